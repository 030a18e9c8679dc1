"""Checking SQL for the operators that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from codeledger.llm.preference import BREAK, CLOSE, OPEN, TRAINED
from codeledger.llm.url_templates import RULES, VARIABLE

#: All pairs of the query set and the table, by integer inner product.
TOP_K = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _url_templates(variety: int = 20, support: float = 0.02, z: float = 2.0, smoothing: float = 10.0, purity: float = 0.8, confidence: float = 1.645) -> str:
    rule = block = ""
    for one in sorted(RULES, key=lambda one: (-len(one.text), one.text)):
        fits = f"(host = '{one.host}' OR ends_with(host, '.{one.host}')) AND starts_with(path, '{one.path}')"
        rule, block = rule + f" WHEN {fits} THEN '{one.text}'", block + f" WHEN {fits} THEN {str(one.block).lower()}"
    return f"""
WITH RECURSIVE urls AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), parted AS (
  SELECT page_id, host, path, string_split(regexp_replace(path, '^/|/$', '', 'g'), '/') AS raw, TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) AS doc_id FROM urls
), marked AS (
  SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id
), shaped AS (
  SELECT page_id, host, path, bad, list_transform(raw, lambda s: CASE WHEN regexp_matches(regexp_replace(s, '\\.[A-Za-z]{{1,5}}$', ''), '{VARIABLE}') THEN '*' ELSE regexp_replace(s, '\\.[A-Za-z]{{1,5}}$', '') END) AS parts
  FROM parted LEFT JOIN marked USING (doc_id)
), counts AS (
  SELECT host, parts, count(*) AS n, count(bad) AS labelled, count(*) FILTER (bad) AS bad FROM shaped GROUP BY host, parts
), walk AS (
  SELECT host, parts, n, labelled, bad, host AS template, 0 AS level FROM counts
  UNION ALL
  SELECT host, parts, n, labelled, bad, template || '/' || CASE WHEN part = '*' OR (kinds > 1 AND (
    (kinds > {variety} AND part_n < {support} * all_n) OR here = 0
    OR (al > here AND (b * (al - here) - (ab - b) * here) * (b * (al - here) - (ab - b) * here) * al <= {z * z} * here * (al - here) * ab * (al - ab)))) THEN '*' ELSE part END, level + 1
  FROM (
    SELECT *, sum(n) OVER same AS part_n, CAST(sum(labelled) OVER same AS DOUBLE) AS here, CAST(sum(bad) OVER same AS DOUBLE) AS b,
      sum(n) OVER node AS all_n, CAST(sum(labelled) OVER node AS DOUBLE) AS al, CAST(sum(bad) OVER node AS DOUBLE) AS ab, count(DISTINCT part) OVER node AS kinds
    FROM (SELECT *, parts[level + 1] AS part FROM walk WHERE len(parts) > level)
    WINDOW same AS (PARTITION BY template, part), node AS (PARTITION BY template)
  )
), tree AS (SELECT * FROM walk WHERE level = len(parts)),
share AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0.0) AS share FROM tree),
sums AS (SELECT template, sum(labelled) AS labelled, sum(bad) AS bad FROM tree GROUP BY template),
judged AS (
  SELECT template, (bad + {smoothing} * share) / (labelled + {smoothing}) AS bad_share, CASE WHEN labelled > 0 THEN
    (bad / labelled + {confidence * confidence} / labelled / 2 - {confidence} * sqrt(bad / labelled * (1 - bad / labelled) / labelled + {confidence * confidence} / labelled / (4 * labelled))) / (1 + {confidence * confidence} / labelled) >= {purity}
    ELSE false END AS sure
  FROM sums, share
)
SELECT page_id, host, path, CASE{rule} END AS rule,
  CASE WHEN coalesce(CASE{block} END, sure OR bad_share >= {purity}) THEN 'block' ELSE 'allow' END AS verdict, template, bad_share
FROM shaped JOIN (SELECT host, parts, template, bad_share, sure FROM tree JOIN judged USING (template)) USING (host, parts)
"""


URL_TEMPLATES = _url_templates()


def _preference() -> str:
    text = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
    shown = lambda x: f"{text(OPEN)} || {x}.role || {text(BREAK)} || {x}.text || {text(CLOSE)}"
    joined = lambda turns: f"coalesce(array_to_string(list_transform({turns}, lambda x: {shown('x')}), ''), '')"
    head = f"'-' || {text(OPEN)} || x.role || {text(BREAK)}"
    pieces = lambda turns: (
        f"coalesce(array_to_string(list_transform({turns}, lambda x: {head} || CASE WHEN x.role = '{TRAINED}' THEN '+' ELSE '-' END || x.text || {text(CLOSE)}), ''), '')"
    )
    trained = lambda turns: f"CAST(coalesce(list_sum(list_transform(list_filter({turns}, lambda x: x.role = '{TRAINED}'), lambda x: length(x.text) + {len(CLOSE)})), 0) AS BIGINT)"
    columns = ", ".join(
        f"{joined(f'{side}[p + 1:]')} AS {side}_text, {trained(f'{side}[p + 1:]')} AS {side}_trained, {pieces(f'{side}[p + 1:]')} AS {side}_pieces" for side in ("chosen", "rejected")
    )
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
lasts AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM c
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM c JOIN lasts USING (conv_id) WHERE turn < last
  UNION ALL SELECT a.conv_id, 'rejected', a.last, role, text FROM lasts a JOIN lasts b ON b.conv_id = xor(a.conv_id, 1) JOIN c ON c.conv_id = b.conv_id AND c.turn = b.last AND role = 'assistant'
), pairs AS (
  SELECT pair_id,
    coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 'chosen'), []) AS chosen,
    coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (side = 'rejected'), []) AS rejected
  FROM sides GROUP BY pair_id
), cut AS (
  SELECT *, coalesce(list_min(list_filter(range(0, least(len(chosen), len(rejected))), lambda i: chosen[i + 1] <> rejected[i + 1])), least(len(chosen), len(rejected))) AS p FROM pairs
)
SELECT pair_id, CAST(p AS BIGINT) AS prefix_turns, {joined("chosen[1:p]")} AS prompt, {columns} FROM cut
"""


PREFERENCE = _preference()


def _repair() -> str:
    """The damage, the faults, and the dynamic program as a recursion over rows: for each state the least (cost, audit, output)."""
    string = lambda name: f"coalesce(CAST({name} AS VARCHAR), ' ')"
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    # The checksum bit by bit: a byte is mixed in, then eight shifts follow (marked -1).
    steps = "flatten(list_transform(string_split(k, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce({steps}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295), 4294967295)"

    def edit(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NULL THEN NULL ELSE {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {line}}} END"

    def put(role: str) -> str:
        return f"chr(10) || '{role}:'"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def kept(state: str, initial: str, role: str) -> list[str]:
        keep = edit(state, "cut", "K", "chr(10) || role || ':' || text")
        rerole = edit(state, "2 + cut", "R", f"{put(role)} || text")
        return [f"CASE WHEN NOT gone AND initial = '{initial}' THEN {keep} END", f"CASE WHEN NOT gone THEN {rerole} END"]

    def inserted(rows: str) -> str:
        twice = lambda s: f"CASE WHEN {s} IS NULL THEN NULL ELSE {{'c': {s}.c + 4, 'a': {s}.a || 'II', 'o': {s}.o || {put('user')} || {put('assistant')}}} END"
        user = [edit(s, "2", "I", put("user")) for s in ("n0", "n1", "n3")]
        return f"SELECT conv_id, rn, n0 AS s0, n1 AS s1, {least('n2', *user)} AS s2, {least('n3', edit('n2', '2', 'I', put('assistant')), twice('n0'), twice('n1'))} AS s3 FROM ({rows})"

    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"
    begin = f"SELECT conv_id, CAST(0 AS BIGINT) AS rn, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS n0, {none} AS n1, {none} AS n2, {none} AS n3 FROM convs"
    row = f"""SELECT s.conv_id, f.rn, {edit("s0", "3", "D")} AS n0,
      {least(edit("s1", "3", "D"), f"CASE WHEN NOT gone AND initial = 's' THEN {edit('s0', 'cut', 'K', 'chr(10) || role || chr(58) || text')} END")} AS n1,
      {least(edit("s2", "3", "D"), *kept("s0", "u", "user"), *kept("s1", "u", "user"), *kept("s3", "u", "user"))} AS n2,
      {least(edit("s3", "3", "D"), *kept("s2", "a", "assistant"))} AS n3
    FROM steps s JOIN faults f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.rn = s.rn + 1"""
    return f"""
WITH RECURSIVE read AS (
  SELECT conv_id, turn, {string("role")} AS role, {string("text")} AS text, {string("conv_id")} || ':' || {string("turn")} AS k FROM conversations
), convs AS (SELECT DISTINCT conv_id FROM conversations),
hit AS (SELECT *, {crc} % 20 AS fault FROM read),
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(CASE fault WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END) AS copies(i)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, left(role, 1) AS initial,
    rtrim(text, {spaces}) AS bare
  FROM damaged
), seen AS (
  SELECT *, bare = '' AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS is_repeat, right(bare, 1) NOT IN ('.', '!', '?') AS is_cut,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) AS prior
  FROM placed
), faults AS (
  SELECT conv_id, rn, turn, role, text, initial, prior, is_blank, NOT is_blank AND is_repeat AS is_repeat, NOT is_blank AND NOT is_repeat AND is_cut AS is_cut,
    is_blank OR is_repeat AS gone, CASE WHEN NOT is_blank AND NOT is_repeat AND is_cut THEN 1 ELSE 0 END AS cut
  FROM seen
), steps AS (
  {inserted(begin)}
  UNION ALL
  {inserted(row)}
), sums AS (
  SELECT conv_id, max(rn) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (is_repeat) AS duplicate, count(*) FILTER (is_cut) AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), best AS (
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, list_min([s0, s3]) AS won
  FROM convs c LEFT JOIN sums t ON c.conv_id IS NOT DISTINCT FROM t.conv_id JOIN steps s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.rn = coalesce(t.n, 0)
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, won.c AS cost, won.a AS audit, sha256(substr(won.o, 2)) AS repaired_sha256 FROM best
"""


CONVERSATION_REPAIR = _repair()

def _captures() -> str:
    """Digests in base 32: five hexadecimal digits at a time are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = "CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT)"
    digest = f"array_to_string(list_transform(range(32), lambda i: substr('{letters}', CAST(1 + (({part} >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), '')"
    return f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex, url FROM pages),
ranked AS (
  SELECT *, row_number() OVER same AS n, first_value(page_id) OVER same AS response FROM hashed
  WINDOW same AS (PARTITION BY hex ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {digest} AS payload_digest,
  CASE n WHEN 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN response END AS refers_to
FROM ranked
"""


CAPTURES = _captures()

ORACLES: dict[str, str] = {
    "op3_exact_top_k": TOP_K,
    "op7_url_templates": URL_TEMPLATES,
    "op9_preference_format": PREFERENCE,
    "op12_capture_index": CAPTURES,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
