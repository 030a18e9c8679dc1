"""The same results in DuckDB's SQL, one statement per registered query.

Written from the rules, over the same inputs; nothing here is run by Spark.
"""

from __future__ import annotations

from codeledger import schemas
from codeledger.plans.fixtures import FILE_OF, REVIEWED, duckdb_fixtures

_SEP = "' | '"
_NL = "chr(10)"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _strip(x: str) -> str:
    return f"trim({x}, {_WHITE})"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tail(raw: str) -> str:
    found = rf"regexp_extract({raw}, '(\{{[^{{]*)$', 1)"
    return f"CASE WHEN json_valid({found}) THEN {found} END"


def _text(json: str, field: str) -> str:
    return f"({json}->>'$.{field}')"


def _flag(json: str, field: str) -> str:
    return f"coalesce({json}->>'$.{field}' = 'true', false)"


def _list(json: str, field: str) -> str:
    return f"coalesce(CAST({json}->'$.{field}' AS VARCHAR[]), CAST([] AS VARCHAR[]))"


def _joined(items: str, separator: str = _SEP) -> str:
    return f"array_to_string({items}, {separator})"


def _fingerprint(x: str, limit: int | None = None) -> str:
    words = f"string_split_regex(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +')"
    return f"array_to_string(list_sort(list_distinct(list_filter({words}, lambda w: w <> ''))){f'[1:{limit}]' if limit else ''}, ' ')"


def _with(*blocks: str, select: str, **ctes: str) -> str:
    more = "".join(f", {name} AS ({text})" for name, text in ctes.items())
    return f"WITH {duckdb_fixtures(*blocks)}{more} {select}"


_PARSED = f"SELECT *, {_tail('raw1')} AS json1, {_tail('raw2')} AS json2, {_tail('raw3')} AS json3 FROM cases"
_NEEDS = f"(json2 IS NULL OR {_strip('coalesce(' + _text('json2', 'cn_code') + ', ' + _q('') + ')')} = '')"
_RESULT = f"""coalesce({_text('json3', 'validation_outcome')}, 'UNKNOWN') AS outcome,
  coalesce(nullif({_text('json3', 'validated_code')}, ''), nullif({_text('json2', 'cn_code')}, ''), '') AS code,
  coalesce(nullif({_text('json3', 'taric_code')}, ''), nullif({_text('json2', 'taric_code')}, ''), '') AS taric,
  {_flag('json3', 'manual_review_recommended')} OR {_flag('json2', 'manual_review_recommended')} AS manual,
  {_list('json3', 'issues')} AS result_issues"""
_RESOLVED = f"SELECT *, {_RESULT} FROM parsed"


def _over_cases(select: str, **ctes: str) -> str:
    return _with("cases", select=select, parsed=_PARSED, **ctes)


_VERIFIED = f"""SELECT row_id, {_fingerprint('description')} AS mark, cn_code, taric_code, senior_user, ts
FROM history WHERE senior_verdict = 'CONFIRMED'"""
_FIRST = "SELECT * FROM verified WHERE mark <> '' QUALIFY row_number() OVER (PARTITION BY mark ORDER BY ts, row_id) = 1"
_BY = """CASE WHEN f.row_id IS NOT NULL AND f.cn_code = code
  THEN coalesce(f.senior_user, 'senior') || ' on ' || strftime(f.ts, '%Y-%m-%d') END"""
_LOOKED_UP = f"""SELECT c.*, {_BY} AS verified_by FROM resolved c
LEFT JOIN first f ON f.mark = {_fingerprint('c.description')}"""


def _over_lookup(select: str, *blocks: str, **ctes: str) -> str:
    return _with(
        "cases", "history", *blocks, select=select, parsed=_PARSED, resolved=_RESOLVED,
        verified=_VERIFIED, first=_FIRST, looked_up=_LOOKED_UP, **ctes,
    )


_EXCERPT_WORDS = "step 3|step 4|step 5|step 6|step 7|step 8|gir|legal note|heading|subheading|chapter|section"


def _excerpts(raw: str, brief: bool = True) -> str:
    lines = rf"string_split_regex({raw}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]|\x{{85}}|\x{{2028}}|\x{{2029}}')"
    stripped = f"list_transform({lines}, lambda l: {_strip('l')})"
    kept = f"list_filter({stripped}, lambda l: regexp_matches(lower(l), {_q(_EXCERPT_WORDS)}))"
    return f"list_transform({kept}[1:20], lambda l: l[1:120])" if brief else kept


_QA = """SELECT row_id, list({'q': question, 'a': answer} ORDER BY pos) AS qa,
  bool_and(trim(answer) <> '') AS complete FROM answers GROUP BY row_id"""
_CONTEXT = f"array_to_string(list_transform(qa, lambda p: '- ' || p.q || ': ' || p.a), {_NL})"
_QA_TEXT = "array_to_string(list_transform(qa, lambda p: 'Q: ' || p.q || ' → A: ' || p.a), ' | ')"


def _tree(qa: str | None, brief: bool = True) -> str:
    """The audit text: a list of lines, nulls left out."""

    def cut(x: str, width: int) -> str:
        return f"left({x}, {width})" if brief else x

    def dash(x: str) -> str:
        return f"coalesce({x}, '—')"

    def each(label: str, items: str) -> str:
        return f"list_transform({items}, lambda v: {_q('  ' + label + ': ')} || v)"

    def one_list(label: str, items: str) -> str:
        return f"CASE WHEN len({items}) > 0 THEN {_q('  ' + label + ': ')} || array_to_string({items}, ', ') END"

    def line(label: str, value: str) -> str:
        return f"{_q('  ' + label + ': ')} || {value}"

    def yes(json: str) -> str:
        return f"CASE WHEN {_flag(json, 'manual_review_recommended')} THEN 'YES' ELSE 'no' END"

    def title(text: str) -> str:
        return f"[{_NL} || {_q('▸ ' + text)}]"

    outcome = dash(_text("json3", "validation_outcome"))
    symbol = (
        f"CASE WHEN contains({outcome}, 'VALIDATED') AND NOT contains({outcome}, 'NOT') THEN '✓'"
        f" WHEN contains({outcome}, 'PARTIAL') THEN '~' ELSE '✗' END"
    )
    materials = f"array_to_string({_list('json1', 'materials')}, ', ')"
    excerpts = _excerpts("raw2", brief)
    truth = lambda field: f"CASE WHEN {_flag('json1', field)} THEN 'True' ELSE 'False' END"
    parts = [
        "['CLASSIFICATION DECISION TREE', repeat('=', 60)]",
        title("INPUT"),
        "[" + line("Description ", cut("CASE WHEN description = '' THEN '—' ELSE description END", 120)) + ", "
        + line("Specs       ", cut("nullif(specs, '')", 120)) + "]",
    ]
    if qa:
        pairs = f"flatten(list_transform({qa}, lambda p: ['  Q: ' || {cut('p.q', 80)}, '  A: ' || {cut('p.a', 120)}]))"
        parts.append(
            f"CASE WHEN len({qa}) > 0 THEN list_concat({title('FOLLOW-UP ANSWERS')}, {pairs}) ELSE CAST([] AS VARCHAR[]) END"
        )
    step1 = ", ".join(
        [
            line("Product     ", dash(_text("json1", "product_identification"))),
            line("Materials   ", f"CASE WHEN {materials} = '' THEN '—' ELSE {materials} END"),
            line("Function    ", dash(_text("json1", "function"))),
            line("Form        ", dash(_text("json1", "form"))),
            line("Category    ", dash(_text("json1", "category_hint"))),
            line("Is part     ", truth("is_part")),
            line("Is set      ", truth("is_set")),
            line("Data quality", dash(_text("json1", "data_quality"))),
            one_list("⚠ Missing   ", _list("json1", "missing_information")),
            one_list("⚠ Ambiguous ", _list("json1", "ambiguities")),
        ]
    )
    parts += [
        title("STEP 1 — FEATURE EXTRACTION"),
        f"CASE WHEN json1 IS NULL THEN ['  ⚠ Could not parse structured extraction'] ELSE [{step1}] END",
        title("STEP 2 — CLASSIFICATION REASONING"),
    ]
    step2 = [
        f"[{one_list('Candidates  ', _list('json2', 'candidate_headings'))}]",
        f"CASE WHEN len({excerpts}) > 0 THEN list_concat(['  Reasoning excerpts:'],"
        f" list_transform({excerpts}, lambda l: '  │ ' || l)) ELSE CAST([] AS VARCHAR[]) END",
        "[" + ", ".join(
            [
                line("→ CN code   ", dash(_text("json2", "cn_code"))),
                line("→ TARIC code", dash(_text("json2", "taric_code"))),
                line("Confidence  ", dash(_text("json2", "confidence"))),
            ]
        ) + "]",
        each("⚠ Warning   ", _list("json2", "warnings")),
        "[" + line("Manual review", yes("json2")) + "]",
    ]
    step3 = [
        "[" + line("Outcome     ", f"({symbol}) || ' ' || {outcome}") + ", "
        + line("Final code  ", dash(_text("json3", "validated_code"))) + "]",
        each("✗ Issue     ", _list("json3", "issues")),
        each("⚠ Missing   ", _list("json3", "missing_data")),
        "[" + line("Manual review", yes("json3")) + "]",
    ]
    nest = lambda lists: f"flatten([{', '.join(lists)}])"
    parts += [
        f"CASE WHEN json2 IS NULL THEN ['  ⚠ Could not parse classification JSON'] ELSE {nest(step2)} END",
        title("STEP 3 — VALIDATION"),
        f"CASE WHEN json3 IS NULL THEN ['  ⚠ Could not parse validation JSON'] ELSE {nest(step3)} END",
        f"['', repeat('=', 60), '  Generated : ' || strftime(ts, '%Y-%m-%d %H:%M:%S')]",
    ]
    return f"array_to_string(list_filter(flatten([{', '.join(parts)}]), lambda l: l IS NOT NULL), {_NL})"


def _history_text(row_id: str, extra: str = "", qa: str | None = None, brief: bool = False) -> str:
    cut = lambda x, width: f"left({x}, {width})" if brief else x
    step1 = lambda field: f"coalesce({_text('json1', field)}, '')"
    step2 = lambda field: f"coalesce({_text('json2', field)}, '')"
    yes = lambda flag: f"CASE WHEN {flag} THEN 'yes' ELSE 'no' END"
    return f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", user_name AS "user",
  {cut('description', 200)} AS description, {cut('specs', 200)} AS specs,
  {yes('has_image')} AS has_image, {yes('has_invoice')} AS has_invoice,
  {step1('product_identification')} AS product_id, {step1('category_hint')} AS category,
  {step1('data_quality')} AS data_quality,
  {step2('cn_code')} AS cn_code, {step2('taric_code')} AS taric_code, {step2('confidence')} AS confidence,
  outcome, code AS validated_code, {yes('manual')} AS manual_review,
  array_to_string(result_issues, '; ') AS issues, {_tree(qa, brief)} AS decision_tree,
  coalesce(json1, {cut('raw1', 500)}) AS raw_step1, {cut('raw2', 500)} AS raw_step2,
  coalesce({cut('raw3', 500)}, '') AS raw_step3, {_QA_TEXT if qa else "''"} AS followup_qa,
  'no' AS senior_reviewed, '' AS senior_user, '' AS senior_timestamp, '' AS senior_verdict, '' AS senior_comment,
  {row_id} AS row_id{extra}"""


# Requests for the model function, as in the rules for steps 1 to 3.


def _request1(extra: str) -> str:
    parts = [
        "CASE WHEN description <> '' THEN 'Product description / invoice text:' || chr(10) || description END",
        "CASE WHEN specs <> '' THEN 'Technical specifications:' || chr(10) || specs END",
        f"'Additional information provided by the user:' || chr(10) || ({extra})",
    ]
    return f"nullif({_strip(f'concat_ws(chr(10) || chr(10), {", ".join(parts)})')}, '')"


_REQUEST2 = "'Structured product data from feature extractor:' || chr(10) || chr(10) || coalesce(json1, raw1)"
_REQUEST3 = """'Product data:' || chr(10) || coalesce(json1, description) || chr(10) || chr(10)
  || 'Proposed classification:' || chr(10) || coalesce(json2, raw2) || chr(10) || chr(10)
  || 'Full reasoning:' || chr(10) || raw2"""


def _question_request(improve: bool) -> str:
    listed = lambda json, field: f"to_json({_list(json, field)})"
    last = (
        f"""'Current code: ' || coalesce({_text('json2', 'cn_code')}, '') || ' (MEDIUM confidence)' || chr(10) || chr(10)
  || 'Candidate headings: '"""
        if improve
        else "'Candidate headings found: '"
    )
    return f"""'Product description: ' || description || chr(10) || chr(10)
  || 'Step 1 extraction:' || chr(10) || coalesce(json1, raw1) || chr(10) || chr(10)
  || 'Step 2 warnings:' || chr(10) || {listed('json2', 'warnings')} || chr(10) || chr(10)
  || 'Missing information:' || chr(10) || {listed('json1', 'missing_information')} || chr(10) || chr(10)
  || {last} || {listed('json2', 'candidate_headings')}"""


# The stub model's answers, digit for digit.


def _digits(system: str, request: str, files: str = "''") -> str:
    return f"translate(md5('{system}' || chr(10) || coalesce({request}, '') || coalesce({files}, '')), 'abcdef', '012345')"


def _stub_chain(source: str, extra: str, files: str = "''") -> dict[str, str]:
    """The three chained answers over ``source``; ``extra`` is the extra context or NULL, ``files`` what stands for attachments."""
    return {
        "asked1": f"SELECT *, {_digits('extract', _request1(extra), files)} AS d1 FROM {source}",
        "done1": """SELECT *, '{"product_identification": "item ' || left(d1, 6)
  || '", "category_hint": "mixed/other"}' AS raw1 FROM asked1""",
        "read1": f"SELECT *, {_tail('raw1')} AS json1 FROM done1",
        "asked2": f"SELECT *, {_digits('classify', _REQUEST2)} AS d2 FROM read1",
        "done2": """SELECT *, 'Heading ' || left(d2, 4) || chr(10) || '{"cn_code": "'
  || CASE WHEN substr(d2, 9, 1) = '9' THEN '' ELSE left(d2, 8) END || '", "confidence": "HIGH"}' AS raw2 FROM asked2""",
        "read2": f"SELECT *, {_tail('raw2')} AS json2 FROM done2",
        "asked3": f"SELECT *, {_digits('validate', _REQUEST3)} AS d3 FROM read2",
        "done3": """SELECT *, '{"validation_outcome": "VALIDATED", "validated_code": "", "taric_code": "'
  || left(d3, 10) || '"}' AS raw3 FROM asked3""",
        "read3": f"SELECT *, {_tail('raw3')} AS json3 FROM done3",
    }


def _request_key(step: str, system: str, request: str) -> str:
    part = lambda text: f"coalesce(strlen({text}) || ':' || {text}, '-')"
    return f"sha256({part(_q(step))} || {part(_q(system))} || {part(f'({request})')})"


def _store_calls() -> dict[str, str]:
    """The calls of two days: on the first every request in eight fails, and with it what follows."""
    fails = lambda d: f"substr({d}, 10, 1) IN ('8', '9')"
    steps = (("extract", "d1", _request1("NULL"), "true"), ("classify", "d2", _REQUEST2, f"NOT {fails('d1')}"), ("validate", "d3", _REQUEST3, f"NOT {fails('d1')} AND NOT {fails('d2')}"))
    calls = [
        f"""SELECT {_request_key(step, step, request)} AS name, '{step}' AS step,
  1 + CAST({fails(f'any_value({d})')} AND bool_or({asked}) AS BIGINT) AS calls, CAST({fails(f'any_value({d})')} AND bool_or({asked}) AS BIGINT) AS errors
FROM read3 GROUP BY ALL"""
        for step, d, request, asked in steps
    ]
    first = " ".join(f"WHEN {fails(d)} THEN '{step}: RuntimeError: no answer'" for step, d, *_ in steps)
    return {"calls": " UNION ALL ".join(calls).replace("GROUP BY ALL", "GROUP BY name"), "told": f"SELECT *, CASE {first} END AS failed_first FROM read3"}


_ADMITTED = "(description <> '' OR has_image OR has_invoice) AND trim(user_name) <> ''"
_IN_SET = lambda json, field, values: (
    f"CASE WHEN {json} IS NOT NULL THEN coalesce({_text(json, field)}, '') IN ({', '.join(map(_q, values))}) END"
)
_NOT_KNOWN = "('no clue', 'unknown', '?', '', 'n/a')"


def _typed_fields() -> str:
    shown = []
    for step, kind in (("1", schemas.STEP1), ("2", schemas.STEP2), ("3", schemas.STEP3)):
        for field in kind:
            json, name, type_name = f"json{step}", field.name, field.dataType.simpleString()
            if type_name == "array<string>":
                value = _joined(f"CAST({json}->'$.{name}' AS VARCHAR[])")
            else:
                value = _text(json, name)
            shown.append(f"{value} AS step{step}_{name}")
    return ", ".join(shown)


def _contract() -> str:
    confidence = "upper(coalesce(" + _text("json2", "confidence") + ", ''))"
    flags = {
        "category_hint_ok": _IN_SET(
            "json1", "category_hint",
            ("food", "chemical", "machine/electrical", "textile", "metal article", "plastic/rubber", "mixed/other"),
        ),
        "data_quality_ok": _IN_SET("json1", "data_quality", ("high", "medium", "low")),
        "confidence_ok": _IN_SET("json2", "confidence", ("HIGH", "MEDIUM", "LOW")),
        "low_confidence_ok": f"CASE WHEN json2 IS NOT NULL THEN {confidence} <> 'LOW' OR {_flag('json2', 'manual_review_recommended')} END",
        "outcome_ok": _IN_SET(
            "json3", "validation_outcome", ("VALIDATED", "PARTIALLY VALIDATED", "NOT VALIDATED")
        ),
    }
    columns = ", ".join(f"{flag} AS {name}" for name, flag in flags.items())
    absent = [f"CASE WHEN json{n} IS NULL THEN 'step{n} has no payload' END" for n in (1, 2, 3)]
    broken = [f"CASE WHEN NOT {name} THEN '{name[:-3]} breaks the contract' END" for name in flags]
    violations = f"list_filter([{', '.join(absent + broken)}], lambda v: v IS NOT NULL)"
    shown = ", ".join(f"CAST({name} AS VARCHAR) AS {name}" for name in flags)
    return _over_cases(
        f"SELECT row_id, {shown}, {_joined(violations)} AS violations FROM flagged",
        flagged=f"SELECT *, {columns} FROM parsed",
    )


def _verdict_columns() -> str:
    pick = lambda verified, rejected, partial, other: (
        f"CASE WHEN coalesce(verified_by, '') <> '' THEN {verified} WHEN contains(outcome, 'NOT VALIDATED') THEN '{rejected}'"
        f" WHEN contains(outcome, 'PARTIAL') THEN '{partial}' ELSE '{other}' END"
    )
    cn, taric = _text("json2", "cn_description"), _text("json2", "taric_description")
    return f"""{pick("'verified'", "invalid", "partial", "validated")} AS verdict,
  {pick("'✓✓'", "✗", "~", "✓")} AS verdict_icon,
  {pick("'Verified by previous inquiry (' || verified_by || ')'", "Not validated", "Partially validated", "Validated")} AS verdict_label,
  CASE WHEN code = '' THEN '—' ELSE code END || CASE WHEN taric <> '' AND taric <> code THEN ' / ' || taric ELSE '' END AS verdict_code,
  CASE WHEN coalesce({cn}, '') = '' THEN '' WHEN coalesce({taric}, '') NOT IN ('', {cn}) THEN {cn} || ' · ' || {taric} ELSE {cn} END AS verdict_subtitle,
  CASE WHEN manual AND coalesce(verified_by, '') = '' THEN 'Manual review recommended' ELSE '' END AS verdict_note,
  array_to_string(result_issues, '; ') AS verdict_issues"""


def _join_steps() -> dict[str, str]:
    return {
        "parsed": f"""SELECT row_id, {_tail('raw2')} AS json2, {_tail('raw3')} AS json3
FROM resp2 LEFT JOIN resp3 USING (row_id)""",
        "resolved": _RESOLVED,
    }


def _critical() -> str:
    words = "unknown|unspecified|missing|cannot distinguish|insufficient|unclear|not provided"
    return f"len(list_filter({_list('json2', 'warnings')}, lambda w: regexp_matches(lower(w), '{words}'))) >= 2"


_CONFIDENCE = f"upper(coalesce({_text('json2', 'confidence')}, ''))"


def _symbol(x: str, tick: str, half: str, cross: str) -> str:
    return (
        f"CASE WHEN contains({x}, 'VALIDATED') AND NOT contains({x}, 'NOT') THEN '{tick}'"
        f" WHEN contains({x}, 'PARTIAL') THEN '{half}' ELSE '{cross}' END"
    )


def _structure() -> str:
    digits = "length(regexp_replace(taric_code, '[^0-9]', '', 'g'))"
    return _with(
        "history",
        select=f"""SELECT row_id, left(cn_code, 4) AS heading,
  CAST(regexp_full_match(cn_code, '[0-9]{{8}}') AS VARCHAR) AS cn_ok,
  CAST(regexp_full_match(taric_code, '[0-9]{{10}}') AS VARCHAR) AS taric_ok,
  CAST(cn_code <> '' AND starts_with(taric_code, cn_code) AS VARCHAR) AS taric_extends_cn,
  CASE WHEN {digits} < 10 THEN 'TARIC code incomplete - only ' || {digits} || ' digits provided, 10 required for EU import.' END AS structure_issue,
  CASE WHEN {digits} < 10 THEN 'NOT VALIDATED' ELSE outcome END AS checked_outcome
FROM history""",
    )


def oracles() -> dict[str, str]:
    answered = {"qa": _QA}
    blank_rest = ", ".join(
        f"'' AS {name}"
        for name in (
            "specs", "product_id", "category", "data_quality", "validated_code", "issues", "decision_tree",
            "raw_step1", "raw_step2", "raw_step3", "followup_qa", "senior_timestamp", "senior_comment",
        )
    )
    return {
        "history_scan": _with(
            "history",
            select=f"""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", user_name AS "user", description,
  'no' AS has_image, 'no' AS has_invoice, cn_code, taric_code, confidence, outcome, 'no' AS manual_review,
  CASE WHEN lower(trim(senior_reviewed)) = 'yes' THEN 'yes' ELSE 'no' END AS senior_reviewed,
  coalesce(senior_user, '') AS senior_user, senior_verdict, row_id, {blank_rest} FROM history""",
        ),
        "history_row": _over_cases(
            _history_text("left(sha256(row_id), 32)", brief=True) + " FROM resolved", resolved=_RESOLVED
        ),
        "attachment_payload": _with(
            "attachments",
            select="""SELECT page_id, path, coalesce(nullif(mime, ''), 'image/jpeg') AS media_type, to_base64(encode(html)) AS data
FROM attachments WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|jfif|png|webp|pdf)$')""",
        ),
        "admissible_requests": _with(
            "inquiries",
            select=f"""SELECT row_id, CAST({_ADMITTED} AS VARCHAR) AS admitted,
  CASE WHEN description = '' AND NOT has_image AND NOT has_invoice THEN 'no description or attachment'
       WHEN trim(user_name) = '' THEN 'no user' ELSE '' END AS reject_reason FROM inquiries""",
        ),
        "pending_reviews": _with(
            "history",
            select="""SELECT row_id, ts AS "timestamp", user_name AS "user", description, cn_code, outcome, senior_reviewed
FROM history WHERE lower(trim(senior_reviewed)) <> 'yes'""",
        ),
        "history_filter": _with(
            "history",
            select="""SELECT 'pending' AS variant, row_id, outcome, senior_reviewed FROM history
  WHERE outcome IN ('VALIDATED', 'PARTIALLY VALIDATED', 'NOT VALIDATED') AND lower(senior_reviewed) <> 'yes'
UNION ALL SELECT 'reviewed', row_id, outcome, senior_reviewed FROM history WHERE lower(senior_reviewed) = 'yes'""",
        ),
        "history_display": _with(
            "history",
            select="""SELECT ts AS "timestamp", user_name AS "user", description, cn_code, taric_code, confidence, outcome,
  senior_reviewed, senior_verdict, senior_user FROM history
WHERE outcome IN ('VALIDATED', 'PARTIALLY VALIDATED', 'NOT VALIDATED')""",
        ),
        "needs_followup": _over_cases(f"SELECT row_id, CAST({_NEEDS} AS VARCHAR) AS needs_followup FROM parsed"),
        "needs_followup_strict": _over_cases(
            f"SELECT row_id, CAST({_NEEDS} OR {_CONFIDENCE} = 'LOW' OR {_critical()} AS VARCHAR) AS needs_followup FROM parsed"
        ),
        "offer_improvement": _over_cases(
            f"""SELECT row_id, CAST(NOT {_NEEDS} AND {_CONFIDENCE} = 'MEDIUM' AND manual AS VARCHAR) AS first_round,
  CAST(NOT {_NEEDS} AND {_CONFIDENCE} = 'MEDIUM' AS VARCHAR) AS retry_round FROM resolved""",
            resolved=_RESOLVED,
        ),
        "answers_complete": _with(
            "answers",
            select="SELECT row_id, CAST(bool_and(trim(answer) <> '') AS VARCHAR) AS complete FROM answers GROUP BY row_id",
        ),
        "extract_json": _over_cases("SELECT row_id, json1, json2, json3 FROM parsed"),
        "parse_steps": _over_cases(f"SELECT row_id, {_typed_fields()} FROM parsed"),
        "build_step1_input": _with(
            "inquiries",
            select=f"SELECT row_id, {_request1('CASE WHEN has_invoice THEN ' + _q('asked by ') + ' || user_name END')} AS request FROM inquiries",
        ),
        "build_step2_input": _over_cases(f"SELECT row_id, {_REQUEST2} AS request FROM parsed"),
        "build_step3_input": _over_cases(f"SELECT row_id, {_REQUEST3} AS request FROM parsed"),
        "build_followup_input": _over_cases(
            f"SELECT row_id, {_question_request(False)} AS request, {_question_request(True)} AS improve_request FROM parsed"
        ),
        "followup_questions": _with(
            "followup_raw",
            listed=f"""SELECT row_id, {_list(_tail('raw_q'), 'questions')} AS listed,
  list_transform(list_filter(list_transform(string_split(raw_q, chr(10)), lambda l: trim(l)),
    lambda l: regexp_matches(l, '^[0-9]')), lambda l: trim(ltrim(l, '0123456789.-) ')))[1:6] AS numbered FROM followup_raw""",
            chosen="SELECT row_id, CASE WHEN len(listed) > 0 THEN listed ELSE numbered END AS chosen FROM listed",
            select="""SELECT row_id, CAST(generate_subscripts(chosen, 1) AS BIGINT) AS pos, unnest(chosen) AS question FROM chosen""",
        ),
        "followup_context": _with(
            "answers", select=f"SELECT row_id, {_CONTEXT} AS context, {_QA_TEXT} AS followup_qa FROM qa", **answered
        ),
        "followup_pairs": _with(
            "answers",
            select=f"""SELECT row_id, CAST(generate_subscripts(pairs, 1) AS BIGINT) AS pos, unnest(pairs) AS pair
FROM (SELECT row_id, string_split({_QA_TEXT}, ' | ') AS pairs FROM qa)""",
            **answered,
        ),
        "suggest_rewrite": _with(
            "cases", "answers",
            parsed=_PARSED,
            **answered,
            known=f"""SELECT *, array_to_string(list_transform(list_filter(qa, lambda p: lower(trim(p.a)) NOT IN {_NOT_KNOWN}),
  lambda p: trim(string_split(string_split(p.q, '—')[1], '-')[1]) || ': ' || p.a), ', ') AS known
FROM parsed JOIN qa USING (row_id) WHERE {_NEEDS}""",
            select=f"""SELECT row_id, trim(description) || CASE WHEN known <> '' THEN ' (' || known || ')' ELSE '' END AS suggestion,
  {_joined(f"(CASE WHEN len({_list('json3', 'missing_data')}) > 0 THEN {_list('json3', 'missing_data')} ELSE {_list('json1', 'missing_information')} END)[1:6]")} AS missing,
  array_to_string({_list('json2', 'candidate_headings')}, ', ') AS candidates FROM known""",
        ),
        "soft_warnings": _over_cases(
            f"""SELECT row_id, CASE WHEN {_NEEDS} THEN '' ELSE {_joined(f"list_concat(CASE WHEN {_CONFIDENCE} IN ('LOW', 'MEDIUM') THEN {_list('json2', 'warnings')} ELSE CAST([] AS VARCHAR[]) END, {_list('json3', 'missing_data')})[1:5]")} END AS warnings FROM parsed"""
        ),
        "reasoning_excerpts": _with("resp2", select=f"SELECT row_id, {_joined(_excerpts('raw2'))} AS excerpts FROM resp2"),
        "fingerprint": f"SELECT doc_id, {_fingerprint('text', 30)} AS fingerprint FROM documents",
        "decision_tree": _with(
            "cases", "answers",
            parsed=_PARSED, **answered,
            select=f"SELECT row_id, {_tree('qa')} AS decision_tree FROM parsed LEFT JOIN qa USING (row_id)",
        ),
        "resolve_result": _with(
            "resp2", "resp3",
            **_join_steps(),
            select=f"SELECT row_id, outcome, code, taric, CAST(manual AS VARCHAR) AS manual, {_joined('result_issues')} AS result_issues FROM resolved",
        ),
        "verdict_label": _over_lookup(f"SELECT row_id, {_verdict_columns()} FROM looked_up"),
        "outcome_symbol": _with(
            "history",
            select=f"""SELECT row_id, outcome, {_symbol('outcome', '✓', '~', '✗')} AS symbol,
  {_symbol('outcome', '#4a9e4a', '#c8880a', '#c84a4a')} AS color FROM history""",
        ),
        "code_structure": _structure(),
        "contract_check": _contract(),
        "verified_lookup": _with(
            "inquiries", "history",
            verified=_VERIFIED, first=_FIRST,
            select=f"""SELECT i.row_id, f.row_id AS verified_row_id, f.cn_code AS verified_cn_code, f.taric_code AS verified_taric_code,
  f.senior_user AS verified_user, f.ts AS verified_at, CASE WHEN f.row_id IS NOT NULL THEN '' END AS verified_comment
FROM inquiries i LEFT JOIN first f ON f.mark = {_fingerprint('i.description')}""",
        ),
        "verified_by": _over_lookup("SELECT row_id, code, verified_by FROM looked_up"),
        "history_kpis": _with(
            "history",
            select="""SELECT count(*) AS total,
  count(*) FILTER (contains(outcome, 'VALIDATED') AND NOT contains(outcome, 'NOT')) AS validated,
  count(*) FILTER (contains(outcome, 'PARTIAL')) AS partial, count(*) FILTER (contains(outcome, 'NOT VALIDATED')) AS rejected,
  count(*) FILTER (lower(senior_reviewed) = 'yes') AS reviewed FROM history""",
        ),
        "recent_results": _with(
            "history",
            select="""SELECT user_name AS "user", rank, strftime(ts, '%H:%M') AS time, cn_code AS code, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY ts DESC, row_id DESC) AS rank FROM history) WHERE rank <= 10""",
        ),
        "apply_reviews": _with(
            "history", "reviews",
            latest="SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY reviewed_at DESC, seq DESC) = 1",
            select="""SELECT h.row_id, outcome, CASE WHEN l.row_id IS NULL THEN h.senior_reviewed ELSE 'yes' END AS senior_reviewed,
  CASE WHEN l.row_id IS NULL THEN h.senior_user ELSE l.senior_user END AS senior_user, l.reviewed_at AS senior_timestamp,
  coalesce(l.verdict, h.senior_verdict) AS senior_verdict, coalesce(l.comment, '') AS senior_comment
FROM history h LEFT JOIN latest l ON l.row_id = h.row_id""",
        ),
        "folded_history": _with(
            "history", "reviews",
            latest="SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY reviewed_at DESC, seq DESC) = 1",
            select="""SELECT h.row_id, outcome,
  CAST(l.row_id IS NOT NULL OR lower(trim(h.senior_reviewed)) = 'yes' AS VARCHAR) AS senior_reviewed,
  CASE WHEN l.row_id IS NULL THEN h.senior_user ELSE l.senior_user END AS senior_user, l.reviewed_at AS senior_timestamp,
  coalesce(l.verdict, h.senior_verdict) AS senior_verdict, l.comment AS senior_comment
FROM history h LEFT JOIN latest l ON l.row_id = h.row_id""",
        ),
        "history_as_of": _with(
            "history", "reviews",
            latest="SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY reviewed_at DESC, seq DESC) = 1",
            dealt="""SELECT *, lower(trim(senior_reviewed)) = 'yes' AS was_reviewed,
  CASE WHEN right(row_id, 1) IN ('0', '1', '2') THEN 'one' WHEN right(row_id, 1) IN ('3', '4', '5', '6') THEN 'two' ELSE 'three' END AS ingest_batch FROM history""",
            select="""SELECT 'two' AS as_of, row_id, outcome, CAST(was_reviewed AS VARCHAR) AS senior_reviewed, senior_user,
  CAST(NULL AS TIMESTAMP) AS senior_timestamp, senior_verdict, CAST(NULL AS VARCHAR) AS senior_comment, ingest_batch FROM dealt WHERE ingest_batch <> 'three'
UNION ALL SELECT 'last', h.row_id, outcome, CAST(l.row_id IS NOT NULL OR was_reviewed AS VARCHAR),
  CASE WHEN l.row_id IS NULL THEN h.senior_user ELSE l.senior_user END, l.reviewed_at, coalesce(l.verdict, h.senior_verdict), l.comment, ingest_batch
FROM dealt h LEFT JOIN latest l ON l.row_id = h.row_id""",
        ),
        "promote_confirmed": _with(
            "history", "reviews",
            select=f"""SELECT r.row_id, {_fingerprint('h.description')} AS product_fingerprint, h.cn_code, h.taric_code, r.senior_user,
  r.reviewed_at AS senior_timestamp, r.comment AS senior_comment, h.description AS original_description
FROM reviews r JOIN history h ON h.row_id = r.row_id WHERE r.verdict = 'CONFIRMED'""",
        ),
        "submit_reviews": _with(
            "history", "reviews",
            sent=f"SELECT seq, verdict, senior_user, comment, reviewed_at, {', '.join(REVIEWED)} FROM reviews",
            latest="SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY reviewed_at DESC, seq DESC) = 1",
            select=f"""SELECT 'ledger' AS stored_in, h.row_id, h.cn_code, h.taric_code,
  CASE WHEN l.row_id IS NULL THEN h.senior_user ELSE l.senior_user END AS senior_user, l.reviewed_at AS senior_timestamp,
  l.comment AS senior_comment, coalesce(l.verdict, h.senior_verdict) AS senior_verdict,
  h.description AS original_description, '' AS product_fingerprint
FROM history h LEFT JOIN latest l ON l.row_id = h.row_id
UNION ALL SELECT 'verified', row_id, cn_code, taric_code, senior_user, reviewed_at, comment, '', description, {_fingerprint('description')}
FROM sent WHERE verdict = 'CONFIRMED'""",
        ),
        "classification_round": _with(
            "inquiries", "attachments", "history",
            files=f"""SELECT {FILE_OF} AS file_of,
  string_agg(chr(10) || coalesce(nullif(mime, ''), 'image/jpeg') || ' ' || md5(to_base64(encode(html))), '' ORDER BY path) AS files
FROM attachments WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|jfif|png|webp|pdf)$') GROUP BY file_of""",
            admitted=f"SELECT * FROM inquiries LEFT JOIN files ON file_of = row_id WHERE {_ADMITTED}",
            **_stub_chain("admitted", "NULL", "files"),
            resolved=f"SELECT *, {_RESULT} FROM read3",
            verified=_VERIFIED, first=_FIRST, looked_up=_LOOKED_UP,
            select=_history_text("row_id", f", verified_by, {_fingerprint('description')} AS product_fingerprint")
            + f" FROM looked_up WHERE NOT {_NEEDS}",
        ),
        "followup_round": _with(
            "cases",
            parsed=_PARSED,
            asked=f"SELECT row_id, 'What about ' || left({_digits('ask', _question_request(False))}, 4) || '?' AS question FROM parsed WHERE {_NEEDS}",
            told="SELECT row_id, [{'q': question, 'a': 'see ' || row_id}] AS qa FROM asked WHERE right(row_id, 1) <> '0'",
            ready="SELECT parsed.* EXCLUDE (raw1, raw2, raw3, json1, json2, json3), qa FROM parsed JOIN told USING (row_id)",
            **_stub_chain("ready", _CONTEXT),
            resolved=f"SELECT *, {_RESULT} FROM read3",
            select=_history_text("row_id", f", {_fingerprint('description')} AS product_fingerprint, CAST(2 AS BIGINT) AS round", qa="qa")
            + f" FROM resolved WHERE {_ADMITTED}",
        ),
        "three_step_pipeline": _with(
            "inquiries",
            admitted=f"SELECT * FROM inquiries WHERE {_ADMITTED}",
            **_stub_chain("admitted", "NULL"),
            select="SELECT row_id, raw1, raw2, raw3 FROM read3",
        ),
        "answer_store": _with(
            "inquiries",
            admitted=f"""SELECT * FROM inquiries WHERE {_ADMITTED}
UNION ALL SELECT * REPLACE (row_id || '-again' AS row_id) FROM inquiries WHERE {_ADMITTED} AND has_image""",
            **_stub_chain("admitted", "NULL"),
            **_store_calls(),
            select="""SELECT row_id AS name, NULL AS step, failed_first, raw1, raw2, raw3, CAST(NULL AS BIGINT) AS calls, CAST(NULL AS BIGINT) AS errors FROM told
UNION ALL SELECT name, step, NULL, NULL, NULL, NULL, calls, errors FROM calls""",
        ),
        "followup_retry": _with(
            "cases", "answers",
            parsed=_PARSED,
            **answered,
            ready=f"SELECT parsed.* EXCLUDE (raw1, raw2, raw3, json1, json2, json3), qa FROM parsed JOIN qa USING (row_id) WHERE {_NEEDS} AND complete",
            **_stub_chain("ready", _CONTEXT),
            rounds="""SELECT row_id, json2, json3, 1 AS round FROM parsed WHERE row_id NOT IN (SELECT row_id FROM ready)
UNION ALL SELECT row_id, json2, json3, 2 FROM read3""",
            select=f"""SELECT row_id, CAST(round AS BIGINT) AS round, outcome, code, taric, CAST({_NEEDS} AS VARCHAR) AS still_insufficient
FROM (SELECT *, {_RESULT} FROM rounds)""",
        ),
        "stream_log": _over_lookup(
            _history_text("row_id", f", verified_by, {_fingerprint('description')} AS product_fingerprint")
            + f" FROM looked_up WHERE {_ADMITTED} AND NOT {_NEEDS} UNION ALL "
            + _history_text("row_id", f", NULL AS verified_by, {_fingerprint('description')} AS product_fingerprint", qa="qa")
            + f" FROM looked_up JOIN qa USING (row_id) WHERE {_ADMITTED}",
            "answers",
            **answered,
        ),
        "stream_repeats": _over_lookup(
            _history_text("row_id", f", verified_by, {_fingerprint('description')} AS product_fingerprint") + f" FROM looked_up WHERE {_ADMITTED} AND NOT {_NEEDS}"
        ),
        "confirmed_by_fingerprint": _with(
            "history",
            verified=f"SELECT *, {_fingerprint('description')} AS mark FROM history WHERE senior_verdict = 'CONFIRMED'",
            first=_FIRST,
            select="""SELECT mark AS product_fingerprint, row_id, cn_code, taric_code, senior_user, ts AS senior_timestamp, description AS original_description,
  CASE WHEN right(row_id, 1) IN ('0', '1', '2') THEN 'one' WHEN right(row_id, 1) IN ('3', '4', '5', '6') THEN 'two' ELSE 'three' END AS ingest_batch
FROM first""",
        ),
        "verdict_summary": _with(
            "resp2", "resp3",
            **_join_steps(),
            labelled=f"SELECT *, {_verdict_columns()} FROM (SELECT *, CAST(NULL AS VARCHAR) AS verified_by FROM resolved)",
            select="""SELECT verdict, verdict_label, count(*) AS inquiries, count(*) FILTER (manual) AS manual_reviews
FROM labelled GROUP BY verdict, verdict_label""",
        ),
    }
