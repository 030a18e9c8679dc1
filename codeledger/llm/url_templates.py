"""URL filters: host and path rules, and a tree of path templates per host judged by labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import stored

ANY = "*"
#: Comes after every segment (the last code point).
LAST = "\U0010ffff"
#: Segments that vary: numbers, and hexadecimal names with a digit.
VARIABLE = r"^([0-9]+|[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]{7,}|[0-9A-Fa-f-]{7,}[0-9][0-9A-Fa-f-]*)$"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    block: bool

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


#: Fixed values of the contract.
RULES = (Rule("net", "/", True), Rule("example.net", "/en/", False), Rule("example.com", "/de/", True), Rule("org", "/fr/", False))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    name = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(name: Column, where: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The text of the longest rule that fits and whether it blocks; null where none fits.

    Rules are few and belong to the query, so they stand in the plan as one CASE, longest first.
    """
    text, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda rule: (len(rule.text), rule.text)):
        fits = ((name == rule.host) | F.endswith(name, F.lit("." + rule.host))) & F.startswith(where, F.lit(rule.path))
        text, block = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.block)).otherwise(block)
    return text, block


def segments(where: Column) -> Column:
    """The segments of a path, numbers and long hexadecimal names as ``*``, file endings off."""

    def shape(part: Column) -> Column:
        body = F.regexp_replace(part, r"\.[A-Za-z]{1,5}$", "")
        return F.when(body.rlike(VARIABLE), F.lit(ANY)).otherwise(body)

    parts = F.split(F.regexp_replace(where, "^/|/$", ""), "/")
    return F.transform(parts, shape)


def lower_bound(bad: Column, labelled: Column, z: float) -> Column:
    """The least share of bad pages that the labelled ones leave likely (Wilson's interval); null without labels."""
    n = F.nullif(labelled, F.lit(0)).cast("double")
    share, over = bad / n, F.lit(z * z) / n
    return (share + over / 2 - F.lit(z) * F.sqrt(share * (1 - share) / n + over / (4 * n))) / (1 + over)


def template_tree(counts: DataFrame, variety: int, support: float, z: float) -> DataFrame:
    """Generalise the templates of each host, level by level from the host down.

    counts: host, parts, n (pages), labelled, bad. Below a node a segment becomes ``*`` if it is rare
    (fewer than ``support`` of the node's pages, where the node has more than ``variety`` segments),
    or if its labelled pages are bad about as often as those of the node's other segments: the
    two-proportion statistic is at most ``z``, or it has no labelled page. Branches under the same
    ``*`` are one from there on. Segments that all longer paths below a node share are taken at once, whatever paths
    end on the way, so long urls make no long walk: a round is a level at which templates part. Adds ``template``. Counts are summed before they
    are dealt out, so a large host is no large group; only its different templates are rows here.
    """
    # A template has a segment for each that was taken, so rows of one template have taken as many.
    rows = stored(counts.withColumns({"template": F.col("host"), "rest": F.col("parts")}), "url-tree")
    while not rows.filter(F.size("rest") > 0).isEmpty():
        part = F.when(F.size("rest") > 0, F.get("rest", F.lit(0)))
        rows = rows.withColumn("part", part)
        open_ = rows.filter("part IS NOT NULL")
        branches = open_.groupBy("template", "part").agg(*(F.sum(name).alias(name) for name in ("n", "labelled", "bad")))
        nodes = branches.groupBy("template").agg(F.count("*").alias("kinds"), *(F.sum(name).alias(f"all_{name}") for name in ("n", "labelled", "bad")))
        here, there, all_ = F.col("labelled").cast("double"), (F.col("all_labelled") - F.col("labelled")).cast("double"), F.col("all_labelled").cast("double")
        apart = F.col("bad") * there - (F.col("all_bad") - F.col("bad")) * here
        similar = (here == 0) | ((there > 0) & (apart * apart * all_ <= F.lit(z * z) * here * there * F.col("all_bad") * (all_ - F.col("all_bad"))))
        rare = (F.col("kinds") > variety) & (F.col("n") < F.lit(support) * F.col("all_n"))
        wide = branches.join(nodes, "template").filter((F.col("part") == ANY) | ((F.col("kinds") > 1) & (rare | similar)))
        named = wide.select("template", "part", F.lit(ANY).alias("as"))
        rows = rows.join(named, ["template", "part"], "left").join(_shared(open_), "template", "left")
        taken = F.greatest(F.least(F.col("shared"), F.size("rest")), F.lit(1))
        name = F.when(F.col("part").isNull(), F.col("template")).when(F.col("shared") > 0, F.concat_ws("/", F.col("template"), F.slice("rest", F.lit(1), taken))).otherwise(F.concat("template", F.lit("/"), F.coalesce("as", "part")))
        rest = F.when(F.col("part").isNull(), F.col("rest")).otherwise(F.slice("rest", taken + 1, F.greatest(F.size("rest"), F.lit(1))))
        rows = stored(rows.withColumns({"template": name, "rest": rest}).drop("as", "part", "shared"), "url-tree")  # each round reads the one above several times
    return rows.drop("rest")


def _shared(rows: DataFrame) -> DataFrame:
    """How many segments the rests below a template share until two of them differ; ends before that do no harm.

    In the order of lists the greatest rest, and the least one where an end comes after every segment, are the first
    to differ of all; where none do, both are the longest.
    """
    ended = F.concat("rest", F.array(F.lit(LAST)))
    ends = rows.groupBy("template").agg(F.min(ended).alias("least"), F.max("rest").alias("greatest"))
    least = F.slice("least", F.lit(1), F.size("least") - 1)
    differs = F.array_position(F.zip_with(least, "greatest", lambda a, b: a.eqNullSafe(b)), False)
    return ends.select("template", F.when(differs > 0, differs - 1).otherwise(F.size("greatest")).cast("int").alias("shared"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, variety: int = 20, support: float = 0.02, z: float = 2.0, smoothing: float = 10.0, purity: float = 0.8, confidence: float = 1.645
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_share.

    pages: page_id, url. labels: page_id, bad (boolean); a page with several is bad if one says so.
    A url under a rule has the verdict of the longest one. The others have that of their template
    (see template_tree): blocked if its smoothed share of bad pages, (bad + smoothing * share in the
    whole table) / (labelled + smoothing), or the lower bound of its own share (see lower_bound, with
    ``confidence``) is ``purity`` or more: eleven labelled pages, all bad, are enough. All pages count, those under rules
    too. A null url or one without ``://`` has an empty host and path and is judged like any other.
    Repeated rows count and come out each; null ids have no label. Ties make no difference: all
    choices are by comparison with a bound. Empty tables give no rows. Only the named columns are read.
    """
    name, where = host(F.col("url")), path(F.col("url"))
    rows = pages.select("page_id", name.alias("host"), where.alias("path")).withColumn("parts", segments(F.col("path")))
    marks = labels.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counts = rows.join(marks, "page_id", "left").groupBy("host", "parts").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    tree = template_tree(counts, variety, support, z)
    sums = tree.groupBy("template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # The table's own share: one row, whatever the size of the input.
    share = tree.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("share"))
    judged = sums.crossJoin(F.broadcast(share)).select("template", ((F.col("bad") + F.lit(smoothing) * F.col("share")) / (F.col("labelled") + F.lit(smoothing))).alias("bad_share"), F.coalesce(lower_bound(F.col("bad"), F.col("labelled"), confidence) >= purity, F.lit(False)).alias("sure"))
    verdicts = tree.select("host", "parts", "template").join(judged, "template")
    rule, block = matching_rule(F.col("host"), F.col("path"), rules)
    joined = rows.join(verdicts, ["host", "parts"])
    blocked = F.coalesce(block, F.col("sure") | (F.col("bad_share") >= purity))
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"), "template", "bad_share")
