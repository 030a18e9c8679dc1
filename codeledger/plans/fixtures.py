"""Inputs for the registered queries, derived from the given tables.

One SQL text per input, written so that Spark and the checking database read it alike.
``$orders``, ``$part`` and ``$pages`` stand for the tables. Every order becomes an inquiry
about one part; the part table is used whole.
"""

from string import Template

from pyspark.sql import DataFrame, SparkSession

_RAW1 = """CASE WHEN k % 13 = 0 THEN 'no structured data' ELSE
  '{"product_identification": "' || p_name || '", "materials": ["steel", "' || lower(p_type)
  || '"], "function": "fixing", "category_hint": "metal article", "is_set": false, "is_part": '
  || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', "missing_information": ['
  || CASE WHEN k % 3 = 0 THEN '"composition"' ELSE '' END || '], "ambiguities": [], "data_quality": "'
  || CASE WHEN k % 3 = 0 THEN 'low' ELSE 'high' END || '"}' END"""

_RAW2 = """'STEP 1 - interpret' || chr(10) || '  STEP 4 - apply GIR 1' || chr(10) || chr(10)
  || 'Heading ' || substr(cn8, 1, 4) || ' fits' || chr(10) || 'done' || chr(10)
  || '{"cn_code": "' || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE cn8 END
  || '", "taric_code": "' || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
       WHEN k % 11 = 0 THEN cn8 ELSE cn8 || '00' END
  || '", "cn_description": "' || p_name || '", "candidate_headings": ["' || substr(cn8, 1, 4)
  || '", "8413"], "confidence": "' || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' ELSE 'LOW' END
  || '", "warnings": [' || CASE WHEN k % 3 = 0 THEN '"material unknown", "size Not Provided", "w3"'
       WHEN k % 3 = 1 THEN '"use unclear"' ELSE '' END
  || '], "manual_review_recommended": ' || CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END || '}'
  || CASE WHEN k % 7 = 0 THEN chr(10) || '```' ELSE '' END"""

_RAW3 = """'Validation analysis' || chr(10) || '{"validation_outcome": "'
  || CASE o_orderstatus WHEN 'F' THEN 'VALIDATED' WHEN 'O' THEN 'PARTIALLY VALIDATED' ELSE 'NOT VALIDATED' END
  || '", "validated_code": "' || CASE WHEN k % 6 = 0 THEN '' ELSE cn8 END
  || '", "taric_code": "' || CASE WHEN k % 6 = 0 THEN '' ELSE cn8 || '00' END
  || '", "manual_review_recommended": ' || CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END
  || ', "issues": [' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '"weak support", "notes"' END
  || '], "missing_data": [' || CASE WHEN k % 8 = 0 THEN '"bore", "weight", "origin"' ELSE '' END || ']}'"""

# Some inquiries were never validated.
_HAS_STEP3 = "NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')"
_DESCRIPTION = "p_name || ', ' || p_brand || ', ' || lower(p_type)"
_CN = "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE cn8 END"
_TARIC = """CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
       WHEN k % 11 = 0 THEN cn8 ELSE cn8 || '00' END"""

# In order: a block may read the ones before it.
BLOCKS = {
    "base": """SELECT o_orderkey AS k, 'r' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS row_id,
  o_orderdate AS ts, 'u' || CAST(o_custkey % 20 AS STRING) AS user_name,
  p_name, p_brand, p_type, p_size, o_orderpriority, o_orderstatus,
  lpad(CAST((o_orderkey * 7919) % 100000000 AS STRING), 8, '0') AS cn8
FROM (SELECT $spread *, o_orderkey % (SELECT count(*) FROM $part) AS part_key FROM $orders) o
JOIN $part ON p_partkey = part_key""",
    "inquiries": f"""SELECT k, row_id, ts, CASE WHEN k % 23 = 0 THEN '  ' ELSE user_name END AS user_name,
  CASE WHEN k % 31 = 0 THEN '' ELSE {_DESCRIPTION} END AS description,
  CASE WHEN k % 3 = 0 THEN 'size ' || CAST(p_size AS STRING) ELSE '' END AS specs,
  k % 62 = 0 AS has_image, k % 93 = 0 AS has_invoice
FROM base""",
    "resp1": f"SELECT row_id, {_RAW1} AS raw1 FROM base",
    "resp2": f"SELECT row_id, {_RAW2} AS raw2 FROM base",
    "resp3": f"SELECT row_id, {_RAW3} AS raw3 FROM base WHERE {_HAS_STEP3}",
    # An inquiry with its answers on one row: what inquiries and resp1..3 give joined by row_id.
    "cases": f"""SELECT row_id, ts, CASE WHEN k % 23 = 0 THEN '  ' ELSE user_name END AS user_name,
  CASE WHEN k % 31 = 0 THEN '' ELSE {_DESCRIPTION} END AS description,
  CASE WHEN k % 3 = 0 THEN 'size ' || CAST(p_size AS STRING) ELSE '' END AS specs,
  k % 62 = 0 AS has_image, k % 93 = 0 AS has_invoice,
  {_RAW1} AS raw1, {_RAW2} AS raw2, CASE WHEN {_HAS_STEP3} THEN {_RAW3} END AS raw3
FROM base""",
    "followup_raw": """SELECT row_id, CASE WHEN k % 2 = 0
  THEN '{"questions": ["What material - steel or other?", "Fixed or removable?"]}'
  ELSE 'Questions:' || chr(10) || '1. What material?' || chr(10) || '2) Diameter in mm?' || chr(10) || 'Thanks' END AS raw_q
FROM base WHERE o_orderpriority = '4-NOT SPECIFIED'""",
    "answers": """SELECT row_id, pos,
  CASE pos WHEN 1 THEN 'Material - steel or other?' WHEN 2 THEN 'Use?' ELSE 'Diameter?' END AS question,
  CASE WHEN pos = 1 THEN 'steel' WHEN pos = 2 AND k % 2 = 0 THEN ' N/A ' WHEN pos = 2 THEN 'pipes'
       WHEN k % 5 = 0 THEN ' ' ELSE '40 mm' END AS answer
FROM (SELECT *, $each_pos AS pos FROM base WHERE o_orderpriority = '4-NOT SPECIFIED') n""",
    "history": f"""SELECT k, row_id, ts, user_name, {_DESCRIPTION} AS description,
  {_CN} AS cn_code, {_TARIC} AS taric_code,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN k % 17 = 0 THEN 'UNKNOWN' WHEN o_orderstatus = 'F' THEN 'VALIDATED'
       WHEN o_orderstatus = 'O' THEN 'PARTIALLY VALIDATED' ELSE 'NOT VALIDATED' END AS outcome,
  CASE WHEN k % 5 = 0 THEN 'yes' WHEN k % 5 = 1 THEN ' Yes ' ELSE 'no' END AS senior_reviewed,
  CASE WHEN k % 5 > 1 THEN '' WHEN k % 2 = 0 THEN 'CONFIRMED'
       WHEN k % 3 = 0 THEN 'REJECTED' ELSE 'NEEDS_MORE_INFO' END AS senior_verdict,
  CASE WHEN k % 5 > 1 THEN '' WHEN k % 15 <> 0 THEN 's' || CAST(k % 4 AS STRING) END AS senior_user
FROM base""",
    "reviews": """SELECT row_id, seq, CASE WHEN (k + seq) % 3 = 0 THEN 'CONFIRMED' WHEN (k + seq) % 3 = 1 THEN 'REJECTED'
  ELSE 'NEEDS_MORE_INFO' END AS verdict, 's' || CAST(k % 4 AS STRING) AS senior_user,
  'note ' || CAST(seq AS STRING) AS comment, ts + INTERVAL '1' HOUR * seq AS reviewed_at
FROM (SELECT *, $each_seq AS seq FROM base WHERE o_orderstatus <> 'O') n
WHERE seq = 1 OR o_orderpriority = '1-URGENT'""",
    # Page sources as attachment files of several types.
    "attachments": """SELECT page_id, 'page' || CAST(page_id AS STRING) || CASE page_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg'
    WHEN 2 THEN '.pdf' WHEN 3 THEN '.html' WHEN 4 THEN '.webp' ELSE '' END AS path, html,
  CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN 'image/png' WHEN page_id % 4 = 2 THEN 'application/pdf' END AS mime
FROM (SELECT $spread * FROM $pages) p""",
}

# Which inquiry a file belongs to: two pages each for those with an image.
FILE_OF = "'r' || lpad(CAST(CAST(31 * (page_id - page_id % 2) AS BIGINT) AS STRING), 9, '0')"
# What a reviewer sends along with a review; some rows are not in the ledger.
REVIEWED = (
    "CASE WHEN row_id LIKE '%7' THEN 'x' || row_id ELSE row_id END AS row_id",
    "'0' || right(row_id, 7) AS cn_code", "'0' || right(row_id, 7) || '10' AS taric_code", "'Valve No. ' || right(row_id, 3) || ', Brass' AS description",
)

_READS = {
    name: next((other for other in ("base", "pages") if f"FROM {other}" in text or f"FROM ${other}" in text), None)
    for name, text in BLOCKS.items()
}
# Column names that are keywords in SQL carry other names in the texts above.
_NAMES = {"ts": "timestamp", "user_name": "user"}


def _fill(block: str, **values: str) -> str:
    return Template(BLOCKS[block]).substitute(values)


# The columns read, declared so that no file is opened to find them out.
_TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "pages": "page_id bigint, html string",
}


def spark_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = {table: spark.read.schema(columns).parquet(f"{sf_dir}/{table}.parquet") for table, columns in _TABLES.items()}
    cores = spark.sparkContext.defaultParallelism
    # The row multipliers are a generator per dialect: no join with a list of numbers.
    values = {
        "each_pos": "explode(array(1, 2, 3))",
        "each_seq": "explode(array(1, 2))",
        "spread": f"/*+ REPARTITION({cores}) */",
    }
    values |= {table: f"<{table}>" for table in read}
    query = f"WITH base AS ({_fill('base', **values)}) " if _READS[name] == "base" else ""
    query = (query + _fill(name, **values)).replace("{", "{{").replace("}", "}}")
    for table in read:
        query = query.replace(f"<{table}>", f"{{{table}}}")
    used = {table: rows for table, rows in read.items() if f"{{{table}}}" in query}
    return spark.sql(query, **used).withColumnsRenamed(_NAMES)


def duckdb_fixtures(*names: str) -> str:
    """The blocks as a list of common table expressions for the checking SQL."""
    values = {table: table for table in _TABLES}
    values |= {"each_pos": "unnest([1, 2, 3])", "each_seq": "unnest([1, 2])", "spread": ""}
    needed = (["base"] if any(_READS[name] == "base" for name in names) else []) + list(names)
    return ", ".join(f"{name} AS ({_fill(name, **values)})" for name in needed)
