import pytest
from pyspark.sql import functions as F

#: Awkward texts that every operator on documents must take.
ODD_TEXTS = [None, "", " \n\t ", "one", "two words", "a b c", "... 123 !!", "x" * 200_000, "la la la " * 2_000, "tab\tand  two spaces \n", "日本語 text ☃ 😀", "same text here", "same text here", "<|endoftext|> literal"]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null ids, repeated rows, awkward texts, and columns whose names clash with results."""
    rows = [(k, text) for k, text in enumerate(ODD_TEXTS)] + [(None, "no id at all"), (3, "one"), (3, "one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = {name: F.lit("clash") for name in ("kept", "start", "length", "score", "lang_pred", "n_shingles", "component_id", "sequence_id", "class", "member", "leader", "root", "band", "bands", "held_out")}
    return frame.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **clashing}).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
