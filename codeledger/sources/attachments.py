"""Attachment files as payloads for the model function."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeledger.functions.text import as_column, blank_to_null

# Accepted file types and the media type of files that state none.
IMAGE_TYPES = ("jpg", "jpeg", "jfif", "png", "webp")
INVOICE_TYPES = IMAGE_TYPES + ("pdf",)
DEFAULT_MEDIA_TYPE = "image/jpeg"


def read_attachments(spark: SparkSession, path: str, types: Sequence[str] = INVOICE_TYPES) -> DataFrame:
    """``path, content`` of the accepted files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return accepted(files.select("path", "content"), types)


def accepted(files: DataFrame, types: Sequence[str] = INVOICE_TYPES, name: str = "path") -> DataFrame:
    """Files whose name ends in one of the types, in either case."""
    extension = F.lower(F.substring_index(F.col(name), ".", -1))
    return files.filter(F.contains(F.col(name), F.lit(".")) & extension.isin(*types))


def media_type(stated: Column | str) -> Column:
    return F.coalesce(blank_to_null(stated), F.lit(DEFAULT_MEDIA_TYPE))


def encoded(content: Column | str) -> Column:
    """Base64 on one line."""
    return F.translate(F.base64(as_column(content)), "\r\n", "")


def attachment_payload(files: DataFrame, content: str = "content", stated: str = "mime") -> DataFrame:
    """Add ``media_type, data``: what a model function is given of a file."""
    return files.withColumns({"media_type": media_type(stated), "data": encoded(content)})


def by_request(payloads: DataFrame, order: str = "path") -> DataFrame:
    """``row_id, files``: the payloads of each request as one array. A request has the files of one form."""
    gathered = payloads.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(order, "media_type", "data"))).alias("files"))
    return gathered.select("row_id", F.transform("files", lambda file: F.struct(file["media_type"], file["data"])).alias("files"))
