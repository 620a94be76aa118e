"""Texts, JSON arrays and binary artifacts as tables; what cannot be read is a status of its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intake import utf8

MOST_BYTES = 64 << 20
#: First bytes of media files, in hex, and their kinds.
MAGIC = [("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("474946383761", "image"), ("474946383961", "image"), ("664C6143", "audio"), ("255044462D", "document")]


def read_texts(spark: SparkSession, path: str | list[str], most_bytes: int = MOST_BYTES, mode: str = "monitor") -> DataFrame:
    """(path, text, size_bytes, status): a row a file; Spark passes over files without bytes. Larger files and, but in monitor mode, bytes that are no UTF-8 have no text."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") <= most_bytes
    text, status = utf8(F.when(fits, F.col("content")), mode)
    return files.select("path", F.when(fits, text).alias("text"), F.col("length").alias("size_bytes"), F.when(~fits, "input_too_large").otherwise(status).alias("status"))


def read_json_array(spark: SparkSession, path: str | list[str], element: str = "string") -> DataFrame:
    """(path, pos, value, status): the members of a JSON array in each file, of the type ``element``; a file that is none has one row with a status."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value")
    parsed = files.withColumn("a", F.from_json("value", f"array<{element}>"))
    ok = F.col("a").isNotNull() & F.ltrim("value").startswith("[")
    some = parsed.where(ok).select("path", F.posexplode("a").alias("pos", "value"), F.lit("ok").alias("status"))
    none = parsed.where(~ok).select("path", F.lit(None).cast("int").alias("pos"), F.lit(None).cast(element).alias("value"), F.lit("unreadable").alias("status"))
    return some.unionByName(none)


def sniffed(content: Column, declared: Column) -> Column:
    """The kind of a file by its first bytes, else the declared one."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith(MAGIC[0][0]), MAGIC[0][1])
    for magic, kind in MAGIC[1:]:
        out = out.when(head.startswith(magic), kind)
    riff = head.startswith("52494646") & (F.substring(head, 17, 8) == "57415645")
    return out.when(riff, "audio").when(F.substring(head, 9, 8) == "66747970", "video").otherwise(declared)


def read_artifacts(spark: SparkSession, path: str | list[str], declared: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, content, modality, modality_routed, status): binary files with their kind; ``modality_routed`` names it where it is not the declared one."""
    files = spark.read.format("binaryFile").load(path)
    kind = sniffed(F.col("content"), F.lit(declared))
    fits = F.col("length") <= most_bytes
    return files.select("path", F.when(fits, F.col("content")).alias("content"), kind.alias("modality"), F.when(kind != declared, kind).alias("modality_routed"), F.when(fits, "ok").otherwise("input_too_large").alias("status"))
