"""Character-set filters over lines, in batch and as streams.

A line is converted by itself, so a stream needs no state and no watermark. Files are read as
binaries because a text reader would damage 8-bit bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charset import PC98, PC6001, decode, encode

MODES = {"pc98-8bit-to-utf8": (PC98, "decode"), "utf8-to-pc98-8bit": (PC98, "encode"), "pc6001-8bit-to-utf8": (PC6001, "decode"), "utf8-to-pc6001-8bit": (PC6001, "encode")}
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line): binary lines with their line ends."""
    text = F.decode("content", "ISO-8859-1")
    each = F.regexp_extract_all(text, F.lit("(?s)([^\\n]*\\n|[^\\n]+\\z)"), 1)
    return files.select("path", F.posexplode(each).alias("line_no", "t")).select("path", "line_no", F.encode("t", "ISO-8859-1").alias("line"))


def converted(line: Column, mode: str, errors: str = "null") -> Column:
    """A line converted to binary; text without bytes in the set gives null, or fails with errors="raise"."""
    charset, way = MODES[mode]
    if way == "decode":
        return F.encode(decode(line, charset, "ascii"), "UTF-8")
    return encode(F.decode(line, "UTF-8"), charset, errors=errors)


def apply(files: DataFrame, mode: str, errors: str = "null") -> DataFrame:
    """(path, line_no, line, converted) of binary files or a stream of them."""
    return lines(files).withColumn("converted", converted(F.col("line"), mode, errors))


def stream(spark: SparkSession, folder: str, mode: str, errors: str = "null") -> DataFrame:
    """The filter as a streaming DataFrame over files that arrive in a folder."""
    return apply(spark.readStream.format("binaryFile").schema(SCHEMA).load(folder), mode, errors)
