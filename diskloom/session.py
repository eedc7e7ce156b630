"""Session helpers shared by the library, the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "diskloom") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession) -> None:
    """SQL functions: character sets, obfuscation, pictures, and the d88_sectors table function.

    Decoding and obfuscation have SQL bodies and stay in the JVM; encoding needs a Unicode normaliser.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    from .functions import charset, obfuscation, pictures
    from .sources import d88

    def text(value: str) -> str:
        return f"decode(X'{value.encode().hex()}', 'UTF-8')"

    def translated(value: str, source: str, target: str) -> str:
        return f"translate({value}, {text(source)}, {text(target)})"

    def function(name: str, kind: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(b BINARY) RETURNS {kind} RETURN {body}")

    def decoded(kind: str) -> str:
        kept = charset.PRESERVE["minimal"]
        codes = [b for b in range(256) if b not in kept]
        out = "decode(b, 'ISO-8859-1')"
        for k, char in enumerate(charset.ALTERNATES) if kind == charset.PC6001 else ():
            out = f"replace({out}, {text(chr(0x14) + chr(0x30 + k))}, {text(char)})"
        out = translated(out, "".join(map(chr, codes)), "".join(charset.TABLES[kind][c] for c in codes))
        if kind == charset.PC6001:
            for pair, whole in charset.composed():
                out = f"replace({out}, {text(pair)}, {text(whole)})"
            for mark, combining in charset.COMBINING:
                out = f"regexp_replace({out}, {text('([ぁ-ゖ])' + mark)}, {text('$1' + combining)})"
        return out

    def keyed(method: str, forward: bool) -> str:
        if method == obfuscation.PC98:
            source, target = (obfuscation._ROTATED, obfuscation._PLAIN) if forward else (obfuscation._PLAIN, obfuscation._ROTATED)
            return f"encode({translated("decode(b, 'ISO-8859-1')", source, target)}, 'ISO-8859-1')"
        take, give = (13, 11) if forward else (11, 13)
        key = f"array({', '.join(map(str, obfuscation.KEYS[method]))})"
        each = f"chr(pmod({give} - i % {give} + (pmod(ascii(c) - ({take} - i % {take}), 256) ^ get({key}, i % 143)), 256))"
        return f"CASE WHEN octet_length(b) = 0 THEN X'' ELSE encode(array_join(transform(split(decode(b, 'ISO-8859-1'), ''), (c, i) -> {each}), ''), 'ISO-8859-1') END"

    for name, kind in (("pc98", charset.PC98), ("pc6001", charset.PC6001)):
        function(f"decode_{name}", "STRING", decoded(kind))
        spark.udf.register(f"encode_{name}", F.pandas_udf(lambda column, k=kind: pd.Series([None if x is None else charset.encode_text(x, k) for x in column], dtype=object), "binary"))
    for method in (obfuscation.PC98, *obfuscation.KEYS):
        function(f"obfuscate_{method}", "BINARY", keyed(method, True))
        function(f"deobfuscate_{method}", "BINARY", keyed(method, False))
    spark.udf.register("rbyte_decode", pictures._decoder(pictures.decode_rbyte))
    spark.udf.register("rbyte88_decode", pictures._decoder(pictures.decode_rbyte88))

    class Sectors:
        def eval(self, path: str, content: bytes):
            for disk in d88.disks_of(path, content):
                for s in disk["sectors"]:
                    yield disk["disk_idx"], s["table_pos"], s["track"], s["side"], s["slice_idx"], s["sec_num"], s["sectors_in_track"], s["data_offset"], s["header"], s["data"], disk.get("fatal")
                if not disk["sectors"]:
                    yield (disk["disk_idx"], *[None] * 9, disk.get("fatal"))

    schema = "disk_idx int, table_pos int, track int, side int, slice_idx int, sec_num int, sectors_in_track int, data_offset bigint, header binary, data binary, fatal string"
    spark.udtf.register("d88_sectors", F.udtf(Sectors, returnType=schema))


def views(disks: DataFrame) -> None:
    """Temporary views over analysed disks: disks, sectors, formats, directory, fat, files, errors."""
    from pyspark.sql import functions as F

    from .operators import outputs

    disks.drop("entries", "metadata", "fats", "layout").createOrReplaceTempView("disks")
    disks.select("path", "disk_idx", F.explode("layout").alias("s")).select("path", "disk_idx", "s.*").createOrReplaceTempView("sectors")
    disks.where("fatal IS NULL").select("path", "disk_idx", "format.*").createOrReplaceTempView("formats")
    outputs.entries(disks).createOrReplaceTempView("directory")
    outputs.fat(disks).createOrReplaceTempView("fat")
    outputs.files(disks).createOrReplaceTempView("files")
    outputs.errors(disks).createOrReplaceTempView("errors")
