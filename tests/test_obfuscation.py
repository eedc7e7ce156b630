import pytest
from pyspark.sql import functions as F

from diskloom.functions import obfuscation as o


def test_rotation_vectors(spark):
    cipher, plain = bytes.fromhex("00FF55AA4020100804020180"), bytes.fromhex("00FFAA558040201008040201")
    row = spark.range(1).select(o.deobfuscate(F.lit(bytearray(cipher)), "pc98").alias("p"), o.obfuscate(F.lit(bytearray(plain)), "pc98").alias("c")).first()
    assert bytes(row.p) == plain and bytes(row.c) == cipher


@pytest.mark.parametrize("method", ["pc88", "gwbasic"])
def test_keyed_round_trip_and_key_recovery(spark, method):
    data = [bytes(range(256)) * 2, b"", b"\0", b"\x80"]
    df = spark.createDataFrame([(d,) for d in data] + [(None,)], "b binary")
    rows = df.select("b", o.obfuscate(F.col("b"), method).alias("c")).select("b", "c", o.deobfuscate(F.col("c"), method).alias("p")).collect()
    for row in rows:
        assert row.p == row.b
    key = spark.range(1).select(o.recover_key(o.obfuscate(F.lit(bytearray(o.known_plaintext())), method)).alias("k")).first().k
    assert bytes(key) == o.KEYS[method]


def test_hand_vector_and_no_method(spark):
    row = spark.range(1).select(F.hex(o.deobfuscate(F.lit(bytearray(b"\x80")), "pc88")).alias("x"), o.deobfuscate(F.lit(bytearray(b"\x80")), None).alias("y")).first()
    assert row.x == "C2" and bytes(row.y) == b"\x80"
