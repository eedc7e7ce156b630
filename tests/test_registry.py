import math

import duckdb
import pytest

import __spark_entry__ as entry
from diskloom import session
from diskloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str([None if isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert rows(got.astype(str)) == rows(want.astype(str))


def test_entry_and_sql_functions(spark):
    assert entry.entry(spark).count() == 25
    session.register(spark)
    row = spark.sql("SELECT decode_pc98(X'5C') AS a, hex(encode_pc6001('小')) AS b, hex(deobfuscate_pc88(X'80')) AS c, rbyte_decode(X'00').error AS d").first()
    assert (row.a, row.b, row.c) == ("¥", "144F", "C2") and row.d


def test_sql_functions_agree_with_the_columns(spark):
    import random

    from pyspark.sql import functions as F

    from diskloom.functions import charset, obfuscation

    session.register(spark)
    r = random.Random(6)
    cases = [bytes(r.choice([r.randrange(256), 0x14, 0xDE, 0xDF, 0x96, r.randrange(0x30, 0x50)]) for _ in range(r.randrange(40))) for _ in range(200)]
    spark.createDataFrame([(c,) for c in cases] + [(None,)], "b binary").createOrReplaceTempView("raw_bytes")
    b = F.col("b")
    pairs = {"decode_pc98": charset.decode_pc98(b), "decode_pc6001": charset.decode_pc6001(b)}
    for method in (obfuscation.PC98, *obfuscation.KEYS):
        pairs |= {f"obfuscate_{method}": obfuscation.obfuscate(b, method), f"deobfuscate_{method}": obfuscation.deobfuscate(b, method)}
    both = spark.table("raw_bytes").select(*[F.expr(f"{k}(b)").alias(f"s_{k}") for k in pairs], *[v.alias(f"c_{k}") for k, v in pairs.items()])
    assert "Python" not in both._jdf.queryExecution().executedPlan().toString()
    for row in both.collect():
        assert all(row[f"s_{k}"] == row[f"c_{k}"] for k in pairs)
