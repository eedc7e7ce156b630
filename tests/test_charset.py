import random

import pytest
from pyspark.sql import functions as F

from diskloom.functions import charset as cs


@pytest.mark.parametrize("kind", [cs.PC98, cs.PC6001])
def test_every_byte_and_marked_pair_goes_there_and_back(kind):
    cases = [bytes([b]) for b in range(256)] + [bytes([b, m]) for b in range(256) for m in (0xDE, 0xDF, 0xEE, 0xEF)]
    cases += [bytes([0x14, b]) for b in range(256)] * (kind == cs.PC6001)
    for raw in cases:
        for mode in cs.PRESERVE:
            assert cs.encode_text(cs.decode_bytes(raw, kind, mode), kind) == raw, (raw, mode)


@pytest.mark.parametrize(
    "kind, text, raw",
    [
        (cs.PC98, "¥0=0円", "5C303D30F1"),
        (cs.PC98, "".join(map(chr, [*range(0x258A, 0x2590), *range(0x2588, 0x2581, -1)])), "8D8C8B8A898887868584838281"),
        (cs.PC98, "「！？」　･･･", "A2213FA320A5A5A5"),
        (cs.PC6001, "¥0=0円", "5C303D301439"),
        (cs.PC6001, "小", "144F"),
        (cs.PC6001, "", "1430"),
        (cs.PC98, "〜‐", "7E2D"),
        (cs.PC98, "ガ゛ー", "B6DEDEB0"),
        (cs.PC6001, "が", "96DE"),
    ],
)
def test_known_vectors(kind, text, raw):
    assert cs.encode_text(text, kind).hex().upper() == raw


def test_strict_encoding_and_unknown_characters():
    assert cs.encode_text("「！", cs.PC98, try_harder=False) is None or cs.encode_text("é", cs.PC98) is None
    assert cs.encode_text("語", cs.PC98) is None
    assert cs.encode_text("", cs.PC98) == b""


def test_columns_agree_with_the_worker_functions(spark):
    r = random.Random(5)
    cases = [bytes(r.choice([r.randrange(256), 0x14, 0xDE, 0xDF, 0x96, r.randrange(0x30, 0x50)]) for _ in range(r.randrange(9))) for _ in range(600)]
    df = spark.createDataFrame([(b,) for b in cases] + [(None,)], "b binary")
    for mode in cs.PRESERVE:
        rows = df.select("b", cs.decode(F.col("b"), cs.PC98, mode).alias("x"), cs.decode(F.col("b"), cs.PC6001, mode).alias("y")).collect()
        for row in rows:
            if row.b is None:
                assert row.x is None and row.y is None
                continue
            raw = bytes(row.b)
            assert row.x == cs.decode_bytes(raw, cs.PC98, mode)
            assert row.y == cs.decode_bytes(raw, cs.PC6001, mode), raw


def test_encoding_columns(spark):
    df = spark.createDataFrame([("ABC¥",), ("語",), ("",), (None,), ("カ",)], "t string")
    rows = df.select(F.hex(cs.encode(F.col("t"), cs.PC98)).alias("full"), F.hex(cs.encode_fast(F.col("t"), cs.PC98)).alias("fast")).collect()
    assert [r.full for r in rows] == ["4142435C", None, "", None, "B6"]
    assert [r.fast for r in rows] == ["4142435C", None, "", None, None]
    whole = spark.range(1).select(cs.encode_fast(F.lit(cs.TABLES[cs.PC98]), cs.PC98).alias("b")).first().b
    assert bytes(whole) == bytes(range(256))
    with pytest.raises(Exception, match="U\\+8A9E"):
        df.select(cs.encode(F.col("t"), cs.PC98, errors="raise")).collect()


def test_glyphs_and_dumps_of_whole_data(spark):
    """Each byte is shown as decoding it with the byte before shows it, and bytes are not translated one by one."""
    import random

    from diskloom.operators import outputs

    def plain(b, kind):
        shown = [cs.decode_bytes(bytes([b[k - 1] if k else 0, b[k]]), kind, "none")[-1] for k in range(len(b))]
        return "".join("." if c < " " or c == "\x7f" or "\ue000" <= c <= "\uf8ff" else c for c in shown)

    r = random.Random(9)
    cases = [b"", bytes(range(256)), b"\x14\x30\x14\x14\x31\x30"] + [bytes(r.choice([r.randrange(256), 0x14, 0xDE, 0xDF, 0x96, r.randrange(0x30, 0x50)]) for _ in range(r.randrange(70))) for _ in range(150)]
    cases += [bytes([a, b, c]) for a in range(0x86, 0x100, 3) for b in (0xDE, 0xDF) for c in (0xDE, 0x14)]
    b = F.col("b")
    for kind in (cs.PC98, cs.PC6001):
        df = spark.createDataFrame([(c, kind) for c in cases], "b binary, k string")
        for row in df.select("b", cs.glyphs(b, F.col("k")).alias("g"), outputs.hexdump(b, F.col("k"), b).alias("lines")).collect():
            raw, want = bytes(row.b), plain(bytes(row.b), kind)
            assert row.g == want
            assert len(row.lines) == -(-len(raw) // 16) + 1
            for i, line in zip(range(0, len(raw), 16), row.lines):
                codes = "".join((f" {x:02X}" + " " * (k == 7)) for k, x in enumerate(raw[i : i + 16]))
                half = codes.ljust(50) + " │" + want[i : i + 16]
                assert line.startswith(f"{i:06X}: " + half) and line.count(half) == 2
    assert spark.createDataFrame([(None,)], "b binary").select(outputs.hexdump(b, F.lit(cs.PC98)).alias("lines"), outputs.hexdump(F.lit(bytearray(b"a")), F.lit(cs.PC98), b).alias("one")).first() == ([None], ["000000:  61" + " " * 47 + " │a╭──────────────╯", "000001" + " " * 53 + "╰─╯"])
