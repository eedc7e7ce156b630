"""Registered queries over Japanese text, line filters and pictures of many lines."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charset, obfuscation, pictures
from ..functions.names import let
from ..streaming import filters
from .registry import _binary, _bytewise, _literal, _spread, _table, query

# Character pairs that don't come from the encoder: kana by their place in Unicode's half-width block, which both
# sets have in its order, voiced ones by composition, hiragana and signs by their place in a set's table.
_HALF = {chr(c): f"{0xA1 + c - 0xFF61:02X}" for c in range(0xFF61, 0xFFA0)}
_FULL = {full: code for half, code in _HALF.items() if len(full := unicodedata.normalize("NFKC", half)) == 1 and "ァ" <= full <= "ヺ"}
_VOICED = {whole: code + mark for base, code in _FULL.items() for sign, mark in (("゙", "DE"), ("゚", "DF")) if len(whole := unicodedata.normalize("NFC", base + sign)) == 1}
_MARKS = {"ー": "B0", "゛": "DE", "゜": "DF", "。": "A1", "「": "A2", "」": "A3", "、": "A4", "・": "A5", "！": "21", "Ａ": "41", "ｚ": "7A", "〜": "7E", "‐": "2D", "¥": "5C", "A": "41", "~": "7E", "　": "20"}
_KANA = _HALF | _FULL | _VOICED | _MARKS
_HIRAGANA = {c: f"{k:02X}" for k, c in enumerate(charset.TABLES[charset.PC6001]) if "ぁ" <= c <= "ん"}
_SOFT = {whole: code + mark for base, code in _HIRAGANA.items() for sign, mark in (("゙", "DE"), ("゚", "DF")) if len(whole := unicodedata.normalize("NFC", base + sign)) == 1}
_OTHER = {c: f"14{0x30 + k:02X}" for k, c in enumerate(charset.ALTERNATES)}
_P6 = _HALF | _FULL | _VOICED | _HIRAGANA | _SOFT | {c: h for c, h in _OTHER.items() if c not in charset.TABLES[charset.PC6001]}


def _pool(pairs: dict[str, str], number: Column) -> Column:
    return F.substr(F.lit("".join(pairs)), (number % len(pairs) + 1).cast("int"), F.lit(1))


def _sql_list(values) -> str:
    return "[" + ", ".join(map(_literal, values)) + "]"


def _coded(pairs: dict[str, str], *numbers: str) -> str:
    return " || ".join(f"{_sql_list(pairs.values())}[({n}) % {len(pairs)} + 1]" for n in numbers)


_THREE = ("l_orderkey", "l_partkey", "l_suppkey")


def _words(spark: SparkSession, sf_dir: str, pairs: dict[str, str]) -> DataFrame:
    return _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.concat(*[_pool(pairs, F.col(c)) for c in _THREE]).alias("text"))


@query(f"SELECT l_orderkey, l_linenumber, {_coded(_KANA, *_THREE)} AS hex FROM lineitem")
def encode_pc98_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-width, full-width and voiced kana and signs in the first set."""
    return _words(spark, sf_dir, _KANA).select("l_orderkey", "l_linenumber", F.hex(charset.encode(F.col("text"), charset.PC98)).alias("hex"))


@query(f"SELECT l_orderkey, l_linenumber, {_coded(_P6, *_THREE)} AS hex FROM lineitem")
def encode_pc6001_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kana of both kinds, voiced ones and alternates in the second set."""
    return _words(spark, sf_dir, _P6).select("l_orderkey", "l_linenumber", F.hex(charset.encode(F.col("text"), charset.PC6001)).alias("hex"))


_SPOKEN = _HIRAGANA | _SOFT


@query(f"SELECT l_orderkey, l_linenumber, {' || '.join(f'{_sql_list(_SPOKEN)}[{c} % {len(_SPOKEN)} + 1]' for c in _THREE)} AS text FROM lineitem")
def decode_pc6001_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hiragana with sound marks behind them become single letters."""
    codes = F.array(*map(F.lit, _SPOKEN.values()))
    raw = F.unhex(F.concat(*[F.get(codes, (F.col(c) % len(_SPOKEN)).cast("int")) for c in _THREE]))
    return _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", raw.alias("b")).select("l_orderkey", "l_linenumber", charset.decode_pc6001(F.col("b")).alias("text"))


@query(f"SELECT o_orderkey, hex(substr({_literal(charset.TABLES[charset.PC98])}, (o_orderkey % 256 + 1)::INTEGER, 1)) = hex(CASE WHEN o_orderkey % 256 IN (0, 10, 13, 26, 127) THEN '' ELSE substr({_literal(charset.TABLES[charset.PC98])}, (o_orderkey % 256 + 1)::INTEGER, 1) END) AS shown, hex(CASE WHEN o_orderkey % 256 IN (0, 10, 13, 26, 127) THEN chr((o_orderkey % 256)::INTEGER) ELSE substr({_literal(charset.TABLES[charset.PC98])}, (o_orderkey % 256 + 1)::INTEGER, 1) END) AS hex FROM orders")
def decode_pc98_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters that decoding keeps in its minimal mode, and those that it shows."""
    text = charset.decode_pc98(F.unhex(F.lpad(F.hex(F.col("o_orderkey") % 256), 2, "0")), "minimal")
    return _table(spark, sf_dir, "orders", "o_orderkey", (~text.isin("\0", "\n", "\r", "\x1a", "\x7f")).alias("shown"), F.hex(_binary(text)).alias("hex"))


@query(f"""WITH s AS (SELECT s_suppkey, s_suppkey + n AS n, n AS line_no FROM supplier, range(3) AS t(n))
  SELECT s_suppkey, line_no::INTEGER AS line_no, {_coded(_KANA, 'n')} || '0A' AS pc98, {_coded(_P6, 'n')} || '0A' AS pc6001, hex({_sql_list(_HALF)}[n % {len(_HALF)} + 1] || chr(10)) AS back98, hex({_sql_list(_SPOKEN)}[n % {len(_SPOKEN)} + 1] || chr(10)) AS back6001 FROM s""")
def line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four filters over files of three lines."""
    def files(make) -> DataFrame:
        lines = F.concat(*[F.concat(make(F.col("s_suppkey") + k), F.lit(bytearray(b"\n"))) for k in range(3)])
        return _table(spark, sf_dir, "supplier", F.col("s_suppkey").cast("string").alias("path"), lines.alias("content"))

    def coded(pairs: dict[str, str]):
        codes = F.array(*map(F.lit, pairs.values()))
        return lambda n: F.unhex(F.get(codes, (n % len(pairs)).cast("int")))

    plans = {"pc98": (files(lambda n: _binary(_pool(_KANA, n))), "utf8-to-pc98-8bit"), "pc6001": (files(lambda n: _binary(_pool(_P6, n))), "utf8-to-pc6001-8bit"), "back98": (files(coded(_HALF)), "pc98-8bit-to-utf8"), "back6001": (files(coded(_SPOKEN)), "pc6001-8bit-to-utf8")}
    out = None
    for name, (own, mode) in plans.items():
        made = filters.apply(own, mode).select(F.col("path").cast("bigint").alias("s_suppkey"), "line_no", F.hex("converted").alias(name))
        out = made if out is None else out.join(made, ["s_suppkey", "line_no"])
    return out


_GW = "[" + ", ".join(map(str, obfuscation.KEYS["gwbasic"])) + "]"
_GW_FORM = f"(11 - i % 11 + xor((({{b}} + 256 - (13 - i % 13)) % 256)::INTEGER, {_GW}[(i % 143 + 1)::BIGINT]::INTEGER)) % 256"


@query(f"SELECT p_partkey, {_bytewise('p_name', _GW_FORM)} AS hex, hex(p_name) AS plain FROM part")
def obfuscate_gwbasic_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later DOS BASIC's key, and the method that changes nothing."""
    return _table(spark, sf_dir, "part", "p_partkey", F.hex(obfuscation.obfuscate(_binary("p_name"), "gwbasic")).alias("hex"), F.hex(obfuscation.deobfuscate(_binary("p_name"), None)).alias("plain"))


# Pictures of many lines

_LINES, _WIDE = 12, 64
#: Whether the pixel i of line y is set in plane p (blue, red, green): lines that repeat, differ little, or are new.
_BIT = "(CASE WHEN {e} > 0 THEN 1 ELSE 0 END + CASE WHEN {i} % 8 = 0 AND {i} / 8 < {y} % 4 AND {y} % 4 > 1 THEN 1 ELSE 0 END) % 2 = 1"
_SQL_BIT = _BIT.format(e=f"embedding[(((i % {_WIDE}) + 7 * (i // {_LINES * _WIDE}) + 13 * (i // {_WIDE} % {_LINES} // 4)) % {_WIDE} + 1)::BIGINT]", i=f"(i % {_WIDE})", y=f"(i // {_WIDE} % {_LINES})").replace(f"(i % {_WIDE}) / 8", f"(i % {_WIDE}) // 8")
_PICTURE = f"SELECT vec_id, array_to_string(list_transform(range(0, {3 * _LINES * _WIDE}), lambda i: CASE WHEN {_SQL_BIT} THEN '1' ELSE '0' END), '') AS bits FROM embeddings"


#: Pictures of a task: an image has 4.6 KB, and a batch as many as its task at most.
_PICTURES_A_TASK = 2048


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, image) of three planes that a vector's signs make.

    Of the lines nine are different, by ``y div 4`` and by how many pixels ``y % 4`` turns; each is a string of signs.
    """
    signs = F.rpad(F.coalesce(F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), ""), F.lit("")), _WIDE, "0")

    def line(own: Column, group: int, turned: int) -> Column:
        def plane(p: int) -> Column:
            first = (7 * p + 13 * group) % _WIDE
            whole = F.concat(F.substr(own, F.lit(first + 1)), F.substr(own, F.lit(1), F.lit(first)))
            parts = [part for k in range(turned) for part in (F.translate(F.substr(whole, F.lit(8 * k + 1), F.lit(1)), "01", "10"), F.substr(whole, F.lit(8 * k + 2), F.lit(7)))]
            return F.concat(*parts, F.substr(whole, F.lit(8 * turned + 1)))

        def mixed(planes: Column) -> Column:  # blue, green, red
            return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(_WIDE)), lambda i: F.concat(*[F.substr(planes[k], i, F.lit(1)) for k in range(3)])), "")

        return let(F.array(plane(0), plane(2), plane(1)), mixed)

    def image(lines: Column) -> Column:
        every = F.concat(*[lines[y // 4 * 3 + max(0, y % 4 - 1)] for y in range(_LINES) for _ in range(2)])
        return F.unhex(F.replace(F.replace(every, F.lit("1"), F.lit("FF")), F.lit("0"), F.lit("00")))

    # Each step is read more than once, so projections are not merged and it is made once.
    rows = _spread(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), _PICTURES_A_TASK).select("vec_id", signs.alias("signs"))
    rows = rows.select("vec_id", F.array(*[line(F.col("signs"), g, t) for g in range(_LINES // 4) for t in (0, 2, 3)]).alias("lines"))
    return rows.select("vec_id", F.struct(F.lit(_WIDE).alias("width"), F.lit(2 * _LINES).alias("height"), F.lit(3).alias("nChannels"), image(F.col("lines")).alias("data")).alias("image"))


def _bits(data: Column) -> Column:
    out = F.translate(F.hex(data), "0123456789ABCDEF", "abcdefghijklmnop")
    for k in range(16):
        out = F.replace(out, F.lit("abcdefghijklmnop"[k]), F.lit(f"{k:04b}"))
    return out


def _planes(decoded: DataFrame) -> DataFrame:
    return decoded.select("vec_id", _bits(F.concat("p.blue", "p.red", "p.green")).alias("bits"))


@query(_PICTURE)
def rbyte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three planes of twelve lines through the PC-98 encoder, which looks back at lines above, and decoder."""
    rows = _drawn(spark, sf_dir).select("vec_id", pictures.rbyte_encode(F.col("image"), 31).alias("x"))
    return _planes(rows.select("vec_id", pictures.rbyte_decode(F.col("x.data")).alias("p")))


@query(_PICTURE)
def rbyte88_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the PC-88 encoder, which takes the shorter scan order, and decoder."""
    rows = _drawn(spark, sf_dir).select("vec_id", pictures.rbyte88_encode(F.col("image")).alias("x"))
    return _planes(rows.select("vec_id", pictures.rbyte88_decode(F.col("x.data")).alias("p")))


@query(_PICTURE)
def picture_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the PNG of a decoded picture: each scan line twice, colours from the planes."""
    rows = _drawn(spark, sf_dir).select("vec_id", pictures.rbyte_encode(F.col("image")).alias("x")).select("vec_id", pictures.rbyte_png(F.col("x.data")).alias("x"))
    size = 3 * _WIDE  # bytes of a scan line

    def shown(h: Column) -> Column:
        """A pixel is set where both of its scan lines have all of a colour."""
        full = F.rpad(F.coalesce(F.translate(charset.latin(h), "".join(map(chr, range(256))), "0" * 255 + "1"), F.lit("")), 2 * _LINES * size, "0")

        def both(t: Column) -> Column:
            lines = []
            for y in range(_LINES):
                one, two = (F.substr(t, F.lit((2 * y + k) * size + 1), F.lit(size)) for k in range(2))
                lines.append(F.when(one == two, one).otherwise(F.array_join(F.zip_with(F.split(one, ""), F.split(two, ""), lambda m, n: F.least(m, n)), "")))
            return F.concat(*lines)

        return let(let(full, both), lambda t: F.concat(*[F.regexp_replace(t, "(.)(.)(.)", f"${c + 1}") for c in (0, 2, 1)]))

    return rows.select("vec_id", let(pictures.image_of(F.col("x.png"))["data"], shown).alias("bits"))


@query("""WITH t AS (SELECT n_nationkey AS k, list_transform(range(8), lambda i: (n_nationkey * 5 + i * 3) % 251) AS v FROM nation),
  h AS (SELECT k, list_transform(v, lambda x: printf('%02X', x::INTEGER)) AS a FROM t)
  SELECT k, array_to_string(a, '') || array_to_string(a, '') || array_to_string(a[1:3], '') || 'E0' || array_to_string(a[5:8], '') || 'E1' || array_to_string(a[2:3], '') || 'E0' || array_to_string(a[5:7], '') || 'E2'
  || 'E1' || a[2] || 'E3E4' || array_to_string(a[5:7], '') || 'E2' || '0F0F0FF0F0F0F0F0' || 'E1' || a[2] || 'E3E4' || array_to_string(a[5:7], '') || 'E2' AS blue, repeat(printf('%02X', k::INTEGER), 56) AS red, repeat('00', 56) AS green FROM h""")
def rbyte_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream with one line of each command: literal, 81, 91, A1, B1, 40, 82; then planes of repetitions."""
    v = F.expr("array_join(transform(sequence(0, 7), i -> lpad(hex((n_nationkey * 5 + i * 3) % 251), 2, '0')), '')")
    line = F.concat(F.lit("00"), v, F.lit("81"), F.lit("9103E0FF"), F.lit("A181E1E2"), F.lit("B10202E3E4FF"), F.lit("400F03F0FF"), F.lit("82"))
    red = F.concat(F.lit("40"), F.lpad(F.hex(F.col("n_nationkey")), 2, "0"), F.lit("FF"), F.repeat(F.lit("81"), F.lit(6)))
    stream = F.unhex(F.concat(F.lit("08000700"), line, red, F.repeat(F.lit("4000FF"), F.lit(7))))
    rows = _table(spark, sf_dir, "nation", F.col("n_nationkey").alias("k"), pictures.rbyte_decode(stream).alias("p"))
    return rows.select("k", *[F.hex(f"p.{c}").alias(c) for c in ("blue", "red", "green")])


@query("""WITH t AS (SELECT n_nationkey::INTEGER AS k, printf('%02X', (n_nationkey * 9 % 250)::INTEGER) AS a, printf('%02X', (n_nationkey * 9 % 250 + 1)::INTEGER) AS b FROM nation)
  SELECT k::BIGINT AS k, CASE WHEN k % 2 = 0 THEN repeat(a, 5) || b ELSE a || a || a || a || a || b END AS blue, CASE WHEN k % 2 = 0 THEN a || a || b || b || b || a ELSE a || b || b || a || b || a END AS red, b || a || b || a || b || a AS green FROM t""")
def rbyte88_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made streams of two by three bytes in either scan order: runs, a run of three, pairs that end a plane."""
    one, two = (F.lpad(F.hex(F.col("n_nationkey") * 9 % 250 + k), 2, "0") for k in (0, 1))
    across = F.concat(F.lit("0203"), one, one, F.lit("04"), two, one, one, F.lit("01"), two, two, F.lit("02"), one, two, one, two, one, two, one)
    down = F.concat(F.lit("8203"), one, one, F.lit("02"), one, one, F.lit("01"), two, one, two, two, F.lit("02"), one, one, two, two, F.lit("02"), one, one, F.lit("02"))
    return _table(spark, sf_dir, "nation", F.col("n_nationkey").alias("k"), pictures.rbyte88_decode(F.unhex(F.when(F.col("n_nationkey") % 2 == 0, across).otherwise(down))).alias("p")).select("k", *[F.hex(f"p.{c}").alias(c) for c in ("blue", "red", "green")])
