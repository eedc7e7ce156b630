"""Registered queries over the disk, character-set and picture operators, with their DuckDB SQL.

Three kinds of proof stand behind them: queries with an independent SQL writing of the formula;
round trips, where images are built from a table and the SQL is the table itself; and hand
vectors, which are unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charset, names, obfuscation, pictures
from ..operators import contents, disks, outputs, relational
from ..sources import build, d88
from ..sources.formats import KNOWN

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import planted, texts  # noqa: F401  (they register themselves)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _spread(rows: DataFrame, each: int) -> DataFrame:
    """Rows dealt out to tasks of about ``each``: they are small and lie in few row groups, what is made of them is not small."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each)))


def _binary(text: Column | str) -> Column:
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bytewise(column: str, formula: str) -> str:
    """SQL hex of each byte b (at i from 0) by a formula; for ASCII text."""
    return f"array_to_string(list_transform(range(0, length({column})), lambda i: printf('%02X', ({formula.replace('{b}', f'ascii({column}[i + 1])')})::INTEGER)), '')"


_K88 = "[" + ", ".join(map(str, obfuscation.KEYS["pc88"])) + "]"


def _pc88(take: int, give: int) -> str:
    return f"({give} - i % {give} + xor((({{b}} + 256 - ({take} - i % {take})) % 256)::INTEGER, {_K88}[(i % 143 + 1)::BIGINT]::INTEGER)) % 256"


# Obfuscation


@query(f"SELECT p_partkey, {_bytewise('p_name', '({b} >> 1) | (({b} & 1) << 7)')} AS hex FROM part")
def obfuscate_pc98_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part", "p_partkey", F.hex(obfuscation.obfuscate(_binary("p_name"), "pc98")).alias("hex"))


@query(f"SELECT p_partkey, {_bytewise('p_name', '(({b} << 1) & 255) | ({b} >> 7)')} AS hex FROM part")
def deobfuscate_pc98_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part", "p_partkey", F.hex(obfuscation.deobfuscate(_binary("p_name"), "pc98")).alias("hex"))


@query(f"SELECT p_partkey, {_bytewise('p_name', _pc88(13, 11))} AS hex FROM part")
def obfuscate_pc88_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part", "p_partkey", F.hex(obfuscation.obfuscate(_binary("p_name"), "pc88")).alias("hex"))


@query(f"SELECT event_id, {_bytewise('props', _pc88(11, 13))} AS hex FROM events")
def deobfuscate_pc88_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events", "event_id", F.hex(obfuscation.deobfuscate(_binary("props"), "pc88")).alias("hex"))


@query(f"SELECT i::BIGINT AS i, {_K88}[i + 1]::BIGINT AS key_byte FROM range(143) AS t(i)")
def key_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    cipher = obfuscation.obfuscate(F.lit(bytearray(obfuscation.known_plaintext())), "pc88")
    return spark.range(1).select(F.posexplode(disks.numbers(obfuscation.recover_key(cipher))).alias("i", "key_byte")).select(F.col("i").cast("bigint").alias("i"), F.col("key_byte").cast("bigint").alias("key_byte"))


# Character sets


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = [F.lpad(F.hex(F.col(c) % 256), 2, "0") for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    return _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.unhex(F.concat(*one)).alias("b"))


def _three_sql(table: str) -> str:
    chars = " || ".join(f"substr({_literal(table)}, ({c} % 256 + 1)::INTEGER, 1)" for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    return f"SELECT l_orderkey, l_linenumber, hex({chars}) AS hex FROM lineitem"


@query(_three_sql(charset.TABLES[charset.PC98]))
def decode_pc98_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).select("l_orderkey", "l_linenumber", F.hex(_binary(charset.decode_pc98(F.col("b"), "none"))).alias("hex"))


_CONTROLS = [b for b in charset.PRESERVE["ascii"]]


@query("SELECT l_orderkey, l_linenumber, hex(" + " || ".join(f"CASE WHEN {c} % 256 < 32 OR {c} % 256 = 127 THEN chr(({c} % 256)::INTEGER) ELSE substr({_literal(charset.TABLES[charset.PC98])}, ({c} % 256 + 1)::INTEGER, 1) END" for c in ("l_orderkey", "l_partkey", "l_suppkey")) + ") AS hex FROM lineitem")
def decode_pc98_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).select("l_orderkey", "l_linenumber", F.hex(_binary(charset.decode_pc98(F.col("b"), "ascii"))).alias("hex"))


@query("SELECT c_custkey, " + _bytewise("c_name", "{b}") + " AS hex FROM customer")
def encode_pc98_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer", "c_custkey", F.hex(charset.encode_fast(F.col("c_name"), charset.PC98)).alias("hex"))


@query("SELECT c_custkey, " + _bytewise("c_name", "{b}") + " AS hex FROM customer")
def encode_pc98_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer", "c_custkey", F.hex(charset.encode(F.col("c_name"), charset.PC98)).alias("hex"))


_ENCODABLE = "".join(dict.fromkeys(charset.TABLES[charset.PC98] + "".join(map(chr, range(1, 128)))))


@query(f"SELECT lang, count(*) AS docs, sum((length(translate(text, {_literal(_ENCODABLE)}, '')) > 0)::BIGINT)::BIGINT AS failures FROM documents GROUP BY lang")
def encode_failures_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = charset.unmapped(F.col("text"), charset.PC98) > 0
    return _table(spark, sf_dir, "documents", "lang", "text").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(failed.cast("bigint")).alias("failures"))


@query(f"SELECT o_orderkey, hex(substr({_literal(charset.ALTERNATES)}, (o_orderkey % 32 + 1)::INTEGER, 1) || chr((65 + o_orderkey % 26)::INTEGER)) AS hex FROM orders")
def decode_pc6001_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.concat(F.lit("14"), F.hex(F.col("o_orderkey") % 32 + 0x30), F.hex(F.col("o_orderkey") % 26 + 65)))
    return _table(spark, sf_dir, "orders", "o_orderkey", F.hex(_binary(charset.decode_pc6001(raw))).alias("hex"))


# Set operations of the sector, directory and allocation checks


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, s, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, event_id * 16 % 4096 AS s, event_id * 16 % 4096 + event_id % 50 AS e FROM events)) WHERE s < reach GROUP BY user_id")
def sector_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("event_id") * 16 % 4096
    ranges = _table(spark, sf_dir, "events", "event_id", "user_id", start.alias("s"), (start + F.col("event_id") % 50).alias("e"))
    return relational.overlaps(ranges, ["user_id"], "s", "e").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.last_wins(_table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT l_orderkey, min(l_returnflag) AS low, max(l_returnflag) AS high FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def nominal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.conflicts(_table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag")


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def sector_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.repeats(_table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"])


@query("SELECT l_suppkey, 1 + max(l_linenumber) AS tracks, greatest(1, 1 + max(l_partkey % 2)) AS sides, max(l_partkey % 26) AS sectors, count(*) AS total_sectors, sum(128 << (l_orderkey % 4)::INTEGER)::BIGINT AS disk_size, max(128 << (l_orderkey % 4)::INTEGER) AS largest_sector FROM lineitem GROUP BY l_suppkey")
def geometry_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", (F.col("l_partkey") % 2).alias("side"), (F.col("l_partkey") % 26).alias("number"), F.expr("shiftleft(128, cast(l_orderkey % 4 as int))").alias("size"))
    return relational.measured(rows, ["l_suppkey"], "l_linenumber", "side", "number", F.col("size"))


@query("SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) > 1 OR max((p_type <> f)::INTEGER) OVER (PARTITION BY p_brand, p_name) = 1 AS duplicate FROM (SELECT *, first_value(p_type) OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS f FROM (SELECT p_partkey, substr(p_name, 1, 6) AS p_name, p_brand, p_type FROM part))")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part", "p_partkey", F.substring("p_name", 1, 6).alias("p_name"), "p_brand", "p_type")
    return relational.duplicate_names(rows, ["p_brand"], "p_name", "p_partkey", "p_type").select("p_partkey", "p_name", "duplicate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, l_returnflag || l_linestatus AS k, first_value(l_returnflag || l_linestatus) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag || l_linestatus) AS o FROM lineitem) WHERE k <> o")
def overlap_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.concat("l_returnflag", "l_linestatus").alias("k"))
    return relational.claims(rows, [], "l_partkey", ["l_orderkey", "l_linenumber", "k"], F.col("k")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_suppkey, sum(bad::BIGINT)::BIGINT AS mismatched FROM (SELECT l_suppkey, l_partkey % 160 AS c, min(l_orderkey % 255) <> max(l_orderkey % 255) AS bad FROM lineitem WHERE l_partkey % 160 > 0 GROUP BY ALL) GROUP BY l_suppkey")
def fat_copy_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", (F.col("l_partkey") % 160).alias("c"), (F.col("l_orderkey") % 255).alias("link"))
    return relational.mismatches(rows, ["l_suppkey"], "l_linenumber", "c", "link")


# Formats, directories, chains


_GEOMETRY = [(80, 2, 16), (77, 2, 26), (78, 2, 26), (35, 1, 16), (40, 2, 16), (36, 1, 16), (40, 1, 16), (80, 1, 16), (81, 1, 16), (41, 2, 16)]
_HEADS = ["SYS", "RXR", "IPL", "ABC"]


@query("WITH g AS (SELECT o_orderkey, ([" + ", ".join(f"[{a}, {b}, {c}]" for a, b, c in _GEOMETRY) + "])[(o_orderkey % 10 + 1)::BIGINT] AS t, (['SYS', 'RXR', 'IPL', 'ABC'])[(o_orderkey // 10 % 4 + 1)::BIGINT] AS h, CASE WHEN o_orderkey // 40 % 2 = 0 THEN 128 ELSE 256 END AS n FROM orders), k(ordinal, tracks, sides, sectors, hint) AS (VALUES " + ", ".join(f"({k.ordinal}, {k.tracks}, {k.sides}, {k.sectors}, {_literal(k.hint)})" for k in KNOWN) + ") SELECT o_orderkey, CASE WHEN ordinal IS NULL THEN 0 ELSE ordinal END AS known FROM (SELECT o_orderkey, ordinal, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE hint WHEN 'len=128' THEN (n = 128)::INT WHEN 'len<>128' THEN (n <> 128)::INT WHEN 'SYS' THEN (h = 'SYS')::INT WHEN 'IPL|RXR' THEN (h IN ('IPL', 'RXR'))::INT ELSE 0 END DESC, ordinal) AS r FROM g LEFT JOIN k ON k.tracks = t[1] AND k.sides = t[2] AND k.sectors = t[3]) WHERE r = 1")
def known_format_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.array(*[F.struct(*map(F.lit, g)) for g in _GEOMETRY])
    rows = _table(spark, sf_dir, "orders", "o_orderkey").withColumn("t", F.get(shapes, (F.col("o_orderkey") % 10).cast("int")))
    head = F.get(F.array(*map(F.lit, _HEADS)), F.expr("cast(o_orderkey div 10 % 4 as int)"))
    boot = F.encode(F.rpad(head, 256, "x"), "US-ASCII")
    boot = F.when(F.expr("o_orderkey div 40 % 2 = 0"), F.substring(boot, 1, 128)).otherwise(boot)
    found = disks.known_format("t.col1", "t.col2", "t.col3", "boot")
    return rows.withColumn("boot", boot).select("o_orderkey", F.coalesce(found["ordinal"], F.lit(0)).alias("known"))


@query("SELECT m::BIGINT AS mask, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN m & {bit} <> 0 THEN {_literal(name)} END" for bit, name in names.ATTRIBUTES.items()) + "], lambda x: x IS NOT NULL)), ',') AS attrs FROM range(1024) AS t(m)")
def attr_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1024).select(F.col("id").alias("mask"), F.array_join(names.attributes(F.col("id").cast("int")), ",").alias("attrs"))


@query("SELECT s_suppkey, replace(replace(rtrim(n), '*', '%2A'), '#', '#') || CASE WHEN s_suppkey % 3 = 0 THEN '..bas' WHEN s_suppkey % 3 = 1 THEN '..bin' ELSE '..asc' END || CASE WHEN s_suppkey % 2 = 0 THEN '.obf' ELSE '' END AS host FROM (SELECT s_suppkey, substr(s_name, 14, 5) || '*' AS n FROM supplier)")
def host_name_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.element_at(F.array(F.lit(0x80), F.lit(0x01), F.lit(0)), (F.col("s_suppkey") % 3 + 1).cast("int")) + F.when(F.col("s_suppkey") % 2 == 0, 0x20).otherwise(0)
    name = F.concat(F.substring("s_name", 14, 5), F.lit("*"))
    return _table(spark, sf_dir, "supplier", "s_suppkey", names.host_name(name, F.lit("   "), names.attributes(mask), charset.PC98).alias("host"))


def _links() -> list[int]:
    return [0xFE if k == 0 else 0xC0 + k % 9 if k % 7 == 0 else 0xFF if k % 53 == 0 else (k * 5 + 3) % 150 for k in range(160)]


@query(f"WITH RECURSIVE l AS (SELECT {_links()} AS links), w(k, chain, error) AS (SELECT n_nationkey::BIGINT, [(n_nationkey * 6 + 1)::BIGINT], CAST(NULL AS VARCHAR) FROM nation UNION ALL SELECT k, list_append(chain, n), CASE WHEN n >= 192 THEN NULL WHEN n >= 150 THEN 'Chain entry falls outside of disk' WHEN list_contains(chain, n) THEN 'Cycle in FAT chain' END FROM (SELECT k, chain, links[chain[-1] + 1]::BIGINT AS n FROM w, l WHERE chain[-1] < 192 AND error IS NULL)) SELECT k, array_to_string(chain, ',') AS chain, coalesce(error, CASE WHEN list_contains(chain, 255) THEN 'Unallocated cluster in FAT chain' WHEN chain[-1] > 200 AND chain[-1] <> 254 THEN 'Sector count for final cluster exceeds sectors-per-cluster limit' END, 'OK') AS error FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY len(chain) DESC) = 1")
def fat_chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = disks.follow(F.array(*map(F.lit, _links())), (F.col("n_nationkey") * 6 + 1).cast("int"), F.lit(150), F.lit(8))
    return _table(spark, sf_dir, "nation", F.col("n_nationkey").cast("bigint").alias("k"), walked.alias("w")).select("k", F.array_join(F.col("w.chain").cast("array<string>"), ",").alias("chain"), F.coalesce("w.error", F.lit("OK")).alias("error"))


@query("SELECT n_nationkey AS k, CASE WHEN 192 + n_nationkey % 9 BETWEEN 192 AND 253 AND n_nationkey % 5 > 0 THEN 2048 * (1 + n_nationkey % 3) - 2048 + 256 * (n_nationkey % 9) ELSE 2048 * (1 + n_nationkey % 3) END::BIGINT AS size FROM nation")
def alloc_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") % 9 + 192).otherwise(254)
    chain = F.concat(F.sequence(F.lit(1), F.col("n_nationkey") % 3 + 1), F.array(last.cast("int")))
    return _table(spark, sf_dir, "nation", F.col("n_nationkey").alias("k"), disks.allocated(chain, F.lit(256), F.lit(2048)).cast("bigint").alias("size"))


@query("WITH f(o, sides, spt, cpt, lsb) AS (VALUES " + ", ".join(f"({k.ordinal}, {k.sides}, {k.sectors}, {k.clusters_per_track}, {str(k.side_is_cluster_lsb).lower()})" for k in KNOWN) + ") SELECT o::INTEGER AS known, c::INTEGER AS cluster, (c // sides // cpt)::INTEGER AS track, CASE WHEN lsb THEN c % sides ELSE c // cpt % sides END::INTEGER AS side, (1 + CASE WHEN lsb THEN c // sides % cpt ELSE c % cpt END * (spt // cpt))::INTEGER AS first FROM f, range(160) AS t(c)")
def cluster_to_chs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k.ordinal, k.sides, k.sectors, k.clusters_per_track, k.side_is_cluster_lsb) for k in KNOWN], "known int, sides int, spt int, cpt int, lsb boolean")
    every = rows.crossJoin(spark.range(160).select(F.col("id").cast("int").alias("cluster")))
    return every.select("known", "cluster", disks.cluster_place(F.col("cluster"), F.col("sides"), F.col("cpt"), F.col("spt"), F.col("lsb")).alias("p")).select("known", "cluster", "p.*")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(26) ELSE p_name || chr(26) || 'x' END AS text FROM part")
def eof_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(F.lit("\x1a\0\0"), F.lit("\x1a\x1a\0"), F.lit("\x1ax")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "part", "p_partkey", disks.trimmed(F.concat("p_name", tail)).alias("text"))


# Images built from tables


def built(rows: DataFrame, key: Column, form: build.Format = build.PC88_2D, disks_a_file: int = 1, parts: int | None = None) -> DataFrame:
    """Disks scanned from images of (name, ext, data) rows, one file for each key; rows in order of ``pos``."""
    def make(table: pa.Table) -> tuple[str, bytes]:
        table = table.sort_by("pos")
        name, ext, data = (table.column(c).to_pylist() for c in ("name", "ext", "data"))
        share = -(-len(name) // disks_a_file)
        out = []
        for n in range(0, len(name), share):
            disk = build.Disk(form, boot=b"\0\0\0\0" if form.hint == "0000" else b"")
            for k in range(n, min(n + share, len(name))):
                disk.add(name[k], ext[k], data[k], 0)
            out.append(disk.build(b"BUILT"))
        return f"{table.column('key')[0].as_py()}.d88", b"".join(out)

    return d88.scan_made(rows.withColumn("key", key.cast("bigint")), make, parts)


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    return _table(spark, sf_dir, "nation", F.col("n_nationkey").alias("pos"), F.encode(F.concat(F.lit("N"), number), "US-ASCII").alias("name"), F.lit(bytearray(b"TXT")).alias("ext"), _binary(F.concat("n_name", F.lit("\r\nregion "), F.col("n_regionkey").cast("string"))).alias("data"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of images built from ``nation``: name, length and first line."""
    own = outputs.files(contents.analyzed(built(_nation(spark, sf_dir), F.lit(0), parts=1)))
    return own.select("path", F.concat(F.rtrim("name"), F.lit("."), F.rtrim("ext")).alias("name"), F.octet_length("file_data").cast("bigint").alias("length"), F.substring_index(charset.decode_pc98(F.col("file_data")), "\r\n", 1).alias("first_line"))


@query("SELECT '0.d88' AS path, printf('N%02d.TXT', n_nationkey) AS name, length(n_name || chr(13) || chr(10) || 'region ' || n_regionkey)::BIGINT AS length, n_name AS first_line FROM nation")
def d88_list_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part", F.col("p_partkey").alias("pos"), F.encode(F.lpad(F.hex("p_partkey"), 6, "0"), "US-ASCII").alias("name"), F.lit(bytearray(b"BAS")).alias("ext"), _binary(F.concat_ws(",", "p_name", "p_brand", "p_type")).alias("data"))


_PART_SQL = "SELECT printf('%06X', p_partkey) AS name, p_name || ',' || p_brand || ',' || p_type AS text FROM part"


@query(_PART_SQL)
def d88_extract_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = outputs.files(contents.analyzed(built(_parts(spark, sf_dir), F.expr("(pos - 1) div 128"))))
    return own.select("name", charset.decode_pc98(F.col("file_data")).alias("text"))


@query(_PART_SQL)
def d88_lsb_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = outputs.files(contents.analyzed(built(_parts(spark, sf_dir), F.expr("(pos - 1) div 128"), KNOWN[11])))
    return own.select("name", charset.decode_pc98(F.col("file_data")).alias("text"))


@query("SELECT disk_idx, count(*) AS files FROM (SELECT 1 + (row_number() OVER (PARTITION BY (p_partkey - 1) // 96 ORDER BY p_partkey) - 1) // (-(-count(*) OVER (PARTITION BY (p_partkey - 1) // 96) // 3)) AS disk_idx FROM part) GROUP BY disk_idx".replace("-(-count(*) OVER (PARTITION BY (p_partkey - 1) // 96) // 3)", "((count(*) OVER (PARTITION BY (p_partkey - 1) // 96) + 2) // 3)").replace("SELECT disk_idx, count(*)", "SELECT disk_idx::INTEGER AS disk_idx, count(*)"))
def d88_multi_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = outputs.files(contents.analyzed(built(_parts(spark, sf_dir), F.expr("(pos - 1) div 96"), disks_a_file=3)))
    return own.groupBy("disk_idx").agg(F.count("*").alias("files"))


@query("SELECT (p_partkey - 1) // 128 || '.d88' AS path, 0::BIGINT AS errors FROM part GROUP BY ALL")
def d88_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = contents.analyzed(built(_parts(spark, sf_dir), F.expr("(pos - 1) div 128")))
    return outputs.error_counts(done, every=True)


@query("SELECT (p_partkey - 1) // 128 || '.d88' AS path, 80::BIGINT AS tracks, 1280::BIGINT AS sectors, 327680::BIGINT AS bytes FROM part GROUP BY ALL")
def d88_sector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = d88.sectors(built(_parts(spark, sf_dir), F.expr("(pos - 1) div 128")))
    return sectors.groupBy("path").agg(F.countDistinct("track", "side").alias("tracks"), F.count("*").alias("sectors"), F.sum(F.octet_length("data").cast("bigint")).alias("bytes"))


@query("SELECT n_nationkey AS k, n_name AS text, 4096 AS start FROM nation")
def bload_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = d88.wrapped_bload(_binary("n_name"))
    padded = F.concat(wrapped, F.lit(bytearray(b"\x1a")), F.unhex(F.repeat(F.lit("00"), F.lit(251) - F.octet_length(_binary("n_name")))))
    return _table(spark, sf_dir, "nation", F.col("n_nationkey").alias("k"), d88.unwrapped_bload(padded).alias("b")).select("k", F.decode("b.payload", "UTF-8").alias("text"), F.col("b.start").alias("start"))


# Pictures


_PICTURE_SQL = "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings"


def _pictures(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A picture 64 pixels wide and 2 scan lines high whose green plane has the signs of a vector."""
    pixels = F.transform("embedding", lambda x: F.when(x > 0, "FF").otherwise("00"))
    line = F.unhex(F.array_join(F.transform(pixels, lambda g: F.concat(F.lit("00"), g, F.lit("00"))), ""))
    rows = _table(spark, sf_dir, "embeddings", "vec_id", F.size("embedding").alias("n"), line.alias("line"))
    image = F.struct(F.col("n").alias("width"), F.lit(2).alias("height"), F.lit(3).alias("nChannels"), F.concat("line", "line").alias("data"))
    packed = pictures.rbyte_encode(image) if kind == "rbyte" else pictures.rbyte88_encode(image)
    decode = pictures.rbyte_decode if kind == "rbyte" else pictures.rbyte88_decode
    back = rows.withColumn("p", decode(packed["data"])).select("vec_id", "n", F.hex("p.green").alias("g"))
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.length("g")), lambda i: F.lpad(F.conv(F.substr(F.col("g"), i, F.lit(1)), 16, 2), 4, "0")), "")
    return back.select("vec_id", F.substr(bits, F.lit(1), F.col("n")).alias("bits"))


@query(_PICTURE_SQL)
def rbyte_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pictures(spark, sf_dir, "rbyte")


@query(_PICTURE_SQL)
def rbyte88_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pictures(spark, sf_dir, "rbyte88")
