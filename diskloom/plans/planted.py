"""Registered queries over images with planted faults, and over what is written from images.

Each image is built from table rows, damaged by a rule on the row's key, and read by the whole path
from the scan to the result; the SQL is the rule written over the table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charset
from ..operators import contents, disks, outputs
from ..sources import build, d88
from ..sources.formats import KNOWN
from .registry import _binary, _bytewise, _pc88, _spread, _table, query

FORM = build.PC88_2D
#: Rows of an image; a file has one cluster of 2048 bytes.
ROWS = 128


def _images(rows: DataFrame, parts: int | None, make) -> DataFrame:
    """Disks scanned from images by ``make(rows of a key in order of pos)``."""

    def run(table: pa.Table) -> tuple[str, bytes]:
        table = table.sort_by("pos")
        return f"{table.column('key')[0].as_py()}.d88", make(table.to_pylist())

    return d88.scan_made(rows, run, parts)


def _faulty(rows: list[dict]) -> bytes:
    """An image whose k-th file has the fault k modulo 16: see CASES."""
    disk = build.Disk(FORM)
    for r in rows:
        disk.add(r["name"], b"BAS", r["data"], 0)
    heads = [e[10] for e in disk.entries]

    def put(k: int, at: int, value: bytes) -> None:
        disk.entries[k] = disk.entries[k][:at] + value + disk.entries[k][at + len(value) :]

    for k, h in enumerate(heads):
        kind = k % 16
        if kind == 1:
            put(k, 0, b"\0")
        elif kind == 2:
            disk.links[h] = h
        elif kind == 3:
            put(k, 10, b"\xc5")
        elif kind == 4:
            disk.links[h] = 0xFF
        elif kind == 5:
            put(k, 10, b"\xb0")
        elif kind == 6:
            put(k, 9, bytes([0x80, heads[k - 6]]))
        elif kind == 7:
            disk.missing.add(disk.place(h))
        elif kind == 8:
            put(k, 0, rows[k - 8]["name"])
        elif kind == 9:
            put(k, 10, b"\xfe")
        elif kind == 10:
            put(k, 9, b"\xa0")
        elif kind == 11:
            put(k, 9, b"\x51")
    return disk.build(b"FAULTS")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part", F.col("p_partkey").alias("pos"), F.expr(f"p_partkey div {ROWS}").alias("key"), F.encode(F.lpad(F.hex("p_partkey"), 6, "0"), "US-ASCII").alias("name"), _binary("p_name").alias("data"))


#: The k-th part of an image, its first cluster, and what is wrong with it.
_CASES = f"""SELECT *, p_partkey // {ROWS} || '.d88' AS path, k % 16 AS kind, c + CASE WHEN c >= 74 THEN 2 ELSE 0 END AS head,
  c - 6 + CASE WHEN c - 6 >= 74 THEN 2 ELSE 0 END AS shared,
  k % 16 = 0 AND count(*) OVER (PARTITION BY p_partkey // {ROWS}) > k + 8 AS twin
  FROM (SELECT *, p_partkey % {ROWS} AS k, p_partkey % {ROWS} + 1 AS c, printf('%06X', p_partkey) AS n FROM part)"""
_ERROR = "CASE kind WHEN 2 THEN 'Cycle in FAT chain' WHEN 3 THEN 'Head of chain cannot be a block count' WHEN 4 THEN 'Unallocated cluster in FAT chain' WHEN 5 THEN 'Head of chain falls outside of disk' WHEN 6 THEN printf('Overlapping allocation %02X', shared::INTEGER) WHEN 7 THEN 'Missing sector' WHEN 8 THEN 'Duplicate filename' ELSE CASE WHEN twin THEN 'Duplicate filename' ELSE '' END END"


def _analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents.analyzed(_images(_parts(spark, sf_dir), None, _faulty))


@query(f"""WITH c AS ({_CASES}), p AS (SELECT *, CASE kind WHEN 3 THEN 197 WHEN 5 THEN 176 WHEN 6 THEN shared WHEN 9 THEN 254 ELSE head END AS start FROM c)
  SELECT path, (k + 1)::INTEGER AS idx, CASE kind WHEN 1 THEN chr(9216) || substr(n, 2) WHEN 8 THEN printf('%06X', p_partkey - 8) ELSE n END AS name,
  {_ERROR} AS errors, CASE kind WHEN 1 THEN '' WHEN 2 THEN start || ',' || start WHEN 3 THEN '197' WHEN 4 THEN start || ',255' WHEN 5 THEN '176' WHEN 9 THEN '254' ELSE start || ',193' END AS chain,
  CASE WHEN kind IN (1, 2, 3, 4, 5, 6, 9) THEN 0 ELSE 256 END::BIGINT AS allocated,
  CASE kind WHEN 1 THEN chr(9216) || substr(n, 2) || '.BAS.asc.era' WHEN 6 THEN n || '.BAS' WHEN 8 THEN printf('%06X', p_partkey - 8) || ' (2).BAS.asc' WHEN 10 THEN n || '.BAS.obf' WHEN 11 THEN n || '.BAS.vfy.r-o.bin' ELSE n || '.BAS.asc' END AS host,
  CASE WHEN {_ERROR} = '' AND kind NOT IN (1, 9) THEN p_name WHEN kind = 9 THEN '' END AS text FROM p""")
def d88_planted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory, names, chains, owners and bytes of damaged images."""
    own = outputs.entries(_analyzed(spark, sf_dir))
    return own.select("path", "idx", "name", F.array_join("errors", ",").alias("errors"), F.array_join(F.col("chain").cast("array<string>"), ",").alias("chain"), F.col("allocated_size").alias("allocated"), F.col("host_fs_name").alias("host"), charset.decode_pc98(F.col("file_data")).alias("text"))


@query(f"WITH c AS ({_CASES}) SELECT path, sum((kind IN (2, 3, 4, 5, 7))::BIGINT)::BIGINT AS errors FROM c GROUP BY path")
def d88_planted_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted faults of each damaged image."""
    return outputs.error_counts(_analyzed(spark, sf_dir))


@query(f"""WITH c AS ({_CASES}) SELECT path, 'chain' AS stage, true AS counted, 'entry ' || (k + 1) || ': ' || {_ERROR} AS message FROM c WHERE kind IN (2, 3, 4, 5)
  UNION ALL SELECT path, 'file', true, 'entry ' || (k + 1) || ': Missing sector' FROM c WHERE kind = 7
  UNION ALL SELECT path, 'entry', false, 'entry ' || (k + 1) || ': ' || {_ERROR} FROM c WHERE kind IN (6, 8) OR twin""")
def d88_planted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault and note as a row."""
    return outputs.errors(_analyzed(spark, sf_dir)).select("path", "stage", "counted", "message")


@query(f"""WITH c AS ({_CASES}), p AS (SELECT *, CASE kind WHEN 3 THEN 197 WHEN 5 THEN 176 WHEN 6 THEN shared WHEN 9 THEN 254 ELSE head END::INTEGER AS start, CASE WHEN kind IN (1, 2, 3, 4, 5, 6, 9) THEN 0 ELSE 1 END AS units FROM c),
  h AS (SELECT *, CASE kind WHEN 1 THEN '"' || chr(9216) || substr(n, 2) || '.BAS.asc.era"' WHEN 6 THEN n || '.BAS' WHEN 8 THEN '"' || printf('%06X', p_partkey - 8) || ' (2).BAS.asc"' WHEN 10 THEN n || '.BAS.obf, ' || n || '.BAS' WHEN 11 THEN n || '.BAS.vfy.r-o.bin' ELSE n || '.BAS.asc' END AS host FROM p)
  SELECT path, (k + 1)::INTEGER AS idx, printf('%3d. %s%s%sBAS%s %3d %s %8d ATTRS=%s  START=%02X CHAIN=%s STATUS=%s', (k + 1)::INTEGER, CASE kind WHEN 1 THEN '[' ELSE ' ' END,
  CASE kind WHEN 1 THEN chr(9216) || substr(n, 2) WHEN 8 THEN printf('%06X', p_partkey - 8) ELSE n END, CASE WHEN kind = 11 THEN '*' WHEN kind IN (6, 10) THEN '.' ELSE ' ' END, CASE kind WHEN 1 THEN ']' ELSE ' ' END, units,
  CASE WHEN length(host) < 40 THEN rpad(host, 40, ' ') ELSE host END, CASE WHEN {_ERROR} = '' AND kind NOT IN (1, 9) THEN length(p_name) ELSE 0 END::INTEGER,
  CASE kind WHEN 1 THEN 'Deleted(00)' WHEN 6 THEN 'Non-ASCII' WHEN 10 THEN 'Non-ASCII, Obfuscated' WHEN 11 THEN 'Binary, Read-Only, Read-after-Write' ELSE 'None' END, start,
  CASE kind WHEN 1 THEN 'None' WHEN 2 THEN printf('%02X→%02X', start, start) WHEN 3 THEN 'C5' WHEN 4 THEN printf('%02X→FF', start) WHEN 5 THEN 'B0' WHEN 9 THEN 'FE' ELSE printf('%02X→C1', start) END, CASE {_ERROR} WHEN '' THEN 'OK' ELSE {_ERROR} END) AS line FROM h""")
def d88_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of damaged images as lines of text."""
    return outputs.listing(_analyzed(spark, sf_dir)).select("path", "idx", "line")


# Allocation tables, autorun sectors and layouts by nation


def _by_nation(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    rows = _table(spark, sf_dir, "nation", F.col("n_nationkey").alias("key"), F.col("n_nationkey").alias("pos"), _binary("n_name").alias("data"))
    return _images(rows, None, lambda own: make(own[0]["key"], own[0]["data"]))


def _tables(k: int, data: bytes) -> bytes:
    """An image whose allocation tables are sound, senseless, unlike, without the first, without metadata links, or with a senseless link."""
    disk = build.Disk(FORM)
    disk.add(b"FILE", b"TXT", data, 0)
    sound = bytes(disk.links.get(c, 0xFF) for c in range(256))

    def changed(at: int, value: int) -> bytes:
        return sound[:at] + bytes([value]) + sound[at + 1 :]

    fats = {1: (b"\1" * 256,) * 3, 2: (sound, changed(9, 0x33), sound), 3: (None, sound, sound), 4: (changed(74, 0xFF),) * 3, 5: (changed(20, 0xC9),) * 3}
    return disk.build(fats=fats.get(k % 6, (sound,) * 3))


@query("SELECT n_nationkey || '.d88' AS path, n_nationkey % 6 NOT IN (1, 4, 5) AS has_fat, n_nationkey % 6 <> 2 AS fats_match, CASE WHEN n_nationkey % 6 IN (1, 4, 5) THEN 'No FAT' ELSE '' END AS errors, CASE WHEN n_nationkey % 6 NOT IN (1, 4, 5) THEN n_name END AS text, CASE n_nationkey % 6 WHEN 1 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END::BIGINT AS counted FROM nation")
def d88_planted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which allocation tables are used, and what comes of it."""
    done = contents.analyzed(_by_nation(spark, sf_dir, _tables))
    counts = outputs.error_counts(done).select("path", "errors").withColumnRenamed("errors", "counted")
    own = done.select("path", "has_fat", "fats_match", F.explode("entries").alias("e")).select("path", "has_fat", "fats_match", F.array_join("e.errors", ",").alias("errors"), charset.decode_pc98(F.col("e.file_data")).alias("text"))
    return own.join(counts, "path", "left").withColumn("counted", F.coalesce("counted", F.lit(0).cast("bigint")))


def _fatal(k: int, data: bytes) -> bytes:
    s = build.sector
    good = build.Disk(FORM)
    good.add(b"FILE", b"TXT", data, 0)
    image = good.build()
    return {
        1: image[:0x1C] + (10**9).to_bytes(4, "little") + image[0x20:],
        2: image[:10],
        3: image[:0x20] + bytes(4) + image[0x24:],
        4: build.image([s(0, 0, 1, 1, 2, bytes(256)) * 2]),
        5: build.image([s(0, 0, 1, 1, 1, bytes(256)), s(0, 0, 2, 1, 2, bytes(256))]),
        6: build.image([s(9, 0, 1, 1, 1, bytes(256))]),
        7: image + image[:50],
        8: build.image([s(0, 0, 1, 30, 1, bytes(128))]),
    }.get(k % 9, image)


@query("SELECT n_nationkey || '.d88' AS path, d::INTEGER AS disk_idx, CASE n_nationkey % 9 WHEN 1 THEN 'the disk size field is too large' WHEN 2 THEN 'not enough data for a disk header' WHEN 3 THEN 'the first entry of the track table is empty' WHEN 4 THEN 'a sector appears more than once in a track' WHEN 5 THEN 'sectors per track varies' WHEN 6 THEN 'no sectors on side 0 of tracks 0 and 1' WHEN 7 THEN CASE d WHEN 2 THEN 'the disk size field is too large' END WHEN 8 THEN 'sector data spilled off the end' END AS fatal FROM nation, range(1, 3) AS t(d) WHERE d = 1 OR n_nationkey % 9 = 7")
def d88_planted_fatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that can't be read, each for its own reason; none fails the query."""
    return disks.formats(disks.geometry(_by_nation(spark, sf_dir, _fatal))).select("path", "disk_idx", "fatal")


def _autorun(k: int, data: bytes) -> bytes:
    return build.Disk(FORM, autorun=bytes([(1 << k % 8) | 0x10 * (k % 2), 255 if k % 5 == 0 else k]) + data).build()


@query("SELECT n_nationkey || '.d88' AS path, array_to_string(list_sort(list_distinct([CASE n_nationkey % 8 WHEN 4 THEN 'Read-Only' ELSE 'UnknownAttr:0x' || printf('%02X', (1 << (n_nationkey % 8))::INTEGER) END] || CASE WHEN n_nationkey % 2 = 1 THEN ['Read-Only'] ELSE [] END)), ', ') AS attributes, CASE WHEN n_nationkey % 5 = 0 THEN '(ask user)' ELSE n_nationkey::VARCHAR END AS file_count, n_name AS payload FROM nation")
def d88_autorun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes, file count and payload of autorun sectors."""
    own = outputs.autorun(contents.analyzed(_by_nation(spark, sf_dir, _autorun)))
    return own.select("path", F.array_join(F.array_sort(F.split("attributes", ", ")), ", ").alias("attributes"), "file_count", "payload")


def _plain(k: int, data: bytes) -> bytes:
    disk = build.Disk(FORM)
    disk.add(b"N%02d" % k, b"TXT", data, 0)
    disk.add(b"S%02d" % k, b"   ", data, 0xA0)
    return disk.build(b"NAME")


@query("SELECT n_nationkey || '.d88' AS path, c::INTEGER AS cluster, CASE c WHEN 0 THEN 254 WHEN 1 THEN 193 WHEN 2 THEN 193 WHEN 74 THEN 254 WHEN 75 THEN 254 ELSE 255 END::INTEGER AS link, 3::BIGINT AS copies FROM nation, range(256) AS t(c)")
def d88_fat_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allocation graph as an edge list, equal in its copies."""
    return outputs.fat(contents.analyzed(_by_nation(spark, sf_dir, _plain))).groupBy("path", "cluster", "link").agg(F.count("*").alias("copies"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents.analyzed(_by_nation(spark, sf_dir, _plain))


_N = "printf('N%02d', n_nationkey::INTEGER)"
_S = "printf('S%02d', n_nationkey::INTEGER)"
_PLAIN_HEX = _bytewise("n_name", _pc88(11, 13))


@query(f"""SELECT n_nationkey || '.d88' AS path, n_nationkey || ' [FAT8 Contents]' AS dir, name, hex FROM nation, LATERAL (VALUES ({_N} || '.TXT', hex(n_name)), ({_N} || '_TXT_utf8_dump.txt', hex(n_name)), ({_S} || '..bas.obf', hex(n_name)), ({_S} || '..bas_obf_utf8_dump.txt', hex(n_name)), ({_S} || '..bas', {_PLAIN_HEX}),
  ({_S} || '._bas_utf8_dump.txt', NULL), ('_boot_sector.dat', repeat('E5', 256)), ('_boot_sector_dat_utf8_dump.txt', NULL), ('_dir_sector_1.dat', NULL), ('_dir_sector_1_dat_utf8_dump.txt', NULL), ('_AutoRun.dat', repeat('00', 256)), ('_AutoRun_dat_utf8_dump.txt', NULL),
  ('_fat_sector_14.dat', 'FEC1C1' || repeat('FF', 71) || 'FEFE' || repeat('FF', 180)), ('_fat_sector_14_dat_utf8_dump.txt', NULL), ('_fat_sector_15.dat', 'FEC1C1' || repeat('FF', 71) || 'FEFE' || repeat('FF', 180)), ('_fat_sector_15_dat_utf8_dump.txt', NULL), ('_fat_sector_16.dat', 'FEC1C1' || repeat('FF', 71) || 'FEFE' || repeat('FF', 180)), ('_fat_sector_16_dat_utf8_dump.txt', NULL), ('_disk_log.txt', NULL)) AS v(name, hex)""")
def d88_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, names and bytes of all that an extraction writes."""
    own = outputs.extraction(_nations(spark, sf_dir))
    plain = F.col("name").endswith("_utf8_dump.txt") & ~F.col("name").rlike(r"_TXT_|_obf_") | (F.col("name") == outputs.LOG) | (F.col("name") == "_dir_sector_1.dat")
    return own.select("path", "dir", "name", F.when(~plain, F.hex("content")).alias("hex"))


@query("SELECT n_nationkey || ' [D88 Contents]' || CASE WHEN s < 0 THEN '' ELSE printf('/track%02d_side%d', s // 32, s // 16 % 2) END AS dir, CASE s WHEN -3 THEN 'diskname.bin' WHEN -2 THEN 'diskprotectionflag.bin' WHEN -1 THEN 'mediaflag.bin' ELSE printf('slice%02d_sector%02d', s % 16, s % 16 + 1) || ext END AS name, CASE s WHEN -3 THEN 16 WHEN -2 THEN 1 WHEN -1 THEN 1 ELSE CASE ext WHEN '.hdr' THEN 13 ELSE 256 END END::BIGINT AS bytes FROM nation, range(-3, 1280) AS t(s), (VALUES ('.hdr'), ('.dat')) AS e(ext) WHERE s >= 0 OR ext = '.hdr'")
def d88_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, names and sizes of a sector-by-sector explosion."""
    return outputs.exploded(disks.geometry(_by_nation(spark, sf_dir, _plain))).select("dir", "name", F.octet_length("content").cast("bigint").alias("bytes"))


@query("SELECT n_nationkey || '.d88' AS path, printf('Track %3d, Side %d: ', s // 2, s % 2) || array_to_string(list_transform(range(1, 17), lambda i: printf('%2d:256', i)), ', ') AS line FROM nation, range(80) AS t(s)")
def d88_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors and sizes of each track as text."""
    return outputs.geometry_listing(_nations(spark, sf_dir)).select("path", "line")


_FACTS = {
    "Detected format name": FORM.name, "8-bit character set": "pc98-8bit", "BASIC obfuscation method": "pc88", "Is side number the cluster LSB": "false", "Is PC66 SYS": "false", "Is PC66SR RXR": "false", "Is PC98 boot sector": "false",
    "D88 track count": "40", "D88 side count": "2", "D88 highest sector index": "16", "D88 total sectors": "1280", "D88 disk size": "327680", "Largest D88 sector size": "256", "Nominal D88 side count": "2", "Nominal D88 disk size": "327680", "Nominal D88 sector size": "256",
    "Virtual track count": "40", "Virtual sector size": "256", "Virtual sectors per D88 sector": "1", "Virtual sectors per track": "16", "Virtual sectors per cluster": "8", "Bytes per cluster": "2048", "Bytes per track": "4096", "Clusters per track": "2", "Total clusters": "160",
    "First metadata cluster": "0x4A", "Metadata track": "18", "Metadata side": "1", "Directory virtual sector indices": ", ".join(map(str, range(1, 13))), "Autorun data virtual sector index": "13", "FAT virtual sector indices": "14, 15, 16", "Metadata clusters": "74, 75",
}


@query("SELECT n_nationkey || '.d88' AS path, label, value FROM nation, (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in _FACTS.items()) + ") AS f(label, value)")
def d88_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found out about a format, item by item."""
    return outputs.diagnostics(_nations(spark, sf_dir)).select("path", "label", "value")


def _unknown(k: int, data: bytes) -> bytes:
    """Geometries without a known format: 60 tracks of 16 sectors on two sides, or 50 on one; each third has 8 sectors of 1024 bytes."""
    tracks, sides = (60, 2) if k % 2 else (50, 1)
    code, count = (3, 8) if k % 3 == 0 else (1, 16)
    s = build.sector
    return build.image([b"".join(s(t, h, n, code, count, b"\xff" * (128 << code)) for n in range(1, count + 1)) for t in range(tracks) for h in range(sides)])


@query("""WITH g AS (SELECT *, CASE WHEN n_nationkey % 2 = 1 THEN 60 ELSE 50 END AS tracks, CASE WHEN n_nationkey % 2 = 1 THEN 2 ELSE 1 END AS sides, CASE WHEN n_nationkey % 3 = 0 THEN 512 ELSE 256 END AS size FROM nation),
  h AS (SELECT *, least(2, floor(16 * size / ceil(tracks * sides * 16 * size / 160)))::INTEGER AS cpt, CASE WHEN sides = 1 THEN 36 ELSE 74 END AS first FROM g)
  SELECT n_nationkey || '.d88' AS path, 'Unknown format [' || CASE WHEN sides = 1 THEN 'N60/PC-6001/mkII/6601' ELSE 'N80/PC88' END || printf('-like, %d-sided, %d-track, 16-sectored, %d-byte sectors]', sides, tracks, size) AS name, CASE WHEN sides = 1 THEN 'pc6001-8bit' ELSE 'pc98-8bit' END AS charset, CASE WHEN sides = 2 THEN 'pc88' END AS obfuscation,
  size::INTEGER AS sector_size, (CASE size WHEN 512 THEN 1 ELSE 0 END)::INTEGER AS shift, cpt, (tracks * sides * cpt)::INTEGER AS total_clusters, (first // cpt // sides)::INTEGER AS metadata_track, (first // cpt % sides)::INTEGER AS metadata_side, 16 // cpt * size AS bytes_per_cluster FROM h""")
def d88_guessed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is guessed where no known format fits, and virtual sectors of larger ones."""
    own = disks.formats(disks.geometry(_by_nation(spark, sf_dir, _unknown)))
    names = ("name", "charset", "obfuscation", "sector_size", "shift", "cpt", "total_clusters", "metadata_track", "metadata_side", "bytes_per_cluster")
    return own.select("path", *[F.col(f"format.{k}").alias(k) for k in names])


@query("""WITH t AS (SELECT p_partkey, p_name || '|' || p_type AS s FROM part), l AS (SELECT p_partkey, s, unnest(range(0, length(s), 16)) AS i FROM t)
  SELECT p_partkey, i // 16 AS pos, printf('%06X: ', i::INTEGER) || array_to_string(list_transform(range(i, i + 16), lambda j: CASE WHEN j < length(s) THEN printf(' %02X', ascii(s[j + 1])) ELSE '   ' END || CASE WHEN j % 8 = 7 THEN ' ' ELSE '' END), '') || ' │' || replace(substr(s, i + 1, 16), '|', '¦') || CASE WHEN length(s) >= i + 16 THEN '│' ELSE '╭' || repeat('─', (i + 16 - length(s) - 1)::INTEGER) || '╯' END AS line FROM l
  UNION ALL SELECT p_partkey, (length(s) + 15) // 16, printf('%06X', length(s)::INTEGER) || repeat(' ', 53) || '╰' || repeat('─', (CASE WHEN length(s) % 16 = 0 THEN 16 ELSE length(s) % 16 END)::INTEGER) || '╯' FROM t""")
def hexdump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps of bytes with their glyphs."""
    rows = _spread(_table(spark, sf_dir, "part", "p_partkey", F.concat("p_name", F.lit("|"), "p_type").alias("text")), 100_000)
    own = rows.select("p_partkey", F.posexplode(outputs.hexdump(_binary("text"), F.lit(charset.PC98))).alias("pos", "line"))
    return own.select("p_partkey", F.col("pos").cast("bigint").alias("pos"), "line")


@query("SELECT n_nationkey || '.d88' AS path, section, n FROM nation, (VALUES (1, 80), (2, 32), (3, 18), (4, 29), (5, 21), (6, 2), (8, 6)) AS s(section, n) ORDER BY ALL".replace(" ORDER BY ALL", "").replace("section, n FROM", "section::INTEGER AS section, n::BIGINT AS n FROM"))
def d88_log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each section of a disk's log."""
    return outputs.log_lines(_nations(spark, sf_dir)).groupBy("path", "section").agg(F.count("*").alias("n"))
