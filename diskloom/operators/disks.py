"""Geometry and format of each disk within its row, and expressions over its allocation table.

Every step adds columns to the row that the scan made. Nothing is shuffled: a disk's payload
stays on the executor that read it, however many disks there are, and a row is bounded by the
size of one disk. Geometry and format are column expressions; the directory with its greedy
names, and the files, are put together by ``contents.contents()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charset import PC98, PC6001, latin
from ..functions.names import DELETED, let
from ..sources.formats import KNOWN

FINAL, END, FREE = 0xC0, 0xFE, 0xFF
MAX_CLUSTERS = 160


def _fail(when: Column, why: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), why)


def _sealed(fatal: Column) -> Column:
    """The column unchanged, but as an expression that the optimizer neither copies nor moves.

    A step's arrays must be made once for a disk. Without the seal, projections would be merged
    and an array would be made again for each element of a lambda that reads it.
    """
    return F.coalesce(fatal, F.when(F.rand(0) < 0, F.lit("")))


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumns({name: value, "fatal": _sealed(F.col("fatal"))})


def _guard(df: DataFrame, *why: Column) -> DataFrame:
    """Add reasons why a disk can't be used; the first one stays."""
    return df.withColumn("fatal", _sealed(F.coalesce("fatal", *why)))


def _ok(value: Column) -> Column:
    return F.when(F.col("fatal").isNull(), value)


def geometry(disks: DataFrame) -> DataFrame:
    """Checks the walks, keeps the last walk of each track and side, and measures what is there."""
    track, walk = "bigint(s.track) * 65536 + s.side", "bigint(s.table_pos) * 65536"

    def kinds(number: str) -> str:
        return f"size(array_distinct(transform(sectors, s -> {number})))"  # longs are told apart by hash, structs one by one

    swept = "aggregate(array_sort(transform(sectors, s -> struct(s.data_offset AS a, s.data_offset + octet_length(s.data) AS b))), struct(0L AS end, false AS bad), (t, r) -> struct(r.b AS end, t.bad OR r.a < t.end AS bad)).bad"
    checked = _guard(
        disks,
        _fail(F.expr(f"{kinds(walk + ' + s.sec_num')} < size(sectors)"), "a sector appears more than once in a track"),
        _fail(F.expr(f"{kinds(f'({track}) * 65536 + s.sectors_in_track')} > {kinds(track)}"), "sectors per track varies"),
        _fail(F.expr(swept), "found overlapping sector data"),
    )
    walks = f"transform(array_distinct(transform(sectors, s -> ({walk}) * 65536 + {track})), k -> struct(int(shiftright(k, 32)) AS p, k % 4294967296 AS t))"
    last = f"transform(array({walks}), w -> transform(filter(w, x -> NOT exists(w, y -> y.t = x.t AND y.p > x.p)), x -> x.p))"
    kept = _with(checked, "sectors", F.expr(f"transform({last}, p -> filter(sectors, s -> array_contains(p, s.table_pos)))[0]"))
    sizes = "transform(sectors, s -> octet_length(s.data))"
    most = lambda name: f"coalesce(array_max(transform(sectors, s -> s.{name})), -1)"
    found = f"struct({most('track')} + 1 AS tracks, greatest(1, {most('side')} + 1) AS sides, greatest(0, {most('sec_num')}) AS sectors, size(sectors) AS total_sectors, aggregate({sizes}, 0L, (t, n) -> t + n) AS disk_size, coalesce(array_max({sizes}), 0) AS largest_sector)"
    return _with(kept, "found", _ok(F.expr(found)))


def _starts(boot: str, *heads: bytes) -> str:
    return "(" + " OR ".join(f"startswith({boot}, X'{x.hex()}')" for x in heads) + ")"


def _text(value: object) -> str:
    return "CAST(NULL AS STRING)" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


_KNOWN_SQL = "array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {_text(v)}" for k, v in row._asdict().items()) + ")" for row in KNOWN) + ")"


def known_format(tracks: str, sides: str, sectors: str, boot: str) -> Column:
    """The known format with this geometry whose hints fit best, all given as SQL; of equals the first listed."""
    met = f"CASE k.hint WHEN 'len=128' THEN octet_length({boot}) = 128 WHEN 'len<>128' THEN octet_length({boot}) <> 128 WHEN 'SYS' THEN {_starts(boot, b'SYS')} WHEN 'IPL|RXR' THEN {_starts(boot, b'IPL', b'RXR')} WHEN '0000' THEN {_starts(boot, bytes(4))} END"
    fits = f"filter({_KNOWN_SQL}, k -> k.tracks = {tracks} AND k.sides = {sides} AND k.sectors = {sectors})"
    return F.expr(f"array_max(transform({fits}, k -> struct(coalesce(int({met}), 0) AS score, -k.ordinal AS first, k AS k))).k")


def formats(disks: DataFrame) -> DataFrame:
    """The format of each disk: guessed from its boot sector and size, then overridden by a known one.

    The expressions are SQL text, which is parsed once a step; built call by call they would cost seconds.
    """
    low, front = "filter(sectors, s -> s.track IN (0, 1))", "filter(sectors, s -> s.track IN (0, 1) AND s.side = 0)"
    first = f"""struct(get(filter(sectors, s -> s.track = 0 AND s.side = 0 AND s.sec_num = 1), 0).data AS boot, array_max(transform({front}, s -> s.sectors_in_track)) AS spt,
      array_max(transform({low}, s -> s.side)) + 1 AS sides, array_max(transform({front}, s -> octet_length(s.data))) AS size)"""
    df = _guard(_with(disks, "n", _ok(F.expr(first))), _fail(F.expr("fatal IS NULL AND n.spt IS NULL"), "no sectors on side 0 of tracks 0 and 1"))
    df = _with(df, "v", _ok(F.expr("aggregate(sequence(1, 24), struct(n.size AS size, n.spt AS spt, 0 AS shift), (v, i) -> CASE WHEN v.size > 256 AND v.spt < 16 THEN struct(shiftright(v.size, 1) AS size, shiftleft(v.spt, 1) AS spt, v.shift + 1 AS shift) ELSE v END)")))
    df = _with(df, "is", F.expr(f"struct(coalesce({_starts('n.boot', b'RXR', b'IPL')}, false) AS rxr, coalesce({_starts('n.boot', b'SYS')}, false) AS sys, coalesce(octet_length(n.boot) = 128, false) AS pc98, coalesce({_starts('n.boot', bytes(4))}, false) AS lsb)"))
    small, disk = "(is.sys OR is.rxr OR n.sides = 1)", "bigint(found.tracks) * n.sides * v.spt * v.size"
    df = _with(df, "g", _ok(F.expr(f"""struct(CASE WHEN is.rxr THEN 74 WHEN is.sys OR n.sides = 1 THEN 36 WHEN is.pc98 THEN 70 ELSE 74 END AS first, CASE WHEN {small} THEN '{PC6001}' ELSE '{PC98}' END AS charset,
      CASE WHEN is.lsb OR {small} THEN NULL WHEN is.pc98 THEN 'pc98' ELSE 'pc88' END AS obfuscation, {disk} AS disk, v.spt * v.size AS per_track,
      int(least(2, floor(try_divide(v.spt * v.size, ceil({disk} / {MAX_CLUSTERS}))))) AS cpt)""")))
    df = _guard(df, _fail(F.expr("fatal IS NULL AND coalesce(g.cpt, 0) = 0"), "more tracks than clusters: no cluster fits a track"))
    df = _with(df, "k", _ok(known_format("found.tracks", "n.sides", "v.spt", "n.boot")))
    title = "CASE WHEN is.lsb THEN 'Pasopia' WHEN is.rxr THEN 'PC-6001 mkII SR/6601 SR' WHEN is.sys OR n.sides = 1 THEN 'N60/PC-6001/mkII/6601' WHEN is.pc98 THEN 'PC98' ELSE 'N80/PC88' END"
    either = lambda name, guessed: f"CASE WHEN k IS NOT NULL THEN k.{name} ELSE {guessed} END"
    unknown = f"format_string('Unknown format [%s-like, %d-sided, %d-track, %d-sectored, %d-byte sectors]', {title}, n.sides, found.tracks, v.spt, v.size)"
    df = _with(df, "f", _ok(F.expr(f"""struct({either('name', unknown)} AS name, coalesce(k.ordinal, 0) AS known, {either('charset', 'g.charset')} AS charset, {either('obfuscation', 'g.obfuscation')} AS obfuscation,
      {either('metadata_track', 'int(g.first div g.cpt div n.sides)')} AS metadata_track, {either('metadata_side', 'int((g.first div g.cpt) % n.sides)')} AS metadata_side, {either('clusters_per_track', 'g.cpt')} AS cpt,
      {either('side_is_cluster_lsb', 'is.lsb')} AS lsb, {either('fat_tracks', 'coalesce(try_element_at(map(36, 35, 41, 40, 78, 77, 81, 80), found.tracks), found.tracks)')} AS tracks,
      CASE WHEN k IS NOT NULL THEN k.fat_tracks * n.sides * k.clusters_per_track ELSE found.tracks * n.sides * g.cpt END AS total_clusters,
      CASE WHEN k IS NOT NULL THEN (k.metadata_track * n.sides + k.metadata_side) * k.clusters_per_track ELSE g.first END AS first_metadata_cluster)""")))
    spc, beside, plain = "int(v.spt div f.cpt)", "f.metadata_track * f.cpt * n.sides + f.metadata_side", "(f.metadata_track * n.sides + f.metadata_side) * f.cpt"
    df = _with(df, "format", _ok(F.expr(f"""struct(f.*, n.boot AS boot, is.sys AS is_pc66_sys, is.rxr AS is_pc66sr_rxr, is.pc98 AS is_pc98_sys, n.sides AS sides, v.spt AS spt, v.size AS sector_size, v.shift AS shift, g.disk AS disk_size, g.per_track AS bytes_per_track,
      {spc} AS sectors_per_cluster, {spc} * v.size AS bytes_per_cluster, sequence(v.spt - 2, v.spt) AS fat_vsecs, v.spt - 3 AS autorun_vsec, CASE WHEN v.spt > 4 THEN sequence(1, v.spt - 4) ELSE cast(array() AS array<int>) END AS dir_vsecs,
      CASE WHEN f.lsb THEN sequence({beside}, {beside} + (f.cpt - 1) * n.sides, n.sides) ELSE sequence({plain}, {plain} + f.cpt - 1) END AS metadata_clusters)""")))
    df = _guard(df, _fail(F.expr("get(format.metadata_clusters, 0) <> format.first_metadata_cluster"), "the metadata clusters don't begin where the format has them"))
    return df.drop("n", "v", "is", "g", "k", "f")


def virtual(sectors: Column, shift: Column, size: Column) -> Column:
    """Virtual sectors of physical ones: 2**shift pieces of ``size`` bytes each, numbered through the track."""
    pieces = F.sequence(F.lit(0), F.shiftleft(F.lit(1), shift) - 1) if isinstance(shift, int) else F.sequence(F.lit(0), F.expr("shiftleft(1, format.shift)") - 1)
    return F.flatten(F.transform(sectors, lambda x: F.transform(pieces, lambda j: F.struct(
        x["track"].alias("track"), x["side"].alias("side"), ((x["sec_num"] - 1) * F.size(pieces) + 1 + j).alias("vsec"), F.substring(x["data"], j * size + 1, size).alias("vdata")))))


def numbers(data: Column) -> Column:
    """Byte values of a binary."""
    return F.when(F.octet_length(data) > 0, F.transform(F.split(latin(data), ""), lambda c: F.ascii(c))).when(data.isNotNull(), F.array().cast("array<int>"))


def byte(data: Column, at: int) -> Column:
    """One byte of a binary, counted from 0."""
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("int")


def deleted(e: Column) -> Column:
    return F.array_contains(e["fattrs"], DELETED)


def usable_fat(links: Column, total: Column, spc: Column, meta: Column) -> Column:
    """Whether a table reserves boot and metadata clusters and has plausible links only."""
    def counts(n: Column) -> Column:
        return n.between(F.lit(FINAL), F.lit(FINAL) + spc)

    start = F.get(links, F.lit(0))
    boot = (start == END) | (start < total) | counts(start)
    kept = F.forall(meta, lambda c: (F.get(links, c) == END) | F.array_contains(meta, F.get(links, c)) | counts(F.get(links, c)))
    sane = F.forall(F.slice(links, F.lit(1), total), lambda n: (n < total) | counts(n) | n.isin(END, FREE))
    return boot & kept & sane


def follow(links: Column, head: Column, total: Column, spc: Column) -> Column:
    """struct(chain, error): the clusters from ``head`` on and the link that ends them."""
    none = F.lit(None).cast("string")
    early = F.when((head >= FINAL) & ~head.isin(END, FREE), "Head of chain cannot be a block count").when((head < FINAL) & (head >= total), "Head of chain falls outside of disk")
    begin = F.struct(F.array(head).alias("chain"), early.alias("error"))

    def step(state: Column, _: Column) -> Column:
        last = F.element_at(state["chain"], -1)

        def take(link: Column) -> Column:
            wrong = F.when((link < FINAL) & (link >= total), "Chain entry falls outside of disk").when((link < FINAL) & F.array_contains(state["chain"], link), "Cycle in FAT chain").otherwise(none)
            return F.struct(F.concat(state["chain"], F.array(link)).alias("chain"), wrong.alias("error"))

        return F.when((last < FINAL) & state["error"].isNull(), let(F.get(links, last), take)).otherwise(state)

    def finish(state: Column) -> Column:
        last = F.element_at(state["chain"], -1)
        late = F.when(F.array_contains(state["chain"], FREE), "Unallocated cluster in FAT chain").when((last > F.lit(FINAL) + spc) & (last != END), "Sector count for final cluster exceeds sectors-per-cluster limit")
        return F.struct(state["chain"].alias("chain"), F.coalesce(state["error"], late).alias("error"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(256)), begin, step, finish)


def allocated(chain: Column, sector: Column, cluster: Column) -> Column:
    """Bytes that a chain holds; a block count shortens its last cluster."""
    last = F.element_at(chain, -1)
    return cluster * (F.size(chain) - 1) + F.when((last >= FINAL) & (last < END), sector * (last - FINAL) - cluster).otherwise(0)


def cluster_place(cluster: Column, sides: Column, cpt: Column, spt: Column, lsb: Column) -> Column:
    """struct(track, side, first): where a cluster's sectors begin."""
    def div(a: Column, b: Column) -> Column:
        return F.floor(a / b).cast("int")

    inner = F.when(lsb, div(cluster, sides) % cpt).otherwise(cluster % cpt)
    side = F.when(lsb, cluster % sides).otherwise(div(cluster, cpt) % sides)
    return F.struct(div(div(cluster, sides), cpt).alias("track"), side.cast("int").alias("side"), (inner * div(spt, cpt) + 1).cast("int").alias("first"))


def trimmed(block: Column) -> Column:
    """Last sector of a file (as Latin-1 text) without its end mark and the zeros after it."""
    return F.regexp_replace(block, "\\x1a\\x00*\\z", "")
