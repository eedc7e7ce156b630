import pytest
from pyspark.sql import functions as F

from diskloom.functions import names
from diskloom.functions.charset import PC98, PC6001
from diskloom.operators import contents, disks, outputs
from diskloom.sources import build, d88
from diskloom.sources.formats import KNOWN

BOOT = {"SYS": b"SYS", "IPL|RXR": b"RXR", "0000": b"\0\0\0\0"}


def disk(form=build.PC88_2D, **more):
    return build.Disk(form, boot=BOOT.get(form.hint, b""), **more)


def analyzed(spark, cases):
    rows = spark.createDataFrame([(k, bytes(v)) for k, v in cases.items()], "path string, content binary")
    return contents.analyzed(d88.scan(rows)).cache()


def entries(done, path, number=1):
    row = done.where((F.col("path") == path) & (F.col("disk_idx") == number)).first()
    return row, {e.name.strip() + "." + e.ext.strip() + f"#{e.idx}": e for e in row.entries or []}


def test_headers_that_cannot_be_read():
    good = disk().build()
    cases = [b"", b"x" * 10, good[:0x1C] + (10**9).to_bytes(4, "little") + good[0x20:], good[:0x1C] + (8).to_bytes(4, "little") + good[0x20:], good[:0x20] + b"\1" + good[0x21:], good[:0x20] + bytes(4) + good[0x24:]]
    for data in cases:
        rows = list(d88.disks_of("p", data))
        assert len(rows) == 1 and rows[0]["fatal"] and rows[0]["sectors"] == []
    assert list(d88.disks_of("p", None))[0]["fatal"]


def test_walks_and_several_disks():
    one = disk().build(b"NAME", protected=True)
    rows = list(d88.disks_of("p", one + one))
    assert [(r["disk_idx"], r["disk_suffix"], len(r["sectors"])) for r in rows] == [(1, " [Disk 01]", 1280), (2, " [Disk 02]", 1280)]
    assert rows[0]["disk_name"] == b"NAME" and rows[0]["disk_attrs"] == ["DiskWriteProtected"]
    assert list(d88.disks_of("p", one))[0]["disk_suffix"] == ""
    late = list(d88.disks_of("p", one + b"garbage"))
    assert late[0].get("fatal") is None and late[1]["fatal"]
    huge = build.image([build.sector(0, 0, 1, 40, 1, b"x" * 128)])
    assert "spilled" in list(d88.disks_of("p", huge))[0]["fatal"]


@pytest.fixture(scope="module")
def corpus(spark):
    cases = {}
    for form in KNOWN:
        own = disk(form, code=0 if form.hint == "len=128" else 1)
        if own.code:
            own.add(b"HELLO", b"BAS", b"10 PRINT\r\n" * 100, 0x80)
            own.add(b"EMPTY", b"", b"", 0)
            own.add(b"secret", b"bas", bytes(range(256)) * 5, 0xA0)
        cases[form.name] = own.build(b"NAME")
    s = build.sector
    cases["dup"] = build.image([s(0, 0, 1, 1, 2, bytes(256)) + s(0, 0, 1, 1, 2, bytes(256))])
    cases["count"] = build.image([s(0, 0, 1, 1, 1, bytes(256)), s(0, 0, 2, 1, 2, bytes(256))])
    cases["replaced"] = build.image([s(0, 0, 1, 1, 2, b"old".ljust(256)), s(1, 0, 1, 1, 1, bytes(256)), s(0, 0, 2, 1, 2, b"new".ljust(256))])
    cases["nolow"] = build.image([s(9, 0, 1, 1, 1, bytes(256))])
    big = [s(t, h, n, 3, 8, bytes(1024)) for t in range(2) for h in range(1) for n in range(1, 9)]
    cases["1024"] = build.image([b"".join(big[:8]), b"".join(big[8:])])
    cases["toomany"] = build.image([b"".join(s(t, h, n, 1, 16, bytes(256)) for n in range(1, 17)) for t in (0, 81) for h in range(2)])
    f = disk()
    f.add(b"A", b"TXT", b"a" * 3000)
    f.add(b"A", b"TXT", b"b" * 10)
    f.add(b"GONE", b"X", b"c")
    f.entries[-1] = b"\0" + f.entries[-1][1:]
    f.add(b"NUL", b"", b"n")
    f.add(b"a", b"txt", b"d")
    f.add(b"F*:?", b"%", b"e")
    f.add(b"LOOP", b"", b"f")
    head = f.entries[-1][10]
    f.links[head] = head + 1
    f.links[head + 1] = head
    for name, cluster in ((b"HEADC5", 0xC5), (b"FREE", 0xFF), (b"OUT", 0xB0), (b"FE", 0xFE)):
        f.entries.append(name.ljust(6) + b"   " + bytes([0, cluster]) + b"\xff" * 5)
    first = f.entries[0][10]
    f.entries.append(b"SHARE1" + b"   " + bytes([0x80, first]) + b"\xff" * 5)
    f.entries.append(b"SHARE2" + b"   " + bytes([0x01, first]) + b"\xff" * 5)
    f.add(b"LOST", b"", b"g" * 100)
    track, side, sector = f.place(f.entries[-1][10])
    f.missing.add((track, side, sector))
    f.add(b"MID", b"", b"x\x1a" * 200, end=b"")
    cases["faults"] = f.build()
    cases["nofat"] = disk(entries=[b"X".ljust(9) + bytes([0, 5]) + b"\xff" * 5]).build(fats=(b"\x01" * 256,) * 3)
    g = disk()
    g.add(b"OK", b"", b"ok")
    base = bytes(g.links.get(k, 0xFF) for k in range(256))
    cases["copies"] = g.build(fats=(base, bytes([*base[:5], 0x33, *base[6:]]), base))
    cases["firstgone"] = g.build(fats=(None, base, base))
    return analyzed(spark, cases)


def test_known_formats_files_and_names(corpus):
    for form in KNOWN:
        row, found = entries(corpus, form.name)
        assert row.fatal is None or form.hint == "len=128", (form.name, row.fatal)
        if form.hint == "len=128":
            continue
        want = 6 if form.ordinal == 2 else form.ordinal
        assert row.format.known == want and row.has_fat and row.fats_match
        assert found["HELLO.BAS#1"].file_data == b"10 PRINT\r\n" * 100 and found["HELLO.BAS#1"].errors == []
        assert found["EMPTY.#2"].file_data == b"" and found["EMPTY.#2"].host_fs_name == "EMPTY..asc"
        assert found["secret.bas#3"].file_data == bytes(range(256)) * 5
        assert found["secret.bas#3"].host_fs_name == "secret.bas.obf" and found["secret.bas#3"].host_fs_deobf_name == "secret.bas"


def test_metadata_clusters(corpus):
    want = {1: [80], 4: [36, 37], 5: [74, 75], 10: [74, 75], 12: [72, 74]}
    for k, clusters in want.items():
        assert entries(corpus, KNOWN[k - 1].name)[0].format.metadata_clusters == clusters


def test_sector_checks(corpus):
    fatal = {r.path: r.fatal for r in corpus.select("path", "fatal").collect()}
    assert "more than once" in fatal["dup"] and "varies" in fatal["count"] and "tracks 0 and 1" in fatal["nolow"]
    assert "no cluster fits" in fatal["toomany"]
    row = corpus.where("path = 'replaced'").first()
    assert row.found.total_sectors == 2 and row.found.sectors == 2 and [(x.track, x.sec_num) for x in row.layout] == [(1, 1), (0, 2)]


def test_virtual_sectors(spark):
    s = build.sector
    tracks = [b"".join(s(t, 0, n, 3, 8, bytes(1024)) for n in range(1, 9)) for t in range(2)]
    row = disks.formats(disks.geometry(d88.scan(spark.createDataFrame([("p", build.image(tracks))], "path string, content binary")))).first()
    assert (row.format.sector_size, row.format.spt, row.format.shift) == (512, 16, 1)


def test_faulty_entries(corpus):
    row, e = entries(corpus, "faults")
    by = {k.split("#")[0]: v for k, v in e.items()}
    assert [x.errors for x in row.entries[:2]] == [["Duplicate filename"]] * 2
    assert e["␀ONE.X#3"].errors == [] and e["␀ONE.X#3"].file_data is None and "Deleted(00)" in e["␀ONE.X#3"].fattrs
    assert by["NUL."].host_fs_name == "%4E%55%4C..bas"
    assert by["a.txt"].host_fs_name == "a (3).txt.bas" and row.entries[1].host_fs_name == "A (2).TXT.bas"
    assert by["F*:?.%"].host_fs_name == "F%2A%3A%3F.%25.bas"
    assert by["LOOP."].errors == ["Cycle in FAT chain"]
    assert by["HEADC5."].errors == ["Head of chain cannot be a block count"]
    assert by["FREE."].errors == ["Unallocated cluster in FAT chain"]
    assert by["OUT."].errors == ["Head of chain falls outside of disk"]
    assert by["FE."].errors == [] and by["FE."].file_data == b""
    assert by["SHARE1."].errors == [] and [x[:11] for x in by["SHARE2."].errors] == ["Overlapping"] * len(by["SHARE2."].errors) and by["SHARE2."].errors
    assert by["LOST."].errors == ["Missing sector"] and by["LOST."].file_data is None
    assert by["MID."].file_data[:400] == b"x\x1a" * 199 + b"x" or by["MID."].file_data.startswith(b"x\x1a" * 128)


def test_allocation_tables(corpus):
    row, e = entries(corpus, "nofat")
    assert not row.has_fat and row.entries[0].errors == ["No FAT"]
    assert not entries(corpus, "copies")[0].fats_match
    assert entries(corpus, "firstgone")[0].has_fat


def test_error_counts(corpus):
    counts = {r.path: r.errors for r in outputs.error_counts(corpus).collect()}
    assert counts["dup"] == 1 and counts["nofat"] == 2 and counts["faults"] == 5
    assert counts["copies"] == 0 and KNOWN[4].name not in counts


def test_outputs(corpus):
    five = corpus.where(F.col("path") == KNOWN[4].name)
    got = {r.name: bytes(r.content) for r in outputs.extraction(five).collect()}
    assert got["HELLO.BAS"] == b"10 PRINT\r\n" * 100 and "HELLO_BAS_utf8_dump.txt" in got and "_fat_sector_16.dat" in got and "_AutoRun.dat" in got
    assert "secret.bas" in got and got["secret.bas"] != got["secret.bas.obf"]
    assert all(r.dir.endswith("[FAT8 Contents]") for r in outputs.extraction(five).select("dir").distinct().collect())
    lines = [r.line for r in outputs.listing(five).orderBy("idx").collect()]
    assert lines[0].startswith("  1.  HELLO .BAS ") and "STATUS=OK" in lines[0]
    assert "Track   0, Side 0:  1:256" in outputs.log(five).first().log
    assert outputs.autorun(five).first().attributes == "None"
    assert outputs.fat(five).where("cluster = 0").first().link == 0xFE


def test_explosion_and_writing(spark, tmp_path):
    scanned = disks.geometry(d88.scan(spark.createDataFrame([("dir/x.d88", disk().build(b"N"))], "path string, content binary")))
    rows = outputs.exploded(scanned)
    outputs.write_files(rows, str(tmp_path))
    root = tmp_path / "x [D88 Contents]"
    assert (root / "diskname.bin").read_bytes() == b"N".ljust(16, b"\0")
    assert len((root / "track00_side0" / "slice00_sector01.hdr").read_bytes()) == 13
    assert len(list(root.rglob("*.dat"))) == 1280


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.d88").write_bytes(disk().build())
    (tmp_path / "b.txt").write_bytes(b"x")
    assert d88.read(spark, str(tmp_path)).select("path", "disk_idx").count() == 1


def test_chains_as_columns_agree_with_the_worker(spark):
    import random

    r = random.Random(3)
    cases = [(bytes(r.choice([r.randrange(20), 0xC0 + r.randrange(12), 0xFE, 0xFF]) for _ in range(256)), r.choice([r.randrange(22), 0xC3, 0xFE, 0xFF, 0xB0])) for _ in range(200)]
    df = spark.createDataFrame([(bytearray(f), h) for f, h in cases], "f binary, h int")
    rows = df.select("f", "h", disks.follow(disks.numbers(F.col("f")), F.col("h"), F.lit(18), F.lit(8)).alias("w"), disks.usable_fat(disks.numbers(F.col("f")), F.lit(18), F.lit(8), F.array(F.lit(3))).alias("u")).collect()
    form = {"total_clusters": 18, "metadata_clusters": [3], "sectors_per_cluster": 8}
    for row in rows:
        assert (row.w.chain, row.w.error) == contents.follow(bytes(row.f), row.h, 18, 8)
        assert row.u == contents.usable(bytes(row.f), form)


def test_names_as_columns_agree_with_the_worker(spark):
    cases = [("HELLO ", "BAS", 0x80), ("CON   ", "   ", 0), ("      ", "   ", 1), (" A.B. ", "X  ", 0x20), ("......", "   ", 0x10), ("a%b*", "", 0x4E), ("¥¦\\|", "n88", 0x80), ("", "cod", 1), (".", "", 0), ("AUX", "BAS", 0xA0)]
    df = spark.createDataFrame([(*c, k) for c in cases for k in (PC98, PC6001)], "n string, e string, m int, k string")
    rows = df.withColumn("a", names.attributes(F.col("m"))).withColumn("h", names.host_name(F.col("n"), F.col("e"), F.col("a"), F.col("k"))).collect()
    for row in rows:
        assert row.h == contents.host_name(row.n, row.e, set(row.a), row.k), row
    assert spark.range(1).select(names.dump_name(F.lit("a.b.bin"))).first()[0] == "a.b_bin_utf8_dump.txt"
    assert spark.range(1).select(names.quoted_if_odd(F.lit("a b"))).first()[0] == '"a b"'


def test_bload(spark):
    wrap = lambda b: d88.unwrapped_bload(F.lit(bytearray(b)))
    good = b"\0\x10\3\x10abc"
    row = spark.range(1).select(wrap(good).alias("a"), wrap(b"\0").alias("b"), wrap(b"\3\x10\0\x10").alias("c"), wrap(b"\0\1\3\1abc").alias("d"), wrap(good + b"\0").alias("e"), wrap((good + b"\x1a").ljust(256, b"\0")).alias("f"), wrap(good + b"\x1a").alias("g"), F.hex(d88.wrapped_bload(F.lit(bytearray(b"abc")))).alias("h"), d88.wrapped_bload(F.lit(bytearray(10)), 0xFFFE).alias("i")).first()
    assert bytes(row.a.payload) == b"abc" and bytes(row.f.payload) == b"abc" and row.h == good.hex().upper() and row.i is None
    assert all(x.error for x in (row.b, row.c, row.d, row.e, row.g))


def test_images_are_walked_where_they_are_built_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(d88, "ROWS_A_TASK", 50)

    def make(table):
        return f"{table.column('key')[0].as_py()}.d88", build.Disk(build.PC88_2D).build()

    done = d88.scan_made(spark.range(1000).select("id", F.expr("id div 10").alias("key")), make)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow [" not in plan.replace("FlatMapGroupsInArrow [", "")
    tasks = done.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 100 and len(tasks) > 12 and max(r["count"] for r in tasks) < 30


def test_sectors_by_column_are_those_of_the_walk():
    import random

    import pyarrow as pa

    r, good = random.Random(8), disk().build(b"NAME")
    cases = [None, b"", good[:100], good + good, good + good[:50], build.image([build.sector(0, 0, 1, 30, 1, bytes(128))])]
    for _ in range(20):
        bad = bytearray(good)
        for _ in range(3):
            bad[r.choice([r.randrange(0x20, 0x300), 688 + 272 * r.randrange(1280) + r.randrange(16)])] = r.randrange(256)
        cases.append(bytes(bad))
    for data in cases:
        want = pa.Table.from_pylist(list(d88.disks_of("p", data)), schema=d88._SCHEMA)
        assert pa.Table.from_batches(d88.batches_of("p", data), schema=d88._SCHEMA).to_pylist() == want.to_pylist()


def test_error_counts_of_every_file_in_one_pass(corpus):
    some = {r.path: r.errors for r in outputs.error_counts(corpus).collect()}
    every = {r.path: r.errors for r in outputs.error_counts(corpus, every=True).collect()}
    assert every == {r.path: some.get(r.path, 0) for r in corpus.select("path").distinct().collect()} and every[KNOWN[4].name] == 0
