"""What users take from analysed disks: tables, logs, dumps and files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charset import decode, glyphs
from ..functions.names import DELETED, OBFUSCATED, dump_name, let, quoted_if_odd
from ..functions.obfuscation import deobfuscate_by
from .disks import byte, deleted

EMPTY = bytearray(b"")


def entries(disks: DataFrame) -> DataFrame:
    """One row for each directory entry of usable disks."""
    own = disks.where("fatal IS NULL").select("path", "disk_idx", F.col("format.charset").alias("charset"), F.col("format.obfuscation").alias("obfuscation"), F.explode("entries").alias("e"))
    return own.select("path", "disk_idx", "charset", "obfuscation", "e.*")


def files(disks: DataFrame) -> DataFrame:
    """One row for each readable file, with its plain bytes where it was obfuscated by a known method."""
    own = entries(disks).where("file_data IS NOT NULL AND size(errors) = 0")
    hidden = F.array_contains("fattrs", OBFUSCATED) & F.col("obfuscation").isNotNull()
    return own.select("path", "disk_idx", "idx", "name", "ext", "fattrs", "charset", "host_fs_name", F.when(hidden, F.col("host_fs_deobf_name")).alias("host_fs_deobf_name"), "file_data", F.when(hidden, deobfuscate_by(F.col("file_data"), F.col("obfuscation"))).alias("deobf_data"))


def fat(disks: DataFrame) -> DataFrame:
    """The allocation graph as an edge list: (path, disk_idx, fat_vsec, cluster, link)."""
    from .disks import numbers

    own = disks.where("fatal IS NULL").select("path", "disk_idx", F.explode("fats").alias("x"))
    return own.select("path", "disk_idx", F.col("x.vsec").alias("fat_vsec"), F.posexplode(numbers(F.col("x.vdata"))).alias("cluster", "link"))


def stopped(disks: DataFrame) -> DataFrame:
    """Without the disks that lie behind a fatal one in their file; their contents are not to be trusted."""
    first = disks.where("fatal IS NOT NULL").groupBy("path").agg(F.min("disk_idx").alias("stop"))
    return disks.join(first, "path", "left").where("stop IS NULL OR disk_idx <= stop").drop("stop")


def errors(disks: DataFrame, every: bool = False) -> DataFrame:
    """(path, disk_idx, stage, severity, counted, message), one row for each fault; ``every`` adds a row of nulls for a disk without one."""
    def fault(when: Column, stage: str, message: Column | str, counted: bool = True) -> Column:
        text = message if isinstance(message, Column) else F.lit(message)
        return F.when(when, F.array(F.struct(F.lit(stage).alias("stage"), F.lit("error" if counted else "note").alias("severity"), F.lit(counted).alias("counted"), text.alias("message")))).otherwise(F.array().cast("array<struct<stage:string,severity:string,counted:boolean,message:string>>"))

    fmt = F.col("format")
    here = F.transform("metadata", lambda x: x["vsec"])
    absent = F.transform(F.array_except(fmt["dir_vsecs"], here), lambda v: F.struct(F.lit("directory").alias("stage"), F.lit("error").alias("severity"), F.lit(True).alias("counted"), F.format_string("missing directory sector %d", v).alias("message")))
    broken = F.transform(F.filter("entries", lambda e: e["chain_error"].isNotNull()), lambda e: F.struct(F.lit("chain").alias("stage"), F.lit("error").alias("severity"), F.lit(True).alias("counted"), F.format_string("entry %d: %s", e["idx"], e["chain_error"]).alias("message")))
    lost = F.transform(F.filter("entries", lambda e: e["missing"]), lambda e: F.struct(F.lit("file").alias("stage"), F.lit("error").alias("severity"), F.lit(True).alias("counted"), F.format_string("entry %d: Missing sector", e["idx"]).alias("message")))
    soft = F.flatten(F.transform("entries", lambda e: F.transform(F.filter(e["errors"], lambda m: m.startswith("Duplicate") | m.startswith("Overlapping")), lambda m: F.struct(F.lit("entry").alias("stage"), F.lit("note").alias("severity"), F.lit(False).alias("counted"), F.format_string("entry %d: %s", e["idx"], m).alias("message")))))
    usable = F.concat(
        fault(fmt["boot"].isNull(), "boot", "missing boot sector"),
        absent,
        fault(F.col("autorun").isNull(), "autorun", "missing autorun sector"),
        fault(~F.col("has_fat"), "fat", "no usable FAT"),
        fault(F.col("has_fat") & ~F.col("fats_match"), "fat", "FAT copies do not match", counted=False),
        broken, lost, soft,
    )
    fatal = F.array(F.struct(F.lit("disk").alias("stage"), F.lit("fatal").alias("severity"), F.lit(True).alias("counted"), F.col("fatal").alias("message")))
    rows = disks.select("path", "disk_idx", (F.explode_outer if every else F.explode)(F.when(F.col("fatal").isNotNull(), fatal).otherwise(usable)).alias("x"))
    return rows.select("path", "disk_idx", "x.*")


def error_counts(disks: DataFrame, every: bool = False) -> DataFrame:
    """(path, errors): counted faults of a file; a fatal one stands for all of the file's. ``every`` gives files without faults a 0."""
    total = F.sum(F.col("counted").cast("int"))
    return errors(disks, every).groupBy("path").agg(F.when(F.max(F.col("severity") == "fatal"), F.lit(1)).otherwise(F.coalesce(total, F.lit(0)) if every else total).cast("bigint").alias("errors"))


def hexdump(data: Column, charset: Column, plain: Column | None = None) -> Column:
    """Lines of a dump: offset, bytes, glyphs in the character set; ``plain`` adds a second half.

    Bytes and glyphs are written out once for the whole data, then cut into lines.
    """

    def written(source: Column) -> Column:
        return F.struct(F.regexp_replace(F.hex(source), "(..)", " $1").alias("codes"), F.coalesce(glyphs(source, charset), F.lit("")).alias("shown"))

    both = F.struct(F.octet_length(data).alias("size"), written(data).alias("data"), *([] if plain is None else [written(plain).alias("plain")]))

    def lines(own: Column) -> Column:
        size = own["size"]

        def half(source: Column, i: Column) -> Column:
            codes = F.rpad(F.substr(source["codes"], 3 * i + 1, F.lit(48)), 48, " ")
            short = F.greatest(F.lit(0), i + 16 - size)
            tail = F.when(short == 0, "│").otherwise(F.concat(F.lit("╭"), F.repeat(F.lit("─"), short - 1), F.lit("╯")))
            return F.concat(F.substr(codes, F.lit(1), F.lit(24)), F.lit(" "), F.substr(codes, F.lit(25), F.lit(24)), F.lit("  │"), F.substr(source["shown"], i + 1, F.lit(16)), tail)

        def second(text: Column) -> Column:
            return F.when(own["plain"]["codes"].isNotNull(), text).otherwise("")

        def line(i: Column) -> Column:
            first = F.concat(F.lpad(F.hex(i), 6, "0"), F.lit(": "), half(own["data"], i))
            return first if plain is None else F.concat(first, second(F.concat(F.lit(" "), half(own["plain"], i))))

        rest = F.when(size % 16 == 0, 16).otherwise(size % 16)
        frame = F.concat(F.lit("╰"), F.repeat(F.lit("─"), rest), F.lit("╯"))
        end = F.concat(F.lpad(F.hex(size), 6, "0"), F.lit(" " * 53), frame)
        if plain is not None:
            end = F.concat(end, second(F.concat(F.repeat(F.lit(" "), F.lit(16) - rest + 52), frame)))
        body = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1, F.lit(16)), line)).otherwise(F.array().cast("array<string>"))
        return F.concat(body, F.array(end))

    return let(both, lines)


def listing(disks: DataFrame) -> DataFrame:
    """(path, disk_idx, idx, line): the directory as text, attributes and errors sorted."""
    own = disks.where("fatal IS NULL").select("path", "disk_idx", F.col("format.obfuscation").alias("method"), F.col("format.bytes_per_cluster").alias("unit"), F.explode("entries").alias("e"))
    e = F.col("e")
    odd = F.arrays_overlap(e["fattrs"], F.array(*map(F.lit, ("Reserved#1", "Reserved#2", "Reserved#3", DELETED))))
    mark = F.when(F.array_contains(e["fattrs"], "Binary"), "*").when(F.array_contains(e["fattrs"], "Non-ASCII"), ".").otherwise(" ")
    names = F.concat(quoted_if_odd(e["host_fs_name"]), F.when(F.array_contains(e["fattrs"], OBFUSCATED) & F.col("method").isNotNull(), F.concat(F.lit(", "), quoted_if_odd(e["host_fs_deobf_name"]))).otherwise(""))
    wide = F.when(F.length(names) < 40, F.rpad(names, 40, " ")).otherwise(names)
    def shown(a: Column, none: str) -> Column:
        return F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise(none)
    chain = shown(F.transform(e["chain"], lambda c: F.lpad(F.hex(c), 2, "0")), "None")
    line = F.format_string(
        "%3d. %s%s%s%s%s %3d %s %8d ATTRS=%s  START=%02X CHAIN=%s STATUS=%s",
        e["idx"], F.when(odd, "[").otherwise(" "), e["name"], mark, e["ext"], F.when(odd, "]").otherwise(" "),
        F.ceil(e["allocated_size"] / F.col("unit")), wide, F.coalesce(F.octet_length(e["file_data"]), F.lit(0)),
        shown(e["fattrs"], "None"), e["cluster"], F.replace(chain, F.lit(", "), F.lit("→")), shown(e["errors"], "OK"),
    )
    return own.select("path", "disk_idx", e["idx"].alias("idx"), line.alias("line"))


def diagnostics(disks: DataFrame) -> DataFrame:
    """(path, disk_idx, label, value): what was found out about each disk's format."""
    fmt, found = F.col("format"), F.col("found")
    rows = {
        "Detected format name": fmt["name"], "8-bit character set": fmt["charset"], "BASIC obfuscation method": F.coalesce(fmt["obfuscation"], F.lit("None; unable to deobfuscate")),
        "Is side number the cluster LSB": fmt["lsb"], "Is PC66 SYS": fmt["is_pc66_sys"], "Is PC66SR RXR": fmt["is_pc66sr_rxr"], "Is PC98 boot sector": fmt["is_pc98_sys"],
        "D88 track count": found["tracks"], "D88 side count": found["sides"], "D88 highest sector index": found["sectors"], "D88 total sectors": found["total_sectors"], "D88 disk size": found["disk_size"], "Largest D88 sector size": found["largest_sector"],
        "Nominal D88 side count": fmt["sides"], "Nominal D88 disk size": fmt["disk_size"], "Nominal D88 sector size": F.expr("shiftleft(format.sector_size, format.shift)"), "Virtual track count": fmt["tracks"], "Virtual sector size": fmt["sector_size"],
        "Virtual sectors per D88 sector": F.expr("shiftleft(1, format.shift)"), "Virtual sectors per track": fmt["spt"], "Virtual sectors per cluster": fmt["sectors_per_cluster"], "Bytes per cluster": fmt["bytes_per_cluster"], "Bytes per track": fmt["bytes_per_track"],
        "Clusters per track": fmt["cpt"], "Total clusters": fmt["total_clusters"], "First metadata cluster": F.format_string("0x%02X", fmt["first_metadata_cluster"]), "Metadata track": fmt["metadata_track"], "Metadata side": fmt["metadata_side"],
        "Directory virtual sector indices": F.array_join(fmt["dir_vsecs"].cast("array<string>"), ", "), "Autorun data virtual sector index": fmt["autorun_vsec"], "FAT virtual sector indices": F.array_join(fmt["fat_vsecs"].cast("array<string>"), ", "),
        "Metadata clusters": F.array_join(fmt["metadata_clusters"].cast("array<string>"), ", "),
    }
    items = F.array(*[F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in rows.items()])
    return disks.where("fatal IS NULL").select("path", "disk_idx", F.posexplode(items).alias("pos", "x")).select("path", "disk_idx", "pos", "x.*")


def geometry_listing(disks: DataFrame) -> DataFrame:
    """(path, disk_idx, track, side, line): sectors and their sizes by track and side."""
    own = disks.where("fatal IS NULL").select("path", "disk_idx", F.explode("layout").alias("s")).groupBy("path", "disk_idx", F.col("s.track").alias("track"), F.col("s.side").alias("side"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("s.slice_idx"), F.format_string("%2d:%d", F.col("s.sec_num"), F.col("s.size")).alias("t"))))
    return own.agg(parts.alias("p")).select("path", "disk_idx", "track", "side", F.format_string("Track %3d, Side %d: %s", "track", "side", F.array_join(F.transform("p", lambda x: x["t"]), ", ")).alias("line"))


def _autorun() -> Column:
    """struct(attributes, file_count, payload) of the autorun sector."""
    b = byte(F.col("autorun"), 0)
    names = F.array_compact(F.array(*[F.when(b.bitwiseAND(F.lit(1 << k)) != 0, "Read-Only" if k == 4 else f"UnknownAttr:0x{1 << k:02X}") for k in range(8)]))
    count = byte(F.col("autorun"), 1)
    body = F.rtrim(F.regexp_replace(F.decode(F.substring("autorun", 3, 65536), "ISO-8859-1"), "\\x00+\\z", ""))
    payload = decode(F.encode(body, "ISO-8859-1"), F.col("format.charset"))
    return F.struct(F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("None").alias("attributes"), F.when(count != 0xFF, count.cast("string")).otherwise("(ask user)").alias("file_count"), payload.alias("payload"))


def autorun(disks: DataFrame) -> DataFrame:
    """(path, disk_idx, attributes, file_count, payload) of the autorun sector; 0x40 is shown as an unknown attribute."""
    return disks.where("fatal IS NULL AND autorun IS NOT NULL").select("path", "disk_idx", _autorun().alias("a")).select("path", "disk_idx", "a.*")


def _stem() -> Column:
    return F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"(?<=.)\.[^.]*\z", "")


#: File name of a disk's log among what is extracted.
LOG = "_disk_log.txt"


def extraction(disks: DataFrame, with_log: bool = True) -> DataFrame:
    """(dir, name, content) of everything that an extraction writes; narrow but for the error counts and the log."""
    counts = error_counts(disks).withColumnRenamed("errors", "n_errors")
    fmt = F.col("format")

    def item(name: Column, content: Column) -> Column:
        text = F.encode(decode(content, fmt["charset"]), "UTF-8")
        return F.when(content.isNotNull(), F.array(F.struct(name.alias("name"), content.alias("content")), F.struct(dump_name(name).alias("name"), text.alias("content")))).otherwise(F.array().cast("array<struct<name:string,content:binary>>"))

    raw = F.filter("metadata", lambda x: F.array_contains(fmt["dir_vsecs"], x["vsec"]) & ~F.regexp_like(F.hex(x["vdata"]), F.lit("\\A(FF)*\\z")))
    sectors = F.flatten(F.transform(raw, lambda x: item(F.format_string("_dir_sector_%d.dat", x["vsec"]), x["vdata"])))
    fats = F.flatten(F.transform("fats", lambda x: item(F.format_string("_fat_sector_%d.dat", x["vsec"]), x["vdata"])))

    def kept(e: Column) -> Column:
        own = F.when((F.size(e["errors"]) == 0) & ~deleted(e), e["file_data"])
        plain = F.when(F.array_contains(e["fattrs"], OBFUSCATED) & fmt["obfuscation"].isNotNull(), deobfuscate_by(own, fmt["obfuscation"]))
        return F.concat(item(e["host_fs_name"], own), item(e["host_fs_deobf_name"], plain))

    all_items = F.concat(item(F.lit("_boot_sector.dat"), fmt["boot"]), sectors, item(F.lit("_AutoRun.dat"), F.col("autorun")), fats, F.flatten(F.transform("entries", kept)))
    place = F.concat(_stem(), F.lit(" [FAT8 Contents]"), "disk_suffix", F.when(F.coalesce("n_errors", F.lit(0)) > 0, F.format_string(" [Error Count %02d]", "n_errors")).otherwise(""))
    named = disks.where("fatal IS NULL").join(counts, "path", "left")
    out = named.select("path", "disk_idx", place.alias("dir"), F.explode(all_items).alias("x")).select("path", "disk_idx", "dir", "x.name", "x.content")
    if with_log:
        told = log(disks).select("path", "disk_idx", F.encode("log", "UTF-8").alias("content"))
        out = out.unionByName(named.select("path", "disk_idx", place.alias("dir"), F.lit(LOG).alias("name")).join(told, ["path", "disk_idx"]))
    return out


def log_lines(disks: DataFrame) -> DataFrame:
    """(path, disk_idx, section, pos, line): all that is said about a disk, in order of section and pos."""
    fmt, none = F.col("format"), F.array().cast("array<string>")
    frame = F.concat(F.lit("╭"), F.repeat(F.lit("─"), F.lit(16)), F.lit("╮"))

    def dump(title: Column, data: Column, plain: Column | None = None) -> Column:
        return F.concat(F.array(title), hexdump(data, fmt["charset"], plain))

    unused = F.lit("\\A(FF)*\\z")
    boot = F.when(fmt["boot"].isNull(), F.array(F.lit("== No boot sector =="))).otherwise(dump(F.concat(F.lit("== Boot sector (track 0, sector 1) =="), F.repeat(F.lit(" "), F.lit(22)), frame), fmt["boot"]))
    raw = F.flatten(F.transform(fmt["dir_vsecs"], lambda v: F.get(F.concat(
        F.transform(F.filter("metadata", lambda x: x["vsec"] == v), lambda x: F.when(F.regexp_like(F.hex(x["vdata"]), unused), F.array(F.format_string("Directory sector %2d unused: %d 0xFF bytes", v, F.octet_length(x["vdata"])))).otherwise(dump(F.concat(F.format_string("Directory sector %2d", v), F.repeat(F.lit(" "), F.lit(40)), frame), x["vdata"]))),
        F.array(F.array(F.format_string("Missing directory sector %2d", v))),
    ), F.lit(0))))
    auto = F.when(F.col("autorun").isNull(), F.array(F.lit("== No autorun sector =="))).otherwise(F.concat(
        dump(F.concat(F.format_string("== Autorun sector %2d ==", fmt["autorun_vsec"]), F.repeat(F.lit(" "), F.lit(35)), frame), F.col("autorun")),
        F.array(F.concat(F.lit("Disk attributes: "), F.col("a.attributes")), F.concat(F.lit("Number of files: "), F.col("a.file_count")), F.concat(F.lit("Payload: "), F.col("a.payload"))),
    ))

    def content(e: Column) -> Column:
        hidden = F.array_contains(e["fattrs"], OBFUSCATED) & fmt["obfuscation"].isNotNull()
        title = F.concat(F.format_string("%3d. %s.%s %s %8d ", e["idx"], e["name"], e["ext"], F.rpad(quoted_if_odd(e["host_fs_name"]), 27, " "), F.octet_length(e["file_data"])), frame)
        title = F.when(hidden, F.concat(title, F.lit(" "), F.rpad(quoted_if_odd(e["host_fs_deobf_name"]), 50, " "), F.lit(" "), frame)).otherwise(title)
        return F.when((F.size(e["errors"]) == 0) & ~deleted(e) & e["file_data"].isNotNull(), dump(title, e["file_data"], F.when(hidden, deobfuscate_by(e["file_data"], fmt["obfuscation"])))).otherwise(none)

    own = disks.where("fatal IS NULL").select("path", "disk_idx", "format", "metadata", "autorun", "entries", "has_fat", _autorun().alias("a"))
    dumps = F.array(*[F.struct(F.lit(n).alias("section"), x.alias("lines")) for n, x in ((3, boot), (4, raw), (5, auto), (8, F.when(F.col("has_fat"), F.flatten(F.transform("entries", content))).otherwise(none)))])
    shown = own.select("path", "disk_idx", F.explode(dumps).alias("d")).select("path", "disk_idx", F.col("d.section").alias("section"), F.posexplode("d.lines").alias("pos", "line"))
    places = geometry_listing(disks).select("path", "disk_idx", F.lit(1).alias("section"), (F.col("track") * 256 + F.col("side")).alias("pos"), "line")
    found = diagnostics(disks).select("path", "disk_idx", F.lit(2).alias("section"), "pos", F.concat_ws(": ", "label", "value").alias("line"))
    names = listing(disks).select("path", "disk_idx", F.lit(6).alias("section"), F.col("idx").alias("pos"), "line")
    wrong = errors(disks).select("path", "disk_idx", F.lit(7).alias("section"), F.lit(0).alias("pos"), F.concat_ws(": ", "severity", "stage", "message").alias("line"))
    return shown.unionByName(places).unionByName(found).unionByName(names).unionByName(wrong)


def log(disks: DataFrame) -> DataFrame:
    """(path, disk_idx, log): geometry, format, sectors, directory, faults and file dumps as one text for each disk."""
    lines = F.array_sort(F.collect_list(F.struct("section", "pos", "line")))
    return log_lines(disks).groupBy("path", "disk_idx").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("log"))


def exploded(disks: DataFrame) -> DataFrame:
    """(dir, name, content) of a sector-by-sector explosion; ``disks`` have been through geometry()."""
    own = disks.where("fatal IS NULL")
    root = F.concat(_stem(), F.lit(" [D88 Contents]"), "disk_suffix")

    def one(n: Column) -> Column:
        return F.unhex(F.lpad(F.hex(n), 2, "0"))

    head = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in (("diskname.bin", F.expr("rpad(coalesce(disk_name, X''), 16, X'00')")), ("diskprotectionflag.bin", one(F.col("protection_flag"))), ("mediaflag.bin", one(F.col("media_flag"))))])
    top = own.select("path", "disk_idx", root.alias("dir"), F.explode(head).alias("f"))
    s = F.col("s")
    stem = F.format_string("slice%02d_sector%02d", s["slice_idx"], s["sec_num"])
    parts = F.array(F.struct(F.concat(stem, F.lit(".hdr")).alias("name"), F.substring(s["header"], 4, 13).alias("content")), F.struct(F.concat(stem, F.lit(".dat")).alias("name"), s["data"].alias("content")))
    rest = own.select("path", "disk_idx", root.alias("dir"), F.explode("sectors").alias("s")).select("path", "disk_idx", F.concat("dir", F.format_string("/track%02d_side%d", s["track"], s["side"])).alias("dir"), F.explode(parts).alias("f"))
    return top.unionByName(rest).select("path", "disk_idx", "dir", "f.name", "f.content")


def _claimed(root: str, folder: str, run: str) -> str:
    """The folder's name for this run: numbered from 1 where another run has it.

    A claim is made by renaming a folder that holds the run's mark, so tasks that run at once or
    again agree on it.
    """
    import uuid

    number = 0
    while True:
        name = folder + (f" ({number})" if number else "")
        there = os.path.join(root, name)
        if os.path.exists(os.path.join(there, f".{run}")):
            return name
        if not os.path.lexists(there):
            scratch = os.path.join(root, f".{uuid.uuid4().hex}")
            os.makedirs(scratch)
            open(os.path.join(scratch, f".{run}"), "wb").close()
            try:
                os.rename(scratch, there)
                return name
            except OSError:  # another task was first: look again
                os.remove(os.path.join(scratch, f".{run}"))
                os.rmdir(scratch)
                continue
        number += 1


def write_files(rows: DataFrame, root: str) -> None:
    """Writes (dir, name, content) as files below a folder that all executors share.

    A folder that exists already is left alone: the new one has a number behind its name. A name
    can't leave its folder; a file is put in place by renaming, so a task that runs again writes the
    same files over.
    """
    import uuid

    run = f"run-{uuid.uuid4().hex}"

    def put(part) -> None:
        names: dict[str, str] = {}
        for row in part:
            first, *rest = [p for p in row["dir"].split("/") if p not in ("", ".", "..")] or ["_"]
            if first not in names:
                os.makedirs(root, exist_ok=True)
                names[first] = _claimed(root, first, run)
            folder = os.path.join(root, names[first], *rest)
            os.makedirs(folder, exist_ok=True)
            name = row["name"].replace("/", "%2F").replace("\0", "%00")
            scratch = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(scratch, "wb") as f:
                f.write(row["content"] or b"")
            os.replace(scratch, os.path.join(folder, name))

    rows.select("dir", "name", "content").foreachPartition(put)
    for name in os.listdir(root) if os.path.isdir(root) else ():
        mark = os.path.join(root, name, f".{run}")
        if os.path.exists(mark):
            os.remove(mark)
