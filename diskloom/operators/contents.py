"""Directory, allocation and files of each disk, in one narrow stage over its row.

Names depend on every name before them, chains on every link before them, and owners of clusters
on the order of the directory, so a disk is worked through in order by an Arrow-fed function. A
batch holds few disks; nothing is shuffled. Faults are data: they stand in the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.charset import decode_bytes, encode_char
from ..functions.names import ATTRIBUTES, BINARY, DELETED, NON_ASCII, OBFUSCATED, RESERVED, UNSAFE
from ..sources import d88
from .disks import END, FINAL, FREE, formats, geometry

ENTRY_DDL = "struct<idx:int,raw_entry:binary,name:string,ext:string,fattrs:array<string>,cluster:int,chain:array<int>,errors:array<string>,chain_error:string,missing:boolean,allocated_size:bigint,host_fs_name:string,host_fs_deobf_name:string,file_data:binary>"
_ENTRY = pa.struct([("idx", pa.int32()), ("raw_entry", pa.binary()), ("name", pa.string()), ("ext", pa.string()), ("fattrs", pa.list_(pa.string())), ("cluster", pa.int32()), ("chain", pa.list_(pa.int32())), ("errors", pa.list_(pa.string())), ("chain_error", pa.string()), ("missing", pa.bool_()), ("allocated_size", pa.int64()), ("host_fs_name", pa.string()), ("host_fs_deobf_name", pa.string()), ("file_data", pa.binary())])
_PIECE = pa.struct([("vsec", pa.int32()), ("vdata", pa.binary())])
_ADDED = {"fatal": (pa.string(), "string"), "metadata": (pa.list_(_PIECE), "array<struct<vsec:int,vdata:binary>>"), "fats": (pa.list_(_PIECE), "array<struct<vsec:int,vdata:binary>>"), "autorun": (pa.binary(), "binary"), "has_fat": (pa.bool_(), "boolean"), "fats_match": (pa.bool_(), "boolean"), "entries": (pa.list_(_ENTRY), f"array<{ENTRY_DDL}>")}
_TAGS = [(ATTRIBUTES[0x200], "---"), (ATTRIBUTES[0x40], "vfy"), *((ATTRIBUTES[2 << k], f"r-{k + 1}") for k in range(3)), (ATTRIBUTES[0x10], "r-o")]


def host_name(name: str, ext: str, attrs: set[str], charset: str) -> str:
    """names.host_name() for one entry."""
    base, tail = name.rstrip(" "), ext.rstrip(" ")
    full = base + "." * bool(tail) + tail
    reserved = full.upper() in RESERVED
    parts = []
    for k, c in enumerate(full):
        odd = c in UNSAFE or c == "%" or c < " " or "\ue000" <= c <= "\uf8ff" or reserved
        odd |= c == "." and k != len(base) or k == 0 and (c == " " or not full.strip(".")) or k == len(full) - 1 and c in " ."
        parts.append("".join(f"%{b:02X}" for b in encode_char(c, charset) or b"") if odd else c)
    host = "".join(parts)
    if host[:1] in ("", "."):
        host = "(empty)" + host
    kind = host.partition(".")[2].replace(".", "").lower()
    tags = [tag for attr, tag in _TAGS if attr in attrs]
    tags += ["bas"] if NON_ASCII in attrs and kind not in ("hd", "nip", "n88", "bas") else []
    tags += ["bin"] if BINARY in attrs and kind not in ("cod", "bin") else []
    tags += ["asc"] if not attrs & {NON_ASCII, BINARY} and kind not in ("txt", "asc") else []
    tags += ["era"] * (DELETED in attrs) + ["obf"] * (OBFUSCATED in attrs)
    return host + ("." if "." in host else "..") + ".".join(tags) if tags else host


def unused_name(name: str, used: set[str]) -> str:
    """The name, numbered from 2 before its first dot where it is taken."""
    head, dot, tail = name.partition(".")
    out, n = name, 2
    while out.lower() in used:
        out, n = f"{head} ({n}){dot}{tail}", n + 1
    return out


def taken(sectors: pa.StructArray) -> dict[str, list]:
    """What the work on a disk needs of its sectors, by column: a dictionary for each sector would cost most of the time."""
    data = sectors.field("data").cast(pa.binary())
    ends = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1].tolist() if len(data) else [0]
    raw = memoryview(data.buffers()[2] or b"")
    return {n: sectors.field(n).to_numpy().tolist() for n in ("track", "side", "sec_num")} | {"data": [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]}


def virtual(sectors: dict[str, list], form: dict) -> dict[tuple[int, int, int], bytes]:
    """Pieces of physical sectors, numbered through each track, by (track, side, number)."""
    many, size = 1 << form["shift"], form["sector_size"]
    return {(track, side, (n - 1) * many + 1 + j): data[j * size : (j + 1) * size] for track, side, n, data in zip(*sectors.values()) for j in range(many)}


def read_directory(pieces: list[dict], form: dict) -> list[dict]:
    """Entries in order up to the first unused one, with names for the host."""
    out: list[dict] = []
    used: set[str] = set()
    for piece in pieces:
        if piece["vsec"] not in form["dir_vsecs"]:
            continue
        for k in range(16):
            raw = piece["vdata"][16 * k : 16 * k + 16]
            if raw[:1] == b"\xff":
                return out
            if len(raw) < 11:
                raise d88.Malformed("a directory sector is shorter than its entries")
            mask = raw[9] | (0x100 if raw[0] == 0 else 0)
            attrs = {name for bit, name in ATTRIBUTES.items() if mask & bit}
            name, ext = (decode_bytes(x, form["charset"], "none") for x in (raw[:6], raw[6:9]))
            host = unused_name(host_name(name, ext, attrs, form["charset"]), used)
            plain = unused_name(host_name(name, ext, attrs - {OBFUSCATED}, form["charset"]), used) if OBFUSCATED in attrs else host
            used.add(host.lower())
            if OBFUSCATED in attrs and form["obfuscation"]:
                used.add(plain.lower())
            out.append({"idx": (piece["vsec"] - 1) * 16 + k + 1, "raw_entry": raw, "name": name, "ext": ext, "fattrs": sorted(attrs), "cluster": raw[10], "chain": [], "errors": [], "chain_error": None, "missing": False, "allocated_size": 0, "host_fs_name": host, "host_fs_deobf_name": plain, "file_data": None})
    return out


def usable(fat: bytes, form: dict) -> bool:
    """Whether a table reserves boot and metadata clusters and has plausible links only."""
    total, meta = form["total_clusters"], set(form["metadata_clusters"])
    if len(fat) < max(total, max(meta) + 1):
        raise d88.Malformed("the FAT is shorter than its clusters")
    counts = set(range(FINAL, FINAL + form["sectors_per_cluster"] + 1))
    inside = set(range(total))
    return fat[0] in {END} | inside | counts and all(fat[c] in {END} | meta | counts for c in meta) and set(fat[:total]) <= inside | counts | {END, FREE}


def follow(fat: bytes, head: int, total: int, spc: int) -> tuple[list[int], str | None]:
    """The chain from a head with the link that ends it, and what is wrong with it."""
    chain = [head]
    if head >= FINAL and head not in (END, FREE):
        return chain, "Head of chain cannot be a block count"
    if total <= head < FINAL:
        return chain, "Head of chain falls outside of disk"
    while chain[-1] < FINAL:
        link = fat[chain[-1]]
        wrong = None if link >= FINAL else "Chain entry falls outside of disk" if link >= total else "Cycle in FAT chain" if link in chain else None
        chain.append(link)
        if wrong:
            return chain, wrong
    if FREE in chain:
        return chain, "Unallocated cluster in FAT chain"
    if chain[-1] > FINAL + spc and chain[-1] != END:
        return chain, "Sector count for final cluster exceeds sectors-per-cluster limit"
    return chain, None


def allocate(entries: list[dict], fat: bytes | None, form: dict) -> None:
    """Adds chains, errors and sizes; of several entries on a cluster the first one in order owns it."""
    first: dict[str, dict] = {}
    owners: dict[int, bytes] = {}
    spc, unit, sector = form["sectors_per_cluster"], form["bytes_per_cluster"], form["sector_size"]
    for e in entries:
        gone = DELETED in e["fattrs"]
        twin = None if gone else first.setdefault(e["name"] + "." + e["ext"], e)
        if twin is not None and twin is not e:
            for x in (e, twin) if twin["raw_entry"] != e["raw_entry"] else (e,):
                if "Duplicate filename" not in x["errors"]:
                    x["errors"].append("Duplicate filename")
        if fat is None:
            e["chain_error"] = "No FAT"
        elif not gone:
            e["chain"], e["chain_error"] = follow(fat, e["cluster"], form["total_clusters"], spc)
        if e["chain_error"]:
            e["errors"].append(e["chain_error"])
        elif e["chain"]:
            key, clean = e["raw_entry"][9:11], True
            for c in e["chain"][:-1]:
                if owners.setdefault(c, key) != key:
                    e["errors"].append(f"Overlapping allocation {c:02X}")
                    clean = False
            last = e["chain"][-1]
            if clean:
                e["allocated_size"] = unit * (len(e["chain"]) - 1) + (sector * (last - FINAL) - unit if FINAL <= last < END else 0)


def place(cluster: int, form: dict) -> tuple[int, int, int]:
    """Track, side and first sector of a cluster."""
    cpt, sides, step = form["cpt"], form["sides"], form["spt"] // form["cpt"]
    if form["lsb"]:
        row, side = divmod(cluster, sides)
        return row // cpt, side, 1 + row % cpt * step
    row, part = divmod(cluster, cpt)
    return row // sides, row % sides, 1 + part * step


def load(entries: list[dict], pieces: dict[tuple[int, int, int], bytes], form: dict) -> None:
    """Adds the bytes of readable entries; only the last sector of a final cluster loses its end mark."""
    for e in entries:
        if e["errors"] or DELETED in e["fattrs"] or not e["chain"]:
            continue
        last, blocks = e["chain"][-1], []
        for k, c in enumerate(e["chain"][:-1]):
            track, side, start = place(c, form)
            many = last - FINAL if k == len(e["chain"]) - 2 and FINAL <= last < END else form["sectors_per_cluster"]
            blocks += [pieces.get((track, side, start + n)) for n in range(many)]
        if None in blocks:
            e["errors"], e["missing"] = ["Missing sector"], True
            continue
        if blocks and last != FINAL:
            stripped = blocks[-1].rstrip(b"\0")
            blocks[-1] = stripped[:-1] if stripped.endswith(b"\x1a") else blocks[-1]
        e["file_data"] = b"".join(blocks)


def work(fatal: str | None, form: dict | None, sectors: dict[str, list]) -> dict:
    """What _ADDED names, for a disk with its format."""
    out: dict = {"fatal": fatal}
    if form is None:
        return out
    try:
        pieces = virtual(sectors, form)
        here = (form["metadata_track"], form["metadata_side"])
        metadata = [{"vsec": key[2], "vdata": pieces[key]} for key in sorted(k for k in pieces if k[:2] == here)]
        fats = [p for p in metadata if p["vsec"] in form["fat_vsecs"]]
        out["metadata"] = metadata
        out["fats"] = fats
        out["autorun"] = next((p["vdata"] for p in metadata if p["vsec"] == form["autorun_vsec"]), None)
        entries = read_directory(metadata, form)
        fat = fats[0]["vdata"] if fats and usable(fats[0]["vdata"], form) else None
        out["has_fat"] = fat is not None
        out["fats_match"] = len({p["vdata"][1 : form["total_clusters"]] for p in fats}) <= 1
        allocate(entries, fat, form)
        load(entries, pieces, form)
        for e in entries:
            e["errors"].sort()
        out["entries"] = entries
    except d88.Malformed as why:
        return {"fatal": str(why)}
    return out


def contents(disks: DataFrame) -> DataFrame:
    """Disks with formats: their directory, allocation and files, and the layout in place of the sectors."""
    kept = ["path", "disk_idx", "disk_name", "disk_attrs", "media_flag", "protection_flag", "disk_sz", "track_offsets", "disk_suffix", "found", "format", "layout"]
    layout = F.transform("sectors", lambda s: F.struct(*[s[k].alias(k) for k in ("table_pos", "track", "side", "slice_idx", "sec_num", "sectors_in_track", "data_offset")], F.octet_length(s["data"]).alias("size")))
    df = disks.withColumn("layout", layout).select(*kept, "fatal", "sectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                sectors = one.column("sectors")[0].values if one.column("sectors")[0].is_valid else pa.array([], d88.SECTOR)
                made = work(one.column("fatal")[0].as_py(), one.column("format")[0].as_py(), taken(sectors))
                yield pa.RecordBatch.from_arrays([*(one.column(n) for n in kept), *(pa.array([made.get(n)], kind) for n, (kind, _) in _ADDED.items())], names=[*kept, *_ADDED])

    given = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in kept)
    return df.mapInArrow(run, given + ", " + ", ".join(f"{n} {ddl}" for n, (_, ddl) in _ADDED.items()))


def analyzed(disks: DataFrame) -> DataFrame:
    """All steps over scanned disks."""
    return contents(formats(geometry(disks)))
