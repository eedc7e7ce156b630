"""Disk-image files as a table: one row for each disk, with its sectors as a nested array.

The byte walk, whose next step depends on the bytes before, is the one Python boundary; it runs
on each file where it is read and shuffles nothing. Everything after it is column expressions
over the row of a disk, so no payload is ever exchanged. A malformed image gives a row with
``fatal`` set, never a failed job; disks behind it in its file are not looked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTOR = pa.struct([("table_pos", pa.int32()), ("track", pa.int32()), ("side", pa.int32()), ("slice_idx", pa.int32()), ("sec_num", pa.int32()), ("sectors_in_track", pa.int32()), ("data_offset", pa.int64()), ("header", pa.binary()), ("data", pa.binary())])
SECTOR_DDL = "struct<table_pos:int,track:int,side:int,slice_idx:int,sec_num:int,sectors_in_track:int,data_offset:bigint,header:binary,data:binary>"
DISK_DDL = f"path string, disk_idx int, disk_name binary, disk_attrs array<string>, media_flag int, protection_flag int, disk_sz bigint, track_offsets array<bigint>, disk_suffix string, fatal string, sectors array<{SECTOR_DDL}>"
_SCHEMA = pa.schema([("path", pa.string()), ("disk_idx", pa.int32()), ("disk_name", pa.binary()), ("disk_attrs", pa.list_(pa.string())), ("media_flag", pa.int32()), ("protection_flag", pa.int32()), ("disk_sz", pa.int64()), ("track_offsets", pa.list_(pa.int64())), ("disk_suffix", pa.string()), ("fatal", pa.string()), ("sectors", pa.list_(SECTOR))])
TABLE, ENTRY, HEADER = 0x20, 4, 16
#: Size codes above this would pass the end of any image, and shift out of an integer.
LARGEST_CODE = 24
#: Rows that a task builds images from; some 64 disks of 128 files.
ROWS_A_TASK = 8192


class Malformed(ValueError):
    """Why an image can't be read."""


def _u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def read_header(data: bytes) -> dict:
    """Fields of a disk's header and its track table."""
    if len(data) < TABLE:
        raise Malformed("not enough data for a disk header")
    size = _u32(data, 0x1C)
    if size > len(data):
        raise Malformed("the disk size field is too large")
    if size <= TABLE + ENTRY:
        raise Malformed("the disk size field is too small")
    tracks: list[int] = []
    at = TABLE
    while not tracks or at < min(tracks):
        offset = _u32(data, at)
        if at == TABLE and offset % ENTRY:
            raise Malformed(f"offset of first track must be a multiple of {ENTRY}")
        if offset not in (0, size):
            tracks.append(offset)
            if offset + HEADER >= size:
                raise Malformed("track data spills over past the end")
        elif not tracks:
            raise Malformed("the first entry of the track table is empty")
        at += ENTRY
    return {"disk_name": bytes(data[:16]).rstrip(b"\0") or None, "disk_attrs": ["DiskWriteProtected"] if data[0x1A] & 0x10 else [], "protection_flag": data[0x1A], "media_flag": data[0x1B], "disk_sz": size, "track_offsets": tracks}


def _starts(data: bytes, size: int, tracks: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(place in the table, number in its walk, begin, end) of each sector's data; a walk ends where cylinder or head changes."""
    for position, at in enumerate(tracks):
        place, number = data[at : at + 2], 0
        while at + HEADER <= size and data[at : at + 2] == place:
            begin = at + HEADER
            at = begin + (128 << min(data[begin - 13], LARGEST_CODE))
            if at > size:
                raise Malformed("sector data spilled off the end")
            yield position, number, begin, at
            number += 1


def walk(data: bytes, size: int, tracks: list[int]) -> list[dict]:
    """Sectors in the order of the track table."""
    out: list[dict] = []
    for position, number, begin, end in _starts(data, size, tracks):
        header = bytes(data[begin - HEADER : begin])
        out.append({"table_pos": position, "track": header[0], "side": header[1], "slice_idx": number, "sec_num": header[2], "sectors_in_track": header[4] | header[5] << 8, "data_offset": begin, "header": header, "data": bytes(data[begin:end])})
    return out


def walk_columns(data: bytes, size: int, tracks: list[int]) -> pa.StructArray:
    """walk() put together by column: a dictionary for each sector would cost most of the time."""
    places = np.array(list(_starts(bytes(data[:size]), size, tracks)), dtype=np.int64).reshape(-1, 4)
    position, number, begin, end = places.T
    header = np.frombuffer(data, dtype=np.uint8)[begin[:, None] + np.arange(-HEADER, 0)]
    head = header.astype(np.int32)

    def binary(ends: np.ndarray, content: bytes) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(content)])

    columns = {
        "table_pos": position, "track": head[:, 0], "side": head[:, 1], "slice_idx": number, "sec_num": head[:, 2], "sectors_in_track": head[:, 4] | head[:, 5] << 8, "data_offset": begin,
        "header": binary(np.arange(1, len(places) + 1) * HEADER, header.tobytes()), "data": binary(np.cumsum(end - begin), b"".join(data[a:b] for a, b in zip(begin.tolist(), end.tolist()))),
    }
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(field.type.to_pandas_dtype())) for c, field in zip(columns.values(), SECTOR)], fields=list(SECTOR))


def disks_of(path: str | None, content: bytes | None, walk: Callable = walk) -> Iterator[dict]:
    """A row for each disk of a file, up to the first that can't be read."""
    left, number = memoryview(content or b""), 1  # a view: what is behind a disk is not copied
    while left or number == 1:
        row: dict = {"path": path, "disk_idx": number}
        try:
            row |= read_header(left)
            row["disk_suffix"] = "" if number == 1 and len(left) == row["disk_sz"] else f" [Disk {number:02}]"
            row["sectors"] = walk(left, row["disk_sz"], row["track_offsets"])
        except Malformed as why:
            yield row | {"fatal": str(why), "sectors": []}
            return
        yield row
        left, number = left[row["disk_sz"] :], number + 1


def batches_of(path: str | None, content: bytes | None) -> Iterator[pa.RecordBatch]:
    """disks_of() as batches of one row, whose sectors are put together by column."""
    for row in disks_of(path, content, walk_columns):
        flat = row["sectors"] if len(row["sectors"]) else pa.array([], pa.struct(list(SECTOR)))
        sectors = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([*(pa.array([row.get(field.name)], field.type) for field in _SCHEMA if field.name != "sectors"), sectors], schema=_SCHEMA)


def scan(images: DataFrame) -> DataFrame:
    """Disks of (path, content); a narrow stage that emits a disk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from batches_of(path.as_py(), content.as_py())

    return images.select("path", "content").mapInArrow(run, DISK_DDL)


def scan_made(rows: DataFrame, make: Callable[[pa.Table], tuple[str, bytes]], parts: int | None = None) -> DataFrame:
    """Disks of the images that ``make`` builds from the rows of each ``key``.

    An image is walked by the worker that builds it, so it never passes through the JVM. Without
    ``parts`` a task has about ROWS_A_TASK rows however many there are, so that a batch of disks,
    which is cut by records before bytes, stays small.
    """

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(batches_of(*make(table)), schema=_SCHEMA)

    many = parts or max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))  # rows are small but images are not: no coalescing here
    return rows.repartition(many, "key").groupBy("key").applyInArrow(run, DISK_DDL)


def images(spark: SparkSession, path: str, glob: str = "*.[dD]88") -> DataFrame:
    """(path, modificationTime, length, content) of image files; filters on length and path reach the scan."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read(spark: SparkSession, path: str, glob: str = "*.[dD]88") -> DataFrame:
    return scan(images(spark, path, glob))


def sectors(disks: DataFrame) -> DataFrame:
    """One row for each sector."""
    return disks.select("path", "disk_idx", F.explode("sectors").alias("s")).select("path", "disk_idx", "s.*")


def unwrapped_bload(data: Column) -> Column:
    """struct(start, payload, error) of a BLOAD file: two little-endian addresses, then the bytes between them."""
    def u16(at: int) -> Column:
        return F.conv(F.hex(F.concat(F.substring(data, at + 1, 1), F.substring(data, at, 1))), 16, 10).cast("int")

    start, stop, size = u16(1), u16(3), F.octet_length(data)
    need = stop - start
    tail = F.substring(data, 5 + need, size)
    error = (
        F.when(data.isNull(), "no data")
        .when(size < 4, "not enough data for BLOAD header")
        .when(stop < start, "BLOAD header is not correct")
        .when(start < 0x1E0, "data cannot overwrite the decoder")
        .when(size - 4 - need > 512, "extra sectors found at end of BLOAD data")
        .when((size - 4 > need) & (F.substring(tail, 1, 1) != F.lit(bytearray(b"\x1a"))), "extra bytes must begin with the end-of-file mark")
        .when((size - 4 > need) & (size % 256 != 0), "padded length must be a multiple of 256")
    )
    return F.struct(F.when(size >= 4, start).alias("start"), F.when(error.isNull(), F.substring(data, 5, F.greatest(need, F.lit(0)))).alias("payload"), error.alias("error"))


def wrapped_bload(data: Column, start: int = 0x1000) -> Column:
    """BLOAD file of the bytes; null where they pass the end of memory."""
    def u16(value: Column) -> Column:
        text = F.lpad(F.hex(value), 4, "0")
        return F.unhex(F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2)))

    stop = F.lit(start) + F.octet_length(data)
    return F.when(stop <= 0xFFFF, F.concat(u16(F.lit(start)), u16(stop), data))
