"""MinHash near-duplicate removal with an LSH forest.

A document's set is its word 3-grams, without regard to case and punctuation. ``HASHES`` minimum
hashes make its signature. Each of ``TREES`` orders sorts the documents by its own ``DEPTH`` of
these values, so that neighbours in an order have the longest common prefixes. Documents with
``FLOOR`` values in common at the front of an order form a region. Regions up to a block are
compared all to all; longer ones are cut at deeper prefixes until they fit, each leaf is linked
by a spanning tree, and neighbours across leaves are compared. A pair counts if its signatures
agree as often as a Jaccard similarity of ``THRESHOLD`` does; groups are the connected components.

The orders are range-partitioned on the whole sort key, so a dense region spreads over tasks; where a
region goes on in the next task, the rows on both sides of the cut are compared in a second step.
Documents with the same text are folded into one before that, with map-side aggregation.

Defined results: null and blank texts are in no group; texts without words are grouped with their
exact copies only; texts of fewer than three words are one gram; very long texts are read whole; the
kept document of a group has the lowest id, null ids last, then the earlier row; repeated rows are
copies like any other; equal agreement goes to the lower row, which changes no group; other columns,
whatever their names, pass through untouched; an empty table gives an empty result. Row numbers are
made here and are not taken from a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import chunks, digest, list_array, mix64, words, written

HASHES, TREES, DEPTH, FLOOR = 128, 14, 8, 3
GRAM = 3
THRESHOLD = 0.6
_SEEDS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word gram; a text of one or two words has one."""
    row, h = words(texts)
    if not len(row):
        return row, h
    count = np.bincount(row, minlength=len(texts))
    k = np.uint64(0x9FB21C651E98DF25)
    full = h.copy()
    same1 = np.zeros(len(h), bool)
    same2 = np.zeros(len(h), bool)
    same1[:-1] = row[1:] == row[:-1]
    same2[:-2] = row[2:] == row[:-2]
    full[:-1] = np.where(same1[:-1], (full[:-1] * k) ^ h[1:], full[:-1])
    full[:-2] = np.where(same2[:-2], (full[:-2] * k) ^ h[2:], full[:-2])
    first = np.concatenate([[True], row[1:] != row[:-1]])
    keep = same2 | (first & (count[row] < GRAM))
    return row[keep], mix64(full[keep])


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows with words, their minimum hashes as a matrix of HASHES columns)."""
    row, h = grams(texts)
    if not len(row):
        return row, np.zeros((0, HASHES), np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out = np.empty((len(starts), HASHES), dtype=np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((h * _SEEDS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return row[starts], out


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each tree: the region (its first FLOOR values) and the packed rest, as int64."""
    n = len(values)
    own = values[:, : TREES * DEPTH].reshape(n, TREES, DEPTH).astype(np.uint64)
    region = np.zeros((n, TREES), np.uint64)
    for k in range(FLOOR):
        region = mix64(region ^ own[:, :, k] + np.uint64(0x9E3779B97F4A7C15))
    rest = np.zeros((n, TREES), np.uint64)
    for k in range(FLOOR, DEPTH):
        rest = rest << np.uint64(12) | (mix64(own[:, :, k]) & np.uint64(4095))
    return region.view(np.int64), rest.view(np.int64)


def least_agreement(threshold: float) -> int:
    """Equal bytes among HASHES that a similarity of ``threshold`` gives on average."""
    return int(np.ceil(HASHES * (threshold + (1 - threshold) / 256)))


def sign(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, region, rest, sketch) of (row, doc_id, text); without words the last three are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            n = part.num_rows
            rows, values = signatures(part.column("text"))
            region, rest = keys_of(values)
            where = np.full(n, -1, dtype=np.int64)
            where[rows] = np.arange(len(rows))
            take = pa.array(where, pa.int64(), mask=where < 0)
            lists = [list_array(pa.array(x.ravel()), np.full(len(rows), TREES)) for x in (region, rest)]
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), len(rows), [None, pa.py_buffer(np.ascontiguousarray(values.astype(np.uint8)).tobytes())]).cast(pa.binary())
            yield pa.record_batch({"row": part.column("row"), "doc_id": part.column("doc_id"), "digest": part.column("digest"), "region": lists[0].take(take), "rest": lists[1].take(take), "sketch": sketch.take(take)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.where(F.length(F.trim("text")) > 0).select("row", "doc_id", digest("text").alias("digest"), "text")
    return held.mapInArrow(run, f"row long, doc_id {kind}, digest binary, region array<long>, rest array<long>, sketch binary")


def forest_edges(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) row pairs of near duplicates among (row, region, rest, sketch)."""
    least = least_agreement(threshold)
    half = graph.BLOCK // 2

    def linked(table: pa.Table) -> pa.RecordBatch | None:
        region = table.column("region").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        size = np.diff(np.append(starts, len(region)))
        several = np.repeat(size > 1, size)  # rows alone in their region have no candidates
        if not several.any():
            return None
        table = table.filter(pa.array(several))
        size = size[size > 1]
        rest = table.column("rest").to_numpy().view(np.uint64)
        keys = [(rest >> np.uint64(12 * k) & np.uint64(4095)) for k in range(DEPTH - FLOOR - 1, -1, -1)]
        raw = table.column("sketch").combine_chunks()
        sketches = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).reshape(len(raw), HASHES)
        nodes = table.column("row").to_numpy()
        a, b = graph.link(keys, sketches, nodes, np.cumsum(size) - size, least)
        return pa.record_batch({"a": pa.array(np.minimum(nodes[a], nodes[b])), "b": pa.array(np.maximum(nodes[a], nodes[b]))})

    def ends(table: pa.Table, last: bool) -> pa.Table:
        """The rows of the table's last or first region that are next to the partition's end."""
        own = table.column("region").to_numpy()
        if last:
            first = int(np.flatnonzero(own == own[-1])[0])
            return table.slice(max(first, len(own) - half))
        return table.slice(0, min(half, int(np.count_nonzero(own == own[0]))))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        names = ["a", "b", "region", "rest", "row", "sketch"]

        def side(rows: pa.Table) -> pa.RecordBatch:
            none = pa.nulls(rows.num_rows, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *(rows.column(c).combine_chunks() for c in names[2:])], names=names)

        for now in graph.by_region(batches, "region"):
            if table is None:
                yield side(ends(now, False))
            table = now
            if (found := linked(now)) is not None:
                none = pa.nulls(found.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*found.columns, none, none, none, pa.nulls(found.num_rows, pa.binary())], names=names)
        if table is not None:
            yield side(ends(table, True))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "region"):
            if (found := linked(table)) is not None:
                yield found

    entries = reps.select("row", "sketch", F.posexplode(F.arrays_zip("region", "rest")).alias("tree", "k")).select(F.xxhash64("k.region", "tree").alias("region"), F.col("k.rest").alias("rest"), "row", "sketch")
    ordered = entries.repartitionByRange("region", "rest", "row").sortWithinPartitions("region", "rest", "row")
    found = written(ordered.mapInArrow(within, "a long, b long, region long, rest long, row long, sketch binary"))
    cut = found.where("region IS NOT NULL").select("region", "rest", "row", "sketch").distinct()  # BLOCK rows a partition at most
    beside = cut.repartition("region").sortWithinPartitions("region", "rest", "row").mapInArrow(across, "a long, b long")
    return found.where("a IS NOT NULL").select("a", "b").unionByName(beside).distinct()


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text) with a number for each row."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, kept_row, duplicate_of) of each document of (row, doc_id, text) that a kept one stands for."""
    signed = written(sign(rows))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    folded = signed.groupBy("digest").agg(F.min(first).alias("head"), F.first("region").alias("region"), F.first("rest").alias("rest"), F.first("sketch").alias("sketch"))
    reps = written(folded.select("digest", F.col("head.row").alias("row"), F.col("head.doc_id").alias("doc_id"), "region", "rest", "sketch"))
    roots = graph.components(forest_edges(reps.where("sketch IS NOT NULL"), threshold))
    placed = reps.select("digest", "row", "doc_id").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    best = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("best"))
    heads = placed.join(best, "root").select("digest", F.col("best.row").alias("kept_row"), F.col("best.doc_id").alias("duplicate_of"))
    return signed.select("row", "doc_id", "digest").join(heads, "digest").where("row <> kept_row").select("row", "doc_id", "kept_row", "duplicate_of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): each document that goes, and the kept one of its group."""
    return duplicates(numbered(docs, id_col, text_col), threshold).select("doc_id", "duplicate_of")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole and with all their columns, whatever these are called, but for those that a kept one stands for."""
    number = "row"
    while number in {c.lower() for c in docs.columns}:
        number += "_"
    held = written(docs.withColumn(number, F.monotonically_increasing_id()))  # row numbers must outlive a lost executor
    gone = duplicates(held.select(F.col(number).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), threshold)
    return held.join(gone.select(F.col("row").alias(number)), number, "left_anti").drop(number)
