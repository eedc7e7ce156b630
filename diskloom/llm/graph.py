"""Linkage of similar rows inside a bucket, and connected components over the edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Rows that are linked with each other all to all; longer runs are cut by depth, then into half-overlapping windows.
BLOCK = 256


def spanning(sketches: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum spanning tree of the rows by agreeing sketch columns: (from, to, agreement).

    It has the single-linkage groups at every threshold, so leaving out its weak edges loses no
    group that all pairs would give. Ties go to the smaller node.
    """
    order = np.argsort(nodes, kind="stable")
    sketches, n = sketches[order], len(order)
    best = np.full(n, -1, dtype=np.int64)
    parent = np.zeros(n, dtype=np.int64)
    out_a, out_b, out_s = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64)
    todo = np.ones(n, dtype=bool)
    todo[0], at = False, 0
    for k in range(n - 1):
        agree = np.count_nonzero(sketches == sketches[at], axis=1)
        closer = todo & (agree > best)
        best[closer], parent[closer] = agree[closer], at
        at = int(np.argmax(np.where(todo, best, -2)))
        out_a[k], out_b[k], out_s[k] = order[parent[at]], order[at], best[at]
        todo[at] = False
    return out_a, out_b, out_s


def runs(keys: list[np.ndarray], start: int, end: int, depth: int) -> list[tuple[int, int]]:
    """Leaves of sorted rows start..end: cut at the next key column while longer than BLOCK."""
    if end - start <= BLOCK or depth == len(keys):
        return [(start, end)]
    own = keys[depth][start:end]
    cuts = [start, *(np.flatnonzero(own[1:] != own[:-1]) + start + 1), end]
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        found = runs(keys, int(a), int(b), depth + 1)
        if out and len(found) == 1 and out[-1][1] - out[-1][0] + b - a <= BLOCK:
            out[-1] = (out[-1][0], int(b))  # neighbours in the order share a leaf while they fit
        else:
            out += found
    return out


def link(keys: list[np.ndarray], sketches: np.ndarray, nodes: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows of one region whose sketches agree in ``least`` columns.

    Rows are sorted by ``keys``; ``starts`` are the regions' first rows. Regions of two are
    compared in one step; larger ones are cut into leaves by adaptive depth, linked by a
    spanning tree each, and joined to the next leaf by their closest rows in the order.
    """
    ends = np.append(starts[1:], len(nodes))
    size = ends - starts
    two = starts[size == 2]
    a, b = [two], [two + 1]
    for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
        leaves = runs(keys, s, e, 0)
        for x, y in leaves:
            at = x
            while True:
                to = min(at + BLOCK, y)
                if to - at > 1:
                    p, q, score = spanning(sketches[at:to], nodes[at:to])
                    near = score >= least
                    a.append(p[near] + at)
                    b.append(q[near] + at)
                if to == y:
                    break
                at += BLOCK // 2
        inner = np.array([y for _, y in leaves[:-1]], dtype=np.int64)
        a.append(inner - 1)
        b.append(inner)
    left, right = np.concatenate(a), np.concatenate(b)
    if len(left):
        near = np.count_nonzero(sketches[left] == sketches[right], axis=1) >= least
        near &= nodes[left] != nodes[right]
        left, right = left[near], right[near]
    return left, right


def by_region(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that no run of equal ``column`` values is divided."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch)
        own = table.column(column).combine_chunks().to_numpy(zero_copy_only=False)
        other = np.flatnonzero(own != own[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if held:
            before = held[-1].column(column)[held[-1].num_rows - 1].as_py()
            if before == own[-1] and last == 0:
                held.append(table)
                continue
            yield pa.concat_tables([*held, table.slice(0, last)]).combine_chunks()
            held = []
        elif last:
            yield table.slice(0, last).combine_chunks()
        held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after those of each pair (a, b) have become one, the smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    known = np.array(sorted(root), dtype=np.int64)
    if not len(known):
        return labels
    to = np.array([find(x) for x in known.tolist()], dtype=np.int64)
    at = np.minimum(np.searchsorted(known, labels), len(known) - 1)
    return np.where(known[at] == labels, to[at], labels)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long); root is the component's smallest node.

    Large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder,
    until nothing changes; the number of rounds grows with the logarithm of the longest chain.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        marked = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = marked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = written(small)
        found = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        now = nxt
        if tuple(found) == state:
            break
        state = tuple(found)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
