"""Vector bin packing of instruction examples by the dot-product heuristic.

A pack has three limits at once: tokens, segments (turns) and loss-bearing tokens. Packs are
filled one at a time: of the examples that still fit, the one whose demands have the largest
weighted dot product with what the pack has left goes in next (Panigrahy et al., 2011); the
weights are the mean demands. Equal products go to the longer example, then the more segments,
the more loss tokens, and the lower hash.

Examples are spread by a hash of their id and demands over groups of about ``GROUP`` rows, as many as
their number asks for, and each group is packed on its own, so no task grows with the data and each
group leaves one pack part-filled at most. Equal examples are counted first and spread in shares of
``SHARE``, so neither the order of the rows nor their partitions change a pack, and a hot key makes no
hot group.

Defined results: an example over a limit by itself has a pack of its own, marked ``oversize``;
null or empty text has no tokens but is a segment; very long texts are counted whole; a null role
bears no loss; turns without a conversation id are examples of their own; repeated turns count again;
null and repeated document ids are examples like any other; other columns, whatever their names, are
not read; an empty table gives none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, written

#: Tokens, segments and loss-bearing tokens of a pack.
LIMITS = (8192, 64, 6144)
GROUP, SHARE = 16_384, 1_024
#: Byte-level BPE ranks that count tokens, and the pattern that cuts texts for it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file, once for each worker process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def counted(df: DataFrame, text_col: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for part in chunks(batches, "__text"):
            tokens = [len(encode(x)) if x else 0 for x in part.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(tokens, pa.int64())], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, f"{kinds}, tokens long")


def fill(demands: np.ndarray, limits: tuple[int, int, int] = LIMITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of an (n, 3) integer matrix: pack number, place in the pack, oversize."""
    n = len(demands)
    pack, slot = np.zeros(n, np.int64), np.zeros(n, np.int32)
    most = np.array(limits, dtype=np.int64)
    over = (demands > most).any(axis=1)
    pack[over] = np.arange(int(over.sum()))
    number = int(over.sum())
    rows = np.flatnonzero(~over)
    rows = rows[np.lexsort((rows, -demands[rows, 2], -demands[rows, 1], -demands[rows, 0]))]
    if not len(rows):
        return pack, slot, over
    kinds, first, count = np.unique(-demands[rows], axis=0, return_index=True, return_counts=True)
    kinds = -kinds  # by falling tokens, segments and loss tokens
    share = kinds / most
    weight = (share * count[:, None]).sum(axis=0) / count.sum()
    value = np.ascontiguousarray((share * weight).T)
    columns = [np.ascontiguousarray(kinds[:, k]) for k in range(3)]
    left, at = count.copy(), first.copy()
    shorter = -columns[0]
    todo = len(rows)
    while todo:
        free, place = most.copy(), 0
        while True:
            begin = int(np.searchsorted(shorter, -free[0]))  # the first kind that has few enough tokens
            fits = (left[begin:] > 0) & (columns[1][begin:] <= free[1]) & (columns[2][begin:] <= free[2])
            if not fits.any():
                break
            room = free / most
            score = np.where(fits, value[0, begin:] * room[0] + value[1, begin:] * room[1] + value[2, begin:] * room[2], -1.0)
            k = begin + int(score.argmax())
            row = rows[at[k]]
            pack[row], slot[row] = number, place
            at[k] += 1
            left[k] -= 1
            free -= kinds[k]
            place += 1
            todo -= 1
        number += 1
        if 2 * np.count_nonzero(left) < len(left):
            live = left > 0
            kinds, left, at, value = kinds[live], left[live], at[live], np.ascontiguousarray(value[:, live])
            columns = [x[live] for x in columns]
            shorter = shorter[live]
    return pack, slot, over


def pack(examples: DataFrame, id_col: str, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """(id, pack_id, slot, tokens, segments, loss_tokens, oversize) for each row of (id, tokens, segments, loss_tokens)."""
    demand = ("tokens", "segments", "loss_tokens")
    own = examples.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(k).cast("long"), F.lit(0)).alias(k) for k in demand))
    held = written(own.groupBy("id", *demand).agg(F.count("*").alias("n")))
    groups = max(1, -(-(held.agg(F.sum("n")).first()[0] or 0) // GROUP))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("name", "ascending"), ("share", "ascending")])
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("n").to_numpy())))
        demands = np.column_stack([table.column(k).to_numpy() for k in demand])
        number, slot, over = fill(demands, limits)
        packs = (table.column("group").to_numpy().astype(np.int64) << 32) | number
        return pa.table([table.column("id"), pa.array(packs), pa.array(slot), *(table.column(k) for k in demand), pa.array(over)], names=["id", "pack_id", "slot", *demand, "oversize"])

    kind = held.schema["id"].dataType.simpleString()
    shares = held.select("id", *demand, F.expr(f"explode(transform(sequence(0, (n - 1) div {SHARE}), s -> struct(s as share, least({SHARE}, n - s * {SHARE}) as n)))").alias("s"))
    spread = shares.select("id", *demand, "s.share", "s.n", F.xxhash64("id", *demand, "s.share").alias("h"), F.col("id").cast("string").alias("name"))
    placed = spread.withColumn("group", F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int"))
    return placed.groupBy("group").applyInArrow(run, f"id {kind}, pack_id long, slot int, tokens long, segments long, loss_tokens long, oversize boolean").withColumnRenamed("id", id_col)


def pack_conversations(turns: DataFrame, limits: tuple[int, int, int] = LIMITS, path: str = VOCABULARY) -> DataFrame:
    """Packs of whole conversations: a turn is a segment, the assistant's tokens bear the loss."""
    own = turns.select("conv_id", "role", "text", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone"))
    sized = counted(own, "text", ["conv_id", "lone", "role"], path)
    examples = sized.groupBy("conv_id", "lone").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0)).alias("loss_tokens"))
    return pack(examples, "conv_id", limits)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int, int] = (LIMITS[0], LIMITS[1], LIMITS[0]), path: str = VOCABULARY) -> DataFrame:
    """Packs of documents: each is one segment, and all its tokens bear the loss."""
    sized = counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"], path)
    return pack(sized.select("doc_id", "tokens", F.lit(1).alias("segments"), F.col("tokens").alias("loss_tokens")), "doc_id", limits)
