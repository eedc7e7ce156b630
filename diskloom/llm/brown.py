"""Language-model scores by a class-based bigram model with exchange clustering.

Words are runs of letters, digits and marks, without regard to case. Every word of the corpus has
a class and an emission of its own; documents begin with a class of their own. Classes come from
exchange clustering, each move being judged by its exact gain in the likelihood of the bigrams:

* the ``SEEDS`` most frequent words are exchanged one by one on the driver, over their own bigram
  table, until a round moves none or ``ROUNDS`` are over; the likelihood never falls;
* the other words begin in a class of rest and are moved out of it by the same gain, from the
  classes around all their occurrences: first the ``FREQUENT`` ones, whose classes every worker then
  holds, then all others where the shuffle by word has brought their occurrences together.

A document's log-probability is the sum over its words of log P(class | class before) and
log P(word | class). Transitions are smoothed by Witten-Bell interpolation with the add-one class
frequencies, emissions by Witten-Bell too: n(word) / (N(class) + distinct words of the class), the
rest being kept for words never seen. Both are counted over all words of all documents.

The driver holds ``SEEDS`` squared counts and ``FREQUENT`` words at any corpus size; all else, the
tables of words, their contexts and the documents' class sequences, is distributed and grows with
the corpus.

Defined results: null, empty and word-less texts have 0 words, log-probability 0 and a null
perplexity; very long texts are one sequence of any length; repeated rows count and are scored like
any other; equal frequencies are ordered by hash and equal gains go to the lowest class; other
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import chunks, forget, words, written

SEEDS, FREQUENT, CLASSES, ROUNDS = 2_048, 65_536, 48, 20
#: Keys that a worker counts before it passes the counts on; bounds memory, not results.
HELD = 6_000_000
#: Context entries whose gains are worked out at a time.
ENTRIES = 100_000
#: Place of a word without a class in a document's class sequence; mark of a word's first occurrence.
OPEN, FIRST = 255, 128


class Numbering:
    """Numbers of words given in order, and one more for all others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.rest = len(hashes)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not self.rest:
            return np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.sorted, h), self.rest - 1)
        return np.where(self.sorted[at] == h, self.order[at], self.rest)


def _same_row(row: np.ndarray) -> np.ndarray:
    """Whether the word before is of the same text."""
    out = np.zeros(len(row), dtype=bool)
    out[1:] = row[1:] == row[:-1]
    return out


def _counted(docs: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(k, n): how often each key comes in (text), summed over up to HELD keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"k": pa.array(keys), "n": pa.array(n.astype(np.int64))})

        for part in chunks(batches, "text"):
            keys = keys_of(*words(part.column("text")))
            held.append(keys)
            size += len(keys)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "k long, n long")


def frequent(docs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the ``most`` most frequent words of (text), by falling count, then hash."""
    seen = written(_counted(docs, lambda row, h: h.view(np.int64)).groupBy("k").agg(F.sum("n").alias("n")))
    step = F.floor(F.log2("n") * 64)
    total, least = 0, 0
    for r in sorted(seen.groupBy(step.alias("s")).count().collect(), reverse=True):  # a few thousand steps
        total, least = total + r["count"], r["s"]
        if total >= most:
            break
    top = seen.where(step >= least).orderBy(F.desc("n"), "k").limit(most).toArrow()
    forget(seen)
    return top.column("k").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)


def bigrams(docs: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """Counts of pairs of words among ``hashes``, all other words being one and a document's start another."""
    rest, start = len(hashes), len(hashes) + 1
    shared = docs.sparkSession.sparkContext.broadcast(hashes)  # SEEDS words at most

    def keys_of(row: np.ndarray, h: np.ndarray) -> np.ndarray:
        now = Numbering(shared.value).of(h)
        before = np.where(_same_row(row), np.roll(now, 1), start) if len(now) else now
        return before << 32 | now

    table = _counted(docs, keys_of).groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k = table.column("k").to_numpy()
    out = np.zeros((rest + 2, rest + 2))
    out[k >> 32, k & 0xFFFFFFFF] = table.column("n").to_numpy()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(n: np.ndarray) -> float:
    """The part of the corpus log-likelihood that depends on the classes."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=1)).sum() - _xlogx(n.sum(axis=0)).sum())


def between(pairs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Counts between classes from those between words."""
    one = np.eye(int(classes.max()) + 1)[classes]
    return one.T @ pairs @ one


def exchange(pairs: np.ndarray, classes: np.ndarray, movable: int, many: int) -> np.ndarray:
    """One round: each of the first ``movable`` words in turn goes to the class of the first ``many`` that gains most."""
    classes = classes.copy()
    one = np.eye(int(classes.max()) + 1)[classes]
    right, left = pairs @ one, pairs.T @ one
    n = one.T @ right
    open_ = np.arange(many)
    for w in range(movable):
        c, s = int(classes[w]), pairs[w, w]
        r, l = right[w].copy(), left[w].copy()
        n[c, :] -= r
        n[:, c] -= l
        n[c, c] += s  # a pair of the word with itself was taken twice
        r[c] -= s
        l[c] -= s
        rows, cols, diagonal = n.sum(axis=1) + l, n.sum(axis=0) + r, n[open_, open_]  # what stands before or after w stays where it is
        f = _xlogx(n)
        gain = (_xlogx(n[:many] + r) - f[:many]).sum(axis=1) + (_xlogx(n[:, :many] + l[:, None]) - f[:, :many]).sum(axis=0)
        gain += _xlogx(diagonal + r[:many] + l[:many] + s) - _xlogx(diagonal + r[:many]) - _xlogx(diagonal + l[:many]) + _xlogx(diagonal)
        gain -= _xlogx(rows + r.sum() + s)[:many] - _xlogx(rows)[:many] + _xlogx(cols + l.sum() + s)[:many] - _xlogx(cols)[:many]
        d = int(gain.argmax())
        if gain[d] <= gain[c] + 1e-7 * max(1.0, abs(gain[c])):
            d = c
        n[d, :] += r
        n[:, d] += l
        n[d, d] += s
        if d != c:
            classes[w] = d
            right[:, c] -= pairs[:, w]
            right[:, d] += pairs[:, w]
            left[:, c] -= pairs[w, :]
            left[:, d] += pairs[w, :]
    return classes


def seeded(pairs: np.ndarray, classes: int, rounds: int) -> tuple[np.ndarray, int]:
    """(classes of the words of a pair table, open classes): words by rank over the classes at first, then exchanged."""
    words_ = len(pairs) - 2
    many = min(classes, max(1, words_))
    now = np.append(np.arange(words_) % many, [many, many + 1])
    for _ in range(rounds):
        nxt = exchange(pairs, now, words_, many)
        if (nxt == now).all():
            break
        now = nxt
    return now, many


class Contexts:
    """Codes of what stands beside a word: a class, rest, a document's start, the word itself, a document's end."""

    def __init__(self, many: int) -> None:
        self.rest, self.start, self.self_, self.end = many, many + 1, many + 2, many + 3

    def of(self, row: np.ndarray, h: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """left * 256 + right of each word; ``classes`` has the rest's code where none is known."""
        if not len(h):
            return np.zeros(0, np.int64)
        same = _same_row(row)
        twin = np.zeros(len(h), dtype=bool)
        twin[1:] = same[1:] & (h[1:] == h[:-1])
        left = np.where(same, np.where(twin, self.self_, np.roll(classes, 1)), self.start)
        follows = np.append(same[1:], False)
        right = np.where(follows, np.where(np.append(twin[1:], False), self.self_, np.roll(classes, -1)), self.end)
        return left.astype(np.int64) << 8 | right


def best_classes(word: np.ndarray, context: np.ndarray, count: np.ndarray, n: np.ndarray, many: int) -> np.ndarray:
    """For words 0, 1, ... of the rest class: the class whose gain is largest if the word alone moves there.

    (word, context, count) has each word's contexts, sorted by word. n has the counts between
    classes, rest (at ``many``) and start.
    """
    code = Contexts(many)
    words_ = int(word[-1]) + 1 if len(word) else 0
    left, right = context >> 8, context & 255
    twins = np.bincount(word, weights=np.where(left == code.self_, count, 0.0), minlength=words_)
    wide = many + 2
    side = []
    for own in (left, right):
        seen = own < wide
        side.append(np.bincount(word[seen] * wide + own[seen], weights=count[seen], minlength=words_ * wide).reshape(words_, wide))
    l, r = side
    f = _xlogx(n)
    gain = np.zeros((words_, many))
    for own, table, base in ((r, n[:many], f[:many]), (l, n[:, :many].T, f[:, :many].T)):  # tables by target and neighbour
        w, c = np.nonzero(np.where(np.arange(wide) == many, 0.0, own))
        for at in range(0, len(w), ENTRIES):
            p, q = w[at : at + ENTRIES], c[at : at + ENTRIES]
            each = _xlogx(table.T[q] + own[p, q][:, None]) - base.T[q]
            heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            np.add.at(gain, p[heads], np.add.reduceat(each, heads, axis=0))
    own_r, own_l, s = r[:, :many], l[:, :many], twins[:, None]
    d = np.diagonal(n)[:many]
    gain += _xlogx(d + own_r + own_l + s) - _xlogx(d + own_r) - _xlogx(d + own_l) + _xlogx(d)
    for beside, gone in ((n[:many, many] - own_l, r[:, many : many + 1]), (n[many, :many] - own_r, l[:, many : many + 1])):
        gain += _xlogx(beside + gone) - _xlogx(beside)
    for total, more in ((n.sum(axis=1)[:many], r.sum(axis=1, keepdims=True) + s), (n.sum(axis=0)[:many], l.sum(axis=1, keepdims=True) + s)):
        gain -= _xlogx(total + more) - _xlogx(total)
    return gain.argmax(axis=1)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of runs of equal keys, number of the run at each place)."""
    begin = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    return np.flatnonzero(begin), np.cumsum(begin) - 1


def assigned(docs: DataFrame, hashes: np.ndarray, classes: np.ndarray, n: np.ndarray, many: int) -> np.ndarray:
    """Classes of all words of ``hashes``, those of the first ``len(classes)`` being given; n has the counts between these."""
    context = docs.sparkSession.sparkContext
    shared, counts = context.broadcast((hashes, np.append(classes, many))), context.broadcast(n)  # FREQUENT words, classes squared
    first, code = len(classes), Contexts(many)

    def keys_of(row: np.ndarray, h: np.ndarray) -> np.ndarray:
        known, given = shared.value
        number = Numbering(known).of(h)
        beside = code.of(row, h, given[np.minimum(number, first)])
        asked = (number >= first) & (number < len(known))
        return number[asked] << 16 | beside[asked]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "w"):
            heads, word = _groups(table.column("w").to_numpy())
            own = best_classes(word, table.column("c").to_numpy(), table.column("n").to_numpy().astype(np.float64), counts.value, many)
            yield pa.record_batch({"w": table.column("w").combine_chunks().take(pa.array(heads)), "class": pa.array(own.astype(np.int32))})

    seen = _counted(docs, keys_of).select(F.shiftright("k", 16).alias("w"), F.col("k").bitwiseAND(F.lit(0xFFFF)).alias("c"), "n")
    moved = seen.repartition("w").sortWithinPartitions("w", "c").mapInArrow(move, "w long, class int").toArrow()
    out = np.append(classes, np.full(len(hashes) - first, many))
    out[moved.column("w").to_numpy()] = moved.column("class").to_numpy()
    return out


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes end to end, length of each) of a binary column."""
    lengths = np.asarray(pa.compute.binary_length(column), dtype=np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8), lengths


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    edges = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(np.ascontiguousarray(data, np.uint8).tobytes())]).cast(pa.binary())


def sequences(docs: DataFrame, hashes: np.ndarray, counts: np.ndarray, classes: np.ndarray, many: int) -> DataFrame:
    """(row, doc_id, codes, logs, rare) of (doc_id, text).

    codes has a byte for each word, its class or OPEN; logs is the sum of log n(word) of those with a
    class; rare has the others' hashes and contexts in order.
    """
    shared, code = docs.sparkSession.sparkContext.broadcast((hashes, np.append(np.log(counts), 0.0), np.append(classes, many))), Contexts(many)  # FREQUENT words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, given = shared.value
        numbers = Numbering(known)
        for part in chunks(batches, "text"):
            row, h = words(part.column("text"))
            number = numbers.of(h)
            own = given[number]
            open_ = own == many
            pairs = pa.StructArray.from_arrays([pa.array(h[open_].view(np.int64)), pa.array(code.of(row, h, own)[open_].astype(np.int32))], names=["w", "c"])
            edges = np.append(0, np.cumsum(np.bincount(row[open_], minlength=part.num_rows)))
            yield pa.record_batch({
                "row": part.column("row"),
                "doc_id": part.column("doc_id"),
                "codes": _binaries(np.where(open_, OPEN, own), np.bincount(row, minlength=part.num_rows)),
                "logs": pa.array(np.bincount(row, weights=logs[number], minlength=part.num_rows).astype(np.float64)),  # no word gives integers
                "rare": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pairs),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, codes binary, logs double, rare array<struct<w:bigint,c:int>>")


def class_counts(held: DataFrame, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts between classes, rest and start; words marked FIRST by class) of all sequences of (codes)."""
    wide = many + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide + wide, dtype=np.int64)
        for part in batches:
            data, lengths = _lists(part.column("codes"))
            now = np.where(data == OPEN, many, data & (FIRST - 1)).astype(np.int64)
            before = np.roll(now, 1)
            before[(np.cumsum(lengths) - lengths)[lengths > 0]] = many + 1
            total[: wide * wide] += np.bincount(before * wide + now, minlength=wide * wide)
            total[wide * wide :] += np.bincount(now[(data >= FIRST) & (data != OPEN)], minlength=wide)
        cells = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(cells), "n": pa.array(total[cells])})

    table = held.select("codes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # classes squared
    out = np.zeros(wide * wide + wide)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out[: wide * wide].reshape(wide, wide), out[wide * wide :]


def settled(held: DataFrame, n: np.ndarray, many: int) -> DataFrame:
    """(doc_id, codes, logs) of sequences() with every word's class; a word's first occurrence is marked FIRST."""
    counts = held.sparkSession.sparkContext.broadcast(n)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "w"):
            heads, word = _groups(table.column("w").to_numpy())
            context = table.column("c").to_numpy().astype(np.int64)
            runs, _ = _groups(word << 16 | context)
            size = np.diff(np.append(heads, len(word)))
            own = best_classes(word[runs], context[runs], np.diff(np.append(runs, len(word))).astype(np.float64), counts.value, many)[word]
            own[heads] |= FIRST
            yield pa.record_batch({"row": table.column("row").combine_chunks(), "k": table.column("k").combine_chunks(), "code": pa.array(own.astype(np.int16)), "n": pa.array(size[word])})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "row"):
            heads, text = _groups(table.column("row").to_numpy())
            yield pa.record_batch({
                "row": table.column("row").combine_chunks().take(pa.array(heads)),
                "found": _binaries(table.column("code").to_numpy(), np.bincount(text)),
                "more": pa.array(np.bincount(text, weights=np.log(table.column("n").to_numpy())).astype(np.float64)),
            })

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, lengths = _lists(part.column("codes"))
            data = data.copy()
            data[data == OPEN] = _lists(pa.compute.fill_null(part.column("found"), b""))[0]
            logs = pa.compute.add(part.column("logs"), pa.compute.fill_null(part.column("more"), 0.0))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "codes": _binaries(data, lengths), "logs": logs})

    kind = held.schema["doc_id"].dataType.simpleString()
    each = held.select("row", F.posexplode("rare").alias("k", "x")).select("x.w", F.col("x.c").cast("short").alias("c"), "row", "k")
    placed = each.repartition("w").sortWithinPartitions("w", "c").mapInArrow(move, "row long, k int, code short, n long")
    found = placed.repartition("row").sortWithinPartitions("row", "k").mapInArrow(gather, "row long, found binary, more double")
    return held.select("row", "doc_id", "codes", "logs").join(found, "row", "left").select("doc_id", "codes", "logs", "found", "more").mapInArrow(fill, f"doc_id {kind}, codes binary, logs double")


def transitions(n: np.ndarray, many: int) -> np.ndarray:
    """log P(class | class before) from each class, rest and start."""
    own = n[:, :many]
    unigram = (own.sum(axis=0) + 1.0) / (own.sum() + many)
    kinds = np.maximum((own > 0).sum(axis=1, keepdims=True), 1)
    return np.log((own + kinds * unigram) / (own.sum(axis=1, keepdims=True) + kinds))


def classified(docs: DataFrame, seeds: int = SEEDS, most: int = FREQUENT, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """Class sequences of (doc_id, text) as a written table (doc_id, codes, logs), the counts between classes, distinct words by class, classes."""
    texts = docs.where(F.length("text") > 0).select("text")
    hashes, counts = frequent(texts, most)
    pairs = bigrams(texts, hashes[:seeds])
    own, many = seeded(pairs, min(classes, FIRST - 4), rounds)
    given = own[:-2]
    if len(hashes) > len(given):
        given = assigned(texts, hashes, given, between(pairs, own), many)
    held = written(sequences(docs, hashes, counts, given, many))
    full = written(settled(held, class_counts(held, many)[0], many))
    forget(held)
    n, kinds = class_counts(full, many)
    return full, n, kinds[:many] + np.bincount(given, minlength=many)[:many], many


def perplexities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS, most: int = FREQUENT, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of each document under the model that all of them make."""
    full, n, kinds, many = classified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), seeds, most, classes, rounds)
    of_class = n[:, :many].sum(axis=0) + kinds
    # a word in a class costs its transition and the class's share; log n(word) is in logs
    step = transitions(n, many) - np.log(np.maximum(of_class, 1.0))
    shared = docs.sparkSession.sparkContext.broadcast(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            data, lengths = _lists(part.column("codes"))
            now = (data & (FIRST - 1)).astype(np.int64)
            before = np.roll(now, 1)
            before[(np.cumsum(lengths) - lengths)[lengths > 0]] = many + 1
            text = np.repeat(np.arange(len(lengths)), lengths)
            log = np.bincount(text, weights=shared.value[before, now], minlength=len(lengths)) + part.column("logs").to_numpy()
            none = lengths == 0
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": pa.array(lengths), "log_prob": pa.array(np.where(none, 0.0, log)), "perplexity": pa.array(np.exp(-log / np.maximum(lengths, 1)), mask=none)})

    kind = full.schema["doc_id"].dataType.simpleString()
    return full.mapInArrow(run, f"doc_id {kind}, n_words long, log_prob double, perplexity double")
