"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent 1- to 3-grams in order. A document's own most frequent
n-grams are compared with each profile by the out-of-place distance: the sum over them of the
difference of the two ranks, or ``PROFILE`` where the language's profile lacks the n-gram.

Text is lower-cased, runs of anything but letters become one blank, and blanks surround it.
N-grams don't span words: a blank stands only at their ends. Ranks are by count, then by
code points, so ties have one order.

Defined results: null text, empty text and text without letters have no language and are not
accepted; equal distances go to the language first in order; with no labelled row at all there
is no profile, every language is null and every text with letters is accepted. Texts are judged whole,
of any length; of a word or two a few letters decide, so gibberish so short may pass. Null ids and
repeated rows are judged like any other row; other columns, whatever their names, are not touched; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, code_points, ragged_arange, rewritten

#: N-grams in a language's profile, and of a document that are compared with it.
PROFILE = 300
#: Labelled documents of each language that the profiles are made from: those first by md5 of the id.
SAMPLE = 500
#: Accepted up to this many hundredths of the largest distance that the document could have. The given
#: documents reach 62 and prose of their languages from elsewhere 66; random letters have 79 and more
#: from about 100 letters on, other languages 67 (the nearest) to 81 from about 300.
ACCEPT = 67


class Grams:
    """N-gram counts of a chunk of texts: rows (doc, gram, count), sorted by document and rank."""

    def __init__(self, texts: pa.Array) -> None:
        points, lengths = code_points(texts)
        seen = np.zeros(0x110000, dtype=bool)
        seen[points] = True
        mapped = {int(c): ord(low) if len(low := chr(c).lower()) == 1 and low.isalpha() else ord(low[0]) if chr(c).isalpha() else 32 for c in np.flatnonzero(seen)}
        self.alphabet = np.array(sorted({32, *mapped.values()}), dtype=np.uint32)
        self.bits = int(len(self.alphabet)).bit_length()
        dense = np.zeros(0x110000, dtype=np.int64)
        if mapped:
            dense[list(mapped)] = np.searchsorted(self.alphabet, list(mapped.values())) + 1
        n = len(lengths)
        self.n = n
        doc = np.repeat(np.arange(n, dtype=np.int64), lengths + 2)
        codes = np.ones(len(doc), dtype=np.int64)
        inner = np.ones(len(doc), dtype=bool)
        ends = np.cumsum(lengths + 2)
        inner[ends - 1] = False
        inner[ends - lengths - 2] = False
        codes[inner] = dense[points]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1) | (doc[1:] != doc[:-1])
        codes, doc = codes[keep], doc[keep]
        b = self.bits
        one = codes != 1
        two = doc[1:] == doc[:-1]
        three = two[:-1] & two[1:] & one[1:-1]
        two = two & (one[1:] | one[:-1])
        packed = codes << (2 * b)
        keys = np.concatenate([
            packed[one] | doc[one] << (3 * b),
            (packed[:-1] | codes[1:] << b | doc[:-1] << (3 * b))[two],
            (packed[:-2] | codes[1:-1] << b | codes[2:] | doc[:-2] << (3 * b))[three],
        ])
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        order = np.lexsort((-count, keys >> (3 * b)))  # stable: equal counts stay in the order of their n-grams
        keys, self.count = keys[order], count[order]
        self.doc, self.gram = keys >> (3 * b), keys & ((1 << (3 * b)) - 1)
        per = np.bincount(self.doc, minlength=n)
        self.rank = ragged_arange(per) + 1

    def text(self, grams: np.ndarray) -> list[str]:
        mask = (1 << self.bits) - 1
        letters = ["", *map(chr, self.alphabet)]
        return ["".join(letters[int(g) >> s & mask] for s in (2 * self.bits, self.bits, 0)) for g in grams]

    def pack(self, gram: str) -> int:
        """The packed form of an n-gram, or -1 where the chunk lacks one of its characters."""
        out = 0
        for k in range(3):
            code = 0
            if k < len(gram):
                at = int(np.searchsorted(self.alphabet, ord(gram[k])))
                if at == len(self.alphabet) or self.alphabet[at] != ord(gram[k]):
                    return -1
                code = at + 1
            out = out << self.bits | code
        return out


class Profiles:
    """Ranks of n-grams by language; ``decide`` judges texts."""

    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        self.langs = sorted({x[0] for x in rows})
        self.grams = sorted({x[1] for x in rows})
        at = {g: k for k, g in enumerate(self.grams)}
        self.ranks = np.zeros((len(self.langs), len(self.grams) + 1), dtype=np.int64)
        for lang, gram, rank in rows:
            self.ranks[self.langs.index(lang), at[gram]] = rank

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: language number or -1, distance, largest possible distance, accepted."""
        g = Grams(texts)
        top = g.rank <= PROFILE
        doc, gram, rank = g.doc[top], g.gram[top], g.rank[top]
        packed = np.array([g.pack(x) for x in self.grams], dtype=np.int64)
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
        at = np.searchsorted(packed, gram)
        at[at == len(packed)] = 0
        known = packed[at] == gram if len(packed) else np.zeros(len(gram), bool)
        column = np.where(known, order[at], len(self.grams)) if len(packed) else np.zeros(len(gram), np.int64)
        worst = np.bincount(doc, minlength=g.n) * PROFILE
        letters = worst > 0
        if not self.langs:
            return np.full(g.n, -1), np.zeros(g.n, np.int64), worst, letters
        far = np.empty((len(self.langs), g.n), dtype=np.int64)
        for k in range(len(self.langs)):
            own = self.ranks[k][column]
            far[k] = np.bincount(doc, weights=np.where(own > 0, np.abs(own - rank), PROFILE), minlength=g.n)
        best = far.argmin(axis=0)
        distance = far[best, np.arange(g.n)]
        return np.where(letters, best, -1), distance, worst, letters & (distance * 100 <= worst * ACCEPT)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles from a bounded sample of labelled rows, ``sample`` of each language."""
    key = F.md5(F.col(id_col).cast("string"))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = labelled.select(F.col(lang_col).alias("l"), F.col(id_col).alias("i"), key.alias("k"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("k"))).where(F.col("r") <= sample).select("i").distinct()
    chosen = labelled.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(ids), "i", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            g = Grams(part.column("text"))
            lang = np.array(part.column("lang").to_pylist(), dtype=object)[g.doc]
            names, numbers = np.unique(lang.astype(str), return_inverse=True) if len(lang) else (np.zeros(0, str), np.zeros(0, np.int64))
            keys, inverse = np.unique(numbers.astype(np.int64) << (3 * g.bits) | g.gram, return_inverse=True)
            total = np.bincount(inverse, weights=g.count, minlength=len(keys)).astype(np.int64)
            yield pa.record_batch({"lang": pa.array([str(names[k >> (3 * g.bits)]) for k in keys], pa.string()), "gram": pa.array(g.text(keys & ((1 << (3 * g.bits)) - 1)), pa.string()), "n": total})

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
    return Profiles([(x["lang"], x["gram"], x["r"]) for x in ranked.select("lang", "gram", "r").collect()])  # PROFILE rows a language


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, distance, worst, accepted), one row for each row of docs."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(profiles.langs, pa.string())
        for part in chunks(batches, "text"):
            lang, distance, worst, ok = profiles.decide(part.column("text"))
            which = pa.array(lang, pa.int64(), mask=lang < 0)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "language": names.take(which), "distance": pa.array(distance, pa.int64(), mask=lang < 0), "worst": pa.array(worst, pa.int64()), "accepted": pa.array(ok)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, f"doc_id {kind}, language string, distance long, worst long, accepted boolean")


def keep_accepted(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The accepted rows of docs, whole and with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            yield part.filter(pa.array(profiles.decide(part.column(text_col))[3]))

    return rewritten(docs, keep)
