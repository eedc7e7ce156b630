"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct word units are concatenated and indexed by a suffix array; every piece is
looked up in it by binary search, its occurrence range gives lattice edges, and the edges are
sorted by position and relaxed. The model is of the merge (BPE) kind, where the last piece of
each prefix's encoding is unique: an edge is taken if and only if its piece, next to the piece
that ends where it starts, is what the merges make of the two together. That gives the same
pieces as merging pair by pair, best score first and leftmost among equals.

Units end before a word mark, and around characters that no piece holds, where no piece can
cross; so only distinct units are indexed and texts may be of any length. Characters without a
piece become their UTF-8 bytes' pieces.

Defined results: null text has null ids, empty text none; texts of any length are encoded whole;
equal scores merge leftmost first; null and repeated ids and repeated rows are rows like any other;
decoding drops the one blank that encoding puts in front; a word mark (U+2581) in a text decodes as a
blank; byte pieces that make no valid UTF-8 decode as U+FFFD; control pieces decode to nothing; other
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, list_array, powers, ragged_arange

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
BATCH_CHARS = 3_000_000
WORD = 5  # characters in a 60-bit word
NONE = -np.inf


class Model:
    """Pieces, their scores and what is needed to tell which may stand side by side."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(k) for k in range(n)]
        plain = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        self.score = {self.text[k]: sp.get_score(k) for k in plain}
        self.id = {self.text[k]: k for k in plain}
        self.byte = {int(self.text[k][1:-1], 16): k for k in range(n) if sp.is_byte(k)}
        if len(self.byte) != 256:
            raise ValueError("the model needs a piece for every byte")
        alphabet = sorted({ord(c) for x in self.id for c in x})
        if any(chr(c) not in self.id for c in alphabet):
            raise ValueError("every character of a piece must be a piece")
        if any(chr(MARK) in x.lstrip(chr(MARK)) for x in self.id):
            raise ValueError("a word mark may only begin a piece")
        self.code = np.zeros(0x110000, dtype=np.uint16)
        self.code[alphabet] = np.arange(1, len(alphabet) + 1)
        if len(alphabet) > 4094:
            raise ValueError("the model has too many characters")
        self._steps(n)
        own = [k for k in plain if self.reachable[k]]
        self.ids = np.array(own, dtype=np.int64)
        self.length = np.array([len(self.text[k]) for k in own], dtype=np.int64)
        self.words = -(-int(self.length.max()) // WORD)
        self.low = np.zeros((self.words, len(own)), dtype=np.int64)
        self.high = np.zeros((self.words, len(own)), dtype=np.int64)
        for row, k in enumerate(own):
            codes = [int(self.code[ord(c)]) for c in self.text[k]]
            for w in range(self.words):
                for at in range(w * WORD, (w + 1) * WORD):
                    self.low[w, row] = self.low[w, row] << 12 | (codes[at] if at < len(codes) else 0)
                    self.high[w, row] = self.high[w, row] << 12 | (codes[at] if at < len(codes) else 4095)
        raw = [bytes([b]) if (b := self._byte_of(sp, k)) is not None else b"" if sp.is_control(k) else " ⁇ ".encode() if sp.is_unknown(k) else self.text[k].replace(chr(MARK), " ").encode() for k in range(n)]
        self.raw_length = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.size = n
        self._keys = np.full(1 << 21, -1, dtype=np.int64)
        self._fits = np.zeros(1 << 21, dtype=bool)

    def _byte_of(self, sp, k: int) -> int | None:
        return int(self.text[k][1:-1], 16) if sp.is_byte(k) else None

    def _steps(self, n: int) -> None:
        """By piece and own merge: its score, and the symbols at both ends before it."""
        joins: dict[int, float] = {}
        merges: list[list[tuple[float, int, int]]] = [[] for _ in range(n)]
        self.reachable = np.zeros(n, dtype=bool)
        for text, k in self.id.items():
            for cut in range(1, len(text)):
                a, b = self.id.get(text[:cut]), self.id.get(text[cut:])
                if a is not None and b is not None:
                    joins[a * n + b] = self.score[text]
            parts = list(text)
            while True:
                best, at = NONE, -1
                for x in range(len(parts) - 1):
                    if (s := self.score.get(parts[x] + parts[x + 1], NONE)) > best:
                        best, at = s, x
                merges[k].append((best, self.id[parts[0]], self.id[parts[-1]]))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.reachable[k] = len(parts) == 1
        deep = max(map(len, merges))
        self.own = np.full((n, deep), NONE)
        self.first = np.zeros((n, deep), dtype=np.int64)
        self.last = np.zeros((n, deep), dtype=np.int64)
        for k, steps in enumerate(merges):
            for x, (score, a, b) in enumerate(steps):
                self.own[k, x], self.first[k, x], self.last[k, x] = score, a, b
        keys = np.array(sorted(joins), dtype=np.int64)
        self.join_keys, self.join_scores = np.append(keys, np.iinfo(np.int64).max), np.array([*(joins[int(k)] for k in keys), NONE])
        self.n = n

    def _beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of left and right together leaves left and right."""
        fits = np.ones(len(left), dtype=bool)
        i, j = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        live = np.arange(len(left))
        while len(live):
            l, r = left[live], right[live]
            a, b = self.own[l, i[live]], self.own[r, j[live]]
            key = self.last[l, i[live]] * self.n + self.first[r, j[live]]
            at = np.searchsorted(self.join_keys, key)
            c = np.where(self.join_keys[at] == key, self.join_scores[at], NONE)
            crossed = (c > a) & (c >= b)
            fits[live[crossed]] = False
            step = ~crossed & (a >= b) & (a > NONE)
            i[live[step]] += 1
            other = ~crossed & ~step & (b > NONE)
            j[live[other]] += 1
            live = live[step | other]
        return fits

    def beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_beside() through a table of pairs seen before."""
        key = left * self.n + right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        fits = self._fits[slot]
        miss = np.flatnonzero(self._keys[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            found = self._beside(new // self.n, new % self.n)
            fits[miss] = found[back]
            self._keys[slot[miss]] = key[miss]
            stayed = self._keys[slot[miss]] == key[miss]  # of several keys for a slot, one stays
            self._fits[slot[miss][stayed]] = fits[miss][stayed]
        return fits


_models: dict[str, Model] = {}


def model(path: str = MODEL) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes by their first ``depth`` characters at least, WORD characters packed at each place)."""
    n = len(codes)
    packed = np.zeros(n + depth + WORD, dtype=np.int64)
    wide = np.zeros(n + WORD, dtype=np.int64)
    wide[:n] = codes
    for k in range(WORD):
        packed[:n] = packed[:n] << 12 | wide[k : k + n]
    key, reach = packed[:n], WORD
    while reach < depth:  # twice as far each time
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - reach)] = rank[reach:]
        key, reach = rank << 32 | ahead, 2 * reach
    return np.argsort(key, kind="stable"), packed


def ranges(m: Model, order: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each piece's occurrences in the suffix order, by binary search."""
    n = len(order)
    out = []
    for target, strict in ((m.low, False), (m.high, True)):
        lo, hi = np.zeros(len(m.ids), np.int64), np.full(len(m.ids), n, np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, n - 1)]
            less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for w in range(m.words):
                own = packed[at + w * WORD]
                less |= equal & (own < target[w])
                equal &= own == target[w]
            go = (less | (equal & strict)) & (lo < hi)
            lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
        out.append(lo)
    return out[0], out[1]


def encode_units(m: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all units end to end, number for each unit); each unit has its end marked by a 0 code."""
    order, packed = suffix_order(codes, m.words * WORD)
    lo, hi = ranges(m, order, packed)
    count = hi - lo
    piece = np.repeat(m.ids, count)
    begin = order[np.repeat(lo, count) + ragged_arange(count)]
    end = begin + np.repeat(m.length, count)
    where = end - np.repeat(starts, lengths + 1)[begin]
    turn = np.argsort(where.astype(np.uint16) if where.max(initial=0) < 65536 else where, kind="stable")
    piece, begin, end, where = piece[turn], begin[turn], end[turn], where[turn]
    last = np.full(len(codes) + 1, -1, dtype=np.int64)  # the piece that ends at a place
    back = np.zeros(len(codes) + 1, dtype=np.int64)
    used = np.zeros(len(codes) + 1, dtype=np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        before = last[begin[a:b]]
        ok = before < 0
        ask = np.flatnonzero(~ok)
        if len(ask):
            ok[ask] = m.beside(before[ask], piece[a:b][ask])
        e, s = end[a:b][ok], begin[a:b][ok]
        last[e], back[e], used[e] = piece[a:b][ok], s, used[s] + 1
    tail = starts + lengths
    total = used[tail]
    out = np.zeros(int(total.sum()), dtype=np.int64)
    base = np.cumsum(total) - total
    at, live = tail.copy(), np.flatnonzero(total > 0)
    while len(live):
        place = at[live]
        out[base[live] + used[place] - 1] = last[place]
        at[live] = back[place]
        live = live[used[at[live]] > 0]
    return out, total


def encode(texts: pa.Array, path: str = MODEL) -> pa.ListArray:
    """Piece ids of each text."""
    m = model(path)
    points, lengths = code_points(texts)
    n = len(lengths)
    filled = lengths > 0
    whole = lengths + filled
    ends = np.cumsum(whole)
    chars = np.full(int(ends[-1]) if n else 0, MARK, dtype=np.uint32)
    inner = np.ones(len(chars), dtype=bool)
    inner[(ends - whole)[filled]] = False
    points = points.copy()
    points[points == 32] = MARK
    chars[inner] = points
    if not len(chars):
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
    codes = m.code[chars]
    mark, known = chars == MARK, codes > 0
    cut = np.ones(len(chars), dtype=bool)
    cut[1:] = (mark[1:] & ~mark[:-1]) | ~known[1:] | ~known[:-1]
    cut[(ends - whole)[filled]] = True
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(chars)))
    place = np.arange(len(chars)) - np.repeat(first, size)
    hashed = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place], first) ^ (size.astype(np.uint64) << np.uint64(52))
    _, head, kind = np.unique(hashed, return_index=True, return_inverse=True)
    model_start = first[head[kind]]
    wrong = np.add.reduceat(chars != chars[np.minimum(np.repeat(model_start, size) + place, len(chars) - 1)], first) > 0
    wrong |= size != size[head[kind]]
    if wrong.any():  # two units with one hash: the later ones are taken by themselves
        odd = np.flatnonzero(wrong)
        kind = kind.copy()
        kind[odd] = len(head) + np.arange(len(odd))
        head = np.append(head, odd)
    uchars, usize = first[head], size[head]
    plain = known[uchars]
    order = np.flatnonzero(plain)
    length = usize[order]
    starts = np.cumsum(length + 1) - length - 1
    flat = np.zeros(int((length + 1).sum()), dtype=np.int64)
    inside = ragged_arange(length)
    flat[np.repeat(starts, length) + inside] = codes[np.repeat(uchars[order], length) + inside]
    found, total = encode_units(m, flat, starts, length) if len(order) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    odd = np.flatnonzero(~plain)
    raw = [chr(int(c)).encode("utf-8", "replace") for c in chars[uchars[odd]]]
    number = np.zeros(len(head), dtype=np.int64)
    number[order], number[odd] = total, [len(x) for x in raw]
    begin = np.zeros(len(head), dtype=np.int64)
    begin[order] = np.cumsum(total) - total
    begin[odd] = len(found) + np.cumsum(number[odd]) - number[odd]
    pool = np.concatenate([found, np.array([m.byte[b] for x in raw for b in x], dtype=np.int64)])
    per = number[kind]
    ids = pool[np.repeat(begin[kind], per) + ragged_arange(per)]
    counts = np.bincount(np.searchsorted(ends, first, side="right"), weights=per, minlength=n).astype(np.int64)
    return list_array(pa.array(ids.astype(np.int32)), counts)


def decode(ids: pa.ListArray, path: str = MODEL) -> pa.Array:
    """The text of each list of piece ids."""
    m = model(path)
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0), dtype=np.int64)
    flat = np.asarray(ids.flatten(), dtype=np.int64)
    size = m.raw_length[flat]
    data = m.raw[np.repeat(m.raw_start[flat], size) + ragged_arange(size)]
    edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    lead = edges[:-1][edges[1:] > edges[:-1]]
    lead = lead[data[lead] == 32] if len(lead) else lead
    keep = np.ones(len(data), dtype=bool)
    keep[lead] = False
    gone = np.concatenate([[0], np.cumsum(~keep)])
    edges = edges - gone[edges]
    data = data[keep]
    blob = data.tobytes()
    try:
        blob.decode("utf-8")
        bad = bool(len(edges) > 1 and (data[edges[:-1][edges[:-1] < len(data)]] & 0xC0 == 0x80).any())
    except UnicodeDecodeError:
        bad = True
    null = np.asarray(ids.is_null())
    if bad:
        return pa.array([None if null[k] else blob[a:b].decode("utf-8", "replace") for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))], pa.large_string())
    made = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(blob))
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.large_string()), made) if null.any() else made


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip) for each row: encoded, and decoded again to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", BATCH_CHARS):
            texts = part.column("text")
            ids = encode(texts, path)
            same = pa.compute.equal(decode(ids, path), pa.compute.replace_substring(pa.compute.fill_null(texts, "").cast(pa.large_string()), chr(MARK), " "))
            null = texts.is_null()
            ids = pa.compute.if_else(null, pa.scalar(None, ids.type), ids) if texts.null_count else ids
            number = pa.compute.list_value_length(ids)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": ids, "n_pieces": number, "round_trip": pa.compute.if_else(null, pa.scalar(None, pa.bool_()), same)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces int, round_trip boolean")
