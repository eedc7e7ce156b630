"""Document fingerprints by a randomised edit embedding.

Shared random walks over a text's characters (Chakraborty, Goldenberg and Koucky, 2016) map edit
distance to Hamming distance: at each step the walk writes the character it stands on and moves
to the next one or stays, by a random bit that depends on step and character only. Texts a few
edits apart write the same symbols again soon after each edit. ``BANDS`` bands of ``ROWS``
sampled steps hash to buckets. Two texts are near if their exact edit distance is at most a 25th of the
longer one, whatever their length; groups are the connected components. All pairs of a bucket are
looked at: those of a spanning tree over sampled symbols, which joins most near texts, are verified
first; then, in buckets that still have several groups, the 3-gram counts of every two texts of unlike
groups, which give a lower bound of their distance, and where the bound allows it the texts. Buckets
that are led by one group are taken together, and more than ``BLOCK`` rows are compared in tasks of two
blocks of texts of about a length, so no task and no row grows with a bucket.

The more edits there are, the longer a walk stays out of step, so texts of ``WINDOWED`` characters
and more are put into buckets by windows instead: a band is the hash of ``PICKS`` windows of
``WINDOW`` characters, each the least by hash of its share of all hashes (one-permutation min-wise
sampling). Their printed fingerprint is the walks' too.

Steps are sampled by length class, texts of a length near a class's edge being in two classes,
so near texts share a class. Equal texts are folded into one first. Only texts in a candidate
pair are shuffled: others are dropped by a bitmap of fixed size, which costs precision but no
result when it fills up.

Defined results: null texts have no fingerprint and no group; equal texts are one group whatever
their length, empty ones too; texts under 25 characters are near equal ones only; the id of a
group is its lowest document id, null ids last; repeated rows are in one group; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import chunks, code_points, digest, forget, list_array, mix64, ragged_arange, written

#: Near texts have an edit distance of one PART-th of the longer one at most.
PART = 25
#: Characters of the texts whose distances are worked out at a time; bounds memory, not results.
MARKS = 4_000_000
#: Characters of a common run from which followed() goes on.
RUN = 16
#: Columns between two looks at which pairs can still be near.
LOOK = 96
#: Pairs that a task compares before it looks which ones still have to be.
PAIRS = 8_192
WALKS, BANDS, ROWS, SKETCH = 4, 24, 7, 24
#: Walks over texts whose bands are windows: they write the sketch only.
LONG_WALKS = 2
#: The walks' random bits repeat after so many steps; characters have one of KINDS sets of bits.
PERIOD, KINDS = 8192, 64
SHORTEST, RATIO = 20, 1.25
#: Least length of a class whose bands are windows; characters of a window; windows of a band.
WINDOWED, WINDOW, PICKS = 300, 12, 2
#: Walks below which documents are walked one at a time.
NARROW = 48
#: Characters of a batch: enough that walks go over many texts at once.
BATCH_CHARS = 4_000_000
#: Rows of a block; a task compares one block, or two with each other. Bins of the profiles that it compares.
BLOCK, BINS = 256, 1024
#: Bits of the bitmap of candidate texts.
BITMAP = 1 << 26
_MASK = PERIOD - 1


def _delta() -> np.ndarray:
    """By walk, kind of character and step: steps until the walk leaves a character it has just reached."""
    n = WALKS * KINDS * PERIOD
    bits = (mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(63)).astype(bool).reshape(WALKS, KINDS, PERIOD)
    out = np.zeros(bits.shape, dtype=np.uint8)  # small, so that it stays in a processor's cache; the longest is far below 255
    ahead = np.zeros(bits.shape[:2], dtype=np.int64)
    for turn in range(2):  # twice around, as the bits repeat
        for step in range(PERIOD - 1, -1, -1):
            ahead = np.where(bits[:, :, step], 1, ahead + 1)
            out[:, :, step] = ahead
    return out.reshape(WALKS, KINDS * PERIOD)


_deltas: list[np.ndarray] = []
_lists: list[list[list[int]]] = []


def deltas() -> tuple[np.ndarray, list[list[list[int]]]]:
    if not _deltas:
        found = _delta()
        _deltas.append(found.ravel())
        _lists.extend(own.reshape(KINDS, PERIOD).tolist() for own in found)
    return _deltas[0], _lists


def arrivals(kinds: np.ndarray, starts: np.ndarray, lengths: np.ndarray, walks: int) -> np.ndarray:
    """By walk, the step at which it reaches each character; texts lie end to end in ``kinds``."""
    flat, lists = deltas()
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    out = np.zeros((walks, len(kinds)), dtype=np.int32)  # a step is reached after a few times as many characters
    now = np.zeros((walks, len(order)), dtype=np.int64)
    base = kinds.astype(np.int32) * PERIOD
    of_walk = np.arange(walks)[:, None] * (KINDS * PERIOD)
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    wide = int(np.count_nonzero(active * walks >= NARROW))
    for i in range(wide):
        a = int(active[i])
        at = begin[:a] + i
        t = now[:, :a]
        out[:, at] = t
        t += flat[base[at] + of_walk + (t & _MASK)]
    for k in range(len(order)):
        if size[k] <= wide:
            break
        a, b = int(begin[k]) + wide, int(begin[k] + size[k])
        own = kinds[a:b].tolist()
        for walk in range(walks):
            t, steps, rows = int(now[walk, k]), [], lists[walk]
            for c in own:
                steps.append(t)
                t += rows[c][t & _MASK]
            out[walk, a:b] = steps
    return out


def allowed(n: np.ndarray) -> np.ndarray:
    """Edits within which a text of n characters is near another one that is not longer."""
    return n // PART


def class_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, SHORTEST) / SHORTEST) / np.log(RATIO) + 1e-9).astype(np.int64)


def steps_of(classes: np.ndarray, walk: int, many: int) -> np.ndarray:
    """Sampled steps of each class for a walk, below 1.9 times the class's least length."""
    seed = (classes[:, None].astype(np.uint64) << np.uint64(32)) | np.uint64(walk << 16) | np.arange(1, many + 1, dtype=np.uint64)
    part = (mix64(mix64(seed)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return (part * 1.9 * (SHORTEST * RATIO ** classes[:, None])).astype(np.int64)


def windows(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Band keys of each text from its least windows; a share without a window takes the next one's."""
    shares = BANDS * PICKS
    out = np.full(len(lengths) * shares, np.iinfo(np.uint64).max, dtype=np.uint64)
    if len(points) >= WINDOW:
        odd = np.uint64(0x9E3779B97F4A7C15)
        h, many = mix64(points.astype(np.uint64) + odd), 1
        while many < WINDOW:
            more = min(many, WINDOW - many)
            h = h[:-more] * (odd + np.uint64(2 * many)) + h[more:]
            many += more
        text = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[: len(h)]
        inside = np.arange(len(h), dtype=np.int64) + WINDOW <= np.cumsum(lengths)[text]
        h, text = mix64(h[inside]), text[inside]
        np.minimum.at(out, text * shares + (h % np.uint64(shares)).astype(np.int64), h // np.uint64(shares))
    out = out.reshape(-1, shares)
    for _ in range(shares):
        empty = out == np.iinfo(np.uint64).max
        if not empty.any():
            break
        out = np.where(empty, np.roll(out, -1, axis=1), out)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 << 20), (len(lengths), BANDS))
    for k in range(PICKS):
        key = mix64(key ^ out[:, k::PICKS]) + np.uint64(k)
    return key


def _symbols(points: np.ndarray, lengths: np.ndarray, texts: np.ndarray, classes: np.ndarray, walks: int, many: int) -> list[np.ndarray]:
    """By walk, the symbols that it writes at the sampled steps of each of ``texts``, ascending, for the class beside it."""
    starts = np.cumsum(lengths) - lengths
    own, back = np.unique(texts, return_inverse=True)
    size = lengths[own]
    flat = points[np.repeat(starts[own], size) + ragged_arange(size)]
    kinds = (mix64(flat) & np.uint64(KINDS - 1)).astype(np.uint8)
    text = np.repeat(np.arange(len(own), dtype=np.int64), size) << 40
    distinct, of = np.unique(classes, return_inverse=True)
    out = []
    for walk, reached in enumerate(arrivals(kinds, np.cumsum(size) - size, size, walks)):
        at = np.searchsorted(text | reached, (back[:, None] << 40) | steps_of(distinct, walk, many)[of], side="right") - 1
        out.append(mix64(flat[at]))
    return out


def sampled(points: np.ndarray, lengths: np.ndarray, which: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, sketches) of the texts ``which``, each sampled for the class beside it."""
    keys = np.zeros((len(which), BANDS), dtype=np.uint64)
    sketch = np.zeros((len(which), SKETCH), dtype=np.uint8)
    wide = SHORTEST * RATIO**classes >= WINDOWED
    for rows, walks, per in ((np.flatnonzero(~wide), WALKS, BANDS // WALKS), (np.flatnonzero(wide), LONG_WALKS, 0)):
        if not len(rows):
            continue
        share = SKETCH // walks
        for walk, symbols in enumerate(_symbols(points, lengths, which[rows], classes[rows], walks, per * ROWS + share)):
            for k in range(per):
                key = (np.uint64(walk * per + k + 1) << np.uint64(32)) | classes[rows].astype(np.uint64)
                for r in range(ROWS):
                    key = mix64(key ^ symbols[:, k * ROWS + r]) + np.uint64(r)
                keys[rows, walk * per + k] = key
            sketch[rows, walk * share : (walk + 1) * share] = (symbols[:, per * ROWS :] >> np.uint64(13)).astype(np.uint8)
    if wide.any():
        own = windows(points, lengths)[which[wide]]
        keys[wide] = mix64(own ^ mix64(classes[wide].astype(np.uint64) + np.uint64(1))[:, None])
    return keys, sketch


def _least(bits: np.ndarray, score: np.ndarray, known: np.ndarray, more: np.ndarray, low: int) -> np.ndarray:
    """Edits that two texts have at least, by a column of their band: its differences up and down (pair, bit),
    the value ``score`` beside bit ``known``, and the characters that the second text is longer by."""
    kind = np.int16 if bits[0].shape[1] < 8192 else np.int32
    value = np.cumsum(bits[0].view(np.int8) - bits[1].view(np.int8), axis=1, dtype=kind)
    place = np.arange(value.shape[1], dtype=kind)
    least = score - value[np.arange(len(score)), known]
    value += np.abs((low - 1 - more).astype(kind)[:, None] - place)  # the rest takes the difference at least
    value[place > known.astype(kind)[:, None]] = np.iinfo(kind).max
    return least + value.min(axis=1)


def counted(a: str, b: str, most: int) -> int:
    """Edit distance of a and b, or most + 1 where it is more: a column at a time, as bits of a band
    along the diagonal (Myers, 1999; Hyyro, 2003) that holds every way of at most ``most`` edits, as one
    that leaves it has to come back; now and then its least value tells whether there still is such a way."""
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    most = min(most, n)
    if n - m > most:
        return most + 1
    if not m:
        return n
    points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = {chr(c): np.packbits(points == c, bitorder="little").tobytes() for c in np.unique(points).tolist()}
    high = (most - n + m) // 2  # rows of the band below the diagonal, and above it
    low = n - m + high + 1
    wide = low + high + 1
    full, corner, above = (1 << wide) - 1, 1 << (wide - 1), 1 << (wide - 2 - max(0, high - m))
    up, down, score = full ^ ((1 << low) - 1), 0, min(high, m)
    row = -low  # of the band's lowest bit
    bound = most + n - max(0, m - high)
    where: dict[str, int] = {}
    base = until = 0
    for j, c in enumerate(b):
        if j == until:  # the marks of the rows that the next columns' bands reach
            if j:
                bits = [np.unpackbits(np.frombuffer(x.to_bytes(wide // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[None, :wide] for x in (up, down)]
                if _least(bits, np.array([score]), np.array([min(high, m - j) + low - 1]), np.array([n - m]), low)[0] > most:
                    return most + 1
            base, until = max(0, row) // 8 * 8, j + 512
            where = {x: int.from_bytes(raw[base // 8 : (row + wide + 512) // 8 + 1], "little") for x, raw in marks.items()}
        same = where.get(c, 0)
        same = (same >> row - base if row >= base else same << base - row) & full
        level = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | (full & ~(level | up)), level & up
        if j < m - high:
            score += not level & corner
        else:
            score += bool(right & above) - bool(left & above)
            above >>= 1
        if score > bound:
            return most + 1
        level >>= 1
        up, down = left | (full & ~(level | right)), level & right
        row += 1
    return min(score, most + 1)


def _batch(texts: list[np.ndarray], first_of: np.ndarray, second_of: np.ndarray, most: np.ndarray, wide: int | None = None) -> np.ndarray:
    """Whether the edit distance of each pair of texts (code points), the first no longer, is at most ``most``.

    As counted(), a column at a time for all pairs at once; the band has 64 * wide rows, or as many words
    as the pairs need. Pairs of which the answer is known leave.
    """
    size = np.array([len(x) for x in texts], dtype=np.int64)
    m, n = size[first_of], size[second_of]
    low = int(((most + n - m) // 2).max()) + 1
    need = low + int(((most - n + m) // 2).max()) + 1
    wide = max(wide or 0, -(-need // 64))
    low += (64 * wide - need) // 2
    high = 64 * wide - 1 - low
    longest = int(n.max())
    points = np.concatenate(texts)
    seen = np.zeros(int(points.max()) + 1, dtype=bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    coded = np.split((np.cumsum(seen, dtype=np.int32) - 1)[points], np.cumsum(size)[:-1])
    begin: dict[int, tuple[int, int, np.ndarray]] = {}  # of a text: where its marks begin, words of a character, row by character
    marks: list[np.ndarray] = []
    base = 0
    for k in np.unique(first_of).tolist():
        known = np.flatnonzero(np.bincount(coded[k], minlength=len(alphabet)))
        words_ = -(-(len(texts[k]) + 128 * wide + 64) // 64)
        own = np.zeros((len(known) + 1, words_ * 64), dtype=bool)  # the last row is of characters that it lacks
        rows = np.full(len(alphabet), len(known), dtype=np.int64)
        rows[known] = np.arange(len(known))
        own[rows[coded[k]], np.arange(low, low + len(texts[k]))] = True
        marks.append(np.packbits(own, axis=1, bitorder="little").view(np.uint64).ravel())
        begin[k] = base, words_, rows
        base += own.shape[0] * words_
    codes = np.zeros((longest, len(most)), dtype=np.int32 if base < 1 << 31 else np.int64)  # where the marks of each column's character begin
    for k, (a, b) in enumerate(zip(first_of.tolist(), second_of.tolist())):
        at, words_, rows = begin[a]
        codes[: n[k], k] = at + rows[coded[b]] * words_
    bits = np.concatenate([*marks, np.zeros(longest // 64 + wide + 2, dtype=np.uint64)])  # ended pairs read on
    ones, top, one = ~np.uint64(0), np.uint64(63), np.uint64(1)
    up = np.zeros((wide, len(most)), dtype=np.uint64)
    up[low // 64] = ones << np.uint64(low % 64)
    up[low // 64 + 1 :] = ones
    down = np.zeros_like(up)
    out = np.zeros(len(most), dtype=bool)
    left_over, since = np.arange(len(most)), 0  # the pairs that are still in the columns; the column that codes begins with
    score = np.minimum(high, m)
    turn = m - high  # from this column on, the score goes along the last row
    first, reach = int(turn.min()), np.arange(wide + 1)[:, None]
    every = np.arange(len(most))
    for j in range(longest):
        if j and j % LOOK == 0:
            spread = [np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little") for x in (up, down)]
            ended = j >= n
            alive = ended | (_least(spread, score, np.clip(np.minimum(high, m - j) + low - 1, 0, None), n - m, low) <= most)
            alive &= ~ended
            if not alive.all() and (alive.sum() < 0.8 * len(alive)):
                out[left_over[ended]] = score[ended] <= most[ended]
                if not alive.any():
                    return out
                left_over, m, n, most, score, turn = (x[alive] for x in (left_over, m, n, most, score, turn))
                up, down, codes, since = up[:, alive], down[:, alive], codes[j - since :, alive], j
                first, every = int(turn.min()), np.arange(len(most))
        gone, r = divmod(j, 64)
        own = bits[codes[j - since] + (reach + gone)]
        if r:
            same = own[:-1] >> np.uint64(r) | own[1:] << np.uint64(64 - r)
        else:
            same = own[:-1]
        both = same & up
        total = both + up
        over = total < both
        for w in range(1, wide):
            carry = over[w - 1]
            total[w] += carry
            over[w] |= carry & (total[w] == 0)
        level = total ^ up | same | down
        right, left = down | ~(level | up), level & up
        if j < first:
            score += level[-1] >> top == 0
        else:
            early = j < turn
            score += early & (level[-1] >> top == 0)
            late = ~early & (j < n)
            place = np.where(late, m - 1 - j + low, 0)
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            score += np.where(late, (right[word, every] >> bit & one).astype(np.int64) - (left[word, every] >> bit & one).astype(np.int64), 0)
        level[:-1] = level[:-1] >> one | level[1:] << top
        level[-1] >>= one
        up, down = left | ~(level | right), level & right
    out[left_over] = score <= most
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def followed(a: str, b: str, most: int) -> bool:
    """Whether a walk along both texts, from one common run to the next close by, shows that ``most`` edits suffice; if not, they may all the same."""
    x, y = _points(a), _points(b)
    i = j = cost = 0
    while i < len(a) and j < len(b):
        many = min(512, len(a) - i, len(b) - j)
        other = np.flatnonzero(x[i : i + many] != y[j : j + many])
        same = int(other[0]) if len(other) else many
        i, j = i + same, j + same
        if same == many:
            continue
        for skip in range(RUN * 3):
            to = b.find(a[i + skip : i + skip + RUN], j, j + skip + RUN * 4)
            if to >= 0:
                break
        else:
            return False
        cost += max(skip, to - j)
        if cost > most:
            return False
        i, j = i + skip, to
    return cost + max(len(a) - i, len(b) - j) <= most


def near_pairs(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the edit distance of the texts a and b of each pair is at most a PART-th of the longer one."""
    size = np.array([len(x) for x in texts], dtype=np.int64)
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    most = size[b] // PART
    out = np.array([texts[x] == texts[y] for x, y in zip(a.tolist(), b.tolist())], dtype=bool)
    todo = np.flatnonzero(~out & (size[b] - size[a] <= most) & (most > 0))
    wide = most // 64 + 1
    part = (size[b] - size[a]) * 4 // (most + 1) if len(todo) > PAIRS // 8 else np.zeros(len(a), dtype=np.int64)  # a band holds their difference
    todo = todo[np.lexsort((size[b][todo], part[todo]))]
    part, wide = part[todo], wide[todo]
    at = 0
    while at < len(todo):
        end, most_wide = at + 1, max(int(wide[at]) + 1, int(wide[at]) * 5 // 4)
        while end < len(todo) and part[end] == part[at] and wide[end] <= most_wide and end - at < 4096 and (end - at) * int(size[b[todo[end]]]) < 2 * MARKS:
            end += 1
        own = todo[at:end]
        if len(own) < 60 + wide[end - 1]:  # too few for steps over all of them to pay
            out[own] = [followed(texts[a[k]], texts[b[k]], int(most[k])) or counted(texts[a[k]], texts[b[k]], int(most[k])) <= most[k] for k in own.tolist()]
        else:
            used, back = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
            out[own] = _batch([_points(texts[k]) for k in used.tolist()], back[: len(own)], back[len(own) :], most[own])
        at = end
    return out


def near(a: str, b: str) -> bool:
    return bool(near_pairs([a, b], np.array([0]), np.array([1]))[0])


def sign(rows: DataFrame) -> DataFrame:
    """(row, doc_id, digest, chars, keys, sketches, print) of (row, doc_id, text); keys are BANDS a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", BATCH_CHARS):
            points, lengths = code_points(part.column("text"))
            n = len(lengths)
            high, low = class_of(lengths), class_of(lengths - allowed(lengths))
            long = lengths >= SHORTEST
            two = long & (low != high)
            which = np.concatenate([np.flatnonzero(long), np.flatnonzero(two)])
            classes = np.concatenate([high[long], low[two]])
            order = np.argsort(which, kind="stable")  # each text's own class comes first
            keys, sketch = sampled(points, lengths, which[order], classes[order])
            count = np.bincount(which, minlength=n)
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH), len(sketch), [None, pa.py_buffer(np.ascontiguousarray(sketch).tobytes())]).cast(pa.binary())
            first = np.cumsum(count) - count
            take = pa.array(first, pa.int64(), mask=count == 0)
            yield pa.record_batch({"row": part.column("row"), "doc_id": part.column("doc_id"), "digest": part.column("digest"), "chars": pa.array(lengths), "keys": list_array(pa.array(keys.ravel().view(np.int64)), count * BANDS), "sketches": list_array(blob, count), "print": blob.take(take)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.where("text IS NOT NULL").select("row", "doc_id", digest("text").alias("digest"), "text")
    return held.mapInArrow(run, f"row long, doc_id {kind}, digest binary, chars long, keys array<long>, sketches array<binary>, print binary")


def candidates(reps: DataFrame, least: int = SKETCH // 4) -> DataFrame:
    """Of (row, chars, keys, sketches): (a, b) row pairs to verify first, and (key, row, chars) of the buckets of several rows; one of the two is null.

    A written table. Most keys occur once: all keys are shuffled without sketches, and sketches only for the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "key"):
            key = table.column("key").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(starts, len(key)))
            several = np.repeat(size > 1, size)
            if not several.any():
                continue
            table = table.filter(pa.array(several))
            size = size[size > 1]
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            nodes = table.column("row").to_numpy()
            a, b = graph.link([], sketches, nodes, np.cumsum(size) - size, least)
            none, other = pa.nulls(len(a), pa.int64()), pa.nulls(len(nodes), pa.int64())
            yield pa.record_batch({"a": pa.array(np.minimum(nodes[a], nodes[b])), "b": pa.array(np.maximum(nodes[a], nodes[b])), "key": none, "row": none, "chars": none})
            yield pa.record_batch({"a": other, "b": other, "key": pa.array(key[several]), "row": pa.array(nodes), "chars": table.column("chars").combine_chunks()})

    keys = reps.select("row", F.posexplode("keys").alias("k", "key")).select("key", "row", F.floor(F.col("k") / BANDS).cast("int").alias("k"))
    shared = written(keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "row", "k"))
    entries = shared.join(reps.select("row", "chars", "sketches"), "row").select("key", "row", "chars", F.get("sketches", "k").alias("sketch"))
    out = written(entries.repartition("key").sortWithinPartitions("key", "sketch", "row").mapInArrow(run, "a long, b long, key long, row long, chars long"))
    forget(shared)
    return out


def wanted(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, text) of the rows whose digest may be among ``digests``: all that are, and few others while the bitmap is sparse."""
    place = F.pmod(F.xxhash64("digest"), F.lit(BITMAP))
    bits = digests.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    own = rows.where("text IS NOT NULL").select(digest("text").alias("digest"), "text").withColumn("p", place)
    own = own.withColumn("bucket", F.expr("bitmap_bucket_number(p)")).join(F.broadcast(bits), "bucket")  # BITMAP bits at most, at any size
    return own.where("(shiftright(cast(conv(hex(substring(bits, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(p) % 8 as int)) & 1) = 1").select("digest", "text")


def verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near by exact edit distance, as a written table."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n = part.num_rows
            ok = pa.array(near_pairs(part.column("ta").to_pylist() + part.column("tb").to_pylist(), np.arange(n), np.arange(n, 2 * n)))
            yield pa.record_batch({"a": part.column("a").filter(ok), "b": part.column("b").filter(ok)})

    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(reps.select("row", "digest"), "row"))
    texts = wanted(rows, nodes.select("digest")).groupBy("digest").agg(F.first("text").alias("text"))
    named = nodes.join(texts, "digest").select("row", "text")
    held = pairs.join(named.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a").join(named.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b")
    out = written(held.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"))
    forget(nodes)
    return out


def profiles(texts: pa.Array) -> np.ndarray:
    """Counts of each text's 3-grams in BINS bins, 255 at most; an edit changes six places by one at most."""
    points, lengths = code_points(texts)
    out = np.zeros((len(lengths), BINS), dtype=np.uint8)
    if len(points) < 3:
        return out
    x = points.astype(np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = (mix64((x[:-2] * odd + x[1:-1]) * odd + x[2:]) % np.uint64(BINS)).astype(np.int64)
    text = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[: len(h)]
    inside = np.arange(len(h), dtype=np.int64) + 3 <= np.cumsum(lengths)[text]
    for at in range(0, len(lengths), 512):
        own = inside & (text >= at) & (text < at + 512) if len(lengths) > 512 else inside
        many = min(512, len(lengths) - at)
        out[at : at + many] = np.minimum(np.bincount((text[own] - at) * BINS + h[own], minlength=many * BINS), 255).reshape(many, BINS)
    return out


def tasks(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(task, side, row, root, chars, size): the rows of buckets that have several groups, in order of length.

    Buckets with the same most frequent group are taken together, so that two texts meet once however
    many buckets they share. More than BLOCK rows give a task for each two blocks whose lengths may be
    near; side is null in a block's own task.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "key"):
            key, root = table.column("key").to_numpy(), table.column("root").to_numpy()  # sorted by both
            head = np.flatnonzero((key[1:] != key[:-1]) | (root[1:] != root[:-1])) + 1
            head = np.concatenate([[0], head])
            count = np.diff(np.append(head, len(key)))
            order = np.lexsort((root[head], -count, key[head]))
            first = order[np.concatenate([[True], key[head][order][1:] != key[head][order][:-1]])]  # the most frequent root of each key
            mixed = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[head][1:] != key[head][:-1]])), len(head))) > 1
            many = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)))
            keep = np.repeat(mixed, many)
            yield pa.record_batch({"lead": pa.array(np.repeat(root[head][first], many)[keep]), **{c: table.column(c).combine_chunks().filter(pa.array(keep)) for c in ("row", "root", "chars")}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "lead"):
            key, row, root, chars = (table.column(c).to_numpy() for c in ("lead", "row", "root", "chars"))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            where, i, j, side, size = [], [], [], [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                cuts, room = [s], 0
                for x in range(s, e):  # a block has so many rows and so many characters at most, or one row
                    if x > cuts[-1] and (x - cuts[-1] == BLOCK or room + chars[x] > MARKS):
                        cuts, room = [*cuts, x], 0
                    room += chars[x]
                blocks = [np.arange(x, y) for x, y in zip(cuts, [*cuts[1:], e])]
                for k, one in enumerate(blocks):
                    for m, two in enumerate(blocks[k:], k):
                        if chars[two[0]] - chars[one[-1]] > chars[two[0]] // PART:
                            break  # later blocks hold longer texts
                        at = one if k == m else np.concatenate([one, two])
                        where.append(at)
                        size.append(np.full(len(at), e - s))
                        i.append(np.full(len(at), k))
                        j.append(np.full(len(at), m))
                        side.append(np.full(len(at), -1) if k == m else np.repeat([0, 1], [len(one), len(two)]))
            if where:
                at, i, j, side, size = (np.concatenate(x) for x in (where, i, j, side, size))
                yield pa.record_batch({"lead": pa.array(key[at]), "i": pa.array(i), "j": pa.array(j), "side": pa.array(side, mask=side < 0), "row": pa.array(row[at]), "root": pa.array(root[at]), "chars": pa.array(chars[at]), "size": pa.array(size)})

    known = members.join(roots.withColumnRenamed("node", "row"), "row", "left").select("key", "row", F.coalesce("root", "row").alias("root"), "chars")
    led = known.repartition("key").sortWithinPartitions("key", "root", "row").mapInArrow(lead, "lead long, row long, root long, chars long").distinct()
    found = led.repartition("lead").sortWithinPartitions("lead", "chars", "row").mapInArrow(run, "lead long, i long, j long, side long, row long, root long, chars long, size long")
    return found.select(F.xxhash64("lead", "i", "j").alias("task"), "side", "row", "root", "chars", "size")


def parts(df: DataFrame) -> int:
    """Partitions of tasks: as many as are set, since their work does not follow the bytes by which small ones are put together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def close(held: DataFrame, pairs: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, ra, rb, apart, task): pairs of the tasks' rows of unlike groups that their lengths and profiles let be near, as a written table.

    No near pair is left out but those of ``pairs``, whose distances are known. A pair of several tasks is given to that of the most rows, so that
    few tasks need a text.
    """

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            own = profiles(part.column("text"))
            yield pa.record_batch({"digest": part.column("digest"), "profile": pa.FixedSizeBinaryArray.from_buffers(pa.binary(BINS), len(own), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "task"):
            task, row, root, chars, size = (table.column(c).to_numpy() for c in ("task", "row", "root", "chars", "size"))
            side = table.column("side").fill_null(-1).to_numpy()
            own = np.frombuffer(b"".join(table.column("profile").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            one, two, apart = [], [], []
            for s, e in zip(cuts, cuts[1:]):
                for k in range(s, e - 1):  # in order of length
                    most = chars[k + 1 : e] // PART
                    ask = np.flatnonzero((chars[k + 1 : e] - chars[k] <= most) & (root[k + 1 : e] != root[k]) & ((side[k + 1 : e] < 0) | (side[k + 1 : e] != side[k])))
                    for at in range(0, len(ask), BLOCK):
                        which = ask[at : at + BLOCK]
                        other = own[k + 1 + which]
                        far = (np.maximum(other, own[k]) - np.minimum(other, own[k])).sum(axis=1, dtype=np.int64)
                        hit = far <= 6 * most[which]
                        one.append(np.full(int(hit.sum()), k))
                        two.append(k + 1 + which[hit])
                        apart.append(far[hit])
            if one:
                one, two, apart = (np.concatenate(x) for x in (one, two, apart))
                one, two = np.where(row[one] < row[two], one, two), np.where(row[one] < row[two], two, one)
                yield pa.record_batch({"a": pa.array(row[one]), "b": pa.array(row[two]), "ra": pa.array(root[one]), "rb": pa.array(root[two]), "apart": pa.array(apart), "size": pa.array(size[one]), "task": pa.array(task[one])})

    nodes = written(held.select("row").distinct().join(reps.select("row", "digest"), "row"))
    made = wanted(rows, nodes.select("digest")).groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(profile, "digest binary, profile binary")
    known = nodes.join(made, "digest").select("row", "profile")
    found = held.join(known, "row").select("task", "side", "row", "root", "chars", "size", "profile").repartition(parts(held), "task").sortWithinPartitions("task", "chars", "row").mapInArrow(compare, "a long, b long, ra long, rb long, apart long, size long, task long")
    once = found.groupBy("a", "b", "ra", "rb", "apart").agg(F.max(F.struct("size", "task")).alias("t")).select("a", "b", "ra", "rb", "apart", "t.task")
    out = written(once.join(pairs, ["a", "b"], "left_anti"))
    forget(nodes)
    return out


def joined(left: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): near pairs of close(), as many as join all texts that they can, as a written table; a task has the texts of its pairs, once each."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in graph.by_region(batches, "task"):
            task = table.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for s, e in zip(cuts, cuts[1:]):
                own = table.slice(s, e - s)
                held = own.filter(pa.compute.is_valid(own.column("text")))
                pairs = own.filter(pa.compute.is_null(own.column("text"))).sort_by([("apart", "ascending"), ("a", "ascending"), ("b", "ascending")])
                number = held.column("a").to_numpy()
                order = np.argsort(number)
                a, b, ra, rb = (pairs.column(c).to_numpy() for c in ("a", "b", "ra", "rb"))
                texts = held.column("text").to_pylist()
                todo = np.arange(len(a))
                while len(todo):  # the closest first: what they join need not be asked for
                    now, todo = todo[:PAIRS], todo[PAIRS:]
                    at, to = (order[np.searchsorted(number[order], x[now])] for x in (a, b))
                    hit = now[near_pairs(texts, at, to)]
                    if len(hit):
                        yield pa.record_batch({"a": pa.array(a[hit]), "b": pa.array(b[hit])})
                        same = graph.merged(np.concatenate([ra, rb]), ra[hit], rb[hit])
                        ra, rb = same[: len(a)], same[len(a) :]
                        todo = todo[ra[todo] != rb[todo]]

    nodes = written(left.select("task", F.explode(F.array("a", "b")).alias("row")).distinct().join(reps.select("row", "digest"), "row"))
    texts = wanted(rows, nodes.select("digest")).groupBy("digest").agg(F.first("text").alias("text"))
    none = F.lit(None).cast("long")
    both = nodes.join(texts, "digest").select("task", F.col("row").alias("a"), none.alias("b"), none.alias("ra"), none.alias("rb"), none.alias("apart"), "text")
    both = both.unionByName(left.select("task", "a", "b", "ra", "rb", "apart", F.lit(None).cast("string").alias("text")))
    out = written(both.repartition(parts(left), "task").sortWithinPartitions("task").mapInArrow(check, "a long, b long"))
    forget(nodes)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, group_id) of each document; group_id is null where no other is near."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(sign(rows))
    folded = signed.groupBy("digest").agg(F.min("row").alias("row"), F.first("chars").alias("chars"), F.first("keys").alias("keys"), F.first("sketches").alias("sketches"))
    bands = written(folded)
    prints = written(signed.select("doc_id", "digest", "print"))
    forget(signed)  # keys and sketches are the bulk of what is stored
    found = candidates(bands)
    reps = written(bands.select("row", "digest"))
    forget(bands)
    pairs = written(found.where("a IS NOT NULL").select("a", "b").distinct())
    edges = verified(pairs, reps, rows)
    roots = graph.components(edges)
    held = written(tasks(found.where("key IS NOT NULL").select("key", "row", "chars"), roots))
    forget(found)
    left = close(held, pairs, reps, rows)
    forget(held, pairs)
    more = joined(left, reps, rows)
    forget(left)
    if not more.isEmpty():
        roots = graph.components(edges.unionByName(more))
    forget(edges, more)
    placed = reps.select("digest", "row").join(roots.withColumnRenamed("node", "row"), "row", "left").select("digest", F.coalesce("root", "row").alias("root"))
    member = prints.join(placed, "digest")
    groups = member.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))).alias("least")).where("n > 1").select("root", F.col("least.doc_id").alias("group_id"))
    known = member.join(groups, "root", "left").select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "group_id")
    none = rows.where("text IS NULL").select("doc_id", F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast(docs.schema[id_col].dataType).alias("group_id"))
    return known.unionByName(none)
