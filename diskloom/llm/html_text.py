"""Main-content extraction from HTML by two passes of block rules.

Markup is cut into blocks at block-level tags. The first pass classes each block by its length,
its stop-word density and its link density as good, near-good, short or bad. The second pass
gives ambiguous blocks (short and near-good) the label of their nearest decided neighbours:
a short block between two good ones is good, between two bad ones bad; between unlike ones it is
good only beside a near-good one on its bad side. Near-good blocks are good unless both
neighbours are bad; the edges of the document count as bad.

Defined results: null html gives null text and no blocks; empty html or html without a good block
gives an empty text; unclosed or crossed tags end where their block does; script, style, title,
form lists, comments and templates hold no text (``markup`` says how far they go); links inside links
count once. Pages may be of any length, with time in proportion. At equal distance both neighbours
count, as above. Null and repeated ids and repeated pages are rows like any other; other columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .markup import tokens

MAX_LINK_DENSITY = 0.2
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.18
#: Function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a and are as at be by for from has he in is it of on or that the this to was were which with what when not but you all his her "
    "aber als am an auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nicht noch sich sie sind so um und von war wie zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sur un une vous y "
    "al como con de del el ella en entre es esta este fue ha han la las le lo los más me mi no o para pero por que se si sin sobre su sus también un una y ya".split()
)
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


def blocks(source: str) -> list[tuple[str, str, int]]:
    """(tag, text, characters inside links) of each block in order; blocks without text are left out."""
    found: list[tuple[str, str, int]] = []
    parts: list[str] = []
    tag, linked, link = "body", 0, 0

    def end() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            found.append((tag, text, min(linked, len(text))))
        parts, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece)
        parts.append(piece)
        if link:
            linked += len(_SPACE.sub(" ", piece).strip())

    for text, name, closing, _ in tokens(source):
        if text:
            add(text)
        if name in BLOCKS:
            end()
            if name != "br":
                tag = "body" if closing else name
        elif name == "a":
            link = 0 if closing else 1
        elif not name:
            parts.append(" ")
    end()
    return found


def first_pass(text: str, linked: int) -> str:
    """good, near, short or bad by link density, length and stop-word density."""
    size = len(text)
    if linked / size > MAX_LINK_DENSITY:
        return "bad"
    if "\xa9" in text:
        return "bad"
    if size < LENGTH_LOW:
        return "bad" if linked else "short"
    words = _WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if density >= STOP_HIGH:
        return "good" if size > LENGTH_HIGH else "near"
    return "near" if density >= STOP_LOW else "bad"


def second_pass(labels: list[str], tags: list[str] | None = None) -> list[bool]:
    """Whether each block is content, once ambiguous ones have their neighbours' labels."""
    n = len(labels)

    def nearest(kinds: tuple[str, ...]) -> tuple[list[str], list[str]]:
        before, after = ["bad"] * n, ["bad"] * n
        last = "bad"
        for k in range(n):
            before[k] = last
            last = labels[k] if labels[k] in kinds else last
        last = "bad"
        for k in range(n - 1, -1, -1):
            after[k] = last
            last = labels[k] if labels[k] in kinds else last
        return before, after

    decided = ("good", "bad")
    plain, wide = nearest(decided), nearest((*decided, "near"))
    out = list(labels)
    for k in range(n):
        if labels[k] == "short":
            left, right = plain[0][k], plain[1][k]
            if left == right:
                out[k] = left
            else:
                side = wide[0][k] if left == "bad" else wide[1][k]
                out[k] = "good" if side == "near" else "bad"
    after = ["bad"] * n
    for k in range(n - 2, -1, -1):
        after[k] = out[k + 1] if out[k + 1] in decided else after[k + 1]
    last = "bad"
    for k in range(n):
        if out[k] == "near":
            out[k] = "bad" if last == after[k] == "bad" else "good"
        last = out[k]
    if tags:
        for k in range(n):  # a heading goes with the content that follows it
            if tags[k][:1] == "h" and tags[k][1:].isdigit() and labels[k] == "short" and out[k] == "bad":
                out[k] = "good" if plain[1][k] == "good" else "bad"
    return [x == "good" for x in out]


def extract(source: str | None) -> tuple[str | None, int, int]:
    """(text, blocks, blocks kept)."""
    if source is None:
        return None, 0, 0
    found = blocks(source)
    keep = second_pass([first_pass(text, linked) for _, text, linked in found], [tag for tag, _, _ in found])
    return "\n".join(text for (_, text, _), ok in zip(found, keep) if ok), len(found), sum(keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url: Column | None = None) -> DataFrame:
    """(page_id, content, n_blocks, n_kept), one row for each page; a narrow stage over two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            rows = [extract(x) for x in part.column("html").to_pylist()]
            yield pa.record_batch({
                "page_id": part.column("page_id"),
                "content": pa.array([x[0] for x in rows], pa.string()),
                "n_blocks": pa.array(np.array([x[1] for x in rows], dtype=np.int32)),
                "n_kept": pa.array(np.array([x[2] for x in rows], dtype=np.int32)),
            })

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, content string, n_blocks int, n_kept int")
