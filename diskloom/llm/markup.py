"""A forgiving reader of HTML markup whose time grows with the length of the page only.

A tag is ``<``, a slash perhaps, a letter and what follows up to the next ``>``; a quotation mark
behind an equals sign hides every ``>`` up to its fellow. A mark without a fellow hides nothing, and
a tag without an end runs to the end of the page. Comments, declarations and the elements of
``drop`` are passed over with what they hold; without their end, comments and ``RAW`` elements run
to the end of the page, other elements to the end of their own tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

RAW = frozenset("script style textarea title".split())
DROP = RAW | frozenset("noscript template svg select iframe object".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")


@lru_cache(maxsize=64)
def _ending(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?![a-zA-Z0-9:-])", re.I)


def tokens(source: str, drop: frozenset[str] = DROP) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, name, closing, attributes) of each tag in order, its name in lower case.

    What is passed over gives its text before and no name; so does the end of the page.
    """
    last = {q: source.rfind(q) for q in "\"'"}
    endless: set[str] = set()
    size, at = len(source), 0

    def end_of_tag(k: int) -> tuple[int, int]:
        while m := _STOP.search(source, k):
            if not m[1]:
                return m.start(), m.end()
            k = m.end() if last[m[1]] < m.end() else source.index(m[1], m.end()) + 1
        return size, size

    while m := _OPEN.search(source, at):
        text = source[at : m.start()]
        if m[1] or m[2]:
            end = source.find("-->" if m[1] else ">", m.end())
            at = size if end < 0 else end + (3 if m[1] else 1)
            yield text, "", False, ""
            continue
        name = m[4].lower()
        stop, at = end_of_tag(m.end())
        if name not in drop or m[3]:
            yield text, "" if name in drop else name, bool(m[3]), source[m.end() : stop]
            continue
        found = None if name in endless else _ending(name).search(source, at)
        if found:
            at = end_of_tag(found.end())[1]
        else:
            endless.add(name)
            at = size if name in RAW else at
        yield text, "", False, ""
    yield source[at:], "", False, ""


def attributes(inside: str) -> dict[str, str]:
    """Values by lower-case name, as they are written; of equal names the first."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(inside):
        out.setdefault(name.lower(), next((v for v in values if v), ""))
    return out
