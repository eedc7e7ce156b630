"""The two 8-bit Japanese character sets as column expressions.

Decoding stays in the JVM: bytes read as Latin-1 are translated by one literal table. Encoding
has a JVM path for text that the table holds, and an Arrow function for the rest, since Spark
has no Unicode normaliser.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PC98, PC6001 = "pc98-8bit", "pc6001-8bit"
#: Bytes that decoding leaves as control characters, by mode.
PRESERVE = {"none": b"", "minimal": bytes([0, 10, 13, 26, 127]), "ascii": bytes([*range(32), 127])}


def _chars(spec: str) -> str:
    """Characters from hexadecimal code points and ranges such as 2581-2588; a range may fall."""
    out = []
    for part in spec.split():
        a, _, b = part.partition("-")
        low, high = int(a, 16), int(b or a, 16)
        out += range(low, high + 1) if low <= high else range(low, high - 1, -1)
    return "".join(map(chr, out))


_LOW = _chars("2400-241B FFEB FFE9-FFEA FFEC 20-5B A5 5D-7B A6 7D-7E 2421")
_KANA = _chars("F8F0 FF61-FF9F")
TABLES = {
    PC98: _LOW + _chars("2581-2588 258F-2589 253C 2534 252C 2524 251C 2594 2500 2502 2595 250C 2510 2514 2518 256D-256E 2570 256F") + _KANA
    + _chars("2550 255E 256A 2561 25E2-25E3 25E5-25E4 2660 2665-2666 2663 2022 FFEE 2571-2573 5186 5E74 6708 65E5 6642 5206 79D2 F8F4-F8F7 5C F8F1-F8F3"),
    PC6001: _LOW + _chars("2660 2665-2666 2663 FFEE 2022 3092 3041 3043 3045 3047 3049 3083 3085 3087 3063 F8F4 3042 3044 3046 3048 304A-304B 304D 304F 3051 3053 3055 3057 3059 305B 305D") + _KANA
    + _chars("305F 3061 3064 3066 3068 306A-306F 3072 3075 3078 307B 307E-3082 3084 3086 3088-308D 308F 3093 F8F2-F8F3"),
}
#: What the byte 14 turns 30..4F into, in the second set.
ALTERNATES = _chars("F8F1 6708 706B 6C34 6728 91D1 571F 65E5 5E74 5186 6642 5206 79D2 767E 5343 4E07 3C0 2534 252C 2524 251C 253C 2502 2500 250C 2510 2514 2518 2573 5927 4E2D 5C0F")
assert all(len(x) == 256 for x in TABLES.values()) and len(ALTERNATES) == 32
_VOICED, _SEMI = "ﾞ", "ﾟ"
#: A mark that makes no single letter becomes a combining one, on a composed letter too.
COMBINING = ((_VOICED, "゙"), (_SEMI, "゚"))


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _translated(text: Column, charset: str, preserve: str) -> Column:
    """Latin-1 text by the table of a set; its 0 bytes come last, as a translation can't hold them."""
    kept = PRESERVE[preserve]
    source = "".join(chr(b) for b in range(256) if b not in kept)
    target = "".join(TABLES[charset][b] for b in range(256) if b not in kept)
    return F.translate(text, source, target)


def decode_pc98(data: Column, preserve: str = "minimal") -> Column:
    return _translated(latin(data), PC98, preserve)


@lru_cache(maxsize=None)
def composed() -> list[tuple[str, str]]:
    """Hiragana with a sound mark behind it, and the single letter that they make."""
    pairs = [base + mark for base in map(chr, range(0x3041, 0x3097)) for mark in (_VOICED, _SEMI)]
    return [(pair, whole) for pair in pairs if len(whole := unicodedata.normalize("NFKC", pair)) == 1]


def decode_pc6001(data: Column, preserve: str = "minimal") -> Column:
    """As decode_pc98(), then alternates after a raw 14 and sound marks on hiragana."""
    text = latin(data)
    for k, char in enumerate(ALTERNATES):
        text = F.replace(text, F.lit("\x14" + chr(0x30 + k)), F.lit(char))
    text = _translated(text, PC6001, preserve)
    for pair, whole in composed():
        text = F.replace(text, F.lit(pair), F.lit(whole))
    for mark, combining in COMBINING:
        text = F.regexp_replace(text, f"([ぁ-ゖ]){mark}", f"$1{combining}")
    return text


def decode(data: Column, charset: str | Column, preserve: str = "minimal") -> Column:
    if isinstance(charset, str):
        return decode_pc98(data, preserve) if charset == PC98 else decode_pc6001(data, preserve)
    return F.when(charset == PC98, decode_pc98(data, preserve)).when(charset == PC6001, decode_pc6001(data, preserve))


def glyphs(data: Column, charset: str | Column) -> Column:
    """One character for each byte, as it is shown after the byte before it; what has no picture is a dot.

    A byte that makes a letter together with the one before it shows that letter; the whole text is
    translated at once, not byte by byte.
    """
    if not isinstance(charset, str):
        return F.when(charset == PC98, glyphs(data, PC98)).when(charset == PC6001, glyphs(data, PC6001))
    text = latin(data)
    if charset == PC6001:
        for k in range(len(ALTERNATES)):  # kept apart from the table's characters until the marks are done
            text = F.replace(text, F.lit("\x14" + chr(0x30 + k)), F.lit("\x14" + chr(0xE000 + k)))
    text = _translated(text, charset, "none")
    if charset == PC6001:
        whole = dict(composed())
        shown = "".join(map(chr, range(0xE000, 0xE000 + len(ALTERNATES))))
        made = ALTERNATES
        for mark, combining in COMBINING:
            text = F.regexp_replace(text, f"([ぁ-ゖ]){mark}", "$1" + combining)
            for base in sorted(b for b in TABLES[PC6001] if b + mark in whole):
                at = chr(0xE100 + len(shown))
                text = F.replace(text, F.lit(base + combining), F.lit(base + at))
                shown, made = shown + at, made + whole[base + mark]
        text = F.translate(text, shown, made)
    return F.regexp_replace(text, "[\\x00-\\x1f\\x7f\\ue000-\\uf8ff]", ".")


@lru_cache(maxsize=None)
def _codes(charset: str) -> dict[str, bytes]:
    """Bytes of each character of a set, and of its compatibility decomposition."""
    own = {c: bytes([b]) for b, c in enumerate(TABLES[charset])}
    if charset == PC6001:
        own |= {c: bytes([0x14, 0x30 + k]) for k, c in enumerate(ALTERNATES)}
    wide = {n: b for c, b in own.items() if (n := unicodedata.normalize("NFKD", c)) != c}
    wide |= {"゛": own[_VOICED], "゜": own[_SEMI], "ー": own["ｰ"]}
    return wide | own


def _one(char: str, charset: str, forms: tuple[str, ...]) -> bytes | None:
    codes = _codes(charset)
    for form in ("", *forms):
        c = unicodedata.normalize(form, char) if form else char
        found = codes.get(c) or (c.encode() if len(c) == 1 and c < "\x80" else None)
        if found is not None:
            return found
    return None


@lru_cache(maxsize=None)
def encode_char(char: str, charset: str, try_harder: bool = True) -> bytes | None:
    """Bytes of one character, or None where the set has none."""
    name = unicodedata.name(char, "")
    scripts = ("KATAKANA LETTER",) if charset == PC98 else ("KATAKANA LETTER", "HIRAGANA LETTER")
    parts = unicodedata.normalize("NFKD", char) if name.startswith(scripts) else {"〜": "~", "‐": "-"}.get(char, char)
    forms = () if not try_harder else ("NFKD",) if charset == PC98 else ("NFKD", "NFC")
    found = [_one(c, charset, forms) for c in parts]
    return None if None in found else b"".join(found)


def encode_text(text: str, charset: str, try_harder: bool = True) -> bytes | None:
    """The whole text, or None where a character has no bytes."""
    found = [encode_char(c, charset, try_harder) for c in text]
    return None if None in found else b"".join(found)


def unmapped(text: Column, charset: str) -> Column:
    """How many characters of a text are neither in the table nor in ASCII; one hash lookup for each."""
    known = TABLES[charset] + "".join(chr(b) for b in range(128) if chr(b) not in TABLES[charset])
    return F.length(F.translate(text, known, ""))


def encode_fast(text: Column, charset: str) -> Column:
    """JVM encoding of text whose characters all are in the table or in ASCII; null for other text."""
    table = TABLES[charset]
    made = F.translate(text, table[1:], "".join(map(chr, range(1, 256))))
    made = F.replace(made, F.lit(table[0]), F.lit("\0"))  # a translation to the character 0 would delete it
    return F.when(unmapped(text, charset) == 0, F.encode(made, "ISO-8859-1"))


def encode(text: Column, charset: str, try_harder: bool = True, errors: str = "null") -> Column:
    """Bytes of a text column; with errors="raise" text that can't be encoded fails the query.

    What the first set's table holds as it is stays in the JVM: Python is given nulls for it.
    """

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        out = [None if x is None else encode_text(x, charset, try_harder) for x in column]
        if errors == "raise":
            for x, y in zip(column, out):
                if x is not None and y is None:
                    at = next(k for k, c in enumerate(x) if encode_char(c, charset, try_harder) is None)
                    raise ValueError(f"no {charset} bytes for U+{ord(x[at]):04X} at {at}")
        return pd.Series(out, dtype=object)

    if charset != PC98:  # of the second set some characters of the table have alternates
        return run(text)
    fast = encode_fast(text, charset)
    return F.coalesce(fast, run(F.when(fast.isNull(), text)))


def decode_bytes(data: bytes, charset: str, preserve: str = "minimal") -> str:
    """decode() for one value in a Python worker."""
    table, kept = TABLES[charset], PRESERVE[preserve]
    if charset == PC98:
        return "".join(chr(b) if b in kept else table[b] for b in data)
    out: list[str] = []
    for k, b in enumerate(data):
        if k and data[k - 1] == 0x14 and 0x30 <= b < 0x50:
            out[-1] = ALTERNATES[b - 0x30]
            continue
        c = chr(b) if b in kept else table[b]
        if c in (_VOICED, _SEMI) and out and "ぁ" <= out[-1] <= "ゖ":
            out += unicodedata.normalize("NFKC", out.pop() + c)
        else:
            out.append(c)
    return "".join(out)
