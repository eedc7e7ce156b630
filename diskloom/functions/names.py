"""Host file names for directory entries, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charset import PC98, PC6001, encode_char

UNSAFE = "<>[]|¦\\¥/:;,+=*?\x7f" + '"'
RESERVED = ["NUL", "AUX", "CON", "CLOCK$", "PRN", *(f"{p}{n}" for p in ("COM", "LPT") for n in range(1, 10))]
#: Bits of an entry's attribute byte, then the two marks in its first byte.
ATTRIBUTES = {0x01: "Binary", 0x02: "Reserved#1", 0x04: "Reserved#2", 0x08: "Reserved#3", 0x10: "Read-Only", 0x20: "Obfuscated", 0x40: "Read-after-Write", 0x80: "Non-ASCII", 0x100: "Deleted(00)", 0x200: "Unused(FF)"}
BINARY, OBFUSCATED, NON_ASCII, DELETED, UNUSED = (ATTRIBUTES[k] for k in (0x01, 0x20, 0x80, 0x100, 0x200))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def attributes(mask: Column) -> Column:
    """Sorted names of the bits that are set."""
    return F.array_sort(F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in ATTRIBUTES.items()])))


def _quotes(charset: str) -> Column:
    """Percent form by character."""
    chars = [chr(c) for c in (*range(0x20, 0x80), 0xA5, 0xA6, *range(0xF8F0, 0xF8F8))]
    known = {c: "".join(f"%{b:02X}" for b in raw) for c in chars if (raw := encode_char(c, charset)) is not None}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])


def _suffix(attrs: Column, natural: Column) -> Column:
    def has(name: str) -> Column:
        return F.array_contains(attrs, name)

    neither = ~has(NON_ASCII) & ~has(BINARY)
    rules = [("---", has(UNUSED)), ("vfy", has(ATTRIBUTES[0x40])), *((f"r-{k + 1}", has(ATTRIBUTES[2 << k])) for k in range(3)), ("r-o", has(ATTRIBUTES[0x10]))]
    rules += [("bas", has(NON_ASCII) & ~natural.isin("hd", "nip", "n88", "bas")), ("bin", has(BINARY) & ~natural.isin("cod", "bin")), ("asc", neither & ~natural.isin("txt", "asc"))]
    rules += [("era", has(DELETED)), ("obf", has(OBFUSCATED))]
    return F.array_join(F.array_compact(F.array(*[F.when(rule, tag) for tag, rule in rules])), ".")


def host_name(name: Column, ext: Column, attrs: Column, charset: Column | str) -> Column:
    """A name that any file system takes: unsafe characters are percent-quoted, attributes become suffixes."""
    quotes = {k: _quotes(k) for k in (PC98, PC6001)}
    table = quotes[charset] if isinstance(charset, str) else F.when(charset == PC6001, quotes[PC6001]).otherwise(quotes[PC98])
    base, tail = F.rtrim(name), F.rtrim(ext)
    whole = F.concat(base, F.when(tail != "", ".").otherwise(""), tail)

    def quoted(full: Column) -> Column:
        last = F.length(full) - 1

        def char(c: Column, i: Column) -> Column:
            bad = c.isin(*UNSAFE, "%") | (c < " ") | F.upper(full).isin(*RESERVED) | ((i == 0) & (F.ltrim(full, F.lit(".")) == ""))
            bad |= ((c == ".") & (i != F.length(base))) | ((i == 0) & (c == " ")) | ((i == last) & c.isin(" ", ".")) | c.between("\ue000", "\uf8ff")
            return F.when(bad, F.coalesce(F.try_element_at(table, c), c)).otherwise(c)

        return F.when(full == "", "").otherwise(F.array_join(F.transform(F.split(full, ""), char), ""))

    def finished(host: Column) -> Column:
        own = F.when((host == "") | host.startswith("."), F.concat(F.lit("(empty)"), host)).otherwise(host)
        natural = F.lower(F.replace(F.substr(own, F.length(F.substring_index(own, ".", 1)) + 2), F.lit("."), F.lit("")))
        suffix = _suffix(attrs, natural)
        return F.concat(own, F.when(suffix == "", "").when(own.contains("."), F.concat(F.lit("."), suffix)).otherwise(F.concat(F.lit(".."), suffix)))

    return let(let(whole, quoted), finished)


def extended(name: Column, tail: Column) -> Column:
    """The tail put in before the first dot."""
    first = F.substring_index(name, ".", 1)
    return F.concat(first, tail, F.substr(name, F.length(first) + 1))


def free_name(name: Column, used: Column) -> Column:
    """The name, or with the first free number from 2; names are compared without case."""
    def taken(candidate: Column) -> Column:
        return F.array_contains(used, F.lower(candidate))

    def numbered(n: Column) -> Column:
        return extended(name, F.concat(F.lit(" ("), n.cast("string"), F.lit(")")))

    first = F.get(F.filter(F.sequence(F.lit(2), F.size(used) + 2), lambda n: ~taken(numbered(n))), F.lit(0))
    return F.when(~taken(name), name).otherwise(numbered(first))


def quoted_if_odd(name: Column) -> Column:
    """In quotation marks where a character is blank, a control or beyond ASCII."""
    return F.when(F.regexp_like(name, F.lit(r"[^\x21-\x7e]")), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)


def dump_name(name: Column) -> Column:
    """File name of a text dump: the last dot becomes an underscore."""
    return F.concat(F.regexp_replace(name, r"\.([^.]*)\z", "_$1"), F.lit("_utf8_dump.txt"))
