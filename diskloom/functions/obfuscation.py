"""The reversible obfuscation of protected BASIC saves as column expressions over binary columns."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charset import latin

PC98, PC88 = "pc98", "pc88"
#: The 143-byte keys: of the PC-88, and of a later DOS BASIC with the same method.
KEYS = {
    PC88: base64.b64decode("wM/MhWKBDELDBOXmzRF1tpDklzXtsvxuN3drYDCG3ThEFTkt1E1i7XYJKazAz8SDV8HLdNTZeNEnEXW+ltHX8tulIfMAnWtgOIDoeIMjLvBJeojtdgEvmYAI8pSKXPye1Nlw1xJRsoiBDErFMaUh+waoK6cOlzXltMku8EF8va2xNzhEHT8YlIpU+quUHkY="),
    "gwbasic": base64.b64decode("4Elnt0at7F3pg/WQF4yTDVWmawnmFZ1j/M3ice2TR9T1toPHuZIvArcQLLvsY6JZrVty6eMQ9AQtmLnMu02dk1IfIGZw9/5bLH2wJm9qiUzABhUencnGVPb5FlMiXubT/yY11sZiI4CxwpwHbAP2o4IgDMGgdyMj+0SVYnns/uwHfdDf/W0wTwybDDwJwIE="),
}
# The byte 0 stays itself and must be left out: a translation to the character 0 would delete it.
_ROTATED = "".join(chr(b << 1 & 255 | b >> 7) for b in range(1, 256))
_PLAIN = "".join(map(chr, range(1, 256)))


def _bytewise(data: Column, change) -> Column:
    """Each byte by change(byte, offset), without leaving the JVM."""
    text = latin(data)
    made = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.chr(change(F.ascii(c), i))), "")
    return F.when(F.length(text) == 0, F.lit(bytearray(b""))).otherwise(F.encode(made, "ISO-8859-1"))


def rotate_left(data: Column) -> Column:
    return F.encode(F.translate(latin(data), _PLAIN, _ROTATED), "ISO-8859-1")


def rotate_right(data: Column) -> Column:
    return F.encode(F.translate(latin(data), _ROTATED, _PLAIN), "ISO-8859-1")


def _keyed(data: Column, key: bytes, take: int, give: int) -> Column:
    shared = F.array(*[F.lit(k) for k in key])

    def change(b: Column, i: Column) -> Column:
        mixed = F.pmod(b - (F.lit(take) - i % take), F.lit(256)).bitwiseXOR(F.get(shared, i % len(key)))
        return F.pmod(F.lit(give) - i % give + mixed, F.lit(256))

    return _bytewise(data, change)


def deobfuscate(data: Column, method: str | None) -> Column:
    """Plain bytes of a protected save; the method None changes nothing."""
    if method is None or method == "none":
        return data
    return rotate_left(data) if method == PC98 else _keyed(data, KEYS[method], 11, 13)


def obfuscate(data: Column, method: str | None) -> Column:
    if method is None or method == "none":
        return data
    return rotate_right(data) if method == PC98 else _keyed(data, KEYS[method], 13, 11)


def deobfuscate_by(data: Column, method: Column) -> Column:
    """As deobfuscate(), with the method in a column."""
    return F.when(method == PC98, rotate_left(data)).when(method == PC88, deobfuscate(data, PC88)).otherwise(data)


def known_plaintext() -> bytes:
    """What a program saves to find the key: 13 falling bytes over and over."""
    return bytes(128 + 13 - i % 13 for i in range(143))


def recover_key(cipher: Column) -> Column:
    """The 143-byte key from the ciphertext of known_plaintext(); the plaintext less its counter is 80 everywhere."""
    return _bytewise(cipher, lambda b, i: F.pmod(b - 11 + i % 11, F.lit(256)).bitwiseXOR(F.lit(0x80)))
