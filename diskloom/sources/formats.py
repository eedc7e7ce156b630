"""The twelve known disk formats, in the order that decides ties."""

from __future__ import annotations

from typing import NamedTuple

from ..functions.charset import PC98, PC6001


class Format(NamedTuple):
    ordinal: int
    name: str
    tracks: int
    fat_tracks: int
    sides: int
    sectors: int
    hint: str
    charset: str
    obfuscation: str | None
    metadata_track: int
    metadata_side: int
    clusters_per_track: int
    side_is_cluster_lsb: bool


_NOTE = " (wild type{})"
#: Media by the size of the disk.
_MICRO, _MINI, _LARGE = '3.5" ', '5.25" ', '8" 2D/'
_ROWS = [
    ("PC-9800 " + _MICRO + "2DD/" + _MINI + "2DD", (80, 80, 2, 16), "", (PC98, "pc98"), (40, 0, 1), False),
    ("PC-9800 " + _LARGE + _MICRO + "2HD/" + _MINI + "2HD", (77, 77, 2, 26), "len=128", (PC98, "pc98"), (35, 0, 1), False),
    ("PC-9800 " + _LARGE + _MICRO + "2HD/" + _MINI + "2HD" + _NOTE.format(", 78 tracks"), (78, 77, 2, 26), "len=128", (PC98, "pc98"), (35, 0, 1), False),
    ('PC-8000/PC-8800 5.25" 1D', (35, 35, 1, 16), "", (PC98, "pc88"), (18, 0, 2), False),
    ('PC-8000/PC-8800 5.25" 2D', (40, 40, 2, 16), "", (PC98, "pc88"), (18, 1, 2), False),
    ("PC-8801 mkII " + _LARGE + _MINI + "2HD", (77, 77, 2, 26), "len<>128", (PC98, "pc88"), (35, 0, 1), False),
    ('PC-6001 mkII 5.25" 1D', (35, 35, 1, 16), "SYS", (PC6001, None), (18, 0, 2), False),
    ('PC-6001 mkII 5.25" 1D' + _NOTE.format(", 36 tracks"), (36, 35, 1, 16), "SYS", (PC6001, None), (18, 0, 2), False),
    ('PC-6601 3.5" 1D' + _NOTE.format(""), (40, 40, 1, 16), "SYS", (PC6001, None), (18, 0, 2), False),
    ('PC-6601 SR 3.5" 1DD' + _NOTE.format(""), (80, 80, 1, 16), "IPL|RXR", (PC6001, None), (37, 0, 2), False),
    ('PC-6601 SR 3.5" 1DD' + _NOTE.format(", 81 tracks"), (81, 80, 1, 16), "IPL|RXR", (PC6001, None), (37, 0, 2), False),
    ('Pasopia 5.25" 2D' + _NOTE.format(""), (40, 40, 2, 16), "0000", (PC98, None), (18, 0, 2), True),
]
KNOWN = [Format(k + 1, name, *size, hint, *codes, *meta, lsb) for k, (name, size, hint, codes, meta, lsb) in enumerate(_ROWS)]
