"""Writes disk images from files: the inverse of the scan, for round trips and fixtures."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from .formats import KNOWN, Format


@lru_cache(maxsize=8192)
def _header(track: int, side: int, number: int, code: int, count: int, size: int) -> bytes:
    return bytes([track, side, number, code]) + count.to_bytes(2, "little") + bytes(8) + size.to_bytes(2, "little")


def sector(track: int, side: int, number: int, code: int, count: int, data: bytes) -> bytes:
    """A sector with its header."""
    return _header(track, side, number, code, count, len(data)) + data


@lru_cache(maxsize=256)
def _blank(track: int, side: int, code: int, count: int) -> bytes:
    """A track on which nothing is written."""
    return b"".join(sector(track, side, n, code, count, b"\xff" * (128 << code)) for n in range(1, count + 1))


def image(tracks: list[bytes], name: bytes = b"", protected: bool = False, media: int = 0, entries: int = 164) -> bytes:
    """A disk of tracks of sectors."""
    first = 0x20 + 4 * entries
    offsets, at = [], first
    for track in tracks:
        offsets.append(at if track else 0)
        at += len(track)
    table = b"".join(x.to_bytes(4, "little") for x in offsets).ljust(4 * entries, b"\0")
    head = name.ljust(26, b"\0") + bytes([0x10 if protected else 0, media]) + at.to_bytes(4, "little")
    return head + table + b"".join(tracks)


@dataclass
class Disk:
    """Contents of a formatted disk; clusters are given out in order, skipping boot and metadata."""

    form: Format
    code: int = 1
    boot: bytes = b""
    autorun: bytes = b"\0"
    entries: list[bytes] = field(default_factory=list)
    links: dict[int, int] = field(default_factory=dict)
    clusters: dict[int, bytes] = field(default_factory=dict)
    missing: set[tuple[int, int, int]] = field(default_factory=set)

    def __post_init__(self) -> None:
        f, size = self.form, 128 << self.code
        self.size, self.per = size, f.sectors // f.clusters_per_track
        self.total = f.fat_tracks * f.sides * f.clusters_per_track
        if f.side_is_cluster_lsb:
            self.meta = [(f.metadata_track * f.clusters_per_track + k) * f.sides + f.metadata_side for k in range(f.clusters_per_track)]
        else:
            self.meta = [(f.metadata_track * f.sides + f.metadata_side) * f.clusters_per_track + k for k in range(f.clusters_per_track)]
        self.links = {0: 0xFE} | {k: 0xFE for k in self.meta} | self.links
        self.next = 1

    def take(self) -> int:
        while self.next in self.links:
            self.next += 1
        if self.next >= self.total:
            raise ValueError("the disk is full")
        return self.next

    def add(self, name: bytes, ext: bytes, data: bytes, attributes: int = 0x80, end: bytes = b"\x1a") -> None:
        """A file with its end mark; its last cluster counts sectors."""
        data = data + end
        sectors = -(-len(data) // self.size)
        data = data.ljust(sectors * self.size, b"\0")
        head, before = 0xFE, None
        for at in range(0, len(data), self.per * self.size):
            own = self.take()
            self.clusters[own] = data[at : at + self.per * self.size]
            self.links[own] = 0xC0 + len(self.clusters[own]) // self.size
            if before is None:
                head = own
            else:
                self.links[before] = own
            before = own
        self.entries.append(name.ljust(6)[:6] + ext.ljust(3)[:3] + bytes([attributes, head]) + b"\xff" * 5)

    def place(self, cluster: int) -> tuple[int, int, int]:
        f = self.form
        if f.side_is_cluster_lsb:
            return cluster // f.sides // f.clusters_per_track, cluster % f.sides, 1 + cluster // f.sides % f.clusters_per_track * self.per
        return cluster // f.clusters_per_track // f.sides, cluster // f.clusters_per_track % f.sides, 1 + cluster % f.clusters_per_track * self.per

    def build(self, name: bytes = b"", protected: bool = False, fats: tuple[bytes | None, ...] | None = None) -> bytes:
        f = self.form
        held: dict[tuple[int, int, int], bytes] = {}
        for cluster, data in self.clusters.items():
            track, side, first = self.place(cluster)
            for k in range(0, len(data), self.size):
                held[track, side, first + k // self.size] = data[k : k + self.size]
        held[0, 0, 1] = self.boot.ljust(self.size, b"\0") if self.boot else b"\xe5" * self.size
        directory = b"".join(self.entries).ljust((f.sectors - 4) * 256, b"\xff")
        for k in range(f.sectors - 4):
            held[f.metadata_track, f.metadata_side, k + 1] = directory[k * 256 : k * 256 + 256].ljust(self.size, b"\xff")[: self.size]
        held[f.metadata_track, f.metadata_side, f.sectors - 3] = self.autorun.ljust(self.size, b"\0")
        fat = bytes(self.links.get(k, 0xFF) for k in range(256)).ljust(self.size, b"\xff")
        for k, own in enumerate(fats or (fat, fat, fat)):
            held[f.metadata_track, f.metadata_side, f.sectors - 2 + k] = own if own is not None else b""
        tracks, used = [], {(track, side) for track, side, _ in (*held, *self.missing)}
        for track in range(f.tracks):
            for side in range(f.sides):
                if (track, side) not in used:
                    tracks.append(_blank(track, side, self.code, f.sectors))
                    continue
                own = [(n, held.get((track, side, n), b"\xff" * self.size)) for n in range(1, f.sectors + 1) if (track, side, n) not in self.missing]
                tracks.append(b"".join(sector(track, side, n, self.code, f.sectors, d) for n, d in own if d))
        return image(tracks, name, protected)


PC88_2D = KNOWN[4]
