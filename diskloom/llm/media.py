"""Interleaved document sequences from HTML: text and media references in reading order.

Each page becomes an ordered array of structs. An item is a run of text, or a reference to an
image, video, audio or embedded file with its absolute address, its alternative text or figure
caption, and the SHA-256 digest of what it refers to: for a ``data:`` address the digest of the
decoded bytes, else that of the address. Payload tables are keyed by the same digest, and
``resolve`` attaches them: references are exploded, joined on the digest and put back at their
positions, so text, media and captions stay aligned.

A picture's address is its src, data-src or first srcset entry, else that of the first source of
its picture element; a video's poster is an image of its own before it; frames are embeds.

Defined results: null html has a null sequence, html without text or media an empty one; a
reference without an address is left out; a digest without payload keeps its item with a null
payload; several payloads of one digest give the one with the smallest media type, then bytes (a null
type first); the same reference twice gives two items; a caption goes with every media item of its
figure. Pages may be of any length, with time in proportion. Pages are resolved by content, so a null
or repeated page_id is no matter, and repeated pages have equal items; other columns, whatever their
names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .html_text import _SPACE, BLOCKS
from .markup import DROP, attributes, tokens

MEDIA = {"img": "image", "image": "image", "input": "image", "video": "video", "audio": "audio", "source": "", "embed": "embed", "object": "embed", "iframe": "embed"}
#: What markup passes over: elements that are references are read.
_DROP = DROP - {"svg", "object", "iframe"}
#: JVM test that no page with a reference fails.
HINT = "(?i)<(img|image|input|video|audio|source|embed|object|iframe)"
ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("url", pa.string()), ("caption", pa.string()), ("digest", pa.string()), ("media_type", pa.string()), ("size", pa.int64())])
ITEM_DDL = "struct<pos:int,kind:string,text:string,url:string,caption:string,digest:string,media_type:string,size:bigint>"


def data_address(address: str) -> tuple[str, bytes] | None:
    """Media type and bytes of a data: address, or None where it is none or can't be read."""
    head, comma, body = address.partition(",")
    if not comma or not head[:5].lower() == "data:":
        return None
    kind, *options = head[5:].split(";")
    try:
        raw = unquote_to_bytes(body)
        return kind.strip().lower() or "text/plain", base64.b64decode(re.sub(rb"\s+", b"", raw), validate=True) if "base64" in (x.strip().lower() for x in options) else raw
    except (binascii.Error, ValueError):
        return None


def absolute(base: str | None, address: str) -> str:
    try:
        return urljoin(base or "", address)
    except ValueError:
        return address


def addresses(name: str, has: dict[str, str], owner: str) -> list[tuple[str, str]]:
    """(kind, address) of each reference of a tag."""
    listed = (has.get("srcset") or "").split()
    if name == "img":
        found = [("image", has.get("src") or has.get("data-src") or (listed[0].rstrip(",") if listed else ""))]
    elif name == "image":
        found = [("image", has.get("href") or has.get("xlink:href") or "")]
    elif name == "input":
        found = [("image", has.get("src", ""))] if has.get("type", "").lower() == "image" else []
    elif name == "source":
        found = [(owner, has.get("src", ""))] if owner in ("video", "audio") else []
    else:
        found = [(MEDIA[name], has.get("data" if name == "object" else "src", ""))]
        if name == "video":
            found.insert(0, ("image", has.get("poster", "")))
    return [(kind, address.strip()) for kind, address in found if address.strip()]


def parsed(source: str | None, base: str | None) -> tuple[list[dict] | None, dict[str, tuple[str, bytes]]]:
    """(items of a page in order, media type and bytes of its inline payloads by digest)."""
    if source is None:
        return None, {}
    items: list[dict] = []
    payloads: dict[str, tuple[str, bytes]] = {}
    parts: list[str] = []
    figure: list[dict] | None = None
    said: str | None = None  # the figure's caption so far
    caption: list[str] | None = None
    owner, fallback = "", ""

    def end() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            items.append({"kind": "text", "text": text})

    def close_caption() -> None:
        nonlocal caption, said
        if caption is not None:
            said = _SPACE.sub(" ", html.unescape(" ".join(caption))).strip() or said
        caption = None

    def close_figure() -> None:
        nonlocal figure, said
        close_caption()
        for item in figure or ():
            item["caption"] = said or item["caption"]
        figure, said = None, None

    for text, name, closing, inside in tokens(source, _DROP):
        (parts if caption is None else caption).append(text)
        if not name:
            (parts if caption is None else caption).append(" ")
            continue
        if name in BLOCKS and caption is None:
            end()
        if name == "figure":
            close_figure()
            figure = None if closing else []
        elif name == "figcaption" and figure is not None:
            close_caption()
            caption = None if closing else []
        elif name in ("video", "audio", "picture"):
            owner, fallback = "" if closing else name, ""
        if closing or name not in MEDIA:
            continue
        has = {k: html.unescape(v) for k, v in attributes(inside).items()}
        found = addresses(name, has, owner)
        if name == "source" and owner == "picture" and not fallback:
            fallback = next(iter((has.get("srcset") or has.get("src") or "").split()), "").rstrip(",")
        if name == "img" and not found and fallback:
            found = [("image", fallback)]
        for kind, address in found:
            if caption is None:
                end()
            inline = data_address(address)
            url = None if inline else absolute(base, address)
            digest = hashlib.sha256(inline[1] if inline else url.encode("utf-8", "replace")).hexdigest()
            if inline and inline < payloads.get(digest, (chr(0x10FFFF), b"")):
                payloads[digest] = inline
            own = _SPACE.sub(" ", has.get("alt") or has.get("title") or "").strip() or None
            item = {"kind": kind, "url": url, "caption": own, "digest": digest, "media_type": inline[0] if inline else (has.get("type") if name != "input" and kind != "image" else None), "size": len(inline[1]) if inline else None}
            if figure is not None:
                figure.append(item)
            items.append(item)
    close_figure()
    end()
    return [{"pos": k} | x for k, x in enumerate(items)], payloads


def sequence(source: str | None, base: str | None) -> list[dict] | None:
    """The items of a page in order."""
    return parsed(source, base)[0]


def sequences(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, page, items), one row for each page, in a narrow stage; page is a digest of address and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            found = [sequence(h, u) for h, u in zip(part.column("html").to_pylist(), part.column("url").to_pylist())]
            yield pa.record_batch({"page_id": part.column("page_id"), "page": part.column("page"), "items": pa.array(found, pa.list_(ITEM))})

    kind = pages.schema[id_col].dataType.simpleString()
    page = F.unhex(F.md5(F.concat(F.coalesce(F.col(url_col), F.lit("")), F.lit("\u0000"), F.col(html_col))))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), page.alias("page")).mapInArrow(run, f"page_id {kind}, page binary, items array<{ITEM_DDL}>")


def inline_payloads(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(digest, media_type, payload) of the data: addresses in the pages, one row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "html"):
            seen: dict[str, tuple[str, bytes]] = {}
            for source in part.column("html").to_pylist():
                for digest, inline in parsed(source, None)[1].items():
                    seen[digest] = min(inline, seen.get(digest, inline))
            yield pa.record_batch({"digest": pa.array(list(seen), pa.string()), "media_type": pa.array([x[0] for x in seen.values()], pa.string()), "payload": pa.array([x[1] for x in seen.values()], pa.binary())})

    found = pages.select(F.col(html_col).alias("html")).where(F.col("html").rlike(HINT)).mapInArrow(run, "digest string, media_type string, payload binary")
    return found.groupBy("digest").agg(F.min(F.struct("media_type", "payload")).alias("p")).select("digest", "p.media_type", "p.payload")


def resolve(found: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, items) with each media item's payload and its size and type from the payload table.

    References alone meet the payloads; what is found comes back as one map for each distinct
    page and is applied in place by position. Pages are named by their content, so the parse is
    made again instead of being kept, and a lost executor changes nothing.
    """
    refs = found.select("page", F.explode(F.filter("items", lambda x: x["digest"].isNotNull())).alias("x")).select("page", F.col("x.pos").alias("pos"), F.col("x.digest").alias("digest")).distinct()
    one = payloads.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("media_type", "payload")).alias("p"))
    one = one.select("digest", F.col("p.media_type").alias("media_type"), F.length("p.payload").cast("long").alias("size"), F.col("p.payload").alias("payload"))
    hits = refs.join(one, "digest").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("media_type", "size", "payload")))).alias("hits"))
    joined = found.join(hits, "page", "left")
    return joined.select(
        "page_id",
        F.transform(
            "items",
            lambda x: F.struct(
                *[x[k].alias(k) for k in ("pos", "kind", "text", "url", "caption", "digest")],
                F.coalesce(F.col("hits")[x["pos"]]["media_type"], x["media_type"]).alias("media_type"),
                F.coalesce(F.col("hits")[x["pos"]]["size"], x["size"]).alias("size"),
                F.col("hits")[x["pos"]]["payload"].alias("payload"),
            ),
        ).alias("items"),
    )


def interleave(pages: DataFrame, payloads: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Sequences of the pages, resolved with their own inline payloads and those of a payload table.

    Pages without a reference have nothing to resolve and stay where they are read.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    refers = F.coalesce(F.col("html").rlike(HINT), F.lit(False))
    known = inline_payloads(own)
    found = resolve(sequences(own.where(refers)), known if payloads is None else known.unionByName(payloads.select("digest", "media_type", "payload")))
    plain = sequences(own.where(~refers)).select("page_id", F.transform("items", lambda x: x.withField("payload", F.lit(None).cast("binary"))).alias("items"))
    return found.unionByName(plain)
