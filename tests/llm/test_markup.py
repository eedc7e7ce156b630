"""HTML reading, extraction and media sequences against parsers that go character by character."""

import base64
import hashlib
import html
import random
import time

import pytest
from pyspark.sql import functions as F

from diskloom.llm import html_text, markup, media

NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789:-"
LETTERS = NAME[:52]


def plain_tag_end(s, k):
    """(where a tag's inside ends, where the text goes on)."""
    while k < len(s):
        if s[k] == ">":
            return k, k + 1
        if s[k] == "=":
            q = k + 1
            while q < len(s) and s[q].isspace():
                q += 1
            if q < len(s) and s[q] in "\"'" and s[q] in s[q + 1 :]:
                k = s.index(s[q], q + 1)
            elif q < len(s) and s[q] in "\"'":
                k = q
        k += 1
    return len(s), len(s)


def plain_tokens(s, drop):
    out, text, k = [], "", 0
    while k < len(s):
        if s.startswith("<!--", k):
            end = s.find("-->", k + 4)
            out.append((text, "", False, ""))
            text, k = "", len(s) if end < 0 else end + 3
        elif s[k] == "<" and s[k + 1 : k + 2] in ("!", "?"):
            end = s.find(">", k + 2)
            out.append((text, "", False, ""))
            text, k = "", len(s) if end < 0 else end + 1
        elif s[k] == "<" and (s[k + 1 : k + 2] or "?") in LETTERS or s[k : k + 2] == "</" and (s[k + 2 : k + 3] or "?") in LETTERS:
            closing = s[k + 1] == "/"
            begin = k + 1 + closing
            end = begin
            while end < len(s) and s[end] in NAME:
                end += 1
            name = s[begin:end].lower()
            stop, k = plain_tag_end(s, end)
            if name in drop and not closing:
                at = k
                while at < len(s) and not (s[at : at + 2] == "</" and s[at + 2 : at + 2 + len(name)].lower() == name and (s[at + 2 + len(name) : at + 3 + len(name)] or " ") not in NAME):
                    at += 1
                if at < len(s):
                    k = plain_tag_end(s, at + 2 + len(name))[1]
                elif name in markup.RAW:
                    k = len(s)
                out.append((text, "", False, ""))
            else:
                out.append((text, "" if name in drop else name, closing, s[end:stop]))
            text = ""
        else:
            text, k = text + s[k], k + 1
    return [*out, (text, "", False, "")]


def plain_attributes(inside):
    """Values by name: a name is a maximal run of name characters that begins with a letter, _ or :."""
    out, k, word = {}, 0, NAME + "_."
    while k < len(inside):
        if inside[k] not in LETTERS + "_:" or k and (inside[k - 1] in word or inside[k - 1].isalnum()):
            k += 1
            continue
        end = k
        while end < len(inside) and (inside[end] in word or inside[end].isalnum()):
            end += 1
        q = end
        while q < len(inside) and inside[q].isspace():
            q += 1
        if inside[q : q + 1] != "=":
            k = end
            continue
        q += 1
        while q < len(inside) and inside[q].isspace():
            q += 1
        first = inside[q : q + 1]
        if first in ("'", '"') and first in inside[q + 1 :]:
            stop = inside.index(first, q + 1)
            value, after = inside[q + 1 : stop], stop + 1
        else:
            stop = q
            while stop < len(inside) and not inside[stop].isspace() and inside[stop] not in ">\"'":
                stop += 1
            value, after = inside[q:stop], stop
            if stop == q:
                k = end
                continue
        out.setdefault(inside[k:end].lower(), value)
        k = after
    return out


def squeezed(s):
    return " ".join(s.split())


PIECES = ["<p>", "</p>", "<a href=x>", "</a>", "<b>", "<br/>", "<div class='x>y'>", "</div>", "<h2>", "</h2>", "<script>", "</script>", "<STYLE a='", "</style >", "<!-- ", "-->", "<!x", "<?", ">", "<", "</", '"', "'", "=", " ", "\n", "&amp;", "\xa9", "<title>", "</title>", "<svg>", "</svg>", "<noscript>", "</noscript>", "the and of ", "word other words ", "x" * 80 + " "]
SEEN = ["<img src='a.png' alt=\"A &amp; b\">", "<img data-src=b.png>", "<img srcset='c.png 1x, d.png 2x' title=T>", "<img>", "<img src=\"data:image/png;base64,AAEC\">", "<img src='DATA:image/gif;base64,AAEC'>", "<img src=&#100;ata:,hi>", "<figure>", "</figure>", "<figcaption>", "</figcaption>", "<video poster=p.png src=v.mp4>", "<video>", "</video>", "<source src=s.ogg type=audio/ogg srcset=t.png>", "<picture>", "</picture>", "<audio>", "</audio>", "<iframe src=/f>", "<object data=o.swf>", "<image xlink:href=i.svg />", "<input type=image src=b>", "<input type=text src=b>", "<embed src=' '>"]


def random_page(r, pieces, most):
    return "".join(r.choice(pieces) for _ in range(r.randrange(most)))


def test_tokens_by_brute_force():
    r = random.Random(11)
    for k in range(4000):
        page = random_page(r, PIECES + SEEN if k % 2 else PIECES + ["<a ", "s", "/", "-"], 24)
        for drop in (markup.DROP, media._DROP, frozenset()):
            assert list(markup.tokens(page, drop)) == plain_tokens(page, drop), page
        inside = "".join(r.choice(["a", "src", "=", " ", "'", '"', "b.c", ":", "-", "x y", "\n", "/"]) for _ in range(r.randrange(14)))
        assert markup.attributes(inside) == plain_attributes(inside), inside


def plain_extract(page):
    """Blocks and labels written out: each block looks for its neighbours by itself."""
    found, text, link, linked, tag = [], "", False, 0, "body"

    def end():
        if squeezed(text):
            found.append((tag, squeezed(text), min(linked, len(squeezed(text)))))

    for piece, name, closing, _ in plain_tokens(page, markup.DROP):
        own = html.unescape(piece)
        text += own
        linked += len(squeezed(own)) if link else 0
        if name in html_text.BLOCKS:
            end()
            text, linked, tag = "", 0, tag if name == "br" else "body" if closing else name
        elif name == "a":
            link = not closing
        elif not name:
            text += " "
    end()
    first = []
    for _, text, linked in found:
        words = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        dense = sum(w in html_text.STOP_WORDS for w in words) / len(words) if words else 0
        if linked / len(text) > 0.2 or "\xa9" in text:
            first.append("bad")
        elif len(text) < 70:
            first.append("bad" if linked else "short")
        elif dense >= 0.18:
            first.append("good" if len(text) > 200 else "near")
        else:
            first.append("near" if dense >= 0.10 else "bad")

    def beside(labels, k, step, kinds):
        k += step
        while 0 <= k < len(labels):
            if labels[k] in kinds:
                return labels[k]
            k += step
        return "bad"

    labels = list(first)
    for k, label in enumerate(first):
        if label == "short":
            left, right = (beside(first, k, s, ("good", "bad")) for s in (-1, 1))
            side = -1 if left == "bad" else 1
            labels[k] = left if left == right else "good" if beside(first, k, side, ("good", "bad", "near")) == "near" else "bad"
    decided = list(labels)
    for k, label in enumerate(labels):
        if label == "near":
            before = decided[k - 1] if k else "bad"
            decided[k] = "bad" if before == "bad" and beside(labels, k, 1, ("good", "bad")) == "bad" else "good"
    for k, (tag, _, _) in enumerate(found):
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and first[k] == "short" and decided[k] == "bad" and beside(first, k, 1, ("good", "bad")) == "good":
            decided[k] = "good"
    kept = [text for (_, text, _), label in zip(found, decided) if label == "good"]
    return "\n".join(kept), len(found), len(kept)


def test_extraction_by_brute_force():
    r = random.Random(12)
    long = ["the house and the garden of the king were in the middle of the town with all of the people " * 3, "and the ", "one two three four five six seven eight nine ten eleven twelve thirteen the and " * 2, "a word "]
    kept = 0
    for _ in range(3000):
        page = random_page(r, PIECES + long * 4 + ["<p>", "</p>", "<h2>"] * 4, 40)
        got = html_text.extract(page)
        assert got == plain_extract(page), page
        kept += got[2] > 0
    assert kept > 300


def plain_sequence(page, base):
    """Items first, in order; then each figure's caption is put on its items."""
    events, items, text, caption, owner, fallback, figures = plain_tokens(page, media._DROP), [], [], None, "", "", []
    figure = None

    def flush():
        if squeezed(html.unescape("".join(text))):
            items.append({"kind": "text", "text": squeezed(html.unescape("".join(text)))})
        text.clear()

    def close():
        nonlocal caption
        if caption is not None and squeezed(html.unescape(" ".join(caption))):
            figure["said"] = squeezed(html.unescape(" ".join(caption)))
        caption = None

    for piece, name, closing, inside in events:
        (text if caption is None else caption).extend([piece] if name else [piece, " "])
        if name in html_text.BLOCKS and caption is None:
            flush()
        if name == "figure":
            close()
            figure = None
            if not closing:
                figure = {"said": None, "items": []}
                figures.append(figure)
        elif name == "figcaption" and figure is not None:
            close()
            caption = None if closing else []
        elif name in ("video", "audio", "picture"):
            owner, fallback = "" if closing else name, ""
        if closing or name not in media.MEDIA:
            continue
        has = {k: html.unescape(v) for k, v in plain_attributes(inside).items()}
        first = (has.get("srcset", "").split() or [""])[0].rstrip(",")
        if name == "source" and owner == "picture":
            fallback = fallback or first or (has.get("src", "").split() or [""])[0].rstrip(",")
        refs = {
            "img": [("image", has.get("src") or has.get("data-src") or first or fallback)],
            "image": [("image", has.get("href") or has.get("xlink:href"))],
            "input": [("image", has.get("src"))] if has.get("type", "").lower() == "image" else [],
            "source": [(owner, has.get("src"))] if owner in ("video", "audio") else [],
            "video": [("image", has.get("poster")), ("video", has.get("src"))],
            "audio": [("audio", has.get("src"))],
            "embed": [("embed", has.get("src"))],
            "iframe": [("embed", has.get("src"))],
            "object": [("embed", has.get("data"))],
        }[name]
        for kind, address in refs:
            if not (address or "").strip():
                continue
            if caption is None:
                flush()
            address = address.strip()
            raw = None
            if address[:5].lower() == "data:" and "," in address:
                head, _, body = address[5:].partition(",")
                raw = base64.b64decode(body) if head.lower().endswith(";base64") else body.encode()
            item = {"kind": kind, "url": None if raw is not None else "http://h/" + address.lstrip("/"), "raw": raw, "own": squeezed(has.get("alt") or has.get("title") or "") or None}
            items.append(item)
            if figure is not None:
                figure["items"].append(item)
    close()
    flush()
    for f in figures:
        for item in f["items"]:
            item["own"] = f["said"] or item["own"]
    return [(k, x["kind"], x.get("text"), x.get("url"), x.get("own"), None if x["kind"] == "text" else hashlib.sha256(x["raw"] if x["raw"] is not None else x["url"].encode()).hexdigest()) for k, x in enumerate(items)]


def test_sequences_by_brute_force():
    r = random.Random(13)
    seen = 0
    for _ in range(4000):
        page = random_page(r, SEEN * 2 + PIECES[:10] + PIECES[12:15] + ["some text ", "&lt;", "<b>"], 26)
        got = media.sequence(page, "http://h/")
        want = plain_sequence(page, "http://h/")
        assert [(x["pos"], x["kind"], x.get("text"), x.get("url"), x.get("caption"), x.get("digest")) for x in got] == want, page
        seen += any(x["kind"] != "text" for x in got)
    assert seen > 2000


@pytest.mark.parametrize("page", ["<a " * 350_000 + '"', "<style " * 150_000, "<style>" * 150_000, "<svg>" * 200_000, "<" * 1_000_000, "<a b='" * 170_000, "<img " + "a" * 1_000_000 + ">", "<img " + "a= " * 330_000 + ">", "=" * 10 + "<p " + "= " * 500_000, "<!-" * 330_000, "<!--" * 250_000, "</a" * 330_000, "<figure>" + "<img src=x><figcaption>y</figcaption>" * 27_000, "&" * 1_000_000, "<p>t</p>" * 125_000, "<a>" * 330_000, "\xa0 " * 500_000])
def test_a_page_of_a_megabyte_takes_time_in_proportion(page):
    for read in (html_text.extract, lambda x: media.sequence(x, "http://h/")):
        began = time.process_time()
        read(page)
        assert time.process_time() - began < 4  # about one; quadratic readers take hours


def test_upper_case_and_coded_addresses_find_their_payloads(spark):
    raw = b"\x00\x01\x02"
    code = base64.b64encode(raw).decode()
    rows = [(1, f"<img src='DATA:image/png;base64,{code}'>"), (2, f"<p>x<img src=&#100;ata:image/aaa;base64,{code}>"), (3, "no media, the word data:image/png,x alone"), (4, "<video poster=/p.png></video><svg><image xlink:href='/s.png'/></svg><iframe src=/f></iframe><img srcset='/a.png 1x, /b.png 2x'>"), (None, None)]
    pages = spark.createDataFrame([(i, "http://h/", h, i, "z") for i, h in rows], "page_id long, url string, html string, page long, items string")
    got = {r.page_id: r.items for r in media.interleave(pages).collect()}
    assert [bytes(x.payload) for k in (1, 2) for x in got[k] if x.kind == "image"] == [raw, raw] and got[1][0].media_type == got[2][1].media_type == "image/aaa"
    assert [x.kind for x in got[3]] == ["text"] and got[None] is None
    assert [(x.kind, x.url) for x in got[4]] == [("image", "http://h/p.png"), ("image", "http://h/s.png"), ("embed", "http://h/f"), ("image", "http://h/a.png")]
    long = spark.createDataFrame([(1, "http://h/", "<p>word and the <img src=/x>" * 60_000)], "page_id long, url string, html string")
    assert media.interleave(long).select(F.size("items")).first()[0] == 120_000
    assert html_text.extract_pages(long.withColumnsRenamed({"url": "content"}).withColumn("n_blocks", F.lit("x"))).first().n_blocks == 60_000
