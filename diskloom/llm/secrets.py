"""Secret scans by dictionary-primed compression novelty.

A candidate is a whole run of 12 token characters or more in a sensitive context: after a name such
as key, token, secret or password and an assignment, after an authorization word, or with a known
issuer's prefix; or a PEM private key, with its frame and, where its end is missing, as far as it goes. Its novelty is what it adds to the compressed size of its surroundings: the
window around it is compressed with and without the candidate by zstandard, primed with a
dictionary of common identifiers and code, and the difference in bytes is divided by the
candidate's length; of a PEM block its inside counts. It is compared with ``NOVELTY``, in proportion
to the bits that a character of a decimal or hexadecimal value can hold at most. A long candidate
whose whole is not novel enough counts by its first ``HEAD`` characters, so what follows a secret
doesn't hide it. Identifiers, placeholders, paths and words that repeat nearby compress to little;
random strings don't.

The candidate's other occurrences are taken out of its surroundings first, so that a secret
pasted twice hides neither copy. An unquoted candidate must hold a digit.

Defined results: null and empty texts have no findings; overlapping candidates are cut from left
to right; the same secret at two places gives two findings; positions count characters from 0
over the whole text, of any length, with time in proportion; null and repeated ids and repeated rows
are judged like any other row; an empty table gives an empty result. Redaction puts ``[secret]`` in
place of a finding's value and leaves texts without findings and all other columns untouched, whatever
their names, but for the text's length, which follows it (null stays null).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, rewritten

WINDOW = 160
#: Bytes of compressed output that a byte of the candidate must add.
NOVELTY = 0.6
#: Characters of a longer candidate that are novel enough by themselves.
HEAD = 512
MASK = "[secret]"

NAMES = r"(?:api|access|auth|client|private|secret|session|signing|encryption|master|account|db|database|aws|user|root|admin)?[ _.-]?(?:key|token|secret|passw(?:or)?d|pwd|passphrase|credential|bearer|signature)s?(?:[ _.-]?(?:id|key|value|hash))?"
_RUN = r"[A-Za-z0-9_-]"
#: A token of three parts, its start being looked for once in each run of its characters.
JWT = rf"(?<!{_RUN})(?={_RUN}++\.{_RUN}{{8,}}+\.{_RUN}{{8}}){_RUN}*?\b(?P<jwt>eyJ{_RUN}{{8,}}+\.{_RUN}{{8,}}+\.{_RUN}{{8,}})"
FRAME = r"-----{} (?:[A-Z0-9]+ ){{0,3}}PRIVATE KEY(?: BLOCK)?-----"
CANDIDATE = re.compile(
    rf"(?i:\b{NAMES}[\"']?\s{{0,4}}(?:[:=]{{1,3}}>?|\bis\b)\s{{0,4}})(?:([\"'`])(?P<quoted>[^\"'`\s]{{12,}})\1|(?P<bare>[A-Za-z0-9+/_=.~-]{{12,}}))"
    rf"|(?i:\b(?:bearer|basic)\s{{1,3}})(?P<auth>[A-Za-z0-9+/_=.~-]{{12,}})"
    rf"|(?P<issued>\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b|\bgh[pousr]_[A-Za-z0-9]{{30,}}\b|\bxox[abprs]-[A-Za-z0-9-]{{10,}}|\bsk_(?:live|test)_[A-Za-z0-9]{{16,}}\b|\bAIza[A-Za-z0-9_-]{{35}}\b)|{JWT}"
    rf"|(?P<pem>{FRAME.format('BEGIN')}(?P<inside>(?:(?!-----)[\s\S])*+){FRAME.format('END')}|{FRAME.format('BEGIN')}(?P<cut>[A-Za-z0-9+/=\s\\]*+))"
)
#: RE2 test, over a batch at once, that no text with a candidate fails.
HINT = r"(?i:key|token|secret|passw|pwd|passphrase|credential|bearer|signature|basic)|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_|AIza|eyJ"
_DIGIT = re.compile(r"[0-9]")
#: Bits of a character by the form of a value; any other has 6.
_FORMS = ((re.compile(r"[0-9.:_-]+"), 3.33), (re.compile(r"[0-9a-f.:_-]+|[0-9A-F.:_-]+"), 4.0))

_WORDS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 00000000 11111111 xxxxxxxxxxxxxxxx XXXXXXXX ******** aaaaaaaa "
    "example placeholder changeme change_me your_api_key_here your-secret-key YOUR_TOKEN_HERE insert_token_here replace_with_your_token dummy sample test testing "
    "default password password123 secret mysecret my_secret_key undefined null none true false string value config settings environment process.env os.environ getenv "
    "username user_id session_id client_id client_secret access_token refresh_token authorization bearer content-type application/json localhost 127.0.0.1 "
    "http:// https:// www. .com .org .net /usr/local/bin /etc/passwd /home/user /var/lib index.html main.py import return function const let var def class public private static void self this "
    "get set put post delete update create read write open close file path name type id key token hash signature data response request handler service manager controller factory "
    "the and that with this from which have for not are was were been their would there could other about into more some time only "
    "und der die das nicht ein eine für auf mit les des une dans pour pas que sur avec los las una por para con ción mente "
    'token = " key = " secret = " password = " api_key: " apikey=" passwd=" pwd=\' '
)
_DICTIONARY = zstandard.ZstdCompressionDict(_WORDS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
_compressor: zstandard.ZstdCompressor | None = None


def size_of(data: bytes) -> int:
    """Compressed bytes with the dictionary."""
    global _compressor
    if _compressor is None:
        _compressor = zstandard.ZstdCompressor(level=9, dict_data=_DICTIONARY, write_content_size=False, write_checksum=False)
    return len(_compressor.compress(data))


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end] against its surroundings, for each of its bytes."""
    own = text[start:end]
    before, after = (x.replace(own, " ").encode("utf-8", "replace") for x in (text[max(0, start - WINDOW) : start], text[end : end + WINDOW]))
    value = own.encode("utf-8", "replace")
    return (size_of(before + after + value) - size_of(before + after)) / max(1, len(value))


def needed(value: str, threshold: float = NOVELTY) -> float:
    """The novelty that a value of this form needs."""
    return threshold * next((bits for form, bits in _FORMS if form.fullmatch(value)), 6.0) / 6


def findings(text: str | None, threshold: float = NOVELTY) -> list[tuple[int, int, float]]:
    """(start, end, novelty) of each reported value in order."""
    out = []
    for m in CANDIDATE.finditer(text or ""):
        group = m.lastgroup
        start, end = m.span(group)
        if group in ("bare", "auth") and not _DIGIT.search(m[group]):
            continue
        inner = m.span("inside" if m["inside"] is not None else "cut") if group == "pem" else (start, end)
        if inner[1] - inner[0] < 12:
            continue
        score = novelty(text, *inner)
        ok = score >= needed(text[slice(*inner)], threshold)
        if not ok and inner[1] - inner[0] > HEAD:
            head = novelty(text, inner[0], inner[0] + HEAD)
            score, ok = max(score, head), head >= needed(text[inner[0] : inner[0] + HEAD], threshold)
        if ok:
            out.append((start, end, score))
    return out


def suspects(texts: pa.Array) -> list[tuple[int, str]]:
    """(row, text) of the texts that may hold a candidate."""
    rows = pa.compute.indices_nonzero(pa.compute.fill_null(pa.compute.match_substring_regex(texts, HINT), False))
    return list(zip(rows.to_pylist(), texts.take(rows).to_pylist()))


def redact(text: str, found: list[tuple[int, int, float]]) -> str:
    parts, at = [], 0
    for start, end, _ in found:
        parts += [text[at:start], MASK]
        at = end
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = NOVELTY) -> DataFrame:
    """(doc_id, start, length, value_md5, novelty in thousandths) of each finding; one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part in chunks(batches, "text"):
            rows, spans = [], []
            for k, text in suspects(part.column("text")):
                for start, end, score in findings(text, threshold):
                    rows.append(k)
                    spans.append((start, end - start, hashlib.md5(text[start:end].encode("utf-8", "replace")).hexdigest(), int(score * 1000)))
            yield pa.record_batch({
                "doc_id": part.column("doc_id").take(pa.array(rows, pa.int64())),
                "start": pa.array([x[0] for x in spans], pa.int64()),
                "length": pa.array([x[1] for x in spans], pa.int32()),
                "value_md5": pa.array([x[2] for x in spans], pa.string()),
                "novelty_milli": pa.array([x[3] for x in spans], pa.int32()),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length int, value_md5 string, novelty_milli int")


def redacted(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", threshold: float = NOVELTY) -> DataFrame:
    """All rows and columns of docs, with secrets masked in the text and its length column put right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            changed = {}
            for k, text in suspects(part.column(text_col)):
                if found := findings(text, threshold):
                    changed[k] = redact(text, found)
            if changed:
                texts = part.column(text_col).to_pylist()
                for k, text in changed.items():
                    texts[k] = text
                columns = list(part.columns)
                columns[part.schema.get_field_index(text_col)] = pa.array(texts, part.schema.field(text_col).type)
                if size_col in part.schema.names:
                    at = part.schema.get_field_index(size_col)
                    sizes = columns[at].to_pylist()
                    for k, text in changed.items():
                        sizes[k] = None if sizes[k] is None else len(text)
                    columns[at] = pa.array(sizes, columns[at].type)
                part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            yield part

    return rewritten(docs, run)
