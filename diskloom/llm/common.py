"""What the corpus operators share: shared-folder tables, batches, hashes."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame, SparkSession

#: Characters that a worker turns into arrays at a time; bounds memory, not results.
CHUNK_CHARS = 2_000_000
#: Whether an execution's shuffles are removed as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables made by written() and not removed yet: path, and the JVM that can remove it.
_tables: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set here only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="diskloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + own)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    It stays until forget() or the end of the driver. The shuffles that made it are removed at once:
    nothing reads them again, while the driver's own cleaning waits for its garbage collector.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if not _tables:
        atexit.unregister(forget_all)
        atexit.register(forget_all)  # last registered, so first called: the JVM is still there
    _tables[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def _remove(path: str) -> None:
    jvm, conf = _tables.pop(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables made by written() once nothing reads them."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path in _tables:
            _remove(path)


def forget_all() -> None:
    """Remove every table that written() has made: of use between jobs of a long session, once their results are stored."""
    for path in list(_tables):
        try:
            _remove(path)
        except Exception as why:  # the JVM may be gone at the end; its folder is then the cluster's to clear
            print(f"not removed: {path} ({type(why).__name__})", file=sys.stderr)
            return


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that the texts of one hold about ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
        at, total = 0, np.cumsum(size + 64)
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end (null as empty), and each text's length in them."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    lengths = np.asarray(pa.compute.utf8_length(texts), dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint32), lengths
    raw = texts.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32), lengths


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on purpose."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, end to end."""
    counts = np.asarray(counts, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - counts, counts)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


_FOLD: np.ndarray | None = None


def folded() -> np.ndarray:
    """By code point: its lower-case form where it belongs to a word (letter, digit, mark or underscore), else 0."""
    global _FOLD
    if _FOLD is None:
        import re

        table = np.zeros(0x110000, dtype=np.uint32)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for m in re.finditer(r"\w", every):
            table[ord(m[0])] = ord(m[0].lower()[0])
        _FOLD = table
    return _FOLD


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant, n at least."""
    global _POWERS
    if len(_POWERS) < n:
        full = np.full(max(n, 4096), 0x9E3779B97F4A7C15, dtype=np.uint64)
        full[0] = 1
        _POWERS = np.cumprod(full)
    return _POWERS


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of each word of each text in order, without regard to case."""
    points, lengths = code_points(texts)
    points = folded()[points]
    ends = np.cumsum(lengths)
    inside = points != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = ends[:-1][lengths[1:] > 0]  # a text's first character starts a word of its own
    first = first[first < len(points)]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    chars = points[inside].astype(np.uint64)
    number = np.cumsum(begin[inside]) - 1
    size = np.bincount(number)
    at = ragged_arange(size)
    heads = np.cumsum(size) - size
    hashed = mix64(np.add.reduceat((chars + np.uint64(1)) * powers(int(size.max()))[at], heads))
    return np.searchsorted(ends, starts, side="right"), hashed


def digest(text: str) -> "Column":  # noqa: F821
    """A text's 128-bit digest as a column expression; equal texts have equal ones."""
    from pyspark.sql import functions as F

    return F.unhex(F.md5(F.col(text)))


def rewritten(docs: DataFrame, change) -> DataFrame:
    """docs with each batch put through ``change``, whatever its columns are called (they pass by position)."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in change(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=[f"c{k}" for k in range(len(names))])

    return plain.mapInArrow(run, plain.schema).toDF(*names)
