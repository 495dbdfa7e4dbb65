"""What the operators share: table readers, the shared folder, text helpers.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``.  Splitting UTF-8
bytes with ``bytes.split()`` gives exactly these words, as all six separators
are single ASCII bytes.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of what separates words.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Java and RE2 pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where unset, a new one if driver and executors are one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='strataflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/strataflow/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: later stages survive the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataflow_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    path = df._strataflow_path
    remove(df.sparkSession, path)
    _written.remove((df.sparkSession, path))


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int):
    """Arrow batches of about ``size`` bytes in queries that are run inside."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def whole_groups(batches, keys: list[str]):
    """Arrow batches of the same rows in which no run of equal keys (without nulls) is cut; rows come ordered by the keys."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        end = tuple(c[-1] for c in columns)
        begin = n - int(np.argmin(np.logical_and.reduce([c[::-1] == e for c, e in zip(columns, end)]))) if any((c != e).any() for c, e in zip(columns, end)) else 0
        if held and last is not None and (begin or last != end):
            # the held run ends in this batch, or just before it
            yield pa.Table.from_batches([*held, batch.slice(0, begin)]).combine_chunks().to_batches()[0]
            held = [batch.slice(begin)]
        elif begin:
            yield batch.slice(0, begin)
            held = [batch.slice(begin)]
        else:
            held.append(batch)
        last = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tidied(f):
    """Of a function of Arrow batches: at its end the worker gives freed memory back, as it stays for later stages."""

    @functools.wraps(f)
    def run(batches, **how):
        import pyarrow as pa

        yield from f(batches, **how)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clean_up() -> None:
    """Delete the intermediate tables of this process."""
    while _written:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # the session may have ended already
            return


def fresh(name: str, taken) -> str:
    """The name, with underscores before it until no column is called so (in whatever case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 5, is 0; null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_count(text="text"):
    """Number of words as a column (null and empty texts: 0)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.filter(F.split(t, SEPARATORS), lambda w: w != "")), F.lit(0)).cast("long")


def text_slices(batch, column: str = "text", chars: int = 2_000_000):
    """Cuts an Arrow batch into (first row, texts) of about ``chars`` bytes of text, one row at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > chars:
            yield first, texts.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += size
    if len(sizes) > first:
        yield first, texts.slice(first).to_pylist()


def array_slices(batch, column: str = "text", size: int = 1_000_000):
    """Cuts an Arrow batch into (first row, large binary array without nulls) of about ``size`` bytes, one row at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "").cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.frombuffer(LOWER_AZ, np.uint8).astype(np.uint64) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base modulo 2^64, and their inverses."""
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(n + n // 8, base, np.uint64)])
    return _powers[0], _powers[1]


class ByteWords:
    """The words of an array of texts, found and hashed in their bytes without a Python object for each.

    ``start`` and ``end`` are places in ``data``, ``first`` the number of each
    text's first word (and the end), ``hash`` 64-bit hashes of words with A-Z in
    lower case.
    """

    def __init__(self, texts):
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        self.data = data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        word = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[self.offsets] = True
        before = np.r_[False, word[:-1]] & ~edge[:-1] if len(data) else word
        after = np.r_[word[1:], False] & ~edge[1:] if len(data) else word
        self.start, self.end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        power, inverse = powers(len(data))
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(_LOWER[data] * power[: len(data)])]
            h = (sums[self.end] - sums[self.start]) * inverse[self.start]
            h += (self.end - self.start).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(29)
        self.hash = h
