"""Shared pieces of the training-data operators: text kernels on Arrow buffers, and lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once; one longer text is taken alone.
SLICE_BYTES = 1 << 19
#: Bytes up to which the tables of powers are kept.
_KEPT = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_COMBINE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Largest number of keys that `met` broadcasts: those that hold at least one row of so many.
HEAVY = 500
#: Share of its limit beyond which the driver's heap is collected when a table has been stashed.
GROWN = 0.5
#: Stashed tables of this driver that still stand, oldest first.
_standing: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets
    a fresh one; on a cluster that is an error, since executors would write their own disks."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def _file_system(df: DataFrame):
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stash_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), path


def _tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown beyond GROWN of its limit. Plans with many exchanges leave
    hundreds of MB of it; the JVM would take its whole limit first, and keep shuffles that nothing reads any more."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > GROWN * runtime.maxMemory():
        gc.collect()  # Python's handles hold the JVM's frames
        spark._jvm.java.lang.System.gc()


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither recompute it nor depend on an executor. The
    files go when they are discarded or swept, and with the session at the latest."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tidy(df.sparkSession)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.stash_path = path
    fs, there = _file_system(held)
    fs.deleteOnExit(there)
    _standing.append(held)
    return held


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more, such as an earlier round's."""
    fs, there = _file_system(df)
    fs.delete(there, True)
    fs.cancelDeleteOnExit(there)
    _standing[:] = [x for x in _standing if x is not df]


@contextlib.contextmanager
def sweeping(keep: list[DataFrame]):
    """Discard the tables stashed inside but those of keep, which the body fills: for code that has its whole result."""
    before = len(_standing)
    yield
    for df in [x for x in _standing[before:] if all(x is not k for k in keep)]:
        discard(df)


def met(rows: DataFrame, found: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows with what found, which has no more than `count` as the number of rows of each key, says of their keys.

    A key with one row of HEAVY or more of all `total` rows is broadcast; there are at most HEAVY such keys, and their rows
    stay where they are. The others meet in a shuffle, in which no key exceeds that share. The column `count` goes.
    """
    found = stash(found)
    often = F.col(count) * HEAVY >= total
    heavy, light = found.where(often).drop(count), found.where(~often).drop(count)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light.hint("merge"), keys))


def quoted(name: str) -> str:
    """A column name as Spark's expressions and schemas read it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df by name, for a frame that has them too."""
    return [F.col(quoted(c)) for c in df.columns]


def numbered(df: DataFrame, *kept: str) -> DataFrame:
    """df with numbers for the names of all columns but the kept ones: functions on Arrow batches take no names with dots."""
    taken = {c.lower() for c in kept}
    return df.toDF(*[c if c.lower() in taken else f"c{i}_" for i, c in enumerate(df.columns)])


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores behind them as keep them apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run):
    """Let a task give freed memory back when it ends: its Python worker lives on for later stages."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 in _powers and len(_powers[0][0]) >= n:
        return _powers[0]
    size = n if n > _KEPT else 1 << max(16, (n - 1).bit_length())  # those for one very long text are not kept
    tables = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _BASE_INVERSE))
    if n <= _KEPT:
        _powers[0] = tables
    return tables


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most limit bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (null counts as empty) and the n + 1 offsets of its rows."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return held, at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word `[^\\x20\\x09-\\x0D]+`, and the number of words of each row."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def text_parts(data: np.ndarray, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Spans of about limit bytes that end before a white space, so that no word is cut: what bounds the memory that one
    very long text takes. A longer word stays whole."""
    space = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    near = np.searchsorted(space, np.arange(limit, len(data), limit))
    edges = [0, *np.unique(space[near[near < len(space)]]).tolist(), len(data)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


def byte_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over all bytes from which span_hashes takes any span's hash, and the matching inverse powers."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def span_sums(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte span before its finaliser: enough where its high bits find a place in a table."""
    prefix, inverse = sums
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def span_hashes(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    prefix, inverse = sums
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes of ascending spans that don't overlap, worked out for about SLICE_BYTES of data at a time."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        out[at:to] = span_hashes(byte_sums(data[base : ends[to - 1]]), starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its width-word shingles over the A-Z-lowered text; the
    whole sequence as one where it has fewer words; empty without words."""
    data, offsets = utf8(texts)
    data = lower_ascii(data)
    starts, ends, counts = word_bounds(data, offsets)
    words = hashes_of(data, starts, ends)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _COMBINE[k]
    rolled = mix(rolled)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i, c in enumerate(counts.tolist()):
        a = first[i]
        if c >= width:
            out.append(np.unique(rolled[a : a + c - width + 1]))
        elif c:
            whole = np.sum(words[a : a + c] * _COMBINE[:c], dtype=np.uint64) ^ _COMBINE[64 - c]
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
