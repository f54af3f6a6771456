"""What the text operators share: shared-folder tables, Arrow text buffers, word spans."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import send

#: Text handled at once inside a Python worker, in bytes (a longer text is handled alone).
CHUNK_BYTES = 1 << 20


#: Rows and bytes of an Arrow batch, so that texts of any length keep batches small (a longer text is one by itself).
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ready(spark: SparkSession) -> None:
    """Sends this package to the workers, and keeps Arrow batches small unless the session says how large they are."""
    send(spark)
    for name, value in SMALL_BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


#: Folders of local sessions that name none.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session that has none gets one of its own: on a
    cluster, workers would not see a folder of the driver."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = spark.sparkContext.applicationId
        where = _local[own] = _local.get(own) or "file://" + tempfile.mkdtemp(prefix="triaxis-")
    return f"{where.rstrip('/')}/triaxis-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back. Results are lazy and read
    these tables, so they stay until `release`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all tables between that this application wrote; call it once its results are stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(docs: DataFrame, *added: str) -> DataFrame:
    """docs with every column that an added one would clash with renamed by underscores at its end."""
    taken = {c.casefold() for c in docs.columns} | {c.casefold() for c in added}
    names = []
    for c in docs.columns:
        if c.casefold() in {a.casefold() for a in added}:
            while c.casefold() in taken:
                c += "_"
            taken.add(c.casefold())
        names.append(c)
    return docs.toDF(*names) if names != docs.columns else docs


def apart(docs: DataFrame, text: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs as kept (all other columns) and whole (the text), so that a text goes to a worker once; and what makes rows of
    them again, with added columns: those of docs in their order, renamed where they clash, with or without the text."""
    others = [c for c in docs.columns if c != text]
    own = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.lit(True).alias("one")).alias("kept"), F.col(text).alias("whole"))

    def together(found: DataFrame, keep_text: bool = True, **added: Column) -> DataFrame:
        names = zip(docs.columns, clear(docs, *added).columns)
        back = [F.col("whole" if c == text else f"kept.c{others.index(c)}").alias(n) for c, n in names if keep_text or c != text]
        return found.select(*back, *[c.alias(n) for n, c in added.items()])

    return own, together


#: Spark says this or more of rows whose size it does not know.
UNKNOWN_SIZE = 1 << 60


def expected_bytes(rows: DataFrame) -> int:
    """The size that Spark expects of the rows, 0 if it has no idea; only to deal out work."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_SIZE else 0


#: Keys whose rows are joined without a shuffle.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Left join of rows with a (written) table that has each key once and the number of its rows in `weight`. Rows of
    the `HOT_KEYS` heaviest keys meet a broadcast of so many rows; only the others are shuffled."""
    hot = table.orderBy(F.desc(weight), *on).limit(HOT_KEYS).drop(weight)
    most = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(table.drop(weight), on, "left")
    return most.unionByName(others)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of a key written as text, modulo n (null for a null key)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and n + 1 offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes of text (or one row), with their buffers."""
    for batch in batches:
        data, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi
    trim()


def trim() -> None:
    """Gives memory that this worker no longer uses back, as workers wait for later tasks with all they hold."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


#: Bytes by which the driver's heap grows until it is collected, and its size after that by application.
GROWN = 64 << 20
_heap: dict[str, int] = {}


def trim_driver(spark: SparkSession) -> bool:
    """The same for the driver. A table that is written leaves plans, broadcasts and shuffle files as garbage; and what
    the JVM's many threads free natively stays with the C library, outside the heap and without a limit. False if
    this JVM can't be asked to give the latter back."""
    jvm, array, own = spark._jvm, spark.sparkContext._gateway.new_array, spark.sparkContext.applicationId
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > _heap.get(own, 0) + GROWN:
        gc.collect()  # of Python's hold on objects of the JVM
        jvm.java.lang.System.gc()
        _heap[own] = heap.totalMemory()
    trim()
    named = jvm.java.lang.Class.forName
    try:
        kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface, as the class of the server is not open to reflection
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


try:
    _libc = ctypes.CDLL(None)
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


_once: dict[str, tuple[str, object]] = {}


def forget() -> None:
    """Drops what a worker kept for an earlier step."""
    if _once:
        _once.clear()
        trim()


def once(kind: str, token: str, make):
    """What make() gives, kept by a worker until it is asked for another token or kind."""
    if kind not in _once or _once[kind][0] != token:
        forget()
        _once[kind] = (token, make())
    return _once[kind][1]


#: Odd multiplier of the rolling polynomial hashes, modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


VALUES = byte_values(1)


def prefix_sums(data: np.ndarray, values: np.ndarray = VALUES, base: np.uint64 = BASE) -> np.ndarray:
    """P[i]: hash of data[:i], from which the hash of any stretch follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(base, len(data)), out=out[1:])
    return out


#: Words of more bytes are hashed one by one.
LONG_WORD = 64
HEADS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[lo:hi]: eight bytes a step are mixed in, which is one to one for words of up
    to eight bytes and, unlike a polynomial, has no different words that collide by their structure; long words
    by xxh3."""
    size = hi - lo
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(np.uint64) + BASE) ^ (eight[lo] & HEADS[np.minimum(size, 8)])
    h = mix(h)
    for at in range(8, LONG_WORD, 8):
        some = np.flatnonzero(size > at)
        if not len(some):
            return h
        h[some] = mix(h[some] ^ (eight[lo[some] + at] & HEADS[np.minimum(size[some] - at, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[lo[i] : hi[i]])
    return h


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of word bytes; runs end where texts end."""
    flag = np.zeros(len(data) + 2, bool)
    flag[1:-1] = is_word[data]
    change = flag[1:] != flag[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = np.unique(cut[flag[cut] & flag[cut + 1]])
    edges = np.flatnonzero(change)
    if len(joined):
        edges = np.sort(np.concatenate([edges, joined, joined]))
    lo, hi = edges[::2], edges[1::2]
    return lo, hi, np.searchsorted(off, lo, "right") - 1


#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def with_columns(batch: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """The columns of `batch` to keep, and new ones."""
    kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*kept, *columns.values()], names=[*keep, *columns])
