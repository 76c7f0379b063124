"""What the operators share: reading tables, scratch tables, Arrow text buffers and word hashes.

Words are runs of ``[^\\x20\\x09-\\x0D]``. On UTF-8 bytes these are the runs that ``bytes.split()`` gives.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one vectorised step takes at most (a single longer document is one step of its own).
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder. Where none is set, local sessions (tests) take one under /tmp; a cluster has no
    folder that all machines see, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{(root or 'file:///tmp/lattis-scratch').rstrip('/')}/lattis-{uuid.uuid4().hex}"


def fresh(docs: DataFrame, name: str) -> str:
    """name, lengthened until no column of docs has it (names are compared without case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key counts as hot beyond this share of all rows; at most HOT_SHARE keys can.
HOT_SHARE, HOT_ROWS = 1000, 500


def looked_up(rows: DataFrame, values: DataFrame, key: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with values (key, others and ``copies``, the key's rows) on key. Keys with over a thousandth of all rows are
    broadcast - there can't be more than a thousand - so none of them meets in one task; the others are joined by a shuffle."""
    hot = values.where(F.col("copies") > max(HOT_ROWS, total // HOT_SHARE)).drop("copies")
    cold = values.where(F.col("copies") <= max(HOT_ROWS, total // HOT_SHARE)).drop("copies")
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(cold, key, how))


#: How scratch files are written where the shared folder is a mounted one: without checksum files. Without Hadoop's native library every
#: file and folder starts a process (chmod) from the JVM: 66 for 20 files with checksums, 45 for 20 without.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    df.write.options(compression="zstd", **_PLAIN).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # the first round frees the JVM's side of Python objects
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored() table that is no longer read."""
    sc = df.sparkSession.sparkContext
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {}
_IDLE: list = []
#: Seconds after which a Python worker that waits for a task lets its table go.
IDLE_SECONDS = 10.0


def trimmed() -> None:
    """Gives the memory of freed batches and tables back to the system, where the system can take it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _let_go() -> None:
    _HELD.clear()
    gc.collect()
    trimmed()


def held(key: object = None, make: Callable | None = None):
    """The large table that a Python worker keeps between tasks. A worker holds one: asking for another, or for none, frees it, so a
    stage doesn't carry the tables of the stages before it. idle() frees it where no Python stage follows."""
    while _IDLE:
        _IDLE.pop().cancel()
    if key not in _HELD:
        if _HELD:
            _let_go()
        if make:
            _HELD[key] = make()
    return _HELD.get(key)


def idle() -> None:
    """Called when a task has ended: without another one soon, the table goes."""
    _IDLE.append(threading.Timer(IDLE_SECONDS, _let_go))
    _IDLE[-1].daemon = True
    _IDLE[-1].start()


def numbered(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ...: mapInArrow can't take names with dots or backticks."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, whatever else docs holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data, offs


def steps(offs: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLES = {False: _TABLE, True: _TABLE[_LOWER]}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in data[offs[0]:offs[-1]], and the row bounds: words of row i are bounds[i]:bounds[i+1]."""
    base, end = int(offs[0]), int(offs[-1])
    inside = ~_IS_SPACE[data[base:end]]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    cut = np.zeros(len(inside) + 1, bool)  # a row starts here
    cut[offs - base] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first) + base, np.flatnonzero(last) + base + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word from prefix sums of a polynomial, in steps of bounded size."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP_BYTES, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        p, inv = _powers(max(b - a + 1, 1 << 16))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLES[lower][data[a:b]] * p[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    if len(_POWERS[0]) > 4 * STEP_BYTES:
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words (the caller leaves out those across rows)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += h[i : len(h) - k + 1 + i]
    return mix(out)


def sql_words(text: str = "text") -> str:
    """Spark SQL for the array of words of a text; null counts as empty."""
    return f"filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')"
