"""What the operators share: tables in the shared folder, byte-level text arithmetic, components of a graph."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 4 << 20


# ------------------------------------------------------------------ tables in the shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets one in the machine's folder for
    temporary files; on a cluster the setting is needed."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints/cloakframe"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session's setting is value inside, and what it was behind."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidy(spark: SparkSession):
    """Inside, a finished step's shuffle files go at once: what later steps need is in the shared folder."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """What one call of an operator has written: files in the shared folder and tables of the warehouse."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths, self.tables = [], []


_OPEN: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)


def finished(operator):
    """An operator (its first argument is a DataFrame) whose result is written to the shared folder before it returns, so that
    all it wrote on the way, tables in the warehouse too, is removed. One called inside another leaves that to the outer one."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        if _OPEN.get() is not None:
            return operator(docs, *args, **kwargs)
        scratch = Scratch(docs.sparkSession)
        token = _OPEN.set(scratch)
        try:
            out = operator(docs, *args, **kwargs)
            _OPEN.set(None)
            return stored(out, operator.__name__)
        finally:
            _OPEN.reset(token)
            scratch.clear()

    return run


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _OPEN.get() is not None:
        _OPEN.get().paths.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back. An operator's own steps are removed when it has
    finished, its result with the application's folder."""
    spark = df.sparkSession
    path = table_path(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """df as a table of the warehouse in parts buckets by key, which later groups and joins by key read without an exchange."""
    spark, name = df.sparkSession, f"cloakframe_{name}_{uuid.uuid4().hex}"
    if _OPEN.get() is not None:
        _OPEN.get().tables.append(name)
    with tidy(spark):
        df.write.option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    return spark.table(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text")).alias("b")).first().b or 0


def blocks_for(n_bytes: int, each: int) -> int:
    return max(1, -(-n_bytes // each))


# ------------------------------------------------------------------ texts as byte arrays
def texts_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def in_blocks(batches, limit: int = BLOCK_BYTES, column: str = "text"):
    """Slices of the batches with at most limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = texts_of(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of x over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses, so that hashes of substrings are differences of prefix sums."""
    if len(_POW.get("p", ())) < n:
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = 1 << max(16, (n - 1).bit_length())
        for k, b in (("p", _BASE), ("i", inv)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _POW[k] = np.cumprod(a, dtype=np.uint64)
    return _POW["p"][:n], _POW["i"][:n]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of bytes a:b, whatever their place."""
    _, inv = powers(len(prefix))
    return mix((prefix[b] - prefix[a]) * inv[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; none crosses a document."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(a, offs)))


# ------------------------------------------------------------------ components
def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges.

    Alternating large-star and small-star steps; both only group by a node and join, so a hub's edges are
    pre-aggregated and a skewed join can be split. Each step is written to the shared folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct(),
            "edges",
        )
        # Settled: every node has one edge, and no node is both a centre and on an edge's far side.
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("k")), F.struct(F.col("v").alias("x"), F.lit(0).alias("k")))).alias("s"))
        ends = ends.groupBy("s.x").agg(F.sum("s.k").alias("s"), F.min("s.k").alias("k"), F.sum(F.hash("s.x", "s.k").cast("long")).alias("h"))
        now = ends.agg(F.sum(F.when(F.expr("s > 1 or (s = 1 and k = 0)"), 1).otherwise(0)).alias("open"), F.sum("h").alias("h")).first()
        if not now["open"] or now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
