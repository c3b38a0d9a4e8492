"""Helpers of the training-data operators: scratch tables, byte slices, connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that setCheckpointDir was given (tests).

    Only in local mode, where driver and executors are one process, a temporary folder is made; on a cluster executors couldn't see it, and an error is raised.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):  # one process: the driver's folder is the executors' too
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuscle-checkpoint-"))
        return sc._jsc.sc().getCheckpointDir().get()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_root(spark: SparkSession) -> str:
    """A folder of this session below :func:`shared_dir`; it is removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        root = _scratch[app] = f"{shared_dir(spark).rstrip('/')}/corpuscle-{app}-{uuid.uuid4().hex[:8]}"

        def clean() -> None:
            try:
                _delete(spark, root)
            except Exception:  # the session may have ended first
                pass

        atexit.register(clean)
    return _scratch[app]


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table of :func:`written` whose successor is written."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]}:
        _delete(table.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        name = f"_{n}"
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs with one row of each group, all columns as they are.

    named has doc_id, digest (xxhash64 of the text) and root (the group) of every row of docs. The row with the
    smallest doc_id stays, of these that with the smallest digest; a null id comes after all others. Unlike texts of one id
    are different documents, which stay if they are of different groups; of rows that agree in id and text one stays.
    """
    key, digest = fresh(docs, "key", "digest")
    name = lambda i, d: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), d.cast("string"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("r"))
    keep = first.select(name(F.col("r.doc_id"), F.col("r.digest")).alias(key))
    rows = docs.withColumn(digest, F.xxhash64("text")).withColumn(key, name(F.col("doc_id"), F.col(digest)))
    return rows.join(keep, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def lowest(rows: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """The n rows of the lowest hash of keys; total is the number of rows.

    A limit on the hash that lets a few more than n rows pass (by ten deviations) comes first,
    so that the tasks don't each send n rows to the one that takes the first n.
    """
    share = (n + 10 * n**0.5 + 10) / max(total, 1)
    some = rows if share >= 1 else rows.where(F.xxhash64(*keys) < F.lit(int((2 * share - 1) * (1 << 63))))
    return some.orderBy(F.xxhash64(*keys), *keys).limit(n)


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit; a larger row gets a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def release() -> None:
    """Gives memory that isn't used any more back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What the operators keep between the tasks of one worker, by module; another operator's first task empties it.
memories: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with the memories of other operators emptied at its beginning and :func:`release` at its end: workers outlive their tasks."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module in [m for m in memories if m != run.__module__]:
            memories.pop(module)()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges, for each node that has an edge.

    Alternating large-star and small-star steps. A step sends each edge to at
    most two places, minima are combined before the shuffle, and the tables of
    the steps are written to the shared folder, so nothing depends on one
    executor and nothing is gathered. Null ends and loops are ignored.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u > v").distinct()
    e = written(e, "edges")

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(last)
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def workers_import(spark: SparkSession) -> None:
    """Lets the Python workers import this package from the folder that the driver has it from (one that they see as well, or is sent with --py-files)."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
