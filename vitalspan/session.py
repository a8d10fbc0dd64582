"""Session helpers: runtime SQL settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def local_session(cpus: int = 8, memory: str = "16g", app: str = "vitalspan") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


#: Megabytes of shuffled data that adaptive execution gives to one task, and
#: those of record tables: their rows are keys and days, ten bytes in a file and
#: a hundred in each hash map.
MERGED_MB, RECORDS_MB = 16, 4


def configure(spark: SparkSession, merged_mb: int = MERGED_MB) -> SparkSession:
    """Runtime settings every plan relies on.

    ``forceOptimizeSkewedJoin`` lets adaptive execution split a hot person's
    partition even when that costs one more exchange further up. Shuffled
    partitions are merged up to ``merged_mb``: keys and days take far more
    room in a task's sorts and hash maps than in shuffle files.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }.items():
        spark.conf.set(key, value)
    _at_most(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", merged_mb)
    return spark


def _at_most(spark: SparkSession, key: str, most_mb: int) -> None:
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if size > most_mb << 20:
        spark.conf.set(key, f"{most_mb}m")


#: Megabytes of files that one task of a record plan reads.
SPLIT_MB = 8
#: Megabytes up to which a table is broadcast by the size of its files, and by
#: that of its measured rows. In a hash table of a key and a day a byte in a file
#: takes fifteen and a byte of a row seven.
UNMEASURED_MB, MEASURED_MB = 1, 4


def configure_records(spark: SparkSession) -> SparkSession:
    """``configure`` for plans on record tables.

    Spark cuts files into one split for each core, up to 128 MB. What a task
    holds of its split, in hash maps and shuffle buffers, would grow so far.
    Broadcast tables pass through the driver, several at a time: one beyond
    ``UNMEASURED_MB`` of files is sent only if adaptive execution has measured
    at most ``MEASURED_MB`` of rows.
    """
    configure(spark, RECORDS_MB)
    _at_most(spark, "spark.sql.files.maxPartitionBytes", SPLIT_MB)
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, spark.conf.get(limit))
    _at_most(spark, measured, MEASURED_MB)
    _at_most(spark, limit, UNMEASURED_MB)
    return spark


#: Bytes of a table's files for each shuffled partition before merging.
INPUT_BYTES = 3 << 20


def size_shuffles(spark: SparkSession, path: str) -> None:
    """Lets shuffles start with a partition for every ``INPUT_BYTES`` of the
    largest table read so far, if ``spark.sql.shuffle.partitions`` gives fewer.

    Adaptive execution only merges partitions and splits those of skewed joins.
    With a fixed number of them a task's sorts and hash maps would grow with
    the input; so the number does, and what is small is merged again.
    """
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    wanted = -(-files.getContentSummary(there).getLength() // INPUT_BYTES)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if wanted > int(spark.conf.get(initial, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(initial, str(wanted))


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it,
    whatever folder they start in; an installed package needs none of it."""
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir`` when the
    cluster sets it, else a fresh local folder (single-machine runs only)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = getattr(spark, "_vitalspan_scratch", None)
    if root is None:
        root = tempfile.mkdtemp(prefix="vitalspan-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark._vitalspan_scratch = root
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Statements begun here remove their shuffle files when they end, not when
    the driver happens to collect its garbage. Blocks may overlap."""
    with _cleaning:
        depth, before = getattr(spark, "_vitalspan_cleaning", (0, None))
        if not depth:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        spark._vitalspan_cleaning = depth + 1, before
    try:
        yield
    finally:
        with _cleaning:
            depth, before = spark._vitalspan_cleaning
            spark._vitalspan_cleaning = depth - 1, before
            if depth == 1:
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame that several jobs reuse and read it back.

    The files outlive lost executors and cut the lineage, unlike block
    storage on the executors themselves. The shuffle files behind them go.
    """
    path = scratch_path(df.sparkSession, label)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._vitalspan_path = path
    return written


def discard(written: DataFrame) -> None:
    """Removes what ``materialize`` wrote, once no frame reads it any more."""
    spark = written.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(written._vitalspan_path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def concurrently(spark: SparkSession, jobs: Sequence[Callable[[], T]], workers: int = 4) -> list[T]:
    """Results of jobs that do not depend on each other, in their order.

    At most ``workers`` are submitted at a time, each in its own scheduler
    pool, so that under a fair scheduler small fits fill what a large one
    leaves idle. The first failure is raised when all have ended.
    """
    def call(i: int) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % workers}")
        try:
            return jobs[i]()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(workers, len(jobs)))) as pool:
        return list(pool.map(call, range(len(jobs))))


#: Rows that stand in a plan as literals.
INLINE_ROWS = 1000


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-side table: short ones (settings, code lists) inline, so that
    Catalyst sees their size; lists of any length as a written table."""
    if len(rows) > INLINE_ROWS:
        return materialize(spark.createDataFrame(rows, schema), "list")

    def text(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, float):
            return f"{v!r}D"
        return str(v)

    fields = [f.strip().split(" ") for f in schema.split(",")]
    if not rows:
        nulls = ", ".join(f"cast(null as {t}) as {n}" for n, t in fields)
        return spark.sql(f"SELECT {nulls} WHERE false")
    names = ", ".join(n for n, _ in fields)
    casts = ", ".join(f"cast({n} as {t}) as {n}" for n, t in fields)
    body = ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
