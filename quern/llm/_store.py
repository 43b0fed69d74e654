"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


#: A table of at most so many narrow rows may be handled by one task, and one of BROADCAST_ROWS (at most 32 bytes each) sent to all.
ONE_TASK_ROWS = 100_000
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if a count finds that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def few(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, as one partition if a count finds that it is very small."""
    return df.coalesce(1) if df.count() <= ONE_TASK_ROWS else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a single-JVM ``local[...]`` session without the setting gets a folder
    of its own; on a cluster a missing setting is an error, since a
    machine-local folder would not be seen by the other machines.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}/{tag}"


BATCH_BYTES = 4 << 20


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage, keeps a Python or shuffle stage from running twice, and
    lets the planner see the real size (a side is then broadcast only below
    spark.sql.autoBroadcastJoinThreshold).  The files survive lost executors.
    Python workers get Arrow batches of at most about BATCH_BYTES.
    """
    path = new_path(df.sparkSession, tag)
    with arrow_bytes(df.sparkSession, BATCH_BYTES):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of the bytes of ``df``, without a job, 1 GB if it has none; for sizes that change costs only, never results."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 1 << 30


def bits_for(wanted: int, least: int, most: int) -> int:
    """The bits of a number of at least ``wanted`` places, held between ``least`` and ``most``."""
    return min(max(max(wanted, 1).bit_length(), least), most)


@contextlib.contextmanager
def arrow_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Inside, tables that are written get Arrow batches of at most about ``most`` bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    for df in tables:
        if df is None:
            continue
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles() if "/quern/" in f}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        made = Path(tempfile.mkdtemp(prefix="quern-code-")) / f"{top.name}.zip"
        with zipfile.ZipFile(made, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(made))
        atexit.register(shutil.rmtree, made.parent, ignore_errors=True)
        _shipped.add(app)
