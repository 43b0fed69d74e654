"""The append-only metrics ledger as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the ledger.
LEDGER = (
    "run_id string, seed long, cell string, split_hash string, client_id string, round long, n_train_samples long, "
    "metric_name string, metric_value double, bytes_up long, bytes_down long, wall_time double"
)


def ledger_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of CSV files that are added to a folder."""
    return spark.readStream.schema(LEDGER).option("header", True).csv(folder)


def latest_by_client(rows: DataFrame, cell: str, metric: str) -> DataFrame:
    """Per client the value of its highest round, the highest of several; works on a stream in complete mode too."""
    mine = rows.where((F.col("cell") == cell) & (F.col("metric_name") == metric))
    return mine.groupBy("client_id").agg(F.max_by("metric_value", F.struct("round", "metric_value")).alias("value"), F.max("round").alias("round"))


def missing_cells(rows: DataFrame, clients: list[str], rounds: int) -> DataFrame:
    """(round, client_id) of rounds 1..rounds that have no row."""
    spark = rows.sparkSession
    each = spark.range(1, rounds + 1).select(F.col("id").alias("round"), F.explode(F.array(*[F.lit(c) for c in clients])).alias("client_id"))
    return each.join(rows.select("round", "client_id").distinct(), ["round", "client_id"], "left_anti")


def by_hour(events: DataFrame, late: str | None = "10 minutes") -> DataFrame:
    """(event_type, hour, n, total) in windows of an hour; on a stream, rows later than ``late`` are left out once a window is closed."""
    rows = events.withWatermark("ts", late) if late else events
    hours = rows.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return hours.select("event_type", F.col("w.start").alias("hour"), "n", "total")


def foreign_rows(rows: DataFrame, run_id: str, seed: int, cell: str, split_hash: str) -> DataFrame:
    """Ledger rows of another run, seed, cell or split: none may be there before rows are appended."""
    want = {"run_id": run_id, "seed": seed, "cell": cell, "split_hash": split_hash}
    same = F.lit(True)
    for c, v in want.items():
        same &= F.col(c).eqNullSafe(F.lit(v))
    return rows.where(~same)


def log_rows(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A row (keys, metric_name, metric_value) for each entry of the map column ``metrics``, null values left out."""
    each = metrics.select(*keys, F.explode("metrics").alias("metric_name", "metric_value"))
    return each.where("metric_value is not null")
