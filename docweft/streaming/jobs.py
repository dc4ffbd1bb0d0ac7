"""Streams over Parquet folders: windows with watermarks, and state by key. Each has a batch twin with the same result.

``collect_stream`` hands the rows on in order of ts, whatever files they are in, so no row is late and each state sees its rows in
order. A stream by ``read_stream`` takes files as they come: rows before the watermark are dropped from windows, and rows that come
in a later batch than their followers count as coming after them.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where none is named and all is on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docweft-")
    return f"{base.rstrip('/')}/stream/{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 1000) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{sf_dir}/{name}[.]parquet")


def slices(rows: DataFrame, n: int) -> list[DataFrame]:
    """The rows in at most n ranges of ts, earliest first; rows of one ts are in one range, those without are in the last."""
    at = F.col("ts").cast("timestamp")
    found = rows.select(F.unix_micros(at).alias("t")).agg(F.percentile_approx("t", [k / n for k in range(1, n)] or [0.5], 100 * n).alias("q")).first()["q"]
    limits = sorted(set(found or []))[: n - 1]
    t = F.unix_micros(at)
    over = [t >= a for a in limits]
    return [
        rows.filter((over[k - 1] if k else F.lit(True)) & (~over[k] if k < len(limits) else F.lit(True)) | (t.isNull() if k == len(limits) else F.lit(False)))
        for k in range(len(limits) + 1)
    ]


def run_now(stream: DataFrame, mode: str, key: list[str], feed: Callable[[], bool] = lambda: False) -> DataFrame:
    """All that is there now: the stream runs until it has read its input; of each key the last batch's row counts.

    ``feed`` puts more input before the stream, which then goes on, and says whether it did. Batches are appended with their number, so a batch that is run again after a failure does not count twice.
    """
    spark = stream.sparkSession
    out = shared_folder(spark)

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/{n}")

    while True:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        if not feed():
            break
    columns, schema = stream.columns, stream.withColumn("_batch", F.lit(0)).schema
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/rows/none")  # there may have been nothing to read
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/rows")
    if not key:
        return rows.select(columns)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in columns if c not in key]), "_batch").alias("_last"))
    return last.select(*key, "_last.*").select(columns)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by type in fixed windows; what is later than the watermark is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def changes(events: DataFrame, key: str, at: list[str], state: str, out: list[str], schema: str) -> DataFrame:
    """Rows of each key that differ in ``state`` from the one before; the last state is kept between batches."""

    def run(k: tuple, frames, group: GroupState):
        before = group.get[0] if group.exists else None
        frame = pd.concat(list(frames)).sort_values(at)
        prior = frame[state].shift(1)
        prior.iloc[0] = before
        group.update((frame[state].iloc[-1],))
        yield frame[prior.isna() | (prior != frame[state])][out]

    return events.groupBy(key).applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def retries(events: DataFrame, schema: str = "user_id long, tries int, status string", most: int = 5) -> DataFrame:
    """A job's status: an error takes one of its tries, a purchase finishes it; tries and status are kept between batches."""

    def run(k: tuple, frames, group: GroupState):
        tries, status = group.get if group.exists else (0, "running")
        for kind in pd.concat(list(frames)).sort_values(["ts", "event_id"])["event_type"]:
            if kind == "error" and status == "running":
                tries += 1
                status = "failed" if tries >= most else "running"
            elif kind == "purchase" and status == "running":
                status = "done"
        group.update((tries, status))
        yield pd.DataFrame({"user_id": [k[0]], "tries": [tries], "status": [status]})

    return events.groupBy("user_id").applyInPandasWithState(run, schema, "tries int, status string", "update", GroupStateTimeout.NoTimeout)


def collect_stream(make: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str, name: str, mode: str, key: list[str], files_at_once: int = 1000) -> DataFrame:
    """A stream over a table, run over all that is there; tables of more files than ``files_at_once`` are put before it by ranges of ts."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    batches = math.ceil(len(rows.inputFiles()) / files_at_once)
    if batches <= 1:
        return run_now(make(read_stream(spark, sf_dir, name, files_at_once)), mode, key)
    into, parts = shared_folder(spark), iter(slices(rows, batches))

    def feed() -> bool:
        part = next(parts, None)
        if part is not None:
            part.write.mode("append").parquet(into)
        return part is not None

    feed()
    return run_now(make(spark.readStream.schema(rows.schema).parquet(into)), mode, key, feed)
