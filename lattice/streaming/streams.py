"""Streaming: replace-by-source updates, query logs, stateful decayed scores; event-time windows as additions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lattice.operators.merge import last_wins, replace_by_source
from lattice.storage import shared_dir


class SnapshotStore:
    """Versions of a table in one folder; a pointer file names the live one, written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        target, fs = self._file("")
        if not fs.exists(target):
            return -1
        found = [s.getPath().getName() for s in fs.listStatus(target)]
        return max((int(n[5:]) for n in found if n.startswith("live-")), default=-1)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v >= 0 else None

    def write(self, df: DataFrame) -> None:
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        target, fs = self._file(f"live-{v}")
        fs.create(target, True).close()


def upsert_stream(stream: DataFrame, store: SnapshotStore, checkpoint: str, trigger: dict | None = None):
    """Each micro-batch replaces, in the store, every source file that it brings rows of; the last row per id wins."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = last_wins(batch, ["id"]) if "ord" in batch.columns else batch
        old = store.read()
        store.write(new if old is None else replace_by_source(old, new))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changed_paths(events: DataFrame, gap: str = "3 seconds") -> DataFrame:
    """Watch with a debounce: a path's changes until nothing came for ``gap`` are one. events: ts, path."""
    return events.withWatermark("ts", gap).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("changes")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "changes")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """An append-only JSON log of a query stream."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def decayed_scores(events: DataFrame, half_life_days: float = 30.0) -> DataFrame:
    """Running decayed score per node: state is (score, last time), so late data of any age adds its decayed share.

    events: node, ts, sign.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, last = state.get if state.exists else (0.0, 0.0)
        for pdf in batches:
            for t, sign in sorted(zip(pdf.ts.astype("int64") / 1e9 if pdf.ts.dtype.kind != "M" else pdf.ts.astype("datetime64[us]").astype("int64") / 1e6, pdf.sign, strict=True)):
                newest = max(last, t)
                score = score * 0.5 ** ((newest - last) / 86400 / half_life_days) + sign * 0.5 ** ((newest - t) / 86400 / half_life_days)
                last = newest
        state.update((score, last))
        yield pd.DataFrame({"node": [key[0]], "score": [score], "last": [last]})

    return events.groupBy("node").applyInPandasWithState(update, "node string, score double, last double", "score double, last double", "update", GroupStateTimeout.NoTimeout)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as an instant; a watermark on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An addition: counts and sums per type in event-time windows with a watermark."""
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = _timed(events, late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}"
