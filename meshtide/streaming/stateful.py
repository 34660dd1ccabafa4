"""Structured Streaming jobs: hysteresis per cell, a run monitor, station summaries.

The first two work in the order of event time: what arrives is held in state until
the watermark has passed it, and an event-time timer then hands it on. So any order
of arrival within the watermark gives the rows that a batch job gives; rows that
come later than the watermark are dropped. Rows newer than the watermark are held
back until it has passed them. They need a state store that transformWithState
supports, so the functions choose RocksDB for the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def _packed(us, h) -> tuple[bytes]:
    return (us.astype("<i8").tobytes() + h.astype("<f8").tobytes(),)


def _unpacked(chunks):
    import numpy as np

    us = [np.frombuffer(c, "<i8", len(c) // 16) for c in chunks]
    return np.concatenate(us), np.concatenate([np.frombuffer(c, "<f8", len(c) // 16, len(c) // 2) for c in chunks])


def _hysteresis(wet: float, dry: float):
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class InOrder(StatefulProcessor):
        """Each call to the state costs a round trip, so rows are held in packed chunks and a cell's flag (-1: none) and timer (0: none) in one value."""

        def init(self, handle):
            self.handle = handle
            self.now = handle.getValueState("now", "flag int, ms long")
            self.held = handle.getListState("held", "chunk binary")

        def handleInputRows(self, key, rows, timerValues):
            parts = [(p["us"].to_numpy("int64"), p["h"].to_numpy("float64")) for p in rows]
            us, h = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0), None)
            if len(us):
                self.held.appendValue(_packed(us, h))
                # a timer at the earliest held time, in place of the one there was
                flag, was = self.now.get() or (-1, 0)
                ms = int(us.min()) // 1000 + 1
                if not was or ms < was:
                    if was:
                        self.handle.deleteTimer(was)
                    self.handle.registerTimer(ms)
                    self.now.update((flag, ms))
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            us, h = _unpacked([c for (c,) in self.held.get()])
            order = np.lexsort((h, us))
            us, h = us[order], h[order]
            n = int(np.searchsorted(us, passed, "right"))
            ms = 0
            if n < len(us):
                self.held.put([_packed(us[n:], h[n:])])
                ms = int(us[n]) // 1000 + 1
                self.handle.registerTimer(ms)
            else:
                self.held.clear()
            flag, _ = self.now.get()
            us, h = us[:n], h[:n]
            told = np.where(h >= wet, 1, np.where(h <= dry, 0, -1))
            since = np.maximum.accumulate(np.where(told >= 0, np.arange(n), -1))
            now = np.where(since >= 0, told[since], max(flag, 0)) if n else told
            before = np.r_[flag, now[:-1]] if n else now
            change = np.where((before < 0) | (now == before), None, np.where(now > before, "wetting", "drying"))
            self.now.update((int(now[-1]) if n else flag, ms))
            yield pd.DataFrame({"cell": pd.Series([key[0]] * n, dtype=object), "us": us, "wet": now.astype("int32"), "change": change.astype(object)})

        def close(self):
            pass

    return InOrder()


def stream_hysteresis(depths: DataFrame, wet: float = 1e-3, dry: float = 5e-4, late: str = "1 hour") -> DataFrame:
    """Transitions ``cell, ts, wet, change`` (wetting, drying or none) of a stream ``(cell, ts, h)``, in the order of ``ts``.

    Of rows with one time the lower depth comes first. The state of a cell is its
    last flag and the rows that the watermark has not passed; rows with a null time
    or depth are left out.
    """
    keep_state_in_rocksdb(depths.sparkSession)
    rows = depths.where("ts is not null and h is not null").select("cell", "ts", F.unix_micros("ts").alias("us"), F.col("h").cast("double").alias("h")).withWatermark("ts", late)
    kind = depths.schema["cell"].dataType.simpleString()
    out = rows.groupBy("cell").transformWithStateInPandas(_hysteresis(wet, dry), f"cell {kind}, us long, wet int, change string", "append", "eventTime")
    return out.select("cell", F.timestamp_micros("us").alias("ts"), "wet", "change")


def _first_violation():
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Earliest(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.best = handle.getValueState("best", "us long, case_id string, reason string")
            self.told = handle.getValueState("told", "done boolean")

        def handleInputRows(self, key, rows, timerValues):
            if not self.told.exists():
                came = [(int(us), c, r) for part in rows for us, c, r in zip(part["us"], part["case_id"], part["reason"], strict=True)]
                before = tuple(self.best.get()) if self.best.exists() else None
                first = min([*came, *([before] if before else [])])
                if first != before:
                    if before:
                        self.handle.deleteTimer(before[0] // 1000 + 1)
                    self.best.update(first)
                    self.handle.registerTimer(first[0] // 1000 + 1)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if not self.told.exists():
                self.told.update((True,))
                yield pd.DataFrame([(key[0], *self.best.get())], columns=["run_id", "us", "case_id", "reason"], dtype=object)
                self.best.clear()

        def close(self):
            pass

    return Earliest()


def stream_violations(cases: DataFrame, limits: dict[str, float], late: str = "1 hour") -> DataFrame:
    """The case of each run that is the first, by time, whose diagnostics break a limit: ``run_id, ts, case_id string, reason``.

    A run is reported once, when the watermark has passed its earliest violation, so
    one that arrives later but happened earlier still counts. Of cases at one time
    the smaller id is taken. A missing diagnostic is a violation; rows with a null
    time are left out.
    """
    keep_state_in_rocksdb(cases.sparkSession)
    reason = F.coalesce(*[F.when(F.col(k) > v, k) for k, v in limits.items()], *[F.when(F.col(k).isNull(), f"{k} missing") for k in limits])
    rows = cases.withColumn("reason", reason).withWatermark("ts", late).where(F.when(F.col("ts").isNotNull(), F.col("reason")).isNotNull())  # names ts, so that it stays above the watermark, which sound cases move as well
    rows = rows.select("run_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce(F.col("case_id").cast("string"), F.lit("")).alias("case_id"), "reason")
    kind = cases.schema["run_id"].dataType.simpleString()
    out = rows.groupBy("run_id").transformWithStateInPandas(_first_violation(), f"run_id {kind}, us long, case_id string, reason string", "append", "eventTime")
    return out.select("run_id", F.timestamp_micros("us").alias("ts"), "case_id", "reason")


def stream_summary(readings: DataFrame, width: str = "90 minutes", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Count, mean and extremes of ``readings(series_id, ts, value)`` in sliding windows."""
    g = readings.withWatermark("ts", late).groupBy("series_id", F.window("ts", width, step).alias("w"))
    return g.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select("series_id", F.col("w.start").alias("begin"), "n", "mean", "low", "high")
