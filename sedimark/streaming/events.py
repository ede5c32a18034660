"""Structured Streaming twins (X operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """File stream of an event table; `ts` becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """n, total per window and event type; with `late`, rows older than the watermark are left out of a stream."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def live_pairs(statements: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Live pairs of an edit stream (key, n, kind, a, b), one row per key and batch with its number of live pairs, emits and retracts.

    State is the key's live pairs and counters; keys without news for ttl_ms are forgotten, which bounds it (None: kept for good, for
    streams that end)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        live, emits, retracts = state.get if state.exists else ([], 0, 0)
        pairs = {tuple(p) for p in live}
        for pdf in frames:
            for _, kind, a, b in pdf.sort_values("n")[["n", "kind", "a", "b"]].itertuples(index=False):
                pair = (int(min(a, b)), int(max(a, b)))
                if kind == "contact":
                    pairs.add(pair)
                    emits += 1
                else:
                    pairs.discard(pair)
                    retracts += 1
        state.update(([list(p) for p in sorted(pairs)], emits, retracts))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([[key[0], len(pairs), emits, retracts]], columns=["key", "n_live", "emits", "retracts"])

    return statements.groupBy("key").applyInPandasWithState(fold, "key long, n_live long, emits long, retracts long", "live array<array<int>>, emits long, retracts long", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def running_average(values: DataFrame, decay: float = 0.9) -> DataFrame:
    """Exponential average per key of a stream (key, n, value), updated per batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, frames, state: GroupState):
        import pandas as pd

        (mean, count) = state.get if state.exists else (0.0, 0)
        for pdf in frames:
            for v in pdf.sort_values("n")["value"]:
                mean = float(v) if count == 0 else decay * mean + (1 - decay) * float(v)
                count += 1
        state.update((mean, count))
        yield pd.DataFrame([[key[0], mean, count]], columns=["key", "mean", "count"])

    return values.groupBy("key").applyInPandasWithState(fold, "key long, mean double, count long", "mean double, count long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there (available now) into a table in memory, and returns it."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
