"""Structured Streaming: change feeds, windows, shared-event caches and write limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import new_path


def read_feed(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the checkpoint keeps the position, so a restart resumes."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def latest_events(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each event once: repeats within the watermark go."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, delay: str, size: str, slide: str | None, *by: str) -> DataFrame:
    """Tumbling or sliding counts with late rows up to the watermark."""
    win = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, delay).groupBy(win, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, at: str, delay: str, gap: str, by: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def write_limiter(stream: DataFrame, session: str, at_us: str, order: str, limit: int = 10, window_s: int = 60, forget_ms: int | None = None) -> DataFrame:
    """(session, order, admitted): at most ``limit`` admitted rows of a session within ``window_s`` seconds.

    State is the instants admitted last, ``limit`` at most.  With ``forget_ms`` an idle session is forgotten;
    leave it out under an available-now trigger, which would wait for timeouts for ever.
    """

    def walk(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(parts)).sort_values([at_us, order])
        flags = []
        for t in pdf[at_us]:
            recent = [x for x in recent if x > t - window_s * 1_000_000]
            ok = len(recent) < limit
            if ok:
                recent.append(int(t))
            flags.append(ok)
        state.update((recent,))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({session: pdf[session], order: pdf[order], "admitted": flags})

    kinds = dict(stream.dtypes)
    return stream.groupBy(session).applyInPandasWithState(walk, f"`{session}` {kinds[session]}, `{order}` {kinds[order]}, admitted boolean", "recent array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)


def event_cache(stream: DataFrame, channel: str, key: str, position: str, most: int = 256) -> DataFrame:
    """(channel, keys): the ``most`` newest distinct keys of a channel, newest last, after every batch."""

    def walk(group, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict(zip(*state.get)) if state.exists else {}
        for pdf in parts:
            for k, p in zip(pdf[key], pdf[position]):
                if k not in kept or kept[k] < p:
                    kept[k] = int(p)
        newest = sorted(kept.items(), key=lambda x: (x[1], x[0]))[-most:]
        state.update(([k for k, _ in newest], [p for _, p in newest]))
        yield pd.DataFrame({channel: [group[0]], "keys": [[k for k, _ in newest]]})

    kinds = dict(stream.dtypes)
    return stream.groupBy(channel).applyInPandasWithState(walk, f"`{channel}` {kinds[channel]}, keys array<{kinds[key]}>", f"ks array<{kinds[key]}>, ps array<bigint>", "update", GroupStateTimeout.NoTimeout)


def apply_stream(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str):
    """Runs ``apply`` on every micro-batch (a change feed into a bucketed table, for one), then stops at the end of input.

    A batch that is replayed after a failure must not matter: applying a change feed twice changes nothing.
    """
    query = stream.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_files(df: DataFrame, mode: str = "append") -> DataFrame:
    """The whole available input through a streaming query into parquet files of the shared folder, read back.

    In ``complete`` mode every micro-batch holds the whole result, so the last one counts.
    """
    spark = df.sparkSession
    out, at = new_path(spark, "stream"), new_path(spark, "offsets")
    query = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", out).parquet(f"{out}/*")
    if mode == "complete":
        got = got.where(F.col("batch") == got.agg(F.max("batch")).first()[0])
    return got.drop("batch")
