"""Incremental runs: watermarks that move only on success, and streams.

The batch functions take the marks of the last run as a table and return the
next ones; a caller saves them only when everything has been written. The
streaming functions keep the same rules in Structured Streaming's own state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def after_marks(df: DataFrame, marks: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows later than their group's mark; late ones are dropped, groups without a mark are new."""
    m = marks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("mark").alias("__mark"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(m, cond, "left").where(F.col("__mark").isNull() | (F.col(time) > F.col("__mark"))).drop("__mark", *[f"__{k}" for k in keys])


def next_marks(marks: DataFrame, df: DataFrame, keys: Sequence[str], time: str, done: DataFrame | None = None) -> DataFrame:
    """Marks after a run: the latest time of each group, never earlier than before; only groups in `done` move if it is given."""
    new = df.groupBy(*keys).agg(F.max(time).alias("mark"))
    if done is not None:
        new = new.join(done.select(*keys).distinct(), list(keys), "left_semi")
    return marks.select(*keys, "mark").unionByName(new).groupBy(*keys).agg(F.max("mark").alias("mark"))


def all_or_nothing(marks: DataFrame, moved: DataFrame, failures: DataFrame) -> DataFrame:
    """The moved marks if no group failed, else those of before."""
    return marks if not failures.isEmpty() else moved


def last_runs(log: DataFrame, key: str = "app_id", time: str = "run_time", order: str = "seq") -> DataFrame:
    """An append-only log of runs: the last entry of each key."""
    return log.groupBy(key).agg(F.max_by(time, order).alias(time))


def pending(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows that no earlier run has decided."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def day_ranges(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Consecutive ranges of `days` days over [start, end]: range_start, range_end. start, end: timestamp columns of df."""
    starts = F.sequence(F.col(start), F.col(end), F.expr(f"interval {days} days"))
    t = df.select("*", F.explode(starts).alias("range_start"))
    return t.withColumn("range_end", F.least(F.col("range_start") + F.expr(f"interval {days} days"), F.col(end))).where(F.col("range_start") < F.col(end))


def tumbling(df: DataFrame, time: str, length: str, *keys: str, value: str = "value", late: str | None = None) -> DataFrame:
    """Counts and sums per window; with `late`, on a stream, rows later than that are dropped."""
    t = df.withWatermark(time, late) if late else df
    g = t.groupBy(F.window(time, length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sliding(df: DataFrame, time: str, length: str, step: str, *keys: str, late: str | None = None) -> DataFrame:
    t = df.withWatermark(time, late) if late else df
    g = t.groupBy(F.window(time, length, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def sessions(df: DataFrame, key: str, time: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key that a gap ends."""
    t = df.withWatermark(time, late) if late else df
    g = t.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_distinct(stream: DataFrame, keys: Sequence[str], time: str, within: str) -> DataFrame:
    """The first row of each key on a stream; state is kept as long as repeats may come."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def stream_turns(stream: DataFrame, group: str, order: str, speaker: str, eligible: str, epoch: str, gap: int = 180, timeout_ms: int = 600_000) -> DataFrame:
    """Answer turns of a live chat: a turn is sent when another message closes it, or after a time without any. Same rule as windows.answer_turns; messages of one trigger are taken in order."""
    out = f"{group} string, speaker string, start_epoch double, end_epoch double, n_messages long"
    state = "speaker string, start double, last double, n long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        cur = held.get if held.exists else (None, 0.0, 0.0, 0)

        def close() -> None:
            if cur[3]:
                done.append((key[0], *cur))

        if held.hasTimedOut:
            close()
            held.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values([epoch, order], kind="stable")
            for who, ok, at in zip(pdf[speaker], pdf[eligible], pdf[epoch], strict=True):
                if ok and cur[3] and who == cur[0] and 0 <= at - cur[2] <= gap:
                    cur = (who, cur[1], float(at), cur[3] + 1)
                else:
                    close()
                    cur = (who, float(at), float(at), 1) if ok else (None, 0.0, 0.0, 0)
            held.update(cur)
            held.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(done, columns=[group, "speaker", "start_epoch", "end_epoch", "n_messages"])

    return stream.groupBy(group).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_stream(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Drain what is there, batch by batch, writing each once: the offsets are committed only after `write` returns."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # state that waits for a time-out would otherwise keep the query running without data
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    q.awaitTermination()
    return q
