"""Streams of projections and events with Structured Streaming, and the same results in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums for each window; on a stream, windows close when the watermark passes them."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    out = df.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    df = events.withWatermark(ts, late) if events.isStreaming else events
    out = df.groupBy(F.window(ts, width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with less than a gap between them."""
    df = events.withWatermark(ts, late) if events.isStreaming else events
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def last_write_wins(slices: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """Of slices with the same index the one that arrived last: what an out-of-order buffer holds at the end."""
    others = [c for c in slices.columns if c not in key]
    best = slices.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(arrival, *[c for c in others if c != arrival])).alias("_s"))
    return best.select(*key, *[F.col(f"_s.{c}").alias(c) for c in others]).select(*slices.columns)


def ordered(slices: DataFrame, index: str) -> DataFrame:
    """Slices in the order of their index: ranges over partitions, sorted within."""
    return slices.repartitionByRange(index).sortWithinPartitions(index)


def ordered_buffer(stream: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """(group, index, value) of a stream in the order of the index, from 0 on, each as soon as all before it are there.

    The state of a group holds what has come too early; a second arrival overwrites a first that still waits; what was
    released is final, and later arrivals of it are dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting_i, waiting_v = state.get if state.exists else (0, [], [])
        waiting = dict(zip(waiting_i, waiting_v, strict=True))
        for pdf in batches:
            for i, v in zip(pdf[index], pdf[value], strict=True):
                if i >= following:
                    waiting[int(i)] = float(v)
        out = []
        while following in waiting:
            out.append((following, waiting.pop(following)))
            following += 1
        state.update((following, list(waiting), list(waiting.values())))
        if out:
            yield pd.DataFrame({group: [key[0]] * len(out), index: [i for i, _ in out], value: [v for _, v in out]})

    return stream.groupBy(group).applyInPandasWithState(
        release, f"{group} {kinds[group]}, {index} long, {value} double", "following long, waiting array<long>, held array<double>", "append", GroupStateTimeout.NoTimeout
    )


def online_back_projection(contributions: DataFrame) -> DataFrame:
    """The image so far: contributions (y, x, v) of views are added up as they arrive (update or complete mode)."""
    return contributions.groupBy("y", "x").agg(F.sum("v").alias("v"))


def with_context(slices: DataFrame, index: str, value: str, before: int, after: int, by: list[str]) -> DataFrame:
    """Each slice with the values around it; a slice is only given where its whole context is there."""
    w = Window.partitionBy(*by).orderBy(index)
    frame = w.rowsBetween(-before, after)
    out = slices.withColumn("context", F.collect_list(value).over(frame))
    return out.filter(F.size("context") == before + after + 1)


def chain(slices: DataFrame, tools: list, value: str = "v") -> DataFrame:
    """Tools (functions of a column) one after the other; Catalyst makes one stage of them."""
    v: Column = F.col(value)
    for t in tools:
        v = t(v)
    return slices.withColumn(value, v)


#: Tools by name, as a configuration lists them.
TOOLS: dict[str, object] = {}


def tool(name: str):
    def put(f):
        TOOLS[name] = f
        return f

    return put


tool("abs")(lambda v: F.abs(v))
tool("square")(lambda v: v * v)
tool("negate")(lambda v: -v)
tool("floor_at_zero")(lambda v: F.greatest(v, F.lit(0.0)))
