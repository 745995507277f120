"""Inactivity of workers, told by timers of event time within a stateful stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources import shared_dir

#: What messages can be: signs of life, stages, progress with a token, counters of child processes, ends. Others only count until a first heartbeat.
HEARTBEAT, STAGE, PROGRESS, COUNTER, TERMINAL = "heartbeat", "stage_started", "progress_update", "child_counter", "terminal"
_NONE = -1


def in_spans(rows: DataFrame, key: str, spans: int) -> tuple[DataFrame, int]:
    """``rows`` (us, others) as a stream of ``spans`` chunks of equal length in time, and that length in milliseconds, rounded up: how late a row can be.

    Two scalars, the first and last instant, come to the driver.  The time is
    also column ``at``, a timestamp.  Rows without a time are left out.
    """
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/chunks/{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where("us is not null").withColumn("at", F.timestamp_micros("us"))
    first, last = rows.agg(F.min("us"), F.max("us")).first()
    width = ((last or 0) - (first or 0)) // spans + 1
    for i in range(spans):
        low = (first or 0) + i * width
        rows.where((F.col("us") >= low) & (F.col("us") < low + width)).repartition(parts, key).write.parquet(f"{root}/span={i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).option("recursiveFileLookup", "true").parquet(root)
    return stream, width // 1000 + 1


def alarms(messages: DataFrame, key: str, late_ms: int, soft_us: int, hard_us: int, stall_us: int) -> DataFrame:
    """key, kind, due (microseconds): one row for each silence over ``soft_us`` (warning) and ``hard_us`` (unresponsive), and for each lack of progress over ``stall_us`` (stalled).

    ``messages``: key (long), at, us, event_id, what, token, counter.  Silence
    runs from the last heartbeat, or from the last message that is no counter
    while there was none.  Progress is a stage, an end, a token other than the
    last, or a counter above all before; nothing else resets it, and it runs
    from the first progress on.  An alarm is told when a later row or the
    watermark shows it, so a silent worker is found by its timer, and once for
    each silence.  Results don't depend on how batches are cut, as long as no
    row is later than ``late_ms``.  Held in one task: a key's rows of one batch.
    """
    limits = (("warning", soft_us), ("unresponsive", hard_us), ("stalled", stall_us))

    def step(of: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        alive, heard, moved, token, top, seen, told = state.get if state.exists else (_NONE, _NONE, _NONE, None, None, _NONE, 0)
        out: list[tuple[str, int]] = []
        clock = _NONE if state.getCurrentWatermarkMs() < 0 else state.getCurrentWatermarkMs() * 1000

        def tell(now: int) -> int:
            marks = told
            for i, (kind, limit) in enumerate(limits):
                since = moved if kind == "stalled" else heard
                if since != _NONE and not marks >> i & 1 and now - since > limit:
                    out.append((kind, since + limit))
                    marks |= 1 << i
            return marks

        if not state.hasTimedOut:
            chunk = pd.concat(parts).sort_values(["us", "event_id"])
            for us, what, said, count in zip(chunk["us"].tolist(), chunk["what"].tolist(), chunk["token"].tolist(), chunk["counter"].tolist()):
                seen, told = us, tell(us)
                if what == HEARTBEAT:
                    alive = us
                if what == HEARTBEAT or (alive == _NONE and what != COUNTER):
                    heard, told = us, told & 4
                fresh = what in (STAGE, TERMINAL)
                if what == PROGRESS and not pd.isna(said) and said != token:
                    token, fresh = said, True
                if what == COUNTER and not pd.isna(count) and (top is None or count > top):
                    top, fresh = int(count), True
                if fresh:
                    moved, told = us, told & 3
        told = tell(max(seen, clock))
        state.update((alive, heard, moved, token, top, seen, told))
        due = [(moved if kind == "stalled" else heard) + limit for i, (kind, limit) in enumerate(limits) if not told >> i & 1 and (moved if kind == "stalled" else heard) != _NONE]
        if due:
            # a timer goes off when the watermark has passed it, that is, in whole milliseconds, just when the alarm holds
            state.setTimeoutTimestamp(min(due) // 1000)
        yield pd.DataFrame({key: pd.Series([of[0]] * len(out), dtype="int64"), "kind": pd.Series([k for k, _ in out], dtype="object"), "due": pd.Series([d for _, d in out], dtype="int64")})

    marked = messages.withWatermark("at", f"{late_ms} milliseconds")
    kept = "alive long, heard long, moved long, token string, top long, seen long, told long"
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} long, kind string, due long", kept, "append", GroupStateTimeout.EventTimeTimeout)
