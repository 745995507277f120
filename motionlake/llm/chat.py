"""Chat formatting with prefix-target expansion.

Every assistant turn is an example of its own: all preceding turns are its
context, and only that reply is trainable.  A conversation's examples are
prefixes of one another, so its text is written once, as a segment a turn with
running code-point offsets, and an example is a row of spans: its context from
the conversation's start, its target after it.  ``examples`` makes these rows,
``digests`` reads loss and length back through them, and ``expand`` joins the
texts when a consumer wants them spelt out.  Spelling all of them out would
square the length of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, thrifty

OPEN, CLOSE, HEAD_END = "<turn>### ", "</turn>\n", ":\n"
#: Control strings that texts may hold; a backslash marks them as text.
_CONTROL = r"(\\|<(?=/?turn>)|###)"
_READ = re.compile(r"\\(\\|<|###)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, to rows in order, how many rows (i) and code points (o) of the same conversation the partition has before each."""
    at, rows, chars = object(), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, n = batch.column("conv_id"), batch.column("chars").to_numpy()
        ids, gone = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        new = np.append(True, (ids[1:] != ids[:-1]) | (gone[1:] != gone[:-1]))
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        before = np.cumsum(n) - n
        i, o = np.arange(len(n)) - starts[group], before - before[starts][group]
        if (None if gone[0] else ids[0]) == at:
            i[group == 0] += rows
            o[group == 0] += chars
        at, rows, chars = None if gone[-1] else ids[-1], int(i[-1]) + 1, int(o[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i), pa.array(o)], names=[*batch.schema.names, "i", "o"])


def format_turns(turns: DataFrame) -> DataFrame:
    """A segment for each turn: conv_id, turn_no (from 0), segment, char_start, char_end, loss_start, loss_end.

    Offsets are code points of the conversation's formatted text; loss offsets
    are null but for assistant turns.  Turns are in order of turn (nulls
    first), then role, then text; a null text or role is empty, and a null
    conv_id is a conversation like any other.  Equal rows are turns each.
    Turns are dealt by ranges, so that a long conversation spans several parts;
    only such conversations, one a part at most, carry counts over.
    """
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(HEAD_END))
    rows = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "tie"]
    placed = (
        rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text")
        .select("conv_id", (F.col("role") == "assistant").alias("mine"), F.concat(head, escape(F.col("text")), F.lit(CLOSE)).alias("segment"), F.length(head).alias("head"), F.spark_partition_id().alias("part"))
        .withColumn("chars", F.length("segment").cast("long"))
    )
    placed = materialize(placed.mapInArrow(thrifty(_running), "conv_id long, mine boolean, segment string, head int, part int, chars long, i long, o long"))
    sums = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("conv_id").alias("k"), F.col("part").alias("q"), F.sum("n").over(before).alias("n0"), F.sum("c").over(before).alias("c0")).where("n0 is not null")
    # one row for each part at most: a part begins within one conversation
    joined = placed.join(F.broadcast(carry), F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("part") == F.col("q")), "left")
    start = F.coalesce("c0", F.lit(0)) + F.col("o")
    mine = F.col("mine")
    return joined.select(
        "conv_id", (F.coalesce("n0", F.lit(0)) + F.col("i")).alias("turn_no"), "segment", start.alias("char_start"), (start + F.col("chars")).alias("char_end"),
        F.when(mine, start + F.col("head")).alias("loss_start"), F.when(mine, start + F.col("chars") - len(CLOSE)).alias("loss_end"),
    )


def examples(segments: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, turn_no, context_start, context_end, loss_start, loss_end, example_end; all preceding turns and the reply's head are its context, and only the loss span is trainable."""
    context = F.lit(0).cast("long").alias("context_start"), F.col("loss_start").alias("context_end")
    return segments.where("loss_start is not null").select("conv_id", "turn_no", *context, "loss_start", "loss_end", F.col("char_end").alias("example_end"))


def expand(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """The segments of chosen examples (conv_id, turn_no): example_turn, turn_no, segment, trainable. Its rows grow with the square of a conversation's turns."""
    chosen = chosen.select(F.col("conv_id").alias("c"), F.col("turn_no").alias("example_turn"))
    found = segments.join(chosen, segments.conv_id.eqNullSafe(F.col("c")) & (segments.turn_no <= F.col("example_turn")))
    return found.select("conv_id", "example_turn", "turn_no", "segment", (F.col("turn_no") == F.col("example_turn")).alias("trainable"))


def unescaped(text: str) -> str:
    return _READ.sub(r"\1", text)


def digests(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, from the formatted text and its examples (``rows``).

    Roles and texts are read back from segments.  What is trained on is read
    through each example's loss span, which must lie in the segment where its
    context ends.  A digest must read a conversation in order, so its segments
    and examples stream through one task, which holds two hash states and a
    batch, however long the conversation is.
    """
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done, last = object(), None, [], ("", 0)

        def close() -> None:
            if state:
                done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for conv, is_example, segment, start, end in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or conv != at:
                    close()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if is_example:
                    loss = unescaped(last[0][start - last[1] : end - last[1]])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                    state[5] += 1
                else:
                    head, _, body = segment[len(OPEN) : -len(CLOSE)].partition(HEAD_END)
                    state[0] += 1
                    state[1].update(f"{unquote_plus(head)}\n{unescaped(body)}\n".encode())
                    state[4] = end
                    last = segment, start
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [()] * 7, kinds)], names=names)
            done = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [()] * 7, kinds)], names=names)

    both = segments.select("conv_id", F.lit(False).alias("is_example"), "segment", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "turn_no")
    both = both.union(rows.select("conv_id", F.lit(True), F.lit(None).cast("string"), "loss_start", "loss_end", "turn_no"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "is_example")
    return ordered.drop("turn_no").mapInArrow(thrifty(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
