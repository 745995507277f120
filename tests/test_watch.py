"""Inactivity of workers in a stream, ends of workers, and settings, case by case."""

import random

import pytest
from pyspark.sql import functions as F

from motionlake.functions.jobs import exit_verdict, settings_fit
from motionlake.streaming import appended
from motionlake.streaming import watch as W

SOFT, HARD, STALL = 4_000_000, 12_000_000, 30_000_000
KINDS = (W.HEARTBEAT, W.STAGE, W.PROGRESS, W.COUNTER, W.TERMINAL, "hello")


def expected(rows, clock):
    """The same by walking each key's rows: key, kind, due."""
    out = set()
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: r[1:3])
        heard, moved, alive, token, top = [], [], False, None, None
        for _, us, _, what, said, count in own:
            if what == W.HEARTBEAT or (not alive and what != W.COUNTER):
                heard.append(us)
            alive = alive or what == W.HEARTBEAT
            if what in (W.STAGE, W.TERMINAL):
                moved.append(us)
            elif what == W.PROGRESS and said is not None and said != token:
                token = said
                moved.append(us)
            elif what == W.COUNTER and count is not None and (top is None or count > top):
                top = count
                moved.append(us)
        end = max([clock] + [r[1] for r in own])
        for kind, marks, limit in (("warning", heard, SOFT), ("unresponsive", heard, HARD), ("stalled", moved, STALL)):
            out |= {(key, kind, a + limit) for a, b in zip(marks, marks[1:] + [end]) if b - a > limit}
    return out


@pytest.mark.parametrize("spans", [1, 4, 9])
def test_alarms_do_not_depend_on_batches(spark, spans):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.randrange(300_000_000), i, rng.choice(KINDS), rng.choice([None, "a", "b"]), rng.choice([None, rng.randrange(9)])) for i in range(120)]
    # one falls silent early, one only counts, one repeats a token, one has no time
    rows += [(7, 1_000, 900, W.STAGE, None, None), (8, 5_000, 901, W.COUNTER, None, 4), (8, 90_000_000, 902, W.COUNTER, None, 4), (9, 2_000, 903, W.PROGRESS, "a", None), (9, 60_000_000, 904, W.PROGRESS, "a", None), (1, None, 905, W.STAGE, None, None)]
    df = spark.createDataFrame(rows, "k long, us long, event_id long, what string, token string, counter long")
    stream, late = W.in_spans(df, "k", spans)
    got = [tuple(r) for r in appended(W.alarms(stream, "k", late, SOFT, HARD, STALL)).collect()]
    clock = (max(r[1] for r in rows if r[1] is not None) // 1000 - late) * 1000
    assert len(got) == len(set(got)) and set(got) == expected(rows, clock)
    if spans > 1:
        # timers, not later rows, tell of those that say nothing more
        assert {(7, "stalled", 1_000 + STALL), (7, "warning", 1_000 + SOFT)} <= set(got)


def test_alarms_of_no_messages(spark):
    df = spark.createDataFrame([], "k long, us long, event_id long, what string, token string, counter long")
    stream, late = W.in_spans(df, "k", 3)
    assert appended(W.alarms(stream, "k", late, SOFT, HARD, STALL)).count() == 0


def test_every_end_of_a_worker(spark):
    cases = {
        ("job_completed", 0, False): ("complete", None), ("job_completed", 1, False): ("failed", "worker_claimed_success_then_nonzero_exit"), ("job_completed", None, True): ("failed", "worker_claimed_success_then_nonzero_exit"),
        ("failure", 0, False): ("failed", "worker_reported_failure"), ("failure", None, True): ("failed", "worker_reported_failure"), ("job_cancelled", 0, True): ("cancelled", None), ("job_cancelled", None, True): ("cancelled", None),
        ("job_cancelled", 0, False): ("failed", "unexpected_job_cancelled"), ("job_cancelled", 3, True): ("failed", "worker_reported_cancel_then_nonzero_exit"), (None, 0, True): ("failed", "worker_protocol_failure"),
        (None, 9, False): ("failed", "worker_terminated_unexpectedly"), (None, None, False): ("failed", "worker_terminated_unexpectedly"),
    }
    df = spark.createDataFrame(list(cases), "last string, code int, asked boolean")
    got = {(r.last, r.code, r.asked): tuple(r.v) for r in df.withColumn("v", exit_verdict(F.col("code"), F.col("last"), F.col("asked"))).collect()}
    assert got == cases


def test_settings_case_by_case(spark):
    good = (True, 0.5, 0.5, 0.2, 3, "auto", [], 1.0, 5.0)
    band, wide = [(1.0, 2.0)], [(1.0, 6.0)]
    cases = [
        (good, True), ((False, 9.0, *good[2:]), True), ((True, 1.01, *good[2:]), False), ((*good[:3], 0.0, *good[4:]), False), ((*good[:3], 1.0, *good[4:]), True), ((*good[:4], 0, *good[5:]), False), ((*good[:4], 11, *good[5:]), False),
        ((*good[:5], "auto", wide, 1.0, 5.0), True), ((*good[:5], "manual_single", [], 1.0, 5.0), False), ((*good[:5], "manual_single", band, 1.0, 5.0), True), ((*good[:5], "manual_single", band * 2, 1.0, 5.0), False),
        ((*good[:5], "manual_multi", band * 10, 1.0, 5.0), True), ((*good[:5], "manual_multi", band * 11, 1.0, 5.0), False), ((*good[:5], "manual_multi", band + wide, 1.0, 5.0), False), ((*good[:5], "manual_multi", [(2.0, 2.0)], 1.0, 5.0), False),
    ]
    names = "e boolean, c double, s double, u double, n int, m string, b array<struct<low_hz: double, high_hz: double>>, l double, h double"
    df = spark.createDataFrame([c for c, _ in cases], names)
    got = [r.v for r in df.select(settings_fit(*[F.col(c) for c in df.columns]).alias("v")).collect()]
    assert got == [v for _, v in cases]
