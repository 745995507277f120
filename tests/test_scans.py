"""Scans over ranges, the state machine of jobs, and nested roots, on hot keys and awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from motionlake.functions.jobs import EVENTS, Job, machine, moved
from motionlake.operators import scans as Z


def history(seed, n):
    """One key has a third of the rows and more; another one has null values only."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.choice([None, rng.random()]), rng.choice(EVENTS + ("unknown",))) for i in range(n)]
    rows += [(7, n + i, None, "load") for i in range(5)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    found = history(3, 3000)
    return found, spark.createDataFrame(found, "k long, i long, x double, e string").repartition(5)


def test_running_values_cross_ranges(spark, rows):
    data, df = rows
    placed = Z.placed(df, "k", ["i"])
    # the hot key lies in several ranges
    assert placed.where("k = 1").select("part_").distinct().count() > 1
    got = {r.i: (r.top, r.total, r.latest) for r in Z.running(placed, "k", top=("max", F.col("x")), total=("sum", F.col("x")), latest=("last", F.col("x"))).collect()}
    seen = {}
    for k, i, x, _ in sorted(data, key=lambda r: r[1]):
        top, total, latest = seen.get(k, (None, None, None))
        if x is not None:
            top, total, latest = max(x, top or 0), (total or 0) + x, x
        seen[k] = top, total, latest
        assert got[i] == pytest.approx((top, total, latest))
    assert len(got) == len(data) and Z.running(Z.placed(df.where("false"), "k", ["i"]), "k", top=("max", F.col("x"))).count() == 0


def test_states_of_a_hot_key_cross_ranges(spark, rows):
    data, df = rows
    jobs, moves = machine()
    found = Z.states(Z.placed(df, "k", ["i"]), "k", "e", moves).collect()
    got = {r.i: (jobs[r.before], jobs[r.after]) for r in found}
    at = {}
    for k, i, _, e in sorted(data, key=lambda r: r[1]):
        before = at.get(k, Job())
        after = (moved(before, e) if e in EVENTS else None) or before
        assert got[i] == (before, after)
        at[k] = after
    assert len(got) == len(data)
    assert Z.states(Z.placed(df.where("false"), "k", ["i"]), "k", "e", moves).count() == 0
    words = df.select(F.concat(F.lit("k"), F.coalesce("k", F.lit(0)).cast("string")).alias("k"), "i", "e")
    assert Z.states(Z.placed(words, "k", ["i"]), "k", "e", moves).count() == len(data)


def run(*events, job=Job()):
    for e in events:
        after = moved(job, e)
        assert after is not None, (job, e)
        job = after
    return job


def test_a_job_becomes_ready_runs_and_ends():
    ready = run("load", "settings_done", "hash_done")
    assert [run("load").state, run("settings_done").state, run("hash_done", "settings_done").state, ready.state] == ["fingerprint_pending", "idle", "idle", "ready"]
    assert run("start", job=ready).state == "preflight" and run("start", "render", job=ready).state == "rendering"
    for end, state in (("complete", "complete"), ("fail", "failed"), ("cancel", "cancelled")):
        over = run("start", "render", end, job=ready)
        assert over.state == state and run("reset", job=over).state == "ready" and run("load", job=over).state == "fingerprint_pending"
    assert run("start", "abort", job=ready).state == "ready" and run("start", "fail", job=ready).state == "failed"
    assert run("start", "settings_open", "abort", job=ready).state == "loaded"


def test_stale_sources_and_illegal_moves():
    ready = run("load", "settings_done", "hash_done")
    stale = run("source_changed", job=ready)
    assert stale.state == "loaded" and run("hash_done", job=stale).state == "ready" and run("source_changed").state == "idle"
    assert run("load", "hash_failed", "settings_done").state == "loaded"
    for job, events in ((Job(), ("start", "render", "abort", "complete", "fail", "cancel", "reset")), (stale, ("start",)), (run("start", job=ready), ("start", "complete", "reset")), (run("start", "render", job=ready), ("abort", "render"))):
        assert all(moved(job, e) is None for e in events)


def test_nested_roots_count_once(spark):
    files = spark.createDataFrame([("a/b/c", 1), ("a/b/c", 2), ("a/x", 4), ("ab/c", 8), ("a", 16), ("z", 32), (None, 64), ("", 128)], "path string, size long")
    roots = spark.createDataFrame([("a/b",), ("a",), ("a",), ("a/b/c",), ("ab/c",), (None,)], "root string")
    got = sorted((r.root, r.path, r["size"]) for r in Z.topmost(files, roots).collect())
    assert got == [("a", "a", 16), ("a", "a/b/c", 1), ("a", "a/b/c", 2), ("a", "a/x", 4), ("ab/c", "ab/c", 8)]
