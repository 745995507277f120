"""A job's states: what is known of its source and settings, and how far a run of it is."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Job(NamedTuple):
    """``mode`` is setup while no run is on; then what was set up decides the state that is shown."""

    mode: str = "setup"
    loaded: bool = False
    known: bool = False
    settings: bool = False
    pending: bool = False
    hashed: bool = False
    stale: bool = False

    @property
    def state(self) -> str:
        if self.mode != "setup":
            return self.mode
        if not self.loaded:
            return "idle"
        if self.pending:
            return "fingerprint_pending"
        return "ready" if self.settings and self.hashed and not self.stale else "loaded"


ENDED = ("complete", "failed", "cancelled")
RUNNING = ("preflight", "rendering")


def moved(job: Job, event: str) -> Job | None:
    """The job after an event; None where the event is illegal."""
    if event == "load":
        return job._replace(mode="setup" if job.mode in ENDED else job.mode, loaded=True, known=True, pending=True, hashed=False, stale=False)
    if event in ("settings_done", "settings_open"):
        return job._replace(settings=event == "settings_done")
    if event == "hash_done":
        return job._replace(known=True, pending=False, hashed=True, stale=False)
    if event == "hash_failed":
        return job._replace(pending=False, hashed=False)
    if event in ("source_changed", "source_same"):
        if not job.known:
            return job
        return job._replace(stale=True, hashed=False, pending=False) if event == "source_changed" else job._replace(stale=False)
    legal = {
        "start": (job.state == "ready", "preflight"), "render": (job.mode == "preflight", "rendering"), "abort": (job.mode == "preflight", "setup"), "complete": (job.mode == "rendering", "complete"),
        "fail": (job.mode in RUNNING, "failed"), "cancel": (job.mode in RUNNING, "cancelled"), "reset": (job.mode in ENDED, "setup"),
    }
    fine, mode = legal[event]
    return job._replace(mode=mode) if fine else None


EVENTS = ("load", "settings_done", "settings_open", "hash_done", "hash_failed", "source_changed", "source_same", "start", "render", "abort", "complete", "fail", "cancel", "reset")


def machine() -> tuple[list[Job], dict[str, list[int]]]:
    """All states that can be reached, the first one first, and what each event makes of each; -1 where it is illegal."""
    found, at = [Job()], 0
    while at < len(found):
        for event in EVENTS:
            after = moved(found[at], event)
            if after is not None and after not in found:
                found.append(after)
        at += 1
    number = {job: i for i, job in enumerate(found)}
    return found, {e: [-1 if (after := moved(job, e)) is None else number[after] for job in found] for e in EVENTS}


def exit_verdict(code: Column, last: Column, asked: Column) -> Column:
    """status, reason of a worker that has ended: its exit code (null: unknown) against its last terminal message (null: none); ``asked``: whether it was told to cancel."""
    ended = lambda status, reason=None: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    zero, bad = code.eqNullSafe(0), code.isNotNull() & (code != 0)
    return (
        F.when((last == "job_completed") & zero, ended("complete")).when(last == "job_completed", ended("failed", "worker_claimed_success_then_nonzero_exit")).when(last == "failure", ended("failed", "worker_reported_failure"))
        .when((last == "job_cancelled") & bad, ended("failed", "worker_reported_cancel_then_nonzero_exit")).when((last == "job_cancelled") & asked, ended("cancelled")).when(last == "job_cancelled", ended("failed", "unexpected_job_cancelled"))
        .when(zero, ended("failed", "worker_protocol_failure")).otherwise(ended("failed", "worker_terminated_unexpectedly"))
    )


#: The most bands that a job may ask for.
MOST_BANDS = 10


def settings_fit(enabled: Column, cutoff: Column, least_confidence: Column, least_support: Column, count: Column, mode: Column, bands: Column, low: Column, high: Column) -> Column:
    """Whether analysis settings can be run: shares within their ranges, as many bands as the mode allows, and manual bands (low_hz, high_hz) rising and inside the phase band. Nothing is asked of a switched-off analysis, nor of manual bands in mode auto."""
    share = lambda c: c.between(0.0, 1.0)
    inside = F.forall(bands, lambda b: (b.high_hz > b.low_hz) & (b.low_hz >= low) & (b.high_hz <= high))
    n = F.size(bands)
    counted = F.when(mode == "manual_single", n == 1).otherwise(n.between(1, MOST_BANDS))
    given = share(cutoff) & share(least_confidence) & (least_support > 0.0) & (least_support <= 1.0) & count.between(1, MOST_BANDS)
    return ~enabled | (given & ((mode == "auto") | (counted & inside)))
