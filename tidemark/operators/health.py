"""The health of an observation: a sequential fold over the windows of each run.

The throughput baseline is an exponential mean that stands still while the state is degraded; reasons need streaks of bad
windows, recovery a streak of good ones.  Such a fold has no fixed frame, so a run's windows (a bounded number) are folded in
order by ``applyInPandas``; the streaming job uses the same step.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..sources import store

# Lengths of streaks and thresholds.
WARMUP, ALPHA, BAD, GOOD = 5, 2 / 31, 3, 5
LOW, RECOVERED, LAG_HIGH_S, LAG_LOW_S, LOSS_HIGH = 0.6, 0.8, 120.0, 30.0, 0.02
LOSSES = ("parse_errors", "rejected_no_time_us", "late_events", "gap_us", "unclassified")


@dataclass
class State:
    state: str = "warming_up"
    windows: int = 0
    baseline: float = 0.0
    low: int = 0
    lag: int = 0
    loss: int = 0
    good: int = 0


def step(s: State, events: int, seconds: float, losses: dict[str, int], lag_s: float | None) -> tuple[str, list[str], float]:
    """Folds one closed window into the state; returns (state, reasons, coverage).  All loss counters must be there."""
    if missing := set(LOSSES) - set(losses):
        raise ValueError(f"uninstrumented loss: {sorted(missing)}")
    s.windows += 1
    rate = events / max(seconds, 1.0)
    if s.state != "degraded":
        s.baseline = rate if s.baseline == 0 else ALPHA * rate + (1 - ALPHA) * s.baseline
    lost = losses["parse_errors"] + losses["rejected_no_time_us"] + losses["late_events"]
    coverage = min(rate / max(s.baseline, 1e-6), 1.0)
    s.low = s.low + 1 if coverage < LOW else 0
    s.lag = s.lag + 1 if (lag_s or 0) > LAG_HIGH_S else 0
    s.loss = s.loss + 1 if lost / max(events + lost, 1) > LOSS_HIGH else 0
    reasons = [name for name, bad in (("low_eps", s.low >= BAD), ("lag_high", s.lag >= BAD), ("loss_observed", s.loss >= BAD), ("gap_observed", losses["gap_us"] > 0)) if bad]
    if s.state == "degraded":
        s.good = s.good + 1 if coverage > RECOVERED and (lag_s or 0) < LAG_LOW_S and not reasons else 0
        if s.good >= GOOD:
            s.state, s.good = "ok", 0
    elif s.state == "ok" or s.windows >= WARMUP:
        s.state = "degraded" if reasons else "ok"
        s.good = 0
    return s.state, reasons, coverage


def checkpoint(s: State, now_s: float, binding: dict[str, str]) -> dict:
    """What of the state outlives a run: the baseline, and what it is about."""
    return {"version": 1, "baseline": s.baseline, "windows": s.windows, "at": now_s, "binding": binding}


def restored(data: dict | None, now_s: float, binding: dict[str, str | None], oldest_s: float = 3600.0) -> State | None:
    """A state with the baseline of a checkpoint; none if that is old, of another version, store or endpoint, or empty.
    Streaks and reasons are not restored: they are about a stream that is no longer the one at hand."""
    fit = data and data.get("version") == 1 and now_s - data.get("at", 0) <= oldest_s and data.get("binding") == binding and binding.get("store_id") and data.get("baseline", 0) > 0
    if not fit:
        return None
    return State("ok" if data["windows"] >= WARMUP else "warming_up", data["windows"], data["baseline"])


def keep(spark: SparkSession, root: str, s: State, now_s: float, binding: dict[str, str]) -> None:
    """Writes the checkpoint of a state into a store, in the place of the one before."""
    store.write_document(spark, f"{root}/health.json", checkpoint(s, now_s, binding))


def kept(spark: SparkSession, root: str, now_s: float, binding: dict[str, str | None]) -> State:
    """The state that a run begins with: that of the store's checkpoint if it fits, else a new one."""
    data, _ = store.stored_document(spark, f"{root}/health.json")
    return restored(data, now_s, binding) or State()


def fold(windows: DataFrame) -> DataFrame:
    """(run_id, bucket_start, state, reasons, coverage, baseline_eps): the machine run over each run's windows in order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        s, out = State(), []
        for w in group.sort_values("bucket_start").itertuples():
            lag = None if pd.isna(w.lag_max_s) else float(w.lag_max_s)
            state, reasons, coverage = step(s, int(w.events_seen), w.observed_duration_us / 1e6, {c: int(getattr(w, c)) for c in LOSSES}, lag)
            out.append((w.run_id, w.bucket_start, state, ",".join(reasons), coverage, s.baseline))
        return pd.DataFrame(out, columns=["run_id", "bucket_start", "state", "reasons", "coverage", "baseline_eps"])

    needed = windows.select("run_id", "bucket_start", "events_seen", "observed_duration_us", "lag_max_s", *LOSSES)
    return needed.groupBy("run_id").applyInPandas(run, "run_id string, bucket_start long, state string, reasons string, coverage double, baseline_eps double")


def cooldown(rows: pd.DataFrame, cycles: int = 5, escalation: float = 0.5) -> list[bool]:
    """Which sightings of one finding (cycle, severity_rank, score; in order) are let through: the first, one after enough
    cycles, or one that is more severe or scores higher by enough."""
    last, out = None, []
    for r in rows.itertuples():
        go = last is None or r.cycle - last.cycle >= cycles or r.severity_rank > last.severity_rank or r.score >= last.score + escalation
        out.append(go)
        last = r if go else last
    return out


def emitted(sightings: DataFrame) -> DataFrame:
    """Rows (det_id, cycle, severity_rank, score) that the cooldown lets through, by finding."""
    return sightings.groupBy("det_id").applyInPandas(lambda g: (s := g.sort_values("cycle"))[cooldown(s)], sightings.schema)
