"""Composition of reduced facts by time only: what was present at once, and how aligned series move together.

Facts are (contract_id, measurement, start_s, end_s, acquired_s, state, coverage_fraction, value, unit, dimensions).
The weakest participating state is the state of what is composed; nothing is composed from an unusable one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, stats
from .episodes import range_join

# States from the weakest on; those that can be composed.
STRENGTH = ("REFUSED", "ABSENT", "UNKNOWN", "STALE", "DEGRADED", "PRESENT")
USABLE = ("PRESENT", "DEGRADED")


@dataclass(frozen=True)
class Contract:
    """What a source may say: its measurements with their units, and the values its dimensions may take."""

    contract_id: str
    units: dict[str, str]
    dimensions: dict[str, tuple[str, ...]] = field(default_factory=dict)


class Refused(ValueError):
    pass


def contracts(documents: list[dict]) -> dict[str, Contract]:
    """Registry from documents of a closed shape."""
    out: dict[str, Contract] = {}
    for d in documents:
        if set(d) != {"contract_id", "producer_id", "vantage_profile", "coverage_profile", "measurements", "allowed_dimensions"}:
            raise Refused("INVALID_CONTRACT: keys")
        if d["contract_id"] in out:
            raise Refused("DUPLICATE_CONTRACT")
        for name, values in d["allowed_dimensions"].items():
            if not values or len(values) > 32 or len(set(values)) != len(values):
                raise Refused(f"INVALID_CONTRACT: dimension {name}")
        out[d["contract_id"]] = Contract(d["contract_id"], {m: x["unit"] for m, x in d["measurements"].items()}, {k: tuple(v) for k, v in d["allowed_dimensions"].items()})
    return out


def problems(facts: DataFrame, known: dict[str, Contract]) -> DataFrame:
    """Facts that break a rule, with ``problem``: the first one they break."""
    rows = [(c.contract_id, m, u) for c in known.values() for m, u in c.units.items()]
    installed = facts.sparkSession.createDataFrame(rows, "contract_id string, measurement string, __unit string")
    dims = F.create_map(*[F.lit(x) for x in sum(([f"{c.contract_id}|{k}|{v}", "1"] for c in known.values() for k, vs in c.dimensions.items() for v in vs), [])]) if any(c.dimensions for c in known.values()) else None
    entries = F.map_entries(F.coalesce("dimensions", F.create_map().cast("map<string,string>")))
    open_ = F.exists(entries, lambda e: (dims[F.concat_ws("|", F.col("contract_id"), e["key"], e["value"])].isNull()) if dims is not None else F.lit(True))
    value, share = F.col("value"), F.col("coverage_fraction")
    usable = F.col("state").isin(*USABLE)
    problem = (
        F.when(F.col("__unit").isNull(), "UNKNOWN_MEASUREMENT").when(F.coalesce(F.col("unit") != F.col("__unit"), F.lit(True)), "UNIT_MISMATCH").when(F.coalesce(F.col("start_s") >= F.col("end_s"), F.lit(True)), "INVALID_WINDOW")
        .when(F.coalesce(F.col("acquired_s") < F.col("start_s"), F.lit(True)), "ACQUIRED_BEFORE_WINDOW").when(~F.coalesce(F.col("state").isin(*STRENGTH), F.lit(False)), "INVALID_STATE")
        .when(F.isnan(value) | (F.abs(value) == float("inf")), "INVALID_VALUE").when(usable & (value.isNull() | share.isNull()), "VALUE_REQUIRED").when(~usable & value.isNotNull(), "VALUE_FORBIDDEN")
        .when((share < 0) | (share > 1), "INVALID_COVERAGE").when((F.col("state") == "PRESENT") & (share < 1), "STATE_COVERAGE_MISMATCH").when(open_, "INVALID_DIMENSION")
        .when(scalars.names_identity(F.to_json("dimensions")), "IDENTITY_SHAPED")
    )
    checked = facts.join(F.broadcast(installed), ["contract_id", "measurement"], "left").withColumn("problem", problem).drop("__unit")
    return checked.where("problem is not null")


def duplicates(facts: DataFrame) -> DataFrame:
    """Keys that several facts share; they can be neither merged nor counted twice."""
    key = F.to_json(F.array_sort(F.map_entries(F.coalesce("dimensions", F.create_map().cast("map<string,string>")))))
    return facts.groupBy("contract_id", "measurement", "start_s", "end_s", key.alias("dims")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _rank(column):
    return F.array_position(F.array(*map(F.lit, STRENGTH)), column)


def weakest(facts: DataFrame) -> DataFrame:
    return facts.agg(F.min_by("state", _rank(F.col("state"))).alias("state"), F.min("coverage_fraction").alias("coverage_fraction"))


def overlap(left: DataFrame, right: DataFrame, width: int = scalars.WEEK) -> DataFrame:
    """(start_s, end_s, state, coverage_fraction, left_value, right_value): windows in which both were present.

    Empty if any participating fact is unusable.  The pairs come from a join on cells of time, not from all pairs.
    """
    usable = weakest(left.select("state", "coverage_fraction").union(right.select("state", "coverage_fraction"))).where(F.col("state").isin(*USABLE)).select(F.lit(1).alias("__ok"))
    pairs = range_join(left, right, width)
    state = F.when(_rank(F.col("a.state")) <= _rank(F.col("b.state")), F.col("a.state")).otherwise(F.col("b.state"))
    out = pairs.select("start_s", "end_s", state.alias("state"), F.least("a.coverage_fraction", "b.coverage_fraction").alias("coverage_fraction"), F.col("a.value").alias("left_value"), F.col("b.value").alias("right_value"))
    return out.crossJoin(F.broadcast(usable)).drop("__ok")  # one row or none


def correlation(left: DataFrame, right: DataFrame, least: int = 10) -> DataFrame:
    """(aligned_windows, coefficient, state, coverage_fraction, disposition): over windows with equal bounds on both sides."""
    for name, side in (("left", left), ("right", right)):
        if side.groupBy("start_s", "end_s").count().where("count > 1").limit(1).count():
            raise Refused(f"AMBIGUOUS_WINDOW: {name}")
    weak = weakest(left.select("state", "coverage_fraction").union(right.select("state", "coverage_fraction")))
    pairs = left.select("start_s", "end_s", F.col("value").alias("x")).join(right.select("start_s", "end_s", F.col("value").alias("y")), ["start_s", "end_s"])
    found = pairs.agg(F.count(F.lit(1)).alias("aligned_windows"), stats.pearson(F.col("x"), F.col("y"), 2).alias("r"))
    out = found.crossJoin(F.broadcast(weak))  # one row each
    composed = F.col("state").isin(*USABLE) & (F.col("aligned_windows") >= least) & F.col("r").isNotNull()
    return out.select("aligned_windows", F.when(composed, F.col("r")).alias("coefficient"), "state", "coverage_fraction", F.when(F.coalesce(composed, F.lit(False)), "COMPOSED").otherwise("UNSATISFIED").alias("disposition"))


@dataclass(frozen=True)
class Rule:
    """An installed composition: two measurements and how they may be put together."""

    kind: str
    left: str
    right: str
    least_pairs: int = 10


def compose(facts: DataFrame, rule: Rule | None, known: dict[str, Contract]) -> DataFrame:
    """Validates facts and composes them under one installed rule; arbitrary rules are refused."""
    if rule is None or rule.kind not in ("overlap", "correlation"):
        raise Refused("RULE_NOT_INSTALLED")
    if bad := problems(facts, known).select("problem").first():
        raise Refused(bad.problem)
    if duplicates(facts).limit(1).count():
        raise Refused("DUPLICATE_FACT")
    left, right = (facts.where(F.col("measurement") == m) for m in (rule.left, rule.right))
    return overlap(left, right) if rule.kind == "overlap" else correlation(left, right, rule.least_pairs)
