"""Raw JSON events: classification into the closed metric alphabet, and the edge and status lanes.

A line is parsed once into a VARIANT.  Only a JSON failure is a parse error; what parses but is no object, or has no positive
integer time, is rejected.  (Unlike some parsers, VARIANT refuses duplicate keys and NaN: those lines are parse errors.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, vocab
from ..sources.store import held
from . import ranks, recurrences

LONGEST = 32_768


def kind_of(v: Column, path: str) -> Column:
    """The JSON type at a path: OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, …; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def is_object(v: Column, path: str) -> Column:
    """Whether there is an object at a path; its members' types are not looked at."""
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def string_at(v: Column, path: str) -> Column:
    """A string at a path; null for any other type."""
    return F.when(kind_of(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _map(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def parsed(lines: DataFrame, raw: str = "value") -> DataFrame:
    """Adds v (VARIANT), parse_error, time_us (null unless a positive integer)."""
    time = lambda v: F.when(is_object(v, "$") & (kind_of(v, "$.time_us") == "BIGINT"), F.try_variant_get(v, "$.time_us", "long"))
    read = scalars.set_down(F.try_parse_json(F.col(raw)), lambda v: F.struct(v.alias("v"), time(v).alias("t")))
    kept = [c for c in lines.columns if c not in ("v", "parse_error", "time_us")]
    return lines.select(*kept, read.alias("__read")).select(
        *kept, F.col("__read.v").alias("v"), (F.col("__read.v").isNull() & F.col(raw).isNotNull()).alias("parse_error"), F.when(F.col("__read.t") > 0, F.col("__read.t")).alias("time_us")
    )


def metrics_of(v: Column) -> Column:
    """The metrics that an event counts for."""
    text, of = lambda p: string_at(v, p), lambda p: is_object(v, p)
    read = F.struct(
        text("$.kind").alias("which"), of("$.commit").alias("commit"), text("$.commit.operation").alias("op"), text("$.commit.collection").alias("collection"), of("$.commit.record").alias("record"),
        of("$.commit.record.reply").alias("reply"), of("$.commit.record.embed").alias("embed"), text("$.commit.record.embed['$type']").alias("etype"), of("$.account").alias("account"),
        F.when(kind_of(v, "$.account.active") == "BOOLEAN", F.try_variant_get(v, "$.account.active", "string")).alias("active"), text("$.account.status").alias("status"),
    )
    return scalars.once(read, lambda f: scalars.once(_map(vocab.COLLECTIONS)[f["collection"]], lambda alias: _metrics(f, alias)))


def _metrics(f: Column, alias: Column) -> Column:
    """The metrics by what was read of an event, and by the alias of its collection."""
    op, collection, etype, status = f["op"], f["collection"], f["etype"], f["status"]
    shaped = (alias == "post") & op.isin(*vocab.SHAPED) & f["record"]
    embed = f["embed"]
    post = F.concat(F.lit("post."), op)
    commit = F.when(~f["commit"], F.array(F.lit("malformed.commit"))).when(
        ~F.coalesce(op.isin(*vocab.OPERATIONS), F.lit(False)), F.array(F.lit("unclassified.operation"))
    ).when(F.coalesce(collection, F.lit("")) == "", F.array(F.lit("malformed.collection"))).when(alias.isNull(), F.array(F.lit("untracked.collection"))).otherwise(
        F.array_compact(F.array(
            F.concat(alias, F.lit("."), op), F.when(shaped & f["reply"], F.concat(post, F.lit(".reply"))),
            F.when(shaped & embed, F.concat(post, F.lit(".embed."), F.coalesce(_map(vocab.EMBEDS)[etype], F.lit(vocab.EMBED_OTHER)))),
            F.when(shaped & embed & etype.isin(*vocab.QUOTES), F.concat(post, F.lit(".quote"))),
        ))
    )
    account_ok = f["account"]
    account = F.array_compact(F.array(
        F.lit("account.event"), F.when(account_ok, F.concat(F.lit("account.active."), F.coalesce(f["active"], F.lit("unknown")))),
        F.when(account_ok & (status != ""), F.concat(F.lit("account.status."), F.when(status.isin(*vocab.STATUSES), status).otherwise(vocab.STATUS_OTHER))),
    ))
    which = f["which"]
    return F.when(which == "commit", commit).when(which == "account", account).when(which == "identity", F.array(F.lit("identity.event"))).otherwise(F.array(F.lit("unclassified.kind")))


def classified(lines: DataFrame, raw: str = "value") -> DataFrame:
    """(…, time_us, metrics, outcome): outcome is ``parse_error``, ``rejected_no_time_us`` or ``classified``."""
    out = parsed(lines, raw)
    outcome = F.when(F.col("parse_error"), "parse_error").when(F.col("time_us").isNull(), "rejected_no_time_us").otherwise("classified")
    metrics = scalars.set_down(F.struct("v", outcome.alias("outcome")), lambda x: F.when(x["outcome"] == "classified", metrics_of(x["v"])))
    return out.withColumn("outcome", outcome).withColumn("metrics", metrics).drop("v", "parse_error")


def outside_alphabet(metrics: DataFrame) -> DataFrame:
    """Metrics that no event may count for; must be empty."""
    known = metrics.sparkSession.createDataFrame([(m,) for m in vocab.metrics()], "metric string")
    return metrics.select("metric").distinct().join(F.broadcast(known), "metric", "left_anti")


def extracted(lines: DataFrame, raw: str = "value", collections: tuple[str, ...] = vocab.EDGE_COLLECTIONS) -> DataFrame:
    """Every line as one of the lanes ``edge``, ``status`` or ``skipped`` (with its reason): (lane, reason, observed_us,
    actor, collection, op, subject_kind, subject_ref, rkey, rev, cid, record_created_at, active, status)."""
    rows = parsed(lines, raw)
    strings = {
        "which": "$.kind", "did": "$.did", "collection": "$.commit.collection", "op": "$.commit.operation", "rkey": "$.commit.rkey", "named": "$.commit.record.subject", "uri": "$.commit.record.subject.uri",
        "rev": "$.commit.rev", "cid": "$.commit.cid", "created": "$.commit.record.createdAt", "status": "$.account.status",
    }
    read = scalars.set_down(F.col("v"), lambda v: F.struct(
        *[string_at(v, p).alias(n) for n, p in strings.items()], *[is_object(v, p).alias(n) for n, p in (("whole", "$"), ("commit", "$.commit"), ("account", "$.account"))],
        F.when(kind_of(v, "$.account.active") == "BOOLEAN", F.try_variant_get(v, "$.account.active", "boolean").cast("int")).alias("active"),
    ))
    rows = rows.select("time_us", read.alias("f"))
    text = lambda n: F.col(f"f.{n}")
    alias, op, rkey = _map(vocab.COLLECTIONS)[text("collection")], text("op"), text("rkey")
    named, uri = text("named"), text("uri")
    by_name = alias.isin("follow", "block", "listitem")
    ref = F.when(op == "delete", "").when(by_name & named.startswith("did:"), named).when(~by_name & uri.startswith("at://"), uri)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    which = F.coalesce(text("which"), F.lit(""))
    reason = (
        F.when(~text("whole"), "malformed").when(F.col("time_us").isNull(), "no_time_us").when(blank(text("did")), "malformed")
        .when(which == "account", F.when(~text("account"), "malformed")).when(which != "commit", "not_commit")
        .when(~text("commit"), "malformed").when(~F.coalesce(alias.isin(*collections), F.lit(False)), "untracked_collection")
        .when(~F.coalesce(op.isin(*vocab.OPERATIONS), F.lit(False)) | blank(rkey), "malformed").when(ref.isNull(), "no_subject")
    )
    rows = rows.withColumn("reason", reason).withColumn("lane", F.when(F.col("reason").isNotNull(), "skipped").when(which == "account", "status").otherwise("edge"))
    edge, status = F.col("lane") == "edge", F.col("lane") == "status"
    made = edge & (op != "delete")
    state = text("status")
    return rows.select(
        "lane", "reason", F.when(edge | status, F.col("time_us")).alias("observed_us"), F.when(edge | status, text("did")).alias("actor"), F.when(edge, alias).alias("collection"), F.when(edge, op).alias("op"),
        F.when(edge, F.when(op == "delete", "unknown").when(by_name, "did").otherwise("uri")).alias("subject_kind"), F.when(edge, ref).alias("subject_ref"), F.when(edge, rkey).alias("rkey"),
        F.when(edge, F.coalesce(text("rev"), F.lit(""))).alias("rev"), F.when(edge, F.when(made, F.coalesce(text("cid"), F.lit(""))).otherwise("")).alias("cid"),
        F.when(edge, F.when(made, F.coalesce(text("created"), F.lit(""))).otherwise("")).alias("record_created_at"),
        F.when(status, F.coalesce(text("active"), F.lit(-1))).alias("active"),
        F.when(status, F.when(blank(state), "").when(state.isin(*vocab.STATUSES), state).otherwise(vocab.STATUS_OTHER)).alias("status"),
    )


def profile(lines: DataFrame, raw: str = "value") -> DataFrame:
    """(what, name, n): histograms of kinds, collections, operations and top-level keys of the lines that parse."""
    rows = parsed(lines, raw).where("not parse_error")
    v = F.col("v")
    named = F.array(
        F.struct(F.lit("kind").alias("what"), F.coalesce(string_at(v, "$.kind"), F.lit("")).alias("name")), F.struct(F.lit("collection").alias("what"), F.coalesce(string_at(v, "$.commit.collection"), F.lit("")).alias("name")),
        F.struct(F.lit("operation").alias("what"), F.coalesce(string_at(v, "$.commit.operation"), F.lit("")).alias("name")),
    )
    keys = F.transform(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), lambda k: F.struct(F.lit("key").alias("what"), k.alias("name")))
    return rows.select(F.explode(F.concat(named, keys)).alias("x")).select("x.*").groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))


def shape(raw: Column) -> Column:
    """A text that names an event's structure: its keys and its record's keys, sorted."""
    inner = F.get_json_object(raw, "$.commit.record")
    keys = lambda c: F.concat_ws(",", F.array_sort(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))))
    return F.concat_ws("|", keys(raw), F.coalesce(F.get_json_object(raw, "$.commit.operation"), F.lit("")), keys(inner))


def event_receipt(edges: DataFrame) -> Column:
    return scalars.receipt(scalars.stable_json(**{c: F.col(c) for c in ("actor", "collection", "op", "rkey", "rev", "cid", "subject_kind", "subject_ref", "observed_us")}))


def rates(rows: DataFrame, width: int) -> DataFrame:
    """One row on events (us) by window: how many windows and events, rates at p50, p95 and most.  The first and the last
    window are seen in part only and do not count."""
    per = rows.groupBy(scalars.bucket_start(F.col("us"), width).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    ends = per.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    inner = per.crossJoin(F.broadcast(ends)).where("at > lo and at < hi")  # one row of bounds
    rate = F.col("n") / F.lit(float(width))
    inner = held(inner.select("n", rate.alias("rate")))
    spread = ranks.order_statistics(inner, [], "rate", {"rate_p50": ranks.between(0.5), "rate_p95": ranks.between(0.95)}).drop("n")
    sums = inner.agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("events"), F.max("rate").alias("rate_max"))
    return sums.join(spread, F.lit(True), "left").select("windows", "events", "rate_p50", "rate_p95", "rate_max")  # one row each


def monotonicity(rows: DataFrame) -> DataFrame:
    """One row on (arrival, us): steps from each row to the next in order of arrival that go up, stay, go down.

    Steps inside ranges of arrival are found range by range; those between ranges from a row for each range, so no task walks
    the whole table, however unevenly the rows arrive.
    """
    dealt = held(recurrences.ranged(rows.select("arrival", "us"), [F.col("arrival"), F.col("us")]))
    inside = dealt.select("us", F.lag("us").over(Window.partitionBy("range").orderBy("at")).alias("before"))
    ends = dealt.groupBy("range").agg(F.min_by("us", "at").alias("us"), F.max_by("us", "at").alias("last"))
    between = ends.select("us", F.lag("last").over(Window.orderBy("range")).alias("before"))  # a row for each range
    step = F.col("us") - F.col("before")
    return inside.union(between).agg(F.count_if(step > 0).alias("up"), F.count_if(step == 0).alias("ties"), F.count_if(step < 0).alias("down"))
