"""Column functions: time, guarded arithmetic, labels, canonical text and its hashes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

MICROS = 1_000_000
WEEK, MONDAY = 604_800, 345_600  # seconds; 1970-01-05
MIN_EFFECT = 0.15
IDENTITY = r"did:(plc|web):|at://"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out a single time, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def set_down(value: Column, then: Callable[[Column], Column]) -> Column:
    """As ``once``, as a column that a generator gives: a filter on it is not moved below it, so nothing is worked out again."""
    return F.explode(F.transform(F.array(value), then))


def bucket_start(us: Column, width: int) -> Column:
    """Start, in seconds, of the window of a time in microseconds (rounded down, also before 1970)."""
    return (F.floor(us / F.lit(MICROS)) - F.pmod(F.floor(us / F.lit(MICROS)), F.lit(width))).cast("long")


def week_start(seconds: Column, width: int = WEEK) -> Column:
    """Start of the window of whole weeks, anchored on Monday."""
    shifted = seconds - F.lit(MONDAY)
    return (F.lit(MONDAY) + shifted - F.pmod(shifted, F.lit(width))).cast("long")


def to_epoch(iso: Column) -> Column:
    """Seconds of an ISO time; no zone means UTC; null if it is not one."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(iso, "Z$", "+00:00"))) / F.lit(float(MICROS))


def us_to_iso(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hour_of(seconds: Column) -> Column:
    return F.hour(F.timestamp_seconds(seconds))


def day_of(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def parse_duration(text: str) -> float:
    """Seconds of '90', '600s', '30m', '1h' or '2d'; refuses all else and what is not above 0."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*", text)
    seconds = float(found[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[found[2]] if found else 0.0
    if seconds <= 0:
        raise ValueError(f"not a duration: {text!r}")
    return seconds


def coarse_period(start: Column, end: Column) -> tuple[Column, Column]:
    """Timestamps rounded to hours: the start down, the end up."""
    up = F.date_trunc("hour", end)
    return F.date_trunc("hour", start), F.when(up < end, up + F.expr("INTERVAL 1 HOUR")).otherwise(up)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where either is missing or b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def positive_ratio(a: Column, b: Column) -> Column:
    """a / b only where b is above 0."""
    return F.when(b > 0, a / b)


def total(parts: Iterable[Column]) -> Column:
    """Sum of those that are not null; null if none is."""
    parts = list(parts)
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))


def share(part: Column, whole: Iterable[Column]) -> Column:
    return positive_ratio(part, total(whole))


def zscore(x: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation != 0, (x - mean) / deviation)


def pct_change(x: Column, mean: Column) -> Column:
    return F.when(mean != 0, (x - mean) / mean)


def condition(z: Column, pct: Column, effect: float = MIN_EFFECT) -> Column:
    """A label from z; too small an effect is normal whatever z is."""
    return (
        F.when(z.isNull(), "unknown").when(F.abs(pct) < effect, "normal").when(z >= 3, "surging").when(z >= 1.5, "elevated")
        .when(z <= -3, "degrading").when(z <= -1.5, "quiet").otherwise("normal")
    )


def magnitude(x: Column) -> Column:
    """log2 of a ratio, 0 below 1 or where there is none."""
    return F.when(x.isNull() | (x <= 0), F.lit(0.0)).otherwise(F.round(F.log2(F.greatest(x, F.lit(1.0))), 6))


def severity(score: Column) -> Column:
    out = F.when(F.lit(False), "info")
    for floor, name in vocab.SEVERITY:
        out = out.when(score >= floor, name)
    return out.otherwise("info")


def worst(flags: Column) -> Column:
    """The first flag by precedence; ``clean`` without any."""
    return F.coalesce(*[F.when(F.array_contains(flags, f), F.lit(f)) for f in vocab.PRECEDENCE], F.lit(vocab.CLEAN))


def effective_n(n: Column, r: Column) -> Column:
    """Effective size of an autocorrelated sample, between 1 and n."""
    r = F.greatest(F.least(r, F.lit(0.999)), F.lit(-0.999))
    return F.when(r.isNotNull() & (n > 0), F.greatest(F.lit(1.0), F.least(n.cast("double"), n * (1.0 - r) / (1.0 + r))))


def support(days: Column, n_eff: Column) -> Column:
    return F.when((days >= 20) & (n_eff >= 100), "supported").when((days >= 7) & (n_eff >= 30), "thin").otherwise("unsupported")


def stable_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def receipt(document: Column) -> Column:
    """Sixteen hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(document.cast("binary"), 256), 1, 16)


def actor_token(salt: str, actor: Column) -> Column:
    return F.concat(F.lit("a:"), F.substring(F.sha2(F.concat(F.lit(salt), actor.cast("string")).cast("binary"), 256), 1, 12))


def subject_actor(kind: Column, ref: Column) -> Column:
    """The account that a reference belongs to; empty if it names none."""
    return F.when(kind == "did", ref).when(kind == "uri", F.regexp_extract(ref, "^at://(did:[^/]*)", 1)).otherwise("")


def normalize_sql(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def capped(text: Column, most: int = 200) -> Column:
    return F.substring(text, 1, most)


def names_identity(text: Column) -> Column:
    """Whether a text holds what names an account."""
    return F.coalesce(text.rlike(IDENTITY), F.lit(False))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits behind the point, rounded from its binary value, halves to even (``format_string`` rounds
    halves of the shortest decimal form up)."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles as a fused operation gives it: what the product rounds off goes into the sum."""
    halves = lambda x: (x * 134217729.0 - (x * 134217729.0 - x), x - (x * 134217729.0 - (x * 134217729.0 - x)))
    (ah, al), (bh, bl) = halves(a), halves(b)
    product = a * b
    total = product + c
    off = (product - (total - (total - product))) + (c - (total - product))
    found = total + (off + (((ah * bh - product) + ah * bl + al * bh) + al * bl))
    return F.when(F.isnan(found), total).otherwise(found)  # halves of very great numbers are not finite


def lag_text(seconds: Column, most: float = 600.0) -> Column:
    """A clamped lag: at the clamp it can only be said to be at least that."""
    return F.when(seconds >= most, F.lit(f">={most:.0f}s")).when(seconds.isNotNull(), F.concat(fixed(seconds, 2), F.lit("s")))


def age_text(seconds: Column) -> Column:
    """An age in words."""
    unit = F.when(seconds < 3600, F.struct(F.lit(60).alias("by"), F.lit("minute").alias("of")))
    unit = unit.when(seconds < 86400, F.struct(F.lit(3600).alias("by"), F.lit("hour").alias("of"))).otherwise(F.struct(F.lit(86400).alias("by"), F.lit("day").alias("of")))
    n = F.floor(seconds / unit["by"])
    return F.when(seconds < 90, "just now").when(seconds.isNotNull(), F.concat(n.cast("string"), F.lit(" "), unit["of"], F.when(n == 1, "").otherwise("s"), F.lit(" ago")))


def query_commitment(sql: Column, params: Column, result: Column) -> Column:
    """Content address of a query: its text with evened-out blanks, its parameters, its result's hash."""
    return receipt(stable_json(sql=normalize_sql(sql), params=params, result=result))


def event_range(start: Column, end: Column, n: Column) -> Column:
    return receipt(stable_json(start=start, end=end, events=n))


def set_root(values: Column, n: Column) -> Column:
    """Content address of a set, whatever the order in which it was gathered."""
    return receipt(stable_json(members=F.array_sort(F.array_distinct(values)), n=n))


def fingerprint(start: Column, end: Column, window: Column, config: Column) -> Column:
    return receipt(stable_json(start=start, end=end, window=window, config=config))


def watermark(eligible: Column, observed: Column) -> Column:
    """How clean the evidence is: the share of eligible windows."""
    share = ratio(eligible, observed)
    return F.when(share >= 0.95, "clean").when(share >= 0.6, "degraded").otherwise("sparse")


def compact_rate(per_second: Column) -> Column:
    """A rate a minute, short: one digit behind the point, none from 100 on, thousands as k and millions as m."""
    n = per_second * 60
    size = F.abs(n)
    short = (
        F.when(size >= 1_000_000, F.concat(fixed(n / 1_000_000, 1), F.lit("m"))).when(size >= 1_000, F.concat(fixed(n / 1_000, 1), F.lit("k")))
        .when(size >= 100, fixed(n, 0)).otherwise(fixed(n, 1))
    )
    return F.when(n.isNull(), "-").otherwise(short)


def switch(text: str | None, default: bool = False) -> bool:
    """A setting that is on or off; what could mean either is refused."""
    if text is None or not text.strip():
        return default
    known = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
    if text.strip().lower() not in known:
        raise ValueError(f"neither on nor off: {text!r}")
    return known[text.strip().lower()]
