"""Scrubbing of recorded messages, and the check that nothing survived it.

One table says what becomes of a key by the shape of its value; what it does not name is dropped until someone adds it.  Both
the scrubber and the check read that table, as expressions over the whole tree of a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, trees

#: What becomes of a key's value, by its shape: an object is entered, a list cut to its scalars, a scalar kept or replaced by a
#: token of it.
ENTER, CUT, KEEP, TOKEN = "enter", "cut", "keep", "token"
RULES = {
    "object": {ENTER: ("account", "commit", "embed", "identity", "media", "record", "reply", "subject")},
    "array": {CUT: ("langs",)},
    "scalar": {KEEP: ("$type", "active", "collection", "createdAt", "kind", "operation", "seq", "status", "time_us"), TOKEN: ("cid", "did", "rev", "rkey", "subject", "uri")},
}
#: Items of a list that are kept.
ITEMS = 8

# Top-level domains that no one can register, keys whose values are names of the protocol, domains under which
# accounts have names, and the longest text that is not taken for someone's words.
RESERVED, PROTOCOL, HANDLES, LONGEST = ("example", "invalid", "localhost", "test"), ("$type", "collection"), ("bsky.app", "bsky.social", "bsky.team"), 96


def rule(key: Column, shape: Column) -> Column:
    """What the table says of a key with a value of that shape; null where it says nothing."""
    known = F.create_map(*[F.lit(x) for s, acts in RULES.items() for act, keys in acts.items() for k in keys for x in (f"{s} {k}", act)])
    return F.try_element_at(known, F.concat(shape, F.lit(" "), key))


def token(value: Column, salt: str) -> Column:
    """A name that stands for a value (its text), the same for the same value and salt."""
    return F.concat(F.lit("x:"), F.substring(F.sha2(F.concat(F.lit(salt), value).cast("binary"), 256), 1, 12))


def _plain(v: Column) -> Column:
    """Scalars as text: strings as they are."""
    return F.coalesce(F.when(trees.kind(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))


def scrubbed(v: Column, salt: str, depth: int = trees.DEPTH) -> Column:
    """The JSON of an object with nothing but what the table allows, keys sorted.  Objects below ``depth`` are dropped."""

    def member(c: Column, left: int) -> Column:
        return scalars.once(rule(c["key"], trees.shape(c["value"])), lambda act: acted(c["value"], act, left))

    def acted(value: Column, act: Column, left: int) -> Column:
        items = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: ~trees.kind(x).isin("OBJECT", "ARRAY", "VOID"))
        text = F.when(act == CUT, F.concat(F.lit("["), F.array_join(F.transform(F.slice(items, 1, ITEMS), lambda x: F.to_json(x)), ","), F.lit("]")))
        text = text.when((act == KEEP), F.to_json(value)).when(act == TOKEN, trees.quoted(token(_plain(value), salt)))
        return text.when(act == ENTER, trees.rendered(value, member, left)) if left > 0 else text

    return trees.rendered(v, member, depth)


def dropped(v: Column, depth: int = trees.DEPTH) -> Column:
    """How many members scrubbing drops; what is inside a dropped one is not counted."""

    def gone(c: Column, left: int) -> Column:
        return scalars.once(rule(c["key"], trees.shape(c["value"])), lambda act: F.when(act.isNull(), 1).when(act == ENTER, count(c["value"], left) if left else F.lit(1)).otherwise(0))

    def count(node: Column, left: int) -> Column:
        return F.aggregate(F.transform(trees.children(node), lambda c: gone(c, left - 1)), F.lit(0), lambda a, b: a + b)

    return count(v, depth).cast("long")


def scrub(lines: DataFrame, salt: str, raw: str = "value", key: str = "event_id") -> DataFrame:
    """(key, value, dropped): each JSON object scrubbed, as text, and how many members went; null for what is no object."""
    left = lambda v: F.when(trees.kind(v) == "OBJECT", F.struct(scrubbed(v, salt).alias("value"), dropped(v).alias("dropped")))
    rows = lines.select(F.col(key), scalars.set_down(F.try_parse_json(F.col(raw)), left).alias("left"))
    return rows.select(key, F.col("left.value").alias("value"), F.coalesce("left.dropped", F.lit(0)).cast("long").alias("dropped"))


NAMES, LONG, HOST, ADDRESS, KEY, DEEP, UNREAD = "names an account", "a long text", "a host that can be real", "an address that can be real", "a key that is not allowed", "deeper than the check goes", "not JSON"


def findings(lines: DataFrame, raw: str = "value", key: str = "event_id", depth: int = trees.DEPTH) -> DataFrame:
    """(key, path, name, problem): whatever at any depth of a message no scrubbed one may have.

    A member whose key and shape the table does not name; a text that names an account or an address or host outside the
    reserved domains, or that is long.  Texts of keys that hold names of the protocol are not taken for hosts.  A tree that is
    deeper than ``depth`` is a finding itself, and so is a line that is no JSON.
    """
    unread = F.when(F.col(raw).isNotNull(), F.array(F.struct(F.lit("$"), F.lit(None).cast("string"), F.lit("scalar"), F.lit("UNREAD"), F.lit(None).cast("string"))).cast(trees.NODES))
    nodes = scalars.once(F.try_parse_json(F.col(raw)), lambda v: F.when(v.isNotNull(), trees.walk(v, depth)).otherwise(unread))
    node = lines.select(F.col(key).alias("of"), F.explode(nodes).alias("n")).select("of", "n.*")
    text, host = F.col("text"), F.lower(F.regexp_extract("text", "(?i)^https?://([^/\\s:]+)", 1))
    real = lambda name: ~F.element_at(F.split(name, "\\."), -1).isin(*RESERVED)
    protocol = F.coalesce(F.col("key").isin(*PROTOCOL), F.lit(False))
    named = scalars.names_identity(text) | text.rlike("(?i)\\b[a-z0-9][a-z0-9.-]*\\.(" + "|".join(h.replace(".", "\\.") for h in HANDLES) + ")\\b")
    hostlike = text.rlike("(?i)^[a-z0-9][a-z0-9-]*(\\.[a-z0-9][a-z0-9-]*)+$")
    member = ~F.col("path").endswith("]") & (F.col("path") != "$")
    problems = F.array(
        F.when(F.col("kind") == "DEEP", DEEP).when(F.col("kind") == "UNREAD", UNREAD), F.when(member & rule(F.col("key"), F.col("shape")).isNull(), KEY), F.when(named, NAMES), F.when((host != "") & real(host) & ~protocol, ADDRESS),
        F.when(hostlike & real(F.lower(text)) & ~protocol, HOST), F.when((F.length(text) > LONGEST) & ~protocol, LONG),
    )
    return node.select(F.col("of").alias(key), "path", F.col("key").alias("name"), F.explode(F.array_compact(problems)).alias("problem"))


def leaks(rows: DataFrame, raw: str = "value", key: str = "event_id") -> DataFrame:
    """(key, problem) of messages whose text names an account anywhere, or whose top level has a key that is not allowed; a
    message each.  ``findings`` says where, at every depth."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    allowed = F.array(*map(F.lit, sorted({k for acts in RULES.values() for ks in acts.values() for k in ks})))
    found = F.array(F.when(scalars.names_identity(F.col(raw)), NAMES), F.when(F.size(F.array_except(keys, allowed)) > 0, KEY))
    return rows.select(key, F.explode(found).alias("problem")).where("problem IS NOT NULL")
