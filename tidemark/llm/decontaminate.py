"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark's items: every ``window`` consecutive words, or the whole item if it has fewer.
Texts and items become word numbers of the benchmark's vocabulary (0: a word that no item has).  For each pattern length a
shift table by the hash of a block of two words, sized by the number of patterns, tells how far the search may jump; where the
shift is 0, the block's hash bucket selects the patterns that end in it and all their words are compared.  Documents are cut
into lanes that overlap by a window, and all lanes of a batch step at once.

The tables are flat arrays, broadcast; items are dealt into blocks of about ``BLOCK_BYTES`` of text, each with tables of its
own, so a broadcast has a bound whatever the benchmark's size.  One pass over the documents searches ``AT_ONCE`` blocks; the
hits of several passes are merged by document: by its id and two hashes of its text, whatever columns are carried.

Nulls: null texts and items without words have no windows; an item without an id is item ``null``; a null document id passes
through.  Rows that repeat, also with the same id, keep a row each.  Items that repeat count once by id.  A very long text is
searched whole, in one task, as the lanes of one batch.  Empty tables give empty results or no hits.  Other columns are not
read unless carried.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import tune

WINDOW = 10
#: Bytes of item texts in a block of the benchmark, blocks that one pass over the documents searches, and window starts of a lane.
BLOCK_BYTES, AT_ONCE, LANE = 8 << 20, 4, 256
#: Bits of the block hash: by the number of patterns, within these.
_HASH_BITS = (10, 24)

# Separators become spaces, A to Z lower case; all else is part of a word.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_WORDS).split() if raw else []


@dataclass
class Patterns:
    """All patterns of one length: where each begins among the words of the items, which items have it (from ``first[i]`` to
    ``first[i + 1]``), the hash of its last block (ascending), and the shifts by block hash."""

    length: int
    block: int
    bits: int
    starts: np.ndarray
    first: np.ndarray
    items: np.ndarray
    last: np.ndarray
    shift: np.ndarray


@dataclass
class Tables:
    """The tables of some items: their words in the order of their numbers, their texts in word numbers, and the patterns."""

    names: list[str]
    vocabulary: bytes
    words: np.ndarray
    patterns: list[Patterns]

    def numbers(self) -> dict[bytes, int]:
        """The number of each word, from 1 on; made once in each worker."""
        if not hasattr(self, "_numbers"):
            self._numbers = {w: i for i, w in enumerate(self.vocabulary.split(b" ") if self.vocabulary else (), 1)}
        return self._numbers


def _block_hash(words: np.ndarray, at: np.ndarray, block: int, bits: int) -> np.ndarray:
    last = words[at].astype(np.uint64)
    with np.errstate(over="ignore"):
        both = last if block == 1 else words[at - 1].astype(np.uint64) * np.uint64(0x9E3779B1) + last
        return ((both * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _patterns(words: np.ndarray, starts: np.ndarray, owner: np.ndarray, size: int) -> Patterns:
    """The table of the windows of ``size`` words that begin at ``starts``; equal windows become one pattern."""
    mixed = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            mixed = (mixed ^ words[starts + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    starts, owner = starts[order], owner[order]
    same = np.concatenate([[False], mixed[order][1:] == mixed[order][:-1]])
    for j in range(size):
        same[1:] &= words[starts[1:] + j] == words[starts[:-1] + j]
    group = np.cumsum(~same) - 1
    heads = starts[~same]
    block = min(2, size)
    bits = int(np.clip(np.ceil(np.log2(8 * len(heads) + 1)), *_HASH_BITS))
    last = _block_hash(words, heads + size - 1, block, bits)
    by_last = np.argsort(last, kind="stable")
    place = np.empty(len(heads), np.int64)
    place[by_last] = np.arange(len(heads))
    by_pattern = np.argsort(place[group], kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(place[group], minlength=len(heads)))])
    shift = np.full(1 << bits, min(255, size - block + 1), np.uint8)
    for j in range(block - 1, size):
        np.minimum.at(shift, _block_hash(words, heads + j, block, bits), min(255, size - 1 - j))
    return Patterns(size, block, bits, heads[by_last].astype(np.uint32), first.astype(np.uint32), owner[by_pattern].astype(np.uint32), last[by_last].astype(np.uint32), shift)


def compiled(items: list[tuple[str, bytes]], window: int) -> Tables:
    """The tables of some items (id, text)."""
    vocabulary: dict[bytes, int] = {}
    known: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(raw)], np.uint32) for _, raw in items]
    owner = np.array([known.setdefault(item, len(known)) for item, _ in items], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths) - lengths
    words = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    found = []
    for size in np.unique(np.minimum(lengths, window)).tolist():
        mine = np.flatnonzero(np.minimum(lengths, window) == size)
        if not size:
            continue
        n = lengths[mine] - size + 1
        at = np.repeat(begin[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found.append(_patterns(words, at, np.repeat(owner[mine], n), size))
    return Tables(list(known), b" ".join(vocabulary), words, found)


def search(words: np.ndarray, bounds: np.ndarray, p: Patterns, item_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, pattern) of every occurrence in joined texts of word numbers; none crosses a bound."""
    lo, hi = bounds[:-1], bounds[1:] - p.length + 1
    counts = np.maximum(0, -(-(hi - lo) // LANE))
    owner = np.repeat(np.arange(len(lo)), counts)
    at = lo[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * LANE
    end = np.minimum(at + LANE, hi[owner])
    places, patterns = [], []
    while len(at):
        h = _block_hash(words, at + p.length - 1, p.block, p.bits)
        shift = p.shift[h].astype(np.int64)
        stop = np.flatnonzero(shift == 0)
        if len(stop):
            first, n = np.searchsorted(p.last, h[stop], "left"), np.searchsorted(p.last, h[stop], "right")
            n = n - first
            place = np.repeat(at[stop], n)
            candidate = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            for j in range(p.length):  # from the front on, what differs goes
                same = words[place + j] == item_words[p.starts[candidate].astype(np.int64) + j]
                place, candidate = place[same], candidate[same]
            places.append(place)
            patterns.append(candidate)
        at = at + np.maximum(1, shift)
        going = at < end
        at, end = at[going], end[going]
    return (np.concatenate(places), np.concatenate(patterns)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def hits(texts: list[bytes], tables: Tables) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """(number of words, hit spans [from, to) in words, items) of each text."""
    get, sizes, flat = tables.numbers().get, [], []
    for raw in texts:
        found = words_of(raw)
        sizes.append(len(found))
        flat += [get(w, 0) for w in found]
    words, bounds = np.array(flat, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for p in tables.patterns:
        at, which = search(words, bounds, p, tables.words)
        for a, w, d in zip(at.tolist(), which.tolist(), (np.searchsorted(bounds, at, "right") - 1).tolist(), strict=True):
            spans[d].append((a - int(bounds[d]), a - int(bounds[d]) + p.length))
            items[d].update(tables.names[i] for i in p.items[p.first[w] : p.first[w + 1]])
    return list(zip(sizes, spans, items, strict=True))


def hits_of_all(texts: list[bytes], blocks: list[Tables]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """``hits`` of several blocks together."""
    found = hits(texts, blocks[0])
    for tables in blocks[1:]:
        found = [(n, spans + more, items | others) for (n, spans, items), (_, more, others) in zip(found, hits(texts, tables), strict=True)]
    return found


def verdict(n_words: int, spans, items) -> tuple[int, int, int, str, bool]:
    mask = np.zeros(n_words, bool)
    for a, b in spans:
        mask[a:b] = True
    n_hit = int(mask.sum())
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0


_OUT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]
OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _batch(heads, rows, names):
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _OUT]
    return pa.RecordBatch.from_arrays([*heads, *(pa.array(c, t) for c, (_, t) in zip(columns, _OUT, strict=True))], [*names, *(n for n, _ in _OUT)])


def blocks_of(benchmark: DataFrame, item: str, text: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of about ``limit`` bytes of text at most, by a hash of the text."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // limit) or 1
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def decontaminate(
    df: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None,
) -> DataFrame:
    """(key or carried columns, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``df``."""
    spark = df.sparkSession
    tune(spark)
    carried = carry or [key]
    kept = df.select(F.col(text).alias("__text"), *carried)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("__text").schema)
    parts = blocks_of(benchmark, item, item_text, block_bytes)

    def sent(part: DataFrame):
        return spark.sparkContext.broadcast(compiled([(r.item, r.text.encode("utf-8", "ignore")) for r in part.collect()], window))

    passes = [[sent(p) for p in parts[i : i + AT_ONCE]] for i in range(0, len(parts), AT_ONCE)]
    if len(passes) == 1:

        def judge(batches):
            for batch in batches:
                found = hits_of_all([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()], [t.value for t in passes[0]])
                yield _batch(batch.columns[1:], [verdict(*f) for f in found], carried)

        return kept.mapInArrow(judge, f"{own}, {OUT}")

    marks = ["__id", "__hash", "__crc"]

    def spans_of(blocks):
        def find(batches):
            for batch in batches:
                found = hits_of_all([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()], [t.value for t in blocks])
                full = [i for i, f in enumerate(found) if f[1]]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(full, pa.int64())) for c in batch.columns[1:]), pa.array([[x for s in found[i][1] for x in s] for i in full], pa.list_(pa.int64())),
                     pa.array([sorted(found[i][2]) for i in full], pa.list_(pa.string()))], [*marks, "spans", "items"],
                )

        return find

    raw = F.col(text).cast("string").cast("binary")
    marked = df.select(F.col(text).alias("__text"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("__id"), F.xxhash64(raw).alias("__hash"), F.crc32(raw).alias("__crc"), *carried)
    found = [marked.select("__text", *marks).mapInArrow(spans_of(p), "__id string, __hash long, __crc long, spans array<long>, items array<string>") for p in passes]
    union = found[0]
    for f in found[1:]:
        union = union.union(f)
    # Sets: rows that repeat give the same spans again.
    merged = union.groupBy(*marks).agg(F.flatten(F.collect_set("spans")).alias("__spans"), F.flatten(F.collect_set("items")).alias("__items"))
    joined = marked.join(merged, marks, "left").select("__text", "__spans", "__items", *carried)

    def merge(batches):
        for batch in batches:
            rows = []
            for raw, spans, items in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = spans or []
                rows.append(verdict(len(words_of(raw)), zip(spans[::2], spans[1::2], strict=True), set(items or [])))
            yield _batch(batch.columns[3:], rows, carried)

    return joined.mapInArrow(merge, f"{own}, {OUT}")
