"""Token ids in shards of raw binary with a minimal perfect hash index by document key.

Format.  ``<shard>.ids`` is the payload: the documents' ids one after the other, little-endian, 2 or 4 bytes an id, in
ascending key order; a shard ends after about ``SHARD_BYTES`` of it.  ``<shard>.idx`` is the index: magic, version, width, documents, keys, levels of bit arrays of the
hash, then per slot the key's fingerprint (32 bits) and the ordinal of its first document, then the documents' offsets.
A key is hashed level by level until it meets a bit of its own; the number of bits set before it is its slot, so the slots
are exactly 0 to keys - 1 and a lookup costs a constant number of steps.  The stored fingerprint turns away keys that the
store does not hold.  The manifest (one row a shard: path, first and last key, documents, ids, checksum of the payload) is a
table; which shard a key is in follows from the ranges of the keys.

Tasks write files under names of their own attempt, and only the attempts that Spark accepted are in the manifest, so lost
executors and repeated tasks do no harm.

Nulls: a null text is the empty one; a null key is written first and has no place in the hash (it is found by ordinal 0 on).
Repeated keys stay: all their documents are in a row behind the slot, in as many shards as they take.  A very long text is
encoded whole, in one task.  Empty tables give no shards.  Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import encoder
from .runtime import opened_store, partitions, shared_dir, stored, tune

MAGIC, VERSION = b"TMIX", 1
#: Bits a key of the first level of the hash, and the most levels (keys left then, if any, stand in a sorted rest).
GAMMA, LEVELS = 2, 40
#: Bytes of payload after which a shard ends, and bytes that are read at once.
SHARD_BYTES, READ_BYTES = 256 << 20, 4 << 20


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well mixed bits of each key for a level (wraps around)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct integer keys to 0 .. n - 1, one to one."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.bits = [np.unpackbits(a, bitorder="little") for a in levels]
        self.ranks = [np.cumsum(b, dtype=np.int64) - b for b in self.bits]
        self.bases = list(accumulate((int(b.sum()) for b in self.bits), initial=0))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys.astype(np.int64))
        while len(left) and len(levels) < LEVELS:
            size = max(8, -(-len(left) * GAMMA // 8) * 8)
            place = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size)
            levels.append(np.packbits(taken == 1, bitorder="little"))
            left = left[taken[place] != 1]
        return cls(levels, left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was not built in gets some slot or -1."""
        keys = keys.astype(np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks, base) in enumerate(zip(self.bits, self.ranks, self.bases, strict=False)):
            place = (mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place] == 1
            out[open_[hit]] = base + ranks[place[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.searchsorted(self.rest, keys[open_])
            found = self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_]
            out[open_[found]] = self.bases[-1] + at[found]
        return out


def index_bytes(keys: list, sizes: list[int], width: int) -> bytes:
    """The index of a shard: ``keys`` ascending with nulls ahead, ``sizes`` in ids."""
    nulls = sum(k is None for k in keys)
    held = np.array(keys[nulls:], np.int64)
    distinct, first = np.unique(held, return_index=True)
    perfect = PerfectHash.build(distinct)
    slot = perfect.slots(distinct)
    prints, ordinals = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u8")
    prints[slot], ordinals[slot] = fingerprint(distinct), first + nulls
    offsets = np.array(list(accumulate(sizes, initial=0)), "<u8")
    head = MAGIC + struct.pack("<6Q", VERSION, width, len(keys), len(distinct), nulls, len(perfect.levels))
    parts = [head, *(struct.pack("<Q", len(a)) + a.tobytes() for a in perfect.levels), struct.pack("<Q", len(perfect.rest)), perfect.rest.astype("<i8").tobytes()]
    return b"".join([*parts, prints.tobytes(), ordinals.tobytes(), offsets.tobytes()])


class Index:
    """A shard's index, read back."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not an index of token ids")
        version, self.width, self.documents, self.keys, self.nulls, n = struct.unpack_from("<6Q", raw, 4)
        if version != VERSION:
            raise ValueError(f"index version {version}")
        at, levels = 4 + 48, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", raw, at)
            levels.append(np.frombuffer(raw, np.uint8, size, at + 8))
            at += 8 + size
        (size,) = struct.unpack_from("<Q", raw, at)
        self.perfect = PerfectHash(levels, np.frombuffer(raw, "<i8", size, at + 8))
        at += 8 + 8 * size
        self.prints = np.frombuffer(raw, "<u4", self.keys, at)
        self.ordinals = np.frombuffer(raw, "<u8", self.keys, at + 4 * self.keys)
        self.bounds = np.append(np.sort(self.ordinals.astype(np.int64)), self.documents)
        self.offsets = np.frombuffer(raw, "<u8", self.documents + 1, at + 12 * self.keys).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinals of the keys' first documents; -1 where the fingerprint says that the shard has no such key."""
        slot = self.perfect.slots(keys)
        if not self.keys:
            return np.full(len(keys), -1, np.int64)
        held = (slot >= 0) & (self.prints[np.maximum(slot, 0)] == fingerprint(keys))
        return np.where(held, self.ordinals[np.maximum(slot, 0)].astype(np.int64), -1)

    def ends(self, first: np.ndarray) -> np.ndarray:
        """One past the last document of the keys whose first documents these are."""
        return self.bounds[np.searchsorted(self.bounds, first, "right")]


def write_store(df: DataFrame, tokenizer_json: str, *, end_id: int = 1, key: str = "doc_id", text: str = "text", path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every whole text, writes the shards and returns the manifest (a table in the shared folder).

    Texts are dealt by ranges of the key; a task streams its documents into payloads of about ``shard_bytes``, one after the
    other, and keeps only the keys and sizes of the one that it is at.
    """
    spark = df.sparkSession
    tune(spark)
    path = path or f"{shared_dir(spark)}/tokens"
    spec = spark.sparkContext.broadcast(tokenizer_json)
    kept = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def write(batches):
        encode = encoder(spec.value)
        end, width = np.array([end_id], encode.dtype).tobytes(), encode.dtype.itemsize
        files, top = opened_store(path)
        files.create_dir(top, recursive=True)
        shard: Shard | None = None
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), [encode(t) + end for t in batch.column(1).to_pylist()]
            if shard and shard.written >= shard_bytes:
                yield shard.close()
                shard = None
            shard = shard or Shard(files, top, width)
            shard.add(keys, ids)
        if shard:
            yield shard.close()

    kept = kept.withColumn("h", F.xxhash64("text"))
    dealt = kept.repartitionByRange(partitions(spark), "key", "h").sortWithinPartitions("key", "h").select("key", "text")
    done = stored(dealt.mapInArrow(write, "shard string, first_key long, last_key long, documents long, tokens long, payload_crc32 long"), "manifest")
    # A row for each shard, whatever the rows.
    rows = sorted(done.collect(), key=lambda r: (r.first_key is not None, r.first_key or 0, r.last_key is not None, r.last_key or 0))
    starts = accumulate((r.tokens for r in rows), initial=0)
    return spark.createDataFrame(
        [(path, i, *r, s) for i, (r, s) in enumerate(zip(rows, starts, strict=False))],
        "path string, ordinal int, shard string, first_key long, last_key long, documents long, tokens long, payload_crc32 long, start long",
    )


class Shard:
    """A shard that is being written."""

    def __init__(self, files, top: str, width: int):
        self.files, self.width, self.name = files, width, uuid.uuid4().hex
        self.base, self.keys, self.sizes, self.crc, self.written = f"{top}/{self.name}", [], [], 0, 0
        self.out = files.open_output_stream(f"{self.base}.ids")

    def add(self, keys: list, ids: list[bytes]) -> None:
        self.keys += keys
        self.sizes += [len(x) // self.width for x in ids]
        block = b"".join(ids)
        self.crc, self.written = zlib.crc32(block, self.crc), self.written + len(block)
        self.out.write(block)

    def close(self) -> pa.RecordBatch:
        """Writes the index; the shard's row of the manifest."""
        self.out.close()
        with self.files.open_output_stream(f"{self.base}.idx") as f:
            f.write(index_bytes(self.keys, self.sizes, self.width))
        ends = pa.array([self.keys[0]], pa.int64()), pa.array([self.keys[-1]], pa.int64())
        return pa.RecordBatch.from_pydict(
            {"shard": [self.name], "first_key": ends[0], "last_key": ends[1], "documents": [len(self.keys)], "tokens": [sum(self.sizes)], "payload_crc32": [self.crc]}
        )


def documents_of(index: Index, payload, ordinals: list[int], keys: list, start: int):
    """Record batches of the documents at ``ordinals``, read from an open payload: neighbours that follow each other are read
    at once, up to ``READ_BYTES``."""
    i = 0
    while i < len(ordinals):
        a = int(index.offsets[ordinals[i]])
        j = i + 1
        while j < len(ordinals) and j < i + 500 and ordinals[j] == ordinals[j - 1] + 1 and (int(index.offsets[ordinals[j] + 1]) - a) * index.width <= READ_BYTES:
            j += 1
        bounds = [int(x) for x in index.offsets[ordinals[i] : ordinals[j - 1] + 2]]
        raw = np.frombuffer(payload.read_at((bounds[-1] - a) * index.width, a * index.width), f"<u{index.width}").astype("<u4")
        ids = [raw[x - a : y - a].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
        columns = keys[i:j], [start + x for x in bounds[:-1]], [y - x for x, y in zip(bounds, bounds[1:], strict=False)], [zlib.crc32(x) for x in ids], ids
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
        i = j


SCHEMA = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
COLUMNS = "key long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_store(manifest: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of the documents whose key is in ``wanted``, by keyed access.

    A key that ``wanted`` repeats is looked up once and gives every document stored under it; keys that are not stored give
    none.  A null in ``wanted`` gives the documents stored without a key.
    """
    spark: SparkSession = manifest.sparkSession
    tune(spark)
    # The ranges have a row for each shard; they route the keys, so that no payload is shuffled.
    shards = [(r.path, r.shard, r.start, r.first_key, r.last_key) for r in manifest.orderBy("ordinal").collect()]
    ranged = [s for s in shards if s[4] is not None]
    firsts = np.array([np.iinfo(np.int64).min if s[3] is None else s[3] for s in ranged], np.int64)
    lasts = np.array([s[4] for s in ranged], np.int64)

    def route(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(lasts, keys, "left"), np.searchsorted(firsts, keys, "right")
            n = np.maximum(0, high - low)  # a key that very many documents have may be in several shards
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n), pa.int64()), pa.array(at, pa.int32())], ["key", "at"])

    def opened(path, shard):
        files, top = opened_store(path)
        with files.open_input_stream(f"{top}/{shard}.idx") as f:
            return Index(f.read()), files.open_input_file(f"{top}/{shard}.ids")

    def look_up(batches):
        held, index, payload = None, None, None
        for batch in batches:
            keys, at = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i in np.unique(at):
                if i != held:
                    held, (index, payload) = i, opened(*ranged[i][:2])
                mine = keys[at == i]
                first = index.find(mine)
                mine, first = mine[first >= 0], first[first >= 0]
                last = index.ends(first)
                ordinals = [o for a, b in zip(first.tolist(), last.tolist(), strict=True) for o in range(a, b)]
                yield from documents_of(index, payload, ordinals, np.repeat(mine, last - first).tolist(), ranged[i][2])

    def without_key(batches):
        for batch in batches:
            for path, shard, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, payload = opened(path, shard)
                yield from documents_of(index, payload, list(range(index.nulls)), [None] * index.nulls, start)

    keys = wanted.select(F.col(key).cast("long").alias("key")).distinct()
    routed = keys.where("key is not null").mapInArrow(route, "key long, at int")
    found = routed.repartition(2 * partitions(spark), "at").sortWithinPartitions("at", "key").mapInArrow(look_up, COLUMNS)
    nulls = manifest.where("first_key is null").join(keys.where("key is null").limit(1), how="left_semi").select("path", "shard", "start")
    return found.union(nulls.mapInArrow(without_key, COLUMNS)).withColumnRenamed("key", key)


def damaged(manifest: DataFrame) -> DataFrame:
    """(shard, problem) of shards that are not what was written: payloads by their checksums and sizes, read in parts; none if
    all is well.  A shard is a task's, and no more of it is in memory than a part."""
    tune(manifest.sparkSession)

    def check(batches):
        for batch in batches:
            out = []
            for path, shard, tokens, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, top = opened_store(path)
                try:
                    with files.open_input_stream(f"{top}/{shard}.idx") as f:
                        width = Index(f.read()).width
                    found, size = 0, 0
                    with files.open_input_stream(f"{top}/{shard}.ids") as f:
                        while part := f.read(READ_BYTES):
                            found, size = zlib.crc32(part, found), size + len(part)
                    problem = "size" if size != tokens * width else "checksum" if found != crc else None
                except OSError:
                    problem = "missing"
                except (ValueError, IndexError, struct.error):
                    problem = "index"
                if problem:
                    out.append((shard, problem))
            if out:
                yield pa.RecordBatch.from_pydict({"shard": [a for a, _ in out], "problem": [b for _, b in out]})

    dealt = manifest.select("path", "shard", "tokens", "payload_crc32").repartition(2 * partitions(manifest.sparkSession), "shard")
    return dealt.mapInArrow(check, "shard string, problem string")
