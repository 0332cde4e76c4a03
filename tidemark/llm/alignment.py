"""Alignment of two tokenizers over the same bytes, by an event sweep.

Every text is encoded by both tokenizers where it is read.  The end of each token is an event; the events of a document are cut
into stretches of ``STRETCH`` bytes, a row for each side with the ids alone (an id gives its length).  Both sides' rows are one
table, dealt by document, sorted by document and offset, and streamed through a machine.  Its state is the open group: the
tokens since the last byte at which both sides end, which wait for the next one.  Closed groups of many documents are worked
off together as arrays, up to ``FLUSH`` tokens.

Links are the pairs of tokens whose bytes overlap; between two events there is exactly one.  How often an id pair is linked in
all documents needs their sums.  The machine sums them by document and pair and deals them into ``BUCKETS`` by the B id, a row
for each flush and bucket.  A bucket's sums are merged in two steps, first by salts, and hold at most all pairs of its B ids.
Then sums and links of a bucket are one sorted table again: a task reads a bucket's sums, then its links row by row, and gives
what each document has of them.  No pair's rows are ever a group, so a pair that is in every document is no larger than others.

A document has no tokens if its text is null or empty, or if either side's bytes put together are not a space and the text
(a U+2581 in a text is one case): it has zeros and an empty digest.  Rows that share an id are documents of their own, a null id
passes through.  Empty tables give empty results.  Texts go to the piece model in chunks cut ahead of a space that follows
something else, where it never merges; a worker keeps what it has met, so a long text needs little more than its ids.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import _PRINTED, BYTE_LEVEL, CACHE_ENTRIES, Generations, TextEncoder
from .runtime import Workspace, partitions, tune

#: Bytes of a stretch; tokens, and bits of the number of documents, that are worked off at once; buckets of B ids, and parts of a bucket.
STRETCH, FLUSH, DOC_BITS, BUCKETS, SALTS = 1 << 16, 1_000_000, 17, 256, 4
#: Bits of an id in a pair.
BITS = 20

# Fixed values of the piece model's files: the letter that stands for a space, and how a single byte is written.
SPACE_LETTER, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")

_i8 = np.int64


#: From a space on that follows something else (or from the start), up to the next such space.
CHUNK = re.compile(r" +[^ ]+| +$")

class Differs(Exception):
    """The pieces' bytes are not the text's."""


class Tokenizers:
    """Both tokenizers in a worker, and the bytes of their tokens.

    A's tokens always give the text's bytes: it has a token for every byte, and merges join bytes.  B's are compared chunk by
    chunk, where a chunk is met for the first time.
    """

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece

        self.a = TextEncoder(a_json)
        if self.a.kind != "byte":
            raise ValueError("the first tokenizer must be a byte-level one")
        self.a.library.encode_special_tokens, self.a.special = True, []  # their strings are plain text
        letters = {ord(chr(b)): b for b in _PRINTED} | {letter: b for b, letter in BYTE_LEVEL.items()}
        self.a_bytes = [b""] * self.a.library.get_vocab_size()
        for token, i in self.a.library.get_vocab().items():
            if all(ord(c) in letters for c in token):
                self.a_bytes[i] = bytes(letters[ord(c)] for c in token)
        if {bytes([c]) for c in range(256)} - set(self.a_bytes):
            raise ValueError("the first tokenizer lacks tokens of single bytes")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.space = [self.b.piece_to_id(SPACE_LETTER)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(BYTE_PIECE.fullmatch(piece)[1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_LETTER, " ").encode())
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << BITS:
            raise ValueError(f"ids beyond {BITS} bits")
        # Where no piece has a space after another letter, none is merged across a space that follows one.
        self.cuts = all(b" " not in p.lstrip(b" ") for p in self.b_bytes)
        self.types = [np.dtype("<u2" if len(x) <= 1 << 16 else "<u4") for x in (self.a_bytes, self.b_bytes)]
        self._code = "H" if self.types[1].itemsize == 2 else "I"
        self.chunks = Generations(self._chunk, CACHE_ENTRIES)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in held], _i8) for held in (self.a_bytes, self.b_bytes))

    def _chunk(self, chunk: str) -> bytes:
        """B ids of a space and a chunk, checked against its bytes."""
        ids = self.b.encode(chunk, num_threads=1) if chunk else self.space  # the library gives nothing for an empty one
        if b"".join(map(self.b_bytes.__getitem__, ids)) != (" " + chunk).encode():
            raise Differs
        return array(self._code, ids).tobytes()

    def pieces(self, text: str) -> bytes:
        """B ids of a space and the text: chunk by chunk, each from a space on that follows something else."""
        parts = text.split(" ") if self.cuts else [text]
        if "" in parts:
            parts = [found[1:] for found in CHUNK.findall(" " + text)]
        return b"".join(map(self.chunks.__getitem__, parts))

    def __call__(self, text: str | None) -> tuple[bytes, bytes] | None:
        """Packed ids of both sides, or None where there are no tokens."""
        if not text:
            return None
        try:
            b = self.pieces(text)
        except Differs:
            return None
        a = self.a(" " + text)
        return a if self.a.dtype == self.types[0] else np.frombuffer(a, self.a.dtype).astype(self.types[0]).tobytes(), b


_HELD: dict[tuple, Tokenizers] = {}


def tokenizers(a_json: str, b_model: bytes) -> Tokenizers:
    """This worker's pair, kept from task to task; one is held at a time."""
    name = (zlib.crc32(a_json.encode()), zlib.crc32(b_model), len(a_json), len(b_model))
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Tokenizers(a_json, b_model)
    return _HELD[name]


@lru_cache
def _coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    return _coders()[0].compress(np.ascontiguousarray(x).tobytes())


def _opened(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_coders()[1].decompress(x), kind)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types, strict=True)], schema=schema)


def events(df: DataFrame, a_json: str, b_model: bytes, *, key: str, text: str) -> DataFrame:
    """(doc, stretch, side, ids, id, n_a, n_b): both sides' tokens by stretches of their ends; a row of stretch -1 for each
    document, with its numbers of tokens.  ``doc`` numbers the rows."""
    sc = df.sparkSession.sparkContext
    files = sc.broadcast((a_json, b_model))
    rows = df.select(F.monotonically_increasing_id().alias("doc"), F.col(key).alias("id"), F.col(text).alias("text"))

    def encode(batches):
        held = tokenizers(*files.value)
        lengths = held.sizes()
        for batch in batches:
            out, schema = [], pa.schema([("doc", pa.int64()), ("stretch", pa.int64()), ("side", pa.int32()), ("ids", pa.binary()), ("id", batch.schema.field(1).type), ("n_a", pa.int64()), ("n_b", pa.int64())])
            size, widths = 0, [t.itemsize for t in held.types]
            for doc, name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = held(body) or (b"", b"")
                out.append((doc, -1, 0, None, name, *(len(x) // w for x, w in zip(found, widths, strict=True))))
                for side, raw in enumerate(found if found[0] else ()):
                    size += len(raw)
                    if 4 * len(body) < STRETCH:
                        out.append((doc, 0, side, raw, None, None, None))
                        continue
                    ids = np.frombuffer(raw, held.types[side])
                    at = (np.cumsum(lengths[side][ids]) - 1) // STRETCH
                    cuts = np.flatnonzero(np.diff(at)) + 1
                    for stretch, part in zip(at[np.r_[0, cuts]].tolist(), np.split(ids, cuts), strict=True):
                        out.append((doc, stretch, side, part.tobytes(), None, None, None))
                if size > 8 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
            if out:
                yield _batch(out, schema)

    return rows.mapInArrow(encode, f"doc long, stretch long, side int, ids binary, id {df.schema[key].dataType.simpleString()}, n_a long, n_b long")


class Machine:
    """Streams the sorted rows of documents and hands closed groups on, many documents at a time.

    ``closed`` gets (documents, balanced stretches): parallel lists of document numbers, A ids and B ids that cover the same
    bytes and end where both sides end.
    """

    def __init__(self, sizes, types):
        self.sizes, self.types = sizes, types
        self.waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.tokens = 0
        self.doc, self.open = None, [np.zeros(0, t) for t in types]

    def take(self, doc: int, stretch: int, side: int, ids: bytes) -> None:
        if doc != self.doc:
            self._close(ended=True)
            self.doc, self.open = doc, [np.zeros(0, t) for t in self.types]
        elif side == 0 or stretch != self.at:
            self._close()
        self.at = stretch
        more = np.frombuffer(ids, self.types[side])
        self.open[side] = np.concatenate([self.open[side], more]) if len(self.open[side]) else more

    def _close(self, ended: bool = False) -> None:
        """What is closed of the open document's tokens goes to the waiting ones; all of them where it has ended, since both
        sides of a whole document end together."""
        a, b = self.open
        if not (len(a) and len(b)):
            return
        n_a, n_b = len(a), len(b)
        if not ended:
            ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b), strict=True)]
            both = np.intersect1d(*ends, assume_unique=True)
            if not len(both):
                return
            n_a, n_b = (int(np.searchsorted(e, both[-1])) + 1 for e in ends)
        self.waiting.append((self.doc, a[:n_a], b[:n_b]))
        self.tokens += n_a + n_b
        self.open = [a[n_a:], b[n_b:]]

    def ready(self) -> bool:
        return self.tokens >= 2 * FLUSH or len(self.waiting) >= 1 << DOC_BITS

    def handed(self, last: bool = False) -> list[tuple[int, np.ndarray, np.ndarray]]:
        if last:
            self._close(ended=True)
        out, self.waiting, self.tokens = self.waiting, [], 0
        return out


def sweep(parts: list[tuple[int, np.ndarray, np.ndarray]], sizes) -> dict[str, np.ndarray]:
    """Groups and links of balanced stretches, as arrays over all of them.

    a, b: ids; a_group, b_group: the group of each token, counted through; group_part: the stretch of each group; link_a,
    link_b: the tokens of each link; link_part: its stretch; group_end: the byte after each group, counted through.
    """
    a, b = (np.concatenate([p[i] for p in parts]).astype(_i8) for i in (1, 2))
    a_ends = np.cumsum(sizes[0][a])
    mark = np.zeros(int(a_ends[-1]) + 1, np.uint8)
    mark[a_ends] = 1
    mark[np.cumsum(sizes[1][b])] += 2
    at = np.flatnonzero(mark)
    kind = mark[at]
    on_a, on_b, both = (kind & 1).astype(bool), (kind & 2).astype(bool), kind == 3
    group = np.cumsum(both) - both
    first_b = np.cumsum([0, *(len(p[2]) for p in parts)])  # the stretch of a B token
    b_part = np.repeat(np.arange(len(parts)), np.diff(first_b))
    link_a, link_b = np.cumsum(on_a) - on_a, np.cumsum(on_b) - on_b
    return {"a": a, "b": b, "a_group": group[on_a], "b_group": group[on_b], "group_part": b_part[link_b[both]], "group_end": at[both], "link_a": link_a, "link_b": link_b, "link_part": b_part[link_b]}


class Texts:
    """Groups as text: ids joined by commas, a bar between the sides, a semicolon between groups."""

    def __init__(self, ids: int):
        self.ids = ids
        self.words = [f"{mark}{i}".encode() for mark in ";,|" for i in range(ids)]

    def __call__(self, found: dict[str, np.ndarray], lengths: list[int]) -> list[bytes]:
        """The text of each stretch, a semicolon ahead of it; lengths: its tokens of both sides."""
        a_group, b_group = found["a_group"], found["b_group"]
        groups = len(found["group_part"])
        n_a, n_b = (np.bincount(g, minlength=groups) for g in (a_group, b_group))
        codes = np.empty(len(a_group) + len(b_group), _i8)
        opens_a, opens_b = (np.r_[True, g[1:] != g[:-1]] for g in (a_group, b_group))
        codes[np.arange(len(a_group)) + (np.cumsum(n_b) - n_b)[a_group]] = found["a"] + np.where(opens_a, 0, self.ids)
        codes[np.arange(len(b_group)) + np.cumsum(n_a)[b_group]] = found["b"] + np.where(opens_b, 2 * self.ids, self.ids)
        out, at, word = [], 0, self.words.__getitem__
        for n in lengths:
            out.append(b"".join(map(word, codes[at : at + n].tolist())))
            at += n
        return out


def swept(found: DataFrame, a_json: str, b_model: bytes, id_type: str) -> DataFrame:
    """(kind, doc, ...) of sorted events: kind ``doc`` has a document's id, its numbers and its digest (a part of the numbers
    where it was worked off in several flushes); kind ``docs`` the documents of a flush; kind ``links`` a flush's links by
    bucket: distinct pairs, their sums, and for each pair the documents that have it and how often."""
    files = found.sparkSession.sparkContext.broadcast((a_json, b_model))
    kinds = [("kind", pa.string()), ("doc", pa.int64()), ("id", None), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()),
             ("flush", pa.string()), ("bucket", pa.int32()), ("pairs", pa.binary()), ("sums", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())]

    def stream(batches):
        from pyspark import TaskContext

        held = tokenizers(*files.value)
        machine, texts, out, sizes, flushes = Machine(held.sizes(), held.types), Texts(max(map(len, (held.a_bytes, held.b_bytes)))), [], held.sizes(), 0
        digest, current, schema, stage = None, None, None, TaskContext.get().partitionId()
        per_bucket = -(-len(held.b_bytes) // BUCKETS)

        def flushed(parts):
            """Appends a flush's rows."""
            nonlocal digest, current, flushes
            if not parts:
                return
            got, name = sweep(parts, sizes), f"{stage}-{flushes}"
            flushes += 1
            docs, of_part = np.unique([p[0] for p in parts], return_inverse=True)
            groups, links = (np.bincount(of_part[got[x]], minlength=len(docs)) for x in ("group_part", "link_part"))
            shas: dict[int, str] = {}
            for (doc, *_), text in zip(parts, texts(got, [len(p[1]) + len(p[2]) for p in parts]), strict=True):
                if doc != current:
                    digest, current = hashlib.sha256(text[1:]), doc
                else:
                    digest.update(text)
                shas[doc] = digest.hexdigest()
            for doc, g, k in zip(docs.tolist(), groups.tolist(), links.tolist(), strict=True):
                out.append(("doc", doc, None, None, None, g, k, f"{flushes:010d}{shas[doc]}", *[None] * 7))
            out.append(("docs", None, None, None, None, None, None, None, name, None, None, None, None, _packed(docs.astype("<i8")), None))
            # One sort by bucket, B id, A id and document; in a bucket B ids stand by their place in it.
            b = got["b"][got["link_b"]]
            pairs = ((b % BUCKETS) * per_bucket + b // BUCKETS) << BITS | got["a"][got["link_a"]]
            links = np.sort(pairs << DOC_BITS | of_part[got["link_part"]])
            starts = np.flatnonzero(np.r_[True, links[1:] != links[:-1]])
            times, links = np.diff(np.r_[starts, len(links)]), links[starts]
            doc, links = links & ((1 << DOC_BITS) - 1), links >> DOC_BITS
            heads = np.flatnonzero(np.r_[True, links[1:] != links[:-1]])
            runs, pairs, sums = np.diff(np.r_[heads, len(links)]), links[heads], np.add.reduceat(times, heads)
            bucket = (pairs >> BITS) // per_bucket
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(heads)].tolist(), strict=True):
                rows = slice(heads[lo], heads[hi] if hi < len(heads) else len(links))
                out.append(("links", *[None] * 7, name, int(bucket[lo]), *(_packed(x) for x in (pairs[lo:hi].astype("<i8"), sums[lo:hi].astype("<i8"), runs[lo:hi].astype("<i4"), doc[rows].astype("<i4"), times[rows].astype("<i4")))))

        for batch in batches:
            schema = schema or pa.schema([(n, t or batch.schema.field(4).type) for n, t in kinds])
            for doc, stretch, side, ids, name, n_a, n_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stretch < 0:
                    out.append(("doc", doc, name, n_a, n_b, 0, 0, "", *[None] * 7))
                    continue
                machine.take(doc, stretch, side, ids)
                if machine.ready():
                    flushed(machine.handed())
            if len(out) > 2000:
                yield _batch(out, schema)
                out.clear()
        flushed(machine.handed(last=True))
        if out:
            yield _batch(out, schema)

    sorted_ = found.repartition(partitions(found.sparkSession), "doc").sortWithinPartitions("doc", "stretch", "side")
    return sorted_.mapInArrow(
        stream,
        f"kind string, doc long, id {id_type}, n_a long, n_b long, n_groups long, n_links long, sha string, flush string, bucket int, pairs binary, sums binary, runs binary, docs binary, times binary",
    )


def pair_sums(links: DataFrame, space: Workspace) -> DataFrame:
    """(bucket, pairs, sums, best): for each bucket its id pairs in order, how often each is linked, and whether that is the
    most of its B id.  Merged in two steps, the first by salts; a task holds the pairs of one bucket at a time."""
    n = partitions(links.sparkSession)

    def merged(last: bool):
        schema = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("sums", pa.binary()), *([("best", pa.binary())] if last else [])])

        def total(pairs, sums):
            pairs, sums = np.concatenate(pairs), np.concatenate(sums)
            order = np.argsort(pairs, kind="stable")
            pairs, sums = pairs[order], sums[order]
            heads = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            return pairs[heads], np.add.reduceat(sums, heads)

        def row(bucket, pairs, sums):
            pairs, sums = total(pairs, sums)
            if not last:
                return _batch([(bucket, _packed(pairs), _packed(sums))], schema)
            of_b = np.flatnonzero(np.r_[True, (pairs[1:] >> BITS) != (pairs[:-1] >> BITS)])
            most = np.repeat(np.maximum.reduceat(sums, of_b), np.diff(np.r_[of_b, len(pairs)]))
            return _batch([(bucket, _packed(pairs), _packed(sums), _packed(sums == most))], schema)

        def run(batches):
            at, pairs, sums, held = None, [], [], 0
            for bucket, some, more in _rows(batches):
                if bucket != at:
                    if pairs:
                        yield row(at, pairs, sums)
                    at, pairs, sums, held = bucket, [], [], 0
                pairs.append(_opened(some, "<i8"))
                sums.append(_opened(more, "<i8"))
                held += len(pairs[-1])
                if held > 4 * FLUSH and held > 2 * len(pairs[0]):
                    pairs, sums = ([x] for x in total(pairs, sums))
                    held = len(pairs[0])
            if pairs:
                yield row(at, pairs, sums)

        return run

    dealt = links.select("bucket", "pairs", "sums", F.pmod(F.xxhash64("flush"), F.lit(SALTS)).alias("salt")).repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt")
    first = dealt.select("bucket", "pairs", "sums").mapInArrow(merged(False), "bucket int, pairs binary, sums binary")
    second = first.repartition(n, "bucket").sortWithinPartitions("bucket")
    return space.stored(second.mapInArrow(merged(True), "bucket int, pairs binary, sums binary, best binary"), "sums")


def scored(links: DataFrame, sums: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, n_best, count_sum): what the documents' links count in all documents."""
    n = partitions(links.sparkSession)
    none = F.lit(None).cast("binary")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    known = sums.select("bucket", F.lit("").alias("flush"), "pairs", F.col("sums").alias("x"), F.col("best").alias("y"), none.alias("z"), salts.alias("salt"))
    asked = links.select("bucket", "flush", "pairs", F.col("runs").alias("x"), F.col("docs").alias("y"), F.col("times").alias("z"), F.pmod(F.xxhash64("flush"), F.lit(SALTS)).cast("long").alias("salt"))
    out_schema = pa.schema([("flush", pa.string()), ("docs", pa.binary()), ("best", pa.binary()), ("counts", pa.binary())])

    def look(batches):
        out, size = [], 0
        for flush, pairs, x, y, z in _rows(batches):
            pairs = _opened(pairs, "<i8")
            if z is None:
                known_pairs, known_sums, known_best = pairs, _opened(x, "<i8"), _opened(y, "?")
                continue
            at = np.repeat(np.searchsorted(known_pairs, pairs), _opened(x, "<i4"))
            doc, times = _opened(y, "<i4"), _opened(z, "<i4").astype(_i8)
            which, place = np.unique(doc, return_inverse=True)
            best, counts = np.zeros(len(which), _i8), np.zeros(len(which), _i8)
            np.add.at(best, place, times * known_best[at])
            np.add.at(counts, place, times * known_sums[at])
            out.append((flush, _packed(which.astype("<i4")), _packed(best), _packed(counts)))
            size += len(which)
            if size > FLUSH:
                yield _batch(out, out_schema)
                out, size = [], 0
        if out:
            yield _batch(out, out_schema)

    together = known.unionByName(asked).repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", "flush")
    parts = together.select("flush", "pairs", "x", "y", "z").mapInArrow(look, "flush string, docs binary, best binary, counts binary")
    named = docs.select("flush", "docs", none.alias("best"), none.alias("counts"))
    sum_schema = pa.schema([("doc", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def summed(batches):
        at, names, best, counts = None, None, None, None
        for flush, docs_, some, more in _rows(batches):
            if some is None:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, best, counts)], schema=sum_schema)
                at, names = flush, _opened(docs_, "<i8")
                best, counts = np.zeros(len(names), _i8), np.zeros(len(names), _i8)
                continue
            which = _opened(docs_, "<i4")
            best[which] += _opened(some, "<i8")
            counts[which] += _opened(more, "<i8")
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, best, counts)], schema=sum_schema)

    back = named.unionByName(parts).repartition(n, "flush").sortWithinPartitions("flush", F.col("best").isNotNull())
    return back.mapInArrow(summed, "doc long, n_best long, count_sum long")


def align(df: DataFrame, a_json: str, b_model: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): every document's alignment in numbers."""
    tune(df.sparkSession)
    space, id_type = Workspace(df.sparkSession), df.schema[key].dataType.simpleString()
    found = space.stored(swept(events(df, a_json, b_model, key=key, text=text), a_json, b_model, id_type), "swept")
    links = found.where("kind = 'links'")
    scores = scored(links, pair_sums(links, space), found.where("kind = 'docs'"))
    zero = F.lit(0).cast("long")
    rows = found.where("kind = 'doc'").select("doc", "id", "n_a", "n_b", "n_groups", "n_links", zero.alias("n_best"), zero.alias("count_sum"), "sha")
    rows = rows.unionByName(scores.select("doc", F.lit(None).cast(id_type).alias("id"), zero.alias("n_a"), zero.alias("n_b"), zero.alias("n_groups"), zero.alias("n_links"), "n_best", "count_sum", F.lit("").alias("sha")))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    summed = rows.groupBy("doc").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in numbers], F.max("sha").alias("sha"))
    return summed.select(F.col("id").alias(key), *numbers, F.substring("sha", 11, 64).alias("groups_sha256"))


def groups(df: DataFrame, a_json: str, b_model: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, key, start, length, a_ids, b_ids): every group, with its place in the bytes of a space and the text.

    ``doc`` tells rows that share a key apart.
    """
    tune(df.sparkSession)
    id_type = df.schema[key].dataType
    files = df.sparkSession.sparkContext.broadcast((a_json, b_model))
    found = events(df, a_json, b_model, key=key, text=text)
    rows = found.repartition(partitions(df.sparkSession), "doc").sortWithinPartitions("doc", "stretch", "side")

    def stream(batches):
        held = tokenizers(*files.value)
        machine, sizes = Machine(held.sizes(), held.types), held.sizes()
        names: dict[int, object] = {}
        at, current = 0, None

        def made(parts, kind):
            nonlocal at, current
            if not parts:
                return
            got = sweep(parts, sizes)
            ends = got["group_end"]
            lengths = np.diff(np.r_[0, ends])
            cuts = [np.r_[0, np.flatnonzero(np.diff(got[x])) + 1, len(got[x])] for x in ("a_group", "b_group")]
            lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(got[x], pa.int32())) for c, x in zip(cuts, "ab", strict=True)]
            starts = []
            for part, n in zip(got["group_part"].tolist(), lengths.tolist(), strict=True):
                if parts[part][0] != current:
                    current, at = parts[part][0], 0
                starts.append(at)
                at += n
            docs = [parts[p][0] for p in got["group_part"].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([names[d] for d in docs], kind), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["doc", key, "start", "length", "a_ids", "b_ids"])
            for d in {p[0] for p in parts} - {machine.doc}:
                names.pop(d, None)

        kind = None
        for batch in batches:
            kind = batch.schema.field(4).type
            for doc, stretch, side, ids, name, *_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stretch < 0:
                    names[doc] = name
                    continue
                machine.take(doc, stretch, side, ids)
                if machine.ready():
                    yield from made(machine.handed(), kind)
        yield from made(machine.handed(last=True), kind)

    return rows.mapInArrow(stream, f"doc long, `{key}` {id_type.simpleString()}, start long, length long, a_ids array<int>, b_ids array<int>")
