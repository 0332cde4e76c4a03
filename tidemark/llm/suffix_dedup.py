"""Removal of byte strings that an earlier document has, by induced sorting of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.  All is judged on the
input texts.

Sampling.  Of each string of ``length`` bytes the least hashed k-gram is its sample; the strings that share a sample position
form one segment of the text.  The sample depends on nothing but the string, so equal strings have equal samples, and all
suffixes that could share ``length`` bytes meet at their sample.  Segments travel as hashes: they are aggregated by sample,
samples that only one document has end there, and the others are joined with their segments by Spark's external sort, one part
of the samples after the other.  A sample with a single content is decided at once: its least id is that of all its strings.
Contents are equal if 128 bits of hashes (64 of the sample, 64 of the segment) are.

Induced sorting.  For samples with several contents the bytes are fetched once for each content.  A task walks through its
samples in order, in blocks, and sorts the suffixes that begin at the samples, with the common prefixes of neighbours.
From their order the order of the suffixes that begin one byte earlier is induced, by a stable sort on that byte alone, and
so are their common prefixes: one more than the least between two that come to stand side by side.  This is repeated back to
the first byte of the segments.  Neighbours with at least ``length`` common bytes are equal strings, and their least id is
what decides.  A sample of more rows than ``HOT_ROWS`` (the edge of a passage that very many documents share) is not sorted
in one task: its strings are aggregated as they are.

Suffix tuples (sample, content, id, position) and the spans that result travel through Spark's disk-backed shuffle and sort;
no task holds more than a block of samples, and no list is longer than a document.

Nulls: a null text is the empty one; rows with a null id count as larger than all others and not as smaller than each other.
Rows that share an id are not smaller than each other.  Where ids repeat, the rows are written with a number each, and what is
found for a row goes by that; the id then only says which row is smaller.  Texts shorter than ``length`` lose nothing; very long
ones are cut in pieces that overlap.  Empty tables give empty results.  With ``rewrite`` all columns of the input stay, whatever
they are called; without, only key and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import mix
from .runtime import Workspace, partitions, stored, tune

#: Bytes of a string that counts as repeated, and of the k-grams that samples are chosen from.
LENGTH, GRAM = 50, 16
#: Bytes of text and contents that are worked on at once.
TEXT_BLOCK, CONTENT_BLOCK = 1 << 18, 100_000
#: Parts of the samples whose segments are brought together one after the other: what is shuffled at once is divided by it.
ROUNDS = 2
#: Rows of a sample beyond which its contents are not brought into one task.
HOT_ROWS = 200_000
NO_ID = 2**63 - 1

_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            held = np.full(n + 1, base, _U)
            held[0] = 1
            held = _POWERS[base] = np.multiply.accumulate(held)
    return held[:n]


def segments(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(sample hash, content hash, start, size, sample's place in it) of the segments of joined texts.

    raw: the texts' bytes, at most 2 to the power 20 of them; bounds: their ends, from 0 on.
    """
    n, reach = len(raw), length - gram + 1
    none = (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < length:
        return none
    with np.errstate(over="ignore"):
        h, width = _BYTE[raw], 1
        while width < gram:
            step = min(width, gram - width)
            h = h[: len(h) - step] * _U(0x9E3779B97F4A7C15 + 2 * width) + h[step:]
            width += step
        h = mix(h)
    at_mask = _U((1 << 20) - 1)
    least = (h & ~at_mask) | np.arange(len(h), dtype=_U)
    width = 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    room = np.repeat(bounds[1:], np.diff(bounds))[: len(least)] - np.arange(len(least))
    starts = np.flatnonzero(room >= length)
    if not len(starts):
        return none
    sample = (least[starts] & at_mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    begin, size = starts[first], starts[last] - starts[first] + length
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[raw] * powers(_BASE, n), out=sums[1:])
        content = mix((sums[begin + size] - sums[begin]) * powers(_INVERSE, n)[begin] + size.astype(_U))
    return h[sample[first]], content, begin, size, sample[first] - begin


def packed_spot(pos: np.ndarray, more: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A segment's place in one long: the position, 6 bits each for its size beyond ``length`` and for the place of its
    sample."""
    return (pos << 12) | (more << 6) | at


def unpacked_spot(spot: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, size, place of the sample)."""
    return spot >> 12, ((spot >> 6) & 63) + length, spot & 63


def pieces_of(texts: list[bytes], length: int):
    """(numbers of texts, where each piece begins in its text, the pieces) in blocks of about ``TEXT_BLOCK`` bytes.  A longer
    text is cut into pieces that share ``length`` - 1 bytes, so every string of ``length`` bytes begins in exactly one."""
    owner, begin, raw, total = [], [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - length + 1), TEXT_BLOCK):
            piece = text if len(text) <= TEXT_BLOCK else text[lo : lo + TEXT_BLOCK + length - 1]
            if raw and total + len(piece) > TEXT_BLOCK:
                yield owner, begin, raw
                owner, begin, raw, total = [], [], [], 0
            owner, begin, raw, total = [*owner, i], [*begin, lo], [*raw, piece], total + len(piece)
            if piece is text:
                break
    if raw:
        yield owner, begin, raw


def emit_segments(batches, length: int, gram: int, part: int = 0, rounds: int = 1):
    """(sample, content, id, spot) of the segments of (id, text), and the row's number where the batches have one more column;
    only of samples of one part of ``rounds``."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for owner, offsets, raws in pieces_of(texts, length):
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
            found = segments(np.frombuffer(b"".join(raws), np.uint8), bounds, length, gram)
            if rounds > 1:
                mine = np.flatnonzero(found[0] % _U(rounds) == part)
                found = tuple(x[mine] for x in found)
            sample, content, begin, size, at = found
            piece = np.searchsorted(bounds, begin, "right") - 1
            doc = np.array(owner)[piece]
            spot = packed_spot(begin - bounds[piece] + np.array(offsets)[piece], size - length, at)
            numbers = [c.take(pa.array(doc)) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (sample.view(np.int64), content.view(np.int64), ids[doc].astype(np.int64), spot)), *numbers], ["sample", "content", "id", "spot", *batch.schema.names[2:]]
            )


def induced_least(group: np.ndarray, raw: list[bytes], at: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each content and number i of bytes ahead of its sample, the least id among the contents of its group that hold the
    same string of ``length`` bytes from there on (the content's own id where it has no such string)."""
    n, reach = len(raw), int(at.max()) + 1
    sizes = np.array([len(r) for r in raw])
    right = np.zeros((n, length), np.uint8)
    left = np.zeros((n, reach), np.uint8)
    flat, start = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    have = np.minimum(sizes - at, length)
    for j in range(length):
        rows = np.flatnonzero(have > j)
        right[rows, j] = flat[start[rows] + at[rows] + j]
    for j in range(1, reach):
        rows = np.flatnonzero(at >= j)
        left[rows, j] = flat[start[rows] + at[rows] - j]
    out = np.repeat(ids[:, None], reach, axis=1)
    # The suffixes at the samples, in order, with the common prefixes of neighbours.
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = right
    key = padded.view(">u8").astype(_U)
    order = np.lexsort([*key.T[::-1], group])
    same = right[order[1:]] == right[order[:-1]]
    common = np.where(same.all(axis=1), length, same.argmin(axis=1)) if n > 1 else np.zeros(0, np.int64)
    common = np.concatenate([[0], np.where(group[order[1:]] == group[order[:-1]], common, -1)]).astype(np.int64)
    for i in range(reach):
        if i:  # induce the order of the suffixes that begin one byte earlier
            keep = np.flatnonzero(at[order] >= i)
            if not len(keep):
                break
            rows = order[keep]
            by = np.argsort(group[rows] * 256 + left[rows, i], kind="stable")
            place, order = keep[by], rows[by]
            alike = (group[order[1:]] == group[order[:-1]]) & (left[order[1:], i] == left[order[:-1], i])
            pairs = np.stack([place[:-1][alike] + 1, place[1:][alike] + 1], axis=1).reshape(-1)
            between = np.minimum.reduceat(np.append(common, 0), pairs)[::2] if len(pairs) else np.zeros(0, np.int64)
            common = np.zeros(len(order), np.int64)
            common[1:][alike] = between + 1
        part = np.flatnonzero(have[order] >= length - i)
        if not len(part):
            continue
        runs = np.cumsum(common < length)[part]
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        least = np.minimum.reduceat(ids[order[part]], first)
        out[order[part], i] = np.repeat(least, np.diff(np.append(first, len(part))))
    return out


def sort_contents(batches, length: int):
    """Streams contents in the order of their samples through blocks of whole samples."""
    held: list = []

    def block(rows):
        sample, content, ids, top, raw, at = (list(c) for c in zip(*rows, strict=True))
        ids, at, top = np.array(ids, np.int64), np.array(at, np.int64), np.array(top, np.int64)
        _, group = np.unique(np.array(sample, np.int64), return_inverse=True)
        least = induced_least(group, raw, at, ids, length)
        sizes = np.array([len(r) for r in raw]) - length + 1
        owner = np.repeat(np.arange(len(raw)), sizes)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        values = least[owner, at[owner] - offset]
        low = np.minimum.reduceat(values, np.cumsum(sizes) - sizes)
        keep = low < top
        kept = values[keep[owner]]
        offsets = np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(sample, np.int64)[keep]), pa.array(np.array(content, np.int64)[keep]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))], ["sample", "content", "least"]
        )

    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held += rows
        if len(held) > CONTENT_BLOCK and held[-1][0] != held[0][0]:
            cut = len(held) - 1
            while held[cut - 1][0] == held[-1][0]:
                cut -= 1
            yield from block(held[:cut])
            held = held[cut:]
    if held:
        yield from block(held)


def covered(size: int, pos: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Mask of the bytes inside [pos, pos + span)."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, pos, 1)
    np.add.at(edges, pos + span, -1)
    return np.cumsum(edges[:size]) > 0


def removed_masks(ids, texts: list[bytes], spans, length: int):
    """The mask of removed bytes of each text, from its list of (spot, least): ``least`` null for a whole segment."""
    for i, text in enumerate(texts):
        mask = np.zeros(len(text), bool)
        if spans[i].is_valid and len(text) >= length:
            found = spans[i].values
            pos, size, _ = unpacked_spot(found.field("spot").to_numpy(), length)
            least = found.field("least")
            whole = least.is_null().to_numpy(zero_copy_only=False)
            parts = least.drop_null()
            counts = parts.value_lengths().to_numpy() if len(parts) else np.zeros(0, np.int64)
            base = np.repeat(pos[~whole], counts)
            offset = np.arange(len(base)) - np.repeat(np.cumsum(counts) - counts, counts)
            hit = parts.flatten().to_numpy() < ids[i] if len(parts) else np.zeros(0, bool)
            starts = (base + offset)[hit]
            mask = covered(len(text), np.concatenate([pos[whole], starts]), np.concatenate([size[whole], np.full(len(starts), length)]))
        yield mask


def least_by_string(contents: DataFrame, length: int) -> DataFrame:
    """(sample, content, least) as ``sort_contents`` gives it, by aggregating the strings themselves: for samples with more
    contents than a task should hold.  Strings are aggregated before they are shuffled."""
    offsets = F.sequence(F.lit(0), F.length("raw") - length)
    strings = contents.select("sample", "content", "id", F.posexplode(F.transform(offsets, lambda o: F.substring(F.col("raw"), o + 1, F.lit(length)))).alias("offset", "string"))
    first = strings.groupBy("string").agg(F.min("id").alias("first"))
    rows = strings.join(first, "string").groupBy("sample", "content").agg(F.sort_array(F.collect_list(F.struct("offset", "first"))).alias("least"))
    return rows.select("sample", "content", F.col("least.first").alias("least"))


def remove_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, rewrite: bool = False, hot_rows: int = HOT_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row; with ``rewrite`` the rows of ``df`` themselves, their
    text without the removed bytes (a character of which a byte went goes whole)."""
    if not gram <= length <= gram + 63:
        raise ValueError("length must be at least gram and at most 63 more")
    spark = df.sparkSession
    tune(spark)
    work = Workspace(spark)
    own, number, of_, parts_, spans_ = free_names(df, "__id", "__number", "__of", "__parts", "__spans")
    docs = df.withColumn(own, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))
    if not rewrite:
        docs = docs.select(own, text)
    repeated = bool(docs.groupBy(own).count().where("count > 1").limit(1).count())
    # The column that tells rows apart, in the rows and in what is found for them: the id, or a number that is written down.
    row, of, more = (number, number, [number]) if repeated else (own, "id", [])
    if repeated:
        docs = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    texts = docs.select(own, text, *more)
    kind = "sample long, content long, id long, spot long" + (f", `{number}` long" if repeated else "")

    # Aggregated before they are shuffled, and joined: a sample that very many documents have is no single task's.
    cut = texts.mapInArrow(lambda b: emit_segments(b, length, gram), kind)
    per_sample = cut.groupBy("sample").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("content").alias("first"), F.max("content").alias("last"))
    per_sample = work.stored(per_sample.where("low < high").selectExpr("sample", "low", "first = last AS single"), "samples")
    seen = None
    for i in range(rounds):
        # Of a sample with one content only the later holders matter, and of theirs only where it is.
        cut = texts.mapInArrow(lambda b, i=i: emit_segments(b, length, gram, i, rounds), kind)
        part = cut.join(per_sample, "sample").where("NOT single OR id > low")
        part = work.stored(part.selectExpr("sample", "CASE WHEN NOT single THEN content END AS content", "id", "spot", *[f"`{m}`" for m in more]), f"segments-{i}")
        seen = part if seen is None else seen.union(part)
    work.drop("samples")

    whole = seen.where("content IS NULL").select(of, "spot", F.lit(None).cast("array<long>").alias("least"))
    several = seen.where("content IS NOT NULL")
    chosen = several.groupBy("sample", "content").agg(F.min(F.struct("id", *more, "spot")).alias("one"), F.max("id").alias("top"))
    wanted = chosen.groupBy(F.col(f"one.{of}").alias(of_)).agg(F.collect_list(F.struct("sample", "content", "top", "one.spot")).alias(parts_))
    wanted = work.stored(wanted, "wanted")

    def fetch(batches):
        for batch in batches:
            for doc, raw, parts in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                raw, values = raw or b"", parts.values
                pos, size, place = unpacked_spot(values.field("spot").to_numpy(), length)
                yield pa.RecordBatch.from_arrays(
                    [values.field("sample"), values.field("content"), pa.array(np.full(len(pos), doc, np.int64)), values.field("top"),
                     pa.array([raw[p : p + s] for p, s in zip(pos.tolist(), size.tolist(), strict=True)], pa.binary()), pa.array(place.astype(np.int32))],
                    ["sample", "content", "id", "top", "raw", "at"],
                )

    fetched = texts.join(wanted, texts[row] == wanted[of_]).select(own, text, parts_).mapInArrow(fetch, "sample long, content long, id long, top long, raw binary, at int")
    hot = work.stored(several.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("sample"), "hot")
    any_hot = bool(hot.limit(1).count())
    fetched = work.stored(fetched, "contents") if any_hot else fetched
    plain = fetched.join(hot, "sample", "left_anti") if any_hot else fetched
    least = plain.repartition(partitions(spark), "sample").sortWithinPartitions("sample").mapInArrow(lambda b: sort_contents(b, length), "sample long, content long, least array<long>")
    if any_hot:
        least = least.union(least_by_string(fetched.join(hot, "sample", "left_semi"), length))
    least = work.stored(least, "least")
    work.drop("wanted")
    work.drop("contents")
    parts = several.join(least, ["sample", "content"]).where(F.array_min("least") < F.col("id"))
    parts = parts.select(of, "spot", "least")
    spans = stored(whole.union(parts).groupBy(F.col(of).alias(of_)).agg(F.collect_list(F.struct("spot", "least")).alias(spans_)), "spans")
    work.drop()
    names = docs.columns
    joined = docs.join(spans, docs[row] == spans[of_], "left").select(*[docs[c] for c in names], spans_)

    def digest(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = []
            for raw, mask in zip(texts, removed_masks(ids, texts, batch.column(batch.num_columns - 1), length), strict=True):
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                runs = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and mask[0]))
                rows.append((len(raw), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            out = [pa.array([None if i == NO_ID else i for i in ids], pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))]
            yield pa.RecordBatch.from_arrays(out, [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    if not rewrite:
        return joined.mapInArrow(digest, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def cut_out(batches):
        for batch in batches:
            at_text = batch.schema.get_field_index(text)
            ids, held = batch.column(batch.schema.get_field_index(own)).to_pylist(), batch.column(at_text)
            texts = [t or b"" for t in held.cast(pa.binary()).to_pylist()]
            masks = removed_masks(ids, texts, batch.column(batch.num_columns - 1), length)
            new = [whole_characters(raw, mask) if mask.any() else raw.decode("utf-8", "ignore") for raw, mask in zip(texts, masks, strict=True)]
            new = [None if not held[i].is_valid else t for i, t in enumerate(new)]
            columns = [pa.array(new, pa.string()) if i == at_text else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(cut_out, docs.schema).drop(own, number)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores ahead that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in ("_" * i + n for i in range(len(taken) + 1)) if x.lower() not in taken) for n in names]


def whole_characters(raw: bytes, mask: np.ndarray) -> str:
    """The text without the masked bytes and without the characters that they are part of."""
    x = np.frombuffer(raw, np.uint8)
    character = np.cumsum((x & 0xC0) != 0x80) - 1
    gone = np.zeros(len(x) + 1, bool)
    gone[character[mask]] = True
    return x[~gone[character]].tobytes().decode("utf-8", "ignore")
