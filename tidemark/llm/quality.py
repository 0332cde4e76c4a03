"""Quality rules: counts of words, symbols and repetition, and compression bands.

The verdict of the method: the zstandard ratio (compressed over raw bytes) of the whole text, and of its fixed chunks, must
lie in a band that depends on the length.  Below the band a text is repetitive, above it incompressible.  Short texts
compress badly whatever they say, so the bands narrow with the length; a text too short for any band is left to the base
rules.  A text is also rejected when at least ``bad_chunks`` of its bytes are in chunks outside the band of their length.  Every
text that has a band has two chunks at least, and every byte of it is in one: parts of which some are repetitive and some
incompressible do not cancel out.

Nulls: a null text has no words (all counts 0) and fails the base rules; a null id passes through.  Empty tables give empty
results.  Repeated rows stay.  Very long texts are compressed whole, in one task each.  Columns that are not carried are not
read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import tune

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Bands:
    """(from this many bytes on, least ratio, greatest ratio), by length, of texts and of chunks; the chunks' size and tolerated share.

    Texts of fewer than two chunks are cut into halves, quarters and so on of ``chunk_bytes``; an end shorter than the first
    of the chunks' bands belongs to the chunk before it.

    The defaults are set a little outside what labelled good documents show at each length; ``fitted_bands`` makes the limits
    of another corpus.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (300, 0.500, 0.82), (600, 0.490, 0.75), (850, 0.483, 0.70), (1_200, 0.472, 0.65), (1_700, 0.458, 0.62), (2_400, 0.446, 0.60),
        (3_400, 0.433, 0.58), (4_800, 0.427, 0.56), (6_800, 0.418, 0.55), (9_600, 0.410, 0.54), (14_000, 0.404, 0.53),
        (19_000, 0.398, 0.52), (27_000, 0.388, 0.52), (54_000, 0.380, 0.52),
    )
    chunk_bytes: int = 1_024
    chunk: tuple[tuple[int, float, float], ...] = (
        (128, 0.595, 0.96), (192, 0.580, 0.85), (256, 0.565, 0.82), (384, 0.535, 0.76), (512, 0.515, 0.72), (768, 0.500, 0.65), (1_024, 0.485, 0.607),
    )
    bad_chunks: float = 0.3
    level: int = 3


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, first occurrences included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    k = len(known)
    if k < 2**21:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)
        windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : i + len(twice)] |= twice
    return int(inside.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def band_of(size: int, bands: tuple[tuple[int, float, float], ...]) -> tuple[float, float] | None:
    return next(((lo, hi) for at, lo, hi in reversed(bands) if size >= at), None)


def chunks_of(raw: bytes, bands: Bands) -> list[bytes]:
    """All of a text in chunks that have a band each."""
    least = bands.chunk[0][0]
    step = bands.chunk_bytes
    while step >= 2 * least and len(raw) < 2 * step:
        step //= 2
    starts = [i for i in range(0, len(raw), step) if not i or len(raw) - i >= least]
    return [raw[i:j] for i, j in zip(starts, [*starts[1:], len(raw)], strict=True)]


def in_band(raw: bytes, bands: Bands, compressor) -> tuple[float | None, float, bool]:
    """(whole ratio, share of bytes in chunks out of their band, verdict)."""
    size = len(raw)
    band = band_of(size, bands.whole)
    if band is None:
        return None, 0.0, True
    ratio = len(compressor.compress(raw)) / size
    bad = 0
    for c in chunks_of(raw, bands):
        lo, hi = band_of(len(c), bands.chunk) or (0.0, float("inf"))
        bad += 0 if lo <= len(compressor.compress(c)) / len(c) <= hi else len(c)
    return ratio, bad / size, band[0] <= ratio <= band[1] and bad < bands.bad_chunks * size


#: Good documents that bands are fitted on at most, the lengths at which bands begin, and the documents or chunks that a band
#: must have seen.
SAMPLE_ROWS, LEAST_SEEN = 4_000, 30
WHOLE_FROM = (300, 424, 600, 850, 1_200, 1_700, 2_400, 3_400, 4_800, 6_800, 9_600, 13_600, 19_200, 27_200, 54_400)
CHUNK_FROM = (128, 192, 256, 384, 512, 768, 1_024)


def fitted_bands(df: DataFrame, good: DataFrame, *, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, spread: float = 4.0) -> Bands:
    """Bands from labelled good documents (``good``: their keys): mean and deviation of the ratios at each length, and limits
    ``spread`` deviations away.

    At most ``sample_rows`` keys are taken, those with the least hashes.  Tasks send sums for each length, never ratios.  A
    length that was hardly seen has the limits of the one before it; without any good document the defaults stay.
    """
    base = Bands()
    keys = good.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(sample_rows)
    picked = df.join(F.broadcast(keys), key, "left_semi").where(F.col(text).isNotNull()).select(text)

    def measure(batches):
        compressor = zstandard.ZstdCompressor(level=base.level)
        sums: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                words = raw.split()
                if len(raw) < WHOLE_FROM[0] or len(words) < 50 or 100 * repeated_words(words) > 50 * len(words):
                    continue
                for whole, part in ((True, raw), *((False, c) for c in chunks_of(raw, base))):
                    ratio = len(compressor.compress(part)) / len(part)
                    place = sum(at <= len(part) for at in (WHOLE_FROM if whole else CHUNK_FROM)) - 1
                    sums[whole, place] = sums.get((whole, place), np.zeros(3)) + (1, ratio, ratio * ratio)
        rows = [(*k, *v.tolist()) for k, v in sums.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5)]
        kinds = [pa.bool_(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["whole", "place", "n", "x", "xx"])

    tune(df.sparkSession)
    found = picked.mapInArrow(measure, "whole boolean, place int, n double, x double, xx double").groupBy("whole", "place").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx")])
    seen = {(r.whole, r.place): r for r in found.collect()}  # a row for each length

    def limits(whole: bool, lengths: tuple[int, ...]) -> tuple[tuple[int, float, float], ...]:
        out: list[tuple[int, float, float]] = []
        for place, at in enumerate(lengths):
            r = seen.get((whole, place))
            if r and r.n >= LEAST_SEEN:
                mean = r.x / r.n
                away = spread * max(0.0, r.xx / r.n - mean * mean) ** 0.5
                out.append((at, round(mean - away, 4), round(mean + away, 4)))
            elif out:
                out.append((at, *out[-1][1:]))
        return tuple(out)

    whole, chunk = limits(True, WHOLE_FROM), limits(False, CHUNK_FROM)
    if not whole or not chunk or chunk[0][0] > CHUNK_FROM[0]:
        return base
    return Bands(whole=whole, chunk=chunk)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(df: DataFrame, *, key: str = "doc_id", text: str = "text", bands: Bands = Bands(), carry: list[str] | None = None) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, zstd_ratio, bad_chunks, kept).

    carry: columns of ``df`` to hand through instead of the key, as they are.
    """
    tune(df.sparkSession)
    carried = carry or [key]
    kept = df.select(F.col(text).alias("__text"), *[F.col(c) for c in carried])
    schema = kept.select(*carried).schema

    def judge(batches):
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                raw = value or b""
                words = raw.split()
                repeats = repeated_words(words)
                # Code points: bytes that do not continue one.
                points = len(raw) - len(raw.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))
                blanks = len(raw) - len(raw.translate(None, BLANKS))
                failed = len(words) < 50 or 100 * repeats > 50 * len(words)
                ratio, out, passed = in_band(raw, bands, compressor)
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                rows.append((len(words), points - blanks, symbols, duplicate_lines(raw), repeats, failed, ratio, out, passed and not failed))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*carried, *COUNTS, "base_failed", "zstd_ratio", "bad_chunks", "kept"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return kept.mapInArrow(judge, f"{own}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, zstd_ratio double, bad_chunks double, kept boolean")
