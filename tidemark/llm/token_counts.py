"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths (in tokens) of frequent pre-tokens, fitted on a bounded sample and broadcast: its
size is a parameter.  It stands in each worker's look-up table from the start on.  Tier two is a cache in each Python worker,
which asks the tokenizers library for pre-tokens met for the first time.  No pre-token is ever shuffled; the sample only
changes the speed, never a count.

Nulls: a null text counts as the empty one (0 bytes, 0 tokens); a null id passes through.  Empty tables give empty results.
Repeated rows stay.  Columns of the input called like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import TextEncoder, encoder
from .runtime import tune

#: Rows and characters of a text from which the table of frequent pre-tokens is fitted, and its entries.
SAMPLE_ROWS, SAMPLE_CHARS, HOT_ENTRIES = 2_000, 20_000, 50_000


def frequent_lengths(df: DataFrame, text: str, tokenizer_json: str, sample_rows: int = SAMPLE_ROWS, entries: int = HOT_ENTRIES) -> list[tuple[bytes, int]]:
    """(pre-token, its number of tokens) of the most frequent pre-tokens of a bounded sample, met at least twice.

    The sample is one task of ``sample_rows`` rows, so nothing is shuffled but them.
    """

    def count(batches):
        seen: Counter = Counter()
        own = TextEncoder(tokenizer_json, counting=True)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(own.split(value))
        kept = [t for t, n in seen.most_common(entries) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([t.encode() for t in kept], pa.binary()), pa.array([own.tokens[t] for t in kept], pa.int32())], ["token", "n"])

    share = min(1.0, 2 * sample_rows / max(1, df.count()))
    sample = df.sample(share, seed=1).where(F.col(text).isNotNull()).select(F.substring(text, 1, SAMPLE_CHARS).alias("text")).limit(sample_rows)
    return [(bytes(r.token), r.n) for r in sample.coalesce(1).mapInArrow(count, "token binary, n int").collect()]


def count_tokens(df: DataFrame, tokenizer_json: str, *, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of each whole text; over_limit: n_tokens > limit."""
    tune(df.sparkSession)
    kept = df.select(F.col(key).alias(key), F.col(text).alias("__text"))
    kind = kept.schema[key].dataType.simpleString()
    hot = df.sparkSession.sparkContext.broadcast((tokenizer_json, frequent_lengths(df, text, tokenizer_json)))

    def count(batches):
        spec, lengths = hot.value
        held = encoder(spec, counting=True, hot=lengths)
        for batch in batches:
            texts = batch.column(1)
            n = [held(t) for t in texts.to_pylist()]
            size = [len(b) if b else 0 for b in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return kept.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
