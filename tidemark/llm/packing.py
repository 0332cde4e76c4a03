"""Packing into fixed windows: concatenate and cut.

All token ids stand in one line, document after document, and are cut every ``window`` ids.  Pass one encodes the texts
where they are read (no text is shuffled), keeps the ids in the shared folder and totals them by partition; the prefix sums
of these totals give each partition its global offset.  Pass two cuts each partition on its own: a document that crosses a
boundary gives one record on either side of it.  Only the last sequence has padding.

Nulls: a null text is the empty one and still has its end id; a null id passes through.  Empty tables give no pieces.
Repeated rows are documents of their own.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import encoder
from .runtime import stored, tune

WINDOW = 4096


def encoded(df: DataFrame, tokenizer_json: str, end_id: int, key: str, text: str) -> DataFrame:
    """(part, key, before, n, ids): packed ids with the end id; ``before`` counts the ids ahead in the same partition."""
    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = kept.schema["key"].dataType.simpleString()
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json)

    def encode(batches):
        held, part, before = encoder(spec.value), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], held.dtype).tobytes(), held.dtype.itemsize
        for batch in batches:
            ids = [held(t) + end for t in batch.column(1).to_pylist()]
            sizes = [len(x) // width for x in ids]
            starts = list(accumulate(sizes, initial=before))
            before = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32())],
                ["part", "key", "before", "n", "ids", "width"],
            )

    return kept.mapInArrow(encode, f"part int, key {kind}, before long, n long, ids binary, width int")


def pack(df: DataFrame, tokenizer_json: str, *, end_id: int = 2, window: int = WINDOW, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces, each id in exactly one.

    with_ids adds the piece's ids as little-endian unsigned 32-bit integers.
    """
    tune(df.sparkSession)
    kept = stored(encoded(df, tokenizer_json, end_id, key, text), "ids")
    kind = kept.schema["key"].dataType.simpleString()
    # One row for each partition of the input, whatever the rows: their prefix sums are made on the driver.
    totals = sorted((r.part, r.n) for r in kept.groupBy("part").agg(F.sum("n").alias("n")).collect())
    bases = df.sparkSession.sparkContext.broadcast(dict(zip([p for p, _ in totals], accumulate((n for _, n in totals), initial=0), strict=False)))

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for part, k, before, n, ids, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, tokens = bases.value[part] + before, np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = tokens[start : start + length].tobytes()
                    for column, value in zip(out, (k, start, length, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None), strict=True):
                        column.append(value)
                    start += length
            arrays = [pa.array(out[0], batch.schema.field(1).type), *(pa.array(c, pa.int64()) for c in out[1:7])]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out[7], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return kept.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))
