"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code is a binary classifier (logistic regression on hashed byte n-grams of
the whole text).  A text is given the language whose codeword has the least loss, weighted by the margins of the classifiers;
its score is the softmax of the losses, and it is flagged ambiguous if the second codeword is almost as near.

The classifiers are fitted on a bounded sample of labelled rows (``PER_LANGUAGE`` rows of each language and ``IN_ALL`` rows of
all, chosen by a hash of key and text), whole texts; predictions read whole texts and nothing but the text.

Nulls: a null text, or one without a letter, is ``und`` with score 0.  Null languages are not learned from.  With no labelled
row every text is ``und``; with a single language every text with a letter is that one.  Rows that repeat in key and text count
once in the sample.  Very long texts are read whole, in one task each.  More than ``MAX_LANGUAGES`` languages are refused.
Empty tables give empty results.  Columns that are not carried are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import tune

#: Rows of the sample that the classifiers are fitted on, of each language and in all, and the most languages.
PER_LANGUAGE, IN_ALL, MAX_LANGUAGES = 600, 6_000, 200
#: Hashed features, rounds of the fit, and the softmax margin below which a prediction is ambiguous.
FEATURES, ROUNDS, AMBIGUOUS = 1 << 13, 200, 0.2
UNKNOWN = "und"


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 a language.  Up to 6 languages all splits in two are used (the exhaustive code); beyond, random
    splits, of which the matrix with the largest least distance out of 64 is kept."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 6:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1.0 if (s >> i) & 1 else -1.0 for s in splits] for i in range(languages)])
    rng, bits = np.random.default_rng(7), int(np.ceil(12 * np.log2(languages)))
    best, width = None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(languages)
        if apart.min() > width:
            best, width = code, apart.min()
    return best


def features(raw: bytes) -> np.ndarray:
    """Square roots of the shares of the hashed byte n-grams, n = 1 to 4, of a text with blanks and case evened out."""
    x = np.frombuffer(b" " + b" ".join(raw.lower().split()) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(FEATURES, np.float32)
    gram = x
    for n in range(1, 5):
        if n > 1:
            if len(x) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | x[n - 1 :]
        place = ((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - 13)
        counts += np.bincount(place, minlength=FEATURES)
    return np.sqrt(counts / max(1, len(x)))


def packed(x: np.ndarray) -> bytes:
    """The features of a text without the zeros."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n, x = len(raw) // 6, np.zeros(FEATURES, np.float32)
    x[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return x


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each codeword: the logistic loss of the margins, each weighted by its size."""
        margins = np.clip(x @ self.weights + self.bias, -30, 30)
        weight = np.abs(margins) / np.maximum(np.abs(margins).sum(axis=1, keepdims=True), 1e-9)
        return np.stack([(weight * np.logaddexp(0, -margins * word)).sum(axis=1) for word in self.code], axis=1)


def fit(rows: list[tuple[str | bytes, str]]) -> Model:
    """Fits the classifiers of all bits at once, by gradient steps with momentum, on (text or its packed features, language)."""
    languages = tuple(sorted({lang for _, lang in rows}))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((FEATURES, code.shape[1])), np.zeros(code.shape[1]))
    x = np.stack([unpacked(v) if isinstance(v, bytes) else features(v.encode("utf-8", "ignore")) for v, _ in rows]).astype(np.float32)
    at = np.array([languages.index(lang) for _, lang in rows])
    y, share = code[at].astype(np.float32), np.bincount(at, minlength=len(languages))
    rows_weight = (len(at) / len(languages) / share[at]).astype(np.float32)[:, None] / len(at)
    weights, bias = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed, drift = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(ROUNDS):
        slope = -y / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30))) * rows_weight
        speed = 0.9 * speed - 4.0 * (x.T @ slope + 1e-5 * weights)
        drift = 0.9 * drift - 0.5 * slope.sum(axis=0)
        weights, bias = weights + speed, bias + drift
    return Model(languages, code, weights, bias)


def sample(df: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """A bounded sample of labelled rows: (packed features, language).

    The rows of each language are thinned by a hash to about twice the bound where they are read; features are made of what
    is left, and only these are shuffled and ranked.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h"))
    counts = {r.l: r.n for r in known.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    most = max(1, min(per_language, IN_ALL // len(counts)))
    limits = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, -(-2_000_000 * most // max(1, n)))])
    thin = known.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(limits, F.col("l")))

    def vectors(batches):
        for batch in batches:
            raws = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packed(features(r)) for r in raws], pa.binary())], ["l", "h", "v"])

    tune(df.sparkSession)
    found = thin.select("l", "h", "t").mapInArrow(vectors, "l string, h long, v binary").groupBy("l", "h").agg(F.min("v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1_000_000)), "h"))
    picked = found.withColumn("r", rank).where(F.col("r") <= most).collect()
    return [(bytes(r.v), r.l) for r in sorted(picked, key=lambda r: (r.l, r.r))]


def identify(df: DataFrame, model: Model, *, text: str = "text", carry: list[Column | str] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, then lang_pred, score (0 to 1), ambiguous."""
    tune(df.sparkSession)
    kept = df.select(F.col(text).alias("__text"), *carry)
    schema = kept.drop("__text").schema
    sent = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m: Model = sent.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            known = [i for i, t in enumerate(texts) if t and m.languages and any(map(str.isalpha, t))]
            pred, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if known:
                losses = m.losses(np.stack([features(texts[i].encode("utf-8", "ignore")) for i in known]))
                soft = np.exp(losses.min(axis=1, keepdims=True) - losses)
                soft /= soft.sum(axis=1, keepdims=True)
                for i, p in zip(known, soft, strict=True):
                    order = np.argsort(-p, kind="stable")
                    pred[i], score[i] = m.languages[order[0]], float(p[order[0]])
                    unsure[i] = len(order) > 1 and bool(p[order[0]] - p[order[1]] < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*schema.names, "lang_pred", "score", "ambiguous"]
            )

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return kept.mapInArrow(predict, f"{own}, lang_pred string, score double, ambiguous boolean")
