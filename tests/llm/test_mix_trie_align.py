"""Mixing, the trie of conversations and the alignment of tokenizers against brute force, on odd rows."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, conversation_trie, mixing
from tidemark.llm.pieces import read_tokenizer
from tidemark.llm.runtime import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size string, copies string, of_rate string"


def words_of(t):
    return len(WORD.findall(t or ""))


def level_of(sizes, weights, most):
    """Targets by sharing the excess again and again, as fractions."""
    from fractions import Fraction

    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weights[s] for s in free)
        shares = {s: Fraction(rest * weights[s], w) for s in free} if w else {}
        above = [s for s in free if shares[s] > most * sizes[s]]
        if not above:
            return {**fixed, **shares}
        fixed |= {s: most * sizes[s] for s in above}


@pytest.fixture(scope="module")
def mixture(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "ü", "", None, "big", "big", "big"])) for i in range(900)]
    rows += [(900 + i, "one two", f"tiny{i}") for i in range(7)] + [(950, None, "empty"), (951, " \n\t ", "empty")]
    rows += [(None, "no id here", "a"), (None, "nor here at all", "a"), (5, rows[5][1], "b"), (960, " lead\x0band\ttrail \r\n", "a"), (961, "  é😀 x", "ü"), (962, "x " * 30_000, "big")]
    return rows


@pytest.mark.parametrize("few", [10_000, 0])
def test_mix_reaches_targets(spark, mixture, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)  # 0: sources are joined by salts
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in mixture], DOCS)
    mixed = mixing.mix(df, carry=("source", "text"))
    got = mixed.select("doc_id", "size", "source_size", "target", "rate", "copies", "row.source", "row.text").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted((i if i is not None else -1, words_of(t)) for i, t, _ in mixture)
    sizes = Counter()
    for _, t, s in mixture:
        sizes[s] += words_of(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: 1 + k % 3 for k, s in enumerate(order)}
    want = level_of(sizes, weights, 3)
    taken = Counter()
    for r in got:
        assert r.size == words_of(r.text) and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate) and r.copies <= 3
        taken[r.source] += r.size * r.copies
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    for s in sizes:  # the huge document of one source is taken whole or not
        assert abs(taken[s] - want[s]) <= max(0.02 * float(want[s]), 3) or s == "big" or s.startswith("tiny")
    again = mixing.mix(df.repartition(7)).select("doc_id", "size", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixed.select("doc_id", "size", "copies").collect())
    out = mixing.emitted(mixed)
    assert out.count() == sum(r.copies for r in got) and out.where("copy > copies").count() == 0


def test_mix_by_given_weights(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 1), ("b", 6)], "source string, weight int")  # c is left out
    got = {r.source: (r.t, r.n, r.size) for r in mixing.mix(df, weights, most=2, carry=("source",)).groupBy("row.source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n"), F.sum("size").alias("size")).collect()}
    total = sum(v[2] for v in got.values())
    assert got["c"][:2] == (0.0, 0) and got["b"][0] == 2 * got["b"][2] and math.isclose(got["a"][0], total - got["b"][0])
    assert all(abs(t - n) <= 0.005 * t + 1 for t, n, _ in got.values())


def test_mix_draws_every_document_alike(spark):
    """Over seeds the extra copy comes with the rate's fraction for each document, and pairs come independently."""
    digests = [(random.Random(i).getrandbits(52)) for i in range(200)]
    f = 0.3
    drawn = [[((a * (d >> 26) + b * (d & (1 << 26) - 1)) % mixing.PRIME) < f * mixing.PRIME for d in digests] for a, b in mixing.seeds()]
    rates = [sum(row[i] for row in drawn) / len(drawn) for i in range(200)]
    assert abs(sum(rates) / 200 - f) < 0.02 and 0.02 < min(rates) and max(rates) < 0.65
    both = [sum(row[i] and row[i + 1] for row in drawn) / len(drawn) for i in range(199)]
    assert abs(sum(both) / 199 - f * f) < 0.02


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0
    df = spark.createDataFrame([(1, None, None, "", "", ""), (2, "", "s", "", "", "")], DOCS)
    assert [(r.size, r.target, r.copies) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2


# ---------------------------------------------------------------------------------------------------------------- trie


def brute_trie(rows, cross=True):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    built = {}
    for c, turns in convs.items():
        turns.sort()
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if cross else 0
        built[c] = [x[2:] for x in convs.get(c - int(math.fmod(c, 100)), [])[:h]] + [x[2:] for x in turns[h:]]
    members, kids, below, out = defaultdict(list), defaultdict(list), {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        leaves = sum(below[q][0] for q in kids[k]) or 1
        saved = sum(below[q][1] for q in kids[k]) + ((len(m) - 1) * len(k[-1][1]) if k else 0)
        below[k] = (leaves, saved)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def built_trie(df, cross=True):
    space = Workspace(df.sparkSession)
    turns = space.stored(conversation_trie.compact(df, space), "turns")
    convs = space.stored(conversation_trie.lengths(turns), "lengths")
    if cross:
        turns, convs = conversation_trie.crossed(turns, convs)
    found = conversation_trie.trie(turns, convs, space).collect()
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert len({(r.conv_id, r.depth) for r in found}) == len(found)
    return {(r.conv_id, r.depth): tuple(r[n] for n in names) for r in found}


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, high string"


@pytest.mark.parametrize("block", [4, 4096])
def test_trie(spark, monkeypatch, block):
    """Absent bases, conversations shorter than what they lose, ids below 0, null and tied turns, long and equal ones."""
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    rng, rows = random.Random(5), []
    for c in range(-130, 260):
        if rng.random() > 0.2:
            rows += [(c, rng.choice([t, t, t, None, 1]), rng.choice(["u", "u", None]), rng.choice(["a", "a", "bb", None, "ç😀"])) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "u", "x" * t) for c in (300, 355, 356) for t in range(40)] + [(c, 0, "u", "the same") for c in range(1000, 1080)]
    rows += [(None, 1, "u", "lost")] * 3
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], CONVERSATIONS)
    assert built_trie(df) == brute_trie(rows)
    assert built_trie(df, cross=False) == brute_trie(rows, cross=False)


def test_trie_nests_deeply(spark):
    """Chains that hang on chains, one from each: conversation k leaves the one before at its k-th turn."""
    rows = [(c, t, "u", f"{min(t, c) if t >= c else t}-{min(c, t)}" if t <= c else f"own {c} {t}") for c in range(14, 0, -1) for t in range(16)]
    rows = [(20 - c, t, r, x) for c, t, r, x in rows]
    df = spark.createDataFrame([(*r, "", "") for r in rows], CONVERSATIONS)
    assert built_trie(df, cross=False) == brute_trie(rows, cross=False)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert built_trie(spark.createDataFrame([], CONVERSATIONS)) == {}
    short = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 >= 1][:5]
    rows = [(c, 0, "u", "only") for c in short]  # their base is absent, their one turn goes
    df = spark.createDataFrame([(*r, "", "") for r in rows], CONVERSATIONS)
    assert built_trie(df) == brute_trie(rows) and set(built_trie(df)) == {(min(short), 0)}


# ----------------------------------------------------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def pair():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), f.read()


def byte_letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in own)}


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, counts, found = byte_letters(), Counter(), []
    for i, t in rows:
        a, b = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        a_raw = [bytes(letters[c] for c in a_lib.id_to_token(x)) for x in a]
        b_raw = [bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(a_raw) != (" " + t).encode() or b"".join(b_raw) != (" " + t).encode():
            found.append((i, None))
            continue
        spans = []
        for raw in (a_raw, b_raw):
            at, out = 0, []
            for x in raw:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        sides = [[[] for _ in cuts] for _ in range(2)]
        for side, ids, where in zip(sides, (a, b), spans, strict=True):
            for x, (_, e) in zip(ids, where, strict=True):
                side[bisect.bisect_left(cuts, e)].append(x)
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (p, q) in zip(b, spans[1], strict=True) if p < e and s < q]
        counts.update(links)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*sides, strict=True))
        found.append((i, (len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest())))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, *f[:3], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for i, f in found]


ODD = [None, "", " ", "  ", "a", "\n\n x", "中文没有空格" * 30, "▁x", "a▁ b", "<|endoftext|> <s> <unk> <0x41> x", "é" * 50, "😀😀 a😀", "tab\tx  y   z    w", "x" * 300, "ﬁﬀ ½ Å Å", "a b " * 100, " lead", "trail ", " nb", "\x00\x01"]


@pytest.mark.parametrize("stretch, flush", [(48, 40), (1 << 16, 1_000_000)])
def test_alignment(spark, sf, pair, monkeypatch, stretch, flush):
    """Small stretches cut documents many times, small flushes give their sums in parts."""
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "FLUSH", flush)
    rows = [*enumerate(ODD), (None, "a"), (3, "again"), (3, "again")]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 900").limit(60).collect()]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, doc string")
    got = alignment.align(df, *pair)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_alignment(rows), key=str)


def test_groups_cover_the_texts(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 48)
    rows = [*enumerate(ODD), (3, "again"), (None, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in alignment.groups(df, *pair).collect():
        got[r.doc, r.doc_id].append((r.start, r.length, r.a_ids, r.b_ids))
    want = {r[0]: r for r in brute_alignment(rows) if r[0] not in (3, None)}
    seen = {i: sorted(v) for (_, i), v in got.items()}
    for i, t in enumerate(ODD):
        if want.get(i) and want[i][1]:
            parts = seen[i]
            assert [s for s, *_ in parts] == [0, *(s + n for s, n, *_ in parts)][:-1] and parts[-1][0] + parts[-1][1] == len((" " + t).encode())
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in parts)
            assert hashlib.sha256(text.encode()).hexdigest() == want[i][-1]
        elif i != 3:
            assert i not in seen
    assert len([k for k in got if k[1] in (3, None)]) == 3  # " " twice and again


def test_chunks_are_the_library(pair, monkeypatch):
    held = alignment.Tokenizers(*pair)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["word", " ", " ", "  ", "é", "中", "\n", "\t", "x" * 60, ".", "\u00a0"]) for _ in range(rng.randint(1, 30)))
        assert np.frombuffer(held.pieces(text), held.types[1]).tolist() == held.b.encode(text)
