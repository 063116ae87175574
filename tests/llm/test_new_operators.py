"""Operators 11 to 13 against plain versions, on whole small tables and on awkward rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import conversation_dawg, hard_negatives, queries, suffix_dedup
from vigil.llm.common import table

from ..conftest import SF_SMALL
from . import brute
from .test_operators import same

# ------------------------------------------------------------------ 11 repeated passages


@pytest.mark.parametrize("n", [1, 2, 7, 50, 2000])
def test_suffix_array_and_common_prefixes(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 2, n), np.zeros(n), rng.integers(97, 100, n), np.arange(n) % 3):
        data = data.astype(np.uint8)
        order = suffix_dedup.suffix_array(data)
        b = data.tobytes()
        want = sorted(range(n), key=lambda i: b[i:])
        assert order.tolist() == want

        def common(x, y):
            k = 0
            while k < 40 and max(x, y) + k < n and b[x + k] == b[y + k]:
                k += 1
            return k
        got = suffix_dedup.common_prefixes(data, order, 40, stretch=64)
        assert got.tolist() == [0] + [common(x, y) for x, y in zip(want, want[1:])]


def test_equal_strings_have_one_key():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 103, 300).astype(np.uint8)
    keys = {}
    for _ in range(20):
        body = np.concatenate([rng.integers(97, 103, rng.integers(0, 90)), shared, rng.integers(97, 103, 50)]).astype(np.uint8)
        start, count, key, _ = suffix_dedup.segments(body, np.array([len(body)]), 64, 16, starts=37)
        assert count.max() <= 37 and np.array_equal(start[1:], (start + count)[:-1])
        for a, n, k in zip(start.tolist(), count.tolist(), key.tolist()):
            for p in range(a, a + n):
                assert keys.setdefault(body[p:p + 64].tobytes(), k) == k


def passages(r):
    base = "".join(r.choice("abcd ") for _ in range(3000))
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(6)):
            kind, a = r.randrange(5), r.randrange(2900)
            parts.append(base[a:a + r.randrange(20, 150)] if kind < 2 else
                         "".join(r.choice("abcdé") for _ in range(r.randrange(100))) if kind < 4 else
                         r.choice(["ab", "x", "abc"]) * r.randrange(60))
        rows.append((i if i % 9 else None, "".join(parts)))
    return rows + rows[:7] + [(3, None), (4, ""), (5, "é" * 300), (6, "12, " * 2000), (7, "q" * 5000), (8, "12, " * 900 + "z")]


# shards of one key or less: its strings are merged over shards
@pytest.mark.parametrize("length,gram,shard", [(40, 8, 1 << 20), (40, 8, 500), (64, 32, 3000)])
def test_repeated_passages(spark, length, gram, shard):
    rows = passages(random.Random(length + shard))
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id long, text string, place long, start long, body string")
    got = suffix_dedup.remove_repeated(df.repartition(6), length, gram, shard).collect()
    same([tuple(r)[:5] for r in got], brute.remove_repeated(rows, length))
    import hashlib
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 300)
    rows = passages(random.Random(5))
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 40, 8, texts=False)
    same([tuple(r)[:5] for r in got.collect()], brute.remove_repeated(rows, 40))
    assert got.where("kept is not null").count() == 0


def test_a_spread_key_gives_few_rows(spark):
    """Near copies dealt over several shards: their strings leave in blocks, not a row each, and none is lost."""
    r, length, shard = random.Random(4), 40, 4000
    base = [r.choice("abcdefgh") for _ in range(400)]
    bodies = []
    for i in range(60):
        at = r.randrange(400)
        bodies.append("".join([*base[:at], chr(ord("A") + i % 26), *base[at + 1:]])[r.randrange(30):].encode())
    parts = -(-sum(map(len, bodies)) // shard)
    dealt = [(7, i % parts, i.to_bytes(16, "big"), 1, parts, b) for i, b in enumerate(bodies)]
    rows = spark.createDataFrame(dealt, "key long, part long, digest binary, times long, parts long, bytes binary")
    found = suffix_dedup.search_shards(rows.repartition("key", "part").sortWithinPartitions("key", "part"), length, shard).cache()
    starts = sum(len(b) - length + 1 for b in bodies)
    assert found.count() < 4 * len(bodies) + starts // 20
    spread = suffix_dedup.merge_shards(found.where("strings is not null").select("key", "bucket", "strings"))
    known = found.where("strings is null").select("key", "digest", "lows", "highs").union(spread).collect()
    marked = {(int.from_bytes(x["digest"], "big"), s) for x in known for a, b in zip(x["lows"], x["highs"]) for s in range(a, b)}
    strings = [(i, s, b[s:s + length]) for i, b in enumerate(bodies) for s in range(len(b) - length + 1)]
    seen = Counter(x for _, _, x in strings)
    assert marked == {(i, s) for i, s, x in strings if seen[x] > 1}
    found.unpersist()


def test_op11_on_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    same(queries.op11_suffix_dedup(spark, SF_SMALL).collect(), brute.remove_repeated(rows, 400))


def test_no_passages_in_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeated(df).count() == 0


# ------------------------------------------------------------------ 12 conversations

def test_op12_on_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op12_conversations(spark, SF_SMALL).collect(), brute.repaired_all(rows))


def awkward_turns():
    r = random.Random(2)
    texts = ["a.", "b", "", None, " ", "c! ", "d?  ", "\x85", "e. f", "A.", "é.", "x. ", "long " * 30_000 + "."]
    roles = ["system", "user", "assistant", None, "", "tool", "user", "assistant"]
    rows = [(r.choice([None, *range(25)]), r.choice([None, *range(30)]), r.choice(roles), r.choice(texts)) for _ in range(600)]
    rows += [(99, t % 5, "user", "same.") for t in range(60)] + [(98, None, None, None)] * 9
    return rows + [(97, -2 ** 63, "user", "first."), (97, 2 ** 63 - 1, "assistant", "last.")]


@pytest.mark.parametrize("piece", [conversation_dawg.PIECE, 3, 7])
def test_conversations_in_pieces(spark, piece):
    rows = awkward_turns()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows],
                               "conv_id long, turn long, role string, text string, place string, at long, copies long")
    want = [w if w[0] != 97 or w[1] < 2 ** 63 else (97, 2 ** 63 - 1, *w[2:]) for w in brute.repaired_all(rows)]
    same(conversation_dawg.repair(df.repartition(5), piece).collect(), want)


def test_endings_share_their_nodes():
    path = conversation_dawg.Path()
    strings = sorted(s[::-1] for s in ("suauaua", "uauaua", "uaua", "Xauaua", "su0auaua"))
    for s in strings:
        path.go(s, conversation_dawg.END)
    nodes = {s[:i] for s in strings for i in range(1, len(s) + 1)}
    assert path.made == len(nodes) < sum(map(len, strings))


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_dawg.repair(df).count() == 0


# ------------------------------------------------------------------ 13 hard negatives

def mined(df, **sizes):
    label = F.when(df["vec_id"] % 7 == 0, (df["label"].cast("long") + 1) % 10).otherwise(df["label"])
    return hard_negatives.mine(df, label, df["vec_id"] % 50 == 0, **sizes).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()


def test_op13_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table(spark, SF_SMALL, "embeddings").collect()]
    got = queries.op13_hard_negatives(spark, SF_SMALL).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    same(got, brute.hard_negatives(rows))


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 60, "anchor_rows": 5}])
def test_hard_negatives_awkward(spark, sizes):
    r = random.Random(1)
    rows = [(r.choice([i, i, i, 50 * (i // 40)]), [r.choice([-1.0, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], r.randrange(3))
            for i in range(300)]
    rows += [(None, [1.0] * 4, 1), (3, None, 1), (4, [None, 1.0, 1.0, 1.0], 0), (5, [float("nan")] * 4, 1), (6, [1.0], 1),
             (50, [1.0], 1), (100, [], 0), (150, [], 0), (1, [], 2), (8, [1.0] * 4, None), (8, [float("inf")] * 4, 1)]
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "vec_id long, embedding array<double>, label int, id long, place string")
    same(mined(df.repartition(5), **sizes), brute.hard_negatives(rows))


def test_scores_are_exact_beyond_doubles():
    a, b = np.array([[2.0 ** 40, 1.0]]), np.array([[2.0 ** 20, 1.0], [1e300, 0.0]])
    assert hard_negatives.scores(a, b).tolist() == [[2 ** 60 + 1, 2 ** 63 - 1]]


def test_slots_are_disjoint_and_reach_every_window():
    spans = hard_negatives.slots([100, 100, 60, 10, 0, -5], 50, 95)
    assert spans == [(58, 95), (30, 57), (5, 9), (0, 0)]


def test_no_vectors(spark):
    assert mined(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")) == []
