"""Text: cleaning rules, charset cascade, vocabulary, skip-gram pairs, search."""

import math

import pytest
from pyspark.sql import functions as F

from vigil.functions.text import decode_bytes, remove_masks, tokens
from vigil.plans import text


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")) \
        .collect()[0]["r"]




def test_tokens_take_no_step_a_character(spark):
    """Words as one step a word and mark gives them, the words' last letters of several lower cases included."""
    odd = ["\u0391\u03a3 \u0392\u03a3\n\u03a3 \u03a3X  \u0130I X", " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ a", "", "\n\n \n", " A\u00a0B \u0391\u03a3'"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    plain = F.translate(F.regexp_replace("t", "[ \\t\\n\\r\\f\\x0B]*X+", ""), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    plain = F.transform(F.filter(F.split(F.btrim(plain, F.lit("\n")), " "), lambda x: x != ""), lambda x: F.lower(x))
    rows = df.select(tokens(F.col("t")).alias("got"), plain.alias("want")).collect()
    assert all(r.got == r.want for r in rows)
    plan = df.select(tokens(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "translate(" not in plan and "lambda" not in plan


def test_masks(spark):
    assert one(spark, remove_masks, "On XX/XX/2015 XBOX  XXXX ok") == "On//2015BO ok"


def test_tokens_split_only_on_space(spark):
    assert one(spark, tokens, "\n a  b\nc\n") == ["a", "b\nc"]
    assert one(spark, tokens, "Hello, World! It's") == ["hello", "world", "its"]


@pytest.mark.parametrize("raw,expect", [
    (bytes.fromhex("FFFE4100"), "﻿A"),
    (bytes.fromhex("FEFF0041"), "﻿A"),
    (bytes.fromhex("C3A9"), "é"),
    (bytes.fromhex("E941"), "éA"),
])
def test_charset_cascade(spark, raw, expect):
    assert one(spark, decode_bytes, bytearray(raw), "binary") == expect


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_binary_documents_are_decoded(spark):
    df = spark.createDataFrame([(0, bytearray("Café au lait".encode("latin-1")))],
                               "doc_id bigint, text binary")
    assert [r.word for r in text.clean_tokens(df).collect()] == ["café", "au", "lait"]


def test_vocabulary_one_unk_when_n_is_distinct_count(spark):
    toks = text.clean_tokens(docs(spark, ["b a a c", "c a b d"]))
    v = {r.word: (r.id, r.n) for r in text.build_vocabulary(toks).collect()}
    # counts: a 3, b 2, c 2, d 1 -> ids by (count desc, word); d is UNK
    assert v == {"a": (1, 3), "b": (2, 2), "c": (3, 2), "UNK": (0, 1)}
    v3 = {r.word: (r.id, r.n) for r in text.build_vocabulary(toks, 3).collect()}
    assert v3 == {"a": (1, 3), "b": (2, 2), "UNK": (0, 3)}
    enc = text.encode(toks, text.build_vocabulary(toks, 3))
    assert enc.where("id = 0").count() == 3


def test_vocabulary_ids_dense_and_ordered(spark):
    words = " ".join(f"w{i % 37} w{i % 11}" for i in range(500))
    toks = text.clean_tokens(docs(spark, [words, words[:300]]))
    v = text.build_vocabulary(toks).where("id > 0").orderBy("id").collect()
    assert [r.id for r in v] == list(range(1, len(v) + 1))
    assert all((a.n, b.word) > (b.n, a.word) or (a.n > b.n) or (a.n == b.n and a.word < b.word)
               for a, b in zip(v, v[1:]))


def _pairs(spark, texts, window=1, skips=2, **kw):
    d = docs(spark, texts)
    toks = text.clean_tokens(d)
    vocab = text.build_vocabulary(toks, 100)
    return text.skipgram_pairs(text.doc_tokens(d), vocab, window, skips, **kw), vocab


def test_skipgram_six_tokens_circular(spark):
    pairs, vocab = _pairs(spark, ["a b c", "d e f"])
    ids = {r.word: r.id for r in vocab.collect()}
    got = sorted((r.center, r.context) for r in pairs.collect())
    seq = [ids[w] for w in "abcdef"]
    exp = sorted((seq[i], seq[(i + o) % 6]) for i in range(6) for o in (-1, 1))
    assert len(got) == 12 and got == exp
    assert (seq[5], seq[0]) in got and (seq[0], seq[5]) in got


def test_skipgram_within_document_and_sampling(spark):
    pairs, _ = _pairs(spark, ["a b c", "d e f"], within_document=True)
    assert pairs.count() == 8
    sampled, _ = _pairs(spark, ["a b c d e f g h"], window=2, skips=2)
    assert sampled.count() == 16
    with pytest.raises(ValueError):
        _pairs(spark, ["a b c"], window=1, skips=3)


def test_search_bm25_against_brute_force(spark):
    corpus = ["the cat sat", "the dog sat down", "a cat and a dog", "birds fly"]
    postings, dl = text.build_index(docs(spark, corpus))
    q = spark.createDataFrame([(0, "cat dog")], "query_id bigint, text string")
    got = [(r.doc_id, r.score) for r in
           text.search(postings, dl, text.query_terms(q), "bm25").collect()]
    toks = [c.split() for c in corpus]
    avg = sum(map(len, toks)) / 4

    def bm25(d):
        s = 0.0
        for t in ["cat", "dog"]:
            df = sum(t in x for x in toks)
            idf = math.log(1 + (4 - df + .5) / (df + .5))
            tf = toks[d].count(t)
            s += idf * tf * 2.2 / (tf + 1.2 * (1 - .75 + .75 * len(toks[d]) / avg))
        return s
    exp = sorted(((d, bm25(d)) for d in range(4) if bm25(d) > 0), key=lambda x: (-x[1], x[0]))
    assert [g[0] for g in got] == [e[0] for e in exp]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in exp])


def test_search_cosine_self_match_is_one(spark):
    corpus = ["alpha beta", "beta gamma", "delta"]
    postings, dl = text.build_index(docs(spark, corpus))
    q = spark.createDataFrame([(0, "alpha beta")], "query_id bigint, text string")
    top = text.search(postings, dl, text.query_terms(q), "cosine").collect()[0]
    assert top.doc_id == 0 and top.score == pytest.approx(1.0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_skipgram_matches_brute_force_on_short_documents(spark, seed):
    import random
    rng = random.Random(seed)
    window = rng.choice([1, 2, 3])
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 1, 2, 3, 5])))
             for _ in range(rng.randint(3, 8))]
    texts = [t if t else "   " for t in texts]          # some documents have no token
    pairs, vocab = _pairs(spark, texts, window=window, skips=2 * window)
    ids = {r.word: r.id for r in vocab.collect()}
    stream = [ids.get(w, 0) for t in texts for w in t.split(" ") if w]
    doc_of = [i for i, t in enumerate(texts) for w in t.split(" ") if w]
    n = len(stream)
    offs = [o for o in range(-window, window + 1) if o != 0]
    exp = sorted((stream[i], stream[(i + o) % n]) for i in range(n) for o in offs)
    assert sorted((r.center, r.context) for r in pairs.collect()) == exp
    inside, _ = _pairs(spark, texts, window=window, skips=2 * window, within_document=True)
    exp_in = sorted((stream[i], stream[i + o]) for i in range(n) for o in offs
                    if 0 <= i + o < n and doc_of[i + o] == doc_of[i])
    assert sorted((r.center, r.context) for r in inside.collect()) == exp_in


def test_skipgrams_of_repeated_and_missing_ids(spark):
    rows = [(1, "a b c"), (1, "x y z"), (None, "p q"), (None, "r s"), (None, None), (2, "  ")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    vocab = text.build_vocabulary(text.clean_tokens(d), 100)
    ids = {r.word: r.id for r in vocab.collect()}
    got = text.skipgram_pairs(text.doc_tokens(d), vocab, 1, 2, within_document=True).collect()
    words = [t.split() for _, t in rows if t]
    want = [(ids[w[i]], ids[w[i + o]]) for w in words for i in range(len(w)) for o in (-1, 1) if 0 <= i + o < len(w)]
    assert sorted(map(tuple, got)) == sorted(want)
    stream = [ids[w] for w in "p q r s a b c x y z".split()]
    got = text.skipgram_pairs(text.doc_tokens(d), vocab, 1, 2).collect()
    assert sorted(map(tuple, got)) == sorted((stream[i], stream[(i + o) % 10]) for i in range(10) for o in (-1, 1))


def test_drawn_contexts_are_without_replacement(spark):
    d = docs(spark, [" ".join(f"w{i}" for i in range(40)), "v1 v2 v3"])
    vocab = text.build_vocabulary(text.clean_tokens(d), 100)
    got = text.skipgram_pairs(text.doc_tokens(d), vocab, 3, 4).collect()
    per = {}
    for r in got:
        per.setdefault(r.center, []).append(r.context)
    # words differ, so a context drawn twice would show
    assert len(per) == 43 and all(len(c) == len(set(c)) == 4 for c in per.values())


def test_tokens_are_coded_by_block_and_the_vocabulary_meets_distinct_words(spark):
    """A word of a block is one row to the vocabulary, however often it stands there; codes come back as ids in place."""
    from vigil.operators.coded import code_documents, decode, word_ids
    rows = [(2, "b a " * 500), (None, "a c a"), (1, ""), (2, "c"), (5, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    coded = code_documents(text.doc_tokens(d))
    assert sorted((r.word, r.n) for r in coded.words.collect()) == [("a", 502), ("b", 500), ("c", 2)]
    vocab = text.coded_vocabulary(coded)
    want = text.build_vocabulary(text.clean_tokens(d))
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, want.collect()))
    got = decode(coded.documents, word_ids(coded, vocab.where("id > 0")), "key").collect()
    ids = {r.word: r.id for r in vocab.collect() if r.id}
    want = [(k, [ids.get(w, 0) for w in t.split()]) for k, t in rows if t]
    assert sorted(((r.key or 0), r.ids) for r in got) == sorted(((k or 0), x) for k, x in want)
    pairs = text.skipgram_pairs(coded, vocab, 2, 4, within_document=True)
    assert pairs.count() == 4 * 1000 - 6 + 6


def test_encoding_shuffles_fewer_bytes_than_a_row_a_token(spark):
    """No row a token is dealt anew: neither by word nor by document."""
    d = docs(spark, ["the cat the dog " * 50] * 20)
    plan = text.encoded_documents(text.doc_tokens(d), text.build_vocabulary(text.clean_tokens(d)))
    assert plan.count() == 20 and {len(r.ids) for r in plan.collect()} == {200}
    from vigil.operators.coded import code_documents, decode, word_ids
    coded = code_documents(text.doc_tokens(d))
    tree = decode(coded.documents, word_ids(coded, text.coded_vocabulary(coded)), "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in tree and "collect_list" not in tree


# ------------------------------------------------------------------ search by blocks

def corpus(rng, n):
    words = [f"w{int(20 * rng.random() ** 3)}" for _ in range(n)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 30]))) for _ in range(n)]


@pytest.mark.parametrize("method,block", [("bm25", 3), ("cosine", 3), ("bm25", 128)])
def test_block_search_gives_what_scoring_everything_gives(spark, tmp_dir, method, block):
    import random

    from vigil.plans import search
    rng = random.Random(block)
    d = docs(spark, corpus(rng, 120)).repartition(5)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(rng, 15))] + [(99, "nothing here"), (None, "w0 w1 w1")],
                              "query_id bigint, text string")
    qt = text.query_terms(q)
    postings, dl = text.build_index(d)
    search.write_index(text.doc_tokens(d), f"{tmp_dir}/i", method, block_rows=block)
    index = search.read_index(spark, f"{tmp_dir}/i")
    for k in (1, 4, 200):
        # the plain version joins a query's norm by its id, so a query without one has no cosine there
        known = qt if method == "bm25" else qt.where("query_id is not null")
        want = text.search(postings, dl, known, method, k)
        got = search.search(index, known, k)

        def rows(f):
            return sorted(((r.query_id is None, r.query_id or 0), r.rank, r.doc_id, round(r.score, 9)) for r in f.collect())
        assert rows(got) == rows(want)


@pytest.mark.parametrize("method", ["bm25", "cosine"])
def test_search_over_parts_shards_and_groups(spark, tmp_dir, monkeypatch, method):
    """Frequent terms over several parts, documents over several shards, queries in groups: what scoring everything gives."""
    import random

    from vigil.plans import search
    for name, n in (("PART_ROWS", 40), ("SHARD_DOCS", 16), ("QUERIES", 4)):
        monkeypatch.setattr(search, name, n)
    rng = random.Random(7)
    d = docs(spark, corpus(rng, 150)).repartition(3)
    qt = text.query_terms(spark.createDataFrame(list(enumerate(corpus(rng, 12))), "query_id bigint, text string"))
    search.write_index(text.doc_tokens(d), f"{tmp_dir}/i", method, block_rows=4)
    index = search.read_index(spark, f"{tmp_dir}/i")
    assert index.terms.where(F.size("folders") > 1).count() > 0
    postings, dl = text.build_index(d)
    got, want = (sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in f.collect())
                 for f in (search.search(index, qt, 5), text.search(postings, dl, qt, method, 5)))
    assert got == want


def test_postings_travel_as_bytes_and_hits_stay_in_their_shard(spark, tmp_dir):
    """No posting is a row of a shuffle on its way to its block, and no hit of a query on its way to a score."""
    import numpy as np
    import pyarrow as pa

    from vigil.plans import search
    d = docs(spark, ["a b c", "a b", "a c d e"] * 40)
    places, impacts = np.array([5, 1 << 40, 7], np.int64), np.array([.5, .25, .5])
    terms, code, place, impact = search._gathered([search._piece(pa.array(["x", "x", "y"]), places, impacts),
                                                   search._piece(pa.array(["a", "y", "y"]), places, impacts)])
    assert terms.to_pylist() == ["a", "x", "y"] and code.tolist() == [1, 1, 2, 0, 2, 2]
    assert place.tolist() == places.tolist() * 2 and impact.tolist() == impacts.tolist() * 2
    documents, _ = search._documents(text.doc_tokens(d), "cosine", "doc_id")
    assert "Generate" not in documents._jdf.queryExecution().optimizedPlan().toString()
    index = search.index_documents(d, "bm25")
    qt = text.query_terms(spark.createDataFrame([(i, "a b e") for i in range(9)], "query_id bigint, text string"))
    weights = search._query_weights(index, qt, "query_id")
    queries = weights.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("weights"))
    found = search.candidates(index, search.plan_reads(index, weights, queries, 3))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query" not in plan.split("FlatMapCoGroupsInArrow")[0]
    # documents below the third best score are no candidates: of 40 with the best score all are
    assert found.groupBy("query").count().select("count").distinct().collect()[0][0] == 40


def test_search_reads_a_part_of_the_postings(spark):
    """Scored (query, document) pairs of the benchmark queries, before and after."""
    from vigil.operators.materialize import materialize
    from vigil.plans import search

    from .conftest import SF_MID
    d = spark.read.parquet(f"{SF_MID}/documents.parquet")
    q = spark.read.parquet(f"{SF_MID}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    qt = materialize(text.query_terms(q))
    index = search.index_documents(d, "bm25")
    postings, _ = text.build_index(d)
    before = qt.join(postings, "term").select("query_id", "doc_id").distinct().count()
    weights = search._query_weights(index, qt, "query_id")
    queries = weights.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("weights"))
    reads = materialize(search.plan_reads(index, weights, queries, 10))
    after = search.candidates(index, reads).count()
    print("pairs scored", before, after)
    assert after < before / 2
    assert reads.where("not essential").count() > 0


def test_cosine_norm_is_no_fold_for_each_impact(spark):
    """A fold inside the impacts would make a document cost the square of its words."""
    from vigil.plans import search
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20000))), (2, "w1 w1 w2")], "doc_id bigint, text string")
    documents, _ = search._documents(text.doc_tokens(d), "cosine", "doc_id")
    assert "aggregate(" not in documents._jdf.queryExecution().executedPlan().toString()
    rows = documents.collect()
    assert [r.doc_id for r in rows] == [1] and len(rows[0].impacts) == 20000
    # the norm without the two words that both documents hold
    assert rows[0].impacts[0] == pytest.approx(1 / (math.log(2) * math.sqrt(19998)))


def test_index_counts_words_where_a_document_lies(spark):
    """One row for a document until its postings are dealt to blocks: no shuffle of its words before."""
    from vigil.plans import search
    d = spark.createDataFrame([(1, "b a b"), (2, "X"), (None, "a")], "doc_id bigint, text string")
    documents, _ = search._documents(text.doc_tokens(d), "bm25", "doc_id")
    assert "Exchange" not in documents._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.terms, r.impacts) for r in documents.collect()}
    mean = 4 / 3   # the text of a mask alone is a document of no word
    want = {1: (["a", "b"], [2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean)), 4.4 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean))]),
            None: (["a"], [2.2 / (1 + 1.2 * (0.25 + 0.75 / mean))])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_index_of_nothing(spark):
    from vigil.plans import search
    index = search.index_documents(spark.createDataFrame([], "doc_id bigint, text string"), "bm25")
    q = spark.createDataFrame([(0, "a b")], "query_id bigint, text string")
    assert search.search(index, text.query_terms(q)).count() == 0


def test_an_id_on_several_rows_is_several_documents(spark):
    from vigil.plans import search
    d = spark.createDataFrame([(1, "a b"), (1, "a c"), (None, "a a"), (None, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(0, "a")], "query_id bigint, text string")
    got = search.search(search.index_documents(d, "bm25"), text.query_terms(q)).collect()
    assert sorted((r["rank"], r["doc_id"] or 0) for r in got) == [(1, 0), (2, 1), (3, 1)]


# ------------------------------------------------------------------ sketches

def test_sketches_merge_over_sources(spark):
    rows = [(i % 3 if i % 5 else None, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(600)]
    d = spark.createDataFrame(rows, "source int, text string")
    stored = text.word_sketches(d, "source")
    exact = {}
    for s, t in rows:
        exact.setdefault(s, set()).update(t.split())
    got = {r["source"]: r["estimate"] for r in text.distinct_estimate(stored, ["source"]).collect()}
    assert got.keys() == exact.keys() and all(abs(got[s] - len(w)) <= 0.025 * len(w) for s, w in exact.items())
    whole = len(set().union(*exact.values()))
    assert abs(text.distinct_estimate(stored).first()[0] - whole) <= 0.025 * whole
