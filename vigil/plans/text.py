"""Text: cleaning, vocabulary, encoding, skip-gram pairs, word vectors,
and a term index with TF-IDF cosine and BM25 retrieval.

Documents are processed whole inside the JVM (built-in string and array
functions). The corpus-wide orders the source needed (one token stream,
a frequency-ranked vocabulary) are computed with block prefix sums, not a
window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decode_bytes, tokens
from ..operators.coded import Coded, code_documents, decode, word_ids
from ..operators.materialize import scratch_table, written
from ..operators.rownumber import number_rows

UNK = "UNK"
BM25_K1 = 1.2
BM25_B = 0.75
TOP_DOCS = 10


# ------------------------------------------------------------------ M16

def doc_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, words): the cleaned token array of every non-null document.

    A binary ``text`` column goes through the charset cascade first.
    """
    t = F.col(text)
    if isinstance(docs.schema[text].dataType, T.BinaryType):
        t = decode_bytes(t)
    return docs.where(F.col(text).isNotNull()).select(key, tokens(t).alias("words"))


def clean_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, word): one row per token, ``pos`` 0-based inside the document."""
    return doc_tokens(docs, text, key).select(key, F.posexplode("words").alias("pos", "word"))


# ------------------------------------------------------------------ M17

def word_counts(toks: DataFrame) -> DataFrame:
    return toks.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def build_vocabulary(toks: DataFrame, n_words: int | None = None) -> DataFrame:
    """(word, id, n): the ``n_words - 1`` most common words get ids 1.. by
    (count descending, word ascending); ``UNK`` has id 0 and counts the
    tokens left out. ``n_words=None`` uses the distinct word count, so
    exactly one (the rarest) word becomes UNK, as the trainer did.

    The frequency rank is exact and distributed: words are range-partitioned
    by (count descending, word) and numbered over the partitions. The
    counts (one row per distinct word) are written by that once, for the
    limit, the vocabulary rows and the UNK row.
    """
    return vocabulary_of(word_counts(toks), n_words)


def coded_vocabulary(coded: Coded, n_words: int | None = None) -> DataFrame:
    """``build_vocabulary`` of coded documents: the blocks' counts are added up."""
    return vocabulary_of(coded.words.groupBy("word").agg(F.sum("n").alias("n")), n_words)


def vocabulary_of(counts: DataFrame, n_words: int | None = None) -> DataFrame:
    """``build_vocabulary`` of counted words (word, n)."""
    ranked = number_rows(counts, [F.desc("n"), F.asc("word")], out="off", keep=lambda rows: scratch_table(rows, "ranked").df).select(
        "word", (F.col("off") + 1).alias("id"), "n")
    if n_words is None:
        limit = ranked.select(F.count(F.lit(1))).scalar() - 1
    else:
        limit = F.lit(n_words - 1)
    vocab = ranked.where(F.col("id") <= limit)
    unk_n = (ranked.where(F.col("id") > limit)
             .select(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    unk = unk_n.select(F.lit(UNK).alias("word"), F.lit(0).cast("bigint").alias("id"), "n")
    return vocab.select("word", F.col("id").cast("bigint"), "n").unionByName(unk)


def encode(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token rows with ``id`` (0 = UNK). A left equi-join; the planner
    broadcasts the vocabulary only when its measured size allows."""
    v = vocab.where(F.col("id") > 0).select("word", "id")
    return toks.join(v, "word", "left").withColumn("id", F.coalesce("id", F.lit(0)).cast("int"))


def vocab_stats(toks: DataFrame, encoded: DataFrame) -> DataFrame:
    """Token count, distinct words and UNK tokens."""
    a = toks.agg(F.count(F.lit(1)).alias("tokens"),
                 F.count_distinct("word").alias("distinct_words"))
    u = encoded.agg(F.count_if(F.col("id") == 0).alias("unk_tokens"))
    return a.select("*", u.select("unk_tokens").scalar().alias("unk_tokens"))


SKETCH_BITS = 14   # an HLL sketch of 2^14 counters: standard error 1.04 / 2^7, under one per cent


def word_sketches(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, sketch): a mergeable sketch of the distinct words of each group (A20, the approximate form)."""
    words = docs.where(F.col(text).isNotNull()).select(by, F.explode(tokens(F.col(text))).alias("word"))
    return words.groupBy(by).agg(F.hll_sketch_agg("word", F.lit(SKETCH_BITS)).alias("sketch"))


def distinct_estimate(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, estimate): distinct words of stored sketches, merged; no word is read again."""
    return sketches.groupBy(*(by or [])).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


# ------------------------------------------------------------------ M18

def encoded_documents(doc_toks: DataFrame | Coded, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(start, ids): each document's word ids and its place in the one token stream formed by all documents in ``key``
    order (rows of one key, or of none, one after the other as they stand in the input).

    Only lengths are numbered over range partitions. Tokens travel as codes of their block's dictionary, once, and the vocabulary is
    joined with the blocks' distinct words. Documents without a word are left out.
    """
    coded = doc_toks if isinstance(doc_toks, Coded) else code_documents(doc_toks, key)
    starts = number_rows(coded.documents.select("key", "place", "block", F.col("size").alias("len")),
                         [F.asc_nulls_first("key"), F.asc("place")], size="len", out="start", keep=lambda rows: written(rows, "lengths"))
    ids = word_ids(coded, vocab.where("id > 0"))
    encoded = scratch_table(decode(coded.documents, ids, "start", starts.select("block", "place", "start")), "encoded").df
    if coded is not doc_toks:
        coded.table.drop()
    return encoded


def skipgram_pairs(doc_toks: DataFrame | Coded, vocab: DataFrame, window: int = 1,
                   num_skips: int = 2, seed: int = 0, within_document: bool = False,
                   key: str = "doc_id") -> DataFrame:
    """(center, context) word-id pairs of the circular token stream.

    Each token is a center; its contexts are the tokens at offsets
    -window..window (not 0), modulo the stream length, so contexts cross
    document boundaries and the last token pairs with the first. With
    ``num_skips == 2 * window`` all contexts are taken (the trainer's case);
    with fewer, ``num_skips`` offsets are picked per center, without replacement, by a seeded
    hash. ``within_document`` drops pairs that cross documents; documents are rows, whatever their ids.

    ``doc_toks`` holds (key, words) or is coded, ``vocab`` (word, id) with UNK = 0.
    Contexts inside a document are taken from its row of ids. A context outside it lies within ``window`` of a
    document edge, so only edge tokens (at most ``2 * window`` per document) are joined on their stream
    position: no self-join of all tokens, no pair enumeration in a group.
    """
    if num_skips > 2 * window:
        raise ValueError("num_skips must not exceed 2 * window")
    docs = encoded_documents(doc_toks, vocab, key)
    offs = F.array(*[F.lit(o) for o in range(-window, window + 1) if o != 0])
    last = F.size("ids") - 1

    def offsets(p: Column) -> Column:
        if num_skips == 2 * window:
            return offs
        drawn = F.transform(offs, lambda o: F.struct(F.xxhash64(F.lit(seed), F.col("start") + p, o).alias("h"), o.alias("o")))
        return F.transform(F.slice(F.array_sort(drawn), 1, num_skips), lambda s: s["o"])

    def inner(p: Column) -> Column:
        here = F.filter(offsets(p), lambda o: (p + o >= 0) & (p + o <= last))
        return F.transform(here, lambda o: F.struct(F.get("ids", p).alias("center"), F.get("ids", p + o).alias("context")))

    places = F.sequence(F.lit(0), last)
    inside = docs.select(F.explode(F.flatten(F.transform(places, inner))).alias("x")).select("x.*")
    if within_document:
        return inside

    n = docs.select(F.sum(F.size("ids"))).scalar()  # a scalar subquery
    edge = F.filter(places, lambda p: (p < window) | (p > last - window))
    edges = docs.select(F.explode(F.transform(edge, lambda p: F.struct(
        (F.col("start") + p).alias("g"), F.get("ids", p).alias("id"),
        F.filter(offsets(p), lambda o: (p + o < 0) | (p + o > last)).alias("offs")))).alias("x")).select("x.*")
    outward = edges.select(F.col("id").alias("center"), F.col("g"), F.explode("offs").alias("o")).select(
        "center", F.pmod(F.col("g") + F.col("o"), F.lit(n)).alias("t"))
    targets = edges.select(F.col("g").alias("t"), F.col("id").alias("context"))
    return inside.unionByName(outward.join(targets, "t").select("center", "context"))


# ------------------------------------------------------------------ M20

def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id"):
    """(postings(term, doc_id, tf), doc_len(doc_id, dl))."""
    return index_from_tokens(doc_tokens(docs, text, key), key)


def index_from_tokens(doc_toks: DataFrame, key: str = "doc_id"):
    """The index from per-document token arrays (e.g. a checkpointed
    ``doc_tokens`` frame, so documents are tokenized once)."""
    toks = doc_toks.select(key, F.explode("words").alias("word"))
    postings = toks.groupBy(F.col("word").alias("term"), key).agg(
        F.count(F.lit(1)).alias("tf"))
    doc_len = doc_toks.select(key, F.size("words").alias("dl"))
    return postings, doc_len


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id") -> DataFrame:
    """(query_id, term, qtf) from whole query texts, cleaned like documents."""
    return (clean_tokens(queries, text, key).groupBy(key, F.col("word").alias("term"))
            .agg(F.count(F.lit(1)).alias("qtf")))


def search(postings: DataFrame, doc_len: DataFrame, qterms: DataFrame,
           method: str = "bm25", k: int = TOP_DOCS, key: str = "doc_id",
           qkey: str = "query_id") -> DataFrame:
    """(query_id, rank, doc_id, score): top ``k`` documents per query.

    bm25: sum over query terms of qtf * idf * tf (k1 + 1) / (tf + k1 (1 - b
    + b dl / avgdl)), idf = ln(1 + (N - df + .5) / (df + .5)).
    cosine: TF-IDF (tf * ln(N / df)) cosine between query and document.
    Ties by doc id; scores are compared at 9 decimals so summation order
    cannot reorder equal scores.
    """
    n_docs = doc_len.select(F.count(F.lit(1))).scalar()
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if method == "bm25":
        idf = F.ln(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    elif method == "cosine":
        idf = F.ln(n_docs / F.col("df"))
    else:
        raise ValueError(f"unknown method {method}")
    terms = df.select("term", idf.alias("idf"))
    qt = qterms.join(terms, "term")
    if method == "bm25":
        # the length normalization is per posting: computed once on the
        # postings (one row per term and document), so the far larger
        # query x posting hits need no join with the document lengths
        avgdl = doc_len.select(F.avg("dl")).scalar()
        norm = postings.join(doc_len, key).select(
            "term", key, "tf",
            (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / avgdl)).alias("den"))
        contrib = F.col("qtf") * F.col("idf") * F.col("tf") * (BM25_K1 + 1) / F.col("den")
        scores = qt.join(norm, "term").groupBy(qkey, key).agg(F.sum(contrib).alias("score"))
    else:
        hits = qt.join(postings, "term")
        dnorm = (postings.join(terms, "term")
                 .groupBy(key).agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("dn")))
        qnorm = qt.groupBy(qkey).agg(
            F.sqrt(F.sum((F.col("qtf") * F.col("idf")) ** 2)).alias("qn"))
        dot = hits.groupBy(qkey, key).agg(
            F.sum(F.col("qtf") * F.col("tf") * F.col("idf") * F.col("idf")).alias("dot"))
        scores = (dot.join(dnorm, key).join(qnorm, qkey)
                  .select(qkey, key, (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score")))
    w = Window.partitionBy(qkey).orderBy(F.desc(F.round("score", 9)), key)
    return (scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(qkey, "rank", key, "score"))


def lookup_vectors(ids: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Rows with an id and its vector; ids without one drop out. Over a table written by ``files.write_vectors`` only the
    ids are shuffled."""
    return ids.join(vectors, key)


def embedding_lookup(encoded: DataFrame, vectors: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, pos, id, vector) for encoded tokens; UNK has no vector."""
    v = vectors.join(vocab.where(F.col("id") > 0).select("word", "id"), "word")
    return encoded.join(v.select("id", "vector"), "id", "left")
