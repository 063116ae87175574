"""Retrieval over a saved index with impact-ordered, block-max postings.

The index holds, written once: ``blocks`` (a term's postings by descending impact, cut into blocks, each with its greatest
impact), ``terms`` (document frequency, greatest impact and folders of each term) and ``documents`` (each document's
terms and impacts). An impact is a posting's share of a score without the query's weight and the term's idf, so lengths, norms
and frequencies are not looked up when searching.

A search
1. reads the first blocks of each query term, scores the best documents met there whole, and takes the k-th best score as the
   threshold that any answer must reach;
2. finds the essential terms of a query: of the others the greatest impacts together stay below the threshold, so a
   document that holds none but those is no answer;
3. adds up the blocks that can hold an answer: those whose greatest impact, with the greatest of the query's other terms,
   reaches the threshold; documents below the threshold, and so those without an essential term, are left out.
Blocks and documents left out cannot hold an answer, so the answers are those of scoring every posting.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.coded import code_documents, packed, unpacked
from ..operators.materialize import Scratch, release_shuffles, scratch_path, scratch_table, written
from .text import BM25_B, BM25_K1, TOP_DOCS, doc_tokens

BLOCK_ROWS = 128
FOLDERS = 4096            # folders of an index, at most: ranges of terms beyond share them
PART_ROWS = 1 << 20       # postings of a part of the terms, about
SHARD_DOCS = 1 << 13      # documents whose scores a task holds at a time, about
QUERIES = 1 << 10         # and of how many queries
PRIME, FACTOR = 2147483647, 48271   # places are spread by a multiplication
#: scores are ranked at nine decimals: a bound this much below the threshold still counts
MARGIN = 2e-9
_DOUBLE_SLACK = 1e-12     # of a score: sums in another order


@dataclass
class Index:
    """The tables of one index and the method its impacts are for."""
    method: str
    terms: DataFrame       # term, df, idf, top, folders
    blocks: DataFrame      # folder, term, block, best, places, impacts
    documents: DataFrame   # place, doc_id, terms, impacts


def _idf(method: str, n: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (n - df + 0.5) / (df + 0.5)) if method == "bm25" else F.ln(n / df)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, doc_id, dl, terms, tfs) of rows (place, doc_id, words): a document's words are counted where it lies, in the order of
    the words."""
    for b in batches:
        words = b.column(2)
        sizes = words.value_lengths().fill_null(0).to_numpy()
        coded = words.flatten().dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank[order] = np.arange(len(order))
        wide = max(len(order), 1)
        key, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + rank[coded.indices.to_numpy()], return_counts=True)
        offsets = pa.array(np.searchsorted(key // wide, np.arange(len(sizes) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(sizes.astype(np.int64)),
             pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(order[key % wide]))),
             pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], ["place", "doc_id", "dl", "terms", "tfs"])


def _documents(doc_toks: DataFrame, method: str, key: str) -> tuple[DataFrame, DataFrame]:
    """((place, doc_id, terms, impacts), (term, df, idf)); ``place`` tells rows of one id apart. An impact lacks its term's idf, which
    is a query's to weigh with."""
    documents, terms, _ = _tables(doc_toks, method, key)
    return documents, terms.df


def _tables(doc_toks: DataFrame, method: str, key: str) -> tuple[DataFrame, Scratch, Scratch]:
    """``_documents``, its terms a scratch table, and the scratch table that its documents are read from."""
    if method == "cosine":
        return _directions(doc_toks, key)
    # texts are tokenized and counted once; a document without a word keeps a row without a term, as it counts for the averages
    placed = doc_toks.select(F.monotonically_increasing_id().alias("place"), F.col(key).alias("doc_id"), "words")
    schema = f"place long, doc_id {placed.schema['doc_id'].dataType.simpleString()}, dl long, terms array<string>, tfs array<long>"
    counted = scratch_table(placed.mapInArrow(_counted, schema), "counted")
    docs = counted.df
    n_docs, avgdl = map(F.lit, docs.agg(F.count(F.lit(1)).cast("double"), F.avg("dl")).first())   # two numbers
    terms = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = scratch_table(terms.select("term", "df", _idf(method, n_docs, F.col("df")).alias("idf")), "terms")
    impacts = F.transform("tfs", lambda tf: tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / avgdl)))
    return docs.where(F.size("terms") > 0).select("place", "doc_id", "terms", impacts.alias("impacts")), terms, counted


def _directions(doc_toks: DataFrame, key: str) -> tuple[DataFrame, Scratch, Scratch]:
    """``_tables`` for the cosine: a norm takes the idf of all of a document's terms, which come to the words of its block, once
    each, and not to every posting."""
    coded = code_documents(doc_toks, key)
    n_docs = F.lit(float(coded.documents.count()))
    terms = coded.words.groupBy(F.col("word").alias("term")).agg(F.sum("docs").alias("df"))
    terms = scratch_table(terms.select("term", "df", _idf("cosine", n_docs, F.col("df")).alias("idf")), "terms")
    known = coded.words.join(terms.df.select(F.col("term").alias("word"), "idf"), "word").select(F.col("block").alias("of"), "code", "word", "idf")

    def directions(docs: pa.Table, known: pa.Table) -> pa.Table:
        code, words = known["code"].to_numpy(), known["word"].combine_chunks()
        row, idf = np.zeros(int(code.max()) + 1, np.int64), np.zeros(int(code.max()) + 1)
        row[code], idf[code] = np.arange(len(code)), known["idf"].to_numpy()
        codes = unpacked(docs["codes"].to_pylist())
        wide = len(idf)
        of = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        key, tf = np.unique(of * wide + np.concatenate(codes), return_counts=True)
        of, code = key // wide, key % wide
        norm = np.sqrt(np.bincount(of, (tf * idf[code]) ** 2, len(codes)))
        # a document of terms that all documents hold has no direction: it takes part in no score
        kept = np.flatnonzero(norm > 0)
        live = norm[of] > 0
        of, code, tf = of[live], code[live], tf[live]
        offsets = pa.array(np.searchsorted(of, np.append(kept, len(codes))).astype(np.int32))
        terms = pa.ListArray.from_arrays(offsets, words.take(pa.array(row[code])))
        impacts = pa.ListArray.from_arrays(offsets, pa.array(tf / norm[of]))
        at = pa.array(kept)
        return pa.table([docs["place"].take(at), docs["key"].take(at), terms, impacts], ["place", "doc_id", "terms", "impacts"])

    docs = coded.documents.where("size > 0")
    kind = docs.schema["key"].dataType.simpleString()
    return docs.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        directions, f"place long, doc_id {kind}, terms array<string>, impacts array<double>"), terms, coded.table


# ------------------------------------------------------------------ pieces: postings (term, place, impact) as bytes

PIECE = pa.schema([("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()), ("values", pa.list_(pa.float64())),
                   ("at", pa.binary())])


def _piece(term: pa.Array, place: np.ndarray, impact: np.ndarray) -> bytes:
    """Postings that stand by term. An impact's value is one of few: those are kept once."""
    runs = pc.run_end_encode(term)
    sizes = np.diff(runs.run_ends.to_numpy(), prepend=0)
    values, at = np.unique(impact, return_inverse=True)
    planes = np.ascontiguousarray(place.view(np.uint8).reshape(-1, 8).T).tobytes()
    row = pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(
        (runs.values, sizes.astype(np.int32), planes, values, packed(at)), PIECE.types)], schema=PIECE)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PIECE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def _gathered(pieces: Iterable[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term, place, impact) of pieces: the distinct terms in order and each posting's number among them."""
    names, codes, places, impacts, n = [], [], [], [], 0
    for piece in pieces:
        row = pa.ipc.open_stream(piece).read_next_batch()
        terms, sizes, planes, values, at = (x[0] for x in row.columns)
        sizes = sizes.values.to_numpy()
        names.append(terms.values)
        codes.append(np.repeat(np.arange(n, n + len(sizes)), sizes))
        places.append(np.ascontiguousarray(np.frombuffer(planes.as_py(), np.uint8).reshape(8, -1).T).view(np.int64).ravel())
        impacts.append(values.values.to_numpy()[unpacked([at.as_py()])[0]])
        n += len(sizes)
    coded = pa.concat_arrays(names).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return (coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()][np.concatenate(codes)], np.concatenate(places),
            np.concatenate(impacts))


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else []
    return zip(starts, np.append(starts[1:], len(x)) if len(x) else [])


def _dealt_pieces(part: np.ndarray, coded: pa.DictionaryArray, place: np.ndarray, impact: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """(name, piece) of the postings of each part, by term."""
    code = coded.indices.to_numpy()
    order = np.lexsort((code, part))
    part, code, place, impact = part[order], code[order], place[order], impact[order]
    for low, high in _runs(part):
        piece = _piece(coded.dictionary.take(pa.array(code[low:high])), place[low:high], impact[low:high])
        yield pa.RecordBatch.from_arrays([pa.array([part[low]], pa.int32()), pa.array([piece], pa.binary())], [name, "piece"])


def _spread(places: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    return places % PRIME * FACTOR % PRIME % n


def _by_term(batches: Iterator[pa.RecordBatch], parts: int, n_docs: int, part_rows: int) -> Iterator[pa.RecordBatch]:
    """(part, piece) of rows (place, terms, impacts). A term has a part, or as many as its share of the documents asks for."""
    for b in batches:
        coded = b.column(1).flatten().dictionary_encode()
        if not len(coded):
            continue
        place = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy())
        code = coded.indices.to_numpy()
        home = np.array([crc32(w.encode()) for w in coded.dictionary.to_pylist()], np.int64)
        shares = np.maximum(1, np.bincount(code, minlength=len(home)) / b.num_rows * n_docs // part_rows).astype(np.int64)
        part = (home[code] + _spread(place, shares[code])) % parts
        yield from _dealt_pieces(part, coded, place, b.column(2).flatten().to_numpy(), "part")


BLOCKS = "folder int, term string, block long, best double, places array<long>, impacts array<double>"


def _cut_blocks(pieces: pa.Table, block_rows: int) -> pa.Table:
    """The blocks of a part: of each term the postings by descending impact, ``block_rows`` to a block."""
    terms, code, place, impact = _gathered(x.as_py() for x in pieces["piece"])
    order = np.lexsort((place, -impact, code))
    code, place, impact = code[order], place[order], impact[order]
    first = np.concatenate([[True], code[1:] != code[:-1]])
    at = np.arange(len(code))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    start = np.flatnonzero(nth % block_rows == 0)
    offsets = pa.array(np.append(start, len(code)).astype(np.int32))
    folder = pieces["part"][0].as_py() % FOLDERS
    return pa.table(
        [pa.array(np.full(len(start), folder, np.int32)), terms.take(pa.array(code[start])), pa.array(nth[start] // block_rows),
         pa.array(impact[start]), pa.ListArray.from_arrays(offsets, pa.array(place)), pa.ListArray.from_arrays(offsets, pa.array(impact))],
        ["folder", "term", "block", "best", "places", "impacts"])


def write_index(doc_toks: DataFrame, path: str, method: str, key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> None:
    """Write the index of ``doc_toks`` (key, words) for "bm25" or "cosine" to ``path``.

    Postings travel as bytes to the parts of their terms, which cut and write the blocks, each in a folder of its part; a frequent
    term is spread over parts, by document. Rows of a null or repeated id are documents of their own.
    """
    if method not in ("bm25", "cosine"):
        raise ValueError(f"unknown method {method}")
    spark = doc_toks.sparkSession
    documents, terms, source = _tables(doc_toks, method, key)
    documents.write.option("compression", "zstd").parquet(f"{path}/documents")
    source.drop()
    release_shuffles(spark)
    documents = spark.read.schema(documents.schema).parquet(f"{path}/documents")
    n_docs, rows = documents.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()   # two numbers
    parts, part_rows = -(-(rows or 0) // PART_ROWS) or 1, PART_ROWS
    pieces = documents.select("place", "terms", "impacts").mapInArrow(lambda batches: _by_term(batches, parts, n_docs, part_rows), "part int, piece binary")
    (pieces.groupBy("part").applyInArrow(lambda found: _cut_blocks(found, block_rows), BLOCKS)
     .write.option("compression", "zstd").partitionBy("folder").parquet(f"{path}/blocks"))
    release_shuffles(spark)
    tops = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("term").agg(
        F.max("best").alias("top"), F.collect_set("folder").alias("folders"))
    terms.df.join(tops, "term").write.option("compression", "zstd").parquet(f"{path}/terms")
    terms.drop()
    release_shuffles(spark)
    spark.range(1).select(F.lit(method).alias("method")).write.parquet(f"{path}/about")


#: Columns of the written tables.
TERMS = "term string, df long, idf double, top double, folders array<int>"


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/about").first()["method"], spark.read.schema(TERMS).parquet(f"{path}/terms"),
                 spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/documents"))


def _blocks_of(index: Index, weights: DataFrame) -> DataFrame:
    """The blocks in the folders of the queries' terms; a number for each folder reaches the driver."""
    folders = weights.select(F.explode("folders")).distinct().collect()
    return index.blocks.where(F.col("folder").isin([r[0] for r in folders]))


def _query_weights(index: Index, qterms: DataFrame, qkey: str) -> DataFrame:
    """(query, term, weight, top): the terms of each query that the index knows, with what a posting's impact is multiplied by."""
    known = qterms.join(index.terms, "term")
    if index.method == "bm25":
        return known.select(F.col(qkey).alias("query"), "term", (F.col("qtf") * F.col("idf")).alias("weight"), "top", "folders")
    w = F.col("qtf") * F.col("idf")
    norms = known.groupBy(qkey).agg(F.sqrt(F.sum(w * w)).alias("norm"))
    return (known.join(norms.withColumnRenamed(qkey, "_q"), F.col(qkey).eqNullSafe(F.col("_q"))).where("norm > 0")
            .select(F.col(qkey).alias("query"), "term", (w * F.col("idf") / F.col("norm")).alias("weight"), "top", "folders"))


def _scored(pairs: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query, score) of a few (query, place) pairs: the document's impacts at the query's terms."""
    q = queries.select(F.col("query").alias("_q"), "weights")
    both = pairs.join(documents, "place").join(q, F.col("query").eqNullSafe(F.col("_q")))
    score = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w["weight"] * F.coalesce(
        F.get("impacts", (F.array_position("terms", w["term"]) - 1).cast("int")), F.lit(0.0)))
    return both.select("query", score.alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; every task keeps its own k before rows are shuffled."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), F.asc_nulls_first("doc_id"), "place")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def plan_reads(index: Index, weights: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, term, weight, folders, others, essential, threshold) of each query's terms; ``others`` is the most that the
    query's other terms can add."""
    # a term's first two blocks, of each part that it is spread over
    heads = _blocks_of(index, weights).where("block <= 1").select("term", F.arrays_zip("places", "impacts").alias("rows"))
    met = weights.select("query", "term", "weight").join(heads, "term")
    met = met.select("query", F.explode("rows").alias("r"), "weight").groupBy("query", F.col("r.places").alias("place")).agg(
        F.sum(F.col("weight") * F.col("r.impacts")).alias("score"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "place")
    # a few rows a query, written: the planner knows their size and leaves the documents where they lie
    some = written(met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= 2 * k).select("query", "place"), "heads")
    kth = Window.partitionBy("query").orderBy(F.desc("score"))
    reached = (_scored(some, queries, index.documents).withColumn("n", F.row_number().over(kth)).where(F.col("n") == k)
               .select(F.col("query").alias("_q"), F.col("score").alias("threshold")))
    # with fewer than k documents so far anything may be an answer
    bounded = weights.join(reached, F.col("query").eqNullSafe(F.col("_q")), "left").withColumn(
        "threshold", F.coalesce(F.col("threshold") * (1 - _DOUBLE_SLACK) - MARGIN, F.lit(float("-inf")))).drop("_q")
    # from the term that can add least upwards; a query's terms are its text's words
    up = Window.partitionBy("query").orderBy("gain", "term").rowsBetween(Window.unboundedPreceding, 0)
    gains = bounded.withColumn("gain", F.col("weight") * F.col("top")).withColumns({
        "upto": F.sum("gain").over(up), "all": F.sum("gain").over(Window.partitionBy("query"))})
    return gains.select("query", "term", "weight", "folders", (F.col("all") - F.col("gain")).alias("others"),
                        (F.col("upto") * (1 + _DOUBLE_SLACK) >= F.col("threshold")).alias("essential"), "threshold")


def candidates(index: Index, reads: DataFrame) -> DataFrame:
    """(query, place, score) of the documents that reach their query's threshold, over the blocks that can hold an answer. The score
    of a document that can be one is whole, and one that reaches the threshold holds an essential term.

    A block that a query needs travels once, as bytes, to the shards of its documents, however many queries need it; a shard adds up
    the scores of ``QUERIES`` queries at a time."""
    can = (F.col("weight") * F.col("best") + F.col("others")) * (1 + _DOUBLE_SLACK) >= F.col("threshold")
    needs = reads.select(F.col("term").alias("_t"), "weight", "others", "threshold")
    blocks = _blocks_of(index, reads).select("term", "best", "places", "impacts")
    needed = blocks.join(needs, (F.col("term") == F.col("_t")) & can, "left_semi").select("term", "places", "impacts")
    shards = -(-index.documents.count() // SHARD_DOCS) or 1   # two numbers
    groups = -(-reads.select("query").distinct().count() // QUERIES) or 1

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
                place = b.column(1).flatten().to_numpy()
                coded = b.column(0).take(pa.array(at)).dictionary_encode()
                yield from _dealt_pieces(_spread(place, shards), coded, place, b.column(2).flatten().to_numpy(), "shard")

    kind = reads.schema["query"].dataType

    def scored(pieces: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query", to_arrow_type(kind)), ("place", pa.int64()), ("score", pa.float64())])
        if not pieces.num_rows or not asked.num_rows:
            return schema.empty_table()
        terms, code, place, impact = _gathered(x.as_py() for x in pieces["piece"])
        order = np.argsort(code, kind="stable")
        places, at = np.unique(place, return_inverse=True)
        at, impact = at[order], impact[order]
        ends = np.searchsorted(code[order], np.arange(len(terms) + 1))
        queries = asked["query"].combine_chunks().dictionary_encode(null_encoding="encode")
        of, weight = queries.indices.to_numpy(), asked["weight"].to_numpy()
        limit = np.zeros(len(queries.dictionary))
        limit[of] = asked["threshold"].to_numpy()
        scores, met = np.zeros((len(limit), len(places))), np.zeros((len(limit), len(places)), bool)
        where = pc.index_in(asked["term"].combine_chunks(), terms).fill_null(-1).to_numpy()
        for q, t, w in zip(of, where, weight):
            if t >= 0:
                some = at[ends[t]:ends[t + 1]]
                scores[q, some] += w * impact[ends[t]:ends[t + 1]]
                met[q, some] = True
        q, found = np.nonzero(met & (scores * (1 + _DOUBLE_SLACK) >= limit[:, None]))
        return pa.table([queries.dictionary.take(pa.array(q)), pa.array(places[found]), pa.array(scores[q, found])], schema=schema)

    pieces = needed.mapInArrow(by_shard, "shard int, piece binary").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "piece")
    asked = reads.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("in_shard"),
                         F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("of_group"), "query", "term", "weight", "threshold")
    return pieces.groupBy("shard", "group").cogroup(asked.groupBy("in_shard", "of_group")).applyInArrow(
        scored, f"query {kind.simpleString()}, place long, score double")


def search(index: Index, qterms: DataFrame, k: int = TOP_DOCS, key: str = "doc_id", qkey: str = "query_id") -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of each query of ``qterms`` (query_id, term, qtf).

    Scores are those of ``text.search``: sums over the query's terms, ranked at nine decimals, ties by id. Documents without
    a term of the query are no answers, nor are queries whose terms no document holds; an empty side gives no rows.
    """
    # written: the planner knows their sizes, and while they are small leaves the index where it lies
    weights = written(_query_weights(index, qterms, qkey), "weights")
    # a query's terms are bounded by its text
    queries = written(weights.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("weights")), "queries")
    reads = written(plan_reads(index, weights, queries, k), "reads")
    named = index.documents.select("place", "doc_id")
    best = _best(candidates(index, reads).join(named, "place"), k)
    return best.select(F.col("query").alias(qkey), "rank", F.col("doc_id").alias(key), "score")


def index_documents(docs: DataFrame, method: str, text: str = "text", key: str = "doc_id", path: str | None = None) -> Index:
    """The index of whole texts, written to ``path`` (a new folder under the shared checkpoint folder if None) and read."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, f"index-{method}")
    write_index(doc_tokens(docs, text, key), path, method, key)
    return read_index(spark, path)
