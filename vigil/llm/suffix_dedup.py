"""Removing repeated passages with suffix arrays.

Every string of ``length`` bytes that starts at two places or more is repeated, and each byte that one covers goes.
A string's key is the least hash of the short grams inside it, so equal strings have one key wherever they stand. A text
falls into segments, runs of starts with one key; a segment's bytes are its starts and the ``length - 1`` bytes behind
them. Segments are grouped by key and content: what is alike is counted before it is shuffled, and only one copy of
the segments whose key stands in different ones is fetched. These are dealt by key to shards.

A shard builds a suffix array by Larsson-Sadakane refinement (groups of equal prefixes are sorted again by the rank
of what follows, the prefix doubling) and common prefixes by Kasai's method, run in many stretches side by side. Neighbours
with ``length`` bytes in common form classes; classes that count two places or more are repeated. A key with more bytes than a
shard takes is dealt over several; their distinct strings, as digests in blocks, meet in buckets and are counted there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import scratch_path

LENGTH = 400
GRAM = 32                   # bytes of a gram; a power of two, at most the length
STARTS = 8192               # starts of a segment, at most: what one row holds
CUT_BYTES = 2 << 20         # bytes of texts cut into segments together; longer texts are taken in pieces
SHARD_BYTES = 2 << 20       # bytes that one suffix array covers, about
STRETCH = 1024              # bytes of a stretch of Kasai's method
BLOCK = 256                 # strings of one row, at most
BUCKETS = 4                 # buckets of strings for each part of a key
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# ------------------------------------------------------------------ segments

def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes at each place, from those of its halves."""
    h = data.astype(np.uint64) + np.uint64(1)
    size, factor = 1, _ODD
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * factor + h[size:]
            factor *= factor
            size *= 2
        h ^= h >> np.uint64(30)
        h *= _MIX[0]
        h ^= h >> np.uint64(27)
        h *= _MIX[1]
    return h ^ (h >> np.uint64(31))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: running minima of blocks, from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, starts: int = STARTS
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, starts, key, own) of the segments of bodies that stand one after the other and end at ``ends``; ``own``: the key's gram
    stands in the segment more than once, so that a string may repeat inside it."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(bool)
    hashes = gram_hashes(data, gram)
    keys = sliding_least(hashes, length - gram + 1)
    at = np.arange(len(keys))
    at = at[at + length <= np.repeat(ends, np.diff(ends, prepend=0))[:len(keys)]]
    if not len(at):
        return none, none, none, none.astype(bool)
    new = np.concatenate([[True], (np.diff(at) != 1) | (keys[at[1:]] != keys[at[:-1]])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - head) % starts == 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    key = keys[start]
    # a gram at one place serves so many starts at most
    own = count > length - gram + 1
    for i in np.flatnonzero(~own).tolist():
        own[i] = np.count_nonzero(hashes[start[i]:start[i] + count[i] + length - gram] == key[i]) > 1
    return start, count, key.view(np.int64), own


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for v in batch.column(column):
        yield v.as_py() or b""


def _written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table under the shared checkpoint folder."""
    path = scratch_path(frame.sparkSession, f"suffix-{name}")
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


SEGMENTS = "place long, start long, starts long, key long, digest binary, own boolean"


def cut_texts(rows: DataFrame, length: int, gram: int, starts: int = STARTS) -> DataFrame:
    """The segments of every text (place, body), with a digest of their bytes. Texts are taken together up to ``CUT_BYTES``, and a
    longer one in pieces that overlap by ``length - 1`` bytes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for place, body in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                for a in range(0, max(1, len(body) - length + 1), CUT_BYTES):
                    held.append((place, a, body[a:a + CUT_BYTES + length - 1]))
                    size += len(held[-1][2])
                    if size >= CUT_BYTES:
                        yield found(held)
                        held, size = [], 0
        if held:
            yield found(held)

    def found(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = b"".join(b for _, _, b in held)
        ends = np.cumsum([len(b) for _, _, b in held])
        start, count, key, own = segments(np.frombuffer(data, np.uint8), ends, length, gram, starts)
        view = memoryview(data)
        digests = [hashlib.blake2b(view[a:a + n + length - 1], digest_size=16).digest()
                   for a, n in zip(start.tolist(), count.tolist())]
        of = np.searchsorted(ends, start, side="right")
        origin = np.array([a for _, a, _ in held]) - np.concatenate([[0], ends[:-1]])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([p for p, _, _ in held])[of]), pa.array(start + origin[of]), pa.array(count), pa.array(key),
             pa.array(digests, pa.binary()), pa.array(own)], ["place", "start", "starts", "key", "digest", "own"])

    return rows.mapInArrow(cut, SEGMENTS)


# ------------------------------------------------------------------ suffix array

def suffix_array(data: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order; the end stands before any byte. Suffixes alike so far share the rank of
    their group's first place; only groups of several are sorted again."""
    n = len(data)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = data
    key = np.zeros(n, np.uint64)
    for i in range(7):   # seven bytes, and how many of them there are
        key = (key << np.uint64(8)) | wide[i:n + i]
    key = (key << np.uint64(3)) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])[:n]   # the first of a group
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    at = np.arange(n)   # places in groups of several
    h = 7
    while True:
        alone = head[at] & np.concatenate([head, [True]])[at + 1]
        at = at[~alone]
        if not len(at):
            return order
        pos = order[at]
        group = rank[pos]
        behind = np.zeros(len(pos), np.int64)
        inside = pos + h < n
        behind[inside] = rank[pos[inside] + h] + 1
        again = np.argsort(group * np.int64(n + 1) + behind)   # groups keep their places
        pos, behind, group = pos[again], behind[again], group[again]
        order[at] = pos
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])])
        head[at] = new
        rank[pos] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, stretch: int = STRETCH) -> np.ndarray:
    """The common prefix of each suffix and the one before it in ``order``, up to ``most``: Kasai's method. A place's prefix
    is at least its left neighbour's less one; the text's stretches advance side by side."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    lanes = np.arange(0, n, stretch)
    known = np.zeros(len(lanes), np.int64)
    for step in range(min(stretch, n)):
        if step and lanes[-1] + step >= n:   # the last stretch is shorter
            lanes, known = lanes[:-1], known[:-1]
            if not len(lanes):
                break
        at = lanes + step
        other = before[at]
        known = np.where(other < 0, 0, np.maximum(known - 1, 0))
        room = np.minimum(most, n - np.maximum(at, other))
        live = np.flatnonzero((other >= 0) & (known < room))
        while len(live):
            differ = words[at[live] + known[live]] ^ words[other[live] + known[live]]
            alike = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            known[live] = np.minimum(known[live] + alike, room[live])
            live = live[(alike == 8) & (known[live] < room[live])]
        out[at] = known
    return out[order]


def classes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): suffixes in order, and the number of their class of equal first ``length`` bytes. Only places with
    ``length`` bytes behind them are meant."""
    order = suffix_array(data)
    return order, np.cumsum(common_prefixes(data, order, length) < length)


def repeated_starts(parts: list[bytes], weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, total, firsts): of the starts of all parts, one after the other (``offsets`` cuts them), how many places hold
    the start's string, each part's counting ``weights`` times; ``firsts`` has one start of each string."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    counts = sizes - length + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    order, kind = classes(data, length)
    part = np.repeat(np.arange(len(parts)), sizes)
    valid = order + length <= ends[part[order]]
    place, kind = order[valid], kind[valid]
    owner = part[place]
    number = place - (ends - sizes)[owner] + offsets[owner]   # among all starts
    sums = np.bincount(kind, weights=weights[owner].astype(float))
    total = np.zeros(offsets[-1], np.int64)
    total[number] = sums[kind]
    return offsets, total, number[np.concatenate([[True], kind[1:] != kind[:-1]])[:len(number)]]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


# ------------------------------------------------------------------ shards

FOUND = "key long, digest binary, lows array<long>, highs array<long>, bucket long, strings binary"
KNOWN = "key long, digest binary, lows array<long>, highs array<long>"
#: A string of a shard: its digest (a, b), its places in the shard, and if there is one only, its start in the segment with the
#: digest (c, d), else -1: what repeats in a shard is known there.
STRING = np.dtype([("a", "<i8"), ("b", "<i8"), ("times", "<i8"), ("start", "<i8"), ("c", "<i8"), ("d", "<i8")])


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[list[tuple]]:
    """Rows (key, part, digest, times, parts, bytes) in whole (key, part), up to about ``shard_bytes`` at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and size >= shard_bytes and held[-1][:2] != row[:2]:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield held


def search_shards(dealt: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """What suffix arrays say of the segments (key, part, digest, times, parts, bytes): a row with the runs of repeated starts of
    each; of keys over several shards also the distinct strings in the shard, as blocks of ``STRING`` by ``bucket``. A shard gives a
    key's bucket one row, and one more for each ``BLOCK`` strings."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _shards(batches, shard_bytes):
            bodies = [r[5] for r in rows]
            offsets, total, firsts = repeated_starts(bodies, np.array([r[3] for r in rows]), length)
            found = [(r[0], r[2], *runs(total[a:b] > 1)) for r, a, b in zip(rows, offsets[:-1], offsets[1:])]
            found = [f for f in found if len(f[2])]
            yield _found(FOUND, key=[f[0] for f in found], digest=[f[1] for f in found], lows=[f[2] for f in found],
                         highs=[f[3] for f in found])
            if any(r[4] > 1 for r in rows):
                yield from _strings(rows, bodies, offsets, total, firsts, length)

    return dealt.mapInArrow(search, FOUND)


def _found(schema: str, **columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    none = [None] * len(columns["key"])
    return pa.RecordBatch.from_arrays([pa.array(columns.get(n, none), kinds[k]) for n, k in fields], [n for n, _ in fields])


def _strings(rows: list[tuple], bodies: list[bytes], offsets: np.ndarray, total: np.ndarray, firsts: np.ndarray,
             length: int) -> Iterator[pa.RecordBatch]:
    owner = np.searchsorted(offsets, firsts, side="right") - 1
    spread = np.array([r[4] > 1 for r in rows])[owner]
    firsts, owner = firsts[spread], owner[spread]
    start = firsts - offsets[owner]
    pair = np.empty((len(firsts), 2), "<i8")
    for at in range(0, len(firsts), 1 << 16):
        some = slice(at, at + (1 << 16))
        pair[some] = np.frombuffer(b"".join(
            [hashlib.blake2b(memoryview(bodies[o])[s:s + length], digest_size=16).digest()
             for o, s in zip(owner[some].tolist(), start[some].tolist())]), "<i8").reshape(-1, 2)
    own = np.frombuffer(b"".join(r[2] for r in rows), "<i8").reshape(-1, 2)[owner]
    out = np.empty(len(firsts), STRING)
    out["a"], out["b"], out["c"], out["d"], out["times"] = *pair.T, *own.T, total[firsts]
    out["start"] = np.where(out["times"] > 1, -1, start)
    key = np.array([r[0] for r in rows])[owner]
    bucket = pair[:, 0].view(np.uint64) % np.array([r[4] * BUCKETS for r in rows], np.uint64)[owner]
    by = np.lexsort((owner, bucket, key))
    out, key, bucket = out[by], key[by], bucket[by]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(out)), 0))
    cuts = np.flatnonzero((np.arange(len(out)) - head) % BLOCK == 0)
    ends = np.append(cuts[1:], len(out))
    for at in range(0, len(cuts), 1024):
        some = cuts[at:at + 1024]
        yield _found(FOUND, key=key[some], bucket=bucket[some].astype(np.int64),
                     strings=[out[a:b].tobytes() for a, b in zip(some.tolist(), ends[at:at + 1024].tolist())])


def merge_shards(found: DataFrame) -> DataFrame:
    """(key, digest, lows, highs) of the starts whose string stands at two places or more in all shards together, of (key, bucket,
    strings). A bucket of a key's strings meets in one task, at most ``1 / BUCKETS`` of a shard's bytes in number, about."""
    met = found.repartition("key", "bucket").sortWithinPartitions("key", "bucket")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            for key, bucket, strings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if held and (key, bucket) != last:
                    yield _merged(last[0], held)
                    held = []
                last = key, bucket
                held.append(strings.as_py())
        if held:
            yield _merged(last[0], held)

    return met.mapInArrow(merge, KNOWN)


def _merged(key: int, held: list[bytes]) -> pa.RecordBatch:
    strings = np.frombuffer(b"".join(held), STRING)
    strings = strings[np.lexsort((strings["b"], strings["a"]))]
    first = np.flatnonzero(np.concatenate([[True], (strings["a"][1:] != strings["a"][:-1]) | (strings["b"][1:] != strings["b"][:-1])]))
    total = np.repeat(np.add.reduceat(strings["times"], first), np.diff(np.append(first, len(strings))))
    # starts in the order of their segments
    strings = strings[(total > 1) & (strings["start"] >= 0)]
    strings = strings[np.lexsort((strings["start"], strings["d"], strings["c"]))]
    c, d, start = strings["c"], strings["d"], strings["start"]
    other = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
    low = np.flatnonzero(np.concatenate([[True], other | (start[1:] != start[:-1] + 1)])[:len(start)])
    high = np.append(low[1:], len(start))[:len(low)] - 1
    heads = np.flatnonzero(np.concatenate([[True], other])[:len(start)])   # the first of a segment
    lists = [*np.searchsorted(low, heads).tolist(), len(low)]
    lows, highs = start[low], start[high] + 1
    digest = np.stack([c[heads], d[heads]], axis=1)
    return _found(KNOWN, key=[key] * len(heads), digest=[x.tobytes() for x in digest],
                  lows=[lows[a:b] for a, b in zip(lists, lists[1:])], highs=[highs[a:b] for a, b in zip(lists, lists[1:])])


# ------------------------------------------------------------------ documents

def _dealt(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, part, digest, times, parts, bytes) of the wanted segments: one copy of each, cut from the text it stands in."""
    asks = wanted.groupBy("place").agg(F.collect_list(F.struct("start", "size", "key", "part", "digest", "times", "parts")).alias("asks"))

    def copy(x):
        return F.struct(x["key"].alias("key"), x["part"].alias("part"), x["digest"].alias("digest"), x["times"].alias("times"),
                        x["parts"].alias("parts"),
                        F.substring("body", (x["start"] + 1).cast("int"), x["size"].cast("int")).alias("bytes"))

    # cut before the rows are made: a text is not copied for each of its segments
    cut = rows.join(asks, "place").select(F.explode(F.transform("asks", copy)).alias("x")).select("x.*")
    return cut.repartition("key", "part").sortWithinPartitions("key", "part")


def repeated(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(place, lows, highs): the bytes of each text (place, body) that repeated strings cover, as runs in order."""
    cut = _written(cut_texts(rows, length, gram), "segments")
    # segments alike: their places, and one of them
    alike = cut.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("times"), F.max("own").alias("own"), F.max("starts").alias("starts"),
        F.min(F.struct("place", "start")).alias("at"))
    keys = alike.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("own").alias("any_own"), F.sum("times").alias("all"),
                                    F.sum(F.col("starts") + length - 1).alias("key_bytes"))
    alike = _written(alike.join(keys.where("all > 1 or any_own"), "key"), "alike")
    # of a key with one segment that stands at several places, every start is repeated: no suffix array can add to it
    plain = alike.where("kinds = 1 and times > 1").select(
        "key", "digest", F.array(F.lit(0).cast("long")).alias("lows"), F.array("starts").alias("highs"))
    parts = F.ceil(F.col("key_bytes") / shard_bytes)
    wanted = alike.where("kinds > 1 or times = 1").select(
        "key", F.pmod(F.xxhash64("digest"), parts).alias("part"), "digest", "times", parts.alias("parts"),
        (F.col("starts") + length - 1).alias("size"), F.col("at.place").alias("place"), F.col("at.start").alias("start"))
    found = _written(search_shards(_dealt(rows, wanted), length, shard_bytes), "found")
    # a segment's starts come from several buckets
    spread = merge_shards(found.where("strings is not null").select("key", "bucket", "strings")).groupBy("key", "digest").agg(
        F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs"))
    known = plain.union(found.where("strings is null").select("key", "digest", "lows", "highs")).union(spread)
    covers = cut.select("place", "start", "key", "digest").join(known, ["key", "digest"]).select(
        "place", F.transform("lows", lambda x: x + F.col("start")).alias("lows"),
        F.transform("highs", lambda x: x + F.col("start") + (length - 1)).alias("highs"))
    return covers.groupBy("place").agg(F.flatten(F.collect_list("lows")).alias("lows"),
                                       F.flatten(F.collect_list("highs")).alias("highs"))


def covered(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover; neighbours that touch are one run."""
    order = np.argsort(lows, kind="stable")
    lows, highs = lows[order], np.maximum.accumulate(highs[order])
    first = np.concatenate([[True], lows[1:] > highs[:-1]])
    return lows[first], highs[np.append(np.flatnonzero(first)[1:] - 1, len(highs) - 1)]


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                    texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    A text counts as its UTF-8 bytes, whole and however long, a null one as empty. Each byte goes that a string of ``length``
    bytes covers which starts elsewhere too, in the same or another row, rows that repeat and null or repeated
    doc_ids included; strings are judged on the input. ``kept`` holds the remaining bytes (null unless ``texts``). Texts shorter than
    ``length`` stay; an empty table gives no rows; other columns are not read, whatever their names.
    """
    rows = _written(docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("binary"), F.lit(b"")).alias("body"))
        .withColumn("place", F.monotonically_increasing_id()), "texts")
    marks = repeated(rows.select("place", "body"), length, gram, shard_bytes)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, low, high in zip(_texts(batch, 1), batch.column(2), batch.column(3)):
                kept, n = body, 0
                if low.is_valid:
                    lows, highs = covered(low.values.to_numpy(), high.values.to_numpy())
                    kept, n = b"".join(body[a:b] for a, b in zip([0, *highs.tolist()], [*lows.tolist(), len(body)])), len(lows)
                out.append((len(body), len(body) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return rows.join(marks, "place", "left").select("doc_id", "body", "lows", "highs").mapInArrow(take, schema)
