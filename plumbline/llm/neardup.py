"""Near-duplicates by BagMinHash signatures of word-shingle multisets.

A text is the multiset of its five-word shingles. Every shingle with count `w`
drives Poisson processes over its discretised weight axis [0, w): one process
for each of the intervals [0, 1), [1, 2), [2, 4), [4, 8), ... that begin below
`w`, with points beyond `w` thinned out. Points come in order of time and fall on
a random component; a component keeps its earliest point. Two texts share a
component's point with a probability equal to their weighted Jaccard
similarity. A process ends at once when its time passes the latest kept point,
which is what makes this quick.

Bands of the signature give buckets. A bucket's members are compared with one
pivot, then with its most typical member; members that then still share a bucket
with another class are joined exactly, by their rarest shingles and the places of
these. Each pair is verified by its exact multiset overlap. Links are joined into classes by
alternating star operations. Equal word sequences are one text throughout.

Defined results: words are split at ASCII white space, A-Z lowered; a text of
one to four words is a single shingle; null and empty texts have no words and
form one class of copies; a class is named by its least id (null only if all its
ids are null); repeated rows fall in one class; an empty table gives no rows.
Columns other than the id and `text` are not read by `classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import kept, mapped, raw_texts
from plumbline.session import cut, ship

ship(__name__)

WORDS = 5
SIMILARITY = 0.8
#: 40 bands of 6 components: a pair at 0.8 shares no band once in 190,000 times.
BANDS, ROWS = 40, 6
#: Words of which one task remembers the hash, before it forgets them all.
WORDS_KEPT = 300_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Multisets of hashed shingles of `size` words."""

    def __init__(self, size: int = WORDS):
        import xxhash

        self.size, self.hash, self.known = size, xxhash.xxh64_intdigest, {}

    def _word(self, word: bytes) -> int:
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        value = self.known[word] = self.hash(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """One hash for each shingle of the text, in order."""
        known, word = self.known.get, self._word
        h = np.array([known(w) or word(w) for w in words], dtype=np.uint64)
        size = min(self.size, len(h))
        if not size:
            return h
        n = len(h) - size + 1
        out = np.full(n, size, dtype=np.uint64)
        for i in range(size):
            out = _mix(out * _M1 + h[i:i + n])
        return out

    def bag(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hashes(words), return_counts=True)


def fold(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the intersection and the union of two multisets."""
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][in_a], b[1][in_b]).sum())
    return shared, int(a[1].sum() + b[1].sum()) - shared


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures: texts x components, as 64-bit marks of the points.

    All processes of all texts advance together, texts of few shingles by many
    points a round.
    """
    out = np.zeros((len(bags), size), dtype=np.uint64)
    few = np.array([len(h) < size // 4 for h, _ in bags], dtype=bool)
    for chosen, points in ((np.flatnonzero(few), 24), (np.flatnonzero(~few), 1)):
        if len(chosen):
            out[chosen] = _signatures([bags[i] for i in chosen], size, points)
    return out


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int, points: int) -> np.ndarray:
    element = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([c for _, c in bags]).astype(np.float64)
    text = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    seeds, texts, lows, widths, weights = [], [], [], [], []
    low, width, level = 0.0, 1.0, 1
    while len(element):                                   # intervals [0,1), [1,2), [2,4), ...
        seeds.append(_mix(element + np.full(1, level, dtype=np.uint64) * _M2))
        texts.append(text)
        lows.append(np.full(len(element), low))
        widths.append(np.full(len(element), width))
        weights.append(weight)
        low, width, level = low + width, max(1.0, low + width), level + 1
        more = weight > low
        element, weight, text = element[more], weight[more], text[more]
    seed, text, low, width, weight = map(np.concatenate, (seeds, texts, lows, widths, weights))
    time = np.zeros(len(seed))
    first = np.full(len(bags) * size, np.inf)
    round_ = 0
    while len(seed):
        nth = np.arange(round_ * points + 1, (round_ + 1) * points + 1, dtype=np.uint64)
        bits = _mix(seed[:, None] + nth[None] * _GOLD)
        wait = -np.log(((bits >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0 ** -44) / (size * width[:, None])
        times = time[:, None] + np.cumsum(wait, axis=1)
        slot = text[:, None] * size + ((bits & np.uint64(0xFFFFF)) * np.uint64(size) >> np.uint64(20)).astype(np.int64)
        partial = low + width > weight
        if partial.any():
            where = _mix(bits[partial] ^ _M1) >> np.uint64(11)
            beyond = low[partial, None] + width[partial, None] * (where.astype(np.float64) * 2.0 ** -53) >= weight[partial, None]
            kept = times.copy()
            kept[np.flatnonzero(partial)[:, None].repeat(points, 1)[beyond], np.nonzero(beyond)[1]] = np.inf
        else:
            kept = times
        np.minimum.at(first, slot.ravel(), kept.ravel())
        limit = first.reshape(len(bags), size).max(axis=1)
        time = times[:, -1]
        alive = time < limit[text]
        seed, text, low, width, weight, time = (x[alive] for x in (seed, text, low, width, weight, time))
        round_ += 1
    return (first.view(np.uint64) >> np.uint64(20)).reshape(len(bags), size)     # last bits may depend on the processor


def bands_of(marks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each signature; the band number is part of it."""
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(marks), 1))
    for i in range(rows):
        out = _mix(out * _GOLD + marks[:, i::rows][:, :bands])
    return out.view(np.int64)


def signed(docs: DataFrame, row: str, words: int, bands: int, rows: int) -> DataFrame:
    """Rows with the key of their word sequence and the hashes of their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingles(words)
        for batch in batches:
            keys, bags, at = [], [], []
            for i, raw in enumerate(raw_texts(batch.column(1))):
                split = fold(raw)
                keys.append(xxhash.xxh3_128_digest(b" ".join(split)))
                if split:
                    at.append(i)
                    bags.append(shingles.bag(split))
            found: list = [[] for _ in keys]
            start = 0
            while start < len(bags):                      # bounded memory whatever the texts
                end, total = start, 0
                while end < len(bags) and (end == start or total + len(bags[end][0]) <= 400_000):
                    total += len(bags[end][0])
                    end += 1
                for i, hashes in zip(at[start:end], bands_of(signatures(bags[start:end], bands * rows), bands, rows)):
                    found[i] = hashes
                start = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["row", "text", "key", "bands"])

    return kept(mapped(docs.select(F.col(row).cast("long").alias("row"), "text"), run, "row long, text string, key binary, bands array<long>"), "signed")


def components(edges: DataFrame) -> DataFrame:
    """(key, label) for every node of `edges` (a, b): the least node it reaches.

    Large-star and small-star steps in turn, each a partial aggregation and a
    join, until the edges stay the same.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := state(edges)) != before:
        before = now
        around = both(edges)
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        edges = cut(large.join(lower, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(lower.select("a", F.col("least").alias("b"))).filter("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("key"), F.col("b").alias("label"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Those of the key pairs (a, b) whose exact multiset overlap is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            keep = []
            last: tuple = (None, None)
            for a, left, right in zip(batch.column(0).to_pylist(), raw_texts(batch.column(2)), raw_texts(batch.column(3))):
                if last[0] != a:
                    last = (a, shingles.bag(fold(left)))
                shared, union = overlap(last[1], shingles.bag(fold(right)))
                keep.append(shared >= similarity * union - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = (pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("right")), "b")
             .join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")), "a").select("a", "b", "left", "right"))
    return mapped(sides, run, "a binary, b binary")


def tokens(texts: DataFrame, words: int) -> DataFrame:
    """(key, token, n) for the shingles of each text; the second copy of a
    shingle is a token of its own, so that multisets become sets of n tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                bags = [shingles.bag(fold(raw)) for raw in raw_texts(part.column(1))]
                found = []
                for hashes, counts in bags:
                    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    found.append(_mix(np.repeat(hashes, counts) + nth.astype(np.uint64) * _GOLD))
                sizes = np.array([len(t) for t in found])
                at = np.repeat(np.arange(len(found)), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.concatenate(found).view(np.int64)), pa.array(sizes[at])], names=["key", "token", "n"])

    return mapped(texts.select("key", "text"), run, "key binary, token long, n long")


def prefixes(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(key, token, n, place, typical): the rarest tokens of each text, enough of
    them that two texts without a common one cannot be similar; `place` counts
    from 1 and `typical` tells how common the text's tokens are."""
    every = cut(tokens(texts, words), "tokens")
    frequency = every.groupBy("token").agg(F.count("*").alias("texts"))
    order, whole = Window.partitionBy("key").orderBy("texts", "token"), Window.partitionBy("key")
    placed = (every.join(frequency, "token").withColumn("place", F.row_number().over(order))
              .withColumn("typical", F.avg(F.log("texts")).over(whole)))
    return cut(placed.filter(F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).select("key", "token", "n", "place", "typical"), "prefixes")


def prefix_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts with different labels that may be similar.

    A pair needs `need` common tokens. At their first common token, with places
    i and j, at most min(n - i, n' - j) more can follow. Only pairs of a text
    outside of a token's largest class are formed, so a large class costs one
    row for each text and not one for each pair.
    """
    largest = rows.groupBy("token", "label").agg(F.count("*").alias("texts")).groupBy("token").agg(F.max_by("label", F.struct("texts", "label")).alias("largest"), F.count("*").alias("labels"))
    mixed = cut(rows.join(largest.filter("labels > 1").select("token", "largest"), "token"), "mixed")
    one, other = mixed.filter("label <> largest").alias("x"), mixed.alias("y")
    need = F.ceil(similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    possible = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= need
    return (one.join(other, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & possible)
            .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct())


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def links(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """Classes (key, label) of the distinct texts of `rows` that have a link.

    Every bucket is first compared with one pivot. Members of buckets that are
    not of one class then, are compared with the most typical member of their
    bucket, such as the source of many copies. What still shares a bucket with
    another class is joined by its rarest shingles, which misses no pair.
    """
    distinct = rows.groupBy("key").agg(F.min("row").alias("row"), F.any_value("bands").alias("bands"))
    bucket = distinct.select("key", F.explode("bands").alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    members = cut(bucket.join(shared, "bucket"), "members")
    texts = cut(rows.select("key", "row", "text").join(members.select("key").distinct(), "key").groupBy("key").agg(F.any_value("text").alias("text")), "texts")

    def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
        marked = _labelled(members.select("bucket", "key"), labels)
        mixed = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
        return cut(marked.join(mixed, "bucket"), "undecided")

    def joined(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        new = verified(pairs, texts, similarity, words)
        return components(new if labels is None else labels.select(F.col("key").alias("a"), F.col("label").alias("b")).union(new))

    pivot = members.groupBy("bucket").agg(F.min("key").alias("pivot"))
    labels = joined(members.join(pivot, "bucket").filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), None)
    members = undecided(members, labels)
    rare = prefixes(texts.join(members.select("key").distinct(), "key"), similarity, words)
    typical = rare.groupBy("key").agg(F.max("typical").alias("typical"))
    pivot = members.join(typical, "key").groupBy("bucket").agg(F.max_by(F.struct(F.col("key").alias("pivot"), F.col("label").alias("pivot_label")), F.struct("typical", "key")).alias("p")).select("bucket", "p.*")
    labels = joined(members.join(pivot, "bucket").filter("label <> pivot_label").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), labels)
    members = undecided(members, labels)
    left = rare.join(members.select("key", "label").distinct(), "key")
    return joined(prefix_pairs(left, similarity), labels)


def classes(docs: DataFrame, row: str = "doc_id", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For every row its id and `class_id`, the least id of its class."""
    signed_rows = signed(docs, row, words, bands, rows)
    labels = links(signed_rows, similarity, words)
    least = signed_rows.groupBy("key").agg(F.min("row").alias("least")).join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    linked = least.filter("label <> key or label is null").select("label").distinct()
    merged = least.join(linked, "label", "left_semi").groupBy("label").agg(F.min("least").alias("merged"))
    named = least.join(merged, "label", "left").select("key", F.coalesce("merged", "least").alias("class_id"))
    return signed_rows.select("row", "key").join(named, "key").select(F.col("row").alias(row), "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """`docs` with one row of each class, the first in input order."""
    numbered = kept(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    first = classes(numbered, "__row", similarity, words).filter("__row = class_id").select("__row")
    return numbered.join(first, "__row", "left_semi").select(*docs.columns)
