"""Language-model scores by context-tree weighting of bytes.

A byte is eight binary decisions. Every decision has a counter in each context
of 0 to `depth` bytes before it; each counter predicts by the Krichevsky-
Trofimov rule, and context-tree weighting mixes the depths by how well they
coded the training texts. A score is the probability of the text's bytes and of
its end; -log2 of it over the bytes is the code length per byte. Beside it
stands a smoothed word unigram as base.

Everything the model needs is counted in Spark: texts are dealt into chunks of
bounded size, each task counts the different words and byte strings of a chunk,
and every chunk gets back the values of just its own words and byte strings. So
a frequent word is one row per chunk, and memory in a task is bounded by the
chunk. Byte strings are dealt into buckets by their two nearest context bytes,
so that all contexts that lengthen these two meet in one task, which sums and
weights them as sorted arrays; a chunk's strings of a bucket are one row of
packed arrays. Only the two uppermost depths reach over buckets: at most 65,280
counters, which are broadcast.

Texts are lowered (A-Z) before they are learnt or scored. Defined results: a
null text is empty and consists of its end; a null id belongs to the training
rows; repeated rows count and score each for themselves; an empty table gives no
rows; without training rows every byte costs eight bits. Other columns are not
read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import kept, mapped, raw_texts
from plumbline.session import ship

ship(__name__)

#: Bytes of context; a byte string of depth + 1 bytes must fit 63 bits with room.
#: With less than five the held-out texts are coded worse than by the word unigram.
DEPTH = 5
#: Nearest context bytes that choose the bucket of a byte string, in so many bits.
TOP, BUCKET_BITS = 2, 10
#: Byte strings of one row of the model.
PIECE = 1 << 18
#: Bytes of packed arrays in one Arrow batch.
BATCH_BYTES = 4 << 20
#: Text bytes of a chunk (one longer text is a chunk of its own).
CHUNK_BYTES = 16 << 20
#: Byte strings whose scores are looked up together.
TOGETHER = 1 << 20
#: Ends a text, and stands before its first byte; no UTF-8 text holds it.
EDGE = 0xFF
#: Stands for the end token among the words.
END = b""


def strings(raw: bytes, depth: int) -> np.ndarray:
    """Each byte of the text and its end, behind the `depth` bytes before it, the nearest of them first."""
    padded = np.frombuffer(bytes([EDGE]) * depth + raw + bytes([EDGE]), dtype=np.uint8)
    n = len(raw) + 1
    out = padded[depth:].astype(np.int64)
    for i in range(depth):
        out |= padded[i:i + n].astype(np.int64) << 8 * (i + 1)
    return out


def bucket_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """The bucket of each byte string; it depends on the nearest context bytes alone."""
    nearest = keys >> 8 * (depth + 1 - min(TOP, depth))
    return (nearest * 40503 & 0xFFFF) >> 16 - BUCKET_BITS


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, with the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def packed(numbers: np.ndarray, width: int) -> bytes:
    """The `width` low bytes of whole numbers, all lowest bytes first: most high ones are zero, and compress."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T
    return out.reshape(-1).view("<i8")


def packed_keys(keys: np.ndarray, depth: int) -> bytes:
    """Ascending byte strings as their differences."""
    return packed(np.diff(keys, prepend=0), depth + 1)


def unpacked_keys(raw: bytes, depth: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, depth + 1))


def packed_counts(counts: np.ndarray) -> bytes:
    return packed(counts, max(1, -(-int(counts.max()).bit_length() // 8)))


def unpacked_counts(raw: bytes, size: int) -> np.ndarray:
    return unpacked(raw, len(raw) // size)


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, block): the rows in compressed blocks, each of one chunk, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            begin = 0
            for i, value in enumerate(batch.column(1)):
                size = len(value.as_buffer()) if value.is_valid else 0
                if held and held + size > chunk_bytes:
                    if i > begin:
                        yield block(batch.slice(begin, i - begin), chunk)
                    chunk, held, begin = chunk + 1, 0, i
                held += size + 16
            if batch.num_rows > begin:
                yield block(batch.slice(begin), chunk)

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return kept(mapped(docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")), run, "chunk long, block binary"), "chunked")


def block(rows: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["chunk", "block"])


def rows_of(raw: bytes) -> Iterator[tuple[int | None, bytes, bool]]:
    """doc_id, text and held_out of each row of a block."""
    found = pa.ipc.open_stream(raw).read_all()
    return zip(found.column(0).to_pylist(), raw_texts(found.column(1)), found.column(2).to_pylist())


def tallies(rows: DataFrame, depth: int) -> DataFrame:
    """Per chunk: its different words and byte strings with their training counts."""

    def emit(chunk: int, words: Counter, others: set, grams: list) -> Iterator[pa.RecordBatch]:
        for word in others:
            words.setdefault(word, 0)
        items = iter(words.items())
        while part := list(islice(items, 50_000)):
            size = len(part)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(size, chunk)), pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64()),
                *[pa.nulls(size, field.type) for field in list(_TALLY)[3:]]], schema=_TALLY)
        keys, counts = summed(*zip(*grams))
        buckets = bucket_of(keys, depth)
        order = np.argsort(buckets, kind="stable")
        keys, counts, buckets = keys[order], counts[order], buckets[order]
        starts = np.flatnonzero(np.diff(buckets, prepend=-1))
        rows_ = ({"chunk": chunk, "bucket": int(buckets[a]), "grams": packed_keys(keys[a:b], depth), "counts": packed_counts(counts[a:b])}
                 for a, b in zip(starts, [*starts[1:], len(keys)]))
        yield from batched(rows_, _TALLY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, words, others, grams = None, Counter(), set(), []
        waiting: dict[bool, list] = {False: [], True: []}
        size = 0

        def settle() -> None:
            nonlocal size
            for held, parts in waiting.items():
                if parts:
                    found, n = np.unique(np.concatenate(parts), return_counts=True)
                    grams.append((found, np.zeros_like(n) if held else n))
            if len(grams) > 8:
                grams[:] = [summed(*zip(*grams))]
            waiting[False], waiting[True], size = [], [], 0

        for batch in batches:
            for now, (_, raw, held) in ((n, row) for n, packed_rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in rows_of(packed_rows)):
                if now != chunk:
                    if chunk is not None:
                        settle()
                        yield from emit(chunk, words, others, grams)
                    chunk, words, others, grams = now, Counter(), set(), []
                raw = raw.lower()
                tokens = raw.split()
                tokens.append(END)
                if held:
                    others.update(tokens)
                else:
                    words.update(tokens)
                waiting[held].append(strings(raw, depth))
                size += len(raw)
                if size > 1 << 20:
                    settle()
        if chunk is not None:
            settle()
            yield from emit(chunk, words, others, grams)

    return kept(mapped(rows, run, "chunk long, word binary, n long, bucket int, grams binary, counts binary"), "tallies")


#: ln of the gamma function of small whole numbers and a half or one.
FEW = {plus: np.array([math.lgamma(i + plus) for i in range(1024)]) for plus in (0.5, 1.0)}


def log_gamma(n: np.ndarray, plus: float) -> np.ndarray:
    """ln of the gamma function of n + plus, for whole n; by Stirling's series beyond FEW."""
    out = FEW[plus][np.minimum(n, 1023)]
    many = np.flatnonzero(n > 1023)
    x = n[many] + plus
    out[many] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return out


def coded(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros, 0.5) + log_gamma(ones, 0.5) - math.log(math.pi) - log_gamma(zeros + ones, 1.0)


class Counters:
    """The counters of one bit of the byte in all contexts of one depth.

    They are runs of the sorted byte strings of that depth: `run` is the counter
    of each string. `below` sums what the contexts one byte longer have coded."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, k: int):
        node = keys >> 8 - k
        new = np.diff(node, prepend=-1) != 0
        self.starts, self.run = np.flatnonzero(new), np.cumsum(new) - 1
        self.bit = keys >> 7 - k & 1
        self.ones, total = (np.add.reduceat(c, self.starts) for c in (counts * self.bit, counts))
        self.zeros = total - self.ones
        self.own = coded(self.zeros, self.ones)
        self.weighted, self.share = self.own, np.ones(len(self.own))

    def mix(self, below: np.ndarray) -> None:
        self.weighted = np.logaddexp(self.own, below) - math.log(2)
        self.share = np.exp(self.own - math.log(2) - self.weighted)

    def predict(self, p: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of a one by all depths down to this one, and the weight left to deeper ones."""
        return p + rest * self.share * (self.ones + 0.5) / (self.zeros + self.ones + 1.0), rest * (1 - self.share)


class Subtrees:
    """The byte strings of a bucket, and from them the counters of depths `top` to `depth`."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.top = min(TOP, depth)
        self.depths = [(keys, counts)]           # deepest first
        self.up = []                             # the string one depth higher of each string
        for _ in range(depth, self.top, -1):
            keys, counts = self.depths[-1]
            shorter, at = np.unique(shortened(keys), return_inverse=True)
            self.up.append(at)
            self.depths.append((shorter, np.bincount(at, weights=counts).astype(np.int64)))

    def counters(self, k: int) -> list[Counters]:
        levels = []
        for keys, counts in self.depths:
            here = Counters(keys, counts, k)
            if levels:
                below = levels[-1]
                here.mix(np.bincount(self.above(here, below, len(levels)), weights=below.weighted, minlength=len(here.own)))
            levels.append(here)
        return levels

    def above(self, here: Counters, below: Counters, level: int) -> np.ndarray:
        """The counter one depth higher of each counter `below`."""
        return here.run[self.up[level - 1][below.starts]]

    def over(self, here: Counters, k: int) -> np.ndarray:
        """The counter at depth `top` - 1 of each counter at depth `top`: context, then a leading one and the bits before."""
        keys = shortened(self.depths[-1][0][here.starts])
        return keys >> 8 << 8 | 1 << k | (keys & 255) >> 8 - k

    def summary(self) -> dict[str, np.ndarray]:
        """What the counters at depth `top` add to those above them."""
        found = []
        for k in range(8 if self.top else 0):
            here = self.counters(k)[-1]
            node, at = np.unique(self.over(here, k), return_inverse=True)
            found.append((node, *(np.bincount(at, weights=c) for c in (here.zeros, here.ones, here.weighted))))
        return {name: np.concatenate(c) for name, c in zip(_SUMMARY, zip(*found))} if found else {name: np.zeros(0) for name in _SUMMARY}

    def values(self, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of the mixed probability of each string's last byte. `p`, `rest`: by counter at depth `top` - 1."""
        out = np.zeros(len(self.depths[0][0]))
        for k in range(8):
            levels = self.counters(k)
            at = self.over(levels[-1], k) if self.top else np.zeros(len(levels[-1].own), dtype=int)
            chance, left = levels[-1].predict(p[at], rest[at])
            for level in range(len(levels) - 1, 0, -1):
                at = self.above(levels[level], levels[level - 1], level)
                chance, left = levels[level - 1].predict(chance[at], left[at])
            first = levels[0]
            out += np.log10(np.where(first.bit == 1, chance[first.run], 1 - chance[first.run]))
        return out


def shortened(keys: np.ndarray) -> np.ndarray:
    """Byte strings without the farthest byte of their context."""
    return keys >> 16 << 8 | keys & 255


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of packed arrays in batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes)) + 64
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


_TALLY = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_SUMMARY = ["node", "zeros", "ones", "weighted"]
_MODEL = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()),
                    ("above", pa.list_(pa.struct([("node", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64()), ("weighted", pa.float64())])))])
_VALUES = pa.schema([("chunk", pa.int64()), ("grams", pa.binary()), ("logs", pa.binary())])


def model(tally: DataFrame, depth: int) -> DataFrame:
    """Per bucket: its byte strings with their counts over the corpus, and what they add to the counters above them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, keys, counts, waiting = None, [], [], 0

        def settled() -> Iterator[dict]:
            found, sums = summed(keys, counts)
            above = Subtrees(found, sums, depth).summary()
            listed = [dict(zip(_SUMMARY, (int(n), int(z), int(o), w))) for n, z, o, w in zip(*(above[c].tolist() for c in _SUMMARY))]
            for piece, start in enumerate(range(0, len(found), PIECE)):
                part = slice(start, start + PIECE)
                yield {"bucket": at, "piece": piece, "grams": packed_keys(found[part], depth), "counts": packed_counts(sums[part]), "above": [] if piece else listed}

        for batch in batches:
            for bucket, grams, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if bucket != at:
                    if keys:
                        yield from settled()
                    at, keys, counts, waiting = bucket, [], [], 0
                keys.append(unpacked_keys(grams, depth))
                counts.append(unpacked_counts(n, len(keys[-1])))
                waiting += len(keys[-1])
                if waiting > max(PIECE, 2 * len(keys[0])):
                    found, sums = summed(keys, counts)
                    keys, counts, waiting = [found], [sums], len(found)
        if keys:
            yield from settled()

    dealt = tally.filter("bucket is not null").select("bucket", "grams", "counts").repartition("bucket").sortWithinPartitions("bucket")
    schema = "bucket int, piece long, grams binary, counts binary, above array<struct<node int, zeros long, ones long, weighted double>>"
    return kept(mapped(dealt, lambda batches: batched(rows(batches), _MODEL), schema), "model")


def uppermost(found: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """By counter at the depth above the buckets: chance of a one, and the weight left to deeper ones."""
    top = min(TOP, depth)
    if not top:
        return np.zeros(1), np.ones(1)
    sums = found.select(F.inline("above")).groupBy("node").agg(*[F.sum(c).alias(c) for c in _SUMMARY[1:]]).toArrow()     # at most 255 x 256^(top - 1) rows
    size = 1 << 8 * top
    zeros, ones, below = (np.bincount(sums.column("node").to_numpy(), weights=sums.column(c).to_numpy(), minlength=size) for c in _SUMMARY[1:])
    levels = []
    while True:
        own = coded(zeros.astype(np.int64), ones.astype(np.int64))
        weighted = np.logaddexp(own, below) - math.log(2)
        levels.append((np.exp(own - math.log(2) - weighted), (ones + 0.5) / (zeros + ones + 1.0)))
        if size == 256:
            break
        # the farthest context byte is the lowest of the context
        zeros, ones, below = (c.reshape(-1, 256, 256).sum(1).reshape(-1) for c in (zeros, ones, weighted))
        size >>= 8
    p, rest = np.zeros(256), np.ones(256)
    for share, one in reversed(levels):
        if len(share) > len(p):
            p, rest = (np.repeat(c.reshape(-1, 1, 256), 256, 1).reshape(-1) for c in (p, rest))
        p, rest = p + rest * share * one, rest * (1 - share)
    return p, rest


def string_scores(tally: DataFrame, depth: int) -> DataFrame:
    """Per chunk and bucket: byte strings, and log10 of the mixed probability of the last byte of each.

    A decision is known by its context, and by the bits of the byte already
    decided behind a leading one.
    """
    found = model(tally, depth)
    over = found.sparkSession.sparkContext.broadcast(uppermost(found, depth))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, keys, counts, logs = None, [], [], None
        for batch in batches:
            for bucket, kind, number, grams, n in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if bucket != at:
                    at, keys, counts, logs = bucket, [], [], None
                own = unpacked_keys(grams, depth)
                if kind == 0:
                    keys.append(own)
                    counts.append(unpacked_counts(n, len(own)))
                    continue
                if logs is None:
                    known = np.concatenate(keys)
                    logs = Subtrees(known, np.concatenate(counts), depth).values(*over.value)
                yield {"chunk": number, "grams": grams, "logs": packed(logs[np.searchsorted(known, own)].view("<i8"), 8)}

    asked = tally.filter("bucket is not null").select("bucket", F.lit(1).alias("kind"), F.col("chunk").alias("number"), "grams", F.lit(None).cast("binary").alias("counts"))
    both = found.select("bucket", F.lit(0).alias("kind"), F.col("piece").alias("number"), "grams", "counts").unionByName(asked)
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "kind", "number")
    return mapped(dealt, lambda batches: batched(rows(batches), _VALUES), "chunk long, grams binary, logs binary")


def string_sums(texts: list[tuple[int, np.ndarray]], bits: int, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The sum of the `logs` of each text's byte strings; `texts`: number (fits `bits`) and byte strings, all of them among the sorted `keys`.

    Sorted strings are found in one pass over the keys, each different one once; the numbers ride in the low bits."""
    marked = np.concatenate([strings_ << bits | number for number, strings_ in texts])
    marked.sort()
    own = marked >> bits
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    found = logs[np.searchsorted(keys, own[starts])]
    return np.bincount(marked & (1 << bits) - 1, weights=np.repeat(found, np.diff(starts, append=len(own))))


def scored(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of all documents by models of the training documents."""
    rows = chunked(docs, chunk_bytes)
    tally = tallies(rows, depth)
    by_word = Window.partitionBy("word").orderBy("chunk")                      # a word has one row per chunk
    all_chunks = by_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = kept(tally.filter("word is not null").select("chunk", "word", F.sum("n").over(all_chunks).alias("c"), (F.row_number().over(by_word) == 1).alias("first")), "words")
    total, kinds = words.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    none = F.lit(None)
    known = (words.select("chunk", "word", "c", none.cast("binary").alias("grams"), none.cast("binary").alias("logs"))
             .unionByName(string_scores(tally, depth).withColumns({"word": none.cast("binary"), "c": none.cast("long")})))
    base = math.log10(total + kinds + 1)
    bits = min(15, 63 - 8 * (depth + 1))                                       # left by a byte string for the number of its text

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        is_word = values.column("word").is_valid()
        own_words = values.filter(is_word)
        value_of = dict(zip(own_words.column("word").to_pylist(), np.log10(own_words.column("c").to_numpy() + 1.0).tolist()))
        own_grams = values.filter(values.column("grams").is_valid())
        keys = np.concatenate([unpacked_keys(g, depth) for g in own_grams.column("grams").to_pylist()])
        logs = np.concatenate([unpacked(v, 8).view("<f8") for v in own_grams.column("logs").to_pylist()])
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        out, sums, waiting, size = [], [], [], 0

        def settle() -> None:
            nonlocal size
            first = waiting[0][0]
            for number, value in enumerate(string_sums([(i - first, part) for i, part in waiting], bits, keys, logs).tolist(), first):
                sums[number] += value
            waiting.clear()
            size = 0

        for doc_id, raw, held in (row for packed_rows in texts.column("block").to_pylist() for row in rows_of(packed_rows)):
            raw = raw.lower()
            tokens = raw.split()
            tokens.append(END)
            found = np.fromiter(map(value_of.__getitem__, tokens), dtype=np.float64, count=len(tokens))
            out.append((doc_id, held, len(tokens), int(np.count_nonzero(found)), total, float(found.sum()) - len(tokens) * base, len(raw) + 1))
            sums.append(0.0)
            own = strings(raw, depth)
            for start in range(0, len(own), TOGETHER):
                part = own[start:start + TOGETHER]
                if waiting and (size + len(part) > TOGETHER or len(out) - waiting[0][0] > 1 << bits):
                    settle()
                waiting.append((len(out) - 1, part))
                size += len(part)
        if waiting:
            settle()
        out = [(*row, value, -value / math.log10(2) / size) for (*row, size), value in zip(out, sums)]
        kinds_ = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_)], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, schema)
