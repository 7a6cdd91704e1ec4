"""Best-fit packing of tokenised documents into sequences.

Every document becomes token pieces of at most `capacity` ids. Packing needs
only the lengths: Spark counts the pieces per length (at most `capacity` rows,
whatever the input), a bin completion search turns these counts into patterns
with repeats, and every piece finds its place from its rank among the pieces of
its length. Ranks come from per-partition counts, so no length meets one task.

Defined results: a null text is an empty one; an empty text is one piece that
holds the end token only; repeated rows are packed once each; equal lengths are
placed by partition and row; an empty table gives no rows. Columns of the input
other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, offsets, raw_texts
from plumbline.session import cut, ship

ship(__name__)

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Branches that the packing search may try after its first solution.
SEARCH_NODES = 20_000
#: Undominated fillings tried around one largest piece.
BRANCHES = 8
#: Words in one generation of remembered ids; two generations are kept.
WORDS_KEPT = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class WordTokenizer:
    """Token ids of whole texts, found word by word.

    White space always ends a pre-token of this tokenizer, upper-case ASCII is
    lowered by its normaliser, and an ASCII letter never shares a pre-token with
    a following ASCII mark other than the apostrophe. So the ids of a text are
    those of its words in order, and each word is tokenised once per task.
    Texts that may spell a special token are tokenised as a whole.
    """

    SPLIT = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]*)\Z")

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.split, self.tokenize = self.SPLIT.match, self.tokenizer.model.tokenize
        # two generations of words, kept by the library's module from task to task
        self.memory = tokenizers.__dict__.setdefault("_words_by_path", {}).setdefault(path, [{}, {}])
        self.marks: dict[bytes, bytes] = {}

    def whole(self, raw: bytes) -> bytes:
        return array("I", self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids).tobytes()

    def word(self, word: bytes) -> bytes:
        """The ids of a word that the younger generation doesn't have."""
        young, old = self.memory
        found = old.get(word)
        if found is None:
            simple = self.split(word)
            if simple is None:
                found = self.whole(word)
            else:
                letters, marks = simple.groups()
                found = array("I", [t.id for t in self.tokenize(letters.decode())]).tobytes()
                if marks:
                    more = self.marks.get(marks)
                    if more is None:
                        more = self.whole(marks)
                        if len(marks) == 1:
                            self.marks[marks] = more
                    found += more
        if len(young) >= WORDS_KEPT:
            self.memory[:] = {}, young
        self.memory[0][word] = found
        return found

    def ids(self, raw: bytes) -> bytes:
        """The ids of a text as unsigned 32-bit numbers, in this machine's order."""
        if b"<|" in raw:
            return self.whole(raw)
        known, word = self.memory[0].get, self.word
        ids = b"".join([known(w) or word(w) for w in raw.lower().split()])
        return ids


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece, written to the scratch folder: `part` and `nth` number
    the pieces of each length inside the partition that made them."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, end = WordTokenizer(tokenizer_path), TaskContext.get().partitionId(), array("I", [END]).tobytes()
        seen, step = np.zeros(capacity + 1, dtype=np.int64), 4 * capacity
        for batch in batches:
            ids, rows, held = batch.column(0).to_pylist(), [], []
            for doc_id, raw in zip(ids, raw_texts(batch.column(1))):
                all_ids = tokens.ids(raw) + end
                if sys.byteorder == "big":
                    all_ids = np.frombuffer(all_ids, dtype=">u4").astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(all_ids), step)):
                    chunk = all_ids[at:at + step]
                    length = len(chunk) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(chunk), part, int(seen[length])))
                    seen[length] += 1
                    if with_ids:
                        held.append(np.frombuffer(chunk, dtype="<u4").astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns, names = [*columns, pa.array(held, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return cut(mapped(docs.select(F.col("doc_id").cast("long"), "text"), pieces, schema), "pieces")


def undominated(filling: list[tuple[int, int]], waste: int, left: np.ndarray) -> bool:
    """False if a length that is still to be had could replace one or two pieces
    of `filling` (length and count; or no piece) and use more of the waste."""
    ones = [x for x, _ in filling]
    options = {0, *ones, *(a + b for i, a in enumerate(ones) for b in ones[:i]), *(2 * x for x, n in filling if n > 1)}
    return not any(left[low + 1:low + waste + 1].any() for low in options if low < len(left) - 1)


def fillings(left: np.ndarray, room: int, most: int) -> list[tuple[int, list[int]]]:
    """Undominated ways to fill `room` with the lengths counted in `left`, by
    waste, larger lengths first; the search ends at a filling without waste.

    A step takes one length as often as it fits, then once less and so on; so
    there are as many steps in a row as different lengths fit into a sequence,
    however many pieces do.
    """
    lengths = np.flatnonzero(left[:room + 1]).tolist()
    found: list[tuple[int, list[tuple[int, int]]]] = []
    steps = 0

    def extend(chosen: list[tuple[int, int]], room: int, upto: int) -> bool:
        nonlocal steps
        steps += 1
        at = min(bisect_right(lengths, room), upto)
        if at == 0:
            for x, n in chosen:
                left[x] -= n
            if undominated(chosen, room, left):
                found.append((room, list(chosen)))
            for x, n in chosen:
                left[x] += n
            return room == 0 or len(found) >= most or steps > 64 * most
        for i in range(at - 1, max(-1, at - 1 - most), -1):
            x = lengths[i]
            for n in range(min(int(left[x]), room // x), 0, -1):
                chosen.append((x, n))
                done = extend(chosen, room - n * x, i)
                chosen.pop()
                if done:
                    return True
        return False

    extend([], room, len(lengths))
    return sorted(((waste, [x for x, n in chosen for _ in range(n)]) for waste, chosen in found), key=lambda f: (f[0], [-x for x in f[1]]))


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and the bound by pieces of over half a
    sequence, which cannot share one; pieces of over `capacity - k` leave room
    for pieces of up to `k` only."""
    sizes = np.arange(len(counts))
    best = -(-int((sizes * counts).sum()) // capacity)
    half = capacity // 2
    for k in range(0, half + 1):
        over = int(counts[capacity - k + 1:].sum())
        large = slice(half + 1, capacity - k + 1)
        spare = int((counts[large] * (capacity - sizes[large])).sum())
        rest = int((counts[k:half + 1] * sizes[k:half + 1]).sum())
        best = max(best, over + int(counts[large].sum()) + max(0, -(-(rest - spare) // capacity)))
    return best


def plan_bins(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their repeats that hold exactly `counts`.

    Bin completion: around the largest length left, undominated fillings are
    tried by growing waste, each as often as the counts allow. A branch is left
    when its waste rules out a better solution than the incumbent. The first
    descent takes the best fit everywhere; the search ends at the lower bound,
    or after `nodes` more branches with the best packing found.
    """
    total, bound = int((np.arange(len(counts)) * counts).sum()), least_bins(counts, capacity)
    left = counts.astype(np.int64).copy()
    best: list[tuple[tuple[int, ...], int]] | None = None
    best_bins = total + 1
    chosen: list[tuple[tuple[int, ...], int]] = []
    bins = waste = spent = 0

    def choices() -> Iterator[tuple[int, tuple[int, ...], int]]:
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        options = fillings(left, capacity - largest, BRANCHES)
        left[largest] += 1
        for unused, filling in options:
            pattern = (largest, *filling)
            repeat = min(int(left[x]) // n for x, n in Counter(pattern).items())
            yield unused, pattern, repeat

    stack: list[Iterator] = []
    undo: list[tuple[int, tuple[int, ...], int]] = []
    down = True
    while True:
        if down:
            if not left.any():
                if bins < best_bins:
                    best, best_bins = list(chosen), bins
                    if best_bins <= bound:
                        return best
                down = False
            else:
                stack.append(choices())
        if not down:
            if not stack:
                return best or []
            if len(undo) == len(stack):
                unused, pattern, repeat = undo.pop()
                chosen.pop()
                bins, waste = bins - repeat, waste - unused * repeat
                for x in pattern:
                    left[x] += repeat
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            down = False
            continue
        unused, pattern, repeat = step
        spent += best is not None
        if best is not None and spent > nodes:
            return best
        if best is not None and waste + unused * repeat > (best_bins - 1) * capacity - total:
            down = False
            undo.append((0, (), 0))
            chosen.append(((), 0))
            continue
        for x in pattern:
            left[x] -= repeat
        chosen.append((pattern, repeat))
        undo.append((unused, pattern, repeat))
        bins, waste = bins + repeat, waste + unused * repeat
        down = True


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For runs of ranks of one length: the sequences and offsets they get."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, repeat in patterns:
        at = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rank = taken.get(length, 0)
            rows.append((length, rank, each, base, at))
            taken[length] = rank + each * repeat
            at += each * length
        base += repeat
    rows.sort()
    return {n: np.array(c, dtype=np.int64) for n, c in zip(("length", "rank", "each", "base", "at"), zip(*rows))} if rows else {}


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> DataFrame:
    """`pieces` (of `token_pieces`) with `sequence_id` and `offset`."""
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("in_part"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():     # at most `capacity` rows
        counts[length] = n
    plan = places(plan_bins(counts, capacity, nodes))
    ranked = (pieces.join(offsets(per_part, "length", "part", "in_part", "earlier"), ["length", "part"])
              .withColumn("rank", F.col("earlier") + F.col("nth")))
    wanted = [c for c in pieces.columns if c not in ("part", "nth")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            keys, key = (plan["length"] << 44) + plan["rank"], (length << 44) + rank
            run = np.searchsorted(keys, key, side="right") - 1
            nth = rank - plan["rank"][run]
            sequence = plan["base"][run] + nth // plan["each"][run]
            offset = plan["at"][run] + nth % plan["each"][run] * length
            columns = [batch.column(c) for c in wanted]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*wanted, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in wanted)
    return ranked.select(*wanted, "rank").mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents packed into sequences: one row per piece with its place."""
    return pack(token_pieces(docs, tokenizer_path, capacity, with_ids), capacity)
