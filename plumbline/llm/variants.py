"""Spelling variants: words one inserted, deleted or replaced letter apart.

A trie-node pair dictionary. All prefixes of all words are the nodes of a trie,
all suffixes those of the trie of the reversed words, and every node has a
number. A word then is known by pairs (prefix node, suffix node): the pair
around a skipped position leaves one letter out, the pair around an insertion
point leaves none out. Words that share a skip pair differ by that one letter;
a word whose skip pair is another's insertion pair is one letter longer. No
other pairs of words are near, so equal pairs of integers are all there is to
join, and nothing has to be verified.

Tries are numbered by tasks over sorted words: a word's new nodes are those
behind its longest common prefix with the word before it. Words are dealt by
ranges; a node that reaches from one range into the next is met at the border
only, so two words of every range settle its number for good (that is all that
comes to the driver). Work grows with the letters of the words, not with their
square, however long they are.

Pairs are sorted, never multiplied: each member of a group gets the number of
its other members and the best of them from one pass. A group holds one word
per letter of the alphabet and one without it.

Words are counted inside the tasks first, in dictionaries of bounded size, so a
frequent word is one row per task.

Defined results: a null or empty text has no words; a null id is an empty text
in the checksum; repeated rows count once each; ties between forms go to the
smaller word in code-point order; an empty table gives no rows; very long words
are words like others. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept, mapped, raw_texts
from plumbline.session import cut, ship

ship(__name__)

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: How many times as frequent a form is as its variant.
RATIO = 10
#: A run of letters whose checksum this number divides loses one of them.
SPOILED = 31
#: The letters of a word.
LETTERS = "a-zÀ-ÿ"
#: Different words that a task counts before it hands them on.
COUNTED = 300_000
#: Words and pairs of one Arrow batch.
ROWS = 50_000
#: A number is that of its range, shifted by PART_BITS, and its place there.
PART_BITS = 38


def spoiler(every: int) -> Callable[[int, str], str]:
    """Deletes one letter of those runs whose checksum with the id `every` divides."""

    def spoil(prefix: int, run: str) -> str:
        h = zlib.crc32(run.encode(), prefix)
        if h % every:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1:]

    return spoil


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                spoiled: int | None = None) -> DataFrame:
    """(word, n): how often each word of enough letters occurs, A-Z lowered.

    `spoiled` plants misspellings: see SPOILED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run shorter than the least cannot become a word
        runs, counts = re.compile(f"[{LETTERS}]{{{least_letters},}}").findall, Counter()
        spoil = spoiler(spoiled) if spoiled else None

        def flush() -> Iterator[pa.RecordBatch]:
            items = iter(counts.items())
            while part := list(islice(items, ROWS)):
                words, n = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                found = runs(raw.lower().decode())
                if spoil is None:
                    counts.update(found)
                else:
                    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(found).items():
                        word = spoil(prefix, word)
                        if len(word) >= least_letters:
                            counts[word] += n
                if len(counts) >= COUNTED:
                    yield from flush()
        yield from flush()

    partial = mapped(docs.select(key, text), run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _common(a: str, b: str) -> int:
    """Letters that two words begin with together."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n                                     # a[:low] is common, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def numbered(words: DataFrame, spelled: str, carried: list[str], label: str) -> DataFrame:
    """`carried` columns, `place` and `nodes`: the numbers of all prefixes of
    `spelled`, the empty one first, written once. `place` numbers the rows in
    code-point order. Borders between ranges are not yet settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = used = place = part << PART_BITS
        last, path = "", [0]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                flat, ends = [], [0]
                for word in piece.column(0).to_pylist():
                    common = _common(last, word)
                    fresh = len(word) - common
                    path = path[:common + 1] + list(range(used + 1, used + 1 + fresh))
                    used, last = used + fresh, word
                    flat.extend(path)
                    ends.append(len(flat))
                if used - base >= 1 << PART_BITS:
                    raise OverflowError("a range of words has too many trie nodes: use more shuffle partitions")
                nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                places = pa.array(np.arange(place, place + piece.num_rows))
                place += piece.num_rows
                yield pa.RecordBatch.from_arrays([*piece.columns, places, nodes], names=["spelled", *carried, "place", "nodes"])

    ordered = words.select(F.expr(spelled).alias("spelled"), *carried).repartitionByRange("spelled").sortWithinPartitions("spelled")
    kinds = dict(words.dtypes)
    schema = ", ".join(["spelled string", *(f"{c} {kinds[c]}" for c in carried), "place long", "nodes array<long>"])
    return kept(ordered.mapInArrow(run, schema), label)


def borders(rows: DataFrame) -> dict[int, int]:
    """Which numbers stand for the same node as a number of an earlier range.

    Collected: the first and last word of every range."""
    ends = rows.groupBy(F.shiftright("place", PART_BITS).alias("part")).agg(
        F.min(F.struct("place", "spelled", "nodes")).alias("first"), F.max(F.struct("place", "spelled", "nodes")).alias("last")).orderBy("part").collect()
    same: dict[int, int] = {}
    for before, after in zip(ends, ends[1:]):
        common = _common(before["last"]["spelled"], after["first"]["spelled"])
        for old, new in zip(before["last"]["nodes"][1:common + 1], after["first"]["nodes"][1:common + 1]):
            same[new] = same.get(old, old)
    return same


def _settled(same: dict[int, int]) -> Callable[[np.ndarray], np.ndarray]:
    """Replaces the numbers of nodes that an earlier range has numbered."""
    keys = np.array(sorted(same), dtype=np.int64)
    values = np.array([same[int(k)] for k in keys], dtype=np.int64)

    def settle(numbers: np.ndarray) -> np.ndarray:
        if not len(keys):
            return numbers
        at = np.minimum(np.searchsorted(keys, numbers), len(keys) - 1)
        return np.where(keys[at] == numbers, values[at], numbers)

    return settle


def node_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words as (id, word, n), ids in code-point order; and their pairs.

    Pairs: (prefix, suffix, id, n, kind). Kind 0 is an insertion point, 1 and 2
    a skipped position; 2 if the letter before is the same one, as leaving out
    either gives the same word, which must count once."""
    forward = numbered(words, "word", ["n"], "prefixes")
    rows = forward.select(F.col("place").alias("id"), F.col("spelled").alias("word"), "n")
    backward = numbered(rows, "reverse(word)", ["id"], "suffixes")
    prefix_of, suffix_of = _settled(borders(forward)), _settled(borders(backward))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            start = 0
            while start < whole.num_rows:
                # as many words as make some ROWS pairs, one at least
                width = np.cumsum(pc.list_value_length(whole.column(2).slice(start, ROWS // 8)).to_numpy(zero_copy_only=False))
                take = max(1, int(np.searchsorted(width, ROWS)))
                batch = whole.slice(start, take)
                start += take
                ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size)
                prefix = prefix_of(batch.column(2).flatten().to_numpy(zero_copy_only=False))
                # the suffix nodes stand from the empty suffix on: turn each word's round
                backwards = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                at = np.arange(int(ends[-1]))
                suffix = suffix_of(backwards[np.repeat(ends - size + ends - 1, size) - at])
                word = np.repeat(np.arange(len(size)), size)
                last = np.zeros(len(at), dtype=bool)
                last[ends - 1] = True
                skip = at[~last]                         # position i of a word: prefix i, suffix i + 1
                letters = np.frombuffer("".join(batch.column(4).to_pylist()).encode("utf-32-le"), dtype=np.uint32)
                owner = word[skip]
                again = np.r_[False, (letters[1:] == letters[:-1]) & (owner[1:] == owner[:-1])]
                kind = np.concatenate([np.zeros(len(at), dtype=np.int8), np.where(again, 2, 1).astype(np.int8)])
                of = np.concatenate([word, owner])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([prefix, prefix[skip]])), pa.array(np.concatenate([suffix, suffix[skip + 1]])),
                    pa.array(ids[of]), pa.array(n[of]), pa.array(kind)], names=["prefix", "suffix", "id", "n", "kind"])

    both = forward.select(F.col("place").alias("id"), "n", F.col("nodes").alias("up"), F.col("spelled").alias("word")).join(
        backward.select("id", F.col("nodes").alias("down")), "id").select("id", "n", "up", "down", "word")
    return rows, both.mapInArrow(run, "prefix long, suffix long, id long, n long, kind byte")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, near, best_n, best): per word and group how many others are near it
    in that group, and the most frequent of them, smaller ids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            # the last group may go on in the next batch
            same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            whole = rows.shape[1] - int(same.sum())
            held = rows[:, whole:]
            if whole:
                yield _joined(rows[:, :whole])
        if held is not None:
            yield _joined(held)

    ordered = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix", F.col("n").desc(), "id")
    return ordered.mapInArrow(run, "id long, near long, best_n long, best long")


def _joined(rows: np.ndarray) -> pa.RecordBatch:
    """Neighbours inside groups of equal (prefix, suffix), given by falling n and rising id."""
    prefix, suffix, ids, n, kind = rows
    head = np.r_[True, (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])]
    group = np.cumsum(head) - 1
    groups = int(group[-1]) + 1
    place = np.arange(len(ids))
    skips = np.bincount(group, kind > 0, groups).astype(np.int64)
    once = np.bincount(group, kind == 1, groups).astype(np.int64)
    plain = np.full(groups, -1)                          # the word without the letter
    plain[group[kind == 0]] = place[kind == 0]

    def leaders(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and second row of each group under the mask, or -1."""
        at, of = place[mask], group[mask]
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.array([], dtype=np.int64)
        first, second = np.full(groups, -1), np.full(groups, -1)
        first[of[start]] = at[start]
        after = start + 1
        after = after[after < len(of)]
        after = after[of[after] == of[after - 1]]
        second[of[after]] = at[after]
        return first, second

    first, second = leaders(kind > 0)
    first_once, _ = leaders(kind == 1)
    near = np.where(kind == 0, once[group], skips[group] - 1 + ((kind == 1) & (plain[group] >= 0)))
    best = np.where(kind == 0, first_once[group], np.where(first[group] == place, second[group], first[group]))
    other = np.where(kind == 1, plain[group], -1)        # the shorter word may be better still
    earlier = (other >= 0) & ((best < 0) | (other < best))
    best = np.where(earlier, other, best)
    has = near > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(near[has]), pa.array(n[best[has]]), pa.array(ids[best[has]])], names=["id", "near", "best_n", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of every row of `forms` (id, form): where its chain of forms
    ends. Chains are halved each time; forms grow by a factor, so they are short."""
    found = cut(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        up = found.select(F.col("id").alias("root"), F.col("root").alias("above"))
        on = found.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        on = cut(on, "roots")
        if on.filter("moved").limit(1).count() == 0:
            return on.select("id", "root")
        found = on.select("id", "root")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of `words` (word, n)."""
    rows, pairs = node_pairs(cut(words.select("word", "n"), "words"))
    per_group = neighbours(pairs)
    found = per_group.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("id"))).alias("best"))
    judged = rows.join(found, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                   F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.id")).alias("form"))
    judged = kept(judged, "judged")
    variants = judged.filter("form is not null")
    ends = roots(variants.select("id", "form"))
    name = lambda n: judged.select(F.col("id").alias(n), F.col("word").alias(f"{n}_word"), F.col("n").alias(f"{n}_n"))
    spelled = (variants.select("id", "form").join(ends, "id").join(name("form"), "form").join(name("root"), "root")
               .select("id", F.col("form_word").alias("form"), "form_n", F.col("root_word").alias("root")))
    return (judged.drop("form").join(spelled, "id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def variants(docs: DataFrame, spoiled: int | None = None, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
             least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """The words of all texts with their near words, forms and roots."""
    return grouped(word_counts(docs, key, text, least_letters, least_count, spoiled), ratio)
