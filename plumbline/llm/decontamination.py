"""Benchmark decontamination with a generalised suffix automaton.

The test items, as sequences of lower-case words, make one automaton. The words
of a training text are streamed through it; the state gives the longest match
that ends at each word. A match of at least `window` words, or a whole shorter
item, is a hit.

The automaton is broadcast in blocks of at most `block_words` item words, one
after the other, so its size does not depend on the benchmark; the texts pass
once per block. Nothing is shuffled.

Defined results: a null or empty text has no words and no hits; a null or empty
item has no window; a null item id counts as an empty one; equal items are
reported under each of their ids; rows are judged one by one, so repeated rows
get equal results; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import like, mapped, raw_texts
from plumbline.session import cut, ship

ship(__name__)

WINDOW = 10
#: Share of hit words above which a document is dropped rather than cut.
COVERAGE = 0.5
#: Item words in one automaton: some 50 MB in each task.
BLOCK_WORDS = 200_000

#: Every byte that parts words becomes a blank, capitals become small letters.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def fold(raw: bytes) -> bytes:
    return raw.translate(_FOLD)


class Automaton:
    """Generalised suffix automaton of word sequences.

    `step` maps (state << 32 | word) to the next state. For a match that ends in
    a state, `window_state` is the state of its last `window` words, whose
    `items` are the items that hold them; `short` lists the whole items of fewer
    words that end there, `short_link` the nearest such suffix.
    """

    def __init__(self, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: dict[int, int] = {}
        self.length, self.link, self.names = [0], [-1], []
        self.least = window
        self._out: list[list[int]] = [[]]
        self._sequences: list[list[int]] = []

    def _state(self, length: int, link: int, out: list[int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append(out)
        return len(self.length) - 1

    def _go(self, state: int, word: int, to: int) -> None:
        key = state << 32 | word
        if key not in self.step:
            self._out[state].append(word)
        self.step[key] = to

    def _clone(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], list(self._out[q]))
        for w in self._out[q]:
            self.step[clone << 32 | w] = self.step[q << 32 | w]
        while p != -1 and self.step.get(p << 32 | word) == q:
            self.step[p << 32 | word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, name: str, words: list[bytes]) -> None:
        self.names.append(name)
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self._sequences.append(ids)
        self.least = min(self.least, len(ids))
        last = 0
        for word in ids:
            q = self.step.get(last << 32 | word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, []), last
            while p != -1 and p << 32 | word not in self.step:
                self._go(p, word, new)
                p = self.link[p]
            if p != -1:
                q = self.step[p << 32 | word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
            last = new

    def close(self) -> Automaton:
        n, window = len(self.length), self.window
        seen = [-1] * n
        self.items: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, ids in enumerate(self._sequences):
            state = 0
            for word in ids:
                state = self.step[state << 32 | word]
                up = state
                while up > 0 and seen[up] != item:
                    seen[up] = item
                    if self.length[self.link[up]] < window <= self.length[up]:
                        self.items.setdefault(up, []).append(item)
                    up = self.link[up]
            if len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), item))
        self.window_state, self.short_link = [-1] * n, [-1] * n
        for state in sorted(range(n), key=self.length.__getitem__):
            if state:
                up = self.link[state]
                self.window_state[state] = state if self.length[up] < window <= self.length[state] else self.window_state[up]
                self.short_link[state] = state if state in self.short else self.short_link[up]
        del self._out, self._sequences
        return self

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (first word, last word + 1), merged, and the items found."""
        known = np.fromiter(map(self.vocabulary.get, words, _unknown), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, known >= 0, False]))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.least
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        states: set[int] = set()
        step, length, link, window = self.step, self.length, self.link, self.window
        window_state, short_link = self.window_state, self.short_link
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            state = matched = 0
            for i, word in enumerate(known[start:end].tolist(), start):
                to = step.get(state << 32 | word)
                while to is None:
                    state = link[state]
                    matched = length[state]
                    to = step.get(state << 32 | word)       # every known word leaves the root
                state = to
                matched += 1
                if matched >= window:
                    states.add(window_state[state])
                    _mark(spans, i + 1 - matched, i + 1)
                at = short_link[state]
                while at != -1:
                    for size, item in self.short[at]:
                        if size <= matched:
                            items.add(item)
                            _mark(spans, i + 1 - size, i + 1)
                    at = short_link[link[at]]
        for state in states:
            items.update(self.items[state])
        return spans, items


class _Endless:
    def __iter__(self):
        return self

    def __next__(self):
        return -1


_unknown = _Endless()


def _mark(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Add a span that ends no earlier than the last one; overlaps merge."""
    while spans and spans[-1][1] > start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata over the items, each of about `block_words` words. Longer items
    are split with an overlap that keeps every window whole."""
    automaton, held = Automaton(window), 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = fold((row[1] or "").encode()).split()
        for at in range(0, max(1, len(words) - window + 1) if words else 0, block_words):
            piece = words[at:at + block_words + window - 1]
            if held and held + len(piece) > block_words:
                yield automaton.close()
                automaton, held = Automaton(window), 0
            automaton.add(row[0] or "", piece)
            held += len(piece)
    yield automaton.close()


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


SPANS, ITEMS = "__decontamination_spans", "__decontamination_items"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with the hit word spans (first, end, first, end, ...) and item ids
    in two more columns. Block after block, each adding to the last."""
    spark, names = docs.sparkSession, docs.columns
    out_schema = T.StructType([*like(docs), T.StructField(SPANS, T.ArrayType(T.IntegerType())), T.StructField(ITEMS, T.ArrayType(T.StringType()))])
    text_at = names.index("text")

    def passing(shared, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(window)
            automaton.__dict__.update(shared.value)
            for batch in batches:
                before = [([], [])] * batch.num_rows if first else zip(batch.column(SPANS).to_pylist(), batch.column(ITEMS).to_pylist())
                spans_out, items_out = [], []
                for raw, (old, old_items) in zip(raw_texts(batch.column(text_at)), before):
                    spans, items = automaton.match(fold(raw).split())
                    if old:
                        spans = _merged([*spans, *zip(old[::2], old[1::2])])
                    spans_out.append([x for span in spans for x in span])
                    items_out.append(sorted({automaton.names[i] for i in items}.union(old_items)) if items or old_items else [])
                columns = batch.columns[:len(names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans_out, pa.list_(pa.int32())), pa.array(items_out, pa.list_(pa.string()))], names=[*names, SPANS, ITEMS])
        return run

    df, first = docs, True
    blocks = _blocks(benchmark, window, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(vars(block))
        df = mapped(df, passing(shared, first), out_schema)
        if following is not None:                       # one block at a time in the tasks
            df = cut(df, "decontamination")
            shared.destroy()
        block, first = following, False
    return df


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: words, hit words, items found and their digest."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, spans, items in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                hit = sum(spans[1::2]) - sum(spans[::2])
                rows.append((doc_id, len(fold(raw).split()), hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    found = matches(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, block_words)
    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_spans(raw: bytes, spans: list[int]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    words = [m.span() for m in _WORD.finditer(fold(raw))]
    out, at = [], 0
    for first, end in zip(spans[::2], spans[1::2]):
        out.append(raw[at:words[first][0]])
        at = words[end - 1][1]
    return b"".join([*out, raw[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` without matches of `window` words or more.

    Hit spans are cut out of the text, again until none is left, as a cut can
    bring words together. A document with a larger share of hit words than
    `coverage`, or nothing left, is dropped. A column `n_chars` follows the text.
    Other rows and columns stay as they are.
    """
    schema, names = like(docs), docs.columns
    text_at = names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(SPANS).to_pylist()
            columns = batch.columns[:len(names)]
            if any(hits):
                texts, keep, sizes = batch.column(text_at).to_pylist(), [], {}
                for i, spans in enumerate(hits):
                    keep.append(True)
                    if spans:
                        raw = texts[i].encode()
                        words = len(fold(raw).split())
                        left = without_spans(raw, spans)
                        keep[-1] = sum(spans[1::2]) - sum(spans[::2]) <= coverage * words and bool(fold(left).split())
                        texts[i], sizes[i] = left.decode(), len(left.decode())
                columns[text_at] = pa.array(texts, pa.string())
                if chars_at is not None and pa.types.is_integer(columns[chars_at].type):
                    old = columns[chars_at].to_pylist()
                    columns[chars_at] = pa.array([sizes.get(i, v) for i, v in enumerate(old)], columns[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    benchmark = benchmark.select("item_id", "text")
    found = cut(matches(docs, benchmark, window, block_words), "matches")
    done = []
    while True:                                         # few rounds: only rows with hits go on
        done.append(found.filter(F.size(SPANS) == 0).select(*names))
        hit = found.filter(F.size(SPANS) > 0)
        if hit.isEmpty():
            return reduce(DataFrame.union, done)
        found = cut(matches(hit.mapInArrow(clean, schema), benchmark, window, block_words), "matches")
