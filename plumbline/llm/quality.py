"""Quality rules: a linear-chain conditional random field over the lines.

Each line of a text is a position of the chain, with a few shares of its bytes
as features. Viterbi decoding marks every line as content or boilerplate, and
the share of content bytes decides whether a document stays. Counts that need
no model (symbols, repeated lines and windows) come with the verdict.

The weights are fitted on at most `sample` labelled documents of each class,
chosen by the smallest hash of their ids; the lines of a document carry its
label. Fitting is deterministic. All else runs over whole texts, row by row,
without a shuffle.

Defined results: a null or empty text has no words and fails the base rules;
lines without a word have no say; without labels of both classes every line is
content; repeated rows get equal results; ties in decoding go to content.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import like, mapped, raw_texts
from plumbline.session import ship

ship(__name__)

#: Labelled documents of each class in the fit.
SAMPLE = 1000
#: Least share of content bytes of a document that stays.
CONTENT_SHARE = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50

_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
#: Features of a line, in this order.
FEATURES = ("bias", "symbols", "capitals", "exclamation marks", "digits", "bars", "word equal to the one before", "repeated line", "no end mark", "under three words")


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    pairs = a[:-1] * len(ids) + a[1:]
    if len(ids) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    key = pairs[:-1] * len(ids) + a[2:]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(key, again)
    covered = np.zeros(len(a), dtype=bool)
    for shift in range(3):
        covered[shift:shift + n] |= hit
    return int(covered.sum())


def _share(line: bytes, among: bytes, n: int) -> float:
    return (n - len(line.translate(None, among))) / n


def line_features(raw: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and sizes of the lines that hold a word, and how many of those
    equal an earlier line."""
    rows, sizes, seen = [], [], set()
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n = len(line)
        again = line in seen
        seen.add(line)
        sizes.append(n)
        same = sum(map(eq, words, words[1:])) / len(words)
        rows.append([1.0, min(1.0, 5 * _share(line, _SYMBOLS, n)), _share(line, _CAPITALS, n), min(1.0, 5 * _share(line, b"!", n)), _share(line, _DIGITS, n),
                     min(1.0, 5 * _share(line, b"|", n)), same, float(again), float(words[-1][-1] not in b".!?:\"')"), float(len(words) < 3)])
    return rows, sizes, len(sizes) - len(seen)


class Chain:
    """Weights of the field: `emission` (features x 2), `transition` (2 x 2).
    State 0 is content, 1 boilerplate."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None):
        self.emission = np.zeros((len(FEATURES), 2)) if emission is None else emission
        self.transition = np.zeros((2, 2)) if transition is None else transition

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best states for rows of emission scores."""
        (cc, cb), (bc, bb) = self.transition.tolist()
        back: list[tuple[bool, bool]] = []
        content, boiler = scores[0]
        for c, b in scores[1:]:
            back.append((content + cc < boiler + bc, content + cb < boiler + bb))
            content, boiler = c + max(content + cc, boiler + bc), b + max(content + cb, boiler + bb)
        state = int(boiler > content)
        path = [state]
        for step in reversed(back):
            state = int(step[state])
            path.append(state)
        return path[::-1]

    def content_shares(self, documents: list[tuple[list[list[float]], list[int]]]) -> list[float]:
        """For each document the share of bytes in content lines; 1 if none."""
        flat = [row for rows, _ in documents for row in rows]
        scores = (np.array(flat) @ self.emission).tolist() if flat else []
        shares, at = [], 0
        for rows, sizes in documents:
            if not rows:
                shares.append(1.0)
                continue
            path = self.viterbi(scores[at:at + len(rows)])
            at += len(rows)
            shares.append(sum(n for n, state in zip(sizes, path) if state == 0) / sum(sizes))
        return shares


def fit_chain(documents: list[tuple[list[list[float]], int]], rounds: int = 150, penalty: float = 1e-3) -> Chain:
    """Weights that maximise the likelihood of the labelled lines (gradient by
    forward-backward over all documents at once)."""
    documents = sorted((d for d in documents if d[0]), key=lambda d: -len(d[0]))
    if len({label for _, label in documents}) < 2:
        return Chain()
    lengths = np.array([len(rows) for rows, _ in documents])
    labels = np.array([label for _, label in documents])
    active = [int((lengths > t).sum()) for t in range(lengths[0])]
    steps = [np.array([documents[d][0][t] for d in range(n)]) for t, n in enumerate(active)]
    weight = 1.0 / lengths                                       # every document counts once
    theta = [np.zeros((len(FEATURES), 2)), np.zeros((2, 2))]
    moments = [[np.zeros_like(x) for x in theta] for _ in range(2)]
    for round_ in range(1, rounds + 1):
        emission, transition = theta
        grad = [-penalty * emission, -penalty * transition]
        scores = [x @ emission for x in steps]
        forward = [scores[0]]
        for t in range(1, len(active)):
            old = forward[-1][:active[t], :, None] + transition[None]
            forward.append(np.logaddexp(old[:, 0], old[:, 1]) + scores[t])
        backward = np.zeros((len(documents), 2))
        total = np.empty(len(documents))
        for t in range(len(active) - 1, -1, -1):
            n, ended = active[t], active[t + 1] if t + 1 < len(active) else 0
            total[ended:n] = np.logaddexp(forward[t][ended:n, 0], forward[t][ended:n, 1])
            share = np.exp(forward[t] + backward[:n] - total[:n, None])
            wrong = (np.arange(2)[None] == labels[:n, None]) - share
            grad[0] += steps[t].T @ (wrong * weight[:n, None]) / len(documents)
            if t:
                pair = np.exp(forward[t - 1][:n, :, None] + transition[None] + (scores[t] + backward[:n])[:, None, :] - total[:n, None, None])
                truth = np.zeros_like(pair)
                truth[np.arange(n), labels[:n], labels[:n]] = 1
                grad[1] += ((truth - pair) * weight[:n, None, None]).sum(0) / len(documents)
                onward = transition[None] + (scores[t] + backward[:n])[:, None, :]
                backward[:n] = np.logaddexp(onward[:, :, 0], onward[:, :, 1])
        for x, g, m, v in zip(theta, grad, *moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.2 * (m / (1 - 0.9 ** round_)) / (np.sqrt(v / (1 - 0.99 ** round_)) + 1e-8)
    return Chain(*theta)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The field fitted on a bounded sample of the labelled documents."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.filter("quality = 0").orderBy(*order).limit(sample).union(known.filter("quality = 1").orderBy(*order).limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")        # at most 2 x sample ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[x for line in line_features(raw)[0] for x in line] for raw in raw_texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "features"])

    found = mapped(texts.select(F.col("doc_id").cast("long"), F.col("quality").cast("long"), "text"), features, "doc_id long, quality long, features array<double>").collect()
    width = len(FEATURES)
    found = sorted({(r[0], 1 - r[1], tuple(r[2])) for r in found})
    return fit_chain([([list(f[i:i + width]) for i in range(0, len(f), width)], label) for _, label, f in found])


def judge(raws: list[bytes], chain: Chain, content_share: float = CONTENT_SHARE) -> list[tuple[int, int, int, int, int, bool, bool, float]]:
    """For each text: words, characters in words, symbols, repeated lines,
    repeated words, base failure, verdict, content share."""
    lines = [line_features(raw) for raw in raws]
    shares = chain.content_shares([(rows, sizes) for rows, sizes, _ in lines])
    out = []
    for raw, (_, _, repeats), share in zip(raws, lines, shares):
        words = raw.split()
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        chars = len(raw.translate(None, _BLANKS).decode())
        repeated = repeated_words(words)
        failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
        out.append((len(words), chars, symbols, repeats, repeated, failed, not failed and share >= content_share, share))
    return out


def rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Per document the counts, the base rules, the verdict and the share."""
    chain = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(list(raw_texts(batch.column(1))), chain, content_share)
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def line_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per line with a word: its number, size and whether it is content."""
    chain = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                features, sizes, _ = line_features(raw)
                numbers = [i for i, line in enumerate(raw.split(b"\n")) if line.split()]
                if numbers:
                    path = chain.viterbi((np.array(features) @ chain.emission).tolist())
                    rows += [(doc_id, i, n, state == 0) for i, n, state in zip(numbers, sizes, path)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["doc_id", "line", "n_bytes", "content"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, line int, n_bytes int, content boolean")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of `docs` that the rules keep, unchanged."""
    chain, text_at = fit(docs, labels, sample), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([j[6] for j in judge(list(raw_texts(batch.column(text_at))), chain, content_share)], pa.bool_()))

    return mapped(docs, run, like(docs))
