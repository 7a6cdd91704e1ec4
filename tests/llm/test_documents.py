"""Quality rules, packing, decontamination, scoring and sharding against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import decontamination, packing, quality, scoring, sharding
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_quality_counts(spark, docs):
    found = quality.rules(docs, fx.labels(spark)).collect()
    want = []
    for doc_id, text in texts_of(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:7] for r in found), key=key) == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in found)


def test_quality_rows_pass_unchanged(spark, docs):
    kept = quality.keep_good(docs, fx.labels(spark))
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    assert quality.keep_good(fx.empty(spark), fx.labels(spark)).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality.rules(docs, no_labels).collect())


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(30):
        chain = quality.Chain(transition=rng.normal(size=(2, 2)))
        scores = rng.normal(size=(6, 2))
        value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) + sum(chain.transition[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert tuple(chain.viterbi(scores.tolist())) == best


def test_chain_learns_junk_and_keeps_clean_text():
    good = [(quality.line_features((fx.prose(200, s) + ".\n" + fx.prose(60, s + 50) + ".").encode())[0], 0) for s in range(40)]
    bad = [(quality.line_features((f"A{s} | b | c* | d\n" * 8).encode())[0], 1) for s in range(40)]
    chain = quality.fit_chain(good[::2] + bad[::2])
    held = chain.content_shares([(rows, [1] * len(rows)) for rows, _ in good[1::2] + bad[1::2]])
    assert all(s > 0.9 for s in held[:20]) and all(s < 0.1 for s in held[20:])


def test_pieces_hold_the_tokenizers_ids(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in texts_of(docs):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 4096):
            part = ids[at:at + 4096]
            want.append((doc_id, at // 4096, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    packed = packing.pack_documents(docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:5] for r in packed), key=key) == sorted(want, key=key)
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(sequences) == -(-sum(r.length for r in packed) // 4096)
    assert packing.pack_documents(fx.empty(spark)).count() == 0
    with_ids = packing.pack_documents(docs.filter("doc_id = 9"), with_ids=True).first()
    assert len(with_ids.ids) == with_ids.length


def fewest_bins(sizes, capacity):
    """By trying everything."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1:])
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(5)
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(sizes, minlength=21)
        patterns = packing.plan_bins(counts, 20)
        used = collections.Counter(x for p, n in patterns for x in p for _ in range(n))
        assert used == collections.Counter(sizes) and all(sum(p) <= 20 for p, _ in patterns)
        assert packing.least_bins(counts, 20) <= fewest_bins(sizes, 20) == sum(n for _, n in patterns)


def test_bin_completion_meets_the_bound_on_many_pieces():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, (rng.lognormal(6, 1, 200_000)).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    patterns = packing.plan_bins(counts)
    assert sum(n for _, n in patterns) == packing.least_bins(counts, 4096)


@pytest.mark.parametrize("sizes", [[1] * 10_000, [4] * 3000 + [5] * 3000 + [6] * 3000, [3] * 5000 + [2000] * 10])
def test_thousands_of_tiny_pieces_share_sequences(sizes):
    counts = np.bincount(sizes, minlength=4097)
    patterns = packing.plan_bins(counts, nodes=200)
    used = collections.Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 4096
        used.update({x: k * n for x, k in collections.Counter(pattern).items()})
    assert used == collections.Counter(sizes) and sum(n for _, n in patterns) == packing.least_bins(counts, 4096)


def test_fillings_are_those_of_all_subsets():
    """Every undominated filling of small rooms is found, by the definition of dominance."""
    rng = random.Random(2)
    for _ in range(60):
        left = np.bincount([rng.randint(1, 9) for _ in range(rng.randint(1, 7))], minlength=21)
        room = rng.randint(1, 20)
        sizes = [x for x in range(21) for _ in range(left[x])]
        subsets = {tuple(sorted((s for i, s in enumerate(sizes) if mask >> i & 1), reverse=True)) for mask in range(1 << len(sizes))}
        best = max(sum(s) for s in subsets if sum(s) <= room)
        found = packing.fillings(left.copy(), room, 1000)
        assert all(sum(f) + waste == room and tuple(f) in subsets for waste, f in found)
        assert found[0][0] == room - best and len({tuple(f) for _, f in found}) == len(found)


def brute_matches(text, items, window=10):
    words = decontamination.fold(text.encode()).split()
    windows = collections.defaultdict(set)
    for item_id, item in items:
        w = decontamination.fold((item or "").encode()).split()
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i:i + k])].add("" if item_id is None else str(item_id))
    hit, found = set(), set()
    for k in {len(x) for x in windows}:
        for i in range(len(words) - k + 1):
            if tuple(words[i:i + k]) in windows:
                found |= windows[tuple(words[i:i + k])]
                hit.update(range(i, i + k))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_matches_are_those_of_all_windows(spark, block_words):
    docs = fx.documents(spark, more=["say short item here twice: Short, item; here", fx.PASSAGE.replace("zeta", "other"), f"{fx.PASSAGE} {fx.PASSAGE}"])
    items = [tuple(r) for r in fx.benchmark(spark).collect()]
    found = decontamination.report(docs, fx.benchmark(spark), block_words=block_words).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(((i, *brute_matches(t, items)) for i, t in texts_of(docs)), key=key)


def test_random_matches():
    rng = random.Random(9)
    for _ in range(200):
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(4)]
        automaton = decontamination.Automaton(4)
        for item_id, text in items:
            if text:
                automaton.add(str(item_id), text.encode().split())
        automaton.close()
        text = " ".join(rng.choice("abcd") for _ in range(30))
        spans, found = automaton.match(text.encode().split())
        _, n_hit, n_items, *_ = brute_matches(text, items, 4)
        assert sum(e - s for s, e in spans) == n_hit and len(found) == n_items


def test_decontaminated_texts_have_no_match_left(spark):
    first, second = fx.PASSAGE.split()[:6], fx.PASSAGE.split()[6:]
    nested = " ".join([fx.prose(40, 11), *first, fx.PASSAGE, *second, fx.prose(40, 12)])         # a cut makes a new match
    docs = fx.documents(spark, more=[nested])
    items = [tuple(r) for r in fx.benchmark(spark).collect()]
    left = decontamination.decontaminate(docs, fx.benchmark(spark))
    assert left.columns == docs.columns
    rows = left.collect()
    assert not any(brute_matches(r.text or "", items)[4] for r in rows)
    before = {tuple(r) for r in docs.collect()}
    ids = [r.doc_id for r in rows]
    assert 14 not in ids and 13 in ids and all(tuple(r) in before for r in rows if r.doc_id not in (13, 18))
    assert all(r.n_chars == len(r.text) for r in rows if r.doc_id in (13, 18))
    assert decontamination.decontaminate(fx.empty(spark), fx.benchmark(spark)).count() == 0
    assert decontamination.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


def brute_scores(rows, depth):
    """Context-tree weighting by its definition, one counter after the other."""
    counters = [collections.defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    def steps(text):
        padded = b"\xff" * depth + text + b"\xff"
        for at in range(depth, len(padded)):
            for k in range(8):
                byte = padded[at]
                yield padded[at - depth:at], (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1

    for doc_id, text in rows:
        if not held(doc_id):
            for context, node, bit in steps(text):
                for d in range(depth + 1):
                    counters[d][context[depth - d:], node][bit] += 1
    coded = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)
    weighted = [{} for _ in range(depth + 1)]
    for d in range(depth, -1, -1):
        below = collections.Counter()
        if d < depth:
            for (context, node), value in weighted[d + 1].items():
                below[context[1:], node] += value
        for key, (a, b) in counters[d].items():
            weighted[d][key] = coded(a, b) if d == depth else np.logaddexp(coded(a, b), below[key]) - math.log(2)
    out = []
    for _, text in rows:
        total = 0.0
        for context, node, bit in steps(text):
            p, rest = 0.0, 1.0
            for d in range(depth + 1):
                key = context[depth - d:], node
                n = counters[d].get(key, (0, 0))
                share = 1.0 if d == depth else math.exp(coded(*n) - math.log(2) - weighted[d][key]) if key in weighted[d] else 0.5
                p, rest = p + rest * share * (n[bit] + .5) / (sum(n) + 1), rest * (1 - share)
            total += math.log10(p)
        out.append(total)
    return out, held


def test_scores_are_those_of_the_definition(spark, docs):
    small = docs.filter("text is null or length(text) < 5000")
    rows = [(i, t.encode().lower()) for i, t in texts_of(small)]
    want, held = brute_scores(rows, 2)
    counts = collections.Counter(w for i, t in rows if not held(i) for w in [*t.split(), b""])
    total, kinds = sum(counts.values()), len(counts)
    found = scoring.scored(small, depth=2, chunk_bytes=4000).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 4), round(r[6], 4))
    expected = []
    for (i, t), score in zip(rows, want):
        tokens = [*t.split(), b""]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)
        expected.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, score))
    for got, wanted in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert tuple(got)[:5] == wanted[:5] and got.base_score == pytest.approx(wanted[5]) and got.score == pytest.approx(wanted[6])
    assert scoring.scored(fx.empty(spark)).count() == 0


def test_scores_are_looked_up_by_sorted_strings(spark, monkeypatch):
    """Each different string of some texts is searched once, in order; long texts come in parts."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 101, size=n).astype(np.uint8)) for n in (0, 4000, 1, 700, 0, 2500)]
    parts = [scoring.strings(raw, 5) for raw in texts]
    keys = np.unique(np.concatenate([*parts, scoring.strings(b"others", 5)]))
    logs = rng.normal(size=len(keys))
    search, asked = np.searchsorted, []
    monkeypatch.setattr(scoring.np, "searchsorted", lambda known, wanted: asked.append(wanted) or search(known, wanted))
    sums = scoring.string_sums(list(enumerate(parts)), 15, keys, logs)
    monkeypatch.undo()
    assert sums == pytest.approx([logs[search(keys, p)].sum() for p in parts])
    assert (np.diff(asked[0]) > 0).all() and len(asked[0]) < sum(map(len, parts)) / 2
    rows = spark.createDataFrame([(i, raw.decode()) for i, raw in enumerate(texts)], "doc_id long, text string")
    want = {r.doc_id: r.score for r in scoring.scored(rows, depth=2).collect()}
    monkeypatch.setattr(scoring, "TOGETHER", 300)
    assert {r.doc_id: r.score for r in scoring.scored(rows, depth=2).collect()} == pytest.approx(want)


def test_scoring_moves_byte_strings_packed(spark):
    keys = np.unique(np.concatenate([scoring.strings(t.encode(), 5) for t in ("some words of a text", "", "é")]))
    counts = np.array([0, 255, 256, 1 << 40])
    assert (scoring.unpacked_keys(scoring.packed_keys(keys, 5), 5) == keys).all()
    assert (scoring.unpacked_counts(scoring.packed_counts(counts), 4) == counts).all()
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tally = scoring.tallies(scoring.chunked(texts, 1 << 20), 5).filter("word is null")
    chunks, rows, grams = tally.selectExpr("count(distinct chunk)", "count(*)", "sum(length(grams)) / 6").first()
    # a row for each bucket of a chunk, not one for each of its byte strings
    assert chunks > 1 and rows <= chunks << scoring.BUCKET_BITS and grams > 20 * rows


def test_held_out_texts_are_coded_better_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000")
    score, base = scoring.scored(docs).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert score > base


def test_sharding_is_even_and_gapless(spark, docs):
    more = [fx.prose(40 + i % 30, 100 + i) for i in range(600)]
    rows = [(i, t) for i, t in enumerate(more)] + [(i, "the same text " * 20) for i in range(600, 1200)] + [(None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sharding.sharded(df, 8).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) == set(range(8))
    bytes_, counts = ([f(rs) for rs in by.values()] for f in (lambda rs: sum(r.size for r in rs), len))
    assert max(bytes_) < 1.03 * min(bytes_) and max(counts) < 1.15 * min(counts)
    homes = collections.defaultdict(set)
    for r in found:
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) == 1                 # only the large group is split
    assert sharding.sharded(fx.empty(spark)).count() == 0
    assert sharding.sharded(docs).count() == docs.count()


def brute_placement(sizes, shards):
    """The rule of the dot product, one item after the other."""
    total = [max(sum(s[m] for s in sizes), 1) for m in range(3)]
    share = [[s[m] / total[m] * shards for m in range(3)] for s in sizes]
    room = [[1.0] * 3 for _ in range(shards)]
    where = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-max(share[i]), i)):
        fitting = [j for j in range(shards) if all(r >= x for r, x in zip(room[j], share[i]))] or list(range(shards))
        where[i] = max(fitting, key=lambda j: (sum(r * x for r, x in zip(room[j], share[i])), -j))
        room[where[i]] = [r - x for r, x in zip(room[where[i]], share[i])]
    return where


def test_items_go_where_the_dot_product_is_highest():
    rng = np.random.default_rng(3)
    for shards in (1, 3, 8):
        sizes = rng.integers(1, 1000, (60, 3))
        assert sharding.placed(sizes, shards).tolist() == brute_placement(sizes.tolist(), shards)


def test_equal_texts_share_a_shard(spark):
    """Groups of all sizes stay whole, unless they are larger than a shard; shards are near equal."""
    rng = random.Random(4)
    texts = [fx.prose(rng.randint(20, 60), 900 + i) for i in range(300)]
    rows = [t for i, t in enumerate(texts) for _ in range(1 + (i % 7 == 0) * rng.randint(1, 12))]
    rows += [texts[0]] * 400                              # about a third of all rows
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)
    found = sharding.sharded(docs).join(docs, "doc_id").collect()
    shards = collections.defaultdict(set)
    for r in found:
        shards[r.text].add(r.shard)
    assert len(found) == len(rows) and all(len(s) == 1 for t, s in shards.items() if t != texts[0]) and len(shards[texts[0]]) > 5
    sizes = collections.Counter()
    for r in found:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 40 and max(sizes.values()) <= 1.35 * sum(sizes.values()) / 40
