"""Spelling variants, languages and centroids."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest

from plumbline.llm import centroids, language, variants
from tests.llm import fixtures as fx


# --- spelling variants ---------------------------------------------------------------

def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(counts, ratio=10):
    """All pairs of words."""
    out, form = [], {}
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best is not None and counts[best] >= ratio * n else None
        out.append((word, n, len(others)))

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return sorted((w, form[w], root(w), n, k, counts.get(form[w])) for w, n, k in out)


def brute_counts(rows, spoiled, least=7, count=2):
    found = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if spoiled and h % spoiled == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def sorted_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def crowded_words(seed, letters="abß", sizes=(1, 2, 3, 4, 5, 6)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(300)} | {"aaaa", "aaaaa", "aaaaaa", "aaa"}
    return {w: rng.choice([1, 2, 3, 10, 25, 300, 3000]) for w in words}


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 8), (3, 31)])
def test_near_words_are_those_of_all_pairs(spark, seed, parts):
    """Dense words: long runs of a letter, ties, chains of forms; nodes that reach over many ranges."""
    counts = crowded_words(seed)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = sorted_rows(variants.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert found == brute_variants(counts)
    assert sum(r[1] is not None and r[1] != r[2] for r in found) > 5          # chains


def test_every_node_has_one_number(spark):
    words = spark.createDataFrame([(w, 1) for w in crowded_words(5)], "word string, n long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = variants.numbered(words, "word", ["n"], "test")
        same = variants.borders(rows)
        number = {}
        for r in rows.collect():
            for i, node in enumerate(r.nodes):
                assert number.setdefault(r.spelled[:i], same.get(node, node)) == same.get(node, node)
        assert len(set(number.values())) == len(number)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_variants_of_texts(spark):
    words = ["ordinary", "ordinarz", "ordinry", "Überfluß", "overflow", "overfloww", "couleur×s", "short", "ñandúes", "straßen"]
    rng = random.Random(3)
    more = [" ".join(rng.choice(words[:1] * 30 + words) for _ in range(200)) + "." for _ in range(4)]
    docs = fx.documents(spark, more=[*more, "x" * 30_000, "x" * 29_999 + " " + "x" * 30_000, "x" * 29_999])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for spoiled in (None, 3):
        assert sorted_rows(variants.variants(docs, spoiled)) == brute_variants(brute_counts(rows, spoiled))
    assert variants.variants(fx.empty(spark)).count() == 0
    assert variants.variants(spark.createDataFrame([(1, "no word is long")], "doc_id long, text string")).count() == 0


def test_tasks_hand_on_full_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 5)
    docs = fx.documents(spark, more=["abcdefgh ABCDEFGH bcdefghi cdefghij defghijk efghijkl fghijklm ghijklmn"] * 2)
    found = {r.word: r.n for r in variants.word_counts(docs).collect()}
    assert found == brute_counts([(r.doc_id, r.text) for r in docs.collect()], None)


# --- languages -----------------------------------------------------------------------

SYLLABLES = {"aa": "ba ke mi to lu ran sil".split(), "bb": "chu zha wei qin dao xu".split(), "cc": "ström blå köt väg sjö".split()}


def sentences(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ",", "!!"]) for _ in range(n))


def speeches(spark, more=()):
    rows = [(i, sentences(lang, 40 + i % 90, i), lang if i % 5 else None, i, "own") for i, lang in enumerate(list(SYLLABLES) * 60)]
    return spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string, score long, held_out string").repartition(4)


def test_held_out_languages_are_told(spark):
    odd = [(1000, None, "aa", 0, ""), (1001, "", "aa", 0, ""), (1002, " 12 ½ Ⅷ _ !", "bb", 0, ""), (None, sentences("bb", 50, 1), None, 0, ""),
           (1003, sentences("cc", 30_000, 2), None, 0, ""), (1003, sentences("cc", 30_000, 2), None, 0, ""), (1004, "東", "dd", 0, "")]
    docs = speeches(spark, odd)
    found = language.identified(docs).collect()
    assert len(found) == docs.count()
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
        assert 0 <= r.score <= 1 and r.accepted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {i: lang for i, lang in enumerate(list(SYLLABLES) * 60)}
    assert all(by[i][0].lang_pred == lang and by[i][0].accepted for i, lang in truth.items())
    assert all((by[i][0].lang_pred, by[i][0].score, by[i][0].accepted) == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert by[None][0].lang_pred == "bb" and [r.lang_pred for r in by[1003]] == ["cc", "cc"]


def test_predictions_do_not_read_the_label(spark):
    docs = speeches(spark)
    learned = language.dictionaries(docs.select("text", "lang"))
    wrong = docs.selectExpr("doc_id", "false as held_out", "text")
    assert sorted(map(tuple, language.predicted(wrong, learned).collect())) == sorted(
        map(tuple, language.predicted(docs.selectExpr("doc_id", "false as held_out", "text"), learned).collect()))
    encoders = language.Encoders(learned)
    sizes = encoders.sizes(language.Folder().fold(sentences("bb", 60, 99)))
    assert min(zip(sizes, encoders.names))[1] == "bb"
    name, margin = encoders.predict(b"x")
    assert name == encoders.names[0] and margin == 0                    # all alike: a tie is rejected


def test_long_texts_count_to_their_end():
    """A text whose first part is another language than its long rest."""
    learned = [(lang, language.Folder().fold(sentences(lang, 3000, 7))) for lang in SYLLABLES]
    text = sentences("aa", 200, 1) + " " + sentences("bb", 20_000, 2)
    assert language.Encoders(learned).predict(language.Folder().fold(text))[0] == "bb"


def test_dictionaries_are_bounded(spark):
    rows = [(sentences("aa", 300, i), "aa") for i in range(60)] + [(sentences("bb", 300, i), "bb") for i in range(30)] + [("x1", "cc"), (None, "dd"), ("12", "ee"), ("z", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    made = language.dictionaries(docs, languages=2, slices=8, slice_chars=100)
    assert [n for n, _ in made] == ["aa", "bb"] and all(0 < len(d) <= 8 * 101 for _, d in made)
    assert [n for n, _ in language.dictionaries(docs)] == ["aa", "bb", "cc"]


def test_one_language_or_none(spark):
    only = speeches(spark).filter("lang = 'aa'")
    rows = language.identified(only).collect()
    assert {r.lang_pred for r in rows} == {"aa"} and all(0 <= r.score <= 1 for r in rows)
    none = language.identified(speeches(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.identified(fx.empty(spark)).count() == 0


# --- centroids -----------------------------------------------------------------------

def brute_clusters(rows, k=8, rounds=10, width=64):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for c in range(len(at)):
            members = [v for (_, v), (_, i) in zip(kept, own) if i == c]
            if members:
                at[c] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    inertia = collections.Counter()
    for d, c in own:
        inertia[c] += d
    return sorted(((vec_id, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, at[c])))) for (vec_id, _), (d, c) in zip(kept, own)), key=str)


VECTORS = "vec_id long, embedding array<float>, cluster string, inertia long, v int"


def test_clusters_are_those_of_all_distances(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=64) * 0.2 + (i % 3)]) for i in range(150)]
    rows += [(i, [0.25] * 64) for i in range(150, 170)] + [(3, [0.25] * 64), (3, [0.25] * 64), (None, [1.0] * 64)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [1.0] * 63 + [float("nan")]), (206, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(5)
    found = sorted((tuple(r) for r in centroids.clustered(df).collect()), key=str)
    assert found == brute_clusters(rows)
    few = df.filter("vec_id < 5")
    assert sorted((tuple(r) for r in centroids.clustered(few).collect()), key=str) == brute_clusters([r for r in rows if r[0] is not None and r[0] < 5])
    assert centroids.clustered(df.limit(0)).collect() == [] and centroids.clustered(df.filter("vec_id >= 200")).columns == centroids.clustered(few).columns


def test_empty_clusters_keep_their_centroids(spark):
    rows = [(i, [0.0] * 64) for i in range(9)] + [(9, [1.0] * 64)]
    found = sorted((tuple(r) for r in centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert found == brute_clusters(rows)


def test_walks_find_the_nearest_and_stop_early():
    rng = np.random.default_rng(4)
    for k, width, spread in ((1, 3, 5), (7, 1, 3), (40, 5, 3), (200, 2, 1000), (64, 8, 40)):
        at, x = rng.integers(-spread, spread + 1, (k, width)), rng.integers(-spread, spread + 1, (500, width))
        walk = centroids.Walk(at)
        number, distance = walk.nearest(x)
        all_ = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (distance == all_.min(1)).all() and (number == all_.argmin(1)).all()           # argmin: the smallest number of a tie
    assert centroids.Walk(rng.integers(0, 9, (4, 2))).nearest(np.zeros((0, 2), dtype=np.int64))[0].size == 0
    far = np.concatenate([np.zeros((1, 2), dtype=np.int64), rng.integers(10_000, 20_000, (300, 2))])
    walk = centroids.Walk(far)
    walk.nearest(np.ones((10, 2), dtype=np.int64))
    assert walk.steps < 10 * 2 * 5                                                             # not all 300


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="exceeds"):
        centroids.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("name", ["op11_variants", "op13_centroids"])
def test_queries_match_their_sql(spark, name):
    from plumbline.llm.queries import ORACLES, QUERIES
    from tests.oracle import compare, connection
    folder = "/root/testdata/sf0.001"
    assert compare(spark, name, QUERIES[name], ORACLES[name], connection(folder), folder)[0] == "ok"


def test_language_query_is_right_on_held_out_documents(spark):
    """Accuracy over the given table; shorter texts are often no more than names."""
    from plumbline.llm.queries import op12_language
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "lang", "length(text) as size")
    rows = op12_language(spark, folder).filter("held_out").join(truth, "doc_id").collect()
    right = [r.lang_pred == r.lang for r in rows if r.size >= 100]
    assert len(right) > 150 and np.mean(right) > 0.98
    wrong = [r.score for r in rows if r.lang_pred != r.lang]
    assert np.mean([r.score for r in rows]) > np.mean(wrong or [0])
