"""Near-duplicates, license scan, chat, pages, URLs and the pipeline."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat, html, licenses, neardup, urls
from tests.llm import fixtures as fx


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    found, true = [], []
    for _ in range(60):
        items = rng.integers(0, 2 ** 63, 150).astype(np.uint64)
        a = rng.integers(1, 12, 150)
        b = np.where(rng.random(150) < 0.5, a, rng.integers(0, 12, 150))
        marks = neardup.signatures([(items, a), (items[b > 0], b[b > 0])], 240)
        found.append((marks[0] == marks[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(found) - np.mean(true)) < 0.015


def test_copies_of_one_shingle_have_filled_signatures():
    marks = neardup.signatures([(np.array([5], dtype=np.uint64), np.array([1])), (np.array([5], dtype=np.uint64), np.array([1000]))], 240)
    assert len(set(marks[0].tolist())) == 240 and (marks[0] == marks[1]).mean() < 0.05


def brute_classes(rows, similarity=0.8):
    """All pairs, then components."""
    bags = {}
    for i, (_, text) in enumerate(rows):
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        bags[i] = collections.Counter(tuple(words[j:j + n]) for j in range(len(words) - n + 1)) if n else collections.Counter()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if not union or sum((bags[i] & bags[j]).values()) >= similarity * union - 1e-9:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None) for i in members]
    return sorted(out, key=str)


def chain_of_texts():
    """Each text links to its neighbours only, so a class needs every link."""
    words = [f"v{i}" for i in range(260)]
    return [" ".join(words[i * 10:i * 10 + 120]) for i in range(12)]


def star_of_texts():
    """Copies that are near their source but not each other, ids in bad order."""
    rng = random.Random(4)
    base = fx.prose(200, 40).split()
    out = []
    for _ in range(25):
        words = list(base)
        for at in rng.sample(range(200), 4):
            words[at] = f"x{rng.random()}"
        out.append(" ".join(words))
    return [*out, " ".join(base)]


def test_classes_are_those_of_all_pairs(spark):
    docs = fx.documents(spark, more=[*chain_of_texts(), *star_of_texts(), "one two three four five six", "one two three four five six", "a b c d", "A b  c D"])
    found = sorted(map(tuple, neardup.classes(docs).collect()), key=str)
    assert found == brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert neardup.classes(fx.empty(spark)).count() == 0


def test_rows_without_an_id_link_like_others(spark):
    chain, near = chain_of_texts(), fx.prose(200, 41)
    rows = [(None if i == 5 else i, t) for i, t in enumerate(chain)]                       # the null id is a bridge
    rows += [(None, near), (30, near + " more"), (None, fx.prose(200, 42)), (None, fx.prose(200, 42) + " more"), (None, fx.prose(90, 43))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, neardup.classes(docs).collect()), key=str)
    assert found == brute_classes(rows)
    assert found.count((None, 0)) == 1 and (None, 30) in found


def test_one_row_of_each_class_stays(spark):
    docs = fx.documents(spark)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    want = {c for _, c in brute_classes([(i, r.text) for i, r in enumerate(rows)])}
    assert kept.count() == len(want)
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in rows}


def test_license_lines_are_found(spark):
    notice = licenses.TEMPLATES[3][2]
    changed = notice.replace("hereby granted", "granted").replace("any person", "any one person").replace("sublicense", "sub license")
    docs = fx.documents(spark, more=[f"before\n{changed} after it", f"{licenses.TEMPLATES[2][2]} words between {licenses.TEMPLATES[2][2]}", "the Apache License is only named here"])
    found = licenses.scan(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted((r.doc_id, r.template) for r in found) == [(17, "apache-2.0-line"), (18, "mit-grant"), (19, "mit-line"), (19, "mit-line")]
    by = {r.doc_id: r for r in found}
    assert by[17].coverage == 1.0 and texts[17][by[17].start_char:by[17].end_char] == "Licensed under the Apache License, Version 2.0"
    assert 0.9 < by[18].coverage < 1.0
    assert licenses.scan(fx.empty(spark)).count() == 0


def edit_free_coverage(index, words, template):
    """Most template words in one local alignment, without a band."""
    wanted = index.words[template]
    text = [index.vocabulary.get(w, -1) for w in words]
    best = (0, 0)
    above = [(0, 0)] * (len(text) + 1)
    for word in wanted:
        row = [(0, 0)]
        for d, other in enumerate(text):
            score, matched = above[d]
            cell = max((score + 1, matched + 1) if word == other else (score - 1, matched), (above[d + 1][0] - 1, above[d + 1][1]), (row[-1][0] - 1, row[-1][1]), (0, 0), key=lambda c: c[0])
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1], key=lambda c: c[0])
        above = row
    return best[1] / len(wanted)


def test_the_index_finds_what_full_alignment_finds():
    index, rng = licenses.Index(), random.Random(6)
    hits = found = 0
    for _ in range(60):
        template = rng.randrange(len(index.words))
        words = licenses.fold(index.templates[template][2].encode()).split()
        for _ in range(len(words) // 12):
            words[rng.randrange(len(words))] = b"edited"
        words = licenses.fold(fx.prose(30, rng.random()).encode()).split() + words + [b"end"] * 5
        if edit_free_coverage(index, words, template) >= licenses.COVERAGE:
            hits += 1
            found += any(m[0] == template for m in index.matches(words))
    assert hits > 40 and found >= 0.9 * hits


def test_edited_notices_are_found_as_by_full_alignment():
    index, rng = licenses.Index(), random.Random(9)
    hits = 0
    for template, (name, _, text) in enumerate(index.templates):
        for _ in range(6):
            words = licenses.fold(text.encode()).split()
            for _ in range(max(1, len(words) // 6)):
                at, edit = rng.randrange(len(words)), rng.randrange(3)
                words[at:at + (edit != 1)] = [b"edited"] * (edit < 2)
            if edit == 1 and len(words) > 30:
                words[len(words) // 2:len(words) // 2] = [b"inserted"] * 12
            words = [b"before"] * 4 + words + [b"after"] * 4
            share = 1.0 if name.startswith("spdx-") else licenses.COVERAGE
            if edit_free_coverage(index, words, template) >= share:
                hits += 1
                assert any(t == template and index.aligned(words, t, low, high, share * len(index.words[t]) - 1e-9) for t, low, high in index.candidates(words)), (name, words)
    assert hits > 100


def test_short_and_further_notices_are_found():
    index = licenses.Index()
    licenses_of = lambda text: sorted({index.templates[m[0]][1] for m in index.matches(licenses.fold(text.encode()).split())})
    assert licenses_of("x Released under MIT License. y") == ["MIT"]
    assert licenses_of("Copyright 2020 Someone. All rights reserved.") == ["all-rights-reserved"]
    assert licenses_of("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert licenses_of("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert licenses_of("This work is licensed under the GNU Affero General Public License, version 3.") == ["AGPL-3.0"]
    assert licenses_of("Licensed under CC BY-NC-SA 3.0.") == ["CC-BY-NC-SA-3.0"] and licenses_of("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert licenses_of("# SPDX-License-Identifier: MIT") == ["MIT"] and licenses_of("SPDX-License-Identifier: MPL-2.0") == ["MPL-2.0"]
    assert licenses_of("SPDX-License-Identifier: Foo-2.0") == []


PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "[BOT]", "<<SYS>>", "<</SYS>>", "[ROLE=x]", "[ROLE=", "]", "[/ROLE]", "\\", "\\\\", " ", "\n", "text", "é", "[", "<"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "odd ]role\n"]), st.lists(st.sampled_from(PARTS)).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns


def test_runs_of_backslashes_take_linear_time():
    import time
    turns = [("user", "\\" * 200_000), ("assistant", "\\" * 100_000 + "[INST]" + "\\" * 50_000)]
    begin = time.perf_counter()
    assert chat.parse("".join(chat.render(r, t) for r, t in turns)) == turns
    assert time.perf_counter() - begin < 5


def test_chat_digests(spark):
    import hashlib
    rows = [(1, 1, "assistant", "b </s> c", 0), (1, 0, "user", None, 0), (2, 0, None, "x\\[INST]", 0), (2, 0, None, "x\\[INST]", 0), (None, 5, "assistant", "z", 0), (3, None, "assistant", "", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int").repartition(4)
    found = {r.conv_id: r for r in chat.digests(turns).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in found.items()} == {
        1: (2, sha("user\n\nassistant\nb </s> c\n"), 8, sha("b </s> c")), 2: (2, sha("\nx\\[INST]\n" * 2), 0, sha("")),
        None: (1, sha("assistant\nz\n"), 1, sha("z")), 3: (1, sha("assistant\n\n"), 0, sha(""))}
    pieces = collections.defaultdict(str)
    spans = {}
    for r in sorted(chat.pieces(turns).collect(), key=lambda r: (str(r.conv_id), r.start)):
        assert r.start == len(pieces[r.conv_id])
        pieces[r.conv_id] += r.rendered
        spans[r.conv_id] = (r.loss_start, r.loss_end)
    assert all(len(pieces[k]) == r.formatted_chars for k, r in found.items())
    assert pieces[1][slice(*spans[1])] == "b \\</s> c"
    assert chat.digests(fx.empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice"><p>cookies</p></div><article><header><h1>Title %d</h1></header><p>A  b&nbsp;&amp; <b>c</b>d<br>e<p>second<script>if (a < b) "</p>"</script>
<ul><li>one<li>two</ul><aside>beside</aside><div class="ad">buy</div><section id="comments"><p>reader</p></section></article><footer>foot</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_main_text(spark):
    rows = [(1, "http://a/x", PAGE % 1), (2, None, None), (3, "nothing", "plain text"), (4, "http://b", "<p>cut off &am"), (5, "http://b", ""), (1, "http://a/x", PAGE % 1), (None, "http://c", "<main><p>m</main>out")]
    found = sorted((str(r.page_id), r.text, r.n_chars) for r in html.main_texts(pages(spark, rows)).collect())
    body = "Title 1\n\nA b & cd e\n\nsecond\n\none\n\ntwo"
    assert found == sorted([("1", body, len(body)), ("1", body, len(body)), ("2", "", 0), ("3", "plain text", 10), ("4", "cut off &am", 11), ("5", "", 0), ("None", "m", 1)])
    assert html.main_texts(pages(spark, [])).count() == 0


def test_recurring_subtrees_go_and_copied_pages_stay(spark):
    block = "<div class='x1'><p>share this page</p></div>"
    rows = [(i, "http://site/p", f"<div><p>text {i}</p></div>{block}") for i in range(12)]
    rows += [(100 + i, "http://other/p", f"<div><p>text {i}</p></div>{block}") for i in range(2)]
    rows += [(200 + i, "http://copies/p", f"<div><p>one text</p></div>{block}") for i in range(20)]
    found = {r.page_id: r.text for r in html.main_texts(pages(spark, rows)).collect()}
    assert all(found[i] == f"text {i}" for i in range(12))
    assert found[100] == "text 0\n\nshare this page" and found[200] == "one text\n\nshare this page"


def test_url_rules(spark):
    cases = {"http://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"), "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
             "http://x.com/de": ("x.com", "/de", "com/", "allow"), "http://x.com": ("x.com", "", None, None), "http://xcom/": ("xcom", "/", None, None),
             "http://a.net/fr/x": ("a.net", "/fr/x", "net/fr/", "block"), None: ("", "", None, None), "no scheme": ("", "", None, None), "a://b://c/d?e": ("b:", "//c/d", None, None)}
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "y")], "page_id long, url string, verdict string")
    rows = urls.judged(df).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        host, path, rule, verdict = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judged(df.limit(0)).count() == 0


def test_url_models_separate_held_out_urls():
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good, bad = ([f"{word(s)}.org/{word(s)}" for _ in range(500)] for s in ("aeioubcd", "xyzw0123"))
    ratio = urls.fit(good[:400], bad[:400])
    assert sum(ratio.score(u) >= ratio.threshold for u in good[400:]) >= 98 and sum(ratio.score(u) < ratio.threshold for u in bad[400:]) >= 98
    model = urls.Markov(2)
    model.learn("abcab")
    seen = {c for x in model.counts.values() for c in x}
    unseen = (0x110000 - len(seen)) * model.probability("ab", "\u2028")
    assert sum(model.probability("ab", c) for c in seen) + unseen == pytest.approx(1.0)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    folder = str(tmp_path)
    clean = [fx.prose(100, 200 + i) for i in range(8)]
    docs = fx.documents(spark, more=clean)
    docs.write.parquet(f"{folder}/documents.parquet")
    fx.labels(spark).write.parquet(f"{folder}/labels.parquet")
    fx.benchmark(spark).write.parquet(f"{folder}/benchmark.parquet")
    stage, columns = spark.read.parquet(f"{folder}/documents.parquet"), docs.columns
    for name, run in corpus_pipeline.STAGES[:-1]:
        run(spark, stage, folder).write.parquet(f"{folder}/{name}")
        stage = spark.read.parquet(f"{folder}/{name}")
        assert stage.columns == columns
    left = [r.doc_id for r in stage.collect()]
    assert set(range(18, 26)) <= set(left) and len(set(left) & {5, 6, 7, 8}) == 1
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(left)


def test_queries_are_registered_whole():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_chat_query_matches_its_sql(spark):
    from plumbline.llm.queries import ORACLES, QUERIES
    from tests.oracle import compare, connection
    folder = "/root/testdata/sf0.001"
    assert compare(spark, "op2_chat", QUERIES["op2_chat"], ORACLES["op2_chat"], connection(folder), folder)[0] == "ok"
