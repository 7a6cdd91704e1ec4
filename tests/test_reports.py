"""Findings, messages, answers, sources, the result store and the whole analysis."""

import json

import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from catalog.intake import as_csv, write_arrow, write_workbooks
from plumbline import InputError, Settings, analyze, read_table
from plumbline.operators import findings, profile, responses
from plumbline.plans import analyze as plan
from plumbline.plans.analyze import steps_to_run
from plumbline.sources import store, tables


def rules(df):
    return {(r["rule"], r["column_name"]) for r in df.collect()}


def test_column_rules(spark):
    df = spark.createDataFrame([(None if i % 2 else 1.0, 42, f"word {i % 48}", float(2 ** (i % 24))) for i in range(50)],
                               "holes double, flat int, words string, steep double")
    found = rules(findings.column_findings(profile.column_profile(df)))
    assert {("missing_values", "holes"), ("constant_column", "flat"), ("constant_column", "holes"), ("high_cardinality", "words"), ("skewed", "steep")} <= found


def test_dataset_rules(spark):
    same = spark.createDataFrame([(1, 2)] * 3, "a int, b int")
    assert rules(findings.dataset_findings(profile.dataset_stats(same))) == {("duplicate_rows", None), ("high_dimensionality", None)}
    assert rules(findings.dataset_findings(profile.dataset_stats(same), Settings(dataset_mb=0.0))) >= {("large_dataset", None)}


def test_insights_match_whole_names(spark):
    notes = findings.merge_findings(spark, [findings.finding(spark, "m", "INFO", "r", text) for text in ("Column 'age' is odd", "Column 'page' too", "a.b and (x) here")])
    names = spark.createDataFrame([("age",), ("page",), ("a.b",), ("axb",)], "column_name string")
    found = {(r["column_name"], r["message"][:10]) for r in findings.column_insights(notes, names).collect()}
    assert found == {("age", "Column 'ag"), ("page", "Column 'pa"), ("a.b", "a.b and (x")}


def test_one_conversation_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(responses, "TURNS_PER_CHUNK", 4)
    roles = ["user"] * 9 + ["assistant"] * 2 + ["system"] + ["assistant"] + ["user"] * 6
    rows = [(1, i, r, f"t{i}") for i, r in enumerate(roles)] + [(2, 0, "user", "hi"), (2, 1, "assistant", "ho")]
    merged = responses.merge_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    one = merged.where("conv_id = 1").orderBy("position").collect()
    assert [(r["position"], r["role"], r["turns"]) for r in one] == [(0, "user", 9), (1, "assistant", 3), (2, "user", 6)]
    assert one[1]["content"] == "t9\n\nt10\n\nt12" and one[0]["content"].startswith("t0\n\nt1\n\nt2")
    assert merged.where("conv_id = 2").count() == 2


ANSWER = {"executive_summary": "s", "recommendations": {"preprocessing_steps": [{"category": "c", "description": "d", "priority": 1}]}}


def parse(spark, texts):
    return responses.parse_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string"), "raw")


def test_answers(spark):
    body = json.dumps(ANSWER)
    parsed = parse(spark, [body, f"```json\n{body}\n```", f"Sure: {body} Bye", body[:-4], "no object", "```\nplain\n```", body.replace('"', "'")])
    rows = parsed.orderBy("id").collect()
    assert [r["is_valid"] for r in rows] == [True, True, True, False, False, False, False]
    assert rows[5]["json"] == "plain"
    full = responses.normalise_response(parsed).orderBy("id").first()
    assert full["executive_summary"] == "s" and full["dataset_overview"] == "" and full["recommendations"]["pitfall_warnings"] == []
    advice = responses.recommendations(responses.normalise_response(parsed), ["id"]).collect()
    assert [(r["list"], r["priority"]) for r in advice] == [("preprocessing_steps", 1)] * 3
    retry = responses.retry_queue(parsed, "raw", ["id"]).collect()
    assert len(retry) == 8 and {r["role"] for r in retry} == {"system", "user"}


def test_extraction_of_known_texts(spark):
    wanted = {'{"a": 1}': '{"a": 1}', 'Here you are: {"a": {"b": 2}} - done': '{"a": {"b": 2}}', '```json\n{"a": 1}\n```': '{"a": 1}',
              "```json\nnothing\n```": "nothing", "  plain  ": "plain", "} backwards {": "} backwards {", "{ open": "{ open", "": ""}
    df = spark.createDataFrame(list(wanted.items()), "raw string, wanted string").withColumn("json", responses.extract_json(F.col("raw")))
    assert [r["raw"] for r in df.collect() if r["json"] != r["wanted"]] == []


@hyp(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='{}`ab"\n json', max_size=25), min_size=30, max_size=30))
def test_extraction_takes_all_from_brace_to_brace(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string").select("raw", responses.extract_json(F.col("raw")).alias("json"))
    for raw, found in df.collect():
        assert found in raw
        if found.startswith("{") and found.endswith("}") and len(found) > 1:
            around = raw.replace(found, "", 1)
            assert "{" not in raw[:raw.index(found)] and "}" not in raw[raw.index(found) + len(found):] and len(around) == len(raw) - len(found)


def test_workbook_columns_get_a_name_each():
    from plumbline.sources.workbook import column_names
    assert column_names(["a", None, "a", "", "a", "column_1"]) == ["a", "column_1", "a_2", "column_3", "a_3", "column_1_2"]


def test_files_with_different_columns_are_read_together(spark, folder):
    import pyarrow as pa
    for name, columns in (("1", {"a": [1], "b": ["x"]}), ("2", {"b": ["y"], "c": [2.5]})):
        table = pa.table(columns)
        with pa.ipc.new_file(f"{folder}/{name}.arrow", table.schema) as sink:
            sink.write_table(table)
    df = read_table(spark, folder, "arrow")
    assert df.columns == ["a", "b", "c"] and sorted(map(tuple, df.collect()), key=str) == sorted([(1, "x", None), (None, "y", 2.5)], key=str)


def test_file_fingerprint_sees_contents_and_places(spark, folder):
    from plumbline.sources import store
    of = lambda path: store.file_fingerprint(spark, path).first()["fingerprint"]
    for name, content in (("a", b"1" * 300), ("b", b"2" * 10), ("c", b"")):
        with open(f"{folder}/{name}.bin", "wb") as sink:
            sink.write(content)
    first = of(folder)
    assert first == of(f"{folder}/*.bin")
    with open(f"{folder}/b.bin", "wb") as sink:
        sink.write(b"2" * 9 + b"3")
    assert of(folder) != first


# --- sources ------------------------------------------------------------------------

@pytest.mark.parametrize("sep", list(tables.DELIMITERS))
def test_delimiters(spark, sep):
    people = spark.createDataFrame([("ann", 30, 1.5), ("bob", 41, 2.0), ("cid", 25, 3.25)], "name string, age long, score double")
    path = as_csv(people.coalesce(1), sep)
    assert tables.detect_delimiter(spark, path) == sep
    assert sorted(map(tuple, read_table(spark, path, "csv").collect())) == sorted(map(tuple, people.collect()))


def test_csv_types_and_missing_texts(spark, folder):
    with open(f"{folder}/x.csv", "w") as sink:
        sink.write('a,b,c,d,e\n1,1,True,x,NA\n2,N/A,False,"two\nlines, ""quoted""",null\n3,2.5,True,nan,\n')
    df = read_table(spark, f"{folder}/x.csv")
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "double"]
    assert [r["d"] for r in df.orderBy("a").collect()] == ["x", 'two\nlines, "quoted"', None]
    assert tables.row_count(df) == 3


def test_header_only_and_single_column(spark, folder):
    for name, text, rows in (("empty", "id,value\n", 0), ("single", "value\n1.5\n2.5\n3.5\n", 3)):
        with open(f"{folder}/{name}.csv", "w") as sink:
            sink.write(text)
        assert read_table(spark, f"{folder}/{name}.csv").count() == rows


def test_arrow_and_workbooks(spark):
    df = spark.range(40).select("id", (F.col("id") / 4).alias("x"), F.concat(F.lit("a&b <"), F.col("id").cast("string")).alias("s"), (F.col("id") % 3).alias("part"))
    assert sorted(map(tuple, read_table(spark, write_arrow(df), "arrow").collect())) == sorted(map(tuple, df.collect()))
    book = read_table(spark, write_workbooks(df, "part"), "workbook")
    assert sorted(map(tuple, book.collect())) == sorted(map(tuple, df.drop("part").collect()))


def test_unknown_formats(spark):
    with pytest.raises(InputError):
        read_table(spark, "x.txt")


def test_sampling(spark):
    df = spark.range(5000)
    first, again = tables.sample_rows(df, 100, ["id"]), tables.sample_rows(df.repartition(7), 100, ["id"])
    assert first.count() == 100 and {r["id"] for r in first.collect()} == {r["id"] for r in again.collect()}
    assert tables.sample_rows(df, 5000, ["id"]).count() == 5000 and tables.sample_rows(df, 4999, ["id"]).count() == 4999
    assert {r["id"] for r in tables.sample_rows(df, 100, ["id"], 7).collect()} != {r["id"] for r in first.collect()}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    of = lambda d: store.table_fingerprint(d).first()["fingerprint"]
    assert of(df) == of(df.repartition(5).orderBy(F.desc("id"))) != of(df.withColumn("x", F.col("x") + (F.col("id") == 7).cast("int")))
    assert store.store_key("a", Settings()) != store.store_key("a", Settings(clusters=9))


def test_store(spark, folder):
    df = spark.createDataFrame([(1, [("a", 2)])], "k int, v array<struct<x:string,n:int>>")
    assert store.load_section(spark, folder, "key", "part") is None
    store.save_section(df, folder, "key", "part")
    assert store.load_section(spark, folder, "key", "part").collect() == df.collect()
    import glob
    for path in glob.glob(f"{folder}/key/part/data/*.parquet"):
        with open(path, "w") as sink:
            sink.write("broken")
    for path in glob.glob(f"{folder}/key/part/data/.*.crc"):
        with open(path, "w") as sink:
            sink.write("broken")
    assert store.load_section(spark, folder, "key", "part") is None
    assert store.clear_store(spark, folder, "key") and not store.clear_store(spark, folder, "key")


def test_title(spark):
    names = spark.createDataFrame([("student_performance-small",), ("they're 2nd",)], "n string")
    assert [r[0] for r in names.select(tables.title_from_name(F.col("n"))).collect()] == ["Student Performance Small Analysis", "They'Re 2Nd Analysis"]


# --- the whole analysis ----------------------------------------------------------------

@pytest.fixture(scope="module")
def people(spark):
    return spark.range(240).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).alias("survived"), F.element_at(F.array(F.lit("f"), F.lit("m")), (F.col("id") % 2 + 1).cast("int")).alias("sex"),
        F.when(F.col("id") % 4 != 0, (F.col("id") * 7) % 61).cast("double").alias("age"), ((F.col("id") * 13) % 97 + 50 * (F.col("id") % 2)).cast("double").alias("fare"),
        ((F.col("id") * 29) % 83).cast("double").alias("size"), (F.col("id") % 3).alias("class"))


def test_steps():
    assert steps_to_run(["statistics"], "supervised") == ["profile", "target", "statistics"]
    assert steps_to_run(["statistics", "unheard of"], "unsupervised") == ["profile", "statistics"]
    assert steps_to_run(None, "unsupervised") == ["profile", "statistics", "reduction", "charts", "narration"]


def test_supervised(spark, people, folder):
    calls = []
    extra = {"rows_per_class": (lambda t: calls.append(1) or people.groupBy("class").count(), "1"), "boom": lambda t: 1 / 0, "anew": lambda t: calls.append(2) or people.limit(1)}
    found = analyze(people, keys=["row_id"], layouts=("pca",), extra_steps=extra, store_root=folder)
    assert found["run"].first()["target"] == "survived"
    assert {"column_profile", "associations", "class_balance", "leakage", "pca_variance", "embedding_pca", "points_pca", "histogram", "violins",
            "grouped_counts", "analysis_context", "prompt_messages", "rows_per_class", "column_insights"} <= set(found)
    seen = rules(found["findings"])
    assert ("missing_values", "age") in seen and ("leakage_v", "sex") in seen and ("step_failed", None) in seen
    assert found["points_pca"].count() == 240
    context = json.loads(found["analysis_context"].first()["context"])
    assert len(context["column_profile"]) == 7
    again = analyze(people, keys=["row_id"], layouts=("pca",), extra_steps=extra, store_root=folder)
    assert calls == [1, 2, 2] and sorted(again) == sorted(set(found))
    assert {"violins", "violin_density"} <= set(found) and found["violin_density"].count() > 0
    # another version, or a changed value without one, is never served from the store
    extra["rows_per_class"] = (lambda t: people.groupBy("sex").count(), "2")
    extra["anew"] = lambda t: people.limit(7)
    third = analyze(people, keys=["row_id"], layouts=("pca",), extra_steps=extra, store_root=folder)
    assert third["rows_per_class"].columns[0] == "sex" and third["anew"].count() == 7
    assert again["associations"].inputFiles() == found["associations"].inputFiles()


def test_unsupervised_with_a_failing_step(spark, people):
    found = analyze(people, task="unsupervised", keys=["row_id"], layouts=("pca",))
    assert "target_candidates" not in found and "class_balance" not in found and found["clusters"].count() == 240
    broken = analyze(people, task="unsupervised", keys=["no_such_column"], layouts=("pca",))
    seen = {(r["module"], r["rule"]) for r in broken["findings"].collect()}
    assert ("reduction", "step_failed") in seen and ("charts", "step_skipped") in seen and "associations" in broken and "prompt_messages" in broken


def _bare_run(people, target):
    run = plan._Run(people, "supervised", target, ["row_id"], Settings(clusters=2, cluster_restarts=1, cluster_rounds=3), 240, "full", "t", (), False, lambda name, make: make())
    run.tables["column_profile"] = profile.column_profile(people)
    return run


def test_rules_about_a_missing_target(spark, people):
    run = _bare_run(people, "gone")
    plan._statistics(run)
    assert "class_balance" not in run.tables and "leakage" not in run.tables
    assert plan._hue(run)[1] == "cluster"
    none = _bare_run(people, None)
    assert plan._hue(none)[1] == "cluster"
    said = {(r["rule"], r["level"]) for part in (*run.findings, *none.findings) for r in part.collect()}
    assert {("target_details_missing", "WARNING"), ("target_missing_for_hue", "WARNING"), ("no_target_for_hue", "INFO")} <= said
    alerted = findings.alerts(findings.merge_findings(spark, none.findings))
    assert alerted.where("rule = 'no_target_for_hue'").isEmpty()


def test_matrices_that_cannot_be_written(spark, people):
    run = _bare_run(people, "survived")

    def save(name, make):
        if name.startswith("matrix"):
            raise OSError("disk full")
        return make()

    run.save = save
    plan._statistics(run)
    said = [(r["rule"], r["level"]) for part in run.findings for r in part.collect()]
    assert said.count(("matrices_not_saved", "WARNING")) == 3 and "leakage" in run.tables


def test_approximate_analysis(spark, people):
    found = analyze(people, steps=["profile"], keys=["row_id"], approximate=True, write_intake=False)
    assert {r["column_name"]: r["unique_count"] for r in found["column_profile"].collect()}["class"] == 3


def test_unusable_target(spark, people):
    found = analyze(people, target="row_id", steps=["statistics"])
    seen = {(r["module"], r["rule"]) for r in found["findings"].collect()}
    assert ("target", "step_failed") in seen and ("statistics", "step_skipped") in seen and "column_profile" in found
    with pytest.raises(InputError):
        analyze(people, task="guess")


def test_fast_mode(spark, people):
    found = analyze(people, mode="fast", steps=["profile"], keys=["row_id"], settings=Settings(sample_rows=50))
    stats = found["dataset_stats"].first()
    assert (stats["original_row_count"], stats["analyzed_row_count"]) == (240, 50)
