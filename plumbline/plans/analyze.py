"""The whole analysis of a table in one call."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col, families, normalise_missing
from plumbline.operators import associations as A
from plumbline.operators import cluster, collinearity, features, findings, layout, outliers, plotdata, profile, reduce, responses, targets
from plumbline.operators.frequencies import Frequencies
from plumbline.session import InputError, cut
from plumbline.settings import DEFAULTS, Settings
from plumbline.sources import store
from plumbline.sources.tables import preview, sample_rows

# The steps in the order they run, each with the steps it builds on.
STEPS = {"profile": [], "target": ["profile"], "statistics": ["profile", "target"], "reduction": ["profile"],
         "charts": ["statistics", "reduction"], "narration": ["statistics"]}
LAYOUTS = ("pca", "tsne", "umap")


class _Run:
    """One analysis: its input, its options and the tables it has finished."""

    def __init__(self, df, task, target, keys, settings, original_rows, mode, title, layouts, approximate, save):
        self.df, self.task, self.target, self.keys, self.settings = df, task, target, keys, settings
        self.original_rows, self.mode, self.title, self.layouts, self.approximate, self.save = original_rows, mode, title, layouts, approximate, save
        self.values: Frequencies | None = None
        self.tables: dict[str, DataFrame] = {}
        self.findings: list[DataFrame] = []

    def put(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """Compute a table now, so that a failure belongs to its step."""
        self.tables[name] = self.save(name, make)
        return self.tables[name]

    def columns(self, *kinds: str) -> list[str]:
        rows = self.tables["column_profile"].where(F.col("inferred_type").isin(*kinds)).orderBy("ordinal").select("column_name").collect()
        return [r["column_name"] for r in rows]

    def row_key(self) -> tuple[DataFrame, str]:
        """The table with a single column that tells its rows apart."""
        if self.keys is None:
            found = self.tables["column_profile"].where("unique_count = row_count").orderBy("ordinal").select("column_name").first()
            if found is None:
                raise InputError("no column tells the rows apart; name the key columns")
            return self.df, found["column_name"]
        if len(self.keys) == 1:
            return self.df, self.keys[0]
        return self.df.withColumn("row_key", F.to_json(F.struct(*[col(k) for k in self.keys]))), "row_key"


def _profile(run: _Run) -> None:
    by = [k for k, kind in families(run.df).items() if kind != "nested"]
    run.put("preview", lambda: preview(run.df, by))
    stats = run.put("dataset_stats", lambda: profile.dataset_stats(run.df, run.original_rows))

    def columns_profiled() -> DataFrame:
        if not run.approximate:
            run.values = Frequencies(run.df, by)            # charts read it, too
        return profile.column_profile(run.df, run.settings, run.approximate, run.values)

    columns = run.put("column_profile", columns_profiled)
    run.findings += [findings.dataset_findings(stats, run.settings), findings.column_findings(columns, run.settings)]


def _target(run: _Run) -> None:
    columns = run.tables["column_profile"]
    if run.target is not None:
        run.put("target_candidates", lambda: targets.validate_target(columns, run.target, run.settings))
        return
    candidates = run.put("target_candidates", lambda: targets.pick_target(targets.score_targets(columns, run.settings)))
    run.target = targets.identified_target(candidates)
    run.findings.append(findings.target_findings(candidates))


def _statistics(run: _Run) -> None:
    s, nums, cats = run.settings, run.columns("numerical"), run.columns("categorical", "boolean")
    if nums:
        run.findings.append(findings.outlier_findings(run.put("outliers", lambda: outliers.outliers(run.df, nums, s.outlier_method, s.outlier_score)), s))
    inputs = [c for c in nums if c != run.target]
    if len(inputs) > 1:
        run.findings.append(findings.vif_findings(run.put("vif", lambda: collinearity.vif(run.df, inputs)), s))
    pairs = run.put("associations", lambda: A.associations(run.df, cats, nums))
    run.findings.append(findings.association_findings(pairs, s))
    for name, kind, there in (("matrix_numbers", A.NUM_NUM, len(nums) > 1), ("matrix_categories", A.CAT_CAT, len(cats) > 1), ("matrix_mixed", A.CAT_NUM, cats and nums)):
        if there:
            try:
                run.put(name, lambda kind=kind: A.association_matrix(pairs, kind))
            except Exception as error:
                run.findings.append(findings.finding(run.df.sparkSession, "statistics", "WARNING", "matrices_not_saved", f"The matrix {name} could not be written: {error}"))
    if run.task != "supervised":
        return
    if run.tables["column_profile"].where(F.col("column_name") == run.target).isEmpty():
        run.findings.append(findings.finding(run.df.sparkSession, "statistics", "WARNING", "target_details_missing", f"The profile has no column '{run.target}', the target."))
        return
    if run.target in cats:
        balance = run.put("class_balance", lambda: A.class_balance(run.df, run.target))
        run.findings.append(findings.balance_findings(balance, run.target, s))
    leaks = run.put("leakage", lambda: A.leakage(pairs, run.target, run.target in nums, s))
    run.findings.append(findings.leakage_findings(leaks, run.target))


def _reduction(run: _Run) -> None:
    chosen = run.put("features", lambda: reduce.select_features(run.tables["column_profile"], run.target))
    run.findings.append(findings.reduction_findings(chosen, reduce.LEAST_FEATURES))
    cols = [r["column_name"] for r in chosen.where(~F.col("is_constant")).orderBy("ordinal").collect()]
    if len(cols) < reduce.LEAST_FEATURES:
        return
    keyed, key = run.row_key()
    ready = run.put("prepared_features", lambda: reduce.prepared(keyed, cols, [key], run.settings))
    run.put("pca_variance", lambda: reduce.pca_variance(ready, cols, run.settings.pca_components))
    if "pca" in run.layouts:
        run.put("embedding_pca", lambda: reduce.pca_embedding(ready, cols, [key]))
    if "tsne" in run.layouts:
        run.put("embedding_tsne", lambda: layout.tsne(ready, cols, key, run.settings))
    if "umap" in run.layouts:
        run.put("embedding_umap", lambda: layout.umap(ready, cols, key, run.settings))


def _hue(run: _Run) -> tuple[DataFrame, str, str] | None:
    """The table with its colouring column, that column's name and the row key;
    without a colouring column a finding says why."""
    keyed, key = run.row_key()
    if run.task == "supervised":
        if run.target in run.df.columns:
            return keyed, run.target, key
        rule = findings.no_target_for_hue if run.target is None else findings.target_missing_for_hue
        run.findings.append(rule(run.df.sparkSession, run.target))
    cols = reduce.feature_names(run.tables["column_profile"], None)
    try:
        labels = run.put("clusters", lambda: cluster.kmeans_clusters(keyed, cols, [key], run.settings))
    except Exception as error:
        run.findings.append(findings.finding(run.df.sparkSession, "charts", "ERROR", "clustering_failed", f"The rows could not be clustered: {error}"))
        return None
    return keyed.join(labels, key), "cluster", key


def _charts(run: _Run) -> None:
    s, columns = run.settings, run.tables["column_profile"]
    nums, cats = run.columns("numerical"), run.columns("categorical", "boolean")
    if nums:
        run.put("histogram", lambda: plotdata.histogram(run.df, nums))
        run.put("kde_curve", lambda: plotdata.kde_curve(run.df, nums))
    if cats:
        run.put("count_bars", lambda: plotdata.count_bars(run.df, cats, s.bars, run.values))
    run.put("heatmap_cells", lambda: _heatmaps(run.tables["associations"]))
    found = _hue(run)
    if found is None:
        return
    colored, hue, key = found
    is_number = hue != "cluster" and plotdata.numeric_hue(columns, hue, s)
    run.put("plot_plan", lambda: plotdata.plot_plan(columns, hue, is_number))
    if hue == "cluster":
        run.put("top_features", lambda: features.top_associated_features(colored, hue, nums, cats, s.bivariate_top, s))
    else:
        run.put("top_features", lambda: A.top_correlated_features(run.tables["associations"], hue, s.bivariate_top))
    chosen = {r["column_name"] for r in run.tables["top_features"].collect()}
    views: dict[str, list[DataFrame]] = {}
    for c in [c for c in nums + cats if c in chosen and c != hue]:
        named = lambda df, c=c: df.select(F.lit(c).alias("column_name"), "*")
        if is_number and c in nums:
            views.setdefault("regression_lines", []).append(named(plotdata.regression_line(colored, c, hue)))
        elif is_number or c in nums:
            category, number = (c, hue) if is_number else (hue, c)
            views.setdefault("violins", []).append(named(plotdata.violin_summary(colored, category, number)))
            views.setdefault("violin_density", []).append(named(plotdata.violin_density(colored, category, number)))
        else:
            views.setdefault("grouped_counts", []).append(named(plotdata.grouped_counts(colored, c, hue)))
    for name, parts in views.items():
        run.put(name, lambda parts=parts: _union(parts))
    labels = colored.select(col(key), col(hue).alias("hue"))
    for name in [n for n in run.tables if n.startswith("embedding_")]:
        run.put(name.replace("embedding_", "points_"), lambda name=name: plotdata.embedding_points(run.tables[name], labels, [key]))


def _heatmaps(pairs: DataFrame) -> DataFrame:
    return _union([A.heatmap_cells(pairs, kind).select(F.lit(kind).alias("kind"), "*") for kind in (A.CAT_NUM, A.CAT_CAT, A.NUM_NUM)])


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _narration(run: _Run) -> None:
    told = ("dataset_stats", "column_profile", "target_candidates", "outliers", "vif", "associations", "class_balance", "pca_variance")
    context = run.put("analysis_context", lambda: findings.analysis_context({n: run.tables[n] for n in told if n in run.tables}, run.title))
    run.put("prompt_messages", lambda: responses.prompt_messages(
        context.withColumns({"task": F.lit(run.task), "mode": F.lit(run.mode)}), ["dataset"]))


WORK = {"profile": _profile, "target": _target, "statistics": _statistics, "reduction": _reduction, "charts": _charts, "narration": _narration}


def steps_to_run(steps: list[str] | None, task: str) -> list[str]:
    """The wanted steps with everything they build on, in running order; unknown names are ignored."""
    wanted = set(STEPS) if steps is None else set()
    pending = [] if steps is None else [s for s in steps if s in STEPS]
    while pending:
        step = pending.pop()
        if step not in wanted:
            wanted.add(step)
            pending += STEPS[step]
    return [s for s in STEPS if s in wanted and not (task == "unsupervised" and s == "target")]


Step = Callable[[dict[str, DataFrame]], DataFrame]


def analyze(df: DataFrame, task: str = "supervised", target: str | None = None, mode: str = "full", steps: list[str] | None = None,
            keys: list[str] | None = None, extra_steps: dict[str, Step | tuple[Step, str]] | None = None,
            settings: Settings = DEFAULTS, title: str = "Table Analysis", layouts: tuple[str, ...] = LAYOUTS, approximate: bool = False,
            write_intake: bool = True, store_root: str | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Run the steps and return their tables by name, `findings` and `run` among them.

    A step that fails leaves an ERROR finding and the steps built on it are
    skipped with a WARNING; all others go on. With `store_root` every finished
    table is kept under a key made of data, options and settings, and a later
    call takes it from there unless `force` is set. An extra step given with a
    version, (function, version), is kept under that version; one without is
    computed on every call. `approximate` counts distinct values by sketches.

    The table is written once before the analysis, so that no step parses or
    computes its source again; `write_intake=False` spares that copy where `df`
    is a plain read of a columnar format.
    """
    if task not in ("supervised", "unsupervised"):
        raise InputError(f"unknown task '{task}'")
    if mode not in ("full", "fast"):
        raise InputError(f"unknown mode '{mode}'")
    spark = df.sparkSession
    df = normalise_missing(df)
    original_rows = df.count()
    if mode == "fast" and original_rows > settings.sample_rows:
        by = keys or [c for c, kind in families(df).items() if kind != "nested"]
        df = cut(sample_rows(df, settings.sample_rows, by, settings.sample_seed), "sample")
    elif write_intake:
        df = cut(df, "intake")
    fingerprint = key = None
    if store_root is not None:
        fingerprint = store.table_fingerprint(df).first()["fingerprint"]
        options = repr((task, target, mode, keys, original_rows, sorted(layouts), title, approximate))
        key = store.store_key(fingerprint + options, settings)

    def save(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key is None:
            return cut(make(), name)
        found = None if force else store.load_section(spark, store_root, key, name)
        return found if found is not None else store.save_section(make(), store_root, key, name)

    run = _Run(df, task, target if task == "supervised" else None, keys, settings, original_rows, mode, title, layouts, approximate, save)
    failed: set[str] = set()
    for step in steps_to_run(steps, task):
        blocking = [s for s in STEPS[step] if s in failed]
        if blocking:
            failed.add(step)
            run.findings.append(findings.finding(spark, step, "WARNING", "step_skipped", f"Step {step} was skipped: {', '.join(blocking)} did not finish."))
            continue
        try:
            WORK[step](run)
        except Exception as error:
            failed.add(step)
            run.findings.append(findings.finding(spark, step, "ERROR", "step_failed", f"Step {step} failed: {error}"))
    for name, step in (extra_steps or {}).items():
        make, version = step if isinstance(step, tuple) else (step, None)
        try:
            result = lambda make=make: make(dict(run.tables))
            run.tables[name] = cut(result(), name) if version is None else save(f"{name}-{version}", result)
        except Exception as error:
            run.findings.append(findings.finding(spark, name, "ERROR", "step_failed", f"Step {name} failed: {error}"))
    run.tables["findings"] = cut(findings.merge_findings(spark, run.findings), "findings")
    run.tables["alerts"] = findings.alerts(run.tables["findings"])
    if "column_profile" in run.tables:
        run.tables["health_metrics"] = findings.health_metrics(run.tables["dataset_stats"])
        run.tables["column_insights"] = findings.column_insights(run.tables["findings"], run.tables["column_profile"])
    run.tables["run"] = spark.createDataFrame(
        [(fingerprint, title, mode, task, target, run.target, original_rows)],
        "fingerprint string, title string, mode string, task string, user_target string, target string, original_row_count bigint")
    return run.tables
