"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of cores, and
BENCH_QUERIES (optional) a comma-separated choice of queries, or `all`.
"""

import json
import os
import sys
import time

os.environ.setdefault("PYTHONWARNINGS", "ignore")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import catalog

HEADLINES = [
    "column_profile_lineitem", "column_profile_orders", "column_profile_events", "column_profile_documents", "duplicate_rows",
    "unique_values", "missing_values", "numeric_summary", "category_summary", "quantiles", "infer_types_events", "pick_target_lineitem",
    "outliers_modified_z", "outliers_z", "spearman", "spearman_missing", "average_rank", "cramers_v", "correlation_ratio_missing", "anova_f",
    "class_balance", "vif_three", "associations", "leakage_number_target", "pca_variance", "kmeans_clusters", "f_classif", "chi2_feature",
    "histogram", "kde_curve_events", "count_bars", "regression_line", "violin_summary", "grouped_counts", "findings_statistics",
    "merge_turns", "parse_responses", "recommendations", "scan_csv", "scan_csv_line_breaks", "sample_rows", "table_fingerprint",
    "sketched_profile", "knn_graph_vectors", "knn_graph_approximate", "umap_weights",
    "tsne", "umap", "analyze_supervised", "analyze_unsupervised",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINES
    seconds, failed = {}, {}
    queries["missing_values"](spark, folder).collect()              # starts the engine
    for name in names:
        start = time.perf_counter()
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds.get(name, "failed"), file=sys.stderr, flush=True)
    line = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
            "sf": os.path.basename(folder), "cpus": int(cpus)}
    if failed:
        line["failed"] = failed
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
