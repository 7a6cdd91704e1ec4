"""Registered queries: neighbour graphs, their weights, layouts, and the whole analysis."""

from pyspark.sql import functions as F

from catalog.shapes import EMBED, _STD, embedded
from catalog.shared import rounded, sql_round as r, table
from plumbline import analyze
from plumbline.operators import forest, layout, neighbours, reduce
from plumbline.session import cut

PART = ["p_size", "p_retailprice"]


def ready_part(spark, d):
    return reduce.standardise(table(spark, d, "part"), PART, ["p_partkey"])


def ready_vectors(spark, d):
    return reduce.prepared(embedded(spark, d), EMBED, ["vec_id"])


def _knn_sql(points, distance, k):
    return f"""WITH p AS ({points}),
d AS (SELECT a.id, b.id AS neighbour, round(sqrt({distance}), 9) AS distance FROM p a JOIN p b ON a.id <> b.id)
SELECT id, neighbour, rank, {r('distance')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= {k}"""


_PLANE = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def _analysis(spark, d, name, **options):
    wanted = options.pop("table_of")
    return analyze(table(spark, d, name), title=f"{name.title()} Analysis", layouts=("pca",), **options)[wanted]


def approximate_recall(spark, d):
    """One row: whether the approximate graph holds nine tenths of the exact neighbours, and how far those reach."""
    points = table(spark, d, "embeddings")
    exact = cut(neighbours.knn_graph(points, "embedding", "vec_id", 10), "exact")
    found = forest.recall(forest.knn_graph_approximate(points, "embedding", "vec_id", 10), exact)
    reach = exact.where("rank = 10").agg(F.avg("distance")).scalar()
    return rounded(found.select("points", "neighbours", (F.col("recall") >= 0.9).alias("recall_at_least_90"), reach.alias("mean_reach")))


_placed = {}


def placed(spark, d, place, anew=True):
    """The layout of all vectors; unless `anew`, the one that a query of this application has made already."""
    key = spark.sparkContext.applicationId, d, place.__name__
    if anew or key not in _placed:
        _placed[key] = place(cut(ready_vectors(spark, d), "ready"), EMBED, "vec_id")
    return _placed[key]


def preservation(spark, d, place, least):
    """One row: whether enough of the ten nearest vectors are among the ten nearest points of the layout."""
    graph = cut(neighbours.knn_graph(ready_vectors(spark, d), EMBED, "vec_id", 10), "exact")
    return layout.preserved(graph, placed(spark, d, place, anew=False), "vec_id").select("points", (F.col("share") >= least).alias("neighbours_kept"))


QUERIES = {
    "knn_graph": lambda spark, d: rounded(neighbours.knn_graph(ready_part(spark, d), PART, "p_partkey", 5)),
    "knn_graph_vectors": lambda spark, d: rounded(neighbours.knn_graph(embedded(spark, d), EMBED, "vec_id", 10)),
    "knn_graph_copies": lambda spark, d: rounded(neighbours.knn_graph(table(spark, d, "labels"), ["quality", "toxic"], "doc_id", 4)),
    "tsne_affinities": lambda spark, d: layout.tsne_affinities(neighbours.knn_graph(ready_vectors(spark, d), EMBED, "vec_id", 31), 10.0),
    "umap_weights": lambda spark, d: layout.umap_weights(neighbours.knn_graph(ready_vectors(spark, d), EMBED, "vec_id", 14), 15),
    "tsne": lambda spark, d: placed(spark, d, layout.tsne),
    "umap": lambda spark, d: placed(spark, d, layout.umap),
    "knn_graph_approximate": approximate_recall,
    # A point's ten nearest are 2 % of these; t-SNE with all forces exact keeps 28 % of them.
    "tsne_preserved": lambda spark, d: preservation(spark, d, layout.tsne, 0.2),
    "umap_preserved": lambda spark, d: preservation(spark, d, layout.umap, 0.15),
    "analyze_supervised": lambda spark, d: _analysis(spark, d, "events", keys=["event_id"], target="event_type", table_of="findings"),
    "analyze_unsupervised": lambda spark, d: _analysis(spark, d, "lineitem", task="unsupervised", mode="full", steps=["statistics"],
                                                       keys=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], table_of="associations"),
}

ORACLES = {
    "knn_graph": _knn_sql(f"SELECT p_partkey AS id, {_STD('p_size')} AS x, {_STD('p_retailprice')} AS y FROM part", _PLANE, 5),
    "knn_graph_vectors": _knn_sql("SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
                                  "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", 10),
    "knn_graph_approximate": "SELECT count(DISTINCT id) AS points, count(*) AS neighbours, TRUE AS recall_at_least_90, " + r("avg(true_distance) FILTER (rank = 10)") + " AS mean_reach FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY true_distance, neighbour) AS rank FROM ("
        "SELECT a.id, b.id AS neighbour, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS true_distance "
        "FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON a.id <> b.id)) WHERE rank <= 10",
    "tsne_preserved": "SELECT count(*) AS points, TRUE AS neighbours_kept FROM embeddings",
    "umap_preserved": "SELECT count(*) AS points, TRUE AS neighbours_kept FROM embeddings",
    "knn_graph_copies": _knn_sql("SELECT doc_id AS id, quality AS x, toxic AS y FROM labels", _PLANE, 4),
}
