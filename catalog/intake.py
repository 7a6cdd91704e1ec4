"""Registered queries: scans of every format, sampling, fingerprints, stored results."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from catalog.shared import rounded, sql_round as r, table, union_all
from catalog.shapes import ORACLES as SHAPES_SQL, QUERIES as SHAPES
from catalog.statistics import ORACLES as STATS, wide_associations
from plumbline.operators import associations as A
from plumbline.operators import profile
from plumbline.operators.frequencies import distinct_counts
from plumbline.operators.ordering import quantiles
from plumbline.session import scratch_path, ship
from plumbline.settings import DEFAULTS
from plumbline.sources import sketches, store, tables
from plumbline.sources.arrow import create_file

ship(__name__)


def as_csv(df, sep=","):
    path = scratch_path(df.sparkSession, "csv")
    df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("quoteAll", False).csv(path)
    return path


def _orders_csv(spark, d, sep=","):
    """Orders with missing cells spelled in several ways."""
    return as_csv(table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 5 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 3 == 0, "null").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice", F.concat(F.lit('say "hi", '), F.col("o_orderpriority")).alias("note"), (F.col("o_custkey") % 2 == 0).alias("even")), sep)


def write_arrow(df):
    """One Arrow file per task."""
    folder = scratch_path(df.sparkSession, "arrow")

    def save(batches):
        batches = list(batches)
        if batches:
            name = f"{folder}/part-{TaskContext.get().partitionId()}.feather"
            with create_file(name) as out, pa.ipc.new_file(out, batches[0].schema) as sink:
                for batch in batches:
                    sink.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"name": [name]})

    df.mapInArrow(save, "name string").count()
    return folder


BOOK_ROWS = 50_000         # a sheet has at most 1,048,576


def _sheet(frame: pd.DataFrame) -> bytes:
    """A minimal workbook: shared texts, numbers, booleans."""
    shared: dict[str, int] = {}

    def cell(value, at, row):
        ref = f"{chr(65 + at)}{row}"
        if value is None or value != value:
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str):
            return f'<c r="{ref}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
        return f'<c r="{ref}"><v>{value!r}</v></c>'

    rows = [list(frame.columns)] + frame.astype(object).values.tolist()
    body = "".join(f'<row r="{i}">' + "".join(cell(v, at, i) for at, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      f'<Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>")
    return out.getvalue()


def write_workbooks(df, by):
    """One workbook per value of `by`; of a table of more than BOOK_ROWS rows as
    many per value as keep a workbook, made and read by one task, at about that size."""
    folder = scratch_path(df.sparkSession, "workbooks")
    books = -(-df.count() // BOOK_ROWS) or 1

    def save(key, frame):
        name = f"{key[0]}" if books == 1 else f"{key[0]}-{key[1]}"
        with create_file(f"{folder}/{name}.xlsx") as sink:
            sink.write(_sheet(frame.drop(columns=[by, "_book"])))
        return pd.DataFrame({"name": [name]})

    df.withColumn("_book", F.pmod(F.xxhash64(*df.columns), F.lit(books))).groupBy(by, "_book").applyInPandas(save, "name string").count()
    return folder


#: Beyond what a double tells apart, so that neighbours fall together where one is used.
FAR_ID = 10 ** 18


def _long_ids(spark, d):
    """Identifiers of 19 digits, with and without missing cells, and of 21 digits."""
    key = F.col("o_orderkey")
    ids = table(spark, d, "orders").select((key + FAR_ID).alias("id"), F.when(key % 3 == 0, F.lit(None)).otherwise(key + FAR_ID).alias("gappy"), F.concat(F.lit("99"), key + FAR_ID).alias("longer"))
    read = tables.read_table(spark, as_csv(ids), "csv", ",")
    return read.select("id", "gappy", F.col("longer").cast("string").alias("longer"), *[F.lit(dict(read.dtypes)[c]).alias(f"{c}_type") for c in ("gappy", "longer")])


def _repeated(spark, d):
    """A sample of a table with three keys."""
    rows = table(spark, d, "lineitem").select("l_returnflag")
    return tables.sample_rows(rows, 1000, ["l_returnflag"]).agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("flags"))


def _missing_told_apart(spark, d):
    """Two columns that differ only in where their cells are missing; and one table in two layouts."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    even = F.col("o_orderkey") % 2 == 0
    one = orders.select(F.when(even, F.col("o_custkey")).alias("a"), F.when(~even, F.col("o_custkey")).alias("b"))
    other = one.select(F.col("b").alias("a"), F.col("a").alias("b"))
    of = lambda df: store.table_fingerprint(df).first()["fingerprint"]
    same = of(orders) == of(orders.repartition(7))
    return orders.agg(F.count("*").alias("rows")).select("rows", F.lit(of(one) != of(other)).alias("told_apart"), F.lit(same).alias("layout_free"))


def _delimiters(spark, d):
    out = None
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    for sep in tables.DELIMITERS:
        found = tables.detect_delimiter(spark, as_csv(rows, sep))
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(sep).alias("written"), F.lit(found).alias("found"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _stored(spark, d):
    """Profile saved, then served from the store."""
    df = table(spark, d, "orders")
    root = scratch_path(spark, "store")
    key = store.store_key(store.table_fingerprint(df).first()["fingerprint"], DEFAULTS)
    store.save_section(profile.missing_values(df), root, key, "missing")
    return rounded(store.load_section(spark, root, key, "missing"))


def _matrix(spark, d):
    path = scratch_path(spark, "matrix")
    store.write_section(A.association_matrix(wide_associations(spark, d), A.NUM_NUM), path, "csv")
    return rounded(tables.read_csv(spark, path))


def _embedding(spark, d):
    path = scratch_path(spark, "embedding")
    store.write_section(SHAPES["pca_embedding_two"](spark, d), path, "csv")
    return rounded(tables.read_csv(spark, path), 4)


def _json(spark, d):
    path = scratch_path(spark, "json")
    store.write_section(profile.missing_values(table(spark, d, "orders")), path, "json")
    return rounded(spark.read.schema("column_name string, missing_count bigint, missing_pct double").json(path))


def sketched_lineitem(spark, d):
    """Line items that arrive in two batches of files; the sketches of the first are not made again.

    Distinct counts must be within 3 %, medians within 1 % of the ranks."""
    items, root = table(spark, d, "lineitem"), scratch_path(spark, "sketches")
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    later = F.col("l_orderkey") % 3 == 0
    items.where(~later).write.parquet(f"{root}/data/first")
    first = sketches.refresh(spark, f"{root}/data", root)
    items.where(later).write.parquet(f"{root}/data/second")
    found = sketches.sketched_profile(spark, f"{root}/data", root).where(F.col("column_name").isin(cols))
    exact = distinct_counts(items, cols).withColumnRenamed("unique_count", "true_count")
    near = quantiles(items, cols[:3], [0.49, 0.51]).groupBy("column_name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    there = sketches.stored(spark, root)
    once = there.groupBy("file", "column_name").count().where("count > 1").isEmpty()
    return found.join(exact, "column_name").join(near, "column_name", "left").select(
        "column_name", "row_count", "present_count", (F.abs(F.col("unique_count") / F.col("true_count") - 1) <= 0.03).alias("distinct_near"),
        F.coalesce(F.col("median").between(F.col("low"), F.col("high")), F.col("low").isNull()).alias("median_near"),
        F.lit(once and first > 0).alias("sketched_once"))


QUERIES = {
    "sketched_profile": sketched_lineitem,
    "scan_parquet": lambda spark, d: tables.read_table(spark, f"{d}/orders.parquet"),
    "scan_csv": lambda spark, d: rounded(tables.read_table(spark, _orders_csv(spark, d), "csv")),
    "scan_csv_semicolon": lambda spark, d: rounded(tables.read_table(spark, _orders_csv(spark, d, ";"), "csv", ";")),
    "scan_csv_line_breaks": lambda spark, d: tables.read_table(spark, as_csv(table(spark, d, "documents")), "csv", ","),
    "scan_csv_types": lambda spark, d: tables.read_table(spark, _orders_csv(spark, d), "csv").agg(
        *[F.max(F.typeof(c)).alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "note", "even")]),
    "detect_delimiter": _delimiters,
    "scan_arrow": lambda spark, d: tables.read_table(spark, write_arrow(table(spark, d, "customer").repartition(4)), "arrow"),
    "scan_workbooks": lambda spark, d: tables.read_table(spark, write_workbooks(table(spark, d, "customer").withColumn("part", F.col("c_custkey") % 4), "part"), "workbook"),
    "scan_csv_long_ids": _long_ids,
    "row_count": lambda spark, d: spark.createDataFrame([(tables.row_count(table(spark, d, "lineitem")),)], "n bigint"),
    "sample_rows": lambda spark, d: tables.sample_rows(table(spark, d, "orders"), 500, ["o_orderkey"]).select("o_orderkey", "o_totalprice"),
    "sample_rows_repeated": _repeated,
    "sample_rows_all": lambda spark, d: tables.sample_rows(table(spark, d, "region"), 500, ["r_regionkey"]).select("r_name"),
    "preview": lambda spark, d: tables.preview(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_extendedprice"),
    "table_fingerprint": lambda spark, d: store.table_fingerprint(table(spark, d, "lineitem")),
    "table_fingerprint_missing": _missing_told_apart,
    "row_digests": lambda spark, d: store.row_digests(table(spark, d, "documents").select("doc_id", "text", "lang", F.nullif("source", F.lit("src0")).alias("source")), ["doc_id"]),
    "file_fingerprint": lambda spark, d: store.file_fingerprint(spark, f"{d}/*.parquet"),
    "result_store": _stored,
    "write_matrix": _matrix,
    "write_embeddings": _embedding,
    "write_report_json": _json,
    "title_from_name": lambda spark, d: table(spark, d, "part").select(
        "p_partkey", tables.title_from_name(F.concat_ws("_", F.translate("p_name", " ", "-"), "p_brand")).alias("title")),
}

_CSV_SQL = """SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN {custkey} END AS o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS o_orderstatus,
 {price} AS o_totalprice, 'say "hi", ' || o_orderpriority AS note, o_custkey % 2 = 0 AS even FROM orders""".format(
    custkey=r("o_custkey"), price=r("o_totalprice"))

ORACLES = {
    "sketched_profile": union_all([f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS present_count, TRUE AS distinct_near, TRUE AS median_near, TRUE AS sketched_once FROM lineitem"
                                   for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")]),
    "scan_parquet": "SELECT * FROM orders",
    "scan_csv": _CSV_SQL,
    "scan_csv_semicolon": _CSV_SQL,
    "scan_csv_line_breaks": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "scan_csv_types": "SELECT 'bigint' AS o_orderkey, 'double' AS o_custkey, 'string' AS o_orderstatus, 'double' AS o_totalprice, 'string' AS note, 'boolean' AS even FROM orders LIMIT 1",
    "detect_delimiter": "SELECT s AS written, s AS found, n AS rows FROM (SELECT count(*) AS n FROM supplier), (SELECT unnest([',', ';', chr(9), '|']) AS s)",
    "scan_arrow": "SELECT * FROM customer",
    "scan_workbooks": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "row_count": "SELECT count(*) AS n FROM lineitem",
    "sample_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500",
    "scan_csv_long_ids": f"""SELECT o_orderkey + {FAR_ID} AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + {FAR_ID} END AS gappy, '99' || (o_orderkey + {FAR_ID}) AS longer,
 'bigint' AS gappy_type, 'decimal(38,0)' AS longer_type FROM orders""",
    "sample_rows_repeated": "SELECT least(1000, count(*)) AS n, count(DISTINCT l_returnflag) AS flags FROM lineitem",
    "table_fingerprint_missing": "SELECT count(*) AS rows, true AS told_apart, true AS layout_free FROM orders",
    "sample_rows_all": "SELECT r_name FROM region",
    "preview": "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5",
    "row_digests": """SELECT doc_id, sha256(length(doc_id::VARCHAR) || ':' || doc_id || '|' || length(text) || ':' || text || '|' || length(lang) || ':' || lang || '|'
 || CASE WHEN source = 'src0' THEN '-' ELSE length(source) || ':' || source END) AS digest FROM documents""",
    "result_store": union_all([f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, CAST(0.0 AS DOUBLE) AS missing_pct FROM orders"
                               for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")]),
    "write_matrix": STATS["association_matrix"],
    "write_embeddings": SHAPES_SQL["pca_embedding_two"],
    "title_from_name": """SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(replace(p_name || '_' || p_brand, '_', ' ')), '[a-z]+|[^a-z]+'),
 lambda x: upper(x[1]) || x[2:]), '') || ' Analysis' AS title FROM (SELECT p_partkey, p_name, p_brand FROM part)""",
}
ORACLES["write_report_json"] = ORACLES["result_store"]
