"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import centroids, chat, decontamination, html, language, licenses, neardup, packing, quality, scoring, sharding, urls, variants
from plumbline.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation whose texts look like the template's own marks.
HOSTILE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "conv_id long, turn long, role string, text string"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.union(spark.createDataFrame(HOSTILE, schema)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), spoiled=variants.SPOILED)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_chat": op2_chat,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_decontamination": op5_decontamination,
    "op6_scoring": op6_scoring,
    "op7_sharding": op7_sharding,
    "op8_html": op8_html,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_urls": op10_urls,
    "op11_variants": op11_variants,
    "op12_language": op12_language,
    "op13_centroids": op13_centroids,
}

#: Every turn has two blanks beside its marks and text, and one backslash more for each string in it that looks like a mark.
OP2_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
    select *, 2 + length(text) + len(regexp_extract_all(text, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|\[BOT\]|<<SYS>>|<</SYS>>|\[ROLE=[A-Za-z0-9_.~%-]*\]|\[/ROLE\])'))
        + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 9 end as chars
    from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
    cast(3 + sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""

#: The checksum is computed bit by bit; near words are found by what is left of them without one letter.
OP11_SQL = r"""
with recursive bits as (
    select b.range as byte, b.range as value, 0 as step from range(256) b
    union all select byte, case when value & 1 = 1 then xor(value >> 1, 3988292384) else value >> 1 end, step + 1 from bits where step < 8
), crc as (
    select list(value order by byte) as entries from bits where step = 8
), runs as (
    select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents)
), found as materialized (
    select doc_id, run, count(*) as n from runs where length(run) >= 7 group by all
), hashed as materialized (
    select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)), lambda x: cast(x as bigint))),
        lambda h, b: xor(h >> 8, entries[(xor(h, b) & 255) + 1])), 4294967295) as h
    from found, crc
), words as materialized (
    select word, cast(sum(n) as bigint) as n from (
        select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed)
    where length(word) >= 7 group by word having sum(n) >= 2
), skipped as materialized (
    select word, n, i, left(word, i) as a, substr(word, i + 2) as b from words, lateral (select unnest(range(length(word))) as i)
), near as materialized (
    select x.word, y.word as other, y.n as m from skipped x join skipped y on x.a = y.a and x.b = y.b and x.word <> y.word
    union select x.word, y.word, y.n from skipped x join words y on x.a || x.b = y.word
    union select y.word, x.word, x.n from skipped x join words y on x.a || x.b = y.word
), best as materialized (
    select word, count(*) as n_near, max(m) as m, arg_min(other, (-m, other)) as other from near group by word
), formed as materialized (
    select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.m >= 10 * w.n then b.other end as form
    from words w left join best b on w.word = b.word
), chain as (
    select word, word as root, form as next from formed
    union all select c.word, f.word, f.form from chain c join formed f on c.next = f.word
)
select f.word, f.form, c.root, f.n, f.n_near, g.n as form_n
from formed f join chain c on c.word = f.word and c.next is null left join words g on g.word = f.form
"""


def _op13_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Ten rounds, one after the other, comparing every vector with every centroid."""
    parts = ["""vectors as materialized (
    select row_number() over () as row, vec_id, list_transform(v, lambda x: cast(floor(1024 * x) as bigint)) as v
    from (select vec_id, cast(embedding as double[]) as v from embeddings)
    where len(v) = 64 and len(list_filter(v, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
    select cast(row_number() over (order by h, v) - 1 as integer) as c, v from (select sha256('3:' || vec_id) as h, v from vectors) order by h, v limit %d
)""" % clusters]
    nearest = """a{i} as materialized (
    select row, vec_id, v, arg_min(c, (d, c)) as c, min(d) as d from (
        select x.row, x.vec_id, x.v, c.c, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from vectors x, c{i} c)
    group by row, vec_id, v
)"""
    mean = """c{j} as materialized (
    select o.c, coalesce(m.v, o.v) as v from c{i} o left join (
        select c, list(cast((s - (((s % n) + n) % n)) // n as bigint) order by k) as v from (
            select c, k, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(64)) as k from a{i}) group by c, k)
        group by c) m on o.c = m.c
)"""
    for i in range(rounds):
        parts += [nearest.format(i=i), mean.format(i=i, j=i + 1)]
    parts.append(nearest.format(i=rounds))
    return "with " + ", ".join(parts) + f"""
select vec_id, a.c as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
    sha256(array_to_string(k.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} k on a.c = k.c
"""


ORACLES: dict[str, str] = {"op2_chat": OP2_SQL, "op11_variants": OP11_SQL, "op13_centroids": _op13_sql()}
