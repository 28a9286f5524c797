"""The queries of this package, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tezgah.llm import chunks, components, leak, near_dup, packing, quota, repetition


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "queries").select(F.col("_id").alias("id"), "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicates(_records(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per query and text class: its group, links and copies, and in how many templates the group's families stand."""
    groups = near_dup.near_duplicate_groups(_records(spark, d)).withColumnRenamed("id", "_id")
    template = _read(spark, d, "families").groupBy(F.col("family_id").alias("_id")).agg(F.max(components.template_key("template_id")).alias("template_key"))
    x = groups.join(template, "_id", "left")
    per = x.groupBy("group_id").agg(F.countDistinct("_id").alias("group_queries"), F.countDistinct("template_key").alias("group_templates"))
    return x.join(per, "group_id").select("_id", F.col("cls").alias("class_id"), "group_id", "links", "members", "template_key", "group_queries", "group_templates")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quota.quota_sample(_read(spark, d, "slots"), _read(spark, d, "quota_targets"))[1].where("short").select("axis", "category")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota.quota_sample(_read(spark, d, "slots"), _read(spark, d, "quota_targets"))[0]


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return quota.quota_sample(_read(spark, d, "slots"), _read(spark, d, "quota_targets"))[1]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = chunks.split_overlaps(_read(spark, d, "queries"), _read(spark, d, "families"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return chunks.overlap_report(_read(spark, d, "queries"), _read(spark, d, "families"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.broken(_read(spark, d, "families")).select("family_id")


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    return components.assign_splits(_read(spark, d, "families"), _read(spark, d, "split_targets"))


def p5_balance(spark: SparkSession, d: str) -> DataFrame:
    targets = _read(spark, d, "split_targets")
    return components.balance(components.assign_splits(_read(spark, d, "families"), targets), targets)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_read(spark, d, "documents"), _read(spark, d, "pack_specs"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    specs = _read(spark, d, "pack_specs")
    return packing.fill(packing.containers(_read(spark, d, "documents"), specs), specs)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(_read(spark, d, "documents"), _read(spark, d, "heldout_items")).select("doc_id", "item_id").distinct()


def p7_leaks_by_item(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked test item: documents that hold it, those with the exact phrase, and the largest share."""
    found = leak.leaks(_read(spark, d, "documents"), _read(spark, d, "heldout_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.count_if("exact").alias("exact_documents"), F.max("share").alias("max_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.heavy_documents(_read(spark, d, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of repeated wording of every document."""
    return repetition.repetition_report(_read(spark, d, "documents")).select("doc_id", "lang", "source", "n_words", "rep_words", "rep_share", "outlier")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_sample, p3_report, p4_found, p4_report, p5_found, p5_assignment, p5_balance, p6_containers, p6_fill, p7_found, p7_leaks_by_item, p8_found, p8_shares)}


_KEY = "nullif(lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g')), '')"
_P3 = """
with n as (select cast(floor(0.25 * count(distinct slot_id)) as bigint) as n from slots),
have as (
  {have}
)
select q.axis, q.category
from (select distinct axis, category, target_share, min_rows from quota_targets) q cross join n
left join have h on h.axis = q.axis and h.k = {key}
where coalesce(h.supply, 0) < greatest(q.min_rows, floor(q.target_share * n.n))
"""
_P5 = """
with recursive keyed as (
  select distinct family_id,
    case lower(trim(split_name)) when 'train' then 'train' when 'development' then 'development' when 'dev' then 'development'
      when 'sealed_test' then 'sealed_test' when 'test' then 'sealed_test' end as split,
    nullif(regexp_replace(strip_accents(lower(translate(critical_lemma, 'Iİı', 'iii'))), '[^a-z0-9]', '', 'g'), '') as l0,
    strip_accents(lower(translate(template_id, 'Iİı', 'iii'))) as t0
  from families where family_id is not null),
keys as (
  select family_id, 'l' || regexp_replace(l0, '(..)m[ae]k$', '\\1') as k from keyed where l0 not in ('na', 'none', 'null', 'nan', 'bilinmiyor', 'unknown', 'yok', 'belirsiz', 'undefined')
  union
  select family_id, 't' || regexp_replace(regexp_extract(t0, '^(.*?)[^a-z0-9]*[0-9]+[^a-z0-9]*$', 1), '[^a-z0-9]', '', 'g') || '.' || cast(regexp_extract(t0, '([0-9]+)[^a-z0-9]*$', 1) as bigint)
  from keyed where regexp_matches(t0, '^[a-z].*[0-9]+[^a-z0-9]*$')),
ties as (select distinct a.family_id as a, b.family_id as b from keys a join keys b using (k)),
reach(a, b) as (select a, b from ties union select r.a, t.b from reach r join ties t on r.b = t.a)
select distinct x.family_id from keyed x join reach r on r.a = x.family_id join keyed y on y.family_id = r.b
where x.split is not null and y.split is not null and x.split <> y.split
"""


#: Folded words of a text, plainly.
_WORDS = "regexp_extract_all(strip_accents(lower(translate(regexp_replace(coalesce({}, ''), '[''’‘`´ʼ]', '', 'g'), 'Iİı', 'iii'))), '[a-z0-9]+')"
#: All pairs of texts by all pairs of words. A word counts if any word of the other text is its partner, which is what a matching comes to where no two words of a text have the same partners.
_AGREE = f"""
with t as (select distinct _id, list_sort({_WORDS.format('text')}) as bag from queries where _id is not null),
b as (select row_number() over (order by _id, bag) as b, _id, bag, len(bag) as n from t where len(bag) > 0),
w as (select b, _id, n, unnest(bag) as word, generate_subscripts(bag, 1) as i from b),
v as (select distinct word, length(word) as l, regexp_full_match(word, '[0-9]+') as digits from w),
near as (select x.word as x, y.word as y from v x join v y on x.word = y.word or (abs(x.l - y.l) <= 2 and least(x.l, y.l) >= 4 and not x.digits and not y.digits and damerau_levenshtein(x.word, y.word) <= case when least(x.l, y.l) < 6 then 1 else 2 end)),
met as (select p.b as a, q.b as b, p._id as id_a, q._id as id_b, p.n as na, q.n as nb, p.i as i, q.i as j from w p join near on x = p.word join w q on q.word = y where p._id < q._id),
pairs as (select distinct id_a, id_b from (select a, b, id_a, id_b, na, nb, count(distinct i) as ca, count(distinct j) as cb from met group by all) where least(ca, cb) >= ceil(0.7 * greatest(na, nb) - 1e-9))
"""
_P4 = _AGREE + """, side as (select family_id, max(case lower(trim(regexp_replace(split_name, '[ -]+', '_', 'g'))) when 'train' then 't' when 'development' then 'e' when 'dev' then 'e' when 'sealed_test' then 'e' when 'test' then 'e' end) as side from families group by 1)
select id_a, id_b from pairs join side x on x.family_id = id_a join side y on y.family_id = id_b where x.side <> y.side"""
_P8 = f"""
with d as (select doc_id, {_WORDS.format('text')} as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5),
keys as (select doc_id, i, 5 as size, '5 ' || array_to_string(w[i:i+4], ' ') as key from p where i + 4 <= len(w)
  union all select doc_id, i, 8, k || ' ' || array_to_string(list_concat(w[i:i+k-1], w[i+k+1:i+7]), ' ') from p, range(0, 8) r(k) where i + 7 <= len(w)),
again as (select distinct doc_id, i, size from (select *, min(i) over (partition by doc_id, size, key) as first from keys) where i > first),
marked as (select doc_id, count(distinct place) as n from (select doc_id, unnest(range(i, i + size)) as place from again) group by 1)
select doc_id from marked join d using (doc_id) where n >= 0.3 * len(w)"""


def oracle_sql() -> dict[str, str]:
    axes = ("target_feature", "domain", "generalization_bucket", "generator_id")
    have = " union all ".join(f"select '{a}' as axis, {_KEY.format(a)} as k, count(distinct slot_id) as supply from slots where slot_id is not null group by 2" for a in axes)
    return {"p3_found": _P3.format(have=have, key=_KEY.format("q.category")), "p5_found": _P5.replace("\\\\", "\\"), "p1_found": _AGREE + "select id_a, id_b from pairs", "p4_found": _P4, "p8_found": _P8}
