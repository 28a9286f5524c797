"""Queries on rankings by candidate, error tables, assembly and repair of texts, reports and orders. Each Spark query stands beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tezgah.functions import text as tx
from tezgah.operators import rank
from tezgah.plans import sql
from tezgah.plans.retrieval import _CLOSED, closed, one_query, pools, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = oracle
        return f

    return add


# ------------------------------------------------------------------ rankings

_ORDER = "row_number() over (partition by qid order by s desc, cid)"


@query(f"with {_CLOSED} select pool, qid, cid, role, s as score, {_ORDER} as rank, round(s - g, 6) as delta from k join gs using (qid)")
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of each closed pool in order, with the distance of their score to gold's."""
    x = closed(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "cid")).cast("bigint"))
    return x.select("pool", "qid", "cid", "role", F.col("s").alias("score"), "rank", F.round(F.col("s") - F.col("g"), 6).alias("delta"))


@query(f"with {_CLOSED}, r as (select k.*, {_ORDER} as rank from k) select qid, min(rank) filter (where role = 'positive') as gold_rank, max(cid) filter (where rank = 1) as first, max(cid) filter (where rank = 2) as second, max(role) filter (where rank = 1) as first_role from r group by qid")
def gold_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Per query, gold's rank in its closed pool and the two candidates on top, in one aggregation without a second sort."""
    x = candidate_ranking(spark, d)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return x.groupBy("qid").agg(F.min(F.when(F.col("role") == "positive", F.col("rank"))).alias("gold_rank"), at(1, "cid").alias("first"), at(2, "cid").alias("second"), at(1, "role").alias("first_role"))


@query(f"with {_CLOSED}, r as (select k.*, {_ORDER} as rank from k), b as (select qid, max(s) as best, arg_max(cid, struct_pack(a := s, b := -cid)) as winner from k where role <> 'positive' group by qid) select qid, rank as gold_rank, winner, round(g - best, 6) as delta from r join gs using (qid) join b using (qid) where role = 'positive' and rank > 1")
def misses(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose gold isn't on top: what beat it and by how much."""
    x = candidate_ranking(spark, d)
    gold = x.where("role = 'positive' and rank > 1").select("qid", F.col("rank").alias("gold_rank"))
    best = x.where("role <> 'positive'").groupBy("qid").agg(F.max(F.struct("score", (-F.col("cid")).alias("c"), "cid", "delta")).alias("b"))
    return gold.join(best, "qid").select("qid", "gold_rank", F.col("b.cid").alias("winner"), F.round(-F.col("b.delta"), 6).alias("delta"))


@query(f"with {_CLOSED}, b as (select qid, max(s) as best from k where role <> 'positive' group by qid) select qid, round(g - best, 6) as margin from gs join b using (qid) where g >= best and g - best < 0.05")
def fragile_hits(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose gold wins by less than 0.05."""
    m = closed(spark, d).where("role <> 'positive'").groupBy("qid").agg((F.first("g") - F.max("s")).alias("margin"))
    return m.where("margin >= 0 and margin < 0.05").select("qid", F.round("margin", 6).alias("margin"))


@query(f"with {_CLOSED} select model, role, count(*) as n, round(avg(case when m > 0 then 1.0 else 0.0 end), 6) as accuracy, round(avg(m), 6) as mean_margin from (select 'first_half' as model, role, g1 - s1 as m from k join gs using (qid) where role <> 'positive' union all select 'second_half', role, g2 - s2 from k join gs using (qid) where role <> 'positive') group by all")
def subtype_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Per model and role of the candidate: pairs, strict accuracy and mean margin."""
    x = closed(spark, d).where("role <> 'positive'").select("role", (F.col("g1") - F.col("s1")).alias("first_half"), (F.col("g2") - F.col("s2")).alias("second_half")).unpivot(["role"], ["first_half", "second_half"], "model", "m")
    return x.groupBy("model", "role").agg(F.count("*").alias("n"), F.round(F.avg((F.col("m") > 0).cast("double")), 6).alias("accuracy"), F.round(F.avg("m"), 6).alias("mean_margin"))


@query(f"with {_CLOSED}, t as (select qid, g as sap, max(s) filter (where role = 'hard') as sad, ql from k join gs using (qid) group by qid, g, ql) select ql as category, count(*) as triplets, count(*) filter (where sap > sad) as correct, round(avg(case when sap > sad then 1.0 else 0.0 end), 6) as accuracy, round(avg(sap - sad), 6) as margin, round(avg(case when qid % 200 = 0 then case when sap > sad then 1.0 else 0.0 end end), 6) as pilot_accuracy from t where sad is not null group by ql")
def triplet_probe(spark: SparkSession, d: str) -> DataFrame:
    """Anchor, positive and hardest distractor of each query: accuracy and margin by category, and over the pilot rows."""
    x = closed(spark, d).groupBy("qid", "ql").agg(F.first("g").alias("p"), F.max(F.when(F.col("role") == "hard", F.col("s"))).alias("n")).where("n is not null")
    right = (F.col("p") > F.col("n")).cast("double")
    return x.groupBy(F.col("ql").alias("category")).agg(F.count("*").alias("triplets"), F.count_if(F.col("p") > F.col("n")).alias("correct"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.col("p") - F.col("n")), 6).alias("margin"), F.round(F.avg(F.when(F.col("qid") % 200 == 0, right)), 6).alias("pilot_accuracy"))


@query(f"with {_CLOSED}, m as (select ql, count(*) filter (where g1 > s1) as a, count(*) filter (where g2 > s2) as b, count(*) as n from k join gs using (qid) where role <> 'positive' group by ql) select ql as label, n, a as first_half, b as second_half, row_number() over (order by case when a > 0 then b end desc nulls last, a desc nulls last, ql) as place from m")
def model_order(spark: SparkSession, d: str) -> DataFrame:
    """Labels by two keys, descending, missing ones last."""
    x = closed(spark, d).where("role <> 'positive'").groupBy(F.col("ql").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("g1") > F.col("s1")).alias("first_half"), F.count_if(F.col("g2") > F.col("s2")).alias("second_half"))
    key = F.when(F.col("first_half") > 0, F.col("second_half"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(key.desc_nulls_last(), F.desc_nulls_last("first_half"), "label")).cast("bigint"))  # a row per label


# ------------------------------------------------------------------ texts: sets, pairs across pools


@query(f"with {sql.POOLS}, x as (select pool, cid, list_distinct({sql.tok('query')}) as a, list_distinct({sql.tok('text')}) as b from cand) select pool, cid, len(list_filter(a, lambda w: not list_contains(b, w))) + len(list_filter(b, lambda w: not list_contains(a, w))) as differing, len(list_filter(a, lambda w: not list_contains(b, w))) = 0 as contained, list_sort(a) = list_sort(b) as equal_sets from x")
def pool_token_sets(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric difference of the token sets, and whether the query's is contained in or equal to the candidate's."""
    x = pools(spark, d).select("pool", "cid", F.array_distinct(tx.tokens("query")).alias("a"), F.array_distinct(tx.tokens("text")).alias("b"))
    apart = F.array_union(F.array_except("a", "b"), F.array_except("b", "a"))
    return x.select("pool", "cid", F.size(apart).cast("bigint").alias("differing"), (F.size(F.array_except("a", "b")) == 0).alias("contained"), (F.array_sort("a") == F.array_sort("b")).alias("equal_sets"))


@query(f"""with {sql.POOLS}, r as (select cid as id, pool, case when cid = gold then 'gold' else 'negative' end as role, {sql.norm('text')} as key from cand join golds using (pool) union all select distinct qid, pool, 'query', {sql.norm('query')} from cand)
  select a.id as id_a, b.id as id_b, a.role as role_a, b.role as role_b from r a join r b on a.key = b.key and a.pool <> b.pool and a.id < b.id and not (a.role = 'query' and b.role = 'query') where a.key <> ''""")
def cross_pool_copies(spark: SparkSession, d: str) -> DataFrame:
    """Records of different pools with the same tokens, by role; pairs of queries aside. Copies meet by the hash of their text."""
    c = pools(spark, d)
    gold = c.groupBy("pool").agg(F.min("cid").alias("gold"))
    r = c.join(gold, "pool").select(F.col("cid").alias("id"), "pool", F.when(F.col("cid") == F.col("gold"), "gold").otherwise("negative").alias("role"), tx.normalised("text").alias("key"))
    r = r.unionByName(c.select(F.col("qid").alias("id"), "pool", F.lit("query").alias("role"), tx.normalised("query").alias("key")).distinct()).where("key <> ''")
    a, b = r.alias("a"), r.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.pool") != F.col("b.pool")) & (F.col("a.id") < F.col("b.id")) & ((F.col("a.role") != "query") | (F.col("b.role") != "query")))
    return met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.role").alias("role_a"), F.col("b.role").alias("role_b"))


# ------------------------------------------------------------------ assembly and repair of texts

_PARTS = f"x as (select doc_id, source, domain, register_name, {sql.tok('text')} as t from documents where text is not null)"


@query(f"with {_PARTS} select doc_id, coalesce(source, 'none') || '_' || lpad((row_number() over (partition by source order by doc_id))::varchar, 6, '0') as candidate_id, array_to_string(list_filter([array_to_string(t[1:3], ' '), coalesce(domain, ''), array_to_string(t[4:9], ' ')], lambda w: w <> ''), ' ') as assembled from x")
def assembled_items(spark: SparkSession, d: str) -> DataFrame:
    """Frame, core and frame joined where they aren't empty, and a running number per role. Numbers come from counts of ranges of ids, so that a
    role of any size isn't sorted in one task."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "source", "domain", tx.tokens("text").alias("t"))
    part = lambda a, n: F.array_join(F.slice("t", a, n), " ")
    text = F.array_join(F.filter(F.array(part(1, 3), F.coalesce("domain", F.lit("")), part(4, 6)), lambda w: w != ""), " ")
    numbered = rank.running_number(x.withColumn("assembled", text).drop("t"), "source", "doc_id", "number")
    return numbered.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("_"), F.lpad(F.col("number").cast("string"), 6, "0")).alias("candidate_id"), "assembled")


@query("""with old as (select doc_id, text from documents where text is not null), patch as (select item_id as doc_id, text as core from heldout_items)
  select doc_id, coalesce(nullif(trim(core), ''), text) as text, nullif(trim(core), '') is not null and trim(core) <> text as changed, case when length(coalesce(nullif(trim(core), ''), text)) < length(text) then 'repaired' else 'kept' end as choice from old left join patch using (doc_id)""")
def repair_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a patch laid over them by id, where the patch isn't blank; whether it changed them; and the shorter of both versions chosen."""
    patch = table(spark, d, "heldout_items").select(F.col("item_id").alias("doc_id"), F.nullif(F.trim("text"), F.lit("")).alias("core"))
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "text").join(patch, "doc_id", "left")
    new = F.coalesce("core", "text")
    return x.select("doc_id", new.alias("text"), (F.col("core").isNotNull() & (F.coalesce("core", F.lit("")) != F.col("text"))).alias("changed"), F.when(F.length(new) < F.length("text"), "repaired").otherwise("kept").alias("choice"))


@query("select slot_id, slot_index, 'generator_x' as generator_id, struct_pack(template := template_id, contract := contract_sha256)::json::varchar as provenance from (select distinct slot_id, slot_index, template_id, contract_sha256 from slots where slot_index between 10 and 40 and slot_id is not null)")
def slot_range(spark: SparkSession, d: str) -> DataFrame:
    """Slots of a range of the plan with another generator, and where they come from."""
    s = table(spark, d, "slots").where("slot_index between 10 and 40 and slot_id is not null").select("slot_id", "slot_index", "template_id", "contract_sha256").distinct()
    made = F.to_json(F.struct(F.col("template_id").alias("template"), F.col("contract_sha256").alias("contract")), {"ignoreNullFields": "false"})
    return s.select("slot_id", "slot_index", F.lit("generator_x").alias("generator_id"), made.alias("provenance"))


@query("""with x as (select distinct generator_id as raw, lower(trim(generator_id)) as low from slots where generator_id is not null)
  select raw, case when starts_with(low, 'generator_a') then 'alpha' else coalesce(list_filter(regexp_split_to_array(low, '[^a-z0-9]+'), lambda t: t in ('a', 'b', 'c', 'd'))[1], regexp_split_to_array(low, '[^a-z0-9]+')[1]) end as family from x""")
def generator_families(spark: SparkSession, d: str) -> DataFrame:
    """Canonical family of a name: by its prefix, else by the first known part, else its first part."""
    x = table(spark, d, "slots").where("generator_id is not null").select(F.col("generator_id").alias("raw"), F.lower(F.trim("generator_id")).alias("low")).distinct()
    parts = F.split("low", "[^a-z0-9]+")
    return x.select("raw", F.when(F.col("low").startswith("generator_a"), "alpha").otherwise(F.coalesce(F.get(F.filter(parts, lambda t: t.isin("a", "b", "c", "d")), F.lit(0)), parts[0])).alias("family"))


@query(f"with f as (select domain, q._id, q.text, row_number() over (partition by domain order by length(q.text), q.text, q._id) as i from (select distinct domain, min(_id) as _id, text from (select f.domain, q._id, q.text from {sql.Q} q join {sql.FAM} f on f.family_id = q._id where q.text is not null and trim(f.domain) <> '') q group by domain, text) q) select domain, _id, i as place from f where i <= 2")
def exemplars(spark: SparkSession, d: str) -> DataFrame:
    """Per domain the two shortest different texts."""
    from tezgah.plans.retrieval import one_family

    x = one_query(spark, d).where("text is not null").join(one_family(spark, d, "domain").withColumnRenamed("family_id", "_id"), "_id").where("trim(domain) <> ''")
    one = x.groupBy("domain", "text").agg(F.min("_id").alias("_id"))
    return rank.first_rows(one.withColumn("n", F.length("text")), ["domain"], ["n", "text", "_id"], 2).select("domain", "_id", F.col("place").cast("bigint").alias("place"))


# ------------------------------------------------------------------ reports and orders

_LATEST = "(select * from (select *, row_number() over (partition by slot_id order by updated_at desc nulls last, coalesce(status, '') desc, coalesce(attempt_batches, -1) desc) as i from slots where slot_id is not null) where i = 1)"


def latest(spark: SparkSession, d: str) -> DataFrame:
    version = F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp")), F.coalesce("status", F.lit("")), F.coalesce("attempt_batches", F.lit(-1)), "status", "attempt_batches")
    x = table(spark, d, "slots").where("slot_id is not null").groupBy("slot_id").agg(F.max(version).alias("v"))
    return x.select("slot_id", F.col("v.status").alias("status"), F.col("v.attempt_batches").alias("attempt_batches"))


@query(f"select coalesce(status, 'none') as status, count(*) as slots, sum(coalesce(attempt_batches, 0)) as attempts, max(coalesce(attempt_batches, 0)) as most_attempts, count(*) filter (where attempt_batches >= 3) as many from {_LATEST} group by 1")
def attempt_report(spark: SparkSession, d: str) -> DataFrame:
    """Slots, attempts, and the most attempts of a slot by state."""
    n = F.coalesce("attempt_batches", F.lit(0))
    return latest(spark, d).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("slots"), F.sum(n).alias("attempts"), F.max(n).cast("bigint").alias("most_attempts"), F.count_if(F.col("attempt_batches") >= 3).alias("many"))


@query(f"select slot_id, status, row_number() over (order by status <> 'needs_review', slot_id) as place from {_LATEST} where status in ('needs_review', 'failed') order by place limit 100")
def review_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred slots to look at: those that need review first."""
    top = latest(spark, d).where(F.col("status").isin("needs_review", "failed")).select("slot_id", "status").orderBy(F.col("status") != "needs_review", "slot_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("status") != "needs_review", "slot_id")).cast("bigint"))  # a hundred rows


@query(f"with a as (select distinct slot_id, 'accepted' as said from slot_events where event_type = 'accepted' and slot_id is not null), r as (select slot_id, status from {_LATEST}) select coalesce(status, 'none') as status, count(*) as slots, count(said) as accepted_in_log, count(*) filter (where (status = 'accepted') = (said is not null)) as agree from r left join a using (slot_id) group by 1")
def log_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The registry's state against what the log says."""
    said = table(spark, d, "slot_events").where("event_type = 'accepted' and slot_id is not null").select("slot_id", F.lit("accepted").alias("said")).distinct()
    x = latest(spark, d).join(said, "slot_id", "left")
    return x.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("slots"), F.count("said").alias("accepted_in_log"), F.count_if((F.col("status") == "accepted") == F.col("said").isNotNull()).alias("agree"))


@query("select reason, event_type, count(*) as n, count(distinct slot_id) as slots from (select distinct event_id, event_type, slot_id, left(regexp_split_to_array(coalesce(json_extract_string(payload_json, '$.reason'), actor, 'none'), '[:(]')[1], 70) as reason from slot_events where event_type in ('rejected', 'failed') and (payload_json is null or json_valid(payload_json))) group by all")
def reject_report(spark: SparkSession, d: str) -> DataFrame:
    """Rejects by stage and the beginning of the reason; damaged payloads aside."""
    e = table(spark, d, "slot_events").where(F.col("event_type").isin("rejected", "failed") & (F.col("payload_json").isNull() | F.try_parse_json("payload_json").isNotNull()))
    said = F.coalesce(F.get_json_object("payload_json", "$.reason"), "actor", F.lit("none"))
    x = e.select("event_id", "event_type", "slot_id", F.left(F.split(said, "[:(]")[0], F.lit(70)).alias("reason")).distinct()
    return x.groupBy("reason", "event_type").agg(F.count("*").alias("n"), F.countDistinct("slot_id").alias("slots"))


@query(f"select slot_id, quota, case when i <= 5 then 'accepted' else 'reserve' end as part from (select l.slot_id, t.quota, row_number() over (partition by t.quota order by sha256(l.slot_id), l.slot_id) as i from {_LATEST} l join (select slot_id, max(coalesce(target_split, 'none')) as quota from slots where slot_id is not null group by 1) t using (slot_id) where status = 'accepted')")
def accepted_and_reserve(spark: SparkSession, d: str) -> DataFrame:
    """Of each split the first five accepted slots in a random order; the others are its reserve. The first five come from the first five of every task."""
    split = table(spark, d, "slots").where("slot_id is not null").groupBy("slot_id").agg(F.max(F.coalesce("target_split", F.lit("none"))).alias("quota"))
    x = latest(spark, d).where("status = 'accepted'").select("slot_id").join(split, "slot_id").withColumn("h", F.sha2("slot_id", 256))
    first = rank.first_rows(x, ["quota"], ["h", "slot_id"], 5).select("slot_id", F.lit("accepted").alias("part"))
    return x.join(F.broadcast(first), "slot_id", "left").select("slot_id", "quota", F.coalesce("part", F.lit("reserve")).alias("part"))


@query("select slot_id, count(distinct contract_sha256) as versions, count(distinct contract_sha256) > 1 as drifted from slots where slot_id is not null and contract_sha256 is not null group by 1")
def contract_drift(spark: SparkSession, d: str) -> DataFrame:
    """Slots whose contract is registered with different hashes: a sync of the plan inserts the others and refuses these."""
    s = table(spark, d, "slots").where("slot_id is not null and contract_sha256 is not null")
    n = F.countDistinct("contract_sha256")
    return s.groupBy("slot_id").agg(n.alias("versions"), (n > 1).alias("drifted"))


@query(f"select target_feature, count(*) as families, count(morph_chain_signature) as annotated, round(100.0 * count(morph_chain_signature) / count(*), 6) as coverage, count(*) filter (where contains(coalesce(morph_chain_signature, ''), target_feature)) as agree from families where family_id is not null and target_feature is not null group by 1")
def annotation_report(spark: SparkSession, d: str) -> DataFrame:
    """Families of each feature with an annotated chain, and chains that name the feature."""
    f = table(spark, d, "families").where("family_id is not null and target_feature is not null")
    c = F.count("morph_chain_signature")
    return f.groupBy("target_feature").agg(F.count("*").alias("families"), c.alias("annotated"), F.round(100.0 * c / F.count("*"), 6).alias("coverage"), F.count_if(F.contains(F.coalesce("morph_chain_signature", F.lit("")), F.col("target_feature"))).alias("agree"))


_HALVES = ["target_feature", "domain", "register_name", "generalization_bucket", "generator_id", "macro_phenomenon", "template_id", "status"]
_VERIFY = " union all ".join(f"select '{a}' as axis, coalesce({a}, 'none') as value, coalesce(target_split, 'none') as split, count(distinct slot_id) as slots from slots where slot_id is not null group by all" for a in _HALVES)


@query(f"with c as ({_VERIFY}) select axis, value, split, slots, round(slots / sum(slots) over (partition by axis, split), 9) as share from c")
def quota_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Counts and shares of all categories of eight axes in each split, in one pass over the slots."""
    axis = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(a, F.lit("none")).alias("value")) for a in _HALVES]))
    x = table(spark, d, "slots").where("slot_id is not null").select("slot_id", F.coalesce("target_split", F.lit("none")).alias("split"), axis.alias("a")).select("slot_id", "split", "a.*")
    n = x.groupBy("axis", "value", "split").agg(F.countDistinct("slot_id").alias("slots"))
    total = n.groupBy("axis", "split").agg(F.sum("slots").alias("total"))
    return n.join(total, ["axis", "split"]).select("axis", "value", "split", "slots", F.round(F.col("slots") / F.col("total"), 9).alias("share"))
