"""Queries on slots, families, event logs and the star schema: state of logs, counts, quotas, pivots, splits, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tezgah.functions import text as tx
from tezgah.operators import logs, nested, quota
from tezgah.plans import sql
from tezgah.plans.retrieval import one_family, split, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested_all(spark, d)


def nested_all(spark: SparkSession, d: str, body: bool = False) -> DataFrame:
    families = nested.nested_objects(table(spark, d, "families"), "family_id", "metadata_json", "families", body)
    return families.unionByName(nested.nested_objects(table(spark, d, "slots"), "slot_id", "contract_json", "slots", body))


@query()
def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Objects and records of each kind of nested object."""
    return nested.kinds(nested_all(spark, d)).groupBy("src", "kind").agg(F.count("*").alias("objects"), F.countDistinct("record_id").alias("records"))


@query()
def p2_hard_profile(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of one kind, with its columns."""
    slots = nested.nested_objects(table(spark, d, "slots"), "slot_id", "contract_json", "slots", True)
    return nested.flat_table(slots, "$.hard_profile[]", "slot string, subtype string, focus string").distinct()


@query()
def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of all kinds, as key/value rows."""
    return nested.flat_fields(nested_all(spark, d, True)).distinct()


# ------------------------------------------------------------------ counts, quotas, slices

_AXES = {"families": ["split_name", "target_feature", "domain", "register_name", "polarity", "temporal_frame", "scope_target", "generator_id"], "slots": ["target_split", "generator_id", "target_feature", "domain", "register_name", "generalization_bucket", "status"]}


def _axis_sql(t: str) -> str:
    return " union all ".join(f"select '{a}' as axis, {a} as value, count(*) as n from {t} group by {a}" for a in _AXES[t])


@query(_axis_sql("families"))
def family_axis_counts(spark: SparkSession, d: str) -> DataFrame:
    return quota.axis_counts(table(spark, d, "families"), _AXES["families"])


@query(_axis_sql("slots"))
def slot_axis_counts(spark: SparkSession, d: str) -> DataFrame:
    return quota.axis_counts(table(spark, d, "slots"), _AXES["slots"])


_KEY = "lower(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"


@query(f"""with a as (select {_KEY.format('domain')} as category, count(distinct slot_id) as n from slots where domain is not null group by 1), t as (select {_KEY.format('category')} as category, target_share from quota_targets where axis = 'domain'), n as (select count(distinct slot_id) as total from slots)
  select category, coalesce(n, 0) as actual, round_even(coalesce(target_share, 0) * total, 0)::bigint as expected, coalesce(n, 0) - round_even(coalesce(target_share, 0) * total, 0)::bigint as difference from a full join t using (category) cross join n""")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")).alias("category")
    s = table(spark, d, "slots")
    actual = s.where("domain is not null").groupBy(key("domain")).agg(F.countDistinct("slot_id").alias("n"))
    total = s.agg(F.countDistinct("slot_id")).first()[0]
    targets = table(spark, d, "quota_targets").where("axis = 'domain'").select(key("category"), "target_share")
    return quota.quota_check(actual, targets, total)


@query("select count(*) as cells, sum(n)::bigint as records from (select target_feature, domain, register_name, generalization_bucket, count(*) as n from slots group by all)")
def coverage_cells(spark: SparkSession, d: str) -> DataFrame:
    """Distinct combinations of four columns; nulls are values."""
    cells = table(spark, d, "slots").groupBy("target_feature", "domain", "register_name", "generalization_bucket").agg(F.count("*").alias("n"))
    return cells.agg(F.count("*").alias("cells"), F.sum("n").alias("records"))


@query(f"select axis, value, count(n_chars) as n, round(avg(n_chars), 6) as mean from (select 'source' as axis, coalesce(source, 'unknown') as value, n_chars from documents union all select 'domain', coalesce(domain, 'unknown'), n_chars from documents union all select 'register_name', coalesce(register_name, 'unknown'), n_chars from documents) group by axis, value")
def document_slices(spark: SparkSession, d: str) -> DataFrame:
    t = quota.slice_means(table(spark, d, "documents"), ["source", "domain", "register_name"], "n_chars")
    return t.select("axis", "value", "n", F.round("mean", 6).alias("mean"))


@query("""with r as (select o.o_orderpriority as grp, count(*) over (partition by l_orderkey) as cnt, l_linenumber as pos from lineitem join orders o on o_orderkey = l_orderkey), c as (select grp, cnt, count(*) as total from r group by all),
  z as (select grp, cnt, total, unnest(range(1, cnt + 1)) as pos from c), n as (select grp, cnt, pos, count(*) as n from r group by all)
  select grp, cnt, pos, coalesce(n, 0) as n, max(coalesce(n, 0)) over w - min(coalesce(n, 0)) over w as spread, greatest(2, ceil(0.05 * total))::int as tolerance from z left join n using (grp, cnt, pos) window w as (partition by grp, cnt)""")
def position_balance(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    cnt = lines.groupBy("l_orderkey").agg(F.count("*").alias("cnt"))
    r = lines.join(cnt, "l_orderkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("grp")), "l_orderkey")
    b = quota.position_balance(r.select("grp", "cnt", F.col("l_linenumber").cast("bigint").alias("pos")), "grp", "cnt", "pos")
    return b.select("grp", "cnt", "pos", "n", "spread", "tolerance")


@query("select o_orderpriority as priority, round(avg(case when o_orderstatus = 'F' then o_totalprice end), 4) as f, round(avg(case when o_orderstatus = 'O' then o_totalprice end), 4) as o, round(avg(case when o_orderstatus = 'P' then o_totalprice end), 4) as p, round(avg(o_totalprice), 4) as mean, count(*) as n from orders group by 1")
def priority_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    p = o.groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    m = o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"))
    return p.join(m, "priority").select("priority", *[F.round(s, 4).alias(s.lower()) for s in ("F", "O", "P")], "mean", "n")


@query("""with s as (select n_name, avg(s_acctbal) as bal, count(*)::double as n from supplier join nation on s_nationkey = n_nationkey group by n_name), c as (select n_name, avg(c_acctbal) as cbal from customer join nation on c_nationkey = n_nationkey group by n_name),
  x as (select n_name, bal, n, coalesce(cbal, avg(cbal) over ()) as cbal from s left join c using (n_name)),
  k as (select n_name, case when max(bal) over () = min(bal) over () then 0.5 else (bal - min(bal) over ()) / (max(bal) over () - min(bal) over ()) end as a, case when max(n) over () = min(n) over () then 0.5 else (n - min(n) over ()) / (max(n) over () - min(n) over ()) end as b, case when max(cbal) over () = min(cbal) over () then 0.5 else (cbal - min(cbal) over ()) / (max(cbal) over () - min(cbal) over ()) end as c from x)
  select n_name, round(0.5::double * a + 0.3::double * b + 0.2::double * c, 6) as score from k""")
def minmax_selection(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.avg("s_acctbal").alias("bal"), F.count("*").cast("double").alias("n"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.avg("c_acctbal").alias("cbal"))
    x = s.join(c, "n_name", "left")
    mean = x.agg(F.avg("cbal").alias("m"))
    k = quota.scaled(x.crossJoin(F.broadcast(mean)).withColumn("cbal", F.coalesce("cbal", "m")).drop("m"), ["bal", "n", "cbal"])
    return k.select("n_name", F.round(0.5 * F.col("bal_scaled") + 0.3 * F.col("n_scaled") + 0.2 * F.col("cbal_scaled"), 6).alias("score"))


@query("select coalesce(source, 'unknown') as source, median(n_chars)::double as middle, list_sort(list(n_chars))[count(*) // 2 + 1] as upper_middle from documents where n_chars is not null group by 1")
def median_variants(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the two middle values, and the upper one of them. The latter is the discrete percentile just above one half."""
    x = table(spark, d, "documents").where("n_chars is not null").withColumn("source", F.coalesce("source", F.lit("unknown")))
    n = x.groupBy("source").agg(F.count("*").alias("n"), F.percentile("n_chars", 0.5).alias("middle"))
    hist = x.groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)
    up = hist.withColumn("upto", F.sum("c").over(w)).join(n, "source").where(F.col("upto") >= F.expr("n div 2 + 1")).groupBy("source", "middle").agg(F.min("n_chars").alias("upper_middle"))
    return up.select("source", "middle", "upper_middle")


@query("select user_id from events group by user_id having count(distinct event_type) = (select count(distinct event_type) from events)")
def universal_users(spark: SparkSession, d: str) -> DataFrame:
    """Relational division: users with every type of event."""
    e = table(spark, d, "events").select("user_id", "event_type").where("event_type is not null").distinct()
    kinds = e.agg(F.countDistinct("event_type").alias("k"))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).join(F.broadcast(kinds), F.col("n") == F.col("k")).select("user_id")


# ------------------------------------------------------------------ logs and registry


@query("""with x as (select *, row_number() over (partition by slot_id order by updated_at desc nulls last, attempt_batches desc nulls last, status desc nulls last) as i from (select distinct slot_id, updated_at, attempt_batches, status from slots where slot_id is not null)) select slot_id, status, attempt_batches, updated_at from x where i = 1""")
def latest_slots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "slots").where("slot_id is not null").select("slot_id", "updated_at", "attempt_batches", "status")
    return logs.latest(s, ["slot_id"], ["updated_at", "attempt_batches", "status"]).select("slot_id", "status", "attempt_batches", "updated_at")


_STATE = """e as (select distinct event_id, slot_id, event_type, created_at from slot_events where slot_id is not null),
  o as (select *, row_number() over (partition by slot_id order by created_at desc nulls last, event_id desc, event_type desc nulls last) as i from e),
  st as (select slot_id, any_value(event_type) filter (where i = 1) as state, any_value(created_at) filter (where i = 1) as since, count(*) as events, count(*) filter (where event_type = 'reserved') as reservations, max(created_at) filter (where event_type = 'reserved') as reserved_at from o group by slot_id)"""


@query(f"with {_STATE} select * from st")
def slot_state(spark: SparkSession, d: str) -> DataFrame:
    return logs.state(table(spark, d, "slot_events"))


@query("""with x as (select *, row_number() over (partition by slot_id order by updated_at desc nulls last, attempt_batches desc nulls last, status desc nulls last, reserved_at desc nulls last) as i from (select distinct slot_id, updated_at, attempt_batches, status, reserved_at from slots where slot_id is not null))
  select slot_id, reserved_at from x where i = 1 and status = 'reserved' and reserved_at < (select max(created_at) from slot_events) - interval 21600 second""")
def stale_reservations(spark: SparkSession, d: str) -> DataFrame:
    """Slots whose latest version is a reservation older than six hours when the log ends."""
    now = table(spark, d, "slot_events").agg(F.max("created_at")).first()[0]
    s = table(spark, d, "slots").where("slot_id is not null").select("slot_id", "updated_at", "attempt_batches", "status", "reserved_at")
    last = logs.latest(s, ["slot_id"], ["updated_at", "attempt_batches", "status", "reserved_at"]).withColumnRenamed("status", "state")
    return logs.stale(last, 21_600, F.lit(now)).select("slot_id", "reserved_at")


@query("select slot_id, actor, event_id, event_type from (select *, row_number() over (partition by slot_id, actor order by event_id, event_type nulls first) as i from (select distinct slot_id, actor, event_id, event_type from slot_events)) where i = 1")
def first_event_per_actor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slot_events").select("slot_id", "actor", "event_id", "event_type")
    return logs.first_per_key(e, ["slot_id", "actor"], ["event_id"])


@query("""with t as (select family_id, created_at, coalesce(domain, '') as domain, coalesce(polarity, '') as polarity from families where family_id is not null), x as (select *, row_number() over (partition by family_id order by created_at desc nulls last, domain desc, polarity desc) as i from t) select family_id, created_at, domain, polarity from x where i = 1""")
def family_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Late re-ingested rows replace earlier ones."""
    f = table(spark, d, "families").where("family_id is not null").select("family_id", "created_at", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("polarity", F.lit("")).alias("polarity"))
    first = logs.first_per_key(f, ["family_id"], ["created_at"])
    return logs.upsert(first, f, ["family_id"], "created_at")


@query("select distinct slot_id, target_feature from slots s where slot_id is not null and not exists (select 1 from families f where f.slot_id = s.slot_id)")
def pending_slots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "slots").where("slot_id is not null").select("slot_id", "target_feature").distinct()
    return s.join(table(spark, d, "families").select("slot_id"), "slot_id", "left_anti")


_HOLD = f"""f as (select *, {sql.SPLIT} as side from families), u as (select side, 'lemma' as axis, {sql.low('trim(critical_lemma)')} as key from f where critical_lemma is not null union select side, 'template', {sql.low('trim(template_id)')} from f where template_id is not null union
  select side, 'chain', {sql.low('trim(morph_chain_signature)')} from f where morph_chain_signature is not null union select side, 'domain_register', {sql.low('trim(domain)')} || '|' || {sql.low('trim(register_name)')} from f where domain is not null and register_name is not null)"""


@query(f"with {_HOLD} select axis, key from u where side = 'development' and key <> '' intersect select axis, key from u where side = 'sealed_test'")
def holdout_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Keys that development and sealed test share, per axis."""
    k = tx.tr_key
    f = table(spark, d, "families").withColumn("side", split())
    pair = F.when(F.col("domain").isNotNull() & F.col("register_name").isNotNull(), F.concat_ws("|", k("domain"), k("register_name")))
    one = lambda c: F.when(F.col(c).isNotNull(), k(c))
    axes = {"lemma": one("critical_lemma"), "template": one("template_id"), "chain": one("morph_chain_signature"), "domain_register": pair}
    u = f.select("side", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("key")) for a, c in axes.items()])).alias("e")).select("side", "e.*").where("key is not null and key <> ''")
    return u.where("side = 'development'").select("axis", "key").intersect(u.where("side = 'sealed_test'").select("axis", "key"))


@query(f"select {sql.low('trim(critical_lemma)')} as lemma, count(distinct family_id) as families, count(distinct source_dataset) as sources, min(family_id) as first_family from {sql.FAM} where critical_lemma is not null group by 1 having count(distinct source_dataset) > 1 and bool_or(source_dataset = 'current_run')")
def registry_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas of the current run that another source claims as well."""
    f = one_family(spark, d, "critical_lemma", "source_dataset").where("critical_lemma is not null")
    x = f.groupBy(tx.tr_key("critical_lemma").alias("lemma")).agg(F.count("*").alias("families"), F.countDistinct("source_dataset").alias("sources"), F.min("family_id").alias("first_family"), F.bool_or(F.col("source_dataset") == "current_run").alias("own"))
    return x.where("sources > 1 and own").drop("own")


@query("select * from (select target_feature, critical_lemma, max(created_at) as last_used, row_number() over (partition by target_feature order by max(created_at) desc, critical_lemma) as place from families where target_feature is not null and critical_lemma is not null group by 1, 2) where place <= 24")
def recent_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """The 24 lemmas used last with each feature, as a generation context lists them."""
    x = table(spark, d, "families").where("target_feature is not null and critical_lemma is not null").groupBy("target_feature", "critical_lemma").agg(F.max("created_at").alias("last_used"))
    w = Window.partitionBy("target_feature").orderBy(F.desc("last_used"), "critical_lemma")
    return x.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 24")


_VOTES = "v as (select distinct on (slot_id, actor) slot_id, actor, event_type as vote from (select distinct event_id, slot_id, actor, event_type from slot_events where slot_id is not null and actor is not null and event_type in ('accepted', 'rejected')) order by slot_id, actor, event_id desc, event_type desc)"


@query(f"""with {_VOTES}, n as (select slot_id, vote, count(*) as n from v group by all), m as (select slot_id, sum(n)::bigint as votes, max(n) as most, max_by(vote, n * 1000 + case vote when 'rejected' then 1 else 0 end) as top from n group by slot_id)
  select slot_id, reviewers, votes, case when reviewers >= 2 and most * 2 > votes then top end as decision from m join (select slot_id, count(distinct actor) as reviewers from v group by slot_id) using (slot_id)""")
def majority_votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slot_events").where("slot_id is not null and actor is not null and event_type in ('accepted', 'rejected')").select("slot_id", "actor", "event_id", "event_type")
    v = logs.latest(e, ["slot_id", "actor"], ["event_id", "event_type"]).select("slot_id", "actor", F.col("event_type").alias("vote"))
    return quota.majority(v, "slot_id", "actor", "vote", 2)


@query("select actor, event_type, n from (select actor, event_type, count(*) as n, row_number() over (partition by actor order by count(*) desc, min(event_id)) as i from slot_events where actor is not null and event_type is not null group by 1, 2) where i = 1")
def usual_event(spark: SparkSession, d: str) -> DataFrame:
    """Each actor's most common event; among equally common ones the one seen first."""
    n = table(spark, d, "slot_events").where("actor is not null and event_type is not null").groupBy("actor", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    best = n.groupBy("actor").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "event_type")).alias("b"))
    return best.select("actor", F.col("b.event_type").alias("event_type"), F.col("b.n").alias("n"))


@query("select event_id, slot_id, event_type, occurrence from (select event_id, slot_id, event_type, row_number() over (partition by slot_id, event_type order by event_id) - 1 as occurrence from (select distinct event_id, slot_id, event_type from slot_events where slot_id is not null))")
def event_occurrences(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slot_events").where("slot_id is not null").select("event_id", "slot_id", "event_type").distinct()
    return logs.occurrence_rank(e, ["slot_id", "event_type"], ["event_id"]).withColumn("occurrence", F.col("occurrence").cast("bigint"))


@query("select code, count(*) as n, count(distinct slot_id) as slots from (select slot_id, unnest(from_json(last_error_json, '[\"VARCHAR\"]')) as code from slots where json_valid(last_error_json) and json_type(last_error_json) = 'ARRAY') group by code")
def problem_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "slots").select("slot_id", F.explode(F.from_json("last_error_json", "array<string>")).alias("code"))
    return s.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("slot_id").alias("slots"))


@query("""with e as (select distinct event_id, event_type, actor, payload_json from slot_events), p as (select event_type, coalesce(actor, 'unknown') as actor, payload_json is not null as given, coalesce(json_valid(payload_json), false) as sound, case when json_valid(payload_json) then try_cast(json_extract_string(payload_json, '$.confidence') as double) end as confidence from e)
  select event_type, actor, count(*) as events, count(*) filter (where given and not sound) as damaged, count(confidence) as judged, round(avg(confidence), 6) as mean_confidence, min(confidence) as min_confidence from p group by 1, 2""")
def judge_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Events, damaged payloads and the confidence stated in the sound ones, by type and actor."""
    e = table(spark, d, "slot_events").select("event_id", "event_type", "actor", "payload_json").distinct()
    sound = F.coalesce(F.try_parse_json("payload_json").isNotNull(), F.lit(False))
    x = e.select("event_type", F.coalesce("actor", F.lit("unknown")).alias("actor"), (F.col("payload_json").isNotNull() & ~sound).alias("bad"), F.when(sound, F.expr("try_cast(get_json_object(payload_json, '$.confidence') as double)")).alias("c"))
    return x.groupBy("event_type", "actor").agg(F.count("*").alias("events"), F.count_if("bad").alias("damaged"), F.count("c").alias("judged"), F.round(F.avg("c"), 6).alias("mean_confidence"), F.min("c").alias("min_confidence"))


@query("select component, count(*) as n, count(distinct family_id) as families from (select family_id, unnest(list_filter(string_split(target_feature, '.'), lambda x: trim(x) <> '')) as component from families where target_feature is not null) group by 1")
def feature_components(spark: SparkSession, d: str) -> DataFrame:
    """The parts of composed features."""
    parts = F.explode(F.filter(F.split("target_feature", r"\."), lambda x: F.trim(x) != ""))
    return table(spark, d, "families").select("family_id", parts.alias("component")).groupBy("component").agg(F.count("*").alias("n"), F.countDistinct("family_id").alias("families"))


# ------------------------------------------------------------------ splits, manifests


@query("""with n as (select lang, source, count(*) as size from documents group by all), r as (select d.doc_id, d.lang, d.source, n.size, row_number() over (partition by d.lang, d.source order by sha256('7|' || d.doc_id), d.doc_id) as i from documents d join n on n.lang is not distinct from d.lang and n.source is not distinct from d.source)
  select doc_id, case when i <= case when size >= 4 then greatest(1, round_even(0.15 * size, 0)) else 0 end then 'dev' else 'train' end as split from r""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return quota.stratified(docs, ["lang", "source"], "doc_id", 0.15, 7).select("doc_id", "split")


@query(f"select 'text' as kind, sha256(text) as key, count(*) as n from heldout_items where text is not null group by 2 union all select 'lemma', {sql.low('trim(critical_lemma)')}, count(*) from families where critical_lemma is not null and {sql.SPLIT} = 'sealed_test' group by 2")
def holdout_manifest(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "heldout_items").where("text is not null").select(F.lit("text").alias("kind"), F.sha2("text", 256).alias("key"))
    m = table(spark, d, "families").where(F.col("critical_lemma").isNotNull() & (split() == "sealed_test")).select(F.lit("lemma").alias("kind"), tx.tr_key("critical_lemma").alias("key"))
    return t.unionByName(m).groupBy("kind", "key").agg(F.count("*").alias("n"))


@query("select distinct slot_id, left(sha256('13|' || slot_id), 16) as seed_hex, left(sha1(coalesce(contract_json, '')), 8) as cache_key, regexp_replace(target_feature, '[^a-zA-Z0-9]+', '_', 'g') as slug from slots where slot_id is not null")
def slot_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slots").where("slot_id is not null").select("slot_id", F.left(tx.canonical_sha(F.lit("13"), F.col("slot_id")), F.lit(16)).alias("seed_hex"), F.left(F.sha1(F.coalesce("contract_json", F.lit(""))), F.lit(8)).alias("cache_key"), tx.slug("target_feature").alias("slug")).distinct()
