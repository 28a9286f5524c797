"""Queries on texts, pools, similarity and ranking. Each Spark query stands beside its SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tezgah.functions import text as tx
from tezgah.functions import udfs
from tezgah.operators import quota, rank, similarity
from tezgah.plans import sql
from tezgah.session import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def one_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").where("_id is not null").groupBy("_id").agg(F.max("text").alias("text"))


FAMILY_COLUMNS = ["template_id", "critical_lemma", "split_name", "domain", "target_feature", "source_dataset", "semantic_frame_id", "generator_id"]


def one_family(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per family id: its latest version, by ``created_at``; of equally late ones the greatest row."""
    version = F.struct(F.coalesce("created_at", F.lit("1900-01-01").cast("timestamp")).alias("at"), *[F.coalesce(c, F.lit("")).alias(f"k{i}") for i, c in enumerate(FAMILY_COLUMNS)], *[F.col(c) for c in FAMILY_COLUMNS])
    return table(spark, d, "families").where("family_id is not null").groupBy("family_id").agg(F.max(version).alias("v")).select("family_id", *[F.col(f"v.{c}").alias(c) for c in columns])


def split(column: str = "split_name"):
    k = F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")
    return F.when(k == "train", "train").when(k.isin("development", "dev"), "development").when(k.isin("sealed_test", "test"), "sealed_test")


# ------------------------------------------------------------------ texts


@query(f"""select doc_id, len({sql.tok('text')}) as tokens, len({sql.wide('text')}) as wide_tokens, len(list_distinct({sql.tok('text')})) as distinct_tokens,
  len(regexp_extract_all({{s}}, '[.!?]+["''”’)]*(\\s|$)')) as sentences from documents""".replace("{s}", "replace(replace(replace(replace(replace(replace(replace(replace(trim(coalesce(text, '')), 'Dr.', 'Dr'), 'Prof.', 'Prof'), 'Doç.', 'Doç'), 'Sn.', 'Sn'), 'vb.', 'vb'), 'vs.', 'vs'), 'örn.', 'örn'), 'T.C.', 'TC')"))
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.size(tx.tokens(t)).cast("bigint").alias("tokens"), F.size(tx.tokens_wide(t)).cast("bigint").alias("wide_tokens"), F.size(F.array_distinct(tx.tokens(t))).cast("bigint").alias("distinct_tokens"), tx.sentence_count(t).cast("bigint").alias("sentences"))


@query(f"""select sha256({sql.norm('text')}) as text_key, count(distinct doc_id) as records, count(distinct source) as groups, min(doc_id) as first_record
  from documents where {sql.norm('text')} <> '' group by 1 having count(distinct doc_id) > 1""")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    return similarity.duplicate_groups(table(spark, d, "documents"), "text", "doc_id", "source")


@query("""select coalesce(source, 'unknown') as source, count(*) as documents,
  count(*) filter (where regexp_matches(text, '(?m)^\\s*(#|[-*] |```)|\\*\\*')) as markdown,
  count(*) filter (where regexp_matches(text, '<[a-zA-Z/][^>]*>')) as markup,
  count(*) filter (where len(list_filter(regexp_extract_all(lower(text), '[a-zçğıöşü]+'), lambda w: w in ('the', 'and', 'of', 'is', 'are', 'with', 'from', 'for'))) >= 2) as english
  from documents group by 1""")
def text_sanity(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda p: F.count_if(F.col("text").rlike(p))
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("documents"), flag(r"(?m)^\s*(#|[-*] |```)|\*\*").alias("markdown"), flag(r"<[a-zA-Z/][^>]*>").alias("markup"), F.count_if(F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-zçğıöşü]+"), F.lit(0)), lambda w: w.isin("the and of is are with from for".split()))) >= 2).alias("english"))


_ABLATION = f"""with x as (select q._id, q.text, regexp_replace(coalesce(f.critical_lemma, ''), 'm[ae]k$', '') as stem from {sql.Q} q join {sql.FAM} f on f.family_id = q._id where q.text is not null),
  p as (select *, case when stem = '' then 0 else strpos({sql.low('text')}, {sql.low('stem')}) end as place from x)
  select _id, regexp_replace(trim(case when place > 0 then substring(text, 1, place - 1) || '[MASK]' || substring(text, place + length(stem)) else text end), '\\s+', ' ', 'g') as masked,
  array_to_string(list_transform({sql.tok('text')}, lambda w: left(w, 5)), ' ') as prefixes, translate({sql.low('text')}, 'çğıöşü', 'cgiosu') as plain from p"""


@query(_ABLATION)
def ablations(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their critical stem masked, reduced to five-letter prefixes, and without Turkish letters."""
    x = one_query(spark, d).where("text is not null").join(one_family(spark, d, "critical_lemma").withColumnRenamed("family_id", "_id"), "_id")
    stem = F.regexp_replace(F.coalesce("critical_lemma", F.lit("")), "m[ae]k$", "")
    x = x.withColumn("stem", stem)
    masked = F.when(F.col("stem") == "", F.regexp_replace(F.trim("text"), r"\s+", " ")).otherwise(tx.mask_first("text", "stem"))
    return x.select("_id", masked.alias("masked"), tx.prefix_ablation("text").alias("prefixes"), tx.deascii("text").alias("plain"))


# ------------------------------------------------------------------ closed pools


def pools(spark: SparkSession, d: str) -> DataFrame:
    f = one_family(spark, d, "template_id", "critical_lemma").where("trim(template_id) <> ''")
    p = one_query(spark, d).where("text is not null").join(f.withColumnRenamed("family_id", "_id"), "_id").select(F.col("template_id").alias("pool"), F.col("_id").alias("cid"), "text", F.col("critical_lemma").alias("lemma"))
    ask = p.groupBy("pool").agg(F.min(F.struct("cid", F.col("text").alias("query"), F.col("lemma").alias("query_lemma"))).alias("q"), F.count("*").alias("n")).where("n > 1").select("pool", F.col("q.cid").alias("qid"), "q.query", "q.query_lemma")
    return p.join(ask, "pool").where("cid <> qid").select("pool", "cid", "qid", "query", "text", "query_lemma", "lemma")


@query(f"""with {sql.POOLS} select pool, cid, qid, round({sql.jac(sql.grams(sql.norm('query')), sql.grams(sql.norm('text')))}, 6) as char_3gram, round({sql.jac(sql.grams(sql.padded('query')), sql.grams(sql.padded('text')))}, 6) as padded_3gram,
  round({sql.over(sql.tok('query'), sql.tok('text'))}, 6) as word_overlap, round({sql.jac('list_distinct(' + sql.tok('query') + ')', 'list_distinct(' + sql.tok('text') + ')')}, 6) as word_jaccard,
  round({sql.over(sql.pre(sql.tok('query')), sql.pre(sql.tok('text')))}, 6) as prefix5, round({sql.over(sql.content_prefixes('query'), sql.content_prefixes('text'))}, 6) as content_prefixes from cand""")
def pool_similarity(spark: SparkSession, d: str) -> DataFrame:
    r = lambda x, n: F.round(x, 6).alias(n)
    return pools(spark, d).select(
        "pool", "cid", "qid", r(tx.jaccard(tx.char_ngrams("query"), tx.char_ngrams("text")), "char_3gram"), r(tx.text_similarity("query", "text"), "padded_3gram"), r(tx.word_overlap("query", "text"), "word_overlap"),
        r(tx.word_jaccard("query", "text"), "word_jaccard"), r(tx.prefix5_overlap("query", "text"), "prefix5"), r(tx.overlap(tx.content_prefixes("query"), tx.content_prefixes("text")), "content_prefixes"))


_CW, _P = sql.content_words("query"), sql.wide("text")


@query(f"""with {sql.POOLS}, w as (select pool, cid, {_CW} as q, {_P} as p from cand), e as (select pool, cid, len(q) as n, unnest(case when len(q) = 0 then [null] else q end) as a, p from w),
  h as (select pool, cid, n, case when a is null then 0 when len(list_filter(p, lambda b: starts_with(b, left(a, 4)) or starts_with(a, left(b, 4)))) > 0 then 1 else 0 end as hit from e)
  select pool, cid, case when n = 0 then 1.0 else round(sum(hit) / n, 6) end as content_overlap from h group by pool, cid, n""")
def pool_content_overlap(spark: SparkSession, d: str) -> DataFrame:
    return pools(spark, d).select("pool", "cid", F.round(tx.content_overlap("query", "text"), 6).alias("content_overlap"))


_BARE = "regexp_replace(translate({}, 'çğıöşü', 'cgiosu'), '[^a-z]', '', 'g')"
_SAME = "len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i)))"
_SOFT = _SAME.format(a="translate(a, 'bcdğ', 'pçtk')", b="translate(b, 'bcdğ', 'pçtk')")
_SUF = _SAME.format(a="reverse(a)", b="reverse(b)")


@query(f"""with {sql.POOLS}, x as (select pool, cid, {sql.low('query_lemma')} as a, {sql.low('lemma')} as b from cand where query_lemma is not null and lemma is not null)
  select pool, cid, {_SAME.format(a='a', b='b')} as prefix, {_SOFT} as soft_prefix, {_SUF} as suffix,
  {_SOFT} >= 2 and {_SOFT} >= 0.3 * least(length(a), length(b)) as stem, {_SUF} >= 3 and {_SUF} >= 0.4 * least(length(a), length(b)) as ending, levenshtein({_BARE.format('a')}, {_BARE.format('b')}) as letters from x""")
def pool_lemma_forms(spark: SparkSession, d: str) -> DataFrame:
    x = pools(spark, d).where("query_lemma is not null and lemma is not null").select("pool", "cid", tx.tr_lower("query_lemma").alias("a"), tx.tr_lower("lemma").alias("b"))
    big = lambda c, n: c.cast("bigint").alias(n)
    bare = lambda c: F.regexp_replace(F.translate(c, "çğıöşü", "cgiosu"), "[^a-z]", "")
    return x.select("pool", "cid", big(tx.common_prefix("a", "b"), "prefix"), big(tx.soft_prefix("a", "b"), "soft_prefix"), big(tx.common_suffix("a", "b"), "suffix"), tx.shares_stem("a", "b").alias("stem"), tx.shares_ending("a", "b").alias("ending"), big(F.levenshtein(bare("a"), bare("b")), "letters"))


@query(f"""with {sql.POOLS}, x as (select pool, cid, {sql.tok('query')} as a, {sql.tok('text')} as b from cand), k as (select *, list_distinct(list_concat(a, b)) as known from x)
  select pool, cid, levenshtein(array_to_string(list_transform(a, lambda w: chr((40 + list_position(known, w))::int)), ''), array_to_string(list_transform(b, lambda w: chr((40 + list_position(known, w))::int)), ''))::bigint as edits,
  coalesce(list_max(list_transform(range(1, len(a) + 1), lambda i: list_max(list_transform(range(i, len(a) + 1), lambda j: case when contains(' ' || array_to_string(b, ' ') || ' ', ' ' || array_to_string(a[i:j], ' ') || ' ') then j - i + 1 else 0 end)))), 0)::bigint as run from k""")
def pool_edits(spark: SparkSession, d: str) -> DataFrame:
    """Token edit distance and longest verbatim run of query and candidate."""
    x = pools(spark, d).select("pool", "cid", tx.tokens("query").alias("a"), tx.tokens("text").alias("b"))
    return x.select("pool", "cid", udfs.token_edit_distance("a", "b").cast("bigint").alias("edits"), udfs.verbatim_run("a", "b").cast("bigint").alias("run"))


@query()
def pool_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Sequence ratio of query and candidate, by an Arrow UDF over the pairs."""
    x = pools(spark, d).select("pool", "cid", tx.tokens("query").alias("a"), tx.tokens("text").alias("b"))
    return x.select("pool", "cid", F.round(udfs.sequence_ratio("a", "b"), 6).alias("ratio"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    p = written(pools(spark, d), "pools")
    x = p.join(rank.pool_bm25(p), ["pool", "cid"])
    pairs = {
        "longest": F.length("text").cast("double"), "most_tokens": F.size(tx.tokens("text")).cast("double"), "char_3gram": F.round(tx.jaccard(tx.char_ngrams("query"), tx.char_ngrams("text")), 9),
        "word_overlap": F.round(tx.word_overlap("query", "text"), 9), "prefix5": F.round(tx.prefix5_overlap("query", "text"), 9), "bm25": F.round("bm25", 6),
    }
    wide = x.select("pool", "cid", *[v.alias(k) for k, v in pairs.items()])
    return wide.unpivot(["pool", "cid"], list(pairs), "scorer", "score")


_TIES = f"""with {sql.POOLS}, {sql.SCORED}, g as (select s.pool, scorer, score as g from scored s join golds on golds.pool = s.pool and gold = cid),
  t as (select pool, scorer, count(*) filter (where score > g) as higher, count(*) filter (where score = g) as tied from scored join g using (pool, scorer) group by all),
  m as (select *, case when higher > 0 then 0.0 else 1.0 / tied end as top_probability, list_sum(list_transform(range(higher + 1, higher + tied + 1), lambda r: case when r <= 10 then 1.0::double / r else 0 end)) / tied as mrr_10,
    list_sum(list_transform(range(higher + 1, higher + tied + 1), lambda r: case when r <= 10 then 1.0::double / log2(r + 1) else 0 end)) / tied as ndcg_10, higher + (tied + 1) / 2 as mean_rank, greatest(0, least(tied, 1 - higher)) / tied as recall_1, greatest(0, least(tied, 3 - higher)) / tied as recall_3 from t)"""


@query(_TIES + " select pool, scorer, higher, tied, round(top_probability, 6) as top_probability, round(mrr_10, 6) as mrr_10, round(ndcg_10, 6) as ndcg_10, round(mean_rank, 6) as mean_rank, round(recall_1, 6) as recall_1, round(recall_3, 6) as recall_3 from m")
def tie_aware_pools(spark: SparkSession, d: str) -> DataFrame:
    s = written(scored(spark, d), "scored")
    x = s.withColumn("gold", F.col("cid") == F.min("cid").over(Window.partitionBy("pool", "scorer")))
    t = rank.tie_aware(x, ["pool", "scorer"], "score", "gold")
    return t.select("pool", "scorer", "higher", "tied", *[F.round(c, 6).alias(c) for c in t.columns[4:]])


@query(_TIES + " select scorer, count(*) as pools, round(avg(top_probability), 6) as recall_top, round(avg(mrr_10), 6) as mrr_10, round(avg(mean_rank), 6) as mean_rank from m group by scorer")
def tie_aware_summary(spark: SparkSession, d: str) -> DataFrame:
    s = written(scored(spark, d), "scored")
    x = s.withColumn("gold", F.col("cid") == F.min("cid").over(Window.partitionBy("pool", "scorer")))
    t = rank.tie_aware(x, ["pool", "scorer"], "score", "gold")
    return t.groupBy("scorer").agg(F.count("*").alias("pools"), F.round(F.avg("top_probability"), 6).alias("recall_top"), F.round(F.avg("mrr_10"), 6).alias("mrr_10"), F.round(F.avg("mean_rank"), 6).alias("mean_rank"))


@query(f"with {sql.POOLS}, {sql.SCORED}, r as (select *, row_number() over (partition by pool, scorer order by score desc, cid) as i, score - lead(score) over (partition by pool, scorer order by score desc, cid) as margin from scored) select pool, scorer, cid, score, round(margin, 6) as margin from r where i = 1")
def pool_winners(spark: SparkSession, d: str) -> DataFrame:
    """Best candidate per pool and scorer, and its margin over the runner-up."""
    w = Window.partitionBy("pool", "scorer").orderBy(F.desc("score"), "cid")
    x = scored(spark, d).withColumn("margin", F.round(F.col("score") - F.lead("score").over(w), 6)).withColumn("i", F.row_number().over(w))
    return x.where("i = 1").select("pool", "scorer", "cid", "score", "margin")


@query(f"""with {sql.POOLS}, {sql.SCORED}, r as (select s.*, gold = cid as is_gold, row_number() over (partition by s.pool, scorer order by score desc, cid desc) as i, lead(score) over (partition by s.pool, scorer order by score desc, cid desc) as runner_up from scored s join golds g on g.pool = s.pool)
  select scorer, count(*) as pools, round(100 * avg(case when is_gold then 1.0 else 0.0 end), 6) as gold_top, round(100 * avg(case when is_gold and score > 1.05::double * coalesce(runner_up, 0) then 1.0 else 0.0 end), 6) as decisive,
  round(median(case when is_gold then score - runner_up end), 6) as margin_median, round(max(case when is_gold then score - runner_up end), 6) as margin_max from r where i = 1 group by scorer""")
def confound_report(spark: SparkSession, d: str) -> DataFrame:
    """How often a scorer alone puts gold on top (ties towards the greater id), how often by more than 5 %, and by which margin."""
    w = Window.partitionBy("pool", "scorer").orderBy(F.desc("score"), F.desc("cid"))
    x = scored(spark, d).withColumn("is_gold", F.col("cid") == F.min("cid").over(Window.partitionBy("pool", "scorer")))
    x = x.withColumn("i", F.row_number().over(w)).withColumn("runner_up", F.lead("score").over(w)).where("i = 1")
    rate = lambda c, n: F.round(100 * F.avg(c.cast("double")), 6).alias(n)
    margin = F.when(F.col("is_gold"), F.col("score") - F.col("runner_up"))
    return x.groupBy("scorer").agg(F.count("*").alias("pools"), rate(F.col("is_gold"), "gold_top"), rate(F.col("is_gold") & (F.col("score") > 1.05 * F.coalesce("runner_up", F.lit(0.0))), "decisive"), F.round(F.percentile(margin, 0.5), 6).alias("margin_median"), F.round(F.max(margin), 6).alias("margin_max"))


@query(f"""with {sql.POOLS}, {sql.SCORED}, x as (select s.scorer, s.score, g.score as gold_score, case when c.lemma = c.query_lemma then 'hard_negative' else 'easy_negative' end as role from scored s join golds on golds.pool = s.pool join scored g on g.pool = s.pool and g.scorer = s.scorer and g.cid = gold join cand c on c.pool = s.pool and c.cid = s.cid where s.cid <> gold)
  select scorer, role, count(*) as pairs, round(100 * avg(case when gold_score > score then 1.0 else 0.0 end), 1) as accuracy from x group by scorer, role""")
def sparse_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Strict pairwise accuracy of each scorer by the kind of negative."""
    s = scored(spark, d).join(pools(spark, d).select("pool", "cid", F.when(F.col("lemma") == F.col("query_lemma"), "hard_negative").otherwise("easy_negative").alias("role")), ["pool", "cid"])
    first = F.min(F.struct("cid", "score")).over(Window.partitionBy("pool", "scorer"))
    x = s.withColumn("g", first).where(F.col("cid") != F.col("g.cid"))
    return x.groupBy("scorer", "role").agg(F.count("*").alias("pairs"), F.round(100 * F.avg(rank.win("g.score", "score", 0.0)), 1).alias("accuracy"))


@query(f"""with {sql.POOLS}, x as (select pool, cid, {sql.tok('query')} as q, {sql.tok('text')} as t from cand),
  l as (select pool, cid, t, q, unnest(q) as a, generate_subscripts(q, 1) as i from x), p as (select pool, cid, a, i, q, unnest(t) as b, generate_subscripts(t, 1) as j from l where not list_contains(t, a)),
  s as (select *, {_SOFT} as stem, {_SUF} as suf, least(length(a), length(b)) as low, greatest(length(a), length(b)) as high from p where not list_contains(q, b)),
  r as (select *, case when stem >= 3 and stem >= 0.35 * low then 2 when suf >= 3 and suf >= 0.4 * low then 1 end as r from s),
  o as (select *, row_number() over (partition by pool, cid order by r desc, (case when r = 2 then stem else suf end)::double / high desc, i, j) as n from r where r is not null)
  select x.pool, x.cid, o.a as "left", o.b as "right", case o.r when 2 then 'stem' when 1 then 'ending' end as kind from x left join o on o.pool = x.pool and o.cid = x.cid and o.n = 1""")
def critical_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The contrasting word pair of query and candidate, derived from the texts."""
    x = pools(spark, d).select("pool", "cid", udfs.derived_pair(tx.tokens("query"), tx.tokens("text")).alias("p"))
    return x.select("pool", "cid", "p.left", "p.right", "p.kind")


_PREFIX = f"""select generator_id, opening, n from (select g.generator_id, array_to_string({sql.tok('text')}[1:3], ' ') as opening, count(*) as n, row_number() over (partition by g.generator_id order by count(*) desc, array_to_string({sql.tok('text')}[1:3], ' ')) as i
  from {sql.Q} q join {sql.FAM} g on g.family_id = q._id where q.text is not null and g.generator_id is not null group by 1, 2) where i <= 10"""


@query(_PREFIX)
def usual_openings(spark: SparkSession, d: str) -> DataFrame:
    """The ten most common first three words of each generator's queries."""
    x = one_query(spark, d).where("text is not null").join(one_family(spark, d, "generator_id").withColumnRenamed("family_id", "_id"), "_id").where("generator_id is not null")
    n = x.groupBy("generator_id", F.array_join(F.slice(tx.tokens("text"), 1, 3), " ").alias("opening")).agg(F.count("*").alias("n"))
    return rank.top(n, ["generator_id"], "n", ["opening"], 10).drop("rank")


@query(f"with {sql.POOLS} select pool, qid, array_to_string(list(cid order by sha256(pool || '|' || cid)), ',') as candidates, count(*) as n from cand group by pool, qid")
def blind_pools(spark: SparkSession, d: str) -> DataFrame:
    """Pools without labels, their candidates in a fixed pseudo-random order."""
    h = tx.canonical_sha(F.col("pool"), F.col("cid"))
    x = pools(spark, d).groupBy("pool", "qid").agg(F.sort_array(F.collect_list(F.struct(h.alias("h"), "cid"))).alias("c"), F.count("*").alias("n"))
    return x.select("pool", "qid", F.array_join(F.transform("c", lambda s: s["cid"]), ",").alias("candidates"), "n")


@query(f"with {sql.POOLS}, l as (select c.*, gold, row_number() over (partition by c.pool order by c.cid) as i from cand c join golds using (pool)) select qid as query_id, cid as corpus_id, case when cid = gold then 1 else 0 end as relevance, i as position, case when cid = gold then 'positive' when lemma = query_lemma then 'hard_negative' else 'easy_negative' end as role from l")
def pool_qrels(spark: SparkSession, d: str) -> DataFrame:
    p = pools(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("pool").orderBy("cid")))
    return p.select(F.col("qid").alias("query_id"), F.col("cid").alias("corpus_id"), (F.col("i") == 1).cast("int").alias("relevance"), F.col("i").cast("bigint").alias("position"), F.when(F.col("i") == 1, "positive").when(F.col("lemma") == F.col("query_lemma"), "hard_negative").otherwise("easy_negative").alias("role"))


@query(f"""with {sql.POOLS}, l as (select c.pool, case when cid = gold then 'positive' when lemma = query_lemma then 'hard' else 'easy' end as role from cand c join golds using (pool))
  select pool, count(*) filter (where role = 'positive') as positive, count(*) filter (where role = 'hard') as hard, count(*) filter (where role = 'easy') as easy, count(*) filter (where role = 'positive') = 1 as sound from l group by pool""")
def pool_integrity(spark: SparkSession, d: str) -> DataFrame:
    r = pool_qrels(spark, d).join(pools(spark, d).select("pool", F.col("cid").alias("corpus_id")), "corpus_id")
    x = r.groupBy("pool").pivot("role", ["positive", "hard_negative", "easy_negative"]).count()
    z = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return x.select("pool", z("positive", "positive"), z("hard_negative", "hard"), z("easy_negative", "easy"), (F.coalesce("positive", F.lit(0)) == 1).alias("sound"))


# ------------------------------------------------------------------ similarity joins


def _grams_of(spark: SparkSession, d: str) -> DataFrame:
    return one_query(spark, d).where("text is not null").select(F.col("_id").alias("id"), tx.char_ngrams("text").alias("grams"))


@query(f"with g as (select _id, {sql.grams(sql.norm('text'))} as g from {sql.Q} where text is not null) select x._id as a, y._id as b, round({sql.jac('x.g', 'y.g')}, 6) as similarity from g x join g y on x._id < y._id and len(x.g) >= 0.82 * len(y.g) and len(y.g) >= 0.82 * len(x.g) where {sql.jac('x.g', 'y.g')} > 0.82 and len(x.g) > 0")
def query_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    x = similarity.jaccard_join(_grams_of(spark, d), None, 0.82)
    return x.select("a", "b", F.round("similarity", 6).alias("similarity"))


_SIDES = f"s as (select q._id, q.text, {sql.SPLIT.replace('split_name', 'f.split_name')} as side from {sql.Q} q join {sql.FAM} f on f.family_id = q._id where q.text is not null)"


def _side(spark: SparkSession, d: str) -> DataFrame:
    f = one_family(spark, d, "split_name").select(F.col("family_id").alias("id"), split().alias("side"))
    return written(one_query(spark, d).where("text is not null").select(F.col("_id").alias("id"), "text").join(f, "id"), "side")


@query(f"""with {_SIDES}, g as (select _id, side, {sql.grams(sql.padded('text'))} as g from s where side is not null)
  select x._id as id, round(max({sql.jac('x.g', 'y.g')}), 6) as nearest from g x join g y on x.side = 'development' and y.side = 'train' and len(x.g) > 0 and len(y.g) > 0 where {sql.jac('x.g', 'y.g')} > 0.5 group by x._id""")
def nearest_train(spark: SparkSession, d: str) -> DataFrame:
    """Development queries that are too near to a training query (padded grams, above 0.5), with the nearest similarity."""
    g = _side(spark, d).withColumn("grams", tx.char_ngrams_padded("text"))
    x = similarity.jaccard_join(g.where("side = 'development'").select("id", "grams"), g.where("side = 'train'").select("id", "grams"), 0.5)
    return x.groupBy(F.col("a").alias("id")).agg(F.round(F.max("similarity"), 6).alias("nearest"))


@query(f"""with {_SIDES}, g as (select _id, side, {sql.norm('text')} as n, {sql.grams(sql.norm('text'))} as g from s where side is not null)
  select x._id as train_id, y._id as held_id, case when x.n = y.n then 'exact' else 'near' end as kind, case when x.n = y.n then 1.0 else round({sql.jac('x.g', 'y.g')}, 6) end as similarity
  from g x join g y on x.side = 'train' and y.side <> 'train' where x.n <> '' and y.n <> '' and (x.n = y.n or {sql.jac('x.g', 'y.g')} > 0.85)""")
def train_test_leakage(spark: SparkSession, d: str) -> DataFrame:
    s = _side(spark, d)
    x = similarity.leaked(s.where("side = 'train'").select("id", "text"), s.where("side <> 'train'").select("id", "text"), 0.85)
    return x.select("train_id", "held_id", "kind", F.round("similarity", 6).alias("similarity"))


_RUNS = f"r as (select _id as id, {sql.tok('text')} as t from {sql.Q} where len({sql.tok('text')}) > 0), e as (select id, t, list_distinct(list_transform(range(1, greatest(len(t) - 3, 2)), lambda i: array_to_string(t[i:i + 4], ' '))) as runs from r)"


@query(f"""with {_RUNS}, u as (select id, unnest(runs) as run from e), k as (select run from u group by run having count(*) between 2 and 80), p as (select distinct a.id as a, b.id as b from u a join k using (run) join u b using (run) where a.id < b.id),
  g as (select id, {sql.grams("array_to_string(t, ' ')")} as g from e) select a, b, round({sql.jac('x.g', 'y.g')}, 6) as similarity from p join g x on x.id = a join g y on y.id = b where {sql.jac('x.g', 'y.g')} > 0.8""")
def shingle_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """As a legacy report lists them: by runs of five words that at most 80 records share."""
    r = one_query(spark, d).select(F.col("_id").alias("id"), F.col("_id").alias("family"), "text")
    return similarity.shingle_pairs(r, 0.8, most=80).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""with {_RUNS}, g as (select id, runs, {sql.grams("array_to_string(t, ' ')")} as g from e) select x.id as a, y.id as b, round({sql.jac('x.g', 'y.g')}, 6) as similarity from g x join g y on x.id < y.id and list_has_any(x.runs, y.runs) where {sql.jac('x.g', 'y.g')} > 0.8""")
def shingle_near_duplicates_all(spark: SparkSession, d: str) -> DataFrame:
    """Without a bound on how many records may share a run."""
    r = one_query(spark, d).select(F.col("_id").alias("id"), F.col("_id").alias("family"), "text")
    return similarity.shingle_pairs(r, 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


# ------------------------------------------------------------------ ranking


@query(f"""with qt as (select item_id as qid, term, count(*) as times from (select item_id, unnest({sql.tok('text')}) as term from heldout_items) group by all),
  t as (select doc_id as did, {sql.tok('text')} as t from documents), s as (select count(*)::double as n, sum(len(t)) / greatest(1.0, count(*)) as av from t),
  tf as (select did, len, term, count(*) as f from (select did, len(t) as len, unnest(t) as term from t) where term in (select term from qt) group by all), df as (select term, count(*)::double as df from tf group by term),
  sc as (select qid, did, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / greatest(1.0, av)))), 6) as score from tf join qt using (term) join df using (term) cross join s group by qid, did)
  select qid, did, score, row_number() over (partition by qid order by score desc, did) as rank from sc qualify rank <= 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "heldout_items").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("did"), "text")
    return rank.bm25(q, docs, 10).select("qid", "did", "score", F.col("rank").cast("bigint").alias("rank"))


_RUN = """e as (select vec_id, label, embedding::double[] as v from embeddings), sc as (select q.vec_id as qid, d.vec_id as did, q.label as ql, d.label as dl, round(list_inner_product(q.v, d.v), 6) as score from e q join e d on q.vec_id % 100 = 0 and d.vec_id <> q.vec_id),
  ranked as (select *, row_number() over (partition by qid order by score desc, did) as rank from sc)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), F.col("label").alias("query_label")), e.select(F.col("vec_id").alias("did"), F.col("embedding").alias("vector"), F.col("label").alias("label"))


@query(f"with {_RUN} select qid, did, score, rank from ranked where rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector as a query against all others."""
    q, c = _vectors(spark, d)
    return rank.dense_scores(q, c, 10).select("qid", "did", "score", F.col("rank").cast("bigint").alias("rank"))


def _run(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    q, c = _vectors(spark, d)
    run = rank.dense_scores(q, c, k).select("qid", "did", "rank")
    rel = q.select("qid", "query_label").join(c.select("did", "label"), F.col("query_label") == F.col("label")).where("qid <> did").select("qid", "did", F.lit(1.0).alias("rel"))
    return written(run, "run"), written(rel, "qrels")


_METRICS = f"""with {_RUN}, rel as (select qid, did, case when rank <= 50 then rank end as rank from ranked where ql = dl), n as (select qid, count(*) as n from rel group by qid),
  m as (select qid, min(rank) as first_rank, case when min(rank) <= 10 then 1.0::double / min(rank) else 0 end as mrr_10, coalesce(sum(case when rank <= 10 then 1.0::double / log2(rank + 1) end), 0) / (select list_sum(list_transform(range(1, least(10, any_value(n.n)) + 1), lambda i: 1.0::double / log2(i + 1)))) as ndcg_10,
    count(*) filter (where rank <= 1) / any_value(n.n) as recall_1, count(*) filter (where rank <= 3) / any_value(n.n) as recall_3, count(*) filter (where rank <= 10) / any_value(n.n) as recall_10 from rel join n using (qid) group by qid)"""


@query(_METRICS + " select qid, first_rank, round(mrr_10, 6) as mrr_10, round(ndcg_10, 6) as ndcg_10, round(recall_1, 6) as recall_1, round(recall_3, 6) as recall_3, round(recall_10, 6) as recall_10 from m")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    run, rel = _run(spark, d, 50)
    m = rank.run_metrics(run, rel)
    return m.select("qid", F.col("first_rank").cast("bigint").alias("first_rank"), *[F.round(c, 6).alias(c) for c in m.columns[2:]])


@query(_METRICS + " select count(*) as queries, round(100 * avg(mrr_10), 2) as mrr_10, round(100 * avg(ndcg_10), 2) as ndcg_10, round(100 * avg(recall_10), 2) as recall_10, round(avg(first_rank), 6) as mean_rank, median(first_rank)::double as median_rank from m where qid in (select qid from ranked where rank <= 50)")
def legacy_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means times 100; queries without a run are dropped."""
    run, rel = _run(spark, d, 50)
    s = rank.metric_summary(rank.run_metrics(run, rel, strict=False), 100.0)
    return s.select("queries", *[F.round(c, 2).alias(c) for c in ("mrr_10", "ndcg_10", "recall_10")], F.round("mean_rank", 6).alias("mean_rank"), "median_rank")


@query(f"""with {_RUN}, j as (select *, dl <> 0 as judged from ranked where rank <= 50), c as (select *, row_number() over (partition by qid order by rank) as r from j where judged),
  n as (select qid, count(*) as n from sc where ql = dl and dl <> 0 group by qid),
  h as (select qid, min(r) as first_rank, count(*) filter (where r <= 3) as h3, count(*) filter (where r <= 10) as h10 from c where ql = dl group by qid),
  g as (select qid, count(*) filter (where judged and rank <= 3) / greatest(1, least(3, count(*))) as judged_3, count(*) filter (where judged and rank <= 10) / greatest(1, least(10, count(*))) as judged_10 from j group by qid)
  select qid, first_rank, case when first_rank <= 10 then round(1.0::double / first_rank, 6) else 0 end as mrr_10, round(coalesce(h3, 0) / n, 6) as recall_3, round(coalesce(h10, 0) / n, 6) as recall_10, round(judged_3, 6) as judged_3, round(judged_10, 6) as judged_10 from n left join h using (qid) left join g using (qid)""")
def condensed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of label 0 count as unjudged: they are taken out of the run before it is measured."""
    run, rel = _run(spark, d, 50)
    q, c = _vectors(spark, d)
    judged_ids = c.where("label <> 0").select("did")
    rel = rel.join(judged_ids, "did", "left_semi").select("qid", "did", "rel")
    judged = run.select("qid", "did").join(judged_ids, "did", "left_semi").select("qid", "did")
    m = rank.run_metrics(run, rel, (3, 10), condensed=judged)
    return m.select("qid", F.col("first_rank").cast("bigint").alias("first_rank"), *[F.round(c, 6).alias(c) for c in ("mrr_10", "recall_3", "recall_10", "judged_3", "judged_10")])


_CLOSED = """e as (select vec_id, label, embedding::double[] as v, vec_id // 100 as pool from embeddings), q as (select * from e where vec_id % 100 = 0),
  c as (select q.pool, q.vec_id as qid, q.label as ql, e.vec_id as cid, e.label, round(list_inner_product(q.v, e.v), 6) as s, round(list_inner_product(q.v[1:32], e.v[1:32]), 6) as s1, round(list_inner_product(q.v[33:64], e.v[33:64]), 6) as s2 from q join e on e.pool = q.pool and e.vec_id <> q.vec_id),
  g0 as (select qid, min(cid) as gold from c where label = ql group by qid),
  k as (select c.*, gold, case when cid = gold then 'positive' when (label + ql) % 2 = 0 then 'hard' else 'easy' end as role from c join g0 using (qid)), gs as (select qid, s as g, s1 as g1, s2 as g2 from k where role = 'positive')"""


def closed(spark: SparkSession, d: str) -> DataFrame:
    """Closed pools of a hundred consecutive vectors: the first asks, the others are candidates; gold is the least id of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.expr("cast(vec_id div 100 as bigint)").alias("pool"), F.col("embedding").alias("v"))
    q = e.where("vec_id % 100 = 0").select("pool", F.col("vec_id").alias("qid"), F.col("label").alias("ql"), F.col("v").alias("qv"))
    part = lambda a, n: F.round(rank.dot(F.slice("qv", a, n), F.slice("v", a, n)), 6)
    c = q.join(e, "pool").where("vec_id <> qid").select("pool", "qid", "ql", F.col("vec_id").alias("cid"), "label", F.round(rank.dot("qv", "v"), 6).alias("s"), part(1, 32).alias("s1"), part(33, 32).alias("s2"))
    c = written(c, "closed")
    gold = c.where("label = ql").groupBy("qid").agg(F.min(F.struct("cid", F.col("s").alias("g"), F.col("s1").alias("g1"), F.col("s2").alias("g2"))).alias("x")).select("qid", F.col("x.cid").alias("gold"), "x.g", "x.g1", "x.g2")
    role = F.when(F.col("cid") == F.col("gold"), "positive").when((F.col("label") + F.col("ql")) % 2 == 0, "hard").otherwise("easy")
    return c.join(gold, "qid").withColumn("role", role)


_W = "case when g > s then 1.0 when g = s then 0.5 else 0.0 end"


@query(f"""with {_CLOSED}, x as (select k.*, g from k join gs using (qid)) select qid, 1 + count(*) filter (where role = 'hard' and (s > g or (s = g and cid < gold))) as hard_rank,
  round(avg({_W}) filter (where role = 'hard'), 6) as pairwise_hard, round(avg({_W}) filter (where role = 'easy'), 6) as pairwise_easy, round(avg({_W}) filter (where role <> 'positive'), 6) as pairwise_all,
  case when count(*) filter (where role = 'hard') > 0 and coalesce(bool_and(g > s) filter (where role = 'hard'), false) then 1 else 0 end as consistent_hard,
  round(any_value(g) - max(s) filter (where role = 'hard'), 6) as hard_margin, round(any_value(g) - max(s) filter (where role <> 'positive'), 6) as margin from x group by qid""")
def closed_pool_contrast(spark: SparkSession, d: str) -> DataFrame:
    x = closed(spark, d)
    hard, easy, rest = F.col("role") == "hard", F.col("role") == "easy", F.col("role") != "positive"
    w = rank.win("g", "s")
    only = lambda m, v: F.when(m, v)
    above = hard & ((F.col("s") > F.col("g")) | ((F.col("s") == F.col("g")) & (F.col("cid") < F.col("gold"))))
    return x.groupBy("qid").agg(
        (1 + F.count_if(above)).alias("hard_rank"), F.round(F.avg(only(hard, w)), 6).alias("pairwise_hard"), F.round(F.avg(only(easy, w)), 6).alias("pairwise_easy"), F.round(F.avg(only(rest, w)), 6).alias("pairwise_all"),
        F.coalesce(F.min(only(hard, (F.col("g") > F.col("s")).cast("int"))), F.lit(0)).alias("consistent_hard"), F.round(F.first("g") - F.max(only(hard, F.col("s"))), 6).alias("hard_margin"), F.round(F.first("g") - F.max(only(rest, F.col("s"))), 6).alias("margin"))


@query(f"with {_CLOSED}, x as (select k.*, g from k join gs using (qid) where role <> 'positive') select case when grouping(role) = 1 then 'ALL' else role end as role, case when grouping(ql) = 1 then -1 else ql end as query_label, count(*) as pairs, round(100 * avg(case when g > s then 1.0 else 0.0 end), 6) as accuracy from x group by rollup (role, ql)")
def pairwise_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Strict pairwise accuracy by role, by role and label, and over all, in one pass."""
    x = closed(spark, d).where("role <> 'positive'")
    r = x.rollup("role", "ql").agg(F.count("*").alias("pairs"), F.round(100 * F.avg(rank.win("g", "s", 0.0)), 6).alias("accuracy"), F.grouping("role").alias("a"), F.grouping("ql").alias("b"))
    return r.select(F.when(F.col("a") == 1, "ALL").otherwise(F.col("role")).alias("role"), F.when(F.col("b") == 1, -1).otherwise(F.col("ql")).alias("query_label"), "pairs", "accuracy")


@query(f"""with {_CLOSED}, e2 as (select vec_id, label, v, pool from e where vec_id % 100 <> 0), f as (select q.vec_id as qid, e2.pool <> q.pool as foreign_, round(list_inner_product(q.v, e2.v), 6) as s from q cross join e2)
  select qid, count(*) filter (where foreign_ and f.s > g) as foreign_above from f join gs using (qid) group by qid""")
def pool_contamination(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates of other pools score above a query's gold candidate."""
    q, c = _vectors(spark, d)
    gold = closed(spark, d).where("role = 'positive'").select("qid", F.col("g").alias("bar"))
    own = lambda c: F.expr(f"{c} div 100").alias("own")
    asked = q.join(gold, "qid").select("qid", "vector", "bar", own("qid"))
    return rank.count_above(asked, c.where("did % 100 <> 0").select("vector", own("did"))).select("qid", F.col("n").alias("foreign_above"))


_MODELS = f"{_CLOSED}, p as (select qid, any_value(ql) as ql, case when bool_and(role = 'positive' or g1 > s1) then 1 else 0 end as first_half, case when bool_and(role = 'positive' or g2 > s2) then 1 else 0 end as second_half, avg(case when role <> 'positive' and g1 > s1 then 1.0 when role <> 'positive' then 0.0 end) as acc1, avg(case when role <> 'positive' and g2 > s2 then 1.0 when role <> 'positive' then 0.0 end) as acc2 from k join gs using (qid) group by qid)"


def models(spark: SparkSession, d: str) -> DataFrame:
    """Two scorers side by side, each with half of the dimensions: does gold win, and against which share of the others."""
    x = closed(spark, d)
    other = F.col("role") != "positive"
    wins = lambda g, s: F.min(F.when(other, (F.col(g) > F.col(s)).cast("int")).otherwise(F.lit(1)))
    acc = lambda g, s: F.avg(F.when(other, (F.col(g) > F.col(s)).cast("double")))
    return x.groupBy("qid").agg(F.first("ql").alias("ql"), wins("g1", "s1").alias("first_half"), wins("g2", "s2").alias("second_half"), acc("g1", "s1").alias("acc1"), acc("g2", "s2").alias("acc2"))


_MC = f"""{_MODELS}, mc as (select ql, count(*) filter (where first_half = 1 and second_half = 0) as left_only, count(*) filter (where first_half = 0 and second_half = 1) as right_only, count(*) as n from p group by ql),
  mp as (select *, case when left_only + right_only = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(left_only, right_only) + 1), lambda i: exp(lgamma(left_only + right_only + 1) - lgamma(i + 1) - lgamma(left_only + right_only - i + 1) - (left_only + right_only) * ln(2))))) end as p_value from mc)"""


@query(f"with {_MC} select ql as label, left_only, right_only, round(p_value, 6) as p_value, round((left_only + 0.5) / (right_only + 0.5), 6) as odds_ratio, round((left_only - right_only) / greatest(1, n), 6) as risk_difference from mp")
def mcnemar_by_label(spark: SparkSession, d: str) -> DataFrame:
    m = rank.mcnemar(models(spark, d), ["ql"], "first_half", "second_half")
    return m.select(F.col("ql").alias("label"), "left_only", "right_only", *[F.round(c, 6).alias(c) for c in ("p_value", "odds_ratio", "risk_difference")])


@query(f"with {_MC}, o as (select ql, p_value, row_number() over (order by round(p_value, 9), ql) as i, count(*) over () as m from mp) select ql as label, round(p_value, 6) as p_value, round(max(least(1.0, (m - i + 1) * p_value)) over (order by i rows unbounded preceding), 6) as adjusted from o")
def holm_by_label(spark: SparkSession, d: str) -> DataFrame:
    m = rank.mcnemar(models(spark, d), ["ql"], "first_half", "second_half").withColumn("family", F.lit("label")).withColumn("p", F.round("p_value", 9))
    h = rank.holm(m, ["family"], "ql", "p")
    return h.select(F.col("ql").alias("label"), F.round("p_value", 6).alias("p_value"), F.round("adjusted", 6).alias("adjusted"))


@query()
def bootstrap_by_label(spark: SparkSession, d: str) -> DataFrame:
    return rank.bootstrap_ci(models(spark, d), ["ql"], "acc1", ["qid"])


@query()
def paired_tests_all(spark: SparkSession, d: str) -> DataFrame:
    return rank.paired_tests(models(spark, d).withColumn("models", F.lit("first_half,second_half")), ["models"], "acc1", "acc2", ["qid"])


@query(f"with {_MODELS} select model, round(avg(case when ql = 0 then acc end), 6) as label_0, round(avg(case when ql = 1 then acc end), 6) as label_1, round(avg(case when ql = 2 then acc end), 6) as label_2, round(avg(acc), 6) as mean from (select ql, 'first_half' as model, acc1 as acc from p union all select ql, 'second_half', acc2 from p) group by model")
def model_pivot(spark: SparkSession, d: str) -> DataFrame:
    x = models(spark, d).select("ql", F.col("acc1").alias("first_half"), F.col("acc2").alias("second_half")).unpivot(["ql"], ["first_half", "second_half"], "model", "acc")
    p = x.groupBy("model").pivot("ql", [0, 1, 2]).agg(F.avg("acc"))
    return p.join(x.groupBy("model").agg(F.avg("acc").alias("mean")), "model").select("model", *[F.round(str(k), 6).alias(f"label_{k}") for k in (0, 1, 2)], F.round("mean", 6).alias("mean"))


@query(f"with {_CLOSED}, m as (select k.pool % 4 as cell, case when role = 'positive' then 'gold' else role end as role, s from k) select axis, value, count(*) as n, round(avg(s), 6) as mean from (select 'cell' as axis, cell::varchar as value, s from m union all select 'role', role, s from m) group by axis, value")
def score_slices(spark: SparkSession, d: str) -> DataFrame:
    x = closed(spark, d).select((F.col("pool") % 4).alias("cell"), F.when(F.col("role") == "positive", "gold").otherwise(F.col("role")).alias("role"), "s")
    t = quota.slice_means(x, ["cell", "role"], "s")
    return t.select("axis", "value", "n", F.round("mean", 6).alias("mean"))
