"""Scoring and ranking: BM25, dense top-k, ranking metrics, tie-aware expectations.

Ranks are by score rounded to six places, then by id, so that they are total and the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tezgah.functions import text as tx
from tezgah.session import written

K1, B = 1.2, 0.75
#: Query terms, and query vectors, held in memory at once; more are searched in blocks.
TERM_BLOCK, ASKED_BLOCK, VECTOR_BLOCK = 200_000, 2_000_000, 4096


def top(scores: DataFrame, by: list[str], score: str, ids: list[str], k: int) -> DataFrame:
    """The ``k`` best rows per group with their ``rank``. Each task keeps its own ``k`` best before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ids)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """``queries``: ``qid, text``; ``docs``: ``did, text``. Top ``k`` documents per query with a positive score:
    ``qid, did, score, rank``. A repeated query term adds repeatedly. Documents are tokenised once; up to ``TERM_BLOCK`` different query terms go to
    the tasks, which score their documents themselves and send their ``k`` best per query on; beyond that, or beyond
    ``ASKED_BLOCK`` terms of all queries together, postings and terms are joined by shuffle."""
    q = queries.select("qid", F.explode(tx.tokens("text")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    terms = written(q, "terms")
    d = docs.select("did", tx.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    vocabulary = [r[0] for r in terms.select("term").distinct().orderBy("term").limit(TERM_BLOCK + 1).collect()]
    if len(vocabulary) > TERM_BLOCK or terms.count() > ASKED_BLOCK:
        return top(_bm25_joined(terms, d), ["qid"], "score", ["did"], k)
    kind = docs.schema["did"].dataType.simpleString()
    held = written(d.mapInArrow(_counted(vocabulary), f"did {kind}, len int, term array<int>, f array<int>"), "postings")
    n, total = held.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    df = np.zeros(max(1, len(vocabulary)))
    for r in held.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row per term
        df[r[0]] = r[1]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    place, asked = {t: i for i, t in enumerate(vocabulary)}, terms.collect()  # at most ASKED_BLOCK rows
    qids = sorted({r["qid"] for r in asked})
    at = {x: i for i, x in enumerate(qids)}
    rows = sorted((place[r["term"]], at[r["qid"]], float(r["times"])) for r in asked)
    term, query, times = (np.array([r[i] for r in rows]) for i in range(3)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    begin = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((begin, query, times * idf[term], total / max(1.0, n), len(qids)))
    best = held.mapInArrow(_scored(shared, k), f"q int, did {kind}, score double")
    names = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(qids)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", queries.schema["qid"].dataType)])))
    return top(best.join(names, "q").select("qid", "did", F.round("score", 6).alias("score")), ["qid"], "score", ["did"], k)


def _counted(vocabulary: list[str]):
    """Tokens of documents as term numbers and counts; terms outside the vocabulary count for the length only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for b in batches:
            t = b.column("t")
            size = np.asarray(t.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            number = pa.compute.index_in(t.flatten(), value_set=known)
            number = pa.compute.fill_null(number, -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(size)), size)[number >= 0]
            key, f = np.unique(doc * max(1, len(vocabulary)) + number[number >= 0], return_counts=True)
            doc, number = np.divmod(key, max(1, len(vocabulary)))
            first = pa.array(np.searchsorted(doc, np.arange(len(size) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(x.astype(np.int32))) for x in (number, f)]
            yield pa.RecordBatch.from_arrays([b.column("did"), pa.array(size.astype(np.int32)), *lists], names=["did", "len", "term", "f"])

    return count


def _scored(shared, k: int, cells: int = 4_000_000):
    """The ``k`` best documents per query of some documents at a time."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, query, weight, average, queries = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, cells // max(1, queries))):
                b = batch.slice(at, step)
                size = np.asarray(b.column("term").value_lengths().to_numpy(zero_copy_only=False), np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                term, f = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "f"))
                part = f * (K1 + 1) / (f + K1 * (1 - B + B * b.column("len").to_numpy(zero_copy_only=False)[doc] / max(1.0, average)))
                times = begin[term + 1] - begin[term]
                j = np.arange(times.sum()) + np.repeat(begin[term] - (np.cumsum(times) - times), times)
                cell = query[j] * len(size) + np.repeat(doc, times)
                total = np.round(np.bincount(cell, weights=weight[j] * np.repeat(part, times), minlength=queries * len(size)), 6).reshape(queries, len(size))
                did = b.column("did").to_numpy(zero_copy_only=False)
                q, c = np.nonzero((total > 0) & (total >= np.partition(total, -k, axis=1)[:, -k][:, None] if total.shape[1] > k else total > 0))
                order = np.lexsort((did[c].astype(str) if did.dtype == object else did[c], -total[q, c], q))
                q, c = q[order], c[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, c = q[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), b.column("did").take(pa.array(c)), pa.array(total[q, c])], names=["q", "did", "score"])

    return score


def _bm25_joined(terms: DataFrame, d: DataFrame) -> DataFrame:
    d = written(d, "tokens")
    posting = d.select("did", F.size("t").alias("len"), F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    tf = written(posting.groupBy("did", "term").agg(F.count("*").alias("f"), F.first("len").alias("len")), "tf")
    size = d.agg(F.count("*").cast("double").alias("n"), F.sum(F.size("t")).cast("double").alias("total"))
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df")).crossJoin(F.broadcast(size))
    idf = df.select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("total") / F.greatest(F.lit(1.0), "n")).alias("avg"))
    part = F.col("times") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.greatest(F.lit(1.0), "avg")))
    return tf.join(terms.join(idf, "term"), "term").groupBy("qid", "did").agg(F.round(F.sum(part), 6).alias("score"))


def pool_bm25(pools: DataFrame) -> DataFrame:
    """BM25 in closed pools. ``pools``: ``pool, cid, query, text``; frequencies and lengths are those of the pool. Adds ``bm25``."""
    p = pools.select("pool", "cid", "query", tx.tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("len", F.size("t"))
    per = p.groupBy("pool").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    q = p.groupBy("pool").agg(F.first("query").alias("query")).select("pool", F.explode(tx.tokens(F.coalesce("query", F.lit("")))).alias("term")).groupBy("pool", "term").agg(F.count("*").alias("times"))
    tf = p.select("pool", "cid", "len", F.explode("t").alias("term")).groupBy("pool", "cid", "term").agg(F.count("*").alias("f"), F.first("len").alias("len")).join(q, ["pool", "term"])
    df = tf.groupBy("pool", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.greatest(F.lit(1.0), F.col("avg"))))
    s = tf.join(df, ["pool", "term"]).join(per, "pool").groupBy("pool", "cid").agg(F.sum(part).alias("bm25"))
    return p.select("pool", "cid").join(s, ["pool", "cid"], "left").select("pool", "cid", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def dense_scores(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Exact top ``k`` by dot product. ``queries``: ``qid, vector``; ``corpus``: ``did, vector``. A row whose id is the query's is left out. Query vectors go
    to the tasks in blocks; each task multiplies matrices and keeps its own best: ``qid, did, score, rank``."""
    out = None
    for block in _vector_blocks(queries):
        ids = np.array([r[0] for r in block])
        matrix = np.array([r[1] for r in block], np.float64)
        shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for b in batches:
                did = b.column("did").to_numpy(zero_copy_only=False)
                if not len(did):
                    continue
                x = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(did), -1)
                s = np.round(matrix @ x.T, 6)
                s[ids[:, None] == did[None, :]] = -np.inf
                take = min(k, len(did))
                order = np.lexsort((np.broadcast_to(did, s.shape), -s), axis=1)[:, :take]
                score = np.take_along_axis(s, order, 1)
                ok = np.isfinite(score).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)[ok]), pa.array(did[order].ravel()[ok]), pa.array(score.ravel()[ok])], names=["qid", "did", "score"])

        part = corpus.where("vector is not null").select("did", "vector").mapInArrow(best, "qid bigint, did bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], "qid bigint, did bigint, score double")
    return top(out, ["qid"], "score", ["did"], k)


def count_above(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``queries``: ``qid, vector, bar, own``; ``corpus``: ``did, vector, own``. Per query, how many vectors of another ``own`` score above its ``bar``:
    ``qid, n``. One row per query and task is shuffled."""
    out = None
    for block in _vector_blocks(queries):
        ids, bar, own = (np.array([r[k] for r in block]) for k in (0, 2, 3))
        shared = corpus.sparkSession.sparkContext.broadcast((ids, np.array([r[1] for r in block], np.float64), bar, own))

        def above(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, bar, own = shared.value
            n = np.zeros(len(ids), np.int64)
            for b in batches:
                if b.num_rows:
                    x = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    n += ((np.round(matrix @ x.T, 6) > bar[:, None]) & (own[:, None] != b.column("own").to_numpy(zero_copy_only=False)[None, :])).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["qid", "n"])

        part = corpus.where("vector is not null").select("vector", "own").mapInArrow(above, "qid bigint, n bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], "qid bigint, n bigint")
    return out.groupBy("qid").agg(F.sum("n").alias("n"))


def _vector_blocks(queries: DataFrame) -> Iterator[list]:
    block: list = []
    for r in queries.where("vector is not null").toLocalIterator():
        block.append((r["qid"], r["vector"], *r[2:]))
        if len(block) == VECTOR_BLOCK:
            yield block
            block = []
    if block:
        yield block


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double, left to right."""
    z = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(z, F.lit(0.0), lambda s, x: s + x)


def run_metrics(run: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 10), condensed: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Per judged query: ``qid, first_rank, mrr_10, ndcg_10, recall_k...`` of a ``run`` (``qid, did, rank``) against ``relevant`` (``qid, did, rel > 0``).

    Strict: a judged query without results counts with zeros; otherwise it is dropped. ``condensed``: judged pairs ``qid, did``; others are taken
    out of the run, and ranks move up, while ``judged_k`` tells how many of the first k were judged."""
    size = relevant.groupBy("qid").agg(F.count("*").alias("positives"))
    best = relevant.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "did"))).where("i <= 10").groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("i") + 1)).alias("ideal"))
    judged = None
    if condensed is not None:
        flagged = run.join(condensed.withColumn("j", F.lit(1)), ["qid", "did"], "left")
        judged = flagged.groupBy("qid").agg(*[(F.count_if(F.col("j").isNotNull() & (F.col("rank") <= k)) / F.greatest(F.lit(1), F.least(F.lit(k), F.count("*")))).alias(f"judged_{k}") for k in ks])
        run = flagged.where("j is not null").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).drop("j")
    hits = run.join(relevant, ["qid", "did"]).groupBy("qid").agg(
        F.min("rank").alias("first_rank"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, F.col("rel") / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        *[F.count_if(F.col("rank") <= k).alias(f"h_{k}") for k in ks],
    )
    x = size.join(best, "qid").join(hits, "qid", "left")
    if not strict:
        x = x.join(run.select("qid").distinct(), "qid", "left_semi")
    x = x.select(
        "qid", "first_rank",
        F.when(F.col("first_rank") <= 10, 1 / F.col("first_rank")).otherwise(F.lit(0.0)).alias("mrr_10"),
        (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg_10"),
        *[(F.coalesce(f"h_{k}", F.lit(0)) / F.col("positives")).alias(f"recall_{k}") for k in ks],
    )
    return x if judged is None else x.join(judged, "qid", "left")


def metric_summary(per_query: DataFrame, scale: float = 1.0) -> DataFrame:
    """Unweighted means over queries, and mean and median of the ranks found."""
    means = [(F.avg(c) * scale).alias(c) for c in per_query.columns if c not in ("qid", "first_rank")]
    return per_query.agg(F.count("*").alias("queries"), *means, F.avg("first_rank").alias("mean_rank"), F.percentile("first_rank", 0.5).alias("median_rank"))


def tie_aware(scored: DataFrame, by: list[str], score: str, gold: str) -> DataFrame:
    """Expected metrics of the single gold row of each group when rows of its score come in any order: ``higher, tied, top_probability, mrr_10,
    ndcg_10, mean_rank, recall_1, recall_3``. Two aggregations, no sort."""
    g = scored.where(gold).groupBy(*by).agg(F.max(score).alias("g"))
    x = scored.join(g, by).groupBy(*by).agg(F.count_if(F.col(score) > F.col("g")).alias("higher"), F.count_if(F.col(score) == F.col("g")).alias("tied"))
    ranks = F.sequence(F.col("higher") + 1, F.col("higher") + F.col("tied"))
    mean = lambda f: F.aggregate(F.transform(ranks, lambda r: F.when(r <= 10, f(r)).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, v: s + v) / F.col("tied")
    recall = lambda k: F.greatest(F.lit(0), F.least(F.col("tied"), k - F.col("higher"))) / F.col("tied")
    return x.select(
        *by, "higher", "tied", F.when(F.col("higher") > 0, F.lit(0.0)).otherwise(1 / F.col("tied")).alias("top_probability"), mean(lambda r: 1 / r).alias("mrr_10"), mean(lambda r: 1 / F.log2(r + 1)).alias("ndcg_10"),
        (F.col("higher") + (F.col("tied") + 1) / 2).alias("mean_rank"), recall(1).alias("recall_1"), recall(3).alias("recall_3"),
    )


def win(gold: Column | str, other: Column | str, tie: float = 0.5) -> Column:
    """1 for a higher gold score, ``tie`` for an equal one, else 0."""
    g, o = (F.col(x) if isinstance(x, str) else x for x in (gold, other))
    return F.when(g > o, F.lit(1.0)).when(g == o, F.lit(tie)).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ resampling statistics, one group per task


def _per_group(rows: DataFrame, by: list[str], schema: str, f) -> DataFrame:
    kinds = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        for b in by:
            out.insert(0, b, pdf[b].iloc[0])
        return out

    return rows.groupBy(*by).applyInPandas(run, ", ".join([f"{b} {kinds[b]}" for b in reversed(by)] + [schema]))


def _draws(rng: np.random.Generator, v: np.ndarray, times: int) -> np.ndarray:
    return rng.choice(v, size=(times, len(v)), replace=True).mean(axis=1)


def bootstrap_ci(rows: DataFrame, by: list[str], value: str, order: list[str], times: int = 10_000, seed: int = 0) -> DataFrame:
    """95 % interval of the mean per group. A group is the vector of one metric over the queries of an evaluation."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        low, high = np.percentile(_draws(np.random.default_rng(seed), v, times), [2.5, 97.5])
        return pd.DataFrame({"n": [len(v)], "mean": [v.mean()], "ci_low": [low], "ci_high": [high]})

    return _per_group(rows, by, "n bigint, mean double, ci_low double, ci_high double", f)


def paired_tests(rows: DataFrame, by: list[str], left: str, right: str, order: list[str], times: int = 10_000, seed: int = 0) -> DataFrame:
    """Paired bootstrap and two-sided approximate randomisation (plus one smoothing) of the mean difference per group."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        d = p[left].to_numpy(float) - p[right].to_numpy(float)
        low, high = np.percentile(_draws(np.random.default_rng(seed), d, times), [2.5, 97.5])
        rng, more = np.random.default_rng(seed), 0
        for a in range(0, times, 1000):
            signs = rng.choice((-1.0, 1.0), size=(min(1000, times - a), len(d)))
            more += int((np.abs((signs * d).mean(axis=1)) >= abs(d.mean())).sum())
        return pd.DataFrame({"mean_difference": [d.mean()], "ci_low": [low], "ci_high": [high], "p_value": [(more + 1) / (times + 1)]})

    return _per_group(rows, by, "mean_difference double, ci_low double, ci_high double, p_value double", f)


def mcnemar(pairs: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Discordant counts per group, matched odds ratio, risk difference and the exact two-sided p value (a sum over at most that many terms)."""
    x = pairs.groupBy(*by).agg(F.count_if((F.col(left) == 1) & (F.col(right) == 0)).alias("left_only"), F.count_if((F.col(left) == 0) & (F.col(right) == 1)).alias("right_only"), F.count("*").alias("n"))

    @F.pandas_udf("double")
    def exact(b: pd.Series, c: pd.Series) -> pd.Series:
        import math

        def p(m: int, k: int) -> float:
            total, low = m + k, min(m, k)
            logs = [math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1) - total * math.log(2) for i in range(low + 1)]
            return min(1.0, 2 * math.fsum(map(math.exp, logs))) if total else 1.0

        return pd.Series([p(int(i), int(j)) for i, j in zip(b, c)])

    return x.select(*by, "left_only", "right_only", exact("left_only", "right_only").alias("p_value"), ((F.col("left_only") + 0.5) / (F.col("right_only") + 0.5)).alias("odds_ratio"), ((F.col("left_only") - F.col("right_only")) / F.greatest(F.lit(1), "n")).alias("risk_difference"))


def holm(p_values: DataFrame, by: list[str], name: str, p: str) -> DataFrame:
    """Step-down adjusted p values per family of tests: a running maximum over the ordered, scaled values."""
    w = Window.partitionBy(*by).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*by))
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return p_values.withColumn("scaled", scaled).withColumn("adjusted", F.max("scaled").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("scaled")


def first_rows(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``place``: the first of each partition, and of these the first, so that a group of any
    size brings at most ``k`` rows per task together. Ties fall in the order of the columns given."""
    part = rows.withColumn("_part", F.spark_partition_id())
    some = part.withColumn("_i", F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))).where(F.col("_i") <= k)
    return some.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k).drop("_part", "_i")


def running_number(rows: DataFrame, by: str, order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Numbers the rows of each group in the order of an integer column: counts of ranges of it are summed up, and rows are numbered only
    within their range. Ranges hold at most ``width`` different values."""
    x = rows.withColumn("_range", F.floor(F.col(order) / width))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(by, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), "_before")
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order))
    y = x.withColumn("_own", own).join(counts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return y.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_by", "_r", "_before")
