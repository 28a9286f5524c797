"""Exact and approximate matches between texts: duplicate groups, set-similarity joins, shingle joins, leakage, contamination.

Similarity joins never compare all pairs. Sets with a Jaccard similarity above ``t`` share at least one of the rarest
``n - ceil(t * n) + 1`` elements of each (prefix filter) and have sizes within a factor ``t``; only such pairs are verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tezgah.functions import text as tx
from tezgah.session import written, written_parts


def duplicate_groups(records: DataFrame, text: str = "text", key: str = "id", group: str = "family") -> DataFrame:
    """Texts that are equal after normalisation: per text ``text_key`` (sha256), records and groups that have it."""
    x = records.withColumn("n", tx.normalised(text)).where("n <> ''")
    return x.groupBy(F.sha2("n", 256).alias("text_key")).agg(F.countDistinct(key).alias("records"), F.countDistinct(group).alias("groups"), F.min(key).alias("first_record")).where("records > 1")


#: Words of 64 bits: with fewer, sets of two hundred grams fill the signature, and most pairs that meet pass.
SIGNATURE = 8
#: Rows of a pass of the join, and the most passes.
ROWS_AT_ONCE, PAIRS_AT_ONCE, PASSES = 2_000_000, 200_000, 16


def _signed(sets: DataFrame) -> DataFrame:
    """Adds the size and a signature of 64 * SIGNATURE bits, one set per element: the bits in which two signatures differ are at most
    the elements in which the sets differ."""
    h = sets.where("size(grams) > 0").select("id", "grams", F.size("grams").alias("size"), F.transform("grams", lambda g: F.xxhash64(g)).alias("h"))
    one = F.lit(1).cast("bigint")
    word = lambda k: F.aggregate(F.filter("h", lambda v: F.pmod(v, F.lit(SIGNATURE)) == k), F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.shiftright(v, 8), F.lit(64)).cast("int"))))
    return h.select("id", "grams", "size", *[word(k).alias(f"s{k}") for k in range(SIGNATURE)])


def _prefix(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """The rarest grams of each set, as many as the threshold needs: ``id, gram, size`` and the signature."""
    signs = [f"s{k}" for k in range(SIGNATURE)]
    x = sets.select("id", "size", *signs, F.explode("grams").alias("gram")).join(frequency, "gram")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "gram"))
    return x.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1).select("id", F.xxhash64("gram").alias("gram"), "size", *signs)


def jaccard_join(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """Pairs of sets with a Jaccard similarity above ``threshold``, exactly. ``left``, ``right``: ``id, grams`` (distinct elements, unique ids).
    Without ``right`` a self-join with ``a < b``. Gives ``a, b, similarity``. Empty and null sets match nothing. Pairs that meet are
    first compared by their signatures: sets that are similar enough differ in at most (1 - t) / (1 + t) of their elements. Joins go over parts
    of the grams and of the pairs, all in turn: the shuffle files of a part are gone before the next."""
    left = written(_signed(left), "sets")
    same = right is None
    right = left if same else written(_signed(right), "sets")
    every = left if same else left.select("grams").unionByName(right.select("grams"))
    frequency = written(every.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")), "df")
    named = lambda x, p: x.select("gram", *[F.col(c).alias(p + c) for c in x.columns if c != "gram"])
    prefix = written(_prefix(left, frequency, threshold), "prefix")
    p, q = named(prefix, "l_"), named(prefix if same else written(_prefix(right, frequency, threshold), "prefix"), "r_")
    m, n = F.col("l_size"), F.col("r_size")
    differ = sum((F.bit_count(F.col(f"l_s{k}").bitwiseXOR(F.col(f"r_s{k}"))) for k in range(SIGNATURE)), F.lit(0))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        z = x.join(y.hint("merge"), "gram").where((m >= threshold * n) & (n >= threshold * m) & (differ <= (1 - threshold) / (1 + threshold) * (m + n) + 1e-9))
        return (z.where("l_id < r_id") if same else z).select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()

    def checked(x: DataFrame) -> DataFrame:
        g, h = left.select(F.col("id").alias("a"), F.col("grams").alias("g")), right.select(F.col("id").alias("b"), F.col("grams").alias("h"))
        z = x.join(g.hint("merge"), "a").join(h.hint("merge"), "b")
        return z.select("a", "b", tx.jaccard("g", "h").alias("similarity")).where(F.col("similarity") > threshold)

    part = lambda x, c, k, of: x.where(F.pmod(F.xxhash64(c), F.lit(of)) == k) if of > 1 else x
    of = min(PASSES, 1 + (p.count() + q.count()) // ROWS_AT_ONCE)
    pairs = written_parts((met(part(p, "gram", k, of), part(q, "gram", k, of)) for k in range(of)), "met")
    if of > 1:
        pairs = written(pairs.distinct(), "pairs")
    some = min(PASSES, 1 + pairs.count() // PAIRS_AT_ONCE)
    return written_parts((checked(part(pairs, "a", k, some)) for k in range(some)), "similar")


def shingle_pairs(records: DataFrame, threshold: float, width: int = 5, most: int | None = None) -> DataFrame:
    """Pairs of records of different families that share a run of ``width`` words and whose strict three-letter grams have a Jaccard similarity above
    ``threshold``. ``records``: ``id, family, text``. ``most``: leave out runs that more records have, as legacy reports do; by default
    none is left out: pairs that share only frequent runs are found as well, by the exact gram join beside."""
    r = records.select("id", "family", tx.tokens(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") > 0)
    r = written(r.select("id", "family", tx.shingles(F.col("t"), width).alias("runs"), tx.char_ngrams(F.array_join("t", " ")).alias("grams")), "runs")
    run = r.select("id", "family", F.explode("runs").alias("run")).withColumn("run", F.xxhash64("run"))
    if most is None:
        pairs = jaccard_join(r.select("id", "grams"), None, threshold).select("a", "b", "similarity")
        f = r.select("id", "family", "runs")
        x = pairs.join(f.select(F.col("id").alias("a"), F.col("family").alias("fa"), F.col("runs").alias("ra")), "a").join(f.select(F.col("id").alias("b"), F.col("family").alias("fb"), F.col("runs").alias("rb")), "b")
        return x.where((F.col("fa") != F.col("fb")) & F.arrays_overlap("ra", "rb")).select("a", "b", "similarity")
    some = run.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("run")
    kept = run.join(some, "run")
    pairs = kept.alias("x").join(kept.alias("y"), "run").where("x.id < y.id and x.family <> y.family").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    g = r.select("id", "grams")
    x = pairs.join(g.select(F.col("id").alias("a"), F.col("grams").alias("g")), "a").join(g.select(F.col("id").alias("b"), F.col("grams").alias("h")), "b")
    return x.select("a", "b", tx.jaccard("g", "h").alias("similarity")).where(F.col("similarity") > threshold)


def leaked(train: DataFrame, held: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Train records that leak held-out ones: the same normalised text, or grams more similar than the threshold. ``id, text`` each. Gives
    ``train_id, held_id, kind, similarity``."""
    n = lambda x, name: x.select(F.col("id").alias(name), tx.normalised("text").alias("n")).where("n <> ''")
    exact = n(train, "train_id").join(n(held, "held_id"), "n").select("train_id", "held_id", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))
    g = lambda x: x.where("text is not null").select("id", tx.char_ngrams("text").alias("grams"))
    near = jaccard_join(g(train), g(held), threshold).select(F.col("a").alias("train_id"), F.col("b").alias("held_id"), F.lit("near").alias("kind"), "similarity")
    return exact.unionByName(near.join(exact.select("train_id", "held_id"), ["train_id", "held_id"], "left_anti"))


def contamination(scores: DataFrame) -> DataFrame:
    """``scores``: ``qid, did, score, own, gold``. Per query: foreign candidates that score above its gold one."""
    g = scores.where("gold").groupBy("qid").agg(F.max("score").alias("g"))
    return scores.join(g, "qid").groupBy("qid").agg(F.count_if(~F.col("own") & (F.col("score") > F.col("g"))).alias("foreign_above"))
