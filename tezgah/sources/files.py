"""Sources and sinks: JSON envelopes, JSON lines, qrels, BEIR folders, training views, manifests.

All reads are distributed and take an explicit schema where one is fixed. A missing path is an empty table where callers expect that.
"""

from __future__ import annotations

import glob
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QRELS = "query_id string, corpus_id string, relevance double"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a damaged line is an error, a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_items(spark: SparkSession, path: str, item: str | T.StructType, box: str = "items") -> DataFrame:
    """One JSON document per file: a bare list of items, or an envelope ``{"items": [...]}`` with the list under the name ``box``."""
    item = T._parse_datatype_string(item) if isinstance(item, str) else item
    text = spark.read.text(path, wholetext=True).select(F.col("value"))
    listed = F.from_json("value", T.ArrayType(item), {"mode": "FAILFAST"})
    boxed = F.from_json("value", T.StructType([T.StructField(box, T.ArrayType(item))]), {"mode": "FAILFAST"})[box]
    lists = text.where(F.ltrim("value").startswith("[")).select(F.inline(listed))
    return lists.unionByName(text.where(~F.ltrim("value").startswith("[")).select(F.inline(boxed)))


def read_flexible(spark: SparkSession, path: str, item: str | T.StructType, box: str = "items") -> DataFrame:
    """By suffix: ``.jsonl`` as lines, anything else as items."""
    return read_jsonl(spark, path, item) if path.endswith(".jsonl") else read_items(spark, path, item, box)


def read_decisions(spark: SparkSession, path: str, decision: str | T.StructType) -> DataFrame:
    """Review decisions: a list, an envelope ``{"decisions": [...]}``, or JSON lines."""
    return read_flexible(spark, path, decision, "decisions")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, corpus_id, relevance`` from TSV (``query-id, corpus-id, score``) or JSON lines (``relevance`` or ``score``)."""
    if path.endswith(".jsonl"):
        x = read_jsonl(spark, path, "query_id string, corpus_id string, relevance double, score double")
        return x.select("query_id", "corpus_id", F.coalesce("relevance", "score", F.lit(0.0)).alias("relevance"))
    x = spark.read.csv(path, sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score double")
    return x.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"), F.col("score").alias("relevance"))


def check_binary(qrels: DataFrame) -> DataFrame:
    """Queries that break the binary contract: a relevance other than 0 or 1, no positive, or no explicit negative."""
    x = qrels.groupBy("query_id").agg(F.count_if(~F.col("relevance").isin(0.0, 1.0)).alias("other"), F.count_if(F.col("relevance") == 1).alias("positives"), F.count_if(F.col("relevance") == 0).alias("negatives"))
    return x.where("other > 0 or positives = 0 or negatives = 0")


def newest(pattern: str) -> str | None:
    """The file of the greatest version ``_v<number>...`` that matches a pattern."""
    version = lambda p: [int(x) for x in re.findall(r"\d+", os.path.basename(p).rpartition("_v")[2])]
    return max(glob.glob(pattern), key=lambda p: (version(p), p), default=None)


def read_env(path: str) -> dict[str, str]:
    """``NAME=value`` lines of a file; comments, blank values and lines of other form are skipped, quotes around a value taken off."""
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = (re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(?:(['\"])(.+)\2|(.+?))\s*", line) for line in f)
        return {m[1]: m[3] or m[4] for m in found if m}


def read_config(path: str, env: dict[str, str] | None = None, env_file: str | None = None, required: bool = False) -> dict:
    """A JSON configuration. At any depth, a string that begins with ``${NAME}`` or ``${NAME:-default}`` is the variable's value, or the
    default; with neither it stays as it is, or is an error if ``required``. ``env_file`` adds variables and overrides none."""
    env = (read_env(env_file) if env_file else {}) | (dict(os.environ) if env is None else env)

    def fill(v):
        if isinstance(v, dict):
            return {k: fill(x) for k, x in v.items()}
        if isinstance(v, list):
            return [fill(x) for x in v]
        m = re.match(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}", v) if isinstance(v, str) else None
        if m is None:
            return v
        value = env.get(m[1]) or m[2]
        if required and not value:
            raise ValueError(f"{m[1]} isn't set")
        return value or v

    with open(path, encoding="utf-8") as f:
        return fill(json.load(f))


def find_parquet(spark: SparkSession, root: str, config: str, split: str | None = None) -> list[str]:
    """Parquet files of a configuration of a dataset folder: of its own folder, else of ``data``, else any below that name it; of these the
    ones that name the split, if any do. Listed by Hadoop's file system, so that the folder may lie anywhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return []
    walk, every = fs.listFiles(path(root), True), []
    while walk.hasNext():
        every.append(walk.next().getPath().toString())
    base = fs.makeQualified(path(root)).toString().rstrip("/") + "/"
    below = sorted(f.removeprefix(base) for f in every if f.endswith(".parquet"))
    named = re.compile(rf"(^|[/_.-]){re.escape(config)}([/_.-]|$)")
    for fits in (lambda f: f.startswith(f"{config}/"), lambda f: f.startswith("data/") and named.search(f), named.search):
        if some := [f for f in below if fits(f)]:
            of_split = [f for f in some if split and re.search(rf"(^|[/_.-]){re.escape(split)}([/_.-]|$)", f)]
            return [base + f for f in (of_split or some)]
    return []


def _assembled(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = F.trim(F.concat_ws(" ", F.nullif(F.trim("title"), F.lit("")), "text")).alias("text")
    queries = queries.join(qrels.select(F.col("query_id").alias("_id")).distinct(), "_id", "left_semi")
    if most is None:
        return corpus.select("_id", text), queries, qrels
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place")  # rows of a block are read in order
    corpus = corpus.select("_id", text, place)
    judged = qrels.select(F.col("corpus_id").alias("_id")).distinct()
    gold = corpus.join(judged, "_id", "left_semi").drop("place")
    rest = corpus.join(judged, "_id", "left_anti").orderBy("place").limit(max(0, most - gold.count())).drop("place")
    return gold.unionByName(rest), queries, qrels


def read_beir_parquet(spark: SparkSession, root: str, split: str = "test", most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``read_beir``, of a folder with Parquet files of the configurations ``corpus``, ``queries`` and ``qrels`` (or ``default``), wherever
    ``find_parquet`` finds them. Columns may be called ``_id`` or ``id``, ``query-id`` or ``query_id``, and so on."""

    def read(*configs: str, of: str | None = None) -> DataFrame:
        files = next((f for c in configs if (f := find_parquet(spark, root, c, of))), None)
        if files is None:
            raise FileNotFoundError(f"no Parquet files of {' or '.join(configs)} in {root}")
        return spark.read.parquet(*files)

    def named(df: DataFrame, new: str, *old: str) -> F.Column:
        found = next((c for c in (new, *old) if c in df.columns), None)
        return (F.col(f"`{found}`") if found else F.lit(None)).cast("string").alias(new)

    corpus, queries, qrels = read("corpus"), read("queries"), read("qrels", "default", of=split)
    score = next(c for c in ("score", "relevance") if c in qrels.columns)
    corpus = corpus.select(named(corpus, "_id", "id"), named(corpus, "title"), named(corpus, "text"), F.col("_metadata")) if most is not None else corpus.select(named(corpus, "_id", "id"), named(corpus, "title"), named(corpus, "text"))
    return _assembled(corpus, queries.select(named(queries, "_id", "id"), named(queries, "text")), qrels.select(named(qrels, "query_id", "query-id"), named(qrels, "corpus_id", "corpus-id"), F.col(score).cast("double").alias("relevance")), most)


def read_beir(spark: SparkSession, folder: str, split: str = "test", most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a BEIR folder of JSON lines. Document text is title and text; queries are those with judgements. ``most``: corpus
    cap that keeps every judged document and fills up in the order of the files."""
    corpus = read_jsonl(spark, f"{folder}/corpus.jsonl", "_id string, title string, text string")
    queries = read_jsonl(spark, f"{folder}/queries.jsonl", "_id string, text string")
    return _assembled(corpus, queries, read_qrels(spark, f"{folder}/qrels/{split}.tsv"), most)


def write_beir(families: DataFrame, folder: str, gold_only: bool = False) -> None:
    """``families``: ``query_id, query, candidates array<struct<id, role, text, relevance>>``. Writes corpus (one row per id), queries, candidate pool and qrels:
    all graded candidates, or the gold one only with the hard negatives beside."""
    c = families.select("query_id", F.explode("candidates").alias("c")).select("query_id", "c.*")
    c.groupBy(F.col("id").alias("_id")).agg(F.min("text").alias("text")).select("_id", F.lit("").alias("title"), "text").write.mode("overwrite").json(f"{folder}/corpus.jsonl")
    families.select(F.col("query_id").alias("_id"), F.col("query").alias("text")).write.mode("overwrite").json(f"{folder}/queries.jsonl")
    families.select("query_id", F.transform("candidates", lambda x: x["id"]).alias("candidates")).write.mode("overwrite").json(f"{folder}/candidate_pool.jsonl")
    q = c.where("relevance > 0") if gold_only else c
    q.select(F.col("query_id").alias("query-id"), F.col("id").alias("corpus-id"), F.col("relevance").alias("score")).write.mode("overwrite").option("header", True).csv(f"{folder}/qrels/test.tsv", sep="\t")
    if gold_only:
        rest = lambda x: x["relevance"] <= 0
        families.select("query_id", F.filter("candidates", lambda x: x["relevance"] > 0)[0]["id"].alias("gold_id"), F.transform(F.filter("candidates", rest), lambda x: F.struct(x["id"].alias("id"), x["role"].alias("role"))).alias("negatives")).write.mode("overwrite").json(f"{folder}/hard_negatives.jsonl")


def grouped_view(families: DataFrame, difficulty: dict[str, int]) -> DataFrame:
    """One row per query: gold text and its negatives, from easy to hard, in parallel arrays; equally hard ones keep their order."""
    level = F.coalesce(*[F.when(F.col("c.role") == k, F.lit(v)) for k, v in difficulty.items()], F.lit(0))
    x = families.select("query_id", "query", F.posexplode("candidates").alias("pos", "c")).withColumn("level", level)
    gold = F.max(F.when(F.col("c.relevance") > 0, F.col("c.text"))).alias("positive")
    rows = F.sort_array(F.collect_list(F.when(F.col("c.relevance") <= 0, F.struct("level", "pos", F.col("c.text").alias("text"), F.col("c.role").alias("role"))))).alias("n")
    g = x.groupBy("query_id", "query").agg(gold, rows)
    return g.select("query_id", "query", "positive", *[F.col(f"n.{f}").alias(a) for f, a in (("text", "negatives"), ("role", "negative_types"), ("level", "difficulty_rank"))])


def paired_view(families: DataFrame) -> DataFrame:
    """One row per gold and negative candidate."""
    gold = F.filter("candidates", lambda x: x["relevance"] > 0)[0]["text"].alias("gold")
    return families.select("query_id", "query", gold, F.explode(F.filter("candidates", lambda x: x["relevance"] <= 0)).alias("c")).select("query_id", "query", "gold", F.col("c.text").alias("negative"), F.col("c.role").alias("negative_type"))


def append_jsonl(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Appends rows; with ``order``, each gets a ``seq`` behind those that are there: a number per batch and the row's place in it."""
    if order is None:
        rows.write.mode("append").json(path)
        return
    spark = rows.sparkSession
    last = spark.read.schema("seq bigint").json(path).agg(F.max("seq")).first()[0] if _exists(spark, path) else None
    batch = 0 if last is None else (last >> 40) + 1
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    spread = F.spark_partition_id().cast("bigint") * (1 << 24) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 24) - 1))  # ranges in order, rows in order
    ranged.select(*rows.columns, (F.lit(batch << 40) + spread).alias("seq")).write.mode("append").json(path)


def write_atomic(rows: DataFrame, path: str) -> None:
    """Replaces a JSON folder: the new one is written beside it and takes its name once it is complete, so that a failed write leaves the old."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").json(f"{path}.tmp")
    if fs.exists(place(path)):
        fs.delete(place(f"{path}.old"), True)
        fs.rename(place(path), place(f"{path}.old"))
    fs.rename(place(f"{path}.tmp"), place(path))
    fs.delete(place(f"{path}.old"), True)


def freeze(families: DataFrame, blockers: DataFrame, folder: str) -> DataFrame:
    """Writes the frozen set, if no blocker is left: blind families (ids and texts alone), the complete ones, and the manifest of all files with
    their hashes, which is returned. With blockers, they are written and nothing else."""
    if blockers.take(1):
        write_atomic(blockers, f"{folder}/blockers")
        raise ValueError(f"blockers are left: {folder}/blockers")
    blind = families.select("query_id", "query", F.transform("candidates", lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"))).alias("candidates"))
    write_atomic(blind, f"{folder}/blind")
    write_atomic(families, f"{folder}/internal")
    return manifest(families.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, sha256`` of every file below a folder, hashed by the tasks."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return x.select(F.regexp_replace("path", "^.*?" + re.escape(os.path.basename(folder.rstrip("/"))) + "/", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).where(~F.col("path").rlike(r"(^|/)[._]"))
