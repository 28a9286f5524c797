"""Same or near-same records across splits (problem 4).

Records are cut into chunks at places their content defines: a rolling hash runs over the folded letters, a chunk ends where a word
ends, and its digest is the hash of its letters. Since any order of the words and three changed words of ten still make the same
record, longer chunks (ends only where the hash is divisible by some number) can't be kept: no common one is left. A
chunk has more digests, those of the chunks a slip apart (``near_dup.lexicon``), so that a slip spoils none.

Digests are joined across the splits: a row of the training split and one of an evaluation split meet under the digest of one of the
first chunks, in the order by weight, that they must share (``near_dup`` says which these are). In the join, the lengths of
the shared chunks, in words, are summed up over the two records' bit sets of chunks and digests; pairs with too little shared length go
no further. Digests that stand in many training records are cut into tiles. What is left is checked word by word.

Edge cases: families without a split, null and blank texts give no pair. Repeated rows and ids count once; copies of one text
are one class until pairs of records are asked for. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tezgah.llm import near_dup
from tezgah.llm.near_dup import agreement, bags, by_texts, classes, coded_classes, heavy_keys, keyed_parts, shuffled, with_bags
from tezgah.session import written, written_parts

WORDS = near_dup.BITS // 64
DIGESTS = "key bigint, cls bigint, t int, e int, n int, slack int, home boolean, " + ", ".join(f"{v}{k} bigint" for v in "xe" for k in range(WORDS))
#: Spellings of the splits.
SPLITS = {"train": "train", "development": "development", "dev": "development", "sealed_test": "sealed_test", "test": "sealed_test"}


def split_of(column: str) -> F.Column:
    """The split's canonical name, however typed; null for anything else."""
    key = F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-]+", "_")
    out = F.lit(None).cast("string")
    for spelling, name in SPLITS.items():
        out = F.when(key == spelling, F.lit(name)).otherwise(out)
    return out


def overlap(a: list[str], b: list[str]) -> float:
    """Letters of the shared chunks, equal ones or a slip apart, over the letters of the longer record."""
    x, y = Counter(a), Counter(b)
    both = x & y
    shared = sum(len(w) * c for w, c in both.items())
    free, other = x - both, y - both
    for w, partners in near_dup._links(list(free), list(other)).items():
        for v in partners:
            c = min(free[w], other[v])
            free[w] -= c
            other[v] -= c
            shared += c * min(len(w), len(v))
    return shared / max(1, sum(map(len, a)), sum(map(len, b)))


def _digest_rows(agree: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                row, code, of, near_code, n = near_dup.unpacked(b)
                slack = n - np.ceil(agree * n - 1e-9).astype(np.int64)
                x = near_dup._bits(row, code, len(n))
                e = x | near_dup._bits(row[of], near_code, len(n))
                r, key, home = near_dup.keys(row, code, of, near_code, n, slack)
                bits = [v.view(np.int64).reshape(len(n), WORDS)[r, k] for v in (x, e) for k in range(WORDS)]
                cols = [pa.array(key), *(b.column(c).take(pa.array(r)) for c in ("cls", "t", "e")), pa.array(n[r].astype(np.int32)), pa.array(slack[r].astype(np.int32)), pa.array(home), *map(pa.array, bits)]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in DIGESTS.split(", ")])

    return rows


def _measured(agree: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for a, b, x, y in zip(*(t.column(c).to_pylist() for c in ("train_cls", "eval_cls", "bag_a", "bag_b"))):
                if (s := agreement(x.split(" "), y.split(" "), agree)) >= agree - 1e-12:
                    out.append((a, b, overlap(x.split(" "), y.split(" ")), s))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["train_cls", "eval_cls", "overlap", "agreement"])

    return check


def class_overlaps(rows: DataFrame, agree: float = 0.7) -> DataFrame:
    """``rows``: ``id, cls, bag, is_train``. Pairs of a class of the training split and one of an evaluation split, equal ones too:
    ``train_cls, eval_cls, overlap, agreement``."""
    cls = classes(rows)
    side = written(rows.groupBy("cls").agg(F.max(F.col("is_train").cast("int")).alias("t"), F.max((~F.col("is_train")).cast("int")).alias("e")), "sides")
    digests = written_parts((x.join(shuffled(side), "cls").mapInArrow(_digest_rows(agree), DIGESTS) for x in coded_classes(cls)), "digests")
    lacks = lambda p, q: sum((F.bit_count(F.col(f"{p}.x{k}").bitwiseAND(F.bitwise_not(F.col(f"{q}.e{k}")))) for k in range(WORDS)), F.lit(0))
    shared = (F.col("a.n") - lacks("a", "b") >= F.col("a.n") - F.col("a.slack")) & (F.col("b.n") - lacks("b", "a") >= F.col("b.n") - F.col("b.slack"))
    fits = F.least("a.n", "b.n") >= F.ceil(F.lit(agree) * F.greatest("a.n", "b.n") - 1e-9)

    def met(some: DataFrame) -> DataFrame:
        tiled = some.join(F.broadcast(heavy_keys(some.where("t = 1"), near_dup.TILE)), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        train = tiled.where("t = 1").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).alias("a")
        held = tiled.where("e = 1").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("b")
        x = train.join(shuffled(held), (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") == F.col("b.tile")) & (F.col("a.cls") != F.col("b.cls")) & (F.col("a.home") | F.col("b.home")) & fits & shared)
        return x.select(F.col("a.cls").alias("train_cls"), F.col("b.cls").alias("eval_cls")).distinct()

    pairs = written_parts(map(met, keyed_parts(digests)), "met")
    near = written_parts((x.mapInArrow(_measured(agree), "train_cls bigint, eval_cls bigint, overlap double, agreement double") for x in with_bags(pairs, cls, "train_cls", "eval_cls")), "overlaps")
    same = side.where("t = 1 and e = 1").select(F.col("cls").alias("train_cls"), F.col("cls").alias("eval_cls"), F.lit(1.0).alias("overlap"), F.lit(1.0).alias("agreement"))
    return near.unionByName(same)


def with_split(queries: DataFrame, families: DataFrame) -> DataFrame:
    """``id, text, split, source_dataset`` of the queries whose family has a split. A family's rows are aggregated first."""
    fam = families.groupBy(F.col("family_id").alias("id")).agg(F.max(split_of("split_name")).alias("split"), F.max("source_dataset").alias("source_dataset")).where("split is not null")
    return queries.select(F.col("_id").alias("id"), "text").join(shuffled(fam), "id")


def _prepared(queries: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    q = with_split(queries, families)
    of = q.select("id", "split", "source_dataset").distinct()
    rows = bags(q).join(shuffled(of), "id").withColumn("is_train", F.col("split") == "train")
    rows = written(rows, "split-bags")
    return rows, rows.select("id", "cls", "split", "source_dataset", "is_train")


def split_overlaps(queries: DataFrame, families: DataFrame, agree: float = 0.7) -> DataFrame:
    """Pairs of records ``train_id, eval_id`` with their overlap fraction and agreement."""
    rows, m = _prepared(queries, families)
    found = class_overlaps(rows, agree)

    def pairs(p: DataFrame, q: DataFrame) -> DataFrame:
        t = p.where("is_train").select(F.col("id").alias("train_id"), F.col("cls").alias("train_cls"))
        e = q.where("not is_train").select(F.col("id").alias("eval_id"), F.col("cls").alias("eval_cls"))
        return found.join(shuffled(t), "train_cls").join(shuffled(e), "eval_cls").select("train_id", "eval_id", "overlap", "agreement")

    one, several = by_texts(m, "is_train")  # pairs of copies grow with their square: they aren't shuffled, but for ids with several texts
    more = pairs(several, one).unionByName(pairs(one, several)).unionByName(pairs(several, several))
    return pairs(one, one).unionByName(more.groupBy("train_id", "eval_id").agg(F.max("overlap").alias("overlap"), F.max("agreement").alias("agreement")))


def overlap_report(queries: DataFrame, families: DataFrame, agree: float = 0.7) -> DataFrame:
    """Per evaluation split and source: records, records that stand in the training split too, exactly or nearly, and the largest and
    mean overlap fraction of these. Classes are linked, not records: linear in copies."""
    rows, m = _prepared(queries, families)
    best = class_overlaps(rows, agree).groupBy("eval_cls").agg(F.max("overlap").alias("overlap"))
    e = m.where("not is_train").join(shuffled(best.withColumnRenamed("eval_cls", "cls")), "cls", "left").groupBy("id", "split", "source_dataset").agg(F.max("overlap").alias("overlap"))
    return e.groupBy("split", "source_dataset").agg(F.count("*").alias("records"), F.count("overlap").alias("overlapping"), F.max("overlap").alias("max_overlap"), F.avg("overlap").alias("mean_overlap"))
