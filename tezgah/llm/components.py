"""Splits that keep related records together (problem 5).

Records that share a critical lemma or a template are tied. Adjacency lists are kept as rows, hash-partitioned by node, so that a node
of any degree is spread. Every node that is least among its neighbours by a hash is a seed: from any node a path of smaller
and smaller hashes leads to one. All seeds expand their frontiers at once, breadth first: a round joins the frontier with the
adjacency rows, unvisited neighbours take the least label that reaches them and are the next frontier, and where a label
reaches a node of another label, the two labels collide. When no frontier is left, the collisions are a graph of seed labels, which is
small beside the first: it is merged in the same way until at most ``SMALL`` collisions are left, and these, a bounded number, by the
driver. Nodes, links and components stay in tables.

Components are then laid end to end in the order of a hash, and each goes, whole, to the split in whose stretch its middle falls. Of
``TRIES`` hashes the one whose splits come closest to the targets is taken.

Edge cases: missing and stand-in values tie nothing, and a record with neither key is a component of its own. Repeated rows count
once. Nulls in ids are dropped: they name no record. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tezgah.llm.chunks import split_of
from tezgah.session import written

#: What is written where a value is missing.
STAND_INS = ["", "na", "none", "null", "nan", "bilinmiyor", "unknown", "yok", "belirsiz", "undefined"]
#: Accented letters of the data and the plain ones, in the same order.
ACCENTED, PLAIN = "çğıöşüâîûéèêáàäëïñóòôúùİI", "cgiosuaiueeeaaaeinooouuii"
#: Collisions of labels that the driver merges itself; more of them are merged by frontiers again. The components are the same.
SMALL = 50_000
#: Hashes among which the order of the components is chosen.
TRIES = 16


def _plain(c: F.Column) -> F.Column:
    bare = F.regexp_replace(F.translate(F.lower(F.translate(c, "Iİ", "ıi")), ACCENTED, PLAIN), r"\p{M}", "")
    return bare


def lemma_key(column: str) -> F.Column:
    """A verb without its infinitive ending, however typed; null if missing."""
    k = F.regexp_replace(_plain(F.col(column)), r"[^\p{L}\p{N}]", "")
    return F.when(k.isin(STAND_INS), None).otherwise(F.regexp_replace(k, r"(?<=..)m[ae]k$", ""))


def template_key(column: str) -> F.Column:
    """Base name and instance number, however typed; null if either is missing."""
    k = _plain(F.col(column))
    base = F.regexp_replace(F.regexp_extract(k, r"^(.*?)[^\p{L}\p{N}]*[0-9]+[^\p{L}\p{N}]*$", 1), r"[^\p{L}\p{N}]", "")
    number = F.regexp_extract(k, r"([0-9]+)[^\p{L}\p{N}]*$", 1)
    stated = (base != "") & (number != "") & ~base.isin(STAND_INS)
    return F.when(stated, F.concat_ws(".", base, F.regexp_replace(number, r"^0+(?=.)", "")))


def frontiers(adjacent: DataFrame, turn: int = 0, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """``adjacent``: ``x, y``, each link in both directions. (labels, collisions): ``node, label`` of every node, the seed it was
    reached from, and the pairs ``a < b`` of labels that touch."""
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("v"))
    least = adjacent.groupBy("x").agg(F.min(rank("y")).alias("m"))
    seeds = written(least.where(rank("x") < F.col("m")).select(F.col("x").alias("node"), F.col("x").alias("label")), "seeds")
    visited, frontier, collisions = [seeds], seeds, []
    for _ in range(most):
        reached = frontier.join(adjacent, frontier["node"] == adjacent["x"]).groupBy(F.col("y").alias("node"), "label").agg(F.lit(1).alias("one"))
        before = visited[0]
        for v in visited[1:]:
            before = before.unionByName(v)
        first = Window.partitionBy("node")  # as many rows as labels touch a node
        met = written(reached.join(before.withColumnRenamed("label", "old"), "node", "left").select("node", "label", "old", F.coalesce("old", F.min("label").over(first)).alias("now")), "reached")
        collisions.append(met.where("label <> now").select(F.least("label", "now").alias("a"), F.greatest("label", "now").alias("b")))
        frontier = met.where("old is null and label = now").select("node", "label")
        if not frontier.take(1):
            break
        visited.append(frontier)
    else:
        raise RuntimeError(f"frontiers did not end in {most} rounds")
    out, touch = visited[0], collisions[0]
    for v in visited[1:]:
        out = out.unionByName(v)
    for c in collisions[1:]:
        touch = touch.unionByName(c)
    return out, touch.distinct()


def _merged(labels: DataFrame, touch: list) -> DataFrame:
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in touch:
        up[top(b)] = top(a)
    if not up:
        return labels
    name = F.broadcast(labels.sparkSession.createDataFrame([(x, top(x)) for x in up], "component bigint, top bigint"))  # at most 2 * SMALL rows
    return labels.join(name, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``links``: two columns of bigint node ids, in any order and number. One row per node that has a link to another:
    ``node, component``, the same for all nodes that are connected."""
    a, b = links.columns[:2]
    edges = written(links.select(F.least(a, b).cast("bigint").alias("a"), F.greatest(a, b).cast("bigint").alias("b")).where("a <> b").distinct(), "edges")
    out = None
    for turn in range(most):
        if out is not None and len(last := edges.limit(SMALL + 1).collect()) <= SMALL:
            return _merged(out, last)
        both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
        label, touch = frontiers(written(edges.select(both.alias("e")).select("e.x", "e.y"), "adjacent"), turn)
        edges = written(touch, "touch")
        if out is None:
            out = label.select("node", F.col("label").alias("component"))
        else:
            out = out.join(label.select(F.col("node").alias("component"), "label"), "component", "left").select("node", F.coalesce("label", "component").alias("component"))
    raise RuntimeError(f"components did not settle in {most} rounds")


def family_components(families: DataFrame) -> DataFrame:
    """One row per family: ``family_id, split, component``. Of repeated rows any stated value counts."""
    f = families.where("family_id is not null").select("family_id", split_of("split_name").alias("split"), lemma_key("critical_lemma").alias("l"), template_key("template_id").alias("t"))
    node = lambda kind, c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(kind), F.col(c)))
    f = written(f.select("family_id", "split", node("lemma", "l").alias("l"), node("template", "t").alias("t")).distinct(), "keys")
    split = f.groupBy("family_id").agg(F.max("split").alias("split"), F.max("l").alias("l"), F.max("t").alias("t"))
    one = written(split, "families")
    # rows of one family may state different values; all of them tie
    ties = f.where("l is not null and t is not null").select("l", "t").distinct().unionByName(f.join(one.select("family_id", F.col("l").alias("l2"), F.col("t").alias("t2")), "family_id").where("l <> l2 or t <> t2").select(F.explode(F.array(F.struct(F.col("l2").alias("l"), F.col("l").alias("t")), F.struct(F.col("t2").alias("l"), F.col("t").alias("t")))).alias("e")).select("e.l", "e.t").where("l is not null and t is not null"))
    label = written(components(ties), "labels")
    own = F.coalesce("l", "t", F.xxhash64(F.lit("family"), F.col("family_id")))
    keyed = one.select("family_id", "split", own.alias("node"))
    return keyed.join(label, "node", "left").select("family_id", "split", F.coalesce("component", "node").alias("component"))


def broken(families: DataFrame) -> DataFrame:
    """Families with a split whose component has families of another split: ``family_id, split, component, splits``."""
    f = written(family_components(families), "components")
    mixed = f.where("split is not null").groupBy("component").agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
    return f.where("split is not null").join(mixed, "component").select("family_id", "split", "component", "splits")


def assign_splits(families: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """One row per family: ``family_id, component, split_name``; components stay whole, in the order of a hash, each in the split in
    whose stretch its middle falls. ``targets``: ``split_name, target_share`` (a few rows); without targets, the split is null."""
    f = written(family_components(families).select("family_id", "component"), "components")
    size = written(f.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    total = size.agg(F.sum("n")).first()[0] or 0
    shares = [(r[0], float(r[1])) for r in targets.select("split_name", "target_share").orderBy(F.desc("target_share"), "split_name").collect()]
    if not shares or not total:
        return f.select("family_id", "component", F.lit(None).cast("string").alias("split_name"))
    scale = sum(s for _, s in shares)
    tried = size.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1)))).withColumn("h", F.xxhash64("component", F.lit(seed), "k")).withColumn("bucket", F.shiftrightunsigned("h", 52))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows each
    starts = tried.groupBy("k", "bucket").agg(F.sum("n").alias("s")).select("k", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("k", "bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("n").over(within) - F.col("n") / 2
    name, end = F.lit(shares[-1][0]), total
    for s, share in reversed(shares[:-1]):
        end -= total * dict(shares)[_next(shares, s)] / scale
        name = F.when(F.col("middle") <= float(end), F.lit(s)).otherwise(name)
    placed = written(tried.join(F.broadcast(starts), ["k", "bucket"]).withColumn("middle", middle).select("k", "component", "n", name.alias("split_name")), "placed")
    got = {(r["k"], r["split_name"]): r["n"] for r in placed.groupBy("k", "split_name").agg(F.sum("n").alias("n")).collect()}  # TRIES times the splits
    best = min(range(TRIES), key=lambda k: (sum(abs(got.get((k, s), 0) - total * x / scale) for s, x in shares), k))
    return f.join(placed.where(F.col("k") == best).select("component", "split_name"), "component").select("family_id", "component", "split_name")


def _next(shares: list[tuple[str, float]], split: str) -> str:
    names = [s for s, _ in shares]
    return names[names.index(split) + 1]


def balance(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: target share, families and share reached."""
    n = assigned.groupBy("split_name").agg(F.count("*").alias("families"))
    total = n.agg(F.sum("families").alias("total"))
    return targets.join(n, "split_name", "left").crossJoin(F.broadcast(total)).select("split_name", "target_share", F.coalesce("families", F.lit(0)).alias("families"), (F.coalesce("families", F.lit(0)) / F.col("total")).alias("share"))
