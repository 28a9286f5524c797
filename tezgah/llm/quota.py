"""Sample matching target category proportions (problem 3).

Slots are counted by cell, the combination of their categories on all axes. Inclusion probabilities of the cells are raked
(iterative proportional fitting, none above 1) so that the expected shares match the targets of every axis at once. Then a
systematic sample is drawn over the slots: they are range-partitioned in the order of their cells and, within a cell, of a random
number; every partition sums up its probabilities, the sums of the partitions before it are added, and a slot is taken where the
running sum passes an integer beyond one random start. The draw is counted by cell, and floors are repaired: single picks move
between cells until every category has greatest(min_rows, floor(share * n)), as far as the supply and the other axes let it; the moves
are carried out on the slots of a cell that come first in its random order, found per partition before they are compared.

The number of cells is bounded by the targets (each axis has its listed categories and "none"), so the cell table, and only it, is
handled by the driver, and a number per partition.

Edge cases: of stale versions of a slot the latest counts for the draw; for the supply, which says whether a category can be met at all, a
slot counts for every category that any of its versions states. Null categories belong to none, and slots with one are taken only if a
total can't be reached otherwise. Repeated target rows count once. No slots or no targets give an empty sample. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tezgah.session import written

#: Single moves of the repair, at most, per category and axis.
MOVES = 200
REPORT = "axis string, category string, target_share double, min_rows int, needed bigint, supply bigint, sampled bigint, short boolean, met boolean"


def category_key(c: F.Column) -> F.Column:
    """Letter case, spacing and separators make no difference; empty is null."""
    k = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return F.when(k == "", None).otherwise(k)


def latest_slots(slots: DataFrame, axes: list[str]) -> DataFrame:
    """One row per slot id with its categories' keys, of its latest version; among equally late ones the greatest."""
    version = F.struct(F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp")).alias("at"), *[category_key(F.col(a)).alias(a) for a in axes])
    return slots.where("slot_id is not null").groupBy("slot_id").agg(F.max(version).alias("v")).select("slot_id", *[F.col(f"v.{a}").alias(a) for a in axes])


def _rake(cells: pd.DataFrame, want: dict[str, dict[str, float]], n: int, rounds: int = 200) -> np.ndarray:
    """Inclusion probabilities of the cells."""
    size = cells["n"].to_numpy(float)
    p = np.full(len(cells), min(1.0, n / max(1.0, size.sum())))
    masks = [(t, [(cells[axis].to_numpy() == c) for c in t]) for axis, t in want.items()]
    for _ in range(rounds):
        worst = 0.0
        for t, ms in masks:
            for m, target in zip(ms, t.values()):
                now = float((size * p)[m].sum())
                if now > 0:
                    f = target / now
                    worst = max(worst, abs(f - 1))
                    p[m] = np.minimum(1.0, p[m] * f)
            other = ~np.any(ms, axis=0) if ms else np.zeros(len(p), bool)
            p[other] *= 0.5
        if worst < 1e-6:
            break
    for _ in range(50):  # the total, without passing 1
        free = p < 1
        s = float((size * p).sum())
        if abs(s - n) < 1e-9 or not free.any():
            break
        room = float((size * p)[free].sum())
        if room <= 1e-9:
            p[free] = np.minimum(1.0, p[free] + (n - s) / max(1.0, size[free].sum()))
        else:
            p[free] = np.clip(p[free] * max(0.0, (n - s + room) / room), 0, 1)
    return p


def _wanted(supply: dict[str, int], share: dict[str, float], n: int) -> dict[str, float]:
    """Counts per category in proportion to the shares, as far as the supply goes; what is short is spread over the others."""
    want = {c: 0.0 for c in share}
    open_ = {c for c in share if supply.get(c, 0) > 0 and share[c] > 0}
    left = float(n)
    while open_ and left > 1e-9:
        s = sum(share[c] for c in open_)
        full = {c for c in open_ if want[c] + left * share[c] / s >= supply[c]}
        if not full:
            for c in open_:
                want[c] += left * share[c] / s
            break
        for c in full:
            left -= supply[c] - want[c]
            want[c] = supply[c]
        open_ -= full
    return want


#: How much more a pick below min_rows counts than one below the share.
FLOOR_WEIGHT = 100.0


def _repair(cells: pd.DataFrame, picks: np.ndarray, needed: dict[tuple[str, str], int], least: dict[tuple[str, str], int], n: int) -> np.ndarray:
    """Moves single picks between cells until no move brings the categories nearer to what they need, with n picks in all. What a
    category lacks counts, below its least number far more than below its share; of moves that gain the same, those that take from the categories with most to spare come first."""
    size, picks = cells["n"].to_numpy(), picks.copy()
    names = list(needed)
    member = np.array([(cells[a].to_numpy() == c) for a, c in names]) if names else np.zeros((0, len(cells)), bool)
    need = np.array([min(needed[k], int(size[m].sum())) for k, m in zip(names, member)])
    floor = np.minimum(need, [least[k] for k in names])
    for _ in range(MOVES * max(1, len(names))):
        have = member @ picks
        total = int(picks.sum())
        lacks = (need - have).clip(0)
        up = np.where(have < floor, FLOOR_WEIGHT, (have < need).astype(float))  # what a pick more is worth, and a pick less costs
        down = np.where(have <= floor, FLOOR_WEIGHT, (have <= need).astype(float))
        gain = (up @ member) - 1e-3 * ((have - need).clip(0) / np.maximum(need, 1)) @ member
        loss = (down @ member) - 1e-3 * ((have - need).clip(0) / np.maximum(need, 1)) @ member
        add = np.where(picks < size, gain, -np.inf)
        drop = np.where(picks > 0, loss, np.inf)
        if total > n:
            picks[drop.argmin()] -= 1
        elif total < n and (picks < size).any():
            picks[add.argmax()] += 1
        elif lacks.sum() and (best := _move(member, up, down, add, drop)):
            picks[best[0]] += 1
            picks[best[1]] -= 1
        else:
            break
    return picks


def _move(member: np.ndarray, up: np.ndarray, down: np.ndarray, add: np.ndarray, drop: np.ndarray) -> tuple[int, int] | None:
    """The cells to add to and to take from that lessen what is lacking most, if any do; categories of both cells stay as they are."""
    best, found = 0.5, None
    for i in np.argsort(-add, kind="stable")[:64]:
        if add[i] <= 0 or not np.isfinite(add[i]):
            break
        own = member[:, i]
        change = np.where(own, up, 0) @ (~member).astype(float) - np.where(own, 0, down) @ member  # without the categories they share
        change = np.where(np.isfinite(drop), change - 1e-3 * np.where(np.isfinite(drop), drop, 0), -np.inf)
        change[i] = -np.inf
        j = int(change.argmax())
        if change[j] > best:
            best, found = change[j], (int(i), j)
    return found


def _first_of_cells(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Of each cell the ``k`` rows with the least random number: the first of each partition, and of these the first."""
    x = rows.join(F.broadcast(moves), "cell")
    for by in (["cell", "part"], ["cell"]):
        x = x.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h", "slot_id"))).where(F.col("place") <= F.col("k"))
    return x


def quota_sample(slots: DataFrame, targets: DataFrame, fraction: float = 0.25, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(sample, report). Sample: ``slot_id`` and its category keys. Report, a row per row of ``targets``: axis, category, target
    share, min rows, ``needed`` = greatest(min_rows, floor(share * n)), ``supply``, ``sampled``, ``short`` (the slots offer fewer than
    needed) and ``met`` (the sample holds at least min rows and the floor of the share)."""
    spark = slots.sparkSession
    goal = targets.select("axis", "category", category_key(F.col("category")).alias("key"), "target_share", "min_rows").distinct().toPandas()  # a few rows per category
    axes = sorted(set(goal["axis"]))
    if not axes:
        return slots.select("slot_id").limit(0), spark.createDataFrame([], REPORT)
    rows = written(latest_slots(slots, axes), "slots")
    known = rows
    for a in axes:
        keys = sorted(k for k in goal[goal["axis"] == a]["key"] if k)
        known = known.withColumn(a, F.when(F.col(a).isin(keys), F.col(a)))
    cells = known.groupBy(*axes).agg(F.count("*").alias("n")).toPandas()  # at most the product of the axes' categories
    cells[axes] = cells[axes].astype(object).where(cells[axes].notna(), "")
    cells = cells.sort_values(axes).reset_index(drop=True)
    total = int(cells["n"].sum())
    n = math.floor(fraction * total)
    supply = {a: cells.groupby(a)["n"].sum().to_dict() for a in axes}
    offered = _offered(slots, axes, [(r.axis, r.key) for r in goal.itertuples() if r.key])
    share = {a: {r.key: float(r.target_share) for r in goal[goal["axis"] == a].itertuples() if r.key} for a in axes}
    want = {a: _wanted(supply[a], share[a], n) for a in axes}
    least = {(r.axis, r.key): int(r.min_rows) for r in goal.itertuples() if r.key}
    needs = {(r.axis, r.key): max(int(r.min_rows), math.floor(r.target_share * n)) for r in goal.itertuples() if r.key}
    cells["cell"] = np.arange(len(cells))
    cells["p"] = _rake(cells, want, n) if n else 0.0
    start = float(np.random.default_rng(seed).random())
    plan = F.broadcast(spark.createDataFrame([(*r[: len(axes)], int(r.cell), float(r.p)) for r in cells[[*axes, "cell", "p"]].itertuples(index=False)], ", ".join([f"{a} string" for a in axes] + ["cell int", "p double"])))
    keyed = known.select("slot_id", *[F.coalesce(a, F.lit("")).alias(a) for a in axes]).join(plan, axes).select("slot_id", "cell", "p", F.xxhash64("slot_id", F.lit(seed)).alias("h"))
    ordered = written(keyed.repartitionByRange("cell", "h", "slot_id").withColumn("part", F.spark_partition_id()), "ordered")
    sums = ordered.groupBy("part").agg(F.sum("p").alias("s")).orderBy("part").collect()  # a row per partition
    before = F.broadcast(spark.createDataFrame([(r["part"], float(b)) for r, b in zip(sums, np.cumsum([0.0, *(r["s"] for r in sums)]))], "part int, before double"))
    run = Window.partitionBy("part").orderBy("cell", "h", "slot_id").rowsBetween(Window.unboundedPreceding, 0)
    passed = ordered.join(before, "part").withColumn("upto", F.col("before") + F.sum("p").over(run) + F.lit(start))
    drawn = written(passed.select("slot_id", "cell", "h", "part", ((F.floor("upto") > F.floor(F.col("upto") - F.col("p"))) & (F.col("p") > 0)).alias("taken")), "drawn")
    counts = {r["cell"]: r["c"] for r in drawn.where("taken").groupBy("cell").agg(F.count("*").alias("c")).collect()}  # a row per cell
    first = np.array([counts.get(c, 0) for c in cells["cell"]], np.int64)
    cells["picks"] = _repair(cells, first, needs, least, n)
    moved = cells["picks"].to_numpy() - first
    moves = lambda sign: spark.createDataFrame([(int(c), int(k)) for c, k in zip(cells["cell"], sign * moved) if k > 0], "cell int, k int")
    gone = _first_of_cells(drawn.where("taken"), moves(-1)).select("slot_id")
    more = _first_of_cells(drawn.where("not taken"), moves(1)).select("slot_id", "cell")
    chosen = drawn.where("taken").join(gone, "slot_id", "left_anti").select("slot_id", "cell").unionByName(more)
    sample = chosen.join(plan, "cell").select("slot_id", *[F.when(F.col(a) != "", F.col(a)).alias(a) for a in axes])
    sampled = {a: cells.groupby(a)["picks"].sum().to_dict() for a in axes}
    out = []
    for r in goal.sort_values(["axis", "category"]).itertuples():
        needed = max(int(r.min_rows), math.floor(r.target_share * n))
        have, got = int(offered.get((r.axis, r.key), 0)), int(sampled[r.axis].get(r.key, 0))
        out.append((r.axis, r.category, float(r.target_share), int(r.min_rows), needed, have, got, have < needed, got >= needed))
    report = spark.createDataFrame(out, REPORT)
    return sample, report


def _offered(slots: DataFrame, axes: list[str], keys: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Slots that state a category of the targets, in any of their versions."""
    each = slots.where("slot_id is not null").select("slot_id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), category_key(F.col(a)).alias("key")) for a in axes])).alias("c")).select("slot_id", "c.*")
    stated = each.join(F.broadcast(slots.sparkSession.createDataFrame(sorted(set(keys)), "axis string, key string")), ["axis", "key"])
    return {(r["axis"], r["key"]): r["n"] for r in stated.distinct().groupBy("axis", "key").agg(F.count("*").alias("n")).collect()}
