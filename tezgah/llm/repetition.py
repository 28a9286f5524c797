"""Repetition inside a single document (problem 8).

Two passes. The first gives every document a vector of three cheap statistics, transformed to a scale on which they spread evenly:
the share of its places at which four words begin that stood before, the share of its distinct words that begin such a place,
and how often its words recur. Per language and source, per language and over all, a minimum-covariance-determinant estimate
gives a robust centre and scatter of these vectors, and documents whose Mahalanobis distance, towards more repetition,
exceeds the chi-square cut are rejected. The second pass measures rejected documents exactly: which words stand in wording that
already stood earlier, five words in a row, or eight of which one may be exchanged. The first occurrence never counts.
A rejected document is ``heavy`` if that share is at least ``min_share``. Eight words with one exchanged, and five in a row, always hold
four unchanged ones in a row, so a document without such places has no share at all.

The estimates cover all documents: vectors are rounded to a grid of 1/64 and counted by cell before any shuffle, so that a group of
any size is a bounded table of cells; concentration steps run on the weighted cells, from several starts, until the inner half
stops changing, and the smallest determinant wins.

Edge cases: null, blank and very short texts have share 0 and are never rejected. Ties (equal distances) fall on the same
side. Repeated rows are measured each for itself. Null ``lang`` or ``source`` is a group of its own. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tezgah.llm.words import mix, slices, words
from tezgah.session import written

RUN, WINDOW, HALF = 5, 8, 4
DIMS = 3
#: Chi-square quantile 0.999 with three degrees of freedom: the usual cut for a robust squared distance.
CUT = 16.266
#: Cells of the grid a unit of a statistic is cut into.
GRID = 64
#: Consistency factor of the scatter of the inner half of three-dimensional normal data.
HALF_FACTOR = 1.8591
#: Least standard deviation of a statistic on its transformed scale, so that a group of documents without any repetition has a scatter.
FLOOR = 0.05
#: Of each place in a window, what tells its word from the same word in another place.
_PLACE = mix(np.arange(1, WINDOW + 1))
STATS = "doc_id bigint, lang string, source string, n_words bigint, g1 int, g2 int, g3 int"
SHARES = "doc_id bigint, n_words bigint, rep_words bigint, rep_share double"


def _stood(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, whether its key stood earlier in its group, and whether it stands there more than once."""
    with np.errstate(over="ignore"):
        k = mix(keys ^ (group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(k, kind="stable")
    s = k[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    earlier, more = np.zeros(len(k), bool), np.zeros(len(k), bool)
    earlier[order] = same[:-1]
    more[order] = same[:-1] | same[1:]
    return earlier, more


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        g = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            g = g * np.uint64(0x9DDFEA08EB382D69) + h[j : j + len(g)]
        return mix(g)


def _mark(n: int, begin: np.ndarray, length: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, begin, 1)
    np.add.at(d, begin + length, -1)
    return np.cumsum(d[:-1]) > 0


def repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``h``: word hashes of documents laid end to end; ``doc``: the document of each word. Which words are repeated wording,
    and which begin four words that stood before.

    Eight words with one exchanged always hold four unchanged ones in a row, so only windows with four words that stand twice
    in their document are looked up: five words by their hash, eight by their hashes with each word in turn left out. All earlier
    places are found.
    """
    n = len(h)
    rep, four = np.zeros(n, bool), np.zeros(n, bool)
    if n < HALF:
        return rep, four
    pos = np.flatnonzero(doc[: n - HALF + 1] == doc[HALF - 1 :])
    stood, more = _stood(_grams(h, HALF)[pos], doc[pos])
    four[pos[stood]] = True
    twice = np.zeros(n + 1, np.int64)
    twice[pos[more] + 1] = 1
    twice = np.cumsum(twice)

    def windows(size: int) -> np.ndarray:
        i = np.arange(max(0, n - size + 1))
        return i[(doc[i] == doc[i + size - 1]) & (twice[i + size - HALF + 1] > twice[i])]

    if len(i := windows(RUN)):
        stood, _ = _stood(_grams(h, RUN)[i], doc[i])
        rep |= _mark(n, i[stood], RUN)
    if len(i := windows(WINDOW)):
        with np.errstate(over="ignore"):
            each = mix(h[i[:, None] + np.arange(WINDOW)] + _PLACE)
        whole = each.sum(1, dtype=np.uint64)
        found = np.zeros(len(i), bool)
        for k in range(WINDOW):
            found |= _stood(mix(whole - each[:, k]), doc[i])[0]
        rep |= _mark(n, i[found], WINDOW)
    return rep, four


def _again(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places at which four words begin that stood before in their document."""
    out = np.zeros(len(h), bool)
    if len(h) >= HALF:
        pos = np.flatnonzero(doc[: len(h) - HALF + 1] == doc[HALF - 1 :])
        out[pos[_stood(_grams(h, HALF)[pos], doc[pos])[0]]] = True
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"))
            m = part.num_rows
            again = _again(w.hash, w.row)
            new = ~_stood(w.hash, w.row)[0] if len(w.hash) else np.zeros(0, bool)
            of = lambda x: np.bincount(w.row[x], minlength=m).astype(np.int64)  # noqa: E731, B023
            count, distinct, places = np.bincount(w.row, minlength=m).astype(np.int64), of(new), of(again)
            s = (np.arcsin(np.sqrt(np.minimum(1.0, places / np.maximum(count, 1)))), np.arcsin(np.sqrt(np.minimum(1.0, places / np.maximum(distinct, 1)))), np.log1p(count) - np.log1p(distinct))
            grid = [pa.array(np.round(v * GRID).astype(np.int32)) for v in s]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), pa.array(count), *grid], names=[c.split()[0] for c in STATS.split(", ")])


def document_stats(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (``doc_id, text, lang, source``): word count and the statistics, as cells of the grid."""
    return documents.select("doc_id", F.col("text").cast("string").alias("text"), F.lower(F.trim("lang")).alias("lang"), F.col("source").cast("string").alias("source")).mapInArrow(_stats, STATS)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"))
            m = part.num_rows
            rep = repeated(w.hash, w.row)[0]
            count, again = np.bincount(w.row, minlength=m).astype(np.int64), np.bincount(w.row[rep], minlength=m).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count), pa.array(again), pa.array(again / np.maximum(count, 1))], names=[c.split()[0] for c in SHARES.split(", ")])


def shares(documents: DataFrame) -> DataFrame:
    """The exact share of repeated words of every row of ``documents`` (``doc_id, text``)."""
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_shares, SHARES)


def _scatter(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = weight.sum()
    centre = weight @ x / n
    d = x - centre
    return centre, (d * weight[:, None]).T @ d / n


def concentrate(x: np.ndarray, weight: np.ndarray, most: int = 100) -> tuple[np.ndarray, np.ndarray, int]:
    """Minimum-covariance-determinant centre, scatter and number of inner rows. ``weight``: how many rows each vector stands for.
    Starts: coordinatewise medians, and the half with the least of each statistic. Each start goes on, keep the half nearest to the
    centre and estimate again, until the half stays the same; the determinant never grows, and the start with the least wins."""
    half = (weight.sum() + 1) // 2
    floor = np.eye(x.shape[1]) * FLOOR**2

    def inner(d: np.ndarray) -> np.ndarray:
        order = np.argsort(d, kind="stable")
        place = int(np.searchsorted(np.cumsum(weight[order]), half))
        return np.where(d <= d[order[min(place, len(d) - 1)]], weight, 0)  # equal distances stay together

    by = [np.argsort(x[:, k], kind="stable") for k in range(x.shape[1])]
    middle = np.array([x[o, k][int(np.searchsorted(np.cumsum(weight[o]), half))] for k, o in enumerate(by)])
    best = None
    for d in (((x - middle) ** 2).sum(1), *x.T):
        keep = inner(d)
        for _ in range(most):
            centre, cov = _scatter(x, keep)
            z = x - centre
            again = inner(np.einsum("ij,jk,ik->i", z, np.linalg.inv(HALF_FACTOR * cov + floor), z))
            if (again == keep).all():
                break
            keep = again
        det = np.linalg.det(HALF_FACTOR * cov + floor)
        if best is None or det < best[0]:
            best = det, centre, HALF_FACTOR * cov + floor, int(keep.sum())
    return best[1:]


ESTIMATE = "level int, lang string, source string, n bigint, centre array<double>, inverse array<double>"


def _estimate(cells: pd.DataFrame) -> pd.DataFrame:
    x, weight = cells[["g1", "g2", "g3"]].to_numpy(float) / GRID, cells["n"].to_numpy()
    centre, cov, n = concentrate(x, weight)
    first = cells.iloc[0]
    return pd.DataFrame([(first["level"], first["lang"], first["source"], n, centre.tolist(), np.linalg.inv(cov).ravel().tolist())], columns=[c.split()[0] for c in ESTIMATE.split(", ")])


def mcd(stats: DataFrame) -> DataFrame:
    """Estimates of each language and source (level 0), each language (1) and of all (2), one row each."""
    cells = stats.groupBy("lang", "source", "g1", "g2", "g3").agg(F.count("*").alias("n"))
    null = F.lit(None).cast("string")
    levels = F.explode(F.array(F.struct(F.lit(0).alias("level"), "lang", "source"), F.struct(F.lit(1).alias("level"), "lang", null.alias("source")), F.struct(F.lit(2).alias("level"), null.alias("lang"), null.alias("source"))))
    at = cells.select(levels.alias("l"), "g1", "g2", "g3", "n").groupBy("l", "g1", "g2", "g3").agg(F.sum("n").alias("n")).select("l.*", "g1", "g2", "g3", "n")
    tasks = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # laborious rows: not to be coalesced by their bytes
    return at.repartition(tasks, "level", "lang", "source").groupBy("level", "lang", "source").applyInPandas(_estimate, ESTIMATE)


def outliers(stats: DataFrame) -> DataFrame:
    """``stats`` with the largest squared distance, towards more repetition, from an estimate of its group, its language or all. A group in
    which most documents repeat themselves moves its own centre, but not the others'."""
    estimates = written(mcd(stats), "mcd")
    out = stats
    s = [F.col(f"g{k}") / GRID for k in range(1, DIMS + 1)]
    for level, by in ((0, ["lang", "source"]), (1, ["lang"]), (2, [])):
        e = estimates.where(F.col("level") == level).select(*[F.col(k).alias(f"e_{k}") for k in by], F.col("centre").alias(f"c{level}"), F.col("inverse").alias(f"i{level}"))
        out = out.join(e, on=[F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in by], how="left") if by else out.crossJoin(F.broadcast(e))  # a single row
        out = out.drop(*[f"e_{k}" for k in by])
        z = [v - F.col(f"c{level}")[k] for k, v in enumerate(s)]
        q = sum(z[j] * z[k] * F.col(f"i{level}")[j * DIMS + k] for j in range(DIMS) for k in range(DIMS))
        out = out.withColumn(f"d{level}", F.when(z[0] > 0, q).otherwise(F.lit(0.0)))
    return out.withColumn("distance", F.greatest("d0", "d1", "d2")).withColumn("outlier", F.col("distance") > F.lit(CUT)).select(*stats.columns, "distance", "outlier")


def heavy_documents(documents: DataFrame, min_share: float = 0.3) -> DataFrame:
    """Rejected documents whose exact share of repeated words is at least ``min_share``: ``doc_id, n_words, rep_words, rep_share``. Only the
    texts of rejected documents are measured."""
    rejected = outliers(written(document_stats(documents), "rep")).where("outlier").select("doc_id").distinct()
    return shares(documents.join(rejected, "doc_id", "left_semi")).where((F.col("n_words") > 0) & (F.col("rep_words") >= F.lit(min_share) * F.col("n_words")))


def repetition_report(documents: DataFrame, min_share: float = 0.3) -> DataFrame:
    """Per document: its share of repeated words, the robust squared distance, whether it is rejected and whether it is ``heavy``."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(_stats(iter([batch])), _shares(iter([batch]))):
                yield pa.RecordBatch.from_arrays([*a.columns, b.column("rep_words"), b.column("rep_share")], names=[*a.schema.names, "rep_words", "rep_share"])

    d = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.lower(F.trim("lang")).alias("lang"), F.col("source").cast("string").alias("source"))
    out = outliers(written(d.mapInArrow(both, STATS + ", rep_words bigint, rep_share double"), "rep"))
    heavy = F.col("outlier") & (F.col("rep_words") >= F.lit(min_share) * F.col("n_words")) & (F.col("n_words") > 0)
    return out.select("doc_id", "lang", "source", "n_words", "rep_words", "rep_share", "distance", "outlier", heavy.alias("heavy"))


def repetition_by_group(report: DataFrame) -> DataFrame:
    """Per language and source: documents, heavy ones, words and repeated words."""
    return report.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.count_if("heavy").alias("heavy_documents"), F.sum("n_words").alias("n_words"), F.sum("rep_words").alias("rep_words"))
