"""Held-out passages inside training documents (problem 7).

The training corpus is indexed by position, shard by shard: for the documents of a shard, the postings (document, position)
of the words are stored sorted by word. For each held-out item the posting lists are read from its rarest word on, their
positions are adjusted by the word's place in the item, and documents in which several adjusted lists meet are aligned with
the item: exact phrases, and proximity matches with other text between the item's sentences, slips of a letter or two and
single exchanged words.

A document with a share ``need`` of an item's words has at least one of the item's rarest words (all but that many), so that
the frequent ones need not be read to find it. The items are held in memory in blocks of a fixed size; any number of blocks
is run one after the other.

Edge cases: null and blank texts, on either side, match nothing. Items of fewer than ``MIN_WORDS`` words match only whole.
Repeated documents are reported each; repeated items (same id and text) once. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tezgah.llm.words import Words, near, slices, words
from tezgah.session import written

#: Share of the item's weight in words that stand unaltered in a document that holds half of it, with slips and exchanges.
NEED = 0.35
#: Share of the item's weight in the words whose postings are read, from the rarest on: a document with NEED of the weight
#: has NEED + READ - 1 of it in them.
READ = 0.8
#: How far adjusted positions may differ within a sentence: words inserted or left out.
DRIFT = 3
#: How far apart two words of a chain within a sentence may stand.
REACH = 6
MIN_WORDS = 4
#: Words in a row, unaltered but for slips, that make a passage, and the shares of an item, by weight and in passages, from which on a
#: document holds it: most of its weight, or as many words as make half of it in passages.
ROW, BY_WEIGHT, IN_ROWS, ROWS_WEIGHT = 4, 0.55, 0.45, 0.42
#: Items held in memory at once.
BLOCK = 2000
#: An opening sentence that this many items share is an instruction, not part of the passage.
SHARED_BY = 3
FOUND = "doc_id bigint, item_id bigint, words int, held int, share double, weighted double, first_word int, last_word int, exact boolean"


def sentences(text: str) -> list[str]:
    """Cut after a full stop and blanks before a capital; a number's full stop ends none. Texts without capitals are cut before any letter."""
    text = text.strip()
    cased = any(c.isupper() for c in text)
    cuts = [m.end() for m in re.finditer(r"[.!?:][\"'”’)]*\s+(?=[^\W\d_])", text) if not cased or text[m.end()].isupper()]
    return [s for a, b in zip([0, *cuts], [*cuts, len(text)]) if (s := text[a:b].strip())]


@dataclass
class Item:
    id: int
    hash: np.ndarray
    word: list[str]
    sentence: np.ndarray


def opening(text: str | None) -> str | None:
    """The words of the first sentence of a text that has more than one."""
    s = sentences(text or "")
    return " ".join(_plain(s[0])) if len(s) > 1 else None


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("text"), pa.array([opening(t) for t in b.column("text").to_pylist()], pa.string())], names=["item_id", "text", "opening"])


def with_instruction(items: DataFrame) -> DataFrame:
    """``item_id, text, instructed``: whether the opening sentence is an instruction, shared by ``SHARED_BY`` items of all or more."""
    x = items.mapInArrow(_openings, "item_id bigint, text string, opening string")
    shared = x.where("opening is not null").groupBy("opening").agg(F.count("*").alias("c")).where(F.col("c") >= SHARED_BY).select("opening", F.lit(True).alias("instructed"))
    return x.join(shared, "opening", "left").select("item_id", "text", F.coalesce("instructed", F.lit(False)).alias("instructed"))


def prepare(rows: list[tuple[int, str, bool]]) -> list[Item]:
    """Items without their instruction sentence. ``rows``: (item id, text, whether it begins with an instruction)."""
    out = []
    for i, t, instructed in rows:
        s = sentences(t)[int(instructed) :]
        w = words(pa.array(s, pa.string()))
        if len(w.hash):
            out.append(Item(i, w.hash, [w.word(k) for k in range(len(w.hash))], w.row.copy()))
    return out


def _plain(s: str) -> list[str]:
    w = words(pa.array([s], pa.string()))
    return [w.word(k) for k in range(len(w.hash))]


def align(item: Item, weight: np.ndarray, w: Words, lo: int, hi: int, pts_i: np.ndarray, pts_p: np.ndarray) -> tuple[int, float, int, int, int] | None:
    """Longest chain of words in both orders: within a sentence the places drift by at most DRIFT, between sentences any
    text may stand. ``pts_i``, ``pts_p``: places of equal words in the item and the document (words lo to hi of ``w``).
    Gives words held, their share by weight, the first and last word of the document used, and the words that stand in passages."""
    order = np.lexsort((pts_i, pts_p))
    pts_i, pts_p = pts_i[order], pts_p[order]
    # a point counts if others follow or precede it closely
    close = np.zeros(len(pts_p), np.int64)
    for step in range(1, len(pts_p)):
        d_p, d_i = pts_p[step:] - pts_p[:-step], pts_i[step:] - pts_i[:-step]
        if d_p.min() > REACH:
            break
        c = (d_p <= REACH) & (d_p > 0) & (d_i > 0) & (np.abs(d_p - d_i) <= DRIFT)
        close[step:] += c
        close[:-step] += c
    ok = close >= 2
    if ok.sum() < 2:
        return None
    pts_i, pts_p = pts_i[ok], pts_p[ok]
    m = len(pts_i)
    best, back = np.ones(m), np.full(m, -1)
    sent = item.sentence
    for k in range(1, m):
        di, dp = pts_i[k] - pts_i[:k], pts_p[k] - pts_p[:k]
        go = (di > 0) & (dp > 0) & (((np.abs(dp - di) <= DRIFT) & (di <= REACH)) | (sent[pts_i[:k]] < sent[pts_i[k]]))
        if go.any():
            c = np.where(go, best[:k] - 1e-4 * np.abs(dp - di).clip(0, 1000), -1)
            j = int(c.argmax())
            best[k], back[k] = c[j] + 1, j
    k = int(best.argmax())
    path = []
    while k >= 0:
        path.append(k)
        k = int(back[k])
    path.reverse()
    # sentences of which only scattered words are met don't count: at least three words, or the whole of a shorter sentence
    per = Counter(sent[pts_i[k]] for k in path)
    size = Counter(sent.tolist())
    path = [k for k in path if per[sent[pts_i[k]]] >= min(3, size[sent[pts_i[k]]])]
    if not path:
        return None
    held = {int(pts_i[k]): int(pts_p[k]) for k in path}
    slip = set()
    ends = sorted(held)
    for i in range(ends[0] - 2, ends[-1] + 3):  # words between or beside the chain that differ by a slip
        if 0 <= i < len(sent) and i not in held:
            for n in (i - 1, i + 1, i - 2, i + 2):
                p = held.get(n, -1) + i - n if n in held else -1
                if lo <= p < hi and near(item.word[i], w.word(p)):
                    slip.add(i)
                    break
    got = set(held) | slip
    rows = run = 0
    for i in range(ends[0] - 2, ends[-1] + 4):  # words in a row
        if i in got and not (i in held and i - 1 in held and held[i] - held[i - 1] != 1):
            run += 1
        else:
            rows += run if run >= ROW else 0
            run = int(i in got)
    rows += run if run >= ROW else 0
    swapped = {i for i in range(1, len(sent) - 1) if i not in got and i - 1 in got and i + 1 in got and held.get(i + 1, -9) - held.get(i - 1, 0) == 2 and weight[[i - 1, i + 1]].max() >= np.median(weight)}
    return len(got) + len(swapped), float(weight[sorted(got)].sum() / weight.sum()), min(held.values()), max(held.values()), rows


@dataclass
class Block:
    """Items held in memory, and, of each of their words (of all items, end to end): item, place, term and share of weight."""

    items: list[Item]
    terms: np.ndarray
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    rare: np.ndarray

    @staticmethod
    def of(items: list[Item]) -> Block:
        h = np.concatenate([x.hash for x in items]) if items else np.zeros(0, np.uint64)
        terms, term = np.unique(h, return_inverse=True)
        return Block(items, terms, np.cumsum([0, *(len(x.hash) for x in items)]), term, np.ones(len(term)), np.arange(len(term)))

    def weigh(self, df: np.ndarray, total: int) -> None:
        """By the frequency of each term in the whole corpus; the rarest words, up to READ of the weight, are looked up."""
        raw = np.log1p(max(1, total) / (1.0 + df))[self.term]
        rare = []
        for k in range(len(self.items)):
            a, b = self.first[k], self.first[k + 1]
            self.weight[a:b] = raw[a:b] / raw[a:b].sum()
            order = np.argsort(-raw[a:b], kind="stable")
            sums = np.cumsum(self.weight[a:b][order])
            rare.append(a + order[: int(np.searchsorted(sums, READ)) + 1])
        self.rare = np.concatenate(rare) if rare else np.zeros(0, np.int64)


class Shard:
    """Positional inverted index of the documents of a shard: places of the items' terms, by term and by document."""

    def __init__(self, texts: pa.Array, terms: np.ndarray):
        self.w = words(texts)
        of = np.searchsorted(terms, self.w.hash).clip(0, max(0, len(terms) - 1))
        self.at = np.flatnonzero(terms[of] == self.w.hash) if len(terms) else np.zeros(0, np.int64)
        self.term = of[self.at]
        order = np.argsort(self.term.astype(np.uint16) if len(terms) < 65536 else self.term, kind="stable")
        self.postings = self.at[order]
        self.df = np.bincount(self.term, minlength=len(terms))
        self.begin = np.concatenate([[0], np.cumsum(self.df)])


def _meeting(shard: Shard, block: Block) -> np.ndarray:
    """(item, document) pairs, as item * documents + document, in which adjusted lists of the item's rarest words meet."""
    docs = len(shard.w.first) - 1
    word = block.rare
    count = shard.df[block.term[word]]
    word, count = word[count > 0], count[count > 0]
    if not len(word):
        return np.zeros(0, np.int64)
    begin = shard.begin[block.term[word]]
    p = shard.postings[np.arange(count.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]
    k = np.repeat(word, count)
    item = np.searchsorted(block.first, word, side="right") - 1
    pair = np.repeat(item, count) * docs + shard.w.row[p]
    least = NEED + READ - 1
    enough = np.bincount(pair, weights=block.weight[k], minlength=len(block.items) * docs) >= least
    some = enough[pair]
    p, k, pair = p[some], k[some], pair[some]
    key = pair * (1 << 32) + (p - k + len(block.term))
    order = np.argsort(key, kind="stable")
    key, k, pair = key[order], k[order], pair[order]
    meets = np.zeros(len(key), bool)
    for step in range(1, len(key)):
        m = key[step:] - key[:-step] <= DRIFT
        if not m.any():
            break
        m &= k[step:] != k[:-step]
        meets[step:] |= m
        meets[: len(key) - step] |= m
    single = block.first[1:] - block.first[:-1] == 1  # an item of one word has nothing to meet
    meets |= single[pair // docs]
    both = np.unique(np.stack([pair[meets], k[meets]]), axis=1) if meets.any() else np.zeros((2, 0), np.int64)
    got, at = np.unique(both[0], return_inverse=True)
    return got[np.bincount(at, weights=block.weight[both[1]], minlength=len(got)) >= least]


def search(shard: Shard, block: Block, share: float, by_weight: float, in_rows: float) -> Iterator[tuple[int, Item, int, float, int, int]]:
    """(document of the shard, item, words held, share by weight, first and last word) of each match."""
    w, docs = shard.w, len(shard.w.first) - 1
    for pair in _meeting(shard, block).tolist():
        k, d = divmod(pair, docs)
        item, a, b = block.items[k], block.first[k], block.first[k + 1]
        n, weight = b - a, block.weight[a:b]
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        x, y = np.searchsorted(shard.at, [lo, hi])
        own = np.argsort(block.term[a:b], kind="stable")
        mine = block.term[a:b][own]
        left, right = np.searchsorted(mine, shard.term[x:y]), np.searchsorted(mine, shard.term[x:y], side="right")
        times = right - left
        pp = np.repeat(shard.at[x:y], times)
        pi = own[np.arange(times.sum()) + np.repeat(left - (np.cumsum(times) - times), times)]
        g = pp - pi
        order = np.argsort(g, kind="stable")
        g, pi, pp = g[order], pi[order], pp[order]
        runs = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        if np.diff(runs).max() == n:  # the exact phrase
            p = int(pp[runs[np.diff(runs).argmax()]])
            yield d, item, n, 1.0, p - lo, p - lo + n - 1
            continue
        keep = np.zeros(len(g), bool)  # only where an adjusted position is met by another word nearby
        for step in range(1, len(g)):
            m = g[step:] - g[:-step] <= DRIFT
            if not m.any():
                break
            m &= (pi[step:] != pi[:-step]) & (np.abs(pp[step:] - pp[:-step]) <= REACH)
            keep[step:] |= m
            keep[: max(0, len(g) - step)] |= m
        pi, pp = pi[keep], pp[keep]
        if len(pi) < 2:
            continue
        got = align(item, weight, w, lo, hi, pi, pp)
        if got and got[0] >= share * n and (n >= MIN_WORDS or got[0] == n) and (got[1] >= by_weight or (got[4] >= in_rows * n and got[1] >= by_weight - BY_WEIGHT + ROWS_WEIGHT)):
            yield d, item, got[0], got[1], got[2] - lo, got[3] - lo


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each term stands in the whole corpus, and its number of words. One row per term and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                h = words(part.column("text")).hash
                of = np.searchsorted(terms, h).clip(0, len(terms) - 1)
                df += np.bincount(of[terms[of] == h], minlength=len(terms))
                total += len(h)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int64)), pa.array(np.append(df[some], total))], names=["term", "n"])

    df, total = np.zeros(len(terms), np.int64), 0
    for r in docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most as many rows as the block has terms
        if r["term"] < 0:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, total


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, by_weight: float = BY_WEIGHT, in_rows: float = IN_ROWS) -> DataFrame:
    """One row per document and held-out item of which it holds at least ``share`` of the words in their order:
    words of the item (instruction aside), words held, both shares, the document's first and last word used, whether it is
    the exact phrase. ``documents``: ``doc_id, text``; ``items``: ``item_id, text``."""
    spark = documents.sparkSession
    rows = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null and trim(text) <> ''").distinct()
    rows = written(with_instruction(rows), "items").orderBy("item_id", "text")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(rows):
        held = Block.of(prepare(block))
        if not held.items:
            continue
        held.weigh(*_frequencies(docs, held.terms))
        shared = spark.sparkContext.broadcast(held)  # at most BLOCK items

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id").to_pylist()
                    found = [(ids[d], x.id, len(x.hash), n, n / len(x.hash), by, a, b, n == len(x.hash) and b - a + 1 == n) for d, x, n, by, a, b in search(Shard(part.column("text"), block.terms), block, share, by_weight, in_rows)]
                    cols = list(zip(*found)) if found else [[] for _ in range(9)]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in FOUND.split(", ")])

        part = docs.mapInArrow(find, FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], FOUND)


def _blocks(rows: DataFrame) -> Iterator[list[tuple[int, str, bool]]]:
    block: list[tuple[int, str, bool]] = []
    for r in rows.toLocalIterator():
        block.append((r[0], r[1], r[2]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block
