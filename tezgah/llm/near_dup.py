"""Near-duplicate records with small edits (problem 1).

Two records are near duplicates if at least ``agree`` of the words of the longer one have a partner in the other, in any
order, each word as often as it stands; a slip of a letter or two makes no other word. Equal word bags are one class; work
is done on classes, and copies are expanded only where a result asks for pairs of records.

1. Lexicon. Words a slip apart are linked, over the vocabulary: such words agree once a letter or two are left out of each, so
   they meet under a common rest. A word's weight is its frequency and that of the words linked to it, and all words stand in one
   order by weight.
2. Blocks. A class of n words may lack k = n - ceil(``agree`` n) partners. Of all words that two agreeing classes match, take the
   first in the order: in its own class at most k words stand before it, and so do in the other. So the first k + 1 words of a class
   are its keys ("at home"), and a class visits the keys of words linked to its own that stand before these and not behind its
   k + 1st word. Two classes that agree meet under a key, one of them at home. Nothing else decides which pairs are compared.
3. Comparison. Each class has 256 bits ``x``, one set by each of its words, and 256 bits ``e``, set by each word that is a partner of
   one of its words. Words of ``x`` that aren't in the other's ``e`` have no partner: their number is a distance, from each side, and
   may not exceed k. It is computed bit-sliced: bit plane j holds bit j of 64 records per machine word; the planes are compared with
   themselves shifted by d records, the distances of all pairs d places apart are summed by carry-save adders into vertical
   counters, and words of lanes are abandoned as soon as all their counters exceed the radius. No pair that agrees is lost.
   Keys of more than ``TILE`` rows are cut into tiles, and each pair of tiles is a task of its own.
4. Pairs within the radius are checked exactly: the largest one-to-one matching of their words.

Rests, coded words, keys and pairs to check take many times the disk of the texts, so each of these steps is done in passes over parts of
its rows, by hash, and the shuffle files of a pass are removed before the next. All parts are done; only the order of work differs.

Edge cases: null and blank texts have no words and give no pair. Repeated rows count once; an id with several texts stands
for each of them. Texts of one word pair only with equal words up to slips. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tezgah.llm.words import mix, near, near_many, slices, words
from tezgah.session import written, written_parts

BITS = 256
TILE = 2048
#: Planes added up before lanes are abandoned.
GROUP = 64
#: Words of more letters meet by a fifth that is left whole, since the ways of leaving out two letters grow with the square of the length.
LONG = 24
#: Bits of a word's code that name it; those above hold its place in the order.
NAME = 40
#: Rows of a pass, and the most passes: beyond these a pass grows with the input, as the disk may.
WORDS_AT_ONCE, ENTRIES_AT_ONCE, KEYS_AT_ONCE, PAIRS_AT_ONCE, PASSES = 100_000, 1_500_000, 1_500_000, 400_000, 16
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column("text"))
            every, first = w.strings(), w.first.tolist()
            bag = [" ".join(sorted(every[a:b])) for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(bag, pa.string())], names=["id", "bag"])


def bags(records: DataFrame) -> DataFrame:
    """``records``: ``id, text``. One row per distinct id and bag of words: ``id, bag, cls`` (64-bit name of the bag)."""
    some = records.select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null and trim(text) <> ''")
    return written(some.mapInArrow(_bags, "id string, bag string").where("bag <> ''").distinct().withColumn("cls", F.xxhash64("bag")), "bags")


def classes(bag_rows: DataFrame) -> DataFrame:
    return written(bag_rows.groupBy("cls").agg(F.min("bag").alias("bag")), "classes")


def passes(rows: int, at_once: int) -> int:
    return min(PASSES, 1 + rows // at_once)


def part(df: DataFrame, column: str, k: int, n: int) -> DataFrame:
    """Part ``k`` of ``n`` of the rows."""
    return df.where(F.pmod(F.xxhash64(column), F.lit(n)) == k) if n > 1 else df


def rests(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, 64-bit name of a rest): words a slip or two apart have a rest in common. All words of a length at once: the
    polynomial hash of a word without letters i and j is put together from prefix sums."""
    by_length = defaultdict(list)
    for k, w in enumerate(some):
        if len(w) >= 4 and not w.isdigit():
            by_length[len(w)].append(k)
    at, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    back = [np.uint64(pow(_P, -d, 1 << 64)) for d in range(3)]

    def add(rows: np.ndarray, h: np.ndarray, tag: int) -> None:
        at.append(rows)
        key.append(mix(h + np.uint64(tag * 0xD6E8FEB86659FD93 & _MASK)))

    with np.errstate(over="ignore"):
        for n, rows in by_length.items():
            rows = np.array(rows)
            code = np.array([some[k] for k in rows], f"<U{n}").view(np.uint32).reshape(len(rows), n).astype(np.uint64)
            power = np.cumprod(np.array([1] + [_P] * n, np.uint64), dtype=np.uint64)
            sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(code * power[:n], axis=1, dtype=np.uint64)], axis=1)
            if n <= LONG:
                add(rows, sums[:, n], n)
                for i in range(n):
                    add(rows, sums[:, i] + (sums[:, n] - sums[:, i + 1]) * back[1], n - 1)
                if n >= 6:
                    for i in range(n):
                        for j in range(i + 1, n):
                            add(rows, sums[:, i] + (sums[:, j] - sums[:, i + 1]) * back[1] + (sums[:, n] - sums[:, j + 1]) * back[2], n - 2)
            if n > LONG - 2:  # two slips spoil at most four of five parts and shift a part by at most two places
                for of in range(n - 2, n + 3):
                    cut = [of * f // 5 for f in range(6)]
                    for f in range(5):
                        for a in range(max(0, cut[f] - 2), min(n - (cut[f + 1] - cut[f]), cut[f] + 2) + 1):
                            add(rows, (sums[:, a + cut[f + 1] - cut[f]] - sums[:, a]) * np.uint64(pow(_P, -a, 1 << 64)), 1000 + of * 5 + f)
    return np.concatenate(at), np.concatenate(key)


def _rest_rows(part: int, parts: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4000):
                word = b.column("word").slice(k, 4000)
                at, key = rests(word.to_pylist())
                own = key % np.uint64(parts) == part
                at, key = distinct(at[own], key[own].view(np.int64))
                yield pa.RecordBatch.from_arrays([word.take(pa.array(at)), pa.array(key)], names=["word", "rest"])

    return rows


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 20_000):
            part = b.slice(k, 20_000)
            yield part.filter(pa.array(near_many(part.column("x").to_pylist(), part.column("y").to_pylist())))


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join whose both sides grow with the data: never broadcast. Spark takes the size of a compressed file, or of what a
    Python function reads, for that of the rows, and would gather tables many times the size it allows on the driver."""
    return side.hint("merge")


def lexicon(entries: DataFrame) -> DataFrame:
    """``entries``: a row per word that stands in a class, with column ``word``. One row per word: ``word, code, near``. The code is
    the word's place in the order and its name; ``near`` holds the codes of the words a slip apart."""
    vocabulary = written(entries.groupBy("word").agg(F.count("*").alias("df")), "vocabulary")
    n = passes(vocabulary.count(), WORDS_AT_ONCE)

    def slips(k: int) -> DataFrame:
        rest = vocabulary.select("word").mapInArrow(_rest_rows(k, n), "word string, rest bigint")
        met = rest.select("rest", F.col("word").alias("x")).join(shuffled(rest.select("rest", F.col("word").alias("y"))), "rest").where("x < y").select("x", "y").distinct()
        return met.mapInArrow(_near_rows, "x string, y string")

    slip = written_parts(map(slips, range(n)), "slips")
    if n > 1:  # words meet in every pass that has a rest of both
        slip = written(slip.distinct(), "slips")
    both = slip.unionByName(slip.select(F.col("y").alias("x"), F.col("x").alias("y")))
    more = both.join(shuffled(vocabulary.withColumnRenamed("word", "y")), "y").groupBy("x").agg(F.sum("df").alias("more"))
    weight = F.least(F.col("df") + F.coalesce("more", F.lit(0)), F.lit((1 << (62 - NAME)) - 1))
    code = F.shiftleft(weight, NAME).bitwiseOR(F.xxhash64("word").bitwiseAND(F.lit((1 << NAME) - 1)))
    coded = written(vocabulary.join(shuffled(more.withColumnRenamed("x", "word")), "word", "left").select("word", code.alias("code")), "codes")
    near_codes = both.join(shuffled(coded.select(F.col("word").alias("y"), F.col("code").alias("near"))), "y").groupBy("x").agg(F.collect_list("near").alias("near"))
    return written(coded.join(shuffled(near_codes.withColumnRenamed("x", "word")), "word", "left").select("word", "code", F.coalesce("near", F.array().cast("array<bigint>")).alias("near")), "lexicon")


def coded_classes(cls: DataFrame) -> Iterator[DataFrame]:
    """One row per class: ``cls, w``, an array of the code and the near codes of each of its words. In parts, each hash-partitioned by class."""
    entries = cls.select("cls", F.explode(F.split("bag", " ")).alias("word"))
    lex = lexicon(entries)
    n = passes(cls.agg(F.sum(F.size(F.split("bag", " ")))).first()[0] or 0, ENTRIES_AT_ONCE)
    for k in range(n):
        yield part(entries, "cls", k, n).join(shuffled(lex), "word").groupBy("cls").agg(F.collect_list(F.struct("code", "near")).alias("w"))


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of two columns."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _bits(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, BITS), np.uint8)
    out[row, (mix(code.view(np.uint64)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(out, axis=1, bitorder="little")


def keys(row: np.ndarray, code: np.ndarray, near_of: np.ndarray, near_code: np.ndarray, n: np.ndarray, slack: np.ndarray):
    """Rows (class, key, at home) of classes laid end to end. ``row``: class of each word; ``near_of``: word of each near code."""
    order = np.lexsort((code, row))
    begin = np.cumsum(n) - n
    last = code[order][begin + slack]
    home = np.flatnonzero(code <= last[row])
    visit = np.flatnonzero((near_code < code[near_of]) & (near_code <= last[row[near_of]]))
    r = np.concatenate([row[home], row[near_of[visit]]])
    k = np.concatenate([code[home], near_code[visit]])
    away = np.concatenate([np.zeros(len(home), np.int64), np.ones(len(visit), np.int64)])
    order = np.lexsort((away, k, r))
    r, k, away = r[order], k[order], away[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return r[new], k[new], away[new] == 0


def unpacked(b: pa.RecordBatch):
    """Of a batch of coded classes: class of each word, code, word of each near code, near code, words per class."""
    w = b.column("w")
    n = np.asarray(w.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = w.flatten()
    code = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    near = flat.field(1)
    of = np.repeat(np.arange(len(code)), np.asarray(near.value_lengths().to_numpy(zero_copy_only=False), np.int64))
    return np.repeat(np.arange(len(n)), n), code, of, near.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n


def _key_rows(agree: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                b = batch.slice(k, 2000)
                row, code, of, near_code, n = unpacked(b)
                slack = n - np.ceil(agree * n - 1e-9).astype(np.int64)
                x = _bits(row, code, len(n))
                e = x | _bits(row[of], near_code, len(n))
                r, key, home = keys(row, code, of, near_code, n, slack)
                sketch = np.concatenate([x, e], axis=1)[r]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), b.column("cls").take(pa.array(r)), pa.array(n[r].astype(np.int32)), pa.array(home), pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 4), len(r), [None, pa.py_buffer(np.ascontiguousarray(sketch))]).cast(pa.binary())],
                    names=["key", "cls", "n", "home", "sketch"],
                )

    return rows


KEYED = "key bigint, cls bigint, n int, home boolean, sketch binary"


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = a ^ b
    return x ^ c, (a & b) | (c & x)


def _carry_save(x: np.ndarray) -> list[np.ndarray]:
    """Vertical counters of the ones in each lane of the planes ``x``: bit k of the count in item k."""
    out, rows = [], [x]
    while rows:
        cur, nxt = rows[0] if len(rows) == 1 else np.concatenate(rows), []
        while len(cur) > 2:
            t = len(cur) // 3 * 3
            s, c = _full(cur[0:t:3], cur[1:t:3], cur[2:t:3])
            nxt.append(c)
            cur = np.concatenate([s, cur[t:]])
        if len(cur) == 2:
            nxt.append((cur[0] & cur[1])[None])
            cur = (cur[0] ^ cur[1])[None]
        out.append(cur[0])
        rows = nxt
    return out


def _sum(total: list[np.ndarray], add: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two vertical counters."""
    if not total:
        return add
    none, out = np.zeros_like(add[0]), []
    carry = none
    for k in range(max(len(total), len(add)) + 1):
        s, carry = _full(total[k] if k < len(total) else none, add[k] if k < len(add) else none, carry)
        out.append(s)
    return out


def _exceeds(bits: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose counter is greater than their radius; ``radius``: planes of a vertical number."""
    none = np.zeros_like(bits[0])
    more, same = none, ~none
    for k in range(max(len(bits), len(radius)) - 1, -1, -1):
        b, r = bits[k] if k < len(bits) else none, radius[k] if k < len(radius) else none
        more = more | (same & b & ~r)
        same = same & ~(b ^ r)
    return more


def _planes(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as planes, a word of 64 rows each and one word of room."""
    n = bits.shape[0]
    out = np.zeros((bits.shape[1], (n + 63) // 64 + 1), np.uint64)
    out.view(np.uint8)[:, : (n + 7) // 8] = np.packbits(bits.T, axis=1, bitorder="little")
    return out


def close_pairs(block: np.ndarray, x: np.ndarray, e: np.ndarray, slack: np.ndarray, home: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same block, one of them at home, of which neither has more than ``slack`` bits of ``x`` that aren't in the
    other's ``e`` (rows of bytes). Rows with a ``tile`` of 0 or more pair only with rows of another tile."""
    n = len(block)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    _, of, count = np.unique(block, return_inverse=True, return_counts=True)
    order = np.lexsort((~home, of, -count[of]))
    of, size, home, tile = of[order], count[of[order]], home[order], tile[order]
    px, pe = (_planes(np.unpackbits(v[order], axis=1, bitorder="little")) for v in (x, e))
    radius = _planes((slack[order][:, None] >> np.arange(max(1, int(slack.max()).bit_length())) & 1).astype(np.uint8))
    room = px.shape[1] - 1
    left, right = [], []
    for d in range(1, int(size[0])):
        m = int(np.searchsorted(-size, -d)) - d  # rows of blocks with more than d rows come first
        if m <= 0:
            break
        valid = np.zeros((m + 63) // 64 * 64, bool)
        valid[:m] = (of[:m] == of[d : m + d]) & home[:m] & ((tile[:m] < 0) | (tile[:m] != tile[d : m + d]))
        alive = np.packbits(valid, bitorder="little").view(np.uint64)
        at = np.flatnonzero(alive)
        alive = alive[at]
        word, bit = at + d // 64, np.uint64(d % 64)

        def moved(p: np.ndarray, word: np.ndarray, bit: np.uint64 = bit) -> np.ndarray:
            low = p[:, np.minimum(word, room)]
            return (low >> bit) | (p[:, np.minimum(word + 1, room)] << (np.uint64(64) - bit)) if bit else low

        here, there = [], []
        for g in range(0, BITS, GROUP):
            if not len(at):
                break
            own, other = slice(g, g + GROUP), slice(g, g + GROUP)
            here = _sum(here, _carry_save(px[own][:, at] & ~moved(pe[other], word)))
            there = _sum(there, _carry_save(moved(px[other], word) & ~pe[own][:, at]))
            alive = alive & ~_exceeds(here, radius[:, at]) & ~_exceeds(there, moved(radius, word))
            keep = alive != 0  # the others are abandoned
            if not keep.all():
                at, word, alive, here, there = at[keep], word[keep], alive[keep], [t[keep] for t in here], [t[keep] for t in there]
        if len(at):
            r, c = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = at[r] * 64 + c
            left.append(order[i])
            right.append(order[i + d])
    if not left:
        return none, none
    return np.concatenate(left), np.concatenate(right)


def _compare(agree: float, least: int = 60_000):
    """Rows come sorted by block; complete blocks are compared some ten thousand rows at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            block, cls, n, tile, home, sk = (np.concatenate([h[k] for h in held]) for k in range(6))
            cut = len(block) if last else int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
            held = [tuple(v[cut:] for v in (block, cls, n, tile, home, sk))]
            block, cls, n, tile, home, sk = (v[:cut] for v in (block, cls, n, tile, home, sk))
            i, j = close_pairs(block, sk[:, : BITS // 8], sk[:, BITS // 8 :], n - np.ceil(agree * n - 1e-9).astype(np.int64), home, tile)
            fits = (np.minimum(n[i], n[j]) >= np.ceil(agree * np.maximum(n[i], n[j]) - 1e-9)) & (cls[i] != cls[j])
            a, b = np.minimum(cls[i], cls[j])[fits], np.maximum(cls[i], cls[j])[fits]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in distinct(a, b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                sk = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BITS // 4)
                held.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "cls", "n", "tile", "home")), sk))
                if sum(len(h[0]) for h in held) >= least:
                    yield from done(False)
        if held and sum(len(h[0]) for h in held):
            yield from done(True)

    return compare


_near = lru_cache(1 << 17)(near)


def _links(left: list[str], right: list[str]) -> dict[str, list[str]]:
    """Of each word on the left, the words on the right that are the same or a slip away."""
    left, right = sorted(set(left)), sorted(set(right))
    if len(left) * len(right) <= 2000:
        return {x: [y for y in right if x == y or abs(len(x) - len(y)) <= 2 and _near(x, y)] for x in left}
    at, key = rests(left + right)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    ends = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    met = {(int(i), int(j) - len(left)) for a, b in zip(ends, ends[1:]) if b - a > 1 for i in at[a:b] if i < len(left) for j in at[a:b] if j >= len(left)}
    met = sorted(met)
    ok = near_many([left[i] for i, _ in met], [right[j] for _, j in met])
    out: dict[str, list[str]] = defaultdict(list)
    for (i, j), yes in zip(met, ok.tolist()):
        if yes:
            out[left[i]].append(right[j])
    for x in set(left) & set(right):
        out[x].append(x)
    return out


def agreement(a: list[str], b: list[str], least: float = 0.0) -> float:
    """Share of the longer bag's words in the largest one-to-one matching of equal words and words a slip apart. Equal words are
    matched first, and paths through them lead on from there; where the matching can't reach ``least``, any smaller share may be given."""
    ca, cb = Counter(a), Counter(b)
    both = ca & cb
    m, n = max(len(a), len(b)), sum(both.values())
    free_a, free_b = ca - both, cb - both
    spare = min(sum(free_a.values()), sum(free_b.values()))
    if not spare or (n + spare) / m < least:
        return n / m
    link = _links(list(free_a), list(cb))
    inner: dict[str, list[str]] | None = None
    flow: dict[str, Counter] = {y: Counter({y: both[y]}) for y in both}  # words on the right and what they are matched with
    for x in free_a.elements():
        came: dict[str, str] = {}  # of a word on the right, the word on the left it was reached from
        through: dict[str, str | None] = {x: None}  # of a word on the left, the word on the right it is taken away from
        stack, y = [x], None
        while stack and y is None:
            u = stack.pop()
            if u not in link:
                inner = inner or _links(list(both), list(cb))
                link = {**inner, **link}
            for z in link.get(u, ()):
                if z in came:
                    continue
                came[z] = u
                if free_b[z] > 0:
                    y = z
                    break
                for v, c in flow.get(z, {}).items():
                    if c > 0 and v not in through:
                        through[v] = z
                        stack.append(v)
        if y is None:
            continue
        n += 1
        free_b[y] -= 1
        while y is not None:
            u = came[y]
            flow.setdefault(y, Counter())[u] += 1
            y = through[u]
            if y is not None:
                flow[y][u] -= 1
    return n / m


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Few but laborious rows over all tasks: a repartition by number isn't coalesced to the few tasks that their bytes would need."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def with_bags(pairs: DataFrame, cls: DataFrame, a: str, b: str) -> Iterator[DataFrame]:
    """Distinct pairs ``a, b`` of classes with their bags, ``bag_a, bag_b``, over all tasks. In parts."""
    pairs = written(pairs.distinct(), "pairs")
    n = passes(pairs.count(), PAIRS_AT_ONCE)
    bag = lambda c, name: cls.select(F.col("cls").alias(c), F.col("bag").alias(name))
    for k in range(n):
        x = part(pairs, a, k, n).join(shuffled(part(bag(a, "bag_a"), a, k, n)), a)
        yield spread(x, b).join(shuffled(bag(b, "bag_b")), b).select(a, b, "bag_a", "bag_b")


def checked(pairs: DataFrame, cls: DataFrame, agree: float) -> DataFrame:
    """Exact check of candidate pairs ``a, b`` of classes: those that agree, each once, with their share."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            s = [agreement(x.split(" "), y.split(" "), agree) for x, y in zip(t.column("bag_a").to_pylist(), t.column("bag_b").to_pylist())]
            keep = pa.array([v >= agree - 1e-12 for v in s], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(s, pa.float64())], names=["a", "b", "share"]).filter(keep)

    return written_parts((x.mapInArrow(check, "a bigint, b bigint, share double") for x in with_bags(pairs, cls, "a", "b")), "links")


def heavy_keys(keyed: DataFrame, tile: int) -> DataFrame:
    """Keys of more than ``tile`` rows and into how many tiles each is cut: at most rows / tile of them."""
    return keyed.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > tile).select("key", F.ceil(F.col("c") / tile).cast("int").alias("tiles"))


def keyed_parts(keyed: DataFrame) -> Iterator[DataFrame]:
    """Parts of the rows by key. A part has at most its rows / ``TILE`` keys of more than ``TILE`` rows."""
    n = passes(keyed.count(), KEYS_AT_ONCE)
    for k in range(n):
        yield part(keyed, "key", k, n)


def candidates(cls: DataFrame, agree: float) -> DataFrame:
    """Pairs ``a < b`` of different classes that hold all pairs that agree; a pair may come more than once."""
    keyed = written_parts((x.mapInArrow(_key_rows(agree), KEYED) for x in coded_classes(cls)), "keyed")

    def met(some: DataFrame) -> DataFrame:
        tiles = F.coalesce("tiles", F.lit(1))
        x = some.join(F.broadcast(heavy_keys(some, TILE)), "key", "left").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
        x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        rows = x.select(block.alias("block"), "cls", "n", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("tile"), "home", "sketch").repartition("block").sortWithinPartitions("block")
        return rows.mapInArrow(_compare(agree), "a bigint, b bigint").distinct()

    return written_parts(map(met, keyed_parts(keyed)), "met")


def class_links(cls: DataFrame, agree: float = 0.7) -> DataFrame:
    """Pairs ``a < b`` of different classes that agree, each once, with the share."""
    return checked(candidates(cls, agree), cls, agree)


def by_texts(members: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The members whose id has one class, and those whose id has several. A pair of the former follows from one pair of classes only.
    ``more``: columns that are the same in all rows of an id."""
    of = written(members.groupBy("id", *more).agg(F.collect_set("cls").alias("of")), "members")
    each = of.select("id", *more, F.explode("of").alias("cls"), (F.size("of") > 1).alias("several"))
    return each.where("not several").drop("several"), each.where("several").drop("several")


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records ``id_a < id_b``: of linked classes, and of the same class. Their number grows with the square of the copies, so
    they aren't shuffled, but for those of ids with several texts."""

    def pairs(p: DataFrame, q: DataFrame) -> DataFrame:
        across = links.join(shuffled(p.select(F.col("cls").alias("a"), F.col("id").alias("x"))), "a").join(shuffled(q.select(F.col("cls").alias("b"), F.col("id").alias("y"))), "b").select("x", "y")
        within = p.select("cls", F.col("id").alias("x")).join(shuffled(q.select("cls", F.col("id").alias("y"))), "cls").where("x < y").select("x", "y")
        return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    one, several = by_texts(members)
    return pairs(one, one).unionByName(pairs(several, one).unionByName(pairs(one, several)).unionByName(pairs(several, several)).distinct())


def near_duplicates(records: DataFrame, agree: float = 0.7) -> DataFrame:
    """All pairs of different ids whose texts are near duplicates. ``records``: ``id, text``."""
    rows = bags(records)
    return record_pairs(class_links(classes(rows), agree), rows)


def near_duplicate_groups(records: DataFrame, agree: float = 0.7) -> DataFrame:
    """One row per id and class: the class, its group of linked classes (``group_id``, the least class of it), the class's number of
    links to other classes and of members. Linear in the input, however many copies a class has."""
    from tezgah.llm.components import components

    rows = bags(records)
    cls = classes(rows)
    links = class_links(cls, agree)
    both = links.select(F.col("a").alias("cls"), "b").unionByName(links.select(F.col("b").alias("cls"), F.col("a").alias("b")))
    degree = both.groupBy("cls").agg(F.count("*").alias("links"))
    label = components(links.select("a", "b"))
    size = rows.groupBy("cls").agg(F.countDistinct("id").alias("members"))
    return (
        rows.select("id", "cls").join(shuffled(size), "cls").join(shuffled(degree), "cls", "left").join(shuffled(label.select(F.col("node").alias("cls"), "component")), "cls", "left")
        .select("id", "cls", F.coalesce("component", "cls").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "members")
    )
