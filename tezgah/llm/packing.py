"""Filling fixed-capacity containers with items (problem 6).

Sizes are tokens of a public tokenizer. A text longer than the capacity is cut into full containers and a remainder; every other
text stays whole. Items are spread over shards of bounded size by a hash, and each shard is packed by linear grouping: the large
items, sorted by size, form groups of equal cardinality and are rounded up to their group's largest size; configurations of
these few sizes are chosen, each the fullest one (an exact bounded knapsack) that holds the largest size left, as often as the
counts allow; the actual documents take the places of their group; the small items, and what rounding left over, go by best fit
into the tightest container that has room.

Between two texts of a container lie ``separator`` tokens: with sizes and capacity enlarged by the separator, sums are plain sums.

Edge cases: null, blank and empty texts have no tokens and go into no container (``container_id`` null). Ties are broken by document
id. Repeated rows are packed each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tezgah.session import written

#: A vocabulary of byte-level BPE for many languages, as ranks; the file must lie at this path on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that goes with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of a shard, at most about; each shard may leave its last container half full.
SHARD = 30_000
GROUPS = 96
#: Items of at most this share of the capacity are small.
SMALL = 0.06
_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


class Counter:
    """Counts tokens of texts. A word with the blank before it is tokenised by itself wherever it stands, so counts are kept by word;
    texts with runs of blanks, where that doesn't hold, are encoded whole."""

    def __init__(self, path: str, most: int = 500_000):
        self.encode = _encoder(path).encode_ordinary
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str | None) -> int:
        if not text or text.isspace():
            return 0
        if "  " in text or "\n " in text or "\t " in text or "\r " in text:
            return len(self.encode(text))
        head, *rest = text.split(" ")
        known, total = self.known, len(self.encode(head))
        for w in rest:
            n = known.get(w)
            if n is None:
                if len(known) >= self.most:
                    known.clear()
                n = known[w] = len(self.encode(" " + w))
            total += n
        return total


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens`` of every row of ``documents`` (``doc_id, text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([counter(t) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id bigint, tokens bigint")


def _fullest(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size fill ``room`` best; sizes descending. Exact: reachable sums as bits of one number."""
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for s, c in zip(sizes, counts):
        r = cur = reach[-1]
        for _ in range(min(c, room // s)):
            cur = (cur << s) & mask
            new = r | cur
            if new == r:
                break
            r = new
        reach.append(r)
    left = reach[-1].bit_length() - 1
    take = [0] * len(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        while not reach[k] >> left & 1:
            left -= sizes[k]
            take[k] += 1
    return take


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container index of each item; sizes from 1 to ``capacity``."""
    sizes = np.asarray(sizes, np.int64)
    out = np.full(len(sizes), -1, np.int64)
    room: list[int] = []
    order = np.argsort(-sizes, kind="stable")
    large = order[sizes[order] > SMALL * capacity]
    if len(large):
        per = -(-len(large) // GROUPS)
        groups: dict[int, list[int]] = {}
        for a in range(0, len(large), per):
            groups.setdefault(int(sizes[large[a]]), []).extend(large[a : a + per].tolist())
        rounded = sorted(groups, reverse=True)
        waiting = {r: groups[r][::-1] for r in rounded}
        while rounded:
            first = rounded[0]
            counts = [len(waiting[r]) for r in rounded]
            counts[0] -= 1
            take = _fullest(rounded, counts, capacity - first)
            take[0] += 1
            times = min(len(waiting[r]) // t for r, t in zip(rounded, take) if t)
            for _ in range(times):
                left = capacity
                for r, t in zip(rounded, take):
                    for _ in range(t):
                        i = waiting[r].pop()
                        out[i] = len(room)
                        left -= int(sizes[i])
                room.append(left)
            rounded = [r for r in rounded if waiting[r]]
    # best fit of the small ones, and of whole light containers
    by_room: dict[int, list[int]] = {}
    some = 0
    for c, left in enumerate(room):
        by_room.setdefault(left, []).append(c)
        some |= 1 << left
    for i in order[sizes[order] <= SMALL * capacity].tolist():
        s = int(sizes[i])
        fits = some >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            c = by_room[left].pop()
            if not by_room[left]:
                some &= ~(1 << left)
        else:
            c, left = len(room), capacity
            room.append(left)
        out[i] = c
        room[c] = left - s
        by_room.setdefault(left - s, []).append(c)
        some |= 1 << (left - s)
    return out


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    at = pack(pdf["size"].to_numpy(), int(pdf["room"].iloc[0]))
    name = f"{pdf['spec_id'].iloc[0]}-{pdf['shard'].iloc[0]}-"
    return pd.DataFrame({"spec_id": pdf["spec_id"], "container_id": [f"{name}{c}" for c in at], "doc_id": pdf["doc_id"], "part": pdf["part"], "tokens": pdf["tokens"]})


def containers(documents: DataFrame, specs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per piece of a document and spec: ``spec_id, container_id, doc_id, part, tokens``. ``specs``: ``spec_id,
    capacity_tokens, separator_tokens`` (a few rows)."""
    counts = written(token_counts(documents, path), "tokens")
    x = counts.crossJoin(F.broadcast(specs.select("spec_id", F.col("capacity_tokens").alias("cap"), F.col("separator_tokens").alias("sep")).distinct()))
    full = x.where("tokens >= cap").select("spec_id", "doc_id", F.explode(F.expr("sequence(0, cast(tokens div cap as int) - 1)")).alias("part"), F.col("cap").cast("bigint").alias("tokens"))
    full = full.select("spec_id", F.concat_ws("-", "spec_id", F.lit("full"), "doc_id", "part").alias("container_id"), "doc_id", "part", "tokens")
    empty = x.where("tokens = 0").select("spec_id", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("part"), "tokens")
    rest = x.where("tokens % cap > 0").select("spec_id", "doc_id", F.expr("cast(tokens div cap as int)").alias("part"), F.expr("tokens % cap").alias("tokens"), (F.col("cap") + F.col("sep")).alias("room"), F.expr("tokens % cap + sep").alias("size"))
    shards = max(1, -(-counts.count() // SHARD))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    packed = rest.groupBy("spec_id", "shard").applyInPandas(_pack_shard, "spec_id int, container_id string, doc_id bigint, part int, tokens bigint")
    return full.unionByName(packed).unionByName(empty)


def fill(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, texts, tokens, the least number of containers possible, and the share of room used (separators count as used)."""
    per = rows.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    s = specs.select("spec_id", F.col("capacity_tokens").alias("cap"), F.col("separator_tokens").alias("sep")).distinct()
    used = per.join(F.broadcast(s), "spec_id").withColumn("u", F.col("t") + (F.col("k") - 1) * F.col("sep"))
    return used.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("k").alias("pieces"), F.sum("t").alias("tokens"), F.max("u").alias("fullest"), F.ceil(F.sum(F.col("t") + F.col("sep")) / F.first(F.col("cap") + F.col("sep"))).alias("least_containers"), (F.sum("u") / F.sum("cap")).alias("fill_share"))
