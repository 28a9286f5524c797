"""Operators for text collections against plain versions of what they compute, and their edge cases."""

import itertools
import random
import time
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tezgah.llm import chunks, components, leak, near_dup, packing, quota, repetition, words
from tezgah.session import written

SYL = "ba be bi bo çu de dı fa ge gö ha hı ka ke ko la lu ma me mo na pe ra ri sa şi ta te tu va ve ya yo yü".split()


def word(r):
    return "".join(r.choice(SYL) for _ in range(r.randint(2, 4)))


def sentence(r, vocabulary, n=None):
    s = " ".join(r.choice(vocabulary) for _ in range(n or r.randint(6, 11)))
    return s[0].upper() + s[1:] + "."


@pytest.fixture(scope="module")
def vocabulary():
    r = random.Random(1)
    return sorted({word(r) for _ in range(900)})


# ------------------------------------------------------------------ words


def test_words():
    assert words.one("İSTANBUL'da ılık; 17.25 Çağ-rı é '' ’x’") == ["istanbulda", "ilik", "17", "25", "cag", "ri", "e", "x"]
    assert words.one(None) == words.one("") == words.one(" '́ ") == []
    assert words.one("a𝒜b 😀 c") == words.one("a𝒜b 😀 c") and len(words.one("x😀y")) == 2
    w = words.words(pa.array(["bir iki", None, "", "iki", "x" * 100_000]))
    assert w.row.tolist() == [0, 0, 3, 4] and w.first.tolist() == [0, 2, 2, 2, 3, 4] and w.hash[1] == w.hash[2] and len(w.word(3)) == 100_000
    b = pa.RecordBatch.from_pydict({"text": ["abc"] * 100 + [None] + ["y" * 50]})
    assert sum(s.num_rows for s in words.slices(b, "text", 10)) == 102
    assert list(words.slices(b.slice(0, 0), "text")) == []


# ------------------------------------------------------------------ near duplicates


def test_bit_sliced_distances():
    r = np.random.default_rng(2)
    for n, blocks in ((1, 1), (2, 1), (70, 3), (300, 5), (500, 200)):
        block = r.integers(0, blocks, n)
        base = r.random((blocks, near_dup.BITS)) < 0.05
        x = np.where((r.random(n) < 0.5)[:, None], base[block], r.random((n, near_dup.BITS)) < 0.05)
        e = x | (r.random(x.shape) < 0.3)
        slack, home, tile = r.integers(0, 8, n), r.random(n) < 0.5, np.where(block % 2, r.integers(0, 2, n), -1)
        i, j = near_dup.close_pairs(block, *(np.packbits(v, axis=1, bitorder="little") for v in (x, e)), slack, home, tile)
        got = sorted((min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist()))
        met = [(a, b) for a, b in itertools.combinations(range(n), 2) if block[a] == block[b] and (home[a] or home[b]) and (tile[a] < 0 or tile[a] != tile[b])]
        assert got == [(a, b) for a, b in met if (x[a] & ~e[b]).sum() <= slack[a] and (x[b] & ~e[a]).sum() <= slack[b]]


def slips_between(a, b):
    """Letters put in, left out or exchanged, and neighbours that changed places, by the plain table."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@lru_cache(None)
def same_word(a, b):
    short = min(len(a), len(b))
    if a == b or a.isdigit() or b.isdigit() or short < 4 or abs(len(a) - len(b)) > 2:
        return a == b
    return len(set(a) ^ set(b)) <= 4 and slips_between(a, b) <= (1 if short < 6 else 2)  # a slip changes at most two letters of the set


def plain_agreement(a, b):
    """Largest matching by augmenting paths over all pairs of words; shares no code with the operator."""
    to, at = [[j for j, y in enumerate(b) if same_word(x, y)] for x in a], {}

    def free(i, seen):
        for j in to[i]:
            if j not in seen:
                seen.add(j)
                if j not in at or free(at[j], seen):
                    at[j] = i
                    return True
        return False

    return sum(free(i, set()) for i in range(len(a))) / max(len(a), len(b))


def test_slips_of_words():
    r = random.Random(23)
    for _ in range(3000):
        a = "".join(r.choice("abc1") for _ in range(r.randint(1, 12)))
        b = list(a)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 2)] = r.choice(["", "a", "cb"])
        b = "".join(b)
        assert words.near(a, b) == same_word(a, b) and (a == b or bool(words.near_many([a], [b])[0]) == same_word(a, b))
        if a != b and same_word(a, b):  # such words have a rest in common
            at, key = near_dup.rests([a, b])
            assert set(key[at == 0].tolist()) & set(key[at == 1].tolist())
    long = "".join(r.choice("abcdefgh") for _ in range(40))
    for b in (long[:7] + long[8:31] + long[32:], long[:3] + "x" + long[3:20] + "y" + long[20:], long[1:], long + "zz", long[:9] + long[10] + long[9] + long[11:25] + long[26] + long[25] + long[27:]):
        at, key = near_dup.rests([long, b])
        assert words.near(long, b) and set(key[at == 0].tolist()) & set(key[at == 1].tolist())


def test_largest_matching():
    r = random.Random(24)
    for _ in range(500):
        some = ["".join(r.choice("ab") for _ in range(r.choice([4, 5, 6, 7]))) for _ in range(6)]
        a, b = ([r.choice(some) for _ in range(r.randint(1, 7))] for _ in range(2))
        assert abs(near_dup.agreement(a, b) - plain_agreement(a, b)) < 1e-9
    assert near_dup.agreement(["abcdefg"], ["axcdeyg"]) == 1  # two slips, wherever they are


def records(vocabulary, n=150, seed=3):
    r = random.Random(seed)
    rows = [(f"o{i:04}", " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 20)))) for i in range(n)]
    for i in range(n // 2):
        w = rows[r.randrange(n)][1].split()
        for _ in range(len(w) // 5):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.5:
            r.shuffle(w)
        k = r.randrange(len(w))
        w[k] = w[k][:2] + "x" + w[k][2:]
        rows.append((f"d{i:04}", r.choice([str.upper, str.title, str])(" ".join(w).replace("i", "İ") if r.random() < 0.2 else " ".join(w))))
    return rows


def brute_pairs(rows, agree=0.7):
    bags = {i: words.one(t) for i, t in rows if t and words.one(t)}
    return {(a, b) for a, b in itertools.combinations(sorted(bags), 2) if len(bags[a]) >= agree * len(bags[b]) - 1e-9 and len(bags[b]) >= agree * len(bags[a]) - 1e-9 and plain_agreement(bags[a], bags[b]) >= agree - 1e-12}


@pytest.mark.parametrize("tile", [2048, 8])
def test_near_duplicates_find_what_all_pairs_find(spark, vocabulary, monkeypatch, tile):
    monkeypatch.setattr(near_dup, "TILE", tile)
    rows = records(vocabulary)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, text string, cls int, bag string")
    got = {(r["id_a"], r["id_b"]) for r in near_dup.near_duplicates(df).collect()}
    want = brute_pairs(rows)
    assert len(want) > 40 and got == want


def common_words(seed=17, per=60):
    """Texts that share seven frequent short words, with three long words of their own."""
    r = random.Random(seed)
    rows = []
    for t in range(3):
        shared = ["".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(2)) + "xyw"[t] for _ in range(7)]
        for k in range(per):
            rows.append((f"{t}-{k:03}", " ".join(shared + ["".join(r.choice("abcdefghijklmnoprstuvyz") for _ in range(9)) for _ in range(3)])))
    return rows


def test_frequent_shared_words_are_enough(spark):
    rows = common_words()
    got = {(x["id_a"], x["id_b"]) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == brute_pairs(rows) and len(got) >= 3 * 60 * 59 // 2


def test_slips_in_the_shared_words(spark):
    """Five of the seven shared words with two letters altered: more letter triples differ than agree."""
    r = random.Random(18)
    rows = []
    letters = "abcdefghijklmnoprstuvyz"
    for k in range(60):
        w = ["".join(r.choice(letters) for _ in range(8)) for _ in range(10)]
        v = [x[:3] + "q" + x[4] + "w" + x[6:] for x in w[:5]] + w[5:7] + ["".join(r.choice(letters) for _ in range(9)) for _ in range(3)]
        rows += [(f"a{k}", " ".join(w)), (f"b{k}", " ".join(v))]
    got = {(x["id_a"], x["id_b"]) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {(f"a{k}", f"b{k}") for k in range(60)}


def test_near_duplicates_edges(spark):
    rows = [("a", None), ("b", ""), ("c", " \n"), ("d", "tek"), ("e", "TEK!"), ("f", "başka"), ("g", "bir iki üç dört"), ("g", "bir iki üç dört"), ("h", "dört üç iki bir"), (None, "bir iki üç dört"), ("l", "uzun " * 20_000)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert {(r["id_a"], r["id_b"]) for r in near_dup.near_duplicates(df).collect()} == {("d", "e"), ("g", "h")}
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    g = {r["id"]: r for r in near_dup.near_duplicate_groups(df).collect()}
    assert g["g"]["group_id"] == g["h"]["group_id"] and g["g"]["members"] == 2 and g["l"]["links"] == 0 and len(g) == 6


def test_groups_of_a_hot_class(spark, vocabulary):
    rows = [(f"c{i}", "aynı söz her yerde durur işte böyle") for i in range(60)] + records(vocabulary, 60, 9)
    df = spark.createDataFrame(rows, "id string, text string")
    g = near_dup.near_duplicate_groups(df).toPandas()
    assert len(g) == len(rows) and (g[g.id.str.startswith("c")].members == 60).all()
    links = {(a, b) for a, b in brute_pairs(rows) if not (a[0] == "c" and b[0] == "c")}
    group = dict(zip(g.id, g.group_id))
    assert all(group[a] == group[b] for a, b in links)


@pytest.fixture
def small_driver(spark):
    """No table of more than two megabytes may be broadcast, whatever Spark takes its size for (a hash table has one at least)."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2000000")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_near_duplicates_broadcast_no_table_that_grows(spark, vocabulary, small_driver):
    r = random.Random(34)
    long = [(f"l{k}", " ".join("".join(r.choice("abcdefghijklmnoprstuvyz") for _ in range(20)) for _ in range(60))) for k in range(10)]
    rows = records(vocabulary, 60, 11) + long  # a word of 20 letters has 211 rests
    df = spark.createDataFrame(rows, "id string, text string")
    assert {(x["id_a"], x["id_b"]) for x in near_dup.near_duplicates(df).collect()} == brute_pairs(rows)
    assert near_dup.near_duplicate_groups(df).count() == len(rows)


def test_agreement():
    f = near_dup.agreement
    assert f("a b c d".split(), "d c b a".split()) == 1 and f(["ev", "ev"], ["ev"]) == 0.5
    assert f("kitaplar masada durdu".split(), "ktaplar masadda drudu".split()) == 1
    assert f(["1234567"], ["1234568"]) == 0 and f(["abc"], ["abd"]) == 0


# ------------------------------------------------------------------ cross-split overlaps


def test_chunks_ignore_order_and_edits_elsewhere():
    a = "barkodlarda yükleyen tebligatımızı toplayarak hemen".split()
    assert chunks.overlap(a, a[::-1]) == 1 and chunks.overlap(a, []) == 0
    assert 0.8 < chunks.overlap(a, [*a, "fazladan"]) < 1
    assert chunks.overlap(["toplayarak", "hemen"], ["toplayrak", "hemen"]) == 14 / 15


def test_overlaps_across_splits(spark, vocabulary):
    rows = records(vocabulary, 150, 5)
    r = random.Random(6)
    split = {i: r.choice(["train", "Train ", "TRAIN", "dev", "development", "sealed_test", "Test", None, "other"]) for i, _ in rows}
    side = {"train": "t", "dev": "e", "development": "e", "sealed_test": "e", "test": "e"}
    of = {i: side.get((s or "").strip().lower()) for i, s in split.items()}
    want = {p for p in brute_pairs(rows) if of[p[0]] and of[p[1]] and of[p[0]] != of[p[1]]}
    q = spark.createDataFrame([*rows, ("n1", None), ("n2", "")], "_id string, text string")
    fam = spark.createDataFrame([(i, s, "src", "clash") for i, s in split.items()] * 2 + [("n1", "train", None, ""), ("n2", "dev", None, "")], "family_id string, split_name string, source_dataset string, text string")
    got = {tuple(sorted((x["train_id"], x["eval_id"]))) for x in chunks.split_overlaps(q, fam).collect()}
    assert len(want) > 15 and got == want
    rep = chunks.overlap_report(q, fam).agg(F.sum("records"), F.sum("overlapping")).first()
    hit = {e for p in want for e in p if of[e] == "e"}
    assert tuple(rep) == (sum(v == "e" for v in of.values()), len(hit))
    assert chunks.split_overlaps(q.limit(0), fam).count() == 0


def test_frequent_words_and_slips_across_splits(spark):
    """Slips make chunks unique; the shared words are frequent."""
    rows = [(i, t if int(i[2:]) % 2 else " ".join(w[:1] + "qq" + w[3:] if k < 5 and len(w) > 5 else w for k, w in enumerate(t.split()))) for i, t in common_words(19, 20)]
    r = random.Random(20)
    for k in range(30):
        w = ["".join(r.choice("abcdefghijklmnoprstuvyz") for _ in range(8)) for _ in range(10)]
        rows += [(f"a{k}", " ".join(w)), (f"b{k}", " ".join([x[:3] + "q" + x[4] + "w" + x[6:] for x in w[:6]] + w[6:8]))]
    side = {i: "train" if k % 2 else "dev" for k, (i, _) in enumerate(rows)}
    want = {p for p in brute_pairs(rows) if side[p[0]] != side[p[1]]}
    q = spark.createDataFrame(rows, "_id string, text string")
    fam = spark.createDataFrame([(i, s, "src") for i, s in side.items()], "family_id string, split_name string, source_dataset string")
    assert {tuple(sorted((x["train_id"], x["eval_id"]))) for x in chunks.split_overlaps(q, fam).collect()} == want and {(f"a{k}", f"b{k}") for k in range(30)} <= want


def test_overlaps_broadcast_no_table_that_grows(spark, small_driver, tmp_path):
    """Files of a few hundred kilobytes whose rows are megabytes; every text has words of its own, but for ten and their copies."""
    n = [F.col("id") * 3 + k for k in range(1_000_000, 1_000_003)]
    x = spark.range(30_000).select("id", F.format_string("t%05d", "id").alias("family_id"), F.lit("train").alias("split_name"), F.concat_ws(" ", *n).alias("text"))
    y = spark.range(7, 30_000, 3000).select("id", F.format_string("d%05d", "id").alias("family_id"), F.lit("dev").alias("split_name"), F.concat_ws(" ", *n[::-1]).alias("text"))
    x.unionByName(y).withColumn("source_dataset", F.lit("src")).write.parquet(f"{tmp_path}/x")
    rows = spark.read.parquet(f"{tmp_path}/x")
    got = {(p["train_id"], p["eval_id"]) for p in chunks.split_overlaps(rows.select(F.col("family_id").alias("_id"), "text"), rows).collect()}
    assert got == {(f"t{k:05}", f"d{k:05}") for k in range(7, 30_000, 3000)}
    assert [tuple(p)[2:4] for p in chunks.overlap_report(rows.select(F.col("family_id").alias("_id"), "text"), rows).collect()] == [(10, 10)]


# ------------------------------------------------------------------ components and splits


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(up):
        out[find(x)].add(x)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("small", [50_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)  # at 0, colliding labels are merged by frontiers alone
    r = random.Random(7)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    some = [(2000 + r.randrange(400), 2000 + r.randrange(400)) for _ in range(260)]
    edges = path + star + [e for e in some if e[0] != e[1]] + [(5000, 5001)] * 3 + [(5001, 5000)]
    r.shuffle(edges)
    got = defaultdict(set)
    for x in components.components(spark.createDataFrame([*edges, (7, 7)], "a bigint, b bigint")).collect():
        got[x["component"]].add(x["node"])
    assert {frozenset(v) for v in got.values()} == union_find(edges)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keys(spark):
    df = spark.createDataFrame([("GELMEK", "Event_Report/0012"), ("gel-", "event-report.12"), (" “gelmek” ", "EVENT_REPORT#12"), ("N/A", "n/a"), (None, None), ("-", ""), ("bilinmiyor", "bilinmiyor"), ("ısınmak", "event_report")], "l string, t string")
    k = [tuple(r) for r in df.select(components.lemma_key("l"), components.template_key("t")).collect()]
    assert k == [("gel", "eventreport.12")] * 3 + [(None, None)] * 4 + [("isin", None)]


def families(spark, n=400, seed=8):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lemma = "hotmak" if r.random() < 0.33 else r.choice([None, "N/A", f"v{r.randrange(300)}mek", f"V{r.randrange(300)}mek "])
        rows.append((f"f{i}", r.choice(["train", "dev", "test", None]), lemma, r.choice([None, "-", f"base.{r.randrange(500):08}", f"BASE#{r.randrange(500)}"]), "clash"))
    return rows, spark.createDataFrame(rows + rows[:30] + [(None, "train", "x", "y.1", "")], "family_id string, split_name string, critical_lemma string, template_id string, component string")


def test_related_families_share_a_split(spark):
    rows, df = families(spark)
    low = lambda s: (s or "").strip().lower()
    edges = []
    for i, _, lemma, t, _ in rows:
        edges.append((i, i))
        if low(lemma) not in ("", "n/a"):
            edges.append((i, ("l", low(lemma)[:-3])))
        if low(t) not in ("", "-"):
            edges.append((i, ("t", int(t[5:]))))
    groups = [{x for x in g if isinstance(x, str)} for g in union_find(edges)]
    got = defaultdict(set)
    for x in components.family_components(df).collect():
        got[x["component"]].add(x["family_id"])
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups if g}
    split = {r[0]: r[1] for r in rows}
    want = {i for g in groups for i in g if split[i] and len({split[j] for j in g} - {None}) > 1}
    assert {x["family_id"] for x in components.broken(df).collect()} == want
    t = spark.createDataFrame([("train", 0.5), ("dev", 0.25), ("test", 0.25)], "split_name string, target_share double")
    a = {x["family_id"]: x["split_name"] for x in components.assign_splits(df, t).collect()}
    assert set(a) == set(split) and all(len({a[i] for i in g}) == 1 for g in groups if g) and None not in a.values()
    assert sum(r["families"] for r in components.balance(components.assign_splits(df, t), t).collect()) == len(split)
    assert components.assign_splits(df.limit(0), t).count() == 0


# ------------------------------------------------------------------ quota sample


def slots(spark, n=1000, seed=9):
    r = random.Random(seed)
    rows = [(f"s{i}", r.choice(["News", "news ", "NEWS", "health", "rare thing", None] if i % 50 else ["tiny"]), "big" if r.random() < 0.7 else "small", i) for i in range(n)]
    rows += [(s, "stale", g, -1) for s, _, g, _ in rows[::10]]
    return spark.createDataFrame(rows, "slot_id string, domain string, generator_id string, t int").withColumn("updated_at", F.timestamp_seconds("t")).withColumn("n", F.lit(1)).withColumn("bucket", F.lit("clash"))


def test_quota_sample(spark):
    s = slots(spark)
    t = spark.createDataFrame([("domain", "news", 0.5, 3), ("domain", "health", 0.2, 3), ("domain", "rare_thing", 0.28, 3), ("domain", "tiny", 0.02, 8), ("domain", "gone", 0.0, 2), ("generator_id", "big", 0.4, 1), ("generator_id", "small", 0.6, 1)], "axis string, category string, target_share double, min_rows int")
    sample, report = quota.quota_sample(s, t)
    got = sample.toPandas()
    assert len(got) == got.slot_id.nunique() == 250
    rep = {r["category"]: r for r in report.collect()}
    assert {c for c, r in rep.items() if r["short"]} == {"gone"}
    assert rep["tiny"]["sampled"] >= 8 and abs(rep["news"]["sampled"] - 125) <= 4 and abs(rep["small"]["sampled"] - 150) <= 4
    assert (got.domain == "tiny").sum() == rep["tiny"]["sampled"] and rep["tiny"]["supply"] == 20
    again = quota.quota_sample(s, t)[0].toPandas()
    assert set(again.slot_id) == set(got.slot_id)
    assert quota.quota_sample(s.limit(0), t)[0].count() == 0 and quota.quota_sample(s, t.limit(0))[0].count() == 0


def test_systematic_inclusion_is_fair(spark):
    """Each slot of a category is equally likely: over seeds, none is left out."""
    s = slots(spark, 200)
    t = spark.createDataFrame([("generator_id", "big", 0.5, 1), ("generator_id", "small", 0.5, 1)], "axis string, category string, target_share double, min_rows int")
    seen = Counter(r["slot_id"] for k in range(6) for r in quota.quota_sample(s, t, 0.5, seed=k)[0].collect())
    assert sum(seen.values()) == 600 and len(seen) > 170


# ------------------------------------------------------------------ packing


@pytest.mark.parametrize("sizes", [[], [5], [10] * 7, [1] * 50, [10, 1] * 9])
def test_packing_small(sizes):
    at = packing.pack(np.array(sizes, np.int64), 10)
    use = Counter()
    for s, c in zip(sizes, at.tolist()):
        use[c] += s
    assert all(v <= 10 for v in use.values()) and len(at) == len(sizes) and len(use) == -(-sum(sizes) // 10)


def test_packing_wastes_little():
    r = np.random.default_rng(3)
    for cap in (513, 4098):
        sizes = np.minimum(cap, r.lognormal(5, 1, 6000).astype(np.int64) + 1)
        at = packing.pack(sizes, cap)
        use = np.bincount(at, weights=sizes)
        assert use.max() <= cap and len(use) <= 1.02 * sizes.sum() / cap + 1


def test_token_counts_equal_whole_encodings():
    c = packing.Counter(packing.VOCABULARY)
    for t in ["Evde 3 kez, \n\n çay  içtik!   Sonra", "a\n b", "x", "tab\t b", "don't we'll", " öncü  ", "son\n", "a  \n  b", " a b", "a   b c"]:
        assert c(t) == len(c.encode(t))
    assert c(None) == c("") == c(" \n") == 0


def test_containers(spark):
    docs = [(i, " ".join(["kelime"] * (i % 40))) for i in range(200)] + [(300, None), (301, "  "), (302, "uzun " * 900), (303, "uzun " * 900)]
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id bigint, text string, tokens int, container_id string")
    s = spark.createDataFrame([(1, 128, 1), (2, 512, 2)], "spec_id int, capacity_tokens int, separator_tokens int")
    x = packing.containers(d, s).toPandas()
    tokens = packing.token_counts(d).toPandas().set_index("doc_id").tokens
    for spec, cap, sep in ((1, 128, 1), (2, 512, 2)):
        p = x[x.spec_id == spec]
        assert (p.groupby("doc_id").tokens.sum() == tokens).all() and not p.duplicated(["doc_id", "part"]).any()
        g = p.dropna(subset=["container_id"]).groupby("container_id").tokens
        assert (g.sum() + (g.count() - 1) * sep <= cap).all()
        whole = tokens[tokens <= cap].index
        assert (p[p.doc_id.isin(whole)].groupby("doc_id").size() == 1).all()
        assert set(p[p.container_id.isna()].doc_id) == set(tokens[tokens == 0].index)
    f = packing.fill(packing.containers(d, s), s).toPandas()
    assert (f.containers <= 1.05 * f.least_containers + 1).all()
    assert packing.containers(d.limit(0), s).count() == 0


# ------------------------------------------------------------------ leaks


def test_leaks(spark, vocabulary):
    r = random.Random(11)
    sent = lambda: sentence(r, vocabulary)
    order = "Aşağıdaki metni okuyup soruyu yanıtlayınız."
    items = [(i, " ".join(sent() for _ in range(3))) for i in range(40)]
    items = [(i, (order + " " + t) if i < 10 else t) for i, t in items] + [(90, None), (91, "  "), (92, "tek"), (93, "")]
    docs, want = [], set()
    fill = lambda n: " ".join(sent() for _ in range(n))
    for k in range(40):
        s = leak.sentences(dict(items)[k])[-3:]
        w = " ".join(s).split()
        kind = k % 8
        if kind == 0:
            text = f"{fill(5)} {' '.join(s)} {fill(2)}"
        elif kind == 1:
            text = f"{fill(1)} {s[0].upper()} {fill(3)} {s[1]} {fill(1)} {s[2]}"
        elif kind == 2:
            for i in range(0, len(w), 7):
                w[i] = w[i][:1] + "x" + w[i][1:]
            text = fill(2) + " <b>" + " ".join(w) + "</b>"
        elif kind == 3:
            for i in range(3, len(w), 8):
                w[i] = r.choice(vocabulary)
            text = " ".join(w) + " " + fill(4)
        elif kind == 4:
            text = f"{fill(2)} {s[0]} {s[1]} {fill(2)}"  # two of three sentences
        elif kind == 5:
            text = f"{fill(3)} {' '.join(w[:4])} {fill(3)}"  # a few words
        elif kind == 6:
            r.shuffle(w)
            text = f"{fill(2)} {' '.join(w)} {fill(2)}"
        else:
            text = f"{order} {fill(6)}"
        docs.append((k, text))
        if kind < 5:
            want.add((k, k))
    docs += [(100, None), (101, ""), (102, fill(3)), (103, docs[0][1]), (104, dict(items)[16].split(". ")[0])]
    want |= {(103, 0)}
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(*x, "c") for x in items + items[:3]], "item_id bigint, text string, doc_id string")
    got = {(x["doc_id"], x["item_id"]) for x in leak.leaks(d.repartition(3), it).collect()}
    assert got == want
    exact = {(x["doc_id"], x["item_id"]) for x in leak.leaks(d, it).where("exact").collect()}
    assert {(k, k) for k in range(0, 40, 8)} <= exact
    assert leak.leaks(d.limit(0), it).count() == 0 and leak.leaks(d, it.limit(0)).count() == 0


def test_leaks_in_blocks(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK", 3)
    r = random.Random(12)
    items = [(i, " ".join(sentence(r, vocabulary) for _ in range(2))) for i in range(8)]
    docs = [(i, f"{sentence(r, vocabulary)} {t}") for i, t in items] + [(50, ("dolgu metni " * 3000) + items[2][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in leak.leaks(d, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i in range(8)} | {(50, 2)}


def test_sentences():
    f = leak.sentences
    assert f("Şubat ayının 13. günü geldi. Saat 10.15'te “gitti.” Sonra bitti!") == ["Şubat ayının 13. günü geldi.", "Saat 10.15'te “gitti.”", "Sonra bitti!"]
    assert f("bir. iki üç.") == ["bir.", "iki üç."] and f("  ") == [] and f("Tek") == ["Tek"]


def test_one_whole_sentence_and_a_common_frame(spark, vocabulary):
    """A sentence that is more than half of the item is a case; a frame of frequent words that many sentences share is none."""
    r = random.Random(21)
    frame = lambda: f"{sentence(r, vocabulary, 2)[:-1]} şubat ayının {r.randrange(1, 29)}. günü ne {r.choice(vocabulary)} ne de {r.choice(vocabulary)} {r.choice(vocabulary)} {r.choice(vocabulary)}."
    long, short = sentence(r, vocabulary, 13), sentence(r, vocabulary, 9)
    items = [(1, f"{long} {short}"), (2, "Berber rıza şubat ayının 3. günü ne fırçayı ne de eğri tahtamızı köyde inceledi.")]
    docs = [(i, " ".join(frame() for _ in range(12))) for i in range(300)] + [(900, f"{frame()} {long} {frame()}"), (901, f"{frame()} {short} {frame()}")]
    got = {(x["doc_id"], x["item_id"]) for x in leak.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(900, 1)}


def test_near_words():
    assert words.near("kitaplar", "kiatplar") and words.near("kitap", "kita") and not words.near("kitap", "masa") and not words.near("ev", "eh") and not words.near("12345", "12346")


# ------------------------------------------------------------------ repetition


def plain_repetition(w):
    """Words in five that stood before, or in eight that stood before but for one word; all earlier places are compared."""
    n, mark = len(w), [False] * len(w)
    for size, miss in ((5, 0), (8, 1)):
        for i in range(n - size + 1):
            if any(sum(a != b for a, b in zip(w[i : i + size], w[p : p + size])) <= miss for p in range(i)):
                mark[i : i + size] = [True] * size
    return sum(mark)


def test_repeated_words_against_a_plain_version(vocabulary):
    r = random.Random(13)
    texts = []
    for _ in range(60):
        s = [sentence(r, vocabulary) for _ in range(r.randint(1, 6))]
        for _ in range(r.randint(0, 5)):
            w = r.choice(s).rstrip(".").split()
            if r.random() < 0.5 and len(w) > 8:
                w[r.randrange(len(w))] = word(r)
            s.insert(r.randrange(len(s) + 1), " ".join(w).upper() if r.random() < 0.3 else " ".join(w))
        texts.append(" ".join(s))
    w = words.words(pa.array(texts))
    rep, _ = repetition.repeated(w.hash, w.row)
    got = np.bincount(w.row[rep], minlength=len(texts))
    want = [plain_repetition(words.one(t)) for t in texts]
    close = [abs(g - x) <= 2 for g, x in zip(got.tolist(), want)]
    assert np.mean(close) >= 0.95 and sum(want) > 300  # of several earlier places the nearest and the first are compared


def test_every_earlier_place_counts():
    """Lines with a changing number and a common ending: the true earlier copy is often neither the first nor the nearest place of its four words."""
    r = random.Random(16)
    kinds = [[f"satır{k}{x}" for x in "abc"] for k in range(10)]
    texts = []
    for t in range(4):
        w = []
        for j in range(40):
            w += [f"dolgu{t}{j}", *r.choice(kinds), str(r.randrange(10**6)), "olarak", "kayda", "geçmiş", "bulunur"]
        texts.append(" ".join(w))
    w = words.words(pa.array(texts))
    rep, _ = repetition.repeated(w.hash, w.row)
    assert np.bincount(w.row[rep], minlength=len(texts)).tolist() == [plain_repetition(words.one(t)) for t in texts]


def test_repetition_report(spark, vocabulary):
    r = random.Random(14)
    rows = []
    for i in range(400):
        s = [sentence(r, vocabulary) for _ in range(r.randint(4, 12))]
        heavy = i % 9 == 0
        if heavy:
            s += s[: max(3, len(s) * 2 // 3)]
        rows.append((i, " ".join(s), r.choice(["tr", "TR ", None]) if i < 300 else "en", "hot" if i < 150 else r.choice(["a", "b", None]), heavy))
    rows += [(900, None, "tr", "a", False), (901, "", "tr", "a", False), (902, "tek", None, None, False), (903, "aynı söz yine gelir burada " * 9000, "tr", "a", True), (904, rows[0][1], "tr", "hot", True)]
    df = spark.createDataFrame([(*x[:4], 1.0) for x in rows], "doc_id bigint, text string, lang string, source string, distance double")
    out = {x["doc_id"]: x for x in repetition.repetition_report(df).collect()}
    assert len(out) == len(rows)
    assert {i for i, x in out.items() if x["heavy"]} == {x[0] for x in rows if x[4]}
    assert out[900]["rep_share"] == out[902]["rep_share"] == 0 and out[903]["rep_share"] > 0.99
    assert repetition.repetition_report(df.limit(0)).count() == 0
    g = repetition.repetition_by_group(repetition.repetition_report(df))
    assert g.agg(F.sum("documents")).first()[0] == len(rows)


def test_most_of_a_group_repeats_itself(spark, vocabulary):
    r = random.Random(15)
    s = lambda: [sentence(r, vocabulary) for _ in range(6)]
    rows = [(i, " ".join(x := s()) + " " + " ".join(x), "tr", "spam") for i in range(80)] + [(100 + i, " ".join(s()), "tr", f"s{i % 3}") for i in range(150)]
    out = repetition.repetition_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).where("heavy").count()
    assert out == 80


def test_queries_equal_sql(spark, small):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    from tezgah.llm import queries

    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, small)
        cols = sorted(df.columns)
        res = c.execute(sql)
        names = [d[0] for d in res.description]
        assert sorted(tuple(r[k] for k in cols) for r in df.collect()) == sorted(tuple(r[names.index(k)] for k in cols) for r in res.fetchall())


def test_robust_estimate_decides(spark):
    """Contaminated vectors don't move the centre; without the estimate's rejection no document is measured."""
    r = np.random.default_rng(31)
    x = np.concatenate([r.normal(0, 0.1, (700, 3)), r.normal(5, 0.1, (290, 3))])
    centre, cov, n = repetition.concentrate(np.round(x * 64) / 64, np.ones(len(x), np.int64))
    assert np.abs(centre).max() < 0.05 and np.linalg.det(cov) < 1e-4 and 490 <= n <= 520
    once = repetition.concentrate(np.array([[0.0, 0, 0], [1, 1, 1]]), np.array([9, 1]))
    assert once[0].tolist() == [0, 0, 0] and once[2] == 9
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "tr", "s") for i in range(50)] + [(99, "bir iki üç dört beş altı " * 5, "tr", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert [x["doc_id"] for x in repetition.heavy_documents(d).collect()] == [99] and repetition.heavy_documents(d.limit(0)).count() == 0


def test_instructions_count_over_all_items(spark, vocabulary, monkeypatch):
    """Of items held in memory one by one the rows are the same: an instruction is shared by all, not by those of a block."""
    r = random.Random(33)
    said = "Aşağıdaki metni dikkatle okuyup soruyu yanıtla."
    body = [" ".join(sentence(r, vocabulary, 9) for _ in range(3)) for _ in range(5)]
    it = spark.createDataFrame([(k, f"{said} {b}") for k, b in enumerate(body)], "item_id bigint, text string")
    other = lambda: " ".join(sentence(r, vocabulary) for _ in range(6))
    d = spark.createDataFrame([(k, f"{other()} {b} {other()}") for k, b in enumerate(body)] + [(50 + k, f"{said} {other()}") for k in range(10)], "doc_id bigint, text string")
    want = {(k, k) for k in range(5)}
    assert {(x["doc_id"], x["item_id"]) for x in leak.leaks(d, it).collect()} == want
    monkeypatch.setattr(leak, "BLOCK", 2)
    assert {(x["doc_id"], x["item_id"]) for x in leak.leaks(d, it).collect()} == want


def test_an_item_of_many_words(spark):
    text = " ".join(f"söz{k}lar" for k in range(6000))
    d = spark.createDataFrame([(1, text), (2, " ".join(text.split()[:3500]) + " son"), (3, " ".join(reversed(text.split())))], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, text)], "item_id bigint, text string")
    assert {x["doc_id"] for x in leak.leaks(d, it).collect()} == {1, 2}


def shuffle_bytes(spark) -> int:
    """Shuffle files on the disk, once those of finished writes are gone."""
    time.sleep(2)
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    return sum(f.length() for f in iter(lambda: files.next() if files.hasNext() else None, None) if f.getName().startswith("shuffle_"))


def test_written_leaves_no_shuffle_files(spark):
    before = shuffle_bytes(spark)
    x = written(spark.range(300_000).groupBy(F.xxhash64("id").alias("h")).count(), "t")
    assert x.count() == 300_000 and shuffle_bytes(spark) < before + 100_000


def test_passes_find_the_same_pairs_with_less_disk(spark, vocabulary, monkeypatch):
    rows = records(vocabulary, 300, 12)
    df = spark.createDataFrame(rows, "id string, text string")
    want = brute_pairs(rows)
    for k in ("WORDS_AT_ONCE", "ENTRIES_AT_ONCE", "KEYS_AT_ONCE", "PAIRS_AT_ONCE"):
        monkeypatch.setattr(near_dup, k, 150)
    monkeypatch.setattr(near_dup, "PASSES", 3)
    assert sorted((x["id_a"], x["id_b"]) for x in near_dup.near_duplicates(df).collect()) == sorted(want)


def test_pairs_of_copies_are_not_shuffled(spark):
    """Half a million pairs of records of one text; the ids with two texts give each pair once, too."""
    rows = [(f"copy{k:04}", "kargo bugün geldi ama kutu kırık çıktı") for k in range(1000)] + [("copy0001", "kargo bugün geldi ama kutu ezik çıktı"), ("copy0002", "kargo bugün geldi ama kutu ezik çıktı")]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "id string, text string"))
    before = shuffle_bytes(spark)
    got = found.groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("id_a") < F.col("id_b")).alias("ok")).first()
    assert got["n"] == got["ok"] == 499_500
    assert shuffle_bytes(spark) < before + 500_000


def test_overlaps_in_passes_and_of_copies(spark, vocabulary, monkeypatch):
    """A quarter of a million pairs of copies are not shuffled; passes find what one pass finds; an id with two texts gives a pair once."""
    rows = [(i, t) for i, t in records(vocabulary, 300, 13) if t]
    rows += [(f"copy{k:04}", "kargo bugün geldi ama kutu kırık çıktı") for k in range(1000)] + [(f"copy{k:04}", "kargo bugün geldi ama kutu ezik çıktı") for k in (1, 2)]
    q = spark.createDataFrame(rows, "_id string, text string")
    fam = spark.createDataFrame([(i, "train" if k % 2 else "dev", "s") for k, i in enumerate(sorted({i for i, _ in rows}))], "family_id string, split_name string, source_dataset string")
    train = {i for k, i in enumerate(sorted({i for i, _ in rows})) if k % 2}
    want = {tuple(sorted(p)) for p in brute_pairs([x for x in rows if x[0][:4] != "copy"]) if len(train & set(p)) == 1}
    for k in ("WORDS_AT_ONCE", "ENTRIES_AT_ONCE", "KEYS_AT_ONCE", "PAIRS_AT_ONCE"):
        monkeypatch.setattr(near_dup, k, 150)
    monkeypatch.setattr(near_dup, "PASSES", 3)
    found = chunks.split_overlaps(q, fam)
    before = shuffle_bytes(spark)
    got = found.groupBy(F.left("train_id", F.lit(4)) == "copy").count().collect()
    assert shuffle_bytes(spark) < before + 500_000
    assert dict(map(tuple, got)) == {True: 250_000, False: len(want)}
    pairs = [tuple(sorted((x["train_id"], x["eval_id"]))) for x in found.where("train_id not like 'copy%'").collect()]
    assert len(want) > 5 and sorted(pairs) == sorted(want)
