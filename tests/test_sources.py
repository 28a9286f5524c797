import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tezgah.sources import files
from tezgah.streaming import events

ITEM = "query_id string, query string, candidates array<struct<id string, role string, text string, relevance int>>"
ITEMS = [{"query_id": "q1", "query": "soru", "candidates": [{"id": "a", "role": "positive", "text": "iyi", "relevance": 1}, {"id": "b", "role": "hard", "text": "zor", "relevance": 0}, {"id": "c", "role": "easy", "text": "kolay", "relevance": 0}]}]


def test_items_and_lines(spark, tmp_path):
    for name, text in (("bare.json", json.dumps(ITEMS)), ("box.json", json.dumps({"items": ITEMS})), ("l.jsonl", json.dumps(ITEMS[0]) + "\n\n")):
        (tmp_path / name).write_text(text)
        assert files.read_flexible(spark, str(tmp_path / name), ITEM).select("query_id", F.size("candidates")).collect() == [("q1", 3)]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), ITEM).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"query_id": ')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), ITEM).collect()


def test_beir_round_trip(spark, tmp_path):
    f = spark.createDataFrame([json.loads(json.dumps(x)) for x in ITEMS], ITEM)
    for gold_only, n in ((False, 3), (True, 1)):
        out = f"{tmp_path}/beir{n}"
        files.write_beir(f, out, gold_only)
        corpus, queries, qrels = files.read_beir(spark, out)
        assert (corpus.count(), queries.count(), qrels.count()) == (3, 1, n)
        assert files.check_binary(qrels).count() == (1 if gold_only else 0)
        assert files.read_beir(spark, out, most=2)[0].count() == max(2, n)
    assert files.grouped_view(f, {"easy": 0, "hard": 4}).select("positive", "negatives", "difficulty_rank").first() == ("iyi", ["kolay", "zor"], [0, 4])
    assert files.paired_view(f).count() == 2


def test_config_versions_manifest(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": ["${X:-y}", {"b": "${Z:-}"}], "n": 1}')
    assert files.read_config(str(tmp_path / "c.json"), {"Z": "z"}) == {"a": ["y", {"b": "z"}], "n": 1}
    for v in ("m_v2.json", "m_v10.json", "m_v2.1.json"):
        (tmp_path / v).write_text("")
    assert files.newest(f"{tmp_path}/m_v*.json").endswith("m_v10.json")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("veri")
    assert [tuple(r) for r in files.manifest(spark, f"{tmp_path}/d").collect()] == [("x.txt", 4, hashlib.sha256(b"veri").hexdigest())]
    files.append_jsonl(spark.range(2), f"{tmp_path}/log")
    files.append_jsonl(spark.range(1), f"{tmp_path}/log")
    assert files.read_jsonl(spark, f"{tmp_path}/log", "id bigint").count() == 3


def test_decisions_env_and_config(spark, tmp_path):
    rows = [{"slot_id": "s", "ok": True}]
    for name, text in (("a.json", json.dumps(rows)), ("b.json", json.dumps({"decisions": rows})), ("c.jsonl", json.dumps(rows[0]))):
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in files.read_decisions(spark, str(tmp_path / name), "slot_id string, ok boolean").collect()] == [("s", True)]
    (tmp_path / ".env").write_text("# x\nA='one'\nB=two \nC=\nnot a line\n")
    assert files.read_env(str(tmp_path / ".env")) == {"A": "one", "B": "two"} and files.read_env(str(tmp_path / "no")) == {}
    (tmp_path / "c.json").write_text('{"a": "${A}", "b": "${B:-x}", "c": "${NONE}", "d": "at ${A}"}')
    assert files.read_config(str(tmp_path / "c.json"), {"B": "own"}, str(tmp_path / ".env")) == {"a": "one", "b": "own", "c": "${NONE}", "d": "at ${A}"}
    with pytest.raises(ValueError):
        files.read_config(str(tmp_path / "c.json"), {}, required=True)


def test_parquet_datasets(spark, tmp_path):
    c = spark.createDataFrame([(f"d{9 - i}", "başlık" if i else None, f"metin {i}") for i in range(10)], "id string, title string, text string")
    q = spark.createDataFrame([("q1", "soru"), ("q2", "yargısız")], "_id string, text string")
    r = spark.createDataFrame([("q1", "d3", 1)], "`query-id` string, `corpus-id` string, score int")
    for k, root in enumerate(("own", "data", "any")):
        at = lambda name: f"{tmp_path}/{root}/" + {"own": f"{name}/test", "data": f"data/{name}-test", "any": f"x/{name}/y"}[root]  # noqa: B023, E731
        c.coalesce(1).write.parquet(at("corpus"))
        q.write.parquet(at("queries"))
        r.write.parquet(at("qrels"))
        corpus, queries, qrels = files.read_beir_parquet(spark, f"{tmp_path}/{root}")
        assert (corpus.count(), queries.count(), qrels.count()) == (10, 1, 1) and corpus.where("_id = 'd8'").first()["text"] == "başlık metin 1"
        capped = {x["_id"] for x in files.read_beir_parquet(spark, f"{tmp_path}/{root}", most=3)[0].collect()}
        assert capped == {"d3", "d9", "d8"}  # gold, then in the order of the file
    assert files.find_parquet(spark, f"{tmp_path}/none", "corpus") == []
    with pytest.raises(FileNotFoundError):
        files.read_beir_parquet(spark, f"{tmp_path}/none")


def test_sinks(spark, tmp_path):
    log, box = f"{tmp_path}/ordered", f"{tmp_path}/box"
    for part in ([3, 1, 2], [5, 4]):
        files.append_jsonl(spark.createDataFrame([(x,) for x in part], "n int"), log, "n")
    assert [r["n"] for r in files.read_jsonl(spark, log, "n int, seq bigint").orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    for n in (3, 2):
        files.write_atomic(spark.range(n), box)
        assert files.read_jsonl(spark, box, "id bigint").count() == n
    f = spark.createDataFrame(ITEMS, ITEM)
    none = spark.createDataFrame([], "code string")
    with pytest.raises(ValueError):
        files.freeze(f, spark.createDataFrame([("x",)], "code string"), f"{tmp_path}/frozen")
    assert {p.split("/")[0] for p in (r["path"] for r in files.freeze(f, none, f"{tmp_path}/release").collect())} == {"blind", "internal"}
    assert "role" not in spark.read.json(f"{tmp_path}/release/blind").select(F.explode("candidates")).select("col.*").columns


def test_streams(spark, tmp_path):
    rows = [(1, "a", "planned", None, None, 10), (1, "a", "planned", None, None, 10), (2, "a", "reserved", None, None, 20), (3, None, "x", None, None, 5), (4, "b", "accepted", None, None, 90_000)]
    e = spark.createDataFrame(rows, "event_id bigint, slot_id string, event_type string, actor string, payload_json string, t int").withColumn("created_at", F.timestamp_seconds("t")).drop("t")
    for k in range(3):  # one file a batch
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    s = events.event_stream(spark, f"{tmp_path}/e", files=1)
    got = events.drain(events.windowed_counts(s))
    assert sorted((r["event_type"], r["n"]) for r in got.collect()) == [("accepted", 1), ("planned", 1), ("reserved", 1), ("x", 1)]
    st = events.stream_state(events.event_stream(spark, f"{tmp_path}/e", files=1), f"{tmp_path}/state")
    assert sorted((r["slot_id"], r["event_type"]) for r in st.collect()) == [("a", "reserved"), ("b", "accepted")]
    again = events.stream_state(events.event_stream(spark, f"{tmp_path}/e", files=1), f"{tmp_path}/state")
    assert again.count() == 2  # nothing new: the table stays
