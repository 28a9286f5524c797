import collections
import json
import random

import pytest

from tezgah.operators import nested

GOOD = ['{}', '[]', '1', '"a"', 'true', 'null', '-0.5e+3', '{"a":1,"b":[1,2,{"c":"x\\"y"}]}', ' [ 1 , {"k" : [ ] } ] ', '{"a":"\\u00e9\\n\\\\"}', '"{\\"a\\":[{}]}"', '[[{}],[{},{"a":[{"b":1}]}]]', '{"a":{"b":{}}}']
BAD = ['{', '}', '{"a"}', '{"a":}', '{"a":1,}', '[1,]', '[,1]', '[1 2]', '{"a" "b"}', '{1:2}', 'nul', '01', '1.', '"a', '{"a":"b}', '["a\nb"]', '{"a":1}}', '{"a":1}{', '[1]]', '{"a":[1}', '{]', "'a'", '{"a":1:2}', '{"a":"\\x"}', '{"a":"\\u12g4"}', '{"a":tru}', '[1] 2', '{,}', '{"a":1 "b":2}', '{"a":[}', 'NaN', ':', '{"a"::1}', '[:]', '["a":1]', '{"a",1}', '"\\"', '{"a":"\\\\""}']


def test_complete_texts():
    ix = nested.index([t.encode() for t in GOOD + BAD])
    assert ix.valid.tolist() == [True] * len(GOOD) + [False] * len(BAD)


def test_damaged_texts_agree_with_a_parser():
    r = random.Random(5)
    text = json.dumps({"a": [{"b": "x\"y\\", "c": [1, -2.5, None]}, {"d": {"e": ["ğ", " "]}}], "k": '[{"z":1}]'}, ensure_ascii=False)
    made = []
    for _ in range(3000):
        t = list(text)
        for _ in range(r.randint(1, 3)):
            i = r.randrange(len(t))
            t[i] = r.choice(["", '"', "\\", "{", "}", "[", "]", ",", ":", "1", " ", "a", t[i] * 2])
        made.append("".join(t))

    def complete(t):
        try:
            json.loads(t, parse_constant=lambda c: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    got = nested.index([t.encode() for t in made]).valid.tolist()
    assert [t for t, g in zip(made, got) if g != complete(t)] == []


def brute(texts):
    def opened(v):
        if isinstance(v, str) and v.lstrip()[:1] in ("{", "[", '"'):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            w = opened(w) if isinstance(w, str) else w
            return w if isinstance(w, (dict, list)) else v
        return v

    fields, docs, out = set(), [], set()

    def scan(v, f):
        v = opened(v)
        if isinstance(v, dict):
            for k, x in v.items():
                scan(x, f"{f}.{k}")
        elif isinstance(v, list):
            for x in map(opened, v):
                if isinstance(x, dict):
                    fields.add(f)
                scan(x, f)

    def walk(r, v, path, f, parent, element):
        v = opened(v)
        if isinstance(v, dict):
            if not element and path != "$" and f in fields:
                path, element = path + "[0]", True
            if element:
                out.add((r, parent, path))
                parent = path
            for k, x in v.items():
                walk(r, x, f"{path}.{k}", f"{f}.{k}", parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(r, x, f"{path}[{i}]", f, parent, True)

    for r, t in texts:
        try:
            docs.append((r, json.loads(t)))
        except (ValueError, TypeError):
            continue
        scan(docs[-1][1], "$")
    for r, v in docs:
        walk(r, v, "$", "$", "$", False)
    return out


ROWS = [
    ("r1", '{"a":[{"b":[{"c":1},{"c":2}]},{"b":{"c":3}}],"x":{"y":1}}'), ("r2", '{"a":{"b":[{"c":1}]}}'), ("r3", '{"a":"[{\\"b\\":[]}]"}'), ("r4", '"{\\"a\\":[{}]}"'), ("r5", "[]"), ("r6", '{"a":[{'), ("r7", None), ("r8", ""),
    ("r1", '{"a":[{"b":[{"c":1},{"c":2}]},{"b":{"c":3}}],"x":{"y":1}}'), ("r9", '[{"q":[[{"z":1}],{"w":[{}]}]}]'), ("r10", '{"a":["{\\"b\\":[{}]}", 5, "[plain", {"b":null}]}'), ("r11", '{"k.e[y]":[{"m":[{}]}]}'), ("r12", '{"ğ\\u00fc":[{"n":{"a":[{}]}}]}'),
]


@pytest.mark.parametrize("block", [1, 10_000])
def test_objects_with_their_parents(spark, monkeypatch, block):
    monkeypatch.setattr(nested, "FIELDS", block)
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "id string, doc string, src string, path int")
    got = {(r["record_id"], r["parent_path"], r["node_path"]) for r in nested.nested_objects(df, "id", "doc", "t").collect()}
    assert got == brute(ROWS)


def test_bodies_and_flat_table(spark):
    df = spark.createDataFrame([("r", '{"a":[{"n":1,"s":"x"},{"n":2}]}'), ("r", '{"a":[{"n":1,"s":"x"},{"n":2}]}')], "id string, doc string")
    o = nested.nested_objects(df, "id", "doc", "t", body=True)
    assert sorted(tuple(r) for r in nested.flat_table(o, "$.a[]", "n int, s string").collect()) == [("r", "$", "$.a[0]", 1, "x"), ("r", "$", "$.a[1]", 2, None)]
    assert nested.nested_objects(df.limit(0), "id", "doc", "t").count() == 0


def test_deep_and_long(spark):
    deep = "{\"a\":[" * 60 + "{}" + "]}" * 60
    long = json.dumps({"a": [{"t": "x" * 200_000}] * 3})
    df = spark.createDataFrame([("d", deep), ("l", long)], "id string, doc string")
    n = collections.Counter(r["record_id"] for r in nested.nested_objects(df, "id", "doc", "t").collect())
    assert n == {"d": 60, "l": 3}


def test_flat_fields_of_all_kinds(spark):
    from tezgah.operators import nested

    rows = [("r1", '{"a":[{"x":1.50,"y":"[k","o":{"z":true},"b":[{"v":null}]},{"x":2,"b":{"v":"t"}}]}'), ("r2", '{"c":[{"t":["p","q"]}]}'), ("r3", "{")]
    o = nested.nested_objects(spark.createDataFrame(rows, "id string, j string"), "id", "j", "s", True)
    got = {(r["record_id"], r["node_path"], r["kind"], r["field"], r["value"], r["type"]) for r in nested.flat_fields(o).collect()}
    a0, a1 = "$.a[0]", "$.a[1]"
    assert got == {
        ("r1", a0, "$.a[]", "x", "1.50", "number"), ("r1", a0, "$.a[]", "y", "[k", "string"), ("r1", a0, "$.a[]", "o.z", "true", "boolean"), ("r1", a0 + ".b[0]", "$.a[].b[]", "v", None, "null"),
        ("r1", a1, "$.a[]", "x", "2", "number"), ("r1", a1 + ".b[0]", "$.a[].b[]", "v", "t", "string"), ("r2", "$.c[0]", "$.c[]", "t[0]", "p", "string"), ("r2", "$.c[0]", "$.c[]", "t[1]", "q", "string"),
    }
