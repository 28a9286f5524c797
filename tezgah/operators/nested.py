"""Deeply nested semi-structured records as related flat tables (problem 2).

JSON texts are indexed as bytes, a whole Arrow batch at once: bitmaps of unescaped quotes, brackets and delimiters; strings by the
parity of the quotes before a byte; nesting depth by prefix sums over the brackets. From the positions of the structural bytes
alone follow each value's container, key, element number and span, level by level, and whether a text is complete JSON at all.
Texts stored as strings inside a text are indexed in the same way, in a further round, in the place of their string.

Whether a field that holds a single object is an array of one is known only when all records are seen: such places are marked in
the paths and resolved once the fields that hold arrays of objects anywhere are known.

Edge cases: null, blank and damaged texts give no rows. A text that is itself a JSON string of an object counts as that object. Repeated
records give each object once. Null record ids are kept as null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import ctypes
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tezgah.session import written

#: Marks, in a path, an object that stands alone in a field.
ALONE = "\x01"
#: Characters of keys that have a meaning in paths, and what stands for them until paths are final.
SPECIAL, STAND_IN = ".[]", ""
#: Fields resolved in one pass.
FIELDS = 10_000
_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
OBJ, ARR, END_OBJ, END_ARR, COLON, COMMA, STRING, SCALAR = range(1, 9)
_KIND = np.zeros(256, np.uint8)
for _c, _k in zip(b"{[}]:,", (OBJ, ARR, END_OBJ, END_ARR, COLON, COMMA)):
    _KIND[_c] = _k
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True


@dataclass
class Index:
    """Tokens of complete texts. Per token: text, kind, first byte, container (token, -1 at the top), key (token, -1 if none), element
    number (-1 if none); ``end``: of a container, its closing token, of a string, the byte of its closing quote."""

    data: bytes
    valid: np.ndarray
    text: np.ndarray
    kind: np.ndarray
    at: np.ndarray
    parent: np.ndarray
    key: np.ndarray
    element: np.ndarray
    end: np.ndarray
    depth: np.ndarray


def _escaped(b: np.ndarray) -> np.ndarray:
    """Positions of bytes with an odd run of backslashes before them."""
    p = np.flatnonzero(b == 92)
    if not len(p):
        return p
    first = np.concatenate([[True], np.diff(p) > 1])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(p)))
    after = p[starts] + sizes
    return after[(sizes % 2 == 1) & (after < len(b))]


def index(texts: list[bytes]) -> Index:
    n = len(texts)
    data = b"\n".join([*texts, b""])
    b = np.frombuffer(data, np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    bad = np.zeros(n, bool)
    of = lambda pos: np.searchsorted(begin, pos, side="right") - 1
    # quotes and strings
    quote = b == 34
    esc = _escaped(b)
    quote[esc] = False
    q = np.flatnonzero(quote)
    qt = of(q)
    before = np.searchsorted(q, begin)
    count = np.diff(np.append(before, len(q)))
    bad |= count % 2 == 1
    opening = (np.arange(len(q)) - before[qt]) % 2 == 0
    flip = np.zeros(len(b) + 1, np.int8)
    flip[q[opening]] = 1
    flip[q[~opening] + 1] -= 1
    ends = begin + size
    open_end = ends[count % 2 == 1]
    flip[open_end] -= 1
    inside = np.cumsum(flip[:-1], dtype=np.int8) > 0  # from the opening to the closing quote
    # escapes and control characters of strings
    if len(esc):
        wrong = ~_ESCAPE[b[esc]] | ~inside[esc]
        u = esc[b[esc] == 117]
        hexes = np.all([_HEX[b[np.minimum(u + k, len(b) - 1)]] for k in range(1, 5)], axis=0) if len(u) else np.zeros(0, bool)
        bad[of(esc[wrong])] = True
        bad[of(u[~hexes])] = True
    control = np.flatnonzero((b < 32) & inside)
    bad[of(control)] = True
    # tokens
    kind_at = _KIND[b]
    kind_at[inside] = 0
    word = ~inside & (kind_at == 0) & ~_BLANK[b]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    kind_at[starts] = SCALAR
    kind_at[q[opening]] = STRING
    at = np.flatnonzero(kind_at)
    kind = kind_at[at]
    text = of(at).astype(np.int32)
    close_q = np.full(len(at), -1, np.int64)
    own = q[~opening]
    strings = np.flatnonzero(kind == STRING)
    if len(own):
        k = np.minimum(np.searchsorted(own, at[strings] + 1), len(own) - 1)
        close_q[strings] = own[k]
    # depth
    up = (kind == OBJ) | (kind == ARR)
    down = (kind == END_OBJ) | (kind == END_ARR)
    total = np.cumsum(up.astype(np.int32) - down.astype(np.int32))
    first_tok = np.searchsorted(text, np.arange(n + 1))
    base = np.concatenate([[0], total])[first_tok[:-1]]
    after = total - base[text] if len(text) else total
    depth = np.where(up, after - 1, after + down) if len(text) else after  # level of the container a token stands in
    bad[text[after < 0]] = True
    tokens = np.diff(first_tok)
    bad |= tokens == 0
    some = tokens > 0
    bad[some] |= after[first_tok[1:][some] - 1] != 0
    top = np.bincount(text[(depth == 0)], minlength=n)
    bad |= top != 1
    # containers: the last one opened on the level above
    parent = np.full(len(at), -1, np.int64)
    ok = ~bad[text] if len(text) else np.zeros(0, bool)
    for level in range(1, int(depth[ok].max(initial=0)) + 1):
        opened = np.flatnonzero(up & ok & (after == level))
        here = np.flatnonzero(ok & (depth == level))
        if len(opened) and len(here):
            k = np.searchsorted(opened, here, side="right") - 1
            parent[here] = np.where(k >= 0, opened[k], -1)
    inner = depth > 0
    lost = inner & ((parent < 0) | (text[np.maximum(parent, 0)] != text))
    bad[text[lost & ok]] = True
    holder = np.where(parent >= 0, kind[np.maximum(parent, 0)], 0) if len(at) else kind
    bad[text[ok & (kind == END_OBJ) & (holder != OBJ)]] = True
    bad[text[ok & (kind == END_ARR) & (holder != ARR)]] = True
    # order of tokens
    prev = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
    if len(kind):
        prev[first_tok[:-1][some]] = 0
    value = up | (kind == STRING) | (kind == SCALAR)
    is_key = (kind == STRING) & (holder == OBJ) & ((prev == OBJ) | (prev == COMMA))
    p_key = np.concatenate([[False], is_key[:-1]]) if len(kind) else is_key
    p_value = np.isin(prev, (STRING, SCALAR, END_OBJ, END_ARR)) & ~p_key
    after_open = np.isin(prev, (OBJ, ARR))
    fine = np.ones(len(kind), bool)
    member = value & (holder == OBJ) & ~is_key
    fine[member] = prev[member] == COLON
    item = value & (holder == ARR)
    fine[item] = (prev[item] == ARR) | (prev[item] == COMMA)
    fine[kind == COLON] = p_key[kind == COLON] & (holder[kind == COLON] == OBJ)
    fine[kind == COMMA] = p_value[kind == COMMA]
    fine[down] = p_value[down] | (after_open[down] & (prev[down] + 2 == kind[down]))
    fine &= ~((kind != 0) & ~value & (depth == 0) & ~down)
    bad[text[~fine]] = True
    # literals
    sc = np.flatnonzero((kind == SCALAR) & ~bad[text]) if len(kind) else np.zeros(0, np.int64)
    if len(sc):
        stop = np.flatnonzero(~word)
        end = stop[np.searchsorted(stop, at[sc])]
        known: dict[bytes, bool] = {b"true": True, b"false": True, b"null": True}
        for t, s, e in zip(text[sc].tolist(), at[sc].tolist(), end.tolist()):
            x = data[s:e]
            good = known.get(x)
            if good is None:
                good = _NUMBER.fullmatch(x) is not None
                if len(known) < 100_000:
                    known[x] = good
            if not good:
                bad[t] = True
    good = ~bad[text] if len(text) else np.zeros(0, bool)
    key = np.full(len(at), -1, np.int64)
    m = np.flatnonzero(member & good)
    key[m] = m - 2
    element = np.full(len(at), -1, np.int64)
    i = np.flatnonzero(item & good)
    if len(i):
        order = np.argsort(parent[i], kind="stable")
        p = parent[i][order]
        new = np.concatenate([[True], p[1:] != p[:-1]])
        run = np.arange(len(p))
        element[i[order]] = run - np.maximum.accumulate(np.where(new, run, 0))
    end = close_q
    d = np.flatnonzero(down & good)
    end[parent[d]] = d
    return Index(data, ~bad, text, kind, at, parent, key, element, end, depth)


class _Names:
    """Keys as they stand in paths."""

    def __init__(self):
        self.known: dict[bytes, str] = {}

    def __call__(self, raw: bytes) -> str:
        s = self.known.get(raw)
        if s is None:
            s = json.loads(raw) if b"\\" in raw else raw[1:-1].decode()
            for a, z in zip(SPECIAL, STAND_IN):
                s = s.replace(a, z)
            s = s.replace(ALONE, "�")
            if len(self.known) < 100_000:
                self.known[raw] = s
        return s


def spans(texts: list[bytes | None], body: bool = False) -> tuple[list[int], list[str], list[bool], list[str]]:
    """Objects of complete texts: (text number, path with marks, is an element of an array, source text if asked for)."""
    rows, paths, elements, bodies = [], [], [], []
    names = _Names()
    work = [(k, t, "$", False) for k, t in enumerate(texts) if t and t.strip()]
    while work:
        ix = index([w[1] for w in work])
        up = ((ix.kind == OBJ) | (ix.kind == ARR)) & ix.valid[ix.text]
        first = ix.data
        looks = np.zeros(len(ix.kind), bool)
        s = np.flatnonzero((ix.kind == STRING) & ix.valid[ix.text])
        s = s[ix.end[s] - ix.at[s] > 2]
        b = np.frombuffer(ix.data, np.uint8)
        begins = b[ix.at[s] + 1]
        looks[s[np.isin(begins, list(b"{[ \t\\"))]] = True
        has_key = np.zeros(len(ix.kind), bool)
        has_key[np.maximum(ix.key[ix.key >= 0], 0)] = True
        looks &= ~has_key  # keys aren't values
        path: dict[int, str] = {}
        nxt = []
        todo = np.flatnonzero(up | looks)
        todo = todo[np.argsort(ix.depth[todo], kind="stable")]
        at, end, kind, parent, key, element, text = (x[todo].tolist() for x in (ix.at, ix.end, ix.kind, ix.parent, ix.key, ix.element, ix.text))
        kat, kend = ix.at, ix.end
        for t, a, e, k, p, ky, el, tx in zip(todo.tolist(), at, end, kind, parent, key, element, text):
            row, _, start, in_array = work[tx]
            if p < 0:
                here, is_el = start, in_array
            elif ky >= 0:
                here, is_el = f"{path[p]}.{names(first[kat[ky] : kend[ky] + 1])}", False
            else:
                here, is_el = f"{path[p]}[{el}]", True
            if k == STRING:
                try:
                    inner = json.loads(first[a : e + 1])
                except ValueError:
                    continue
                if inner.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
                    nxt.append((row, inner.encode("utf-8", "replace"), here, is_el))
                continue
            if k == OBJ:
                if not is_el and here != "$":
                    here += ALONE
                if here != "$":
                    rows.append(row)
                    paths.append(here)
                    elements.append(is_el)
                    if body:
                        bodies.append(first[a : int(ix.at[e]) + 1].decode())
            path[t] = here
        work = nxt
    return rows, paths, elements, bodies


def field(path: str) -> str:
    """The field a path leads to: names only."""
    return re.sub(r"\[\d+\]", "", path).replace(ALONE, "")


def _keep_memory() -> None:
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 30)
        libc.mallopt(-1, 1 << 29)
    except (OSError, AttributeError):
        pass


def _emit(src: str, body: bool):
    names = ["src", "record_id", "path", "element", "body"][: 5 if body else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("doc")), 0).to_numpy(zero_copy_only=False), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // 2_000_000)) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                part = batch.slice(a, z - a)
                rows, paths, elements, bodies = spans(part.column("doc").to_pylist(), body)
                ids = part.column("record_id").take(pa.array(rows, pa.int64()))
                cols = [pa.array([src] * len(rows), pa.string()), ids, pa.array(paths, pa.string()), pa.array(elements, pa.bool_()), pa.array(bodies, pa.string())]
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names=names)

    return run


def _resolver(fields: set[tuple[str, str]], final: bool):
    back = str.maketrans(STAND_IN, SPECIAL)

    def one(src: str, path: str) -> str:
        parts = path.split(ALONE)
        out = parts[0]
        for nxt in parts[1:]:
            out += ("[0]" if (src, field(out)) in fields else "" if final else ALONE) + nxt
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src = b.column("src").to_pylist()
            d = b.column("path").dictionary_encode()
            per: dict[tuple[str, int], tuple[str | None, str | None]] = {}
            plain = d.dictionary.to_pylist()
            node, up = [], []
            for s, k in zip(src, d.indices.to_pylist()):
                got = per.get((s, k))
                if got is None:
                    p = one(s, plain[k])
                    got = (p, None)
                    if final:
                        cut = p.rfind("].", 0, len(p))
                        got = (p.translate(back), p[: cut + 1].translate(back) if cut >= 0 else "$") if p.endswith("]") else (None, None)
                    per[s, k] = got
                node.append(got[0])
                up.append(got[1])
            rest = [c for c in b.schema.names if c not in ("path", "parent_path")]
            cols, names = [b.column(c) for c in rest] + [pa.array(node, pa.string())], [*rest, "path"]
            if final:
                cols, names = [*cols, pa.array(up, pa.string())], [*names, "parent_path"]
            t = pa.RecordBatch.from_arrays(cols, names=names)
            yield t.filter(pc.is_valid(t.column("path")))

    return run


def nested_objects(records: DataFrame, id_column: str, json_column: str, src: str, body: bool = False) -> DataFrame:
    """Each object that is an element of an array, at any depth, once: ``src, record_id, parent_path, node_path`` and, if asked for, its
    source text ``body`` (then objects of stale versions of a record that differ come out each)."""
    x = records.select(F.col(id_column).cast("string").alias("record_id"), F.encode(F.col(json_column).cast("string"), "utf-8").alias("doc")).where("doc is not null")
    schema = "src string, record_id string, path string, element boolean" + ", body string" * body
    rows = written(x.mapInArrow(_emit(src, body), schema), "nested")
    name = F.regexp_replace(F.regexp_replace("path", r"\[\d+\]", ""), ALONE, "")
    single = F.col("element") & F.col("path").rlike(r"[^\]]\[\d+\]$")
    kinds = rows.select("src", name.alias("f"), single.alias("many"), (~F.col("element")).alias("alone")).groupBy("src", "f").agg(F.max("many").alias("many"), F.max("alone").alias("alone"))
    both = kinds.where("many and alone").select("src", "f").orderBy("src", "f")
    out = rows
    block: set[tuple[str, str]] = set()
    ordered = "src string, record_id string, " + "element boolean, " + ("body string, " if body else "") + "path string"
    for r in both.toLocalIterator():  # names of fields, not data; any number, in blocks
        block.add((r["src"], r["f"]))
        if len(block) == FIELDS:
            out = out.mapInArrow(_resolver(block, False), ordered)
            block = set()
    out = out.mapInArrow(_resolver(block, True), ordered + ", parent_path string")
    return out.select("src", "record_id", "parent_path", F.col("path").alias("node_path"), *["body"] * body).distinct()


def kinds(objects: DataFrame) -> DataFrame:
    """The kind of each object, its field without element numbers, beside the other columns."""
    return objects.withColumn("kind", F.regexp_replace("node_path", r"\[\d+\]", "[]"))


def flat_table(objects: DataFrame, kind: str, schema: str) -> DataFrame:
    """The flat table of one kind: record, parent and own path, and the columns of ``schema`` parsed from ``body`` (see ``nested_objects``)."""
    return kinds(objects).where(F.col("kind") == kind).select("record_id", "parent_path", "node_path", F.from_json("body", schema).alias("o")).select("record_id", "parent_path", "node_path", "o.*")


def _fields(value, path: str):
    """Scalars of an object and of the plain objects and arrays in it; objects in arrays are rows of their own."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            inner = json.loads(value, parse_int=_Number, parse_float=_Number, object_pairs_hook=_Pairs)
        except ValueError:
            inner = None
        if isinstance(inner, (_Pairs, list)) and not isinstance(value, _Number):
            yield from _fields(inner, path)
            return
    if isinstance(value, _Pairs):
        for k, v in value.items:
            yield from _fields(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if not isinstance(v, _Pairs):
                yield from _fields(v, f"{path}[{i}]")
    elif value is None or isinstance(value, bool):
        yield path, None if value is None else str(value).lower(), "null" if value is None else "boolean"
    else:
        yield path, str(value), "number" if isinstance(value, _Number) else "string"


class _Number(str):
    """A number as it is written."""


class _Pairs:
    def __init__(self, items: list):
        self.items = items


def _field_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["src", "record_id", "parent_path", "node_path", "kind"]
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            b = batch.slice(at, 2000)
            row, out = [], []
            for i, body in enumerate(b.column("body").to_pylist()):
                x = json.loads(body, parse_int=_Number, parse_float=_Number, object_pairs_hook=_Pairs, strict=False)
                if isinstance(x, str) and not isinstance(x, _Number):
                    x = json.loads(x, parse_int=_Number, parse_float=_Number, object_pairs_hook=_Pairs, strict=False)
                for f in _fields(x, ""):
                    row.append(i)
                    out.append(f)
            cols = list(zip(*out)) if out else [[], [], []]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(take) for k in keys] + [pa.array(list(c), pa.string()) for c in cols], names=[*keys, "field", "value", "type"])


def flat_fields(objects: DataFrame) -> DataFrame:
    """The flat tables of all kinds, one row per scalar field: record, parent and own path, kind, the field's path in the object, its value
    as text (null for null) and its type. ``objects``: with ``body`` (see ``nested_objects``)."""
    o = written(kinds(objects), "kinds")
    names = "src string, record_id string, parent_path string, node_path string, kind string, field string, value string, type string"
    rows = o.select("src", "record_id", "parent_path", "node_path", "kind", "body").mapInArrow(_field_rows, names)
    # a single object where other records hold an array is a row of its own
    below = o.select(F.col("src").alias("s"), F.col("kind").alias("k")).distinct()
    at = F.concat("kind", F.lit("."), F.regexp_replace("field", r"\[\d+\]", "[]"))
    inner = (F.col("src") == F.col("s")) & F.col("k").startswith(F.concat("kind", F.lit("."))) & at.startswith(F.concat(F.regexp_replace("k", r"\[\]$", ""), F.lit(".")))
    return rows.join(F.broadcast(below), inner, "left_anti")
