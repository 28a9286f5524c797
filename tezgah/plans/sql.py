"""Fragments of SQL for the oracles, in the dialect of DuckDB. They are written apart from the Spark expressions."""

from __future__ import annotations

from tezgah.functions.text import STOPWORDS_STRICT, STOPWORDS_WIDE


def low(x: str) -> str:
    return f"lower(translate(coalesce({x}, ''), 'İI', 'iı'))"


def tok(x: str) -> str:
    return f"regexp_extract_all({low(x)}, '[a-zçğıöşü0-9]+')"


def wide(x: str) -> str:
    return f"regexp_extract_all({low(x)}, '[0-9A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîû]+')"


def norm(x: str) -> str:
    return f"array_to_string({tok(x)}, ' ')"


def grams(s: str) -> str:
    """Distinct three-letter grams of the string expression ``s``."""
    return f"(case when length({s}) >= 3 then list_distinct(list_transform(range(1, length({s}) - 1), lambda i: substring({s}, i, 3))) else [] end)"


def padded(x: str) -> str:
    return f"(' ' || regexp_replace(trim({low(x)}), '\\s+', ' ', 'g') || ' ')"


def jac(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / greatest(1, len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


def over(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / greatest(1, len(list_distinct({a}))))"


def pre(t: str, k: int = 5) -> str:
    return f"list_distinct(list_transform({t}, lambda w: left(w, {k})))"


def words(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def content_prefixes(x: str) -> str:
    t, main = tok(x), f"list_filter({tok(x)}, lambda w: length(w) >= 4 and not list_contains({words(STOPWORDS_STRICT)}, w))"
    return f"(case when len({main}) > 0 then {pre(main)} else {pre(f'list_filter({t}, lambda w: length(w) >= 3)')} end)"


def content_words(x: str) -> str:
    return f"list_filter({wide(x)}, lambda w: length(w) > 1 and not regexp_full_match(w, '[0-9]+') and not list_contains({words(STOPWORDS_WIDE)}, w))"


#: One row per query id and per family id.
Q = "(select _id, max(text) as text from queries where _id is not null group by _id)"
_FAM = ["template_id", "critical_lemma", "split_name", "domain", "target_feature", "source_dataset", "semantic_frame_id", "generator_id"]
FAM = f"(select family_id, {', '.join(_FAM)} from (select *, row_number() over (partition by family_id order by coalesce(created_at, timestamp '1900-01-01') desc, {', '.join(f"encode(coalesce({c}, '')) desc, {c} desc nulls last" for c in _FAM)}) as version from families where family_id is not null) where version = 1)"
SPLIT = "case regexp_replace(lower(trim(split_name)), '[\\s\\-]+', '_', 'g') when 'train' then 'train' when 'development' then 'development' when 'dev' then 'development' when 'sealed_test' then 'sealed_test' when 'test' then 'sealed_test' end"
#: Closed pools: queries of a template; its least id asks, the others are candidates, of which the least id is gold.
POOLS = f"""
pooled as (select f.template_id as pool, q._id as cid, q.text, f.critical_lemma as lemma from {Q} q join {FAM} f on f.family_id = q._id where trim(f.template_id) <> '' and q.text is not null),
asked as (select pool, min(cid) as qid from pooled group by pool having count(*) > 1),
cand as (select p.pool, p.cid, a.qid, q.text as query, p.text, q.lemma as query_lemma, p.lemma from asked a join pooled q on q.pool = a.pool and q.cid = a.qid join pooled p on p.pool = a.pool and p.cid <> a.qid),
golds as (select pool, min(cid) as gold from cand group by pool)"""
SCORED = f"""
toks as (select pool, cid, {tok('text')} as t, {tok('query')} as q from cand),
flat as (select pool, cid, len(t) as len, unnest(t) as term from toks),
tf as (select pool, cid, len, term, count(*) as f from flat group by all),
per as (select pool, count(*) as n, avg(len(t)) as av from toks group by pool),
df as (select pool, term, count(*) as df from tf group by all),
qt as (select pool, term, count(*) as times from (select pool, unnest(q) as term from (select pool, any_value(q) as q from toks group by pool)) group by all),
bm as (select pool, cid, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / greatest(1.0, av)))) as s from tf join qt using (pool, term) join df using (pool, term) join per using (pool) group by pool, cid),
scored as (
  select pool, cid, 'longest' as scorer, length(text)::double as score from cand union all
  select pool, cid, 'most_tokens', len({tok('text')})::double from cand union all
  select pool, cid, 'char_3gram', round({jac(grams(norm('query')), grams(norm('text')))}, 9) from cand union all
  select pool, cid, 'word_overlap', round({over(tok('query'), tok('text'))}, 9) from cand union all
  select pool, cid, 'prefix5', round({over(pre(tok('query')), pre(tok('text')))}, 9) from cand union all
  select c.pool, c.cid, 'bm25', round(coalesce(s, 0), 6) from cand c left join bm using (pool, cid))"""
