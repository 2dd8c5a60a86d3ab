"""Queries on the operators of this subpackage, with the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_token_planes, op2_quality, op3_bpe, op4_pivots, op5_substrings, op6_language, op7_minhash, op8_secrets, op9_caps, op10_mixing, op11_audit, op12_runs, op13_packing

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_planes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_token_planes.token_planes(spark, table(spark, sf_dir, "documents"), WORD_BPE)


def op2_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_bpe.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_pivots_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pivots.nearest(table(spark, sf_dir, "embeddings"))


def op5_substrings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_substrings.digests(table(spark, sf_dir, "documents"))


def op6_language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and web pages; a page's doc_id is -1 - page_id, so that the two are kept apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = op6_language.page_documents(table(spark, sf_dir, "pages"))
    return op6_language.identify(docs.unionByName(pages.withColumn("doc_id", -1 - F.col("doc_id")))).drop("th")


def op7_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secrets.scan(table(spark, sf_dir, "documents"))


def op9_caps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op10_mixing.schedule(docs, op10_mixing.source_shares(docs))


def op11_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_runs.find_runs(table(spark, sf_dir, "documents"))


def op13_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_planes": op1_token_planes_query,
        "op2_quality": op2_quality_query,
        "op3_bpe": op3_bpe_query,
        "op4_pivots": op4_pivots_query,
        "op5_substrings": op5_substrings_query,
        "op6_language": op6_language_query,
        "op7_minhash": op7_minhash_query,
        "op8_secrets": op8_secrets_query,
        "op9_caps": op9_caps_query,
        "op10_mixing": op10_mixing_query,
        "op11_audit": op11_audit_query,
        "op12_runs": op12_runs_query,
        "op13_packing": op13_packing_query,
    }


OP4_SQL = """
with v as (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.r as q_row, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v c on q.r <> c.r and len(q.v) = len(c.v)
    where q.vec_id % 100 = 0
), ranked as (
    select *, row_number() over (partition by q_row order by score desc, vec_id) as r from scored
)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 10
"""


OP5_SQL = """
with d as (
    select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), w as (
    select r, i, md5_number(substr(h, 2 * i + 1, 400)) as m
    from (select r, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) as i from d)
), t as (
    select r, i from (select r, i, count(*) over (partition by m) as n from w) where n > 1
), f as (
    select r, i, case when i <= lag(i) over (partition by r order by i) + 200 then 0 else 1 end as fresh from t
), s as (
    select r, i, sum(fresh) over (partition by r order by i rows unbounded preceding) as run from f
), runs as (
    select r, min(i) as a, max(i) + 200 as b from s group by r, run
), pieces as (
    select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as low from runs
), cut as (
    select d.r, sum(b - a) as removed, count(*) as spans, string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept
    from pieces join d on d.r = pieces.r group by d.r
)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut on cut.r = d.r
"""

#: Words are joined by blanks, which no word has, so equal texts of shingles are equal shingles.
OP7_SQL = """
with recursive d as (
    select row_number() over () as r, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
    from documents
), s as (
    select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as sh
    from d
), e as (
    select r, unnest(list_transform(sh, lambda x: md5_number(x))) as x from s
), c as (
    select a.r as a, b.r as b, count(*) as n from e a join e b on a.x = b.x and a.r <> b.r group by all
), l as (
    select c.a, c.b from c join s x on x.r = c.a join s y on y.r = c.b where 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)
), reach(r, top) as (
    select r, r from s union select reach.r, l.b from reach join l on l.a = reach.top
), named as (
    select reach.r, min(t.doc_id) as component_id from reach join s t on t.r = reach.top group by reach.r
)
select doc_id, len(sh) as n_shingles, component_id, coalesce(doc_id = component_id, component_id is null) as kept from s join named on named.r = s.r
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "(?:" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: CRC-32 of the 30 letters after the prefix (place p of the token), as six base-62 digits.
_CRC = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(range({p}, {p} + 30), lambda i: ascii(x[i])::bigint)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(0, 8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295)"
_DIGITS = "array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda q: '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'[(" + _CRC + " // q) % 62 + 1]), '')"


def _kind(name: str, pattern: str, good: str, group: int = 0) -> str:
    """Matches of a pattern with their places: each begins after the pieces between matches and the matches before it."""
    return f"""select r, '{name}' as kind, k, list_sum(list_transform(g[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) as a, m[k] as x
    from (select r, m, g, unnest(range(1, len(m) + 1)) as k, v from (select r, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as v, string_split_regex(text, '{pattern}') as g from d)) where {good}"""


OP8_SQL = f"""
with d as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), found as (
    {_kind("assign", _ASSIGN, "length(v[k]) >= 8", 1)}
    union all {_kind("access", "AKIA[A-Z0-9]+", "length(m[k]) >= 16")}
    union all {_kind("hex", "[0-9a-f]+", "length(m[k]) >= 32")}
    union all select * from ({_kind("github", "gh[pousr]_[A-Za-z0-9]+", "length(m[k]) = 40")}) where x[35:] = {_DIGITS.format(p=5)}
    union all select * from ({_kind("npm", "npm_[A-Za-z0-9]+", "length(m[k]) = 40")}) where x[35:] = {_DIGITS.format(p=5)}
), spans as (
    select r, kind, list_position(['assign', 'access', 'hex', 'github', 'npm'], kind) as nth, cast(a as bigint) as a, kind || ':' || cast(a as bigint) || ':' || cast(a + length(x) as bigint) as shown from found
), told as (
    select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, count(*) filter (nth > 3) as n_checked,
        string_agg(shown, ',' order by a, nth) filter (nth <= 3) as base, string_agg(shown, ',' order by a, nth) as spans from spans group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_checked, 0) as n_checked, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told on told.r = d.r
"""

OP9_SQL = """
with recursive v as (
    select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings
), u as (
    select *, sqrt(list_dot_product(x, x)) as size from v
    where label is not null and x is not null and len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0
), l as (
    select a.r as a, b.r as b from u a join u b on a.label = b.label and a.r <> b.r and len(a.x) = len(b.x)
    where a.size > 0 and b.size > 0 and list_dot_product(a.x, b.x) / a.size / b.size >= 0.98
), reach(r, top) as (
    select r, r from v union select reach.r, l.b from reach join l on l.a = reach.top
), named as (
    select reach.r, min(t.vec_id) as component_id from reach join v t on t.r = reach.top group by reach.r
), n as (
    select a, count(*) as n_links from l group by a
)
select vec_id, coalesce(n_links, 0) as n_links, component_id, coalesce(vec_id = component_id, component_id is null) as kept from v join named on named.r = v.r left join n on n.a = v.r
"""


OP11_SQL = """
with d as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
    from documents
), f as (
    select doc_id, part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) as c,
        regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e
    from d
), told as (
    select part, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end, case when d then 'D' else '' end, case when e then 'E' else '' end) as fails,
        count(*) as n, count(*) filter (g.doc_id is not null) as good, count(*) filter (t.doc_id is not null) as toxic
    from f left join (select distinct doc_id from labels where quality = 1) g on g.doc_id = f.doc_id left join (select distinct doc_id from labels where toxic = 1) t on t.doc_id = f.doc_id
    group by all
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select v.x || w.x || p.x || q.x || r.x as filter_order from letters v, letters w, letters p, letters q, letters r
    where len(list_distinct([v.x, w.x, p.x, q.x, r.x])) = 5
), steps as (
    select filter_order, cast(step as integer) as step, filter_order[step] as letter, filter_order[1 : step - 1] as earlier from orders, range(1, 6) s(step)
), met as (
    select part, filter_order, step, letter, n, good, toxic, contains(fails, letter) as failing, regexp_matches(fails, '[' || earlier || '-]') as gone, fails = letter as alone from told, steps
), sums as (
    select part, filter_order, step, letter, sum(n) filter (not failing and not gone) as kept, sum(n) filter (failing and not gone) as removed, sum(n) filter (failing and gone) as redundant,
        sum(n) filter (alone) as unique_fails, sum(good) filter (failing and not gone) as good_lost, sum(toxic) filter (failing and not gone) as toxic_lost
    from met group by all
)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, letter), 0)::bigint as shapley
from sums
"""


def oracle_sql() -> dict[str, str]:
    """The others have none: tokens, training and schedules are no SQL, and are held to brute force in the tests."""
    return {"op4_pivots": OP4_SQL, "op5_substrings": OP5_SQL, "op7_minhash": OP7_SQL, "op8_secrets": OP8_SQL, "op9_caps": OP9_SQL, "op11_audit": OP11_SQL}
