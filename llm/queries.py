"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, near_dedup, nearest, packing, repair, secrets, toxicity, url_filter, warc
from .license_texts import TEMPLATES
from .tokens import word_bpe_path

# The URL rules of op2.
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, [url_filter.host_rule(*r) for r in URL_RULES]).select("page_id", "host", "path", "rule", "verdict")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_ids(_table(spark, sf_dir, "documents"), word_bpe_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_bpe_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed patterns of op10 find, without the model's spans."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_url_filter, op3_token_ids, op4_decontaminate, op5_near_dedup, op6_nearest, op7_warc, op8_packing, op9_toxicity, op10_secrets, base_secrets)
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_QUOTED = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))

SQL_LICENSE = f"""
with template as (select name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from (select name, {_WORDS.format('body')} w from (values {_QUOTED}) t(name, body))),
piece as (select distinct doc_id, w from (
    select doc_id, {_WORDS.format('part')} w, kind, place from (
        select doc_id, 0 kind, 0 place, coalesce(text, '') part from documents
        union all select doc_id, 1, unnest(range(len(s))), unnest(s) from (select doc_id, string_split(text, chr(10) || chr(10)) s from documents)
        union all select doc_id, 2, unnest(range(len(s))), unnest(s) from (select doc_id, string_split(text, chr(10)) s from documents)))
    where len(w) > 1),
bag as (select doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from piece),
hit as (select doc_id, b.g, name, 2 * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) as dice from bag b join template t on len(b.g) <= len(t.g) * 3 and len(t.g) <= len(b.g) * 3),
good as (select * from hit where dice >= {license_scan.MIN_DICE}),
best as (select doc_id, first(name order by dice desc, name) as license, max(dice) dice, string_agg(distinct name, ',' order by name) licenses from good group by doc_id)
select d.doc_id, license, dice, coalesce(licenses, '') licenses from documents d left join best using (doc_id)"""

_RULES = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)
SQL_URL = f"""
with cut as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
fit as (select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule) desc) rn
    from split join (values {_RULES}) r(rule, verdict) on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1))) and starts_with(path, substr(rule, position('/' in rule))))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from split left join (select * from fit where rn = 1) using (page_id)"""

SQL_DECONTAMINATE = f"""
with doc as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
item as (select item_id, {_WORDS.format("coalesce(text, '')")} w from benchmark),
win as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i : i + least(len(w), 10) - 1])) g from item where len(w) > 0),
size as (select distinct len(g) n from win),
place as (select doc_id, n, unnest(range(1, len(w) - n + 2)) p from doc join size on len(w) >= n),
gram as (select doc_id, n, p, w[p : p + n - 1] g from place join doc using (doc_id)),
hit as (select doc_id, n, p, item_id from gram join win using (g)),
words as (select doc_id, count(distinct q) n_hit from (select distinct doc_id, unnest(range(p, p + n)) q from (select distinct doc_id, n, p from hit)) group by doc_id),
items as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hit group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join words using (doc_id) left join items using (doc_id)"""

SQL_NEAR = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end g from w),
e as (select doc_id, len(g) n, unnest(g) x from s),
pair as (select a.doc_id a, b.doc_id b from e a join e b using (x) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(id, other) as (select doc_id, doc_id from s union select r.id, p.b from reach r join pair p on r.other = p.a)
select doc_id, len(g)::bigint n_shingles, m component_id, doc_id = m kept from s join (select id, min(other) m from reach group by id) on doc_id = id"""

SQL_NEAREST = """
with v as (select vec_id, embedding::double[] e from embeddings where embedding is not null),
u as (select vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, x: s + x)) n from v),
ok as (select * from u where n > 0 and isfinite(n)),
p as (select q.vec_id query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda s, x: s + x) / (q.n * c.n) score from ok q join ok c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from p)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5"""


SQL_WARC = """
with d as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) x from pages),
g as (select *, max(page_id) over (partition by x) last, list_transform(range(0, 8), lambda i: ('0x' || substr(x, i * 5 + 1, 5))::integer) parts from d),
-- five hexadecimal digits are four of base 32
e as (select *, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), '')), '') payload_digest from g)
select page_id, payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to from e"""


def _spans(kind: str, at: int, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, {at} as place, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'token': length(h[i]), 'size': length(w[i]),
        'e': list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(w[1:i], lambda x: length(x)))}})) m
        from (select doc_id, regexp_extract_all(t, '{quoted}', 0) w, regexp_extract_all(t, '{quoted}', {group}) h, string_split_regex(t, '{quoted}') g from (select doc_id, coalesce(text, '') t from documents) where regexp_matches(t, '{quoted}'))
        where len(w) > 0"""


SQL_SECRETS = f"""
with s as (select doc_id, kind, place, (m.e - m.size)::bigint b, m.e::bigint e, m.token from (
    {_spans("assign", 0, secrets.ASSIGN, 2)} union all {_spans("access", 1, secrets.ACCESS, 0)} union all {_spans("hex", 2, secrets.HEX, 0)})),
k as (select * from s where token >= case kind when 'assign' then 8 when 'access' then 16 else 32 end),
c as (select doc_id, count(*) filter (kind = 'assign') a, count(*) filter (kind = 'access') x, count(*) filter (kind = 'hex') h, string_agg(kind || ':' || b || ':' || e, ',' order by b, place) l from k group by doc_id)
select doc_id, coalesce(a, 0) n_assign, coalesce(x, 0) n_access, coalesce(h, 0) n_hex, sha256(coalesce(l, '')) base_sha256 from documents left join c using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": SQL_LICENSE,
        "op2_url_filter": SQL_URL,
        "op4_decontaminate": SQL_DECONTAMINATE,
        "op5_near_dedup": SQL_NEAR,
        "op6_nearest": SQL_NEAREST,
        "op7_warc": SQL_WARC,
        "base_secrets": SQL_SECRETS,
    }
