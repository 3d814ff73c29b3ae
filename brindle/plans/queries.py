"""The engine's own queries over the test tables, and their SQL. Times are literals, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, similarity, tags, text, urls
from ..functions.values import FRAMINGS, STOPWORDS, TOPICS
from ..operators import aggregates, cluster, dedupe, filters, joins, knn, rank, views
from ..sources.sinks import scratch
from .registry import NOW, ORACLES, QUERIES, query, table, texts  # noqa: F401

def title(c: Column) -> Column:
    """A document's first line."""
    return F.substring_index(c, "\n", 1)


def words_in(words: tuple[str, ...], hay: str) -> str:
    return "(" + " or ".join(f"contains({hay}, '{w}')" for w in words) + ")"


# -- URLs and pages

CANON = r"""
with p as (select page_id, url, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', ['s','h','p','q','f']) as x from pages),
c as (select page_id, url, x.s as s, x.h as h, case when x.p = '' then '/' when length(x.p) > 1 and x.p[-1] = '/' then x.p[1:-2] else x.p end as path,
 array_to_string(list_filter(string_split(substr(x.q, 2), '&'), lambda a: a <> '' and string_split(a, '=')[1] not in ('ref','source','feature') and not starts_with(lower(string_split(a, '=')[1]), 'utm_')), '&') as q from p),
u as (select page_id, url, case when s = '' then url else lower(s) || '://' || lower(h) || path || case when q <> '' then '?' || q else '' end end as canonical, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', ''), '') as domain from c)
"""


@query(CANON + "select page_id, canonical from u")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(CANON + "select domain, count(*) as n, count(distinct canonical) as n_urls, max(page_id) as latest from (select domain, canonical, max(page_id) as page_id from u group by 1, 2) group by 1")
def url_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    """The newest page of each canonical URL, counted by domain."""
    p = table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.domain(F.col("url")).alias("domain"))
    last = dedupe.latest(p, F.struct("domain", "canonical"), F.col("page_id"), F.col("page_id"))
    return last.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("canonical").alias("n_urls"), F.max("page_id").alias("latest"))


@query(CANON + "select page_id, canonical, slot from (select page_id, canonical, min(page_id) over (partition by canonical) as slot, row_number() over (partition by canonical order by page_id desc) as r from u) where r = 1")
def page_dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))
    return dedupe.latest(p, F.col("canonical"), F.col("page_id"), F.col("page_id")).select("page_id", "canonical", "slot")


@query(CANON + "select page_id, substr(sha256('pages|' || canonical), 1, 24) as id from u")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.stable_id(F.lit("pages"), urls.canonical_url(F.col("url"))).alias("id"))


@query(r"""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', '', 'gis'), '<style.*?</style>', '', 'gis'), '</?[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) as text from pages""")
def page_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(r"""select page_id, case when strpos(lower(html), '</head>') > 0 then substr(html, 1, strpos(lower(html), '</head>') + 6) else html end as head, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title from pages""")
def page_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.head_html(F.col("html"), 1 << 30).alias("head"), F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"))


# -- documents: topics, stance, tokens

_HAY = "lower(coalesce(text, ''))"
_TOPIC_LIST = "list_filter([" + ", ".join(f"case when {words_in(w, _HAY)} then '{t}' end" for t, w in TOPICS.items() if t != "general") + "], lambda x: x is not null)"
_TAGGED = f"with t as (select doc_id, source, case when len({_TOPIC_LIST}) > 0 then {_TOPIC_LIST} else ['general'] end as tags from documents)"


def _topics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", tags.topic_tags(F.col("text"), F.lit("")).alias("tags"))


@query(f"{_TAGGED} select doc_id, array_to_string(tags, '|') as tags from t")
def doc_topic_tags(spark: SparkSession, d: str) -> DataFrame:
    return _topics(texts(spark, d)).select("doc_id", F.array_join("tags", "|").alias("tags"))


@query(f"{_TAGGED}, e as (select doc_id, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from t) select tag, count(*) as n from e group by 1 order by n desc, min(doc_id * 1000 + pos) limit 12")
def topic_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_tags(_topics(texts(spark, d)), "tags", "doc_id")


@query(f"{_TAGGED}, e as (select source, unnest(tags) as tag from t), n as (select source, tag, count(*) as n, row_number() over (partition by source order by count(*) desc, tag) as r from e group by 1, 2) select source, string_agg(tag, '|' order by r) as tags from n where r <= 6 group by 1")
def cluster_tag_ranking(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.cluster_tags(_topics(texts(spark, d)), "source", "tags").select("source", F.array_join("tags", "|").alias("tags"))


@query(
    f"select doc_id, case when {words_in(tags.SKEPTICAL, _HAY)} then 'skeptical' when {words_in(tags.OPTIMISTIC, _HAY)} then 'mainstream' else 'balanced' end as stance, case when {words_in(tags.RUMOR_WORDS + tags.HEDGE_WORDS, _HAY)} then 'Speculative' when doc_id % 200 < 90 then 'Developing' else 'Confirmed' end as speculation, case when {words_in(tags.SKEPTICAL, _HAY)} then '{FRAMINGS["skeptical"]}' when {words_in(tags.OPTIMISTIC, _HAY)} then '{FRAMINGS["mainstream"]}' else '{FRAMINGS["balanced"]}' end as framing from documents"
)
def doc_stance(spark: SparkSession, d: str) -> DataFrame:
    """Stances, and statuses of documents that are up to 200 minutes old."""
    now = F.lit(NOW).cast("timestamp")
    published = now - F.make_dt_interval(mins=F.col("doc_id") % 200)
    return texts(spark, d).select("doc_id", tags.stance(F.col("text"), F.lit("")).alias("stance"), tags.speculation(F.col("text"), F.lit(""), published, now).alias("speculation"), tags.framing(tags.stance(F.col("text"), F.lit(""))).alias("framing"))


@query(f"select doc_id, source from documents where not {words_in(('deal', 'discount', 'coupon', 'sale'), _HAY)}")
def blocked_term_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.unblocked(table(spark, d, "documents"), F.col("text"), F.lit("")).select("doc_id", "source")


_TITLE = "string_split(coalesce(text, ''), chr(10))[1]"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_TOK = f"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({_TITLE}), '[''’]', '', 'g'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) >= 3 and w not in {_STOP}))"


@query(f"select doc_id, array_to_string(list_sort({_TOK}), ' ') as tokens, len({_TOK}) as n from documents")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = similarity.tokens(title(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(t), " ").alias("tokens"), F.size(t).cast("long").alias("n"))


def _title_classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cid) of documents whose titles have tokens, and (cid, key, n): a class for each set of tokens."""
    t = table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(similarity.tokens(title(F.col("text")))), " ").alias("key")).where("key <> ''")
    classes = scratch(t.groupBy("key").agg(F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()), "classes")  # written: the numbers stay
    return scratch(t.join(classes.select("key", "cid"), "key").select("doc_id", "cid"), "members"), classes


@query(
    f"with t as (select doc_id, {_TOK} as tok from documents), e as (select doc_id, unnest(tok) as w, len(tok) as n from t), p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as m from e a join e b on a.w = b.w and a.doc_id <> b.doc_id where a.doc_id % 100 = 0 group by all) select a, b, round(m / (na + nb - m), 6) as jaccard from p where m / (na + nb - m) >= 0.3"
)
def doc_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A search: titles of ids divisible by 100 as queries, against those of all documents. Equal token sets are one class."""
    of, classes = _title_classes(spark, d)
    sets = classes.select(F.col("cid").alias("key"), F.split("key", " ").alias("tok"))
    asked = of.where("doc_id % 100 = 0").select(F.col("doc_id").alias("a"), F.col("cid").alias("ka"))
    pairs = joins.similar_sets(sets, 0.3, queries=sets.join(asked.select(F.col("ka").alias("key")).distinct(), "key", "left_semi"))
    return joins.expanded(pairs, asked, of.select(F.col("doc_id").alias("b"), F.col("cid").alias("kb"))).where("a <> b").select("a", "b", F.round("sim", 6).alias("jaccard"))


@query(
    f"with t as (select doc_id, {_TOK} as tok from documents), e as (select doc_id, unnest(tok) as w, len(tok) as n from t), p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as m from e a join e b on a.w = b.w and a.doc_id < b.doc_id group by all) select a, b, round(m / (na + nb - m), 6) as jaccard from p where m / (na + nb - m) >= 0.3"
)
def doc_jaccard_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """Similar titles of all languages and sources: equal token sets are one class, and classes are compared."""
    of, classes = _title_classes(spark, d)
    pairs = joins.similar_sets(classes.select(F.col("cid").alias("key"), F.split("key", " ").alias("tok")), 0.3)
    pairs = pairs.unionByName(classes.where("n > 1").select(F.col("cid").alias("ka"), F.col("cid").alias("kb"), F.lit(1.0).alias("sim")))
    found = joins.expanded(pairs.withColumn("sim", F.round("sim", 6)), of.select(F.col("doc_id").alias("a"), F.col("cid").alias("ka")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("sim").alias("jaccard"))


@query(r"""select doc_id, md5(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|')) as lines, length(coalesce(text, '')) > 500 as long_text, case when length(text) > 80 then substr(text, 1, 80) || '…' else text end as clamped from documents""")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: text.trim_separators(x)), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(lines, "|")).alias("lines"), (F.length(F.coalesce("text", F.lit(""))) > 500).alias("long_text"), text.clamp_text(F.col("text"), 80).alias("clamped"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) as slug from documents""")
def doc_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hashing.slug(F.coalesce("text", F.lit(""))).alias("slug"))


@query(
    "with recursive w as (select n_nationkey as k, n_name as s from nation), f(k, s, i, h) as (select k, s, 0, 2166136261::hugeint from w union all select k, s, i + 1, (xor(h::ubigint, ascii(s[i + 1])::ubigint)::hugeint * 16777619) % 4294967296 from f where i < length(s)) select k as n_nationkey, h::bigint as fnv from f where i = length(s)"
)
def fnv_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", hashing.fnv1a(F.col("n_name")).alias("fnv"))


# -- events: recency, latest, first, social

_EVENTS = f"events where ts >= timestamp '{NOW}' - interval 7 day"


@query(f"select event_id, ts, event_type from {_EVENTS} order by ts desc, event_id limit 1000")
def recency_cap(spark: SparkSession, d: str) -> DataFrame:
    return filters.newest(filters.recent(table(spark, d, "events"), "ts", NOW), "ts", "event_id").select("event_id", "ts", "event_type")


@query("select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) as r from events) where r = 1")
def event_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.latest(table(spark, d, "events"), F.struct("user_id", "event_type"), F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id", "ts")


@query("select user_id, min(event_id) as event_id from events group by 1")
def event_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.first_wins(table(spark, d, "events"), F.col("user_id"), F.col("event_id")).select("user_id", "event_id")


_SOCIAL = "(case when event_id % 3 = 0 then 5.0 else 0 end + case when event_type = 'purchase' then 3.0 else 0 end + floor(coalesce(value, 0)) + (user_id % 7) * 2 + (event_id % 5) * 0.5)"


def _posts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    score = rank.social_score(F.col("event_id") % 3 == 0, F.col("event_type") == "purchase", F.floor(F.coalesce("value", F.lit(0))), F.col("user_id") % 7, F.col("event_id") % 5)
    return e.withColumn("score", score)


@query(f"select event_id, {_SOCIAL} as score from events order by score desc, event_id limit 120")
def social_score_topk(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).orderBy(F.desc("score"), "event_id").limit(120).select("event_id", "score")


@query("with m as (select *, event_id % 3 = 0 or event_type = 'purchase' as strict, event_id % 3 = 0 or user_id % 7 > 0 as relaxed from events), n as (select count(*) filter (where strict) as n from m) select event_id from m, n where case when n.n >= 12 then strict else relaxed end")
def social_two_tier_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.two_tier(table(spark, d, "events"), F.col("event_id") % 3 == 0, F.col("event_type") == "purchase", F.col("user_id") % 7, F.lit(0), True).select("event_id")


@query(
    "with b as (select event_id, event_type, ts, event_type = 'purchase' as social, row_number() over (partition by event_type = 'purchase', user_id order by ts desc, event_id) as k, count(*) filter (where event_type <> 'purchase') over (partition by user_id) as others, user_id from events), s as (select *, case when not social then k when k * 5 <= others then k * 5 else 1000000000 end as slot from b) select user_id, event_id, row_number() over (partition by user_id order by slot, social, k) as position from s"
)
def social_interleave(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return rank.interleaved(e, F.col("event_type") == "purchase", [F.desc("ts"), F.asc("event_id")], "user_id").select("user_id", "event_id", F.col("position").cast("long").alias("position"))


@query("select event_id, case when event_id % 4 = 2 then 'none' else props end as whole, case when event_id % 4 < 2 then json_extract_string(props, '$.' || json_keys(props)[1]) else 'none' end as first from events where json_valid(props) and props like '{%'")
def json_recover(spark: SparkSession, d: str) -> DataFrame:
    """JSON as it is, within other text, cut short (none), and an array (kept, without keys)."""
    k, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(k == 0, p).when(k == 1, F.concat(F.lit("Sure: "), p, F.lit(" Anything else?"))).when(k == 2, F.concat(F.lit("a "), F.expr("substring(props, 1, length(props) - 1)"))).otherwise(p)
    e = table(spark, d, "events").where(F.try_parse_json("props").isNotNull() & p.startswith("{")).withColumn("whole", F.coalesce(text.json_object(raw), F.lit("none")))
    first = F.when(k < 2, F.expr("get_json_object(whole, concat('$.', json_object_keys(props)[0]))")).otherwise("none")
    return e.select("event_id", "whole", first.alias("first"))


# -- joins and snapshots

_ORDERS = "orders where o_orderkey % 3 = 0"


@query("select s_suppkey, coalesce(n_name, s_nationkey::varchar) as nation from supplier left join nation on s_nationkey = n_nationkey and n_regionkey <> 1")
def source_left_join(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").where("n_regionkey <> 1")
    return joins.with_name(table(spark, d, "supplier"), "s_nationkey", names, "n_nationkey", "n_name", "nation").select("s_suppkey", "nation")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def orders_anti_existing(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unseen(table(spark, d, "orders"), old, "o_orderkey").select("o_orderkey", "o_custkey")


@query("with old as (select o_custkey as id, max(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1), new as (select o_custkey as id, max(o_totalprice) as v from orders where o_orderstatus <> 'F' group by 1), u as (select * from old where id not in (select id from new) union all select * from new) select id, v from u where id in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def trust_semi_upsert(spark: SparkSession, d: str) -> DataFrame:
    """New records replace old ones; those of unknown items go."""
    o = table(spark, d, "orders")
    old, new = (o.where(c).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("v")) for c in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"))
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return joins.present(joins.upsert(old, new, "id"), known, "id").select("id", "v")


@query("with off as (select n_nationkey from nation where n_regionkey = 2) select s_suppkey from supplier where s_nationkey not in (select n_nationkey from off)")
def source_filter(spark: SparkSession, d: str) -> DataFrame:
    settings = table(spark, d, "nation").select(F.concat(F.lit(" "), F.upper(F.col("n_nationkey").cast("string"))).alias("name"), (F.col("n_regionkey") != 2).alias("enabled"))
    return filters.allowed_sources(table(spark, d, "supplier"), F.col("s_nationkey").cast("string"), settings).select("s_suppkey")


@query("select event_id from events where ts > timestamp '2024-01-30 23:50:00' - interval 600 second")
def ttl_fresh(spark: SparkSession, d: str) -> DataFrame:
    return joins.fresh(table(spark, d, "events"), "ts", "2024-01-30 23:50:00", 600).select("event_id")


@query("select c_custkey, o_orderkey as last_order from customer left join (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) on c_custkey = o_custkey and r = 1")
def last_entry_lookup(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.lookup(table(spark, d, "customer"), entries, "c_custkey", "o_orderkey").select("c_custkey", F.col("o_orderkey").alias("last_order"))


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 8")
def chat_last_n(spark: SparkSession, d: str) -> DataFrame:
    return filters.last_n(table(spark, d, "conversations"), "conv_id", "turn", 8).select("conv_id", "turn", "role")


# -- vectors


_VEC = "with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as nrm from v)"


@query(f"{_VEC} select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.e, b.e) / (a.nrm * b.nrm), 6) as sim from n a join n b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and list_dot_product(a.e, b.e) / (a.nrm * b.nrm) >= 0.2")
def vec_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A search: vectors of ids divisible by 100 as queries, against all of their label."""
    v = table(spark, d, "embeddings").withColumn("norm", similarity.norm(F.col("embedding")))
    a = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x"), F.col("norm").alias("nx"))
    b = v.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y"), F.col("norm").alias("ny"))
    sim = similarity.dot(F.col("x"), F.col("y")) / (F.col("nx") * F.col("ny"))
    return a.join(b, "label").where("a <> b").withColumn("sim", sim).where("sim >= 0.2").select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"{_VEC} select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.e, b.e) / (a.nrm * b.nrm), 6) as sim from n a join n b on a.label = b.label and a.vec_id < b.vec_id where list_dot_product(a.e, b.e) / (a.nrm * b.nrm) >= 0.2")
def vec_cosine_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a label."""
    return knn.cosine_pairs(table(spark, d, "embeddings"), 0.2).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"{_VEC}, l as (select a.vec_id, count(*) as n from n a join n b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.nrm * b.nrm) >= 0.2 group by 1) select v.vec_id, min(v.vec_id) over (partition by label, e) as class_id, coalesce(n, 0) as n_links from v left join l on v.vec_id = l.vec_id")
def vec_cosine_links(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors of its label each one is similar to, and its class of equal ones: the whole job, a row a vector."""
    return knn.cosine_links(table(spark, d, "embeddings"), 0.2)


@query(f"{_VEC}, p as (select a.vec_id as id, b.vec_id as neighbour, b.vec_id % 20 as src, list_dot_product(a.e, b.e) / (a.nrm * b.nrm) as sim from n a join n b on a.label = b.label and a.vec_id <> b.vec_id), c as (select *, row_number() over (partition by id, src order by sim desc, neighbour) as r from p where sim >= 0.2), k as (select *, row_number() over (partition by id order by sim desc, neighbour) as rank from c where r <= 3) select id, neighbour, round(sim, 6) as sim, rank from k where rank <= 8")
def vec_knn_capped(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 20).alias("source"), F.array("label").alias("tags"), "embedding", F.col("vec_id").alias("seq"))
    return knn.neighbours(v, threshold=0.2).select("id", "neighbour", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


# -- clusters, groups, rankings


def _titled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), title(F.col("text")).alias("title"), F.col("text").alias("summary"), "source", "lang", tags.topic_tags(F.col("text"), F.lit("")).alias("tags"))


def _folded(tokens: str) -> str:
    """Leader clustering of all documents in order of their ids, a row a step: leads(doc_id, lead). Similar pairs are found first."""
    return f"""
with recursive t as materialized (select doc_id, {tokens} as tok, row_number() over (order by doc_id) as pos from documents), e as (select doc_id, unnest(tok) as w, len(tok) as n from t),
p as materialized (select a, b, m / (na + nb - m) as sim from (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as m from e a join e b on a.w = b.w and a.doc_id < b.doc_id group by all) where m / (na + nb - m) >= 0.25),
s(pos, doc_id, lead, leaders) as (
 select 0::bigint, null::bigint, null::bigint, []::bigint[]
 union all
 select t.pos, t.doc_id, coalesce(b.a, t.doc_id), case when b.a is null then list_append(s.leaders, t.doc_id) else s.leaders end
 from s join t on t.pos = s.pos + 1 left join lateral (select a from p where p.b = t.doc_id and list_contains(s.leaders, p.a) order by sim desc, a limit 1) b on true
), leads as (select doc_id, lead from s where pos > 0)"""


@query(_folded(_TOK) + " select doc_id as id, lead as leader from leads")
def title_leader_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Leader clustering of all titles in one fold."""
    rows = _titled(spark, d).withColumn("tokens", similarity.tokens(F.col("title")))
    return cluster.title_leaders(rows, 0.25).select("id", "leader")


_COLON = r"regexp_replace(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g')"
_CURATION = _TOK.replace(_TITLE, rf"(case when strpos({_COLON}, ':') between 2 and 30 then regexp_replace(substr({_COLON}, strpos({_COLON}, ':') + 1), '^\s+|\s+$', '', 'g') else {_COLON} end)")
_GROUP_IMAGE = "case when doc_id % 3 = 0 then concat('/img/', doc_id, '.png') when doc_id % 3 = 1 then '/placeholder.svg' end"


def _assembled(leads: str) -> str:
    """Groups of leads(doc_id, lead), from the common table expressions before."""
    return f"""{leads}, r as (select d.*, lead, {_GROUP_IMAGE} as img, row_number() over (partition by lead, source order by d.doc_id desc) as s from documents d join leads using (doc_id)),
l as (select *, row_number() over (partition by lead order by doc_id desc) as pos from r where s = 1), k as (select *, case when len({_TOPIC_LIST}) > 0 then {_TOPIC_LIST} else ['general'] end as tags from l where pos <= 10),
g as (select lead, list(doc_id order by pos) as ids, list(img order by pos) as imgs, count(*) as n, list(source order by pos) as sources, flatten(list(tags order by pos)) as tags, first(string_split(coalesce(text, ''), chr(10))[1] order by pos) as title, max(doc_id) as newest from k group by 1)
select substr(sha256('story|' || array_to_string(list_sort(list_transform(ids, lambda x: x::varchar)), '|')), 1, 24) as id, title, newest, array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), '|') as topic_tags, n::int as n_perspectives, n as n_sources,
 array_to_string(ids, '|') as ids, coalesce(list_filter(imgs, lambda x: x is not null and x <> '' and not contains(x, 'placeholder.svg'))[1], imgs[1], 'none') as image from g where n >= 2"""


def _grouped_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as items; the later id is the newer."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), title(F.col("text")).alias("title"), F.col("text").alias("summary"), "source", F.lit("editorial").alias("source_type"), F.concat(F.lit("https://example.com/"), "doc_id").alias("url"), F.timestamp_seconds(F.col("doc_id")).alias("published_at"), F.expr(_GROUP_IMAGE).alias("image_url")
    )


def _group_rows(groups: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("perspectives", lambda p: p["id"].cast("string")), "|")
    return groups.select("id", "title", F.unix_seconds("created_at").alias("newest"), F.array_join("topic_tags", "|").alias("topic_tags"), F.size("perspectives").alias("n_perspectives"), "n_sources", ids.alias("ids"), F.coalesce("image_url", F.lit("none")).alias("image"))


@query(_assembled(_folded(_CURATION)))
def story_groups(spark: SparkSession, d: str) -> DataFrame:
    """Multi-source groups of all titles, in one fold."""
    return _group_rows(views.story_groups(_grouped_items(spark, d), tags=tags.topic_tags(F.col("summary"), F.lit(""))))


@query(_assembled("with leads as (select doc_id, doc_id % 59 as lead from documents)"))
def group_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Groups of given clusters: the newest of each source, ten at most, their tags, image and id."""
    return _group_rows(views.assembled(_grouped_items(spark, d).withColumn("leader", F.col("id") % 59), tags=tags.topic_tags(F.col("summary"), F.lit(""))))


@query("select count(*) as groups, count(*) filter (where n >= 3) as multi, (select count(distinct user_id) from events) as sources from (select event_type, count(*) as n from events group by 1)")
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.group_stats(table(spark, d, "events"), "event_type", "user_id").select("groups", "multi", "sources")


_IMAGE = "case doc_id % 4 when 0 then null when 1 then '/placeholder.svg' else concat('/img/', doc_id % 50, '.png') end"


@query(
    rf"""with d as (select *, {_IMAGE} as img, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) as n from documents), i as (select count(*) as items, count(*) filter (where doc_id % 4 < 2) as img_missing, count(*) filter (where doc_id % 4 > 1 and doc_id % 50 >= 30) as img_broken, count(*) filter (where n < 500) as short_text, count(*) filter (where n < 80) as title_only from d),
m as (select doc_id % 200 as id, count(distinct source) as sources, count(*) as n from documents group by 1), c as (select count(*) as stories, count(*) filter (where sources <= 1) as one_source, count(*) filter (where n < 3) as under_three from m)
select *, round(img_broken / items * 100, 6) as img_broken_pct, round(short_text / items * 100, 6) as short_text_pct, round(one_source / stories * 100, 6) as one_source_pct, true as invalid from i, c"""
)
def audit_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Images are missing, stored (those numbered under 30) or broken."""
    docs = texts(spark, d)
    items = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.lit("no text").alias("title"), F.col("text").alias("summary"), F.col("text").alias("extracted_text"), F.expr(_IMAGE).alias("image_url"))
    stored = spark.range(30).select(F.concat(F.lit("/img/"), "id", F.lit(".png")).alias("path"))
    out = aggregates.audit(items, docs.select((F.col("doc_id") % 200).alias("id"), F.col("doc_id").alias("item_id")), stored)
    shares = ("img_broken_pct", "short_text_pct", "one_source_pct")
    return out.select("items", "img_missing", "img_broken", "short_text", "title_only", "stories", "one_source", "under_three", *(F.round(c, 6).alias(c) for c in shares), "invalid")


_BULLET = "list_filter(list_transform(list_filter(list_transform(string_split(md, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '- ')), lambda x: trim(regexp_replace(x, '^-+[ ]*', ''))), lambda x: x <> '')"


@query(f"with m as (select doc_id, '- ' || replace(coalesce(text, ''), chr(10), chr(10) || ' - ') as md from documents) select doc_id, len({_BULLET}) as n, md5(array_to_string({_BULLET}, '|')) as digest from m")
def bullets_extract(spark: SparkSession, d: str) -> DataFrame:
    b = text.bullets(F.concat(F.lit("- "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n - "))))
    return texts(spark, d).select("doc_id", F.size(b).cast("long").alias("n"), F.md5(F.array_join(b, "|")).alias("digest"))


_SYN = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in tags._CANONICAL.items()) + "}"


@query(f"{_TAGGED}, e as (select doc_id, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from t), c as (select doc_id, ({_SYN})[regexp_replace(tag, '[^a-z0-9]', ' ', 'g')] as canonical, pos from e) select canonical, count(*) as n, count(distinct doc_id) as docs from c where canonical is not null group by 1")
def tag_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    e = _topics(texts(spark, d)).select("doc_id", F.explode("tags").alias("tag")).withColumn("canonical", tags.canonical_tag(F.col("tag"))).where("canonical is not null")
    return e.groupBy("canonical").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"{_TAGGED}, e as (select doc_id, ({_SYN})[regexp_replace(tag, '[^a-z0-9]', ' ', 'g')] as tag, pos from (select doc_id, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from t)), c as (select tag, count(*) as n, min(doc_id * 1000 + pos) as first from e where tag is not null group by 1), f as (select tag, i from (select unnest([{', '.join(repr(t) for t in aggregates.HIGH_SIGNAL_TAGS)}]) as tag, generate_subscripts(range({len(aggregates.HIGH_SIGNAL_TAGS)}), 1) as i)) select (row_number() over (order by n desc nulls last, first nulls last, i))::int as rank, f.tag, coalesce(n, 0) as n from f left join c on f.tag = c.tag")
def onboarding_tags(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.onboarding_tags(_topics(texts(spark, d)), "tags", "doc_id")


@query("select l_orderkey as o_orderkey, array_to_string(list(l_linenumber order by l_linenumber), ',') as lines, sum(p_size)::bigint as size from lineitem join part on l_partkey = p_partkey group by 1")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """Member ids of a cluster to their rows, in order."""
    li = table(spark, d, "lineitem")
    c = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("xs"))
    c = c.select("o_orderkey", F.col("xs.l_linenumber").alias("numbers"), F.col("xs.l_partkey").alias("ids"))
    m = joins.members(c, "ids", table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return m.groupBy("o_orderkey").agg(F.array_join(F.first("numbers"), ",").alias("lines"), F.sum("p_size").alias("size"))
