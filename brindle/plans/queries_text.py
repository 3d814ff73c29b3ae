"""Queries of single-row functions over the test tables, each on whole texts. Inputs that the tables lack (markup, bullets, odd
tags) are made from their rows by an expression that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, settings, similarity, tags, text, trust, urls
from ..functions.values import PLACEHOLDERS, SOCIAL_TOPICS, TOKEN_TAGS
from ..operators import enrich, rank
from .queries import _STOP, _SYN, words_in
from .registry import NOW, query, sql_values, table, texts, values

NOW_S = 1706659200  # NOW in seconds
_trim = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_collapse = lambda x: rf"trim(regexp_replace({x}, '[\s\x0B]+', ' ', 'g'))"
_first = lambda xs: f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"  # noqa: E731; distinct, in order
_md5 = lambda xs: f"md5(array_to_string({xs}, '|'))"


def digest(c) -> F.Column:
    return F.md5(F.array_join(c, "|"))


# -- pages

MARKED = """concat(case page_id % 5
 when 0 then concat('<head><link href="/c', page_id, '" rel="canonical">', repeat('x', 500), '<meta property="og:image" content="/o', page_id, '.png"></head>')
 when 1 then concat('<meta content="/w', page_id, '" name="description"><META NAME="twitter:image" CONTENT="/t.png">')
 when 2 then concat('<p>a</p><img class=q src="/i', page_id, '.jpg">')
 when 3 then '<link rel="canonical"><a href="/other">' else '' end, html)"""


def _near(mark: str, attribute: str) -> str:
    at = f"strpos(lower(h), '{mark}')"
    return f"case when {at} > 0 then nullif(regexp_extract(substr(h, greatest(0, {at} - 401) + 1, {at} + 399 - greatest(0, {at} - 401)), '(?i){attribute}=[\"'']([^\"'']+)[\"'']', 1), '') end"


_IMG = "nullif(regexp_extract(h, '(?i)<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1), '')"


@query(f"with p as (select page_id, {MARKED} as h from pages) select page_id, {_near('rel=\"canonical\"', 'href')} as canonical, coalesce({_near('property=\"og:image\"', 'content')}, {_near('name=\"twitter:image\"', 'content')}, {_IMG}) as image, {_IMG} as first_image from p")
def page_links_and_images(spark: SparkSession, d: str) -> DataFrame:
    h = F.expr(MARKED)
    return texts(spark, d, "pages").select("page_id", text.canonical_link(h).alias("canonical"), text.page_image(h).alias("image"), text.first_image(h).alias("first_image"))


_UNTAGGED = "regexp_replace(html, '</?[^>]+>', ' ', 'g')"
_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', '', 'gis'), '<style.*?</style>', '', 'gis'), '</?[^>]+>', ' ', 'g')"


@query(f"select page_id, md5({_collapse(_BARE)}) as undecoded, md5({_collapse(_UNTAGGED)}) as without_tags from pages")
def page_plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html"), False)).alias("undecoded"), F.md5(text.strip_tags(F.col("html"))).alias("without_tags"))


#: Pages whose </head> lies about the limit, after characters of one to four bytes.
LONG = "case page_id % 4 when 0 then concat(repeat('a', cast(63980 + page_id % 40 as int)), '</head>', html) when 1 then concat('ab', repeat('é', cast(31985 + page_id % 23 as int)), '</head>', html) when 2 then concat(repeat('€', cast(21325 + page_id % 17 as int)), '</head>', html) else concat('a', repeat('😀', cast(15995 + page_id % 9 as int)), '</head>', html) end"


@query(f"with x as (select page_id, hex(encode({LONG})) as h from pages), b as (select *, list_filter([64000, 63999, 63998, 63997], lambda k: not (substr(h, 2 * k + 1, 2) between '80' and 'BF'))[1] as k from x), p as (select page_id, decode(unhex(substr(h, 1, 2 * k))) as h from b), c as (select page_id, case when strpos(lower(h), '</head>') > 0 then substr(h, 1, strpos(lower(h), '</head>') + 6) else h end as h from p) select page_id, length(h) as n, md5(h) as digest from c")
def page_heads_cut(spark: SparkSession, d: str) -> DataFrame:
    """Heads of pages whose </head> lies about the limit of 64,000."""
    h = table(spark, d, "pages").select("page_id", text.head_html(F.expr(LONG)).alias("h"))
    return h.select("page_id", F.length("h").cast("long").alias("n"), F.md5("h").alias("digest"))


_URL = """case page_id % 8 when 0 then concat('https://news.ycombinator.com/item?id=', page_id) when 1 then concat('http://news.ycombinator.com/item?x=1&id=', page_id, '&y=2')
 when 2 then concat('https://www.reddit.com/r/a/comments/k', page_id, '/title') when 3 then concat('//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.b%2F', page_id, '%3Fq%3Da%2520b&rut=1')
 when 4 then concat('HTTPS://WWW.Site', page_id, '.org:8443/a#frag') when 5 then concat('ftp://x/', page_id) else url end"""


@query(
    rf"""with p as (select page_id, {_URL} as u from pages), h as (select *, nullif(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') as domain from p)
select page_id, domain, case when page_id % 8 in (0, 1) then page_id else -1 end as forum_id, case when page_id % 8 = 2 then 'k' || page_id end as thread, case when page_id % 8 = 3 then 'https://a.b/' || page_id || '?q=a%20b' else u end as target,
case when regexp_matches(u, '(?i)^https?://') then regexp_replace(u, '#.*$', '') end as web, 'https://www.google.com/s2/favicons?domain=' || domain || '&sz=128' as favicon from h"""
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("u")
    p = table(spark, d, "pages").select("page_id", F.expr(_URL).alias("u"))
    return p.select("page_id", urls.domain(u).alias("domain"), F.coalesce(urls.forum_item_id(u), F.lit(-1)).alias("forum_id"), urls.thread_id(u).alias("thread"), urls.redirect_target(u).alias("target"), urls.web_url(u).alias("web"), urls.favicon_url(u).alias("favicon"))


# -- times


@query(f"with m as (select event_id, greatest(0, floor(({NOW_S} - epoch(ts)) / 60))::bigint as m, ts from events) select event_id, case when m < 60 then m || 'm ago' when m < 1440 then m // 60 || 'h ago' else m // 1440 || 'd ago' end as ago, case when m < 60 then m || 'm ago' else floor(m / 60 + 0.5)::bigint || 'h ago' end as label from m")
def relative_times(spark: SparkSession, d: str) -> DataFrame:
    now, ts = F.lit(NOW).cast("timestamp"), F.col("ts").cast("timestamp")
    minutes = F.greatest(F.lit(0), F.floor((now.cast("double") - ts.cast("double")) / 60)).cast("long")
    return table(spark, d, "events").select("event_id", text.ago(ts, now).alias("ago"), text.minutes_label(minutes).alias("label"))


@query(f"select event_id, case when event_id % 4 < 3 then floor(epoch(ts))::bigint else {NOW_S} end as seconds from events")
def date_coercion(spark: SparkSession, d: str) -> DataFrame:
    """ISO 8601, two forms of RFC 822, and what is no date."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))).when(k == 2, F.concat(F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.when(F.col("event_id") % 8 == 3, "junk"))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(text.parse_date(raw, F.timestamp_seconds(F.lit(NOW_S)))).alias("seconds"))


# -- bullets and summaries

MD = """case doc_id % 7 when 0 then concat('- ', replace(coalesce(text, ''), chr(10), concat(chr(10), '- '))) when 1 then text
 when 2 then concat('- Key points: one', chr(10), '  - two ', source, chr(10), '- as an AI model', chr(10), '--- three', chr(10), '- -- four') when 3 then 'Not specified'
 when 4 then concat('- ', lang, chr(10), '- b', chr(10), '- ', repeat('c', cast(doc_id % 300 as int)), chr(10), '- d') when 5 then concat(' ', chr(10), ' only ', source, ' ') end"""
_DASHES, _KEY_POINTS = r"regexp_replace(x, '^-+\s*', '')", r"regexp_replace(x, '(?i)^key points:?\s*', '')"
_B = f"list_filter(list_transform(list_filter(list_transform(string_split(coalesce(md, ''), chr(10)), lambda x: {_trim('x')}), lambda x: starts_with(x, '- ')), lambda x: {_trim(_DASHES)}), lambda x: x <> '')"
_some = lambda xs, test: f"len(list_filter({xs}, lambda x: {test})) > 0"


@query(
    rf"""with m as (select doc_id, source, {MD} as md from documents), b as (select *, {_B} as b, lower(coalesce(md, '')) as low, {_trim("coalesce(md, '')")} as line from m),
f as (select *, list_filter(list_transform(b, lambda x: {_trim(_KEY_POINTS)}), lambda x: not contains(lower(x), 'not specified') and not contains(lower(x), 'as an ai')) as f, len(list_filter(string_split(md, chr(10)), lambda x: starts_with({_trim('x')}, '- '))) as n from b),
g as (select *, case when len(f) < 2 or contains(low, 'not specified') or {_some('f', 'length(x) > 220')} then [source] else f[1:6] end as g from f)
select doc_id, {_md5('case when len(b) > 0 then b when line <> ' + repr('') + ' then [line] else [] end')} as lines, not contains(low, 'not specified') and not contains(low, 'key points:') and len(b) between 2 and 8 and not {_some('b', 'length(x) > 140')} as good, {_md5('g')} as summary,
array_to_string(list_transform(g, lambda x: '- ' || x), chr(10)) as markdown, coalesce(length(md) >= 120 and n between 4 and 5 and not contains(low, 'as an ai') and not contains(low, 'as a language model'), false) as valid, coalesce(length(md) >= 400 and not contains(low, 'as an ai') and not contains(low, 'as a language model'), false) as valid_text from g"""
)
def bullet_forms(spark: SparkSession, d: str) -> DataFrame:
    md = F.col("md")
    m = texts(spark, d).select("doc_id", "source", F.expr(MD).alias("md"))
    m, own = m.withColumn("own", text.summary_bullets(F.col("source"), md)), F.col("own")  # computed once, as it is used twice
    return m.select("doc_id", digest(text.bullets_or_line(md)).alias("lines"), text.good_bullets(md).alias("good"), digest(own).alias("summary"), text.to_markdown(own).alias("markdown"), text.valid_summary(md).alias("valid"), text.valid_text(md).alias("valid_text"))


_NOTES = "concat('Source: ', source), concat(' Sourcery ', lang), concat(' PUBLISHED ', doc_id), case when doc_id % 3 = 0 then 'topics' else coalesce(text, '') end, 'Author x', ' '"


@query(
    rf"""with n as (select doc_id, [{_NOTES}] as b, [case when doc_id % 2 = 0 then 'Domain: ' || lang else lang end] as one from documents)
select doc_id, {_md5(rf"list_filter(b, lambda x: not regexp_matches({_trim('x')}, '(?i)^(source|source domain|published|domain|topics)\b'))")} as built, one[1] as kept, {_md5(rf"list_filter(list_transform(b, lambda x: {_trim('x')}), lambda x: x <> '' and not regexp_matches(x, '(?i)^(source|source domain|published|domain|topics|updated|author)\b'))")} as refreshed from n"""
)
def metadata_bullets(spark: SparkSession, d: str) -> DataFrame:
    """Bullets without metadata; where all are metadata, a build keeps them."""
    b = F.expr(f"array({_NOTES})")
    one = F.expr("array(case when doc_id % 2 = 0 then concat('Domain: ', lang) else lang end)")
    return texts(spark, d).select("doc_id", digest(text.without_metadata(b)).alias("built"), text.without_metadata(one)[0].alias("kept"), digest(text.without_metadata(b, True)).alias("refreshed"))


@query(rf"select doc_id, md5(case when length({_trim('text')}) > 1200 then text when doc_id % 3 = 0 then 'fetched ' || doc_id when doc_id % 2 = 0 then lang else '' end) as body from documents")
def article_bodies(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", F.md5(text.article_body(F.col("text"), F.expr("case when doc_id % 3 = 0 then concat('fetched ', doc_id) end"), F.expr("case when doc_id % 2 = 0 then lang end"))).alias("body"))


@query(
    rf"""with t as (select doc_id, {_trim("string_split(coalesce(text, ''), chr(10))[1]")} as title, case when doc_id % 3 = 0 then ' ' when doc_id % 3 = 1 then 'About ' || source end as description, 'Summary ' || lang as summary, text from documents)
select doc_id, md5(substr(concat_ws(chr(10), nullif(title, ''), nullif({_trim('coalesce(description, summary)')}, ''), nullif(substr(text, 1, 1200), '')), 1, 4000)) as digest from t"""
)
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    description = F.expr("case when doc_id % 3 = 0 then ' ' when doc_id % 3 = 1 then concat('About ', source) end")
    return table(spark, d, "documents").select("doc_id", F.md5(text.embedding_text(first, description, F.concat(F.lit("Summary "), "lang"), F.col("text"))).alias("digest"))


_CHUNKS = r"""
with c as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t from documents),
s as (select doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from c),
j as (select doc_id, t, case when len(s) > 0 then string_split(list_reduce(s, lambda a, x: a || case when length(string_split(a, chr(1))[-1]) + 1 + length(x) <= 700 then ' ' else chr(1) end || x), chr(1)) else [] end as out from s),
o as (select doc_id, case when len(out) = 1 and length(t) > 1400 then list_transform(range(0, length(t), 700), lambda i: substr(t, i + 1, 700)) else out end as out from j)
select doc_id, (i - 1)::int as pos, out[i] as chunk from o, unnest(range(1, len(out) + 1)) as r(i)
"""


@query(_CHUNKS)
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts in chunks of whole sentences."""
    return texts(spark, d).select("doc_id", F.posexplode(text.sentence_chunks(F.col("text"))).alias("pos", "chunk"))


# -- tags

_ODD = "concat('# ', source, ' - '), upper(lang), 'AI', 'a b', concat(' C', doc_id % 9, ' loud'), 'machine  learning', concat('Machine ', 'Learning'), lang, 'Research & Design', 'UX', concat('tag', repeat('x', cast(doc_id % 60 as int))), 'gpt-4', 'Policy —'"
_KEYED = lambda x: rf"trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9\t-\r ]', ' ', 'g'), '[\t-\r ]+', ' ', 'g'))"
_TOKENS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in TOKEN_TAGS.items()) + "}"


@query(
    rf"""with t as (select doc_id, text, [{_ODD}] as t from documents), b as (select doc_id, t, text, list_transform(t, lambda x: {_collapse(r"regexp_replace(regexp_replace(x, '^(?:[#*]|\s)+', ''), '(?:[-–—]|\s)+$', '')")}) as b from t),
g as (select *, list_filter(b, lambda x: length(x) between 2 and 48 and not {_some("string_split(x, ' ')", 'length(x) = 1').replace('lambda x: length', 'lambda w: length').replace('length(x) = 1', 'length(w) = 1')} and (length(x) > 3 or x in ('AI', 'ML', 'GPU', 'CPU', 'API', 'AWS', 'GCP', 'iOS', 'SaaS'))) as g,
 list_filter(list_transform(t, lambda x: ({_SYN})[{_KEYED('x')}]), lambda x: x is not null) as h, list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\t-\r -]', ' ', 'g'), '\s+'), lambda w: ({_TOKENS})[w]), lambda x: x is not null) as k from b)
select doc_id, array_to_string(list_filter(g, lambda x, i: list_position(list_transform(g, lambda y: lower(y)), lower(x)) = i), '|') as clean, array_to_string(({_first('h')})[1:6], '|') as high, array_to_string(({_first('k')})[1:6], '|') as by_token from g"""
)
def tag_forms(spark: SparkSession, d: str) -> DataFrame:
    """A generator's tags cleaned, high-signal tags, tags by single words of the text."""
    t = F.expr(f"array({_ODD})")
    return texts(spark, d).select("doc_id", F.array_join(tags.clean_tags(t), "|").alias("clean"), F.array_join(tags.high_signal(t), "|").alias("high"), F.array_join(tags.token_tags(F.col("text")), "|").alias("by_token"))


ALLOWED = ["Data", "machine learning", "New York", "AI", "the", "Open-source tools", "Rust"]
_PLAIN = lambda x: rf"regexp_replace(lower({x}), '[^a-z0-9\t-\r -]', ' ', 'g')"


@query(
    rf"""with j as (select doc_id, ' ' || {_collapse(_PLAIN("coalesce(text, '')"))} || ' ' as j from documents), t as (select tag, i, lower(trim(tag)) as w, list_filter(string_split({_collapse(_PLAIN('tag'))}, ' '), lambda x: x <> '') as ws from (select unnest({ALLOWED!r}) as tag, generate_subscripts({ALLOWED!r}, 1) as i)),
s as (select doc_id, tag, i, (case when contains(j, ' ' || w || ' ') then 5 else 0 end + case when contains(j, w) then 2 else 0 end + len(list_filter(ws, lambda x: contains(j, ' ' || x || ' '))))::int as score from j, t), r as (select *, (row_number() over (partition by doc_id order by score desc, i))::int as rank from s where score > 0)
select doc_id, rank, tag, score from r where rank <= 6"""
)
def allowed_tag_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rank.allowed_tags(texts(spark, d), "doc_id", F.coalesce("text", F.lit("")), ALLOWED)


ASKED = ("ai", "Security ", "Zig", "data", "frontend")
_LOW = "lower(coalesce(text, ''))"
_MATCHED = "list_filter([" + ", ".join(f"case when {words_in(SOCIAL_TOPICS.get(t.strip().lower(), (t.strip().lower(),)), _LOW)} then '{t}' end" for t in ASKED) + "], lambda x: x is not null)"


@query(f"with m as (select doc_id, {_MATCHED} as m from documents) select doc_id, array_to_string(m, '|') as topics, case when len(m) > 0 then array_to_string(list_sort(list_distinct(list_transform(m, lambda x: lower(trim(x))))), '|') else 'all' end as key from m")
def social_topic_matches(spark: SparkSession, d: str) -> DataFrame:
    m = texts(spark, d).select("doc_id", tags.social_topics(F.col("text"), ASKED).alias("m"))
    return m.select("doc_id", F.array_join("m", "|").alias("topics"), tags.topic_key(F.col("m")).alias("key"))


@query(
    rf"""with t as (select doc_id, string_split(coalesce(text, ''), chr(10))[1] as t from documents), b as (select doc_id, t, regexp_replace(regexp_replace('Wire: [x] ' || t, '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g') as b from t),
p as (select doc_id, t, case when strpos(b, ':') between 2 and 30 then {_trim("substr(b, strpos(b, ':') + 1)")} else b end as c from b),
w as (select doc_id, {', '.join(f"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: length(w) >= 3{y}) as {z}" for x, y, z in (('c', f' and w not in {_STOP}', 'c'), ('t', '', 't')))} from p)
select doc_id, array_to_string({_first('c')}, ' ') as curation, array_to_string({_first('t')}, ' ') as serving from w"""
)
def token_forms(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of whole first lines, for curation (no brackets, no source before a colon) and for serving (with stop words)."""
    t = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return table(spark, d, "documents").select("doc_id", F.array_join(similarity.curation_tokens(F.concat(F.lit("Wire: [x] "), t)), " ").alias("curation"), F.array_join(similarity.tokens(t, False), " ").alias("serving"))


# -- hashes


@query(
    """with recursive w as (select p_partkey as k, p_name as s from part), f(k, s, i, h, r) as (select k, s, 0, 2166136261::hugeint, 0::hugeint from w union all select k, s, i + 1, (xor(h::ubigint, ascii(s[i + 1])::ubigint)::hugeint * 16777619) % 4294967296, (r * 31 + ascii(s[i + 1])) % 4294967296 from f where i < length(s))
select k as p_partkey, h::bigint as fnv, abs(case when h >= 2147483648 then h - 4294967296 else h end)::bigint as fnv_abs, lower(to_hex(r::bigint)) as rolling, (['Left', 'Center', 'Right', 'Mixed'])[(abs(case when h >= 2147483648 then h - 4294967296 else h end) % 4)::int + 1] as picked from f where i = length(s)"""
)
def seeded_hashes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.insights import BIAS_LABELS, pick

    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", hashing.fnv1a(n).alias("fnv"), hashing.fnv1a_abs(n).alias("fnv_abs"), hashing.rolling31_hex(n).alias("rolling"), pick(BIAS_LABELS, hashing.fnv1a_abs(n)).alias("picked"))


# -- trust records

_NUMBERS = [(1, "12.5"), (2, "-3"), (3, "1000"), (4, "abc"), (5, None), (6, "NaN"), (7, "99.49"), (8, "Infinity"), (9, " 7 ")]
_CLAMPED = lambda hi: f"case when x is null or isnan(x) or isinf(x) then 0 else {'least(100, ' if hi else ''}greatest(0, floor(x + 0.5)){')' if hi else ''} end::bigint"


@query(
    f"""with {sql_values('c', 'id, raw', _NUMBERS)}, n as (select id, raw from c union all select o_orderkey + 100, (round(o_totalprice / 1000, 3) - 40)::varchar from orders), v as (select *, try_cast(trim(raw) as double) as x from n)
select id, {_CLAMPED(True)} as percent, {_CLAMPED(False)} as count, coalesce(nullif(trim(raw), ''), 'n/a') as safe from v"""
)
def trust_numbers(spark: SparkSession, d: str) -> DataFrame:
    rounded = F.round(F.col("o_totalprice") / 1000 * 1000) / 1000  # the double is rounded, as in SQL; F.round(x, 3) would round its decimal digits
    n = values(spark, "id long, raw string", _NUMBERS).unionByName(table(spark, d, "orders").select((F.col("o_orderkey") + 100).alias("id"), text.plain_number(rounded - 40).alias("raw")))
    raw = F.col("raw")
    return n.select("id", trust.percent(raw).alias("percent"), trust.count(raw).alias("count"), trust.safe_string(raw).alias("safe"))


_STATUS = "case o_orderkey % 6 when 0 then ' Verified ' when 1 then 'DISPUTED' when 2 then 'incorrect' when 3 then 'unknown' when 4 then '' end"


@query(f"with s as (select o_orderkey, lower(trim(coalesce({_STATUS}, ''))) as r from orders), t as (select *, case when r = 'verified' then r when r in ('disputed', 'incorrect') then 'disputed' else 'unverified' end as status from s) select o_orderkey, status, case when status = 'disputed' then status when o_orderkey % 5 = 0 then 'verified' else status end as final from t")
def claim_statuses(spark: SparkSession, d: str) -> DataFrame:
    status = trust.claim_status(F.expr(_STATUS))
    cited = F.expr("case when o_orderkey % 5 = 0 then array('u') else array() end")
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"), trust.final_status(status, cited).alias("final"))


_JSON = """case c_custkey % 7 when 0 then '{}' when 1 then 'no json' when 2 then concat('{"whats_missing":["- a', c_custkey, '"," ","b"],"so_what":{"near_term":["n"]},"framing":{"lens":"Human Impact "}}')
 when 3 then '{"whatsMissing":["x","y","z","1","2","3","4"],"soWhat":{"nearTerm":[],"longTerm":["l"]},"framing":{"lens":"other","emphasis":["e"],"languageNotes":["1","2","3","4","5"]}}'
 when 4 then concat('{"whats_missing":["', m, '"],"so_what":{"near_term":["n"]},"framing":{"lens":"security risk"}}') when 5 then concat('{"whats_missing":["w"],"so_what":{"near_term":["n"]},"framing":{"lens":"opinion/analysis","downplays":["', p, '"]}}') end"""
_STOCK = {"m": PLACEHOLDERS["whats_missing"][0], "p": PLACEHOLDERS["downplays"][1]}


@query(
    """select c_custkey, case c_custkey % 7 when 2 then 'a' || c_custkey || '|b' when 3 then 'x|y|z|1|2|3' when 4 then '%s' when 5 then 'w' end as missing, case when c_custkey %% 7 in (2, 4, 5) then 'n' when c_custkey %% 7 = 3 then '' end as near, case c_custkey %% 7 when 2 then 'human impact' when 3 then 'opinion/analysis' when 4 then 'security risk' when 5 then 'opinion/analysis' end as lens,
case when c_custkey %% 7 = 3 then '1|2|3|4' when c_custkey %% 7 in (2, 4, 5) then '' end as notes, c_custkey %% 7 <> 2 as placeholder, case when c_custkey %% 7 in (2, 3, 4, 5) then false else true end as filled from customer""".replace("c_custkey % 7 when 2 then 'a'", "c_custkey %% 7 when 2 then 'a'") % _STOCK["m"]
)
def trust_records(spark: SparkSession, d: str) -> DataFrame:
    """Records from JSON in either case, which of them are placeholders, and the fallback where there is none."""
    json = F.expr(_JSON.replace(", m, ", ", '" + _STOCK["m"] + "', ").replace(", p, ", ", '" + _STOCK["p"] + "', "))
    r = table(spark, d, "customer").select("c_custkey", trust.trust_fields(json).alias("t"))
    t = F.col("t")
    filled = F.coalesce(t, trust.fallback_trust())["whats_missing"][0] == PLACEHOLDERS["whats_missing"][0]
    return r.select("c_custkey", F.array_join(t["whats_missing"], "|").alias("missing"), F.array_join(t["so_what"]["near_term"], "|").alias("near"), t["framing"]["lens"].alias("lens"), F.array_join(t["framing"]["language_notes"], "|").alias("notes"), trust.is_placeholder(t).alias("placeholder"), (filled & t.isNull()).alias("filled"))


# -- settings and small fallbacks

#: Settings as texts: numbers, what begins with one, what doesn't, blanks, words for yes and no, lists.
_RAW = """case page_id % 12 when 0 then concat('', page_id) when 1 then concat('-', page_id) when 2 then concat(page_id, 'x') when 3 then concat('x', page_id) when 4 then '' when 6 then concat(page_id, '.5e2z') when 7 then ' YES ' when 8 then 'off' when 9 then concat('a', page_id, ', b,,c ') when 10 then '0' when 11 then concat('.', page_id) end"""


@query(
    rf"""with c as (select page_id as id, {_RAW} as raw from pages), p as (select *, try_cast(nullif(regexp_extract(raw, '^\s*([+-]?\d+)', 1), '') as bigint) as i, try_cast(nullif(regexp_extract(raw, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1), '') as double) as f, lower(trim(raw)) as b from c)
select id, case when i > 0 then i else 6 end as i, coalesce(f, 0.25) as f, case when b in ('1', 'true', 'yes', 'y', 'on') then true when b in ('0', 'false', 'no', 'n', 'off') then false else true end as b, array_to_string(case when coalesce(raw, '') = '' then ['deal'] else list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') end, '|') as l from p"""
)
def setting_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.expr(_RAW).alias("raw"))
    return rows.select("id", settings.int_setting(raw, 6).alias("i"), settings.float_setting(raw, 0.25).alias("f"), settings.bool_setting(raw, True).alias("b"), F.array_join(settings.list_setting(raw, ["deal"]), "|").alias("l"))


@query(
    """with c as (select conv_id, list(text order by turn) as c, max(turn) as n from conversations group by 1)
select conv_id, coalesce(substr(case when conv_id % 4 > 0 then c[1] end, 1, 200), 'No audience reaction is available yet.') as reaction, '- ' || n || chr(10) || '- Only the headline was available for this item.' as title_only from c"""
)
def fallback_texts(spark: SparkSession, d: str) -> DataFrame:
    """Reactions and headline bullets where no model is asked."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("xs"), F.max("turn").alias("n"))
    comments = F.when(F.col("conv_id") % 4 > 0, F.transform("xs", lambda x: x["text"])).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", enrich.reaction(comments).alias("reaction"), F.array_join(enrich.title_only(F.col("n").cast("string")), "\n").alias("title_only"))


@query(rf"""select page_id, md5(concat_ws(chr(10) || chr(10), url, substr({_collapse("replace(replace(replace(replace(replace(" + _BARE + ", '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + chr(34) + "'), '&#39;', '''')")}, 1, 8000))) as digest from pages""")
def question_contexts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.insights import context

    return texts(spark, d, "pages").select("page_id", F.md5(context(F.col("url"), F.col("html"))).alias("digest"))

