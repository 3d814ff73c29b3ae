"""Queries of sources, joins, rankings and views over the test tables. Inputs that the tables lack are made from their rows by
expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, tags, text, trust, urls
from ..functions.values import BOOSTED_SOURCES, SOURCE_TYPES
from ..operators import aggregates, cluster, dedupe, enrich, filters, insights, joins, rank, views
from ..sources import feeds, sinks
from ..streaming import ingest
from . import build, serving
from .queries import _HAY, _TAGGED, _TOK, words_in
from .queries_text import NOW_S
from .registry import NOW, table, texts
from .registry import query as registered


#: Lines of orders, one of each number, as SQL.
LINES = "(select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_shipdate) as l_shipdate, min(l_extendedprice) as l_extendedprice from lineitem group by 1, 2)"


def query(sql: str | None = None):
    """Registers SQL in which lines stands for LINES."""
    return registered(sql and sql.replace("from lines", f"from {LINES}"))


# -- sources


@query(
    """select 's' || s_suppkey as source_id, 'rss' as kind, 'https://feeds.example/' || s_suppkey as url from supplier where s_suppkey % 3 > 0
union all select 'hackernews', 'hn', 'https://hn.algolia.com/api/v1/search_by_date?tags=story' union all select 'google-news:' || r_name, 'rss', 'https://news.google.com/rss/search?q=' || replace(r_name, ' ', '%20') || '&hl=en-US&gl=US&ceid=US:en' from region"""
)
def feed_catalogue(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.expr("case when s_suppkey % 3 > 0 then concat('https://feeds.example/', s_suppkey) end").alias("rss"))
    return feeds.catalogue(sources, table(spark, d, "region").select(F.col("r_name").alias("query")))


#: An RSS document a page: odd titles, links or guids, dates of three forms, images in five places.
_ITEM = """concat('<rss><channel><title>Feed</title><item><title>', case page_id % 7 when 0 then '  ' else concat(' Story &amp; ', page_id, ' ') end, '</title>', case when page_id % 3 > 0 then concat('<link> https://Site', page_id, '.org/a/?utm_x=1&amp;b=', page_id, ' </link>') else '' end,
 case page_id % 6 when 0 then concat('<guid>https://site.org/g', page_id, '</guid>') when 3 then '<guid>tag:none</guid>' else '' end, case page_id % 4 when 0 then '<isoDate>2024-01-02T03:04:05Z</isoDate>' when 1 then '<pubDate>Tue, 2 Jan 2024 03:04:06 +0000</pubDate>' when 2 then '<pubDate>never</pubDate>' else '' end,
 case page_id % 5 when 0 then '<enclosure url="/e.png"/>' when 1 then '<thumb/>' when 2 then '<content>&lt;p&gt;a&lt;img src="/c.png"&gt;&lt;/p&gt;</content>' else '' end, case when page_id % 2 = 0 then '<creator> Ann </creator>' else '<author>Bob</author>' end, '<contentSnippet>Some &lt;b&gt;bold&lt;/b&gt;  text</contentSnippet></item></channel></rss>')"""


@query(
    """with p as (select page_id, case when page_id % 3 > 0 then 'https://site' || page_id || '.org/a?b=' || page_id when page_id % 6 = 0 then 'https://site.org/g' || page_id end as url from pages)
select page_id, substr(sha256('feed|' || url), 1, 24) as id, 'Story & ' || page_id as title, url, (case page_id % 4 when 0 then 1704164645 when 1 then 1704164646 else 1706659200 end)::bigint as published, case when page_id % 2 = 0 then 'Ann' else 'Bob' end as author, 'Some bold text' as summary,
case when page_id % 3 > 0 then 'site' || page_id || '.org' else 'site.org' end as domain, case page_id % 5 when 0 then '/e.png' when 2 then '/c.png' else 'none' end as image from p where url is not null and page_id % 7 > 0"""
)
def rss_items_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Landed feed documents to items."""
    rows = feeds.parse_rss(table(spark, d, "pages").select("page_id", F.expr(_ITEM).alias("body")), "body")
    items = feeds.rss_items(rows, "feed", "editorial", F.timestamp_seconds(F.lit(1706659200)), keep=("page_id",))
    return items.select("page_id", "id", "title", "url", F.unix_seconds("published_at").alias("published"), "author", "summary", "domain", F.coalesce("image_url", F.lit("none")).alias("image"))


#: A document a page: RSS 2.0, Atom, RSS 1.0 in turn, or Atom with a prefix; of Atom, links of several kinds and texts of three types.
_MIXED = """concat(case page_id % 4 when 0 then '<rss xmlns:atom="http://www.w3.org/2005/Atom"><channel><atom:link href="http://self.org/"/><item>' when 1 then '<feed xmlns="http://www.w3.org/2005/Atom"><link href="http://feed.org/"/><entry>'
 when 2 then '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed</title></channel><item>' else '<x:feed xmlns:x="http://www.w3.org/2005/Atom"><x:entry>' end,
 case when page_id % 4 = 3 then concat('<x:title>Story ', page_id, '</x:title><x:link href="http://site.org/', page_id, '"/><x:published>2024-01-02T03:04:05Z</x:published><x:author><x:name>Ann</x:name></x:author><x:summary type="html">&lt;i&gt;Some&lt;/i&gt; text</x:summary>')
 when page_id % 4 = 1 then concat('<title type="html">Story ', page_id, '</title><link rel="edit" href="http://edit.org/"/>', case when page_id % 3 = 0 then '' else concat('<link rel="alternate" href="http://site.org/', page_id, '"/>') end, '<id>http://id.org/', page_id, '</id><updated>2024-01-02T03:04:05Z</updated><author><name> Ann </name></author>',
  case page_id % 5 when 0 then '<content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>Some</p> <b>text</b></div></content>' when 1 then '<content type="html">&lt;p&gt;Some&lt;/p&gt; text</content>' else '<summary>Some &lt;p&gt; text</summary>' end)
 else concat('<title>Story ', page_id, '</title><link>http://site.org/', page_id, '</link><description>Some text</description>', case page_id % 4 when 0 then '<pubDate>Tue, 2 Jan 2024 03:04:05 +0000</pubDate><author>Ann</author>' else '<dc:date>2024-01-02T03:04:05Z</dc:date><dc:creator>Ann</dc:creator>' end) end,
 case page_id % 4 when 0 then '</item></channel></rss>' when 1 then '</entry></feed>' when 2 then '</item></rdf:RDF>' else '</x:entry></x:feed>' end)"""


@query(
    """with p as (select page_id, case when page_id % 4 = 1 and page_id % 3 = 0 then 'http://edit.org/' else 'http://site.org/' || page_id end as url from pages)
select page_id, case page_id % 4 when 0 then 'rss' when 2 then 'rdf' else 'atom' end as format, substr(sha256('feed|' || url), 1, 24) as id, 'Story ' || page_id as title, url, 1704164645::bigint as published, 'Ann' as author,
case when page_id % 4 = 1 and page_id % 5 > 1 then 'Some <p> text' else 'Some text' end as summary from p"""
)
def mixed_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Landed documents of three formats in one scan."""
    rows = feeds.parse_rss(texts(spark, d, "pages").select("page_id", F.expr(_MIXED).alias("body")), "body")
    items = feeds.rss_items(rows, "feed", "editorial", F.timestamp_seconds(F.lit(0)), keep=("page_id", "format"))
    return items.select("page_id", "format", "id", "title", "url", F.unix_seconds("published_at").alias("published"), "author", "summary")


@query()  # SQL has no parser; tests compare with a tree of the page
def article_texts(spark: SparkSession, d: str) -> DataFrame:
    """What each address's last landed page gives: canonical URL, image, article."""
    pages = texts(spark, d, "pages").select("page_id", "url", "html")
    landed = dedupe.latest(pages, F.col("url"), F.col("page_id"), F.col("page_id"))
    out = feeds.extracted(pages.select("page_id", "url"), landed.select("url", "html"))
    return out.select("page_id", "canonical_url", F.coalesce("page_image", F.lit("none")).alias("image"), F.length("extracted_text").cast("long").alias("n"), F.md5("extracted_text").alias("digest"))


@query(
    """with s as (select s_suppkey as k, s_suppkey % 5 as source, 's' || s_suppkey % 5 as name from supplier), i as (select page_id, page_id % 5 as source, case when page_id % 3 > 0 then 'https://x.org/' || page_id % 40 else 'https://y.org/' || page_id end as url, 1704067200 + page_id % 50 as since from pages where page_id % 5 <> 2 and page_id % 11 > 0),
r as (select *, row_number() over (partition by url order by since desc, source, page_id) as r from i) select substr(sha256('k' || source || '|' || url), 1, 24) as id, url, since as published, 'Source ' || source as source from r where r = 1"""
)
def serving_feed(spark: SparkSession, d: str) -> DataFrame:
    """The serving catalogue's feeds as one: a feed that failed or can't be parsed is left out, the newest item of each URL stays."""
    p = table(spark, d, "pages").withColumn("source", F.col("page_id") % 5)
    item = F.expr("concat('<item><title>T', page_id, '</title><link>', case when page_id % 3 > 0 then concat('https://x.org/', page_id % 40) else concat('https://y.org/', page_id) end, '</link><isoDate>2024-01-01T00:00:', lpad(page_id % 50, 2, '0'), 'Z</isoDate></item>')")
    bad = F.expr("case when page_id % 11 = 0 then '<item><title></title></item>' end")
    body = p.groupBy("source").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", F.coalesce(bad, item).alias("x")))), lambda s: s["x"]), ""), F.lit("</channel></rss>")).alias("body"))
    landed = body.withColumn("body", F.when(F.col("source") == 2, "<rss><chan").otherwise(F.col("body")))
    catalogue = spark.range(6).select(F.col("id").alias("source"), F.concat(F.lit("k"), "id").alias("source_id"), F.concat(F.lit("Source "), "id").alias("source_name"), F.lit("editorial").alias("source_type"))
    out = serving.feed(catalogue, landed, "source", F.timestamp_seconds(F.lit(0)))
    return out.select("id", "url", F.unix_seconds("published_at").alias("published"), "source")


@query(
    """with e as (select *, event_id % 13 as page from events where event_id % 13 between 1 and 4) select substr(sha256('hackernews|https://h.org/' || event_id), 1, 24) as id, 'Title ' || event_id as title, 'https://h.org/' || event_id as url, floor(epoch(ts))::bigint as published, user_id::varchar as author, case when event_id % 4 = 0 then 'a b' else '' end as summary, event_id as item, event_id % 100 as score from e where page <> 3 and event_id % 5 > 0"""
)
def search_hit_items(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a forum's search, the first four of them: a corrupt page is empty, hits without a URL go."""
    hit = F.expr("""concat('{"objectID":"', event_id, '","title":" Title ', event_id, '","url":', case when event_id % 5 = 0 then 'null' else concat('"https://h.org/', event_id, '/#x"') end, ',"author":"', user_id, '","created_at":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z","points":', event_id % 100, case when event_id % 4 = 0 then ',"story_text":"<p>a <b>b</b>"' else '' end, '}')""")
    e = table(spark, d, "events").withColumn("page", F.col("event_id") % 13).withColumn("part", F.col("event_id") % 40)
    bodies = e.groupBy("page", "part").agg(F.concat(F.lit('{"hits":['), F.array_join(F.collect_list(hit), ","), F.lit("]}")).alias("body"))
    bodies = bodies.withColumn("body", F.when(F.col("page") == 3, F.lit('{"hits":[{')).otherwise(F.col("body")))
    items = feeds.hit_items(feeds.hit_rows(bodies.where("page > 0"), 4), F.timestamp_seconds(F.lit(0)))
    return items.select("id", "title", "url", F.unix_seconds("published_at").alias("published"), "author", "summary", F.col("signals.id").alias("item"), F.col("signals.score").alias("score"))


@query("select page_id, coalesce(d.source, 'none') as by from (select page_id, case when page_id % 3 = 0 then page_id * 2 end as i from pages) left join documents d on i = d.doc_id")
def forum_item_lookup(spark: SparkSession, d: str) -> DataFrame:
    stories = table(spark, d, "pages").select("page_id", F.expr("case when page_id % 3 = 0 then concat('https://news.ycombinator.com/item?id=', page_id * 2) else url end").alias("url"))
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("by"))
    return feeds.with_item(stories, items).select("page_id", F.coalesce("item.by", F.lit("none")).alias("by"))


_COMMENT = "case p_partkey % 5 when 0 then '<p> </p>' when 1 then concat('<i>', p_name, '</i> &amp;') else p_name end"


@query(
    """with k as (select l_orderkey as story, l_linenumber as pos, p_partkey, case p_partkey % 5 when 0 then '' when 1 then p_name || ' &amp;' else p_name end as c from lines join part on l_partkey = p_partkey where p_size % 4 > 0), r as (select *, row_number() over (partition by story order by pos) as r from k where c <> '') select story, string_agg(c, '|' order by r) as comments from r where r <= 3 group by 1"""
)
def forum_top_comments(spark: SparkSession, d: str) -> DataFrame:
    """The first three comments of each story: kids that are no comments, unknown or blank don't count."""
    stories = _lines(spark, d).groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("kids"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 > 0, "comment").otherwise("job").alias("type"), F.expr(_COMMENT).alias("text"))
    return feeds.top_comments(stories, items).select("story", F.array_join("comments", "|").alias("comments"))


_BODY = "case turn % 4 when 1 then '[deleted]' when 3 then '  ' else text end"


@query(f"with b as (select conv_id, turn, trim({_BODY}) as t from conversations), r as (select *, row_number() over (partition by conv_id order by turn) as r from b where t not in ('', '[deleted]', '[removed]')) select c.conv_id, coalesce(string_agg(t, '|' order by r), '') as comments from (select distinct conv_id from conversations) c left join r on c.conv_id = r.conv_id and r <= 3 group by 1")
def thread_top_comments(spark: SparkSession, d: str) -> DataFrame:
    child = F.struct(F.struct(F.expr(_BODY).alias("body")).alias("data"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", child.alias("c")))), lambda x: x["c"]).alias("children"))
    listing = F.concat(F.lit('[{"data":{}},'), F.to_json(F.struct(F.struct("children").alias("data"))), F.lit("]"))
    return c.select("conv_id", F.array_join(feeds.thread_comments(listing), "|").alias("comments"))


@query("select page_id, page_id % 2 = 0 as found, md5(case when page_id % 2 = 0 then html end) as digest from pages")
def landed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Items with what their landed pages hold; a page that wasn't landed gives nothing."""
    p = table(spark, d, "pages")
    items = p.select("page_id", F.concat("url", F.lit("#"), "page_id").alias("url"))
    landed = p.where("page_id % 2 = 0").select(F.concat("url", F.lit("#"), "page_id").alias("url"), "html")
    return items.join(landed, "url", "left").select("page_id", F.col("html").isNotNull().alias("found"), F.md5("html").alias("digest"))


_POST = {"url": "case event_id % 5 when 0 then concat('https://e.org/', event_id) when 1 then concat('https://m.org/', event_id) when 2 then concat('https://t.org/', event_id) end"}


@query(
    f"""with e as (select event_id, user_id, event_type, ts, {_POST["url"]} as url, case when event_id % 7 = 0 then '  ' else event_type || ' ' || event_id || case when event_id % 5 = 2 then ' see https://t.org/' || event_id || ')' else '' end end as t from events)
select event_id, substr(sha256('at://u/' || event_id), 1, 24) as id, case when event_id % 5 = 0 and event_id % 3 = 0 then 'Card ' || event_id when length(trim(t)) >= 8 then substr(trim(t), 1, 90) else 'Post from @h' || user_id end as title, coalesce(url, 'none') as url, 'https://bsky.app/profile/h' || user_id || '/post/' || event_id as post_url, floor(epoch(ts))::bigint as published, event_id % 9 as likes from e where trim(t) <> ''"""
)
def social_post_items(spark: SparkSession, d: str) -> DataFrame:
    """Posts with links in a card, in media within media, or in the text; blank ones go."""
    e = table(spark, d, "events")
    external = lambda host: f"named_struct('uri', concat('https://{host}.org/', event_id), 'title', case when event_id % 3 = 0 then concat('Card ', event_id) end)"
    body = "case when event_id % 7 = 0 then '  ' else concat(event_type, ' ', event_id, case when event_id % 5 = 2 then concat(' see https://t.org/', event_id, ')') else '' end) end"
    posts = e.select(
        "event_id", F.concat(F.lit("at://u/"), "event_id").alias("uri"), F.lit("c").alias("cid"), F.struct(F.lit("n").alias("displayName"), F.concat(F.lit("h"), "user_id").alias("handle")).alias("author"), F.struct(F.expr(body).alias("text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt")).alias("record"), F.lit(None).cast("string").alias("indexedAt"),
        F.expr("case when event_id % 9 > 0 then event_id % 9 end").cast("long").alias("likeCount"), F.lit(None).cast("long").alias("repostCount"), F.lit(1).cast("long").alias("replyCount"),
        F.expr(f"case event_id % 5 when 0 then to_json(named_struct('$type', 'app.bsky.embed.external', 'external', {external('e')})) when 1 then to_json(named_struct('$type', 'app.bsky.embed.recordWithMedia', 'media', named_struct('$type', 'app.bsky.embed.record', 'record', named_struct('$type', 'app.bsky.embed.external', 'external', {external('m')})))) when 3 then '{{\"$type\":\"app.bsky.embed.images\"}}' end").alias("embed"),
    )
    items = feeds.post_items(posts, F.timestamp_seconds(F.lit(0)), keep=("event_id",))
    return items.select("event_id", "id", "title", F.coalesce("url", F.lit("none")).alias("url"), "post_url", F.unix_seconds("published_at").alias("published"), "likes")


@query("select page_id, case when page_id % 6 in (3, 4) then '' when page_id % 6 = 5 then 'a' || page_id || '|second' else 'a' || page_id || '|b|c' end as ids from pages")
def group_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Each page's group files, of each shape; what is no such file is passed over for the next one."""
    rows = """concat('[{"id":"a', page_id, '","perspectives":[]},{"id":"b"},{"id":"c"}]')"""
    first = F.expr(f"""case page_id % 6 when 0 then {rows} when 1 then concat('{{"clusters":', {rows}, '}}') when 2 then concat('{{"groups":', {rows}, '}}') when 3 then '{{"items":[]}}' when 4 then '{{[' end""")
    second = F.expr("""case when page_id % 6 = 5 then concat('[{"id":"a', page_id, '"},{"id":"second"}]') end""")
    p = table(spark, d, "pages")
    files = p.select("page_id", F.lit(0).alias("place"), first.alias("body")).unionByName(p.select("page_id", F.lit(1).alias("place"), second.alias("body")))
    return feeds.group_files(files, "page_id", "place", "body", "id string").select("page_id", F.coalesce(F.array_join("rows.id", "|"), F.lit("")).alias("ids"))


#: Attempts k of a page: some answer at once, some in time, some too late, never, or with what asking again doesn't change.
_STATUS = """case page_id % 7 when 0 then 200 when 1 then case when k >= page_id % 3 then 204 else 503 end when 2 then 404 when 3 then 429 when 4 then case when k > 2 then 200 else 500 end when 5 then case when k = 0 then 429 else 301 end end"""


@query(
    f"""with a as (select page_id, k, {_STATUS} as status from pages, range(0, 5) t(k) where k <= page_id % 5), r as (select *, row_number() over (partition by page_id order by k desc) as r from a where k <= 2),
s as (select page_id, k, status, case when status between 200 and 299 then 'good' when status is not null and status <> 429 and status < 500 then 'refused' when k = 2 then 'exhausted' else 'waiting' end as state from r where r = 1)
select page_id, state, k::int as attempt, coalesce(status, 0)::int as status, case when state = 'waiting' then 1000000 + 60000 * k + greatest(floor(500 * pow(2, k) * (('0x' || substr(md5(page_id || '|' || k), 1, 4))::int / 65536 * 0.6 + 0.7)), case when status = 429 then coalesce(case when page_id % 2 = 0 then page_id % 3 end, 0) * 1000 else 0 end) else 0 end::bigint as due_ms from s"""
)
def fetch_schedule(spark: SparkSession, d: str) -> DataFrame:
    """What the landed attempts of each page's address come to, and when those that are left are due again."""
    p = table(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 5).cast("int"))).alias("k"))
    attempts = p.select(F.col("page_id").cast("string").alias("url"), F.col("k").alias("attempt"), F.expr(_STATUS).alias("status"), (F.col("k") * 60000 + 1000000).alias("at_ms"), F.expr("case when page_id % 2 = 0 then page_id % 3 end").alias("retry_after"))
    out = feeds.fetch_states(attempts)
    return out.select(F.col("url").cast("long").alias("page_id"), "state", "attempt", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("due_ms", F.lit(0)).alias("due_ms"))


@query("select event_id, case when event_id % 4 = 0 then event_id % 3 + 1 else 0 end as attempts, event_id % 4 = 0 as settled from events")
def settled_fetches(spark: SparkSession, d: str) -> DataFrame:
    """The first good response among a request and its two retries; a fourth attempt doesn't count, a failed request gives none."""
    e = table(spark, d, "events").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(4))))
    good = F.expr("(event_id % 4 = 0 and attempt >= event_id % 3) or (event_id % 4 = 1 and attempt > 2)")
    attempts = e.select(F.col("event_id").alias("url"), "attempt", F.when(good, 200).otherwise(503).alias("status"), F.concat(F.lit("b"), "attempt").alias("body"))
    out = feeds.settled(attempts, retries=2)
    every = table(spark, d, "events").select(F.col("event_id").alias("url")).join(out, "url", "left")
    return every.select(F.col("url").alias("event_id"), F.coalesce(F.col("attempt") + 1, F.lit(0)).cast("long").alias("attempts"), F.col("body").isNotNull().alias("settled"))


# -- dedupe and sets


_KEYS = "case when event_id % 3 = 0 then concat('u', user_id) end as url, case when event_id % 3 = 1 then concat('u', user_id) when event_id % 3 = 2 and event_id % 2 = 0 then concat('p', event_type) end as post_url, concat('i', event_id) as id"


@query(f"with k as (select event_id, ts, coalesce(url, post_url, id) as key from (select event_id, ts, {_KEYS} from events)), r as (select *, min(event_id) over (partition by key) as slot, row_number() over (partition by key order by ts desc, event_id) as r from k) select key, event_id, slot from r where r = 1")
def serving_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "ts", *_KEYS.replace(", case", "\n, case").replace(", concat('i'", "\n, concat('i'").split("\n, "))
    e = e.withColumn("key", dedupe.item_key())
    return dedupe.latest(e, F.col("key"), F.col("ts"), F.col("event_id")).select("key", "event_id", "slot")


@query(
    """with recursive p as (select user_id % 40 as b, event_id, event_type || (user_id % 7) as k, case when event_id % 6 = 0 then '' else lower(event_type) || ' ' || event_id % 11 end as t, row_number() over (partition by user_id % 40 order by event_id) as pos from events),
s(b, pos, event_id, keep, keys, texts) as (select b, 0::bigint, null::bigint, false, []::varchar[], []::varchar[] from p group by b
 union all select s.b, p.pos, p.event_id, not (list_contains(s.keys, p.k) or (p.t <> '' and list_contains(s.texts, p.t))), case when list_contains(s.keys, p.k) or (p.t <> '' and list_contains(s.texts, p.t)) then s.keys else list_append(s.keys, p.k) end,
 case when list_contains(s.keys, p.k) or p.t = '' or list_contains(s.texts, p.t) then s.texts else list_append(s.texts, p.t) end from s join p on p.b = s.b and p.pos = s.pos + 1)
select event_id from s where keep"""
)
def social_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("b", F.col("user_id") % 40)
    words = F.expr("case when event_id % 6 = 0 then ' ' else concat(upper(event_type), '  ', event_id % 11) end")
    return dedupe.social(e, "b", F.concat("event_type", F.col("user_id") % 7), words, F.col("event_id")).select("event_id")


@query(r"with p as (select page_id, page_id % 9 as g, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', ''), '') as domain from pages) select g, domain, min(page_id) as page_id from p where domain is not null group by 1, 2")
def first_by_domain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 9).alias("g"), urls.domain(F.col("url")).alias("domain"))
    return dedupe.first_by_domain(p, F.col("g"), F.col("domain"), F.col("page_id")).select("g", "domain", "page_id")


@query("select event_type as connector, count(*) as n, count(distinct user_id) as ids from events group by 1")
def connector_counts(spark: SparkSession, d: str) -> DataFrame:
    return insights.connector_counts(table(spark, d, "events").withColumn("id", F.col("user_id")), F.col("event_type"))


@query("select o_orderkey as id, 'o' as kind, o_totalprice as v from orders where o_orderkey % 2 = 0 union all select l_orderkey, 'l', max_by(l_extendedprice, -l_linenumber) from lines where l_orderkey not in (select o_orderkey from orders where o_orderkey % 2 = 0) group by 1")
def articles_and_feed(spark: SparkSession, d: str) -> DataFrame:
    """Orders, and the first line of each order that is not among them."""
    articles = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("o").alias("kind"), F.col("o_totalprice").alias("v"))
    feed = _lines(spark, d).select(F.col("l_orderkey").alias("id"), F.lit("l").alias("kind"), F.col("l_extendedprice").alias("v"), F.col("l_linenumber").alias("seq"))
    return joins.with_missing(articles.withColumn("seq", F.lit(0)), feed, "id").select("id", "kind", "v")


@query(
    """with t as (select event_id, row_number() over (order by event_id) as k from events where event_type <> 'click'), q as (select event_id, user_id % 8 as query, row_number() over (partition by user_id % 8 order by event_id) as k from events where event_type = 'click'),
u as (select event_id, -1 as query, k from t where k <= 50 union all select event_id, query, k from q where query < 6 and k <= 25) select event_id, row_number() over (order by query, k) as seq from u"""
)
def timeline_and_searches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("seq", F.col("event_id"))
    searches = e.where("event_type = 'click'").withColumn("query", F.col("user_id") % 8).select("event_id", "query", "seq")
    return serving.fetched(e.where("event_type <> 'click'").select("event_id", "seq"), searches).select("event_id", "seq")


@query("with c as (select event_id, user_id, ts, event_type from events where event_type <> 'purchase'), r as (select *, row_number() over (partition by user_id order by event_type = 'click', event_id) as r from c) select event_id, user_id from r where r = 1")
def connectors_merged(spark: SparkSession, d: str) -> DataFrame:
    """Rows of enabled connectors after the feed's own; the first of each key stays."""
    e = table(spark, d, "events")
    e = e.withColumn("event_type", F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")).otherwise("view"))
    row = lambda kind: e.where(F.col("event_type") == kind).select("event_id", "user_id", "event_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("post_url"), F.col("user_id").cast("string").alias("id"), "event_type")
    rows = {kind: row(kind).toDF("event_id", "user_id", "seq", "url", "post_url", "id", "event_type") for kind in ("view", "click", "purchase")}
    out = serving.merged(rows["view"], {"clicks": rows["click"], "purchases": rows["purchase"]}, enabled={"clicks"})
    return out.select("event_id", "user_id")


# -- rankings


_PLAIN_TEXT = r"' ' || trim(regexp_replace(regexp_replace(replace(lower(coalesce(d.text, '')), '&', ' and '), '[^a-z0-9\t-\r ]', ' ', 'g'), '[\t-\r ]+', ' ', 'g')) || ' '"
_SCORED = f"""{_TAGGED}, m as (select t.doc_id, d.n_chars, array_to_string(t.tags, ' ') as j, {_PLAIN_TEXT} as b, t.tags from t join documents d using (doc_id)),
p as (select *, (case when list_contains(tags, 'ai') then 3 else 0 end + case when contains(j, 'ai') then 2 else 0 end + case when contains(b, 'ai') then 1 else 0 end + case when list_contains(tags, 'security') then 3 else 0 end + case when contains(j, 'security') then 2 else 0 end + case when contains(b, 'security') then 1 else 0 end)::int as score, contains(j, 'policy') as blocked from m)"""


@query(f"{_SCORED} select doc_id, score, blocked, (row_number() over (order by blocked, score desc, n_chars desc, doc_id))::int as rank from p")
def pref_rank(spark: SparkSession, d: str) -> DataFrame:
    """All documents in a reader's order, n_chars standing for their time."""
    docs = texts(spark, d).withColumn("tags", tags.topic_tags(F.col("text"), F.lit("")))
    rows = rank.by_preferences(docs, ["AI", "security", "AI"], ["policy"], F.col("tags"), F.col("text"), F.col("n_chars"), F.col("doc_id"))
    return rank.ranked(rows.select("doc_id", "score", "blocked", "_ts", "_seq"), rank.preference_order()).select("doc_id", "score", "blocked", F.col("rank").cast("int").alias("rank"))


_BOOST = "(" + " or ".join(f"contains(lower(s), '{w}')" for w in BOOSTED_SOURCES) + ")"
_NAME = "case when l_linenumber % 4 = 0 then concat('Re', 'uters ', l_suppkey) else concat('Zzq ', l_suppkey) end"
_CARDS = "select l_orderkey, l_linenumber, l_suppkey, l_shipdate, {name} as s from lines".replace("{name}", _NAME)


@query(
    f"""with l as ({_CARDS}), g as (select l_orderkey, count(*)::int as n, bool_or({_BOOST}) as boosted, max(l_shipdate) as since, (case when l_orderkey % 3 = 0 then 1 else 0 end + case when l_orderkey % 5 = 0 then 1 else 0 end)::int as topics from l group by 1)
select l_orderkey as id, n, (row_number() over (order by case when boosted then 3 else 0 end desc, topics desc, n desc, since desc, l_orderkey))::int as rank from g"""
)
def group_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    """All groups in order: well-known sources, wanted topics, perspectives, newest."""
    topics = F.expr("array_compact(array(case when l_orderkey % 3 = 0 then 'AI' end, case when l_orderkey % 5 = 0 then 'Data' end, 'Space'))")
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.expr(_NAME).alias("source"))).alias("perspectives"), F.max("l_shipdate").alias("created_at"))
    g = g.withColumn("topic_tags", topics).select(F.col("l_orderkey").alias("id"), *(c.alias(k) for k, c in rank.group_keys(["ai", "Data"]).items()))
    return rank.ranked(g, [*rank.group_order(), F.asc("id")]).select("id", F.col("_n").alias("n"), F.col("rank").cast("int").alias("rank"))


_SUMMARY = "case l_orderkey % 3 when 0 then concat('- one', chr(10), '- two') when 1 then '- Key points: x' end"
_PICTURE = "case l_orderkey % 4 when 0 then '/img/a.png' when 1 then '/globe.svg' when 2 then '/data/placeholder.svg' end"


@query(f"with l as ({_CARDS}), g as (select l_orderkey, count(*) as n, count(distinct lower(s)) as k, bool_or({_BOOST}) as b from l group by 1) select l_orderkey as id, (case when l_orderkey % 3 = 0 then 6 else 0 end + case when l_orderkey % 4 = 0 then 3 else 0 end + least(2, n - 1) + least(2, k - 1) + case when b then 3 else 0 end)::int as score from g")
def card_scores(spark: SparkSession, d: str) -> DataFrame:
    g = _lines(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.expr(_NAME)).alias("sources"))
    return g.select(F.col("l_orderkey").alias("id"), rank.card_score(F.expr(_SUMMARY), F.expr(_PICTURE), F.col("sources")).alias("score"))


@query("select o_orderkey as id, (row_number() over (order by o_orderkey % 4 > 0, o_orderkey))::int as rank, o_orderkey % 4 > 0 as placeholder, not (o_orderkey % 4 in (0, 1)) as saved_placeholder from orders")
def images_first(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr(_PICTURE.replace("l_orderkey", "o_orderkey"))
    rows = table(spark, d, "orders").withColumn("url", url)
    out = rank.ranked(rows, rank.images_first(F.col("o_orderkey"), F.col("url")))
    return out.select(F.col("o_orderkey").alias("id"), F.col("rank").cast("int").alias("rank"), filters.placeholder_image(F.col("url")).alias("placeholder"), filters.placeholder_image(F.col("url"), False).alias("saved_placeholder"))


@query(f"{_SCORED}, f as (select doc_id, n_chars, source, (source = 'src0') as social, row_number() over (partition by source = 'src0' order by n_chars desc, doc_id) as k, count(*) filter (where source <> 'src0') over () as others from m join documents using (doc_id, n_chars)), s as (select *, case when not social then k when k * 5 <= others then k * 5 else 4611686018427387903 end as slot from f), o as (select *, row_number() over (order by slot, social, k) as position from s) select doc_id, (row_number() over (order by blocked, score desc, o.n_chars desc, position))::int as rank from o join p using (doc_id)")
def ranked_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed with social rows interleaved, then in the reader's order."""
    docs = texts(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("post_url"), "source", F.when(F.col("source") == "src0", "social").otherwise("editorial").alias("source_type"), F.lit("").alias("title"), "text", tags.topic_tags(F.col("text"), F.lit("")).alias("tags"), F.col("n_chars").alias("published_at"), F.col("doc_id").alias("seq"))
    out = serving.rank_items(docs, serving.Preferences(["AI", "security"], ["policy"]))
    return out.select(F.col("seq").alias("doc_id"), F.col("rank").cast("int").alias("rank"))


# -- joins of snapshots


@query("select o_orderkey as id, case when o_orderkey % 3 = 0 then 's' || o_custkey else '' end as summary, '' as impact, array_to_string(coalesce(u, []), '|') as citations from orders left join (select l_orderkey, list_filter(l, lambda x, i: list_position(l, x) = i) as u from (select l_orderkey, list('u' || l_suppkey % 3 order by l_linenumber) as l from lines group by 1)) on l_orderkey = o_orderkey")
def cluster_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Groups with what was found about them, blank where nothing was, and the URLs they cite."""
    o = table(spark, d, "orders")
    p = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("u"), F.col("l_suppkey") % 3).alias("url")))).alias("perspectives"))
    groups = o.select(F.col("o_orderkey").alias("id")).join(p, F.col("id") == F.col("l_orderkey"), "left").withColumn("perspectives", F.coalesce("perspectives", F.array().cast(p.schema["perspectives"].dataType)))
    analysis = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), "o_custkey").alias("summary"), *(F.lit(None).cast("string").alias(c) for c in ("facts", "missing", "impact")))
    out = views.story_group_table(groups, analysis)
    return out.select("id", F.col("analysis.summary").alias("summary"), F.col("analysis.impact").alias("impact"), F.array_join("citations", "|").alias("citations"))


@query("select c_custkey as id, coalesce('out' || n, 'none') as output, coalesce('re' || m, 'none') as reaction from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) f on f.o_custkey = c_custkey left join (select o_custkey, count(*) as m from orders where o_orderstatus = 'O' group by 1) o on o.o_custkey = c_custkey")
def article_outputs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    made = lambda status, tag, name: o.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit(tag), F.count("*")).alias(name))
    out = views.articles(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), made("F", "out", "output"), made("O", "re", "reaction"))
    return out.select("id", F.coalesce("output", F.lit("none")).alias("output"), F.coalesce("reaction", F.lit("none")).alias("reaction"))


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 'new' || c_custkey || '|x' else 'old' end as tags from customer")
def tags_pushed(spark: SparkSession, d: str) -> DataFrame:
    """Tags are replaced where there are new ones; an empty list changes nothing."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.lit("old")).alias("tags"))
    new = table(spark, d, "customer").where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.expr("case when c_custkey % 3 = 0 then array(concat('new', c_custkey), 'x') else array() end").alias("tags"))
    return joins.updated(c, new, "id", "tags").select("id", F.array_join("tags", "|").alias("tags"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders, one of each number."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders as groups, their lines as perspectives."""
    p = F.struct("l_linenumber", F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.concat(F.lit("u"), "l_suppkey").alias("url"), F.concat(F.lit("S"), F.col("l_suppkey") % 10).alias("source"), F.lit("old").alias("summary"))
    return _lines(spark, d).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(p)).alias("perspectives")).withColumn("summary", F.lit("own"))


@query("with p as (select l_orderkey as id, l_linenumber as k, case when l_linenumber % 3 = 0 then 'n' || l_suppkey when l_linenumber % 3 = 1 then '' else 'old' end as s from lines) select id, string_agg(s, '|' order by k) as summaries, coalesce(first(s order by k) filter (where k % 3 = 0), 'own') as summary from p group by 1")
def perspective_summaries(spark: SparkSession, d: str) -> DataFrame:
    """New summaries within groups; an empty one is put in as well, but isn't the group's."""
    new = _lines(spark, d).where("l_linenumber % 3 < 2").select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("id"), F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("n"), "l_suppkey")).otherwise("").alias("summary"))
    return joins.with_new_summaries(_groups(spark, d), new).select("id", F.array_join("perspectives.summary", "|").alias("summaries"), "summary")


@query("with f as (select l_orderkey as id, min(l_linenumber) as k from lines group by 1) select f.id, case when k % 2 = 0 then 'none' else 't' || (id % 4 + 1) end as trust from f")
def trust_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """The trust record of a group's first perspective; of several entries of an id the last counts."""
    li = _lines(spark, d).where("l_linenumber % 2 = 1").select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("id"), "l_orderkey")
    records = li.withColumn("seq", F.explode(F.sequence(F.lit(0), (F.col("l_orderkey") % 4).cast("int")))).select("id", "seq", F.concat(F.lit("t"), F.col("seq") + 1).alias("trust"))
    return joins.with_trust(_groups(spark, d), records).select("id", F.coalesce("trust", F.lit("none")).alias("trust"))


@query("select max(l_orderkey) || '-1' as id, max(l_orderkey) as group_id from lineitem where l_linenumber = 1 union all select 'solo', -1")
def article_with_group(spark: SparkSession, d: str) -> DataFrame:
    """One item with the group that holds it, and one that no group holds."""
    wanted = table(spark, d, "lineitem").where("l_linenumber = 1").agg(F.max("l_orderkey")).first()[0]  # which item is asked for
    items = spark.createDataFrame([(f"{wanted}-1",), ("solo",), ("other",)], "id string")
    found = views.article(items, _groups(spark, d), f"{wanted}-1").unionByName(views.article(items, _groups(spark, d), "solo"))
    return found.select("id", F.coalesce("group_id", F.lit(-1)).cast("long").alias("group_id"))


@query(
    """with d as (select 'k' || s_suppkey as id, 'Name ' || s_suppkey as name, true as enabled, s_suppkey as seq from supplier), o as (select case when c_custkey % 2 = 0 then 'k' || c_custkey else 'z' || c_custkey end as id, case when c_custkey % 3 = 0 then 'NAME ' || c_custkey % 50 else 'Own ' || c_custkey end as name, c_custkey % 5 > 0 as enabled, c_custkey as seq from customer),
n as (select lower(name) as name, max_by(enabled, seq) as enabled from o group by 1), m as (select d.id, d.name, coalesce(o.enabled, n.enabled, d.enabled) as enabled from d left join o on d.id = o.id left join n on lower(d.name) = n.name)
select * from m union all select id, name, enabled from o where id not in (select id from d) and lower(name) not in (select lower(name) from d)"""
)
def source_preferences_merged(spark: SparkSession, d: str) -> DataFrame:
    defaults = table(spark, d, "supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("id"), F.concat(F.lit("Name "), "s_suppkey").alias("name"), F.lit(True).alias("enabled"), F.col("s_suppkey").alias("seq"))
    own = table(spark, d, "customer").selectExpr("case when c_custkey % 2 = 0 then concat('k', c_custkey) else concat('z', c_custkey) end as id", "case when c_custkey % 3 = 0 then concat('NAME ', c_custkey % 50) else concat('Own ', c_custkey) end as name", "c_custkey % 5 > 0 as enabled", "c_custkey as seq")
    return joins.source_preferences(defaults, own).select("id", "name", "enabled")


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 'before' when c_custkey % 2 = 0 then 'now' else 'none' end as reused, case when c_custkey % 2 = 0 then 'now' else 'none' end as forced from customer")
def summaries_reused(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "now").alias("s"))
    before = c.where("id % 3 = 0").select("id", F.lit("before").alias("s"))
    reused, forced = (joins.reused(c, before, "id", "s", f).select("id", F.coalesce("s", F.lit("none")).alias(n)) for f, n in ((False, "reused"), (True, "forced")))
    return reused.join(forced, "id")


@query("select c_custkey as id, case when c_custkey % 4 = 0 then 'kept' when c_custkey % 4 = 1 then 'replaced' else 'new' end as kind from customer")
def trust_backfilled(spark: SparkSession, d: str) -> DataFrame:
    """Records of known items: good ones stay, placeholders are made again, missing ones made."""
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    one = lambda word: F.from_json(F.lit(f'{{"whats_missing":["{word}"],"so_what":{{"near_term":["n"],"long_term":["l"]}},"framing":{{"lens":"human impact","emphasis":["e"],"downplays":[],"language_notes":[]}}}}'), trust.TRUST)
    old = items.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, one("kept")).otherwise(trust.fallback_trust()).alias("trust"))
    old = old.unionByName(spark.range(5).select((-F.col("id") - 1).alias("id"), one("stale").alias("trust")))
    made = items.select("id", one("made").alias("trust"))
    out = build.trust_backfill(items, old, made).select("id", F.col("trust.whats_missing")[0].alias("w"))
    return out.select("id", F.when(F.col("w") == "kept", "kept").when((F.col("id") % 4 == 1) & (F.col("w") == "made"), "replaced").when(F.col("w") == "made", "new").otherwise("wrong").alias("kind"))


@query("with k as (select c_custkey as id, c_custkey % 5 as key, c_custkey % 3 as since from customer), m as (select key, max(since) as since from k group by 1) select id, k.key as topics, k.since = 2 as fresh from k join m on k.key = m.key and k.since = m.since")
def stale_cache_read(spark: SparkSession, d: str) -> DataFrame:
    """The last cached batch of each topic key, however old, and whether it is still fresh."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).alias("topics"), F.timestamp_seconds(F.lit(1706659200) - 300 * (2 - F.col("c_custkey") % 3)).alias("fetched_at"))
    return joins.stale(rows, "topics", "fetched_at").select("id", "topics", (F.unix_seconds("fetched_at") > 1706659200 - 300).alias("fresh"))


@query("select doc_id as id, case when doc_id % 2 = 0 then 'cached' else 'Mine|' || upper(lang) || upper(lang) end as tags, 'Mine|' || upper(lang) || upper(lang) as anew from documents")
def tags_cached(spark: SparkSession, d: str) -> DataFrame:
    """Cached tags are kept, the rest made; all are made with overwrite."""
    items = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.upper("lang").alias("title"), F.lit("").alias("summary"))
    cache = items.where("id % 2 = 0").select("id", F.array(F.lit("cached")).alias("tags"))
    model = lambda rows, strict: [f'["# Mine -", "mine", "{t}{t}"]' for t in rows["title"]]
    a, b = build.retag(items, cache, model), build.retag(items, cache, model, overwrite=True)
    return a.select("id", F.array_join("tags", "|").alias("tags")).join(b.select("id", F.array_join("tags", "|").alias("anew")), "id")


# -- views


@query("select doc_id as id, md5(case when doc_id % 4 = 0 and trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' then text when doc_id % 3 = 0 then 'description' else 'summary' end) as digest, case doc_id % 6 when 0 then 'primary' when 1 then 'editorial' when 2 then 'community' when 3 then 'social' else 'editorial' end as kind from documents")
def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    types = F.get(F.array(*map(F.lit, SOURCE_TYPES)), (F.col("doc_id") % 6).cast("int"))
    items = texts(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(" ").alias("extracted_text"), F.when(F.col("doc_id") % 3 == 0, "description").alias("description"), F.lit("summary").alias("summary"), types.alias("source_type"))
    return views.feed_items(items).select("id", F.md5("text").alias("digest"), F.col("source_type").alias("kind"))


@query("with p as (select l_orderkey as id, l_linenumber as k, 'S' || l_suppkey % 10 as s from lines where l_suppkey % 10 not in (3, 4)) select id, string_agg(s, '|' order by k) as sources from p group by 1")
def groups_of_allowed_sources(spark: SparkSession, d: str) -> DataFrame:
    out = filters.allowed_perspectives(_groups(spark, d), ["s3", "s4"])
    return out.select("id", F.array_join("perspectives.source", "|").alias("sources"))


@query("select doc_id as id from documents where doc_id % 3 = 1 and 'u' || doc_id % 200 not in (select 'u' || l_suppkey from lines)")
def extra_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of unseen URLs with four bullets."""
    bullets = F.expr("case doc_id % 3 when 0 then array('a', 'b', 'c', ' ') when 1 then array('a', 'b', ' ', 'c', 'd') else array() end")
    cards = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id") % 200).alias("url"), bullets.alias("bullets"))
    return serving.unseen_cards(cards, _groups(spark, d)).select("id")


_VESTED = "case when doc_id % 2 = 0 then array('a', 'b') else array() end"


@query(
    """select 'solo:' || doc_id as id, case when doc_id % 3 = 0 then '- x' || chr(10) || '- y' when doc_id % 3 = 1 then '- Summary ' || lang else '- Summary not available.' end as summary, case when doc_id % 5 = 0 then '' else 'Vested interests: ' || case when doc_id % 2 = 0 then 'a; b' else 'Not specified.' end || chr(10) || 'Framing: f' || chr(10) || 'Confidence: 0.5' end as bias,
case when doc_id % 4 = 0 then '- m1' else '' end as missing, case doc_id % 3 when 0 then '- s' || chr(10) || '- l' when 1 then '- s' else '' end as impact, case when doc_id % 2 = 0 then 'u' || doc_id when doc_id % 7 > 0 then 'p' || doc_id else '' end as url, case when doc_id % 2 = 0 then 'u' || doc_id else '' end as citations from documents"""
)
def solo_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr(
        "cast(doc_id as string) as id", "source", "'editorial' as source_type", "'T' as title", "case when doc_id % 2 = 0 then concat('u', doc_id) end as url", "case when doc_id % 7 > 0 then concat('p', doc_id) end as post_url", "cast(null as timestamp) as published_at", "case when doc_id % 3 = 1 then concat('Summary ', lang) end as summary",
        "array('t') as tags", "cast(null as string) as image_url", "case when doc_id % 3 = 0 then array('x', 'y') end as bullets", f"case when doc_id % 5 > 0 then named_struct('vested', {_VESTED}, 'framing', array('f'), 'confidence', 0.5D) end as bias", "case when doc_id % 4 = 0 then array('m1') end as missing", "case when doc_id % 3 < 2 then array('s') end as short_term", "case when doc_id % 3 = 0 then array('l') end as long_term",
    )
    out = views.solo_groups(rows, F.lit(NOW).cast("timestamp"))
    return out.select("id", "analysis.summary", "analysis.bias", "analysis.missing", "analysis.impact", F.col("perspectives")[0]["url"].alias("url"), F.array_join("analysis.citations", "|").alias("citations"))


@query("select doc_id as id, case when doc_id % 2 = 0 then 'u' when doc_id % 3 = 0 then 'p' else 'https://bsky.app' end as url, case when doc_id % 4 = 0 then '/a.png' else '/globe.svg' end as image, doc_id % 60 || 'm ago' as published, md5(case when doc_id % 5 = 0 then text else lang end) as digest, source <> 'src0' as with_perspectives, 'Title: ' || source || chr(10) || 'Author: ' || case when doc_id % 2 = 0 then lang else 'Not specified' end as metadata from documents")
def item_stories(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select(
        F.col("doc_id").alias("id"), F.lit("t").alias("title"), F.col("lang").alias("summary"), F.expr("case when doc_id % 2 = 0 then 'u' end").alias("url"), F.expr("case when doc_id % 3 = 0 then 'p' end").alias("post_url"), F.expr("case doc_id % 4 when 0 then '/a.png' when 1 then 'https://x/b.png' end").alias("image_url"), "source", F.when(F.col("source") == "src0", "social").alias("source_type"),
        F.array().cast("array<string>").alias("tags"), (F.lit(NOW).cast("timestamp") - F.make_dt_interval(mins=F.col("doc_id") % 60)).alias("published_at"), F.expr("case when doc_id % 5 = 0 then coalesce(text, '') end").alias("text"),
    )
    out = views.item_stories(rows, F.lit(NOW).cast("timestamp"))
    metadata = views.metadata_text({"Title": F.col("source"), "Author": F.when(F.col("id") % 2 == 0, F.col("summary"))})
    return out.select("id", "url", F.col("image_url").alias("image"), "published", F.md5("text").alias("digest"), "with_perspectives", metadata.alias("metadata"))


@query(
    """with p as (select l_orderkey as id, list(case when l_linenumber % 2 = 0 then '- p' || l_linenumber || chr(10) || '- q' else '- only' end order by l_linenumber) as ps, list(case l_suppkey % 4 when 0 then 'primary' when 1 then 'social' else 'editorial' end order by l_linenumber) as ts from lines group by 1)
select id, case when id % 3 = 0 then 'a|b' when len(list_filter(ps, lambda x: contains(x, '- q'))) > 0 then replace(replace(list_filter(ps, lambda x: contains(x, '- q'))[1], '- ', ''), chr(10), '|') else 'T' end as bullets, array_to_string(ts, '|') as types from p"""
)
def group_stories(spark: SparkSession, d: str) -> DataFrame:
    """Groups as stories: their own bullets, or those of the first perspective that has two."""
    p = F.struct("l_linenumber", F.expr("case when l_linenumber % 2 = 0 then concat('- p', l_linenumber, chr(10), '- q') else '- only' end").alias("summary"), F.expr("case l_suppkey % 4 when 0 then 'primary' when 1 then 'social' when 2 then 'vc_blog' end").alias("source_type"))
    g = _lines(spark, d).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(p)).alias("perspectives"))
    g = g.select("id", F.lit("T").alias("title"), F.expr("case id % 3 when 0 then concat('- a', chr(10), '- b') when 1 then '- one' else '' end").alias("summary"), "perspectives")
    return views.stories(g).select("id", F.array_join("bullets", "|").alias("bullets"), F.array_join("source_types", "|").alias("types"))


@query("with p as (select l_orderkey as id, list('t' || l_suppkey order by l_linenumber) as ts from lines group by 1) select id, array_to_string(list_concat(list_transform(ts[1:3], lambda t: '- ' || t), ['- Topics: x, y, z', '- Details may change as coverage develops.']), chr(10)) as summary from p")
def group_summaries(spark: SparkSession, d: str) -> DataFrame:
    g = _lines(spark, d).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("t"), "l_suppkey").alias("title")))).alias("perspectives"))
    return views.heuristic_summary(g.withColumn("topic_tags", F.array(*map(F.lit, "xyzw")))).select("id", "summary")


@query(
    "with b as (select doc_id as id, case doc_id % 4 when 0 then [] when 1 then ['a', 'b'] when 2 then ['a', 'b', 'c', 'd'] else ['a', 'b', 'c', 'd', 'e', 'f'] end as f, coalesce(length(text), 0) as n from documents) select id, case when n < 500 then 'T' else array_to_string(case when len(f) >= 4 then f else list_concat(f, list_filter(['b', 'x'], lambda y: not list_contains(f, y)))[1:4] end[1:5], '|') end as bullets from b"
)
def summaries_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Generated bullets topped up from the item's own; the title alone where there is little text."""
    rows = texts(spark, d).select(F.col("doc_id").alias("id"), F.lit("T").alias("title"), F.col("text").alias("extracted_text"), F.lit("- b\n- x").alias("summary"))
    made = rows.where("id % 4 > 0").select("id", F.expr("case id % 4 when 1 then array('a', 'b') when 2 then array('a', 'b', 'c', 'd') else array('a', 'b', 'c', 'd', 'e', 'f') end").alias("bullets"))
    return build.refreshed_summaries(rows, made).select("id", F.array_join("bullets", "|").alias("bullets"))


_DASH = """case c_custkey % 4 when 0 then '{}' when 1 then concat('{"selection":{"relevance":', c_custkey, '.5,"freshness":"x"},"framing":{"political":-3},"coverage":{"independentSourceCount":2.4,"mix":{"media":150},"agreement":"High"},"confidence":{"level":"Medium"},"missing":{"bullets":[" a ",""]},"provenance":{"updatedMinsAgo":7,"models":{"framing":" f "}}}')
 when 2 then '{"coverage":{"agreement":"Low"},"missing":{"bullets":[]}}' end"""


@query(
    """select c_custkey as id, case when c_custkey % 4 = 1 then least(100, c_custkey + 1) else 0 end as relevance, 0 as political, case when c_custkey % 4 = 1 then 150 else 0 end as media, case when c_custkey % 4 = 1 then 2 else 0 end as sources, case when c_custkey % 4 = 1 then 'High' else 'Low' end as agreement, case when c_custkey % 4 = 1 then 'Medium' else 'Low' end as level,
case when c_custkey % 4 = 1 then 'a' else 'Trust signals not available for this story yet.' end as missing, case when c_custkey % 4 = 1 then 'f' else 'n/a' end as model, case c_custkey % 4 when 1 then 'none' when 2 then 'Trust signals were incomplete; showing defaults.' when 0 then 'Trust signals were incomplete; showing defaults.' else 'Trust signals not available for this story yet.' end as reason from customer"""
)
def dashboards(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), views.dashboard(F.expr(_DASH), F.lit(NOW).cast("timestamp")).alias("t"))
    return rows.select("id", t["selection"]["relevance"].alias("relevance"), t["framing"]["political"].cast("int").alias("political"), t["coverage"]["mix"]["media"].cast("int").alias("media"), t["coverage"]["independentSourceCount"].cast("int").alias("sources"), t["coverage"]["agreement"].alias("agreement"), t["confidence"]["level"].alias("level"), F.array_join(t["missing"], "|").alias("missing"), t["models"]["framing"].alias("model"), F.coalesce(t["fallback_reason"], F.lit("none")).alias("reason"))


@query("with m as (select l_orderkey as id, l_linenumber as k, l_suppkey % 6 as t from lines) select id, " + ", ".join(f"coalesce(string_agg(k::varchar, '|' order by k) filter (where t = {i}), '') as {t}" for i, t in enumerate(SOURCE_TYPES)) + " from m group by 1")
def lens_maps(spark: SparkSession, d: str) -> DataFrame:
    types = F.get(F.array(*map(F.lit, SOURCE_TYPES)), (F.col("l_suppkey") % 6).cast("int"))
    m = _lines(spark, d).select(F.col("l_orderkey").alias("id"), types.alias("source_type"), F.col("l_linenumber").cast("string").alias("item"), F.col("l_linenumber").alias("seq"))
    out = aggregates.lenses(m, "id", "source_type", "item", "seq")
    return out.select("id", *(F.array_join(F.col("lenses")[t], "|").alias(t) for t in SOURCE_TYPES))


@query(
    """with s as (select event_id, user_id, (user_id % 8)::int as n, event_id % 3 = 0 as prim from events) select event_id as id, case when n > 0 and prim then 'Strong' when n >= 3 then 'Medium' else 'Weak' end as evidence, case when n >= 6 and prim then 'High' when n < 3 then 'Low' else 'Medium' end as confidence, case when n >= 6 then 'High' when n >= 3 then 'Medium' else 'Low' end as agreement, n as sources,
case when n > 0 and prim then 'No missing signals detected (mock).' when n >= 3 then 'No primary source found yet.' else 'Limited cross-source confirmation so far.' end as missing from s"""
)
def insight_levels(spark: SparkSession, d: str) -> DataFrame:
    """Evidence, agreement and confidence of items by the number and kinds of their sources."""
    types = F.expr("case when user_id % 8 = 0 then array() when event_id % 3 = 0 then concat(array('primary'), array_repeat('community', cast(user_id % 8 - 1 as int))) else array_repeat('editorial', cast(user_id % 8 as int)) end")
    items = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("").alias("summary"), types.cast("array<string>").alias("source_types"), F.col("ts").cast("timestamp").alias("published_at"))
    out = insights.mock_insights(items, F.lit(NOW).cast("timestamp"))
    return out.select(F.col("id").cast("long").alias("id"), "evidence", "confidence", F.col("coverage.agreement").alias("agreement"), F.col("coverage.sources").alias("sources"), "missing")


@query(
    """with recursive w as (select p_partkey as k, p_partkey || '|' || p_name as s from part), f(k, s, i, h) as (select k, s, 0, 2166136261::hugeint from w union all select k, s, i + 1, (xor(h::ubigint, ascii(s[i + 1])::ubigint)::hugeint * 16777619) % 4294967296 from f where i < length(s)), z as (select k, h::bigint as h from f where i = length(s)),
l as (select unnest(['Media', 'Community', 'Primary', 'Skeptical']) as label, unnest([0, 1, 2, 3]) as i) select p_partkey || ':' || lower(label) as id, label, p_name || case when i = 0 then '' else ' (Alt ' || (i + 1) || ')' end as title, label || ' lens: ' || p_type as summary, case when i = 3 then 'Skeptical' else 'Neutral' end as tone,
array_to_string(([p_brand, (['AP', 'Reuters', 'Bloomberg', 'The Verge', 'FT', 'Guardian'])[(h + 1) % 6 + 1], (['Local wire', 'Reddit thread', 'Official blog', 'Press release'])[(h + 2) % 4 + 1], (['Analyst note', 'Community post', 'Primary doc', 'Explainer'])[(h + 3) % 4 + 1]])[1:3 + (h + i) % 2], '|') as covered from part join z on k = p_partkey, l"""
)
def mock_perspectives(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("source"), F.col("p_type").alias("summary"), F.lit("u").alias("url"), F.lit(None).cast("timestamp").alias("published_at"))
    return insights.mock_perspectives(s).select("id", "label", "title", "summary", "tone", F.array_join("covered_by", "|").alias("covered"))


# -- verification, images, enrichment


@query(
    """with c as (select o_orderkey as id, unnest([0, 1, 2]) as pos from orders) select id, pos, 'c' || pos as claim, case when pos = 1 and id % 2 = 0 then 'disputed' when pos = 0 and id % 3 > 0 or pos = 1 or (pos in (0, 2) and id % 5 = 0) then 'verified' when pos = 2 then 'verified' else 'unverified' end as status,
case when pos = 0 and id % 3 > 0 then 'https://a.org/1|https://b.org/x' when pos = 0 and id % 5 = 0 then 'https://t.org/2' when pos = 0 then '' when pos = 1 then 'https://s' || id % 4 || '.org/' when id % 5 = 0 then 'https://t.org/2' else '' end as citations from c"""
)
def claims_verified(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a model's answer with their citations: the model's, else a search's for the claim, else one for the title."""
    answer = F.expr("""concat('Here: {"claims":[{"claim":" c0 ","status":"maybe","citations":[', case when id % 3 > 0 then '"https://own.org/other","https://a.org/1#f","ftp://z","https://www.a.org/2","https://b.org/x","https://c.org"' else '"https://own.org/p"' end, ']},{"claim":"c1","status":"', case when id % 2 = 0 then 'Incorrect' else 'x' end, '"},{"claim":"c2","status":"verified"},{"claim":"c3"}]}')""")
    o = texts(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    articles = o.select("id", F.lit("https://own.org/p").alias("url"), answer.alias("answer"))
    searches = o.select("id", F.lit("c1").alias("claim"), F.array(F.lit("https://www.own.org/q"), F.concat(F.lit("https://s"), F.col("id") % 4, F.lit(".org/"))).alias("urls")).unionByName(o.where("id % 5 = 0").select("id", F.lit(None).cast("string").alias("claim"), F.array(F.lit("https://t.org/2")).alias("urls")))
    return insights.verified(articles, searches).select("id", F.col("pos").cast("int").alias("pos"), "claim", "status", F.array_join("citations", "|").alias("citations"))


@query("select page_id as id from pages where page_id % 6 in (0, 2, 3)")
def citations_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Cited addresses, not the article's own, that answered."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("https://c.org/"), F.col("page_id"), F.lit("#x")).alias("url"))
    p = p.withColumn("url", F.when(F.col("id") % 6 == 5, "https://own.org/").otherwise(F.col("url")))
    status = F.expr("case id % 6 when 0 then 200 when 1 then 404 when 2 then 403 when 3 then 500 when 5 then 200 end")
    responses = p.select(F.regexp_replace("url", "#.*", "").alias("url"), F.lit("HEAD").alias("method"), status.alias("status")).unionByName(p.where("id % 6 = 3").select(F.regexp_replace("url", "#.*", "").alias("url"), F.lit("GET").alias("method"), F.lit(200).alias("status")))
    return insights.valid_citations(p, responses, F.lit("https://own.org/#top")).select("id")


@query(
    """with i as (select page_id as id, case when page_id % 4 = 0 then '/a' || page_id when page_id % 4 = 1 then '/og' || page_id end as img from pages), r as (select *, row_number() over (order by id) as r from i where img is not null) select i.id, coalesce(case when r <= 100 then i.img end, case when i.id % 2 = 0 then '/icon' end, '/placeholder.svg') as image from i left join r using (id)"""
)
def images_chosen(spark: SparkSession, d: str) -> DataFrame:
    """A wide enough candidate, else the page's own image, for the first hundred that have one; else the icon, else the placeholder."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("seq"))
    stored = p.select(F.concat(F.lit("narrow"), "id").alias("url"), F.concat(F.lit("/n"), "id").alias("path"), F.lit(100).alias("width")).union(p.where("id % 4 = 0").select(F.concat(F.lit("wide"), "id"), F.concat(F.lit("/a"), "id"), F.lit(300))).union(p.where("id % 4 < 2").select(F.concat(F.lit("og"), "id"), F.concat(F.lit("/og"), "id"), F.lit(900)))
    candidates = F.when(F.col("id") % 3 < 2, F.array(F.lit(" "), F.concat(F.lit("narrow"), "id"), F.concat(F.lit(" wide"), "id"))).otherwise(F.array(F.concat(F.lit("wide"), "id")))
    out = insights.chosen_image(candidates, F.concat(F.lit("og"), "id"), stored, p, most=100, favicon=F.when(F.col("id") % 2 == 0, "/icon"))
    return out.select("id", "image")


@query("select page_id as id, case page_id % 3 when 0 then 'https://a.org/' || page_id || '|https://b.org' when 1 then 'https://r.org/' || page_id || '|https://d.org' else '' end as urls from pages")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in the text of a landed search page, else those of its result links."""
    body = F.expr("""case page_id % 3 when 0 then concat('see (https://a.org/', page_id, ') and https://b.org https://b.org https://duckduckgo.com/html/x') when 1 then concat('<a class="result__a" rel="x" href="/l/?uddg=https%3A%2F%2Fr.org%2F', page_id, '&z=1"></a>', '<a class="result__a" href="//no">') else 'none' end""")
    found = insights.search_results(body)
    shown = F.filter(found, lambda u: u != "//no")
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.array_join(F.when(F.col("page_id") % 3 == 1, F.concat(shown, F.array(F.lit("https://d.org")))).otherwise(shown), "|").alias("urls"))


@query(f"select doc_id as id, case when doc_id % 3 = 0 then 'first' when doc_id % 3 = 1 then 'again' else 'fallback' end as output, {words_in(('launch',), _HAY)} as launch from documents")
def validated_outputs(spark: SparkSession, d: str) -> DataFrame:
    """What a model gives is validated, asked for once more where it isn't valid, and replaced by the fallback."""
    model = lambda rows, strict: ["first" if k == 0 else "again" if strict and k == 1 else None for k in rows["k"]]
    docs = texts(spark, d).withColumn("k", F.col("doc_id") % 3).withColumnRenamed("doc_id", "id")
    out = enrich.generated(docs, "id", ["k"], model, bool, F.lit("fallback"))
    return out.select("id", "output", F.lower(F.coalesce("text", F.lit(""))).contains("launch").alias("launch"))


@query("select vec_id as id, len(embedding)::int as n, 'm' as model from embeddings where vec_id % 3 > 0")
def embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("case vec_id % 3 when 0 then case when vec_id % 2 = 0 then array() end else embedding end").alias("embedding"))
    return sinks.embedding_table(filters.with_embedding(items), "m").select("id", F.size("embedding").alias("n"), "model")


@query("select c_custkey as id, c_name as name, round(c_acctbal, 2) as acctbal from customer")
def state_exported(spark: SparkSession, d: str) -> DataFrame:
    """User state as JSON and back."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("acctbal"))
    return sinks.exported(c).select(F.from_json("json", c.schema).alias("x")).select("x.*")


@query("with p as (select l_orderkey as id, list('S' || l_suppkey % 4 order by l_linenumber) as s from lines group by 1) select id, len(list_distinct(s))::int as n, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), '|') as sources from p")
def unique_sources(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed names, blanks left out, each once in order."""
    names = F.struct("l_linenumber", F.expr("concat(' S', l_suppkey % 4, ' ')").alias("s"))
    g = _lines(spark, d).groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(names)), lambda x: x["s"]).alias("s"))
    u = text.unique_strings(F.concat("s", F.array(F.lit(" "), F.lit(None).cast("string"))))
    return g.select("id", F.size(u).alias("n"), F.array_join(u, "|").alias("sources"))



# -- builds and published tables


_BUILT = {"url": "concat('https://site.org/', doc_id % 700)", "at": "1706054400 + (doc_id * 37) % 1000 * 1000 - 400000"}


def _built_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as ingested items, some of one address, over some twelve days."""
    docs = texts(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return docs.join(vectors, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.col("source").alias("source_id"), F.lit("editorial").alias("source_type"), F.substring_index("text", "\n", 1).alias("title"), F.expr(_BUILT["url"]).alias("url"), F.expr(_BUILT["url"]).alias("canonical_url"), F.col("text").alias("summary"), F.col("text").alias("extracted_text"),
        F.lit("site.org").alias("domain"), (F.lit(NOW).cast("timestamp") + F.make_dt_interval(secs=F.expr(_BUILT["at"]) - NOW_S)).alias("published_at"), "embedding", F.lit(None).cast("string").alias("image_url"),
    )


@query(
    f"""with r as (select doc_id, text, {_BUILT["url"]} as url, {_BUILT["at"]} as since from documents), o as (select * from r where doc_id % 3 = 0), u as (select * from o union all select * from r where doc_id % 3 > 0 and url not in (select url from o)),
k as (select *, row_number() over (partition by url order by since desc, doc_id) as r from u), c as (select * from k where r = 1 and since >= 1706659200 - 7 * 86400 order by since desc, doc_id limit 250)
select doc_id::varchar as id, url, since as published from c where not {words_in(("deal", "discount", "coupon", "sale"), _HAY.replace("coalesce(text, '')", "string_split(coalesce(text, ''), chr(10))[1] || ' ' || coalesce(text, '')"))}"""
)
def built_items(spark: SparkSession, d: str) -> DataFrame:
    """Items merged with the last snapshot: unseen addresses, the latest of each, recent ones, the newest 250, without blocked terms."""
    rows = _built_rows(spark, d).drop("embedding")
    out = build.items(rows.where("seq % 3 > 0"), rows.where("seq % 3 = 0"), NOW, most=250)
    since = F.unix_seconds("published_at") - F.unix_seconds(F.lit(NOW).cast("timestamp")) + NOW_S  # NOW is of the session's time zone
    return out.select("id", "url", since.alias("published"))


@query(
    """select 'articles' as name, count(*) as n from documents union all select 'sources', count(distinct source) from documents union all select 'summaries', count(*) from documents union all select 'trust_fields', count(*) from documents union all select 'trust_dashboard', count(*) from documents
union all select 'feed', count(*) from documents union all select 'embeddings', count(*) from documents where doc_id in (select vec_id from embeddings) union all select 'older articles', 1"""
)
def published_tables(spark: SparkSession, d: str) -> DataFrame:
    """A build's tables, published twice and read back; readers of the version before still find it."""
    rows = _built_rows(spark, d).withColumn("tags", F.array(F.lit("general")))
    sources = rows.select(F.col("source_id").alias("id"), F.upper("source_id").alias("name")).distinct()
    root = sinks.scratch_path(spark, "published")
    sinks.publish({"articles": rows.where("seq = 0")}, root)
    sinks.publish(build.tables(rows, sources), root, by_day="published_at")
    names = ("articles", "sources", "summaries", "trust_fields", "trust_dashboard", "feed", "embeddings")
    counts = [sinks.snapshot(spark, f"{root}/none", f"{root}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in names]
    counts.append(sinks.current(spark, f"{root}/articles", before=2).agg(F.lit("older articles").alias("name"), F.count("*").alias("n")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("select doc_id as id, length(text) as n from documents where text is not null")
def flushed_portions(spark: SparkSession, d: str) -> DataFrame:
    """Outputs written in portions, so that a run that is broken off goes on with the next one."""
    docs = texts(spark, d).select(F.col("doc_id").alias("id"), "text").where("text is not null")
    return sinks.flushed(docs, "id", lambda rows: rows.select("id", F.length("text").cast("long").alias("n")), sinks.scratch_path(spark, "portions"), 4)


@query("select c_custkey as id, c_custkey * 2 as v, 'fresh' as kind from customer union all select c_custkey, c_custkey, 'stale' from customer where c_custkey % 2 = 0")
def cached_batches(spark: SparkSession, d: str) -> DataFrame:
    """What a cache gives within its time to live, and after it when any batch will do."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("v"))
    path, other = sinks.scratch_path(spark, "cache"), sinks.scratch_path(spark, "cache")
    sinks.cache_write(c, path, 1_000)
    sinks.cache_write(c.withColumn("v", F.col("v") * 2), path, 700_000)
    sinks.cache_write(c.where("id % 2 = 0"), other, 1_000)
    fresh, expired, old = sinks.cache_read(spark, path, 1_200_000, 600_000), sinks.cache_read(spark, other, 1_200_000, 600_000), sinks.cache_read(spark, other, 1_200_000, None)
    if expired is not None:
        raise ValueError("an expired batch was read")
    return fresh.select("id", "v", F.lit("fresh").alias("kind")).unionByName(old.select("id", "v", F.lit("stale").alias("kind")))


# -- folds, packs, generators, streams


@query("with p as (select l_orderkey as g, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber desc) - 1 as k, count(*) over (partition by l_orderkey) as n from lines), s as (select g, case when n <= 5 then 0 else k // 3 end as sub, list(k::varchar order by k) as ids, count(*) as m, first(n) as n from p group by 1, 2) select g, (row_number() over (partition by g order by sub) - 1)::int as sub, array_to_string(ids, '|') as ids from s where n <= 5 or m > 1")
def subgroup_packs(spark: SparkSession, d: str) -> DataFrame:
    """Groups of over five perspectives packed by threes of like titles and unlike sources; a single one left over goes."""
    from pyspark.sql import Window

    p = _lines(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"))) - 1)
    title = F.concat_ws(" ", *(F.concat(F.lit(w), F.floor(F.col("k") / 3)) for w in ("aaa", "bbb")))
    fields = F.struct(F.col("k").cast("string").alias("id"), F.concat(F.lit("S"), F.col("k") % 3).alias("source"), title.alias("title"), F.lit("- one\n- two").alias("summary"), (-F.col("k")).alias("published_at"))
    out = insights.subgroups(p.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(fields).alias("perspectives")))
    return out.select(F.col("group_id").alias("g"), F.col("subgroup").alias("sub"), F.array_join("ids", "|").alias("ids"))


@query("with c as (select event_id as id, case when event_id % 3 > 0 then 'v' || event_id % 7 else 't' || event_id % 11 end as c from events), l as (select c, min(id) as leader from c group by 1) select id, leader from c join l using (c)")
def near_duplicate_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicates by vector where there is one, else by tokens: seven vectors and eleven titles, told apart."""
    vector = F.when(F.col("event_id") % 3 > 0, F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i == F.col("event_id") % 7, 1.0).otherwise(0.0)))
    tokens = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("title"), F.col("event_id") % 11))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), tokens.alias("tokens"), vector.alias("embedding"))
    return cluster.near_leaders(rows).select("id", "leader")


@query(
    f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), g as ({_TAGGED.removeprefix('with t as (').removesuffix(')')}),
w as (select doc_id, unnest(tok) as w, len(tok) as n from (select doc_id, {_TOK} as tok from documents)), likely as (select b.doc_id, map(list(a.doc_id order by a.doc_id), list(m / (a.n + b.n - m) order by a.doc_id)) as likes from (select a.doc_id as a, b.doc_id as b, count(*) as m from w a join w b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2) p
 join (select distinct doc_id, n from w) a on a.doc_id = p.a join (select distinct doc_id, n from w) b on b.doc_id = p.b group by 1),
t as materialized (select d.doc_id, likes, list_filter(g.tags, lambda x: x not in ('ai', 'general', 'frontend', 'devtools', 'data')) as tags, d.source as dom, v.e, sqrt(list_dot_product(v.e, v.e)) as size, row_number() over (order by d.doc_id) as pos from documents d join g using (doc_id) left join likely using (doc_id) left join v on vec_id = d.doc_id),
s(pos, doc_id, lead, state) as (
 select 0::bigint, null::bigint, null::bigint, []::struct(lead bigint, tags varchar[], dom varchar, mean double[], size double, n bigint)[]
 union all
 select t.pos, t.doc_id, coalesce(b.lead, t.doc_id), case when b.lead is null then list_append(s.state, {{'lead': t.doc_id, 'tags': t.tags, 'dom': t.dom, 'mean': t.e, 'size': t.size, 'n': 1::bigint}}) else s.state[1:b.i - 1] || [b.changed] || s.state[b.i + 1:] end
 from s join t on t.pos = s.pos + 1
 left join lateral (select lead, i, {{'lead': lead, 'tags': list_distinct(list_concat(x.tags, t.tags)), 'dom': x.dom, 'mean': moved, 'size': sqrt(list_dot_product(moved, moved)), 'n': x.n + 1}} as changed from (
   select *, case when t.e is null then x.mean when x.mean is null then t.e else list_transform(list_zip(x.mean, t.e), lambda z: z[1] + (z[2] - z[1]) / (x.n + 1)) end as moved from (
    select lead, i, x, vec, least(1, least(1, base + case when common >= 2 then 0.25 * common / greatest(1, least(len(t.tags), len(x.tags))) else 0 end) + case when x.dom = t.dom then 0.05 else 0 end) as score from (
     select x.lead as lead, i, x, len(list_intersect(x.tags, t.tags)) as common, x.mean is not null and t.e is not null as vec, case when x.mean is not null and t.e is not null then list_dot_product(x.mean, t.e) / (x.size * t.size) else coalesce(t.likes[x.lead], 0) end as base
     from (select unnest(s.state) as x, generate_subscripts(s.state, 1) as i)) order by score desc, i limit 1) where score >= case when vec then 0.78 else 0.22 end)) b on true
), l as (select doc_id, lead from s where pos > 0), n as (select lead, count(*) as n from l group by 1)
select l.doc_id as id, l.lead as leader from l join n using (lead) where n.n >= 2"""
)
def topic_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Topic clustering of all documents with moving mean vectors, tag and domain bonuses."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = texts(spark, d).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), similarity.tokens(F.substring_index("text", "\n", 1)).alias("tokens"), F.col("source").alias("domain"), tags.topic_tags(F.col("text"), F.lit("")).alias("tags"))
    return cluster.topic_leaders(rows.join(v, "id", "left")).select("id", "leader")


@query(
    """with k as (select doc_id as id, doc_id % 4 as k from documents) select id, case k when 0 then '- a' || chr(10) || '- b' || chr(10) || '- c' || chr(10) || '- ' || repeat('d', 120) when 1 then 'T' when 2 then '- one' || chr(10) || '- two' else '- one' || chr(10) || '- two' end as summary,
case k when 0 then '{"claims":[1]}' else '{"claims":[]}' end as claims, case when k = 3 then 'third time' else '- T' || chr(10) || '- Only the headline was available for this item.' end as title_only from k""".replace("when 1 then 'T' when 2", "when 1 then '- T' when 2")
)
def generated_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Generators with a model that fails at first, gives what isn't valid, or needs a third attempt."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("T").alias("title"), F.when(F.col("doc_id") % 4 == 1, "").otherwise("- one\n- two").alias("summary"), F.col("doc_id").cast("string").alias("extracted_text"))
    good = "- a\n- b\n- c\n- " + "d" * 120

    def summaries(rows, strict):
        if not strict:
            raise ConnectionError
        return [good if int(t) % 4 == 0 else "As an AI" if int(t) % 4 == 2 else "- too short" for t in rows["extracted_text"]]

    def claims(rows, strict):
        return ['{"claims":[1]}' if int(t) % 4 == 0 else "none" for t in rows["extracted_text"]]

    of = enrich.GENERATORS
    a = of["summary"](docs, summaries, concurrency=2).select("id", F.col("output").alias("summary"))
    b = of["claims"](docs, claims).select("id", F.col("output").alias("claims"))
    asked: dict = {}

    def third(rows, strict):
        out = []
        for t in rows["x"]:
            asked[t] = asked.get(t, 0) + 1
            out.append("third time" if int(t) % 4 == 3 and asked[t] == 3 else None)
        return out

    named = docs.withColumn("x", F.col("extracted_text"))
    c = enrich.generated(named, "id", ["x"], third, bool, F.array_join(enrich.title_only(F.col("title")), "\n"), attempts=3).select("id", F.col("output").alias("title_only"))
    return a.join(b, "id").join(c, "id")


@query("select doc_id as id, case doc_id % 6 when 0 then 'jpg' when 1 then 'png' when 2 then 'gif' else 'webp' end as extension from documents where doc_id % 6 < 4 and doc_id % 50 > 0")
def image_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Stored images by their content; empty and too large ones and other files go."""
    content = F.expr("case doc_id % 6 when 0 then unhex('FFD8FF00') when 1 then unhex('89504E470D0A') when 2 then unhex('4749463839') when 3 then unhex('524946460000000057454250') when 4 then unhex('25504446') else unhex('') end")
    files = table(spark, d, "documents").select(F.col("doc_id").alias("id"), content.alias("content"), F.when(F.col("doc_id") % 50 == 0, 600_001).otherwise(F.length(content)).alias("length"))
    return feeds.image_kinds(files).select("id", "extension")


@query("select page_id, case page_id % 4 when 0 then 3 when 1 then 1 else -1 end::int as n, case page_id % 4 when 0 then 3 * page_id + 3 when 1 then page_id else 0 end::bigint as total from pages")
def json_files(spark: SparkSession, d: str) -> DataFrame:
    """Landed JSON of each page: a list, an object, one that is cut short, one that isn't there."""
    body = F.expr("""case page_id % 4 when 0 then concat('[{"a":', page_id, '},{"a":', page_id + 1, '},{"a":', page_id + 2, '}]') when 1 then concat('{"a":', page_id, '}') when 2 then concat('[{"a":', page_id, '},') end""")
    rows = table(spark, d, "pages").select("page_id", sinks.json_rows(body, "a bigint").alias("rows"))
    return rows.select("page_id", F.coalesce(F.size("rows"), F.lit(-1)).alias("n"), F.aggregate(F.coalesce("rows", F.array().cast("array<struct<a:bigint>>")), F.lit(0).cast("long"), lambda s, x: s + x["a"]).alias("total"))


@query(
    """with recursive k as (select r_name as topic, (row_number() over (order by r_regionkey) - 1)::int as t, unnest([0, 1, 2]) as i from region), w as (select topic, t, i, 'hn-' || topic || '-' || i as s from k), f(topic, t, i, s, n, r) as (select topic, t, i, s, 0, 0::hugeint from w union all select topic, t, i, s, n + 1, (r * 31 + ascii(s[n + 1])) % 4294967296 from f where n < length(s))
select 'hn-' || lower(to_hex(r::bigint)) as id, topic || ' #' || (i + 1) as title, (1704067200 - 60 * (t * 5 + i))::bigint as published from f where n = length(s)"""
)
def mock_connector_rows(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("t"), F.col("r_name").alias("topic"))
    rows = feeds.mock_connector(spark, "hn", topics, "2024-01-01 00:00:00")
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return rows.select("id", "title", (F.unix_seconds("published_at") - start + 1704067200).alias("published"))


def _landing(rows: DataFrame) -> DataFrame:
    """rows as a stream of three files, one in each micro-batch."""
    rows.repartition(3).write.parquet(path := sinks.scratch_path(rows.sparkSession, "landed"))
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("select floor(epoch(ts) / 86400)::bigint as day, event_type, count(*) as n from events group by 1, 2")
def streamed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each day, kept while rows land within a year of the latest."""
    at = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit(NOW).cast("timestamp")) + NOW_S)  # whatever the session's time zone
    counts = ingest.windowed_counts(_landing(table(spark, d, "events").withColumn("ts", at)), "ts", "event_type", late="366 days")
    out = sinks.scratch_path(spark, "counts")
    ingest.changes_to(counts, out, sinks.scratch_path(spark, "progress")).awaitTermination()
    return ingest.latest_table(spark, out, "start", "event_type").select(F.floor(F.unix_seconds("start") / 86400).alias("day"), "event_type", "n")


@query("select user_id, event_type, true as once from events group by 1, 2")
def streamed_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each user and kind within a year, written once whichever batch brings it."""
    first = ingest.distinct_within(_landing(table(spark, d, "events")), "ts", ["user_id", "event_type"], "366 days")
    out = sinks.scratch_path(spark, "first")
    ingest.changes_to(first, out, sinks.scratch_path(spark, "progress"), "append").awaitTermination()
    rows = spark.read.option("basePath", f"{out}/changes").parquet(*(f"{out}/changes/v={v}" for v in sinks.versions(spark, f"{out}/changes")))
    return rows.groupBy("user_id", "event_type").agg((F.count("*") == 1).alias("once"))


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id) as r from events) where r = 1")
def streamed_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each key, kept by a stream that reads the table as it lands."""
    stream = _landing(table(spark, d, "events"))
    state = sinks.scratch_path(spark, "state")
    ingest.upsert_latest(stream, "user_id", "ts", "event_id", state, sinks.scratch_path(spark, "progress")).awaitTermination()
    return ingest.latest_table(spark, state, "user_id").select("user_id", "event_id", "ts")
