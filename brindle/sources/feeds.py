"""Sources: landed RSS and JSON files to items. Nothing here uses a network; a crawler lands what these read.

Schemas are fixed, never inferred; a row that doesn't parse is kept in _corrupt_record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import article_text, blank_to_null, canonical_link, first_image, first_url, page_image, parse_date, post_title, strip_html, strip_tags
from ..functions.urls import canonical_url, domain, forum_item_id, news_search_url, stable_id

RSS = "title string, link string, guid string, pubDate string, isoDate string, creator string, author string, contentSnippet string, summary string, content string, description string, enclosure struct<_url:string>, `itunes:image` struct<_href:string>, `media:content` struct<_url:string>, `media:thumbnail` struct<_url:string>, _corrupt_record string"
HITS = "hits array<struct<objectID:string,title:string,url:string,author:string,created_at:string,points:bigint,num_comments:bigint,story_text:string>>, _corrupt_record string"
FORUM = "id bigint, type string, by string, time bigint, text string, kids array<bigint>, score bigint, descendants bigint, title string, url string"
POSTS = "uri string, cid string, author struct<displayName:string,handle:string>, record struct<text:string,createdAt:string>, indexedAt string, likeCount bigint, repostCount bigint, replyCount bigint, embed string"


def catalogue(sources: DataFrame, queries: DataFrame) -> DataFrame:
    """What to fetch: sources with a feed, the forum's search, a news search for each query."""
    feeds = sources.where("rss is not null").select(F.col("id").alias("source_id"), F.lit("rss").alias("kind"), F.col("rss").alias("url"))
    forum = sources.sparkSession.createDataFrame([("hackernews", "hn", "https://hn.algolia.com/api/v1/search_by_date?tags=story")], feeds.schema)
    news = queries.select(F.concat(F.lit("google-news:"), F.col("query")).alias("source_id"), F.lit("rss").alias("kind"), news_search_url(F.col("query")).alias("url"))
    return feeds.unionByName(forum).unionByName(news)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed feed files of any of the formats, a document each."""
    return parse_rss(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"), "body")


# Name spaces of Atom and of RSS 1.0, and the roots of their documents.
ATOM_SPACE, RSS1_SPACE = r"http://www\.w3\.org/2005/Atom", r"http://purl\.org/rss/1\.0/"
FEED_ROOT, RDF_ROOT = r"<(?:[\w.-]+:)?feed[\s>]", r"<(?:[\w.-]+:)?RDF[\s>]"
_TYPED = "struct<_VALUE:string,_type:string,div:string>"
ENTRY = f"title {_TYPED}, link array<struct<_href:string,_rel:string>>, id string, published string, updated string, author array<struct<name:string>>, content {_TYPED}, summary {_TYPED}, `media:thumbnail` struct<_url:string>, `media:content` struct<_url:string>"
_RDF = "`dc:date` string, `dc:creator` string, `content:encoded` string"


def _fields(schema: str) -> str:
    return ",".join(f.replace(" ", ":", 1) for f in schema.replace(", _corrupt_record string", "").split(", "))


def _unprefixed(body: Column) -> Column:
    """A document with the elements of its feed's name space without a prefix, if that name space has one."""
    out = body
    for space, root in ((ATOM_SPACE, FEED_ROOT), (RSS1_SPACE, RDF_ROOT)):
        prefix = F.regexp_extract(body, rf"xmlns:([\w.-]+)\s*=\s*[\"']{space}[\"']", 1)
        bare = F.regexp_replace(out, F.concat(F.lit(r"<(/?)\Q"), prefix, F.lit(r"\E:")), F.lit("<$1"))
        out = F.when((prefix != "") & body.rlike(root), bare).otherwise(out)
    return out


def _typed(c: Column) -> Column:
    """An Atom text as HTML: plain text is escaped, as tags in it are none."""
    plain = F.replace(F.replace(c["_VALUE"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.coalesce(c["div"], F.when(c["_type"].isin("html", "xhtml"), c["_VALUE"]).otherwise(plain))


def _link(links: Column) -> Column:
    """The address of the alternate link, which needs no mark, else of the first."""
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(alternate, F.lit(0)), F.get(links, F.lit(0)))["_href"]


def parse_rss(df: DataFrame, body: str) -> DataFrame:
    """Rows of landed RSS 2.0, RSS 1.0 (RDF) and Atom documents, an item each, with the other columns of df and format; what doesn't parse has no items.

    One scan with one schema reads all three. An Atom entry's link is that of its alternate page, its text is HTML by its type.
    """
    rss = _fields(RSS)
    parsed = F.from_xml(_unprefixed(F.col(body)), f"channel struct<item:array<struct<{rss}>>>, item array<struct<{rss},{_fields(_RDF)}>>, entry array<struct<{_fields(ENTRY)}>>", {"mode": "PERMISSIVE"})
    names = [f.split(" ")[0].strip("`") for f in RSS.split(", ")][:-1]
    nothing = {n: F.lit(None) for n in names}

    def item(kind: str, x: Column, **own: Column) -> Column:
        return F.struct(F.lit(kind).alias("format"), *((own[n] if n in own else x[n] if kind != "atom" else nothing[n]).alias(n) for n in names))

    rdf = lambda x: item("rdf", x, isoDate=F.coalesce(x["isoDate"], x["dc:date"]), creator=F.coalesce(x["creator"], x["dc:creator"]), content=F.coalesce(x["content"], x["content:encoded"]))
    atom = lambda x: item("atom", x, title=F.coalesce(x["title"]["_VALUE"], strip_tags(x["title"]["div"])), link=_link(x["link"]), guid=x["id"], isoDate=F.coalesce(x["published"], x["updated"]), author=F.get(x["author"], F.lit(0))["name"], content=_typed(x["content"]), summary=_typed(x["summary"]), **{m: x[m] for m in ("media:content", "media:thumbnail")})
    found = (F.transform(parsed["channel"]["item"], lambda x: item("rss", x)), F.transform(parsed["item"], rdf), F.transform(parsed["entry"], atom))
    kind = f"array<struct<format:string,{rss}>>"
    rows = F.concat(*(F.coalesce(f.cast(kind), F.array().cast(kind)) for f in found))
    return df.withColumn("_item", F.explode(rows)).select(*(F.col(f"`{c}`") for c in df.columns if c != body), "_item.*")


def rss_items(rows: DataFrame, source_id: str | Column, source_type: str | Column, now, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of RSS rows; rows without a URL or title go."""
    source_id, source_type = (F.lit(x) if isinstance(x, str) else x for x in (source_id, source_type))
    url = canonical_url(F.coalesce(blank_to_null(F.col("link")), F.when(F.col("guid").startswith("http"), F.col("guid"))))
    text = F.coalesce("contentSnippet", "summary", "content", "description")
    image = F.coalesce(F.col("enclosure._url"), F.col("`itunes:image`._href"), F.col("`media:content`._url"), F.col("`media:thumbnail`._url"), first_image(F.coalesce("content", "summary")))
    out = rows.select(
        *keep, stable_id(source_id, url).alias("id"), source_id.alias("source_id"), source_type.alias("source_type"), blank_to_null(F.col("title")).alias("title"), url.alias("url"), url.alias("canonical_url"),
        parse_date(F.coalesce("isoDate", "pubDate"), now).alias("published_at"), F.coalesce(blank_to_null(F.col("creator")), blank_to_null(F.col("author"))).alias("author"), strip_html(F.coalesce(text, F.lit(""))).alias("summary"), domain(url).alias("domain"), image.alias("image_url"),
    )
    return out.where("url is not null and title is not null")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HITS).option("mode", "PERMISSIVE").json(path, multiLine=True).select(F.explode("hits").alias("h")).select("h.*")


def hit_rows(bodies: DataFrame, pages: int) -> DataFrame:
    """Hits of landed search pages(page, body): as many pages as asked for, 1 to 10; a page that doesn't parse is empty."""
    hits = F.from_json("body", HITS.replace(", _corrupt_record string", ""))["hits"]
    return bodies.where(F.col("page") <= min(10, max(1, pages))).select(F.explode(hits).alias("h")).select("h.*")


def hit_items(hits: DataFrame, now) -> DataFrame:
    """Items of forum search hits; those without a URL or title go."""
    url = canonical_url(F.col("url"))
    summary = F.substring(strip_html(F.coalesce("story_text", F.lit(""))), 1, 240)
    out = hits.select(
        stable_id(F.lit("hackernews"), url).alias("id"), F.lit("hackernews").alias("source_id"), F.lit("community").alias("source_type"), blank_to_null(F.col("title")).alias("title"), url.alias("url"), parse_date(F.col("created_at"), now).alias("published_at"),
        F.col("author"), summary.alias("summary"), domain(url).alias("domain"), F.struct(F.col("objectID").cast("long").alias("id"), F.col("points").alias("score"), F.col("num_comments").alias("comments")).alias("signals"),
    )
    return out.where("url is not null and title is not null")


def top_comments(stories: DataFrame, items: DataFrame, most: int = 3) -> DataFrame:
    """The first comments of each story in order, without HTML, blank ones left out."""
    kids = stories.select(F.col("id").alias("story"), F.posexplode("kids").alias("pos", "kid"))
    text = strip_tags(F.coalesce(F.col("text"), F.lit("")))
    rows = kids.join(items.where("type = 'comment'").select(F.col("id").alias("kid"), text.alias("comment")), "kid").where("comment <> ''")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("story").orderBy("pos"))).where(F.col("r") <= most)
    return ranked.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "comment"))), lambda x: x["comment"]).alias("comments"))


def thread_comments(json, most: int = 3):
    """The first comments in a thread's JSON, a list whose second element holds them."""
    listing = F.from_json(json, "array<struct<data:struct<children:array<struct<data:struct<body:string>>>>>>")
    bodies = F.transform(F.get(listing, F.lit(1))["data"]["children"], lambda c: F.trim(c["data"]["body"]))
    return F.slice(F.filter(bodies, lambda b: b.isNotNull() & ~b.isin("", "[deleted]", "[removed]")), 1, most)


# Kinds of embeds that lead to an address.
CARD, WITH_MEDIA, OF_RECORD = "app.bsky.embed.external", "app.bsky.embed.recordWithMedia", "app.bsky.embed.record"


def embed_url(embed: Column, depth: int = 4) -> Column:
    """The address of a JSON embed's card, which may lie in its media or record, to a depth."""
    kind, within = F.get_json_object(embed, "$['$type']"), lambda name: embed_url(F.get_json_object(embed, f"$.{name}"), depth - 1)
    out = F.when(kind == CARD, F.get_json_object(embed, "$.external.uri"))
    return out.when(kind == WITH_MEDIA, within("media")).when(kind == OF_RECORD, within("record")) if depth else out


def post_items(posts: DataFrame, now, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of social posts with text."""
    text = F.coalesce("record.text", F.lit(""))
    link = F.coalesce(embed_url(F.col("embed")), first_url(text))
    own = F.concat(F.lit("https://bsky.app/profile/"), F.col("author.handle"), F.lit("/post/"), F.element_at(F.split("uri", "/"), -1))
    return posts.where(F.trim(text) != "").select(
        *keep, F.substring(F.sha2("uri", 256), 1, 24).alias("id"), post_title(text, F.get_json_object("embed", "$.external.title"), F.col("author.handle")).alias("title"), text.alias("text"), link.alias("url"), own.alias("post_url"), parse_date(F.coalesce("record.createdAt", "indexedAt"), now).alias("published_at"),
        F.coalesce("likeCount", F.lit(0)).alias("likes"), F.coalesce("repostCount", F.lit(0)).alias("reposts"), F.coalesce("replyCount", F.lit(0)).alias("replies"), F.lit("social").alias("source_type"),
    )


def group_files(files: DataFrame, key: str, place: str, body: str, schema: str) -> DataFrame:
    """Of each key's files in order the first that holds groups: rows, from a bare array or the fields clusters or groups."""
    rows = f"array<struct<{schema.replace(' ', ':', 1)}>>"
    text = F.col(body)
    array = F.when(F.ltrim(text).startswith("["), F.from_json(text, rows, {"mode": "PERMISSIVE"}))
    # a field counts only if it holds an array
    field = lambda name: F.when(F.ltrim(F.get_json_object(text, f"$.{name}")).startswith("["), F.from_json(F.get_json_object(text, f"$.{name}"), rows))
    found = files.withColumn("rows", F.when(F.try_parse_json(text).isNotNull(), F.coalesce(array, field("clusters"), field("groups"))))
    return found.groupBy(key).agg(F.min_by("rows", F.when(F.col("rows").isNotNull(), F.col(place))).alias("rows"))


def settled(attempts: DataFrame, retries: int = 2) -> DataFrame:
    """url, attempt and body of the first good response of landed attempts(url, attempt from 0, status, body) within the retries."""
    good = attempts.where(F.col("attempt").between(0, retries) & F.col("status").between(200, 299))
    return good.groupBy("url").agg(F.min("attempt").alias("attempt"), F.min_by("body", "attempt").alias("body"))


def fetch_states(attempts: DataFrame, retries: int = 2, base_ms: int = 500) -> DataFrame:
    """url, state, attempt, status and due_ms of each address of attempts(url, attempt from 0, status, at_ms, retry_after seconds).

    Its last attempt within the retries decides. good: 2xx; refused: another answer that asking again doesn't change; else no
    answer (null), 5xx or 429, which is exhausted after the last retry, and before it waiting until due_ms. The wait doubles with
    each attempt, within 30 % by the address; a 429 waits as long as it was told to, if that is longer.
    """
    last = attempts.where(F.col("attempt").between(0, retries)).groupBy("url").agg(F.max_by(F.struct("attempt", "status", "at_ms", "retry_after"), "attempt").alias("_l")).select("url", "_l.*")
    status = F.coalesce("status", F.lit(0))
    again = (status == 0) | (status == 429) | status.between(500, 599)
    state = F.when(status.between(200, 299), "good").when(~again, "refused").when(F.col("attempt") == retries, "exhausted").otherwise("waiting")
    share = F.conv(F.substring(F.md5(F.concat_ws("|", "url", "attempt")), 1, 4), 16, 10).cast("double") / 65536
    wait = F.floor(F.lit(base_ms) * F.pow(F.lit(2.0), F.col("attempt")) * (share * 0.6 + 0.7))
    told = F.when(status == 429, F.coalesce(F.col("retry_after"), F.lit(0)) * 1000).otherwise(0)
    return last.select("url", state.alias("state"), "attempt", "status", F.when(state == "waiting", F.col("at_ms") + F.greatest(wait, told)).cast("long").alias("due_ms"))


def with_item(stories: DataFrame, items: DataFrame) -> DataFrame:
    """Stories with item, the landed forum item that their URL names, if any."""
    landed = items.select(F.col("id").alias("_id"), F.struct("*").alias("item"))
    return stories.join(landed, forum_item_id(F.col("url")) == F.col("_id"), "left").drop("_id")


def extracted(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with what their landed pages (url, html) give: canonical URL, image, text. The id stays that of the URL at ingest."""
    html = F.col("html")
    found = pages.select(F.col("url").alias("_url"), canonical_url(canonical_link(html)).alias("_canonical"), page_image(html).alias("_image"), article_text(html).alias("_text"))
    rows = items.join(found, F.col("url") == F.col("_url"), "left")
    return rows.withColumn("canonical_url", F.coalesce("_canonical", "url")).withColumn("page_image", F.col("_image")).withColumn("extracted_text", F.col("_text")).drop("_url", "_canonical", "_image", "_text")


def mock_connector(spark: SparkSession, connector: str, topics: list[str] | DataFrame, now: str, per_topic: int = 3) -> DataFrame:
    """Deterministic rows for tests: per_topic for each topic, a minute apart. topics: names, or a table (t, topic) with t from 0."""
    from ..functions.hashing import rolling31_hex

    rows = spark.createDataFrame(list(enumerate(topics)), "t int, topic string") if isinstance(topics, list) else topics
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_topic - 1))))
    seed = F.concat_ws("-", F.lit(connector), F.col("topic"), F.col("i").cast("string"))
    published = F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.col("t") * 5 + F.col("i"))
    return rows.select(F.concat(F.lit(f"{connector}-"), rolling31_hex(seed)).alias("id"), F.concat_ws(" ", F.col("topic"), F.concat(F.lit("#"), (F.col("i") + 1).cast("string"))).alias("title"), published.alias("published_at"))


def image_kinds(files: DataFrame, most_bytes: int = 600_000) -> DataFrame:
    """Of files(content, length) the images that are neither empty nor too large, with the extension that their content shows."""
    kinds = F.when(F.hex(F.substring("content", 1, 3)) == "FFD8FF", "jpg").when(F.hex(F.substring("content", 1, 4)) == "89504E47", "png").when(F.hex(F.substring("content", 1, 4)) == "47494638", "gif").when(F.hex(F.substring("content", 9, 4)) == "57454250", "webp")
    return files.where(F.col("length").between(1, most_bytes)).withColumn("extension", kinds).where("extension is not null")


def images(spark: SparkSession, path: str, most_bytes: int = 600_000) -> DataFrame:
    """Landed images."""
    return image_kinds(spark.read.format("binaryFile").load(path), most_bytes)
