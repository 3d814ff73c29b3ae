"""Queries of what readers are served, of published tables read back, and of generators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags, text
from ..functions.values import SOURCE_TYPES
from ..operators import aggregates, enrich, joins, knn, views
from ..sources import sinks
from . import build, serving
from .queries import _GROUP_IMAGE, _VEC, _assembled, _group_rows, _grouped_items
from .queries_feed import LINES, _lines
from .registry import NOW, query, sql_values, table, texts

#: Tags in the order of a dictionary: letters, then accents, then small letters before large ones.
LOCAL = ("Äpfel", "apple", "Apple", "apple pie", "eclair", "éclair", "zebra", "Zebra")


@query(
    f"""with {sql_values("o", "k, tag", list(enumerate(LOCAL)))}, t as (select source, unnest([doc_id % 8, doc_id // 8 % 8, doc_id // 5 % 8]) as k from documents), n as (select source, k, count(*) as n from t group by 1, 2),
r as (select source, tag, row_number() over (partition by source order by n desc, k) as r from n join o using (k)) select source, string_agg(tag, '|' order by r) as tags from r where r <= 6 group by 1"""
)
def tags_by_locale(spark: SparkSession, d: str) -> DataFrame:
    """Each source's most frequent tags; of equal counts as a dictionary has them, with accents and capitals."""
    known = F.array(*map(F.lit, LOCAL))
    of = F.array(*(F.get(known, F.expr(f"cast({k} % 8 as int)")) for k in ("doc_id", "doc_id div 8", "doc_id div 5")))
    return aggregates.cluster_tags(table(spark, d, "documents").select("source", of.alias("tags")), "source", "tags").select("source", F.array_join("tags", "|").alias("tags"))


_TIMES = ("case event_id % 5 when 0 then null when 1 then '' else concat('2024-01-', lpad(cast(event_id % 28 + 1 as string), 2, '0'), 'T00:00:00Z') end", "case event_id % 7 when 0 then null when 1 then '' else concat('2024-01-', lpad(cast(user_id % 28 + 1 as string), 2, '0'), 'T00:00:00Z') end")


@query(f"with t as (select event_id, {_TIMES[0]} as a, {_TIMES[1]} as b from events) select event_id, coalesce(case when a <> '' and b <> '' then greatest(a, b) else coalesce(a, b) end, 'none') as latest from t".replace("as string", "as varchar"))
def latest_iso_times(spark: SparkSession, d: str) -> DataFrame:
    """The later of two times as text, either of which may be missing or empty."""
    a, b = map(F.expr, _TIMES)
    return table(spark, d, "events").select("event_id", F.coalesce(text.latest_iso(a, b), F.lit("none")).alias("latest"))


_OF = "doc_id % 59"


@query(_assembled(f"with leads as (select doc_id, {_OF} as lead from documents)") + " union all select 'solo:' || doc_id, 'Card ' || doc_id, 1706659200 - doc_id, 'solo', 1, 0, doc_id::varchar, 'none' from documents where doc_id % 3 = 0 and doc_id % 2 = 1")
def groups_with_cards(spark: SparkSession, d: str) -> DataFrame:
    """Groups, and the items as groups of their own that none of them has: those with four bullets and an address that is new."""
    items = _grouped_items(spark, d)
    groups = views.assembled(items.withColumn("leader", F.expr(_OF.replace("doc_id", "id"))), tags=tags.topic_tags(F.col("summary"), F.lit("")))
    groups = sinks.scratch(groups, "groups")  # read twice
    bullets = F.expr("case when id % 3 = 0 then array('a', 'b', 'c', 'd') else array('a', ' ') end")
    address = F.when(F.col("id") % 2 == 1, F.concat(F.lit("https://new.org/"), "id")).otherwise(F.get(F.lit(None).cast("array<string>"), F.lit(0)))
    cards = items.select(
        F.col("id").cast("string").alias("id"), "source", "source_type", F.concat(F.lit("Card "), "id").alias("title"), address.alias("url"), F.lit(None).cast("string").alias("post_url"), F.timestamp_seconds(F.lit(1706659200) - F.col("id")).alias("published_at"), F.lit("").alias("summary"), F.array(F.lit("solo")).alias("tags"),
        F.lit(None).cast("string").alias("image_url"), bullets.alias("bullets"), F.lit(None).cast("struct<vested:array<string>,framing:array<string>,confidence:double>").alias("bias"), *(F.lit(None).cast("array<string>").alias(c) for c in ("missing", "short_term", "long_term")),
    )
    old = cards.where("id % 7 = 0 and id % 2 = 0").withColumn("url", F.concat(F.lit("https://example.com/"), "id"))  # most of these stand in a group
    seen = groups.select(F.explode("perspectives.url").alias("url")).distinct()
    cards = cards.where("url is not null").unionByName(old.join(seen, "url", "left_semi").select(*cards.columns))
    return _group_rows(serving.with_cards(groups, cards, F.lit(NOW).cast("timestamp"))).withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


_WELL = "case when l_suppkey % 10 = 3 then 'Reuters' else concat('S', l_suppkey % 10) end"


@query(
    f"""with p as (select l_orderkey as id, {_WELL} as s, l_shipdate from {LINES} where l_suppkey % 10 <> 4), g as (select id, count(*) as n, bool_or(s = 'Reuters') as well, max(l_shipdate) as since from p group by 1),
t as (select *, id % 4 = 0 as ai, id % 6 = 0 as policy from g) select id, (row_number() over (order by policy, case when ai then 5 else 0 end desc, since desc, well desc, ai desc, n desc, id))::int as rank from t"""
)
def groups_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Story groups in a reader's order: blocked topics last, then wanted topics, the newest, well-known sources; a source is switched off."""
    p = _lines(spark, d).withColumn("source", F.expr(_WELL))
    g = p.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct("source")).alias("perspectives"), F.max(F.when(F.col("source") != "S4", F.col("l_shipdate"))).alias("created_at"))
    topics = F.expr("array_compact(array(case when id % 4 = 0 then 'AI' end, case when id % 6 = 0 then 'policy' end, 'Other'))")
    out = serving.rank_groups(g.withColumn("topic_tags", topics).withColumn("title", F.lit("T")), serving.Preferences(["AI"], ["policy"], [" s4 "]))
    return out.select("id", F.col("rank").cast("int").alias("rank"))


@query(
    """with recursive p as (select event_id, case when event_id % 3 = 0 then 'u' || event_id % 400 end as url, event_type || ' ' || event_id % 500 as t, 5.0 + floor(coalesce(value, 0)) + user_id % 7 * 2 + event_id % 5 * 0.5 as score from events where event_id % 3 = 0),
o as (select *, row_number() over (order by score desc, event_id) as pos from p), s(pos, event_id, keep, keys, texts) as (select 0::bigint, null::bigint, false, []::varchar[], []::varchar[]
 union all select o.pos, o.event_id, not (list_contains(s.keys, o.url) or list_contains(s.texts, o.t)), case when list_contains(s.keys, o.url) or list_contains(s.texts, o.t) then s.keys else list_append(s.keys, o.url) end, case when list_contains(s.keys, o.url) or list_contains(s.texts, o.t) then s.texts else list_append(s.texts, o.t) end
 from s join o on o.pos = s.pos + 1 where s.pos < 2000)
select event_id, score from s join p using (event_id) where keep order by s.pos limit 60"""
)
def social_feed_top(spark: SparkSession, d: str) -> DataFrame:
    """The best 60 posts of all that have a link, none of which repeats the address or the text of a better one."""
    e = table(spark, d, "events")
    posts = e.select(
        F.col("event_id").cast("string").alias("id"), F.expr("case when event_id % 3 = 0 then concat('u', event_id % 400) end").alias("url"), F.lit(None).cast("string").alias("post_url"), F.expr("concat(event_type, ' ', event_id % 500)").alias("text"),
        F.floor(F.coalesce("value", F.lit(0))).alias("likes"), (F.col("user_id") % 7).alias("reposts"), (F.col("event_id") % 5).alias("replies"), F.col("event_id").alias("seq"),
    )
    return serving.social_feed(posts, ()).select(F.col("seq").alias("event_id"), "score")


# -- published tables, read back


@query(f"{_VEC}, p as (select a.vec_id as id, b.vec_id as neighbour, b.vec_id % 20 as src, list_dot_product(a.e, b.e) / (a.nrm * b.nrm) as sim from n a join n b on a.label = b.label and a.vec_id <> b.vec_id), c as (select *, row_number() over (partition by id, src order by sim desc, neighbour) as r from p where sim >= 0.3), k as (select *, row_number() over (partition by id order by sim desc, neighbour) as rank from c where r <= 2) select id, string_agg(neighbour::varchar, '|' order by rank) as neighbours from k where rank <= 5 group by 1")
def published_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 20).alias("source"), F.array("label").alias("tags"), "embedding", F.col("vec_id").alias("seq"))
    root = sinks.scratch_path(spark, "published")
    sinks.publish({"neighbors": knn.neighbours(v, 0.3, 5, 2)}, root)
    back = sinks.snapshot(spark, f"{root}/neighbors")
    lists = back.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour").cast("string").alias("n")))).alias("xs"))  # five at most
    return lists.select("id", F.array_join("xs.n", "|").alias("neighbours"))


@query(
    "with m as (select doc_id, doc_id % 97 as lead, (doc_id * 37) % 1000 as since, doc_id % 6 as t, case when doc_id % 2 = 0 then 'even' else 'odd' end as parity, 'k' || doc_id % 97 % 3 as k from documents), g as (select lead, list(doc_id order by doc_id) as ids, max(since) as since, "
    + ", ".join(f"coalesce(string_agg(doc_id::varchar, '|' order by doc_id) filter (where t = {i}), '') as \"{t}\"" for i, t in enumerate(SOURCE_TYPES))
    + ", count(*) filter (where parity = 'even') as e, count(*) filter (where parity = 'odd') as o, any_value(k) as k from m group by 1) select lead as id, array_to_string(ids, '|') as item_ids, (1704067200 + since)::bigint as updated, k || case when e = 0 then '|odd' when o = 0 then '|even' when e >= o then '|even|odd' else '|odd|even' end as tags, "
    + ", ".join(f'"{t}"' for t in SOURCE_TYPES)
    + " from g"
)
def published_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of given leaders with the latest time of their members, their tags and lenses."""
    docs = table(spark, d, "documents")
    types = F.get(F.array(*map(F.lit, SOURCE_TYPES)), (F.col("doc_id") % 6).cast("int"))
    of = F.array(F.concat(F.lit("k"), F.col("doc_id") % 97 % 3), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    rows = docs.select(F.col("doc_id").alias("id"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 37 % 1000).alias("published_at"), types.alias("source_type"), of.alias("tags"))
    leaders = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 97).alias("leader"), F.col("doc_id").alias("pos"))
    root = sinks.scratch_path(spark, "published")
    sinks.publish({"clusters": build.clusters_of(rows, leaders)}, root)
    back = sinks.snapshot(spark, f"{root}/clusters")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return back.select("id", listed(F.col("item_ids")).alias("item_ids"), F.unix_seconds("updated_at").alias("updated"), F.array_join("tags", "|").alias("tags"), *(listed(F.col("lenses")[t]).alias(t) for t in SOURCE_TYPES))


@query(_assembled("with leads as (select doc_id, doc_id % 83 as lead from documents)"))
def published_groups(spark: SparkSession, d: str) -> DataFrame:
    """Story groups of given leaders, the table that readers are served from."""
    groups = views.assembled(_grouped_items(spark, d).withColumn("leader", F.col("id") % 83), tags=tags.topic_tags(F.col("summary"), F.lit("")))
    root = sinks.scratch_path(spark, "published")
    sinks.publish({"story_groups": views.heuristic_summary(groups)}, root)
    return _group_rows(sinks.snapshot(spark, f"{root}/story_groups"))


@query("with n as (select page_id * 2 as id, url from pages where page_id % 100 = 0 union all select page_id * 2 + 1, url || '-new' from pages where page_id % 100 = 0) select id from n where url not in (select url from pages where url is not null)")
def unseen_published(spark: SparkSession, d: str) -> DataFrame:
    """Which of new rows' addresses a published table doesn't have; every hundredth page and a changed address of each ask."""
    pages = table(spark, d, "pages").select("page_id", "url")
    path = sinks.scratch_path(spark, "addresses")
    sinks.write_version(pages, path, 1, key="url")
    few = pages.where("page_id % 100 = 0")
    new = few.select((F.col("page_id") * 2).alias("id"), "url").unionByName(few.select((F.col("page_id") * 2 + 1).alias("id"), F.concat("url", F.lit("-new")).alias("url")))
    return joins.unseen_in(new, sinks.current(spark, path), "url").select("id")


@query("select event_type, count(*) as n, count(distinct user_id) as users, true as users_near, true as events_near from events group by 1")
def distinct_by_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users and events over three published versions, from the sketches that each left; near: within 3 % of the exact count."""
    e = table(spark, d, "events")
    root = sinks.scratch_path(spark, "sketches")
    for k in range(3):
        sinks.write_version(aggregates.sketched(e.where(F.col("event_id") % 3 == k), ["event_type"], "user_id", "event_id"), root, k, keep=3)
    kept = spark.read.parquet(*(f"{root}/v={k}" for k in range(3)))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.03 * F.col(b) + 1
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"))
    merged = aggregates.sketches_merged(kept, ["event_type"], "user_id", "event_id").join(exact, "event_type")
    return merged.select("event_type", "n", "users", near("user_id", "users").alias("users_near"), near("event_id", "events").alias("events_near"))


# -- generators


@query("select doc_id as id, case when doc_id % 3 = 0 then coalesce(v.n, -1) else 2 + length(lang) end::double as first from documents left join (select vec_id, len(embedding) as n from embeddings) v on vec_id = doc_id")
def vectors_attached(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from a table, and from a model that is asked with the text that an article's vector is made of."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("description"), F.col("lang").alias("summary"), F.lit(None).cast("string").alias("extracted_text"))
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(F.size("embedding").cast("double")).alias("embedding"))
    own = enrich.with_vectors(docs.where("id % 3 = 0"), stored)
    made = enrich.with_vectors(docs.where("id % 3 > 0"), model=lambda rows, strict: [json.dumps([len(t)]) for t in rows["_text"]])
    return own.select("id", "embedding").unionByName(made.select("id", "embedding")).select("id", F.coalesce(F.get("embedding", F.lit(0)), F.lit(-1.0)).alias("first"))


#: What a model gives that is valid for each generator, which the other queries don't ask.
_MADE = {
    "tags": '["AI"]', "lite_summary": "\n".join(f"- bullet {k} and some more words" for k in range(4)), "bundle": '{"summary":[],"bias":0}', "trust": '{"whats_missing":[],"so_what":{},"framing":{}}', "reaction": "mixed",
    "bias": '{"vestedInterests":[],"framingBias":[],"confidence":1}', "missing": "what is missing", "impact": '{"shortTerm":[],"longTerm":[]}', "long_text": "word " * 90, "title_only": "- T",
}


@query("with n(name, place) as (values " + ", ".join(f"('{k}', {i})" for i, k in enumerate(_MADE)) + ") select doc_id as id, name, (doc_id + place) % 3 > 0 as made, (doc_id + place) % 3 = 1 as again from documents, n")
def generators_asked(spark: SparkSession, d: str) -> DataFrame:
    """Each generator over all items: what is valid at once, what is valid when it is asked for strictly, and what gets the fallback."""
    docs = texts(spark, d).select(F.col("doc_id").alias("id"), F.lit("T").alias("title"), F.lit("S").alias("summary"), F.col("doc_id").cast("string").alias("extracted_text"), F.array(F.lit("c")).alias("comments"))
    out = None
    for at, (name, good) in enumerate(_MADE.items()):
        of = enrich.GENERATORS[name]
        inputs = of.inputs
        key = F.when((F.col("id") + at) % 3 == 2, "at once").when((F.col("id") + at) % 3 == 1, "again").otherwise("never")
        rows = docs.withColumn(inputs[0], key)  # what the model sees

        def model(frame, strict, good=good, column=inputs[0]):
            return [good if k == "at once" or (k == "again" and strict) else None for k in frame[column]]

        got = of(rows, model).select("id", F.lit(name).alias("name"), (F.col("output") == good).alias("made"), (F.col(inputs[0]) == "again").alias("again"))
        out = got if out is None else out.unionByName(got)
    return out
