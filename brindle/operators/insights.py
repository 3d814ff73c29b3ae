"""Deterministic stand-ins for insights, subgroup packing, image choice, search results, connector counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.hashing import fnv1a, fnv1a_abs
from ..functions.similarity import tokens
from ..functions.text import bound, good_bullets, json_object, strip_html, trim
from ..functions.trust import claim_status, final_status, soft_citations
from ..functions.urls import domain, redirect_target, web_url
from .cluster import _jaccard

# Labels, outlets and templates of mock perspectives and bundles.
LABELS = ("Media", "Community", "Primary", "Skeptical")
SOURCE_NAMES = {"Media": "Media roundup (mock)", "Community": "Community (mock)", "Primary": "Primary source (mock)", "Skeptical": "Skeptical take (mock)"}
COVERED_BY = (("AP", "Reuters", "Bloomberg", "The Verge", "FT", "Guardian"), ("Local wire", "Reddit thread", "Official blog", "Press release"), ("Analyst note", "Community post", "Primary doc", "Explainer"))
BIAS_LABELS = ("Left", "Center", "Right", "Mixed")
MISSING_SIGNALS = {"Strong": "No missing signals detected (mock).", "Medium": "No primary source found yet.", "Weak": "Limited cross-source confirmation so far."}


def pick(options: tuple[str, ...], seed: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), (seed % len(options)).cast("int"))


def mock_perspectives(stories: DataFrame) -> DataFrame:
    """Four labelled perspectives for each story(id, title, source, summary, url, published_at)."""
    seed = fnv1a(F.concat_ws("|", "id", "title"))
    rows = stories.withColumn("_seed", seed).select("*", F.posexplode(F.array(*map(F.lit, LABELS))).alias("i", "label"))
    seed = F.col("_seed")
    covered = F.filter(F.array(F.col("source"), *(pick(o, seed + k + 1) for k, o in enumerate(COVERED_BY))), lambda x: F.coalesce(x, F.lit("")) != "")
    names = F.create_map(*(F.lit(x) for kv in SOURCE_NAMES.items() for x in kv))
    skeptical = F.col("label") == "Skeptical"
    return rows.select(
        F.concat_ws(":", "id", F.lower("label")).alias("id"), F.col("id").alias("story_id"), "label", names[F.col("label")].alias("source_name"), F.concat(F.col("title"), F.when(F.col("i") == 0, "").otherwise(F.concat(F.lit(" (Alt "), F.col("i") + 1, F.lit(")")))).alias("title"),
        F.concat(F.col("label"), F.lit(" lens: "), F.col("summary")).alias("summary"), F.when(skeptical, "Skeptical").otherwise("Neutral").alias("tone"), F.slice(covered, 1, (F.lit(3) + (seed + F.col("i")) % 2).cast("int")).alias("covered_by"), "url", "published_at",
    )


def mock_insights(items: DataFrame, now: Column) -> DataFrame:
    """A trust dashboard and statuses for each item(id, title, summary, source_types, published_at), from a hash of its id and its sources."""
    rows = items.withColumn("_h", fnv1a_abs(F.col("id")))
    h, types = F.col("_h"), F.col("source_types")
    bounded = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(100)).cast("int")
    shifted = lambda n: F.shiftright(h.cast("long"), n)
    of = lambda t: F.size(F.filter(types, lambda x: x == t))
    selection = F.struct(bounded(55 + h % 40).alias("relevance"), bounded(40 + shifted(2) % 55).alias("freshness"), bounded(35 + shifted(3) % 60).alias("trending"), bounded(30 + shifted(4) % 65).alias("information_gain"))
    framing = F.struct(bounded(h % 101).alias("political"), bounded(shifted(1) % 101).alias("tech_sentiment"), bounded(shifted(5) % 101).alias("power_lens"))
    coverage = F.struct(F.size(types).alias("sources"), of("editorial").alias("media"), of("community").alias("community"), of("primary").alias("official"), T.level(F.size(types)).alias("agreement"))
    confidence = F.when((F.size(types) >= 6) & (of("primary") > 0), "High").when(F.size(types) < 3, "Low").otherwise("Medium")
    evidence = T.evidence(types)
    missing = F.create_map(*(F.lit(x) for kv in MISSING_SIGNALS.items() for x in kv))[evidence]
    status = T.speculation(F.col("title"), F.col("summary"), F.col("published_at"), now)
    return rows.select("id", selection.alias("selection"), framing.alias("framing"), coverage.alias("coverage"), confidence.alias("confidence"), evidence.alias("evidence"), missing.alias("missing"), status.alias("speculation"), pick(BIAS_LABELS, h).alias("bias"), (h % 7 == 0).alias("vested_interest"))


def pack(perspectives: list[dict], least: float = 0.06, most: int = 3) -> list[list[str]]:
    """Greedy packing in order: the first unused one with good bullets, and up to two more of other sources, the most similar first."""
    used: set[str] = set()
    out = []
    while (seed := next((p for p in perspectives if p["id"] not in used and p["good"]), None)) is not None:
        own = set(seed["tokens"])
        rest = [(_jaccard(own, set(p["tokens"])), p) for p in perspectives if p["id"] not in used and p["id"] != seed["id"]]
        chosen, sources = [seed], {(seed["source"] or "").lower()}
        for sim, p in sorted(rest, key=lambda x: -x[0]):
            source = (p["source"] or "").lower()
            if len(chosen) < most and sim >= least and source and source not in sources:
                chosen.append(p)
                sources.add(source)
        used.update([seed["id"]] if len(chosen) < 2 else [p["id"] for p in chosen])
        if len(chosen) > 1:
            out.append([p["id"] for p in chosen])
    return out


def subgroups(groups: DataFrame, keep: int = 5) -> DataFrame:
    """group_id, subgroup, ids: groups of at most `keep` perspectives as they are, newest first; larger ones, a row each, are packed."""
    one = lambda p, i: F.struct(p["published_at"].alias("at"), (-i).alias("i"), p["id"].cast("string").alias("id"), p["source"].alias("source"), p["title"].alias("title"), p["summary"].alias("summary"))
    rows = groups.select(F.col("id").alias("group_id"), F.sort_array(F.transform("perspectives", one), asc=False).alias("ps"))
    whole = rows.where(F.size("ps").between(1, keep)).select("group_id", F.lit(0).alias("subgroup"), F.col("ps.id").alias("ids"))
    parts = F.transform("ps", lambda p: F.struct(p["id"].alias("id"), p["source"].alias("source"), tokens(p["title"], False).alias("tokens"), good_bullets(p["summary"]).alias("good")))
    kind = f"group_id {groups.schema['id'].dataType.simpleString()}, subgroup int, ids array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(g, k, ids) for g, ps in zip(frame["group_id"], frame["ps"], strict=True) for k, ids in enumerate(pack(list(ps)))]
            yield pd.DataFrame(found, columns=["group_id", "subgroup", "ids"])

    return whole.unionByName(rows.where(F.size("ps") > keep).select("group_id", parts.alias("ps")).mapInPandas(run, kind))


def chosen_image(candidates: Column, page_image: Column, stored: DataFrame, items: DataFrame, placeholder: str = "/placeholder.svg", least_width: int = 300, most: int = 4000, favicon: Column | None = None) -> DataFrame:
    """items with image: the first candidate, then the page's own image, that is stored(url, path, width) and wide enough, for the
    first `most` items by seq that have one; else the site's icon, else the placeholder."""
    wide = stored.where(F.col("width") >= least_width).select(F.col("url").alias("_u"), F.col("path").alias("_p"))
    tries = items.select("id", "seq", F.posexplode(F.concat(F.coalesce(candidates, F.array().cast("array<string>")), F.array(page_image))).alias("pos", "_u")).where("trim(_u) <> ''")
    best = tries.withColumn("_u", F.trim("_u")).join(wide, "_u").groupBy("id", "seq").agg(F.min_by("_p", "pos").alias("_image"))
    best = best.orderBy("seq").limit(most).select("id", "_image")
    return items.join(best, "id", "left").withColumn("image", F.coalesce("_image", favicon if favicon is not None else F.lit(None), F.lit(placeholder))).drop("_image")


def search_results(page: Column, most: int = 3) -> Column:
    """URLs of a landed search page: those in its text, else the links of its results."""
    found = F.regexp_extract_all(page, F.lit(r"(https?://[^\s)\]]+)"), 1)
    urls = F.filter(found, lambda u: ~u.contains("duckduckgo.com/html") & ~u.contains("external-content.duckduckgo.com"))
    links = F.transform(F.regexp_extract_all(page, F.lit(r'class="result__a"[^>]*href="([^"]+)"'), 1), lambda u: F.when(u.startswith("/l/?"), redirect_target(u)).otherwise(u))
    return F.slice(F.when(F.size(urls) > 0, F.array_distinct(urls)).otherwise(links), 1, most)


def connector_counts(items: DataFrame, connector: Column) -> DataFrame:
    return items.groupBy(connector.alias("connector")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def context(title: Column, html: Column, most: int = 8000) -> Column:
    """What a question about an article is answered from."""
    return F.concat_ws("\n\n", title, F.substring(strip_html(html), 1, most))


# Answers to a request that show that the page is there.
REACHABLE = (401, 403, 405)


def valid_citations(citations: DataFrame, responses: DataFrame, own: Column) -> DataFrame:
    """citations(url) whose web address, not the article's own, answered a HEAD or a GET; responses(url, method, status) are landed."""
    good = responses.where(F.col("status").between(200, 299) | F.col("status").isin(*REACHABLE)).where(F.col("method").isin("HEAD", "GET"))
    rows = citations.withColumn("url", web_url(F.col("url"))).where(F.col("url").isNotNull() & ~F.col("url").eqNullSafe(web_url(own)))
    return rows.join(good.select("url").distinct(), "url", "left_semi")


def verified(articles: DataFrame, searches: DataFrame, most: int = 3, citations: int = 2) -> DataFrame:
    """articles(id, url, answer) -> id, pos, claim, status, citations: the first claims of a model's JSON answer.

    A claim's citations are the model's, else those that a search for the claim found, else those of a search for the title
    (searches(id, claim, urls), claim null for the title): web addresses of other domains than the article's, one a domain.
    """
    answer = F.from_json(json_object(F.col("answer")), "claims array<struct<claim:string,status:string,citations:array<string>>>")
    claims = articles.select("id", F.col("url").alias("_own"), F.posexplode(F.slice(answer["claims"], 1, most)).alias("pos", "_c"))
    claims = claims.withColumn("claim", trim(F.coalesce("_c.claim", F.lit(""))))
    claims = claims.withColumn("_site", domain(F.col("_own")))
    found = searches.where("claim is not null").select(F.col("id").alias("_i"), F.col("claim").alias("_q"), F.col("urls").alias("_found"))
    titles = searches.where("claim is null").select(F.col("id").alias("_t"), F.col("urls").alias("_title"))
    rows = claims.join(found, (F.col("id") == F.col("_i")) & (F.col("claim") == F.col("_q")), "left").join(titles, F.col("id") == F.col("_t"), "left")
    # of each list once: whether it has any, and what it has
    of = lambda urls: bound(F.slice(distinct_domains(soft_citations(urls, F.col("_own"), web_url), F.col("_site")), 1, citations), lambda x: F.when(F.size(x) > 0, x))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("citations", F.coalesce(of(F.col("_c.citations")), F.when(F.col("claim") != "", of(F.col("_found"))), of(F.col("_title")), none))
    return rows.select("id", "pos", "claim", final_status(claim_status(F.col("_c.status")), F.col("citations")).alias("status"), "citations")


def distinct_domains(urls: Column, own: Column) -> Column:
    """The first address of each domain but one's own; those without a domain go. Each domain is computed once."""
    pairs = F.filter(F.transform(urls, lambda u: F.struct(u.alias("url"), domain(u).alias("site"))), lambda p: p["site"].isNotNull() & ~p["site"].eqNullSafe(own))
    start = F.array().cast("array<struct<url:string,site:string>>")
    return F.aggregate(pairs, start, lambda seen, p: F.when(F.exists(seen, lambda s: s["site"] == p["site"]), seen).otherwise(F.concat(seen, F.array(p))))["url"]
