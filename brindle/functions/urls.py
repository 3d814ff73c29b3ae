"""URL expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import TRACKING_PARAMETERS


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters and a final slash; what is no http(s) URL stays as it is.

    Scheme and host are lower-cased and a default port goes, as in a WHATWG parser; parameters keep their encoding.
    """
    found = lambda k: F.regexp_extract(url, r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", k)
    scheme = F.lower(found(1))
    host = F.regexp_replace(F.lower(found(2)), F.when(scheme == "https", F.lit(":443$")).otherwise(F.lit(":80$")), F.lit(""))
    path = F.when(found(3) == "", F.lit("/")).otherwise(found(3))
    path = F.when((F.length(path) > 1) & path.endswith("/"), path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(F.substring(found(4), 2, 1 << 30), "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING_PARAMETERS) & ~F.lower(name(p)).startswith("utm_"))
    query = F.array_join(kept, "&")
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (found(2) != ""), whole).otherwise(url)


def domain(url: Column) -> Column:
    """Host in lower case without a leading www.; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def stable_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts joined by bars; null parts count as empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.substring(F.sha2(joined, 256), 1, 24)


def news_search_url(query: Column) -> Column:
    """The RSS URL of a news search."""
    return F.concat(F.lit("https://news.google.com/rss/search?q="), F.replace(F.url_encode(query), F.lit("+"), F.lit("%20")), F.lit("&hl=en-US&gl=US&ceid=US:en"))


def favicon_url(url: Column, size: int = 128) -> Column:
    return F.concat(F.lit("https://www.google.com/s2/favicons?domain="), domain(url), F.lit(f"&sz={size}"))


def forum_item_id(url: Column) -> Column:
    """The numeric id= of a forum item's URL."""
    return F.nullif(F.regexp_extract(url, r"^https?://news\.ycombinator\.com/item\?(?:[^#]*&)?id=(\d+)", 1), F.lit("")).cast("long")


def thread_id(url: Column) -> Column:
    """The id after /comments/ in a thread's URL."""
    return F.nullif(F.regexp_extract(url, r"/comments/([A-Za-z0-9]+)", 1), F.lit(""))


def redirect_target(url: Column, parameter: str = "uddg") -> Column:
    """Where a search engine's redirect leads; other URLs stay."""
    target = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).otherwise(url)


def web_url(url: Column) -> Column:
    """http and https URLs without their fragment, else null."""
    return F.when(url.rlike("(?i)^https?://"), F.regexp_replace(url, "#.*$", ""))
