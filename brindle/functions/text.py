"""Text, HTML and Markdown expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .article import article_of

# White space as JavaScript's \s has it, and HTML entities in the order of decoding.
SPACE = r"[\t-\r    -     　﻿]"
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SEPARATORS = " \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"  # Unicode's Zs, what trim() of SQL engines takes away
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it; branches of conditions would compute it anew."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def bare(c: Column) -> Column:
    """trim() of long texts: looks at their ends only."""
    return F.btrim(c, F.lit(SPACES))


def trim_separators(c: Column) -> Column:
    """Without spaces at the ends, of whatever width; tabs and line ends stay."""
    return F.btrim(c, F.lit(SEPARATORS))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first that isn't blank, untrimmed."""
    return F.coalesce(*(F.when(trim(c) != "", c) for c in cs))


def strip_html(html: Column, entities: bool = True) -> Column:
    """Text of HTML: scripts and styles go, tags become spaces, five entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<script.*?</script>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<style.*?</style>", ""), r"</?[^>]+>", " ")
    for entity, char in ENTITIES if entities else ():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def strip_tags(html: Column) -> Column:
    return collapse(F.regexp_replace(html, r"</?[^>]+>", " "))


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def first_image(html: Column) -> Column:
    return _found(html, r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']")


def _near(html: Column, mark: str, attribute: str, reach: int = 400) -> Column:
    """The attribute's first value within reach of a mark, even if another tag has it."""
    at = F.locate(mark, F.lower(html)) - 1
    start = F.greatest(F.lit(0), at - reach)
    return F.when(at >= 0, _found(html.substr(start + 1, at + reach - start), rf"(?i){attribute}=[\"']([^\"']+)[\"']"))


def canonical_link(html: Column) -> Column:
    return _near(html, 'rel="canonical"', "href")


def page_image(html: Column) -> Column:
    """og:image, else twitter:image, else the first image."""
    return F.coalesce(_near(html, 'property="og:image"', "content"), _near(html, 'name="twitter:image"', "content"), first_image(html))


def head_html(html: Column, limit: int = 64_000) -> Column:
    """The first bytes of a page in UTF-8, without a character that they cut, up to the end of </head>."""
    raw = F.encode(html, "UTF-8")
    within = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")  # noqa: E731; a byte that goes on with a character
    end = F.when(~within(limit + 1), limit).when(~within(limit), limit - 1).when(~within(limit - 1), limit - 2).otherwise(limit - 3)
    start = F.when(F.octet_length(html) <= limit, html).otherwise(F.decode(raw.substr(F.lit(1), end), "UTF-8"))
    end = F.locate("</head>", F.lower(start))
    return F.when(end > 0, start.substr(F.lit(1), end + 6)).otherwise(start)


def article_text(html: Column, limit: int = 8000) -> Column:
    """The article by its blocks' density, else all text; at most limit characters, null if empty."""
    text = F.coalesce(article_of(html), strip_html(html, entities=False))
    return F.nullif(F.substring(text, 1, limit), F.lit(""))


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)\bhttps?://[^\s)]+", 0), F.lit(""))


def clamp_text(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def plain_number(value: Column) -> Column:
    """A double of 1E-15 to 1E15 as its shortest digits, without an exponent."""
    digits = value.cast("string")
    return F.when(digits.contains("E"), F.regexp_replace(digits.try_cast("decimal(38,22)").cast("string"), r"(\.\d+?)0+$", "$1")).otherwise(digits)


def parse_date(text: Column, otherwise: Column) -> Column:
    """ISO 8601 or RFC 822, else what is given."""
    bare = F.regexp_replace(text, "^[A-Za-z]{3}, *", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), otherwise)


def latest_iso(a: Column, b: Column) -> Column:
    """The later of two ISO times as text; where one is null or empty, the first that isn't null."""
    return F.when((a != "") & (b != ""), F.greatest(a, b)).otherwise(F.coalesce(a, b))


def ago(ts: Column, now: Column) -> Column:
    """Minutes, hours or days before now, as 5m ago."""
    minutes = F.greatest(F.lit(0), F.floor((now.cast("double") - ts.cast("double")) / 60))
    hours = F.floor(minutes / 60)
    label = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 60, label(minutes, "m")).when(hours < 24, label(hours, "h")).otherwise(label(F.floor(hours / 24), "d"))


def minutes_label(minutes: Column) -> Column:
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(minutes / 60 + 0.5).cast("string"), F.lit("h ago")))


def bullets(markdown: Column) -> Column:
    """Lines that start with a dash and a space, without it."""
    lines = F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), bare)
    return F.filter(F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: bare(F.regexp_replace(x, rf"^-+{SPACE}*", ""))), lambda x: x != "")


def bullets_or_line(text: Column) -> Column:
    """Bullets, else the whole text as one line, if it isn't blank."""
    line = bound(bare(text), lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.array(x)).otherwise(F.array().cast("array<string>")))
    return bound(bullets(text), lambda found: F.when(F.size(found) > 0, found).otherwise(line))


def good_bullets(markdown: Column) -> Column:
    """Two to eight bullets of at most 140 characters, without stock phrases."""
    low = F.lower(F.coalesce(markdown, F.lit("")))
    few = bound(bullets(markdown), lambda found: F.size(found).between(2, 8) & ~F.exists(found, lambda b: F.length(b) > 140))
    return few & bound(low, lambda x: ~x.contains("not specified") & ~x.contains("key points:"))


def summary_bullets(title: Column, markdown: Column, least: int = 2) -> Column:
    """A summary's first six bullets; the title alone where they are too weak."""
    found = F.filter(F.transform(bullets(markdown), lambda b: bare(F.regexp_replace(b, rf"(?i)^key points:?{SPACE}*", ""))), lambda b: ~F.lower(b).contains("not specified") & ~F.lower(b).contains("as an ai"))
    vague = F.lower(F.coalesce(markdown, F.lit(""))).contains("not specified")
    fallback = F.filter(F.array(bare(F.coalesce(title, F.lit("")))), lambda t: t != "")
    return bound(found, lambda x: F.when((F.size(x) < max(1, least)) | F.exists(x, lambda b: F.length(b) > 220) | vague, fallback).otherwise(F.slice(x, 1, 6)))


def unique_strings(items: Column) -> Column:
    """Trimmed, without blanks, each once in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def to_markdown(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda b: F.concat(F.lit("- "), b)), "\n")


def valid_summary(markdown: Column, least: int = 120) -> Column:
    """Long enough, four or five bullets, no disclaimer."""
    n = F.size(F.filter(F.split(markdown, "\n"), lambda x: bare(x).startswith("- ")))
    good = (F.length(markdown) >= least) & bound(n, lambda k: k.between(4, 5))
    return F.coalesce(good & ~disclaims(markdown), F.lit(False))


def valid_text(text: Column, least: int = 400) -> Column:
    """Long enough and no disclaimer."""
    return F.coalesce((F.length(text) >= least) & ~disclaims(text), F.lit(False))


# First words of bullets that hold metadata, in builds and, with the rest, in refreshed summaries.
METADATA = ("source", "source domain", "published", "domain", "topics")
MORE_METADATA = ("updated", "author")


def without_metadata(bullets: Column, refreshed: bool = False) -> Column:
    """Bullets that don't begin with a metadata word. Builds keep all if none is left; refreshed ones are trimmed, blanks go."""
    words = "|".join(METADATA + (MORE_METADATA if refreshed else ()))
    if refreshed:
        return F.filter(F.transform(bullets, trim), lambda b: (b != "") & ~b.rlike(rf"(?i)^({words})\b"))
    return bound(F.filter(bullets, lambda b: ~trim(b).rlike(rf"(?i)^({words})\b")), lambda left: F.when(F.size(left) > 0, left).otherwise(bullets))


def article_body(stored: Column, fetched: Column, description: Column, least: int = 1200) -> Column:
    """The stored text if it is long enough when trimmed, else the fetched one, else the description."""
    return F.when(F.length(trim(stored)) > least, stored).otherwise(F.coalesce(fetched, description, F.lit("")))


def disclaims(text: Column) -> Column:
    return bound(F.lower(text), lambda low: low.contains("as an ai") | low.contains("as a language model"))


def sentence_chunks(text: Column, target: int = 700) -> Column:
    """Sentences joined greedily up to target characters; one chunk of over twice that is cut evenly."""
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + 1 + F.length(s) <= target
        return F.when(acc["cur"] == "", F.struct(acc["out"].alias("out"), s.alias("cur"))).when(fits, F.struct(acc["out"].alias("out"), F.concat(acc["cur"], F.lit(" "), s).alias("cur"))).otherwise(F.struct(F.concat(acc["out"], F.array(acc["cur"])).alias("out"), s.alias("cur")))

    def joined(clean: Column) -> Column:
        sentences = F.filter(F.split(F.regexp_replace(clean, r"([.!?]) ", "$1\n"), "\n"), lambda s: s != "")
        return F.aggregate(sentences, state, add, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))

    even = lambda clean: F.transform(F.sequence(F.lit(0), F.floor((F.length(clean) - 1) / target).cast("int")), lambda i: clean.substr(i * target + 1, F.lit(target)))
    chosen = lambda clean: bound(joined(clean), lambda out: F.when((F.size(out) == 1) & (F.length(clean) > 2 * target), even(clean)).otherwise(out))
    return bound(collapse(F.coalesce(text, F.lit(""))), chosen)


def json_object(text: Column) -> Column:
    """The text if it is JSON, else from its first { to its last } if that is, else null."""
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)  # noqa: E731; "" is no JSON
    return F.coalesce(valid(text), bound(F.regexp_extract(text, r"(?s)\{.*\}", 0), valid))


def embedding_text(title: Column, description: Column, summary: Column, body: Column) -> Column:
    """What an article's vector is made of: title, description or summary, the start of the body."""
    parts = [blank_to_null(title), blank_to_null(F.coalesce(description, summary)), F.nullif(F.substring(body, 1, 1200), F.lit(""))]
    return F.substring(F.concat_ws("\n", *parts), 1, 4000)


def post_title(text: Column, link_title: Column, handle: Column) -> Column:
    """A post's title: of its link, else its first 90 characters, else its author."""
    return F.coalesce(blank_to_null(link_title), F.when(F.length(trim(text)) >= 8, F.substring(trim(text), 1, 90)), F.concat(F.lit("Post from @"), handle))
