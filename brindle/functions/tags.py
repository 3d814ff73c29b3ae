"""Topics, tags, stances and statuses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import match_text
from .text import SPACE, bound, collapse, trim
from .values import FRAMINGS, HEDGE_WORDS, HIGH_SIGNAL_TAGS, OPTIMISTIC, RUMOR_WORDS, SKEPTICAL, SOCIAL_TOPICS, TAG_SYNONYMS, TOKEN_TAGS, TOPICS


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is a substring; those that hold another one are not looked for, short ones come first."""
    out = F.lit(False)
    for w in sorted((w for w in words if not any(v in w and v != w for v in words)), key=len):
        out = out | text.contains(w)
    return out


def haystack(title: Column, summary: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))


def topic_tags(title: Column, summary: Column) -> Column:
    """Topics of which a keyword is a substring of title and summary, else general."""
    found = lambda text: F.array_compact(F.array(*(F.when(any_of(text, words), F.lit(t)) for t, words in TOPICS.items() if t != "general")))
    return bound(bound(haystack(title, summary), found), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("general"))))


def social_topics(text: Column, topics: tuple[str, ...]) -> Column:
    """Of the topics asked for, those with a keyword in a post; an unknown topic is its own keyword."""
    if not topics:
        return F.array().cast("array<string>")
    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_compact(F.array(*(F.when(any_of(low, SOCIAL_TOPICS.get(t.strip().lower(), (t.strip().lower(),))), F.lit(t)) for t in topics))))


def tag_key(tag: Column) -> Column:
    return match_text(tag)


def _lookup(key: Column, of: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in of.items() for x in kv))
    return F.try_element_at(pairs, key)


_CANONICAL = {" ".join("".join(c if c.isalnum() else " " for c in word).split()): tag for word, tag in TAG_SYNONYMS.items()} | {t.lower(): t for t in HIGH_SIGNAL_TAGS}


def canonical_tag(tag: Column) -> Column:
    """The high-signal tag that a tag stands for, or null."""
    return _lookup(tag_key(tag), _CANONICAL)


def high_signal(tags: Column, most: int = 6) -> Column:
    """Distinct canonical tags in order."""
    return F.slice(F.array_distinct(F.array_compact(F.transform(tags, canonical_tag))), 1, most)


# Tags of up to three letters that are kept.
SHORT_TAGS = ("AI", "ML", "GPU", "CPU", "API", "AWS", "GCP", "iOS", "SaaS")


def clean_tags(tags: Column) -> Column:
    """Tags of a generator: trimmed of marks, 2 to 48 characters, no single letters, distinct without regard to case."""
    bare = F.transform(tags, lambda t: collapse(F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), rf"^(?:[#*]|{SPACE})+", ""), rf"(?:[-–—]|{SPACE})+$", "")))
    good = F.filter(bare, lambda t: F.length(t).between(2, 48) & ~F.exists(F.split(t, " "), lambda w: F.length(w) == 1) & ((F.length(t) > 3) | t.isin(*SHORT_TAGS)))
    return F.filter(good, lambda t, i: F.array_position(F.transform(good, F.lower), F.lower(t)) == i + 1)


def token_tags(text: Column, most: int = 6) -> Column:
    """Tags that single words stand for."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\t-\r -]", " "), f"{SPACE}+")
    return F.slice(F.array_distinct(F.array_compact(F.transform(words, lambda w: _lookup(w, TOKEN_TAGS)))), 1, most)


def _words(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\t-\r -]", " ")


def allowed_tag_score(text: Column, tag: Column) -> Column:
    """5 for a tag as words of the text, 2 as a substring, 1 for each of its words."""
    return bound(_spaced(collapse(_words(text))), lambda joined: tag_score(joined, tag))


def _spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), words, F.lit(" "))


def tag_score(joined: Column, tag: Column) -> Column:
    """allowed_tag_score in a text that is plain words between single spaces."""
    whole = F.lower(trim(tag))
    words = F.filter(F.split(collapse(_words(whole)), " "), lambda w: w != "")
    return F.when(joined.contains(_spaced(whole)), 5).otherwise(0) + F.when(joined.contains(whole), 2).otherwise(0) + F.size(F.filter(words, lambda w: joined.contains(_spaced(w))))


def allowed_tag_scores(text: Column, tags: list[str]) -> Column:
    """(pos, tag, score) of each tag in a text, which is made plain once."""
    return bound(_spaced(collapse(_words(text))), lambda joined: F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(t).alias("tag"), tag_score(joined, F.lit(t)).alias("score")) for i, t in enumerate(tags))))


def topic_key(topics: Column) -> Column:
    out = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(topics, lambda t: F.lower(trim(t))), lambda t: t != ""))), "|")
    return F.when(out == "", "all").otherwise(out)


def stance(title: Column, summary: Column) -> Column:
    return bound(haystack(title, summary), lambda text: F.when(any_of(text, SKEPTICAL), "skeptical").when(any_of(text, OPTIMISTIC), "mainstream").otherwise("balanced"))


def framing(stance_tag: Column) -> Column:
    return F.when(stance_tag == "skeptical", FRAMINGS["skeptical"]).when(stance_tag == "mainstream", FRAMINGS["mainstream"]).otherwise(FRAMINGS["balanced"])


def speculation(title: Column, summary: Column, published: Column, now: Column) -> Column:
    recent = (now.cast("double") - published.cast("double")) / 60 < 90
    hedged = bound(haystack(title, summary), lambda text: any_of(text, RUMOR_WORDS) | any_of(text, HEDGE_WORDS))
    return F.when(hedged, "Speculative").when(recent, "Developing").otherwise("Confirmed")


def evidence(source_types: Column) -> Column:
    return F.when(F.array_contains(source_types, "primary"), "Strong").when(F.size(source_types) >= 3, "Medium").otherwise("Weak")


def level(sources: Column) -> Column:
    """Agreement or confidence by the number of sources."""
    return F.when(sources >= 6, "High").when(sources >= 3, "Medium").otherwise("Low")


def source_class(source_type: Column) -> Column:
    """Six source types as four."""
    return F.when(source_type.isin("editorial", "community", "primary", "social"), source_type).otherwise("editorial")
