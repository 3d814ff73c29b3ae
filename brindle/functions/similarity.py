"""Token sets and similarity measures."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim
from .values import STOPWORDS


def match_text(text: Column) -> Column:
    """Lower case, & as and, all else but letters and digits as spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))  # a run at a time


def plain_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "['’]", ""), "[^a-z0-9]+", " "))


def without_source(title: Column) -> Column:
    """Without bracketed parts and without what stands before a colon among the first 30 characters."""
    bare = F.regexp_replace(F.regexp_replace(title, r"\[[^\]]*\]", " "), r"\([^)]*\)", " ")
    at = F.locate(":", bare)
    return F.when(at.between(2, 30), trim(bare.substr(at + 1, F.length(bare)))).otherwise(bare)


def tokens(title: Column, stopwords: bool = True) -> Column:
    """Distinct words of at least three characters, in order."""
    words = F.filter(F.split(plain_title(title), " "), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS)) if stopwords else words)


def curation_tokens(title: Column) -> Column:
    return tokens(without_source(title))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    norms = norm(F.slice(a, 1, n)) * norm(F.slice(b, 1, n))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
