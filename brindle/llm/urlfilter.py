"""URL filter: rules of hosts and paths, and boosted trees over lexical features for URLs that no rule fits.

All of it is DataFrame expressions. URLs that a rule decides are the labelled ones (block: 1); the trees learn from at most
LABELLED of them, those of least hash. A tree is grown a level at a time: one aggregate sums gradients and Hessians of the log
loss by node, feature and bin, windows run over its sums, and the best split of each node comes back, some numbers a level.
Sums are of whole numbers (in 2^-20), so no order of rows changes a tree. A fitted model is an expression of CASEs. Allowed and
blocked URLs weigh the same in sum, as how many of each the rules decide says nothing about other URLs: one without evidence
scores 0.5.

The features: length of URL and host, depth of the path, digits by length, entropy of the characters in bits, parameters; and of
the host's last label (the suffix) over the whole table: log2 of its URLs, their mean length and depth, and their share of digits.

Defined cases: a URL that is null or has no "://" has an empty host and path, no rule fits it, and the trees judge it by what it
holds (null: an empty text); an empty path starts with no rule's path; of rules that fit the longest wins, of equally long ones
the one with the longer host; without labelled URLs of both kinds the score is the smoothed share of blocked ones; repeated rows
count as rows and null page_ids are carried; other columns are not read.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, spent_by, written

#: The bound of the labelled URLs that are learnt from.
LABELLED = 20_000
BINS, DEPTH, ROUNDS, RATE, L2, LEAST_HESSIAN, UNIT = 32, 3, 10, 0.3, 1.0, 2.0, 1 << 20
FEATURES = ("length", "host_length", "depth", "digits", "entropy", "parameters", "suffix_urls", "suffix_length", "suffix_depth", "suffix_digits")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


# The rules of the query.
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


class Split(NamedTuple):
    """Of a node: rows with x[feature] > edge go right; without a split feature is None. The values are those of the leaves below."""

    feature: int | None
    edge: float
    left: float
    right: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, with A-Z in lower case, and the path."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Host and path of the longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Of the characters of a text, in bits: equal ones are runs of the sorted characters."""
    chars = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0.0).alias("s"))
    term = lambda k: F.when(k > 1, k * F.log2(k.cast("double"))).otherwise(0.0)
    step = lambda a, c: F.when(a["c"] == c, F.struct(a["c"].alias("c"), (a["k"] + 1).alias("k"), a["s"].alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1).alias("k"), (a["s"] + term(a["k"])).alias("s")))
    return F.when(n > 0, F.log2(n) - F.aggregate(chars, start, step, lambda a: a["s"] + term(a["k"])) / n).otherwise(0.0)


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    length = F.length(url).cast("double")
    filled = lambda x, by: F.size(F.filter(F.split(x, by), lambda s: s != "")).cast("double")
    return {
        "length": length, "host_length": F.length(host).cast("double"), "depth": filled(path, "/"), "entropy": entropy(url), "parameters": filled(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"),
        "digits": F.when(length > 0, (length - F.length(F.translate(url, string.digits, ""))) / length).otherwise(0.0),
    }


def _suffix(host: Column) -> Column:
    return F.substring_index(F.substring_index(host, ".", -1), ":", 1)


def suffixes(rows: DataFrame) -> DataFrame:
    """Statistics of all rows(url, host, path) by the last label of the host, without a port."""
    x = _lexical(F.col("url"), F.col("host"), F.col("path"))
    digits = F.length("url") - F.length(F.translate("url", string.digits, ""))
    sums = rows.groupBy(_suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum(F.length("url").cast("long")).alias("l"), F.sum(x["depth"].cast("long")).alias("d"), F.sum(digits.cast("long")).alias("g"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("suffix", F.log2(F.col("n").cast("double")).alias("suffix_urls"), ratio("l", "n").alias("suffix_length"), ratio("d", "n").alias("suffix_depth"), ratio("g", "l").alias("suffix_digits"))


def with_features(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows(url, host, path) with x, the FEATURES; of: suffixes()."""
    x = _lexical(F.col("url"), F.col("host"), F.col("path"))
    joined = rows.withColumn("_suffix", _suffix(F.col("host"))).join(of, F.col("_suffix") == F.col("suffix"), "left")
    return joined.select(*(F.col(c) for c in rows.columns), F.array(*(x[f] if f in x else F.col(f) for f in FEATURES)).alias("x"))


class Trees(NamedTuple):
    base: float
    trees: list[list[Split]]  # a complete tree each: the children of node i are 2i+1 and 2i+2

    def margin(self, x: Column) -> Column:
        def below(tree: list[Split], i: int) -> Column:
            s, last = tree[i], 2 * i + 1 >= len(tree)
            left, right = (F.lit(s.left), F.lit(s.right)) if last else (below(tree, 2 * i + 1), below(tree, 2 * i + 2))
            return left if s.feature is None else F.when(x[s.feature] > s.edge, right).otherwise(left)

        return sum((below(t, 0) for t in self.trees), F.lit(self.base))

    def score(self, x: Column) -> Column:
        """From 0 to 1; higher: a block likelier."""
        return 1 / (1 + F.exp(-self.margin(x)))


def _node(tree: list[Split], x: Column) -> Column:
    """The node, from 0, that rows reach below the complete levels of a growing tree."""

    def below(i: int) -> Column:
        if i >= len(tree):
            return F.lit(i)
        s = tree[i]
        return below(2 * i + 1) if s.feature is None else F.when(x[s.feature] > s.edge, below(2 * i + 2)).otherwise(below(2 * i + 1))

    return below(0)


def fit(sample: DataFrame) -> Trees:
    """Trees over sample(y 0 or 1, x array<double>), a bounded table that is read once a level."""
    n, ones = sample.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return Trees(math.log(share / (1 - share)), [])
    weight = F.when(F.col("y") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones)))
    at = [k / BINS for k in range(1, BINS)]
    edges = [sorted(set(e)) for e in sample.agg(*(F.percentile(F.col("x")[k], at) for k in range(len(FEATURES)))).first()]
    x = F.col("x")
    bins = F.array(*(sum(((x[k] > e).cast("int") for e in edges[k]), F.lit(0)) for k in range(len(FEATURES))))
    rows = written(sample.sparkSession, sample.select("y", "x", bins.alias("b")), "url-bins")
    trees: list[list[Split]] = []
    for _ in range(ROUNDS):
        p = Trees(0.0, trees).score(x)
        now = rows.select("x", "b", F.round((p - F.col("y")) * weight * UNIT).cast("long").alias("g"), F.round(p * (1 - p) * weight * UNIT).cast("long").alias("h"))
        tree: list[Split] = []
        for level in range(DEPTH):
            found = {r["node"]: r for r in _splits(now.select(_node(tree, x).alias("node"), "b", "g", "h")).collect()}
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                r = found.get(node)
                value = lambda g, h: -RATE * g / (h + L2)
                if r is None or r["gain"] <= 1e-6:
                    v = value(r["tg"], r["th"]) if r else 0.0
                    tree.append(Split(None, 0.0, v, v))
                else:
                    tree.append(Split(r["f"], edges[r["f"]][r["k"]], value(r["lg"], r["lh"]), value(r["tg"] - r["lg"], r["th"] - r["lh"])))
        trees.append(tree)
    drop_path(sample.sparkSession, rows._brindle_path)
    return Trees(0.0, trees)


def _splits(rows: DataFrame) -> DataFrame:
    """For each node of rows(node, b, g, h): the best split (f, k: bins above k go right), its gain, sums of its left side and of all."""
    sums = rows.select("node", "g", "h", F.posexplode("b").alias("f", "k")).groupBy("node", "f", "k").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    of, real = Window.partitionBy("node", "f"), lambda c: c / F.lit(float(UNIT))
    run = sums.select("node", "f", "k", *(real(F.sum(c).over(of.orderBy("k"))).alias(f"l{c}") for c in "gh"), *(real(F.sum(c).over(of)).alias(f"t{c}") for c in "gh"))
    part = lambda g, h: g * g / (h + L2)
    lg, lh, tg, th = map(F.col, ("lg", "lh", "tg", "th"))
    gain = F.when((lh >= LEAST_HESSIAN) & (th - lh >= LEAST_HESSIAN), part(lg, lh) + part(tg - lg, th - lh) - part(tg, th)).otherwise(0.0)
    best = run.withColumn("gain", gain).groupBy("node").agg(F.max_by(F.struct("f", "k", "gain", "lg", "lh", "tg", "th"), F.struct("gain", -F.col("f"), -F.col("k"))).alias("s"))
    return best.select("node", "s.*")


def parted(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url (null: empty), host, path, rule and the rule's verdict."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", F.coalesce(url, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    return rows.withColumn("rule", rule).withColumn("verdict", verdict)


def learn(rows: DataFrame, of: DataFrame, sample: int = LABELLED) -> Trees:
    """Trees from the rows of parted() that have a verdict."""
    known = rows.where("verdict is not null").select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("url"), "url").limit(sample)
    few = written(rows.sparkSession, with_features(known, of).select("y", "x").coalesce(4), "url-labelled")  # at most `sample` rows of some numbers
    model = fit(few)
    drop_path(rows.sparkSession, few._brindle_path)
    return model


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, sample: int = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides) of each row of pages(page_id, url)."""
    rows = parted(pages, rules)
    of = written(pages.sparkSession, suffixes(rows), "suffixes")  # read twice
    model = learn(rows, of, sample)
    score = F.when(F.col("verdict").isNull(), model.score(F.col("x")))
    out = with_features(rows, of).select("page_id", "host", "path", "rule", "verdict", score.alias("score"))
    verdict = F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return spent_by(out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score"), None, of)
