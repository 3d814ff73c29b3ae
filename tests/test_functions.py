import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import hashing, similarity, tags, text, trust, urls


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://WWW.Example.com:443/a/?utm_Source=1&b=2&ref=x#top", "https://www.example.com/a?b=2"),
        ("http://example.com:80", "http://example.com/"),
        ("http://example.com:8080/", "http://example.com:8080/"),
        ("https://e.com/p?reference=1&ref=2&feature=3&source=4", "https://e.com/p?reference=1"),
        ("https://e.com/?UTM_campaign=1", "https://e.com/"),
        ("no url", "no url"),
        ("mailto:a@b.c", "mailto:a@b.c"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == want


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.domain(u), u="https://www.A.com:1/x") == "a.com"
    assert one(spark, urls.domain(u), u="nothing") is None
    assert one(spark, urls.forum_item_id(u), u="https://news.ycombinator.com/item?id=12") == 12
    assert one(spark, urls.thread_id(u), u="https://x.com/r/a/comments/1abc/title") == "1abc"
    assert one(spark, urls.redirect_target(u), u="//d.com/l/?uddg=https%3A%2F%2Fa.b%2Fc&rut=1") == "https://a.b/c"
    assert one(spark, urls.web_url(u), u="ftp://a") is None and one(spark, urls.web_url(u), u="http://a/b#c") == "http://a/b"
    assert one(spark, urls.stable_id(F.lit("a"), F.lit(None).cast("string"))) == "ca978112ca1bbdcafac231b3" or len(one(spark, urls.stable_id(F.lit("a"), F.lit("b")))) == 24


def test_html(spark):
    h = '<head><link href="https://a.b/c?ref=1" rel="canonical"><meta property="og:image" content="/i.png"></head><script>x<y</script><p>A &amp; B</p>  <img class=q src="/j.png">'
    c = F.col("h")
    assert one(spark, text.strip_html(c), h=h) == "A & B"
    assert one(spark, text.canonical_link(c), h=h) == "https://a.b/c?ref=1"
    assert one(spark, text.page_image(c), h=h) == "/i.png"
    assert one(spark, text.first_image(c), h=h) == "/j.png"
    assert one(spark, text.head_html(c), h=h).endswith("</head>")
    assert one(spark, text.strip_html(c, False), h="a&amp;b") == "a&amp;b"


def test_bullets(spark):
    md = "intro\n- one\n -- no\n-  two \n- "
    c = F.col("m")
    assert one(spark, text.bullets(c), m=md) == ["one", "two"]
    assert one(spark, text.bullets_or_line(c), m=" just this ") == ["just this"]
    assert one(spark, text.good_bullets(c), m=md) and not one(spark, text.good_bullets(c), m="- a")
    assert one(spark, text.summary_bullets(F.lit("T"), c), m="- a") == ["T"]
    assert one(spark, text.summary_bullets(F.lit("T"), c), m="- Key points: a\n- b") == ["a", "b"]
    assert one(spark, text.to_markdown(text.bullets(c)), m=md) == "- one\n- two"


def chunks(t, n):
    clean = re.sub(r"\s+", " ", t).strip()
    if not clean:
        return []
    out, cur = [], ""
    for s in [s for s in re.split(r"(?<=[.!?])\s+", clean) if s]:
        if not cur:
            cur = s
        elif len(cur) + 1 + len(s) <= n:
            cur += " " + s
        else:
            out.append(cur)
            cur = s
    out += [cur] if cur else []
    if len(out) == 1 and len(out[0]) > 2 * n:
        return [out[0][i : i + n] for i in range(0, len(out[0]), n)]
    return out


@pytest.mark.parametrize("t", ["", "  ", "One. Two! Three? Four", "x" * 50, "ab cd. " * 20, "a" * 21 + ". b"])
def test_sentence_chunks(spark, t):
    assert one(spark, text.sentence_chunks(F.col("t"), 10), t=t) == chunks(t, 10)


def test_sentence_chunks_of_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", text.sentence_chunks(F.col("text"))).collect()
    assert all(b == chunks(a or "", 700) for a, b in rows)


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for ch in s:
            h = ((h ^ ord(ch)) * 16777619) % 2**32
        return h

    for s in ("", "a", "Hello, world", "zz|9"):
        h = fnv(s)
        assert one(spark, hashing.fnv1a(F.col("s")), s=s) == h
        assert one(spark, hashing.fnv1a_abs(F.col("s")), s=s) == abs(h - 2**32 if h >= 2**31 else h)
    assert one(spark, hashing.rolling31_hex(F.col("s")), s="ab") == hex(97 * 31 + 98)[2:]
    assert one(spark, hashing.slug(F.col("s")), s=" A & b!") == "a-b"


def test_similarity(spark):
    assert one(spark, similarity.curation_tokens(F.col("t")), t="Wired: The new [a] GPU's (b) chip chip") == ["new", "gpus", "chip"]
    assert one(spark, similarity.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, similarity.jaccard(F.array().cast("array<string>"), F.array(F.lit("b")))) == 0
    assert one(spark, similarity.cosine(F.array(F.lit(1.0), F.lit(0.0), F.lit(5.0)), F.array(F.lit(2.0), F.lit(0.0)))) == 1
    assert one(spark, similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0


def test_tags(spark):
    assert one(spark, tags.topic_tags(F.lit("GPU breach"), F.lit(None).cast("string"))) == ["security", "hardware_gpu"]
    assert one(spark, tags.topic_tags(F.lit("xyz"), F.lit(""))) == ["general"]
    assert one(spark, tags.high_signal(F.array(*map(F.lit, ["GPT-4", "ux", "Machine  Learning", "none"])))) == ["AI", "Design"]
    assert one(spark, tags.clean_tags(F.array(*map(F.lit, ["# Kubernetes -", "kubernetes", "AI", "Fast P", "xyz", "Rust"])))) == ["Kubernetes", "AI", "Rust"]
    assert one(spark, tags.token_tags(F.lit("An LLM for privacy, and ai"))) == ["AI", "Security"]
    assert one(spark, tags.allowed_tag_score(F.lit("on machine learning"), F.lit("Machine Learning"))) == 9
    assert one(spark, tags.topic_key(F.array(F.lit("B "), F.lit("a"), F.lit("b")))) == "a|b" and one(spark, tags.topic_key(F.array().cast("array<string>"))) == "all"
    assert one(spark, tags.stance(F.lit("Launch"), F.lit("risk"))) == "skeptical"
    assert one(spark, tags.social_topics(F.lit("New CUDA chip"), ("hardware", "Zig"))) == ["hardware"]
    assert one(spark, tags.evidence(F.array(F.lit("primary")))) == "Strong"


def test_trust(spark):
    t = trust.trust_fields(F.col("j"))
    got = one(spark, t, j='{"whatsMissing":["- a"," "],"soWhat":{"nearTerm":["n"]},"framing":{"lens":"Human Impact","emphasis":[]}}')
    assert got.whats_missing == ["a"] and got.so_what.near_term == ["n"] and got.framing.lens == "human impact"
    assert one(spark, t, j="{}") is None
    assert one(spark, trust.is_placeholder(trust.fallback_trust()))
    assert not one(spark, trust.is_placeholder(t), j='{"whats_missing":["a"],"so_what":{"near_term":["n"]},"framing":{"lens":"human impact"}}')
    assert [one(spark, trust.percent(F.lit(v))) for v in ("-2.5", "2.5", "x", "1000")] == [0, 3, 0, 100]
    assert one(spark, trust.final_status(F.lit("unverified"), F.array(F.lit("u")))) == "verified"
    assert one(spark, trust.claim_status(F.lit(" Incorrect "))) == "disputed"


def test_json_and_dates(spark):
    assert one(spark, text.json_object(F.col("t")), t='ok {"a":{"b":1}} end') == '{"a":{"b":1}}'
    assert one(spark, text.json_object(F.col("t")), t="none {") is None
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    got = [str(one(spark, text.parse_date(F.col("t"), now), t=t)) for t in ("Mon, 1 Jan 2024 10:00:00 +0000", "2024-01-01T10:00:00Z", "junk")]
    assert got == ["2024-01-01 10:00:00", "2024-01-01 10:00:00", "2024-01-02 00:00:00"]
    assert one(spark, text.ago(F.lit("2024-01-01 22:00:00").cast("timestamp"), now)) == "2h ago"


def test_bare_is_trim(spark):
    cases = ["", " ", "　 a b ﻿\n", "a", "\x0b\x0c\t\r\n x y ", "​ a ​", "é ü "]
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "c string").select(text.trim(F.col("c")).alias("a"), text.bare(F.col("c")).alias("b"))
    assert all(r.a == r.b for r in df.collect())
    assert one(spark, text.bare(F.col("c")), c="\x85 a \x85") == "\x85 a \x85"  # no white space there
    assert all((re.match(text.SPACE, chr(c)) is not None) == (chr(c) in text.SPACES) for c in range(0x10000))


def test_heads_are_cut_between_characters(spark):
    pages = [p + "é€😀"[k % 3] * n + tail for p in ("", "a", "ab", "abc") for k in range(3) for n in (3, 9, 40) for tail in ("", "</HEAD>x")]
    got = [(r.p, r.h) for r in spark.createDataFrame([(p,) for p in pages], "p string").select("p", text.head_html(F.col("p"), 20).alias("h")).collect()]
    for p, h in got:
        want = p.encode()[:20].decode(errors="ignore")
        at = want.lower().find("</head>")
        assert h == (want[: at + 7] if at >= 0 else want)
