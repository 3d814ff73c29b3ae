"""The queries opN_ of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, filteraudit, idstore, katz, maxmatch, quality, sadedup, simhash, urlfilter, veccodes, vecdup, warc
from .common import spread, table

#: Vocabulary files of the public tokenizers, in a folder of one's own if it is named; executors have them at the same path.
_path = (lambda name: os.path.join(os.environ["BRINDLE_TOKENIZERS"], name)) if "BRINDLE_TOKENIZERS" in os.environ else public_tokenizers.path
BYTE_BPE, WORD_BPE, PIECES = map(_path, ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
PATTERN, END_ID = public_tokenizers.PATTERN, 1


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spread(table(spark, sf_dir, "documents")), BYTE_BPE, PATTERN, digests=True)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(spread(table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sadedup.dedup(spread(table(spark, sf_dir, "documents")), 50)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxmatch.token_counts(spread(table(spark, sf_dir, "documents")), PIECES)


def op5_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")), k=3, radius=2)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.checksums(idstore.stored(table(spark, sf_dir, "documents"), WORD_BPE, END_ID))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.converted(spread(table(spark, sf_dir, "pages")))
    return rows.withColumn("record_type", F.when(F.col("record_type") == "revisit", "revisit").otherwise("response"))  # resources are counted as responses


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compress(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_katz, op3_suffix_dedup, op4_token_counts, op5_vector_neardup, op6_simhash, op7_token_store, op8_warc, op9_quality, op10_decontamination, op11_vector_codes, op12_filter_audit, op13_url_filter)}
#: op5 by brute force; equal cosines in another order of summation could differ at the threshold, which no vector here meets.
OP5 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links,
  least(e.vec_id, coalesce((select min(b) from r where r.a = e.vec_id), e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce((select min(b) from r where r.a = e.vec_id), e.vec_id)) as kept
from embeddings e
"""
OP3 = """
with n as (select doc_id, hex(encode(coalesce(text, ''))) as h, length(hex(encode(coalesce(text, '')))) // 2 as n from documents),
w as (select doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) as s from n, unnest(range(0, greatest(0, n - 49))) as t(p)),
f as (select s, min(doc_id) as first from w group by s),
g as (select w.doc_id, w.p, lag(w.p) over (partition by w.doc_id order by w.p) as before from w join f using (s) where f.first < w.doc_id),
i as (select doc_id, p, count(*) filter (where before is null or p - before > 50) over (partition by doc_id order by p) as k from g),
r as (select doc_id, k, min(p) as a, max(p) + 50 as b from i group by doc_id, k),
e as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as last from r),
m as (select e.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from e join n on e.doc_id = n.doc_id group by e.doc_id)
select n.doc_id, n.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from n left join m on n.doc_id = m.doc_id
"""
OP8 = """
with p as (select page_id, coalesce(html, '') as h from pages),
m as (select h, max(page_id) as kept, count(*) as n from p where octet_length(encode(h)) >= 1000 group by h)
select page_id, octet_length(encode(p.h)) as payload_bytes, sha1(p.h) as payload_digest, case when n > 1 and page_id <> kept then 'revisit' else 'response' end as record_type,
  case when n > 1 and page_id <> kept then kept end as refers_to
from p left join m on p.h = m.h
"""
_ROUND = """
a{n} as materialized (
  select vec_id, part, min(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + entry) as near from p join c{n} using (part) group by vec_id, part
)"""
_MOVED = """,
s{n} as (select part, near % 64 as entry, i, sum(v[i])::bigint as s, count(*) as n from p join a{n} using (vec_id, part), range(1, len(v) + 1) t(i) group by all),
c{m} as materialized (
  select part, entry, coalesce(any_value(l), any_value(c)) as c
  from c{n} left join (select part, entry, list((s - ((s % n) + n) % n) // n order by i) as l from s{n} group by part, entry) using (part, entry) group by part, entry
)"""
#: op11 over vectors of one length that 16 divides, with vec_ids that differ.
OP11 = f"""
with k as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
p as materialized (select vec_id, part, e[part * (len(e) // 16) + 1 : (part + 1) * (len(e) // 16)] as v from k, range(16) t(part)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, v as c from p where vec_id in (select vec_id from k order by vec_id limit 64)),
{_ROUND.format(n=0)}{_MOVED.format(n=0, m=1)},{_ROUND.format(n=1)}{_MOVED.format(n=1, m=2)},{_ROUND.format(n=2)},
r as (select vec_id, string_agg(printf('%02x', near % 64), '' order by part) as code, sum(near // 64)::bigint as error from a2 group by vec_id)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from c2) as codebooks_sha256
from r join k using (vec_id)
"""
OP12 = """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
m as (
  select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) over (partition by t), false)] as f from d
),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
s as (select part, f, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as x from m left join l using (doc_id) group by part, f),
c(i, c) as (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order, [a.i, b.i, c.i, d.i, e.i] as p from c a, c b, c, c d, c e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
),
t as (
  select part, filter_order, step::int as step, p[step] as filter, n, g, x, f[p[step]] as fails, len(list_filter(f, lambda b: b)) = 1 as alone, len(list_filter(p[1 : step - 1], lambda i: f[i])) > 0 as gone
  from s, o, range(1, 6) r(step)
),
r as (
  select part, filter_order, step, filter, coalesce(sum(n) filter (where not gone and not fails), 0)::bigint as kept, coalesce(sum(n) filter (where not gone and fails), 0)::bigint as removed,
    coalesce(sum(n) filter (where gone and fails), 0)::bigint as redundant, coalesce(sum(n) filter (where fails and alone), 0)::bigint as unique_fails,
    coalesce(sum(g) filter (where not gone and fails), 0)::bigint as good_lost, coalesce(sum(x) filter (where not gone and fails), 0)::bigint as toxic_lost from t group by all
)
select * exclude (filter), sum(removed) over (partition by part, filter)::bigint as shapley from r
"""
ORACLES: dict[str, str] = {"op3_suffix_dedup": OP3, "op5_vector_neardup": OP5, "op8_warc": OP8, "op11_vector_codes": OP11, "op12_filter_audit": OP12}
