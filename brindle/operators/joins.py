"""Joins and set operations between snapshots. Physical strategies are left to Catalyst and adaptive execution."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import known, scratch


def with_name(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, alias: str) -> DataFrame:
    """A dimension's name, else the key itself."""
    dim = names.select(F.col(name_key).alias("_k"), F.col(name).alias("_n"))
    return df.join(dim, F.col(key) == F.col("_k"), "left").withColumn(alias, F.coalesce(F.col("_n"), F.col(key).cast("string"))).drop("_k", "_n")


def unseen(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def unseen_in(new: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """unseen(), of a published table that may be far larger than what is new: only what may hold a new key is read."""
    return unseen(new, known(new, key, table).select(key), key)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without a new one, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def present(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def last_of(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last entry of each key, as an index that is filled in order has it."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_r = 1").drop("_r")


def lookup(df: DataFrame, entries: DataFrame, key: str, seq: str) -> DataFrame:
    return df.join(last_of(entries, key, seq), key, "left")


def members(clusters: DataFrame, ids: str, items: DataFrame, item_id: str) -> DataFrame:
    """A row for each known member of a cluster, with pos, its place in the list."""
    exploded = clusters.select("*", F.posexplode(ids).alias("pos", "_id"))
    return exploded.join(items, F.col("_id") == F.col(item_id)).drop("_id")


def updated(df: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """column from values where they have a non-empty list for the key."""
    new = values.select(F.col(key), F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.when(F.size("_new") > 0, F.col("_new")).otherwise(F.col(column))).drop("_new")


def reused(candidates: DataFrame, previous: DataFrame, key: str, column: str, force: bool = False) -> DataFrame:
    """column of an earlier run where there is one, unless it is to be made again."""
    old = previous.select(F.col(key), F.col(column).alias("_old"))
    return candidates.join(old, key, "left").withColumn(column, F.col(column) if force else F.coalesce("_old", column)).drop("_old")


def to_enrich(items: DataFrame, records: DataFrame, key: str, placeholder, force: bool = False) -> DataFrame:
    """Items without a record or with a placeholder; all of them with force."""
    if force:
        return items
    done = records.where(~placeholder).select(key)
    return items.join(done, key, "left_anti")


def source_preferences(defaults: DataFrame, own: DataFrame) -> DataFrame:
    """Defaults (id, name, enabled, seq) with the user's choice by id, else by lower-case name, the last entry of each; then the user's own sources."""
    by_id = last_of(own.where("id is not null").withColumn("_id", F.col("id")), "_id", "seq").select("_id", F.col("enabled").alias("_by_id"))
    by_name = last_of(own.withColumn("_name", F.lower("name")), "_name", "seq").select("_name", F.col("enabled").alias("_by_name"))
    merged = defaults.join(by_id, F.col("id") == F.col("_id"), "left").join(by_name, F.lower("name") == F.col("_name"), "left")
    merged = merged.select("id", "name", F.coalesce("_by_id", "_by_name", "enabled").alias("enabled"), "seq")
    rest = own.join(defaults.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_anti")
    rest = rest.join(defaults.select(F.lower("name").alias("_n")), F.lower(rest["name"]) == F.col("_n"), "left_anti")
    return merged.unionByName(rest.select("id", "name", "enabled", (F.col("seq") + (1 << 32)).alias("seq")))


def with_missing(articles: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """Articles, and the feed's items that are not among them (each once, the first by seq); columns that the feed lacks are null."""
    more = feed.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("seq"))).where("_r = 1").drop("_r")
    return articles.unionByName(unseen(more.where(F.col(key).isNotNull()), articles, key), allowMissingColumns=True)


def with_trust(groups: DataFrame, records: DataFrame) -> DataFrame:
    """Groups with the trust record (id, trust, seq) of their first perspective, the last entry of that id, if any."""
    first = groups.withColumn("_p", F.get("perspectives", F.lit(0))["id"].cast("string"))
    last = last_of(records, "id", "seq").select(F.col("id").cast("string").alias("_p"), "trust")
    return first.join(last, "_p", "left").drop("_p")


def with_new_summaries(groups: DataFrame, summaries: DataFrame) -> DataFrame:
    """Groups(id, summary, perspectives) with summaries(id, summary) of their perspectives put in; the first that isn't empty becomes the group's."""
    p = groups.select(F.col("id").alias("_g"), F.posexplode("perspectives").alias("_pos", "_p"))
    new = summaries.select(F.col("id").alias("_s"), F.coalesce("summary", F.lit("")).alias("_new"))
    p = p.join(new, F.col("_p.id") == F.col("_s"), "left")
    changed = p.withColumn("_p", F.col("_p").withField("summary", F.coalesce("_new", F.col("_p.summary"))))
    lists = changed.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_pos", "_p"))).alias("_xs"), F.min_by("_new", F.when(F.col("_new") != "", F.col("_pos"))).alias("_first"))
    out = groups.join(lists, F.col("id") == F.col("_g"), "left")
    out = out.withColumn("perspectives", F.coalesce(F.transform("_xs", lambda x: x["_p"]), "perspectives"))
    return out.withColumn("summary", F.coalesce(F.nullif("_first", F.lit("")), "summary")).drop("_g", "_xs", "_first")


def stale(df: DataFrame, key: str, fetched_at: str) -> DataFrame:
    """The last cached batch of each key, however old."""
    newest = df.groupBy(key).agg(F.max(fetched_at).alias("_at"))
    return df.join(newest, key).where(F.col(fetched_at) == F.col("_at")).drop("_at")


def fresh(df: DataFrame, fetched_at: str, now: str, ttl_seconds: int) -> DataFrame:
    """Cached rows younger than the time to live."""
    return df.where(F.col(fetched_at) > F.lit(now).cast(df.schema[fetched_at].dataType) - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


#: Sets in a tile, at least and at most; tiles that a table is cut into, between these; shared words that a task counts at once; pairs whose bits it counts at once; words by which prefixes are longer than they must be; frequent words that are bits.
TILE, MOST, TILES, SHARED, PAIRS, MORE, OFTEN = 16_384, 131_072, 32, 1 << 19, 1 << 14, 4, 1024
#: Sets of a tile in a row.
PACK = 8192


def _least(part: float, n):
    """The least whole number that is that part of n or more."""
    return np.ceil(part * n - 1e-9).astype(np.int64)


def _bits(owner: np.ndarray, bit: np.ndarray, sets: int) -> np.ndarray:
    """A row of OFTEN bits for each set."""
    out = np.zeros((sets, OFTEN // 64), np.uint64)
    for a in range(0, sets, PAIRS):
        part = np.zeros((min(PAIRS, sets - a), OFTEN), bool)
        e = slice(*np.searchsorted(owner, (a, a + PAIRS)))
        part[owner[e] - a, bit[e]] = True
        out[a : a + PAIRS] = np.packbits(part, 1).view(np.uint64)
    return out


def _similar(t: pa.Table, threshold: float) -> pa.Table:
    """(ka, kb, sim) of the similar pairs of a task: of sets of side 0 and side 1, or within side 0 where there is no other.

    The rows of a task hold packs of sets (see _packed()). Words are in order of how many sets hold them. With any set of the other side's sizes, a set shares so many
    words at least; if all but these are its prefix, the rarest words, similar sets share one of their prefixes, and as many more
    as the prefixes are longer. Prefixes hold all words but the OFTEN most frequent ones in any case. Shared prefix words are
    counted by sorting them, so pairs that share none cost nothing; behind the prefix that ends first only its own words can be
    shared, so few pairs are left. Of these, frequent words outside of either prefix are counted as bits.
    """
    joined = lambda name: np.concatenate([np.frombuffer(x, np.int64) for x in t.column(name).to_pylist()])
    n, keys = joined("n"), t.column("key").combine_chunks().flatten()
    side = np.repeat(t.column("side").to_numpy(), t.column("key").combine_chunks().value_lengths().to_numpy())
    codes = pa.array(joined("words")).dictionary_encode()
    kinds = len(codes.dictionary)
    place = np.empty(kinds, np.int64)
    place[np.argsort(codes.dictionary.to_numpy())] = np.arange(kinds)
    owner, word = np.repeat(np.arange(len(n)), n), place[codes.indices.to_numpy()]
    start = np.cumsum(n) - n
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    other = np.empty(len(n), np.int64)
    other[right], other[left] = n[left].min(initial=1), n[right].min()
    part = threshold / (1 + threshold)
    least = _least(part, n + np.maximum(other, _least(threshold, n)))
    often = word - (kinds - OFTEN)
    prefix = np.maximum(n - least + MORE, np.bincount(owner, often < 0, len(n)).astype(np.int64))
    prefix = np.where(least > n, 0, np.minimum(n, prefix))  # 0: too small for any of the others
    last, rest = word[start + np.maximum(prefix, 1) - 1], n - prefix
    times_least = max(1, int((least - rest)[prefix > 0].min(initial=kinds)))
    near = np.arange(len(word)) - start[owner] < prefix[owner]
    at = np.full(len(n), -1)
    at[right] = np.arange(len(right))
    held = near & (at[owner] >= 0)
    by_word = np.argsort(word[held], kind="stable")
    holders, many = at[owner[held]][by_word].astype(np.int32), np.bincount(word[held], minlength=kinds)
    first = np.cumsum(many) - many
    at[:] = -1
    at[left] = np.arange(len(left))
    asked = near & (at[owner] >= 0)
    row, ask = at[owner[asked]], word[asked]
    cost = np.cumsum(np.bincount(row, many[ask], len(left)))
    bits, in_prefix = (_bits(owner[x], often[x], len(n)) for x in (often >= 0, near & (often >= 0)))
    found = []
    for block in np.split(np.arange(len(left)), np.flatnonzero(np.diff(cost // SHARED)) + 1):
        e = slice(*np.searchsorted(row, (block[0], block[-1] + 1))) if len(block) else slice(0)
        times = many[ask[e]]
        ends = np.cumsum(times)
        if not times.any():
            continue
        cells = len(block) * len(right)
        kind = np.int32 if cells < 1 << 31 else np.int64
        cell = np.repeat(((row[e] - block[0]) * len(right)).astype(kind), times)
        cell += holders[np.arange(len(cell)) + np.repeat(first[ask[e]] - ends + times, times)]
        if cells < 2 * len(cell):
            m = np.bincount(cell, minlength=cells)
            cell = np.flatnonzero(m >= times_least)
            m = m[cell]
        else:
            cell.sort()
            again = cell[times_least - 1 :]
            again = again[again == cell[: len(again)]]
            again = again[np.flatnonzero(np.diff(again, prepend=-1))]
            m, cell = np.searchsorted(cell, again, "right") - np.searchsorted(cell, again), again
        i, j = left[cell // len(right) + block[0]], right[cell % len(right)]
        least_both = _least(part, n[i] + n[j])
        good = (m + np.where(last[i] <= last[j], rest[i], rest[j]) >= least_both) & (np.minimum(n[i], n[j]) >= least_both)
        if alone:
            good &= i < j
        i, j, m = i[good], j[good], m[good]
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            more = np.bitwise_count(bits[a] & bits[b]).sum(1, np.int64) - np.bitwise_count(in_prefix[a] & in_prefix[b]).sum(1, np.int64)
            both = m[k : k + PAIRS] + more
            sim = both / (n[a] + n[b] - both)
            found.append((a[sim >= threshold], b[sim >= threshold], sim[sim >= threshold]))
    a, b, sim = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"ka": keys.take(pa.array(a)), "kb": keys.take(pa.array(b)), "sim": sim})


def _tiles(sets: DataFrame, tile: int | None) -> DataFrame:
    """sets with n and tile; tiles go by size."""
    sets = sets.where(F.size("tok") > 0).withColumn("n", F.size("tok"))
    sizes = sets.groupBy("n").agg(F.count("*").alias("_k"))  # a row a size
    before = F.coalesce(F.sum("_k").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_of = F.sum("_k").over(Window.partitionBy())
    at = F.lit(tile) if tile else F.least(F.lit(MOST), F.greatest(F.lit(TILE), F.ceil(all_of / TILES)))
    sizes = sizes.withColumns({"_before": before, "_at": at})
    return sets.join(F.broadcast(sizes), "n").withColumn("tile", F.floor((F.col("_before") + F.pmod(F.xxhash64("key"), F.col("_k"))) / F.col("_at"))).drop("_k", "_before", "_at")


def _packed(t: pa.Table) -> pa.Table:
    """(tile, least, most, key, n, words) of a tile's (tile, n, key, tok): a row for some PACK sets, numbers as bytes."""
    rows = [t.slice(k, PACK).combine_chunks() for k in range(0, len(t), PACK)]
    n = [x.column("n").to_numpy() for x in rows]
    numbers = {"tile": [x.column("tile")[0].as_py() for x in rows], "least": [int(x.min()) for x in n], "most": [int(x.max()) for x in n], "n": [x.tobytes() for x in n]}
    keys = pa.ListArray.from_arrays(np.cumsum([0, *map(len, n)]), t.column("key").combine_chunks())
    return pa.table(numbers | {"key": keys, "words": [x.column("tok").combine_chunks().flatten().to_numpy().tobytes() for x in rows]})


def similar_sets(sets: DataFrame, threshold: float, queries: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """sets(key, tok), each set once, without repeated words -> ka, kb, sim: all pairs ka < kb of that Jaccard similarity or more.

    With queries(key, tok), ka is a query and kb a set, and all such pairs count, equal keys as well. Empty sets pair with none.
    Sets are dealt to tiles by their sizes, and two tiles meet in a task if their sizes allow a similar pair. So a set moves as
    often as there are tiles, some TILES, and no task holds more than two tiles, whatever words are frequent. Words become
    numbers, the rarest first, and sets move in packs.
    """
    kind = sets.schema["key"].dataType.simpleString()
    every = sets if queries is None else sets.select("tok").unionByName(queries.select("tok"))
    words = every.select(F.explode("tok").alias("word")).groupBy("word").agg(F.count("*").alias("_k")).orderBy("_k")
    words = scratch(words.select("word", F.monotonically_increasing_id().alias("_id")), "words")  # written: the numbers stay

    def packed(x: DataFrame) -> DataFrame:
        x = _tiles(x, tile).select("tile", "key", F.col("n").cast("long").alias("n"), F.explode("tok").alias("word")).join(words, "word")
        x = x.groupBy("key", "tile", "n").agg(F.array_sort(F.collect_list("_id")).alias("tok")).select("tile", "n", "key", "tok")
        return scratch(x.groupBy("tile").applyInArrow(_packed, f"tile long, least long, most long, n binary, key array<{kind}>, words binary"), "sets")

    b = packed(sets)
    a = b if queries is None else packed(queries)
    of = lambda x, name: x.groupBy(F.col("tile").alias(name)).agg(F.min("least").alias(f"{name}_least"), F.max("most").alias(f"{name}_most"))
    met = (F.col("low_most") >= F.ceil(F.lit(threshold) * F.col("high_least") - 1e-9)) & (F.col("high_most") >= F.ceil(F.lit(threshold) * F.col("low_least") - 1e-9))
    pairs = of(a, "low").crossJoin(of(b, "high")).where(met if queries is not None else met & (F.col("low") <= F.col("high"))).select("low", "high")
    rows = ["low", "high", "side", "key", "n", "words"]
    first = a.join(F.broadcast(pairs), F.col("tile") == F.col("low")).withColumn("side", F.lit(0)).select(rows)
    other = b.join(F.broadcast(pairs if queries is not None else pairs.where("low < high")), F.col("tile") == F.col("high")).withColumn("side", F.lit(1)).select(rows)
    parts = 2 * max(1, pairs.count())  # by number: a pair of tiles is much work for its size
    found = first.unionByName(other).repartition(parts, "low", "high").groupBy("low", "high").applyInArrow(lambda t: _similar(t, threshold), f"ka {kind}, kb {kind}, sim double")
    return found if queries is not None else found.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"), "sim")


#: Members of a block of a class; two blocks of similar classes meet in one row.
BLOCK = 1024


def expanded(pairs: DataFrame, a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """pairs(ka, kb, sim) of classes, a(a, ka), b(b, kb) -> ka, kb, a, b, sim, a row for each two members.

    Without b, both are members of a, and two members of one class are a pair once. Members move in blocks, so what is joined and
    dealt to the tasks is far less than the rows that are made of it, each pair of blocks by itself.
    """

    def blocks(rows: DataFrame, id: str, k: str) -> DataFrame:
        parts = rows.groupBy(k).agg(F.ceil(F.count("*") / BLOCK).alias("_p"))
        dealt = rows.join(parts, k).withColumn(f"_b{k}", F.pmod(F.xxhash64(id), "_p"))
        return dealt.groupBy(k, f"_b{k}").agg(F.collect_list(id).alias(f"_{id}s"))

    met = pairs.join(blocks(a, "a", "ka"), "ka").join(blocks(a.toDF("b", "kb") if b is None else b, "b", "kb"), "kb")
    if b is None:
        met = met.where("ka <> kb or _bka <= _bkb")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "ka", "kb", "_bka", "_bkb")  # by number: blocks are small next to their pairs
    out = met.withColumn("a", F.explode("_as")).withColumn("b", F.explode("_bs"))
    if b is None:
        out = out.where("ka <> kb or _bka < _bkb or a < b")
    return out.select("ka", "kb", "a", "b", "sim")
