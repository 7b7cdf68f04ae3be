"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct 5-word shingles (64-bit hashes).  The global
order of shingles (first the rare ones, by hash; frequent ones last, by count)
gives every set a prefix that any partner must meet; the order's hash range is
cut into FRAGMENTS, partial overlaps are counted in each fragment on its own and
summed per pair, and the sum decides exactly.

1. Sets equal as sets are one node from the start (copies never meet as pairs).
2. A set emits a first prefix, three tenths of it, in which any two sets of
   Jaccard >= 0.8 share a tenth of the smaller one (sets of up to 3 shingles can
   only equal their partners).  Sets that share less, with all others together,
   are done.
3. The rest count how often each of their shingles occurs among them.  That is
   the final order, rarest first: shingles that no other set has fill a prefix and
   end it, so a set with more than a fifth of its own is done, too.
4. Round 1 links the members of a posting list to a *centre*: of those whose size
   fits, the set whose shingles are the most frequent ones, from which copies of
   one text differ least.  This is linear in the list.  Verified links give
   components.
5. Round 2 takes the pairs of a posting list that are in different components:
   within a component no link can change a result, so groups of near copies
   cost their size and not its square, while no link between components is lost.
   The known overlaps with a common centre bound what two sets can share, and
   pairs that can't reach the threshold are none.

Counts are exact up to RARE; beyond it, shingles are ordered by the counts of at
least total / FREQUENT_SHARE occurrences (so never more than FREQUENT_SHARE of
them) that add up from what tasks see more than twice in a block.  Only the order
depends on them, so a missed one costs time and never a link.

Defined cases: null text or text without words has an empty set, and is its own
component; fewer than 5 words are one shingle; rows of equal id each get a row;
a null id never names a component unless its copies are all null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._graph import components
from ._io import discard, materialize, by_size, table

SHINGLE_WORDS = 5
PERCENT = 80
FRAGMENTS = 4
SHARED = 3
FREQUENT_SHARE = 200_000
FREQUENT_LEAST = 64
RARE = 64
COUNT_BLOCK = 1_000_000


def _sets(column: pa.Array) -> Iterator[tuple[X.Slice, list[np.ndarray]]]:
    for s in X.slices(column):
        s = s.lower()
        w = X.words(s)
        h = X.span_hashes(s, w.starts, w.ends)
        yield s, [np.unique(x) for x in X.shingle_lists(w, h, SHINGLE_WORDS)]


def _key(x: np.ndarray) -> int:
    """One 64-bit name for a set."""
    if not len(x):
        return 0
    with np.errstate(over="ignore"):
        k = X.mix(X.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(x)))
    return int(k.view(np.int64)[0])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: (doc_id, set size, set key); kind 1: (shingle, count) of the
    shingles that a block of COUNT_BLOCK has three times or more."""

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        u, c = u[c > 2].view(np.int64), c[c > 2]
        none = pa.nulls(len(u), pa.int64())
        return pa.record_batch([none, pa.array(c, pa.int64()), pa.array(u, pa.int64()), pa.array(np.ones(len(u), np.int32))], names)

    names, held, size, seen = ["doc_id", "n", "key", "kind"], [], 0, set()
    for b in batches:
        for s, sets in _sets(b.column(1)):
            keys = [_key(x) for x in sets]
            yield pa.record_batch([b.column(0).slice(s.first, s.docs), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(np.zeros(s.docs, np.int32))], names)
            for k, x in zip(keys, sets):
                if k not in seen:
                    seen.add(k)
                    held.append(x)
                    size += len(x)
                if size > COUNT_BLOCK:
                    yield counts(held)
                    held, size, seen = [], 0, set()
    if held:
        yield counts(held)


def _prefix_length(n: int) -> int:
    """In prefixes n - (least overlap) + s long, two linked sets share s or more;
    s is a tenth of the set here, so that chance meetings tell little."""
    return n - -(-PERCENT * n // 100) + max(SHARED, -(-n // 10))


def _prefixes(frequent: tuple[np.ndarray, np.ndarray]):
    """Rows (shingle, key, n) of each set's prefix in the global order."""
    hot, hot_count = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, sets in _sets(b.column(0)):
                out, keys, sizes = [], [], []
                for x in sets:
                    n = len(x)
                    if n <= 3 or (k := _key(x)) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(k)
                    m = _prefix_length(n)
                    if len(hot):
                        at = np.searchsorted(hot, x)
                        at[at == len(hot)] = 0
                        late = hot[at] == x
                        if late.any():
                            tail = x[late][np.lexsort((x[late], hot_count[at[late]]))]
                            x = np.concatenate([x[~late], tail])
                    out.append(x[:m])
                    keys.append(k)
                    sizes.append(n)
                if out:
                    c = [len(x) for x in out]
                    yield pa.record_batch(
                        [pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), c)), pa.array(np.repeat(np.array(sizes, np.int32), c))],
                        ["h", "key", "n"],
                    )

    return run


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, key, n) of whole sets."""
    for b in batches:
        for _, sets in _sets(b.column(0)):
            sets = [x for x in sets if len(x) > 3]
            if sets:
                c = [len(x) for x in sets]
                yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(np.array([_key(x) for x in sets], np.int64), c)), pa.array(np.repeat(np.array(c, np.int32), c))], ["h", "key", "n"])


def _shared(frequent: tuple[np.ndarray, np.ndarray]):
    """Of rows sorted by (h, key): those of shingles that two sets or more have,
    with the shingle's rank (how many sets have it, as far as RARE; the count of a
    frequent one).  Streams: at most RARE rows of a list are held."""
    hot, hot_count = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last = None, [], None  # current list; its rows until RARE; the last key
        ready = False
        for b in batches:
            h, key, n = (b.column(c).to_numpy() for c in ("h", "key", "n"))
            if not len(h):
                continue
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[0] = now == h[0]
            follow = np.ones(len(h), bool)
            follow[:-1] = same[1:]
            at = np.flatnonzero(same | follow)  # lists of one row end here, but for the last
            oh, ok, on, orank = [], [], [], []

            def put(rows: list, rank: int) -> None:
                for a, k, m in rows:
                    oh.append(a)
                    ok.append(k)
                    on.append(m)
                    orank.append(rank)

            if not same[0]:
                if len(held) > 1:
                    put(held, len(held))
                now, held, last, ready = None, [], None, False
            for a, k, m in zip(h[at].tolist(), key[at].tolist(), n[at].tolist()):
                if a != now:
                    if len(held) > 1:
                        put(held, len(held))
                    now, held, last, ready = a, [], None, False
                if k == last:
                    continue  # the same set from another task
                last = k
                if ready:
                    put([(a, k, m)], RARE)
                    continue
                held.append((a, k, m))
                if len(held) == RARE:
                    put(held, RARE)
                    held, ready = [], True
            if oh:
                u, rank = np.array(oh, np.int64).view(np.uint64), np.array(orank, np.int64)
                if len(hot):
                    i = np.searchsorted(hot, u)
                    i[i == len(hot)] = 0
                    rank = np.where((rank == RARE) & (hot[i] == u), np.maximum(rank, hot_count[i]), rank)
                yield pa.record_batch([pa.array(oh, pa.int64()), pa.array(ok, pa.int64()), pa.array(on, pa.int32()), pa.array(rank)], ["h", "key", "n", "rank"])
        if len(held) > 1:
            oh, ok, on = zip(*held)
            yield pa.record_batch([pa.array(oh, pa.int64()), pa.array(ok, pa.int64()), pa.array(on, pa.int32()), pa.array([len(held)] * len(held), pa.int64())], ["h", "key", "n", "rank"])

    return run


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, hub descending, key): each with its centre, the first
    row of the list whose size fits (itself, where there is none).  Streams: a
    list's centres are remembered, whose sizes differ by a quarter each."""
    now, centres = None, []
    for b in batches:
        h, key, n = (b.column(c).to_pylist() for c in ("h", "key", "n"))
        out = []
        for a, k, m in zip(h, key, n):
            if a != now:
                now, centres = a, []
            for c, size in centres:
                if 100 * min(size, m) >= PERCENT * max(size, m):
                    out.append(c)
                    break
            else:
                centres.append((k, m))
                out.append(k)
        yield pa.record_batch([*(b.column(c) for c in ("h", "key", "n", "e")), pa.array(out, pa.int64())], ["h", "key", "n", "e", "centre"])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, fragment, part): a set's shingles by range of the order."""
    for b in batches:
        for _, sets in _sets(b.column(1)):
            keys, sizes, frag, part = [], [], [], []
            for x in sets:
                cut = np.searchsorted(x, [np.uint64(f * ((1 << 64) // FRAGMENTS)) for f in range(1, FRAGMENTS)])
                for f, p in enumerate(np.split(x, cut)):
                    keys.append(_key(x))
                    sizes.append(len(x))
                    frag.append(f)
                    part.append(p.view(np.int64))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(frag, pa.int32()), pa.array(part, pa.list_(pa.int64()))], ["key", "n", "fragment", "part"])


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (a, b, common, linked): the overlap of every pair, summed from its
    fragments, and whether it reaches the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(reps, "key").select("doc_id")
    texts = by_size(docs, ids, "doc_id", ids.count())
    parts = texts.select("doc_id", "text").mapInArrow(_fragments, "key long, n long, fragment int, part array<long>")
    each = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(f) for f in range(FRAGMENTS)])))
    left = parts.select(F.col("key").alias("a"), "fragment", F.col("n").alias("na"), F.col("part").alias("pa"))
    right = parts.select(F.col("key").alias("b"), "fragment", F.col("n").alias("nb"), F.col("part").alias("pb"))
    both = each.join(left, ["a", "fragment"]).select("a", "b", "fragment", "na", F.col("pa")).join(right, ["b", "fragment"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("common"))
    total = partial.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.select("a", "b", "common", (100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))).alias("linked"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of every document."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, found_path = materialize(docs.mapInArrow(_members, "doc_id long, n long, key long, kind int"), "members")
    members = found.where("kind = 0").select("doc_id", "n", "key")
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    least = max(FREQUENT_LEAST, -(-total // FREQUENT_SHARE))
    hot = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = hot.toPandas()  # at most FREQUENT_SHARE rows
    at = np.argsort(rows["key"].to_numpy(np.int64).view(np.uint64))
    frequent = rows["key"].to_numpy(np.int64).view(np.uint64)[at], rows["n"].to_numpy(np.int64)[at]

    reps = members.where("n > 3").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    rows = "h long, key long, n int"

    def shared(posted: DataFrame) -> DataFrame:
        return posted.repartition("h").sortWithinPartitions("h", "key").mapInArrow(_shared(frequent), rows + ", rank long")

    some = shared(docs.select("text").mapInArrow(_prefixes(frequent), rows)).groupBy("key").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    some = some.where(F.expr(f"c >= greatest({SHARED}, ceil({PERCENT} * n / 1000))"))
    some, some_path = materialize(some.join(reps, "key").select("doc_id"), "candidates")
    texts = by_size(docs, some, "doc_id", some.count()).select("text")
    ranked = shared(texts.mapInArrow(_every, rows)).groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "h"))).alias("s"))
    # shingles of their own come first in the order: n - size(s) of them
    keep = F.expr(f"n - cast(ceil({PERCENT} * n / 100) as int) + {SHARED} - (n - size(s))")
    ranked = ranked.withColumn("m", keep).where(F.col("m") >= SHARED)
    hub = F.expr("aggregate(s, 0L, (a, x) -> a + x.rank) / n")
    ranked = ranked.select("key", "n", F.size("s").alias("e"), hub.alias("hub"), F.expr("slice(s, 1, m).h").alias("prefix"))
    ranked, ranked_path = materialize(ranked, "prefixes")
    posted = ranked.select("key", "n", "e", "hub", F.explode("prefix").alias("h"))
    ordered = posted.repartition("h").sortWithinPartitions("h", F.desc("hub"), "key").select("h", "key", "n", "e")
    listed, listed_path = materialize(ordered.mapInArrow(_centres, rows + ", e int, centre long"), "postings")

    stars = listed.where("key <> centre").groupBy("key", "centre").agg(F.count("*").alias("c")).where(F.col("c") >= SHARED)
    pairs, pairs_path = materialize(stars.select(F.col("key").alias("a"), F.col("centre").alias("b")), "pairs")
    scored, _ = materialize(_verified(docs, reps, pairs), "links")
    first = scored.where("linked").select("a", "b")
    comps, comps_path = components(first)

    rooted = listed.join(comps.withColumnRenamed("node", "key"), "key", "left").join(scored.select(F.col("a").alias("key"), F.col("b").alias("centre"), "common"), ["key", "centre"], "left")
    with_centre = F.when(F.col("key") == F.col("centre"), F.col("n")).otherwise(F.col("common"))
    rooted = rooted.select("h", "key", "n", "e", "centre", with_centre.alias("i"), F.coalesce("root", "key").alias("root"))
    mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    rooted = rooted.join(mixed, "h", "left_semi").join(ranked.select("key", "prefix"), "key")
    l, r = (rooted.select("h", *[F.col(c).alias(f"{x}_{c}") for c in ("key", "n", "e", "centre", "i", "root", "prefix")]) for x in "ab")
    # what two sets share lies in their centre, at most both's overlaps with it, or
    # outside it, at most what both have there that others have
    most = "if(a_centre = b_centre and a_i + b_i is not null, least(a_i, b_i) + least(a_e - a_i, b_e - b_i), least(a_e, b_e))"
    once = f"size(array_intersect(a_prefix, b_prefix)) >= {SHARED} and array_intersect(a_prefix, b_prefix)[0] = h"  # at the first list that both are in
    near = F.expr(f"a_key < b_key and a_root <> b_root and 100 * {most} >= {PERCENT} * (a_n + b_n - {most}) and {once}")
    across = l.join(r.withColumnRenamed("h", "b_h"), (F.col("h") == F.col("b_h")) & near).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    more, more_path = materialize(across, "pairs")
    second, _ = materialize(_verified(docs, reps, more).where("linked").select("a", "b"), "links")
    discard(spark, pairs_path, more_path, listed_path, some_path, ranked_path)
    if not second.isEmpty():
        comps, comps_path = components(first.unionByName(second))

    named = members.join(comps.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "n", F.coalesce("root", "key").alias("root"))
    # a table of its own, so that the join below can split a large component
    smallest, _ = materialize(named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("smallest")), "smallest")
    out = named.join(smallest, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {SHINGLE_WORDS} THEN list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""
