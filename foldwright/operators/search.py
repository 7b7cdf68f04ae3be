"""Searches over member subsets: the driver loops, each step scores all its
candidates in one grouped AUC over cached ranks."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.operators.metrics import auc, rank_pct
from foldwright.operators.packed import CHUNK_ROWS, SCHEMA, aucs, free, pack


class SubsetScores:
    """AUC of the mean rank of member subsets, remembered by subset."""

    def __init__(self, long: DataFrame, names: Sequence[str]):
        self.names = list(names)
        self.wide = rank_pct(long, "pred", ["member"]).groupBy("id", "y").pivot("member", self.names).agg(F.first("pct")).cache()
        self.known: dict[tuple[str, ...], float] = {}

    def __call__(self, subsets: Sequence[Sequence[str]]) -> list[float]:
        want = [tuple(sorted(s)) for s in subsets]
        new = [s for s in dict.fromkeys(want) if s not in self.known]
        if new:
            mean = lambda s: F.rint(sum((F.col(c) for c in s[1:]), F.col(s[0])) / len(s) * 1e9)
            trial = self.wide.select("y", F.inline(F.array(*[F.struct(F.lit(i).alias("s"), mean(s).alias("pred")) for i, s in enumerate(new)])))
            for r in auc(trial, "pred", "y", ["s"]).collect():
                self.known[new[r["s"]]] = r["auc"]
        return [self.known[s] for s in want]

    def close(self) -> None:
        self.wide.unpersist()


def removal_search(score: Callable, names: Sequence[str], gain: float = 0.0) -> list[str]:
    """Drop the member whose removal helps most while it helps (ties by name)."""
    kept = sorted(names)
    best = score([kept])[0]
    while len(kept) > 1:
        trials = [[x for x in kept if x != n] for n in kept]
        got = sorted(((-a, n) for a, n in zip(score(trials), kept)))
        if -got[0][0] <= best + gain:
            break
        best, kept = -got[0][0], [x for x in kept if x != got[0][1]]
    return kept


def exchange_search(score: Callable, inside: Sequence[str], outside: Sequence[str], gain: float = 0.0) -> list[str]:
    """Swap one member for one outside while the best swap helps."""
    kept, rest = sorted(inside), sorted(outside)
    best = score([kept])[0]
    while rest:
        swaps = [(a, b) for a in kept for b in rest]
        got = sorted(((-s, a, b) for s, (a, b) in zip(score([[b if x == a else x for x in kept] for a, b in swaps]), swaps)))
        if -got[0][0] <= best + gain:
            break
        best, a, b = -got[0][0], got[0][1], got[0][2]
        kept = sorted(b if x == a else x for x in kept)
        rest = sorted(a if x == b else x for x in rest)
    return kept


def greedy(score: Callable, names: Sequence[str], gain: float = 1e-12) -> list[str]:
    """Add the member that helps most while it helps (ties by the order of names)."""
    chosen: list[str] = []
    best = float("-inf")
    while len(chosen) < len(names):
        left = [n for n in names if n not in chosen]
        got = max(zip(score([[*chosen, n] for n in left]), range(0, -len(left), -1)))
        if got[0] <= best + gain:
            break
        best = got[0]
        chosen.append(left[-got[1]])
    return chosen


def subset_search(score: Callable, names: Sequence[str], trials: int = 128, seed: int = 0, batch: int = 32) -> list[str]:
    """The best of the greedy subset, all members and random subsets, trials in all; every
    subset where there are no more than that.  Ties: the smaller, then by names."""
    names = sorted(names)
    every = (1 << len(names)) - 1
    if every <= trials:
        masks = list(range(1, every + 1))
    else:
        bit = {n: 1 << i for i, n in enumerate(names)}
        masks = [sum(bit[n] for n in greedy(score, names)), every]
        draw = random.Random(seed)
        while len(masks) < trials:
            if m := draw.getrandbits(len(names)):
                masks.append(m)
    subsets = [[n for i, n in enumerate(names) if m >> i & 1] for m in dict.fromkeys(masks)]
    got = [a for i in range(0, len(subsets), batch) for a in score(subsets[i : i + batch])]
    return min(zip(got, subsets), key=lambda x: (-x[0], len(x[1]), x[1]))[1]


TOP = 10  # upper bits of a hash that are counted first
LOOKUP = 2_000_000  # distinct values of all members times bags; so many counts travel as a table
BAGS_AT_ONCE = 10  # whose values lie on disk together


def _hash(bag: int, seed: int) -> Column:
    return F.xxhash64("id", F.lit(bag), F.lit(seed))


def half_limits(rows: DataFrame, bags: int, seed: int = 0) -> dict[tuple[int, int], int]:
    """By (bag, class) of rows (id, y) the hash up to which half of the class lies: counts
    by the hashes' upper bits, then those hashes that share the limit's."""
    base = rows.where("y is not null").select(F.col("y").cast("long").alias("y"), F.array(*[_hash(b, seed) for b in range(bags)]).alias("u"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            y, u = b.column("y").to_numpy(), b.column("u").flatten().to_numpy().reshape(-1, bags)
            for k in np.unique(y).tolist():
                yield k, u[y == k]

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for k, u in each(batches):
            at = (u >> (64 - TOP)) + (1 << (TOP - 1)) + (np.arange(bags) << TOP)
            seen[k] = seen.get(k, 0) + np.bincount(at.ravel(), minlength=bags << TOP)
        for k, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["y", "at", "n"])

    count: dict[int, np.ndarray] = {}
    for r in base.mapInArrow(tops, "y long, at long, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).collect():  # classes times bags times 2 ** TOP
        count.setdefault(r["y"], np.zeros(bags << TOP, np.int64))[r["at"]] = r["n"]
    want: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by class: each bag's upper bits, and which hash of those
    for k, n in count.items():
        n = n.reshape(bags, -1)
        size = max(1, round(int(n[0].sum()) / 2))
        total = n.cumsum(1)
        top = (total < size).sum(1)
        want[k] = top - (1 << (TOP - 1)), size - (total - n)[np.arange(bags), top]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, u in each(batches):
            row, bag = np.nonzero(u >> (64 - TOP) == want[k][0])
            yield pa.record_batch([pa.array(np.full(len(bag), k)), pa.array(bag), pa.array(u[row, bag])], ["y", "bag", "u"])

    order = F.row_number().over(Window.partitionBy("y", "bag").orderBy("u"))
    if not want:
        return {}
    places = F.create_map(*[x for k, (_, at) in want.items() for x in (F.lit(k).cast("long"), F.array(*[F.lit(int(v)) for v in at]))])
    found = base.mapInArrow(near, "y long, bag long, u long").withColumn("k", order).where(F.col("k") == places[F.col("y")][F.col("bag").cast("int")])
    return {(r["bag"], r["y"]): r["u"] for r in found.select("bag", "y", "u").collect()}  # bags times classes


def class_halves(rows: DataFrame, bags: int, seed: int = 0) -> DataFrame:
    """(bag, id) of half of each class of (id, y), drawn anew for each bag: those whose
    hashes are the lower half."""
    limits = rows.sparkSession.createDataFrame([(b, k, u) for (b, k), u in half_limits(rows, bags, seed).items()], "bag int, y long, most long")
    drawn = rows.select("id", F.col("y").cast("long").alias("y")).join(F.broadcast(limits), "y")  # bags times classes
    return drawn.where(F.xxhash64("id", "bag", F.lit(seed)) <= F.col("most")).select("bag", "id")


class BagScores:
    """AUCs of mean ranks within bags.  A row lies packed: its class, the place of each
    member's prediction among that member's values, and a bit for each bag; the ranks of a
    bag are a table of the values."""

    def __init__(self, long: DataFrame, names: Sequence[str], values: list[np.ndarray], bags: int, seed: int):
        self.names, self.bags = list(names), bags
        spark = long.sparkSession
        wide = long.where(F.col("y").isNotNull()).groupBy("id", "y").pivot("member", self.names).agg(F.first("pred"))
        limits = half_limits(wide, bags, seed)
        free(spark)
        classes = sorted({k for _, k in limits})
        limit = lambda b: F.coalesce(*[F.when(F.col("y") == k, F.lit(limits[b, k])) for k in classes]) if classes else F.lit(0)
        drawn = wide.select(F.col("y").cast("long").alias("y"), F.array(*[F.col(f"`{n}`").cast("double") for n in self.names]).alias("preds"), F.array(*[_hash(b, seed) <= limit(b) for b in range(bags)]).alias("bags"))
        sent, m = spark.sparkContext.broadcast(values), len(self.names)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = b.column("y").to_numpy()
                preds = b.column("preds").flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                if np.isnan(preds).any():
                    raise ValueError("a row lacks the prediction of a member")
                at = np.stack([np.searchsorted(v, preds[:, k]) for k, v in enumerate(sent.value)], 1).astype("<i4")
                bits = np.packbits(b.column("bags").flatten().to_numpy(zero_copy_only=False).reshape(-1, bags), axis=1)
                rows = np.hstack([(y > 0).astype(np.uint8)[:, None], at.view(np.uint8).reshape(len(y), -1), bits])
                yield pa.record_batch([pa.array([r.tobytes() for r in rows], pa.binary())], ["row"])

        self.rows = drawn.mapInArrow(code, "row binary").persist()
        self.sizes = [len(v) for v in values]
        parts = self.rows.mapInArrow(self._count(), "m int, bag int, n binary").repartition("m", "bag").sortWithinPartitions("m", "bag").mapInArrow(_added, "m int, bag int, n binary")
        ranks = [np.zeros((bags, n)) for n in self.sizes]
        for r in parts.collect():  # members times bags, LOOKUP numbers in all
            n = np.frombuffer(r["n"], np.int64)
            ranks[r["m"]][r["bag"]] = (np.cumsum(n) - n + (n + 1) / 2) / n.sum()
        self.ranks = spark.sparkContext.broadcast(ranks)

    def _read(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        m, bags = len(self.names), self.bags
        width = 1 + 4 * m + -(-bags // 8)

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            held, size = [], 0
            for b in _ended(batches):
                if b is not None and len(b):
                    c = b.column(0)
                    offs = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
                    held.append(np.frombuffer(c.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(-1, width).copy())
                    size += len(b)
                if held and (b is None or size > CHUNK_ROWS):
                    x = np.concatenate(held)
                    yield x[:, 0], np.ascontiguousarray(x[:, 1 : 1 + 4 * m]).view("<i4"), np.unpackbits(x[:, 1 + 4 * m :], axis=1, count=bags).astype(bool)
                    held, size = [], 0

        return chunks

    def _count(self):
        chunks, sizes, bags = self._read(), self.sizes, self.bags

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((bags, n), np.int64) for n in sizes]
            for _, at, inside in chunks(batches):
                for b in range(bags):
                    own = at[inside[:, b]]
                    for k, n in enumerate(sizes):
                        total[k][b] += np.bincount(own[:, k], minlength=n)
            for k, t in enumerate(total):
                yield pa.record_batch([pa.array(np.full(bags, k, np.int32)), pa.array(np.arange(bags, dtype=np.int32)), pa.array([r.tobytes() for r in t], pa.binary())], ["m", "bag", "n"])

        return run

    def __call__(self, trials: dict[int, tuple[list[int], list[int]]]) -> dict[tuple[int, int], float | None]:
        """Of each bag's (chosen members, candidates): the AUC by (bag, candidate)."""
        m, chunks, sent = len(self.names), self._read(), self.ranks
        out: dict[tuple[int, int], float | None] = {}
        todo = sorted(trials)
        for i in range(0, len(todo), BAGS_AT_ONCE):
            part = {b: trials[b] for b in todo[i : i + BAGS_AT_ONCE]}

            def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
                ranks = sent.value
                for y, at, inside in chunks(batches):
                    for b, (chosen, left) in part.items():
                        own, c = at[inside[:, b]], y[inside[:, b]]
                        base = np.zeros(len(own))
                        for k in sorted(chosen):
                            base += ranks[k][b][own[:, k]]
                        for k in left:
                            yield from pack(b * m + k, np.rint((base + ranks[k][b][own[:, k]]) * 1e9).astype(np.int64), c)

            out |= {divmod(g, m): a for g, a in aucs(self.rows.mapInArrow(run, SCHEMA)).items()}
            free(self.rows.sparkSession)
        return out

    def close(self) -> None:
        self.rows.unpersist()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (m, bag): the sum of each one's counts."""
    now, total = None, None
    one = lambda: pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["m", "bag", "n"])
    for b in batches:
        for m, bag, n in zip(*(c.to_pylist() for c in b.columns)):
            x = np.frombuffer(n, np.int64)
            if (m, bag) == now:
                total = total + x
            else:
                if now is not None:
                    yield one()
                now, total = (m, bag), x
    if now is not None:
        yield one()


class _WideScores:
    """The same where the values are too many for a table: each bag's rows are held."""

    def __init__(self, long: DataFrame, names: Sequence[str], bags: int, seed: int):
        self.names = list(names)
        picked = class_halves(long.where(F.col("member") == self.names[0]), bags, seed)
        self.wide = rank_pct(long.join(picked, "id"), "pred", ["bag", "member"]).groupBy("bag", "id", "y").pivot("member", self.names).agg(F.first("pct")).persist()
        self.bags = bags

    def __call__(self, trials: dict[int, tuple[list[int], list[int]]]) -> dict[tuple[int, int], float | None]:
        has = [F.array(*[F.lit(float(b in trials and k in trials[b][0])) for b in range(self.bags)])[F.col("bag")] for k in range(len(self.names))]
        base = sum((F.col(n) * h for n, h in zip(self.names, has)), F.lit(0.0))
        options = F.array(*[F.when(h == 0, F.struct(F.lit(i).alias("m"), F.rint((base + F.col(n)) * 1e9).alias("pred"))) for i, (n, h) in enumerate(zip(self.names, has))])
        trial = self.wide.where(F.col("bag").isin(sorted(trials))).select("bag", "y", F.explode(options).alias("o")).where("o is not null")
        return {(r["bag"], r["m"]): r["auc"] for r in auc(trial.select("bag", "y", "o.m", "o.pred"), "pred", "y", ["bag", "m"]).collect()}  # bags times members

    def close(self) -> None:
        self.wide.unpersist()


def bagged_greedy(long: DataFrame, names: Sequence[str], bags: int = 50, seed: int = 0, gain: float = 1e-12) -> dict[str, float]:
    """Mean over bags of the equal weights that greedy selection gives on half of each
    class; a step scores the remaining members of all live bags."""
    names = list(names)
    values = long.where(F.col("member").isin(names) & F.col("pred").isNotNull()).select("member", F.col("pred").cast("double").alias("pred")).distinct()
    few = values.limit(LOOKUP // bags + 1).toPandas()  # at most LOOKUP / bags rows and one
    if len(few) * bags <= LOOKUP:
        score = BagScores(long, names, [np.sort(few["pred"][few["member"] == n].to_numpy(float)) for n in names], bags, seed)
    else:
        score = _WideScores(long, names, bags, seed)
    chosen: list[list[int]] = [[] for _ in range(bags)]
    best = [float("-inf")] * bags
    live = set(range(bags))
    try:
        for _ in names:
            top: dict[int, tuple[float, int]] = {}
            for (b, k), a in score({b: (chosen[b], [k for k in range(len(names)) if k not in chosen[b]]) for b in live}).items():
                if a is not None:
                    top[b] = max(top.get(b, (float("-inf"), 0)), (a, -k))
            for b in sorted(live):
                if b not in top or top[b][0] <= best[b] + gain:
                    live.discard(b)
                else:
                    best[b] = top[b][0]
                    chosen[b].append(-top[b][1])
            if not live:
                break
    finally:
        score.close()
    return {n: sum(1 / len(c) for c in chosen if k in c) / bags for k, n in enumerate(names)}
