"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into runs, written once: in a run every dimension is a list of (value, row) sorted by value. A query reads a
dimension's list from its high end where its own component is positive and from its low end where it is negative, always in order, and
reads lists of greater components further. What it has read of a candidate counts exactly; what it hasn't read lies between the value
at the reading edge and the far end of the list. That gives a lower and an upper bound of each score. All lists are read step by step: a candidate
whose upper bound is below the k-th best lower bound can't qualify and goes, and a query stops reading a run when few candidates are left in it. Their
scores are then resolved exactly in 64-bit integers, ties going to the smaller id.

The k-th best score so far is a lower bound for all that follows. A task reads one block of queries against several runs, one after
another, and carries each query's k best along. The first ``SEED_RUNS`` runs are searched before all others, so every task begins with a bound.

The bounds of all queries of a block are matrix products, as the edges depend on the step, the class of the component and the end only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, parallelism, table

K = 10
SCALE = 1024
#: Rows of a run and of a block of queries; both bound the memory of a task.
RUN, QUERIES = 256, 512
#: Runs that are searched first, and runs that one task reads against a block of queries.
SEED_RUNS, TASK_RUNS = 8, 32
#: Parts of the lists that are read by the end of each step; and times that for the quarters of a query's components, the greatest first.
DEPTHS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
DEEPER = (1.2, 1.0, 0.7, 0.3)
#: A query stops reading a run when so small a part of its candidates is left.
FEW = 0.05


@dataclass
class SortedRun:
    """``ids``, ``values`` (rows, dims) and ``order``: of each dimension the rows by value."""

    ids: np.ndarray
    values: np.ndarray
    order: np.ndarray

    def __post_init__(self) -> None:
        self.x = self.values.astype(np.float64)
        n, dims = self.values.shape
        self.place = np.empty((n, dims), dtype=np.int64)
        np.put_along_axis(self.place, self.order.astype(np.int64), np.broadcast_to(np.arange(n)[:, None], (n, dims)), axis=0)
        self.by_value = np.take_along_axis(self.x, self.order.astype(np.int64), axis=0)


@dataclass
class QueryBlock:
    """Queries, and the k best of each so far: ``scores`` and ``found`` (ids), the best first, ``filled`` of them in use."""

    ids: np.ndarray
    values: np.ndarray
    k: int
    bound: np.ndarray | None = None
    #: Entries read and pairs resolved, against all that there are.
    read: int = 0
    resolved: int = 0
    entries: int = 0
    pairs: int = 0
    best: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.x = self.values.astype(np.float64)
        rank = np.argsort(np.argsort(-np.abs(self.x), axis=1, kind="stable"), axis=1)
        self.kind = rank * len(DEEPER) // max(self.x.shape[1], 1)
        self.bound = np.full(len(self.ids), -np.inf) if self.bound is None else self.bound
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)

    def search(self, run: SortedRun) -> None:
        """Read a run's lists and keep the k best."""
        alive = self.candidates(run)
        self.pairs += alive.size
        self.resolved += int(alive.sum())
        for i in range(len(self.ids)):
            rows = np.flatnonzero(alive[i])
            if not len(rows):
                continue
            scores, ids = self.best[i]
            scores = np.concatenate([scores, (run.values[rows] * self.values[i][None, :]).sum(axis=1)])
            ids = np.concatenate([ids, run.ids[rows]])
            first = np.lexsort((ids, -scores))[: self.k]
            self.best[i] = scores[first], ids[first]
            if len(first) == self.k:
                self.bound[i] = max(self.bound[i], float(scores[first[-1]]))

    def candidates(self, run: SortedRun) -> np.ndarray:
        """Which rows of the run may be among the k best of each query: no other can be, ties included."""
        n, dims = run.x.shape
        other = run.ids[None, :] != self.ids[:, None]
        alive = other.copy()
        self.entries += len(self.ids) * n * dims
        most_q, most_x = np.abs(self.x).max(initial=0), np.abs(run.x).max(initial=0)
        room = 0.0 if float(most_q) * float(most_x) * dims < 2.0**52 else 1e-9 * (np.abs(self.x).sum(axis=1) * most_x + 1)
        active, had = np.arange(len(self.ids)), 0
        for depth in DEPTHS:
            upper, lower, read = np.zeros((len(active), n)), np.zeros((len(active), n)), 0
            for kind, deeper in enumerate(DEEPER):
                t = min(n, max(1, int(n * depth * deeper)))
                read += t * int((self.kind[0] == kind).sum()) if len(self.kind) else 0
                own = np.where(self.kind[active] == kind, self.x[active], 0)
                for q, seen, edge, far in ((np.maximum(own, 0), run.place >= n - t, run.by_value[n - t], run.by_value[0]), (np.minimum(own, 0), run.place < t, run.by_value[t - 1], run.by_value[-1])):
                    upper += q @ np.where(seen, run.x, edge).T
                    lower += q @ np.where(seen, run.x, far).T
            slack = room if np.isscalar(room) else room[active][:, None]
            upper, lower = upper + slack, np.where(other[active], lower - slack, -np.inf)
            bound = self.bound[active]
            if n >= self.k:
                bound = np.maximum(bound, np.partition(lower, n - self.k, axis=1)[:, n - self.k])
            alive[active] &= upper >= bound[:, None]
            self.read += len(active) * (read - had)
            had = read
            active = active[alive[active].sum(axis=1) > FEW * n]
            if not len(active):
                break
        return alive


def _packed(name: str, per: int):
    """Rows sorted by ``name`` to one row for each value: n, dims, ids and values as bytes, and for runs the sorted lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column("id").to_numpy().astype(np.int64)
            values = rows.column("v").combine_chunks()
            values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
            flat = values.flatten().to_numpy().astype(np.int64).reshape(len(ids), -1)
            small = np.abs(flat).max(initial=0) < 1 << 31 and flat.min(initial=0) > -(1 << 31)
            order = np.argsort(flat, axis=0, kind="stable").astype(np.uint16) if name == "run" else np.zeros(0, np.uint16)
            columns = {name: rows.column(name)[0].as_py(), "dims": flat.shape[1], "ids": ids.tobytes(), "lists": flat.astype(np.int32 if small else np.int64).tobytes(), "places": order.tobytes()}
            return pa.RecordBatch.from_pydict({c: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for c, v in columns.items()})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held)
            keys = np.stack([whole.column(c).to_numpy() for c in (name, "dims")])
            last = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for lo, hi in zip([0, *last.tolist()][:-1], last.tolist(), strict=True):
                yield from (write(whole.slice(a, min(per, hi - a))) for a in range(lo, hi, per))
            held = whole.slice(int(last[-1]) if len(last) else 0).to_batches()
        if held and sum(b.num_rows for b in held):
            whole = pa.Table.from_batches(held)
            yield from (write(whole.slice(a, min(per, whole.num_rows - a))) for a in range(0, whole.num_rows, per))

    return run


_BLOCK = "long, dims long, ids binary, lists binary, places binary"


def blocks_of(rows: DataFrame, name: str, per: int) -> DataFrame:
    """``rows(id, v)`` packed ``per`` rows at most to a block, written once: ``name``, dims, ids, lists, places. Vectors of one length share blocks."""
    spark = rows.sparkSession
    many = max(1, math.ceil(rows.count() / max(per * 3 // 4, 1)))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(many))).withColumn("dims", F.size("v").cast("long"))
    dealt = dealt.repartition(min(many, parallelism(spark)), name).sortWithinPartitions(name, "dims", "id", "v")
    return cut(dealt.mapInArrow(_packed(name, per), f"{name} {_BLOCK}"))


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def close(block: QueryBlock | None) -> Iterator[pa.RecordBatch]:
        if block is not None:
            sizes = [len(ids) for _, ids in block.best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids, sizes)), *(pa.array(np.concatenate([b[side] for b in block.best]), pa.int64()) for side in (1, 0))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of = None, None
        for batch in batches:
            for row in batch.to_pylist():
                ids, dims = np.frombuffer(row["ids"], np.int64), row["dims"]
                values = np.frombuffer(row["lists"], np.int32 if len(row["lists"]) == 4 * len(ids) * dims else np.int64).reshape(len(ids), dims).astype(np.int64)
                if row["bounds"] is not None:
                    yield from close(block)
                    block, of = QueryBlock(ids, values, k, np.frombuffer(row["bounds"], np.float64).copy()), (row["side"], row["chunk"], dims)
                elif of == (row["side"], row["chunk"], dims):
                    block.search(SortedRun(ids, values, np.frombuffer(row["places"], np.uint16).reshape(len(ids), dims)))
        yield from close(block)

    return run


def _bounded(k: int):
    """Bounds of a block of queries: the k-th best score of each so far (``known``: query_id to it), or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                known = {r["query_id"]: r["bound"] for r in row["known"] or []}
                out.append(np.array([known.get(i, -np.inf) for i in np.frombuffer(row["ids"], np.int64).tolist()], np.float64).tobytes())
            rest = [c for c in batch.schema.names if c != "known"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.binary())], names=[*rest, "bounds"])

    return run


def _tasks(sides: DataFrame, runs: DataFrame, k: int) -> DataFrame:
    """The k best of each query within each chunk of runs: a task reads a block of queries, then the runs of a chunk in order."""
    spark = runs.sparkSession
    chunks = runs.select("chunk", "dims").distinct()
    heads = sides.join(chunks, "dims").select("side", "chunk", "dims", F.lit(-1).cast("long").alias("run"), "ids", "lists", "places", "bounds")
    tails = runs.join(F.broadcast(sides.select("side", "dims").distinct()), "dims").select("side", "chunk", "dims", "run", "ids", "lists", "places", F.lit(None).cast("binary").alias("bounds"))
    rows = heads.unionByName(tails).repartition(parallelism(spark) * 4, "side", "chunk", "dims").sortWithinPartitions("side", "chunk", "dims", "run")
    return rows.mapInArrow(_search(k), "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``queries(query_id long, _q array<long>)`` against the ``candidates(vec_id long, _v array<long>)`` of the same length.

    Rows whose vec_id equals the query_id are the query's own and don't count. A query with several rows takes the least
    vector. Candidate rows that repeat each count. Scores must fit 64 bits. Nothing on one side: no rows.

    Every block of queries meets every run, as the query set is a part of the table: work and rows sent grow with both.
    """
    queries = queries.groupBy("query_id").agg(F.min("_q").alias("_q"))
    runs = blocks_of(candidates.select(F.col("vec_id").alias("id"), F.col("_v").alias("v")), "run", RUN)
    sides = blocks_of(queries.select(F.col("query_id").alias("id"), F.col("_q").alias("v")), "side", QUERIES)
    first = sides.withColumn("known", F.lit(None).cast("array<struct<query_id:long,bound:double>>"))
    schema = f"side {_BLOCK}, bounds binary"
    seed = cut(_tasks(first.mapInArrow(_bounded(k), schema), runs.filter(F.col("run") < SEED_RUNS).withColumn("chunk", F.lit(-1).cast("long")), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = seed.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    of = sides.mapInArrow(_listed, "query_id long, side long, dims long").join(bounds, "query_id").groupBy("side", "dims").agg(F.collect_list(F.struct("query_id", "bound")).alias("known"))
    known = sides.join(of, ["side", "dims"], "left").select(*sides.columns, "known").mapInArrow(_bounded(k), schema)
    rest = _tasks(cut(known), runs.filter(F.col("run") >= SEED_RUNS).withColumn("chunk", F.floor(F.col("run") / TASK_RUNS)), k)
    return seed.unionByName(rest).withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            yield pa.RecordBatch.from_pydict({"query_id": ids, "side": np.full(len(ids), row["side"], np.int64), "dims": np.full(len(ids), row["dims"], np.int64)})


def integer_vectors(df: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and ``floor(scale * x)`` of each component as double; vectors that are null, empty or hold null or non-finite components, and rows without an id, go."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    fit = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad
    return df.filter(fit).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("_v"))


def op4_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of each vector whose vec_id is divisible by 100, against all others.

    Null and empty vectors, those that hold null or non-finite components, and rows without a vec_id take no part; vectors of another length are never compared; rows that
    repeat a vec_id each count as candidates, and the least is the query; ties go to the smaller vec_id; an empty table gives no rows; other columns are not read.
    """
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    queries = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("_v").alias("_q"))
    return top_k(queries, vectors)
