"""Choice among clusters, scales, proteins, fronts and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS
from .metrics import centers, distance_to_medoid, medoids, squared_distance
from .models import clusters
from .windows import drop_similar, greedy_unlike

#: Rows of a table whose clusters are merged on the driver (a table of scales has hundreds).
MOST_MERGED = 20_000


def _least_correlation(x: np.ndarray) -> float:
    """The least correlation of rows with their mean; 1 for one row."""
    if len(x) < 2:
        return 1.0
    c, y = x.mean(axis=0) - x.mean(), x - x.mean(axis=1, keepdims=True)
    low = np.sqrt((y * y).sum(axis=1) * (c * c).sum())
    return float(np.where(low > 0, (y @ c) / np.maximum(low, 1e-300), 0.0).min())


def merge_clusters(x: np.ndarray, labels: Sequence[int], n_max: int = 5, least: float = 0.5) -> list[int]:
    """Clusters of 1, 2, ... ``n_max`` - 1 rows join the larger one with which all rows correlate best with the common centre, if by ``least`` at
    least; then clusters are numbered by size (ties: as they came)."""
    labels, order = np.asarray(labels).copy(), list(dict.fromkeys(labels))
    for n in range(1, n_max):
        sizes = {c: int((labels == c).sum()) for c in order}
        for small in [c for c in order if sizes[c] == n]:
            fits = {big: q for big in order if sizes[big] > n and (labels == big).any() and (q := _least_correlation(x[(labels == big) | (labels == small)])) >= least}
            if fits:
                labels[labels == small] = max(fits, key=lambda c: (fits[c], -order.index(c)))
    ranked = sorted({int(c) for c in labels}, key=lambda c: (-int((labels == c).sum()), int(np.flatnonzero(labels == c)[0])))
    return [ranked.index(int(c)) for c in labels]


def merged(df: DataFrame, key: str, vector: str, label: str, n_max: int = 5, least: float = 0.5) -> DataFrame:
    """``key, cluster`` after merging. Tables of ``MOST_MERGED`` rows at most are merged on the driver in the order of their keys; of larger ones only the clusters' sums and
    the rows of small clusters get there (``merged_apart``)."""
    rows = df.select(key, vector, label).limit(MOST_MERGED + 1).collect()
    if len(rows) > MOST_MERGED:
        return merged_apart(df, key, vector, label, n_max, least)
    rows.sort(key=lambda r: r[0])
    out = merge_clusters(np.array([r[1] for r in rows], dtype=float), [r[2] for r in rows], n_max, least) if rows else []
    return df.sparkSession.createDataFrame([(r[0], c) for r, c in zip(rows, out, strict=True)], f"{key} {dict(df.dtypes)[key]}, cluster int")


#: Pairs of a small and a larger cluster that one pass over the rows tells of.
_PAIRS = 1 << 20


def _fits(rows: DataFrame, place: dict, sums: np.ndarray, sizes: np.ndarray, small: list[int], big: list[int]) -> np.ndarray:
    """Least correlation of the rows of each larger cluster with its common centre with each small one: small x big. ``place``: which cluster a label is in by now."""
    column, sc = {c: k for k, c in enumerate(big)}, rows.sparkSession.sparkContext
    sent = sc.broadcast((place, sums[small], sizes[small], sums[big], sizes[big]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s, n, t, m = sent.value
        out = np.full((len(s), len(t)), np.inf)
        for batch in batches:
            told = np.array([column.get(at[c], -1) for c in batch.column(1).to_pylist()])
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            y = x - x.mean(axis=1, keepdims=True)
            size = (y * y).sum(axis=1)
            for b in np.unique(told[told >= 0]):
                c = (s + t[b]) / (n + m[b])[:, None]
                c -= c.mean(axis=1, keepdims=True)
                mine = told == b
                low = np.sqrt(size[mine][:, None] * (c * c).sum(axis=1)[None, :])
                out[:, b] = np.minimum(out[:, b], np.where(low > 0, (y[mine] @ c.T) / np.maximum(low, 1e-300), 0.0).min(axis=0))
        i, j = np.nonzero(np.isfinite(out))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(out[i, j])], names=["i", "j", "q"])

    out = np.full((len(small), len(big)), np.inf)
    for r in rows.mapInArrow(run, "i long, j long, q double").groupBy("i", "j").agg(F.min("q").alias("q")).collect():
        out[r["i"], r["j"]] = r["q"]
    return out


def merged_apart(df: DataFrame, key: str, vector: str, label: str, n_max: int = 5, least: float = 0.5) -> DataFrame:
    """``merge_clusters`` of a table of any length: one pass gives the clusters' sums, then each pass tells how small clusters fit larger ones, again only for those that
    have grown since. The driver holds a sum of vectors per cluster, and the rows of clusters below ``n_max``; passes after the first number at most the merges."""
    rows, kind = df.select(vector, label, key), dict(df.dtypes)[label]
    told = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.first(F.size(vector)).alias("d")).collect()
    told.sort(key=lambda r: r["first"])
    number, dims = {r[label]: k for k, r in enumerate(told)}, told[0]["d"]
    sizes = np.array([r["n"] for r in told])
    few = [r[label] for r in told if r["n"] < n_max]
    place = {r[label]: k for k, r in enumerate(told)}
    if few:
        sums = np.zeros((len(told), dims))
        for r in rows.groupBy(label).agg(F.array(*[F.sum(F.col(vector)[d].cast("double")) for d in range(dims)]).alias("s")).collect():
            sums[number[r[label]]] = r["s"]
        names = rows.sparkSession.createDataFrame([(c,) for c in few], f"{label} {kind}")
        held: dict[int, list] = {}
        for r in rows.join(F.broadcast(names), label).select(label, vector).collect():
            held.setdefault(number[r[0]], []).append(np.asarray(r[1], dtype=float))
        for n in range(1, n_max):
            at = sizes.copy()
            small = [c for c in range(len(told)) if at[c] == n]
            big = [c for c in range(len(told)) if at[c] > n]
            step = max(1, _PAIRS // max(len(big), 1))
            for lo in range(0, len(small) if big else 0, step):
                mine = small[lo : lo + step]
                fits, grown = _fits(rows, place, sums, sizes, mine, big), set()
                for k, c in enumerate(mine):
                    if grown:
                        again = sorted(grown)
                        fits[k:, again] = _fits(rows, place, sums, sizes, mine[k:], [big[j] for j in again])
                        grown = set()
                    x, best = np.stack(held[c]), None
                    y = x - x.mean(axis=1, keepdims=True)
                    centre = (sums[big] + sums[c]) / (sizes[big] + sizes[c])[:, None]
                    centre -= centre.mean(axis=1, keepdims=True)
                    low = np.sqrt((y * y).sum(axis=1)[:, None] * (centre * centre).sum(axis=1)[None, :])
                    own = np.where(low > 0, (y @ centre.T) / np.maximum(low, 1e-300), 0.0).min(axis=0)
                    q = np.minimum(fits[k], own)
                    if q.max() >= least:
                        j = int(np.argmax(q))
                        best = big[j]
                        sums[best] += sums[c]
                        sizes[best] += sizes[c]
                        sizes[c] = 0
                        if best in held:
                            held[best] += held[c]
                        place.update({name: best for name, p in place.items() if p == c})
                        grown.add(j)
    first: dict[int, int] = {}
    for name, p in place.items():
        first[p] = min(first.get(p, number[name]), number[name])
    ranked = {c: k for k, c in enumerate(sorted(first, key=lambda c: (-int(sizes[c]), first[c])))}
    table = df.sparkSession.createDataFrame([(name, ranked[p]) for name, p in place.items()], f"{label} {kind}, cluster int")
    return rows.join(F.broadcast(table), label).select(key, "cluster")


def calinski_harabasz(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """One row ``ch``: spread between clusters by that within; 0 if there is only one."""
    means = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.avg(F.col(vector)[d].cast("double")).alias(f"_{d}") for d in range(dims)])
    means = means.select(label, "_n", F.array(*[F.col(f"_{d}") for d in range(dims)]).alias("_c"))
    whole = df.agg(*[F.avg(F.col(vector)[d].cast("double")).alias(f"_{d}") for d in range(dims)]).select(F.array(*[F.col(f"_{d}") for d in range(dims)]).alias("_all"))
    within = df.join(means, label).agg(F.sum(squared_distance(F.col(vector), F.col("_c"))).alias("w"))
    between = means.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("_n") * squared_distance(F.col("_c"), F.col("_all"))).alias("b"), F.sum("_n").alias("n"), F.count(F.lit(1)).cast("double").alias("k"))
    k, n = F.col("k"), F.col("n")
    return between.crossJoin(F.broadcast(within)).select(F.when((k > 1) & (F.col("w") > 0), F.col("b") / (k - 1) / (F.col("w") / (n - k))).otherwise(0.0).alias("ch"))


#: Rows that a worker compares at once: its own, and others.
_OWN, _OTHERS = 128, 1024


def silhouette(df: DataFrame, key: str, label: str, vector: str, block: int = 1 << 18) -> DataFrame:
    """One row ``sc``: mean over rows of (b - a) / max(a, b), a the mean distance to the own cluster's others and b the least to another cluster; 0 for rows alone in their
    cluster. Rows meet all rows, of which about ``block`` at a time go to the workers; a row gets one array of sums by cluster for each such block, and distances stay in
    tiles. The work grows with the square of the rows, what is held and shuffled doesn't."""
    sc, kind, told = df.sparkSession.sparkContext, dict(df.dtypes)[key], dict(df.dtypes)[label]
    rows = df.select(key, label, vector)
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return df.sparkSession.createDataFrame([(None,)], "sc double")
    groups = sorted(sizes)
    place, n = {g: k for k, g in enumerate(groups)}, sum(sizes.values())

    def matrix(table: pa.RecordBatch | pa.Table) -> np.ndarray:
        column = table.column(2)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def sums(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends, y = sent.value  # rows in the order of their clusters
            for batch in batches:
                x = matrix(batch).astype(float)
                total, size = np.zeros((len(x), len(groups))), (x * x).sum(axis=1)
                for a, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    for first in range(lo, hi, _OTHERS):
                        z = y[first : min(first + _OTHERS, hi)].astype(float)
                        other, turned = (z * z).sum(axis=1), -2 * z.T
                        for at in range(0, len(x), _OWN):
                            far = x[at : at + _OWN] @ turned
                            far += size[at : at + _OWN, None]
                            far += other
                            np.sqrt(np.maximum(far, 0.0, out=far), out=far)
                            total[at : at + _OWN, a] += far.sum(axis=1)
                column = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(groups), pa.array(total.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], names=[key, label, "_s"])

        return run

    spread, out, rounds, blocks = rows.repartition(sc.defaultParallelism * 4), None, -(-n // block), 0
    for k in range(rounds):
        mine = rows.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == k).toArrow()
        if not mine.num_rows:
            continue
        of = np.array([place[g] for g in mine.column(1).to_pylist()])
        blocks += 1
        sent = sc.broadcast((np.searchsorted(np.sort(of), np.arange(len(groups) + 1)), matrix(mine)[np.argsort(of, kind="stable")]))
        part = spread.mapInArrow(sums(sent), f"`{key}` {kind}, `{label}` {told}, _s array<double>")
        out = part if out is None else out.unionByName(part)
    # a row has an array for each block; equal keys count as one row of all their distances
    mean = out.groupBy(key, label).agg((F.count(F.lit(1)) / blocks).alias("_m"), *[F.sum(F.col("_s")[k]).alias(f"_{k}") for k in range(len(groups))])
    own = lambda k: F.col(label).eqNullSafe(F.lit(groups[k]))
    a = F.coalesce(*[F.when(own(k), F.col(f"_{k}") / F.nullif(F.col("_m") * sizes[g] - 1, F.lit(0.0))) for k, g in enumerate(groups)], F.lit(None).cast("double"))
    b = F.array_min(F.array(*[F.when(~own(k), F.col(f"_{k}") / (F.col("_m") * sizes[g])) for k, g in enumerate(groups)]))
    ab = mean.select(a.alias("a"), b.alias("b"))
    one = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.avg(one).alias("sc"))


def representatives(df: DataFrame, key: str, vector: str, dims: int, k: int, metric: str = "correlation") -> DataFrame:
    """``key, cluster, is_representative, dist_to_rep`` of k clusters and their medoids."""
    found = clusters(df, key, vector, k).select(key, vector, "cluster")
    chosen = medoids(found, "cluster", key, vector, dims, metric).select(F.col("medoid").alias("_rep"), F.lit(True).alias("_is"))
    far = distance_to_medoid(found, "cluster", key, vector, dims, metric)
    return far.join(chosen, F.col(key) == F.col("_rep"), "left").select(key, "cluster", F.coalesce("_is", F.lit(False)).alias("is_representative"), F.col("distance").alias("dist_to_rep"))


def select_until_covered(df: DataFrame, key: str, vector: str, dims: int, names: DataFrame, name: str, least: float = 100.0, most: int | None = None) -> DataFrame:
    """Representatives of the fewest clusters, among doublings, whose ``names(key, name)`` cover so many percent of all names."""
    every = names.select(name).distinct().count()
    most, k = most or df.count(), 2
    while True:
        chosen = representatives(df, key, vector, dims, min(k, most)).filter("is_representative").select(key)
        if k >= most or names.join(chosen, key, "left_semi").select(name).distinct().count() * 100.0 >= least * every:
            return chosen
        k *= 2


# Fronts


def convergence(front: DataFrame, reference: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """One row ``convergence``: mean over the front of the distance to the nearest point of a reference front, each objective divided by its range over both; fronts
    are small next to the tables they come from, and equal points are one."""
    both = front.select(*objectives).unionByName(reference.select(*objectives))
    spans = both.agg(*[F.coalesce(F.nullif((F.max(c) - F.min(c)).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(f"_s{i}") for i, c in enumerate(objectives)])
    mine = front.groupBy(*objectives).agg(F.count(F.lit(1)).alias("_n"))
    theirs = reference.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(objectives)]).distinct()
    far = sum(((F.col(c) - F.col(f"_r{i}")) / F.col(f"_s{i}")) * ((F.col(c) - F.col(f"_r{i}")) / F.col(f"_s{i}")) for i, c in enumerate(objectives))
    near = mine.crossJoin(theirs).crossJoin(F.broadcast(spans)).groupBy(*objectives, "_n").agg(F.min(F.sqrt(far)).alias("_d"))
    return near.agg((F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("convergence"))


def greedy_walk(wild: str, positions: Sequence[int], objective: Callable[[str], float], weights: Mapping[int, float] | None = None, most: int = 5, alphabet: str = LETTERS) -> list[tuple[str, float]]:
    """The accepted variants of a walk over the positions, the heaviest first: at each the best letter is taken if it betters the objective."""
    weights, current, best, out = weights or {}, wild, -np.inf, []
    for p in sorted(positions, key=lambda p: (-float(weights.get(p, 0.0)), p)):
        if len(out) >= most:
            break
        trials = [(current[: p - 1] + a + current[p:], a) for a in alphabet if a != wild[p - 1]]
        if not trials:
            continue
        scores = [objective(s) for s, _ in trials]
        at = int(np.argmax(scores))
        if scores[at] > best:
            best, current = float(scores[at]), trials[at][0]
            out.append((current, best))
    return out



# Samples


def benchmark_set(arms: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of all arms with their name in ``arm``; columns that an arm lacks are null."""
    out = None
    for name, rows in arms.items():
        rows = rows.withColumn("arm", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def sub_seed(seed: int, arm: str) -> int:
    """A seed of its own for each arm."""
    return sum((i + 1) * ord(c) for i, c in enumerate(f"{seed}:{arm}"))


def draw_until(candidates: DataFrame, n: int, size: int, draw: Column, test: DataFrame | None = None, max_to_test: float | None = None, max_within: float | None = None, attempts: int = 10) -> DataFrame:
    """Up to n of ``candidates(entry, center, window)`` in the order of ``draw``: windows like a test window go, batches are drawn and filtered against those taken before,
    until there are enough, no candidates left, or so many attempts made. What reaches the driver is bounded by n times the attempts."""
    spark, taken, at = candidates.sparkSession, [], 0
    ordered = candidates.withColumn("_d", draw)
    if test is not None and max_to_test is not None:
        ordered = drop_similar(ordered, test, size, max_to_test)
    drawn = ordered.orderBy("_d", "entry", "center").limit(n * attempts).select("entry", "center", "window").collect()
    while len(taken) < n and at < len(drawn):
        batch = drawn[at : at + n - len(taken)]
        at += len(batch)
        both = [*taken, *batch]
        keep = greedy_unlike([r["window"] for r in both], max_within) if max_within is not None else range(len(both))
        taken = [both[k] for k in keep][:n]
    return spark.createDataFrame([tuple(r) for r in taken], "entry long, center int, window string")


def motif_p_values(pwm: Sequence[Sequence[int]], background: Sequence[float] | None = None) -> dict[int, float]:
    """Probability of each score, or a higher one, for random letters: the exact distribution of sums, a position at a time."""
    background = background or [1 / 20] * 20
    dist: dict[int, float] = {0: 1.0}
    for row in pwm:
        new: dict[int, float] = {}
        for s, p in dist.items():
            for v, q in zip(row, background, strict=True):
                new[s + int(v)] = new.get(s + int(v), 0.0) + p * q
        dist = new
    out, tail = {}, 0.0
    for s in sorted(dist, reverse=True):
        tail += dist[s]
        out[s] = min(tail, 1.0)
    return out


def motif_hits(scored: DataFrame, p_values: Mapping[int, float], most: float = 1e-4) -> DataFrame:
    """Rows of ``scored(..., score)`` with ``p_value`` of at most so much; there is a row per possible score."""
    table = scored.sparkSession.createDataFrame([(int(s), float(p)) for s, p in p_values.items() if p <= most], "score long, p_value double")
    return scored.join(F.broadcast(table), "score")



def center_table(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """``label, n`` and a column per dimension of the centres: what a chart of centres shows."""
    c = centers(df, label, vector, dims)
    return c.select(label, "n", *[F.col("center")[d].alias(f"d{d}") for d in range(dims)])
