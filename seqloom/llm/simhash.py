"""SimHash fingerprints compared bit-sliced.

Fingerprints that may link meet in buckets. For radius 3 the bits fall into five parts, of which two at least are equal in any
link, so ten tables of two parts each lose none. A bucket's fingerprints are stored as vertical bit planes: word i of plane k holds bit
k of 64 fingerprints. Distances of 64 pairs at a time are counted in carry-save counters, two planes per step; the
counters start so that they overflow exactly past the radius, and words of which all pairs have overflowed are abandoned.

Small buckets are compared many at once, the whole sequence of fingerprints against itself shifted by 1, 2, ... places.
Larger ones are compared query by query against the planes, buckets of over ``TILE`` fingerprints in tiles of two parts, so no task
holds a hot bucket. A tile returns a spanning forest of its links, not all pairs; links then join up in ``components``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_slices, bloom_bits, bloom_has, bloom_of, cut, free_name, mix, parallelism, table, text_buffer, text_or_empty, windows, word_hashes, words_of
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
TILE = 1024
SMALL = 64
CHUNK = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Near-duplicates of the pipeline: word shingles of five, Jaccard 0.8 or more.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
#: 128 bits; at similarity 0.8 a link differs in 19.4 bits on average, with a deviation of 4.1: one in 400,000 is beyond the radius.
NEAR_WORDS, NEAR_RADIUS = 2, 38
#: Bands of so many min-wise shingles; at similarity 0.8 two texts share none of them with probability (1 - 0.8 ** 2) ** 12 = 5e-6.
NEAR_BANDS, NEAR_ROWS = 12, 2
#: Shingles of a part of a group whose pairs are verified in one task (each text counts ``VERIFY_LEAST`` at least).
VERIFY_SHINGLES, VERIFY_LEAST = 1 << 19, 64
#: Most hot buckets or groups that are sent to the tasks; with more they are joined.
MOST_HOT = 1 << 17


# Bit planes


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Fingerprints (n, words) as planes (64 * words, n / 64 and one empty word more)."""
    n, words = prints.shape
    lanes = -(-n // 64) * 64 + 64
    bits = np.zeros((lanes, 64 * words), dtype=np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(plane: Callable[[int, np.ndarray], np.ndarray], n_planes: int, radius: int, wanted: np.ndarray) -> np.ndarray:
    """Which of the ``wanted`` lanes (a flat array of words) differ in ``radius`` planes or fewer. ``plane(k, words)``: the
    differences in plane k at these words."""
    width = max(radius.bit_length(), 1)
    start = (1 << width) - 1 - radius
    out = np.zeros_like(wanted)
    live = np.flatnonzero(wanted)
    over = ~wanted[live]
    counters = [np.full(len(live), _ALL if start >> j & 1 else 0, dtype=np.uint64) for j in range(width)]
    zeros = None
    for k in range(0, n_planes, 2):
        if not len(live):
            return out
        a = plane(k, live)
        b = plane(k + 1, live) if k + 1 < n_planes else (zeros if zeros is not None and len(zeros) == len(live) else np.zeros(len(live), np.uint64))
        half = counters[0] ^ a
        if width == 1:  # the carry of three bits of weight 1 has weight 2, which overflows a counter of one bit
            over |= (counters[0] & a) | (half & b)
            counters[0] = half ^ b
        else:
            carry = (counters[0] & a) | (half & b)
            counters[0] = half ^ b
            for j in range(1, width):
                counters[j], carry = counters[j] ^ carry, counters[j] & carry
            over |= carry
        if k % 8 == 6:
            stay = over != _ALL
            if stay.sum() < 0.75 * len(live):
                live, over, counters = live[stay], over[stay], [c[stay] for c in counters]
    out[live] = ~over
    return out


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def _pack(mask: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(words * 64, dtype=np.uint8)
    bits[: len(mask)] = mask
    return np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)


def distances(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1)


class Forest:
    """Union-find that keeps the links which joined something."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def small_links(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``, each of at most SMALL rows: the sequence against itself, shifted."""
    n = len(prints)
    planes = planes_of(prints)
    words = planes.shape[1]
    found_i, found_j = [], []
    for s in range(1, SMALL):
        same = group[:-s] == group[s:] if s < n else np.zeros(0, bool)
        if not same.any():
            break
        low, high = np.uint64(s), np.uint64(64 - s)

        def plane(k: int, at: np.ndarray, low=low, high=high) -> np.ndarray:
            row = planes[k]
            mine = row[at]
            return mine ^ ((mine >> low) | (row[np.minimum(at + 1, words - 1)] << high))

        i = _lanes(within(plane, planes.shape[0], radius, _pack(same, words)))
        found_i.append(i)
        found_j.append(i + s)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def block_links(prints: np.ndarray, radius: int, step: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows within ``radius``: blocks of queries against all planes."""
    n = len(prints)
    planes = planes_of(prints)
    words = planes.shape[1] - 1
    for at in range(0, n, step):
        mine = np.arange(at, min(at + step, n))
        bits = np.unpackbits(np.ascontiguousarray(prints[mine]).astype("<u8").view(np.uint8).reshape(len(mine), -1), axis=1, bitorder="little")
        flip = np.where(bits.T.astype(bool), _ALL, np.uint64(0))
        wanted = np.stack([_pack(np.arange(n) > i, words) for i in mine]).reshape(-1)

        def plane(k: int, where: np.ndarray, flip=flip) -> np.ndarray:
            return planes[k][where % words] ^ flip[k][where // words]

        near = within(plane, planes.shape[0], radius, wanted).reshape(len(mine), words)
        for row, i in enumerate(mine):
            if near[row].any():
                yield int(i), _lanes(near[row])


def forest_of_bucket(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one larger bucket."""
    label = np.arange(len(prints))
    out = []
    for i, others in block_links(prints, radius):
        labels = label[others]
        new = labels != label[i]
        if not new.any():
            continue
        labels, first = np.unique(labels[new], return_index=True)
        out += [(i, int(c)) for c in others[new][first]]
        joined = np.append(labels, label[i])
        label[np.isin(label, joined)] = joined.min()
    return out


def forest_of_chunk(prints: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forests of all buckets of a chunk of rows sorted by bucket."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    size = np.repeat(sizes, sizes)
    out = []
    few = np.flatnonzero((size > 1) & (size <= SMALL))
    if len(few):
        i, j = small_links(prints[few], group[few], radius)
        forest = Forest(len(group))
        out += [(a, b) for a, b in zip(few[i].tolist(), few[j].tolist(), strict=True) if forest.join(a, b)]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        out += [(s + a, s + b) for a, b in forest_of_bucket(prints[s : s + n], radius)]
    return out


# Buckets and links


def pigeonhole_masks(bits: int = BITS, radius: int = RADIUS) -> list[list[int]]:
    """Masks (one number per 64 bits) of the tables of which any two fingerprints within ``radius`` agree in one at least."""
    edges = np.linspace(0, bits, radius + 3).round().astype(int)
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [[(x | y) >> s & int(_ALL) for s in range(0, bits, 64)] for x, y in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(columns: Sequence[str], radius: int, node_type: pa.DataType):
    schema = pa.schema([("a", node_type), ("b", node_type)])

    def links(whole: pa.Table) -> pa.RecordBatch:
        prints = np.stack([whole.column(c).to_numpy().view(np.uint64) for c in columns], axis=1)
        group = np.cumsum(np.any([np.r_[False, (x := whole.column(c).to_numpy())[1:] != x[:-1]] for c in ("_key", "_i", "_j")], axis=0))
        found = forest_of_chunk(prints, group, radius)
        nodes = whole.column("node")
        a, b = (nodes.take(pa.array([f[side] for f in found], pa.int64())).combine_chunks() for side in (0, 1))
        return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else (pa.array([], node_type) if isinstance(x, pa.ChunkedArray) else x) for x in (a, b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                whole = pa.Table.from_batches(held)
                keys = [whole.column(c).to_numpy() for c in ("_key", "_i", "_j")]
                last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
                if len(last):
                    at = int(last[-1]) + 1
                    yield links(whole.slice(0, at))
                    held = whole.slice(at).to_batches()
        if held and sum(b.num_rows for b in held):
            yield links(pa.Table.from_batches(held))

    return run


def with_parts(df: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``df`` with ``_parts``: that of its key in ``sizes(_of, _parts)``, which names the hot keys only, else 1. Hot keys are few, so they go
    to the tasks and no row is moved to learn that its key isn't hot."""
    sizes = cut(sizes)
    few = F.broadcast(sizes) if sizes.count() <= MOST_HOT else sizes
    return df.join(few, F.col(key) == F.col("_of"), "left").drop("_of").withColumn("_parts", F.coalesce(F.col("_parts").cast("int"), F.lit(1)))


def in_tiles(df: DataFrame, key: str, node: str = "node") -> DataFrame:
    """Rows with ``_own``, the part of each by a hash of its node, copied to all tiles ``_i <= _j`` of two parts of its key."""
    dealt = df.withColumn("_own", F.pmod(F.xxhash64(F.lit(7), node), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other", "_parts")
    return dealt.repartition(parallelism(df.sparkSession), key, "_i", "_j").sortWithinPartitions(key, "_i", "_j", node)


def mask_keys(columns: Sequence[str], masks: Sequence[Sequence[int]]) -> list[Column]:
    """A bucket for each mask: what the fingerprint has under it."""
    return [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(_signed(m)).cast("long")) for c, m in zip(columns, mask, strict=True)]) for t, mask in enumerate(masks)]


def hamming_links(prints: DataFrame, columns: Sequence[str], radius: int, keys: Sequence[Column]) -> DataFrame:
    """Links ``a, b`` between the nodes of ``prints(node, *columns)`` within ``radius`` that have one of the bucket ``keys`` in common: a
    spanning forest of each bucket, or of each tile of a hot one. Nodes must be distinct; buckets are read in the order of their nodes,
    so tasks run again give the same links."""
    keyed = prints.select("node", *columns, F.explode(F.array(*keys)).alias("_key"))
    sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TILE)
    dealt = in_tiles(with_parts(keyed, "_key", sizes.select(F.col("_key").alias("_of"), F.ceil(F.col("_n") / TILE).alias("_parts"))), "_key")
    kind = dict(prints.dtypes)["node"]
    return dealt.mapInArrow(_forest(columns, radius, pa.string() if kind == "string" else pa.int64()), f"a {kind}, b {kind}").distinct()


# The contract's fingerprint


def contract_fingerprint(text: str) -> int:
    """64 bits over the XXH64 of all 3-word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-SHINGLE]].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)])
    n = len(starts)
    ones = np.zeros(64, dtype=np.int64)
    raw = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((contract_fingerprint(t or "") for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "_print": pa.array(prints.view(np.int64), pa.int64())})


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Equal fingerprints are one node, so exact copies cost nothing. Null and empty texts have fingerprint zero and link like any
    other; repeated rows and rows without a doc_id get rows of their own (the latter count for no component_id unless alone).
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    prints = cut(docs.mapInArrow(_fingerprints, "doc_id long, _print long"))
    nodes = cut(prints.groupBy(F.col("_print").alias("node")).agg(F.min("doc_id").alias("_first")))
    links = hamming_links(nodes.select("node", F.col("node").alias("_print")), ["_print"], RADIUS, mask_keys(["_print"], pigeonhole_masks()))
    of = components(links)
    rooted = nodes.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    known = rooted.join(ids, "root").select(F.col("node").alias("_print"), "component_id")
    return prints.join(known, "_print").select("doc_id", F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates of the pipeline


def shingle_sets(texts: pa.Array, size: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """The set of hashes of the ``size``-word shingles of each text, lower-cased (fewer words: the whole; none: empty), sorted."""
    raw, at = text_buffer(texts, lower=True)
    starts, ends, first = words_of(raw, at)
    hashes = word_hashes(raw, starts, ends)
    whole = windows(hashes, size)
    return [np.unique(whole[lo : hi - size + 1]) if hi - lo >= size else windows(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def near_prints(flat: np.ndarray, starts: np.ndarray, words: int = NEAR_WORDS) -> np.ndarray:
    """Fingerprints (sets, words) of the sets of shingle hashes that begin at ``starts`` (none is empty): a bit is 1 if set in over half of them."""
    sizes = np.diff(np.r_[starts, len(flat)])
    out = np.zeros((len(starts), words), dtype=np.uint64)
    for w in range(words):
        ones = np.zeros((len(starts), 64), dtype=np.int64)
        owner = np.repeat(np.arange(len(starts)), sizes)
        for at in range(0, len(flat), 1 << 16):
            raw = np.unpackbits(mix(flat[at : at + (1 << 16)] + np.uint64(w)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            who = owner[at : at + (1 << 16)]
            begins = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            ones[who[begins]] += np.add.reduceat(raw, begins, axis=0, dtype=np.int64)
        out[:, w] = np.packbits(ones * 2 > sizes[:, None], axis=1).view(">u8")[:, 0]
    return out


_FACTORS = mix(np.arange(1, NEAR_BANDS * NEAR_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def near_bands(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket keys (sets, bands), each of the least values of the set under ``NEAR_ROWS`` orders of its own."""
    least = [np.minimum.reduceat(flat * f, starts) for f in _FACTORS]
    out = np.zeros((len(starts), NEAR_BANDS), dtype=np.uint64)
    for b in range(NEAR_BANDS):
        for r in range(NEAR_ROWS):
            out[:, b] = mix(out[:, b] + least[b * NEAR_ROWS + r] + np.uint64(b + 1))
    return out


def _named(texts: pa.Array) -> list[str]:
    return [hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts.to_pylist()]


_SLICE = 1 << 19
_PRINTS, _BANDS = [f"_f{w}" for w in range(NEAR_WORDS)], [f"_b{b}" for b in range(NEAR_BANDS)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in batch_slices(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), _SLICE):
            part = texts.slice(lo, hi - lo)
            sets = shingle_sets(part)
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            numbers = np.zeros((len(sets), NEAR_WORDS + NEAR_BANDS), dtype=np.uint64)
            if len(some):
                flat, starts = np.concatenate(sets), np.r_[0, np.cumsum(sizes[some])[:-1]]
                numbers[some] = np.concatenate([near_prints(flat, starts), near_bands(flat, starts)], axis=1)
            columns = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "node": pa.array(_named(part), pa.string()), "n": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(numbers[:, k].view(np.int64), pa.int64()) for k, c in enumerate(_PRINTS + _BANDS)})


def _sets_of(sent):
    """A worker's pass over documents: the name and the shingle set of those whose doc_id is in the filter sent, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            wanted = bloom_has(sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(wanted))
            texts = part.column("text")
            for lo, hi in batch_slices(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False), _SLICE):
                some = texts.slice(lo, hi - lo)
                sets = pa.array([s.tobytes() for s in shingle_sets(some)], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").slice(lo, hi - lo), "node": pa.array(_named(some), pa.string()), "shingles": sets})

    return run


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges one after another."""
    sizes = hi - lo
    return np.repeat(lo - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def similar_forest(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets as similar; ``side``: pairs within a side don't count, unless all are on one side.

    Two sets as similar share one of their first shingles in any order, so many of each as could be missing from the other, and one more.
    With the rarest ones first, texts that differ from the rest meet few others; pairs that are joined already are not compared.
    """
    cross = len(np.unique(side)) > 1
    rank = np.argsort([len(s) for s in sets], kind="stable")
    sizes, side = np.array([len(sets[k]) for k in rank]), side[rank]
    none = int((sizes == 0).sum())
    found = [(0, k) for k in range(1, none)]
    starts = np.r_[0, np.cumsum(sizes)]
    known, token = np.unique(np.concatenate([sets[k] for k in rank]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    token = token[np.lexsort((token, np.bincount(token, minlength=len(known))[token], owner))] if len(token) else token
    first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    head = np.flatnonzero(np.arange(len(token)) - starts[owner] < first[owner])
    head = head[np.argsort(token[head], kind="stable")]  # by token, then by owner
    begins = np.searchsorted(token[head], np.arange(len(known)))
    place = np.empty(len(token), dtype=np.int64)
    place[head] = np.arange(len(head))
    label, mark = np.arange(len(sets)), np.zeros(len(known), dtype=bool)
    for x in range(none, len(sets)):
        mine = np.arange(starts[x], starts[x] + min(first[x], sizes[x]))
        met, times = np.unique(owner[head[_ranges(begins[token[mine]], place[mine])]], return_counts=True)
        fit = (sizes[met] >= similarity * sizes[x] - 1e-9) & (label[met] != label[x])
        if cross:
            fit &= side[met] != side[x]
        met = met[fit][np.argsort(-times[fit], kind="stable")]
        if not len(met):
            continue
        mark[token[starts[x] : starts[x + 1]]] = True
        step = 8
        while len(met):
            some, met = met[:step], met[step:]
            both = np.add.reduceat(mark[token[_ranges(starts[some], starts[some + 1])]].astype(np.int64), np.r_[0, np.cumsum(sizes[some])[:-1]])
            for y in some[both >= similarity * (sizes[x] + sizes[some] - both) - 1e-9].tolist():
                if label[y] != label[x]:
                    found.append((y, x))
                    label[label == label[y]] = label[x]
            met, step = met[label[met] != label[x]], step * 4
        mark[token[starts[x] : starts[x + 1]]] = False
    return [(int(rank[a]), int(rank[b])) for a, b in found]


def _similar(similarity: float):
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [rows.column(c).to_numpy() for c in ("root", "_i", "_j")]
        edges = np.flatnonzero(np.any([np.r_[True, k[1:] != k[:-1]] for k in keys], axis=0))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), rows.num_rows], strict=True):
            nodes = rows.column("node").slice(lo, hi - lo).to_pylist()
            once = [k for k in range(len(nodes)) if not k or nodes[k] != nodes[k - 1]]  # repeated rows follow each other
            if len(once) > 1:
                sets = [np.frombuffer(s, dtype=np.uint64) for s in rows.column("shingles").slice(lo, hi - lo).to_pylist()]
                side = rows.column("_own").slice(lo, hi - lo).to_numpy()
                found = similar_forest([sets[k] for k in once], side[once], similarity)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[once[f[s]]] for f in found], pa.string()) for s in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= 4 << 20:
                whole = pa.Table.from_batches(held)
                keys = [whole.column(c).to_numpy() for c in ("root", "_i", "_j")]
                last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
                if len(last):
                    at = int(last[-1]) + 1
                    yield from links(whole.slice(0, at))
                    held = whole.slice(at).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield from links(pa.Table.from_batches(held))

    return run


def verified_links(docs: DataFrame, nodes: DataFrame, loose: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: a spanning forest of the pairs of nodes as similar within each group of ``loose(node, root)``. All pairs of a group count, in tiles
    of two parts where it is large; each shingle set comes from the row of ``docs`` that ``nodes(node, doc_id, n)`` names."""
    wanted = cut(loose.join(nodes.select("node", "doc_id", F.greatest(F.col("n"), F.lit(VERIFY_LEAST)).alias("_n")), "node"))
    sizes = wanted.groupBy("root").agg(F.sum("_n").alias("_n")).filter(F.col("_n") > VERIFY_SHINGLES)
    parted = with_parts(wanted, "root", sizes.select(F.col("root").alias("_of"), F.ceil(F.col("_n") / VERIFY_SHINGLES).alias("_parts")))
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted.select("doc_id"), bloom_bits(wanted.count())))
    sets = docs.mapInArrow(_sets_of(sent), "doc_id long, node string, shingles binary")
    sets = sets.join(parted.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), F.xxhash64("root").alias("root"), "_parts"), (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return in_tiles(sets.select("node", "root", "shingles", "_parts"), "root").mapInArrow(_similar(similarity), "a string, b string").distinct()


def near_groups(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node`` of every row of ``docs(doc_id, text)`` (a node is an exact text, by its MD5) and ``node, root`` of nodes that
    are linked by similarity of their shingle sets; texts without words have similarity 1 with each other.

    Bands of min-wise shingles are the buckets in which fingerprints are compared bit-sliced. Their links are loose (they reach down to a
    similarity of 0.4 or so) and serve to find groups; within a group every pair that can be as similar is verified on its shingle sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = cut(docs.mapInArrow(_sketch, "doc_id long, node string, n long, " + ", ".join(f"{c} long" for c in _PRINTS + _BANDS)))
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", *_PRINTS, *_BANDS)]))
    bands = [F.xxhash64(F.lit(b), F.col(c)) for b, c in enumerate(_BANDS)]
    loose = components(hamming_links(nodes.select("node", *_PRINTS, *_BANDS), _PRINTS, NEAR_RADIUS, bands))
    return rows.select("doc_id", "node"), components(verified_links(docs, nodes, loose, similarity))


def drop_near_duplicates(docs: DataFrame, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """One row of each group stays, the one with the smallest doc_id (ties: smallest MD5, then any of equal rows); columns as they are.

    Null and empty texts and texts of blanks are one group. Texts of fewer than five words are one shingle. Rows without a doc_id go only if
    a row with one, or another like them, is in their group. Rows that repeat doc_id and text stay once. Columns of any name are kept as they are;
    an empty table gives no rows. Texts are judged whole.

    Only rows that may have to go are moved: the others are told by a filter of the doc_ids of those that go.
    """
    rows, roots = near_groups(docs, similarity)
    grouped = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("node").alias("node"))
    best = grouped.groupBy("root").agg(F.min(rank).alias("_r")).select("root", F.col("_r.d").alias("_d"), F.col("_r.node").alias("_best"))
    told = grouped.groupBy("root", "node", "doc_id").agg(F.count(F.lit(1)).alias("_times")).join(best, "root")
    told = cut(told.withColumn("_stays", (F.col("node") == F.col("_best")) & F.col("doc_id").eqNullSafe(F.col("_d"))).filter(~F.col("_stays") | (F.col("_times") > 1) | F.col("doc_id").isNull()).select("doc_id", "node", "_stays"))
    return _without(docs, told)


def _without(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``told(doc_id, node, _stays)`` names and says not to stay; of those that stay one each."""
    maybe, key, row = (free_name(c, docs.columns) for c in ("_maybe", "_key", "_row"))
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(told.select("doc_id"), bloom_bits(told.count())))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            had = bloom_has(sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(had)], names=[*batch.schema.names[:-1], maybe])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{maybe}` boolean"])
    judged = docs.withColumn(key, F.col("doc_id").cast("long")).mapInArrow(judge, schema)
    sure = judged.filter(~F.col(maybe)).drop(maybe)
    packed = judged.filter(F.col(maybe)).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    packed = packed.select(row, F.col(f"{row}.doc_id").cast("long").alias("_id"), F.md5(F.coalesce(F.col(f"{row}.text"), F.lit(""))).alias("_md5"))
    joined = packed.join(told.toDF("_told_id", "_told_node", "_stays"), F.col("_id").eqNullSafe(F.col("_told_id")) & (F.col("_md5") == F.col("_told_node")), "left").filter(F.col("_stays").isNull() | F.col("_stays"))
    once = joined.withColumn("_once", F.when(F.col("_stays").isNull(), F.monotonically_increasing_id()))
    return sure.unionByName(once.dropDuplicates(["_id", "_md5", "_once"]).select(f"{row}.*"))
