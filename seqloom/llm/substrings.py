"""Substring dedup with a log-structured index of window fingerprints.

A window is 13 consecutive words. Its fingerprint is the best of the eleven 3-word grams inside it (the most letters, whatever stands between the
words; ties by hash), so neighbouring windows mostly share one and equal windows always do. The index holds sorted immutable runs of (fingerprint, smallest
and largest document that has it, number of documents), bucketed by fingerprint: a new batch becomes a run and is merge-joined with the runs of
history without any shuffle. Runs of a like size are compacted into one of the next level before the batch that finds too many of them. An index may
stay in its folder and be opened again for the next batch. Fingerprints that two documents have are the candidates.

They are then verified: the windows under a candidate fingerprint are digested (96 bits over the words themselves), and a window counts as
repeated if its digest's first document is smaller than its own. Texts are read once for that, with a Bloom filter of candidates in hand that lets only
a few others pass, which match nothing; ``MOST_SHARED`` candidates fill a filter, more take a pass each, and where passes would be too many, occurrences and
texts are joined to the candidates instead. Digests under a fingerprint of very many documents are salted: a row above the least of its salt
is repeated whatever the other salts have, so only the least rows meet again. Documents of equal words need no windows: all but the first of them go as a whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import batch_slices, bloom_bits, bloom_has, bloom_of, checkpoint_dir, cut, maybe_in, mix, parallelism, table, text_buffer, text_or_empty, windows, word_hashes, words_of

WINDOW, GRAM = 13, 3
#: Batches in which a whole table enters the index, and the number of runs of one level that are compacted into one.
BATCHES, FANOUT = 3, 4
#: Candidates that a filter is used for (2^29 bits, 64 MB, at most), and passes over the texts with a filter each.
FILTER_BITS, MOST_SHARED, MOST_PASSES = 1 << 29, 1 << 27, 4
#: Documents from which on a fingerprint is hot, the most hot fingerprints, and the salts of their digests.
HOT_DOCS, MOST_HOT, SALTS = 2048, 1 << 18, 64
#: Most copies of whole documents that are sent to the tasks; beyond, copies are treated like any other document.
MOST_COPIES = 1 << 21
_SLICE = 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def fingerprints(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of the window that starts at each word, as long as there are enough words after it."""
    grams = windows(word_hashes(raw, starts, ends), gram)
    n = len(starts) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    lengths = np.r_[0, np.cumsum(ends - starts)]
    letters = np.minimum(lengths[gram:] - lengths[: len(grams)], 63).astype(np.uint64)
    best = ((np.uint64(63) - letters) << np.uint64(58)) | (grams >> np.uint64(6))
    wide, span = window - gram + 1, 1
    while 2 * span <= wide:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    return np.minimum(best[:n], best[wide - span : wide - span + n]) if wide > span else best[:n]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        texts = batch.column("text")
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi in batch_slices(sizes, _SLICE):
            raw, at = text_buffer(texts.slice(lo, hi - lo))
            starts, ends, first = words_of(raw, at)
            prints = fingerprints(raw, starts, ends)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))[: len(prints)]
            whole = np.arange(len(prints)) + WINDOW <= first[1:][doc] if len(prints) else np.zeros(0, bool)
            prints, doc = prints[whole], doc[whole]
            new = np.r_[True, (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])][: len(prints)]
            yield pa.RecordBatch.from_pydict({"h": pa.array(prints[new].view(np.int64), pa.int64()), "doc_id": pa.array(ids[lo:hi][doc[new]], pa.int64())})


def occurrences(docs: DataFrame) -> DataFrame:
    """h, doc_id: the fingerprints of all windows of ``docs(doc_id, text)``; neighbours that share one give one row."""
    return docs.filter("doc_id IS NOT NULL").mapInArrow(_occurrences, "h long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs of (h, lo, hi, n), each a bucketed table in a folder; those of one level are about as large.

    Without a ``root`` the index lives under the shared folder until ``drop``; with one, the runs there are opened again, and stay.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, root: str | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, parallelism(spark)
        self.root = root or f"{checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []
        folder = self._path("")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(folder) if root and files.exists(folder) else []:
            found = re.fullmatch(r"fingerprints_(\d+)_(\d+)_[0-9a-f]{32}", name := status.getPath().getName())
            if found and files.exists(self._path(f"{name}/_SUCCESS")):
                self.runs.append((int(found[1]), name))
                self.buckets = int(found[2])
                if not spark.catalog.tableExists(name):
                    spark.sql(f"CREATE TABLE {name} (h BIGINT, lo BIGINT, hi BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {found[2]} BUCKETS LOCATION '{self.root}/{name}'")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str]:
        name = f"fingerprints_{level}_{self.buckets}_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", f"{self.root}/{name}").option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return level, name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self._path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, docs: DataFrame) -> DataFrame:
        """Enter a batch; returns h, n: the fingerprints that it has in two documents, or shares with a document of history, and in how many."""
        self.compact()
        rows = occurrences(docs).groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
        new = self._write(rows, 0)
        mine = self.spark.table(new[1])
        found = mine.filter("lo < hi").select("h", "n")
        for _, run in self.runs:
            old = self.spark.table(run).toDF("h", "_lo", "_hi", "_n")
            found = found.unionByName(mine.hint("merge").join(old, "h").filter("least(lo, _lo) < greatest(hi, _hi)").select("h", F.expr("n + _n").alias("n")))
        self.runs.append(new)
        return cut(found.groupBy("h").agg(F.sum("n").alias("n")))

    def compact(self) -> None:
        """Merge ``fanout`` runs of one level into one of the next, as often as there are so many; they are sorted and bucketed alike, so nothing is shuffled."""
        level = 0
        while any(v >= level for v, _ in self.runs):
            if sum(v == level for v, _ in self.runs) >= max(self.fanout, 2):
                self._merge(level)
            else:
                level += 1

    def _merge(self, level: int) -> None:
        some = [name for v, name in self.runs if v == level][: self.fanout]
        merged = self.spark.table(some[0])
        for name in some[1:]:
            other = self.spark.table(name).toDF("h", "_lo", "_hi", "_n")
            merged = merged.hint("merge").join(other, "h", "full_outer").select("h", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"), F.expr("coalesce(n, 0) + coalesce(_n, 0)").alias("n"))
        self.runs = [r for r in self.runs if r[1] not in some] + [self._write(merged, level + 1)]
        for name in some:
            self._drop(name)

    def drop(self) -> None:
        for _, run in self.runs:
            self._drop(run)
        self.runs = []


def _normal(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha = [], []
        for text in batch.column("text").to_pylist():
            words = _normal(text)
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "cid": batch.column("cid"), "n_words": pa.array(n, pa.int64()), "sha": pa.array(sha, pa.string())})


_WINDOW_SCHEMA = "d1 long, d2 int, salt int, doc_id long, cid long, pos int"


def _window_rows(batch: pa.RecordBatch, chosen, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Digests of the windows whose fingerprints ``chosen(prints, rows)`` picks, salted under ``hot`` ones (sorted)."""
    texts = batch.column("text")
    ids, cids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "cid"))
    for lo, hi in batch_slices(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), _SLICE):
        raw, at = text_buffer(texts.slice(lo, hi - lo))
        starts, ends, first = words_of(raw, at)
        prints = fingerprints(raw, starts, ends)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))[: len(prints)]
        if not len(prints):
            continue
        some = np.flatnonzero(np.arange(len(prints)) + WINDOW <= first[1:][doc])
        some = some[chosen(prints[some], lo + doc[some])]
        if not len(some):
            continue
        words = word_hashes(raw, starts, ends)
        d1, d2 = windows(words, WINDOW)[some], windows(mix(words + np.uint64(1)), WINDOW)[some]
        where = np.searchsorted(hot, prints[some])
        heat = np.zeros(len(some), bool)
        heat[where < len(hot)] = hot[where[where < len(hot)]] == prints[some[where < len(hot)]]
        owner = lo + doc[some]
        salt = np.where(heat, mix(ids[owner].astype(np.int64).view(np.uint64)) % np.uint64(SALTS) + np.uint64(1), np.uint64(0)).astype(np.int32)
        columns = {"d1": d1.view(np.int64), "d2": (d2 >> np.uint64(32)).astype(np.uint32).view(np.int32), "salt": salt, "doc_id": ids[owner].astype(np.int64), "cid": cids[owner].astype(np.int64), "pos": (some - first[doc[some]]).astype(np.int32)}
        yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})


def _joined_windows(sent_hot):
    """Windows of texts that come with ``hs``, their candidate fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                wanted = batch.column("hs")[i].values.to_numpy().view(np.uint64)
                yield from _window_rows(batch.slice(i, 1), lambda prints, _, w=wanted: np.isin(prints, w), sent_hot.value)

    return run


def _filtered_windows(sent, sent_hot, part: int, parts: int):
    """Windows whose fingerprints are in the filter sent; of several passes each takes the fingerprints of its own part."""

    def chosen(prints: np.ndarray, _: np.ndarray) -> np.ndarray:
        hit = bloom_has(sent.value, prints.view(np.int64))
        return hit if parts == 1 else hit & (mix(prints) % np.uint64(parts) == np.uint64(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _window_rows(batch, chosen, sent_hot.value)

    return run


def _of_part(part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(mix(batch.column("h").to_numpy().view(np.uint64)) % np.uint64(parts) == np.uint64(part)))

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "cid": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for doc_id, text, cid, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cid", "places")), strict=True):
            words = _normal(text)
            cover = np.zeros(len(words) + 1, dtype=np.int64)
            at = np.asarray(places)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            for c, v in zip(out, (doc_id, cid, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c.startswith("kept") else pa.int64()) for c, v in out.items()})


def repeated_windows(docs: DataFrame, candidates: DataFrame, most_shared: int = MOST_SHARED, most_passes: int = MOST_PASSES, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, cid, places of the windows of ``docs(doc_id, cid, text)`` that start in a smaller document, from ``candidates(h, n)``."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", "cid", "text")
    many, everywhere = candidates.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(hot_docs, everywhere // MOST_HOT)  # so there are MOST_HOT at most
    hot = np.sort(candidates.filter(F.col("n") > least).select("h").toArrow().column("h").to_numpy().view(np.uint64))
    sent_hot = spark.sparkContext.broadcast(hot)
    parts = max(1, -(-many // most_shared))
    if parts <= most_passes:
        found = None
        for part in range(parts):
            mine = candidates.select("h") if parts == 1 else candidates.select("h").mapInArrow(_of_part(part, parts), "h long")
            sent = spark.sparkContext.broadcast(bloom_of(mine, min(FILTER_BITS, bloom_bits(many // parts, FILTER_BITS))))
            rows = docs.mapInArrow(_filtered_windows(sent, sent_hot, part, parts), _WINDOW_SCHEMA)
            found = _open_places(rows) if found is None else found.unionByName(_open_places(rows))
    else:
        touched = cut(occurrences(docs).join(candidates.select("h"), "h").groupBy("doc_id").agg(F.collect_set("h").alias("hs")))
        texts = maybe_in(docs, "doc_id", bloom_of(touched.select("doc_id"), bloom_bits(touched.count())))
        found = _open_places(texts.join(touched, "doc_id").mapInArrow(_joined_windows(sent_hot), _WINDOW_SCHEMA))
    if not len(hot):
        return found.groupBy("doc_id", "cid").agg(F.flatten(F.collect_list("places")).alias("places")).filter(F.size("places") > 0)
    found = cut(found)
    open_ = found.select("doc_id", "cid", F.explode("open").alias("_o")).select("doc_id", "cid", "_o.*")
    again = open_.withColumn("_first", F.min("doc_id").over(Window.partitionBy("d1", "d2"))).filter("doc_id > _first").groupBy("doc_id", "cid").agg(F.collect_list("pos").alias("places"))
    both = found.select("doc_id", "cid", "places").unionByName(again)
    return both.groupBy("doc_id", "cid").agg(F.flatten(F.collect_list("places")).alias("places")).filter(F.size("places") > 0)


def _open_places(rows: DataFrame) -> DataFrame:
    """doc_id, cid, places of windows above the least document of their digest and salt; and of salted windows that are the least, d1, d2 and pos in ``open``."""
    judged = rows.withColumn("_first", F.min("doc_id").over(Window.partitionBy("d1", "d2", "salt"))).filter("doc_id > _first OR salt > 0")
    gone = F.col("doc_id") > F.col("_first")
    return judged.groupBy("doc_id", "cid").agg(F.collect_list(F.when(gone, F.col("pos"))).alias("places"), F.collect_list(F.when(~gone, F.struct("d1", "d2", "pos"))).alias("open"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, most_shared: int = MOST_SHARED, most_passes: int = MOST_PASSES, hot_docs: int = HOT_DOCS, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs(doc_id, text)``; windows are judged on the input.

    Null and empty texts have no words, texts of under 13 no windows. Rows without a doc_id are smaller than none and keep all. Rows with one
    doc_id are one document as to what is smaller; rows equal in both keep the same. No rows give none; other columns are not read.

    With an ``index`` of the documents of ``history``, the rows of ``docs`` enter it and are judged against those of history too, as far as they have a smaller doc_id.
    """
    spark = docs.sparkSession
    own_index, index = index is None, index or FingerprintIndex(spark)
    try:
        new = docs.select("doc_id", "text", F.xxhash64("text").alias("cid"))
        whole = new if history is None else new.unionByName(history.select("doc_id", "text", F.xxhash64("text").alias("cid")))
        facts = cut(whole.mapInArrow(_facts, "doc_id long, cid long, n_words long, sha string"))
        first = facts.filter("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("_first"))
        copies = cut(facts.join(first, "sha").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") > F.col("_first")).alias("_all")).filter("_all").select("doc_id"))
        few = copies.count() <= MOST_COPIES
        without = lambda df: df.join(F.broadcast(copies), "doc_id", "left_anti") if few else df
        lo, hi = facts.agg(F.min("doc_id"), F.max("doc_id")).first()
        asked = facts if history is None else cut(new.mapInArrow(_facts, "doc_id long, cid long, n_words long, sha string"))
        if lo is None:
            return asked.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
        edges = [lo + (hi + 1 - lo) * k // batches for k in range(batches + 1)]
        candidates = None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            found = index.add(without(new).filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
            candidates = found if candidates is None else candidates.unionByName(found)
        places = cut(repeated_windows(without(whole), cut(candidates.groupBy("h").agg(F.max("n").alias("n"))), most_shared, most_passes, hot_docs))
    finally:
        if own_index:
            index.drop()
    texts = maybe_in(without(new).filter("doc_id IS NOT NULL"), "doc_id", bloom_of(places.select("doc_id"), bloom_bits(places.count())))
    kept = texts.join(places, ["doc_id", "cid"]).mapInArrow(_kept, "doc_id long, cid long, n_removed long, kept_sha256 string, kept string")
    kept = kept.select("doc_id", "cid", "n_removed", "kept_sha256").distinct()
    ranked = asked.join(first, "sha", "left").join(kept, ["doc_id", "cid"], "left")
    copy = (F.col("doc_id") > F.col("_first")) & (F.col("n_words") >= WINDOW)
    return ranked.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op10_lsm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after removing the 13-word windows that smaller documents have. Odd rows are taken as ``remove_repeats`` says; other columns are not read."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return remove_repeats(docs)
