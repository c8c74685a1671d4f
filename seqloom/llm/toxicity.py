"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words, lower-cased, and their beginnings of 4 to 6 bytes, each hashed to 32 bits and counted once. The model adds a
weight per term and, for each pair of terms, the product of two short vectors, so it learns pairs that say more than their
parts, such as an insult next to the mention of a group.

It is fitted on at most ``FIT_ROWS`` labelled texts (half of each label where there are so many, chosen by a hash of doc_id):
first the terms that differ most between the labels, and those of pairs that say more than either term, are selected, then weights and vectors are learned on the driver. The model's size
is fixed by ``TERMS`` and ``RANK``; every text is then scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NOT_LETTERS, batch_slices, free_name, mix, set_aside, table, text_buffer, word_hashes, words_of

FIT_ROWS = 6000
TERMS, RANK = 2048, 4
EPOCHS, STEPS, BATCH, RATE, DECAY = 30, 3000, 64, 0.1, 1e-5
#: Most that a toxic text weighs against another in the fit, where there are fewer of them.
MOST_WEIGHT = 9.0
#: Least log-likelihood ratio of a term (a chi-square of one degree, over some 100,000 terms), and how much of it a pair must have beyond its terms.
LEAST_RATIO, LEAST_PAIR = 12.0, 30.0
#: Terms of which all pairs are tried, the most frequent ones; pairs that are kept; least texts of a term.
PAIR_TERMS, PAIRS, PAIR_TEXTS = 1024, 256, 5
#: Least texts of any term.
LEAST_TEXTS = 2
BEGINNINGS = (4, 5, 6)
_SLICE = 1 << 20
_FILTER_BITS = 20


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and 32-bit terms, repeats included."""
    raw, at = text_buffer(texts, lower=True)
    starts, ends, first = words_of(raw, at, NOT_LETTERS)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    docs, terms = [doc], [word_hashes(raw, starts, ends)]
    for n in BEGINNINGS:
        long = ends - starts >= n
        docs.append(doc[long])
        terms.append(mix(word_hashes(raw, starts[long], starts[long] + n) ^ np.uint64(n)))
    return np.concatenate(docs), (np.concatenate(terms) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Machine:
    """Selected terms (sorted), bias, weights and vectors."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """``doc`` in order; ``term``: places among the selected terms, each once a text."""
        out = np.full(n, self.bias)
        np.add.at(out, doc, self.weights[term])
        v = self.vectors[term]
        sums = np.zeros((n, self.vectors.shape[1]))
        np.add.at(sums, doc, v)
        out += 0.5 * (sums**2).sum(axis=1)
        np.add.at(out, doc, -0.5 * (v**2).sum(axis=1))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        low = np.zeros(1 << _FILTER_BITS, dtype=bool)
        low[self.terms & ((1 << _FILTER_BITS) - 1)] = True
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        out = []
        for lo, hi in batch_slices(sizes, _SLICE):
            doc, term = terms_of(texts.slice(lo, hi - lo))
            some = low[term & ((1 << _FILTER_BITS) - 1)]
            doc, term = doc[some], term[some]
            at = np.searchsorted(self.terms, term)
            known = at < len(self.terms)
            known[known] = self.terms[at[known]] == term[known]
            pair = np.unique(doc[known] * np.int64(len(self.terms) + 1) + at[known])
            out.append(self.logits(pair // (len(self.terms) + 1), pair % (len(self.terms) + 1), hi - lo))
        logits = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


def _ratios(one: np.ndarray, with_: np.ndarray, n: float, ones: float) -> np.ndarray:
    """Log-likelihood ratio of the label for features that ``with_`` of n texts have, ``one`` of them labelled 1."""
    g = np.zeros(one.shape)
    for seen, here, all_here in ((one, with_, ones), (with_ - one, with_, n - ones), (ones - one, n - with_, ones), (n - ones - with_ + one, n - with_, n - ones)):
        g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(here * all_here / n, 1e-9)), 0)
    return g


def select_terms(doc: np.ndarray, term: np.ndarray, label: np.ndarray, most: int = TERMS) -> np.ndarray:
    """The terms of the ``PAIRS`` pairs that together tell most beyond what each of their terms does, then those that tell most of the label by
    themselves, by the log-likelihood ratio of their counts; ties by number."""
    known, texts = np.unique(term, return_counts=True)
    known = known[texts >= LEAST_TEXTS]
    inside = np.flatnonzero(np.isin(term, known)).astype(np.int32)
    doc, place = doc[inside], np.searchsorted(known, term[inside]).astype(np.int32)
    with_ = np.bincount(place, minlength=len(known)).astype(float)
    one = np.bincount(place, weights=label[doc], minlength=len(known))
    n, ones = float(len(label)), label.sum()
    g = _ratios(one, with_, n, ones)
    paired = _paired_terms(doc, place, label, with_, g)
    fit = np.flatnonzero(g >= LEAST_RATIO)
    ranked = np.concatenate([paired, fit[np.lexsort((known[fit], -g[fit]))]])
    _, first = np.unique(ranked, return_index=True)
    return np.sort(known[ranked[np.sort(first)][:most]])


def _paired_terms(doc: np.ndarray, place: np.ndarray, label: np.ndarray, with_: np.ndarray, g: np.ndarray) -> np.ndarray:
    some = np.flatnonzero((with_ >= PAIR_TEXTS) & (with_ < len(label)))
    some = np.sort(some[np.argsort(-with_[some], kind="stable")][:PAIR_TERMS])
    column = np.full(len(with_), -1, dtype=np.int32)
    column[some] = np.arange(len(some))
    inside = np.flatnonzero(column[place] >= 0)
    has = np.zeros((len(label), len(some)), dtype=np.float32)
    has[doc[inside], column[place[inside]]] = 1
    both, one = has.T @ has, (has * label[:, None].astype(np.float32)).T @ has
    gain = _ratios(one.astype(float), both.astype(float), float(len(label)), label.sum()) - np.maximum(g[some][:, None], g[some][None, :])
    i, j = np.nonzero(np.triu((gain >= LEAST_PAIR) & (both >= PAIR_TEXTS), 1))
    best = np.lexsort((j, i, -gain[i, j]))[:PAIRS]
    pairs = np.stack([some[i[best]], some[j[best]]], axis=1).reshape(-1)
    return pairs[np.sort(np.unique(pairs, return_index=True)[1])]


def fit_machine(doc: np.ndarray, term: np.ndarray, label: np.ndarray, seed: int = 7) -> Machine:
    """``doc``, ``term``: the terms of each text, each once; ``label``: 0 or 1 by text."""
    n, ones = len(label), float(label.sum())
    none = np.zeros(0, np.uint32)
    if n == 0 or ones in (0, n):
        return Machine(none, -6.0 if ones == 0 else 6.0, np.zeros(0), np.zeros((0, RANK)))
    terms = select_terms(doc, term, label)
    inside = np.isin(term, terms)
    doc, place = doc[inside], np.searchsorted(terms, term[inside])
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order]
    starts = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    weigh = np.where(label > 0, min(max((n - ones) / ones, 1.0), MOST_WEIGHT), 1.0)
    m = Machine(terms, float(np.log(ones / (n - ones))), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), RANK)))
    g_bias, g_w, g_v = 1e-6, np.full(len(terms), 1e-6), np.full((len(terms), RANK), 1e-6)
    batches = max(1, n // BATCH)
    for _ in range(max(EPOCHS, STEPS // batches)):
        for rows in np.array_split(rng.permutation(n), batches):
            sizes = starts[rows + 1] - starts[rows]
            row = np.repeat(np.arange(len(rows)), sizes)
            at = place[np.repeat(starts[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
            v = m.vectors[at]
            sums = np.zeros((len(rows), RANK))
            np.add.at(sums, row, v)
            error = (1 / (1 + np.exp(-np.clip(m.logits(row, at, len(rows)), -40, 40))) - label[rows]) * weigh[rows] / len(rows)
            used, where = np.unique(at, return_inverse=True)
            dw = np.bincount(where, weights=error[row], minlength=len(used)) + DECAY * m.weights[used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, where, error[row][:, None] * (sums[row] - v))
            dv += DECAY * m.vectors[used]
            db = error.sum()
            g_bias += db**2
            g_w[used] += dw**2
            g_v[used] += dv**2
            m.bias -= RATE * db / np.sqrt(g_bias)
            m.weights[used] -= RATE * dw / np.sqrt(g_w[used])
            m.vectors[used] -= RATE * 0.2 * dv / np.sqrt(g_v[used])
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _unique_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for i in range(batch.num_rows):
            _, term = terms_of(texts.slice(i, 1))
            yield pa.RecordBatch.from_pydict({"label": batch.column("label").slice(i, 1), "terms": pa.array([np.unique(term).view(np.int32)], pa.list_(pa.int32()))})


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most ``rows`` of the labelled documents that aren't held out.

    A doc_id with several labels counts as toxic if one says so; null ids and labels other than 0 and 1 don't count. Without both
    labels the machine says what there is: with no toxic row, no text is.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    of = lambda label: known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
    chosen = of(0).unionByName(of(1))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("label").cast("int").alias("label"), "text")
    got = texts.mapInArrow(_unique_terms, "label int, terms array<int>").toArrow()
    label = got.column("label").to_numpy().astype(np.float64)
    terms = got.column("terms").combine_chunks()
    terms = terms if isinstance(terms, pa.Array) else pa.concat_arrays(terms.chunks)
    sizes = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False) if len(terms) else np.zeros(0, np.int64)
    doc, term = np.repeat(np.arange(len(label), dtype=np.int32), sizes), terms.flatten().to_numpy().view(np.uint32) if len(terms) else np.zeros(0, np.uint32)
    del got, terms
    order = _steady(label, doc, term)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    return fit_machine(place[doc], term, label[order])


def _steady(label: np.ndarray, doc: np.ndarray, term: np.ndarray) -> np.ndarray:
    """An order of the texts by what they hold, as rows arrive in any order and the fit follows the order."""
    key = np.zeros(len(label), dtype=np.uint64)
    for at in range(0, len(doc), 1 << 20):
        np.add.at(key, doc[at : at + (1 << 20)], mix(term[at : at + (1 << 20)].astype(np.uint64)))
    return np.lexsort((key, label))


def score_texts(docs: DataFrame, machine: Machine, out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of its whole ``text``; null and empty texts get that of a text without known terms. Repeated rows are scored
    each; no rows give none. A column that is called like ``out`` already is kept as ``<out>_input``."""
    docs = set_aside(docs, out)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def reject_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows whose text scores below 0.5, or no higher than a text without known terms, as they are, with columns of any name."""
    least, name = float(machine.scores(pa.array([""]))[0]), free_name("_toxicity", docs.columns)
    return score_texts(docs, machine, name).filter((F.col(name) < 0.5) | (F.col(name) <= least)).drop(name)


def op9_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document by a machine that has seen no held-out label.

    Null and empty texts get the score of a text without known terms; rows without a doc_id are scored and not held out, and their labels don't count;
    repeated rows are scored each, and repeated labels count once; very long texts are scored whole; without documents there are no rows,
    without labels all score the same. Other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score_texts(docs, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
