"""Benchmark decontamination on templates, so that re-parameterised questions are caught too.

Words are canonicalised: lower-cased and stripped of punctuation at their ends; numbers become ``<num>``, names (capitalised words that don't begin a
sentence, or words that are all capitals) ``<name>``, units after a number ``<unit>``. Windows of 13 canonical words of the items and of every
text are joined by hash. A hit is then laid out along its diagonal (text position minus item position): the item's longest run of
consecutive windows there must be consistent in its slots, that is, equal fillers of the item stay equal in the text and different ones
different; of a run that isn't, only its verbatim windows count. A passage whose every slot was refilled consistently is a re-parameterised question.
Template windows of slots mostly say nothing and don't count: half of a window's words at least must be literal. Beside them all windows
are joined as they read in lower case, whatever their words are, so a verbatim passage is found in any letter case.

An item shorter than a window is one window of its own length, found as it reads; below ``SHORTEST`` words it says nothing.

An index of up to ``BLOCK_WINDOWS`` item windows goes to the tasks, and texts are judged where they stand. A larger benchmark is a table of windows: a Bloom
filter of their hashes lets few windows of the texts pass, and these are hash-joined to it. Texts are never shuffled, only hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_slices, bloom_bits, bloom_has, bloom_of, cut, free_name, mix, table, text_buffer, text_or_empty, windows, word_hashes, words_of

WINDOW = 13
LEAST_LITERALS = 7
#: Words of the shortest item that is looked for.
SHORTEST = 8
#: Item windows that are sent to the tasks as an index; more are joined as a table.
BLOCK_WINDOWS = 1 << 20
_SLICE = 1 << 20
#: Units that stand for ``<unit>`` after a number (fixed values).
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "min", "h", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "miles", "mile", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "%", "$", "km/h", "mph", "kwh", "w", "kw", "v")

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_TRIM = np.zeros(256, bool)
_TRIM[:128] = [not chr(c).isalnum() and chr(c) not in "%$" for c in range(128)]
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (11, 12, 13))
LITERAL, NUM, NAME, UNIT = range(4)


def _trimmed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the marks at their ends; of a word of marks one is left."""
    lo, hi = starts.copy(), ends.copy()
    some = np.arange(len(lo))
    while len(some):
        left = (hi[some] - lo[some] > 1) & _TRIM[raw[lo[some]]]
        lo[some] += left
        right = (hi[some] - lo[some] > 1) & _TRIM[raw[hi[some] - 1]]
        hi[some] -= right
        some = some[left | right]
    return lo, hi


def lower_case(texts: pa.Array) -> pa.Array:
    """Texts in lower case, also beyond ASCII; a sharp s is ss, as it is in capitals. The words stay as many."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    try:
        return pa.compute.replace_substring(pa.compute.utf8_lower(texts), "ß", "ss")
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        return pa.array([t.decode("utf-8", "replace").lower().replace("ß", "ss") for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def literals(texts: pa.Array) -> np.ndarray:
    """Literal hash of each word: lower-cased, without marks at its ends."""
    raw, at = text_buffer(lower_case(texts))
    starts, ends, _ = words_of(raw, at)
    return word_hashes(raw, *_trimmed(raw, starts, ends))


def canonical(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, literal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical hash and kind of each word."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8)
    lo, hi = _trimmed(raw, starts, ends)
    digits = np.r_[0, np.cumsum(_DIGIT[raw])]
    capitals = np.r_[0, np.cumsum(_UPPER[raw])]
    n_digits, n_capitals = digits[hi] - digits[lo], capitals[hi] - capitals[lo]
    begins = np.r_[True, _STOP[raw[ends[:-1] - 1]]]
    begins[first[:-1][first[:-1] < n]] = True
    begins[1:] |= _newline_between(raw, starts, ends)
    kind = np.zeros(n, dtype=np.int8)
    kind[(_UPPER[raw[lo]] & ~begins) | ((n_capitals == hi - lo) & (n_capitals > 1))] = NAME
    kind[n_digits * 2 >= np.maximum(hi - lo, 1)] = NUM
    after = np.r_[False, kind[:-1] == NUM]
    after[first[:-1][first[:-1] < n]] = False
    kind[after & np.isin(literal, _unit_hashes())] = UNIT
    out = literal.copy()
    for k, h in ((NUM, _NUM), (NAME, _NAME), (UNIT, _UNIT)):
        out[kind == k] = h
    return out, kind


def _newline_between(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lines = np.r_[0, np.cumsum(raw == 10)]
    return lines[starts[1:]] > lines[ends[:-1]]


_UNIT_HASHES: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _UNIT_HASHES:
        raw, at = text_buffer(pa.array([" ".join(UNITS)]))
        starts, ends, _ = words_of(raw, at)
        _UNIT_HASHES.append(word_hashes(raw, starts, ends))
    return _UNIT_HASHES[0]


def text_windows(texts: pa.Array, window: int = WINDOW) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Of the template windows that count, then of all windows as they read: text number, start (word number within the text), hash; after
    these, literal hashes and kinds of all words and the first word of each text."""
    raw, at = text_buffer(texts)
    starts, ends, first = words_of(raw, at)
    literal = literals(texts)
    canon, kind = canonical(raw, starts, ends, first, literal)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))[: max(len(canon) - window + 1, 0)]
    whole = np.arange(len(doc)) + window <= first[1:][doc] if len(doc) else np.zeros(0, bool)
    n_literals = np.r_[0, np.cumsum(kind == LITERAL)]
    counts = whole & (n_literals[window : window + len(doc)] - n_literals[: len(doc)] >= LEAST_LITERALS)
    found = []
    for words, fit in ((canon, counts), (literal, whole)):
        where = np.flatnonzero(fit)
        found.append((doc[where], where - first[doc[where]], windows(words, window)[where]))
    return found, literal, kind, first


def consistent(item_literal: np.ndarray, text_literal: np.ndarray, kind: np.ndarray) -> bool:
    """Whether the slots' fillers map one to one, each kind for itself (a unit or number may stand for itself)."""
    for k in (NUM, NAME, UNIT):
        a, b = item_literal[kind == k], text_literal[kind == k]
        pairs = len(set(zip(a.tolist(), b.tolist(), strict=True)))
        if pairs != len(set(a.tolist())) or pairs != len(set(b.tolist())):
            return False
    return True


class WindowIndex:
    """Sorted windows of items."""

    def __init__(self, item: np.ndarray, pos: np.ndarray, h: np.ndarray, window: int):
        self.window, order = window, np.lexsort((pos, item, h))
        self.h, self.item, self.pos = h[order], item[order], pos[order]
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def runs(self, doc: np.ndarray, pos: np.ndarray, h: np.ndarray) -> Iterator[tuple[tuple[int, int, int], int, int]]:
        """Of each run of windows along a diagonal: (text, item, shift), first word in the item, words."""
        some = np.flatnonzero(self.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.h, h[some], "left"), np.searchsorted(self.h, h[some], "right")
        diagonals: dict[tuple[int, int, int], list[int]] = {}
        for i in np.flatnonzero(hi > lo).tolist():
            w = some[i]
            for j in range(lo[i], hi[i]):
                diagonals.setdefault((int(doc[w]), int(self.item[j]), int(pos[w] - self.pos[j])), []).append(int(self.pos[j]))
        for diagonal, places in diagonals.items():
            at = np.unique(places)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                yield diagonal, int(run[0]), int(run[-1] - run[0]) + self.window


class ItemIndex:
    """Windows of items, as templates and as they read, and the items' words for the check of the slots; of items shorter than a window the whole."""

    def __init__(self, ids: list[int], texts: list[str], window: int = WINDOW):
        self.ids, self.window = np.asarray(ids, dtype=np.int64), window
        found, self.literal, self.kind, self.first = text_windows(pa.array(texts, pa.string()), window)
        self.templates, self.verbatim = (WindowIndex(*f, window) for f in found)
        sizes = np.diff(self.first)
        self.short = []
        for n in range(SHORTEST, window):
            items = np.flatnonzero(sizes == n)
            if len(items):
                self.short.append(WindowIndex(items, np.zeros(len(items), np.int64), windows(self.literal, n)[self.first[items]], n))

    def _verbatim(self, literal: np.ndarray, first: np.ndarray, verbatim: tuple) -> Iterator[tuple[tuple[int, int, int], int, int]]:
        yield from self.verbatim.runs(*verbatim)
        for index in self.short:
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: max(len(literal) - index.window + 1, 0)]
            where = np.flatnonzero(np.arange(len(doc)) + index.window <= first[1:][doc]) if len(doc) else np.zeros(0, np.int64)
            yield from index.runs(doc[where], where - first[doc[where]], windows(literal, index.window)[where])

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, bool]]:
        """Text number, item_id, first word in the text, first word in the item, words, verbatim: of each verbatim or consistent run; runs
        inside another of their diagonal don't count."""
        (templates, verbatim), literal, kind, first = text_windows(texts, self.window)
        runs: dict[tuple[int, int, int], list[tuple[int, int, bool]]] = {}
        for (d, item, shift), a, n in self._verbatim(literal, first, verbatim):
            mine, theirs = self.first[item] + a, first[d] + a + shift
            if np.array_equal(self.literal[mine : mine + n], literal[theirs : theirs + n]):
                runs.setdefault((d, item, shift), []).append((a, a + n, True))
        for (d, item, shift), a, n in self.templates.runs(*templates):
            mine = slice(self.first[item] + a, self.first[item] + a + n)
            theirs = slice(first[d] + a + shift, first[d] + a + shift + n)
            if np.array_equal(self.kind[mine], kind[theirs]) and consistent(self.literal[mine], literal[theirs], self.kind[mine]):
                runs.setdefault((d, item, shift), []).append((a, a + n, False))
        for (d, item, shift), found in runs.items():
            for a, b, same in outermost(found):
                yield d, int(self.ids[item]), a + shift, a, b - a, same


def outermost(found: list[tuple[int, int, bool]]) -> Iterator[tuple[int, int, bool]]:
    """The runs of one diagonal that lie in no other, verbatim ones first."""
    end = -1
    for a, b, same in sorted(found, key=lambda r: (r[0], -r[1], not r[2])):
        if b > end:
            yield a, b, same
            end = b


def _find(index):
    names = ("doc_id", "item_id", "doc_word", "item_word", "n_words", "verbatim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in batch_slices(sizes, _SLICE):
                rows = [(ids[lo + d], *rest) for d, *rest in index.value.hits(texts.slice(lo, hi - lo))]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.bool_() if c == "verbatim" else pa.int64()) for k, c in enumerate(names)})

    return run


_LEAKS = "doc_id long, item_id long, doc_word long, item_word long, n_words long, verbatim boolean"
_WINDOWS = "key string, doc_id long, kind int, h long, pos int, literals binary, kinds binary"


def _window_table(batches: Iterator[pa.RecordBatch], sent=None, lengths: tuple[int, ...] = (), whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of windows of ``key, doc_id, text``: kind 0 is a template, any other the words of a window as it reads. ``sent``: a filter of hashes. ``whole``: of texts
    shorter than a window the whole; else windows of the ``lengths`` that short items have."""
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in batch_slices(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), _SLICE >> 2):
            found, literal, kind, first = text_windows(texts.slice(lo, hi - lo))
            groups = [(0, WINDOW, *found[0]), (WINDOW, WINDOW, *found[1])]
            for n in range(SHORTEST, WINDOW) if whole else lengths:
                doc = np.repeat(np.arange(hi - lo), np.diff(first))[: max(len(literal) - n + 1, 0)]
                fit = (np.diff(first)[doc] == n) & (np.arange(len(doc)) == first[doc]) if whole else np.arange(len(doc)) + n <= first[1:][doc]
                where = np.flatnonzero(fit) if len(doc) else np.zeros(0, np.int64)
                groups.append((n, n, doc[where], where - first[doc[where]], windows(literal, n)[where]))
            for name, n, doc, pos, h in groups:
                h = mix(h ^ np.uint64(name))
                if sent is not None:
                    some = np.flatnonzero(bloom_has(sent.value, h.view(np.int64)))
                    doc, pos, h = doc[some], pos[some], h[some]
                if not len(h):
                    continue
                at = first[doc] + pos
                words = [literal[k : k + n].tobytes() for k in at.tolist()]
                kinds = [kind[k : k + n].tobytes() for k in at.tolist()]
                owner = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(owner), batch.column("doc_id").take(owner), pa.array(np.full(len(h), name, np.int32)), pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(words, pa.binary()), pa.array(kinds, pa.binary())],
                    names=["key", "doc_id", "kind", "h", "pos", "literals", "kinds"],
                )


def _runs_of_diagonal(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of one text, item and shift from its hits."""
    found = []
    for kind, rows in pdf.groupby("kind"):
        rows = rows.drop_duplicates("item_pos").sort_values("item_pos")
        size = int(kind) or WINDOW
        places = rows["item_pos"].to_numpy()
        for run in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > 1) + 1):
            mine, theirs, kinds, other = ([np.frombuffer(v, t) for v in rows[c].iloc[run]] for c, t in (("item_literals", np.uint64), ("literals", np.uint64), ("item_kinds", np.int8), ("kinds", np.int8)))
            joined = lambda parts: np.concatenate([parts[0], *[p[-1:] for p in parts[1:]]])
            a, b, k, o = joined(mine), joined(theirs), joined(kinds), joined(other)
            if np.array_equal(a, b) if kind else np.array_equal(k, o) and consistent(a, b, k):
                found.append((int(places[run[0]]), int(places[run[0]]) + len(run) - 1 + size, bool(kind)))
    first = pdf.iloc[0]
    rows = [(first["key"], first["doc_id"], first["item_id"], a + first["shift"], a, b - a, same) for a, b, same in outermost(found)]
    return pd.DataFrame(rows, columns=["key", "doc_id", "item_id", "doc_word", "item_word", "n_words", "verbatim"])


def joined_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``key`` and the columns of ``find_leaks``, by a hash join of the windows of ``docs(key, doc_id, text)`` and ``items(item_id, text)``."""
    known = items.select(F.lit("").alias("key"), F.col("item_id").alias("doc_id"), "text").mapInArrow(lambda b: _window_table(b, whole=True), _WINDOWS)
    known = cut(known.select(F.col("doc_id").alias("item_id"), "kind", "h", F.col("pos").alias("item_pos"), F.col("literals").alias("item_literals"), F.col("kinds").alias("item_kinds")))
    lengths = tuple(r["kind"] for r in known.filter((F.col("kind") > 0) & (F.col("kind") < WINDOW)).select("kind").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(known.select("h"), bloom_bits(known.count())))
    there = docs.mapInArrow(lambda b: _window_table(b, sent, lengths), _WINDOWS)
    hits = there.join(known, ["h", "kind"]).withColumn("shift", (F.col("pos") - F.col("item_pos")).cast("long"))
    return hits.groupBy("key", "doc_id", "item_id", "shift").applyInPandas(_runs_of_diagonal, "key string, " + _LEAKS)


def item_index(items: DataFrame, most: int | None = None) -> ItemIndex | None:
    """An index of all items, in the order of their ids, or none if they may have more windows than ``most``."""
    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]  # a window takes two characters at least
    if size > (BLOCK_WINDOWS if most is None else most):
        return None
    rows = rows.orderBy("item_id", "text").collect()
    return ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows])


def _known_items(items: DataFrame) -> DataFrame:
    return items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")


def find_leaks(docs: DataFrame, items: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, verbatim of each verbatim or consistent run of windows.

    Null items, items of under ``SHORTEST`` words, and null or short texts have no windows; very long texts are searched whole. Repeated items with one id count
    once, repeated rows each where the index is sent; rows without a doc_id count. Nothing on one side: no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    index = item_index(items, most)
    if index is not None:
        return docs.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(index)), _LEAKS)
    return joined_leaks(docs.select(F.md5("text").alias("key"), "doc_id", "text"), _known_items(items)).drop("key")


def drop_leaks(docs: DataFrame, items: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of ``docs`` without any leak, as they are, with columns of any name: each text is judged where it stands, so nothing is joined or moved; against more
    items than ``most`` texts are named by their digests."""
    index = item_index(items, most)
    if index is None:
        key, row = free_name("_md5", docs.columns), free_name("_row", docs.columns)
        leaks = joined_leaks(docs.select(F.md5(text_or_empty()).alias("key"), F.lit(0).cast("long").alias("doc_id"), text_or_empty().alias("text")), _known_items(items))
        packed = docs.select(F.struct("*").alias(row), F.md5(text_or_empty()).alias(key))
        return packed.join(leaks.select(F.col("key").alias("_leak")).distinct(), F.col(key) == F.col("_leak"), "left_anti").select(f"{row}.*")
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            leaks = np.zeros(batch.num_rows, bool)
            for lo, hi in batch_slices(sizes, _SLICE):
                leaks[[lo + d for d, *_ in sent.value.hits(texts.slice(lo, hi - lo))]] = True
            yield batch.filter(pa.array(~leaks))

    return docs.mapInArrow(keep, kinds)


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and item that it holds passages of: doc_id, item_id, runs, longest_run (words), verbatim (if any run is).

    Null, empty and short texts have none; odd rows are taken as ``find_leaks`` says.
    """
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("runs"), F.max("n_words").alias("longest_run"), F.max("verbatim").alias("verbatim"))
