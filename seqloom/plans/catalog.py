"""Registration of queries and their SQL twins, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import LETTERS, canonical_sequence, scale_values
from ..functions.splits import Split, periodic_patterns, patterns, segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            TWINS[name] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """Documents as sequences: the middle half is the tmd. ``labels(doc_id, label)``: those only, so that no other text is cleaned."""
    docs = load(spark, sf_dir, "documents")
    more = [] if labels is None else ["label"]
    docs = docs if labels is None else docs.join(labels, "doc_id")
    seq = docs.select(F.col("doc_id").alias("entry"), canonical_sequence(F.coalesce("text", F.lit(""))).alias("sequence"), "lang", "source", *more)
    size = F.length("sequence")
    return seq.withColumns({"tmd_start": (F.floor(size / 4) + 1).cast("int"), "tmd_stop": F.floor(size * 3 / 4).cast("int")})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with a label (1: high quality)."""
    return sequences(spark, sf_dir, load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


SCALES = {f"SC{s:02d}": scale_values(s) for s in range(4)}
PARTS = ("tmd", "jmd_n_tmd_n", "tmd_c_jmd_c")
SEGMENTS = segments(1, 3)
PATTERNS = [p for p in patterns((3, 4), 2, 3, 10)][:6]
PERIODIC = periodic_patterns((3, 4))[:4]

SEQ = f"""seq AS (
  SELECT doc_id AS entry, regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[^{LETTERS}]', '', 'g') AS sequence, lang, source FROM documents
), df_seq AS (SELECT *, (length(sequence) // 4 + 1)::INT AS tmd_start, (length(sequence) * 3 // 4)::INT AS tmd_stop FROM seq)"""

BASE = f"""{SEQ}, base AS (
  SELECT entry, lang, source, sequence, substr(sequence, tmd_start, greatest(tmd_stop - tmd_start + 1, 0)) AS tmd,
    lpad(substr(sequence, greatest(tmd_start - 10, 1), tmd_start - greatest(tmd_start - 10, 1)), 10, '-') AS jmd_n,
    rpad(substr(sequence, tmd_stop + 1, 10), 10, '-') AS jmd_c FROM df_seq
), halves AS (SELECT *, round_even(length(tmd) / 2, 0)::INT AS h FROM base),
parts AS (
  SELECT entry, lang, source, sequence, tmd, jmd_n, jmd_c, substr(tmd, 1, h) AS tmd_n, substr(tmd, h + 1, length(tmd) - h) AS tmd_c,
    jmd_n || tmd || jmd_c AS tmd_jmd, jmd_n || substr(tmd, 1, h) AS jmd_n_tmd_n, substr(tmd, h + 1, length(tmd) - h) || jmd_c AS tmd_c_jmd_c FROM halves
), long AS (
  SELECT entry, 'TMD' AS part, tmd AS s FROM parts UNION ALL SELECT entry, 'JMD_N_TMD_N', jmd_n_tmd_n FROM parts UNION ALL SELECT entry, 'TMD_C_JMD_C', tmd_c_jmd_c FROM parts
)"""


def splits_sql(splits: list[Split], source: str = "long") -> str:
    """``letters(entry, part, split, x)``: the letters of each split."""
    seg = [s for s in splits if s.kind == "Segment"]
    pat = [s for s in splits if s.kind == "Pattern"]
    per = [s for s in splits if s.kind == "PeriodicPattern"]
    out = []
    if seg:
        rows = ", ".join(f"('{s.label}', {s.args[0]}, {s.args[1]}::DOUBLE)" for s in seg)
        lo, hi = "floor(length(s) / n * (i - 1)::DOUBLE)::INT", "floor(length(s) / n * i::DOUBLE)::INT"
        out.append(f"SELECT entry, part, l AS split, substr(s, {lo} + 1, {hi} - {lo}) AS x FROM {source}, (VALUES {rows}) AS v(l, i, n)")
    if pat:
        rows = ", ".join(f"('{s.label}', '{s.args[0]}', {list(s.args[1])})" for s in pat)
        out.append(f"SELECT entry, part, l AS split, coalesce(array_to_string(list_transform(p, lambda k: substr(CASE WHEN e = 'C' THEN reverse(s) ELSE s END, k, 1)), ''), '') AS x FROM {source}, (VALUES {rows}) AS v(l, e, p)")
    if per:
        rows = ", ".join(f"('{s.label}', '{s.args[0]}', {s.args[1]}, {s.args[2]}, {s.args[3]})" for s in per)
        at = "list_filter(list_transform(range(0, length(s) + 1), lambda k: st + k // 2 * (a + b) + k % 2 * a), lambda p: p <= length(s))"
        out.append(f"SELECT entry, part, l AS split, coalesce(array_to_string(list_transform({at}, lambda k: substr(CASE WHEN e = 'C' THEN reverse(s) ELSE s END, k::INT, 1)), ''), '') AS x FROM {source}, (VALUES {rows}) AS v(l, e, a, b, st)")
    return f"letters AS ({' UNION ALL '.join(out)})"


COUNTS = "[" + ", ".join(f"length(x) - length(replace(x, '{a}', ''))" for a in LETTERS) + "]"


def scales_sql(scales: dict[str, list[int]] = SCALES) -> str:
    return "scales(scale_id, v) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in scales.items()) + ")"


def features_sql(splits: list[Split] = SEGMENTS) -> str:
    """``feats(entry, feature, part, split, scale_id, value)`` after BASE."""
    return f"""{splits_sql(splits)}, {scales_sql()}, counted AS (SELECT entry, part, split, {COUNTS} AS c FROM letters),
feats AS (
  SELECT entry, concat(part, '-', split, '-', scale_id) AS feature, part, split, scale_id,
    CASE WHEN list_sum(c) > 0 THEN floor(list_sum(list_transform(list_zip(c, v), lambda p: p[1] * p[2])) / list_sum(c)::DOUBLE + 0.5) / 100000.0::DOUBLE END AS value
  FROM counted, scales
)"""


def rhu(x: str, d: int) -> str:
    """Round half up, as in the plans."""
    return f"(floor(({x}) * 1e{d}::DOUBLE + 0.5::DOUBLE) / 1e{d}::DOUBLE)"
