"""Secret scan with corpus-wide ownership: who else has the same credential?

Spans are found by regular expressions inside the plan (a text's pieces between matches give the positions, in code points).
Every candidate's hash is then counted over the whole corpus by distinct repositories and owners. A credential that many owners
have was copied from an example; one that a single owner has looks live. Candidates of the loose kind ``mixed`` (long
runs of letters and digits in both cases) become spans only if a single owner has them, as copied ones are nearly always
identifiers of public things.

Only DataFrame functions are used. Counts are aggregated per (hash, repository), per (hash, owner) and per hash, so a widely copied
hash is one row per task before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, table, text_or_empty


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of the whole class only, so that the length can stand in the pattern itself.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIXED = "[A-Za-z0-9]{24,}"
KINDS = ("assign", "access", "hex", "mixed")
#: A candidate of this many owners or more counts as a copied example.
COPIED = 3
#: Matches that are gathered before they join the others of their text.
CHUNK = 64
_SPAN = "array<struct<start:bigint,order:int,kind:string,end:bigint,value:string>>"


def _spans(text: Column, order: int, pattern: str, value_group: int, may: Column, keep) -> Column:
    """The matches of one kind as structs, positions by adding up the lengths of pieces and matches. Arrays grow in chunks, so a text of many matches isn't copied for each."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"), values.alias("v"))
    empty = F.array().cast(_SPAN)

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["p"])
        end = start + F.length(row["m"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(KINDS[order]).alias("kind"), end.alias("end"), row["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep(row), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    state = f"struct<at:bigint,spans:{_SPAN}>"
    nested = f"struct<at:bigint,spans:array<{_SPAN}>>"

    def chunk(done: Column, k: Column) -> Column:
        first = F.struct(done["at"].alias("at"), empty.alias("spans"))
        some = F.aggregate(F.slice(rows, k * CHUNK + 1, F.lit(CHUNK)), first.cast(state), lambda s, r: step(s, r).cast(state))
        return F.transform(F.array(some), lambda s: F.struct(s["at"].alias("at"), F.concat(done["spans"], F.array(s["spans"])).alias("spans")).cast(nested))[0]

    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans")).cast(nested)
    chunks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
    return F.when(may & (F.size(found) > 0), F.aggregate(chunks, none, chunk, lambda s: F.flatten(s["spans"]))).otherwise(empty)


def find_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind, leftmost and not overlapping within the kind."""
    everything = lambda row: F.lit(True)
    keyed = (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(ASSIGN)
    both = lambda row: row["m"].rlike("[A-Z]") & row["m"].rlike("[a-z]") & row["m"].rlike("[0-9]")
    return {
        "assign": _spans(text, 0, ASSIGN, 2, keyed, lambda row: F.length(row["v"]) >= 6),
        "access": _spans(text, 1, ACCESS, 0, F.contains(text, F.lit("AKIA")), everything),
        "hex": _spans(text, 2, HEX, 0, text.rlike("[0-9a-f]{24}"), everything),
        "mixed": _spans(text, 3, MIXED, 0, text.rlike(MIXED), both),
    }


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, key: str, repository: Column, owner: Column, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, counts and spans of each kind, and how many are live-looking, shared or copied.

    Null texts are empty, null owners and repositories are one owner of their own, repeated rows stay apart. Empty and
    span-free texts give empty strings, an empty table no rows.
    """
    base = docs.select(F.col(key), text_or_empty(text).alias("_text"), F.coalesce(owner, F.lit("")).alias("_owner"), F.coalesce(repository, F.lit("")).alias("_repository"))
    by_kind = find_spans(F.col("_text"))
    found = cut(base.select(F.monotonically_increasing_id().alias("_row"), key, "_owner", "_repository", *[c.alias(f"_{k}") for k, c in by_kind.items()]))
    hits = found.select("_row", "_owner", "_repository", F.explode(F.concat(*[F.col(f"_{k}") for k in KINDS])).alias("_span")).withColumn("_hash", F.sha2(F.col("_span.value"), 256))
    ownership = (
        hits.groupBy("_hash", "_owner", "_repository").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_n").alias("repositories"))
    )
    judged = hits.join(ownership, "_hash")
    kept = judged.filter((F.col("_span.kind") != "mixed") | (F.col("owners") == 1))
    per_row = kept.groupBy("_row").agg(
        F.collect_list("_span").alias("_all"),
        F.count_if(F.col("owners") == 1).alias("n_live"),
        F.count_if((F.col("owners") > 1) & (F.col("owners") < COPIED)).alias("n_shared"),
        F.count_if(F.col("owners") >= COPIED).alias("n_copied"),
        F.max("repositories").alias("most_repositories"),
    )
    count = lambda kind: F.size(f"_{kind}").cast("long").alias(f"n_{kind}")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_shared", "n_copied", "most_repositories")]
    return found.join(per_row, "_row", "left").select(
        key,
        *[count(k) for k in KINDS[:3]],
        F.sha2(_joined(F.concat("_assign", "_access", "_hex")), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("_all")), F.lit("")).alias("spans"),
        *numbers,
    )


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a source is an owner, and its texts of one language are a repository. Odd rows are taken as ``scan_secrets`` says."""
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, "doc_id", F.concat_ws("/", "source", "lang"), F.col("source"))
