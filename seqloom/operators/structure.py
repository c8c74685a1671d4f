"""Structures and annotation records as tables: JSON of pairwise errors, atoms of two text formats, secondary structure streams, feature registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parts import bound_once

#: States of secondary structure and their three classes (fixed values).
SS3 = {"H": "H", "G": "H", "I": "H", "E": "E", "B": "E", "T": "C", "S": "C", "-": "C", "C": "C", "P": "C"}
_RECORD = "struct<features:array<struct<type:string,description:string,featureId:string,location:struct<start:struct<value:int>,end:struct<value:int>>,evidences:array<struct<evidenceCode:string>>>>>"


def error_matrix(json: Column) -> Column:
    """The square matrix of one of the usual layouts: an object, or a list of one, with the matrix under ``pae`` or ``predicted_aligned_error``; null if it isn't square."""
    record = "struct<pae:array<array<double>>,predicted_aligned_error:array<array<double>>>"
    # a list's schema also reads an object; the text is parsed once, and not again in the lambda
    first = F.get(F.from_json(json, f"array<{record}>"), 0)
    matrix = bound_once(first, lambda x: F.coalesce(x["predicted_aligned_error"], x["pae"]))
    return bound_once(matrix, lambda m: F.when(F.forall(m, lambda r: F.size(r) == F.size(m)), m))


def error_features(matrix: Column, window: int = 5, edges: tuple[int, int] = (5, 15)) -> Column:
    """Per residue its mean error, and those within a window, and near, middle and far along the sequence; null where a band is empty."""
    mean = lambda x: bound_once(x, lambda y: F.when(F.size(y) > 0, F.aggregate(y, F.lit(0.0), lambda s, v: s + v) / F.size(y)))

    def of(row: Column, i: Column) -> Column:
        band = lambda keep: mean(F.filter(row, lambda _, j: keep(F.abs(j - i))))
        return F.struct(mean(row).alias("mean"), band(lambda d: d <= window).alias("local"), band(lambda d: d <= edges[0]).alias("near"), band(lambda d: (d > edges[0]) & (d <= edges[1])).alias("middle"), band(lambda d: d > edges[1]).alias("far"))

    return F.transform(matrix, of)


def pdb_atoms(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Atoms of the fixed-column format, with occupancy and B-factor; hetero atoms are kept apart by ``record``."""
    cut = lambda a, n: F.trim(F.substring(value, a, n))
    rows = lines.filter(F.substring(value, 1, 6).isin("ATOM  ", "HETATM"))
    numbers = [cut(a, n).cast("double").alias(c) for a, n, c in ((31, 8, "x"), (39, 8, "y"), (47, 8, "z"), (55, 6, "occupancy"), (61, 6, "b_factor"))]
    return rows.select(*keep, F.trim(F.substring(value, 1, 6)).alias("record"), cut(7, 5).cast("int").alias("serial"), cut(13, 4).alias("atom"), cut(18, 3).alias("residue"), cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("number"), *numbers)


#: Names of the columns of an atom table in the tagged format, and ours (fixed values).
CIF = {"group_PDB": "record", "id": "serial", "label_atom_id": "atom", "label_comp_id": "residue", "auth_asym_id": "chain", "auth_seq_id": "number", "Cartn_x": "x", "Cartn_y": "y", "Cartn_z": "z", "occupancy": "occupancy", "B_iso_or_equiv": "b_factor"}


def cif_atoms(texts: DataFrame, entry: str, text: str) -> DataFrame:
    """``entry`` and the columns of ``pdb_atoms`` from whole files of the tagged format, whatever the order of their columns."""
    lines = F.split(text, "\n")
    tags = F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit("_atom_site."))), lambda s: F.trim(F.substring(s, 12, 99)))
    atoms = F.filter(lines, lambda s: F.startswith(s, F.lit("ATOM")) | F.startswith(s, F.lit("HETATM")))
    rows = texts.select(F.col(entry).alias("entry"), tags.alias("_t"), F.explode(F.transform(atoms, lambda s: F.split(F.trim(s), r"\s+"))).alias("_f"))
    kinds = {"serial": "int", "number": "int", "x": "double", "y": "double", "z": "double", "occupancy": "double", "b_factor": "double"}
    at = lambda tag: F.get("_f", (F.array_position("_t", tag) - 1).cast("int"))
    return rows.select("entry", *[at(tag).cast(kinds.get(name, "string")).alias(name) for tag, name in CIF.items()])


def residues_of_chain(atoms: DataFrame, entry: str = "entry") -> DataFrame:
    """``entry, number, x, y, z, b_factor`` of the alpha carbons of the longest chain of each entry (ties: the first by name)."""
    carbons = atoms.filter("record = 'ATOM' AND atom = 'CA'")
    sizes = carbons.groupBy(entry, "chain").agg(F.countDistinct("number").alias("_n"))
    best = sizes.groupBy(entry).agg(F.min(F.struct((-F.col("_n")).alias("n"), "chain")).alias("_b")).select(entry, F.col("_b.chain").alias("chain"))
    return carbons.join(best, [entry, "chain"]).groupBy(entry, "number").agg(*[F.first(c).alias(c) for c in ("x", "y", "z", "b_factor")])


def confidence(b_factor: Column, disorder: float = 70.0) -> dict[str, Column]:
    """A predicted model's confidence: scaled to 0..1, its tier from 0 (very low) to 3 (very high), and whether the residue counts as disordered."""
    tier = F.when(b_factor >= 90, 3).when(b_factor >= 70, 2).when(b_factor >= 50, 1).otherwise(0)
    return {"plddt": F.least(F.greatest(b_factor / 100, F.lit(0.0)), F.lit(1.0)), "tier": tier, "disorder": (b_factor < disorder).cast("int")}


def secondary_structure(states: Column, mode: str = "ss3") -> Column:
    """One vector per residue: which of the three classes (H, E, C) or eight states it has."""
    names = ["H", "E", "C"] if mode == "ss3" else ["H", "B", "E", "G", "I", "T", "S", "-"]
    table = F.create_map(*[F.lit(x) for kv in SS3.items() for x in kv])
    each = F.filter(F.split(states, ""), lambda s: s != "")
    state = lambda s: F.coalesce(F.element_at(table, s), F.lit("C")) if mode == "ss3" else s
    return F.transform(each, lambda s: F.array(*[(state(s) == n).cast("double") for n in names]))


def angle_features(angles: Column) -> Column:
    """Sine and cosine of each angle in degrees; zeros where there is none (360 in the usual tables)."""
    there = lambda a: a.isNotNull() & (F.abs(a) <= 180)
    return F.transform(angles, lambda a: F.array(F.when(there(a), F.sin(F.radians(a))).otherwise(0.0), F.when(there(a), F.cos(F.radians(a))).otherwise(0.0)))


def align_to_sequence(stream: Column, seen: Column, sequence: Column, missing: Column) -> Column:
    """A stream over the residues that were seen (1-based numbers), laid over the whole sequence; ``missing`` elsewhere."""
    return F.transform(F.sequence(F.lit(1), F.length(sequence)), lambda p: F.coalesce(F.get(stream, (F.array_position(seen, p) - 1).cast("int")), missing))


def record_annotations(df: DataFrame, entry: str, json: str, categories: dict[str, str], evidence: Sequence[str] | None = None) -> DataFrame:
    """``protein_id, feature_type, category, start, end, evidence`` of JSON records: only wanted types, only rows with an allowed evidence, the ends of bonds as rows of their own."""
    rows = df.select(F.col(entry).alias("protein_id"), F.explode(F.from_json(json, _RECORD)["features"]).alias("f"))
    codes = F.coalesce(F.transform("f.evidences", lambda e: e["evidenceCode"]), F.array().cast("array<string>"))
    rows = rows.withColumn("_codes", codes).withColumn("category", F.element_at(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv]), F.col("f.type"))).filter("category IS NOT NULL")
    if evidence is not None:
        rows = rows.filter(F.arrays_overlap("_codes", F.array(*[F.lit(e) for e in evidence])))
    start, end = F.col("f.location.start.value"), F.col("f.location.end.value")
    ends = F.when(F.col("f.type").isin("Disulfide bond", "Cross-link") & (start < end), F.array(F.struct(start.alias("start"), start.alias("end")), F.struct(end.alias("start"), end.alias("end")))).otherwise(F.array(F.struct(start.alias("start"), end.alias("end"))))
    return rows.select("protein_id", F.col("f.type").alias("feature_type"), "category", F.explode(ends).alias("_e"), F.get("_codes", 0).alias("evidence")).select("protein_id", "feature_type", "category", "_e.start", "_e.end", "evidence")


#: Features that encoders know: subcategory, and lowest and highest value where they are scaled (fixed values).
REGISTRY = {
    "plddt": ("Confidence", 0.0, 100.0), "b_factor": ("Flexibility", 0.0, 100.0), "rasa": ("Accessibility", 0.0, 1.0), "depth": ("Accessibility", 0.0, 20.0),
    "contacts_8": ("Packing", 0.0, 20.0), "contacts_12": ("Packing", 0.0, 40.0), "pae_mean": ("Confidence", 0.0, 30.0), "domain_size": ("Domain", 0.0, 200.0), "ptm": ("Modification", None, None), "site": ("Function", None, None),
}


def registry(spark: SparkSession, more: dict[str, tuple[str, float | None, float | None]] | None = None) -> DataFrame:
    """``feature, category, subcategory, low, high`` of all features known, with registered ones."""
    rows = [(k, "Structure", s, lo, hi) for k, (s, lo, hi) in REGISTRY.items()] + [(k, "Registered", s, lo, hi) for k, (s, lo, hi) in (more or {}).items()]
    return spark.createDataFrame(rows, "feature string, category string, subcategory string, low double, high double")


def normalized(df: DataFrame, features: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Values scaled to 0..1 by their feature's range, clipped; those without a range stay."""
    ranged = df.join(F.broadcast(features.select(F.col("feature").alias(feature), "low", "high")), feature, "left")
    scaled = F.least(F.greatest((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.0)), F.lit(1.0))
    return ranged.withColumn(value, F.when(F.col("low").isNull(), F.col(value)).otherwise(scaled)).drop("low", "high")


def routed(spark: SparkSession, wanted: Sequence[str], encoders: dict[str, DataFrame], keys: Sequence[str] = ("entry", "pos")) -> DataFrame:
    """``keys, feature, value`` of mixed feature names, each from the encoder that makes it (long tables by encoder); unknown names raise."""
    made = {f: name for name, df in encoders.items() for f in df.columns if f not in keys}
    if unknown := [f for f in wanted if f not in made]:
        raise ValueError(f"no encoder for {unknown}")
    out = None
    for name, df in encoders.items():
        mine = [f for f in wanted if made[f] == name]
        if mine:
            rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in mine])).alias("_f")).select(*keys, "_f.feature", "_f.value")
            out = rows if out is None else out.unionByName(rows)
    return out


