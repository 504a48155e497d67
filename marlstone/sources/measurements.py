"""Sources and sinks: delimited measurements, prediction files, tables, manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.expr import finite, normalize_endpoint

#: Names a logical column goes by, best first.
ALIASES = {
    "compound": ["smiles_norm", "canonical_smiles", "canonical_smiles_norm", "smiles", "SMILES"],
    "target": ["protein_clean", "protein_sequence", "target_sequence", "protein", "sequence"],
    "endpoint": ["affinity_type", "endpoint", "endpoint_type", "measure_type", "metric"],
    "y_true": ["y_true", "affinity_value", "observed_px", "observed_pX", "px_true", "label"],
    "y_pred": ["y_pred", "y_pred_raw", "pred_pX", "pred_final", "prediction", "predicted_px", "predicted_pX", "pred"],
}
#: Further names that this library takes, after those.
for _name, _more in {"compound": ["compound", "ligand"], "target": ["target"], "endpoint": ["type"], "y_true": ["y"]}.items():
    ALIASES[_name] += _more
#: Names that predictions and their uncertainty go by in scored tables, best first.
SCORED = {
    "y_pred": ["y_pred_calibrated", "y_pred", "pred_pX", "prediction", "pred"],
    "sigma": ["sigma", "pred_sigma", "sigma_pred", "std"],
    "lo": ["pred_lo", "lo", "lower"],
    "hi": ["pred_hi", "hi", "upper"],
    "bound": ["err_bound", "error_bound", "bound"],
}


def detect_columns(columns: Sequence[str], pattern: str, cap: int = 10) -> list[str]:
    """Columns that match a family's pattern, ordered by the number in it, at most ``cap`` (the family's own limit)."""
    found = [(int(m[1]) if m.groups() else 0, c) for c in columns if (m := re.fullmatch(pattern, c))]
    return [c for _, c in sorted(found)][:cap]


def resolve_columns(columns: Sequence[str], aliases: dict[str, Sequence[str]] = ALIASES, required: Sequence[str] = ()) -> dict[str, str]:
    """Logical name -> column: exact alias first, then without regard to case; a required name not found is an error."""
    lower = {c.lower(): c for c in reversed(columns)}
    out = {}
    for name, names in aliases.items():
        hit = next((a for a in names if a in columns), None) or next((lower[a.lower()] for a in names if a.lower() in lower), None)
        if hit:
            out[name] = hit
    if missing := [r for r in required if r not in out]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(columns)}")
    return out


def infer_columns(columns: Sequence[str], candidates: dict[str, Sequence[str]] = SCORED) -> dict[str, str | None]:
    """What each role's column is called in a scored table, None where nothing fits; an interval needs both of its ends."""
    found = resolve_columns(columns, candidates)
    out = {role: found.get(role) for role in candidates}
    if "lo" in out and "hi" in out and not (out["lo"] and out["hi"]):
        out |= {"lo": None, "hi": None}
    return out


def read_measurements(spark: SparkSession, path: str, colmap: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(measurements, bad lines) of a tab-separated file without quotes; all columns are text, named as colmap says.

    Columns are picked by the header, the first line; lines equal to it head further files. A line that is not UTF-8 is
    read as latin-1. A tab or backslash after a backslash is part of a field. A line
    with more or fewer fields than the header is bad; an empty field is null.
    """
    lines = spark.read.text(path).select(F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).alias("line"))
    head = lines.first()
    if head is None:
        raise ValueError(f"{path} has no header")
    header = [h.strip() for h in head["line"].split("\t")]
    rows = lines.where((F.col("line") != head["line"]) & (F.col("line") != "")).withColumn("f", F.split("line", r"(?<!\\)\t", -1))
    field = lambda k: F.nullif(F.regexp_replace(F.col("f")[k], r"\\(.)", "$1"), F.lit(""))
    whole = F.size("f") == len(header)
    return rows.where(whole).select(*(field(header.index(c)).alias(n) for c, n in colmap.items() if c in header)), rows.where(~whole).select("line")


def read_predictions(spark: SparkSession, paths: Sequence[str], aliases: dict[str, Sequence[str]] = ALIASES, require_pred: bool = True) -> DataFrame:
    """Union of prediction files under logical names, numbers coerced, rows without key or finite label left out.

    A file without an endpoint column takes the endpoint from its name.
    """
    out = None
    for path in paths:
        raw = spark.read.csv(path, header=True, mode="DROPMALFORMED")
        names = resolve_columns(raw.columns, aliases, ["compound", "target", "y_true", *(["y_pred"] if require_pred else [])])
        names |= {n: c for n, c in infer_columns(raw.columns).items() if c and n in ("sigma", "lo", "hi")}
        rows = raw.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items()))
        if "endpoint" not in names:
            rows = rows.withColumn("endpoint", normalize_endpoint(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\..*$", "")))
        rows = rows.withColumns({n: F.col(n).try_cast("double") for n in ("y_true", "y_pred", "sigma", "lo", "hi") if n in rows.columns})
        rows = rows.where(F.col("compound").isNotNull() & F.col("target").isNotNull() & finite("y_true"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def load_scored(df: DataFrame, y: str, p: str, sigma: str, endpoint: str, least: int = 200) -> tuple[DataFrame, int]:
    """(rows with finite label and prediction and a positive sigma, number removed); below ``least`` rows an error."""
    rows = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in (y, p, sigma)})
    good = rows.where(finite(y, p, sigma) & (F.col(sigma) > 0) & F.col(endpoint).isNotNull())
    n, kept = df.agg(F.count("*"), F.count_if(finite(*(F.col(c).cast("string").try_cast("double") for c in (y, p, sigma))) & (F.col(sigma).cast("string").try_cast("double") > 0) & F.col(endpoint).isNotNull())).first()  # one scan
    if kept < least:
        raise ValueError(f"{kept} scored rows; {least} are needed")
    return good, n - kept


def write_table(df: DataFrame, cols: Sequence[str], path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Writes the named columns in that order; names that are missing become null columns."""
    out = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols))
    writer = out.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def manifest(df: DataFrame) -> DataFrame:
    """json of each row, non-finite numbers and nulls as null."""
    clean = [F.when(finite(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def with_row_key(df: DataFrame, cols: Sequence[str], name: str = "row_key") -> DataFrame:
    """Adds a key from the row's own columns, the same however the table is partitioned."""
    return df.withColumn(name, F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols)), 256))
