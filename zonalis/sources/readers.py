"""Reading fields: tables, swaths, external grids, variable mappings."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The value that marks missing data in swath files.
MISSING = -999.0


def clean(df: DataFrame, missing: float | None = None) -> DataFrame:
    """NaN, and the missing value, as null in every floating column; metadata stays."""
    out = []
    for field in df.schema:
        c = F.col(field.name)
        if field.dataType.simpleString() in ("double", "float"):
            bad = F.isnan(c) if missing is None else F.isnan(c) | (c == missing)
            c = F.when(~bad, c).alias(field.name, metadata=field.metadata or {})
        out.append(c)
    return df.select(*out)


def read_field(spark: SparkSession, path: str | list[str], fmt: str = "parquet", missing: float | None = None) -> DataFrame:
    """One table of a field; several paths or a glob are read together.  Types of CSV are found by a pass over it."""
    options = {"header": "true", "inferSchema": "true"} if fmt == "csv" else {}
    return clean(spark.read.format(fmt).options(**options).load(path), missing)


def read_each(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a pattern, with the file each row came from as ``source``."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return clean(spark.read.parquet(pattern)).withColumn("source", name)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern matches, in order and without metadata; none is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    paths = sorted(p for p in (f.getPath().toString() for f in found) if not p.endswith((".meta", ".aside")))
    if not paths:
        raise FileNotFoundError(f"no file matches {pattern}")
    return paths


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """Tables merged by column name; a column that a table lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_grid(field: DataFrame, grid: DataFrame, cell: str = "cell") -> DataFrame:
    """lon and lat of an external grid table joined to the cells."""
    return field.join(grid.select(cell, "lon", "lat"), cell)


def rename_mapped(df: DataFrame, mapping: dict[str, str], keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Keys and {new name: column}; the names of missing columns are returned too."""
    have = {new: old for new, old in mapping.items() if old in df.columns}
    return df.select(*keys, *[F.col(old).alias(new, metadata=df.schema[old].metadata or {}) for new, old in have.items()]), sorted(set(mapping) - set(have))


def load_mapping(text: str) -> dict[str, str]:
    """A mapping of names from JSON, or lines ``new: old`` with # comments."""
    if text.lstrip().startswith("{"):
        return {str(k): str(v) for k, v in json.loads(text).items()}
    pairs = (line.split("#", 1)[0].partition(":") for line in text.splitlines() if ":" in line.split("#", 1)[0])
    return {k.strip().strip("'\""): v.strip().strip("'\"") for k, _, v in pairs if v.strip()}


def named_by_standard(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the columns that have a standard name; all columns if none has one."""
    named = [f.name for f in df.schema if (f.metadata or {}).get("standard_name") and f.name not in keys]
    return df.select(*keys, *named) if named else df


def is_swath(meta: dict) -> bool:
    return meta.get("Mission") == "TIMED" and "SABER" in str(meta.get("Title", ""))


def swath_hours(milliseconds: str) -> Column:
    """Hours of the day from milliseconds since midnight."""
    return F.pmod(F.col(milliseconds) / 3.6e6, F.lit(24.0))


def output_name(template: str, path: str) -> str:
    """A template with {basename} and {name_no_ext} of an input path filled in."""
    p = PurePosixPath(path)
    return template.format(basename=p.name, name_no_ext=p.stem)
