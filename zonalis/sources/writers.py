"""Writing fields and tables of statistics."""

from __future__ import annotations

import json
import posixpath
import re
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from zonalis.functions import healpix as hp

#: File endings and what they are written as; anything else is Parquet.
STORES = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json"}
UNITS_LATEX = {"⁻¹": r"\textsuperscript{-1}", "⁻²": r"\textsuperscript{-2}", "²": r"\textsuperscript{2}", "³": r"\textsuperscript{3}", "°": r"\textdegree{}"}
HEADERS = ("Variable", "Level", "N", "Bias", "RMSE", "cRMSE", "MAE", "r", "sigma_ref", "sigma_cmp", "Skill")
COLUMNS = ("variable", "level", "n", "bias", "rmse", "crmse", "mae", "r", "sigma_ref", "sigma_cmp", "skill")


def resolve_store(path: str, store: str | None = None) -> tuple[str, str]:
    """(path, format); a format that is given wins over the ending."""
    ending = next((e for e in STORES if path.endswith(e)), None)
    return path, store or STORES.get(ending, "parquet")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def check_paths(source: str, target: str) -> None:
    # "x", "./x" and "x/" are one path, and so are file:/x and /x.
    plain = lambda p: posixpath.normpath(p if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]+:", p) else posixpath.abspath(re.sub(r"^file:/*", "/", p)))
    if plain(source) == plain(target):
        raise ValueError("input and output are the same")


def metadata(nside: int, order: str, history: list[str] | None = None, note: str = "", attrs: dict | None = None) -> dict:
    """What goes beside a field: grid, mapping, attributes, and the history with the newest entry first."""
    entry = [f"{datetime.now(UTC):%a %b %d %H:%M:%S %Y}: {note}"] if note else []
    return {
        "healpix_nside": nside, "npix": hp.npix(nside), "healpix_order": order, "cell_area_sr": hp.cell_area(nside), "resolution_km": hp.resolution_km(nside),
        "healpix": {"grid_mapping_name": "healpix", "healpix_nside": nside, "indexing_scheme": order}, "Conventions": "CF-1.10", **(attrs or {}), "history": [*entry, *(history or [])],
    }


def write_field(df: DataFrame, path: str, *, overwrite: bool = False, store: str | None = None, meta: dict | None = None, partition_by: list[str] | None = None) -> str:
    """Write a field in parallel, with its metadata in a one-line text table beside it.

    An existing path is an error unless ``overwrite``; the commit protocol leaves no half output.
    """
    path, fmt = resolve_store(path, store)
    writer = df.write.format(fmt).mode("overwrite" if overwrite else "error")
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    if meta is not None:
        df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.meta")
    return path


def aside(path: str) -> str:
    """Where the variables of a field stand that have no cell: a small table keyed by the remaining columns."""
    return f"{path.rstrip('/')}.aside"


def carry_aside(spark: SparkSession, source: str, target: str) -> None:
    """Pass the variables without a cell on from an input to an output."""
    if exists(spark, aside(source)):
        spark.read.parquet(aside(source)).write.mode("overwrite").parquet(aside(target))


def read_metadata(spark: SparkSession, path: str) -> dict:
    place = f"{path.rstrip('/')}.meta"
    return json.loads(spark.read.text(place).first()[0]) if exists(spark, place) else {}


def _rows(statistics: DataFrame, precision: int, pressure: bool) -> list[list[str]]:
    """Statistics, one small row per variable and level, as text."""
    out = []
    for r in statistics.orderBy("variable", "level").collect():
        level = "GLOBAL" if r["level"] is None else f"{r['level']:.2g}" if pressure else f"{r['level']:.1f}"
        out.append([r["variable"], level, str(r["n"]), *("nan" if r[c] is None else f"{r[c]:.{precision}f}" for c in COLUMNS[3:])])
    return out


def escape_latex(text: str) -> str:
    if "$" in text:
        return text.replace("%", r"\%")
    for c in "&%#_":
        text = text.replace(c, f"\\{c}")
    for plain, latex in UNITS_LATEX.items():
        text = text.replace(plain, latex)
    return text


def format_statistics(statistics: DataFrame, fmt: str = "table", precision: int = 3, pressure: bool = False, color: bool = False) -> str:
    """A table of statistics as text, csv, markdown or latex."""
    rows = _rows(statistics, precision, pressure)
    if fmt == "csv":
        return "\n".join(",".join(r) for r in [list(HEADERS), *rows])
    if fmt == "markdown":
        return "\n".join(f"| {' | '.join(r)} |" for r in [list(HEADERS), ["---"] * len(HEADERS), *rows])
    if fmt == "latex":
        head = " & ".join(escape_latex(h) for h in HEADERS)
        body = "\n".join(f"{' & '.join(map(escape_latex, r))} \\\\" for r in rows)
        return f"\\begin{{tabular}}{{ll{'r' * (len(HEADERS) - 2)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}"
    if fmt != "table":
        raise ValueError(f"{fmt!r} is no format of tables")
    width = [max(len(r[i]) for r in [list(HEADERS), *rows]) for i in range(len(HEADERS))]
    lines = []
    for r in [list(HEADERS), *rows]:
        cells = [c.rjust(w) if i > 1 else c.ljust(w) for i, (c, w) in enumerate(zip(r, width, strict=True))]
        if color and r is not None and r[7] not in ("r", "nan"):
            shade = 32 if float(r[7]) >= 0.9 else 33 if float(r[7]) >= 0.6 else 31
            cells[7] = f"\x1b[{shade}m{cells[7]}\x1b[0m"
        lines.append("  ".join(cells))
    return "\n".join(lines)
