"""Commands over tables of fields: ``python -m zonalis.cli COMMAND input output [options]``.

A field is a table with a ``cell`` column in RING order, key columns (time, level) and one
column for each variable.  Tables end in .parquet, .orc, .csv or .json.
"""

from __future__ import annotations

import argparse
import resource
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import cf
from zonalis.functions import healpix as hp
from zonalis.operators import compare as cp
from zonalis.operators import dynamics, extract, grid, reduce, regrid, spectral, tides, wavelet
from zonalis.operators.interpolator import HealpixInterpolator
from zonalis.plans import figures
from zonalis.sources import readers, writers

KEYS = ("time", "lst", "hour", "level")


class Field:
    """A field with its keys, values and resolution."""

    def __init__(self, spark: SparkSession, path: str, nside: int | None = None):
        self.spark, self.path = spark, path
        self.meta = writers.read_metadata(spark, path)
        self.df = readers.read_field(spark, path, writers.resolve_store(path)[1])
        self.keys = [c for c in self.df.columns if c in KEYS]
        self.values = [f.name for f in self.df.schema if f.name not in (*self.keys, "cell", "lat", "lon") and f.dataType.typeName() in ("double", "float", "integer", "long")]
        self.nside = nside or self.meta.get("healpix_nside")
        if not self.nside and "cell" in self.df.columns:
            last = self.df.agg(F.max("cell")).first()[0]
            if last is None:
                raise ValueError(f"{path} has no cells and does not say its resolution")
            self.nside = hp.nside_for(last + 1)
        if cf.order_of(self.meta) == "nested":
            self.df = grid.reorder(self.df, self.nside, "ring")


def convert(args, spark) -> DataFrame:
    """Regrid unstructured or regular tables, or bin a swath; the files of a pattern are merged first."""
    files = readers.matching(spark, args.input)
    df = readers.concatenate([readers.read_field(spark, f, writers.resolve_store(f)[1]) for f in files])
    if args.grid:
        df = readers.with_grid(df, readers.read_field(spark, args.grid, writers.resolve_store(args.grid)[1]))
    df = cf.usual_names(df)
    keys, meta = [c for c in df.columns if c in KEYS], writers.read_metadata(spark, files[0])
    # Beside a cell, or one without the other, y and x are variables.
    own = ("cell",) if "cell" in df.columns else ("y", "x") if {"y", "x"} <= set(df.columns) else ()
    places = [*own, *(c for c in ("lon", "lat", "hours") if c in df.columns)]
    if args.config:
        df, missing = readers.rename_mapped(df, readers.load_mapping(open(args.config, encoding="utf-8").read()), [*keys, *places])
        if missing:
            print(f"no column for {', '.join(missing)}", file=sys.stderr)
    elif readers.is_swath(meta):
        df = readers.named_by_standard(df, [*keys, *places])
    values = [c for c in df.columns if c not in (*keys, *places)]
    if args.ut_bins or readers.is_swath(meta):
        args.ut_bins = args.ut_bins or 24
        z, t = F.sin(F.radians("lat")), F.pmod(F.col("lon"), F.lit(360.0)) / 90.0
        args.nside = args.nside or 32
        return reduce.bin_swath(df, args.nside, values[0], z=z, t=t, level="level", bins=args.ut_bins, hours=F.col("hours"))
    if {"lon", "lat"} <= set(df.columns) and not cf.are_degrees(df, "lon") and df.filter(F.abs("lat") > 1.5707964).isEmpty():
        df = df.withColumns({c: F.degrees(c) for c in ("lon", "lat")})
    own = HealpixInterpolator(args.nside, args.order).setup(df)
    args.nside = own.nside
    return own(df, keys, values)


def zonal_mean(args, spark) -> DataFrame:
    """Means of rings, or of latitude bands where the cells are not those of a HEALPix grid."""
    df = readers.read_field(spark, args.input, writers.resolve_store(args.input)[1])
    last = df.agg(F.max("cell")).first()[0] if "cell" in df.columns else None
    if "lat" not in df.columns or cf.is_healpix(writers.read_metadata(spark, args.input), last + 1 if last is not None else None):
        f = Field(spark, args.input)
        return reduce.zonal_mean(f.df, f.nside, f.keys, f.values)
    keys = [c for c in df.columns if c in KEYS]
    values = [c for c in df.columns if c not in (*keys, "cell", "lat", "lon")]
    bands = args.bands or reduce.band_count(last + 1 if last is not None else df.select("lat", "lon").distinct().count())
    return reduce.band_zonal_mean(df, bands, keys, values)


def _along(args, spark, targets: Callable) -> DataFrame:
    f = Field(spark, args.input)
    return extract.along(f.df, targets(f), f.nside, f.keys, f.values)


def run_tides(args, spark) -> DataFrame:
    f = Field(spark, args.input)
    value = args.var or cf.guess_variable(f.df, "temperature", [*f.keys, "cell"])
    periods = [float(p) for p in args.periods.split(",")] if args.periods else [24.0]
    orders = [int(m) for m in args.m.split(",")] if args.m else [1]
    pairs = [(p, m) for p in periods for m in orders] if not args.modes else [(p or 24.0, m) for p, m in map(tides.parse_mode, args.modes.split(","))]
    axis = next(k for k in ("lst", "hour", "time") if k in f.keys)
    keys = [k for k in f.keys if k != axis]
    hours = tides.elapsed_hours(axis) if axis == "time" else F.col(axis)
    if args.method == "ls":
        return tides.least_squares_tides(f.df, f.nside, keys, value, hours, pairs, args.lmax, args.sym_asy)
    dt = cf.time_step_hours(f.df, axis) if axis == "time" else 24.0 / f.df.select(axis).distinct().count()
    out = None
    for m in dict.fromkeys(abs(m) for _, m in pairs):
        rings = wavelet.harmonic_rings(f.df, f.nside, keys, axis, value, m, args.lmax) if args.method == "sh" else spectral.ring_fourier(f.df, f.nside, [*keys, axis], value, [m])
        own = tides.wavelet_tides(rings, f.nside, keys, axis, m, dt, [p for p, _ in pairs], args.dj, args.sym_asy, not args.per_time)
        own = (tides.on_cells(own, spark, f.nside) if args.cells else own).withColumn("m", F.lit(m))
        out = own if out is None else out.unionByName(own)
    return out


def run_compare(args, spark) -> None:
    ref, cmp = Field(spark, args.input), Field(spark, args.output)
    wanted = args.var.split(",") if args.var else ref.values
    variables = [v for v in wanted if v in ref.values and v in cmp.values]
    for v in sorted(set(wanted) - set(variables)):
        print(f"{v} is not in both data sets", file=sys.stderr)
    one, two = ref.df, cmp.df
    if "time" in ref.keys and "time" in cmp.keys:
        one, two = cp.align_time(one, two)
    if args.lmax or args.wavelength:
        option = {"lmax": args.lmax} if args.lmax else {"wavelength_km": args.wavelength}
        smooth = lambda df, f: spectral.filter_maps(df, f.nside, f.keys, variables, **option)
        one, two = smooth(one, ref), smooth(two, cmp)
    vector = ("u", "v") if args.vector and {"u", "v"} <= set(variables) else None
    level = "level" if "level" in ref.keys else None
    out = cp.compare(one, two, variables, nside=ref.nside, nside_cmp=cmp.nside, select_levels=args.levels, keys=ref.keys, level=level, reduce=args.reduce, lat_range=tuple(args.lat_range), level_range=tuple(args.level_range) if args.level_range else None, vector=vector, scale=figures.display_factors(variables))
    if not args.by_level:
        out = out.filter("level is null")
    text = writers.format_statistics(out, args.format, args.precision, level is not None and cf.is_pressure(ref.df, "level"), color=not args.no_color and args.format == "table")
    if args.save:
        with open(args.save, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)


def run_spectrum(args, spark) -> DataFrame:
    f = Field(spark, args.input)
    names, kind = args.var.split(",") if args.var else [], args.type
    if kind == "kinetic":
        names, kind = spectral.kinetic_variables(f.df, names)
    return spectral.spectrum(f.df, f.nside, f.keys, names or f.values[: 1 if kind == "power" else 2], kind, args.lmax)


def _joined(parts: list[DataFrame], on: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, on)
    return out


def plot(args, spark) -> DataFrame:
    f = Field(spark, args.input)
    value = args.var or f.values[0]
    kinds = {
        "section": lambda: figures.section(f.df, f.nside, "level", value, args.lon),
        "keogram": lambda: figures.keogram(f.df, f.nside, "time", "level", value, args.lat, args.lon),
        "map": lambda: figures.global_map(f.df, f.nside, "level", value, args.height or 0.0),
        "spectrum": lambda: figures.spectrum_lines(f.df),
        "epflux": lambda: figures.flux_arrows(f.df, rho="rho" if "rho" in f.df.columns else None, scaling=args.scaling),
        "tide": lambda: figures.tide_panel(f.df, f.nside, args.m, args.period, "level" if "level" in f.keys else None),
    }
    axes = {"section": ("lat", "level", value), "keogram": ("time", "level", value), "tide": ("ring", "level", "amplitude")}
    if args.picture and args.type not in axes:
        raise ValueError(f"no picture is drawn of {args.type}, only its rows are written")
    out = kinds[args.type]()
    if args.picture:
        figures.draw(out, *axes[args.type], args.picture)
    return out


def commands() -> dict[str, tuple[Callable, list[tuple]]]:
    """Every command: what it does, and its options."""
    flag = {"action": "store_true"}
    wind = [("--u", {"default": "u"}), ("--v", {"default": "v"}), ("--lmax", {"type": int})]

    def on(f: Callable) -> Callable:
        return lambda args, spark: f(args, Field(spark, args.input))

    def flux(a, f: Field) -> DataFrame:
        vertical = "height" if a.height else "auto"
        return dynamics.eliassen_palm(f.df, f.nside, [k for k in f.keys if k != "level"], mode=a.mode, time_mean="time" if a.time_mean else None, vertical=vertical, interpolate=False if a.native else None, lmax=a.lmax, check=True, least_pressure=a.least_pressure, greatest_height=a.greatest_height)

    ep = (on(flux), [("--height", flag), ("--native", flag), ("--mode", {"default": "auto", "choices": ["auto", "full", "tem", "qg"]}), ("--time-mean", flag), ("--lmax", {"type": int}), ("--least-pressure", {"type": float}), ("--greatest-height", {"type": float})])
    return {
        "convert": (convert, [("--nside", {"type": int}), ("--ut-bins", {"type": int}), ("--config", {}), ("--grid", {}), ("--order", {"default": "ring", "choices": ["ring", "nested"]})]),
        "extract-lat": (lambda a, s: _along(a, s, lambda f: extract.parallel_targets(s, f.nside, a.lat, a.num_lons)), [("--lat", {"type": float, "required": True}), ("--num-lons", {"type": int})]),
        "extract-lon": (lambda a, s: _along(a, s, lambda f: extract.meridian_targets(s, f.nside, a.lon, a.num_lats)), [("--lon", {"type": float, "required": True}), ("--num-lats", {"type": int})]),
        "extract-point": (on(lambda a, f: extract.point(f.df, f.nside, a.lat, a.lon)), [("--lat", {"type": float, "required": True}), ("--lon", {"type": float, "required": True})]),
        "fill": (fill, [("--time-dim", {})]),
        "zonal-mean": (zonal_mean, [("--bands", {"type": int})]),
        "spectrum": (run_spectrum, [("--var", {}), ("--lmax", {"type": int}), ("--type", {"default": "power", "choices": ["power", "cross", "kinetic", "kinetic-scalar"]})]),
        "filter": (on(lambda a, f: spectral.filter_maps(f.df, f.nside, f.keys, f.values, fwhm_deg=a.fwhm, lmax=a.lmax, wavelength_km=a.wavelength)), [("--fwhm", {"type": float}), ("--lmax", {"type": int}), ("--wavelength", {"type": float})]),
        "regrade": (on(lambda a, f: grid.regrade(f.df, f.nside, a.nside or hp.nside_for_zoom(a.zoom), f.keys, f.values)), [("--nside", {"type": int}), ("--zoom", {"type": int})]),
        "uv2dv": (on(lambda a, f: spectral.vorticity_divergence(f.df, f.nside, f.keys, a.u, a.v, a.lmax)), wind),
        "dv2uv": (on(lambda a, f: spectral.winds(f.df, f.nside, f.keys, a.div, a.vor, a.lmax)), [("--div", {"default": "divergence"}), ("--vor", {"default": "vorticity"}), ("--lmax", {"type": int})]),
        "helmholtz": (on(lambda a, f: spectral.helmholtz(f.df, f.nside, f.keys, a.u, a.v, a.lmax).drop(*(["psi"] if a.no_psi else []), *(["chi"] if a.no_chi else []))), [*wind, ("--no-psi", flag), ("--no-chi", flag)]),
        "tides": (run_tides, [("--var", {}), ("--periods", {}), ("--m", {}), ("--modes", {}), ("--lmax", {"type": int}), ("--method", {"default": "ls", "choices": ["ls", "fourier", "sh"]}), ("--dj", {"type": float, "default": 0.1}), ("--sym-asy", flag), ("--per-time", flag), ("--cells", flag)]),
        "plot": (plot, [("--type", {"required": True, "choices": ["section", "keogram", "map", "spectrum", "epflux", "tide"]}), ("--m", {"type": int, "default": 1}), ("--period", {"type": float, "default": 24.0}), ("--scaling", {"default": "root", "choices": ["root", "edmon"]}), ("--picture", {}), ("--var", {}), ("--lat", {"type": float}), ("--lon", {"type": float}), ("--height", {"type": float})]),
        "ep-flux": ep,
        "epflux": ep,
        "compare": (run_compare, [("--var", {}), ("--by-level", flag), ("--reduce", {"default": "zonal-mean", "choices": ["zonal-mean", "global", "none"]}), ("--lat-range", {"type": float, "nargs": 2, "default": [-90.0, 90.0]}), ("--level-range", {"type": float, "nargs": 2}), ("--levels", {"type": float, "nargs": "+"}), ("--format", {"default": "table", "choices": ["table", "csv", "markdown", "latex"]}), ("--precision", {"type": int, "default": 3}), ("--no-color", flag), ("--save", {}), ("--vector", flag), ("--lmax", {"type": int}), ("--wavelength", {"type": float})]),
    }


def fill(args, spark) -> DataFrame:
    f = Field(spark, args.input)
    points = grid.grid(spark, f.nside).select(F.col("cell_ring").alias("cell"), "lon", "lat")
    parts = []
    for v in f.values:
        own = regrid.gaps(f.df.select(*f.keys, "cell", v), points, f.keys, v)
        if args.time_dim:
            own = regrid.time_gaps(own, args.time_dim, [k for k in f.keys if k != args.time_dim] + ["cell"], v)
        parts.append(own)
    return _joined(parts, [*f.keys, "cell"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="zonalis")
    subs = parser.add_subparsers(dest="command", required=True)
    known = commands()
    for name, (_, options) in known.items():
        sub = subs.add_parser(name)
        sub.add_argument("input")
        sub.add_argument("output")
        sub.add_argument("--overwrite", action="store_true")
        for option, settings in options:
            sub.add_argument(option, **settings)
    args = parser.parse_args(argv)
    began = time.time()
    spark = spark or SparkSession.builder.appName("zonalis").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    # A template as output means one output for every file that the input's pattern matches.
    for path in readers.matching(spark, args.input) if "{" in args.output else [args.input]:
        one = argparse.Namespace(**{**vars(args), "input": path, "output": readers.output_name(args.output, path)}) if "{" in args.output else args
        _run_one(one, spark, known[args.command][0])
    print(f"{args.command}: {time.time() - began:.1f} s, {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.0f} MB", file=sys.stderr)
    return 0


def _run_one(args, spark: SparkSession, command: Callable) -> None:
    writers.check_paths(args.input, args.output)
    out = command(args, spark)
    if out is not None:
        before = writers.read_metadata(spark, args.input)
        nside = getattr(args, "nside", None) or before.get("healpix_nside")
        meta = writers.metadata(nside, getattr(args, "order", "ring"), history=before.get("history"), note=f"zonalis {args.command}") if nside and "cell" in out.columns else None
        writers.write_field(out, args.output, overwrite=args.overwrite, meta=meta)
        writers.carry_aside(spark, args.input, args.output)


if __name__ == "__main__":
    sys.exit(main())
