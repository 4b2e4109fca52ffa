"""X-ray physics on tables: rays' path lengths, spectra, materials."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def resolve_priorities(segments: DataFrame, by: list[str], most: int = 10_000) -> DataFrame:
    """(by, start, end, obj): along each ray, between any two successive boundaries, the open segment of highest priority.

    segments (by, obj, priority, start, end). Of equal priorities the lower obj wins. A ray's crossings are a bounded group,
    a scene's size; the elementary intervals meet the segments in an equi-join on the ray.
    """
    cuts = segments.select(*by, F.explode(F.array("start", "end")).alias("_a")).distinct()
    nxt = cuts.withColumn("_b", F.lead("_a").over(Window.partitionBy(*by).orderBy("_a"))).filter("_b is not null")
    open_ = nxt.join(segments, by).filter((F.col("start") <= F.col("_a")) & (F.col("end") >= F.col("_b")))
    best = open_.groupBy(*by, "_a", "_b").agg(F.max(F.struct("priority", (-F.col("obj")).alias("_o"))).alias("m"))
    return best.select(*by, F.col("_a").alias("start"), F.col("_b").alias("end"), (-F.col("m._o")).alias("obj"), F.col("m.priority").alias("priority"))


def path_lengths(segments: DataFrame, by: list[str], material: str) -> DataFrame:
    return segments.groupBy(*by, material).agg(F.sum(F.col("end") - F.col("start")).alias("length"))


def length_histogram(lengths: DataFrame, material: str, width: float, bins: int) -> DataFrame:
    """Rays for each material and bin; lengths beyond the last bin are counted in bin `bins`."""
    b = F.least(F.floor(F.col("length") / width), F.lit(bins)).cast("int")
    return lengths.groupBy(material, b.alias("bin")).agg(F.count("*").alias("n"))


def monochromatic(lengths: DataFrame, by: list[str], mu: Column) -> DataFrame:
    """Sum of mu in 1/cm times length in mm, over 10; 0 at least."""
    return lengths.groupBy(*by).agg(F.greatest(F.sum(mu * F.col("length")) / 10, F.lit(0.0)).alias("v"))


def polychromatic(lengths: DataFrame, by: list[str], spectrum: DataFrame, coefficients: DataFrame, material: str) -> DataFrame:
    """-ln(I / I0) with I = sum over energies of flux exp(-sum mu len / 10) energy.

    spectrum (energy, flux) and coefficients (material, energy, mu) are short tables and broadcast.
    """
    line = lengths.join(F.broadcast(coefficients), material).groupBy(*by, "energy").agg((F.sum(F.col("mu") * F.col("length")) / 10).alias("_l"))
    return line.join(F.broadcast(spectrum), "energy").groupBy(*by).agg(
        (-F.log(F.sum(F.col("flux") * F.exp(-F.col("_l")) * F.col("energy")) / F.sum(F.col("flux") * F.col("energy")))).alias("v")
    )


def mixture(composition: DataFrame, coefficients: DataFrame) -> DataFrame:
    """(material, energy, mu_rho): the weighted mean of the elements' mass attenuation."""
    j = composition.join(F.broadcast(coefficients), "element")
    return j.groupBy("material", "energy").agg((F.sum(F.col("weight") * F.col("mu_rho")) / F.sum("weight")).alias("mu_rho"))


def kramers_spectrum(spark: SparkSession, peak_kv: int, step: float = 1.0, filter_mm: float = 2.5) -> DataFrame:
    """(energy, flux): bremsstrahlung by Kramers' law behind a filter whose attenuation falls with the cube of the energy,
    normalised to 1."""
    n = int(peak_kv / step)
    e = F.col("id") * step
    raw = spark.range(1, n + 1).select(e.alias("energy"), F.greatest((peak_kv - e) / e, F.lit(0.0)).alias("_f"))
    raw = raw.select("energy", (F.col("_f") * F.exp(-filter_mm * 2.7 * F.pow(F.lit(18.0) / F.col("energy"), 3) / 10)).alias("flux"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("flux").alias("_s")))).select("energy", (F.col("flux") / F.col("_s")).alias("flux"))


def half_value_layer(spectrum: DataFrame, mu: Column) -> float:
    """The thickness in mm that halves the energy fluence, by bisection over the spectrum's rows."""
    rows = [(r["f"], r["m"]) for r in spectrum.select((F.col("flux") * F.col("energy")).alias("f"), mu.alias("m")).collect()]
    total = sum(f for f, _ in rows)
    low, high = 0.0, 1e4
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(f * math.exp(-m * mid / 10) for f, m in rows) > total / 2 else (low, mid)
    return high


#: Fixed values: (CT value, density in g/cm^3) of air, fat, water, muscle and bone.
CT_DENSITIES = ((-1000.0, 0.0012), (-100.0, 0.92), (0.0, 1.0), (50.0, 1.05), (1500.0, 1.85))


def ct_line() -> tuple[float, float]:
    """Slope and intercept of density over CT value, by least squares."""
    n = len(CT_DENSITIES)
    mx, my = sum(x for x, _ in CT_DENSITIES) / n, sum(y for _, y in CT_DENSITIES) / n
    slope = sum((x - mx) * (y - my) for x, y in CT_DENSITIES) / sum((x - mx) ** 2 for x, _ in CT_DENSITIES)
    return slope, my - slope * mx


def density_of_ct(v: Column) -> Column:
    slope, base = ct_line()
    return v * slope + base


def ct_of_density(v: Column) -> Column:
    slope, base = ct_line()
    return (v - base) / slope


def parse_formula(formula: Column) -> Column:
    """H2O as an array of (element, count)."""
    parts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?[0-9]*)"), F.lit(1))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, "^([A-Z][a-z]?)", 1).alias("element"), F.coalesce(F.nullif(F.regexp_extract(p, "([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1)).alias("count")
        ),
    )


def molar_mass(formulas: DataFrame, elements: DataFrame) -> DataFrame:
    """(formula, mass): the sum of the elements' masses."""
    parts = formulas.select("formula", F.explode(parse_formula(F.col("formula"))).alias("p")).select("formula", "p.*")
    return parts.join(F.broadcast(elements), "element").groupBy("formula").agg(F.sum(F.col("count") * F.col("mass")).alias("mass"))


def log_factorial(n: Column) -> Column:
    """Stirling's series."""
    n = n.cast("double")
    return F.when(n < 2, 0.0).otherwise(n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * F.pow(n, 3)))


def poisson_probability(k: Column, mean: Column) -> Column:
    return F.exp(k * F.log(mean) - mean - log_factorial(k))
