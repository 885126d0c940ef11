"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8
#: Logarithm of the smallest normal double: exponents below it would underflow.
LOG_TINY = -708.3964185322641


def quantile(x: Column, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(x, F.lit(q))


#: Accuracy of the brackets of `quantiles`: what is sorted is some thousandths of the rows.
BRACKET = 4000


def quantiles(rows: DataFrame, columns: dict[str, Column], qs: Sequence[float]) -> DataFrame:
    """One row: for each column an array of exact quantiles with linear interpolation; missing values do not count.

    A sketch brackets each quantile; then the values below a bracket are counted, and of those inside the distinct ones
    with their counts, so that no task holds a column and a value that many rows share is one entry. A plan of
    aggregates, without a round trip to the driver.
    """
    step = 4 / BRACKET
    edges = [p for q in qs for p in (max(0.0, q - step), min(1.0, q + step))]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(columns.values())])).alias("x")).select("x.i", "x.v").where("v is not null")
    brackets = long.groupBy("i").agg(F.percentile_approx("v", F.array(*map(F.lit, edges)), BRACKET).alias("e"), F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
    few = F.col("n") <= BRACKET  # all of them are sorted: a rank more or less matters
    low, high = (F.array(*[F.when(few, F.col(end)).otherwise(F.col("e")[2 * j + k]) for j in range(len(qs))]) for k, end in enumerate("az"))
    brackets = brackets.select("i", "n", F.posexplode(F.arrays_zip(low.alias("low"), high.alias("high"))).alias("j", "b")).select("i", "j", "n", "b.low", "b.high")
    met = long.join(F.broadcast(brackets), "i").where("v <= high")  # a row for each column and quantile
    counts = met.groupBy("i", "j", "n", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    below, inside = F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)), F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "c"))))
    held = counts.groupBy("i", "j", "n").agg(below.alias("b"), inside.alias("s"))

    def pick(k: Column) -> Column:  # the value of rank k from 0
        start = F.struct(F.col("b").alias("n"), F.lit(None).cast("double").alias("v"))
        return F.aggregate("s", start, lambda a, x: F.struct((a["n"] + x["c"]).alias("n"), F.when(a["v"].isNull() & (a["n"] + x["c"] > k), x["v"]).otherwise(a["v"]).alias("v")))["v"]

    at = F.element_at(F.array(*map(F.lit, map(float, qs))), F.col("j") + 1) * (F.col("n") - 1)
    held = held.withColumns({"at": at, "down": F.floor(at), "up": F.ceil(at)})
    value = F.when(F.col("down") == F.col("up"), pick(F.col("down"))).otherwise((F.col("up") - F.col("at")) * pick(F.col("down")) + (F.col("at") - F.col("down")) * pick(F.col("up")))
    found = held.select("i", "j", value.alias("q")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("i") * len(qs) + F.col("j"), "q"))).alias("m"))
    return found.select(*[F.array(*[F.col("m")[F.lit(i * len(qs) + j)] for j in range(len(qs))]).alias(n) for i, n in enumerate(columns)])


def norm(v: Column) -> Column:
    """Euclidean norm of an array."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def times(a: Column, c: Column) -> Column:
    return F.transform(a, lambda x: x * c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sum_arrays(v: Column, dim: int) -> Column:
    """Element-wise sum over a group, as an array; one partial aggregate for each element."""
    return F.array(*[F.sum(v[k]) for k in range(dim)])


def soft_clip(y: Column, radius: Column) -> Column:
    """Projection of an array onto the ball of a radius."""
    return times(y, F.least(F.lit(1.0), radius / F.greatest(norm(y), F.lit(1e-30))))


def affinity(exponent: Column) -> Column:
    """exp, kept above the smallest normal double."""
    return F.exp(F.greatest(exponent, F.lit(LOG_TINY)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, missing where |b| is at most 1e-12."""
    return F.when(F.abs(b) > 1e-12, a / b)


def spectral_indices(b02: Column, b04: Column, b08: Column, b11: Column) -> dict[str, Column]:
    """NDVI, NDMI and bare-soil index of reflectances."""
    return {"ndvi": ratio(b08 - b04, b08 + b04), "ndmi": ratio(b08 - b11, b08 + b11), "bsi": ratio(b11 + b04 - b08 - b02, b11 + b04 + b08 + b02)}


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def point_id(x: Column) -> Column:
    """A point identifier as text: trimmed, without a trailing `.0`."""
    return F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")


def stable_id(prefix: str, fields: Sequence[Column]) -> Column:
    """prefix and the first 20 digits of the SHA-256 of the fields, joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *fields).cast("binary"), 256), 1, 20))


def is_sha256(x: Column) -> Column:
    return F.lower(x).rlike("^[0-9a-f]{64}$")
