"""Projections, ratios and the scrubbing of what they leave behind."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def without(df: DataFrame, *names: str) -> DataFrame:
    """All columns but these."""
    return df.drop(*names)


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Columns whose names begin with ``prefix``, in order of their names."""
    return df.select(*sorted(c for c in df.columns if c.startswith(prefix)))


def without_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefixes)])


def namespaced(df: DataFrame, prefix: str, keep: Iterable[str] = ()) -> DataFrame:
    """Columns renamed with ``prefix`` except those to ``keep``."""
    keep = set(keep)
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keep})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def ratio(num: Column, den: Column, zero: str = "null") -> Column:
    """num / den where a zero denominator gives null (``null``), 0 (``zero``), counts as at least 1
    (``floor1``) or has 1e-9 added (``eps``)."""
    num, den = num.cast("double"), den.cast("double")
    match zero:
        case "null":
            return F.try_divide(num, den)
        case "zero":
            return F.coalesce(F.try_divide(num, den), F.lit(0.0))
        case "floor1":
            return num / F.greatest(den, F.lit(1.0))
        case "eps":
            return num / (den + F.lit(1e-9))
    raise ValueError(zero)


def completion(done: Column, given: Column, zero: str = "zero") -> dict[str, Column]:
    """Ratio, difference, remainder and shortfall of completed against assigned counts."""
    r = ratio(done, given, zero)
    return {"ratio": r, "diff": done - given, "remaining": given - done, "shortfall": F.lit(1.0) - r}


def finite_or(c: Column, value: Column | float | None) -> Column:
    """``c`` with null, NaN and infinities replaced."""
    x = c.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, value if isinstance(value, Column) else F.lit(value).cast("double")).otherwise(x)


def scrub(df: DataFrame, columns: Iterable[str], value: float = 0.0) -> DataFrame:
    """Null, NaN and infinities replaced in ``columns``."""
    return df.withColumns({c: finite_or(F.col(c), value) for c in columns})


def medians(df: DataFrame, columns: Iterable[str]) -> dict[str, float | None]:
    """Exact medians of what is finite, all columns in one long frame."""
    from .ranks import exact_quantiles

    columns = list(columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), finite_or(F.col(c), None).alias("x")) for i, c in enumerate(columns)])
    found = {r["feature"]: r["q"][0] for r in exact_quantiles(df.select(F.explode(pairs).alias("r")).select("r.*"), [0.5]).collect()}  # a row per column
    return {c: found.get(i) for i, c in enumerate(columns)}


def impute_median(df: DataFrame, columns: Iterable[str], fitted: Mapping[str, float | None] | None = None) -> DataFrame:
    """What isn't finite replaced by the column's median, or by the ``fitted`` ones of another frame."""
    columns = list(columns)
    fitted = medians(df, columns) if fitted is None else fitted
    return df.withColumns({c: finite_or(F.col(c), fitted[c]) for c in columns})


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def log_shifted(df: DataFrame, column: str, low: float | None = None) -> Column:
    """log1p of the distance from the column's least value plus 1, or from a fitted one."""
    low = df.agg(F.min(column)).first()[0] if low is None else low
    return F.log1p(F.col(column) - F.lit(low) + 1)


def products(columns: Iterable[str], order: int = 2) -> dict[str, Column]:
    """Named products of every ``order`` columns."""
    out = {}
    for names in combinations(columns, order):
        c = F.col(names[0])
        for n in names[1:]:
            c = c * F.col(n)
        out["*".join(names)] = c
    return out


def pair_terms(a: str, b: str) -> dict[str, Column]:
    """Product, ratio, difference, least, largest and sign tests of two columns."""
    x, y = F.col(a), F.col(b)
    return {
        f"{a}*{b}": x * y, f"{a}/{b}": ratio(x, y, "eps"), f"{a}-{b}": x - y, f"min({a},{b})": F.least(x, y), f"max({a},{b})": F.greatest(x, y),
        f"both({a},{b})": ((x > 0) & (y > 0)).cast("double"), f"same({a},{b})": (F.signum(x) == F.signum(y)).cast("double"),
    }


def unary_terms(a: str) -> dict[str, Column]:
    x = F.col(a)
    return {f"{a}^2": x * x, f"|{a}|": F.abs(x), f"sroot({a})": F.signum(x) * F.sqrt(F.abs(x))}


def diagonal_terms(a: str, b: str) -> dict[str, Column]:
    """Magnitudes of sums of two columns."""
    x, y = F.col(a), F.col(b)
    return {"abs_sum": F.abs(x + y), "square_sum": (x + y) * (x + y), "weighted": F.abs(F.lit(1.2) * x + y), "radius": F.sqrt(x * x + y * y), "city": F.abs(x) + F.abs(y)}


def balance(x: Column, y: Column, eps: float = 1e-6) -> Column:
    return (x - y) / (F.abs(x) + F.abs(y) + F.lit(eps))


def harmonic(x: Column, y: Column, eps: float = 1e-6) -> Column:
    return 2 * x * y / (x + y + F.lit(eps))


def id_patterns(df: DataFrame, id_col: str, modulus: int, divisor: int) -> DataFrame:
    """``df`` with remainders and floors of the id and of its place in order of ids (from 0)."""
    from .ranks import with_positions

    placed = with_positions(df, [id_col], "row_index").withColumn("row_index", F.col("row_index") - 1)
    floor = lambda c, k: F.floor(F.col(c) / k).cast("long")
    return placed.withColumns({
        f"{id_col}_mod_{modulus}": F.pmod(F.col(id_col), F.lit(modulus)), f"{id_col}_div_{divisor}": floor(id_col, divisor),
        f"row_mod_{modulus}": F.pmod(F.col("row_index"), F.lit(modulus)), f"row_div_{divisor}": floor("row_index", divisor),
    })


def frequency(key: str) -> Column:
    """How many rows share the row's key."""
    return F.count("*").over(W.partitionBy(key))
