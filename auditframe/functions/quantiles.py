"""Exact medians of any number of columns in one pass, without holding a group in one task."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.ordered import ranged, running_sums


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """keys and, per name, the median of its column (mean of the two middle values), exact.

    Values are counted per distinct value, the counts are stored in ranges of (key, column, value), and prefix sums over the
    ranges give every value its ranks; so a group of any size is spread over ranges. NULLs are left out; a key without a value of a column has NULL.
    """
    by = [*keys, "_what"]
    cells = F.array(*[F.struct(F.lit(name).alias("_what"), F.col(column).cast("double").alias("_v")) for name, column in columns.items()])
    values = df.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.*")
    counted = values.groupBy(*by, "_v").agg(F.count("_v").alias("_c"))  # a NULL keeps its key, with the count 0
    ranked = running_sums(ranged(counted, by, "_v"), by, "_v", {"_to": F.col("_c")}, totals="_n")
    holds = lambda rank: (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to"))
    found = []
    for name in columns:
        ends = [F.max(F.when((F.col("_what") == name) & holds(F.expr(rank)), F.col("_v"))) for rank in ("(_n - 1) div 2", "_n div 2")]
        found.append(((ends[0] + ends[1]) / 2).alias(name))
    return ranked.groupBy(*keys).agg(*found)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median of one column per key."""
    return exact_medians(df, keys, {name: value})
