"""Three-valued conditions over nullable columns: true, false, or null for unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def at_least(column: str, value) -> Column:
    return F.col(column) >= F.lit(value)


def at_most(column: str, value) -> Column:
    return F.col(column) <= F.lit(value)


def equals(column: str, value) -> Column:
    return F.col(column) == F.lit(value)


def one_of(column: str, values, known_false: Column | None = None) -> Column:
    """Membership; where the column is unknown but ``known_false`` holds, the answer is false."""
    member = F.col(column).isin(*values)
    return member if known_false is None else F.when(F.col(column).isNull() & F.coalesce(known_false, F.lit(False)), F.lit(False)).otherwise(member)


def has_all(struct: str, names) -> Column:
    """All flags of a struct set; a missing flag is false, not unknown."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(f"{struct}.{n}"), F.lit(False)) for n in names])


def evaluate(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One nullable boolean column c_<name> per condition."""
    return df.select("*", *(c.alias(f"c_{n}") for n, c in conditions.items()))


def matching(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows for which every condition is true; no conditions match everything."""
    return reduce(lambda d, c: d.filter(c), conditions.values(), df)


def diagnostics(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(condition, total, matched, failed, unknown), in one pass."""
    counts = df.agg(F.count("*").alias("total"), *(f for n, c in conditions.items() for f in (F.count_if(c).alias(f"t_{n}"), F.count_if(~c).alias(f"f_{n}"))))
    rows = F.array(*(F.struct(F.lit(n).alias("condition"), F.col("total"), F.col(f"t_{n}").alias("matched"), F.col(f"f_{n}").alias("failed"), (F.col("total") - F.col(f"t_{n}") - F.col(f"f_{n}")).alias("unknown")) for n in conditions))
    return counts.select(F.inline(rows))


def unknown_counts(df: DataFrame, conditions: dict[str, tuple[str, Column]]) -> DataFrame:
    """(field, rows): rows with no false condition whose unknowns all lie in one field. conditions: name -> (field, condition)."""
    unknown = F.array_distinct(F.array_compact(F.array(*(F.when(c.isNull(), F.lit(field)) for field, c in conditions.values()))))
    none_false = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for _, c in conditions.values()])
    return df.filter(none_false).select(unknown.alias("u")).filter(F.size("u") == 1).select(F.col("u")[0].alias("field")).groupBy("field").agg(F.count("*").alias("rows"))


def grade(tests: list[Column]) -> tuple[Column, Column]:
    """(how many tests hold, grade): unknown is false; 2 if all hold, 1 if exactly one of several fails, else 0."""
    passed = reduce(Column.__add__, [F.coalesce(t, F.lit(False)).cast("int") for t in tests])
    return passed, F.when(passed == len(tests), 2).when((passed == len(tests) - 1) & F.lit(len(tests) > 1), 1).otherwise(0)
