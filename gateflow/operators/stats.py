"""Percentiles and boxplot statistics per group.

Exact percentiles keep the distinct values of a group together. Their inputs
are tables with one row per calendar hour and direction, so a group grows with
the number of days, not with the number of transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.fixed import WHISKER
from gateflow.functions.text import name as quoted
from gateflow.functions.text import value as literal
from gateflow.operators.impute import outside
from gateflow.operators.joins import left_join_null_safe
from gateflow.session import materialise


def local_percentiles(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mean, 10th and 90th percentile (linear between neighbours).

    Values are counted first, so that a group holds its distinct values only.
    """
    keys = [quoted(group) for group in groups]
    frequencies = (
        df.selectExpr(*keys, f"CAST({quoted(value)} AS DOUBLE) AS valor")
        .groupBy(*groups, "valor")
        .agg(F.expr("count(1) AS veces"))
    )
    known = "FILTER (WHERE valor IS NOT NULL)"
    return frequencies.groupBy(*groups).agg(
        F.expr(f"sum(valor * veces) / sum(veces) {known} AS media_local"),
        F.expr("percentile(valor, 0.1D, veces) AS p10_local"),
        F.expr("percentile(valor, 0.9D, veces) AS p90_local"),
    )


def _known(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    keys = [quoted(group) for group in groups]
    return df.where(f"{quoted(value)} IS NOT NULL").selectExpr(
        *keys, f"CAST({quoted(value)} AS DOUBLE) AS valor"
    )


def _with_boxes(
    df: DataFrame, groups: list[str], value: str, whisker: float
) -> DataFrame:
    """Distinct values of each group, their frequency, and the box of the group.

    Both uses of the frequencies share one shuffle.
    """
    known = _known(df, groups, value)
    frequencies = known.groupBy(*groups, "valor").agg(F.expr("count(1) AS veces"))
    return _boxed(frequencies, groups, whisker)


def _boxed(frequencies: DataFrame, groups: list[str], whisker: float) -> DataFrame:
    keys = [quoted(group) for group in groups]
    ranks = {"p10": 0.1, "q1": 0.25, "mediana": 0.5, "q3": 0.75, "p90": 0.9}
    wanted = ", ".join(map(literal, ranks.values()))
    boxes = (
        frequencies.groupBy(*groups)
        .agg(
            F.expr(f"percentile(valor, array({wanted}), veces) AS q"),
            F.expr("sum(valor * veces) / sum(veces) AS media"),
        )
        .selectExpr(
            *keys, "media", *[f"q[{i}] AS {rank}" for i, rank in enumerate(ranks)]
        )
    )
    reach = f"{literal(float(whisker))} * (q3 - q1)"
    far = outside("valor", f"q1 - {reach}", f"q3 + {reach}")
    return left_join_null_safe(frequencies, boxes, groups).selectExpr(
        "*", f"{far} AS atipico"
    )


def _summary(boxes: DataFrame, groups: list[str], local_points: bool) -> DataFrame:
    points = ["media", "p10", "p90"] if local_points else []
    columns = [
        "sum(veces) AS n",
        *[f"first({name}) AS {name}" for name in ("q1", "mediana", "q3")],
        "least(min(valor) FILTER (WHERE NOT atipico), first(q1)) AS bigote_inferior",
        "greatest(max(valor) FILTER (WHERE NOT atipico), first(q3)) AS bigote_superior",
        "coalesce(sum(veces) FILTER (WHERE atipico), 0) AS n_atipicos",
        *[f"first({name}) AS {name}_local" for name in points],
    ]
    return boxes.groupBy(*groups).agg(*map(F.expr, columns))


def boxplot_stats(
    df: DataFrame,
    groups: list[str],
    value: str,
    whisker: float = WHISKER,
    local_points: bool = False,
) -> DataFrame:
    """Quartiles, whiskers and number of points beyond them, per group.

    A whisker ends at the last value within ``whisker`` interquartile ranges
    of the box, and never inside the box. ``local_points`` adds the columns of
    ``local_percentiles``.
    """
    return _summary(_with_boxes(df, groups, value, whisker), groups, local_points)


def boxes_of_sets(
    df: DataFrame, value: str, sets: dict[str, list[str]], whisker: float = WHISKER
) -> dict[str, DataFrame]:
    """Boxes with local points for several groupings of the same rows, in one pass.

    Frequencies of all groupings come from one aggregation over grouping sets, in which
    the grouping's number keeps a missing key apart from one that is left out; quartiles
    and whiskers of all of them are two more. The boxes are stored, so each table is a
    filter of them.
    """
    columns = list(dict.fromkeys(c for groups in sets.values() for c in groups))
    # Names that ask for the same columns share a grouping, which must be listed once.
    distinct = {frozenset(groups): groups for groups in sets.values()}
    counted = _known(df, columns, value).groupingSets(
        [[F.col(c) for c in (*groups, "valor")] for groups in distinct.values()],
        *[F.col(c) for c in (*columns, "valor")],
    )
    frequencies = counted.agg(
        F.expr("count(1) AS veces"), F.grouping_id().cast("long").alias("conjunto")
    )
    keys = ["conjunto", *columns]
    boxes = materialise(_summary(_boxed(frequencies, keys, whisker), keys, True))

    def number(groups: list[str]) -> int:
        """One bit a column and one for the value, set where it is left out."""
        return sum((c not in groups) << i for i, c in enumerate(reversed([*columns, "valor"])) if c != "valor")

    measures = [c for c in boxes.columns if c not in keys]
    return {
        name: boxes.where(F.col("conjunto") == number(groups)).select(*groups, *measures)
        for name, groups in sets.items()
    }


def boxplot_outliers(
    df: DataFrame, groups: list[str], value: str, whisker: float = WHISKER
) -> DataFrame:
    """The values beyond the whiskers, with how often each occurs."""
    return (
        _with_boxes(df, groups, value, whisker)
        .where("atipico")
        .select(*groups, "valor", "veces")
    )
