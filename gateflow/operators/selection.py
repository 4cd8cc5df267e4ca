"""Exact percentiles by histograms of ranks, for groups of any size.

``percentile`` holds the distinct values of a group in one buffer. Here a group's values
are counted in bins of their range, which is combined on the map side; only the bins
that hold a wanted rank go on, each with the range of the values found in it, until the
values of all such bins are equal. The first bins are even on a logarithmic scale, so
that a few far values do not leave all others in one bin; later ones are even on their
own range, and split it every time. What a task holds is bounded by groups x ranks x
``bins`` counts, and the result is exact, not approximate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.functions.fixed import WHISKER
from gateflow.functions.text import name as quoted
from gateflow.functions.text import names
from gateflow.functions.text import value as literal
from gateflow.operators.impute import outside
from gateflow.operators.joins import left_join_null_safe
from gateflow.session import materialise

BINS = 1024


def _bin(x: str, low: str, high: str, bins: int) -> str:
    """Number of the bin; ``low`` has the first and a larger ``high`` the last one.

    Halves, so that the width of any range is a number.
    """
    share = f"try_divide({x} / 2 - {low} / 2, {high} / 2 - {low} / 2)"
    return (
        f"CAST(CASE WHEN {x} = {low} THEN 0 WHEN {x} = {high} THEN {bins - 1} "
        f"ELSE least({bins - 1}, floor(coalesce({share}, 0) * {bins})) END AS INT)"
    )


def _log(x: str) -> str:
    return f"signum({x}) * ln(1 + abs({x}))"


def values_at_ranks(
    df: DataFrame, groups: list[str], value: str, ranks: dict[str, str], bins: int = BINS
) -> DataFrame:
    """The values that stand at given places of each group's ascending order.

    ``ranks`` has SQL expressions over ``n``, the number of known values of the group,
    for places from 0. Gives the groups, ``n``, and a column for each place. ``df`` is
    read once a pass, so it should be stored; its values must be finite or missing.
    """
    keys = [quoted(group) for group in groups]
    rows = df.where(f"{quoted(value)} IS NOT NULL").selectExpr(
        *keys, f"CAST({quoted(value)} AS DOUBLE) + 0D AS valor"
    )
    whole = rows.groupBy(*groups).agg(
        F.expr("count(1) AS n"), F.expr("min(valor) AS low"), F.expr("max(valor) AS high")
    )
    places = ", ".join(f"CAST({place} AS BIGINT)" for place in ranks.values())
    # A bin in work: its range, the values below it, and the wanted places in it.
    work = materialise(
        whole.selectExpr(*keys, "n", "low", "high", "0L AS below", f"array({places}) AS places")
    )
    done, first = [], True
    while True:
        done.append(work.where("low = high"))
        open_bins = work.where("low < high")
        if open_bins.isEmpty():
            break
        bounds = open_bins.groupBy(*groups).agg(
            F.expr("collect_list(struct(low, high, below, n, places)) AS __bins")
        )
        held = left_join_null_safe(rows, bounds, groups).selectExpr(
            *keys, "valor", "get(filter(__bins, b -> valor BETWEEN b.low AND b.high), 0) AS b"
        )
        x, low, high = ("valor", "b.low", "b.high")
        if first:
            x, low, high = _log(x), _log(low), _log(high)
        counted = (
            held.where("b IS NOT NULL")
            .selectExpr(*keys, "valor", "b", f"{_bin(x, low, high, bins)} AS bin")
            .groupBy(*groups, F.expr("b.low"), "bin")
            .agg(
                F.expr("count(1) AS count"),
                F.expr("min(valor) AS bin_low"),
                F.expr("max(valor) AS bin_high"),
                F.expr("first(b) AS b"),
            )
        )
        before = (
            f"b.below + sum(count) OVER (PARTITION BY {names([*groups, 'low'])} ORDER BY bin "
            "ROWS UNBOUNDED PRECEDING) - count"
        )
        work = materialise(
            counted.selectExpr("*", f"{before} AS below")
            .selectExpr(
                *keys,
                "b.n AS n",
                "bin_low AS low",
                "bin_high AS high",
                "below",
                "filter(b.places, p -> p >= below AND p < below + count) AS places",
            )
            .where("size(places) > 0")
        )
        first = False
    found = done[0]
    for more in done[1:]:
        found = found.unionAll(more)
    # A place counts by its number, so equal places of two names are found once.
    table = found.selectExpr(*keys, "n", "low", "explode(places) AS place")
    wanted = [
        F.expr(f"max(IF(place = CAST({place} AS BIGINT), low, NULL)) AS {quoted(name)}")
        for name, place in ranks.items()
    ]
    return table.groupBy(*groups, "n").agg(*wanted)


def exact_percentiles(
    df: DataFrame, groups: list[str], value: str, shares: dict[str, float], bins: int = BINS
) -> DataFrame:
    """Percentiles, linear between neighbours, and ``n``, per group.

    A group without a known value has no row.
    """
    places = {}
    for name, share in shares.items():
        spot = f"(n - 1) * {literal(float(share))}"
        places[f"{name}_low"] = f"floor({spot})"
        places[f"{name}_high"] = f"ceil({spot})"
    found = values_at_ranks(df, groups, value, places, bins)

    def between(name: str, share: float) -> str:
        spot = f"((n - 1) * {literal(float(share))})"
        low, high = quoted(f"{name}_low"), quoted(f"{name}_high")
        return (
            f"CASE WHEN {low} = {high} THEN {low} ELSE {low} * (1 - ({spot} - floor({spot}))) "
            f"+ {high} * ({spot} - floor({spot})) END AS {quoted(name)}"
        )

    columns = [between(name, share) for name, share in shares.items()]
    return found.selectExpr(*[quoted(group) for group in groups], "n", *columns)


def boxplot_of_large_groups(
    df: DataFrame,
    groups: list[str],
    value: str,
    whisker: float = WHISKER,
    local_points: bool = False,
    bins: int = BINS,
) -> DataFrame:
    """The columns of ``boxplot_stats`` for groups with very many distinct values."""
    shares = {"q1": 0.25, "mediana": 0.5, "q3": 0.75}
    points = {"p10": 0.1, "p90": 0.9} if local_points else {}
    boxes = materialise(exact_percentiles(df, groups, value, shares | points, bins))
    rows = df.where(f"{quoted(value)} IS NOT NULL").selectExpr(
        *[quoted(group) for group in groups], f"CAST({quoted(value)} AS DOUBLE) AS valor"
    )
    reach = f"{literal(float(whisker))} * (q3 - q1)"
    far = outside("valor", f"q1 - {reach}", f"q3 + {reach}")
    columns = [
        "first(n) AS n",
        *[f"first({name}) AS {name}" for name in shares],
        "least(min(valor) FILTER (WHERE NOT atipico), first(q1)) AS bigote_inferior",
        "greatest(max(valor) FILTER (WHERE NOT atipico), first(q3)) AS bigote_superior",
        "count(1) FILTER (WHERE atipico) AS n_atipicos",
    ]
    if local_points:
        columns.append("avg(valor) AS media_local")
        columns += [f"first({name}) AS {name}_local" for name in points]
    marked = left_join_null_safe(rows, boxes, groups).selectExpr("*", f"{far} AS atipico")
    return marked.groupBy(*groups).agg(*map(F.expr, columns))
