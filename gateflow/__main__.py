"""Folder of exports to a folder of result tables, for ``spark-submit``.

    python -m gateflow EXPORTS RESULTS [--layout new] [--gates TK54RT54 ...]

With ``--refresh`` it can be run again and again: files that did not change are neither
decoded nor counted anew, and the results become a new version of the bundle.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession

from gateflow.functions.fixed import DEFAULT_GATES, SIGMAS, TIME_BANDS
from gateflow.operators.counts import date_range
from gateflow.plans.flow import flow_from_folder
from gateflow.plans.refresh import flow_from_refreshed_folder
from gateflow.plans.report import report
from gateflow.sources import workbooks
from gateflow.sources.bundle import renew_bundle, write_bundle

LAYOUTS = {
    "old": workbooks.OLD_EXPORT,
    "old-strict": workbooks.STRICT_OLD_EXPORT,
    "new": workbooks.NEW_EXPORT,
    "pre-counted": workbooks.PRECOUNTED_EXPORT,
}


def _band(text: str) -> tuple[str, int, int]:
    label, first, last = text.rsplit(":", 2)
    return label, int(first), int(last)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gateflow", description=__doc__)
    parser.add_argument("exports", help="folder with .xlsx exports")
    parser.add_argument("results", help="folder for the result tables")
    parser.add_argument("--layout", choices=LAYOUTS, default="old")
    parser.add_argument("--gates", nargs="+", default=DEFAULT_GATES)
    parser.add_argument("--sigmas", type=float, default=SIGMAS)
    parser.add_argument(
        "--bands",
        nargs="+",
        type=_band,
        default=TIME_BANDS,
        help="bands of the day as LABEL:FIRST:LAST hour",
    )
    parser.add_argument(
        "--refresh", action="store_true", help="load what changed, and renew the results"
    )
    chosen = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("gateflow").getOrCreate()
    layout, bands = LAYOUTS[chosen.layout], tuple(chosen.bands)
    loaded = f"{chosen.results}/loaded"
    if chosen.refresh:
        tables = flow_from_refreshed_folder(
            spark, chosen.exports, loaded, chosen.gates, layout, chosen.sigmas, bands
        )
        renew_bundle(
            spark, {**tables, **report(tables, layout.direction, bands)}, chosen.results
        )
        print(_files(tables["files"]), _dates(tables, layout), sep=", ")
        return
    tally = Observation()
    tables = flow_from_folder(
        spark,
        chosen.exports,
        chosen.gates,
        layout,
        loaded,
        chosen.sigmas,
        bands,
        tally,
    )
    write_bundle({**tables, **report(tables, layout.direction, bands)}, chosen.results)
    seen = tally.get
    print(
        f"{seen['rows']} rows read, {seen['untimed']} without a time, {seen['kept']} of the "
        f"gates, dates {seen['first']} to {seen['last']}, {tables['quarantine'].count()} "
        "files refused"
    )


def _files(files: DataFrame) -> str:
    found = {row["status"]: row["count"] for row in files.groupBy("status").count().collect()}
    return ", ".join(f"{found[status]} {status}" for status in sorted(found))


def _dates(tables: dict[str, DataFrame], layout: workbooks.Layout) -> str:
    dated = tables["people"] if layout.gate is None else tables["counts"]
    first, last = date_range(dated).first()
    return f"dates {first} to {last}, {tables['quarantine'].count()} files refused"


if __name__ == "__main__":
    main()
