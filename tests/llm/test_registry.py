"""The registered queries, as the entry module lists them."""

import re

from __spark_entry__ import oracle_sql, queries
from compare import connect, differences
from gateflow.llm.oracles import llm_oracles
from gateflow.llm.registry import llm_queries

FOLDER = "/root/testdata/sf0.01"


def test_one_query_an_operator_and_the_pipeline():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in llm_queries())
    assert numbers == list(range(1, 14))
    assert set(llm_queries()) | {"pipeline"} <= set(queries())
    assert set(llm_oracles()) <= set(oracle_sql())


def test_queries_match_their_sql(spark):
    connection = connect(FOLDER)
    for name, sql in llm_oracles().items():
        assert differences(queries()[name](spark, FOLDER), connection.sql(sql)) is None


def test_no_other_module_imports_these():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for path in [*root.glob("gateflow/**/*.py"), root / "bench.py", root / "compare.py"]:
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
