"""Plan checks: Python runs only where it is the
feature (MIME parsing, the user scorer hook), and no query plans a cartesian
product or a nested-loop join."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark.plans import catalog  # noqa: E402

from .conftest import SF  # noqa: E402

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF",
                "MapInArrow")
PYTHON_ALLOWED = {"ingest_messages", "mail_body_select", "ingest_with_deadletter", "score_hook", "score_hook_isolated"}
catalog.load_all()
BAD_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan_shape(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    if name not in PYTHON_ALLOWED:
        assert not any(n in plan for n in PYTHON_NODES), f"{name}: Python node in plan"
    assert not any(n in plan for n in BAD_JOINS), f"{name}: cross or nested-loop join"


@pytest.mark.parametrize("name", ["parse_dates", "drop_bad_dates", "newest_first", "date_range"])
def test_header_dates_are_parsed_once(spark, name):
    from tallyspark.functions import dates
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("gettimestamp(") == len(dates.INSTANT_FORMATS) + len(dates.WALL_FORMATS)


def test_candidate_search_reads_its_matches_back(spark):
    plan = _plan(catalog.QUERIES["candidate_messages"](spark, SF))
    assert "contains" not in plan.lower() and "orders.parquet" not in plan


def test_no_collect_in_library():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tallyspark")
    for d, _, files in os.walk(root):
        if os.path.basename(d) == "llm":      # its bounded collects have tests of their own
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(d, f), encoding="utf-8").read()
                assert ".collect()" not in text and ".toPandas()" not in text, f
