"""Queries beside their SQL twins on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from check import compare, connect  # noqa: E402
from voltloom.plans import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
entry_module.queries()  # registers them
QUERIES, SQL = registry.QUERIES, registry.ORACLES
#: Random or iterative; tests of their properties are in test_fill.py.
WITHOUT_SQL = {
    "apply_repair", "candidate_sets", "family_ablation", "fill_method_tests", "fill_score_summary", "fill_scores", "global_importance", "physical_fit",
    "recursive_feature_ranking",
}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


# On the smallest tables the three powers of a meter are near copies, and the determinant in the SQL twin of this
# query loses the digits of R2 (two identical meters differ there). It is compared at sf0.01 by tools/check.py.
UNSTABLE_SQL = {"channel_audit"}


@pytest.mark.parametrize(
    "name",
    [pytest.param(n, marks=pytest.mark.xfail(reason="SQL twin ill-conditioned at sf0.001")) if n in UNSTABLE_SQL else n for n in sorted(QUERIES) if n in SQL],
)
def test_query(spark, duck, name):
    text, ok = compare(spark, duck, FOLDER, name, QUERIES[name], SQL.get(name))
    assert ok, text


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and df.columns
