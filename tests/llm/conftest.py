import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import DOCS, SMALL, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    from voltloom.llm.frame import ready

    ready(spark)
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(i, i % 3 and 1, i % 4 == 0 and 1 or 0) for i in range(1, 16)] + [(None, 1, 1), (3, None, None), (2, 0, 1)]
    return spark.createDataFrame([(a, b, c, "t") for a, b, c in rows], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="session")
def small_docs(spark):
    from voltloom.llm.frame import table

    return table(spark, SMALL, "documents")
