import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def rows():
    from brute import odd_documents

    return odd_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from brute import SCHEMA

    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
