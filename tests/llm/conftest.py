import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return brute.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return brute.frame(spark, rows)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def real_rows(real):
    return [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
