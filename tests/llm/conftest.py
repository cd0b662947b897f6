import pytest

from sitescope.llm.common import read


@pytest.fixture(scope="session", autouse=True)
def shipped(spark, sf_dir):
    """Workers find the package wherever the tests start."""
    read(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def documents(spark):
    """A thousand documents; whole texts."""
    return read(spark, "/root/testdata/sf0.01", "documents").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
