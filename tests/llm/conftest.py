import os

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.cairn.pii.key", "cairn")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


def docs_of(spark, texts, sources=None, extra=False):
    """A documents table with ids 0.. (an explicit (id, text) pair sets the id)."""
    rows = []
    for i, t in enumerate(texts):
        d, t = t if isinstance(t, tuple) else (i, t)
        rows.append((d, t, "en", sources[i] if sources else "s", len(t or ""), "x") if extra else (d, t, "en", sources[i] if sources else "s", len(t or "")))
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", size string" if extra else "")
    return spark.createDataFrame(rows, schema)
