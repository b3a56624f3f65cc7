import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm_spark(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


@pytest.fixture(scope="session")
def docs_of(llm_spark):
    """Documents from (id, text) pairs, with an extra column of a clashing name."""
    def make(rows, schema=DOCS):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return llm_spark.createDataFrame(full, schema)
    return make
