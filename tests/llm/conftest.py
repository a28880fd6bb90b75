import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def documents(spark):
    """Rows of documents from texts, or from (doc_id, text[, lang, source]) tuples."""

    def make(rows, extra=False):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            row = (*row, *("en", "s")[len(row) - 2 :]) if len(row) < 4 else row
            full.append((*row, len(row[1] or "")))
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            import pyspark.sql.functions as F

            clashing = ["n", "words", "part", "file", "fingerprint", "start", "_row", "key", "Spans"]
            df = df.withColumns({c: F.lit("x") for c in clashing})
        return df

    return make
