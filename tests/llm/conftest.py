import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Rows of (doc_id, text) or (doc_id, text, source) as a documents table with odd extras."""
    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            # Names the operators use themselves.
            df = df.selectExpr(
                "*", "7 AS size", "'x' AS score", "1 AS shard", "2 AS slot", "3 AS _key",
                "4 AS _row", "5 AS copies", "6 AS row_key", "8 AS at", "9 AS tag", "10 AS spans")
        return df
    return make


@pytest.fixture()
def empty(docs):
    return docs([])
