import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents table from (doc_id, text) or (doc_id, text, lang, source), with columns whose names operators use inside."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("score", "kept", "label", "hash", "node", "size", "run", "ids", "y", "h", "t"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
