import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Make documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        clash = "1 AS sha, 'x' AS fp, 2 AS chunk, 3 AS bucket, 4 AS component_id, 5 AS length, 6 AS rank, 7 AS spans, 8 AS node"
        return df.selectExpr("*", clash[: clash.index(",")], *clash[clash.index(",") + 2 :].split(", ")) if extra else df

    return make
