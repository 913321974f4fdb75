import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text[, lang[, source]]) with one more column, whose name clashes with inner ones."""

    def make(*rows):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "web", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for extra in ("id", "digest", "size", "fp", "path", "place", "rows"):
            df = df.withColumn(extra, F.lit("x"))
        return df

    return make
