import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of (id, text) pairs, or of (id, text, lang) triples, as documents."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for c in filter(None, extra.split(",")):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("kept"))
        return df

    return make
