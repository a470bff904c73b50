import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(rows, extra=None):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], SCHEMA)
        for name in extra or []:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return make
