import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark, tmp_path):
    """Documents read from files, with columns whose names clash with those of results."""
    made = []

    def make(rows, **extra):
        rows = [(*r, "en", f"src{i % 3}", len(r[1] or "")) if len(r) == 2 else r for i, r in enumerate(rows)]
        df = spark.createDataFrame(rows, DOCS)
        for c in ("score", "kept", "digest", "size", "key", "label"):
            df = df.withColumn(c, F.lit("clash"))
        path = str(tmp_path / f"docs{len(made)}")
        made.append(path)
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
