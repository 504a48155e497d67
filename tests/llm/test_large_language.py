"""Language ID with more training rows of a language than 2**23: the draw must not overflow a bigint."""

from pyspark.sql import functions as F

from marlstone.llm import hdlang


def test_prototype_of_nine_million_rows(spark):
    rows = spark.range(9_000_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"))
    assert list(hdlang.fit_prototypes(rows)) == ["en"]
