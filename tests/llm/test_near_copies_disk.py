"""What near copies move between tasks: texts that are looked for, and narrow rows."""

from pyspark.sql import functions as F

from quillsift.llm import near_copies


def test_few_texts_are_shuffled(spark):
    """All wanted rows stay, and hardly any other, whatever the signs of the hashes."""
    rows = spark.range(20000).select(F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("text"))
    wanted = rows.filter("cast(text AS long) % 100 = 0").select("h")
    kept = near_copies._among(rows, wanted)
    assert kept.join(wanted, "h").count() == 200
    assert kept.count() < 220
    assert near_copies._among(rows, wanted.limit(0)).count() == 0
