"""Entities met by names that many rows have."""

from pyspark.sql import functions as F

from kgspark.operators.build import resolve_entities


def test_entities_of_one_name_are_not_paired(spark):
    """Joined row by row these would be 4e10 rows."""
    many = spark.range(200_000)
    new = many.select(F.lit("one").alias("name"), F.array(F.lit("other")).alias("aliases"))
    old = many.select(F.format_string("e%06d", "id").alias("entity_id"), F.lit("other").alias("name"), F.lit(None).cast("array<string>").alias("aliases"))
    assert [tuple(r) for r in resolve_entities(new, old).collect()] == [("one", "e000000", False)]
