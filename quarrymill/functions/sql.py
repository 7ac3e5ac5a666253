"""The engine's identities and scalars as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result and body of each function.
FUNCTIONS = {
    "content_id": ("text STRING", "STRING", "concat('rec_', substring(sha2(text, 256), 1, 20))"),
    "canonical_text": ("text STRING", "STRING", r"trim(regexp_replace(lower(text), '\\s+', ' '))"),
    "split_unit": ("seed INT, grouping STRING", "DOUBLE", "cast(conv(substring(sha2(concat_ws(':', seed, grouping), 256), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D"),
    "sample_order": ("seed INT, id STRING", "STRING", "sha2(concat_ws(':', seed, id), 256)"),
    "logistic_score": ("value DOUBLE", "DOUBLE", "1 / (1 + exp(-greatest(-60.0D, least(60.0D, value / 256.0D))))"),
    "rating_score": ("value DOUBLE", "DOUBLE", "1 / (1 + pow(10.0D, -value / 400.0D))"),
    "point_of_view": ("value DOUBLE, side STRING", "DOUBLE", "CASE WHEN side = 'b' THEN -value ELSE value END"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates them as temporary functions of the session; gives back their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
