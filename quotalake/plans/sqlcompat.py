"""Run usage SQL written for the log's query engine directly on Spark.

``register_sql_functions`` adds the two dialect functions such queries use
as temporary SQL functions, so they are inlined by Catalyst (no Python):

* ``json_extract_scalar(json, path)``: scalar at ``path`` as text, NULL
  for objects, arrays, JSON null and malformed text;
* ``from_iso8601_timestamp(text)``: ISO-8601 text (``Z``, ``+hh:mm`` or no
  zone) as a UTC ``TIMESTAMP_NTZ``.

``register_invocations_view`` exposes raw log records under the flat
column names of the log table (``timestamp``, ``accountid``, ``requestid``,
``modelid``, ``requestmetadata``, ``usage``, ``error``).  Everything else
the queries use (``CAST``, ``date_trunc``, ``interval``, ``COUNT(DISTINCT)``,
``ROUND``, ``ORDER BY``/``LIMIT``) is plain Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_JSON_EXTRACT_SCALAR = r"""
CREATE OR REPLACE TEMPORARY FUNCTION json_extract_scalar(j STRING, p STRING) RETURNS STRING
RETURN CASE
  WHEN startswith(schema_of_variant(try_variant_get(try_parse_json(j), p, 'variant')), 'OBJECT')
    OR startswith(schema_of_variant(try_variant_get(try_parse_json(j), p, 'variant')), 'ARRAY') THEN NULL
  ELSE try_variant_get(try_parse_json(j), p, 'string')
END
"""

_LOCAL = r"^(\\d{4}-\\d{2}-\\d{2}(?:[T ]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d{1,9})?)?)?)"
_OFFSET = r"[T ].*([+-])(\\d{2}):?(\\d{2})$"

_FROM_ISO8601 = rf"""
CREATE OR REPLACE TEMPORARY FUNCTION from_iso8601_timestamp(s STRING) RETURNS TIMESTAMP_NTZ
RETURN CASE
  WHEN endswith(s, 'Z') AND length(s) >= 20 AND substring(s, 11, 1) = 'T'
    THEN try_cast(concat(substring(s, 1, 10), ' ', substring(s, 12, length(s) - 12)) AS TIMESTAMP_NTZ)
  ELSE timestampadd(MINUTE,
    -(CASE regexp_extract(s, '{_OFFSET}', 1) WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END)
      * coalesce(try_cast(regexp_extract(s, '{_OFFSET}', 2) AS INT) * 60
                 + try_cast(regexp_extract(s, '{_OFFSET}', 3) AS INT), 0),
    try_cast(nullif(replace(regexp_extract(s, '{_LOCAL}', 1), 'T', ' '), '') AS TIMESTAMP_NTZ))
END
"""


def register_sql_functions(spark: SparkSession) -> None:
    """Create the dialect functions for this session."""
    spark.sql(_JSON_EXTRACT_SCALAR)
    spark.sql(_FROM_ISO8601)


def register_invocations_view(spark: SparkSession, raw: DataFrame, name: str = "invocations") -> None:
    """Expose raw log records (``schema.INVOCATION_LOG`` columns) as a SQL view."""
    register_sql_functions(spark)
    raw.createOrReplaceTempView(name)
