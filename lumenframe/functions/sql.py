"""The scalar helpers and the voxel view as SQL functions of a session, written in SQL: Spark folds them into the query."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "hu_density": "(hu DOUBLE) RETURNS DOUBLE RETURN CASE WHEN hu <= 0 THEN greatest(0.01D, 1 + 0.001D * hu) ELSE 1 + 0.0007D * hu END",
    "tm_seconds": r"""(tm STRING) RETURNS DOUBLE RETURN CASE WHEN tm RLIKE '^\\s*\\d{2}(\\d{2}(\\d{2}(\\.\\d*)?)?)?\\s*$' THEN
        try_cast(substr(trim(tm), 1, 2) AS DOUBLE) * 3600 + coalesce(try_cast(substr(trim(tm), 3, 2) AS DOUBLE), 0) * 60 + coalesce(try_cast(substr(trim(tm), 5, 2) AS DOUBLE), 0)
        + coalesce(try_cast(concat('0.', rpad(substr(regexp_extract(trim(tm), '\\.(\\d*)$', 1), 1, 9), 9, '0')) AS DOUBLE), 0) END""",
    "suv_factor": """(weight_kg DOUBLE, dose DOUBLE, half_life DOUBLE, start STRING, scan STRING) RETURNS DOUBLE RETURN
        CASE WHEN dose * exp(-ln(2D) * pmod(tm_seconds(scan) - tm_seconds(start), 86400D) / nullif(half_life, 0D)) > 0
        THEN weight_kg * 1000 / (dose * exp(-ln(2D) * pmod(tm_seconds(scan) - tm_seconds(start), 86400D) / nullif(half_life, 0D))) END""",
    "mi_voxels": """(voxels ARRAY<FLOAT>, dims ARRAY<INT>) RETURNS TABLE(x INT, y INT, z INT, value FLOAT) RETURN
        SELECT p.f % dims[0] + 1, CAST(p.f DIV dims[0] AS INT) % dims[1] + 1, CAST(p.f DIV (dims[0] * dims[1]) AS INT) + 1, p.v FROM posexplode(voxels) AS p(f, v)""",
}


def register(spark: SparkSession) -> None:
    """Create hu_density, tm_seconds, suv_factor and the table function mi_voxels (for LATERAL) in this session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
