"""The scalar functions under SQL names. Those that are plain expressions are SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import codecs

# Name: (parameters, result type, body).
FUNCTIONS = {
    "srgb_eotf": ("x DOUBLE", "DOUBLE", "CASE WHEN x <= 0.04045D THEN x / 12.92D ELSE pow((x + 0.055D) / 1.055D, 2.4D) END"),
    "srgb_oetf": ("x DOUBLE", "DOUBLE", "CASE WHEN x <= 0.0031308D THEN 12.92D * x ELSE 1.055D * pow(x, 1 / 2.4D) - 0.055D END"),
    "reinhard": ("x FLOAT", "FLOAT", "CAST(x / (1 + x) AS FLOAT)"),
    "round2": ("x BIGINT, n INT", "BIGINT", "CASE WHEN n = 0 THEN x ELSE shiftright(x + shiftleft(1L, n - 1), n) END"),
    "round_div_nearest": ("num BIGINT, den BIGINT", "BIGINT", "CASE WHEN num >= 0 THEN (num + den div 2) div den ELSE -((-num + den div 2) div den) END"),
    "wrap8": ("x BIGINT", "BIGINT", "pmod(x, 256)"),
    "paeth": ("a INT, b INT, c INT", "INT", "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END"),
    "clip8": ("x BIGINT", "INT", "CAST(greatest(least(x, 255), 0) AS INT)"),
    "mu_compress": ("v DOUBLE, mu DOUBLE", "DOUBLE", "signum(v) * ln(1 + mu * least(abs(v), 1D)) / ln(1 + mu)"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers them as temporary functions, and the codecs as ``<name>_encode(binary)``; returns the names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    names = list(FUNCTIONS)
    for name, work in (("packbits", codecs.packbits_encode), ("lzw", codecs.lzw_encode), ("deflate", codecs.deflate)):
        spark.udf.register(f"{name}_encode", lambda raw, work=work: None if raw is None else work(bytes(raw)), "binary")
        names.append(f"{name}_encode")
    return names
