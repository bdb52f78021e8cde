"""Dimension tables: code points, layouts, field types and limits, each a small table that joins by code or name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import color
from ..sources import png, riff, tiff

# CICP code points, pixel layouts (bits, channels, model) and chroma subsamplings (x, y shifts).
CICP = [("matrix", "identity", 0), ("matrix", "bt709", 1), ("matrix", "unspecified", 2), ("matrix", "bt601", 6), ("matrix", "ycgco", 8), ("matrix", "bt2020_ncl", 9), ("primaries", "bt709", 1), ("primaries", "unspecified", 2), ("primaries", "bt601_pal", 5), ("primaries", "smpte170m", 6), ("primaries", "bt2020", 9), ("primaries", "display_p3", 12), ("transfer", "bt709", 1), ("transfer", "unspecified", 2), ("transfer", "srgb", 13), ("transfer", "bt2020_10", 14), ("transfer", "pq", 16), ("transfer", "hlg", 18), ("range", "limited", 0), ("range", "full", 1)]
LAYOUTS = [("Gray8", 8, 1, "gray"), ("Bilevel", 1, 1, "bilevel"), ("Indexed8", 8, 1, "palette"), ("Rgb8", 8, 3, "rgb"), ("Rgba8", 8, 4, "rgba"), ("Cmyk8", 8, 4, "cmyk"), ("GrayAlpha8", 8, 2, "gray_alpha"), ("Gray16", 16, 1, "gray"), ("Rgb16", 16, 3, "rgb"), ("Rgba16", 16, 4, "rgba"), ("GrayAlpha16", 16, 2, "gray_alpha")]
SUBSAMPLINGS = [("444", 0, 0), ("422", 1, 0), ("420", 1, 1), ("400", 0, 0)]

_TABLES: dict[str, tuple[list[tuple], str]] = {
    "catalog_cicp": (CICP, "kind string, name string, code int"),
    "catalog_pixel_layouts": (LAYOUTS, "name string, bits int, channels int, model string"),
    "catalog_subsampling": (SUBSAMPLINGS, "name string, sx int, sy int"),
    "catalog_field_types": ([(c, n, s) for c, (n, s, _) in tiff.TYPES.items()], "code int, name string, bytes int"),
    "catalog_compressions": (list(tiff.COMPRESSIONS.items()), "code int, name string"),
    "catalog_photometrics": (list(tiff.PHOTOMETRICS.items()), "code int, name string"),
    "catalog_png_colours": ([(c, n, k, d) for n, (c, k, depths) in png.COLOURS.items() for d in depths], "code int, name string, channels int, depth int"),
    "catalog_webp_chunks": (list(riff.KINDS.items()), "fourcc string, kind string"),
    "catalog_profiles": (list(color.PROFILES), "name string, space string, transfer string, primaries int, code int, white double"),
}


def _values(rows: list[tuple], schema: str) -> str:
    types = {"string": "VARCHAR", "int": "INT", "double": "DOUBLE"}
    names = [x.split() for x in schema.split(", ")]
    cell = lambda v: "NULL" if v is None else repr(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {types[t]}) AS {n}' for n, t in names)} FROM (VALUES {body}) t({', '.join(n for n, _ in names)})"


def _query(rows: list[tuple], schema: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    return query


QUERIES = {name: (_query(*spec), _values(*spec)) for name, spec in _TABLES.items()}
