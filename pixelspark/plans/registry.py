"""All registered queries but those of the corpus operators."""

from __future__ import annotations

from . import catalog, colour, containers, images, signal, video

_PARTS = (colour, signal, images, containers, video, catalog)
#: Places and indices that are INT here, where the ranges of SQL are BIGINT.
_INT = {
    "color_ycbcr": "p", "mulaw": "i", "tiff_predictor": "p", "run_lengths": "start", "changing_elements": "x b1", "rgb_from_420": "x y", "palette": "idx",
    "subtract_green": "p", "colour_transform": "p", "coefficient_scan": "place col", "colour_cache": "p", "modal_groups": "grp",
}


def _typed(name: str, sql: str) -> str:
    columns = _INT.get(name, "").split()
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INT) AS {c}' for c in columns)}) FROM ({sql})" if columns else sql


def queries() -> dict:
    return {name: query for part in _PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _typed(name, sql) for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
