"""Image files of any known format to image rows and back: sniffing, decoding, presentation and conversion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lossless
from ..operators.batches import Once, batched
from . import dng, png, tiff

#: An image row: samples are interleaved, row-major.
IMAGE = "width int, height int, model string, channels int, bits int, data binary"


def sniff(content: Column) -> Column:
    """webp, tiff, png or dng's tiff by the first bytes of a binary column; null for anything else."""
    head = lambda at, n: F.substring(content, at, n)
    lit = lambda b: F.lit(b)
    tiffs = head(1, 4).isin(lit(b"II*\0"), lit(b"MM\0*"), lit(b"II+\0"), lit(b"MM\0+"))
    return F.when((head(1, 4) == lit(b"RIFF")) & (head(9, 4) == lit(b"WEBP")), "webp").when(tiffs, "tiff").when(head(1, 8) == lit(png.SIGNATURE), "png")


def decode(raw: bytes) -> np.ndarray:
    """Samples (rows, columns, channels) of a WebP, TIFF, DNG (its preview) or PNG file."""
    if raw[:4] == b"RIFF":
        argb = lossless.read_webp(raw)
        return argb[..., [1, 2, 3, 0]].astype(np.uint8)
    if raw[:8] == png.SIGNATURE:
        samples, chunks = png.decode(raw)
        if "PLTE" in chunks:
            table = np.frombuffer(chunks["PLTE"], np.uint8).reshape(-1, 3)
            return table[samples[..., 0]]
        return samples
    return tiff.read_page(raw)


def present(samples: np.ndarray, channels: int) -> np.ndarray:
    """Eight-bit gray, RGB or RGBA as RGB or RGBA: gray is repeated, alpha is dropped or opaque."""
    if samples.dtype != np.uint8:
        samples = (samples >> 8).astype(np.uint8)
    n = samples.shape[2]
    colour = samples[..., :3] if n >= 3 else samples[..., :1].repeat(3, axis=2)
    if channels == 3:
        return colour
    alpha = samples[..., 3:4] if n == 4 else samples[..., 1:2] if n == 2 else np.full((*samples.shape[:2], 1), 255, np.uint8)
    return np.concatenate([colour, alpha], axis=2)


def _webp(x: np.ndarray) -> bytes:
    return lossless.write_webp(present(x, 4)[..., [3, 0, 1, 2]])


ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "webp": _webp,
    "tiff": lambda x: tiff.write_pages([x if x.shape[2] in (1, 3, 4) else present(x, 4)], compression="lzw", predictor=True),
    "png": lambda x: png.encode(x, {1: "gray", 2: "gray_alpha", 3: "rgb", 4: "rgba"}[x.shape[2]]),
}


def register_encoder(name: str, encode: Callable[[np.ndarray], bytes]) -> None:
    ENCODERS[name] = encode


_MODELS = {1: "gray", 2: "gray_alpha", 3: "rgb", 4: "rgba"}


def decode_files(files: DataFrame, *, channels: int | None = 3, mode: str = "permissive", keep: Sequence[str] = ()) -> DataFrame:
    """``files`` (path, content) to image rows with path and error, and the columns ``keep`` as they are; ``channels`` 3
    or 4 presents them as RGB or RGBA, None keeps what the file has. A file that can't be decoded gives its error, or
    fails the job with ``failfast``."""

    def decoded(raw: bytes | None) -> tuple:
        try:
            x = decode(raw or b"")
            x = present(x, channels) if channels else x
            return x.shape[1], x.shape[0], _MODELS.get(x.shape[2], "other"), x.shape[2], 8 * x.dtype.itemsize, x.tobytes(), None
        except Exception as e:  # damaged files fail in as many ways as there are bytes
            if mode == "failfast":
                raise
            return *[None] * 6, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        names = ["path", "width", "height", "model", "channels", "bits", "data", "error"]
        known = Once(decoded)
        for batch in batches:
            kept = batch.schema.names[2:]
            rows = ((path.as_py(), *known(raw.as_py()), *(x.as_py() for x in more)) for path, raw, *more in zip(*batch.columns, strict=True))
            yield from batched(rows, [*names, *kept], [*types, *batch.schema.types[2:]], 6)

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema) if keep else ""
    return files.select("path", "content", *keep).mapInArrow(run, f"path string, {IMAGE}, error string{more}")


def encode_images(images: DataFrame, form: str | Sequence[str]) -> DataFrame:
    """Image rows (with path) to files: (path, format, content, raw, error), one a row and format. ``raw`` is the bytes of
    the pixels. What has no pixels, as it couldn't be decoded, or more than eight bits a sample has no content but an
    error."""
    forms = [form] if isinstance(form, str) else list(form)
    if not set(forms) <= set(ENCODERS):
        raise ValueError(f"supported formats are {', '.join(sorted(ENCODERS))}")
    works = {x: ENCODERS[x] for x in forms}

    def encoded(form: str, width: int, height: int, channels: int, bits: int, data: bytes | None, error: str | None) -> tuple:
        if data is None or bits != 8:
            return form, None, None, error or ("no pixels" if data is None else f"{bits} bits a sample have no encoder")
        try:
            return form, works[form](np.frombuffer(data, np.uint8).reshape(height, width, channels)), len(data), None
        except (KeyError, ValueError) as e:
            return form, None, len(data), f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Once(encoded)
        each = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns, strict=True))
        rows = ((path, *known(form, *rest)) for path, *rest in each for form in forms)
        yield from batched(rows, ["path", "format", "content", "raw", "error"], [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()], 2)

    error = F.col("error") if "error" in images.columns else F.lit(None).cast("string").alias("error")
    return images.select("path", "width", "height", "channels", "bits", "data", error).mapInArrow(run, "path string, format string, content binary, raw long, error string")


def convert(files: DataFrame, form: str, *, channels: int | None = 4) -> DataFrame:
    """Files to files of another format, one row each: (path, format, content, ratio of raw bytes to encoded ones,
    error). Each is decoded once; a path that occurs twice gives two rows."""
    return encode_images(decode_files(files, channels=channels), form).select("path", "format", "content", (F.col("raw") / F.length("content")).alias("ratio"), "error")


def read_images(spark: SparkSession, path: str, *, channels: int | None = 3, mode: str = "permissive", pattern: str = "*") -> DataFrame:
    """Image rows of all files below a path that Spark can read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return decode_files(files, channels=channels, mode=mode)


def raw_rows(files: DataFrame) -> DataFrame:
    """Raw images of DNG files; see ``dng.read_raws``."""
    return dng.read_raws(files)
