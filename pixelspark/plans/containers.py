"""Queries over codecs and containers: what comes back after a round trip is compared by its MD5."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import integer as n
from ..operators import coders, codecs, lossless
from ..operators.batches import Once
from ..session import dealt, spread
from ..sources import dng, isobmff, png, riff, tiff
from ..sources import images as files
from . import inputs as i

QUERIES: dict = {}


#: Images of a task that runs serial codecs.
IMAGES = 4096


def images(spark: SparkSession, sf_dir: str, alike: bool = False) -> DataFrame:
    """One row an image: img, raw (768 bytes of interleaved RGB) and bits (a 16 x 16 bilevel image, 32 bytes). Built
    from each part by array functions; only the parts' numbers are dealt out. ``alike``: for long work on each image,
    the images themselves are dealt out too, by content, so that what is done once a content is done in one task."""
    u = lambda p: p % 16 + F.col("img")
    v = lambda p: (p.cast("long") - p % 16) / 16 + F.col("p_size")

    def channels(p: Column) -> list[Column]:
        a, b = u(p).cast("long"), v(p).cast("long")
        return [(a * 31 + b) % 256, (b * 17).bitwiseXOR(a) % 256, (a + b) * 5 % 256]

    places = F.sequence(F.lit(0), F.lit(255))
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    raw = F.unhex(F.array_join(F.transform(places, lambda p: F.concat(*[two(x) for x in channels(p)])), ""))
    flags = F.array_join(F.transform(places, lambda p: F.when(channels(p)[0] >= 128, "1").otherwise("0")), "")
    bits = F.unhex(F.concat(*[F.lpad(F.conv(F.substring(flags, 32 * k + 1, 32), 2, 16), 8, "0") for k in range(8)]))
    parts = i.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img"), "p_size")
    if not alike:
        return spread(parts, "img").select("img", raw.alias("raw"), bits.alias("bits"))
    each = dealt(parts, None, IMAGES)
    n = max(4 * spark.sparkContext.defaultParallelism, each.rdd.getNumPartitions())
    return each.select("img", raw.alias("raw"), bits.alias("bits")).repartition(n, "raw")


_MD5 = "md5(unhex(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY p)))"
_BITS = "md5(unhex(string_agg(h, '' ORDER BY q)))"
_IMAGES = i.PIXELS + f""", rw AS (SELECT img, {_MD5} AS raw FROM px GROUP BY img), bt AS (SELECT img, {_BITS} AS bits FROM
 (SELECT img, p // 4 AS q, printf('%X', CAST(sum(CASE WHEN r >= 128 THEN 1 << (3 - p % 4) ELSE 0 END) AS INT)) AS h FROM px GROUP BY img, p // 4) GROUP BY img)"""


def byte_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir, alike=True)
    raw, bits = F.col("raw"), F.col("bits")
    back = {
        "packbits": codecs.codec("packbits", codecs.codec("packbits", raw), 768, decode=True),
        "lzw": codecs.codec("lzw", codecs.codec("lzw", raw), 768, decode=True),
        "deflate": codecs.codec("deflate", codecs.codec("deflate", raw, "best"), 768, decode=True),
        "mh": codecs.codec("mh", codecs.codec("mh", bits, 16), 16, 16, decode=True),
        "g4": codecs.codec("g4", codecs.codec("g4", bits, 16), 16, 16, decode=True),
    }
    return px.select("img", *[F.md5(x).alias(name) for name, x in back.items()])


QUERIES["byte_codecs"] = byte_codecs, f"WITH {_IMAGES} SELECT img, raw AS packbits, raw AS lzw, raw AS deflate, bits AS mh, bits AS g4 FROM rw JOIN bt USING (img)"


def _mapped(work: Callable[[bytes], bytes], data: Column) -> Column:
    """A function from bytes to bytes over a binary column, in Arrow batches."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Once(lambda raw: work(bytes(raw)))
        for part in parts:
            yield part.map(known)

    return run(data)


def _rgb(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(16, 16, 3)


def _argb(raw: bytes) -> np.ndarray:
    return np.concatenate([np.full((16, 16, 1), 255), _rgb(raw)], axis=2)


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = images(spark, sf_dir, alike=True)
    raw = F.col("raw")
    back = {
        "png": lambda x: png.decode(png.encode(_rgb(x), "rgb"))[0].tobytes(),
        "png_brute": lambda x: png.decode(png.encode(_rgb(x), "rgb", strategy="brute_force"))[0].tobytes(),
        "tiff_plain": lambda x: tiff.read_page(tiff.write_pages([_rgb(x)], big_endian=True)).tobytes(),
        "tiff_lzw": lambda x: tiff.read_page(tiff.write_pages([_rgb(x)] * 2, compression="lzw", predictor=True), 1).tobytes(),
        "tiff_packbits": lambda x: tiff.read_page(tiff.write_pages([_rgb(x)], compression="packbits", big=True, strip_bytes=100)).tobytes(),
        "webp": lambda x: lossless.read_webp(lossless.write_webp(_argb(x), colour=x[0] % 2 == 1))[..., 1:].astype(np.uint8).tobytes(),
        "range_coder": lambda x: coders.decode_bytes(coders.encode_bytes(x), 768),
        "ljpeg": lambda x: codecs.ljpeg_decode(codecs.ljpeg_encode(_rgb(x), 8)).astype(np.uint8).tobytes(),
    }
    return px.select("img", *[F.md5(_mapped(work, raw)).alias(name) for name, work in back.items()])


QUERIES["image_files"] = image_files, f"WITH {_IMAGES} SELECT img, {', '.join(f'raw AS {x}' for x in ('png', 'png_brute', 'tiff_plain', 'tiff_lzw', 'tiff_packbits', 'webp', 'range_coder', 'ljpeg'))} FROM rw"


def png_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and data chunks built by native Columns: their lengths and CRCs."""
    px = images(spark, sf_dir)
    head = png.chunk_column("IHDR", png.ihdr_column(F.lit(16), F.lit(16), 8, "rgb"))
    data = png.chunk_column("IDAT", F.col("raw"))
    return px.select("img", F.hex(head).alias("head"), F.length(data).alias("size"), F.md5(F.substring(data, 9, 768)).alias("body"))


QUERIES["png_chunks"] = png_chunks, f"WITH {_IMAGES} SELECT img, '{png.chunk(b'IHDR', bytes([0, 0, 0, 16, 0, 0, 0, 16, 8, 2, 0, 0, 0])).hex().upper()}' AS head, 780 AS size, raw AS body FROM rw"


def riff_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended containers with an odd-sized chunk, read back as chunk rows."""
    write = lambda raw: riff.assemble([("VP8X", riff.extended_header(16, 16, alpha=True)), ("ALPH", raw[1:]), ("VP8L", raw)])
    files = images(spark, sf_dir).select(F.col("img").cast("string").alias("path"), _mapped(write, F.col("raw")).alias("content"))
    found = riff.read_chunks(files, mode="failfast")
    head = riff.parse_extended(F.when(F.col("fourcc") == "VP8X", F.col("payload")))
    return found.select(F.col("path").cast("long").alias("img"), "idx", "fourcc", "size", F.md5("payload").alias("body"), head["width"].alias("width"), head["alpha"].alias("alpha"))


_HEX = "string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY p)"
QUERIES["riff_chunks"] = riff_chunks, f"""WITH {i.PIXELS}, f AS (SELECT img, {_HEX} AS h FROM px GROUP BY img)
SELECT img, k AS idx, c AS fourcc, CAST(CASE k WHEN 0 THEN 10 WHEN 1 THEN 767 ELSE 768 END AS BIGINT) AS size, md5(unhex(CASE k WHEN 0 THEN '100000000F00000F0000' WHEN 1 THEN substr(h, 3) ELSE h END)) AS body,
 CASE WHEN k = 0 THEN 16 END AS width, CASE WHEN k = 0 THEN true END AS alpha FROM f, (VALUES (0, 'VP8X'), (1, 'ALPH'), (2, 'VP8L')) t(k, c)"""


def tiff_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of two-page files as tag rows, offsets left out."""
    write = lambda raw: tiff.write_pages([_rgb(raw), _rgb(raw)[: 1 + raw[1] % 16]], big=raw[0] % 2 == 1, big_endian=raw[0] % 3 == 1)
    files = images(spark, sf_dir).select(F.col("img").cast("string").alias("path"), _mapped(write, F.col("raw")).alias("content"))
    rows = tiff.read_tags(files, mode="failfast").where(~F.col("tag").isin(273, 282, 283))
    return rows.select(F.col("path").cast("long").alias("img"), F.col("ifd").cast("int").alias("page"), "tag", "type", "count", F.element_at("ints", 1).alias("first"))


QUERIES["tiff_tags"] = tiff_tags, f"""WITH {i.PIXELS}, f AS (SELECT img, CASE WHEN pg = 0 THEN 16 ELSE 1 + g % 16 END AS h, pg FROM px, range(2) t(pg) WHERE p = 0)
SELECT img, CAST(pg AS INT) AS page, tag, type, CAST(n AS BIGINT) AS count, CAST(CASE tag WHEN 257 THEN h WHEN 278 THEN least(170, 170) WHEN 279 THEN h * 48 WHEN 297 THEN pg ELSE v END AS BIGINT) AS first
FROM f, (VALUES (254, 'long', 1, 2), (256, 'long', 1, 16), (257, 'long', 1, 0), (258, 'short', 3, 8), (259, 'short', 1, 1), (262, 'short', 1, 2), (277, 'short', 1, 3), (278, 'long', 1, 0), (279, 'long', 1, 0), (296, 'short', 1, 2), (297, 'short', 2, 0)) t(tag, type, n, v)"""


def avif_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the boxes of stills around each image's bytes."""

    @F.pandas_udf("array<struct<box:string,size:long>>")
    def walk(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda raw: [{"box": path, "size": size} for path, size, _ in isobmff.boxes(isobmff.avif_still(bytes(raw), 16, 16))])

    rows = images(spark, sf_dir).select("img", F.explode(walk("raw")).alias("x"))
    return rows.select("img", "x.*").where("box IN ('/ftyp', '/mdat', '/meta/hdlr', '/meta/iprp/ipco/ispe', '/meta/iprp/ipco/pixi', '/meta/iprp/ipco/colr')")


QUERIES["avif_boxes"] = avif_boxes, "SELECT p_partkey AS img, box, CAST(size AS BIGINT) AS size FROM part, (VALUES ('/ftyp', 32), ('/mdat', 776), ('/meta/hdlr', 33), ('/meta/iprp/ipco/ispe', 20), ('/meta/iprp/ipco/pixi', 16), ('/meta/iprp/ipco/colr', 19)) t(box, size)"


def leb128(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.integers(spark, sf_dir).select("k", F.hex(n.leb128(F.col("u") * 9999)).alias("bytes"))


QUERIES["leb128"] = leb128, f"""WITH {i.INTEGERS}, w AS (SELECT k, u * 9999 AS v, CASE WHEN u * 9999 < 128 THEN 1 WHEN u * 9999 < 16384 THEN 2 WHEN u * 9999 < 2097152 THEN 3 WHEN u * 9999 < 268435456 THEN 4 ELSE 5 END AS n FROM ints)
SELECT k, string_agg(printf('%02X', CAST((v >> (7 * j) & 127) + CASE WHEN j < n - 1 THEN 128 ELSE 0 END AS INT)), '' ORDER BY j) AS bytes FROM w, range(5) t(j) WHERE j < n GROUP BY k"""


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIFF files to each format and back to RGB: sniffed format, sides and the pixels' MD5."""
    source = images(spark, sf_dir, alike=True).select(F.col("img").cast("string").alias("path"), _mapped(lambda raw: tiff.write_pages([_rgb(raw)], compression="packbits"), F.col("raw")).alias("content"))
    there = files.encode_images(files.decode_files(source, channels=3, mode="failfast"), ("webp", "tiff", "png"))
    sniffed = there.select("path", "content", files.sniff(F.col("content")).alias("format"))
    back = files.decode_files(sniffed, channels=3, mode="failfast", keep=["format"])
    return back.select(F.col("path").cast("long").alias("img"), "format", "width", "height", "model", F.md5("data").alias("pixels"))


QUERIES["convert_images"] = conversions, f"WITH {_IMAGES} SELECT img, format, 16 AS width, 16 AS height, 'rgb' AS model, raw AS pixels FROM rw, (SELECT unnest(['webp', 'tiff', 'png']) AS format)"


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-bit mosaics as DNG files by each compression, and their samples' MD5 when read back."""

    def write(raw: bytes) -> bytes:
        x = np.frombuffer(raw, np.uint8).reshape(16, 48).astype(np.int64) * 16
        return dng.write(dng.Raw(x[:, :, None], 12, model="unit"), compression=("none", "deflate", "ljpeg")[raw[0] % 3], big_endian=raw[1] % 2 == 1)

    source = images(spark, sf_dir, alike=True).select(F.col("img").cast("string").alias("path"), _mapped(write, F.col("raw")).alias("content"))
    found = dng.read_raws(source, mode="failfast")
    return found.select(F.col("path").cast("long").alias("img"), "width", "rows", "bits", "white", "model", F.md5("samples").alias("samples"))


QUERIES["raw_files"] = raw_files, f"""WITH {i.PIXELS}, b AS (SELECT img, y * 48 + x * 3 + k AS p, CASE k WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM px, range(3) t(k))
SELECT img, 48 AS width, 16 AS rows, 12 AS bits, CAST(4095 AS BIGINT) AS white, 'unit' AS model, md5(unhex(string_agg(printf('%02X%02X', v * 16 % 256, v * 16 // 256), '' ORDER BY p))) AS samples FROM b GROUP BY img"""
