import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.sources import isobmff, png, riff, tiff
from pixelspark.streaming import files


def image(rows, width, parts, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (rows, width, parts)).astype(np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (2, 2), (3, 7), (17, 13), (64, 100)])
@pytest.mark.parametrize("compression,predictor", [("none", False), ("packbits", False), ("lzw", False), ("lzw", True), ("deflate", True)])
def test_tiff_round_trips(size, compression, predictor):
    for parts, big, endian in ((1, False, False), (3, True, True), (4, False, True)):
        pages = [image(*size, parts), image(*size, parts, 2)]
        raw = tiff.write_pages(pages, compression=compression, predictor=predictor, big=big, big_endian=endian, strip_bytes=500)
        for k, page in enumerate(pages):
            assert (tiff.read_page(raw, k) == page).all()
    with pytest.raises(ValueError):
        tiff.read_page(raw, 2)


@pytest.mark.parametrize("compression", ["mh", "g4"])
def test_bilevel_tiff(compression):
    page = (image(21, 37, 1) > 128).astype(np.uint8)
    assert (tiff.read_page(tiff.write_pages([page], compression=compression)) == page).all()


def test_malformed_tiffs_raise():
    raw = tiff.write_pages([image(8, 8, 3)], compression="lzw")
    rng = random.Random(3)
    for cut in range(len(raw)):
        _value_error_or_fine(raw[:cut])
    for _ in range(400):
        bad = bytearray(raw)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        _value_error_or_fine(bytes(bad))


def _value_error_or_fine(raw):
    try:
        tiff.read_page(raw)
    except ValueError:
        pass


def test_loops_of_directories_end():
    raw = bytearray(tiff.write_pages([image(2, 2, 1)]))
    at = tiff.Reader(bytes(raw)).first
    count = int.from_bytes(raw[at : at + 2], "little")
    raw[at + 2 + 12 * count : at + 6 + 12 * count] = at.to_bytes(4, "little")
    with pytest.raises(ValueError, match="loop"):
        list(tiff.Reader(bytes(raw)).directories())


@pytest.mark.parametrize("colour,depth,parts", [("gray", 8, 1), ("gray", 1, 1), ("gray", 4, 1), ("gray", 16, 1), ("rgb", 8, 3), ("rgb", 16, 3), ("rgba", 8, 4), ("gray_alpha", 8, 2), ("palette", 2, 1)])
def test_png_round_trips(colour, depth, parts):
    samples = np.random.default_rng(depth).integers(0, 1 << depth, (13, 17, parts))
    for strategy in ("min_sum_abs", "brute_force", "0", "4"):
        back, _ = png.decode(png.encode(samples, colour, depth=depth, strategy=strategy, palette=bytes(12) if colour == "palette" else b""))
        assert (back == samples).all()
    smooth = np.add.outer(np.arange(48), np.arange(48))[:, :, None].repeat(3, axis=2) % 256
    assert len(png.encode(smooth, "rgb", strategy="brute_force")) <= len(png.encode(smooth, "rgb"))
    with pytest.raises(ValueError):
        png.encode(samples, "rgb" if parts != 3 else "gray", depth=depth)


def test_spark_reads_our_png(spark, tmp_path):
    samples = image(5, 4, 3)
    (tmp_path / "a.png").write_bytes(png.encode(samples, "rgb", extra=[png.text("Title", "x"), png.gamma(0.45455), png.srgb(), png.physical(2835, 2835), png.time(2020, 1, 2)]))
    row = spark.read.format("image").load(f"file://{tmp_path}/a.png").select("image.*").first()
    got = np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, 3)[:, :, ::-1]
    assert (got == samples).all()


def test_native_png_chunks(spark):
    data = F.lit(b"some data")
    assert bytes(spark.range(1).select(png.chunk_column("IDAT", data)).first()[0]) == png.chunk(b"IDAT", b"some data")
    assert bytes(spark.range(1).select(png.chunk_column("IEND", F.lit(b""))).first()[0])[-4:].hex() == "ae426082"
    with pytest.raises(ValueError):
        png.ihdr_column(F.lit(1), F.lit(1), 4, "rgb")


def test_riff(spark):
    good = riff.assemble([("VP8X", riff.extended_header(300, 2, alpha=True, exif=True)), ("XMP ", b"abc")])
    rows = spark.createDataFrame([("a", good), ("b", b"RIFFxx"), ("c", good[:-1]), ("d", None), ("e", good[:20])], "path string, content binary")
    found = riff.read_chunks(rows).orderBy("path", "idx").collect()
    assert [(r.path, r.fourcc, r.size) for r in found if r.error is None] == [("a", "VP8X", 10), ("a", "XMP ", 3)]
    assert {r.path for r in found if r.error} == {"b", "c", "d", "e"}
    head = riff.read_chunks(rows).where("fourcc = 'VP8X'").select(riff.parse_extended(F.col("payload")).alias("h")).first().h
    assert (head.width, head.height, head.alpha, head.exif, head.icc) == (300, 2, True, True, False)
    with pytest.raises(Exception, match="RIFF"):
        riff.read_chunks(rows, mode="failfast").collect()


def test_tag_rows(spark):
    raw = tiff.write_pages([image(3, 5, 3)], big=True)
    rows = spark.createDataFrame([("a", raw), ("b", b"II*\0")], "path string, content binary")
    found = tiff.read_tags(rows).collect()
    tags = {r.tag: r for r in found if r.path == "a"}
    assert tags[256].ints == [5] and tags[258].ints == [8, 8, 8] and tags[282].rationals[0].num == 72 and tags[258].type == "short"
    assert [r.error is not None for r in found if r.path == "b"] == [True]


def test_avif_boxes():
    raw = isobmff.avif_still(b"payload", 640, 480, rotation=1, mirror=0)
    found = {p: x for p, _, x in isobmff.boxes(raw)}
    place = int.from_bytes(found["/meta/iloc"][-8:-4], "big")
    assert raw[place : place + 7] == b"payload" and found["/mdat"] == b"payload"
    assert found["/meta/iprp/ipco/irot"] == b"\x01" and found["/meta/iprp/ipco/imir"] == b"\x00"
    assert found["/meta/iprp/ipma"][-7:] == bytes([6, 0x81, 2, 3, 4, 0x85, 0x86])
    with pytest.raises(ValueError):
        list(isobmff.boxes(raw[:-1]))


def test_stream_of_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.tif").write_bytes(tiff.write_pages([image(2, 2 + k, 1)]))
    work = lambda df: tiff.read_tags(df).where("tag = 256").select("path", F.element_at("ints", 1).alias("width"))
    out = f"file://{tmp_path}/out"
    for extra in (None, "3.tif"):
        if extra:
            (source / extra).write_bytes(tiff.write_pages([image(2, 9, 1)]))
        files.run_to_table(files.file_stream(spark, f"file://{source}", pattern="*.tif"), work, out, f"file://{tmp_path}/state").awaitTermination()
    got = sorted(r.width for r in spark.read.parquet(out).collect())
    assert got == [2, 3, 4, 9]
    batch = work(spark.read.format("binaryFile").load(f"file://{source}"))
    assert sorted(r.width for r in batch.collect()) == got


def test_png_ancillary_chunks():
    extra = [png.text("A", "é"), png.text("B", "x" * 50, compressed=True), png.text("C", "Ж"), png.gamma(0.5), png.chromaticities((0.3127, 0.329), (0.64, 0.33), (0.3, 0.6), (0.15, 0.06)), png.significant_bits(8, 8, 8), png.background(1, 2, 3), png.icc_profile("p", b"profile"), png.exif(b"II*"), png.xmp("<x/>")]
    raw = png.encode(image(2, 2, 3), "rgb", extra=extra)
    _, chunks = png.decode(raw)
    assert chunks["gAMA"] == (50_000).to_bytes(4, "big") and chunks["tEXt"] == b"A\0\xe9" and len(chunks["cHRM"]) == 32 and chunks["bKGD"] == bytes([0, 1, 0, 2, 0, 3])
    assert raw.index(b"iCCP") < raw.index(b"tEXt") < raw.index(b"IDAT") and b"XML:com.adobe.xmp" in chunks["iTXt"]
    with pytest.raises(ValueError):
        png.text("", "x")


def test_tiles_palettes_and_inks():
    for parts, size in ((1, (33, 50)), (3, (16, 16)), (4, (40, 17))):
        page = image(*size, parts)
        for compression in ("none", "lzw", "packbits"):
            assert (tiff.read_page(tiff.write_pages([page], compression=compression, tile=(16, 32), predictor=compression == "lzw")) == page).all()
    table, indices = image(1, 200, 3)[0], image(9, 9, 1) % 200
    assert (tiff.read_page(tiff.write_pages([indices], palette=table)) == table[indices[..., 0]]).all()
    inks = image(6, 5, 4)
    raw = tiff.write_pages([inks], cmyk=True)
    assert (tiff.read_page(raw) == inks).all() and dict(tiff.Reader(raw).directories())["0"][262][1] == [5]
    with pytest.raises(ValueError):
        tiff.write_pages([inks], tile=(10, 16))


def test_stream_headers_as_columns(spark):
    from pixelspark.operators import lossless

    stream = lossless.encode(np.full((7, 300, 4), 9))
    frame = (0 | 2 << 1 | 1 << 4 | 777 << 5).to_bytes(3, "little") + b"\x9d\x01\x2a" + (640 | 1 << 14).to_bytes(2, "little") + (480).to_bytes(2, "little")
    rows = spark.createDataFrame([(1, stream, frame), (2, b"", b""), (3, b"\x2e1234", frame[:3] + b"abc" + frame[6:]), (4, None, None)], "k int, a binary, b binary")
    got = {r.k: r for r in rows.select("k", riff.parse_lossless(F.col("a")).alias("a"), riff.parse_lossy(F.col("b")).alias("b")).collect()}
    assert tuple(got[1].a) == (300, 7, True, 0) and tuple(got[1].b) == (640, 480, 1, 0, 2, True, 777)
    assert all(got[k].a is None and got[k].b is None for k in (2, 3, 4))
