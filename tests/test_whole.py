import zlib
from collections import Counter

from pixelspark.operators import blocks as b
from pixelspark.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_image_and_line_item(spark):
    queries = registry.queries()
    images = spark.read.parquet(f"{SF}/part.parquet").count()
    assert queries["predictor_modes"](spark, SF).count() == images * 4
    assert queries["colour_transform"](spark, SF).count() == images * 256
    assert queries["color_space_clamp"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_every_image_has_its_palette_and_bundles(spark):
    queries = registry.queries()
    sizes = {r.img: r["count"] for r in queries["palette"](spark, SF).groupBy("img").count().collect()}
    assert len(sizes) == spark.read.parquet(f"{SF}/part.parquet").count() and max(sizes.values()) > 16
    rows = {r.img: (r.bits, r["count"]) for r in queries["palette_bundles"](spark, SF).groupBy("img", "bits").count().collect()}
    bits = {k: next(w for w in (1, 2, 4, 8) if n <= 1 << w) for k, n in sizes.items()}
    assert rows == {k: (w, 256 * w // 8) for k, w in bits.items()}


def test_bundles_of_each_width(spark):
    images = [(k, p, p % n) for k, n in enumerate((2, 4, 16, 17)) for p in range(20)]
    px = spark.createDataFrame(images, "img int, p int, colour int")
    known = b.palette(px)
    found = {(r.img, r.y, r.byte): r.v for r in b.bundle_palettes(b.to_indices(px, known), known, 20).collect()}
    want = {}
    for k, p, idx in images:
        w = (1, 2, 4, 8)[k]
        at = (k, 0, p * w // 8)
        want[at] = want.get(at, 0) | idx << p * w % 8
    assert found == want


def test_every_block_of_a_vector(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    values = vectors.selectExpr("sum(size(embedding))").first()[0]
    for name in ("walsh_hadamard", "integer_dct", "vp8_transforms"):
        assert registry.queries()[name](spark, SF).select("vec_id", "block").distinct().count() * 16 == values


def test_every_byte_of_a_document(spark):
    queries = registry.queries()
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.id: (r.n, r.adler) for r in queries["adler32"](spark, SF).collect()} == {k: (len(x), zlib.adler32(x)) for k, x in texts.items()}
    assert {r.id: r.crc for r in queries["crc32"](spark, SF).collect()} == {k: zlib.crc32(x) for k, x in texts.items()}
    assert {(r.id, r.v): r.n for r in queries["byte_histogram"](spark, SF).collect()} == {(k, v): n for k, x in texts.items() for v, n in Counter(x).items()}
