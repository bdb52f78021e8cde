"""What must not grow with the tables: rows of a task, shuffles of pixels, joins whose size Spark misjudges."""

import pytest

from pixelspark.plans import inputs, registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_images_are_dealt_out_before_they_become_pixels(spark, monkeypatch):
    monkeypatch.setattr(inputs, "IMAGES", 10)
    images = spark.read.parquet(f"{SF}/part.parquet").count()
    for key in ("img", None):
        px = inputs.pixels(spark, SF, key)
        assert px.rdd.getNumPartitions() == -(-images // 10)
        most = px.groupBy("img").count().select("count").distinct().collect()
        assert [r[0] for r in most] == [256]


@pytest.mark.parametrize("name", ["palette", "image_reduction", "colour_cache", "raw_preview", "linear_preview", "block_directions", "modal_groups", "pack_scanlines", "palette_bundles", "block_mode_choice", "colour_transform", "rgb_from_420", "identity_planes", "downscaled_rows"])
def test_pixels_are_neither_shuffled_nor_joined(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "Join" not in text and text.count("Exchange") == 1
    assert text.index("Generate") < text.index("Exchange")  # a plan is printed from its last step


def test_blocks_at_ragged_edges(spark):
    """Sides that blocks don't divide, against sums over a plain grid."""
    from pixelspark.operators import blocks as b

    width, rows, size = 10, 7, 4
    v = {(x, y): (37 * x * x + 91 * y + 13 * x * y) % 256 for x in range(width) for y in range(rows)}
    df = spark.createDataFrame([(1, y * width + x, c) for (x, y), c in v.items()], "img int, p int, v int")
    found = {(r.bx, r.by): (r.dc, r.sad0, r.sad1, r.sad2, r.sad3, r["mode"]) for r in b.block_sad(df, width, size).collect()}
    want = {}
    for bx in range(3):
        for by in range(2):
            cells = [(x, y) for x, y in v if x // size == bx and y // size == by]
            edge = [v[x, by * size - 1] for x in range(bx * size, min(bx * size + size, width)) if by] + [v[bx * size - 1, y] for y in range(by * size, min(by * size + size, rows)) if bx]
            dc = (sum(edge) + len(edge) // 2) // len(edge) if edge else 128
            top = lambda x: v[x, by * size - 1] if by else 127  # noqa: E731, B023
            left = lambda y: v[bx * size - 1, y] if bx else 129  # noqa: E731, B023
            corner = v[bx * size - 1, by * size - 1] if bx and by else 127 if not by else 129
            guess = [lambda x, y: dc, lambda x, y: top(x), lambda x, y: left(y), lambda x, y: max(min(left(y) + top(x) - corner, 255), 0)]  # noqa: B023
            sads = [sum(abs(v[c] - g(*c)) for c in cells) for g in guess]
            want[bx, by] = (dc, *sads, sads.index(min(sads)))
    assert found == want


def test_boxes_of_any_two_widths(spark):
    from pixelspark.operators import video

    for width, target in ((16, 11), (7, 7), (9, 2), (3, 8)):
        df = spark.createDataFrame([(1, x, x * x) for x in range(width)], "img int, p int, v int")
        found = {r.x: r.v for r in video.downscale_rows(df, width, target).collect()}
        boxes = {b: [x * x for x in range(b * width // target, (b + 1) * width // target)] for b in range(target)}
        assert found == {b: sum(xs) // len(xs) for b, xs in boxes.items() if xs}


def test_code_of_the_largest_forward_transform_is_small(spark):
    """Written out, its 4096 products took the compiler more than 2 GB."""
    from pyspark.sql import functions as F

    from pixelspark.functions import transforms as t

    names = [f"v{k:02d}" for k in range(64)]
    found = t.forward_columns(spark.range(3).select(*[(F.col("id") + k).alias(x) for k, x in enumerate(names)]), names, "dct", 6)
    code = found._jdf.queryExecution().debug().codegenToSeq()
    assert max(len(code.apply(k)._2()) for k in range(code.length())) < 200_000


def test_alike_inputs_are_worked_once_within_bounds():
    from pixelspark.operators.batches import Once

    calls = []
    once = Once(lambda raw, k: calls.append(raw) or raw * k, most=2000)
    assert [once(x, 2) for x in (b"a", b"b", b"a", b"b")] == [b"aa", b"bb", b"aa", b"bb"] and calls == [b"a", b"b"]
    for k in range(300):
        assert once(bytes([k % 256]) * 40, 3) == bytes([k % 256]) * 120
        assert once.size <= 2000 and len(once.known) <= 7
    assert once(b"x" * 5000, 1) == b"x" * 5000 and (b"x" * 5000, 1) not in once.known


def test_a_converted_path_that_occurs_twice_gives_two_rows(spark):
    import numpy as np

    from pixelspark.sources import images, tiff

    raws = [tiff.write_pages([np.full((2, 3, 3), k, np.uint8)]) for k in (1, 2)]
    source = spark.createDataFrame([("x", r) for r in raws], "path string, content binary")
    there = images.encode_images(images.decode_files(source), ("png", "tiff"))
    back = images.decode_files(there, keep=["format"])
    assert sorted((r.format, bytes(r.data)[0], r.width) for r in back.collect()) == [("png", 1, 3), ("png", 2, 3), ("tiff", 1, 3), ("tiff", 2, 3)]


def test_images_are_decoded_and_encoded_in_one_pass(spark):
    text = plan(registry.queries()["convert_images"](spark, SF))
    assert text.count("Scan parquet") == 1 and text.count("MapInArrow") == 3 and "Join" not in text
    assert "hashpartitioning(raw" in plan(registry.queries()["image_files"](spark, SF))


def test_clamping_of_nulls_and_edges(spark):
    from pixelspark.functions import color as c

    rows = [(1, 0.5, 0.0, 0.0), (2, 0.9, 0.4, 0.1), (3, None, None, None), (4, float("nan"), 0.0, 0.0), (5, 0.6, 0.1, -0.3)]
    df = spark.createDataFrame(rows, "k int, l double, a double, b double")
    found = {r.k: (r.ol, r.oa, r.ob) for r in c.soft_clamp(df, ("l", "a", "b"), 0.5, out=("ol", "oa", "ob")).collect()}
    assert found[1] == (0.5, 0.0, 0.0) and found[3] == (None, None, None) and found[4][0] != found[4][0]

    def inside(lab):
        lms = [sum(m * x for m, x in zip(row, lab)) ** 3 for row in c.M2_INV]
        return all(-1e-3 <= sum(m * x for m, x in zip(row, lms)) <= 1 + 1e-3 for row in c.M1_INV_SRGB)

    for k, l, a, b in (rows[1], rows[4]):
        ol, oa, ob = found[k]
        assert not inside((l, a, b)) and inside(found[k])
        t = 1 - oa / a
        assert 0 < t <= 1 and abs(ol - (l + (0.5 - l) * 0.5 * t)) < 1e-12 and abs(ob - b * (1 - t)) < 1e-12


def test_compiled_methods_of_the_clamp_are_small(spark):
    """The JVM doesn't compile methods of more than 8,000 bytes to machine code."""
    code = registry.queries()["color_space_clamp"](spark, SF)._jdf.queryExecution().debug().codegenToSeq()
    assert max(code.apply(k)._3().maxMethodCodeSize() for k in range(code.length())) < 8000
