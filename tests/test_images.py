import numpy as np
import pytest

from pixelspark import __main__ as cli
from pixelspark.functions import sql
from pixelspark.sources import images, png, tiff


def test_files_of_all_formats(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    for name, form in (("a", "webp"), ("b", "tiff"), ("c", "png")):
        (tmp_path / name).write_bytes(images.ENCODERS[form](x))
    (tmp_path / "d").write_bytes(tiff.write_pages([x[..., :1]]))
    (tmp_path / "e").write_bytes(b"nothing known")
    (tmp_path / "f").write_bytes(png.encode(x[..., :1] % 3, "palette", palette=bytes(range(9))))
    rows = {r.path[-1]: r for r in images.read_images(spark, f"file://{tmp_path}").collect()}
    for name in "abc":
        assert bytes(rows[name].data) == x[..., :3].tobytes() and rows[name].model == "rgb"
    assert bytes(rows["d"].data) == x[..., :1].repeat(3, axis=2).tobytes() and rows["e"].error and rows["e"].data is None
    assert bytes(rows["f"].data)[:3] == bytes(range(int(x[0, 0, 0] % 3) * 3, int(x[0, 0, 0] % 3) * 3 + 3))
    four = {r.path[-1]: r for r in images.read_images(spark, f"file://{tmp_path}", channels=4).collect()}
    assert bytes(four["a"].data) == x.tobytes() and four["d"].channels == 4
    with pytest.raises(Exception, match="TIFF"):
        images.read_images(spark, f"file://{tmp_path}", mode="failfast").collect()
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    assert {r.path[-1]: r.k for r in files.select("path", images.sniff(files.content).alias("k")).collect()} == {"a": "webp", "b": "tiff", "c": "png", "d": "tiff", "e": None, "f": "png"}
    found = images.convert(files, "png").collect()
    assert len(found) == 6 and {r.path[-1] for r in found if r.error} == {"e"}  # what can't be read stays, with its error
    assert all(r.ratio > 0 and bytes(r.content)[:8] == png.SIGNATURE for r in found if not r.error)
    with pytest.raises(ValueError):
        images.encode_images(images.decode_files(files), "jpeg")


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT round2(-5, 1), round_div_nearest(-7, 2), wrap8(-1), paeth(10, 20, 15), clip8(300), srgb_eotf(1D), hex(packbits_encode(X'61616162')), round(mu_compress(-2, 255), 6)").first()
    assert list(row) == [-2, -4, 255, 15, 255, 1.0, "FE610062", -1.0]


def test_command_line(capsys):
    assert cli.main(["leb128", "300"]) == 0 and capsys.readouterr().out == "ac 02\n"
    with pytest.raises(SystemExit):
        cli.main(["convert", "a", "b", "--format", "jpeg"])


def test_no_file_is_lost(spark):
    good = tiff.write_pages([np.zeros((2, 3, 3), np.uint8)])
    files = spark.createDataFrame([("a", good), ("b", b"no image"), ("c", None), ("a", good), ("d", good[:20])], "path string, content binary")
    found = images.convert(files, "png").collect()
    assert sorted((r.path, r.error is None, r.content is None) for r in found) == [("a", True, False), ("a", True, False), ("b", False, True), ("c", False, True), ("d", False, True)]
    deep = spark.createDataFrame([("x", 1, 1, 3, 16, bytes(6))], "path string, width int, height int, channels int, bits int, data binary")
    assert [(r.path, r.content, r.error) for r in images.encode_images(deep, "png").collect()] == [("x", None, "16 bits a sample have no encoder")]
