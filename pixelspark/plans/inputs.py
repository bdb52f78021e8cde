"""Inputs of the registered queries, derived alike from the supplied tables in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.integer import div
from ..session import dealt

WIDTH = 16
#: Images of a task: half a million pixels, or three times as many samples.
IMAGES = 2048
#: Vectors of a task, where large blocks are transformed.
VECTORS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, key: str | None = "img", *more: str) -> DataFrame:
    """One 16 x 16 image a part: img, p (place), x, y, r, g, b, and ``more`` of p_size. The parts are dealt out by
    ``key`` before they become pixels, so that pixels aren't shuffled; None deals them in turn."""
    parts = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img"), "p_size"), key, IMAGES)
    cells = parts.select("img", "p_size", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("p"))
    x, y = F.col("p") % WIDTH, div(F.col("p"), WIDTH)
    u, v = x + F.col("img"), y + F.col("p_size")
    return cells.select("img", *more, "p", x.alias("x"), y.cast("int").alias("y"), ((u * 31 + v) % 256).cast("int").alias("r"), ((v * 17).cast("long").bitwiseXOR(u.cast("long")) % 256).cast("int").alias("g"), ((u + v) * 5 % 256).cast("int").alias("b"))


PIXELS = """px AS (
  SELECT img, p, x, y, CAST((31 * u + v) % 256 AS INT) AS r, CAST(xor(17 * v, u) % 256 AS INT) AS g, CAST(5 * (u + v) % 256 AS INT) AS b
  FROM (SELECT p_partkey AS img, p, p % 16 AS x, p // 16 AS y, CAST(p % 16 + p_partkey AS BIGINT) AS u, CAST(p // 16 + p_size AS BIGINT) AS v
        FROM part, range(256) t(p)))"""


def few_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of all kinds: gray where p_size is odd, of five colours where it divides by 4, one alpha in ten images."""
    rows = pixels(spark, sf_dir, "img", "p_size")
    level = ((div(F.col("x"), 4) + div(F.col("y"), 4)) % 5 * 50).cast("int")

    def channel(c: str, k: int) -> Column:
        return F.when(F.col("p_size") % 4 == 0, (level + k) % 256).when(F.col("p_size") % 2 == 1, F.col("r")).otherwise(F.col(c)).cast("int")

    alpha = F.when((F.col("img") % 10 == 0) & (F.col("x") < 4), 128).otherwise(255)
    return rows.select("img", "p", channel("r", 0).alias("r"), channel("g", 0).alias("g"), channel("b", 7).alias("b"), alpha.alias("a"))


FEW = (
    PIXELS
    + """, fx AS (
  SELECT px.img, p, CASE WHEN p_size % 4 = 0 THEN lv WHEN p_size % 2 = 1 THEN r ELSE r END AS r,
         CASE WHEN p_size % 4 = 0 THEN lv WHEN p_size % 2 = 1 THEN r ELSE g END AS g,
         CASE WHEN p_size % 4 = 0 THEN (lv + 7) % 256 WHEN p_size % 2 = 1 THEN r ELSE b END AS b,
         CASE WHEN px.img % 10 = 0 AND x < 4 THEN 128 ELSE 255 END AS a
  FROM (SELECT *, (x // 4 + y // 4) % 5 * 50 AS lv FROM px) px JOIN part ON img = p_partkey)"""
)


def linear_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour a line item: k, n, r, g, b from 0 to 1, and a space name."""
    rows = table(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(x) for x in ("srgb", "display_p3", "adobe_rgb", "bt2020", "prophoto_rgb")])
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 12.5).alias("g"), (F.col("l_quantity") / 50).alias("b"), F.element_at(names, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("space"))


RGB = """rgb AS (SELECT l_orderkey AS k, l_linenumber AS n, l_discount * 10 AS r, l_tax * 12.5 AS g, l_quantity / 50 AS b,
  ['srgb', 'display_p3', 'adobe_rgb', 'bt2020', 'prophoto_rgb'][l_linenumber % 5 + 1] AS space FROM lineitem)"""


def hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 20000).cast("float").alias("x"))


HDR = "hdr AS (SELECT o_orderkey AS k, CAST(o_totalprice / 20000 AS FLOAT) AS x FROM orders)"


def integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed and positive integers an order: k, s (-5000 to 5000), u (1 to 32768), d (1 to 100)."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), (k * 7919 % 10001 - 5000).alias("s"), (k * 104729 % 32768 + 1).alias("u"), (k % 100 + 1).alias("d"))


INTEGERS = "ints AS (SELECT o_orderkey AS k, o_orderkey * 7919 % 10001 - 5000 AS s, o_orderkey * 104729 % 32768 + 1 AS u, o_orderkey % 100 + 1 AS d FROM orders)"


def mulaw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).select("vec_id", "i", F.greatest(F.least(F.col("e").cast("double") * 2, F.lit(1.0)), F.lit(-1.0)).alias("v"))


MULAW = "mu AS (SELECT vec_id, i - 1 AS i, greatest(least(CAST(e AS DOUBLE) * 2, 1.0), -1.0) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def blocks(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """All blocks of ``size`` values of a vector times 128, rounded half away from zero: vec_id, block, v ARRAY<INT>; zeros
    fill the last one up."""
    value = lambda e: F.when(e >= 0, F.floor(e.cast("double") * 128 + 0.5)).otherwise(F.ceil(e.cast("double") * 128 - 0.5)).cast("int")
    vectors = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0)
    if size >= 32:  # much work a block
        vectors = dealt(vectors.select("vec_id", "embedding"), "vec_id", VECTORS)
    rows = vectors.select("vec_id", F.transform("embedding", value).alias("e"))
    each = rows.select("vec_id", "e", F.explode(F.sequence(F.lit(0), div(F.size("e") - 1, size).cast("int"))).alias("block"))
    cut = F.slice("e", F.col("block") * size + 1, F.lit(size))
    return each.select("vec_id", "block", F.concat(cut, F.array_repeat(F.lit(0), F.lit(size) - F.size(cut))).alias("v"))


def blocks_sql(size: int = 16) -> str:
    return f"""bl AS (SELECT vec_id, block, list_transform(range(1, {size + 1}), lambda j: coalesce(e[block * {size} + j], 0)) AS v
 FROM (SELECT vec_id, list_transform(embedding, lambda e: CAST(CASE WHEN e >= 0 THEN floor(CAST(e AS DOUBLE) * 128 + 0.5) ELSE ceil(CAST(e AS DOUBLE) * 128 - 0.5) END AS BIGINT)) AS e, CAST(unnest(range((len(embedding) + {size - 1}) // {size})) AS INT) AS block FROM embeddings))"""


BLOCKS = blocks_sql()


def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each document's whole text: id, i, v."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("(..)")).alias("h"))
    each = rows.select("id", F.posexplode("h").alias("i", "two"))
    return each.select("id", "i", F.conv("two", 16, 10).cast("int").alias("v"))


DOCUMENT_BYTES = """byt AS (SELECT id, i - 1 AS i, CAST('0x' || two AS INT) AS v
 FROM (SELECT id, unnest(h) AS two, generate_subscripts(h, 1) AS i FROM (SELECT doc_id AS id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents)))"""
