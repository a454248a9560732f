"""All queries of the raster engine and their SQL over exploded pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import geometry, identify, output, raster
from lumenframe.functions.geometry import Crop, ResizeTarget
from lumenframe.operators import kernels, monochrome
from lumenframe.operators.combine import combine
from lumenframe.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.from_embeddings(table(spark, sf_dir, "embeddings"))


def grouped(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Images with the number of their set of n; the last set may have fewer."""
    return images(spark, sf_dir).withColumn("grp", F.floor(F.col("image_id") / n))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(grouped(spark, sf_dir, 3), "grp", "Rgb8")


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(grouped(spark, sf_dir, 4), "grp", "Rgb8")


def shown(df: DataFrame) -> DataFrame:
    """An image as scalars: its pixels are one string."""
    return df.select("image_id", "width", "height", "color_type", F.array_join(F.transform("px", lambda v: v.cast("string")), ",").alias("px"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((1 + F.col("l_partkey") % 4000).alias("w"), (1 + F.col("l_suppkey") * 37 % 3000).alias("h")).distinct()


# --- SQL building blocks ----------------------------------------------------

PIX = """pix AS (SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, 0 AS c,
    CAST(least(greatest(floor((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS BIGINT) AS v
    FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def pix_of(n: int) -> str:
    """Sets of n images as one of three channels, or of four if a set has four; channels
    that a set lacks are 0."""
    return f"""{PIX.replace("pix AS", "one AS")},
    sets AS (SELECT vec_id // {n} AS g, count(*) AS m FROM embeddings GROUP BY 1),
    pix AS (SELECT g * {n} AS image_id, cy.y, cx.x, k AS c, coalesce(v, 0) AS v
            FROM sets CROSS JOIN range(4) r(k) CROSS JOIN range(8) cy(y) CROSS JOIN range(8) cx(x)
            LEFT JOIN one ON one.image_id = g * {n} + k AND k < {n} AND one.y = cy.y AND one.x = cx.x WHERE k < CASE WHEN m > 3 THEN 4 ELSE 3 END)"""


RGB_OR_RGBA = "CASE WHEN max(c) = 3 THEN 'Rgba8' ELSE 'Rgb8' END"


def listed(select: str, w: str = "8", h: str = "8", kind: str = "'L8'", source: str = PIX) -> str:
    """SQL for shown(): ``select`` gives image_id, y, x, c, v."""
    return f"""WITH {source}, res AS ({select})
    SELECT image_id, CAST({w} AS BIGINT) AS width, CAST({h} AS BIGINT) AS height, {kind} AS color_type,
           string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY y, x, c) AS px FROM res GROUP BY image_id"""


def weights_sql(name: str, rows: tuple[tuple[int, int, int], ...]) -> str:
    return f"{name}(i, s, w) AS (VALUES {', '.join(map(str, rows))})"


def separable_sql(passes: list[tuple[tuple, tuple]], source: str = PIX, w: int = 8, h: int = 8, kind: str = "'L8'", after: str = "") -> str:
    """Rows then columns by joins of pixels with weights; each sum is rounded once."""
    parts, last = [source], "pix"
    for k, (x, y) in enumerate(passes):
        parts += [weights_sql(f"wx{k}", x), weights_sql(f"wy{k}", y)]
        for axis, other, weights in (("x", "y", f"wx{k}"), ("y", "x", f"wy{k}")):
            new = f"p{k}{axis}"
            total = "CAST(sum(CAST(v * w AS BIGINT)) AS BIGINT)"
            parts.append(
                f"{new} AS (SELECT image_id, {other}, i AS {axis}, c, least(greatest(({total} + 8192) >> 14, 0), 255) AS v "
                f"FROM {last} JOIN {weights} ON {axis} = s GROUP BY image_id, {other}, i, c)"
            )
            last = new
    select = after.format(last=last) if after else f"SELECT image_id, y, x, c, v FROM {last}"
    return listed(select, str(w), str(h), kind, ", ".join(parts))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def pixel_query(name: str, work: Callable[[DataFrame], DataFrame], sql: str | None, source: Query = images) -> None:
    query(name, sql)(lambda spark, sf_dir: shown(work(source(spark, sf_dir))))


# --- scans and identify -----------------------------------------------------

pixel_query("raster_scan", lambda d: d, listed("SELECT * FROM pix"))


@query("identify_default", "SELECT vec_id AS image_id, 'img/' || vec_id || '.png PNG 8x8 8x8+0+0 8-bit Gray' || chr(10) AS text FROM embeddings")
def identify_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("image_id", identify.text().alias("text"))


@query(
    "identify_format_vars",
    "SELECT vec_id AS image_id, '8 8|8 8|+0+0|img/' || vec_id || '.png img/' || vec_id || '.png PNG 8x8 8x8+0+0 8%' || chr(10) || '10%x' AS text FROM embeddings",
)
def identify_format_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("image_id", identify.text("%w %W|%h %H|%X%Y|%i %M %m %G %g %z\\%\\n10%x").alias("text"))


# --- sizes ------------------------------------------------------------------


def sized(name: str, geom: str, w: str, h: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nw, nh = ResizeTarget.parse(geom).size(F.col("w"), F.col("h"))
        return sizes(spark, sf_dir).select("w", "h", nw.alias("new_w"), nh.alias("new_h"))

    sql = f"""WITH s AS (SELECT DISTINCT 1 + l_partkey % 4000 AS w, 1 + l_suppkey * 37 % 3000 AS h FROM lineitem)
        SELECT w, h, CAST({w} AS BIGINT) AS new_w, CAST({h} AS BIGINT) AS new_h FROM s"""
    query(f"resize_dims_{name}", sql)(run)


def ratio_sql(tw: str, th: str, cover: bool = False) -> tuple[str, str]:
    less, more = ("<", ">") if not cover else (">", "<")
    w = f"CASE WHEN w * ({th}) {less} ({tw}) * h THEN greatest(1, round(CAST(w AS DOUBLE) / h * ({th}))) ELSE ({tw}) END"
    h = f"CASE WHEN w * ({th}) {more} ({tw}) * h THEN greatest(1, round(CAST(h AS DOUBLE) / w * ({tw}))) ELSE ({th}) END"
    return w, h


sized("fit", "640x480", *ratio_sql("640", "480"))
sized("width_only", "200", *ratio_sql("200", "4294967295"))
sized("height_only", "x200", *ratio_sql("4294967295", "200"))
sized("exact", "640x480!", "640", "480")
sized("exact_shrink", "640x480!>", "least(w, 640)", "least(h, 480)")
sized("percent", "33.3x47%", "round(w * CAST(33.3 AS DOUBLE) / 100.0)", "round(h * CAST(47 AS DOUBLE) / 100.0)")
sized("area", "90000@", "floor(w * sqrt(CAST(90000 AS DOUBLE) / (w * h)))", "floor(h * sqrt(CAST(90000 AS DOUBLE) / (w * h)))")
sized("area_shrink", "90000@>", "least(w, floor(w * sqrt(CAST(90000 AS DOUBLE) / (w * h))))", "least(h, floor(h * sqrt(CAST(90000 AS DOUBLE) / (w * h))))")
sized("cover", "640x480^", *ratio_sql("640", "480", True))
sized("shrink_only", "640x480>", *ratio_sql("least(w, 640)", "least(h, 480)"))
sized("enlarge_only", "640x480<", *ratio_sql("greatest(w, 640)", "greatest(h, 480)"))
sized("no_op", "100%", "w", "h")


@query(
    "thumbnail_prescale_dims",
    f"""WITH s AS (SELECT DISTINCT 1 + l_partkey % 4000 AS w, 1 + l_suppkey * 37 % 3000 AS h FROM lineitem),
    t AS (SELECT w, h, CAST({ratio_sql("100", "100")[0]} AS BIGINT) AS tw, CAST({ratio_sql("100", "100")[1]} AS BIGINT) AS th FROM s)
    SELECT w, h, least(w, tw * 5) AS pre_w, least(h, th * 5) AS pre_h FROM t""",
)
def thumbnail_prescale_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = ResizeTarget.parse("100x100").size(F.col("w"), F.col("h"))
    return sizes(spark, sf_dir).select("w", "h", kernels.prescale(F.col("w"), w).alias("pre_w"), kernels.prescale(F.col("h"), h).alias("pre_h"))


@query(
    "default_filter",
    f"""WITH s AS (SELECT DISTINCT 1 + l_partkey % 4000 AS w, 1 + l_suppkey * 37 % 3000 AS h FROM lineitem),
    t AS (SELECT w, h, {ratio_sql("640", "480")[0]} AS tw, {ratio_sql("640", "480")[1]} AS th FROM s)
    SELECT w, h, CASE WHEN tw > w OR th > h OR (w + h) % 2 = 1 THEN 'MitchellNetravalli' ELSE 'Lanczos3' END AS kernel FROM t""",
)
def default_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = ResizeTarget.parse("640x480").size(F.col("w"), F.col("h"))
    steady = (F.col("w") + F.col("h")) % 2 == 0
    return sizes(spark, sf_dir).select("w", "h", raster.default_filter(F.col("w"), F.col("h"), w, h, steady).alias("kernel"))


@query(
    "geometry_parse",
    r"""WITH g AS (SELECT DISTINCT (1 + l_partkey % 500) || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' || (l_suppkey % 90) WHEN 2 THEN 'x+5-' || (l_suppkey % 90) ELSE '+1+2' END
            || CASE l_partkey % 3 WHEN 0 THEN '%' WHEN 1 THEN '>' ELSE '' END AS s FROM lineitem),
    b AS (SELECT s, regexp_replace(s, '[!%@^<>]', '', 'g') AS t FROM g)
    SELECT s, contains(t, '+') AND NOT contains(t, 'x') AS error,
           CASE WHEN NOT (contains(t, '+') AND NOT contains(t, 'x')) THEN CAST(regexp_extract(t, '^[0-9]+') AS DOUBLE) END AS width,
           CAST(nullif(regexp_extract(t, 'x([0-9]+)', 1), '') AS DOUBLE) AS height,
           CASE WHEN contains(t, 'x+') THEN CAST(5 AS DOUBLE) END AS xoffset,
           CASE WHEN contains(t, 'x+') THEN CAST(regexp_extract(t, '-[0-9]+$') AS DOUBLE) END AS yoffset,
           regexp_replace(s, '[^!%@^<>]', '', 'g') AS flags FROM b""",
)
def geometry_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    k = (F.col("l_suppkey") % 90).cast("string")
    tail = F.when(n == 0, "").when(n == 1, F.concat(F.lit("x"), k)).when(n == 2, F.concat(F.lit("x+5-"), k)).otherwise("+1+2")
    m = F.col("l_partkey") % 3
    flags = F.when(m == 0, "%").when(m == 1, ">").otherwise("")
    s = F.concat((1 + F.col("l_partkey") % 500).cast("string"), tail, flags)
    return table(spark, sf_dir, "lineitem").select(s.alias("s")).distinct().select("s", *[c.alias(n) for n, c in geometry.parsed(F.col("s")).items()])


# --- gathers and pointwise ---------------------------------------------------

pixel_query("negate", raster.negate, listed("SELECT image_id, y, x, c, 255 - v AS v FROM pix"))
pixel_query("negate_rgba", raster.negate, listed("SELECT image_id, y, x, c, CASE WHEN c = 3 THEN v ELSE 255 - v END AS v FROM pix", kind=RGB_OR_RGBA, source=pix_of(4)), rgba)
pixel_query("flip", raster.flip, listed("SELECT image_id, 7 - y AS y, x, c, v FROM pix"))
pixel_query("flop", raster.flop, listed("SELECT image_id, y, 7 - x AS x, c, v FROM pix"))
pixel_query("crop", lambda d: raster.crop(d, Crop.parse("5x4+2+3")), listed("SELECT image_id, y - 3 AS y, x - 2 AS x, c, v FROM pix WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 6", "5", "4"))
pixel_query("crop_on_load", lambda d: raster.crop(d, Crop.parse_on_load("3x8+5+0")), listed("SELECT image_id, y, x - 5 AS x, c, v FROM pix WHERE x >= 5", "3", "8"))
pixel_query(
    "sample", lambda d: raster.sample(d, ResizeTarget.parse("5x11!")),
    listed("SELECT image_id, b.i AS y, a.i AS x, c, v FROM pix JOIN range(5) a(i) ON x = (2 * a.i + 1) * 8 // 10 JOIN range(11) b(i) ON y = (2 * b.i + 1) * 8 // 22", "5", "11"),
)
pixel_query(
    "grayscale_rec709", raster.grayscale,
    listed("SELECT image_id, y, x, 0 AS c, CAST(sum(v * CASE c WHEN 0 THEN 2126 WHEN 1 THEN 7152 ELSE 722 END) AS BIGINT) // 10000 AS v FROM pix GROUP BY ALL", source=pix_of(3)), rgb,
)
pixel_query(
    "grayscale_rgba", raster.grayscale,
    listed(
        """SELECT image_id, y, x, 0 AS c, CAST(sum(v * CASE c WHEN 0 THEN 2126 WHEN 1 THEN 7152 ELSE 722 END) AS BIGINT) // 10000 AS v FROM pix WHERE c < 3 GROUP BY ALL
        UNION ALL SELECT image_id, y, x, 1, v FROM pix WHERE c = 3""", kind="CASE WHEN max(c) = 1 THEN 'La8' ELSE 'L8' END", source=pix_of(4)), rgba,
)


def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5x8 images with an EXIF block of orientation label % 8 + 1."""
    emb = table(spark, sf_dir, "embeddings")
    block = F.unhex(F.concat(F.lit("4D4D002A000000080001011200030000000100"), F.lpad((F.pmod("label", F.lit(8)) + 1).cast("string"), 2, "0"), F.lit("000000000000")))
    labelled = emb.select(F.col("vec_id").alias("image_id"), block.alias("own_exif"))
    base = raster.crop(raster.from_embeddings(emb), Crop(5, 8))
    return base.join(labelled, "image_id").withColumn("exif", F.col("own_exif")).drop("own_exif")


query(
    "auto_orient",
    f"""WITH {PIX}, o AS (SELECT vec_id AS image_id, ((label % 8) + 8) % 8 + 1 AS o FROM embeddings),
    res AS (SELECT image_id, o, v,
        CASE o WHEN 1 THEN x WHEN 2 THEN 4 - x WHEN 3 THEN 4 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y ELSE y END AS x,
        CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 4 - x ELSE 4 - x END AS y
        FROM pix JOIN o USING (image_id) WHERE x < 5)
    SELECT image_id, CAST(CASE WHEN o >= 5 THEN 8 ELSE 5 END AS BIGINT) AS width, CAST(CASE WHEN o >= 5 THEN 5 ELSE 8 END AS BIGINT) AS height, 'L8' AS color_type,
           string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS px FROM res GROUP BY image_id, o""",
)(lambda spark, sf_dir: shown(raster.auto_orient(oriented(spark, sf_dir))))

# --- combine ------------------------------------------------------------------

pixel_query("combine_rgb", lambda d: d, listed("SELECT * FROM pix", kind="'Rgb8'", source=pix_of(3)), rgb)
pixel_query("combine_rgba_fallback", lambda d: d, listed("SELECT * FROM pix", kind=RGB_OR_RGBA, source=pix_of(4)), rgba)
pixel_query("combine_gray", lambda d: combine(d.withColumn("grp", F.col("image_id")), "grp", "L8", False), listed("SELECT * FROM pix"))
pixel_query(
    "combine_partial_channels", lambda d: combine(d, "grp", "Rgb8"),
    listed("SELECT * FROM pix", kind="'Rgb8'", source=pix_of(2)), lambda s, d: grouped(s, d, 2),
)




def unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of three of which the second is 5x4."""
    own = grouped(spark, sf_dir, 3)
    second = F.col("image_id") % 3 == 1
    return own.where(~second).unionByName(raster.crop(own.where(second), Crop(5, 4)))


pixel_query(
    "combine_unequal", lambda d: combine(d, "grp", "Rgb8"),
    listed("SELECT image_id, y, x, c, CASE WHEN c = 1 AND (x >= 5 OR y >= 4) THEN 0 ELSE v END AS v FROM pix", kind="'Rgb8'", source=pix_of(3)), unequal,
)


@query(
    "combine_metadata",
    "SELECT min(vec_id) AS image_id, 'img/' || min(vec_id) || '.png' AS filename, 'png' AS format, 'L8' AS orig_color_type FROM embeddings GROUP BY vec_id // 3",
)
def combine_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb(spark, sf_dir).select("image_id", "filename", "format", "orig_color_type")


# --- sink metadata -------------------------------------------------------------


def quality_sql(body: str) -> str:
    return f"WITH q AS (SELECT DISTINCT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_suppkey % 131 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (l_partkey % 2) END AS q FROM lineitem) {body}"


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = (F.col("l_suppkey") % 131).cast("double") + 0.5 * (F.col("l_partkey") % 2)
    return table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 50 == 0, None).otherwise(q).alias("q")).distinct()


@query(
    "png_quality_map",
    quality_sql("""SELECT q, CASE WHEN q IS NULL THEN '7' WHEN CAST(floor(q) AS BIGINT) % 10 >= 8 THEN 'fast' ELSE CAST(least(CAST(floor(q) AS BIGINT) // 10, 9) AS VARCHAR) END AS level,
        CASE WHEN q IS NULL THEN 'adaptive' ELSE (['none', 'sub', 'up', 'avg', 'paeth', 'adaptive', 'adaptive', 'adaptive', 'adaptive', 'up'])[CAST(floor(q) AS BIGINT) % 10 + 1] END AS row_filter FROM q"""),
)
def png_quality_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualities(spark, sf_dir).select("q", *[c.alias(n) for n, c in output.png_settings(F.col("q")).items()])


@query("jpeg_quality_map", quality_sql("SELECT q, CAST(CASE WHEN q IS NULL THEN 92 WHEN floor(q) <= 100 THEN floor(q) ELSE 100 END AS BIGINT) AS jpeg FROM q"))
def jpeg_quality_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualities(spark, sf_dir).select("q", output.jpeg_quality(F.col("q")).alias("jpeg"))


@query(
    "webp_avif_quality_map",
    quality_sql("SELECT q, coalesce(q, 75) AS webp_quality, coalesce(q = 100, false) AS lossless, CAST(CASE WHEN q IS NULL THEN 50 ELSE least(floor(q), 255) END AS BIGINT) AS avif FROM q"),
)
def webp_avif_quality_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = output.webp_settings(F.col("q")) | {"avif": output.avif_quality(F.col("q"))}
    return qualities(spark, sf_dir).select("q", *[c.alias(n) for n, c in more.items()])


@query(
    "output_names",
    """WITH o AS (SELECT o_custkey AS g, o_orderkey AS seq, CASE o_custkey % 3 WHEN 0 THEN 'a.b/out.tar.gif' WHEN 1 THEN 'dir/noext' ELSE '-' END AS path FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS k, count(*) OVER (PARTITION BY g) AS n FROM o)
    SELECT g, seq, CASE WHEN path = '-' OR n = 1 THEN path WHEN path = 'dir/noext' THEN path || '-' || k ELSE 'a.b/out.tar-' || k || '.gif' END AS name FROM r""",
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_custkey") % 3
    path = F.when(m == 0, "a.b/out.tar.gif").when(m == 1, "dir/noext").otherwise("-")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("seq"), path.alias("path"))
    return own.select("g", "seq", output.output_name(F.col("path"), ["g"]).alias("name"))


@query(
    "choose_format",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'webp' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'tiff' ELSE 'png' END AS format FROM part""",
)
def choose_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("p_size") % 4
    prefix = F.when(m == 0, "WEBP")
    path = F.when(m == 1, "x.y/a.JPG").when(m == 2, "a.b.tif").otherwise("noext")
    return table(spark, sf_dir, "part").select("p_partkey", output.chosen_format(prefix, path, F.lit("png")).alias("format"))


@query("filter_alias_map", f"SELECT * FROM (VALUES {', '.join(f"('{f}', '{output.FILTER_ALIASES.get(f, f)}')" for f in output.FILTERS)}) t(name, kernel)")
def filter_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(f,) for f in output.FILTERS], "name string")
    return rows.select("name", output.kernel_column(F.upper("name")).alias("kernel"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGBA in 16 bits of each grey image: opaque, grey or 8-bit for some ids."""
    k = F.col("image_id")

    def cell(v: Column) -> Column:
        deep = v * 257 + F.when(k % 2 == 0, 0).otherwise(1) * (v % 3)
        green = F.when(k % 3 == 0, deep).otherwise(F.abs(65535 - deep))
        return F.array(deep.cast("int"), green.cast("int"), deep.cast("int"), F.when(k % 5 == 0, 65535).otherwise(v * 257).cast("int"))

    return images(spark, sf_dir).withColumns({"px": F.flatten(F.transform("px", cell)), "color_type": F.lit("Rgba16")})


WIDE = PIX.replace("pix AS", "one AS") + """,
    pix AS (SELECT image_id, y, x, n AS c, CASE n WHEN 3 THEN CASE WHEN image_id % 5 = 0 THEN 65535 ELSE v * 257 END
        WHEN 1 THEN CASE WHEN image_id % 3 = 0 THEN d ELSE abs(65535 - d) END ELSE d END AS v
        FROM (SELECT *, v * 257 + (image_id % 2) * (v % 3) AS d FROM one), range(4) r(n))"""
FLAGS_SQL = """f AS (SELECT image_id, bool_and(c <> 3 OR v = 65535) AS opaque, bool_and(v % 257 = 0) AS eight, count(DISTINCT v) FILTER (WHERE c = 3) = 1 AS steady FROM pix GROUP BY image_id),
    gr AS (SELECT image_id, bool_and(lo = hi) AS gray FROM (SELECT image_id, y, x, min(v) AS lo, max(v) AS hi FROM pix WHERE c < 3 GROUP BY ALL) GROUP BY image_id)"""


@query("narrow_flags", f"WITH {WIDE}, {FLAGS_SQL} SELECT image_id, opaque, gray, eight, steady FROM f JOIN gr USING (image_id)")
def narrow_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select("image_id", raster.is_opaque().alias("opaque"), raster.is_gray().alias("gray"), raster.is_8bit().alias("eight"), raster.constant_alpha().alias("steady"))


query(
    "narrow_apply",
    f"""WITH {WIDE}, {FLAGS_SQL},
    res AS (SELECT image_id, y, x, c, CASE WHEN eight THEN v // 257 ELSE v END AS v, opaque, gray, eight FROM pix JOIN f USING (image_id) JOIN gr USING (image_id)
            WHERE NOT (gray AND c IN (1, 2)) AND NOT (opaque AND c = 3))
    SELECT image_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height,
           CASE WHEN gray AND opaque THEN 'L' WHEN gray THEN 'La' WHEN opaque THEN 'Rgb' ELSE 'Rgba' END || CASE WHEN eight THEN '8' ELSE '16' END AS color_type,
           string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY y, x, c) AS px FROM res GROUP BY image_id, opaque, gray, eight""",
)(lambda spark, sf_dir: shown(raster.narrow(wide(spark, sf_dir), precision=True)))

query(
    "narrow_keeps_precision",
    f"""WITH {WIDE}, {FLAGS_SQL},
    res AS (SELECT image_id, y, x, c, v, opaque, gray FROM pix JOIN f USING (image_id) JOIN gr USING (image_id) WHERE NOT (gray AND c IN (1, 2)) AND NOT (opaque AND c = 3))
    SELECT image_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height,
           CASE WHEN gray AND opaque THEN 'L16' WHEN gray THEN 'La16' WHEN opaque THEN 'Rgb16' ELSE 'Rgba16' END AS color_type,
           string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY y, x, c) AS px FROM res GROUP BY image_id, opaque, gray""",
)(lambda spark, sf_dir: shown(raster.narrow(wide(spark, sf_dir))))
query(
    "rgb8_maybe_alpha",
    f"""WITH {WIDE}, {FLAGS_SQL},
    res AS (SELECT image_id, y, x, c, (v + 128) // 257 AS v, opaque FROM pix JOIN f USING (image_id) WHERE NOT (opaque AND c = 3))
    SELECT image_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, CASE WHEN opaque THEN 'Rgb8' ELSE 'Rgba8' END AS color_type,
           string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY y, x, c) AS px FROM res GROUP BY image_id, opaque""",
)(lambda spark, sf_dir: shown(raster.rgb8_maybe_alpha(wide(spark, sf_dir))))

# --- codecs: what is read from the bytes that were written ------------------------


def through(kind: str) -> Callable[[DataFrame], DataFrame]:
    """Encodes images as ``kind`` and decodes those bytes."""

    def work(df: DataFrame) -> DataFrame:
        made = files.encoded(df, kind, 100.0 if kind == "webp" else None).select("image_id", "seq", "filename", "content")
        back = files.decoded(made.select("seq", "filename", "content"))
        return back.withColumn("image_id", F.col("seq"))

    return work


GRAY_AS = {
    "L8": "SELECT * FROM pix", "Rgb8": "SELECT image_id, y, x, k AS c, v FROM pix CROSS JOIN range(3) r(k)",
    "Rgba8": "SELECT image_id, y, x, k AS c, CASE WHEN k = 3 THEN 255 ELSE v END AS v FROM pix CROSS JOIN range(4) r(k)",
    "Rgba16": "SELECT image_id, y, x, k AS c, CASE WHEN k = 3 THEN 65535 ELSE v * 257 END AS v FROM pix CROSS JOIN range(4) r(k)",
}
CODECS = {"png": "L8", "tiff": "L8", "pnm": "L8", "tga": "L8", "gif": "Rgba8", "qoi": "Rgb8", "bmp": "Rgb8", "pcx": "Rgb8", "ico": "Rgba8", "ff": "Rgba16", "webp": "Rgb8"}
for _format, _kind in CODECS.items():
    pixel_query(f"codec_{_format}", through(_format), listed(GRAY_AS[_kind], kind=f"'{_kind}'"))
pixel_query("codec_tiff_rgba", through("tiff"), listed("SELECT * FROM pix", kind=RGB_OR_RGBA, source=pix_of(4)), rgba)


@query("codec_jpeg_error", "SELECT vec_id AS image_id, true AS close FROM embeddings")
def codec_jpeg_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each cell of a JPEG of quality 100 is within 3 of what was written."""
    own = images(spark, sf_dir)
    back = files.decoded(files.encoded(own, "jpeg", 100.0).select("seq", "filename", "content")).select("seq", F.col("px").alias("read"))
    off = F.exists(F.zip_with("px", "read", lambda a, b: F.abs(a - b)), lambda d: d > 3)
    return own.join(back, "seq").select("image_id", (~off).alias("close"))


# --- kernels ---------------------------------------------------------------------

RESIZES = {"scale_box": ("3x5!", "Box"), "resize_triangle": ("5x3!", "Bilinear"), "resize_mitchell": ("12x10!", "MitchellNetravalli"), "resize_lanczos3": ("4x4!", "Lanczos3"), "resize_catmull": ("6x9!", "CatmullRom"), "resize_hamming": ("7x2!", "Hamming")}
for _name, (_geom, _kernel) in RESIZES.items():
    _t = ResizeTarget.parse(_geom)
    pixel_query(
        _name, lambda d, t=_t, k=_kernel: kernels.resize(d, t, k),
        separable_sql([(kernels.resample_weights(8, _t.width, _kernel), kernels.resample_weights(8, _t.height, _kernel))], w=_t.width, h=_t.height),
    )
_lanczos = kernels.resample_weights(8, 4, "Lanczos3")
pixel_query("resize_default_filter", lambda d: kernels.resize(d, ResizeTarget.parse("50%")), separable_sql([(_lanczos, _lanczos)], w=4, h=4))
pixel_query("thumbnail", lambda d: kernels.thumbnail(d, ResizeTarget.parse("4x4")), separable_sql([(_lanczos, _lanczos)], w=4, h=4))
# Colours are weighed by alpha where alpha varies.
_mitchell = kernels.resample_weights(8, 11, "MitchellNetravalli")
pixel_query(
    "resize_rgba", lambda d: kernels.resize(d, ResizeTarget.parse("11x11!"), "MitchellNetravalli"),
    separable_sql(
        [(_mitchell, _mitchell)], w=11, h=11, kind=RGB_OR_RGBA,
        source=pix_of(4).replace("pix AS", "raw AS") + """,
        alpha AS (SELECT image_id, y, x, v AS a, min(v) OVER (PARTITION BY image_id) <> max(v) OVER (PARTITION BY image_id) AS mix FROM raw WHERE c = 3),
        pix AS (SELECT image_id, y, x, c, CASE WHEN mix AND c < 3 THEN (v * a + 127) // 255 ELSE v END AS v FROM raw LEFT JOIN alpha USING (image_id, y, x))""",
        after="""SELECT o.image_id, o.y, o.x, o.c, CASE WHEN mixed.image_id IS NULL OR o.c = 3 THEN o.v WHEN a.v > 0 THEN least((o.v * 255 + a.v // 2) // a.v, 255) ELSE 0 END AS v
        FROM {last} o LEFT JOIN {last} a ON a.image_id = o.image_id AND a.y = o.y AND a.x = o.x AND a.c = 3
        LEFT JOIN (SELECT DISTINCT image_id FROM alpha WHERE mix) mixed ON mixed.image_id = o.image_id"""), rgba,
)
_gauss = kernels.gaussian_weights(1.5, 8)
pixel_query("gaussian_blur", lambda d: kernels.gaussian_blur(d, 1.5), separable_sql([(_gauss, _gauss)]))
_box = kernels.box_weights(kernels.box_radius(2.0), 8)
pixel_query("blur_fast", lambda d: kernels.blur(d, 2.0), separable_sql([(_box, _box)] * 3))
pixel_query(
    "unsharp", lambda d: kernels.unsharp(d, 1.5, 4),
    separable_sql([(_gauss, _gauss)], after="SELECT image_id, y, x, c, CASE WHEN abs(o.v - {last}.v) > 4 THEN least(greatest(2 * o.v - {last}.v, 0), 255) ELSE o.v END AS v FROM pix o JOIN {last} USING (image_id, y, x, c)"),
)

# --- monochrome --------------------------------------------------------------------


@query("mono_histogram", f"WITH {PIX} SELECT image_id, v, count(*) AS n FROM pix GROUP BY image_id, v")
def mono_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir).select("image_id", F.posexplode(monochrome.bands("px")["hist"]).alias("v", "n"))
    return own.where("n > 0").select("image_id", F.col("v").cast("long").alias("v"), F.col("n").cast("long").alias("n"))


PERCENTILES = """hist AS (SELECT image_id, v, count(*) AS n FROM pix GROUP BY image_id, v),
    run AS (SELECT image_id, v, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS upto FROM hist),
    pc AS (SELECT image_id, CAST(min(v) FILTER (WHERE upto >= 16) AS DOUBLE) AS p25, CAST(min(v) FILTER (WHERE upto >= 48) AS DOUBLE) AS p75 FROM run GROUP BY image_id)"""
CENTROIDS = PERCENTILES + """,
    it AS (SELECT image_id, 0 AS k, p25 AS low, p75 AS high, false AS done FROM pc UNION ALL
        SELECT image_id, k + 1, CASE WHEN stop THEN low ELSE l2 END, CASE WHEN stop THEN high ELSE h2 END, stop
        FROM (SELECT *, done OR (abs(l2 - low) < 0.5 AND abs(h2 - high) < 0.5) AS stop FROM (
            SELECT it.image_id, k, low, high, done,
                coalesce(CAST((SELECT sum(v * n) FROM hist h WHERE h.image_id = it.image_id AND v <= (low + high) / 2) AS DOUBLE) / (SELECT sum(n) FROM hist h WHERE h.image_id = it.image_id AND v <= (low + high) / 2), low) AS l2,
                coalesce(CAST((SELECT sum(v * n) FROM hist h WHERE h.image_id = it.image_id AND v > (low + high) / 2) AS DOUBLE) / (SELECT sum(n) FROM hist h WHERE h.image_id = it.image_id AND v > (low + high) / 2), high) AS h2
            FROM it WHERE k < 20))),
    cen AS (SELECT image_id, low, high FROM it WHERE k = 20)"""


@query("mono_percentile", f"WITH {PIX}, {PERCENTILES} SELECT * FROM pc")
def mono_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monochrome.with_band(images(spark, sf_dir)).select("image_id", "p25", "p75")


@query("mono_centroids", f"WITH RECURSIVE {PIX}, {CENTROIDS} SELECT image_id, round(low, 6) AS low, round(high, 6) AS high FROM cen")
def mono_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monochrome.with_band(images(spark, sf_dir)).select("image_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


pixel_query(
    "mono_remap", monochrome.remapped,
    listed(
        "SELECT image_id, y, x, c, CASE WHEN high - low < 1 THEN v ELSE floor(least(greatest((v - low) / (high - low) * 255.0, 0), 255)) END AS v FROM pix JOIN cen USING (image_id)",
        source=f"{PIX}, {CENTROIDS}").replace("WITH", "WITH RECURSIVE", 1),
)


def monochrome_sql() -> str:
    """Diffusion cell by cell, in the same 32-bit steps; the noise is the tile's upper left."""
    noise = (monochrome.noise_tile()[:8, :8].astype("float32") / np.float32(255) - np.float32(0.5)).ravel()
    listed_noise = ", ".join(f"CAST('{x!r}' AS FLOAT)" for x in map(float, noise))
    f = lambda x: f"CAST({x} AS FLOAT)"
    jitter = f"n[k + 1] * {f(100)} * ({f(1)} - least({f(1)}, abs(CAST(px[k + 1] AS FLOAT) - {f(127.5)}) / {f(127.5)}))"
    return f"""WITH RECURSIVE {PIX}, {CENTROIDS},
    rem AS (SELECT image_id, y, x, CAST(CASE WHEN high - low < 1 THEN v ELSE floor(least(greatest((v - low) / (high - low) * 255.0, 0), 255)) END AS INTEGER) AS v FROM pix JOIN cen USING (image_id)),
    start AS (SELECT image_id, list(v ORDER BY y, x) AS px, [{listed_noise}] AS n FROM rem GROUP BY image_id),
    d AS (SELECT image_id, px, n, 0 AS k, list_transform(range(91), lambda z: {f(0)}) AS e, CAST([] AS INTEGER[]) AS o FROM start UNION ALL
        SELECT image_id, px, n, k + 1, list_transform(e, lambda q, z: CASE z WHEN place + 1 THEN q + rest * {f(0.5)} WHEN place + 9 THEN q + rest * {f(0.25)} WHEN place + 10 THEN q + rest * {f(0.25)} ELSE q END),
            list_append(o, new)
        FROM (SELECT *, here - CAST(new AS FLOAT) AS rest FROM (SELECT *, CASE WHEN here > edge THEN 255 ELSE 0 END AS new FROM (
            SELECT *, CAST(px[k + 1] AS FLOAT) + e[place] AS here, {f(127.5)} + {jitter} AS edge FROM (SELECT *, (k // 8) * 10 + k % 8 + 2 AS place FROM d WHERE k < 64))))),
    out AS (SELECT image_id, o FROM d WHERE k = 64)
    SELECT image_id, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, 'L8' AS color_type, array_to_string(o, ',') AS px FROM out"""


pixel_query("monochrome", monochrome.monochrome, None)
#: SQL that takes seconds to make, made when it is asked for.
LATER: dict[str, Callable[[], str]] = {"monochrome": monochrome_sql}


def oracles() -> dict[str, str]:
    """The SQL of every query."""
    return ORACLES | {k: make() for k, make in LATER.items()}



@query(
    "constant_alpha",
    f"""WITH {pix_of(4)} SELECT image_id, coalesce(min(v) FILTER (WHERE c = 3) = max(v) FILTER (WHERE c = 3), true) AS steady,
        coalesce(min(v) FILTER (WHERE c = 3) = 255, true) AS opaque FROM pix GROUP BY image_id""",
)
def constant_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgba(spark, sf_dir).select("image_id", raster.constant_alpha().alias("steady"), raster.is_opaque().alias("opaque"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half size by nearest cells, negated, with its identify text."""
    df = raster.negate(raster.sample(images(spark, sf_dir), ResizeTarget.parse("50%")))
    text = df.select("image_id", identify.text().alias("text"), "width", "height", F.array_join(F.transform("px", lambda v: v.cast("string")), ",").alias("px"))
    return text


query(
    "convert_flagship",
    f"""WITH {PIX}, res AS (SELECT image_id, y // 2 AS y, x // 2 AS x, 255 - v AS v FROM pix WHERE x % 2 = 1 AND y % 2 = 1)
    SELECT image_id, 'img/' || image_id || '.png PNG 4x4 4x4+0+0 8-bit Gray' || chr(10) AS text, CAST(4 AS BIGINT) AS width, CAST(4 AS BIGINT) AS height,
           string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS px FROM res GROUP BY image_id""",
)(flagship)
