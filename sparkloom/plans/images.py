"""Queries over images whose pixels are rows of ``lineitem``, one image a supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import coding, colour, histogram, scanlines
from sparkloom.sources import png, png_write
from sparkloom.staging import Stage

from .graphs import table
from .registry import query

#: Pixels of a row.
WIDTH = 16

# Images by supplier modulo 8: coloured, grey of 1, 4 and 2 bits (the last with a colour key), few colours,
# transparency, grey with transparency, coloured with a colour key. The expressions mean the same in both engines.
_R = """CASE l_suppkey % 8 WHEN 0 THEN l_orderkey % 256 WHEN 1 THEN l_linenumber % 2 * 255 WHEN 2 THEN l_orderkey % 16 * 17 WHEN 3 THEN l_linenumber % 4 * 85
    WHEN 4 THEN l_linenumber * 20 WHEN 5 THEN l_orderkey % 256 WHEN 6 THEN l_linenumber * 3 ELSE l_partkey % 5 * 50 END"""
_G = "CASE image % 8 WHEN 0 THEN l_partkey % 256 WHEN 4 THEN 7 WHEN 5 THEN l_linenumber WHEN 7 THEN l_orderkey % 7 ELSE r END"
_B = "CASE image % 8 WHEN 0 THEN l_linenumber * 30 % 256 WHEN 4 THEN l_orderkey % 2 WHEN 5 THEN 9 WHEN 7 THEN CASE WHEN r = 0 AND g = 0 THEN 0 ELSE l_orderkey % 200 END ELSE r END"
_A = """CASE image % 8 WHEN 3 THEN CASE WHEN r = 85 THEN 0 ELSE 255 END WHEN 5 THEN l_orderkey % 256 WHEN 6 THEN CASE WHEN l_orderkey % 3 = 0 THEN 128 ELSE 255 END
    WHEN 7 THEN CASE WHEN r = 0 AND g = 0 THEN 0 ELSE 255 END ELSE 255 END"""
_POS = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1"

RASTER_SQL = f"""SELECT image, pos, r::INT AS r, g::INT AS g, b::INT AS b, ({_A})::INT AS a FROM (SELECT *, {_B} AS b FROM (SELECT *, {_G} AS g FROM (
    SELECT l_suppkey AS image, {_POS} AS pos, l_orderkey, l_partkey, l_linenumber, {_R} AS r FROM lineitem)))"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, pos, r, g, b, a) of all lines; pos counts from 0 within the image."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS image", f"{_POS} AS pos", "l_orderkey", "l_partkey", "l_linenumber", f"{_R} AS r")
    for name, expr in (("g", _G), ("b", _B), ("a", _A)):
        lines = lines.withColumn(name, F.expr(expr))
    return lines.select("image", F.col("pos").cast("long").alias("pos"), *(F.col(c).cast("int").alias(c) for c in ("r", "g", "b", "a")))


_MODEL_SQL = """s AS (SELECT image, count(*) AS n_pixels, bool_or(r <> g OR r <> b) AS colored, count(DISTINCT (r, g, b)) FILTER (WHERE a = 0) AS n_keys, min((r * 256 + g) * 256 + b) FILTER (WHERE a = 0) AS k,
    bool_or(a > 0 AND a < 255) AS partly, least(count(DISTINCT (r, g, b, a)), 257) AS n_colors,
    max(CASE WHEN r IN (0, 255) THEN 1 WHEN r % 85 = 0 THEN 2 WHEN r % 17 = 0 THEN 4 ELSE 8 END) AS grey FROM px GROUP BY image),
t AS (SELECT s.*, partly OR n_keys > 1 OR (n_keys = 1 AND EXISTS (SELECT 1 FROM px WHERE px.image = s.image AND a > 0 AND (r * 256 + g) * 256 + b = k)) AS alpha FROM s),
stats AS (SELECT image, n_pixels, colored, alpha, CASE WHEN NOT alpha THEN k END AS key, CASE WHEN colored OR alpha THEN 8 ELSE grey END AS bits, n_colors FROM t),
u AS (SELECT *, key IS NOT NULL AND n_pixels <= 16 AS few, CASE WHEN n_colors <= 2 THEN 1 WHEN n_colors <= 4 THEN 2 WHEN n_colors <= 16 THEN 4 ELSE 8 END AS pal FROM stats),
v AS (SELECT *, CASE WHEN (few OR colored) AND bits < 8 THEN 8 ELSE bits END AS d FROM u),
w AS (SELECT *, n_colors <= 256 AND d <= 8 AND n_pixels >= 2 * n_colors AND NOT (NOT colored AND NOT (alpha OR few) AND d <= pal) AS palette FROM v),
model AS (SELECT *, CASE WHEN palette THEN 3 WHEN alpha OR few THEN CASE WHEN colored THEN 6 ELSE 4 END WHEN colored THEN 2 ELSE 0 END AS color_type, CASE WHEN palette THEN pal ELSE d END AS bit_depth,
    CASE WHEN NOT palette AND NOT few THEN key END AS kept FROM w)"""
_STATS_SQL = f"WITH px AS MATERIALIZED ({RASTER_SQL}),\n{_MODEL_SQL}"


@query(f"""{_STATS_SQL} SELECT image, n_pixels, colored, alpha, coalesce(key, -1)::BIGINT AS key, bits::INT AS bits, n_colors::BIGINT AS n_colors, color_type::INT AS color_type, bit_depth::INT AS bit_depth,
    coalesce(((kept >> 16) % (1 << bit_depth)), -1)::INT AS key_r, coalesce(((kept >> 8) % 256 % (1 << bit_depth)), -1)::INT AS key_g, coalesce((kept % 256 % (1 << bit_depth)), -1)::INT AS key_b FROM model""")
def image_colour_model(spark, sf_dir):
    """The model of each image; -1 where there is no key."""
    return colour.choose_model(colour.colour_stats(raster(spark, sf_dir))).fillna(-1, ["key", "key_r", "key_g", "key_b"])


_PALETTE_SQL = f"""WITH px AS MATERIALIZED ({RASTER_SQL}), c AS (SELECT image, r, g, b, a, min(pos) AS pos FROM px GROUP BY ALL),
few AS (SELECT image, CASE WHEN count(*) <= 2 THEN 1 WHEN count(*) <= 4 THEN 2 WHEN count(*) <= 16 THEN 4 ELSE 8 END AS depth FROM c GROUP BY image HAVING count(*) <= 256),
pal AS (SELECT image, depth, row_number() OVER (PARTITION BY image ORDER BY pos) - 1 AS idx, r, g, b, a FROM c JOIN few USING (image))"""


@query(f"{_PALETTE_SQL} SELECT image, idx::INT AS idx, r, g, b, a FROM pal")
def image_palettes(spark, sf_dir):
    return colour.palettes(raster(spark, sf_dir))


def _packed(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    return colour.packed_rows(colour.indexed(pixels, palette).join(colour.index_bits(palette), "image"), WIDTH)


@query(f"""{_PALETTE_SQL}, parts AS (SELECT image, pos // {WIDTH} AS y, (pos % {WIDTH} * depth) // 8 AS place, sum(idx << (8 - depth - (pos % {WIDTH} * depth) % 8)) AS byte
    FROM px JOIN pal USING (image, r, g, b, a) GROUP BY ALL)
SELECT image, y, string_agg(printf('%02x', byte::BIGINT), '' ORDER BY place) AS bytes FROM parts GROUP BY ALL""")
def image_packed_indices(spark, sf_dir):
    pixels = raster(spark, sf_dir)
    return _packed(pixels, colour.palettes(pixels)).select("image", "y", F.lower(F.hex("bytes")).alias("bytes"))


@query(f"{_PALETTE_SQL} SELECT px.* FROM px SEMI JOIN few USING (image)")
def image_unpacked_pixels(spark, sf_dir):
    """Pixels read back from palette and packed indices."""
    pixels = raster(spark, sf_dir)
    palette = colour.palettes(pixels)
    packed = _packed(pixels, palette).join(colour.index_bits(palette), "image")
    # The last row is filled up to whole bytes; what lies beyond the image is no pixel.
    size = pixels.groupBy("image").agg(F.count(F.lit(1)).alias("size"))
    read = colour.unpacked_rows(packed, WIDTH).join(size, "image").where("pos < size").drop("size")
    return read.join(palette, ["image", "idx"]).select("image", "pos", "r", "g", "b", "a")


def scanline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, line): rows of red, green and blue bytes, the last row filled with zeros."""
    rows = raster(spark, sf_dir).select("image", F.expr(f"pos div {WIDTH}").alias("y"), "pos", "r", "g", "b")
    pixels = rows.groupBy("image", "y").agg(F.array_sort(F.collect_list(F.struct("pos", "r", "g", "b"))).alias("all"))  # WIDTH pixels
    flat = F.flatten(F.transform("all", lambda p: F.array(p["r"], p["g"], p["b"])))
    return pixels.select("image", "y", F.concat(flat, F.array_repeat(F.lit(0), F.lit(3 * WIDTH) - F.size(flat))).alias("line"))


_FILTER_SQL = f"""WITH px AS MATERIALIZED ({RASTER_SQL}), v AS (SELECT image, pos // {WIDTH} AS y, pos % {WIDTH} * 3 + c AS x, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END AS v FROM px, range(3) t(c)),
whole AS MATERIALIZED (SELECT image, y, x, coalesce(v, 0) AS v FROM (SELECT DISTINCT image, y FROM v) CROSS JOIN range({3 * WIDTH}) k(x) LEFT JOIN v USING (image, y, x)),
n AS (SELECT w.*, coalesce(l.v, 0) AS l, coalesce(u.v, 0) AS u, coalesce(c.v, 0) AS c FROM whole w LEFT JOIN whole l ON l.image = w.image AND l.y = w.y AND l.x = w.x - 3
    LEFT JOIN whole u ON u.image = w.image AND u.y = w.y - 1 AND u.x = w.x LEFT JOIN whole c ON c.image = w.image AND c.y = w.y - 1 AND c.x = w.x - 3),
g AS (SELECT *, [0, l, u, (l + u) // 2, CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END] AS guess FROM n),
f AS (SELECT image, y, x, k AS kind, (v - guess[k + 1] + 256) % 256 AS byte FROM g, range(5) t(k))"""


@query(f"""{_FILTER_SQL}, s AS (SELECT image, y, kind, sum(CASE WHEN kind > 0 AND byte >= 128 THEN 255 - byte ELSE byte END) AS s FROM f GROUP BY ALL)
SELECT image, y, arg_min(kind, (s, kind))::INT AS filter FROM s GROUP BY ALL""")
def scanline_filters(spark, sf_dir):
    return scanlines.choose_filters(scanline_rows(spark, sf_dir), 3)


@query(f"""{_FILTER_SQL}, n2 AS (SELECT image, y, kind, byte, count(*) AS n FROM (SELECT image, y, kind, byte FROM f UNION ALL SELECT DISTINCT image, y, kind, kind FROM f) GROUP BY ALL),
s AS (SELECT image, y, kind, sum(n * floor(log2(n)) + 2 * (n - 2 ** floor(log2(n)))) AS s FROM n2 GROUP BY ALL)
SELECT image, y, arg_min(kind, (-s, kind))::INT AS filter FROM s GROUP BY ALL""")
def scanline_filters_entropy(spark, sf_dir):
    return scanlines.choose_filters(scanline_rows(spark, sf_dir), 3, "entropy")


@query(f"""{_FILTER_SQL}, s AS (SELECT image, y, kind, sum(CASE WHEN kind > 0 AND byte >= 128 THEN 255 - byte ELSE byte END) AS s FROM f GROUP BY ALL),
best AS (SELECT image, y, arg_min(kind, (s, kind)) AS filter FROM s GROUP BY ALL)
SELECT image, y, filter::INT AS filter, string_agg(printf('%02x', byte), '' ORDER BY x) AS line FROM f JOIN best USING (image, y) WHERE kind = filter GROUP BY ALL""")
def scanlines_filtered(spark, sf_dir):
    rows = scanline_rows(spark, sf_dir)
    done = scanlines.filtered_rows(rows, scanlines.choose_filters(rows, 3), 3)
    return done.withColumn("line", F.lower(F.array_join(F.transform("line", lambda v: F.lpad(F.hex(v), 2, "0")), "")))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = raster(spark, sf_dir).select("image", "pos")
    height = pixels.groupBy("image").agg(F.expr(f"(count(*) + {WIDTH} - 1) div {WIDTH}").alias("height"))
    return pixels.select("image", F.expr(f"pos % {WIDTH}").alias("x"), F.expr(f"pos div {WIDTH}").alias("y")).join(height, "image").withColumn("width", F.lit(WIDTH))


_GRID_SQL = f"""WITH px AS MATERIALIZED ({RASTER_SQL}), size AS (SELECT image, (count(*) + {WIDTH} - 1) // {WIDTH} AS height FROM px GROUP BY image),
whole AS (SELECT image, i % {WIDTH} AS x, i // {WIDTH} AS y FROM size, range({WIDTH} * 100000) t(i) WHERE i < {WIDTH} * height),
p AS (SELECT *, CASE WHEN y % 2 = 1 THEN 7 WHEN x % 2 = 1 THEN 6 WHEN y % 4 = 2 THEN 5 WHEN x % 4 = 2 THEN 4 WHEN y % 8 = 4 THEN 3 WHEN x % 8 = 4 THEN 2 ELSE 1 END AS pass FROM whole),
o AS (SELECT image, x, y, pass, row_number() OVER (PARTITION BY image ORDER BY pass, y, x) - 1 AS place FROM p)"""


@query(f"{_GRID_SQL} SELECT o.image, x, y, pass::INT AS pass, place FROM o JOIN px ON px.image = o.image AND pos = y * {WIDTH} + x")
def interlaced_places(spark, sf_dir):
    return scanlines.interlace(_grid(spark, sf_dir)).select("image", "x", "y", "pass", "place")


@query(f"SELECT image, pos FROM ({RASTER_SQL})")
def interlaced_round_trip(spark, sf_dir):
    """Every pixel's place in the interlaced order, turned back into the pixel."""
    placed = scanlines.interlace(_grid(spark, sf_dir))
    back = scanlines.interlaced_pixel(F.col("place"), F.col("width"), F.col("height"))
    return placed.select("image", back.alias("p")).select("image", (F.col("p.y") * WIDTH + F.col("p.x")).alias("pos"))


# The images as files: every row is full, what lies beyond the last line is transparent black.
_FULL_SQL = f"""WITH base AS MATERIALIZED ({RASTER_SQL}), size AS (SELECT image, (count(*) + {WIDTH} - 1) // {WIDTH} * {WIDTH} AS n FROM base GROUP BY image),
whole AS (SELECT s.image, i AS pos, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM (SELECT image, unnest(range(n)) AS i FROM size) s LEFT JOIN base ON base.image = s.image AND pos = i)"""


def full_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = raster(spark, sf_dir)
    size = pixels.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    fill = size.where(f"n % {WIDTH} > 0").select("image", F.explode(F.sequence("n", F.expr(f"n + {WIDTH} - n % {WIDTH} - 1"))).alias("pos"))
    return pixels.unionByName(fill.select("image", "pos", *(F.lit(0).alias(c) for c in ("r", "g", "b", "a"))))


def image_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a PNG file of each supplier's image, written by the tasks."""
    folder = Stage(spark, "image-files").root
    png_write.write_images(full_raster(spark, sf_dir), WIDTH, folder)
    return folder


def _file_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png.read_pixels(spark, image_folder(spark, sf_dir)).withColumn("image", _image_id("image"))


def _image_id(path: str):
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long")


@query(f"{_FULL_SQL} SELECT image, pos, r::INT AS r, g::INT AS g, b::INT AS b, a::INT AS a FROM whole")
def png_pixels(spark, sf_dir):
    return _file_pixels(spark, sf_dir)


def _image_query(mode: str, select: str):
    def run(spark, sf_dir):
        return png.colors(_file_pixels(spark, sf_dir), mode).groupBy("image", "color").agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = f"png_{mode}_colors"
    return query(f"{_FULL_SQL} SELECT image, color::INT AS color, count(*) AS n FROM (SELECT image, {select} AS color FROM whole) GROUP BY ALL")(run)


_image_query("grayscale", "trunc(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)")
_image_query("rgb", "unnest([r, g, b])")
_image_query("rgba", "unnest([r, g, b, a])")

#: What is done to a file by image number modulo 6, and the error that it has to give.
_DAMAGE = {0: ("content", None), 1: ("cast('' AS binary)", 48), 2: ("substring(content, 1, 20)", 27), 3: ("overlay(content placing X'00' from 1)", 28), 4: ("substring(content, 1, length(content) - 12)", 30), 5: ("overlay(content placing X'00' from length(content))", 57)}


@query(f"SELECT image, {'CASE image % 6 ' + ' '.join(f'WHEN {k} THEN {v[1]}' for k, v in _DAMAGE.items() if v[1]) + ' ELSE 0 END'}::INT AS error FROM (SELECT DISTINCT l_suppkey AS image FROM lineitem)")
def png_errors(spark, sf_dir):
    """Files of which most are damaged: the number of what is wrong with each, 0 for nothing."""
    files = spark.read.format("binaryFile").load(image_folder(spark, sf_dir)).select("path", "content", _image_id("path").alias("image"))
    damaged = files.withColumn("content", F.expr("CASE image % 6 " + " ".join(f"WHEN {k} THEN {v[0]}" for k, v in _DAMAGE.items()) + " END"))
    read = png.decode_files(damaged, permissive=True)
    return read.groupBy(_image_id("image").alias("image")).agg(F.coalesce(F.max("error"), F.lit(0)).alias("error"))


@query(f"""{_FULL_SQL}, px AS (SELECT * FROM whole), {_MODEL_SQL},
kinds AS (SELECT image, any_value(color_type) AS color_type, any_value(kept) IS NOT NULL OR (any_value(color_type) = 3 AND bool_or(a < 255)) AS clear FROM model JOIN px USING (image) GROUP BY image),
parts AS (SELECT image, list_filter(['IHDR', CASE WHEN color_type = 3 THEN 'PLTE' END, CASE WHEN clear THEN 'tRNS' END, 'IDAT', 'IEND'], lambda x: x IS NOT NULL) AS types FROM kinds)
SELECT image, (i - 1)::INT AS no, types[i] AS type FROM (SELECT image, types, unnest(range(1, len(types) + 1)) AS i FROM parts)""")
def png_chunks(spark, sf_dir):
    """The chunks of every image's file, of which none is inflated."""
    found = png.chunk_table(spark.read.format("binaryFile").load(image_folder(spark, sf_dir)))
    return found.where("crc_ok AND error IS NULL").select(_image_id("image").alias("image"), "no", "type")


_CODES_SQL = """WITH RECURSIVE h AS (SELECT l_returnflag, l_suppkey % 256 AS bucket, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT l_returnflag, list(n::BIGINT) AS w, 0::BIGINT AS cost FROM h GROUP BY l_returnflag
    UNION ALL SELECT l_returnflag, list_append(list_sort(w)[3:], list_sum(list_sort(w)[1:2])::BIGINT), cost + list_sum(list_sort(w)[1:2])::BIGINT FROM t WHERE len(w) > 1)
SELECT l_returnflag, (SELECT count(*) FROM h WHERE h.l_returnflag = t.l_returnflag) AS n_symbols, 32768::BIGINT AS kraft, cost AS total_bits FROM t WHERE len(w) = 1"""


@query(_CODES_SQL)
def prefix_code_totals(spark, sf_dir):
    """Code lengths of at most 15 bits over the grouped histogram; their total is that of an unlimited Huffman code where its codes are short enough."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 256).cast("int").alias("color"))
    counts = histogram.histogram(rows, by=("l_returnflag",))
    return coding.code_summary(counts, coding.code_lengths(counts, ("l_returnflag",), 256), ("l_returnflag",)).drop("longest")


_CHECKSUM_SQL = """WITH tab AS (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS v FROM documents),
s AS (SELECT doc_id, v, len(v) AS n, coalesce(list_sum(v), 0)::BIGINT AS first, coalesce(list_sum(list_transform(v, lambda b, i: b * (len(v) - i + 1))), 0)::BIGINT AS second FROM d)
SELECT doc_id, n AS n_bytes, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, v), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc32,
    (n + second) % 65521 * 65536 + (1 + first) % 65521 AS adler32 FROM s, tab"""


@query(_CHECKSUM_SQL)
def document_checksums(spark, sf_dir):
    """Checksums of whole texts from blocks that are cut at a length of each document's own."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"), F.expr("cast(500 + doc_id % 777 AS int)").alias("size"))
    starts = F.sequence(F.lit(0), F.expr("cast(greatest(0, ceil(length(raw) / size) - 1) AS int)"))
    cut = texts.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substring("raw", i * F.col("size") + 1, F.col("size")))).alias("seq", "block"))
    return coding.stream_checksums(cut, "doc_id")
