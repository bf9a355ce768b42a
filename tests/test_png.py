import struct
import zlib

import numpy as np
import pytest

from sparkloom.operators.histogram import histogram
from sparkloom.sources import png, png_write


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def make(width, height, color, depth, rows, extra=b"", interlaced=0):
    header = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlaced)
    return png.SIGNATURE + chunk(b"IHDR", header) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def plain(array):
    return b"".join(b"\0" + row.tobytes() for row in array)


RNG = np.random.default_rng(3)
RGBA = RNG.integers(0, 256, (5, 7, 4), dtype=np.uint8)


def filtered(array, step):
    """The same rows under filters 0 to 4 in turn."""
    out, above = b"", np.zeros(array.shape[1], int)
    for y, row in enumerate(array.astype(int)):
        left = np.concatenate([np.zeros(step, int), row[:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        base = left + above - corner
        paeth = [min((a, b, c), key=lambda v, p=p: abs(p - v)) for a, b, c, p in zip(left, above, corner, base)]
        guess = [0 * row, left, above, (left + above) // 2, np.array(paeth)][y % 5]
        out += bytes([y % 5]) + bytes(((row - guess) % 256).astype(np.uint8))
        above = row
    return out


def test_truecolour_filters():
    flat = RGBA.reshape(5, -1)
    assert (png.decode_png(make(7, 5, 6, 8, filtered(flat, 4))) == RGBA).all()
    rgb = RGBA[..., :3].copy()
    got = png.decode_png(make(7, 5, 2, 8, filtered(rgb.reshape(5, -1), 3)))
    assert (got[..., :3] == rgb).all() and (got[..., 3] == 255).all()


def test_depths_palette_and_key():
    grey = RGBA[..., 0].copy()
    assert (png.decode_png(make(7, 5, 0, 8, plain(grey)))[..., 1] == grey).all()
    wide = (grey.astype(np.uint16) * 256 + 17).astype(">u2")
    assert (png.decode_png(make(7, 5, 0, 16, plain(wide)))[..., 0] == grey).all()
    four = np.array([[0x1F, 0x20]], np.uint8)
    assert png.decode_png(make(3, 1, 0, 4, plain(four)))[0, :, 0].tolist() == [17, 255, 34]
    both = RGBA[..., :2].copy()
    got = png.decode_png(make(7, 5, 4, 8, plain(both.reshape(5, -1))))
    assert (got[..., 0] == both[..., 0]).all() and (got[..., 3] == both[..., 1]).all()
    palette = chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", b"\x09\x08")
    got = png.decode_png(make(4, 1, 3, 2, b"\0\x1b", palette))
    assert got[0].tolist() == [[0, 1, 2, 9], [3, 4, 5, 8], [6, 7, 8, 255], [9, 10, 11, 255]]
    key = chunk(b"tRNS", struct.pack(">H", int(grey[0, 0])))
    assert png.decode_png(make(7, 5, 0, 8, plain(grey), key))[0, 0, 3] == 0


def test_interlaced():
    rows = b""
    for x0, y0, dx, dy in png.PASSES:
        part = RGBA[y0::dy, x0::dx]
        if part.size:
            rows += plain(part.reshape(part.shape[0], -1))
    assert (png.decode_png(make(7, 5, 6, 8, rows, interlaced=1)) == RGBA).all()


def test_damage():
    good = make(7, 5, 6, 8, plain(RGBA.reshape(5, -1)))
    for bad in (b"GIF", good[:40], good[:50] + b"\0" + good[51:], make(7, 5, 6, 8, b"\0"), make(7, 5, 5, 8, b"")):
        with pytest.raises(png.PngError):
            png.decode_png(bad)


def test_images_to_histograms(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(make(7, 5, 6, 8, plain(RGBA.reshape(5, -1))))
    (tmp_path / "b.png").write_bytes(b"nothing")
    pixels = png.read_pixels(spark, str(tmp_path), drop_invalid=True)
    assert pixels.count() == 35
    for mode, n in (("grayscale", 35), ("rgb", 105), ("rgba", 140)):
        got = histogram(png.colors(pixels, mode), by=("image",)).collect()
        assert len(got) == 256 and sum(r.n for r in got) == n
    with pytest.raises(Exception):
        png.read_pixels(spark, str(tmp_path)).count()


def raw_chunk(kind, body, crc=None):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body) if crc is None else crc)


def file_of(*chunks, header=(7, 5, 8, 6, 0, 0, 0)):
    return png.SIGNATURE + raw_chunk(b"IHDR", struct.pack(">IIBBBBB", *header)) + b"".join(chunks) + raw_chunk(b"IEND", b"")


IDAT = raw_chunk(b"IDAT", zlib.compress(plain(RGBA.reshape(5, -1))))
PIXELS = plain(RGBA.reshape(5, -1))


def stream(data=PIXELS, head=b"\x78\x9c", adler=None):
    return raw_chunk(b"IDAT", head + zlib.compress(data)[2:-4] + struct.pack(">I", zlib.adler32(data) if adler is None else adler))


PALETTE = raw_chunk(b"PLTE", bytes(range(12)))
INDEXED = dict(header=(4, 1, 2, 3, 0, 0, 0))
GREY = dict(header=(7, 5, 8, 0, 0, 0, 0))
RGB = dict(header=(7, 5, 8, 2, 0, 0, 0))
BROKEN = {
    "empty": (48, b""), "short": (27, file_of(IDAT)[:30]), "signature": (28, b"x" + file_of(IDAT)[1:]), "header size": (94, png.SIGNATURE + raw_chunk(b"IHDR", b"x" * 14) + IDAT), "no header": (29, png.SIGNATURE + raw_chunk(b"IDAT", b"x" * 13) + IDAT),
    "no width": (93, file_of(IDAT, header=(0, 5, 8, 6, 0, 0, 0))), "type": (31, file_of(IDAT, header=(7, 5, 8, 5, 0, 0, 0))), "depth": (37, file_of(IDAT, header=(7, 5, 4, 6, 0, 0, 0))), "packing": (32, file_of(IDAT, header=(7, 5, 8, 6, 1, 0, 0))),
    "filtering": (33, file_of(IDAT, header=(7, 5, 8, 6, 0, 1, 0))), "interlace": (34, file_of(IDAT, header=(7, 5, 8, 6, 0, 0, 2))), "header crc": (57, png.SIGNATURE + raw_chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 6, 0, 0, 0), 1) + IDAT),
    "no end": (30, file_of(IDAT)[:-12]), "cut": (64, file_of(IDAT)[:-20]), "huge chunk": (63, file_of()[:33] + b"\xff\xff\xff\xffIDAT" + b"x" * 20), "crc": (57, file_of(raw_chunk(b"IDAT", b"x", 5))), "critical": (69, file_of(raw_chunk(b"ABCD", b""), IDAT)),
    "palette size": (38, file_of(raw_chunk(b"PLTE", b"x"), **INDEXED)), "no palette": (106, file_of(raw_chunk(b"IDAT", zlib.compress(b"\0\x1b")), **INDEXED)), "alphas": (39, file_of(PALETTE, raw_chunk(b"tRNS", b"x" * 5), **INDEXED)),
    "grey key": (30, file_of(raw_chunk(b"tRNS", b"x"), **GREY)), "colour key": (41, file_of(raw_chunk(b"tRNS", b"x"), **RGB)), "key beside alpha": (42, file_of(raw_chunk(b"tRNS", b"x"))),
    "no data": (53, file_of()), "fcheck": (24, file_of(stream(head=b"\x78\x9d"))), "method": (25, file_of(stream(head=b"\x77\x09"))), "dictionary": (26, file_of(stream(head=b"\x78\x20"))), "adler": (58, file_of(stream(adler=3))),
    "deflate": (20, file_of(raw_chunk(b"IDAT", b"\x78\x9c\xff\xff\xff\xff"))), "early": (23, file_of(raw_chunk(b"IDAT", zlib.compress(PIXELS)[:-9]))), "less": (91, file_of(stream(PIXELS[:-1]))), "more": (91, file_of(stream(PIXELS + b"x"))),
    "row filter": (36, file_of(stream(b"\5" + PIXELS[1:]))), "keyword": (89, file_of(raw_chunk(b"tEXt", b"\0x"), IDAT)), "text end": (75, file_of(raw_chunk(b"zTXt", b"key"), IDAT)), "text method": (72, file_of(raw_chunk(b"zTXt", b"key\0\1xxxx"), IDAT)),
    "short text": (30, file_of(raw_chunk(b"iTXt", b"k\0"), IDAT)), "long text": (112, file_of(raw_chunk(b"zTXt", b"key\0\0" + zlib.compress(b"a" * 5000)), IDAT)), "profile": (113, file_of(raw_chunk(b"iCCP", b"key\0\0" + zlib.compress(b"a" * 5000)), IDAT)),
    "no profile": (100, file_of(raw_chunk(b"iCCP", b"key\0\0" + zlib.compress(b"")), IDAT)), "time": (73, file_of(raw_chunk(b"tIME", b"x"), IDAT)), "size": (74, file_of(raw_chunk(b"pHYs", b"x"), IDAT)), "gamma": (96, file_of(raw_chunk(b"gAMA", b"x"), IDAT)),
    "chromaticities": (97, file_of(raw_chunk(b"cHRM", b"x"), IDAT)), "intent": (98, file_of(raw_chunk(b"sRGB", b""), IDAT)), "background": (43, file_of(PALETTE, raw_chunk(b"bKGD", b"xx"), **INDEXED)), "grey background": (44, file_of(raw_chunk(b"bKGD", b"x"), **GREY)),
    "colour background": (45, file_of(raw_chunk(b"bKGD", b"x"), **RGB)), "background index": (103, file_of(PALETTE, raw_chunk(b"bKGD", b"\4"), **INDEXED)),
}


def test_every_error_has_its_number(spark):
    assert {code for code, _ in BROKEN.values()} == set(png.ERRORS)
    good = file_of(raw_chunk(b"abCd", b"anything", 1), IDAT)  # unknown ancillary chunks are passed over
    rows = [(name, data) for name, (_, data) in BROKEN.items()] + [("good", good), ("null", None)]
    files = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    read = png.decode_files(files, permissive=True, max_text=4000, max_profile=4000).collect()
    assert {r.image: r.error for r in read if r.error} == {n: c for n, (c, _) in BROKEN.items()} | {"null": 48}
    pixels = [r for r in read if r.image == "good"]
    assert len(pixels) == 35 and all(r.error is None for r in pixels) and [(r.r, r.g, r.b, r.a) for r in sorted(pixels, key=lambda r: r.pos)] == [tuple(p) for p in RGBA.reshape(-1, 4).tolist()]
    assert png.decode_files(files, drop_invalid=True, max_text=4000, max_profile=4000).select("image").distinct().count() == 1
    assert png.decode_files(files.limit(0), permissive=True).count() == 0


def test_index_beyond_the_palette_is_black():
    got = png.decode_png(file_of(raw_chunk(b"PLTE", bytes(range(6))), raw_chunk(b"IDAT", zlib.compress(b"\0\x1b")), **INDEXED))
    assert got[0].tolist() == [[0, 1, 2, 255], [3, 4, 5, 255], [0, 0, 0, 255], [0, 0, 0, 255]]


def test_chunks_and_metadata(spark):
    chunks = [
        (b"tEXt", b"Title\0caf\xe9"), (b"zTXt", b"Long\0\0" + zlib.compress(b"z" * 3000)), (b"iTXt", b"Key\0\0\0de\0Schl\xc3\xbcssel\0\xc3\xa4"), (b"iTXt", b"Packed\0\1\0\0\0" + zlib.compress("日本".encode())),
        (b"tIME", struct.pack(">H5B", 2024, 2, 29, 23, 59, 60)), (b"pHYs", struct.pack(">IIB", 3000, 4000, 1)), (b"gAMA", struct.pack(">I", 45455)), (b"cHRM", struct.pack(">8I", *range(8))), (b"sRGB", b"\2"), (b"bKGD", struct.pack(">3H", 1, 2, 3)),
        (b"iCCP", b"profile\0\0" + zlib.compress(b"abc")), (b"tIME", b"bad"), (b"prIv", b"own"),
    ]
    data = file_of(*(raw_chunk(k, b) for k, b in chunks), IDAT)
    files = spark.createDataFrame([("a", data), ("cut", data[:-5]), ("none", None), ("no", b"GIF89a")], "path string, content binary").repartition(3)
    got = png.metadata(files, max_text=2000).collect()
    a = {r.no: r for r in got if r.image == "a"}
    assert (a[1].keyword, a[1].text, a[1].error) == ("Title", "café", None) and a[2].error == 112 and a[2].text is None
    assert (a[3].language, a[3].translated, a[3].text) == ("de", "Schlüssel", "ä") and (a[4].keyword, a[4].text) == ("Packed", "日本")
    assert a[5].numbers == {"year": 2024, "month": 2, "day": 29, "hour": 23, "minute": 59, "second": 60} and a[6].numbers == {"x": 3000, "y": 4000, "unit": 1}
    assert a[7].numbers == {"gamma": 45455} and a[8].numbers["blue_y"] == 7 and a[9].numbers == {"intent": 2} and a[10].numbers == {"r": 1, "g": 2, "b": 3}
    assert a[11].numbers == {"profile_bytes": 3, "profile_crc32": zlib.crc32(b"abc")} and a[12].error == 73 and set(a) == set(range(1, 13))
    assert {(r.image, r.error) for r in got if r.type is None} == {("cut", 30), ("none", 48), ("no", 27)}
    assert len([r for r in png.metadata(files).collect() if r.image == "a" and r.text == "z" * 3000]) == 1
    rows = {(r.image, r.no): r for r in png.chunk_table(files).collect()}
    at, want = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        want.append((kind.decode(), size, at, True, None))
        at += 12 + size
    assert [tuple(rows["a", i])[2:] for i in range(len(want))] == want and rows["cut", len(want) - 1].error == 30
    assert rows["none", 0].error == 48 and rows["no", 0].error == 28 and len(rows) == 2 * len(want) + 2


def test_written_images_read_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    shape, images = (12, 9), {}
    grey = lambda v: np.stack([v, v, v, np.full_like(v, 255)], -1)
    for bits in (1, 2, 4, 8):
        images[f"grey{bits}"] = grey(rng.integers(0, 1 << bits, shape) * (255 // ((1 << bits) - 1)))
    images["grey-alpha"] = np.stack([*[rng.integers(0, 256, shape)] * 3, rng.integers(0, 256, shape)], -1)
    images["grey-key"] = np.where(rng.random(shape)[..., None] < 0.2, np.zeros(4, int), grey(17 * rng.integers(1, 16, shape)))
    for n in (2, 4, 16, 50):
        images[f"palette{n}"] = rng.integers(0, 256, (n, 4))[rng.integers(0, n, shape)]
    images["rgb"] = np.concatenate([rng.integers(0, 256, (*shape, 3)), np.full((*shape, 1), 255)], -1)
    images["rgba"] = rng.integers(0, 256, (*shape, 4))
    images["rgb-key"] = np.where(rng.random(shape)[..., None] < 0.2, np.array([1, 2, 3, 0]), images["rgb"])
    rows = [(n, i, *map(int, p), "x") for n, image in images.items() for i, p in enumerate(image.reshape(-1, 4))]
    pixels = spark.createDataFrame(rows, "image string, pos long, r int, g int, b int, a int, y string").repartition(5)
    folder = f"file://{tmp_path}/out"
    for strategy in ("minsum", "entropy"):
        files = png_write.encode_images(pixels, 9, strategy)
        paths = {r.image: r.path for r in png_write.write_files(files, folder).collect()}
        kinds = {}
        for n, image in images.items():
            data = open(paths[n], "rb").read()
            kinds[n] = tuple(data[24:26])
            assert (png.decode_png(data) == image).all(), n
        assert kinds["grey1"] == (1, 0) and kinds["grey2"] == (2, 0) and kinds["grey-key"] == (4, 0) and kinds["grey-alpha"] == (8, 4) and kinds["palette4"] == (2, 3) and kinds["rgb-key"] == (8, 2) and kinds["rgba"] == (8, 6)
    assert png.read_pixels(spark, folder).count() == len(rows) and len(list((tmp_path / "out").glob("*"))) == len(images)
    with pytest.raises(Exception, match="whole rows"):
        png_write.encode_images(pixels.where("pos < 10"), 9).collect()
    assert png_write.encode_images(pixels.limit(0), 9).count() == 0


def test_a_file_is_made_from_rows_one_by_one(spark):
    """No task gets a whole image, or thousands of them, in one batch: with one row a batch the files are the same."""
    rows = [(k, i, (i * k) % 256, i % 7, k, 255 if i % 9 else k) for k in range(1, 12) for i in range(16 * (k % 4 + 1))]
    pixels = spark.createDataFrame(rows, "image long, pos long, r int, g int, b int, a int").repartition(3)
    whole = {r.image: bytes(r.content) for r in png_write.encode_images(pixels, 8).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        files = png_write.encode_images(pixels, 8)
        assert {r.image: bytes(r.content) for r in files.collect()} == whole and len(whole) == 11
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list(struct(y" not in files._jdf.queryExecution().executedPlan().toString()
    for k, data in whole.items():
        assert [tuple(map(int, p)) for p in png.decode_png(data).reshape(-1, 4)] == [r[2:] for r in rows if r[0] == k]


def test_chunks_of_streamed_files(spark, tmp_path):
    rows = [(k, i, k, i % 5, i % 3, 255) for k in (1, 2, 3) for i in range(40 * k)]
    files = png_write.encode_images(spark.createDataFrame(rows, "image long, pos long, r int, g int, b int, a int"), 8)
    assert "MapInPandas" not in files._jdf.queryExecution().executedPlan().toString()
    written = {r.image: r.path for r in png_write.write_files(files, f"file://{tmp_path}/out").collect()}
    assert set(written) == {1, 2, 3}
    found = png.chunk_table(spark.read.format("binaryFile").load(f"file://{tmp_path}/out")).orderBy("image", "no").collect()
    assert [r.type for r in found] == ["IHDR", "PLTE", "IDAT", "IEND"] * 3 and all(r.crc_ok and r.error is None for r in found)


def test_a_task_makes_and_writes_files_in_one_worker(spark, tmp_path, monkeypatch):
    from sparkloom import staging
    from sparkloom.plans import images

    lines = [(o, o % 13, s, o % 4) for s in (1, 8, 11) for o in range(20 * s)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, write = {}, staging.Stage.write
    monkeypatch.setattr(staging.Stage, "write", lambda self, df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(self, df, name))
    folder = images.image_folder(spark, str(tmp_path))
    initial = plans["written"].rpartition("== Initial Plan ==")[2]
    assert initial.count("MapInArrow") == 1  # one worker behind another doubles an executor's Python
    pixels = {(r.image.rsplit("/", 1)[1], r.pos): (r.r, r.g, r.b, r.a) for r in png.read_pixels(spark, folder).collect()}
    want = {(f"{r.image}.png", r.pos): (r.r, r.g, r.b, r.a) for r in images.full_raster(spark, str(tmp_path)).collect()}
    assert pixels == want and {name for name, _ in want} == {"1.png", "8.png", "11.png"}
