"""PNG rasters as pixel tables, and their chunks and metadata as rows.

Spark's own image source gives other channel orders and depths, so files are read as
binary and decoded by zlib and numpy: all colour types and depths, palettes, colour keys
and interlacing, to eight bits a channel. A damaged file stops the read, is left out, or
becomes a row with the code of what is wrong.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type, and the passes of an interlaced image (x0, y0, dx, dy).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: What is wrong with a file, by the format's customary error numbers.
ERRORS = {
    20: "damaged compressed data", 23: "compressed data end early", 24: "wrong check bits of the compressed stream", 25: "unknown method of the compressed stream",
    26: "compressed stream with a dictionary", 27: "file shorter than a header", 28: "no PNG signature", 29: "first chunk is no header", 30: "file ends where a chunk should begin, or a chunk is too short",
    31: "unknown colour type", 32: "unknown compression method", 33: "unknown filter method", 34: "unknown interlace method", 36: "unknown row filter", 37: "bit depth doesn't fit the colour type",
    38: "palette without colours, or with too many", 39: "transparency for more colours than the palette has", 41: "transparency of a colour image has the wrong size", 42: "transparency beside an alpha channel",
    43: "background of a palette image has the wrong size", 44: "background of a grey image has the wrong size", 45: "background of a colour image has the wrong size", 48: "empty file", 53: "compressed stream too short",
    57: "wrong CRC", 58: "wrong Adler-32", 63: "chunk too long", 64: "file ends inside a chunk", 69: "unknown critical chunk", 72: "unknown compression of a text", 73: "time has the wrong size", 74: "pixel size has the wrong size",
    75: "text without its separators", 89: "keyword of no or of more than 79 bytes", 91: "image data of the wrong size", 93: "no width or height", 94: "header of the wrong size", 96: "gamma has the wrong size",
    97: "chromaticities have the wrong size", 98: "rendering intent has the wrong size", 100: "empty colour profile", 103: "background colour not in the palette", 106: "no palette", 112: "text too large", 113: "colour profile too large",
}
#: Chunks whose CRC counts; other ancillary chunks are passed over.
KNOWN = frozenset((b"IHDR", b"IDAT", b"IEND", b"PLTE", b"tRNS", b"bKGD", b"tEXt", b"zTXt", b"iTXt", b"tIME", b"pHYs", b"gAMA", b"cHRM", b"sRGB", b"iCCP"))
#: Largest text and colour profile that are inflated; parameters of the readers.
MAX_TEXT = MAX_PROFILE = 16 << 20
#: Rows of one output batch; an image is decoded as a whole, its pixels leave in slices.
SLICE = 1 << 18


class PngError(ValueError):
    def __init__(self, code: int, detail: object = None):
        self.code = code
        super().__init__(f"{ERRORS[code]} (error {code})" + (f": {detail}" if detail is not None else ""))


def walk_chunks(read: Callable[[int, int], bytes], size: int, with_body: Callable[[bytes], bool]) -> Iterator[tuple[int, bytes, int, bytes | None, int | None]]:
    """(offset, type, length, body, crc) of each chunk up to the end chunk; ``read(at, n)`` gives n bytes of the file.

    Bodies of types that ``with_body`` doesn't want are neither read nor summed up. A chunk that the file can't hold raises its error.
    """
    at = len(SIGNATURE)
    while True:
        if at + 12 > size:
            raise PngError(30)
        length, kind = struct.unpack(">I4s", read(at, 8))
        if length > 0x7FFFFFFF:
            raise PngError(63)
        if at + 12 + length > size:
            raise PngError(64, kind)
        body = crc = None
        if with_body(kind):
            rest = read(at + 8, length + 4)
            body, crc = rest[:length], struct.unpack(">I", rest[length:])[0]
        yield at, kind, length, body, crc
        if kind == b"IEND":
            return
        at += 12 + length


def _header(data: bytes) -> tuple[int, int, int, int, int]:
    """(width, height, depth, colour type, interlaced)."""
    if not data:
        raise PngError(48)
    if len(data) < 33:
        raise PngError(27)
    if data[:8] != SIGNATURE:
        raise PngError(28)
    size, kind, width, height, depth, color, packing, filtering, interlaced, crc = struct.unpack(">I4sIIBBBBBI", data[8:33])
    if size != 13:
        raise PngError(94)
    if kind != b"IHDR":
        raise PngError(29)
    if not width or not height:
        raise PngError(93)
    if color not in CHANNELS:
        raise PngError(31, color)
    if depth not in DEPTHS[color]:
        raise PngError(37, depth)
    for code, wrong in ((32, packing), (33, filtering), (34, interlaced > 1)):
        if wrong:
            raise PngError(code)
    if crc != zlib.crc32(data[12:29]):
        raise PngError(57, "IHDR")
    return width, height, depth, color, interlaced


def inflate(data: bytes, most: int, too_large: int) -> bytes:
    """The contents of a compressed stream of at most ``most`` bytes; more are error ``too_large``."""
    if len(data) < 2:
        raise PngError(53)
    if (data[0] * 256 + data[1]) % 31:
        raise PngError(24)
    if data[0] & 15 != 8 or data[0] >> 4 > 7:
        raise PngError(25)
    if data[1] & 32:
        raise PngError(26)
    stream = zlib.decompressobj(-15)
    try:
        out = stream.decompress(data[2:], most + 1)
    except zlib.error as e:
        raise PngError(20, e) from e
    if len(out) > most:
        raise PngError(too_large)
    if not stream.eof:
        raise PngError(23)
    if stream.unused_data[:4] != struct.pack(">I", zlib.adler32(out)):
        raise PngError(58)
    return out


def _keyword(body: bytes, behind: int) -> tuple[str, int]:
    """A text chunk's keyword and where it ends; ``behind`` bytes at least must follow."""
    end = body.find(b"\0")
    end = len(body) if end < 0 else end
    if behind and end + behind >= len(body):
        raise PngError(75)
    if not 1 <= end <= 79:
        raise PngError(89)
    return body[:end].decode("latin-1"), end


def read_metadata(kind: bytes, body: bytes, color: int, palette_size: int, max_text: int = MAX_TEXT, max_profile: int = MAX_PROFILE) -> dict | None:
    """A metadata chunk's fields: keyword, language, translated, text and numbers (a map); None for other chunks.

    ``color`` is the image's colour type and ``palette_size`` the colours of the palette so far.
    """
    numbers = lambda names, form: dict(zip(names.split(), struct.unpack(form, body)))
    if kind == b"tEXt":
        key, end = _keyword(body, 0)
        return {"keyword": key, "text": body[end + 1 :].decode("latin-1")}
    if kind == b"zTXt":
        key, end = _keyword(body, 2)
        if body[end + 1]:
            raise PngError(72)
        return {"keyword": key, "text": inflate(body[end + 2 :], max_text, 112).decode("latin-1")}
    if kind == b"iTXt":
        if len(body) < 5:
            raise PngError(30)
        key, end = _keyword(body, 3)
        packed, method = body[end + 1], body[end + 2]
        if method:
            raise PngError(72)
        language, _, rest = body[end + 3 :].partition(b"\0")
        translated, _, text = rest.partition(b"\0")
        text = inflate(text, max_text, 112) if packed else text
        return {"keyword": key, "language": language.decode("latin-1"), "translated": translated.decode("utf-8", "replace"), "text": text.decode("utf-8", "replace")}
    if kind == b"iCCP":
        key, end = _keyword(body, 2)
        profile = inflate(body[end + 2 :], max_profile, 113)
        if not profile:
            raise PngError(100)
        return {"keyword": key, "numbers": {"profile_bytes": len(profile), "profile_crc32": zlib.crc32(profile)}}
    for name, size, code, names, form in (
        (b"tIME", 7, 73, "year month day hour minute second", ">H5B"), (b"pHYs", 9, 74, "x y unit", ">IIB"), (b"gAMA", 4, 96, "gamma", ">I"),
        (b"cHRM", 32, 97, "white_x white_y red_x red_y green_x green_y blue_x blue_y", ">8I"), (b"sRGB", 1, 98, "intent", ">B"),
    ):
        if kind == name:
            if len(body) != size:
                raise PngError(code)
            return {"numbers": numbers(names, form)}
    if kind == b"bKGD":
        size, code, names, form = {3: (1, 43, "index", ">B"), 0: (2, 44, "grey", ">H"), 4: (2, 44, "grey", ">H")}.get(color, (6, 45, "r g b", ">3H"))
        if len(body) != size:
            raise PngError(code)
        if color == 3 and body[0] >= palette_size:
            raise PngError(103)
        return {"numbers": numbers(names, form)}
    return None


def _check_transparency(body: bytes, color: int, palette_size: int) -> None:
    if color == 3 and len(body) > palette_size:
        raise PngError(39)
    if color == 0 and len(body) != 2:
        raise PngError(30)
    if color == 2 and len(body) != 6:
        raise PngError(41)
    if color in (4, 6):
        raise PngError(42)


def _unfilter(raw: bytes, at: int, height: int, stride: int, step: int) -> tuple[np.ndarray, int]:
    """Filtered rows to bytes; ``step`` is the distance to the pixel on the left."""
    if at + height * (1 + stride) > len(raw):
        raise PngError(91)
    rows = np.frombuffer(raw, np.uint8, height * (1 + stride), at).reshape(height, 1 + stride)
    kinds, width = rows[:, 0], stride // step
    if kinds.max() > 4:
        raise PngError(36, int(kinds.max()))
    # A byte needs those on its left, above and above left: all bytes of a diagonal are ready at once.
    out = np.zeros((height + 1, width + 1, step), np.int32)
    out[1:, 1:] = rows[:, 1:].reshape(height, width, step)
    if (kinds > 2).any():
        for d in range(width + height - 1):
            y = np.arange(max(0, d - width + 1), min(height - 1, d) + 1)
            x, kind = d - y, kinds[y][:, None]
            left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
            base = left + above - corner
            by_left, by_above, by_corner = abs(base - left), abs(base - above), abs(base - corner)
            nearest = np.where((by_left <= by_above) & (by_left <= by_corner), left, np.where(by_above <= by_corner, above, corner))
            guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)
            out[y + 1, x + 1] = (out[y + 1, x + 1] + guess) & 255
    else:
        for y in range(height):
            if kinds[y] == 1:
                out[y + 1, 1:] = np.cumsum(out[y + 1, 1:], axis=0) & 255
            elif kinds[y] == 2:
                out[y + 1] = (out[y + 1] + out[y]) & 255
    return out[1:, 1:].reshape(height, stride).astype(np.uint8), at + height * (1 + stride)


def _samples(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(height, width, channels) samples at their own depth."""
    if depth == 8:
        flat = rows.astype(np.int32)
    elif depth == 16:
        flat = (rows[:, 0::2].astype(np.int32) << 8) | rows[:, 1::2]
    else:
        bits = np.unpackbits(rows, axis=1)
        flat = bits[:, : bits.shape[1] // depth * depth].reshape(rows.shape[0], -1, depth).astype(np.int32) @ (1 << np.arange(depth)[::-1])
    return flat[:, : width * channels].reshape(rows.shape[0], width, channels)


def _row_bytes(width: int, bits: int) -> int:
    return (width * bits + 7) // 8


def _passes(width: int, height: int, interlaced: int) -> list[tuple[int, ...]]:
    """(x0, y0, dx, dy, width, height) of the passes that have pixels."""
    sized = ((x0, y0, dx, dy, -(-(width - x0) // dx), -(-(height - y0) // dy)) for x0, y0, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),)))
    return [p for p in sized if p[4] > 0 and p[5] > 0]


def decode_png(data: bytes, max_text: int = MAX_TEXT, max_profile: int = MAX_PROFILE) -> np.ndarray:
    """(height, width, 4) bytes: red, green, blue, alpha.

    Sixteen-bit samples keep their high byte, smaller grey depths are scaled to 255, an index
    beyond the palette is black. Metadata chunks are checked as they pass.
    """
    width, height, depth, color, interlaced = _header(data)
    palette, key, body = None, None, []
    for at, kind, _, chunk, crc in walk_chunks(lambda at, n: data[at : at + n], len(data), KNOWN.__contains__):
        if kind == b"PLTE":
            n = len(chunk) // 3
            if not 1 <= n <= 256:
                raise PngError(38)
            palette = np.frombuffer(chunk[: 3 * n], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            _check_transparency(chunk, color, 0 if palette is None else len(palette))
            key = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind not in KNOWN and not kind[0] & 32 or kind == b"IHDR" and at > len(SIGNATURE):
            raise PngError(69, kind)
        elif kind in KNOWN:
            read_metadata(kind, chunk, color, 0 if palette is None else len(palette), max_text, max_profile)
        if kind in KNOWN and crc != zlib.crc32(kind + chunk):
            raise PngError(57, kind)
    if color == 3 and palette is None:
        raise PngError(106)
    passes = _passes(width, height, interlaced)
    bits = CHANNELS[color] * depth
    expected = sum(h * (1 + _row_bytes(w, bits)) for *_, w, h in passes)
    raw = inflate(b"".join(body), expected, 91)
    if len(raw) != expected:
        raise PngError(91)
    n = CHANNELS[color]
    image, at = np.zeros((height, width, n), np.int32), 0
    for x0, y0, dx, dy, w, h in passes:
        rows, at = _unfilter(raw, at, h, _row_bytes(w, bits), max(1, bits // 8))
        image[y0::dy, x0::dx] = _samples(rows, w, n, depth)
    out = np.full((height, width, 4), 255, np.uint8)
    if color == 3:
        whole, alpha = np.zeros((256, 3), np.uint8), np.full(256, 255, np.uint8)
        whole[: len(palette)] = palette
        if key:
            alpha[: len(key)] = np.frombuffer(key, np.uint8)
        out[..., :3], out[..., 3] = whole[image[..., 0]], alpha[image[..., 0]]
        return out
    to8 = (lambda x: x >> 8) if depth == 16 else (lambda x: x * 255 // ((1 << depth) - 1))
    out[..., :3] = to8(image[..., :3] if n >= 3 else image[..., :1])
    if n in (2, 4):
        out[..., 3] = to8(image[..., -1])
    elif key:
        out[..., 3] = np.where((image == np.array(struct.unpack(f">{n}H", key[: 2 * n]))).all(axis=2), 0, 255)
    return out


def encode_rgba(image: np.ndarray) -> bytes:
    """A PNG file of (height, width, 4) bytes; rows take the filters none, left and above in turn."""
    height, width, _ = image.shape
    rows = image.reshape(height, -1)
    left = np.concatenate([np.zeros((height, 4), np.uint8), rows[:, :-4]], axis=1)
    above = np.concatenate([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])
    guess = [np.zeros_like(rows), left, above]
    raw = b"".join(bytes([y % 3]) + (rows[y] - guess[y % 3][y]).tobytes() for y in range(height))
    parts = ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in parts)


def read_pixels(spark: SparkSession, path: str, drop_invalid: bool = False, permissive: bool = False) -> DataFrame:
    """(image, pos, r, g, b, a), one row a pixel, of all files under ``path``."""
    return decode_files(spark.read.format("binaryFile").load(path), drop_invalid, permissive)


def decode_files(files: DataFrame, drop_invalid: bool = False, permissive: bool = False, max_text: int = MAX_TEXT, max_profile: int = MAX_PROFILE) -> DataFrame:
    """The same for a table of (path, content); null content is an empty file.

    A damaged file stops the read, is left out (``drop_invalid``), or is one row without a
    pixel whose column ``error`` has its number in ``ERRORS`` (``permissive``; null in pixels' rows).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                try:
                    flat = decode_png(bytes(data) if data is not None else b"", max_text, max_profile).reshape(-1, 4)
                except PngError as e:
                    if permissive:
                        yield pd.DataFrame({"image": [name], **{c: pd.array([None], "Int64") for c in ("pos", "r", "g", "b", "a")}, "error": pd.array([e.code], "Int64")})
                    elif not drop_invalid:
                        e.args = (f"{name}: {e}",)
                        raise
                    continue
                for at in range(0, len(flat), SLICE):
                    part = flat[at : at + SLICE].astype(np.int32)
                    rows = {"image": name, "pos": np.arange(at, at + len(part)), "r": part[:, 0], "g": part[:, 1], "b": part[:, 2], "a": part[:, 3]}
                    yield pd.DataFrame(rows | ({"error": pd.array([None] * len(part), "Int64")} if permissive else {}))

    schema = "image string, pos long, r int, g int, b int, a int" + ", error int" * permissive
    return files.select("path", "content").mapInPandas(run, schema)


CHUNKS = "image string, no int, type string, length long, offset long, crc_ok boolean, error int"


def chunk_rows(name: str, read: Callable[[int, int], bytes], size: int, check: bool = True) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` of one file; what ends the walk early is a last row with its error and no type."""
    no = 0
    try:
        if not size:
            raise PngError(48)
        if read(0, min(8, size)) != SIGNATURE:
            raise PngError(28)
        for at, kind, length, body, crc in walk_chunks(read, size, lambda _: check):
            yield name, no, kind.decode("latin-1"), length, at, crc == zlib.crc32(kind + body) if check else None, None
            no += 1
    except PngError as e:
        yield name, no, None, None, None, None, e.code


def chunk_table(files: DataFrame) -> DataFrame:
    """(image, no, type, length, offset, crc_ok, error), one row a chunk, of a table of (path, content).

    Nothing is inflated or decoded, and unknown chunks have rows too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                rows = list(chunk_rows(name, lambda at, n, data=data: data[at : at + n].to_pybytes(), data.size))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CHUNK_TYPES)], names=_CHUNK_NAMES)

    return files.select("path", "content").mapInArrow(run, CHUNKS)


_CHUNK_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]
_CHUNK_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
METADATA = "image string, no int, type string, keyword string, language string, translated string, text string, numbers map<string,long>, error int"


def metadata(files: DataFrame, max_text: int = MAX_TEXT, max_profile: int = MAX_PROFILE) -> DataFrame:
    """Rows of ``METADATA``, one a metadata chunk, of a table of (path, content).

    A chunk that can't be read, or whose text is larger than ``max_text`` bytes, is a row with its error; no
    more than that is inflated. A damaged header or chunk order ends the file's rows with the error.
    """

    def rows_of(name: str, data: bytes) -> Iterator[dict]:
        no, palette = 0, 0
        try:
            *_, color, _ = _header(data)
            for _, kind, length, body, crc in walk_chunks(lambda at, n: data[at : at + n], len(data), lambda k: k in KNOWN and k != b"IDAT"):
                try:
                    palette = length // 3 if kind == b"PLTE" else palette
                    if found := body is not None and read_metadata(kind, body, color, palette, max_text, max_profile):
                        if crc != zlib.crc32(kind + body):
                            raise PngError(57)
                        yield {"image": name, "no": no, "type": kind.decode("latin-1"), **found}
                except PngError as e:
                    yield {"image": name, "no": no, "type": kind.decode("latin-1"), "error": e.code}
                no += 1
        except PngError as e:
            yield {"image": name, "no": no, "error": e.code}

    kinds = pa.schema([("image", pa.string()), ("no", pa.int32()), *((c, pa.string()) for c in ("type", "keyword", "language", "translated", "text")), ("numbers", pa.map_(pa.string(), pa.int64())), ("error", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = list(rows_of(name, content.as_py() or b""))
                columns = [pa.array([list(r[f.name].items()) if f.name == "numbers" and f.name in r else r.get(f.name) for r in rows], f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return files.select("path", "content").mapInArrow(run, METADATA)


def colors(pixels: DataFrame, mode: str = "rgb") -> DataFrame:
    """(image, color): grey levels, or the channels' bytes; alpha counts in "rgba" alone."""
    from sparkloom.functions.scalars import luma

    if mode == "grayscale":
        return pixels.select("image", luma("r", "g", "b").alias("color"))
    names = {"rgb": ("r", "g", "b"), "rgba": ("r", "g", "b", "a")}[mode]
    return pixels.select("image", F.explode(F.array(*names)).alias("color"))
