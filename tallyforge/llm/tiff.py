"""TIFF columns: binary files in, one row per page out.

``tiff_pages`` walks each file's chain of image directories, decodes its strips or tiles
(stored plain, PackBits, LZW or deflate), undoes the horizontal or floating-point
predictor and emits the samples of every page.  ``text_to_tiff`` stores texts as pages
of 8-bit samples.

A null file gives no row.  A file that is damaged gives the pages before the damage and
one row with ``error`` set.  Rows are independent: repeated rows, ties and empty tables
need no special case; the input's columns come along inside the struct ``row``, so no
name can clash.  A page is decoded at once, so a task holds one page besides its batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values of the format: tags, field types, compression codes ---
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PLAIN, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST = 256, 257, 258
# --- end of fixed values ---


def packbits_decode(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n != 128)
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    cuts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)])) if len(a) else np.array([0])
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo < 3:
            literal += data[lo:hi]
            continue
        flush()
        for k in range(lo, hi, 128):
            n = min(128, hi - k)
            out += bytes(((257 - n) & 255, data[k])) if n > 1 else bytes((0, data[k]))
    flush()
    return bytes(out)


def lzw_decode(data: bytes, most: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, last = list(base), [], b""
    bits = held = made = 0
    width = 9
    for byte in data:
        if made >= most:
            break
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(base), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        made += len(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:  # the width grows one code early
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, held, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = (bits << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1

    put(CLEAR)
    word, nxt = b"", FIRST
    code_of = lambda w: w[0] if len(w) == 1 else table[w]
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(code_of(word))
        table[longer] = nxt
        nxt += 1
        if nxt + 1 > 4095:
            put(CLEAR)
            table.clear()
            nxt, width = FIRST, 9
        elif nxt >= 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(code_of(word))
        if nxt + 1 >= 1 << width and width < 12:
            width += 1
    put(END)
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, max(1, most))
    if len(out) < most and not d.eof:
        raise ValueError("deflate data end early")
    return out


#: From packed bytes and the bytes that are needed to these; no more are made.
DECODERS = {PLAIN: lambda data, most: data[:most], LZW: lzw_decode, DEFLATE: inflate, DEFLATE_OLD: inflate, PACKBITS: packbits_decode}
ENCODERS = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}


def _small_samples(raw: bytes, rows: int, cols: int, samples: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, the first in a byte's highest bits; rows begin at whole bytes."""
    line = -(-cols * samples * bits // 8)
    packed = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line, 1)
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((packed >> shifts) & np.uint8((1 << bits) - 1)).reshape(rows, -1)[:, : cols * samples].reshape(rows, cols, samples)


def _undo_predictor(raw: bytes, rows: int, cols: int, samples: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """Samples of a strip or tile, shaped (rows, cols, samples)."""
    if predictor == 3:  # bytes of equal weight stand together, most significant first
        size = dtype.itemsize
        planes = np.frombuffer(raw, np.uint8).reshape(rows, size * cols * samples)
        planes = np.cumsum(planes.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, cols * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, cols, samples)
    a = np.frombuffer(raw, dtype).reshape(rows, cols, samples)
    if predictor == 2:
        a = np.cumsum(a.astype(dtype.newbyteorder("=")), axis=1, dtype=dtype.newbyteorder("="))
    return a


def directories(data: bytes) -> Iterator[tuple[dict[int, tuple], str]]:
    """(tags, byte order) of each page, in directory order."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories run in a circle")
        seen.add(at)
        tags: dict[int, tuple] = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPES:
                size, where = count * struct.calcsize(order + TYPES[kind]), at + 10 + 12 * k
                if size > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                if where + size <= len(data):  # a tag that points outside the file is none
                    tags[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, where)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        yield tags, order


def read_tiff(data: bytes) -> Iterator[dict]:
    """Each page's geometry and samples (rows, cols, samples), in directory order."""
    for page, (tags, order) in enumerate(directories(data)):
        yield {"page": page} | _page(data, tags, order)


#: Pages go on in batches of about so many bytes of pixels.
BATCH_BYTES = 4 << 20
#: No compression here makes more than so many bytes of one.
EXPANSION = 4096


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    bits, form, packing, predictor = one(BITS, 1), one(SAMPLE_FORMAT, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    small = bits in (1, 2, 4)
    if not small and bits not in (8, 16, 32, 64) or packing not in DECODERS or small and predictor != 1:
        raise ValueError(f"{bits} bits with compression {packing} and predictor {predictor} are not supported")
    if width * height * samples * bits > 8 * EXPANSION * len(data):
        raise ValueError(f"{width} x {height} samples cannot come from {len(data)} bytes")
    dtype = np.dtype(np.uint8) if small else np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}.get(form, 'u') }{bits // 8}")
    planes = samples if one(PLANAR, 1) == 2 else 1
    inside = samples // planes
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if w * h * inside * bits > 8 * EXPANSION * len(data):
        raise ValueError(f"tiles of {w} x {h} samples cannot come from {len(data)} bytes")
    image = np.zeros((height, width, samples), dtype.newbyteorder("="))
    across, down = -(-width // w), -(-height // h)
    for k, (off, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, cell = divmod(k, across * down)
        y, x = (cell // across) * h, (cell % across) * w
        rows = h if tiled else min(h, height - y)
        need = rows * -(-w * inside * bits // 8)
        raw = DECODERS[packing](data[off : off + size], need)[:need]
        block = _small_samples(raw, rows, w, inside, bits) if small else _undo_predictor(raw, rows, w, inside, dtype, predictor)
        image[y : y + rows, x : x + w, plane * inside : (plane + 1) * inside] = block[: height - y, : width - x]
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": packing, "predictor": predictor, "image": image}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 512, tile: int = 0) -> bytes:
    """A little-endian file of unsigned 8- or 16-bit pages, shaped (rows, cols, samples)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for p in pages:
        height, width, samples = p.shape
        blocks = []
        for y in range(0, height, tile or strip_rows):
            for x in range(0, width, tile or width):
                block = p[y : y + (tile or strip_rows), x : x + (tile or width)]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                blocks.append(ENCODERS[compression](np.ascontiguousarray(block).tobytes()))
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
        fields = {WIDTH: (width,), LENGTH: (height,), BITS: (8 * p.itemsize,), COMPRESSION: (compression,), PHOTOMETRIC: (1,), SAMPLES: (samples,), PREDICTOR: (predictor,)}
        counts = tuple(len(b) for b in blocks)
        fields |= {TILE_WIDTH: (tile,), TILE_LENGTH: (tile,), TILE_OFFSETS: tuple(offsets), TILE_COUNTS: counts} if tile else {ROWS_PER_STRIP: (strip_rows,), STRIP_OFFSETS: tuple(offsets), STRIP_COUNTS: counts}
        entries = bytearray()
        for tag, values in sorted(fields.items()):
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(packed) > 4:
                packed, where = struct.pack("<I", len(out)), packed
                out += where
            entries += struct.pack("<HHI", tag, 4, len(values)) + packed
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0)
    return bytes(out)


PAGE_TYPE = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"
PAGE_COLUMNS = [c.split()[0] for c in PAGE_TYPE.split(", ")]


DAMAGE = (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error)


def tiff_pages(df: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per page: the struct ``row`` of the input's other columns and the page.  A page
    that cannot be read is a row with the error, and so is what is wrong with a file; the
    pages behind a bad page are read."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != content_col]
    slim = df.select(F.struct(*(rest or [F.lit(None).cast("string").alias("none")])).alias("row"), F.col(f"`{content_col}`").alias("content"))

    def each(data: bytes) -> Iterator[dict]:
        page, found = 0, directories(data)
        while True:
            failed = dict.fromkeys(PAGE_COLUMNS) | {"page": page}
            try:
                tags, order = next(found)
            except StopIteration:
                return
            except DAMAGE as e:
                yield failed | {"error": str(e)[:200] or type(e).__name__}
                return
            try:
                got = _page(data, tags, order)
                yield {"page": page, "error": None, "pixels": got.pop("image").tobytes()} | got
            except DAMAGE as e:
                yield failed | {"error": str(e)[:200] or type(e).__name__}
            page += 1

    def packed(b: pa.RecordBatch, at: list[int], pages: list[dict]) -> pa.RecordBatch:
        cols = [pa.array([p[c] for p in pages], pa.binary() if c == "pixels" else pa.string() if c == "error" else pa.int32()) for c in PAGE_COLUMNS]
        return pa.RecordBatch.from_arrays([b.column("row").take(pa.array(at, pa.int64())), *cols], names=["row", *PAGE_COLUMNS])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pages, held = [], [], 0
            for i, data in enumerate(b.column("content")):
                for got in each(data.as_py()) if data.is_valid else ():
                    at.append(i)
                    pages.append(got)
                    held += len(got["pixels"] or b"")
                    if held > BATCH_BYTES or len(pages) == 1000:
                        yield packed(b, at, pages)
                        at, pages, held = [], [], 0
            if pages:
                yield packed(b, at, pages)

    kind = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(decode, f"row {kind}, {PAGE_TYPE}")


def payload_pages(payload: bytes, width: int = 64, page_rows: int = 16384) -> list[np.ndarray]:
    a = np.frombuffer(payload, np.uint8).reshape(-1, width, 1)
    return [a[k : k + page_rows] for k in range(0, len(a), page_rows)]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


def text_to_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE) -> DataFrame:
    """doc_id, n_bytes and the file of each text (null: empty), zero-padded to rows of 64 samples."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):  # files of a few hundred rows at a time
                part = b.slice(k, 256)
                texts = [padded(t) for t in part.column("text").to_pylist()]
                media = [write_tiff(payload_pages(p), compression) for _, p in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


class Features:
    """What a document's pages add up to: the hash of all pixels, the last 64 of them, pages,
    rows, mean sample and an 8-bin histogram."""

    def __init__(self) -> None:
        self.hash, self.tail, self.size = hashlib.sha256(), b"", 0
        self.pages, self.rows, self.counts = 0, 0, np.zeros(256, np.int64)

    def add(self, pixels: bytes, height: int) -> None:
        self.hash.update(pixels)
        self.tail, self.size = (self.tail + pixels[-64:])[-64:], self.size + len(pixels)
        self.pages, self.rows = self.pages + 1, self.rows + height
        self.counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)

    def text(self) -> str:
        mean = float(self.counts @ np.arange(256)) / max(1, self.counts.sum())
        return f"pages={self.pages};rows={self.rows};mean={mean:.4f};hist={','.join(map(str, self.counts.reshape(8, 32).sum(1)))}"


DIGEST_TYPE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, all taken from the page rows of the stored files.

    The pages of a file follow one another where they were read, so they are added up in
    passing: a task holds the features of one document."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, Features()

        def done() -> tuple:
            return now[1], now[2], total.size, total.hash.hexdigest(), zlib.crc32(total.tail), now[3], now[4], total.text()

        for b in batches:
            rows, out = b.column("row").to_pylist(), []
            for row, pixels, height, error in zip(rows, b.column("pixels").to_pylist(), b.column("height").to_pylist(), b.column("error").to_pylist(), strict=True):
                if error is not None:
                    raise ValueError(f"a stored page cannot be read: {error}")
                key = (row["file"], row["doc_id"], row["n_bytes"], row["media_bytes"], row["media_sha256"])
                if now is not None and key != now:
                    out.append(done())
                    total = Features()
                now = key
                total.add(pixels, height)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], names=[c.split()[0] for c in DIGEST_TYPE.split(", ")])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(done(), KINDS, strict=True)], names=[c.split()[0] for c in DIGEST_TYPE.split(", ")])

    files = text_to_tiff(docs).select(F.monotonically_increasing_id().alias("file"), "doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return tiff_pages(files, "media").mapInArrow(added, DIGEST_TYPE)
