"""TIFF media columns: write byte payloads as multi-page 8-bit images, walk image directories (classic and big files),
decode PackBits, LZW and deflate strips or tiles, undo predictors, and give one row per page.

Samples of 8 bits and more come out as stored, in the file's byte order; samples of 1, 2 or 4 bits as one byte each.

Defined results: a null blob has no pages; a page that cannot be read (damaged, of an unknown form, or above
``MOST_BYTES`` decoded, which a binary value could not hold) gives a row with ``error`` set, and reading goes on
with the next directory; a blob that is no TIFF, or whose chain of directories breaks off or forms a loop, gives the
pages up to there and one row with ``error`` set; an empty text is stored as one row of bytes 255. Rows are
independent, so ties, repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import BATCH_BYTES, map_rows

WIDTH = 576  # samples in a row of an image; payloads are padded to a multiple of it
PAGE_ROWS = 256  # rows of a page; longer payloads get more pages
MOST_BYTES = 1 << 30  # decoded bytes of a page
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Fixed values of the format: bytes and form of each field type that is read.
FIELDS = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: The most bytes that a stored byte of each compression can stand for.
MOST_GROWTH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


class TiffError(ValueError):
    pass


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes
    error: str | None = None


# ---- codecs -----------------------------------------------------------------------------------


def packbits_pack(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(start: int, end: int) -> None:
        for i in range(start, end, 128):
            piece = data[i : min(i + 128, end)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in _RUN.finditer(data):
        literal(at, m.start())
        out.append(257 - (m.end() - m.start()))
        out.append(data[m.start()])
        at = m.end()
    literal(at, len(data))
    return bytes(out)


def packbits_unpack(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_pack(data: bytes) -> bytes:
    """Codes from 9 to 12 bits, high bit first, widened one code early as the format wants."""
    single = [bytes([i]) for i in range(256)]
    codes = {b: i for i, b in enumerate(single)}
    acc, bits, out, width, following = 256, 9, bytearray(), 9, 258
    word = b""
    for value in data:
        longer = word + single[value]
        if longer in codes:
            word = longer
            continue
        acc = (acc << width) | codes[word]
        bits += width
        codes[longer] = following
        following += 1
        if following == 4094:
            acc = (acc << 12) | 256
            bits += 12
            codes, width, following = {b: i for i, b in enumerate(single)}, 9, 258
        elif following in (512, 1024, 2048):
            width += 1
        word = single[value]
        if bits >= 512:
            keep = bits & 7
            out += (acc >> keep).to_bytes((bits - keep) // 8, "big")
            acc, bits = acc & ((1 << keep) - 1), keep
    if word:
        acc = (acc << width) | codes[word]
        bits += width
        following += 1
        if following == 4094:
            acc, bits, width = (acc << 12) | 256, bits + 12, 9
        elif following in (512, 1024, 2048):
            width += 1
    acc = (acc << width) | 257
    bits += width
    pad = -bits % 8
    out += (acc << pad).to_bytes((bits + pad) // 8, "big")
    return bytes(out)


def lzw_unpack(data: bytes, size: int) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, width, last = list(base), bytearray(), 9, None
    acc = bits = 0
    for value in data:
        acc = (acc << 8) | value
        bits += 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            words, width, last = list(base), 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW code out of range")
            word = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            if len(words) < 4096:
                words.append(last + word[:1])
                if len(words) in (511, 1023, 2047):
                    width += 1
        out += word
        last = word
        if len(out) >= size:
            break
    return bytes(out)


def _unpack(kind: int, data: bytes, size: int) -> bytes:
    if not size:
        return b""
    if kind == NONE:
        got = data
    elif kind == LZW:
        got = lzw_unpack(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(data, size)
    elif kind == PACKBITS:
        got = packbits_unpack(data, size)
    else:
        raise TiffError(f"compression {kind} is not known")
    if len(got) < size:
        raise TiffError("strip or tile is cut short")
    return got[:size]


def _pack(kind: int, data: bytes) -> bytes:
    if kind == LZW:
        return lzw_pack(data)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    if kind == PACKBITS:
        return packbits_pack(data)
    return data


def _undo(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x columns x samples, integers or (for 3) bytes as stored."""
    if predictor == 1:
        return block
    if predictor == 2:
        native = block.astype(block.dtype.newbyteorder("="))
        return np.add.accumulate(native, axis=1, dtype=native.dtype).astype(block.dtype)
    if predictor == 3:  # bytes of a row: differences over planes, most significant byte first
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        raw = np.frombuffer(block.tobytes(), np.uint8).reshape(rows, columns * size, samples)
        raw = np.add.accumulate(raw, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        back = np.moveaxis(raw, 1, 2)
        back = back if order == ">" else back[:, :, ::-1]
        return np.frombuffer(np.ascontiguousarray(back).tobytes(), block.dtype).reshape(rows, columns, samples)
    raise TiffError(f"predictor {predictor} is not known")


# ---- reading ----------------------------------------------------------------------------------

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _directories(blob: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each directory, along the chain."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(blob[:2]))
    if order is None or len(blob) < 8:
        raise TiffError("not a TIFF")
    (version,) = struct.unpack_from(order + "H", blob, 2)
    big = version == 43
    if version not in (42, 43) or big and (len(blob) < 16 or struct.unpack_from(order + "HH", blob, 4) != (8, 0)):
        raise TiffError("not a TIFF")
    # Forms of an offset, of the number of fields and of a field's head; bytes of a field and of the value in it.
    place, number, head, entry, room = ("Q", "Q", "HHQ", 20, 8) if big else ("I", "H", "HHI", 12, 4)
    (at,) = struct.unpack_from(order + place, blob, 8 if big else 4)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        tags: dict[int, tuple] = {}
        try:
            (count,) = struct.unpack_from(order + number, blob, at)
            start = at + struct.calcsize(order + number)
            (following,) = struct.unpack_from(order + place, blob, start + entry * count)
            for i in range(count):
                tag, kind, n = struct.unpack_from(order + head, blob, start + entry * i)
                if kind not in FIELDS:
                    continue
                size, form = FIELDS[kind]
                where = start + entry * (i + 1) - room
                if size * n > room:
                    (where,) = struct.unpack_from(order + place, blob, where)
                # A field beyond the end of the file is as good as missing: its page says so.
                tags[tag] = struct.unpack_from(f"{order}{n}{form}", blob, where) if 0 <= where <= len(blob) - size * n else ()
        except (struct.error, OverflowError) as e:
            raise TiffError("directory is cut short") from e
        yield order, tags
        at = following


def _one(tags: dict[int, tuple], tag: int, name: str, default: int | None = None, least: int = 1) -> int:
    """The value of a field that has one."""
    found = tags.get(tag)
    if found is None and default is not None:
        return default
    if not found:
        raise TiffError(f"{name} is missing")
    if found[0] < least:
        raise TiffError(f"{name} is {found[0]}")
    return found[0]


def _page(blob: bytes, index: int, order: str, tags: dict[int, tuple]) -> Page:
    width, height = _one(tags, 256, "width"), _one(tags, 257, "height")
    samples, kind, predictor = _one(tags, 277, "number of samples", 1), _one(tags, 259, "compression", 1), _one(tags, 317, "predictor", 1)
    depths = tags.get(258, (1,))
    if not depths or len(set(depths[:samples])) > 1:
        raise TiffError("samples of several depths are not read")
    bits, planar, tiled = depths[0], tags.get(284, (1,))[:1] == (2,), 322 in tags
    if bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError(f"{bits} bits a sample are not read")
    if bits < 8 and predictor != 1 or predictor == 3 and bits == 8:
        raise TiffError(f"predictor {predictor} of {bits} bits is not read")
    if kind not in MOST_GROWTH:
        raise TiffError(f"compression {kind} is not known")
    if tags.get(262, (1,))[:1] == (6,) and tags.get(530, (2, 2)) != (1, 1):
        raise TiffError("subsampled colours are not read")
    if tiled:
        block_w, block_h = _one(tags, 322, "tile width"), _one(tags, 323, "tile height")
        starts, sizes = tags.get(324, ()), tags.get(325, ())
    else:
        block_w, block_h = width, min(_one(tags, 278, "rows of a strip", height), height)
        starts, sizes = tags.get(273, ()), tags.get(279, ())
    across, down = -(-width // block_w), -(-height // block_h)
    per, planes = (1, samples) if planar else (samples, 1)
    blocks = across * down * planes
    if len(starts) < blocks or len(sizes) < blocks:
        raise TiffError("strips or tiles are missing")
    line = -(-block_w * per * bits // 8)  # bytes of a block's row
    held = [max(0, min(sizes[k], len(blob) - starts[k])) for k in range(blocks)]
    whole = height * width * samples * max(1, bits // 8)
    if whole > MOST_BYTES or line * block_h > MOST_BYTES:
        raise TiffError("page is too large")
    if line * (block_h * blocks if tiled else height * planes) > MOST_GROWTH[kind] * sum(held):
        raise TiffError("page is larger than its strips or tiles can hold")
    dtype = np.dtype(f"{order}u{bits // 8}") if bits > 8 else np.dtype(np.uint8)
    image = np.zeros((height, width, samples), dtype)
    for k in range(blocks):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * block_h, cell % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        data = blob[starts[k] : starts[k] + sizes[k]]
        if tags.get(266, (1,))[:1] == (2,):
            data = data.translate(_REVERSED)
        raw = np.frombuffer(_unpack(kind, data, rows * line), np.uint8)
        if bits < 8:
            shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
            split = (raw.reshape(rows, line, 1) >> shifts) & np.uint8((1 << bits) - 1)
            block = split.reshape(rows, -1)[:, : block_w * per].reshape(rows, block_w, per)
        else:
            block = _undo(raw.view(dtype).reshape(rows, block_w, per), predictor, order)
        h, w = min(rows, height - y), min(block_w, width - x)
        image[y : y + h, x : x + w, plane : plane + per if planar else samples] = block[:h, :w]
    return Page(index, width, height, samples, bits, kind, predictor, tiled, image.tobytes())


def pages_of(blob: bytes) -> Iterator[Page]:
    """The pages of a TIFF in directory order, decoded to interleaved samples; what cannot be read has ``error`` set."""
    index = 0
    try:
        for order, tags in _directories(blob):
            try:
                yield _page(blob, index, order, tags)
            except (TiffError, zlib.error) as e:
                yield Page(index, 0, 0, 0, 0, 0, 0, False, b"", str(e))
            index += 1
    except TiffError as e:
        yield Page(index, 0, 0, 0, 0, 0, 0, False, b"", str(e))


def read_pages(blob: bytes) -> Iterator[Page]:
    """The pages of a TIFF that must be whole."""
    for p in pages_of(blob):
        if p.error:
            raise TiffError(p.error)
        yield p


# ---- writing ----------------------------------------------------------------------------------


def write_pages(payload: bytes, kind: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, width: int = WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = 64) -> bytes:
    """8-bit grey pages of ``payload``, whose length is a multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        blocks = []
        if tile:
            for y in range(0, len(page), tile[1]):
                for x in range(0, width, tile[0]):
                    cell = page[y : y + tile[1], x : x + tile[0]]
                    if cell.shape != (tile[1], tile[0]):
                        cell = np.pad(cell, ((0, tile[1] - cell.shape[0]), (0, tile[0] - cell.shape[1])))
                    blocks.append(cell)
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        starts, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _pack(kind, block.tobytes())
            starts.append(len(out))
            sizes.append(len(data))
            out += data
        fields = [(256, 4, [width]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [kind]), (262, 3, [1])]
        if not tile:
            fields += [(273, 4, starts), (277, 3, [1]), (278, 4, [strip_rows]), (279, 4, sizes), (317, 3, [predictor])]
        else:
            fields += [(277, 3, [1]), (317, 3, [predictor]), (322, 4, [tile[0]]), (323, 4, [tile[1]]), (324, 4, starts), (325, 4, sizes)]
        entries = b""
        for tag, form, values in fields:
            packed = struct.pack(f"<{len(values)}{'H' if form == 3 else 'I'}", *values)
            if len(packed) > 4:
                where = len(out)
                out += packed
                packed = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, form, len(values)) + packed.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``width``."""
    return data.ljust(max(1, -(-len(data) // width)) * width, b"\xff")


def store(payload: bytes) -> bytes:
    """The image of a payload. Its checksum picks one of four layouts, so equal payloads are stored alike."""
    pick = zlib.crc32(payload) % 4
    if pick == 0:
        return write_pages(payload, DEFLATE, 2)
    if pick == 1:
        return write_pages(payload, DEFLATE, 1, tile=(192, 32))
    if pick == 2:
        return write_pages(payload, PACKBITS)
    return write_pages(payload, LZW)


def feature(pages: list[Page]) -> str:
    """Pages, rows, mean, deviation and a 16-bin histogram (in thousandths) of all samples."""
    data = np.frombuffer(b"".join(p.data for p in pages), np.uint8)
    counts = np.bincount(data, minlength=256)
    total = max(1, len(data))
    mean = float(counts @ np.arange(256)) / total
    spread = (max(0.0, float(counts @ (np.arange(256.0) ** 2)) / total - mean * mean)) ** 0.5
    bins = ",".join(str(int(b) * 1000 // total) for b in counts.reshape(16, 16).sum(axis=1))
    return f"pages={len(pages)};rows={sum(p.height for p in pages)};mean={mean:.4f};sd={spread:.4f};hist={bins}"


# ---- operator ---------------------------------------------------------------------------------

PAGES = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def tiff_pages(df: DataFrame, key: str, blob: str) -> DataFrame:
    """One row per page of each TIFF in column ``blob``, with ``key`` beside it."""
    keyed = df.select(df[key].alias("k"), df[blob].alias("b"))

    def rows(parts):
        for part in parts:
            out, size = [], 0
            for k, b in zip(part["k"], part["b"]):
                for p in pages_of(bytes(b)) if b is not None else ():
                    out.append((k, p.index, *[None] * 8, p.error) if p.error else (k, p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data, None))
                    size += len(p.data)
                    if size > BATCH_BYTES:
                        yield list(zip(*out))
                        out, size = [], 0
            if out:
                yield list(zip(*out))

    return map_rows(keyed, f"{key} {keyed.schema['k'].dataType.simpleString()}, {PAGES}", rows)


def text_media(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text (null: empty) as UTF-8, padded, stored as an image, read back and described: one row per
    row of ``df``. Equal texts get equal values; texts of any length are split over pages."""
    keyed = df.select(df[key].alias("k"), df[text].alias("t"))

    def rows(parts):
        for part in parts:
            out = []
            for k, t in zip(part["k"], part["t"]):
                raw = (t or "").encode("utf-8")
                media = store(pad(raw))
                pages = list(read_pages(media))
                payload = b"".join(p.data for p in pages)
                out.append((k, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages)))
            yield list(zip(*out)) if out else [[] for _ in range(8)]

    return map_rows(keyed, f"{key} {keyed.schema['k'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows)
