import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tiff


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]), st.sampled_from([1, 2]), st.sampled_from([None, (192, 32), (160, 16)]))
def test_round_trip(data, kind, predictor, tile):
    payload = tiff.pad(data)
    assert len(payload) % 576 == 0 and payload
    blob = tiff.write_pages(payload, kind, predictor, tile, page_rows=4)
    pages = list(tiff.read_pages(blob))
    assert b"".join(p.data for p in pages) == payload and len(pages) == -(-len(payload) // 576 // 4)
    assert b"".join(p.data for p in tiff.read_pages(tiff.store(payload))) == payload


@given(st.binary(max_size=9000))
def test_codecs(data):
    assert tiff.lzw_unpack(tiff.lzw_pack(data), len(data)) == data
    assert tiff.packbits_unpack(tiff.packbits_pack(data), len(data)) == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(3).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_unpack(tiff.lzw_pack(data), len(data)) == data


def _big_endian(bits, samples, planar, predictor, planes, width, height):
    """A hand-made file: big-endian, deflate, one strip a plane."""
    out, starts, sizes = bytearray(b"MM\0*\0\0\0\0"), [], []
    for p in planes:
        data = zlib.compress(p)
        starts.append(len(out))
        sizes.append(len(data))
        out += data
    fields = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits]), (259, 3, [8]), (273, 4, starts), (277, 3, [samples]), (278, 4, [height]), (279, 4, sizes), (284, 3, [planar]), (317, 3, [predictor])]
    entries = b""
    for tag, form, values in fields:
        packed = struct.pack(f">{len(values)}{'H' if form == 3 else 'I'}", *values)
        if len(packed) > 4:
            where = len(out)
            out += packed
            packed = struct.pack(">I", where)
        entries += struct.pack(">HHI", tag, form, len(values)) + packed.ljust(4, b"\0")
    struct.pack_into(">I", out, 4, len(out))
    return bytes(out + struct.pack(">H", len(fields)) + entries + b"\0\0\0\0")


def test_other_layouts():
    wide = (np.arange(24).reshape(3, 8) * 999).astype(">u2")
    stored = wide.copy()
    stored[:, 1:] -= wide[:, :-1]
    (page,) = tiff.read_pages(_big_endian(16, 1, 1, 2, [stored.tobytes()], 8, 3))
    assert page.data == wide.tobytes()
    planes = [bytes(range(i, i + 6)) for i in (0, 50, 100)]
    (page,) = tiff.read_pages(_big_endian(8, 3, 2, 1, planes, 3, 2))
    assert page.data == bytes(np.array([list(p) for p in planes], np.uint8).T.reshape(-1))
    real = np.linspace(-2, 3, 12).astype(">f4").reshape(2, 6)
    raw = np.frombuffer(real.tobytes(), np.uint8).reshape(2, 6, 4)
    split = np.moveaxis(raw, 2, 1).reshape(2, 24)
    coded = split.copy()
    coded[:, 1:] -= split[:, :-1]
    (page,) = tiff.read_pages(_big_endian(32, 1, 1, 3, [coded.tobytes()], 6, 2))
    assert page.data == real.tobytes()


def _little(fields, data, big=False):
    """A hand-made little-endian file of one page whose strip or tile is ``data``; classic or big."""
    at = 16 if big else 8
    out = bytearray((b"II+\0\x08\0\0\0" + struct.pack("<Q", at + len(data)) if big else b"II*\0" + struct.pack("<I", at + len(data))) + data)
    rows = sorted([*fields, (273, 4, at), (279, 4, len(data))])
    out += struct.pack("<Q" if big else "<H", len(rows))
    for tag, form, value in rows:
        out += struct.pack("<HHQ" if big else "<HHI", tag, form, 1) + struct.pack("<H" if form == 3 else "<I", value).ljust(8 if big else 4, b"\0")
    return bytes(out + b"\0" * (8 if big else 4))


def test_few_bits_and_big_files():
    rng = np.random.default_rng(5)
    for bits in (1, 2, 4):
        want = rng.integers(0, 1 << bits, (5, 11, 1), dtype=np.uint8)
        lines = b"".join(int("".join(f"{v:0{bits}b}" for v in row.ravel()).ljust(-(-11 * bits // 8) * 8, "0"), 2).to_bytes(-(-11 * bits // 8), "big") for row in want)
        for kind, packed in ((tiff.NONE, lines), (tiff.LZW, tiff.lzw_pack(lines)), (tiff.PACKBITS, tiff.packbits_pack(lines))):
            fields = [(256, 3, 11), (257, 3, 5), (258, 3, bits), (259, 3, kind), (262, 3, 1)]
            for big in (False, True):
                (page,) = tiff.read_pages(_little(fields, packed, big))
                assert page.data == want.tobytes() and page.bits == bits
        (page,) = tiff.read_pages(_little([(256, 3, 11), (257, 3, 5), (258, 3, bits), (259, 3, 1), (262, 3, 1), (266, 3, 2)], lines.translate(tiff._REVERSED)))
        assert page.data == want.tobytes()


def test_lzw_whatever_the_length():
    kinds = set()
    for n in range(40):
        payload = tiff.pad(bytes([n]) * 9000 + bytes(range(n)))
        pages = list(tiff.read_pages(tiff.store(payload)))
        kinds.add(pages[0].compression)
        assert b"".join(p.data for p in pages) == payload
    assert kinds == {tiff.DEFLATE, tiff.PACKBITS, tiff.LZW}


def test_bad_page_among_good_ones(spark):
    blob = bytearray(tiff.write_pages(tiff.pad(b"z" * 3000), page_rows=2))
    first = struct.unpack_from("<I", blob, 4)[0]
    for i in range(struct.unpack_from("<H", blob, first)[0]):
        if struct.unpack_from("<H", blob, first + 2 + 12 * i)[0] == 259:
            struct.pack_into("<H", blob, first + 2 + 12 * i + 8, 777)
    pages = list(tiff.pages_of(bytes(blob)))
    assert [bool(p.error) for p in pages] == [True, False, False] and [p.index for p in pages] == [0, 1, 2]
    rows = tiff.tiff_pages(spark.createDataFrame([(1, bytes(blob))], "id long, blob binary"), "id", "blob").collect()
    assert sorted((r["page"], r["error"] is None, r["width"]) for r in rows) == [(0, False, None), (1, True, 576), (2, True, 576)]


def test_damaged_files_never_raise():
    """4,000 files with bytes changed, cut or repeated."""
    rng = np.random.default_rng(11)
    payload = tiff.pad(bytes(rng.integers(0, 60, 4000, dtype=np.uint8)))
    whole = [tiff.write_pages(payload, kind, predictor, tile, page_rows=3) for kind in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for predictor, tile in ((1, None), (2, (192, 32)))]
    whole += [_little([(256, 3, 40), (257, 3, 20), (258, 3, 4), (259, 3, 5), (262, 3, 1)], tiff.lzw_pack(bytes(400)), big) for big in (False, True)]
    for n in range(4000):
        blob = bytearray(whole[n % len(whole)])
        for _ in range(rng.integers(1, 9)):
            # Half of the changes go to the last directory, where they hurt most.
            at = int(rng.integers(0, len(blob)) if rng.random() < 0.5 else len(blob) - 1 - rng.integers(0, min(150, len(blob))))
            blob[at] = int(rng.choice([0, 1, 255, rng.integers(0, 256)]))
        if n % 7 == 0:
            del blob[int(rng.integers(0, len(blob))) :]
        for p in tiff.pages_of(bytes(blob)):
            assert p.error or len(p.data) == p.width * p.height * p.samples * max(1, p.bits // 8)


def test_broken_files_give_an_error_row(spark):
    good = tiff.write_pages(tiff.pad(b"x" * 3000), page_rows=2)
    loop = bytearray(good)
    first = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * struct.unpack_from("<H", loop, first)[0], first)
    rows = [(1, good), (2, b"no"), (3, None), (4, good[: len(good) // 2]), (5, bytes(loop)), (1, good)]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None, "extra") for k, b in rows], "id long, blob binary, page string")
    got = tiff.tiff_pages(df, "id", "blob").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert len(by[1]) == 6 and all(r["error"] is None and r["data"] for r in by[1])
    assert by[2][0]["error"] and 3 not in by and by[4][-1]["error"]
    assert len(by[5]) == 2 and by[5][1]["error"]
    assert tiff.tiff_pages(df.limit(0), "id", "blob").count() == 0


def test_text_media(spark):
    df = spark.createDataFrame([(1, "aé"), (2, None), (3, ""), (4, "aé"), (5, "y" * 300_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in tiff.text_media(df, "doc_id", "text").collect()}
    want = tiff.pad("aé".encode())
    assert rows[1]["n_bytes"] == 3 and rows[1]["payload_sha256"] == hashlib.sha256(want).hexdigest() and rows[1]["tail_crc32"] == zlib.crc32(want[-32:])
    assert rows[2][1:] == rows[3][1:] and rows[1][1:] == rows[4][1:] and rows[2]["payload_bytes"] == 576
    assert rows[5]["payload_bytes"] == 300_096


def _plain_pages(media):
    """(height, samples) of each page by the format's own rules: little-endian classic files, one byte a sample."""
    at, out = struct.unpack_from("<I", media, 4)[0], []
    while at:
        count = struct.unpack_from("<H", media, at)[0]
        tags = {}
        for i in range(count):
            tag, form, n, value = struct.unpack_from("<HHI4s", media, at + 2 + 12 * i)
            size = {3: 2, 4: 4}[form]
            raw = value[: n * size] if n * size <= 4 else media[struct.unpack("<I", value)[0] :][: n * size]
            tags[tag] = struct.unpack(f"<{n}{'H' if form == 3 else 'I'}", raw)
        at = struct.unpack_from("<I", media, at + 2 + 12 * count)[0]
        width, height, kind = tags[256][0], tags[257][0], tags[259][0]
        tiled = 324 in tags
        across, down = (tags[322][0], tags[323][0]) if tiled else (width, tags[278][0])
        canvas = [bytearray(width) for _ in range(height)]
        columns = -(-width // across)
        for i, (start, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279])):
            left, top = i % columns * across, i // columns * down
            rows = down if tiled else min(down, height - top)
            data = bytearray(_plain_unpack(kind, media[start : start + size]))[: across * rows]
            for r in range(rows):
                line = data[r * across : (r + 1) * across]
                if tags.get(317, (1,))[0] == 2:
                    for x in range(1, len(line)):
                        line[x] = (line[x] + line[x - 1]) & 255
                if top + r < height:
                    kept = min(across, width - left)
                    canvas[top + r][left : left + kept] = line[:kept]
        out.append((height, b"".join(canvas)))
    return out


def _plain_unpack(kind, data):
    if kind == tiff.DEFLATE:
        return zlib.decompress(data)
    out = bytearray()
    if kind == tiff.PACKBITS:
        i = 0
        while i < len(data):
            n = data[i] - 256 if data[i] > 128 else data[i]
            if data[i] == 128:
                i += 1
            elif n >= 0:
                out += data[i + 1 : i + 2 + n]
                i += n + 2
            else:
                out += data[i + 1 : i + 2] * (1 - n)
                i += 2
        return out
    bits = "".join(f"{b:08b}" for b in data)
    at, width, table, last = 0, 9, {}, b""
    while at + width <= len(bits):
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            break
        if code == 256:
            table, width, last = {i: bytes([i]) for i in range(256)}, 9, b""
            continue
        word = table[code] if code in table else last + last[:1]
        out += word
        if last:
            table[len(table) + 2] = last + word[:1]
        last, width = word, max(9, (len(table) + 2 + 1).bit_length())
    return out


def test_media_equal_a_plain_reader(spark):
    """Every column of the operator by an independent reading of the stored bytes; all four layouts come up."""
    texts = ["", "a", "é" * 3000, "word " * 900, "".join(chr(33 + i * i % 90) for i in range(5000)), "x" * 200_000, *(f"text {i} " * (i % 50) for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = set()
    for r in tiff.text_media(df, "doc_id", "text").collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media = tiff.store(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        kinds.add(zlib.crc32(payload) % 4)
        pages = _plain_pages(media)
        assert b"".join(d for _, d in pages) == payload and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-32:])
        mean = sum(payload) / len(payload)
        spread = (sum(x * x for x in payload) / len(payload) - mean * mean) ** 0.5
        bins = ",".join(str(sum(x // 16 == b for x in payload) * 1000 // len(payload)) for b in range(16))
        named = dict(x.split("=") for x in r["feature"].split(";"))
        assert (named["pages"], named["rows"], named["hist"]) == (str(len(pages)), str(sum(h for h, _ in pages)), bins)
        assert abs(float(named["mean"]) - mean) < 1e-3 and abs(float(named["sd"]) - spread) < 1e-3
    assert kinds == {0, 1, 2, 3}
