"""Media columns as progressive JPEG.

A payload's bytes become quantised DCT coefficients, 64 to a block, six blocks to a 4:2:0 unit. They
are written as progressive scans: DC and AC bands apart (spectral selection), high bits first and
the low bit in later scans (successive approximation). Reading accumulates the scans into
coefficient arrays, which give the payload back exactly; the inverse transform in numpy and
upsampled chroma give the full-resolution RGB tensor.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, ship, worker_cache

UNIT = 64
#: Bits of the inverse transform's fractions. Sums over 64 coefficients up to 900 stay under 2 ** 24.
SCALE = 11
#: Blocks that are transformed at once.
CHUNK = 16_384
MARK = b"BYTES\0"
#: (component, first, last, high, low): the scans in the order of writing.
SCANS = (
    *((c, 0, 0, 0, 1) for c in (0, 1, 2)), (0, 1, 5, 0, 1), (1, 1, 63, 0, 1), (2, 1, 63, 0, 1), (0, 6, 63, 0, 1),
    *((c, 0, 0, 1, 0) for c in (0, 1, 2)), *((c, 1, 63, 1, 0) for c in (0, 1, 2)),
)


def _zigzag() -> np.ndarray:
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * y + x for y, x in cells])


def _basis() -> np.ndarray:
    """Inverse transform of a block in zigzag order, times 2 ** SCALE, in whole numbers: sums are exact."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)[_zigzag()] * (1 << SCALE))


BASIS = _basis()
HALF = (1 << SCALE - 1) + (128 << SCALE)


# --- writing --------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, slot: int, symbols: list[int]) -> bytes:
    """Codes 0, 10, 110, ...: the first symbol takes one bit."""
    return _segment(0xC4, bytes([kind << 4 | slot]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + bytes(symbols))


def _stuffed(bits: np.ndarray) -> bytes:
    flat = bits.reshape(-1)
    if pad := -len(flat) % 8:
        flat = np.concatenate([flat, np.ones(pad, np.uint8)])
    return np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00")


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes (a multiple of 64, at least 64).

    AC coefficients are -255..-128 and 128..255: their eight value bits are the byte itself. DC
    coefficients are 256 + byte with a sign that alternates, so their differences, too, have one size.
    """
    blocks = len(payload) // UNIT
    units = -(-blocks // 6)
    high = -(-units // 4095)
    wide = -(-units // high)
    values = np.zeros((6 * wide * high, UNIT), np.uint8)
    values[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = wide * high
    parts = values[: 4 * n], values[4 * n : 5 * n], values[5 * n :]
    out = [
        b"\xff\xd8", _segment(0xE9, MARK + struct.pack(">Q", len(payload))),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _huffman(0, 0, [9, 8]), _huffman(1, 0, [7, 0]), _huffman(1, 1, [0, 1]),
    ]
    for c, first, last, ah, al in SCANS:
        b = parts[c]
        if first == 0:
            dc = b[:, 0].astype(np.int64) + 256
            dc[1::2] *= -1
            if ah:
                data = _stuffed((dc & 1).astype(np.uint8))
            else:
                diff = np.diff(dc >> 1, prepend=0)
                code = np.where(diff < 0, diff + 511, diff)
                code[0] = 0b10 << 8 | diff[0]
                data = _stuffed(code[:, None] >> np.arange(9, -1, -1) & 1)
        elif ah:
            bits = ((b ^ (b < 128)) & 1).astype(np.uint8)
            bits[:, 0] = 0  # the end-of-band code stands where DC would
            data = _stuffed(bits)
        else:
            data = (b[:, first : last + 1] >> 1).tobytes()  # code 0 and seven bits
        out += [_segment(0xDA, bytes([1, c + 1, 0x01 if ah and first else 0x00, first, last, ah << 4 | al])), data]
    return b"".join([*out, b"\xff\xd9"])


# --- reading --------------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the scan ends early")
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def _signed(bits: int, size: int) -> int:
    return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


def _scan_blocks(part: list, frame: dict) -> list[tuple[int, int]]:
    """(component, block) in the order of an (interleaved) scan; components' grids are whole units."""
    if len(part) == 1:
        comp = frame["parts"][part[0][0]]
        wide, high = comp["own"]
        return [(part[0][0], y * comp["wide"] + x) for y in range(high) for x in range(wide)]
    order = []
    for uy in range(frame["units"][1]):
        for ux in range(frame["units"][0]):
            for c, *_ in part:
                comp = frame["parts"][c]
                order += [
                    (c, (uy * comp["v"] + y) * comp["wide"] + ux * comp["h"] + x) for y in range(comp["v"]) for x in range(comp["h"])
                ]
    return order


def _slow_scan(pieces: list[bytes], every: int, part: list, frame: dict, spec: tuple, tables: dict) -> None:
    """Any progressive scan, symbol by symbol; ``pieces`` lie between restart marks."""
    first, last, ah, al = spec
    order = _scan_blocks(part, frame)
    dc_codes, ac_codes = {c: tables.get((0, d)) for c, d, _ in part}, {c: tables.get((1, a)) for c, _, a in part}
    per_unit = 1 if len(part) == 1 else sum(frame["parts"][c]["h"] * frame["parts"][c]["v"] for c, *_ in part)
    step = every * per_unit or len(order)
    for k, at in enumerate(range(0, len(order), step)):
        bits, before, run = _Bits(pieces[k]), dict.fromkeys(frame["parts"], 0), 0
        for c, i in order[at : at + step]:
            block = frame["parts"][c]["coefs"][i]
            if first == 0:
                if ah:
                    block[0] |= bits.take(1) << al
                else:
                    size = bits.symbol(dc_codes[c])
                    before[c] += _signed(bits.take(size), size)
                    block[0] = before[c] << al
            elif not ah:
                if run:
                    run -= 1
                    continue
                j = first
                while j <= last:
                    skip, size = divmod(bits.symbol(ac_codes[c]), 16)
                    if size:
                        j += skip
                        block[j] = _signed(bits.take(size), size) << al if size else 0
                        j += 1
                    elif skip == 15:
                        j += 16
                    else:
                        run = (1 << skip) + bits.take(skip) - 1
                        break
            else:
                j = first
                if not run:
                    while j <= last:
                        skip, size = divmod(bits.symbol(ac_codes[c]), 16)
                        new = 0
                        if size:
                            new = (1 if bits.take(1) else -1) << al
                        elif skip < 15:
                            run = (1 << skip) + bits.take(skip)
                            break
                        while j <= last:
                            if block[j]:
                                _correct(block, j, bits, al)
                            elif skip:
                                skip -= 1
                            else:
                                if new:
                                    block[j] = new
                                j += 1
                                break
                            j += 1
                if run:
                    for j in range(j, last + 1):
                        if block[j]:
                            _correct(block, j, bits, al)
                    run -= 1


def _correct(block: np.ndarray, j: int, bits: _Bits, al: int) -> None:
    if bits.take(1) and not abs(int(block[j])) >> al & 1:
        block[j] += (1 if block[j] > 0 else -1) << al


def _quick_scan(data: bytes, part: list, frame: dict, spec: tuple, tables: dict) -> bool:
    """Scans of codes of one width, read as arrays. False, and nothing done, if this isn't one."""
    if len(part) > 1:
        return False
    (c, d, a), (first, last, ah, al) = part[0], spec
    comp = frame["parts"][c]
    coefs = comp["coefs"]
    if comp["own"] != (comp["wide"], len(coefs) // comp["wide"]):
        return False
    n, band = len(coefs), last - first + 1
    raw = np.frombuffer(data, np.uint8)
    if first == 0 and ah:
        coefs[:, 0] |= np.unpackbits(raw, count=n).astype(np.int32) << al
        return True
    codes = tables.get((0, d) if first == 0 else (1, a), {})
    if first == 0:
        size, other = codes.get((1, 0)), codes.get((2, 0b10))
        if size is None or other != size - 1 or size > 15 or 8 * len(raw) < n * (1 + size):
            return False
        bits = np.unpackbits(raw, count=n * (1 + size)).reshape(n, 1 + size)
        code = bits[:, 1:] @ (1 << np.arange(size - 1, -1, -1, dtype=np.int64))
        # the first code is one bit longer, its value one bit shorter
        if bits[1:, 0].any() or bits[0, 0] != 1 or bits[0, 1] != 0:
            return False
        diff = np.where(code >> (size - 1) & 1, code, code - (1 << size) + 1)
        diff[0] = _signed(int(code[0]) & ((1 << other) - 1), other)
        coefs[:, 0] = np.cumsum(diff) << al
        return True
    if ah:
        if codes.get((1, 0)) != 0 or (1 + band) % 8 or len(raw) != n * (1 + band) // 8 or not coefs[:, first : last + 1].all():
            return False
        bits = np.unpackbits(raw).reshape(n, 1 + band)
        if bits[:, 0].any():
            return False
        own = coefs[:, first : last + 1]
        own += np.where(own > 0, 1, -1).astype(np.int32) * (bits[:, 1:] << al)
        return True
    size = codes.get((1, 0))
    if size != 7 or len(raw) != n * band or (raw & 128).any():
        return False
    code = raw.reshape(n, band).astype(np.int32)
    coefs[:, first : last + 1] = np.where(code & 64, code, code - 127) << al if al == 0 else np.where(code & 64, code << al, (code - 127) * (1 << al))
    return True


def read_coefficients(media: bytes, quick: bool = True) -> dict:
    """A progressive JPEG's frame: width, height and, for every component, its coefficient blocks in
    zigzag order (``coefs``), its sampling (``h``, ``v``) and quantiser."""
    at, tables, quant, frame, every = 2, {}, {}, {}, 0
    frame["app"] = b""
    while at < len(media):
        marker = media[at + 1]
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", media, at + 2)
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xE9:
            frame["app"] = body
        elif marker == 0xDD:
            (every,) = struct.unpack(">H", body)
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, p, code, codes = body[1:17], 17, 0, {}
                for n, k in enumerate(counts, 1):
                    for _ in range(k):
                        codes[n, code] = body[p]
                        code, p = code + 1, p + 1
                    code <<= 1
                tables[body[0] >> 4, body[0] & 15] = codes
                body = body[p:]
        elif marker == 0xC2:
            _, high, wide, _ = struct.unpack_from(">BHHB", body)
            comps = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
            hm, vm = max(h for _, h, _, _ in comps), max(v for _, _, v, _ in comps)
            units = -(-wide // (8 * hm)), -(-high // (8 * vm))
            frame |= {"width": wide, "height": high, "units": units, "most": (hm, vm), "parts": {}}
            for c, h, v, q in comps:
                own = -(-wide * h // (8 * hm)), -(-high * v // (8 * vm))
                frame["parts"][c] = {"h": h, "v": v, "q": q, "wide": units[0] * h, "own": own, "coefs": np.zeros((units[0] * h * units[1] * v, 64), np.int32)}
        elif marker == 0xDA:
            part = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            first, last, ahl = body[-3:]
            end, pieces, start = at, [], at
            while True:
                end = media.index(b"\xff", end)
                if media[end + 1] == 0:
                    end += 2
                elif 0xD0 <= media[end + 1] <= 0xD7:
                    pieces.append(media[start:end])
                    start = end = end + 2
                else:
                    break
            pieces = [p.replace(b"\xff\x00", b"\xff") for p in (*pieces, media[start:end])]
            spec = first, last, ahl >> 4, ahl & 15
            if not (quick and len(pieces) == 1 and not every and _quick_scan(pieces[0], part, frame, spec, tables)):
                _slow_scan(pieces, every, part, frame, spec, tables)
            at = end
    for comp in frame["parts"].values():
        comp["quant"] = quant[comp["q"]]
    return frame


def payload_of(frame: dict) -> bytes:
    """The payload that ``encode`` put into the coefficients."""
    (size,) = struct.unpack_from(">Q", frame["app"], len(MARK))
    out = []
    for comp in frame["parts"].values():
        c = comp["coefs"]
        b = np.where(c >= 0, c, c + 255).astype(np.uint8)
        b[:, 0] = np.abs(c[:, 0]) - 256
        out.append(b.tobytes())
    return b"".join(out)[:size]


def rgb_of(frame: dict) -> np.ndarray:
    """The full-resolution tensor: height x width x 3, 8 bits."""
    planes = []
    for comp in frame["parts"].values():
        c, wide = comp["coefs"], comp["wide"]
        plain = comp["quant"].max() > 1 or np.abs(c).max() > 900
        plane = np.empty((len(c) // wide * 8, wide * 8), np.uint8)
        rows = max(1, CHUNK // wide)
        for y in range(0, len(c) // wide, rows):
            some = c[y * wide : (y + rows) * wide]
            # whole numbers under 2 ** 24 or 2 ** 53: exact, so equal whatever the batch
            scaled = some * comp["quant"] if plain else some
            kind = np.float32 if not plain or np.abs(scaled).max() <= 900 else np.float64
            pixels = (scaled.astype(kind) @ BASIS.astype(kind)).astype(np.int32 if kind == np.float32 else np.int64)
            pixels += HALF
            pixels >>= SCALE
            pixels = np.clip(pixels, 0, 255, out=pixels).astype(np.uint8)
            plane[8 * y : 8 * (y + rows)] = pixels.reshape(-1, wide, 8, 8).swapaxes(1, 2).reshape(-1, wide * 8)
        up = frame["most"][1] // comp["v"], frame["most"][0] // comp["h"]
        planes.append(plane.repeat(up[0], 0).repeat(up[1], 1) if up != (1, 1) else plane)
    high, wide = frame["height"], frame["width"]
    if len(planes) == 1:
        return np.repeat(planes[0][:high, :wide, None], 3, 2)
    y, cb, cr = (p[:high, :wide].astype(np.int32) for p in planes)
    y, cb, cr = (y << 16) + 32768, cb - 128, cr - 128
    rgb = np.empty((high, wide, 3), np.uint8)
    for i, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        rgb[:, :, i] = np.clip(v >> 16, 0, 255)
    return rgb


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its bytes with 0s appended up to a positive multiple of 64)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + b"\0" * (-len(b) % UNIT or (0 if b else UNIT))


def feature_of(rgb: np.ndarray) -> str:
    flat = rgb.reshape(-1, 3)
    mean, square = flat.sum(0, dtype=np.int64), np.einsum("ij,ij->j", flat.astype(np.int64), flat.astype(np.int64))
    n = len(flat)
    spread = [(int(q) * n - int(m) ** 2) / n**2 for m, q in zip(mean, square, strict=True)]
    return f"{rgb.shape[1]}x{rgb.shape[0]} mean " + " ".join(f"{int(m) / n:.3f}" for m in mean) + " var " + " ".join(f"{v:.3f}" for v in spread)


# --- columns --------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def to_media(texts: pd.Series) -> pd.Series:
    """A text's payload as a progressive JPEG; null counts as empty."""
    return texts.map(lambda t: encode(padded(t)[1]), na_action=None)


@F.pandas_udf(T.StructType().add("height", "integer").add("width", "integer").add("rgb", "binary"))
def to_tensor(media: pd.Series) -> pd.DataFrame:
    """The stored bytes as a full-resolution RGB tensor in row order; null stays null."""
    out = [None if m is None else rgb_of(read_coefficients(m)) for m in media]
    return pd.DataFrame({
        "height": [None if t is None else t.shape[0] for t in out],
        "width": [None if t is None else t.shape[1] for t in out],
        "rgb": [None if t is None else t.tobytes() for t in out],
    })


#: Bytes of tensors that a worker holds before it hands them on; a larger one goes alone.
HELD_BYTES = 8 << 20
DIGEST = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "height int, width int, rgb binary"
)


def digest(media: bytes) -> tuple:
    """The columns of ``DIGEST``: what the stored bytes hold once read back, and their full-resolution tensor (height x width x 3 bytes)."""
    frame = read_coefficients(media)
    p, rgb = payload_of(frame), rgb_of(frame)
    return (
        len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(rgb),
        *rgb.shape[:2], rgb.tobytes(),
    )


def tensors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, the columns of ``DIGEST``): each text stored as a progressive JPEG, read back and kept as a tensor.

    A null text counts as empty and gives the image of 64 zero bytes; repeated rows give equal rows,
    null keys stay, an empty table gives an empty result. A worker holds few tensors at once.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = ["key", "n_bytes", *(c.split()[0] for c in DIGEST.split(", "))]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("media")
        for batch in batches:
            start, held, size = 0, [], 0
            keys, texts = batch.column("key"), batch.column("text")
            for i in range(len(texts)):
                n, payload = padded(texts[i].as_py())
                held.append((n, *digest(encode(payload))))
                size += len(held[-1][-1])
                if size >= HELD_BYTES or i == len(texts) - 1:
                    columns = [keys.slice(start, len(held)), *(pa.array(list(c), t) for c, t in zip(zip(*held), TYPES, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    start, held, size = i + 1, [], 0

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(made, f"key {kind}, n_bytes bigint, {DIGEST}").withColumnRenamed("key", key)


TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())


def store_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with its texts' payloads as a column of progressive JPEG files."""
    return docs.withColumn(media, to_media(F.col(text)))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest and tensor of each text's stored JPEG."""
    return tensors(documents(spark, sf_dir))


ship(__name__)
