"""Media columns: progressive JPEG in, full-resolution RGB tensors out.

decode() reads a progressive (SOF2) Huffman-coded JPEG: it accumulates spectral-selection and
successive-approximation scans into one coefficient array a component, inverse-transforms them in
numpy, upsamples chroma and converts to RGB. Where a scan's Huffman table has a single symbol every
block has the same number of bits, and the scan is read as one numpy bit array; other scans are read
symbol by symbol.

pack() is the lossless carrier for bytes: 64 of them are the coefficients of one 8 x 8 block (each
byte plus 256, so that all have the same magnitude class), in a 4:2:0 image of three components, sent
in thirteen scans (DC and AC bands without their lowest bit, then that bit). unpack() gives them
back from the coefficients. The number of payload bytes is in a comment segment.

A null text is the empty payload; a null media value gives null results. Rows with null or repeated ids keep a
row each, in no particular order; equal texts give equal media. Columns other than the key and the text are left out.
Bytes that aren't such a JPEG raise ValueError naming the fault.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import arrow, saved, table

BLOCKS = 4096  # blocks handled at once; a multiple of 8, so that bits end on a byte
TALL = 4000  # rows of MCUs before an image gets another column
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
_k, _x = np.arange(8), np.arange(8)
_basis = np.where(_k == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _x + 1) * _k[:, None] * np.pi / 16)
#: (64, 64): zigzag coefficients to samples.
INVERSE = np.einsum("ux,vy->uvxy", _basis, _basis).reshape(64, 64)[ZIGZAG].astype(np.float32)
_ends = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_restarts = re.compile(rb"\xff[\xd0-\xd7]")


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks, whole MCUs
    high: int = 0
    own_wide: int = 0  # blocks that hold samples
    own_high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    parts: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


# --- writing


def _bits(blocks: np.ndarray, first: int, last: int) -> np.ndarray:
    """The bits of a band of 7 high bits each: code 0, then the 8-bit magnitude."""
    high = (blocks[:, first : last + 1] >> 1) | 128
    out = np.zeros((*high.shape, 9), np.uint8)
    out[..., 1:] = np.unpackbits(high.reshape(-1, 1), axis=1).reshape(*high.shape, 8)
    return out.reshape(-1)


def _stream(blocks: np.ndarray, bits) -> bytes:
    """Packed bits of all blocks, padded with ones, 0xFF stuffed."""
    parts = []
    for i in range(0, len(blocks), BLOCKS):
        b = bits(blocks[i : i + BLOCKS])
        if len(b) % 8:
            b = np.concatenate([b, np.ones(-len(b) % 8, np.uint8)])
        parts.append(np.packbits(b).tobytes())
    return b"".join(parts).replace(b"\xff", b"\xff\x00")


def _restarted(blocks: np.ndarray) -> bytes:
    """First DC scan, one block a restart interval: the prediction is 0 for each."""
    high = ((blocks[:, 0] >> 1) | 128).astype(np.uint8)
    out = np.empty((len(blocks), 5), np.uint8)
    out[:, 0], out[:, 1] = high >> 1, (high << 7) | 127
    out[:, 2], out[:, 3], out[:, 4] = 0, 255, 0xD0 + np.arange(len(blocks)) % 8
    keep = np.ones(out.shape, bool)
    keep[:, 2] = out[:, 1] == 255
    keep[-1, 3:] = False
    return out[keep].tobytes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_symbol(kind: int, symbol: int) -> bytes:
    """A Huffman table with one code: the bit 0."""
    return bytes([kind, 1] + [0] * 15 + [symbol])


def padded_size(n: int) -> int:
    return max(64, -(-n // 64) * 64)


def layout(n_blocks: int) -> tuple[int, int]:
    """MCU columns and rows for so many blocks, six to an MCU."""
    mcus = -(-n_blocks // 6)
    columns = -(-mcus // TALL)
    return columns, -(-mcus // columns)


def pack(data: bytes) -> bytes:
    """data as a progressive JPEG."""
    size = padded_size(len(data))
    columns, rows = layout(size // 64)
    blocks = np.zeros((columns * rows * 6, 64), np.uint8)
    blocks.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
    n = columns * rows
    out = [b"\xff\xd8", _segment(0xFE, b"bytes=%d" % len(data)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_segment(0xC4, _one_symbol(0x00, 8) + _one_symbol(0x10, 8) + _one_symbol(0x11, 0)))
    parts = [(1, blocks[: 4 * n]), (2, blocks[4 * n : 5 * n]), (3, blocks[5 * n :])]
    sos = lambda ident, ac, first, last, approx: _segment(0xDA, bytes([1, ident, ac, first, last, approx]))
    out.append(_segment(0xDD, b"\x00\x01"))
    for ident, b in parts:
        out += [sos(ident, 0, 0, 0, 0x01), _restarted(b)]
    out.append(_segment(0xDD, b"\x00\x00"))
    for first, last, some in ((1, 5, parts[:1]), (6, 63, parts[:1]), (1, 63, parts[1:])):
        for ident, b in some:
            out += [sos(ident, 0, first, last, 0x01), _stream(b, lambda x, f=first, t=last: _bits(x, f, t))]
    for ident, b in parts:
        out += [sos(ident, 0, 0, 0, 0x10), _stream(b, lambda x: x[:, 0] & 1)]

    def low(x):
        bits = x & 1
        bits[:, 0] = 0  # the code of the end of the band
        return bits.reshape(-1)

    for ident, b in parts:
        out += [sos(ident, 1, 1, 63, 0x10), _stream(b, low)]
    return b"".join(out) + b"\xff\xd9"


# --- reading


class _Bits:
    """Bits of one stretch between restarts, without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.n = data, 0, len(data) * 8

    def bit(self) -> int:
        if self.at >= self.n:
            raise ValueError("a scan ends early")
        b = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return b

    def bits(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def number(self, size: int) -> int:
        v = self.bits(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _tables(body: bytes, into: dict) -> None:
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        codes, code, k = {}, 0, at + 17
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                codes[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        into[kind >> 4, kind & 15] = codes
        at = k


def _uniform(part: Component, data: bytes, n: int, first: int, last: int, high: int, low: int, codes: dict | None, restart: int) -> bool:
    """Reads a scan whose blocks all have the same number of bits; False: it isn't one."""
    only = next(iter(codes.values())) if codes and len(codes) == 1 and next(iter(codes)) == (1, 0) else None
    if part.wide != part.own_wide or (codes and only is None):
        return False
    coef, width = part.coef, last - first + 1
    if first == 0 and high:
        each = 1
    elif first == 0 or (not high and only and only >> 4 == 0):
        if (first == 0 and restart != 1) or only > 14:
            return False
        each = width * (1 + only)
    elif high and only == 0 and coef[:n, first : last + 1].all():
        each = 1 + width
    else:
        return False
    if restart and (restart != 1 or first or high):
        return False
    if restart:
        step = -(-each // 8)
        raw = np.frombuffer(_restarts.sub(b"", data).replace(b"\xff\x00", b"\xff"), np.uint8)
        if len(raw) != n * step:
            return False
    else:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        if len(raw) < -(-n * each // 8):
            raise ValueError("a scan ends early")
    for i in range(0, n, BLOCKS):
        m = min(BLOCKS, n - i)
        if restart:
            bits = np.unpackbits(raw[i * step : (i + m) * step].reshape(m, step), axis=1)[:, :each]
        else:
            bits = np.unpackbits(raw[i * each // 8 : -(-(i + m) * each // 8)], count=m * each)
        if first == 0 and high:
            coef[i : i + m, 0] |= bits.astype(np.int16) << low
        elif high:
            bits = bits.reshape(m, each)
            if bits[:, 0].any():
                raise ValueError("no such Huffman code")
            band = coef[i : i + m, first : last + 1]
            more = bits[:, 1:].astype(np.int16) << low
            band += more if (band > 0).all() else np.where(band > 0, more, -more)
        else:
            bits = bits.reshape(m * width, 1 + only)
            if bits[:, 0].any():
                raise ValueError("no such Huffman code")
            if only == 8:
                v = np.packbits(bits[:, 1:], axis=1)[:, 0].astype(np.int16)
            else:
                v = bits[:, 1:].astype(np.int16) @ (1 << np.arange(only - 1, -1, -1, dtype=np.int16))
            if only and not bits[:, 1].all():
                v = np.where(bits[:, 1] == 1, v, v - (1 << only) + 1)
            coef[i : i + m, first : last + 1] = v.reshape(m, width) << low
    return True


def _refine(bits: _Bits, c: np.ndarray, one: int) -> None:
    if bits.bit():
        c[...] += one if c > 0 else -one


def _ac(bits: _Bits, row: np.ndarray, first: int, last: int, high: int, low: int, codes: dict, eob: int) -> int:
    """One block of an AC scan; eob: blocks left in the run of ended bands. Returns it anew."""
    one = 1 << low
    k = first
    if not eob:
        while k <= last:
            rs = bits.symbol(codes)
            run, size = rs >> 4, rs & 15
            if size == 0 and run < 15:
                eob = (1 << run) + bits.bits(run)
                break
            value = 0
            if size:
                value = bits.number(size) if not high else (1 if bits.bit() else -1)
            if not high:
                k += run
            else:
                while k <= last:
                    if row[k]:
                        _refine(bits, row[k : k + 1], one)
                    elif run == 0:
                        break
                    else:
                        run -= 1
                    k += 1
            if value:
                if k > last:
                    raise ValueError("a run leaves its band")
                row[k] = value << low if value > 0 else -(-value << low)
            k += 1
    if eob:
        if high:
            for j in range(k, last + 1):
                if row[j]:
                    _refine(bits, row[j : j + 1], one)
        eob -= 1
    return eob


def _scan(img: Image, body: bytes, data: bytes, tables: dict, restart: int) -> None:
    n = body[0]
    chosen = []
    for i in range(n):
        part = next((p for p in img.parts if p.ident == body[1 + 2 * i]), None)
        if part is None:
            raise ValueError("a scan of no component")
        chosen.append((part, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
    first, last, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
    high, low = approx >> 4, approx & 15
    if n == 1:
        part, dc, ac = chosen[0]
        codes = None if first == 0 and high else tables.get((0, dc) if first == 0 else (1, ac))
        if codes is None and not (first == 0 and high):
            raise ValueError("a scan without its Huffman table")
        if _uniform(part, data, part.own_wide * part.own_high, first, last, high, low, codes, restart):
            return
        order = [[(part, y * part.wide + x, dc, ac)] for y in range(part.own_high) for x in range(part.own_wide)]
    else:
        across, down = chosen[0][0].wide // chosen[0][0].h, chosen[0][0].high // chosen[0][0].v
        order = [[(p, (my * p.v + y) * p.wide + mx * p.h + x, dc, ac) for p, dc, ac in chosen for y in range(p.v) for x in range(p.h)] for my in range(down) for mx in range(across)]
    stretches = [_Bits(x.replace(b"\xff\x00", b"\xff")) for x in _restarts.split(data)]
    for i in range(0, len(order), restart or len(order)):
        bits, before, eob = stretches[i // (restart or len(order))], dict.fromkeys((p.ident for p in img.parts), 0), 0
        for unit in order[i : i + (restart or len(order))]:
            for p, at, dc, ac in unit:
                row = p.coef[at]
                if first == 0:
                    if high:
                        row[0] |= bits.bit() << low
                    else:
                        before[p.ident] += bits.number(bits.symbol(tables[0, dc]))
                        row[0] = before[p.ident] << low
                else:
                    eob = _ac(bits, row, first, last, high, low, tables[1, ac], eob)


def decode(data: bytes) -> Image:
    """All scans, as coefficients in zigzag order."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    img, tables, restart, at = Image(), {}, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            _tables(body, tables)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                img.quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.float32)
                k += 65 + 64 * (wide > 0)
        elif marker == 0xC2:
            _, img.height, img.width, n = struct.unpack_from(">BHHB", body)
            img.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(p.h for p in img.parts), max(p.v for p in img.parts)
            for p in img.parts:
                p.wide, p.high = -(-img.width // (8 * h)) * p.h, -(-img.height // (8 * v)) * p.v
                p.own_wide, p.own_high = -(-(-(-img.width * p.h // h)) // 8), -(-(-(-img.height * p.v // v)) // 8)
                p.coef = np.zeros((p.wide * p.high, 64), np.int16)
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a progressive Huffman JPEG")
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            img.comment = body
        elif marker == 0xDA:
            end = _ends.search(data, at)
            stop = end.start() if end else len(data)
            _scan(img, body, data[at:stop], tables, restart)
            at = stop
    if not img.parts:
        raise ValueError("no frame")
    return img


def unpack(img: Image) -> bytes:
    """The padded payload of a carrier made by pack()."""
    found = re.fullmatch(rb"bytes=(\d+)", img.comment)
    if not found:
        raise ValueError("not a carrier of bytes")
    blocks = np.concatenate([(p.coef - 256).astype(np.uint8) for p in img.parts])
    return blocks.tobytes()[: padded_size(int(found[1]))]


def plane(img: Image, part: Component) -> np.ndarray:
    """Samples of one component at its own resolution."""
    out = np.empty((len(part.coef), 64), np.uint8)
    turn = INVERSE * img.quant[part.quant][:, None]
    for i in range(0, len(out), BLOCKS):
        s = part.coef[i : i + BLOCKS].astype(np.float32) @ turn
        out[i : i + BLOCKS] = np.clip(np.rint(s + 128), 0, 255)
    return out.reshape(part.high, part.wide, 8, 8).transpose(0, 2, 1, 3).reshape(part.high * 8, part.wide * 8)


def rgb(img: Image) -> np.ndarray:
    """(height, width, 3) uint8; chroma is repeated up to full resolution."""
    h, v = max(p.h for p in img.parts), max(p.v for p in img.parts)
    full = [plane(img, p).repeat(v // p.v, 0).repeat(h // p.h, 1)[: img.height, : img.width] for p in img.parts]
    if len(full) == 1:
        return np.repeat(full[0][..., None], 3, 2)
    out = np.empty((*full[0].shape, 3), np.uint8)
    for i in range(0, len(out), 1024):
        y, cb, cr = (x[i : i + 1024].astype(np.float32) for x in full[:3])
        cb -= 128
        cr -= 128
        for k, s in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
            out[i : i + 1024, :, k] = np.clip(np.rint(s), 0, 255)
    return out


# --- columns


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media: each whole text as a progressive JPEG; equal texts have equal media."""
    arrow(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def encode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(x or b"") for x in b.column(1).to_pylist()], pa.binary())], [key, "media"])

    return df.select(key, F.col(text).cast("binary").alias("t")).mapInArrow(encode, f"{key} {kind}, media binary")


def to_tensors(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key, height, width, tensor: row-major RGB bytes at full resolution; null media: nulls."""
    arrow(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def read(batches):
        for b in batches:
            for k, m in zip(b.column(0), b.column(1).to_pylist()):
                t = None if m is None else rgb(decode(m))
                row = [None, None, None] if t is None else [t.shape[0], t.shape[1], t.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], b.schema.field(0).type), pa.array(row[:1], pa.int32()), pa.array(row[1:2], pa.int32()), pa.array(row[2:], pa.binary())], [key, "height", "width", "tensor"])

    return df.select(key, media).mapInArrow(read, f"{key} {kind}, height int, width int, tensor binary")


def describe(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """What the stored bytes hold, read back: payload digests and features of the RGB tensor; null media: nulls."""
    arrow(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(m):
        if m is None:
            return (None,) * 7
        img = decode(m)
        payload = unpack(img)
        t = rgb(img)
        means = ",".join(f"{x:.3f}" for x in t.reshape(-1, 3).mean(0))
        return (int(img.comment[6:]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{t.shape[1]}x{t.shape[0]} rgb {means}")

    def read(batches):
        for b in batches:
            rows = [one(m) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], [key, *names])

    return df.select(key, media).mapInArrow(read, f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_progressive_jpeg(spark, sf_dir):
    return describe(saved(to_media(table(spark, sf_dir, "documents").select("doc_id", "text")), "media"))
