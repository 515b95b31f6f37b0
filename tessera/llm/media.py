"""Motion-JPEG in AVI: writing, reading by the RIFF index, decoding, shot detection.

Bytes are stored as samples without loss in baseline JPEG: a sample is an 8x8 block of one value,
whose quantised DC coefficient is the sample itself (the quantiser is 8, the transform's gain for
a flat block).  The Huffman table is chosen so that every difference takes 9 bits and the empty
rest of the block one more, so whole frames are packed and unpacked by array operations; any
baseline decoder reads them.  `decode_frame` also decodes other baseline frames (any Huffman and
quantiser tables or the usual ones, sampling factors, restart intervals), bit by bit.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

WIDE, HIGH = 64, 16  # blocks in a frame
FRAME = WIDE * HIGH
FPS = 25
UNIT = 64
TOGETHER = 256  # frames in one array


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Row-major places in the order in which coefficients are coded."""
    places = [(r, c) for r in range(8) for c in range(8)]
    places.sort(key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * r + c for r, c in places])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1)
def _tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """Our frame header; the 10-bit code of each difference (plus 255); the difference of each code."""
    # Differences of 0 to 8 bits get codes of 9 to 1 bits, so any difference takes 9 bits in all.
    dc = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = bytes([1] + [0] * 15) + b"\0"  # end of block: one 0 bit
    quantiser = bytes([8] + [1] * 63)
    head = b"\xff\xd8" + _segment(0xDB, b"\0" + quantiser) + _segment(0xC0, struct.pack(">BHHB3B", 8, HIGH * 8, WIDE * 8, 1, 1, 0x11, 0))
    head += _segment(0xC4, b"\0" + dc) + _segment(0xC4, b"\x10" + ac) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    codes, back = np.zeros(511, dtype=np.uint64), np.zeros(1024, dtype=np.int16)
    for length, size in enumerate(range(8, -1, -1), 1):
        prefix = (1 << length) - 2  # canonical: 0, 10, 110, ...
        for extra in range(1 << size):
            value = 0 if not size else extra if extra >> size - 1 else extra - (1 << size) + 1
            codes[value + 255] = (prefix << size | extra) << 1
            back[(prefix << size | extra) << 1] = value
    return head, codes, back


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _frames(payload: bytes) -> list[bytes]:
    head, codes, _ = _tables()
    count, size = -(-len(payload) // FRAME), FRAME * 10 // 8
    samples = np.zeros(count * FRAME, dtype=np.int16)
    samples[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    steps = np.diff(samples.reshape(count, FRAME) - 128, axis=1, prepend=np.int16(0))
    four = codes[steps + 255].reshape(-1, 4)
    packed = four[:, 0] << np.uint64(30) | four[:, 1] << np.uint64(20) | four[:, 2] << np.uint64(10) | four[:, 3]
    data = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    return [_chunk(b"00dc", head + data[i : i + size].replace(b"\xff", b"\xff\0") + b"\xff\xd9") for i in range(0, len(data), size)]


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload's bytes as samples, the last one filled with zeros.

    The payload's length is in the INFO list.
    """
    count = -(-len(payload) // FRAME)
    frames = [f for at in range(0, len(payload), TOGETHER * FRAME) for f in _frames(payload[at : at + TOGETHER * FRAME])]
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, count, 0, 1, 0, WIDE * 8, HIGH * 8, 0, 0, 0, 0)
    stream = struct.pack("<4s4sI2H8I4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, count, 0, 0xFFFFFFFF, 0, 0, 0, WIDE * 8, HIGH * 8)
    shape = struct.pack("<3I2H4s5I", 40, WIDE * 8, HIGH * 8, 1, 24, b"MJPG", WIDE * HIGH * 192, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", shape)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4s2I", b"00dc", 0x10, at) + f[4:8])  # f[4:8]: its length without padding
        at += len(f)
    return _chunk(b"RIFF", b"AVI " + lists + info + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    fps: float
    frames: list[bytes]
    info: dict[str, str]


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def _video(data: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Where the video chunks of a movi list are, also those grouped in `rec ` lists."""
    for name, start, size in _chunks(data, at, end):
        if name == b"LIST" and data[start : start + 4] == b"rec ":
            yield from _video(data, start + 4, start + size)
        elif name[2:4] in (b"dc", b"db"):
            yield start, start + size


def _indexed(data: bytes, movi: int, index: tuple[int, int]) -> list[tuple[int, int]] | None:
    """Where an idx1 says that video chunks are; None if it points elsewhere than at their headers."""
    entries = [e for e in struct.iter_unpack("<4s3I", data[index[0] : index[0] + index[1] // 16 * 16]) if e[0][2:4] in (b"dc", b"db")]
    for base in (movi, 0):  # offsets are from `movi` or from the file's start
        places = [(base + o + 8, base + o + 8 + n) for _, _, o, n in entries]
        if all(data[s - 8 : s - 4] == name and e <= len(data) for (s, e), (name, *_) in zip(places, entries, strict=True)):
            return places
    return None


def read_avi(data: bytes) -> Avi:
    """Frames of the first video stream, by the index where there is a right one, else in file order.

    Further RIFF segments follow in file order.  The rate is that of the main header, else of the stream's, else 0.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, rate, info, places = 0.0, 0.0, {}, []
    for outer, begin, length in _chunks(data, 0, len(data)):
        if outer != b"RIFF" or data[begin : begin + 4] not in (b"AVI ", b"AVIX"):
            continue
        movi, index = None, None
        for name, at, size in _chunks(data, begin + 4, begin + length):
            kind = data[at : at + 4] if name == b"LIST" else b""
            if kind == b"hdrl":
                for inner, start, n in _chunks(data, at + 4, at + size):
                    if inner == b"avih" and n >= 4 and not fps:
                        fps = 1e6 / (struct.unpack_from("<I", data, start)[0] or 1e6 / FPS)
                    elif inner == b"LIST":
                        for deep, s, m in _chunks(data, start + 4, start + n):
                            if deep == b"strh" and data[s : s + 4] == b"vids" and m >= 28 and not rate:
                                scale, per = struct.unpack_from("<2I", data, s + 20)
                                rate = per / scale if scale else 0.0
            elif kind == b"INFO":
                info |= {inner.decode("latin-1"): data[s : s + n].rstrip(b"\0").decode("utf-8", "replace") for inner, s, n in _chunks(data, at + 4, at + size)}
            elif kind == b"movi":
                movi = at, size
            elif name == b"idx1":
                index = at, size
        if movi:
            found = _indexed(data, movi[0], index) if index else None
            places += _video(data, movi[0] + 4, movi[0] + movi[1]) if found is None else found
    return Avi(fps or rate, [data[s:e] for s, e in places], info)


#: The Huffman tables that frames without their own use: counts by length, then the first symbols; the other symbols of AC tables follow in order.
_USUAL = (
    (0x00, (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))),
    (0x01, (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12))),
    (0x10, (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82)),
    (0x11, (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), (
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1)),
)


@lru_cache(1)
def usual_tables() -> dict[int, dict]:
    """The tables that are taken where a frame has none, by class and number."""
    symbols = {0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))}
    return {name: _huffman(bytes(counts) + bytes(first) + (bytes(sorted(symbols - set(first))) if name & 0x10 else b"")) for name, counts, first in _USUAL}


def _huffman(body: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            out[length, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segments(frame: bytes):
    """(marker, start, end) of each header segment; the last is the scan's header."""
    at = 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        yield marker, at + 4, at + 2 + size
        at += 2 + size
        if marker == 0xDA:
            return


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n]:
            value = value << 1 | bit
        self.at += n
        return value

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> n - 1 else value - (1 << n) + 1


def _luma_coefficients(frame: bytes) -> tuple[np.ndarray, int, int]:
    """Dequantised 8x8 coefficient blocks of the first component, (rows, columns, 64), and its height and width."""
    quantisers, tables, parts, restart = {}, dict(usual_tables()), [], 0
    scan = None
    for marker, at, end in _segments(frame):
        if marker == 0xDB:
            while at < end:
                wide, name = frame[at] >> 4, frame[at] & 15
                quantisers[name] = np.frombuffer(frame, ">u2" if wide else ">u1", 64, at + 1).astype(np.int64)
                at += 65 + 64 * wide
        elif marker == 0xC4:
            while at < end:
                size = 17 + sum(frame[at + 1 : at + 17])
                tables[frame[at]] = _huffman(frame[at + 1 : at + size])
                at += size
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", frame, at)[0]
        elif marker in (0xC0, 0xC1):
            high, wide, n = struct.unpack_from(">xHHB", frame, at)
            parts = [(frame[at + 6 + 3 * i], frame[at + 7 + 3 * i] >> 4, frame[at + 7 + 3 * i] & 15, frame[at + 8 + 3 * i]) for i in range(n)]
        elif marker in range(0xC2, 0xD0) and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDA:
            uses = {frame[at + 1 + 2 * i]: frame[at + 2 + 2 * i] for i in range(frame[at])}
            scan = frame[end : frame.rindex(b"\xff\xd9")]
    if scan is None or not parts:
        raise ValueError("a frame without a scan")
    pieces, start = [], 0
    for i in range(len(scan) - 1):
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            pieces.append(scan[start:i])
            start = i + 2
    pieces = [_Bits(p.replace(b"\xff\0", b"\xff")) for p in [*pieces, scan[start:]]]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    single = len(parts) == 1
    if single:
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    out = np.zeros((down * parts[0][2], across * parts[0][1], 64), dtype=np.int64)
    order, last, bits = zigzag(), {}, None
    for mcu in range(across * down):
        if mcu == 0 or restart and mcu % restart == 0:
            bits, last = pieces.pop(0), {}
        for k, (name, h, v, q) in enumerate(parts):
            dc, ac = tables[uses[name] >> 4], tables[0x10 | uses[name] & 15]
            for block in range(h * v):
                values = np.zeros(64, dtype=np.int64)
                last[name] = values[0] = last.get(name, 0) + bits.signed(bits.symbol(dc))
                i = 1
                while i < 64:
                    both = bits.symbol(ac)
                    if both == 0:
                        break
                    i += both >> 4
                    if both & 15:
                        values[i] = bits.signed(both & 15)
                    i += 1
                if k == 0:
                    place = np.zeros(64, dtype=np.int64)
                    place[order] = values * quantisers[q]
                    out[mcu // across * v + block // h, mcu % across * h + block % h] = place
    return out, -(-high * parts[0][2] // most_v), -(-wide * parts[0][1] // most_h)


@lru_cache(1)
def _basis() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)


def decode_frame(frame: bytes) -> np.ndarray:
    """The luma samples of any baseline frame."""
    blocks, high, wide = _luma_coefficients(frame)
    rows, columns, _ = blocks.shape
    basis = _basis()
    pixels = basis.T @ blocks.reshape(rows, columns, 8, 8) @ basis
    plane = pixels.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)[:high, :wide]
    return np.clip(np.round(plane) + 128, 0, 255).astype(np.uint8)


def block_samples(frames: list[bytes]) -> list[np.ndarray]:
    """For each frame the mean of every 8x8 block, in row order: the stored samples of frames that write_avi made."""
    head = _tables()[0]
    out = []
    for at in range(0, len(frames), TOGETHER):
        some = frames[at : at + TOGETHER]
        if all(f.startswith(head) for f in some):
            out += _own_samples(some)
        else:
            out += [_block_means(decode_frame(f)) for f in some]
    return out


def _own_samples(frames: list[bytes]) -> list[np.ndarray]:
    head, _, back = _tables()
    raw = b"".join(f[len(head) : f.rindex(b"\xff\xd9")].replace(b"\xff\0", b"\xff") for f in frames)
    if len(raw) != len(frames) * FRAME * 10 // 8:
        raise ValueError("a frame is cut short")
    wide = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    wide[:, 3:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    packed = wide.view(">u8").astype(np.uint64).ravel()
    codes = np.stack([packed >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1)
    return list((np.cumsum(back[codes].reshape(-1, FRAME), axis=1) + 128).astype(np.uint8))


def _block_means(plane: np.ndarray) -> np.ndarray:
    plane = plane[: len(plane) // 8 * 8, : plane.shape[1] // 8 * 8]
    return plane.reshape(len(plane) // 8, 8, -1, 8).mean(axis=(1, 3)).round().astype(np.uint8).ravel()


def shots(frames: list[np.ndarray], window: int = 12, deviations: float = 3.0, least: float = 0.25) -> list[tuple[int, int]]:
    """(first, end) frames of each shot.

    The difference of neighbouring frames is half the L1 distance of their 32-bin histograms (0 to
    1).  A cut is where it is at least `least` and `deviations` standard deviations above the mean of
    the other differences within `window` frames, so the threshold follows the material.
    """
    if not frames:
        return []
    levels = np.array([np.bincount(f >> 3, minlength=32) / max(1, f.size) for f in frames])
    steps = np.abs(np.diff(levels, axis=0)).sum(axis=1) / 2
    cuts = []
    for i in np.flatnonzero(steps >= least):
        near = np.concatenate((steps[max(0, i - window) : i], steps[i + 1 : i + 1 + window]))
        if not len(near) or steps[i] >= near.mean() + deviations * near.std():
            cuts.append(int(i) + 1)
    return list(zip([0, *cuts], [*cuts, len(frames)], strict=True))


def stored(text: Column) -> Column:
    """The AVI file of each text's padded UTF-8 bytes; null as empty.

    Texts of any length are stored whole, some frames at a time; equal texts have equal files.
    """

    @F.arrow_udf(T.BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((write_avi(padded((t.as_py() or "").encode("utf-8", "replace"))) for t in texts), type=pa.binary())

    return run(text)


_CLIP = T.StructType([T.StructField(n, t) for n, t in (("first", T.IntegerType()), ("end", T.IntegerType()), ("start_s", T.DoubleType()), ("end_s", T.DoubleType()), ("level", T.DoubleType()))])
_READ = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("frames", T.IntegerType()), T.StructField("fps", T.DoubleType()), T.StructField("clips", T.ArrayType(_CLIP)), T.StructField("error", T.StringType())])


def _opened(data: bytes, window: int, deviations: float, least: float) -> dict:
    avi = read_avi(data)
    planes = block_samples(avi.frames)
    payload = np.concatenate([np.zeros(0, np.uint8), *planes]).tobytes()
    said = avi.info.get("ICMT", "")
    if said.startswith("payload=") and said[8:].isdigit():
        payload = payload[: int(said[8:])]
    time = lambda n: n / avi.fps if avi.fps else None
    clips = [{"first": a, "end": b, "start_s": time(a), "end_s": time(b), "level": float(np.mean([p.mean() for p in planes[a:b]]))} for a, b in shots(planes, window, deviations, least)]
    return {"payload": payload, "frames": len(planes), "fps": avi.fps, "clips": clips, "error": None}


def opened(media: Column, window: int = 12, deviations: float = 3.0, least: float = 0.25) -> Column:
    """struct(payload, frames, fps, clips, error) of each AVI file; null for null.

    payload is the stored bytes of files that say how many they hold, else all samples; clips are the shots with
    their times and mean sample.  A file without a rate has fps 0 and null times.  Whatever is no AVI or cannot be
    decoded has null payload, no frames and clips, and the reason as error; empty files are such.  Repeated files
    have equal results.  Only this column is read, so others may have any names.
    """

    @F.arrow_udf(_READ)
    def run(files: pa.Array) -> pa.Array:
        out = []
        for file in files:
            data = file.as_py()
            if data is None:
                out.append(None)
                continue
            try:
                out.append(_opened(data, window, deviations, least))
            except (ValueError, LookupError, struct.error) as error:
                out.append({"payload": None, "frames": 0, "fps": 0.0, "clips": [], "error": f"{type(error).__name__}: {error}"})
        clip = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("level", pa.float64())])
        return pa.array(out, type=pa.struct([("payload", pa.binary()), ("frames", pa.int32()), ("fps", pa.float64()), ("clips", pa.list_(clip)), ("error", pa.string())]))

    return run(media)


def clip_rows(docs: DataFrame, media_col: str = "media", **how) -> DataFrame:
    """A row for each shot: the columns of docs and clip, first, end, start_s, end_s, level; columns of docs with these names are replaced.

    Null media and files without frames have no rows.
    """
    kept = [c for c in docs.columns if c not in ("clip", "first", "end", "start_s", "end_s", "level")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), opened(F.col(media_col), **how).alias("_read"))
    rows = rows.select(*(F.col(f"`{c}`") for c in kept), F.posexplode("_read.clips").alias("clip", "_clip"))
    return rows.select(*(F.col(f"`{c}`") for c in kept), "clip", "_clip.*")
