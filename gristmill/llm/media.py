"""Media columns: AVI motion-JPEG written, read back, decoded and cut into shots.

A clip's frames are baseline grayscale JPEGs. Each sample of the payload is one flat 8x8 block, which the DCT of a
single coefficient stores without loss. The writer's Huffman tables give a DC difference of category c a code of
12 - c bits and the end-of-block 4 bits, so that every block takes 16 bits: both ways of the coding are table
lookups over whole frames. Frames of other writers (baseline JPEG, grayscale or colour with any sampling, restart
markers, tables of their own or the standard ones that motion-JPEG leaves out) go through a block-by-block decoder that
gives the pixels of every component. The reader follows the RIFF lists (``rec `` lists and further RIFF parts too) and
takes frames from the ``idx1`` index, or from ``movi`` where there is none or it does not fit. What is damaged is
flagged and costs that frame only.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import only

#: Blocks in a row of a frame, and the most rows of a frame.
WIDE, HIGH = 64, 64
FPS = 25
PAD = 64
#: Bins of a frame's histogram, frames that the threshold looks back on, and its distance in deviations.
BINS, LOOK_BACK, DEVIATIONS, LEAST = 32, 12, 3.0, 0.25
CLIPS = "clip int, start_s double, end_s double, first_frame int, frames int, damaged int, mean double, peak_difference double"
#: The zigzag order of a block's coefficients.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)
EOB = 0b0000
#: The standard Huffman tables (codes of each length, then symbols by class and number); of the AC symbols
#: the first ones, the others follow in rising order.
STANDARD_COUNTS = {
    0x00: (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0),
    0x01: (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0),
    0x10: (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    0x11: (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
}
STANDARD_FIRST = {
    0x10: "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    0x11: "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
}


# --- writer ---------------------------------------------------------------------------------------------------
def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """The 16 bits of a block by its DC difference + 255, and the difference by those 16 bits."""
    words, back = np.zeros(511, np.uint16), np.full(1 << 16, 9999, np.int16)
    code, of = 0, {}
    for length in range(4, 13):  # canonical order: short codes first, category 12 - length
        of[12 - length] = (code, length)
        code = (code + 1) << 1
    for d in range(-255, 256):
        c = abs(d).bit_length()
        bits = d if d > 0 else d + (1 << c) - 1
        prefix, _ = of[c]
        words[d + 255] = ((prefix << c | bits) << 4) | EOB
        back[words[d + 255]] = d
    return words, back


WORDS, DIFFERENCES = _dc_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(wide: int, high: int) -> bytes:
    dc = bytes([0, 0, 0, *[1] * 9, 0, 0, 0, 0]) + bytes(range(8, -1, -1))
    ac = bytes([0, 0, 0, 1, *[0] * 12, 0])
    quant = bytes([0, 8, *[1] * 63])
    return b"\xff\xd8" + b"".join(
        (
            _segment(0xE0, b"AVI1" + bytes(10)),
            _segment(0xDB, quant),
            _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + dc),
            _segment(0xC4, b"\x10" + ac),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


HEADERS: dict[tuple[int, int], bytes] = {}


def write_frame(samples: np.ndarray) -> bytes:
    """A JPEG of flat blocks, one for each of the 8-bit samples (rows, columns)."""
    high, wide = samples.shape
    head = HEADERS.get((wide, high)) or HEADERS.setdefault((wide, high), _header(wide, high))
    flat = samples.ravel().astype(np.int16)
    words = WORDS[np.diff(flat, prepend=np.int16(128)) + 255]
    return head + words.astype(">u2").tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(payload: bytes) -> bytes:
    """An AVI of the payload, whose length must be a multiple of 64; the last frame is filled up with zeros."""
    if 2 * len(payload) > 0xF0000000:
        raise ValueError("the payload is too large for the 32-bit sizes of an AVI file")
    rows = max(1, -(-len(payload) // WIDE))
    count = -(-rows // HIGH)
    high = -(-rows // count)  # frames of even size, so that little is filled up
    count = -(-rows // high)
    samples = np.frombuffer(payload.ljust(count * high * WIDE, b"\0"), np.uint8).reshape(count, high, WIDE)
    frames = [write_frame(s) for s in samples]
    w, h = WIDE * 8, high * 8
    main = struct.pack("<10I16x", 1_000_000 // FPS, 0, 0, 0x10, count, 0, 1, max(map(len, frames)), w, h)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, count, 0, 0xFFFFFFFF, 0, 0, 0, w, h)
    form = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
    headers = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form) + _chunk(b"strd", struct.pack("<Q", len(payload)))))
    chunks, index, at = [], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        chunks.append(_chunk(b"00dc", f))
        at += len(chunks[-1])
    body = b"AVI " + headers + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


# --- reader ---------------------------------------------------------------------------------------------------
class Damaged(ValueError):
    """Bytes that are no AVI file or no frame that can be decoded."""


def chunks(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name or list type, first byte, byte after the last) of the chunks between two places; lists are entered."""
    while start + 8 <= end:
        name, size = bytes(data[start : start + 4]), struct.unpack_from("<I", data, start + 4)[0]
        last = min(end, start + 8 + size)
        if name in (b"RIFF", b"LIST"):
            yield bytes(data[start + 8 : start + 12]), start + 8, last
            yield from chunks(data, start + 12, last)
        else:
            yield name, start + 8, last
        start = last + (size & 1)


class Avi:
    """A parsed file: seconds for each frame, the frames' bytes and the payload's length if the file tells it."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        parts: dict[bytes, list[tuple[int, int]]] = {}
        for name, a, b in chunks(view, 0, len(data)):
            parts.setdefault(name, []).append((a, b))
        if b"AVI " not in parts or b"movi" not in parts or b"avih" not in parts:
            raise Damaged("no AVI file")
        a, b = parts[b"avih"][0]
        self.seconds = ((struct.unpack_from("<I", view, a)[0] if b - a >= 4 else 0) or 1_000_000 // FPS) / 1e6
        found = sorted((p, q - p) for name, own in parts.items() if name[2:] in (b"dc", b"db") for p, q in own)
        places = found
        if b"idx1" in parts and len(parts[b"movi"]) == 1:
            a, b = parts[b"idx1"][0]
            movi = parts[b"movi"][0][0]
            rows = [struct.unpack_from("<4sIII", view, k) for k in range(a, b - 15, 16)]
            base = movi if not rows or rows[0][2] < movi else 0  # offsets from movi, or from the file's start
            listed = [(base + at + 8, size) for name, _, at, size in rows if name[2:] in (b"dc", b"db")]
            if len(listed) == len(rows) > 0 and all(bytes(view[p - 6 : p - 4]) in (b"dc", b"db") for p, _ in listed):
                places = listed
        self.frames = [bytes(view[p : p + n]) for p, n in places]
        a, b = parts.get(b"strd", [(0, 0)])[0]
        self.length = struct.unpack_from("<Q", view, a)[0] if b - a >= 8 else None

    def samples(self) -> list[np.ndarray]:
        return [read_frame(f) for f in self.frames]

    def seen(self) -> list[np.ndarray | None]:
        """As ``samples``, with None in place of damaged frames; an empty frame repeats the one before."""
        out: list[np.ndarray | None] = []
        for f in self.frames:
            try:
                out.append(out[-1] if not f and out else read_frame(f))
            except Damaged:
                out.append(None)
        return out


def read_frame(data: bytes) -> np.ndarray:
    """One sample for each 8x8 block of the first component: its mean, 8 bits. Exact for frames of flat blocks."""
    frame = parsed(data)
    if frame.flat:
        scan = data[frame.at : data.rfind(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
        if len(scan) == 2 * frame.high * frame.wide:
            steps = DIFFERENCES[np.frombuffer(scan, ">u2")]
            if (steps != 9999).all():
                return (np.cumsum(steps, dtype=np.int64) + 128).astype(np.uint8).reshape(frame.high, frame.wide)
    luma = pixels(data)[0]
    high, wide = -(-luma.shape[0] // 8), -(-luma.shape[1] // 8)
    full = np.pad(luma, ((0, high * 8 - luma.shape[0]), (0, wide * 8 - luma.shape[1])), "edge")
    return np.round(full.reshape(high, 8, wide, 8).mean((1, 3))).astype(np.uint8)


@dataclass
class Frame:
    """What a frame's header tells. ``parts``: (number, across, down, quantisation table) of each component; ``scan``:
    (component, DC table, AC table) in the order of the scan; ``at``: where the scan begins."""

    rows: int = 0
    columns: int = 0
    parts: tuple = ()
    scan: tuple = ()
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    restart: int = 0
    at: int = 0
    flat: bool = False

    @property
    def high(self) -> int:
        return -(-self.rows // 8)

    @property
    def wide(self) -> int:
        return -(-self.columns // 8)


PARSED: dict[bytes, Frame] = {}


def codes(counts: tuple[int, ...], symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def standard_tables() -> dict[int, dict]:
    out = {}
    for key, counts in STANDARD_COUNTS.items():
        if key in STANDARD_FIRST:
            first = bytes.fromhex(STANDARD_FIRST[key])
            every = sorted({0x00, 0xF0} | {run << 4 | size for run in range(16) for size in range(1, 11)})
            symbols = first + bytes(x for x in every if x not in first)
        else:
            symbols = bytes(range(12))
        out[key] = codes(counts, symbols)
    return out


def parsed(data: bytes) -> Frame:
    """The frame's header; Damaged if it is none of a baseline JPEG."""
    end = data.find(b"\xff\xda")
    head = data[: end + 10] if end >= 0 else b""
    if head not in PARSED:
        try:
            frame = _parsed(data)
        except (struct.error, IndexError, KeyError) as e:
            raise Damaged(f"no frame: {e}") from e
        frame.flat = head == _header(frame.wide, frame.high)
        if len(PARSED) >= 256:
            PARSED.clear()
        PARSED[head] = frame
    return PARSED[head]


def _parsed(data: bytes) -> Frame:
    if data[:2] != b"\xff\xd8":
        raise Damaged("no JPEG")
    frame, at = Frame(tables=standard_tables()), 2
    while True:
        if data[at] != 0xFF:
            raise Damaged("no marker")
        marker = data[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise Damaged("the header is cut off")
        if marker in (0xC0, 0xC1):
            bits, frame.rows, frame.columns, n = struct.unpack_from(">BHHB", body)
            frame.parts = tuple((body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n))
            if bits != 8 or not frame.rows or not frame.columns or not n or any(not p[1] or not p[2] for p in frame.parts):
                raise Damaged("only 8-bit frames of a stated size are decoded")
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                frame.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                frame.tables[body[0]] = codes(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            frame.restart = struct.unpack_from(">H", body)[0]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise Damaged("only baseline frames are decoded")
        elif marker == 0xD9:
            raise Damaged("no scan")
        at += 2 + size
        if marker == 0xDA:
            numbers = [p[0] for p in frame.parts]
            frame.scan = tuple((numbers.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])) if all(body[1 + 2 * k] in numbers for k in range(body[0])) else ()
            if len(frame.scan) != len(frame.parts) or any(p[3] not in frame.quant or len(frame.quant[p[3]]) != 64 for p in frame.parts):
                raise Damaged("only frames of one scan with their quantisation are decoded")
            frame.at = at
            return frame


class Bits:
    """The bits of a scan between two restart markers; looked up 16 at a time."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff" * 8, "big"), 8 * len(data) + 64
        self.end = 64

    def peek(self, n: int) -> int:
        return self.value >> (self.left - n) & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.left -= n
        if self.left < self.end - 32:
            raise Damaged("the scan is cut off")

    def symbol(self, table: np.ndarray) -> int:
        found = int(table[self.peek(16)])
        if found < 0:
            raise Damaged("no such code")
        self.skip(found >> 8)
        return found & 255

    def number(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek(n)
        self.skip(n)
        return value if value >> (n - 1) else value - (1 << n) + 1


def looked_up(table: dict[tuple[int, int], int]) -> np.ndarray:
    """For each 16 bits the length (times 256) and the symbol of the code that they begin with; -1 for none."""
    out = np.full(1 << 16, -1, np.int32)
    for (length, code), symbol in table.items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


STEPS = np.arange(8)
BASIS = np.cos((2 * STEPS[:, None] + 1) * STEPS * np.pi / 16) * np.where(STEPS, 0.5, np.sqrt(0.125))


def pixels(data: bytes) -> list[np.ndarray]:
    """The 8-bit samples (rows, columns) of every component, at the component's own resolution: Huffman codes, run
    lengths, dequantisation, inverse DCT. Damaged if the scan is."""
    frame = parsed(data)
    end = data.rfind(b"\xff\xd9")
    scan = data[frame.at : end if end >= frame.at else len(data)]
    runs = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", scan)] if frame.restart else [scan.replace(b"\xff\x00", b"\xff")]
    across, down = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
    if len(frame.parts) == 1:
        across = down = 1
    units = -(-frame.columns // (8 * across)), -(-frame.rows // (8 * down))
    shape = [(units[1] * (p[2] if len(frame.parts) > 1 else 1), units[0] * (p[1] if len(frame.parts) > 1 else 1)) for p in frame.parts]
    values = [np.zeros((*s, 64)) for s in shape]
    tables = {k: looked_up(t) for k, t in frame.tables.items()}
    try:
        each = frame.restart or units[0] * units[1]
        for unit in range(units[0] * units[1]):
            if unit % each == 0:
                bits, last = Bits(runs[unit // each]), [0] * len(frame.parts)
            for part, dc, ac in frame.scan:
                h, v = frame.parts[part][1:3] if len(frame.parts) > 1 else (1, 1)
                for block in range(h * v):
                    row, column = unit // units[0] * v + block // h, unit % units[0] * h + block % h
                    own = values[part][row, column]
                    last[part] += bits.number(bits.symbol(tables[dc]))
                    own[0], place = last[part], 1
                    while place < 64 and (s := bits.symbol(tables[0x10 | ac])):
                        place += s >> 4
                        if s & 15:
                            own[ZIGZAG[place]] = bits.number(s & 15)
                        place += 1
    except (IndexError, KeyError) as e:
        raise Damaged("the scan does not fit its header") from e
    out, order = [], np.array(ZIGZAG)
    for (_, h, v, q), own, (high, wide) in zip(frame.parts, values, shape, strict=True):
        square = np.zeros(64)
        square[order] = frame.quant[q]
        blocks = np.einsum("xu,ijuv,yv->ijxy", BASIS, (own * square).reshape(high, wide, 8, 8), BASIS) + 128
        plane = np.clip(np.round(blocks), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8)
        out.append(plane[: -(-frame.rows * v // down) if len(frame.parts) > 1 else frame.rows, : -(-frame.columns * h // across) if len(frame.parts) > 1 else frame.columns])
    return out


# --- shots ----------------------------------------------------------------------------------------------------
def differences(frames: list[np.ndarray]) -> np.ndarray:
    """Half the L1 distance of each frame's histogram to that of the frame before; 0 for the first."""
    shares = np.stack([np.bincount(f.ravel() // (256 // BINS), minlength=BINS) / f.size for f in frames])
    return np.concatenate(([0.0], np.abs(np.diff(shares, axis=0)).sum(1) / 2))


def cuts(steps: np.ndarray) -> list[int]:
    """Frames that begin a shot: their difference is above LEAST and above what the shot has seen of late."""
    found = [0]
    for k in range(1, len(steps)):
        late = steps[max(found[-1] + 1, k - LOOK_BACK) : k]
        usual = late.mean() + DEVIATIONS * late.std() if len(late) else 0.0
        if steps[k] > max(LEAST, usual):
            found.append(k)
    return found


def clips(avi: Avi, frames: list[np.ndarray | None]) -> list[tuple]:
    """Timed clip rows (columns of CLIPS), one for each shot. Damaged frames are counted; the frame before stands for
    them (the first sound one for those at the start)."""
    sound = [f for f in frames if f is not None]
    if not frames:
        return []
    if not sound:
        return [(0, 0.0, len(frames) * avi.seconds, 0, len(frames), len(frames), None, None)]
    filled, before = [], sound[0]
    for f in frames:
        before = before if f is None else f
        filled.append(before)
    steps = differences(filled)
    starts = cuts(steps)
    return [
        (i, a * avi.seconds, b * avi.seconds, a, b - a, sum(f is None for f in frames[a:b]), float(np.mean([f.mean() for f in filled[a:b]])), float(steps[a]))
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True))
    ]


def payload_of(text: str | None) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return len(data), data + b"\0" * (-len(data) % PAD if data else PAD)


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each document's text as an AVI file. Null text is empty: 64 zero samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [payload_of(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in made], "media": [write_avi(p) for _, p in made]})

    return only(docs, "doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """doc_id and one row of CLIPS for each shot of each file in ``media``. Null bytes, and such as are no AVI file,
    give no rows; files that are cut off or hold damaged frames give what there is, with those frames counted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, data in zip(frame["doc_id"], frame["media"], strict=True):
                try:
                    avi = Avi(bytes(data or b""))
                except (Damaged, struct.error):
                    continue
                rows += [(doc_id, *c) for c in clips(avi, avi.seen())]
            yield pd.DataFrame(rows, columns=["doc_id", *[c.split()[0] for c in CLIPS.split(", ")]]).astype({"mean": float, "peak_difference": float})

    return only(media, "doc_id", "media").mapInPandas(run, f"doc_id long, {CLIPS}")


def digests(media: DataFrame) -> DataFrame:
    """The stored files read back: payload and media digests, and the shots as one feature text."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, n, data in zip(frame["doc_id"], frame["n_bytes"], frame["media"], strict=True):
                avi = Avi(data)
                seen = avi.samples()
                back = np.concatenate([s.ravel() for s in seen]).tobytes()[: avi.length]
                shots = clips(avi, seen)
                feature = f"frames={len(seen)};shots={len(shots)};" + ",".join(f"{c[1]:.2f}-{c[2]:.2f}:{c[6]:.1f}" for c in shots)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    return only(media, "doc_id", "n_bytes", "media").mapInPandas(run, schema)


def media_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``; equal texts have equal values.

    Null text is empty. A file holds a text of up to some 2 GB (an AVI's sizes have 32 bits; larger ones raise an
    error that says so). Rows without doc_id and repeated ones are rows of their own; an empty table gives an empty
    result; other columns are not looked at.
    """
    return digests(stored_media(docs.select(F.col("doc_id").cast("long"), "text")))
