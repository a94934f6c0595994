"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

A payload of 8-bit samples is stored as grey frames WIDTH wide; a frame holds ROWS rows at most, so memory for a
frame is bounded and longer payloads get more frames. Reading decodes each frame's codes, applies its palette and
draws it on the canvas as disposal and transparency ask.

Edge cases: a null text is an empty one; an empty payload is padded like any other, so there is always a frame;
equal payloads give equal files; a null file gives nulls, and so does one that isn't a GIF or ends early, with the
reason in `error`; the canvas is as large as the frames, not as the header says, and what lies beyond counts as
transparent; an empty table gives an empty one. Columns of the names that are added are replaced, all others pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import append

WIDTH, ROWS, DELAY = 64, 16384, 10
CLEAR, END, FULL = 256, 257, 4096
NUMBERS = ("number", "left", "top", "width", "height", "delay_cs", "disposal", "transparent")
FRAMES = ArrayType(StructType([*(StructField(n, IntegerType()) for n in NUMBERS), StructField("histogram", ArrayType(LongType()))]))
#: Columns that encode() and decode() add.
MEDIA = [StructField("media", BinaryType())]
LOADED = [StructField("payload", BinaryType()), StructField("frames", FRAMES), StructField("error", StringType())]
#: Bits of the i-th code after a clear code.
CODE_BITS = np.minimum(12, np.maximum(9, np.array([int(258 + max(0, i - 1)).bit_length() for i in range(8192)])))
#: The bit at which it starts.
CODE_STARTS = np.concatenate([[0], np.cumsum(CODE_BITS)])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits for 8-bit samples; the table is cleared when it is full."""
    segments, codes, new, last = [], [], 258 << 8, (FULL - 1) << 8  # codes and table hold codes shifted by a byte
    rest = iter(data)
    current = next(rest) << 8
    known, emit = {}.setdefault, codes.append
    for b in rest:
        code = known(current | b, new)  # one look finds a string or learns it
        if code == new:
            emit(current)
            current = b << 8
            if new == last:
                segments.append(codes)
                codes, new = [], 258 << 8
                known, emit = {}.setdefault, codes.append
            else:
                new += 256
        else:
            current = code
    codes.append(current)
    segments.append(codes)
    values, starts, bit = [CLEAR << 8], [np.zeros(1, np.int64)], 9
    for i, s in enumerate(segments):
        values += s
        values.append((END if i == len(segments) - 1 else CLEAR) << 8)
        starts.append(CODE_STARTS[: len(s) + 1] + bit)
        bit += int(CODE_STARTS[len(s) + 1])
    at = np.concatenate(starts)
    # a code reaches into three bytes at most; codes share bytes but no bits, so sums join them
    value, byte = (np.array(values, np.int64) >> 8) << (at & 7), at >> 3
    size = (bit + 7) >> 3
    out = np.bincount(byte, value & 255, size + 2)
    out[1:] += np.bincount(byte, value >> 8 & 255, size + 1)
    out[2:] += np.bincount(byte, value >> 16, size)
    return out[:size].astype(np.uint8).tobytes()


def lzw_codes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """Runs of codes between clear codes; size: bits of a sample."""
    clear, raw, bit = 1 << size, np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32), 0
    every = CODE_BITS if size == 8 else np.minimum(12, np.maximum(size + 1, np.array([int(clear + 2 + max(0, i - 1)).bit_length() for i in range(8192)])))
    run: list[np.ndarray] = []
    done = 0
    while True:
        some = min(4096, (8 * len(data) - bit) // (size + 1) + 1) if bit else 1  # a clear code comes first, as a rule
        widths = every[done : done + some] if done + some <= len(every) else np.full(some, 12)
        at = bit + np.concatenate(([0], np.cumsum(widths)[:-1]))
        keep = at + widths <= 8 * len(data)
        at, widths = at[keep], widths[keep]
        if not len(at):
            raise ValueError("code stream without end")
        byte = at >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stop):
            run.append(codes[: stop[0]])
            yield np.concatenate(run)
            if codes[stop[0]] == clear + 1:
                return
            run, done, bit = [], 0, int(at[stop[0]] + widths[stop[0]])
        else:
            run.append(codes)
            done, bit = done + len(codes), int(at[-1] + widths[-1])


def lzw_decode(data: bytes, size: int, most: int | None = None) -> bytes:
    """The samples for which a code stream stands; ValueError beyond `most`."""
    start = [bytes([i]) for i in range(1 << size)] + [b"", b""]
    parts, total = [], 0
    for codes in lzw_codes(data, size):
        table, run = list(start), codes.tolist() or [1 << size]
        if run[0] >= len(table):
            raise ValueError("code out of order")
        before = table[run[0]]
        learn = table.append
        for c in run[1 : 1 + FULL - len(table)]:  # then the table is full
            try:
                s = table[c]
            except IndexError:
                if c != len(table):
                    raise ValueError("code out of order") from None
                s = before + before[:1]
            learn(before + s[:1])
            before = s
        parts.append(b"".join(map(table.__getitem__, run)))
        total += len(parts[-1])
        if most is not None and total > most:
            raise ValueError("more samples than the frame holds")
    return b"".join(parts)


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray  # rows of palette numbers
    palette: np.ndarray  # 256 x 3
    delay: int
    disposal: int
    transparent: int  # -1: none


def write(frames: list[Frame]) -> bytes:
    """A GIF of frames with the first frame's palette for all."""
    h, w = max(f.top + f.samples.shape[0] for f in frames), max(f.left + f.samples.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), frames[0].palette.astype(np.uint8).tobytes()]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent >= 0), f.delay, max(f.transparent, 0), 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, f.left, f.top, f.samples.shape[1], f.samples.shape[0], 0, 8))
        codes = lzw_encode(f.samples.astype(np.uint8).tobytes())
        for i in range(0, len(codes), 255):
            part = codes[i : i + 255]
            out += (bytes([len(part)]), part)
        out.append(b"\0")
    return b"".join([*out, b";"])


def blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), np.uint8)
    colours[:n] = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3)
    return colours, at + 3 * n


def read(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    shared, at = palette(data, 13, flags)
    frames, delay, disposal, transparent = [], 0, 0, -1
    try:
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = blocks(data, at + 2)
                if label == 0xF9:
                    disposal, delay, transparent = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0], body[3] if body[0] & 1 else -1
                continue
            left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            own, at = palette(data, at + 10, flags)
            codes, after = blocks(data, at + 1)
            if not 1 <= data[at] <= 8:
                raise ValueError("samples of a size that GIF doesn't have")
            samples = np.frombuffer(lzw_decode(codes, data[at], w * h), np.uint8).reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            frames.append(Frame(left, top, samples, own if own is not None else shared if shared is not None else np.zeros((256, 3), np.uint8), delay, disposal, transparent))
            delay, disposal, transparent, at = 0, 0, -1, after
    except (IndexError, struct.error) as e:
        raise ValueError("GIF ends early") from e
    return width, height, frames


def extent(frames: list[Frame]) -> tuple[int, int]:
    """Width and height that the frames reach."""
    return max((f.left + f.samples.shape[1] for f in frames), default=0), max((f.top + f.samples.shape[0] for f in frames), default=0)


def canvases(frames: list[Frame]) -> Iterator[np.ndarray]:
    """What is seen at each frame within extent(), as rows of RGBA."""
    width, height = extent(frames)
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        h, w = f.samples.shape
        area = (slice(f.top, f.top + h), slice(f.left, f.left + w))
        before = canvas.copy() if f.disposal == 3 else None
        colours = np.concatenate([f.palette, np.full((256, 1), 255, np.uint8)], axis=1)
        if f.transparent < 0:
            canvas[area] = colours[f.samples]
        else:
            seen = f.samples != f.transparent
            canvas[area][seen] = colours[f.samples[seen]]
        yield canvas
        if f.disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray, beyond: int = 0) -> list[int]:
    """Pixels by the two high bits of red, green and blue; 64 bins, then transparent ones and those beyond the canvas."""
    flat = canvas.reshape(-1, 4)
    lit = flat[:, 3] > 0
    bins = (flat[:, 0] >> 6 << 4) | (flat[:, 1] >> 6 << 2) | (flat[:, 2] >> 6)
    counts = np.bincount(np.where(lit, bins, 64), minlength=65).tolist()
    counts[64] += beyond
    return counts


def padded(payload: bytes) -> bytes:
    return payload + b"\0" * (-len(payload) % 64 or 64 * (not payload))


def store(payload: bytes) -> bytes:
    """A padded payload as a GIF of grey frames."""
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return write([Frame(0, 0, rows[i : i + ROWS], grey, DELAY, 1, -1) for i in range(0, len(rows), ROWS)])


def stored(texts: pa.Array) -> pa.Array:
    return pa.array([store(padded((t.as_py() or "").encode())) for t in texts], pa.binary())


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `media`: the UTF-8 bytes of each whole text, padded to a multiple of 64, as a GIF."""
    return append(docs, MEDIA, lambda b: [stored(b.column(text))], by=text)


def opened(media: bytes) -> tuple[bytes, list[dict]]:
    """The red samples of all frames as stored, and the frames' times, places and histograms."""
    width, height, frames = read(media)
    payload = b"".join(f.palette[:, 0][f.samples].tobytes() for f in frames)
    w, h = extent(frames)
    beyond = max(width * height - w * h, 0)
    return payload, [
        {"number": i, "left": f.left, "top": f.top, "width": f.samples.shape[1], "height": f.samples.shape[0], "delay_cs": f.delay, "disposal": f.disposal, "transparent": f.transparent, "histogram": histogram(c, beyond)}
        for i, (f, c) in enumerate(zip(frames, canvases(frames), strict=True))
    ]


def loaded(media: pa.Array) -> list[pa.Array]:
    payloads, tables, errors = [], [], []
    for m in media:
        payload = frames = error = None
        try:
            payload, frames = opened(m.as_py()) if m.is_valid else (None, None)
        except ValueError as e:
            error = str(e)
        payloads.append(payload)
        tables.append(frames)
        errors.append(error)
    ints = [(n, pa.int32()) for n in NUMBERS]
    return [pa.array(payloads, pa.binary()), pa.array(tables, pa.list_(pa.struct([*ints, ("histogram", pa.list_(pa.int64()))]))), pa.array(errors, pa.string())]


def decode(docs: DataFrame, media: str = "media") -> DataFrame:
    """Adds `payload`, `frames` with times and histograms, and `error`."""
    return append(docs, LOADED, lambda b: loaded(b.column(media)), by=media)


def round_trip(docs: DataFrame, text: str = "text") -> DataFrame:
    """encode(), and decode() of the files it made, in one pass, so that a task holds one Python worker and files go to Spark once."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        media = stored(batch.column(text))
        return [media, *loaded(media)]

    return append(docs, [*MEDIA, *LOADED], run, by=text)
