"""GIF media: LZW code streams, palettes, disposal and transparency, timed frames.

`decode` reads any GIF87a/89a; `gif_frames` turns a binary column into one row
per frame with its timing and a colour histogram of the composed canvas;
`text_media` stores texts as GIF samples and reads them back.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.llm.common import batch_of, bounded_batches, per_row, slices, slim

MAX_CODES = 4096
#: Larger canvases and frames are an error: a header of 35 bytes can ask for gigabytes.
MAX_PIXELS = 1 << 24
WIDTH = 64
ROWS_PER_FRAME = 1024
FRAME_DELAY_MS = 100
UNIT = 64
#: Rows of an interlaced image in stored order: (first row, step).
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))


class GifError(ValueError):
    """The bytes are not a GIF that can be decoded."""


def code_widths(min_size: int, codes: int) -> np.ndarray:
    """Bits of each code after a clear: fixed by its place, as every code adds a table entry."""
    free = (1 << min_size) + 2 + np.maximum(0, np.arange(codes) - 1)
    return np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, min_size + 1, 12)


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """Greedy LZW; the table is cleared when it is full."""
    clear = 1 << min_size
    codes = [clear]
    if data:
        add, table, free = codes.append, {}, clear + 2
        prefix = data[0]
        for value in data[1:]:
            key = prefix << 8 | value
            if key in table:
                prefix = table[key]
                continue
            add(prefix)
            if free < MAX_CODES:
                table[key] = free
                free += 1
            else:
                add(clear)
                table = {}
                free = clear + 2
            prefix = value
        add(prefix)
    codes.append(clear + 1)
    array = np.array(codes, np.uint32)
    per_table = MAX_CODES - clear  # codes from one clear to the next, that one included
    widths = np.concatenate([[min_size + 1], np.resize(_schedule(min_size)[:per_table], len(codes) - 1)])
    return _packed(array, widths)


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of at most 12 bits, low bits first, end to end."""
    ends = np.cumsum(widths)
    starts = ends - widths
    shifted = codes << (starts & 7).astype(np.uint32)  # of at most 19 bits: three bytes
    byte, size = starts >> 3, int(ends[-1] + 7 >> 3)
    # bits don't overlap, so sums are unions
    parts = [np.bincount(byte + k, shifted >> np.uint32(8 * k) & np.uint32(255), size + 3) for k in range(3)]
    return sum(parts)[:size].astype(np.uint8).tobytes()


_SCHEDULES: dict[int, np.ndarray] = {}


def _schedule(min_size: int) -> np.ndarray:
    if min_size not in _SCHEDULES:
        _SCHEDULES[min_size] = code_widths(min_size, MAX_CODES + 2)
    return _SCHEDULES[min_size]


_OFFSETS: dict[int, np.ndarray] = {}


def _offsets(min_size: int) -> np.ndarray:
    if min_size not in _OFFSETS:
        _OFFSETS[min_size] = np.concatenate([[0], np.cumsum(_schedule(min_size))])
    return _OFFSETS[min_size]


def _expanded(codes: np.ndarray, clear: int, most: int) -> bytes:
    """The samples of the codes between two clears, about `most` of them at most, without a loop over them.

    The table entry that code i makes is its own output plus the next sample,
    so it lies in the output at the place of code i: a code above the roots
    copies from there. Lengths, then sources, follow such references to their
    roots by doubling.
    """
    entry = codes - (clear + 2)
    copies = entry >= 0
    if (entry >= np.arange(len(codes)) + (entry < 0)).any() or ((codes >= clear) & ~copies).any():
        raise GifError("a code before its table entry")
    lengths, to = np.ones(len(codes), np.int64), np.where(copies, entry, -1)
    while len(open_ := np.flatnonzero(to >= 0)):
        target = to[open_]
        lengths[open_] += lengths[target]
        to[open_] = to[target]
    needed = int(np.searchsorted(np.cumsum(lengths), most)) + 1  # few codes can stand for gigabytes
    codes, entry, copies, lengths = codes[:needed], entry[:needed], copies[:needed], lengths[:needed]
    starts = np.cumsum(lengths) - lengths
    source = np.arange(int(lengths.sum()))
    shift = np.where(copies, starts - starts[np.maximum(entry, 0)], 0)
    source -= np.repeat(shift, lengths)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    values = np.zeros(len(source), np.uint8)
    values[starts[~copies]] = codes[~copies]
    return values[source].tobytes()


def lzw_decode(data: bytes, min_size: int, expected: int) -> bytes:
    """`expected` samples at most; a stream that ends early yields what it has."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    buffer = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    n_bits = 8 * len(data)
    widths, offsets = _schedule(min_size), _offsets(min_size)
    out: list[bytes] = []
    size, at = 0, 0
    pending: list[np.ndarray] = []  # codes since the last clear
    while size < expected:
        seen = sum(map(len, pending))
        if seen < MAX_CODES:
            w = widths[seen : MAX_CODES + 1]
            starts = at + offsets[seen : seen + len(w)] - offsets[seen]
        else:
            w = np.full(MAX_CODES, 12)
            starts = at + 12 * np.arange(MAX_CODES)
        whole = int(np.searchsorted(starts + w, n_bits, side="right"))
        w, starts = w[:whole], starts[:whole]
        byte = starts >> 3
        codes = (buffer[byte] | buffer[byte + 1] << 8 | buffer[byte + 2] << 16) >> (starts & 7) & ((1 << w) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else whole
        pending.append(codes[:stop])
        if stop == whole and whole:
            at = int(starts[-1] + w[-1])
            continue
        segment = np.concatenate(pending)
        if len(segment):
            out.append(_expanded(segment, clear, expected - size))
            size += len(out[-1])
        if not whole or codes[stop] == end:
            break
        pending = []
        at = int(starts[stop] + w[stop])
    return b"".join(out)[:expected]


@dataclass
class Frame:
    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int = 0
    palette: np.ndarray | None = None
    frames: list[Frame] = field(default_factory=list)

    @property
    def duration_ms(self) -> int:
        return sum(f.delay_ms for f in self.frames)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("a block runs past the end")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        at += n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << ((flags & 7) + 1)
    if at + n > len(data):
        raise GifError("a palette runs past the end")
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def decode(data: bytes) -> Gif:
    """All frames with their samples, colours, timing and disposal."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MAX_PIXELS:
        raise GifError(f"a canvas of {width} x {height}; the limit is {MAX_PIXELS} pixels")
    palette, at = _palette(data, 13, flags)
    gif = Gif(width, height, background, palette)
    delay, disposal, transparent = 0, 0, None
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return gif
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal = 10 * hundredths, packed >> 2 & 7
                transparent = index if packed & 1 else None
        elif kind == 0x2C:
            if at + 10 > len(data):
                raise GifError("an image descriptor runs past the end")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            if w * h > MAX_PIXELS:
                raise GifError(f"a frame of {w} x {h}; the limit is {MAX_PIXELS} pixels")
            own, at = _palette(data, at + 9, flags)
            if at >= len(data) or not 2 <= data[at] <= 8:
                raise GifError("bad code size")
            min_size = data[at]
            stream, at = _blocks(data, at + 1)
            samples = lzw_decode(stream, min_size, w * h)
            if len(samples) < w * h:
                raise GifError(f"{len(samples)} of {w * h} samples")
            pixels = np.frombuffer(samples, np.uint8).reshape(h, w)
            if flags & 0x40:
                stored = np.concatenate([np.arange(a, h, step) for a, step in INTERLACE]) if h else []
                straight = np.empty_like(pixels)
                straight[stored] = pixels
                pixels = straight
            colours = own if own is not None else palette
            if colours is None:
                raise GifError("a frame without colours")
            gif.frames.append(Frame(left, top, pixels, colours, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise GifError(f"unknown block {kind:#x}")
    raise GifError("no trailer")


def composed(gif: Gif) -> Iterator[np.ndarray]:
    """The RGBA canvas as each frame shows it. Disposal 2 clears the frame's area, 3 restores it."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        h, w = (max(0, min(f.samples.shape[0], gif.height - f.top)), max(0, min(f.samples.shape[1], gif.width - f.left)))
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        before = area.copy() if f.disposal == 3 else None
        samples = f.samples[:h, :w]
        known = np.zeros((256, 4), np.uint8)
        known[: len(f.palette), :3], known[:, 3] = f.palette, 255
        shown = np.ones_like(samples, bool) if f.transparent is None else samples != f.transparent
        area[shown] = known[samples[shown]]
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            area[:] = before


def colour_histogram(rgba: np.ndarray) -> np.ndarray:
    """Opaque pixels by the top two bits of red, green and blue: 64 counts."""
    pixels = np.ascontiguousarray(rgba).view("<u4").ravel()
    bins = (pixels >> 2 & 0x30 | pixels >> 12 & 0x0C | pixels >> 22 & 0x03) | np.where(pixels >> 24, 0, 64).astype(np.uint32)
    return np.bincount(bins, minlength=65)[:64]


def spread_palette() -> np.ndarray:
    """256 different colours: 3 bits red, 3 green, 2 blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


PALETTE = spread_palette()


def encode(frames: list[Frame], width: int, height: int, palette: np.ndarray = PALETTE) -> bytes:
    """A GIF89a of frames that share one palette of 256 colours."""
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, f.delay_ms // 10, f.transparent or 0, 0))
        parts.append(struct.pack("<BHHHHBB", 0x2C, f.left, f.top, f.samples.shape[1], f.samples.shape[0], 0, 8))
        stream = lzw_encode(f.samples.tobytes())
        parts += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


#: The sample of padding is transparent; frames take turns to stay, to be cleared and to give back what was there.
CLEAR_SAMPLE = 0
DISPOSALS = (1, 2, 3)


def store_payload(data: bytes, palette: np.ndarray = PALETTE) -> tuple[bytes, int]:
    """Pad with zero bytes to a positive multiple of UNIT, store as timed frames of WIDTH columns."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    rows = np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)
    frames = [
        Frame(0, 0, rows[at : at + ROWS_PER_FRAME], palette, FRAME_DELAY_MS, DISPOSALS[i % len(DISPOSALS)], CLEAR_SAMPLE)
        for i, at in enumerate(range(0, len(rows), ROWS_PER_FRAME))
    ]
    return encode(frames, WIDTH, min(len(rows), ROWS_PER_FRAME), palette), size


def load_payload(media: bytes) -> tuple[bytes, Gif]:
    gif = decode(media)
    return b"".join(f.samples.tobytes() for f in gif.frames), gif


def timed_frames(gif: Gif) -> Iterator[tuple[int, Frame, np.ndarray, np.ndarray]]:
    """(start in ms, frame, composed canvas, its histogram) of each frame, one canvas at a time."""
    start = 0
    for f, canvas in zip(gif.frames, composed(gif), strict=True):
        yield start, f, canvas, colour_histogram(canvas)
        start += f.delay_ms


def feature(gif: Gif, histograms: list[np.ndarray]) -> str:
    """Frames, canvas, duration, and what the canvases show: opaque pixels and their sums by half of red, green and blue."""
    total = np.sum(histograms, axis=0, dtype=np.int64) if histograms else np.zeros(64, np.int64)
    halves = total.reshape(2, 2, 2, 2, 2, 2).sum(axis=(1, 3, 5)).ravel()
    return f"frames={len(gif.frames)};size={gif.width}x{gif.height};ms={gif.duration_ms};shown={total.sum()};rgb={','.join(map(str, halves))}"


_FRAME = pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int32()))])
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("duration_ms", pa.int64()), ("frames", pa.list_(_FRAME))])
MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long, frames array<struct<start_ms: long, delay_ms: int, disposal: int, histogram: array<int>>>"


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as a GIF, read back and described.

    feature and frames come from the stored file alone: its palette, timing,
    disposal and transparency, by way of the composed canvases. A null text is
    empty, and an empty one is 64 zero bytes. A null doc_id stays null;
    repeated rows repeat; an empty table gives no rows. Other columns are not
    looked at.
    """

    def of(doc_id, text):
        data = _utf8(text)
        media, _ = store_payload(data)
        payload, gif = load_payload(media)
        frames = [(start, f.delay_ms, f.disposal, histogram) for start, f, _, histogram in timed_frames(gif)]
        shown = feature(gif, [f[3] for f in frames])
        stored = [{"start_ms": a, "delay_ms": b, "disposal": c, "histogram": h.astype(np.int32)} for a, b, c, h in frames]
        return doc_id, len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha256(media).hexdigest(), shown, len(frames), gif.duration_ms, stored

    return per_row(slim(docs), lambda: of, _MEDIA, MEDIA_SCHEMA)


_STORED = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the GIF bytes of every text, null and empty ones as 64 zero bytes.

    Null doc_ids and repeated rows pass through; an empty table gives no rows.
    """
    return per_row(slim(docs), lambda: lambda doc_id, text: (doc_id, store_payload(_utf8(text))[0]), _STORED, "doc_id long, media binary")


_FRAMES = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64())), ("rgba", pa.binary()), ("error", pa.string())])


def gif_frames(df: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per frame: when it shows, its composed canvas and 64-bin colour histogram.

    Bytes that can't be decoded (null too, or of more than MAX_PIXELS) give one
    row with `error` set; a GIF without frames gives none. Null ids and
    repeated rows pass through; an empty table gives no rows. One canvas is
    held at a time.
    """

    def run(batches):
        for part in (p for batch in batches for p in slices(batch)):
            for key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                try:
                    gif = decode(data or b"")
                except GifError as e:
                    yield batch_of(_FRAMES, [(key, *[None] * 8, str(e))])
                    continue
                for i, (start, f, canvas, histogram) in enumerate(timed_frames(gif)):
                    yield batch_of(_FRAMES, [(key, i, start, f.delay_ms, f.disposal, gif.width, gif.height, histogram, canvas.tobytes(), None)])

    bounded_batches(df.sparkSession)
    schema = "id long, frame int, start_ms long, delay_ms long, disposal int, width int, height int, histogram array<long>, rgba binary, error string"
    return df.select(df[id_column].cast("long"), df[media_column]).mapInArrow(run, schema)
