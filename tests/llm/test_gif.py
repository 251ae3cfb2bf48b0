import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import gif


@given(st.binary(max_size=4000))
@settings(max_examples=60, deadline=None)
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 100_000, b"abab" * 9000, np.random.default_rng(1).bytes(70_000)])
def test_lzw_long(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


@pytest.mark.parametrize("bits", [2, 3, 5, 7])
def test_lzw_small_alphabets(bits):
    data = bytes(np.random.default_rng(bits).integers(0, 1 << bits, 30_000, dtype=np.uint8))
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data


def slow_decode(stream: bytes, min_size: int) -> bytes:
    """The textbook decoder, one bit at a time."""
    bits = [b >> i & 1 for b in stream for i in range(8)]
    clear, end, at, out = 1 << min_size, (1 << min_size) + 1, 0, b""
    table, width, last = {}, min_size + 1, None
    while True:
        code = sum(bits[at + i] << i for i in range(width))
        at += width
        if code == end:
            return out
        if code == clear:
            table, width, last = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            continue
        n = len(table) + 2
        entry = table[code] if code in table else last + last[:1]
        out += entry
        if last is not None and n < 4096:
            table[n] = last + entry[:1]
            n += 1
        width = max(width, min(12, n.bit_length()))
        last = entry


def test_against_textbook_decoder():
    rnd = np.random.default_rng(3)
    for alphabet in (2, 7, 200):
        data = bytes(rnd.integers(0, alphabet, 12_000, dtype=np.uint8))
        stream = gif.lzw_encode(data)
        assert slow_decode(stream, 8) == data == gif.lzw_decode(stream, 8, len(data))


def animation():
    palette = gif.spread_palette()
    full = np.full((4, 4), 10, np.uint8)
    patch = np.array([[20, 99], [99, 20]], np.uint8)
    return gif.encode([
        gif.Frame(0, 0, full, palette, 50, 1),
        gif.Frame(1, 1, patch, palette, 70, 3, 99),
        gif.Frame(2, 2, np.full((2, 2), 30, np.uint8), palette, 80, 2),
        gif.Frame(0, 0, np.full((1, 1), 40, np.uint8), palette, 90, 0),
    ], 4, 4, palette)


def test_disposal_transparency_and_timing():
    made = gif.decode(animation())
    assert [f.delay_ms for f in made.frames] == [50, 70, 80, 90]
    p = gif.spread_palette()
    first, second, third, fourth = gif.composed(made)
    assert (first[..., :3] == p[10]).all()
    assert (second[1, 1, :3] == p[20]).all() and (second[1, 2, :3] == p[10]).all()
    assert (third[1, 1, :3] == p[10]).all() and (third[3, 3, :3] == p[30]).all()  # restored, then covered
    assert fourth[3, 3, 3] == 0 and (fourth[0, 0, :3] == p[40]).all()  # cleared, then drawn


def test_interlace_and_local_palette():
    rows = np.arange(10, dtype=np.uint8)[:, None].repeat(3, 1)
    stored = np.concatenate([np.arange(a, 10, s) for a, s in gif.INTERLACE])
    stream = gif.lzw_encode(rows[stored].tobytes())
    palette = bytes(range(256)) * 3
    data = b"GIF89a\x03\x00\x0a\x00\x00\x00\x00\x2c\0\0\0\0\x03\0\x0a\0\xc7" + palette + b"\x08" + bytes([len(stream)]) + stream + b"\0\x3b"
    assert (gif.decode(data).frames[0].samples == rows).all()


@pytest.mark.parametrize("data", [b"", b"PNG", b"GIF89a", animation()[:-1], animation()[:40], b"GIF89a\x01\0\x01\0\0\0\0\x2c\0\0\0\0\x01\0\x01\0\0\x08\x02\xff\xff\0\x3b"])
def test_broken_bytes_raise(data):
    with pytest.raises(gif.GifError):
        gif.decode(data)


def test_text_media(odd, odd_rows):
    got = gif.text_media(odd).collect()
    want = Counter()
    for i, text, *_ in odd_rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        want[(i, len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by_text = {}
    for r in got:
        assert by_text.setdefault((r.payload_sha256, r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert max(r.n_frames for r in got) > 1


def test_stored_media_are_frames(spark, odd, none):
    stored = gif.store_media(odd)
    frames = gif.gif_frames(stored, "doc_id", "media").where("id = 11").orderBy("frame").collect()
    assert [f.start_ms for f in frames] == [gif.FRAME_DELAY_MS * i for i in range(len(frames))]
    assert all(0 < sum(f.histogram) <= f.width * f.height for f in frames)
    bad = spark.createDataFrame([(1, b"no gif"), (2, None)], "k long, m binary")
    assert [r.error is not None for r in gif.gif_frames(bad, "k", "m").collect()] == [True, True]
    assert gif.text_media(none).count() == 0


def plain_canvases(data, width, rows_per_frame, palette):
    """What a viewer shows of a stored payload, pixel by pixel: sample 0 is clear, frames stay, are cleared or given back in turn."""
    rows = [data[i : i + width] for i in range(0, len(data), width)]
    height = min(len(rows), rows_per_frame)
    canvas, shown = [[None] * width for _ in range(height)], []
    for n, at in enumerate(range(0, len(rows), rows_per_frame)):
        before = [list(r) for r in canvas]
        own = rows[at : at + rows_per_frame]
        for y, row in enumerate(own):
            for x, sample in enumerate(row):
                if sample:
                    canvas[y][x] = tuple(palette[sample].tolist())
        shown.append([list(r) for r in canvas])
        if n % 3 == 1:
            for y in range(len(own)):
                canvas[y] = [None] * width
        elif n % 3 == 2:
            canvas = before
    return shown


def plain_histogram(canvas):
    counts = [0] * 64
    for pixel in (p for row in canvas for p in row if p):
        counts[(pixel[0] // 64) * 16 + (pixel[1] // 64) * 4 + pixel[2] // 64] += 1
    return counts


def test_media_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(gif, "ROWS_PER_FRAME", 5)
    rnd = np.random.default_rng(8)
    for n in (0, 1, 64, 700, 2500):
        data = rnd.integers(0, 256, n, dtype=np.uint8).tobytes()
        media, size = gif.store_payload(data)
        payload, made = gif.load_payload(media)
        assert payload == data.ljust(size, b"\0")
        shown = plain_canvases(payload, 64, 5, gif.PALETTE)
        frames = list(gif.timed_frames(made))
        assert [plain_histogram(c) for c in shown] == [f[3].tolist() for f in frames]
        assert [(f[0], f[1].delay_ms, f[1].disposal) for f in frames] == [(100 * i, 100, (1, 2, 3)[i % 3]) for i in range(len(shown))]
        assert slow_decode(gif.lzw_encode(made.frames[0].samples.tobytes()), 8) == payload[: 64 * min(5, len(payload) // 64)]


def test_query_reads_the_stored_file(spark, odd, odd_rows):
    texts = {i: t for i, t, *_ in odd_rows if i in (1, 5, 10, 12)}
    for r in gif.text_media(odd).where("doc_id in (1, 5, 10, 12)").collect():
        media, _ = gif.store_payload((texts[r.doc_id] or "").encode())
        payload, made = gif.load_payload(media)
        assert (r.media_bytes, r.media_sha256) == (len(media), sha256(media).hexdigest())
        canvases = plain_canvases(payload, 64, gif.ROWS_PER_FRAME, gif.PALETTE)
        histograms = [plain_histogram(c) for c in canvases]
        assert [f.histogram for f in r.frames] == histograms and r.n_frames == len(canvases)
        halves = [0] * 8
        for pixel in (p for c in canvases for row in c for p in row if p):
            halves[pixel[0] // 128 * 4 + pixel[1] // 128 * 2 + pixel[2] // 128] += 1
        want = f"frames={len(canvases)};size={made.width}x{made.height};ms={100 * len(canvases)};shown={sum(halves)};rgb={','.join(map(str, halves))}"
        assert r.feature == want


def test_feature_depends_on_the_palette():
    def shown(palette):
        made = gif.load_payload(gif.store_payload(b"some text of a document", palette)[0])[1]
        return gif.feature(made, [h for *_, h in gif.timed_frames(made)])

    assert shown(gif.PALETTE) != shown(gif.PALETTE[::-1].copy())


def test_sizes_are_limited(spark):
    huge = b"GIF89a\xff\xff\xff\xff\xf0\0\0" + bytes(6) + b"\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02\x4c\x01\0\x3b"
    with pytest.raises(gif.GifError, match="limit"):
        gif.decode(huge)
    with pytest.raises(gif.GifError, match="limit"):
        gif.decode(huge[:6] + b"\1\0\1\0" + huge[10:24] + b"\xff\xff\xff\xff" + huge[28:])
    assert "limit" in gif.gif_frames(spark.createDataFrame([(1, bytearray(huge))], "k long, m binary"), "k", "m").first().error
    # a megabyte of codes that stand for gigabytes: only what the frame holds is made
    assert len(gif.lzw_decode(gif.lzw_encode(bytes(8_000_000)), 8, 1000)) == 1000
