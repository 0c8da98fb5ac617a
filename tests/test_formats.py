"""Byte parsers and the frame index of generated streams."""

import struct

import numpy as np
import pytest

from wavestrata.errors import OggFormatError
from wavestrata.sources import formats


@pytest.fixture(scope="module")
def noise():
    return np.cumsum(np.random.default_rng(5).integers(-300, 300, (10_000, 2)), 0) % 30_000 - 15_000


def test_wav(noise):
    for channels in (1, 2, 8, 12):
        x = np.tile(noise[:, :1], (1, channels))
        s = formats.parse(data := formats.wav_file(x, 96_001))
        assert (s.codec, s.channels, s.sample_rate, s.n_samples) == ("pcm_s16le", channels, 96_001, len(x))
        assert (formats.pcm_samples(data[slice(*s.payload)], s.codec, channels) == x).all()
    assert formats.pcm_samples(b"\xff\xff\xff\x00\x00\x80\xff\xff\x7f", "pcm_s24le", 1).ravel().tolist() == [-1, -(2**23), 2**23 - 1]
    assert formats.parse(b"RIFF\0\0\0\0WAVEjunk") is None and formats.parse(b"plain text") is None and formats.parse(b"") is None


def test_adts():
    frames = [formats.adts_frame(bytes(n)) for n in (0, 1, 365, 8184)]
    assert formats.adts_frames(b"junk" + b"".join(frames) + b"end").tolist() == [[4, 7], [11, 8], [19, 372], [391, 8191]]
    short = bytearray(formats.adts_frame(bytes(20)))
    short[3], short[4], short[5] = short[3] & 0xFC, 0, short[5] & 0x1F | 6 << 5
    assert len(formats.adts_frames(bytes(short))) == 0
    s = formats.parse(b"".join(formats.adts_frame(bytes(300), 44_100, 2) for _ in range(10)))
    assert (s.codec, s.sample_rate, s.channels, s.n_samples) == ("aac", 44_100, 2, 10_240)


@pytest.mark.parametrize("channels", [1, 2, 3])
def test_flac_round_trip(noise, channels):
    x = np.tile(noise[:, :1], (1, channels)) + np.arange(channels)
    data = formats.flac_file(x, 48_000)
    frames = formats.flac_frames(data)
    assert frames[:, 2].tolist() == [0, 4096, 8192] and frames[:, 3].tolist() == [4096, 4096, 1808] and frames[-1, :2].sum() == len(data)
    assert (formats.flac_decode(data[frames[0, 0] :], 16) == x).all()
    a, n, start, count = frames[1]
    assert (formats.flac_decode(data[a : a + n], 16) == x[start : start + count]).all()
    with pytest.raises(ValueError, match="damaged"):
        formats.flac_decode(data[frames[0, 0] : len(data) - 1] + bytes([data[-1] ^ 1]), 16)


def test_flac_metadata_sizes_have_24_bits_and_false_syncs_do_not_count(noise):
    plain = formats.flac_file(noise[:, :1], 48_000)
    size = 9 << 20
    padding = b"\xff\xf8" * (size // 2)
    data = plain[:4] + bytes([0]) + plain[5:42] + bytes([0x81]) + size.to_bytes(3, "big") + padding + plain[42:]
    assert [b[2] for b in formats.flac_metadata(data)[0]] == [34, size]
    moved, own = formats.flac_frames(data), formats.flac_frames(plain)
    assert (moved[:, 1:] == own[:, 1:]).all() and (moved[:, 0] - own[:, 0] == size + 4).all()


def page(serial, number, granule, segments):
    lacing = bytes(len(s) for s in segments)
    return b"OggS" + struct.pack("<BBqIII", 0, 0, granule, serial, number, 0) + bytes([len(lacing)]) + lacing + b"".join(segments)


def test_ogg():
    head = b"OpusHead" + struct.pack("<BBHIHB", 1, 2, 312, 44_100, 0, 0)
    tags = b"OpusTags" + struct.pack("<I", 2) + b"me" + struct.pack("<II", 1, 9) + b"SITE=nord"
    data = page(7, 0, 0, [head]) + page(7, 1, 0, [tags]) + b"x" * 100 + page(9, 0, 5, [b"other"]) + page(7, 2, 960, [b"a" * 255, b"b" * 255]) + page(7, 3, 1920, [b"c" * 10, b"dd"])
    assert formats.ogg_pages(data)[:, 2:5].tolist() == [[0, 7, 0], [0, 7, 1], [5, 9, 0], [960, 7, 2], [1920, 7, 3]]
    assert [len(p) for p in formats.ogg_packets(data)[7]] == [len(head), len(tags), 520, 2]
    s = formats.parse(data)
    assert (s.codec, s.channels, s.sample_rate, s.n_samples, s.tags) == ("opus", 1 + 1, 44_100, 1608, {"SITE": "nord"})
    with pytest.raises(OggFormatError):
        formats.ogg_pages(data + b"z" * 2000)


def test_flac_linear_prediction_and_speed():
    """A frame whose subframe is predicted by weights, decoded sample by sample; a second of another one takes a fraction of it."""
    import time

    rng = np.random.default_rng(3)
    x = np.cumsum(np.cumsum(rng.integers(-9, 10, 192))).clip(-30000, 30000)
    weights, shift = [7, -3], 2  # sum of weights * samples before, newest first, shifted
    e = [int(x[k]) - (int(weights[0] * x[k - 1] + weights[1] * x[k - 2]) >> shift) for k in range(2, 192)]
    put = lambda v, n: format(v & (1 << n) - 1, f"0{n}b")
    fold = [(v << 1) ^ (v >> 63) for v in e]
    low = 8
    bits = put(33 << 1, 8) + put(int(x[0]), 16) + put(int(x[1]), 16) + put(4, 4) + put(shift, 5) + "".join(put(w, 5) for w in weights) + put(0, 2) + put(0, 4) + put(low, 4)
    bits += "".join("0" * (v >> low) + "1" + put(v, low) for v in fold)
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x10, 0x08, 0])
    head += bytes([formats.crc8(head)])
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += formats.crc16(frame).to_bytes(2, "big")
    assert formats.flac_decode(frame * 2, 16)[:, 0].tolist() == x.tolist() * 2
    with pytest.raises(ValueError, match="damaged"):
        formats.flac_decode(frame[:-9], 16)
    walk = (np.cumsum(rng.integers(-200, 200, (96_000, 1)), 0) % 40_000 - 20_000).astype(np.int64)
    data = formats.flac_file(walk, 48_000)
    began = time.time()
    assert (formats.flac_decode(data[formats.flac_frames(data)[0, 0] :], 16) == walk).all()
    assert time.time() - began < 2  # two seconds of sound
