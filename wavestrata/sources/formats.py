"""Byte formats of audio files: RIFF/WAV, ADTS, FLAC and Ogg, parsed without any native library."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from operator import mul

import numpy as np

from wavestrata.errors import OggFormatError

ADTS_SHORTEST, ADTS_LONGEST, AAC_SAMPLES = 7, 8192, 1024
OGG_MOST_SKIPPED = 1024


@dataclass
class Stream:
    """What a header says about one audio stream; payload is where its coded bytes lie."""

    container: str
    codec: str
    channels: int
    sample_rate: int
    sample_format: str
    n_samples: int | None = None
    bit_rate: int | None = None
    payload: tuple[int, int] = (0, 0)
    tags: dict[str, str] = field(default_factory=dict)


def sniff(data: bytes) -> str | None:
    """wav, flac, ogg, adts or None by the first bytes."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "wav"
    if data[:4] == b"fLaC":
        return "flac"
    if data[:4] == b"OggS":
        return "ogg"
    return "adts" if len(adts_frames(data[: 4 * ADTS_LONGEST])) else None


def parse(data: bytes) -> Stream | None:
    """The audio stream of a file, or None if it holds none that is known here."""
    kind = sniff(data)
    return {"wav": wav_stream, "flac": flac_stream, "ogg": opus_stream, "adts": adts_stream}[kind](data) if kind else None


# WAV


def wav_stream(data: bytes) -> Stream | None:
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
            if form[0] == 0xFFFE and size >= 40:
                form = (struct.unpack_from("<H", data, at + 32)[0], *form[1:])
        elif name == b"data":
            body = (at + 8, min(len(data), at + 8 + size))
            break
        at += 8 + size + size % 2
    if form is None or body is None:
        return None
    kind, channels, rate, _, width, bits = form
    if kind not in (1, 3) or not channels or not width:
        return None
    codec = f"pcm_f{bits}le" if kind == 3 else "pcm_u8" if bits == 8 else f"pcm_s{bits}le"
    n = (body[1] - body[0]) // width
    return Stream("wav", codec, channels, rate, codec[4:], n, rate * width * 8, (body[0], body[0] + n * width))


def pcm_samples(data: bytes, codec: str, channels: int) -> np.ndarray:
    """(samples, channels) of raw bytes: floats as they are, integers as 64-bit integers."""
    if codec == "pcm_s24le":
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int64)
        x = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        x -= (x >> 23) << 24
    else:
        kinds = {"pcm_u8": "u1", "pcm_s16le": "<i2", "pcm_s32le": "<i4", "pcm_f32le": "<f4", "pcm_f64le": "<f8"}
        x = np.frombuffer(data, kinds[codec])
        x = x.astype(np.int64) - (128 if codec == "pcm_u8" else 0) if x.dtype.kind in "iu" else x
    return x.reshape(-1, channels)


def wav_file(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file of (samples, channels) integers."""
    x = np.atleast_2d(samples.T).T.astype("<i2")
    body, channels = x.tobytes(), x.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body))
    return head + body


# ADTS


def adts_frames(data: bytes) -> np.ndarray:
    """(offset, size) of each frame; bytes that start no valid header are passed over."""
    out, at, last = [], 0, len(data) - ADTS_SHORTEST
    while at < last:
        if data[at] == 0xFF and data[at + 1] & 0xF0 == 0xF0:
            size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
            if ADTS_SHORTEST <= size <= ADTS_LONGEST:
                out.append((at, size))
                at += size
                continue
        at += 1
    return np.array(out, np.int64).reshape(-1, 2)


_ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def adts_stream(data: bytes) -> Stream | None:
    frames = adts_frames(data)
    if not len(frames):
        return None
    h = frames[0, 0]
    rate, channels = data[h + 2] >> 2 & 15, (data[h + 2] & 1) << 2 | data[h + 3] >> 6
    if rate >= len(_ADTS_RATES):
        return None
    n = len(frames) * AAC_SAMPLES
    return Stream("adts", "aac", channels or 1, _ADTS_RATES[rate], "fltp", n, int(frames[:, 1].sum() * 8 * _ADTS_RATES[rate] / n), (0, len(data)))


def adts_frame(payload: bytes, rate: int = 48000, channels: int = 1) -> bytes:
    """A frame with this payload, for tests and streams without their own header."""
    size = len(payload) + ADTS_SHORTEST
    r = _ADTS_RATES.index(rate)
    return bytes([0xFF, 0xF1, 1 << 6 | r << 2 | channels >> 2, (channels & 3) << 6 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 0x1F, 0xFC]) + payload


# FLAC


def _crc_table(poly: int, bits: int) -> list[int]:
    out = []
    for v in range(256):
        r = v << (bits - 8)
        for _ in range(8):
            r = (r << 1) ^ (poly if r >> (bits - 1) & 1 else 0)
        out.append(r & ((1 << bits) - 1))
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    r = 0
    for b in data:
        r = _CRC8[r ^ b]
    return r


def crc16(data: bytes) -> int:
    r = 0
    for b in data:
        r = (r << 8 & 0xFFFF) ^ _CRC16[r >> 8 ^ b]
    return r


def flac_metadata(data: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """(type, offset, size) of the metadata blocks, and where the first frame may begin."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, blocks, last = 4, [], False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        blocks.append((kind, at + 4, size))
        at += 4 + size
    return blocks, at


def flac_info(data: bytes) -> dict[str, int]:
    at = next(o for k, o, _ in flac_metadata(data)[0] if k == 0)
    bits = int.from_bytes(data[at + 10 : at + 18], "big")
    return {"least_block": int.from_bytes(data[at : at + 2], "big"), "most_block": int.from_bytes(data[at + 2 : at + 4], "big"), "sample_rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "bits": (bits >> 36 & 31) + 1, "n_samples": bits & (1 << 36) - 1}


def flac_stream(data: bytes) -> Stream:
    i = flac_info(data)
    seconds = i["n_samples"] / i["sample_rate"] if i["sample_rate"] else 0
    return Stream("flac", "flac", i["channels"], i["sample_rate"], f"s{i['bits']}", i["n_samples"], int(len(data) * 8 / seconds) if seconds else None, (0, len(data)))


@dataclass
class FlacHeader:
    variable: bool
    number: int
    block: int
    channels: int
    mode: int
    bits: int
    size: int


# Fixed values of the format: block sizes and bits per sample by their code.
_FLAC_BLOCKS = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_FLAC_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def flac_header(data: bytes, at: int, bits: int = 16) -> FlacHeader | None:
    """The frame header at this place if its sync code, fields and checksum are right."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    block_code, rate_code, mode, size_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if block_code == 0 or rate_code == 15 or mode > 10 or size_code == 3 or data[at + 3] & 1:
        return None
    p, lead = at + 4, data[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and (not 1 <= more <= 6) or p + more >= len(data):
        return None
    number = lead if lead < 0x80 else lead & (1 << (6 - more)) - 1
    for k in range(more):
        if data[p + 1 + k] & 0xC0 != 0x80:
            return None
        number = number << 6 | data[p + 1 + k] & 0x3F
    p += 1 + more
    extra = {6: 1, 7: 2}.get(block_code, 0)
    block = _FLAC_BLOCKS[block_code] if not extra else int.from_bytes(data[p : p + extra], "big") + 1
    p += extra + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    return FlacHeader(bool(data[at + 1] & 1), number, block, mode + 1 if mode < 8 else 2, mode, _FLAC_BITS.get(size_code, bits), p + 1 - at)


def flac_frames(data: bytes) -> np.ndarray:
    """(offset, size, samples before, samples) of each frame, to the end of the data.

    A candidate must have a valid header and go on where the frame before ends, so sync codes within a frame don't count.
    """
    info, at = flac_info(data), flac_metadata(data)[1]
    raw = np.frombuffer(data, np.uint8)
    maybe = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] & 0xFE == 0xF8))
    out: list[list[int]] = []
    position = 0
    for p in maybe[maybe >= at].tolist():
        h = flac_header(data, p, info["bits"])
        if h is None or h.channels != info["channels"]:
            continue
        start = h.number if h.variable else h.number * (info["most_block"] or h.block)
        if start != position:
            continue
        if out:
            out[-1][1] = p - out[-1][0]
        out.append([p, 0, position, h.block])
        position += h.block
    if out:
        out[-1][1] = len(data) - out[-1][0]
    return np.array(out, np.int64).reshape(-1, 4)


class _Bits:
    """Bits of some bytes; numbers are cut out of the bytes, unary codes jump from one set bit to the next."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        place = np.where(self.bits, np.arange(len(self.bits), dtype=np.int64), len(self.bits))
        self.next_one = np.minimum.accumulate(place[::-1])[::-1].tolist()

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise IndexError("the data end within a frame")
        self.at += n
        return int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at) & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        one = self.next_one[self.at]
        n, self.at = one - self.at, one + 1
        return n

    def rice(self, count: int, low: int) -> np.ndarray:
        """count folded numbers, each a unary part and low bits."""
        first, following, stops = self.at, self.next_one, [0] * count
        at = first
        for k in range(count):
            stops[k] = stop = following[at]
            at = stop + 1 + low
        if at > len(self.bits):
            raise IndexError("the data end within a frame")
        self.at = at
        stop = np.array(stops, np.int64)
        v = np.diff(stop, prepend=first - 1 - low) - 1 - low
        for k in range(low):
            v = v << 1 | self.bits[stop + 1 + k]
        return v >> 1 ^ -(v & 1)


def _residual(bits: _Bits, n: int, order: int) -> np.ndarray:
    width = 4 + bits.take(2)
    parts = bits.take(4)
    out = []
    for k in range(1 << parts):
        count = (n >> parts) - (order if k == 0 else 0)
        low = bits.take(width)
        if low == (1 << width) - 1:
            size = bits.take(5)
            out.append(np.array([bits.signed(size) for _ in range(count)], np.int64))
        else:
            out.append(bits.rice(count, low))
    return np.concatenate(out)


def _summed(first: list[int], residual: np.ndarray) -> np.ndarray:
    """The samples whose differences of order len(first) are the residual."""
    x, warm = residual, np.array(first, np.int64)
    for order in reversed(range(len(first))):
        x = np.diff(warm, order)[-1] + np.cumsum(x)
    return np.concatenate([warm, x])


def _predicted(first: list[int], residual: np.ndarray, weights: list[int], shift: int) -> np.ndarray:
    """The samples that a linear prediction of the ones before, in integers, makes of the residual."""
    out, last = list(first), len(weights)
    weights = weights[::-1]
    for k, e in enumerate(residual.tolist()):
        out.append(e + (sum(map(mul, weights, out[k : k + last])) >> shift))
    return np.array(out, np.int64)


def _subframe(bits: _Bits, n: int, width: int) -> np.ndarray:
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        out = np.full(n, bits.signed(width), np.int64)
    elif kind == 1:
        out = np.array([bits.signed(width) for _ in range(n)], np.int64)
    elif 8 <= kind <= 12:
        first = [bits.signed(width) for _ in range(kind - 8)]
        out = _summed(first, _residual(bits, n, kind - 8))
    elif kind >= 32:
        order = kind - 31
        first = [bits.signed(width) for _ in range(order)]
        precision, shift = bits.take(4) + 1, bits.signed(5)
        weights = [bits.signed(precision) for _ in range(order)]
        out = _predicted(first, _residual(bits, n, order), weights, shift)
    else:
        raise ValueError(f"reserved FLAC subframe type {kind}")
    return out << wasted


def flac_decode(frames: bytes, bits: int) -> np.ndarray:
    """(samples, channels) of consecutive whole frames."""
    out, at = [], 0
    while at < len(frames):
        h = flac_header(frames, at, bits)
        if h is None:
            raise ValueError(f"no FLAC frame at byte {at}")
        size = 64 + h.block * h.channels * (h.bits + 2) // 8
        while True:
            reader = _Bits(frames[at + h.size : at + h.size + size])
            try:
                x = [_subframe(reader, h.block, h.bits + (1 if (h.mode, k) in ((8, 1), (9, 0), (10, 1)) else 0)) for k in range(h.channels)]
                break
            except IndexError:
                if at + h.size + size >= len(frames):
                    raise ValueError(f"damaged FLAC frame at byte {at}") from None
                size *= 2
        if h.mode == 8:
            x[1] = x[0] - x[1]
        elif h.mode == 9:
            x[0] = x[0] + x[1]
        elif h.mode == 10:
            mid = x[0] << 1 | x[1] & 1
            x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
        out.append(np.stack(x, 1))
        end = at + h.size + -(-reader.at // 8)
        if crc16(frames[at:end]) != int.from_bytes(frames[end : end + 2], "big"):
            raise ValueError(f"damaged FLAC frame at byte {at}")
        at = end + 2
    return np.concatenate(out) if out else np.zeros((0, 1), np.int64)


def _coded_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (5 * k + 6))
    return bytes([(0xFF00 >> (more + 1)) & 0xFF | n >> 6 * more, *(0x80 | n >> 6 * k & 0x3F for k in reversed(range(more)))])


def _coded_channel(x: np.ndarray, width: int, order: int = 2) -> np.ndarray:
    """Bits of a subframe with a fixed predictor and one Rice partition; constant if all samples are equal."""
    def number(v: int, n: int) -> np.ndarray:
        return np.array([v >> k & 1 for k in reversed(range(n))], np.uint8)

    if len(x) and (x == x[0]).all():
        return np.concatenate([number(0, 8), number(int(x[0]) & (1 << width) - 1, width)])
    order = min(order, len(x) - 1)
    e = x
    for _ in range(order):
        e = np.diff(e)
    folded = (e << 1) ^ (e >> 63)
    rice = int(min(14, max(0, np.log2(folded.mean() + 1))))
    high = folded >> rice
    size = high + 1 + rice
    ends = np.cumsum(size)
    body = np.zeros(int(ends[-1]), np.uint8)
    stop = ends - rice - 1
    body[stop] = 1
    for k in range(rice):
        body[stop + 1 + k] = folded >> (rice - 1 - k) & 1
    warm = [number(int(v) & (1 << width) - 1, width) for v in x[:order]]
    return np.concatenate([number((8 + order) << 1, 8), *warm, number(0, 2), number(0, 4), number(rice, 4), body])


def flac_file(samples: np.ndarray, rate: int, bits: int = 16, block: int = 4096) -> bytes:
    """A FLAC stream of (samples, channels) integers, independent channels, fixed prediction."""
    x = np.atleast_2d(samples.T).T.astype(np.int64)
    n, channels = x.shape
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n
    info = struct.pack(">HH", block, block) + bytes(6) + packed.to_bytes(8, "big") + bytes(16)
    out = [b"fLaC", bytes([0x80, 0, 0, len(info)]), info]
    size_code = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bits]
    for k in range(0, n, block):
        part = x[k : k + block]
        head = bytes([0xFF, 0xF8, 0x70, (channels - 1) << 4 | size_code << 1]) + _coded_number(k // block) + struct.pack(">H", len(part) - 1)
        head += bytes([crc8(head)])
        body = np.packbits(np.concatenate([_coded_channel(part[:, c], bits) for c in range(channels)])).tobytes()
        frame = head + body
        out += [frame, crc16(frame).to_bytes(2, "big")]
    return b"".join(out)


# Ogg


def ogg_pages(data: bytes) -> np.ndarray:
    """(offset, size, granule, serial, number, segments) of each page; over 1024 bytes between pages are an error."""
    out, at = [], 0
    while at + 27 <= len(data):
        if data[at : at + 4] != b"OggS":
            found = data.find(b"OggS", at, at + OGG_MOST_SKIPPED + 4)
            if found < 0:
                if len(data) - at > OGG_MOST_SKIPPED:
                    raise OggFormatError(f"no page within {OGG_MOST_SKIPPED} bytes from byte {at}")
                break
            at = found
            continue
        granule, serial, number = struct.unpack_from("<qII", data, at + 6)
        segments = data[at + 26]
        size = 27 + segments + sum(data[at + 27 : at + 27 + segments])
        out.append((at, size, granule, serial, number, segments))
        at += size
    return np.array(out, np.int64).reshape(-1, 6)


def ogg_packets(data: bytes) -> dict[int, list[bytes]]:
    """The packets of each serial; segments of 255 bytes go on in the next one, over pages too."""
    done: dict[int, list[bytes]] = {}
    rest: dict[int, bytes] = {}
    for at, _, _, serial, _, segments in ogg_pages(data).tolist():
        p = at + 27 + segments
        for s in data[at + 27 : at + 27 + segments]:
            rest[serial] = rest.get(serial, b"") + data[p : p + s]
            p += s
            if s < 255:
                done.setdefault(serial, []).append(rest.pop(serial))
    return done


def opus_stream(data: bytes) -> Stream | None:
    packets = next((p for p in ogg_packets(data).values() if p and p[0][:8] == b"OpusHead"), None)
    if packets is None:
        return None
    channels, skip, rate = struct.unpack_from("<BHI", packets[0], 9)  # after the version byte
    pages = ogg_pages(data)
    tags: dict[str, str] = {}
    if len(packets) > 1 and packets[1][:8] == b"OpusTags":
        at = 12 + struct.unpack_from("<I", packets[1], 8)[0]
        for _ in range(struct.unpack_from("<I", packets[1], at)[0]):
            size = struct.unpack_from("<I", packets[1], at + 4)[0]
            key, _, value = packets[1][at + 8 : at + 8 + size].decode("utf-8", "replace").partition("=")
            tags[key] = value
            at += 4 + size
    return Stream("ogg", "opus", channels, rate or 48_000, "fltp", max(0, int(pages[:, 2].max()) - skip), None, (0, len(data)), tags)
