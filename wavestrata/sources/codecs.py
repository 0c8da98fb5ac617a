"""What is known of each codec: how its frames are found, decoded and, where there is an encoder, made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from wavestrata.errors import CodecUnavailable
from wavestrata.sources import formats

PCM_FRAME = 4096


@dataclass(frozen=True)
class Codec:
    """frames: (content, codec, channels, n_samples, payload_from) to rows of (byte_offset, frame_size, sample_pos, n_samples).

    decode: (bytes of whole frames, codec, channels, bits) to (samples, channels); encode: (samples, rate, bits) to a file.
    """

    frames: Callable[[bytes, str, int, int, int], np.ndarray] | None = None
    decode: Callable[[bytes, str, int, int], np.ndarray] | None = None
    encode: Callable[[np.ndarray, int, int], bytes] | None = None


def pcm_bits(codec: str) -> int:
    return int("".join(filter(str.isdigit, codec)))


def _pcm_frames(content: bytes, codec: str, channels: int, n_samples: int, payload_from: int) -> np.ndarray:
    width = pcm_bits(codec) // 8 * channels
    start = np.arange(0, n_samples, PCM_FRAME)
    n = np.minimum(PCM_FRAME, n_samples - start)
    return np.stack([payload_from + start * width, n * width, start, n], 1)


def _aac_frames(content: bytes, *_: object) -> np.ndarray:
    f = formats.adts_frames(content)
    return np.concatenate([f, np.arange(len(f))[:, None] * formats.AAC_SAMPLES, np.full((len(f), 1), formats.AAC_SAMPLES)], 1)


def _opus_frames(content: bytes, *_: object) -> np.ndarray:
    p = formats.ogg_pages(content)
    before = np.concatenate([[0], np.maximum(0, p[:-1, 2])]) if len(p) else np.zeros(0, np.int64)
    return np.stack([p[:, 0], p[:, 1], before, np.maximum(0, p[:, 2] - before)], 1)


CODECS: dict[str, Codec] = {
    "pcm": Codec(_pcm_frames, lambda data, codec, channels, _: formats.pcm_samples(data, codec, channels)),
    "flac": Codec(lambda content, *_: formats.flac_frames(content), lambda data, codec, channels, bits: formats.flac_decode(data, bits), formats.flac_file),
    "aac": Codec(_aac_frames),
    "opus": Codec(_opus_frames),
}


def register(name: str, codec: Codec) -> None:
    """Makes a codec known, or replaces one: a decoder for aac, for example, where the environment has one."""
    CODECS[name] = codec


def _known(codec: str, part: str) -> Callable:
    found = getattr(CODECS.get("pcm" if codec.startswith("pcm_") else codec, Codec()), part)
    if found is None:
        raise CodecUnavailable({"frames": "no frame index for {}", "decode": "no decoder for {} is installed", "encode": "no encoder for {} is installed"}[part].format(codec))
    return found


def frame_table(content: bytes, codec: str, channels: int, n_samples: int, payload_from: int) -> np.ndarray:
    """(byte_offset, frame_size, sample_pos, n_samples) of each frame."""
    return _known(codec, "frames")(content, codec, channels, n_samples, payload_from)


def decoded(data: bytes, codec: str, channels: int, bits: int) -> np.ndarray:
    """(samples, channels) of whole frames as their codec has them: integers of their own width, or floats."""
    return _known(codec, "decode")(data, codec, channels, bits)


def as_int16(x: np.ndarray, bits: int) -> np.ndarray:
    """Samples scaled to 16 bits: integers shifted, floats clipped and cut towards zero."""
    if x.dtype.kind == "f":
        return np.clip(np.trunc(x * 32767), -32768, 32767).astype(np.int64)
    return x >> (bits - 16) if bits >= 16 else x << (16 - bits)


def encoded(samples: np.ndarray, codec: str, rate: int, bits: int) -> bytes:
    return _known(codec, "encode")(samples, rate, bits)


def cut(content: bytes, codec: str, channels: int, bits: int, start: int, end: int, n_samples: int = 0, payload_from: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Samples start to end (inclusive) of a whole file, and the rows of its frame table that were decoded for them."""
    frames = frame_table(content, codec, channels, n_samples, payload_from)
    hit = frames[(frames[:, 2] <= end) & (frames[:, 2] + frames[:, 3] > start)] if start <= end else frames[:0]
    if not len(hit):
        return np.zeros((0, channels), np.int64), hit
    x = decoded(content[int(hit[0, 0]) : int(hit[-1, 0] + hit[-1, 1])], codec, channels, bits)
    first = max(0, start - int(hit[0, 2]))
    return x[first : end - int(hit[0, 2]) + 1], hit
