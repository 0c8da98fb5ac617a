"""Sample arithmetic on columns, and transforms of whole signals by NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def mixed(left: Column, right: Column, share: float = 0.7) -> Column:
    return left.cast("double") * share + right.cast("double") * (1 - share)


def delayed(value: Column, steps: int, over: WindowSpec) -> Column:
    """value steps samples later (earlier if negative), filled with zeros."""
    return F.lag(value, steps, 0.0).over(over) if steps >= 0 else F.lead(value, -steps, 0.0).over(over)


def level_difference_db(left: Column, right: Column) -> Column:
    return 20 * F.log10((F.abs(left.cast("double")) + 1e-6) / (F.abs(right.cast("double")) + 1e-6))


def to_int16(x: Column) -> Column:
    """Sample in [-1, 1] as a 16-bit integer, clipped, then cut towards zero."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), x.cast("double") * 32767)).cast("smallint"))


def to_float32(x: Column) -> Column:
    return (x / F.lit(32767.0)).cast("float")


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def match(a: Column, b: Column) -> dict[str, Column]:
    """Aggregates of two signals: share of equal samples, number of others, largest and mean difference."""
    apart = F.abs(a - b)
    return {"match_rate": F.avg((a == b).cast("double")), "n_different": F.count_if(a != b), "max_diff": F.max(apart), "mean_diff": F.avg(apart)}


def stft(samples: np.ndarray, size: int = 1024, hop: int = 512) -> np.ndarray:
    """Complex spectra (bins, frames) of Hann-windowed frames; the signal is centred by reflection."""
    padded = np.pad(samples.astype(np.float64), size // 2, mode="reflect" if len(samples) > size // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=1).T


def istft(spectra: np.ndarray, n: int, size: int = 1024, hop: int = 512) -> np.ndarray:
    """The n samples whose spectra these are, by weighted overlap and add."""
    window = np.hanning(size + 1)[:-1]
    frames = np.fft.irfft(spectra.T, size, axis=1) * window
    out, weight = np.zeros(hop * (len(frames) - 1) + size), np.zeros(hop * (len(frames) - 1) + size)
    for k, f in enumerate(frames):
        out[k * hop : k * hop + size] += f
        weight[k * hop : k * hop + size] += window**2
    return (out / np.maximum(weight, 1e-12))[size // 2 : size // 2 + n]


def stereo_features(left: np.ndarray, right: np.ndarray, size: int = 1024, hop: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Level difference in dB and unwrapped phase difference of two channels, per bin and frame."""
    a, b = stft(left, size, hop), stft(right, size, hop)
    return 20 * np.log10((np.abs(a) + 1e-6) / (np.abs(b) + 1e-6)), np.unwrap(np.angle(a)) - np.unwrap(np.angle(b))


def mel_filters(rate: int, size: int, n: int) -> np.ndarray:
    """Triangular filters with equal steps on the mel scale, (n, size // 2 + 1)."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), n + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    at = np.linspace(0, rate / 2, size // 2 + 1)
    up, down = (at - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - at) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_features(segments: DataFrame, rate: int, bands: int = 16, size: int = 1024, hop: int = 512) -> DataFrame:
    """(request_id, frame, mel) for segments with a column samples: log mel energies of each frame."""
    filters = mel_filters(rate, size, bands)

    def compute(batches):
        for pdf in batches:
            rows = []
            for i, x in zip(pdf.request_id, pdf.samples, strict=True):
                energy = np.log1p(filters @ np.abs(stft(np.asarray(x, float), size, hop)) ** 2).T
                rows += [(i, k, v.tolist()) for k, v in enumerate(energy)]
            yield pd.DataFrame(rows, columns=["request_id", "frame", "mel"])

    return segments.select("request_id", "samples").mapInPandas(compute, "request_id long, frame int, mel array<double>")


def clustered(features: DataFrame, column: str, k: int = 2, seed: int = 0) -> DataFrame:
    """features with the column cluster by k-means on an array column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    table = features.withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(table)
    return model.transform(table).drop("__v")


def separated(left: np.ndarray, right: np.ndarray, labels: np.ndarray, cluster: int, size: int = 1024, hop: int = 512) -> np.ndarray:
    """The left channel's part whose frames belong to the cluster, by a binary mask on its spectra."""
    spectra = stft(left, size, hop)
    return istft(spectra * (labels[: spectra.shape[1]] == cluster), len(left), size, hop)


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """(samples, channels) at another rate, band-limited, by cutting or padding the spectrum."""
    n = round(len(samples) * to / rate)
    if not len(samples) or not n:
        return np.zeros((n, *samples.shape[1:]))
    spectrum = np.fft.rfft(samples, axis=0)
    out = np.zeros((n // 2 + 1, *samples.shape[1:]), complex)
    k = min(len(spectrum), len(out))
    out[:k] = spectrum[:k]
    return np.fft.irfft(out, n, axis=0) * n / len(samples)
