"""WAV facts, mono mixes and spectra."""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

#: Weights of a mono mix by number of channels; low-frequency effects are left out.
MIX = {1: [1.0], 2: [1.0, 1.0], 6: [1.0, 1.0, 0.707, 0.0, 0.707, 0.707], 8: [1.0, 1.0, 0.707, 0.0, 0.707, 0.707, 0.707, 0.707]}


class Wav(NamedTuple):
    rate: int
    channels: int
    bits: int
    form: str  # Int or Float
    samples: np.ndarray  # interleaved, -1..1
    dropped: int  # samples that are cut off

    @property
    def seconds(self) -> float:
        return len(self.samples) / self.channels / self.rate if self.rate and self.channels else 0.0


def read_wav(raw: bytes) -> Wav:
    """Samples as numbers between -1 and 1; bytes that are no WAV raise ValueError."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, head, data, stated = 12, None, None, 0
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(raw):
            head = struct.unpack_from("<HHIIHH", raw, at + 8)
            if head[0] == 0xFFFE and size >= 40 and at + 34 <= len(raw):  # the true format stands in the extension
                head = (struct.unpack_from("<H", raw, at + 32)[0], *head[1:])
        elif name == b"data":
            data, stated = raw[at + 8 : at + 8 + size], size
            break
        at += 8 + size + size % 2
    if head is None or data is None or head[0] not in (1, 3) or not head[1]:
        raise ValueError("no samples")
    kind, channels, rate, _, _, bits = head
    width = bits // 8
    if width not in ((4,) if kind == 3 else (1, 2, 3, 4)):
        raise ValueError(f"{bits} bits are not supported")
    whole = len(data) // width * width
    b = np.frombuffer(data[:whole], dtype=np.uint8)
    if kind == 3:
        x = b.view("<f4").astype(np.float64)
    elif width == 1:
        x = (b.astype(np.float64) - 128) / 127
    elif width == 3:
        wide = np.zeros((len(b) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = b.reshape(-1, 3)
        x = (wide.view("<i4").ravel() >> 8) / float((1 << 23) - 1)
    else:
        x = b.view(f"<i{width}") / float((1 << (bits - 1)) - 1)
    return Wav(rate, channels, bits, "Float" if kind == 3 else "Int", x, max(0, stated // width - len(x)))


def mono(samples: np.ndarray, channels: int) -> np.ndarray:
    """The mean of up to two channels, a weighted sum of more."""
    if channels < 1:
        return np.zeros(0)
    frames = samples[: len(samples) // channels * channels].reshape(-1, channels)
    return frames.mean(axis=1) if channels <= 2 else frames @ np.array(MIX.get(channels, [1.0 / channels] * channels))


def spectrum(samples: np.ndarray, rate: int, size: int = 1024, overlap: float = 0.5, low_hz: float = 20.0, low_share: float = 0.01, high_hz: float = 2000.0, high_share: float = 0.05, peak_share: float = 0.02, hops: int = 3, digest: str = "") -> dict | None:
    """Energies of overlapping Hann windows, and what stands out below hearing or near the upper end; None if too short or silent."""
    if len(samples) < size or size < 4:
        return None
    hop = max(1, int(size * (1 - overlap)))
    starts = np.arange(0, len(samples) - size + 1, hop)
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))
    width, nyquist = rate / size, rate / 2
    first_high, low_bins = int(np.ceil(max(0.0, nyquist - high_hz) / width)), int(np.ceil(low_hz / width))
    total = low_sum = high_sum = peak_sum = top = dominant = 0.0
    windows, any_low, any_high, bins = 0, False, False, set()
    for i in range(0, len(starts), 256):
        part = np.lib.stride_tricks.sliding_window_view(samples, size)[starts[i : i + 256]] * hann
        energy = np.abs(np.fft.rfft(part, axis=1)) ** 2
        sums = energy.sum(axis=1)
        energy, sums = energy[sums > 0], sums[sums > 0]
        if not len(sums):
            continue
        windows += len(sums)
        total += sums.sum()
        best = energy.max(axis=1)
        if best.max() > top:
            row = int(best.argmax())
            top, dominant = float(best[row]), float(energy[row].argmax() * width)
        low, high = energy[:, :low_bins].sum(axis=1), energy[:, first_high:].sum(axis=1)
        low_sum, high_sum = low_sum + low.sum(), high_sum + high.sum()
        any_low, any_high = any_low or bool((low / sums > low_share).any()), any_high or bool((high / sums > high_share).any())
        if energy.shape[1] > first_high:
            peak = energy[:, first_high:].max(axis=1)
            clear = peak / sums > peak_share
            peak_sum += peak[clear].sum()
            bins |= set((energy[clear, first_high:].argmax(axis=1) + first_high).tolist())
    if not windows:
        return None
    band = lambda label, a, b, e: {"label": label, "low_hz": a, "high_hz": b, "energy": float(e), "fraction_of_total": float(e / total)}
    start = max(0.0, nyquist - high_hz)
    subliminal = [band("sub_audible", 0.0, low_hz, low_sum)] if any_low else []
    hidden = [band("high_frequency_anomaly", start, nyquist, high_sum)] if any_high else []
    if bins:
        hidden.append(band("frequency_hopping" if len(bins) >= hops else "narrowband_high_freq_peak", start, nyquist, peak_sum))
    return {
        "artifact_digest": digest, "sample_rate": rate, "channels": 1, "total_samples": len(samples), "windows_analyzed": windows, "total_energy": float(total), "anomalous_bands": subliminal + hidden,
        "subliminal_findings": subliminal, "steganography_findings": hidden, "dominant_freq_hz": dominant,
    }
