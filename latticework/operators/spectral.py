"""Fourier-domain operators on rows and slices: Arrow batches of arrays through NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLEX = "array<struct<re: double, im: double>>"


def _pairs(z: np.ndarray) -> list[dict]:
    return [{"re": float(c.real), "im": float(c.imag)} for c in z]


def _values(row) -> np.ndarray:
    return np.asarray(row, float)


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def fft(pad: bool = False) -> Callable[[Column | str], Column]:
    """The spectrum of an array of numbers; with pad, filled with zeros to the next power of two."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda r: None if r is None else _pairs(np.fft.fft(_values(r), power_of_two(len(r)) if pad else None)))

    return F.pandas_udf(run, COMPLEX)


def inverse_fft() -> Callable[[Column | str], Column]:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda r: None if r is None else _pairs(np.fft.ifft(np.array([c["re"] + 1j * c["im"] for c in r]))))

    return F.pandas_udf(run, COMPLEX)


def row_filter(response: Callable[[np.ndarray], np.ndarray], pad: int = 2) -> Callable[[Column | str], Column]:
    """Rows times a response in the frequency domain. The response gets frequencies in units of the Nyquist frequency; rows
    are padded with zeros to a power of two of at least pad times their length, and cut again."""

    def run(s: pd.Series) -> pd.Series:
        def one(r):
            if r is None:
                return None
            x = _values(r)
            n = power_of_two(pad * len(x))
            return np.real(np.fft.ifft(np.fft.fft(x, n) * response(np.fft.fftfreq(n) * 2)))[: len(x)].tolist()

        return s.map(one)

    return F.pandas_udf(run, "array<double>")


def ramp_filter(kind: str = "ram_lak", cut: float = 1.0) -> Callable[[Column | str], Column]:
    shapes = {
        "ram_lak": lambda a: np.ones_like(a),
        "shepp_logan": lambda a: np.sinc(a / 2),
        "hamming": lambda a: 0.54 + 0.46 * np.cos(np.pi * a / cut),
        "hann": lambda a: 0.5 + 0.5 * np.cos(np.pi * a / cut),
        "cosine": lambda a: np.cos(np.pi * a / 2 / cut),
    }
    shape = shapes[kind]
    return row_filter(lambda f: np.where(np.abs(f) > cut, 0.0, np.abs(f) * shape(np.abs(f))) / 2)


def low_pass(cut: float) -> Callable[[Column | str], Column]:
    return row_filter(lambda f: (np.abs(f) <= cut).astype(float), 1)


def hilbert(pad: int = 2) -> Callable[[Column | str], Column]:
    """Rows with the sign of the frequency, times -i."""
    return row_filter(lambda f: -1j * np.sign(f), pad)


def fourier_volume_filter(kind: str, shape: tuple[int, int], sigma: float = 0.25, direction: tuple[float, float] = (1.0, 0.0), power: int = 2) -> np.ndarray:
    """Weights over the frequencies of a slice: gaussian and exponential low-pass, their complements, or a directional
    squared cosine."""
    fy, fx = np.meshgrid(np.fft.fftfreq(shape[0]) * 2, np.fft.fftfreq(shape[1]) * 2, indexing="ij")
    r = np.hypot(fy, fx)
    if kind == "gaussian":
        return np.exp(-(r**2) / (2 * sigma**2))
    if kind == "exponential":
        return np.exp(-r / sigma)
    if kind == "low_pass":
        return (r <= sigma).astype(float)
    if kind == "high_pass":
        return (r > sigma).astype(float)
    if kind == "directional":
        n = np.hypot(*direction)
        with np.errstate(invalid="ignore", divide="ignore"):
            c = (fy * direction[0] + fx * direction[1]) / (n * r)
        return np.where(r > 0, c ** (2 * power), 1.0)
    raise ValueError(f"no filter {kind!r}")


def slice_filter(kind: str, **options) -> Callable[[Column, Column, Column], Column]:
    """(px, h, w) -> px: a slice multiplied by weights in the frequency domain."""

    def run(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        def one(p, height, width):
            a = _values(p).reshape(height, width)
            return np.real(np.fft.ifft2(np.fft.fft2(a) * fourier_volume_filter(kind, a.shape, **options))).ravel().tolist()

        return pd.Series([one(*t) for t in zip(px, h, w, strict=True)])

    return F.pandas_udf(run, "array<double>")


def power_spectrum(log: bool = True) -> Callable[[Column, Column, Column], Column]:
    """(px, h, w) -> the magnitude of the slice's spectrum, zero frequency in the middle; log(1 + m) by default."""

    def run(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        def one(p, height, width):
            m = np.abs(np.fft.fftshift(np.fft.fft2(_values(p).reshape(height, width))))
            return (np.log1p(m) if log else m).ravel().tolist()

        return pd.Series([one(*t) for t in zip(px, h, w, strict=True)])

    return F.pandas_udf(run, "array<double>")


def blur(sigma: float) -> Callable[[Column, Column, Column], Column]:
    """(px, h, w) -> px: a separable Gaussian blur, borders replicated."""

    def run(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        half = max(1, int(np.ceil(3 * sigma)))
        k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
        k /= k.sum()

        def one(p, height, width):
            a = np.pad(_values(p).reshape(height, width), half, mode="edge")
            a = sum(c * a[i : i + height] for i, c in enumerate(k))
            a = sum(c * a[:, i : i + width] for i, c in enumerate(k))
            return a.ravel().tolist()

        return pd.Series([one(*t) for t in zip(px, h, w, strict=True)])

    return F.pandas_udf(run, "array<double>")


def vesselness(sigma: float = 1.0, beta: float = 0.5, c: float = 0.1) -> Callable[[Column, Column, Column], Column]:
    """(px, h, w) -> px: for bright lines, from the eigenvalues of the Hessian of the blurred slice (Frangi)."""
    smooth = blur(sigma).func

    def run(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        def one(p, height, width):
            a = np.asarray(p, float).reshape(height, width)
            gy, gx = np.gradient(a)
            yy, yx = np.gradient(gy)
            _, xx = np.gradient(gx)
            root = np.sqrt(((xx - yy) / 2) ** 2 + yx**2)
            e1, e2 = (xx + yy) / 2 + root, (xx + yy) / 2 - root
            small, large = np.where(np.abs(e1) < np.abs(e2), e1, e2), np.where(np.abs(e1) < np.abs(e2), e2, e1)
            with np.errstate(divide="ignore", invalid="ignore"):
                v = np.exp(-((small / large) ** 2) / (2 * beta**2)) * (1 - np.exp(-(small**2 + large**2) / (2 * c**2)))
            return np.where(large < 0, np.nan_to_num(v), 0.0).ravel().tolist()

        return pd.Series([one(*t) for t in zip(smooth(px, h, w), h, w, strict=True)])

    return F.pandas_udf(run, "array<double>")


def anisotropic_diffusion(rounds: int = 5, kappa: float = 0.1, step: float = 0.2) -> Callable[[Column, Column, Column], Column]:
    """(px, h, w) -> px: diffusion that stops at edges (Perona and Malik), replicated borders, a fixed number of rounds."""

    def run(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        def one(p, height, width):
            a = _values(p).reshape(height, width).copy()
            for _ in range(rounds):
                q = np.pad(a, 1, mode="edge")
                d = [q[:-2, 1:-1] - a, q[2:, 1:-1] - a, q[1:-1, :-2] - a, q[1:-1, 2:] - a]
                a += step * sum(np.exp(-((x / kappa) ** 2)) * x for x in d)
            return a.ravel().tolist()

        return pd.Series([one(*t) for t in zip(px, h, w, strict=True)])

    return F.pandas_udf(run, "array<double>")


def poisson_noise(photons: float, seed: int = 1) -> Callable[[Column, Column], Column]:
    """(key, row) -> row: -log(Poisson(N exp(-v)) / N), 20 where nothing arrives. The seed and the row's key decide, so a
    task that runs again gives the same."""

    def run(key: pd.Series, rows: pd.Series) -> pd.Series:
        def one(k, r):
            n = np.random.default_rng([seed, int(k) & 0xFFFFFFFF]).poisson(photons * np.exp(-_values(r)))
            return np.where(n > 0, -np.log(np.maximum(n, 1) / photons), 20.0).tolist()

        return pd.Series([one(k, r) for k, r in zip(key, rows, strict=True)])

    return F.pandas_udf(run, "array<double>")


def apply_slices(slices: DataFrame, f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    return slices.withColumn("px", f(F.col("px"), F.col("h"), F.col("w")))
