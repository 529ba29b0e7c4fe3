"""Dense array kernels: Fourier, blur, ridge and peak-fit helpers, one image at a time inside Spark's Arrow batches.

The helpers are numpy; Spark deals the rows. Images are rows (frame, h, w, data) as in `movies`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "frame int, h int, w int, data array<float>"


def per_image(df: DataFrame, kernel: Callable[..., dict], schema: str, *columns: str) -> DataFrame:
    """kernel(row's arrays as images...) for each row; its dictionary is the new row's columns beside frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                images = [np.asarray(getattr(r, c), np.float64).reshape(r.h, r.w) for c in columns]
                rows.append({"frame": r.frame, **kernel(*images)})
            yield pd.DataFrame(rows)

    return df.select("frame", "h", "w", *columns).mapInPandas(run, schema)


STACK = 4 << 20  # pixels of the rows that a kernel gets at once


def per_stack(df: DataFrame, kernel: Callable[..., dict[str, np.ndarray]], columns: dict[str, tuple[int, int]]) -> DataFrame:
    """(frame, h, w, and the kernel's arrays) of each row.

    columns: which arrays the kernel gets, and their shape. It gets stacks (rows, height, width) of as many rows as fit
    STACK, so that weights of rows and columns are made once for all of them, and gives stacks of one shape by name. A row
    with a null array has null results; an array of another size fails.
    """
    names = list(kernel(*(np.zeros((0, h, w)) for h, w in columns.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, STACK // max(h * w for h, w in columns.values()))
        for b in batches:
            for first in range(0, b.num_rows, step):
                part = b.slice(first, step)
                valid = np.ones(part.num_rows, bool)
                for name in columns:
                    valid &= part.column(name).is_valid().to_numpy(zero_copy_only=False)
                own = part.filter(pa.array(valid))
                stacks = []
                for name, (h, w) in columns.items():
                    values = own.column(name).flatten().to_numpy(zero_copy_only=False)
                    if not (np.diff(own.column(name).offsets.to_numpy()) == h * w).all():
                        raise ValueError(f"{name} does not have {h} x {w} pixels")
                    stacks.append(values.astype(np.float64).reshape(-1, h, w))
                made = kernel(*stacks)
                h, w = next(iter(made.values())).shape[1:]
                place = pa.array(np.cumsum(valid) - 1, mask=~valid)
                out = [part.column("frame"), pa.array(np.full(len(valid), h, np.int32)), pa.array(np.full(len(valid), w, np.int32))]
                for x in made.values():
                    edges = np.arange(len(x) + 1, dtype=np.int32) * (h * w)
                    out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(x).ravel())).take(place))
                yield pa.RecordBatch.from_arrays(out, ["frame", "h", "w", *names])

    schema = f"frame {df.schema['frame'].dataType.simpleString()}, h int, w int, " + ", ".join(f"{n} array<double>" for n in names)
    return df.select("frame", *(F.col(c).cast("array<double>").alias(c) for c in columns)).mapInArrow(run, schema)


def _image(a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "data": a.astype(np.float32).ravel()}


# ---- phase correlation


def whitened(image: np.ndarray) -> np.ndarray:
    """z-scores under a Hanning window."""
    z = image - image.mean()
    std = z.std()
    z = z / std if std > 0 else z
    return z * np.hanning(z.shape[0])[:, None] * np.hanning(z.shape[1])[None, :]


def correlation_map(reference: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Phase correlation, centred: the peak's distance from the middle is the shift of the moving image."""
    if reference.shape != moving.shape:
        raise ValueError(f"shapes differ: {reference.shape} and {moving.shape}")
    cross = np.fft.fft2(whitened(reference)) * np.conj(np.fft.fft2(whitened(moving)))
    return np.fft.fftshift(np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-8))))


def feature(image: np.ndarray, mode: str, keep: float, sigmas: tuple[float, ...]) -> np.ndarray:
    """What is correlated: the clipped image itself ("raw"), or its strongest dark ridges ("ridges")."""
    image = np.clip(image, *np.percentile(image, [1, 99]))
    if mode == "raw":
        return image
    span = image.max() - image.min()
    return strongest(ridge_response((image - image.min()) / span if span > 0 else np.zeros_like(image), sigmas), keep)[0]


def phase_correlation(pairs: DataFrame, mode: str = "raw", keep: float = 20.0, sigmas: tuple[float, ...] = (4.0, 5.0, 6.0, 7.0)) -> DataFrame:
    """(frame, h, w, corr) of rows with a reference (data) and a moving image (moving), by their values or their ridges."""
    if mode not in ("raw", "ridges"):
        raise ValueError("mode must be raw or ridges")

    def kernel(a, b):
        out = _image(correlation_map(feature(a, mode, keep, sigmas), feature(b, mode, keep, sigmas)))
        return {"h": out["h"], "w": out["w"], "corr": out["data"]}

    return per_image(pairs, kernel, "frame int, h int, w int, corr array<float>", "data", "moving")


# ---- blur and band pass


def gaussian_blur(image: np.ndarray, sigma: float, mode: str = "edge") -> np.ndarray:
    """Separable Gaussian out to four deviations; beyond the border the edge value, or the mirror image, goes on."""
    if sigma <= 0:
        return image.astype(np.float64)
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if k == axis else (0, 0) for k in (0, 1)]
        wide, n = np.pad(out, pad, mode=mode), out.shape[axis]
        out = sum(w * np.take(wide, range(k, k + n), axis=axis) for k, w in enumerate(weights))
    return out


def blurred(images: DataFrame, sigma: float) -> DataFrame:
    return per_image(images, lambda a: _image(gaussian_blur(a, sigma)), IMAGE, "data")


def band_passed(image: np.ndarray, large: float = 5.0, small: float = 1.0) -> np.ndarray:
    """Structures between two sizes kept, by a difference of Gaussians in the frequency domain; the mean stays.

    The image is mirrored out to the next power of two of one and a half times its longer side.
    """
    h, w = image.shape
    size = 1 << int(np.ceil(np.log2(max(2, 1.5 * max(h, w)))))
    oy, ox = (size - h) // 2, (size - w) // 2
    rows, columns = ((lambda m, n: np.where(m < n, m, 2 * n - 1 - m))(np.mod(np.arange(size) - o, 2 * n), n) for n, o in ((h, oy), (w, ox)))
    fy, fx = np.fft.fftfreq(size)[:, None] * size, np.fft.rfftfreq(size)[None, :] * size
    r2 = fy**2 + fx**2
    gain = (1 - np.exp(-r2 * (2.0 * large / size) ** 2)) * np.exp(-r2 * (2.0 * small / size) ** 2)
    gain[0, 0] = 1.0
    out = np.fft.irfft2(np.fft.rfft2(image[np.ix_(rows, columns)]) * gain, s=(size, size))
    return out[oy : oy + h, ox : ox + w]


def band_pass(images: DataFrame) -> DataFrame:
    return per_image(images, lambda a: _image(band_passed(a)), IMAGE, "data")


def regression_field(total: np.ndarray, count: np.ndarray, sigma: float) -> np.ndarray:
    """Kernel regression of scattered values: blurred totals over blurred counts, which count as 1e-8 at least."""
    return gaussian_blur(total, sigma) / np.maximum(gaussian_blur(count, sigma), 1e-8)


# ---- ridges


def ridge_response(image: np.ndarray, sigmas: tuple[float, ...], beta: float = 0.5) -> np.ndarray:
    """Dark ridges by the eigenvalues of the Hessian, the greatest response over the scales."""
    best = np.zeros_like(image, dtype=np.float64)
    for sigma in sigmas:
        smooth = gaussian_blur(image, sigma, "symmetric")
        gy, gx = np.gradient(smooth)
        (hyy, hyx), (_, hxx) = np.gradient(gy), np.gradient(gx)
        middle, spread = (hyy + hxx) / 2, np.sqrt(((hyy - hxx) / 2) ** 2 + hyx**2)
        a, b = middle - spread, middle + spread
        small, large = np.where(np.abs(a) < np.abs(b), (a, b), (b, a)) * sigma**2
        norm = np.sqrt(small**2 + large**2)
        gamma = norm.max() / 2 or 1.0
        ratio = np.divide(small, large, out=np.zeros_like(small), where=large != 0)
        response = np.exp(-(ratio**2) / (2 * beta**2)) * (1 - np.exp(-(norm**2) / (2 * gamma**2)))
        best = np.maximum(best, np.where(large > 0, response, 0.0))
    return best


def strongest(response: np.ndarray, keep: float) -> tuple[np.ndarray, float]:
    """The top share (per cent) of positive responses, blurred by a pixel; and the threshold."""
    positive = response[response > 0]
    if not positive.size:
        return np.zeros_like(response), 0.0
    threshold = float(np.percentile(positive, 100.0 - min(max(keep, 0.0), 100.0)))
    kept = np.where(response >= threshold, response, 0.0)
    return gaussian_blur(kept, 1.0, "symmetric"), threshold


def vesselness(images: DataFrame, sigmas: tuple[float, ...] = (4.0, 5.0, 6.0, 7.0), keep: float = 20.0) -> DataFrame:
    """(frame, h, w, data, threshold): ridges of images clipped and scaled to 0..1."""

    def kernel(a):
        a = np.clip(a, *np.percentile(a, [1, 99]))
        span = a.max() - a.min()
        kept, threshold = strongest(ridge_response((a - a.min()) / span if span > 0 else np.zeros_like(a), sigmas), keep)
        return {**_image(kept), "threshold": threshold}

    return per_image(images, kernel, IMAGE + ", threshold double", "data")


# ---- peak fit


def gaussian_peak(p: np.ndarray, yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
    """Rotated Gaussian with offset; p: amplitude, centre y and x, log deviations, raw correlation, offset."""
    rho = 0.98 * np.tanh(p[5])
    dy, dx = (yy - p[1]) / np.exp(p[3]), (xx - p[2]) / np.exp(p[4])
    return p[0] * np.exp(-(dy * dy - 2 * rho * dy * dx + dx * dx) / (2 * (1 - rho * rho))) + p[6]


def fit_peak(corr: np.ndarray, window: tuple[int, int, int, int], most: int = 400) -> dict:
    """Weighted least squares of the peak in a window, by Levenberg-Marquardt held to bounds; its start if that fails.

    The start is the window's centre, a quarter of its sides and its tenth percentile; the bounds follow the window and
    its values.
    """
    y0, y1, x0, x1 = window
    part = np.asarray(corr, np.float64)[y0:y1, x0:x1]
    (h, w), eps = part.shape, float(np.finfo(np.float64).eps)
    yy, xx = np.mgrid[y0:y1, x0:x1].astype(np.float64)
    top = np.unravel_index(np.asarray(corr).argmax(), np.asarray(corr).shape)
    least, peak, floor = float(part.min()), float(part.max()), float(np.percentile(part, 10))
    weight = 0.25 + (part / max(peak, eps)) ** 2
    p = np.array([max(peak - floor, eps), (y0 + y1 - 1) / 2, (x0 + x1 - 1) / 2, np.log(max(h / 4, 1.5)), np.log(max(w / 4, 1.5)), 0.0, floor])
    low = np.array([0, y0, x0, np.log(0.5), np.log(0.5), -4, least])
    high = np.array([max(5 * peak, 1), y1 - 1, x1 - 1, np.log(max(h, 2)), np.log(max(w, 2)), 4, max(peak, least + 1e-6)])
    p = np.clip(p, low, high)
    start = p.copy()
    residual = lambda q: (weight * (gaussian_peak(q, yy, xx) - part)).ravel()
    r, damping, calls = residual(p), 1e-3, 1
    while calls < most and np.isfinite(r).all():
        jacobian = np.empty((r.size, 7))
        for k in range(7):
            step = 1e-6 * max(1.0, abs(p[k]))
            q = p.copy()
            q[k] += step
            jacobian[:, k] = (residual(q) - r) / step
        calls += 7
        normal, slope = jacobian.T @ jacobian, jacobian.T @ r
        for _ in range(8):
            q = np.clip(p - np.linalg.lstsq(normal + damping * np.diag(np.diag(normal) + 1e-12), slope, rcond=None)[0], low, high)
            s = residual(q)
            calls += 1
            if np.isfinite(s).all() and s @ s < r @ r:
                break
            damping *= 4
        else:
            break
        gain, p, r, damping = r @ r - s @ s, q, s, damping / 3
        if gain < 1e-14 * max(r @ r, 1e-30):
            break
    if not np.isfinite(p).all():
        p = start
    sy, sx, rho = np.exp(p[3]), np.exp(p[4]), 0.98 * np.tanh(p[5])
    values, vectors = np.linalg.eigh(np.array([[sy * sy, rho * sy * sx], [rho * sy * sx, sx * sx]]))
    major = vectors[:, 1]
    return {
        "peak_y": int(top[0]), "peak_x": int(top[1]), "centre_y": float(p[1]), "centre_x": float(p[2]), "sigma_y": float(sy), "sigma_x": float(sx),
        "rho": float(rho), "angle": float(np.degrees(np.arctan2(major[0], major[1]))), "major": float(np.sqrt(values[1])), "minor": float(np.sqrt(max(values[0], 0.0))),
    }


def peak_window(corr: np.ndarray, radius: int) -> tuple[int, int, int, int]:
    """A window about the greatest value, at least four pixels a side where the image allows."""
    h, w = corr.shape
    y, x = np.unravel_index(corr.argmax(), corr.shape)
    y0, x0 = max(0, min(int(y) - radius, h - 4)), max(0, min(int(x) - radius, w - 4))
    return y0, min(h, max(int(y) + radius + 1, y0 + 4)), x0, min(w, max(int(x) + radius + 1, x0 + 4))


def peak_fits(maps: DataFrame, radius: int = 8) -> DataFrame:
    """Fitted peak of each correlation map, and the shift it means: its distance from the middle."""

    def kernel(a):
        out = fit_peak(a, peak_window(a, radius))
        return {**out, "offset_y": out["centre_y"] - a.shape[0] // 2, "offset_x": out["centre_x"] - a.shape[1] // 2}

    numbers = ("centre_y", "centre_x", "sigma_y", "sigma_x", "rho", "angle", "major", "minor", "offset_y", "offset_x")
    return per_image(maps, kernel, "frame int, peak_y int, peak_x int, " + ", ".join(f"{n} double" for n in numbers), "data")
