"""Images before and in text recognition: preprocessing in numpy, and the seam for an engine.

Images are rows of grey or colour samples (height, width, pixels as bytes). An
engine is a function without arguments that returns a function from a binary
image (an array of 0 and 255) and a page segmentation mode to (text, mean
confidence from 0 to 100); none is installed here, so it is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values: least width in pixels, angles tried, modes in the order tried, confidence that suffices
LEAST_SIDE = 1500
LARGEST_ANGLE, ANGLE_STEP = 5.0, 0.5
MODES = (6, 3, 11)
SURE = 60.0

RECOGNISED = "path string, text string, mean_confidence double, psm_used int, error string"


def grey(image: np.ndarray) -> np.ndarray:
    """One channel of 0 to 255, by the usual weights of red, green and blue."""
    if image.ndim == 2:
        return image.astype(np.uint8)
    return np.rint(image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])).clip(0, 255).astype(np.uint8)


def enlarged(image: np.ndarray, least: int = LEAST_SIDE) -> np.ndarray:
    """The image with its width brought up to `least` by bilinear interpolation; wider ones stay."""
    side = image.shape[1]
    if not image.size or side >= least:
        return image
    height, width = (max(1, round(n * least / side)) for n in image.shape)
    y, x = ((np.arange(m) + 0.5) * n / m - 0.5 for m, n in ((height, image.shape[0]), (width, image.shape[1])))
    y, x = y.clip(0, image.shape[0] - 1), x.clip(0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    cell = image.astype(np.float64)
    rows = (1 - fy) * cell[y0] + fy * cell[y1]
    return np.rint((1 - fx) * rows[:, x0] + fx * rows[:, x1]).astype(np.uint8)


def rotated(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """The image turned about its middle, in a frame that holds all of it."""
    if not degrees or not image.size:
        return image
    height, width = image.shape
    angle = np.deg2rad(degrees)
    cos, sin = abs(np.cos(angle)), abs(np.sin(angle))
    tall, wide = int(np.ceil(height * cos + width * sin - 1e-9)), int(np.ceil(width * cos + height * sin - 1e-9))
    y, x = np.mgrid[:tall, :wide]
    y, x = y - (tall - 1) / 2, x - (wide - 1) / 2
    from_x = np.rint(np.cos(angle) * x - np.sin(angle) * y + (width - 1) / 2).astype(int)
    from_y = np.rint(np.sin(angle) * x + np.cos(angle) * y + (height - 1) / 2).astype(int)
    inside = (from_x >= 0) & (from_x < width) & (from_y >= 0) & (from_y < height)
    out = np.full((tall, wide), fill, image.dtype)
    out[inside] = image[from_y[inside], from_x[inside]]
    return out


def skew(image: np.ndarray, largest: float = LARGEST_ANGLE, step: float = ANGLE_STEP) -> float:
    """The angle whose rotation makes lines of text stand out most: the largest variance of ink per row."""
    stride = max(1, max(image.shape) // 500)
    small = image[::stride, ::stride]
    angles = np.arange(-largest, largest + step / 2, step)
    angles = angles[np.argsort(np.abs(angles), kind="stable")]  # of equals, the least turn
    height, width = small.shape

    def framed(angle: float) -> np.ndarray:
        turned = rotated(small, angle)
        y, x = (turned.shape[0] - height) // 2, (turned.shape[1] - width) // 2
        return turned[y : y + height, x : x + width]

    scores = [np.var((255 - framed(a).astype(np.float64)).sum(1)) for a in angles]
    return float(angles[int(np.argmax(scores))])


def median3(image: np.ndarray) -> np.ndarray:
    """The median of each sample and its eight neighbours."""
    wide = np.pad(image, 1, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, (3, 3)), axis=(2, 3)).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold between dark and light with the largest variance between the two."""
    counts = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below, weighted = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (weighted / below - (weighted[-1] - weighted) / above) ** 2
    return int(np.argmax(np.nan_to_num(between)))


def prepared(image: np.ndarray) -> np.ndarray:
    """Grey, enlarged, straightened, smoothed, and black on white."""
    image = enlarged(grey(image))
    if not image.size:
        return image
    image = median3(rotated(image, skew(image)))
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def recognised(image: np.ndarray, engine: Callable[[np.ndarray, int], tuple[str, float]]) -> tuple[str, float, int]:
    """(text, mean confidence, mode): later modes are tried only while none is sure, and the surest holds."""
    best = None
    for mode in MODES:
        text, confidence = engine(image, mode)
        if best is None or confidence > best[1]:
            best = (text, confidence, mode)
        if best[1] >= SURE:
            break
    return best


def recognise(images: DataFrame, engine: Callable[[], Callable] | None = None) -> DataFrame:
    """(path, text, mean_confidence, psm_used, error) of images (path, height, width, pixels).

    Without an engine, or where it fails, error says so and the row stays.
    """

    def run(batches):
        read = engine() if engine is not None else None
        for batch in batches:
            rows = []
            for path, height, width, pixels in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if read is None:
                    rows.append((path, None, None, None, "no text recognition installed"))
                    continue
                try:
                    samples = np.frombuffer(pixels, np.uint8)
                    shape = (height, width) if samples.size == height * width else (height, width, -1)
                    rows.append((path, *recognised(prepared(samples.reshape(shape)), read), None))
                except Exception as failure:  # noqa: BLE001 - an engine's errors are of any kind
                    rows.append((path, None, None, None, type(failure).__name__))
            columns = zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string()), strict=True) if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["path", "text", "mean_confidence", "psm_used", "error"])

    return images.select("path", "height", "width", "pixels").mapInArrow(run, RECOGNISED)
