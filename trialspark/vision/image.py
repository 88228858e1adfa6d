"""Gray images as numpy arrays: what the frame UDFs are made of.

An image is (height, width) uint8, a mask (height, width) bool.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def rgba_to_gray(rgba: bytes | np.ndarray, width: int, height: int) -> np.ndarray:
    data = np.frombuffer(rgba, np.uint8) if isinstance(rgba, (bytes, bytearray, memoryview)) else rgba
    if data.size < width * height * 4:
        raise ValueError("the buffer is shorter than the image")
    return rgb_to_gray(data[: width * height * 4].reshape(height, width, 4))


def rgb_to_gray(px: np.ndarray) -> np.ndarray:
    """Luma of (..., red, green, blue, ...) pixels, its fraction cut off."""
    px = px.astype(float)
    return (0.299 * px[..., 0] + 0.587 * px[..., 1] + 0.114 * px[..., 2]).astype(np.uint8)


def _same_size(a: np.ndarray, b: np.ndarray) -> None:
    if a.shape != b.shape:
        raise ValueError(f"sizes differ: {a.shape} and {b.shape}")


def abs_diff(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _same_size(a, b)
    return np.maximum(a, b) - np.minimum(a, b)


def circle_mask(width: int, height: int, cx: float, cy: float, r: float) -> np.ndarray:
    y, x = np.ogrid[:height, :width]
    return (x - cx) ** 2 + (y - cy) ** 2 <= r * r


def apply_mask(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    _same_size(image, mask)
    return np.where(mask, image, 0).astype(image.dtype)


def otsu_of_counts(counts: np.ndarray) -> int:
    """The first value of greatest variance between the classes up to and above it;
    0 when one class holds everything."""
    # between two values that occur the variance stays as it is, so they are enough
    at = np.flatnonzero(counts)
    if len(at) < 2:
        return 0
    n = counts[at].astype(float)
    below, sums = np.cumsum(n), np.cumsum(n * at)
    above = below[-1] - below[:-1]
    gap = sums[:-1] / below[:-1] - (sums[-1] - sums[:-1]) / above
    return int(at[(below[:-1] * above * gap * gap).argmax()])


def otsu_threshold(image: np.ndarray, mask: np.ndarray | None = None) -> int:
    return otsu_of_counts(np.bincount((image if mask is None else image[mask]).ravel(), minlength=256))


def binarize(image: np.ndarray, threshold: int, mask: np.ndarray | None = None) -> np.ndarray:
    out = image > threshold
    return out if mask is None else out & mask


def binarize_below(image: np.ndarray, threshold: int, mask: np.ndarray | None = None) -> np.ndarray:
    out = image <= threshold
    return out if mask is None else out & mask


def _spread(mask: np.ndarray, r: int, op: np.ufunc) -> np.ndarray:
    """op over the square of half-width r, first along rows, then columns; nothing
    lies outside the image."""
    if r <= 0:
        return mask.copy()
    h, w = mask.shape
    padded = np.zeros((h + 2 * r, w + 2 * r), bool)
    padded[r : r + h, r : r + w] = mask
    rows = padded[:, :w].copy()
    for i in range(1, 2 * r + 1):
        op(rows, padded[:, i : i + w], out=rows)
    out = rows[:h].copy()
    for i in range(1, 2 * r + 1):
        op(out, rows[i : i + h], out=out)
    return out


def _extent(mask: np.ndarray) -> tuple[slice, slice] | None:
    """The least rows and columns that hold the foreground; None without any."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1)) if len(rows) else None


def erode(mask: np.ndarray, r: int) -> np.ndarray:
    return _spread(mask, r, np.logical_and)


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    return _spread(mask, r, np.logical_or)


def open_mask(mask: np.ndarray, r: int) -> np.ndarray:
    """Opening never leaves the foreground, so only its extent is worked on."""
    at, out = _extent(mask), np.zeros(mask.shape, bool)
    if at:
        out[at] = dilate(erode(mask[at], r), r)
    return out


def close_mask(mask: np.ndarray, r: int) -> np.ndarray:
    return erode(dilate(mask, r), r)


@dataclass(frozen=True)
class Component:
    label: int
    area: int
    cx: float
    cy: float
    min_x: int
    min_y: int
    max_x: int
    max_y: int
    orientation: float
    sigma_major: float
    sigma_minor: float


def label_components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected labels from 1 in scan order, and how many there are.

    The foreground is cut into horizontal runs; runs of neighbouring rows that touch
    are one component, whose label spreads to the least run number until it rests.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), bool)
    padded[:, 1:-1] = mask
    before, now = padded[:, :-1], padded[:, 1:]
    rows, starts = np.nonzero(now & ~before)
    ends = np.nonzero(before & ~now)[1]  # exclusive
    n = len(rows)
    labels = np.zeros(mask.shape, np.int32)
    if not n:
        return labels, 0
    if n == rows[-1] - rows[0] + 1 and (np.diff(rows) == 1).all() and (starts[1:] <= ends[:-1]).all() and (ends[1:] >= starts[:-1]).all():
        return mask.astype(np.int32), 1  # one run a row, each touching the one above
    # runs of the row above that touch run i, corners included, are consecutive
    span = w + 2
    low = np.searchsorted(rows * span + ends, (rows - 1) * span + starts, "left")
    high = np.searchsorted(rows * span + starts, (rows - 1) * span + ends, "right")
    times = np.maximum(high - low, 0)
    lower = np.repeat(np.arange(n), times)
    upper = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    root = np.arange(n)
    root[lower] = upper
    while True:
        least = np.minimum(root[lower], root[upper])
        new = root.copy()
        np.minimum.at(new, root[lower], least)
        np.minimum.at(new, root[upper], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    first = root == np.arange(n)  # a component's root is its first run
    run_label = np.cumsum(first)[root]
    cells = np.repeat(rows * w + starts, ends - starts)
    lengths = ends - starts
    cells = cells + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    labels.ravel()[cells] = np.repeat(run_label, lengths)
    return labels, int(first.sum())


def components(mask: np.ndarray) -> tuple[np.ndarray, list[Component]]:
    """Labels and components, largest first, of equals the first in scan order."""
    labels, extent = np.zeros(mask.shape, np.int32), _extent(mask)
    if not extent:
        return labels, []
    inner, n = label_components(mask[extent])
    labels[extent] = inner
    y, x = np.nonzero(inner)
    at = inner[y, x] - 1
    y, x = y + extent[0].start, x + extent[1].start
    total = (lambda v: v.sum(keepdims=True)) if n == 1 else (lambda v: np.bincount(at, v, n))
    area = np.bincount(at, minlength=n)
    cx, cy = total(x) / area, total(y) / area
    xx, yy, xy = total(x * x) / area - cx * cx, total(y * y) / area - cy * cy, total(x * y) / area - cx * cy
    root = np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    major, minor = np.sqrt(np.maximum((xx + yy) / 2 + root, 0)), np.sqrt(np.maximum((xx + yy) / 2 - root, 0))
    angle = 0.5 * np.arctan2(2 * xy, xx - yy)
    order, firsts = (np.argsort(at, kind="stable") if n > 1 else slice(None)), np.cumsum(area) - area
    box = np.stack([op.reduceat(v[order], firsts) for op in (np.minimum, np.maximum) for v in (x, y)])
    found = [
        Component(i + 1, int(area[i]), float(cx[i]), float(cy[i]), int(box[0, i]), int(box[1, i]), int(box[2, i]), int(box[3, i]), float(angle[i]), float(major[i]), float(minor[i]))
        for i in range(n)
    ]
    return labels, sorted(found, key=lambda c: -c.area)


def axis_endpoints(labels: np.ndarray, c: Component) -> tuple[tuple[int, int], tuple[int, int]]:
    """Pixels of least and greatest projection on the major axis, first in scan order."""
    y, x = np.nonzero(labels[c.min_y : c.max_y + 1, c.min_x : c.max_x + 1] == c.label)
    y, x = y + c.min_y, x + c.min_x
    along = (x - c.cx) * np.cos(c.orientation) + (y - c.cy) * np.sin(c.orientation)
    a, b = int(along.argmin()), int(along.argmax())
    return (int(x[a]), int(y[a])), (int(x[b]), int(y[b]))


def upper_median(stack: np.ndarray) -> np.ndarray:
    """Per pixel, the value at position n // 2 of the sorted frames."""
    if not len(stack):
        raise ValueError("a background needs a frame")
    return np.partition(stack, len(stack) // 2, axis=0)[len(stack) // 2]
