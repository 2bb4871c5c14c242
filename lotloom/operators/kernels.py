"""Image kernels in numpy, to be called from Arrow batches.

Images are uint8 arrays, grey (h, w) or colour (h, w, 3) in blue-green-red order. Keypoint detection and text
recognition need outside libraries; those are passed in as functions (see sources.files.pages_of).
"""

from __future__ import annotations

import numpy as np


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image."""
    if image.ndim == 2:
        return image
    return np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def otsu(image: np.ndarray) -> tuple[int, np.ndarray]:
    """Threshold with the greatest variance between classes, and the binary image."""
    counts = np.bincount(grey(image).ravel(), minlength=256).astype(float)
    p = counts / counts.sum()
    low, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * low - mean) ** 2 / (low * (1 - low))
    t = int(np.nanargmax(np.where(np.isfinite(between), between, -1)))
    return t, np.where(grey(image) > t, 255, 0).astype(np.uint8)


def _window_sums(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and count over a square window, cut off at the border, from one integral image."""
    h, w = x.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = x.cumsum(0).cumsum(1)
    r = size // 2
    top, bottom = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    left, right = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    s = total[bottom][:, right] - total[top][:, right] - total[bottom][:, left] + total[top][:, left]
    return s, (bottom - top)[:, None] * (right - left)[None, :]


def wolf(image: np.ndarray, window: int = 95, k: float = 0.1) -> np.ndarray:
    """Wolf's local threshold: mean - k (1 - deviation / greatest deviation) (mean - darkest)."""
    x = grey(image).astype(float)
    s, n = _window_sums(x, window)
    s2, _ = _window_sums(x * x, window)
    mean = s / n
    deviation = np.sqrt(np.maximum(s2 / n - mean**2, 0))
    limit = mean - k * (1 - deviation / max(deviation.max(), 1e-9)) * (mean - x.min())
    return np.where(x > limit, 255, 0).astype(np.uint8)


def binarised(image: np.ndarray, method: str = "wolf") -> tuple[np.ndarray, str | None]:
    """Binary image as colour, and a warning if another method had to do."""
    warning = None
    try:
        out = wolf(image) if method == "wolf" else otsu(image)[1]
    except (ValueError, FloatingPointError) as e:
        out, warning = otsu(image)[1], f"{method} failed: {e}"
    return np.repeat(out[:, :, None], 3, axis=2), warning


def crop(image: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A zone, cut off at the border."""
    h, w = image.shape[:2]
    return image[max(0, min(y, h)) : max(0, min(y + height, h)), max(0, min(x, w)) : max(0, min(x + width, w))]


def anchor_crop(image: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A region given by shares of the page."""
    h, w = image.shape[:2]
    a, b, c, d = int(x0 * w), int(y0 * h), max(int(x1 * w), int(x0 * w) + 1), max(int(y1 * h), int(y0 * h) + 1)
    return image[b:d, a:c]


def shrunk(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of equal cells."""
    g = grey(image).astype(float)
    rows = np.array_split(np.arange(g.shape[0]), height) if g.shape[0] >= height else [np.array([i * g.shape[0] // height]) for i in range(height)]
    cols = np.array_split(np.arange(g.shape[1]), width) if g.shape[1] >= width else [np.array([i * g.shape[1] // width]) for i in range(width)]
    return np.array([[g[np.ix_(r, c)].mean() for c in cols] for r in rows])


def _bits(mask: np.ndarray) -> int:
    return int("".join("1" if b else "0" for b in mask.ravel()), 2)


def difference_hash(image: np.ndarray, size: int = 8) -> int:
    """Whether each cell is brighter than its left neighbour."""
    x = shrunk(image, size, size + 1)
    return _bits(x[:, 1:] > x[:, :-1])


def perceptual_hash(image: np.ndarray, size: int = 16, factor: int = 4) -> int:
    """Signs of the lowest cosine terms against their median."""
    n = size * factor
    x = shrunk(image, n, n)
    i = np.arange(n)
    basis = np.cos(np.pi * (2 * i[None, :] + 1) * i[:, None] / (2 * n))
    low = (basis @ x @ basis.T)[:size, :size]
    return _bits(low > np.median(low))


def wavelet_hash(image: np.ndarray, size: int = 8) -> int:
    """Cells against their median, the lowest Haar band."""
    x = shrunk(image, size, size)
    return _bits(x > np.median(x))


def hash_similarity(a: int, b: int, bits: int) -> float:
    return 1 - (a ^ b).bit_count() / bits


def grey_histogram(image: np.ndarray) -> np.ndarray:
    """Shares of the 256 levels."""
    counts = np.bincount(grey(image).ravel(), minlength=256).astype(float)
    return counts / (counts.sum() + 1e-10)


def histogram_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation, not below 0."""
    x, y = a - a.mean(), b - b.mean()
    low = np.sqrt((x @ x) * (y @ y))
    return float(max(0.0, (x @ y) / low)) if low > 0 else float(np.array_equal(a, b))


def edge_density(image: np.ndarray, limit: float = 80.0) -> float:
    """Share of pixels whose Sobel gradient exceeds a limit."""
    g = np.pad(grey(image).astype(float), 1, mode="edge")
    dx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
    dy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
    return float((np.abs(dx) + np.abs(dy) > limit).mean())


def region_signature(image: np.ndarray) -> dict:
    """All features of a region."""
    return {
        "phash": perceptual_hash(image), "dhash": difference_hash(image), "whash": wavelet_hash(image),
        "histogram": grey_histogram(image), "edge_density": edge_density(image),
    }


def compare_regions(a: dict, b: dict) -> float:
    """Likeness of two signatures."""
    hashes = 0.45 * hash_similarity(a["phash"], b["phash"], 256) + 0.25 * hash_similarity(a["dhash"], b["dhash"], 64) + 0.30 * hash_similarity(a["whash"], b["whash"], 64)
    edges = max(0.0, 1 - min(abs(a["edge_density"] - b["edge_density"]) / 0.15, 1.0))
    return 0.60 * hashes + 0.25 * histogram_similarity(a["histogram"], b["histogram"]) + 0.15 * edges


def overlay(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half of each (I16)."""
    return ((a.astype(np.uint16) + b) // 2).astype(np.uint8)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Direct linear transform of four or more point pairs."""
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ h.T
    return p[:, :2] / p[:, 2:]


def ransac(src: np.ndarray, dst: np.ndarray, reach: float = 4.0, tries: int = 500, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """Homography that most pairs agree with, and which do."""
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    if len(src) < 4:
        return None, best
    for _ in range(tries):
        pick = rng.choice(len(src), 4, replace=False)
        with np.errstate(all="ignore"):
            ok = np.hypot(*(project(homography(src[pick], dst[pick]), src) - dst).T) <= reach
        if ok.sum() > best.sum():
            best = ok
    return (homography(src[best], dst[best]), best) if best.sum() >= 4 else (None, best)


def match_descriptors(a: np.ndarray, b: np.ndarray, ratio: float = 0.75) -> np.ndarray:
    """Pairs (i, j) of descriptors (n, 32) whose nearest is clearly nearer than the second."""
    if len(b) < 2:
        return np.empty((0, 2), int)
    far = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int32)
    two = np.argsort(far, axis=1, kind="stable")[:, :2]
    d = np.take_along_axis(far, two, 1)
    good = np.flatnonzero(d[:, 0] < ratio * d[:, 1])
    return np.c_[good, two[good, 0]]


def view_homography(width: int, height: int, rng: np.random.Generator, tilt: float = 0.12) -> np.ndarray:
    """A random camera view of a page: rotations about its centre, seen from a distance."""
    ax, ay, az = rng.uniform(-tilt, tilt, 3)
    rx = np.array([[1, 0, 0], [0, np.cos(ax), -np.sin(ax)], [0, np.sin(ax), np.cos(ax)]])
    ry = np.array([[np.cos(ay), 0, np.sin(ay)], [0, 1, 0], [-np.sin(ay), 0, np.cos(ay)]])
    rz = np.array([[np.cos(az), -np.sin(az), 0], [np.sin(az), np.cos(az), 0], [0, 0, 1]])
    f = float(max(width, height))
    to_plane = np.array([[1, 0, -width / 2], [0, 1, -height / 2], [0, 0, 0], [0, 0, 1]])
    pose = np.eye(4)
    pose[:3, :3] = rz @ ry @ rx
    pose[2, 3] = f
    camera = np.array([[f, 0, width / 2, 0], [0, f, height / 2, 0], [0, 0, 1, 0]])
    return camera @ pose @ to_plane


def relit(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Contrast, brightness, gamma and a linear shadow, then noise."""
    x = image.astype(float) / 255
    x = np.clip(x * rng.uniform(0.8, 1.2) + rng.uniform(-0.1, 0.1), 0, 1) ** rng.uniform(0.8, 1.25)
    shade = np.linspace(rng.uniform(0.7, 1), 1, image.shape[1])
    x = x * (shade[None, :, None] if image.ndim == 3 else shade[None, :]) + rng.normal(0, 0.02, image.shape)
    return np.rint(np.clip(x, 0, 1) * 255).astype(np.uint8)


def motion_kernel(size: int, horizontal: bool = True) -> np.ndarray:
    """Mean over a line of pixels."""
    k = np.zeros((size, size))
    if horizontal:
        k[size // 2] = 1 / size
    else:
        k[:, size // 2] = 1 / size
    return k
