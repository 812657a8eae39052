"""Pixel kernels on float32 images in numpy alone: filters, morphology, distances, degradations, quality metrics.

Where two published variants differ, `variant` names the one meant: "evaluation" (the default) or
"toolkit". Definitions are exact as documented here; no claim is made to match any imaging library
bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# --- filters


def correlate(x: np.ndarray, weights: np.ndarray, axis: int, mode: str = "symmetric") -> np.ndarray:
    """One-dimensional correlation; mode as numpy.pad ("symmetric" repeats the edge pixel, "reflect" doesn't)."""
    r = len(weights) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, len(weights) - 1 - r)
    p = np.pad(x, pad, mode=mode if min(x.shape) > 1 else "edge")
    n = x.shape[axis]
    return sum(w * np.take(p, range(k, k + n), axis=axis) for k, w in enumerate(weights))


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    return correlate(correlate(x, w, 0), w, 1)


def sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, s = np.array([-1.0, 0, 1]), np.array([1.0, 2, 1])
    return correlate(correlate(x, d, 1), s, 0), correlate(correlate(x, d, 0), s, 1)


def box_mean(x: np.ndarray, size: int) -> np.ndarray:
    w = np.full(size, 1 / size)
    return correlate(correlate(x, w, 0), w, 1)


# --- masks


def disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of each pixel to the nearest one outside mask: columns, then rows by lower envelopes."""
    h, w = mask.shape
    far = float((h + w) ** 2)
    g = np.where(mask, far, 0.0)
    for order in (range(1, h), range(h - 2, -1, -1)):
        step = -1 if order.step == 1 else 1
        run = np.sqrt(g)
        for i in order:
            run[i] = np.minimum(run[i], run[i + step] + 1)
        g = run**2
    out = np.empty_like(g)
    at = np.arange(w)
    gap = (at[:, None] - at[None, :]) ** 2
    for i in range(h):
        row = g[i]
        out[i] = row if not row.any() else (row[None, :] + gap).min(axis=1)
    return out


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return squared_distance(~mask) <= radius * radius if mask.any() else mask.copy()


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    return squared_distance(mask) > radius * radius if not mask.all() else mask.copy()


def close_(mask: np.ndarray, radius: int) -> np.ndarray:
    """Dilation then erosion by a disk, with room around the image."""
    p = np.pad(mask, radius + 1)
    return erode(dilate(p, radius), radius)[radius + 1 : -radius - 1, radius + 1 : -radius - 1]


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Labels from 1: least index reached, by sweeps in four directions until nothing changes."""
    h, w = mask.shape
    ids = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        p = np.pad(np.where(mask, ids, big), 1, constant_values=big)
        near = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
        if diagonal:
            near += [p[:-2, :-2], p[:-2, 2:], p[2:, :-2], p[2:, 2:]]
        new = np.where(mask, np.minimum.reduce(near), 0)
        flat = np.append(0, new.ravel())
        while True:  # follow labels of labels
            hop = flat[flat]
            if (hop == flat).all():
                break
            flat = hop
        new = np.where(mask, flat[1:].reshape(h, w), 0)
        if (new == ids).all():
            return ids
        ids = new


def largest(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    if not mask.any():
        return mask
    labels = components(mask, diagonal)
    found, n = np.unique(labels[mask], return_counts=True)
    return labels == found[n.argmax()]


def drop_small(mask: np.ndarray, size: int) -> np.ndarray:
    """Without the components of fewer than size pixels."""
    if not mask.any():
        return mask
    labels = components(mask)
    found, n = np.unique(labels, return_counts=True)
    return mask & np.isin(labels, found[(n >= size) & (found > 0)])


def fill_holes(mask: np.ndarray, size: int) -> np.ndarray:
    """With the holes of at most size pixels filled; what touches the border is no hole."""
    labels = components(~mask)
    edge = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    found, n = np.unique(labels, return_counts=True)
    return mask | np.isin(labels, found[(n <= size) & (found > 0) & ~np.isin(found, edge)])


def convex_hull(mask: np.ndarray) -> np.ndarray:
    """Pixels whose centre lies in the hull of mask's pixel centres: monotone chain, then half planes."""
    y, x = np.nonzero(mask)
    if len(y) < 3:
        return mask.copy()
    points = sorted({(int(a), int(b)) for r in np.unique(y) for a, b in ((x[y == r].min(), r), (x[y == r].max(), r))})

    def half(ps):
        out: list[tuple[int, int]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(points) + half(points[::-1])
    if len(hull) < 3:
        return mask.copy()
    gy, gx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    inside = np.ones(mask.shape, bool)
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        inside &= (bx - ax) * (gy - ay) - (by - ay) * (gx - ax) >= 0
    return inside


# --- setting up an image


def unit_range(x: np.ndarray) -> np.ndarray:
    """Scaled to 0..1, non-finite pixels 0; flat images are all 0."""
    x = np.where(np.isfinite(x), x, 0).astype(np.float32)
    low, high = float(x.min()), float(x.max())
    return (x - low) / (high - low) if high > low else np.zeros_like(x)


def fixed_window(x: np.ndarray, mask: np.ndarray | None = None, low: float = 0.5, high: float = 99.5) -> tuple[float, float]:
    """Two percentiles of the masked pixels; their ends if those coincide, and a width of 1 if those do."""
    v = x[mask] if mask is not None and mask.any() else x.ravel()
    v = v[np.isfinite(v)]
    if not len(v):
        return 0.0, 1.0
    a, b = (float(e) for e in np.percentile(v, [low, high]))
    if b <= a:
        a, b = float(v.min()), float(v.max())
    return (a, b) if b > a else (a, a + 1.0)


def windowed(x: np.ndarray, window: tuple[float, float]) -> np.ndarray:
    return np.clip((x - window[0]) / (window[1] - window[0]), 0, 1).astype(np.float32)


def otsu(v: np.ndarray, bins: int = 256) -> float:
    """The centre of the histogram bin that best parts v by variance between the classes; of variances alike to nine digits the lowest."""
    if not len(v):
        return 0.0
    n, edges = np.histogram(v, bins)
    centre = (edges[1:] + edges[:-1]) / 2
    below, above = np.cumsum(n), n.sum() - np.cumsum(n)
    sums = np.cumsum(n * centre)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.round(below * above * (sums / below - (sums[-1] - sums) / above) ** 2, 9)  # sums of equal classes differ in their last bits
    return float(centre[int(np.nanargmax(np.append(np.where(above[:-1] > 0, between[:-1], -1), -1)))])


def threshold_of(x: np.ndarray, strategy: str = "otsu_fraction") -> float:
    """Where tissue starts: a fraction of Otsu's threshold, that threshold, Yen's, the second percentile, or 0."""
    positive = x[x > 0]
    if not len(positive) or strategy == "nonzero":
        return 0.0
    if strategy == "otsu_fraction":
        return 0.15 * otsu(positive)
    if strategy == "otsu_positive":
        return otsu(positive)
    if strategy == "percentile":
        return float(np.percentile(positive, 2))
    if strategy == "yen_positive":
        n, edges = np.histogram(positive, 256)
        p = n / n.sum()
        c, s1 = np.cumsum(p), np.cumsum(p**2)
        s2 = np.cumsum((p**2)[::-1])[::-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            crit = np.log((s1[:-1] * s2[1:]) ** -1 * (c[:-1] * (1 - c[:-1])) ** 2)
        return float(((edges[1:] + edges[:-1]) / 2)[int(np.nanargmax(np.where(np.isfinite(crit), crit, -np.inf)))])
    raise ValueError(f"unknown threshold {strategy!r}")


def breast_mask(img: np.ndarray, strategy: str = "otsu_fraction", closing: int = 15, least_object: int = 4096, most_hole: int = 8192, diagonal: bool = False) -> np.ndarray:
    x = unit_range(img)
    if not (x > 0).any():
        return np.zeros(x.shape, bool)
    mask = close_(gaussian(x, 3.0) > threshold_of(x, strategy), closing)
    mask = fill_holes(largest(drop_small(mask, least_object), diagonal), most_hole)
    return convex_hull(mask) & close_(x > 0.01, 5) if mask.any() else mask


def tissue_patch(img: np.ndarray, mask: np.ndarray, size: int = 96, margin: int = 80, avoid: np.ndarray | None = None) -> tuple[int, int, int, int] | None:
    """The box of the calmest patch wholly inside the mask, as far from its contour as margins allow; the first of equals, rows first.

    Sums over patches come from summed-area tables, so each place costs the same.
    """
    h, w = img.shape
    gx, gy = sobel(gaussian(img.astype(np.float32), 1.0))
    table = lambda a: np.pad(np.cumsum(np.cumsum(a, 0, dtype=np.float64), 1), ((1, 0), (1, 0)))
    grad, distance = table(np.hypot(gx, gy)), np.sqrt(squared_distance(np.pad(mask, 1))[1:-1, 1:-1])
    step = max(8, size // 4)
    ys, xs = (np.arange(0, max(n - size, -1) + 1, step) for n in (h, w))
    if not len(ys) or not len(xs):
        return None
    over = lambda t: t[ys[:, None] + size, xs + size] - t[ys[:, None], xs + size] - t[ys[:, None] + size, xs] + t[ys[:, None], xs]
    for m in sorted({margin, margin // 2, margin // 4, 0}, reverse=True):
        inside = distance >= m if m else mask
        if avoid is not None:
            inside = inside & ~avoid
        full = over(table(inside)) >= size * size
        if full.any():
            score = np.where(full, over(grad), np.inf)
            i, j = np.unravel_index(int(score.argmin()), score.shape)
            return int(xs[j]), int(ys[i]), int(xs[j]) + size, int(ys[i]) + size
    return None


def without_text(x: np.ndarray) -> np.ndarray:
    """Only the largest component of positive pixels."""
    return np.where(largest(x > 0), x, 0)


def crop_box(mask: np.ndarray, margin: int) -> tuple[int, int, int, int]:
    y, x = np.nonzero(mask)
    if not len(y):
        raise ValueError("nothing to crop to")
    h, w = mask.shape
    return max(int(x.min()) - margin, 0), max(int(y.min()) - margin, 0), min(int(x.max()) + 1 + margin, w), min(int(y.max()) + 1 + margin, h)


def to_bytes(x: np.ndarray) -> np.ndarray:
    return (unit_range(x) * 255).round().astype(np.uint8)


def box_mask(shape: tuple[int, int], b: tuple[int, int, int, int], strict: bool = False) -> np.ndarray:
    """Pixels of a box; of one outside the image none, or an error if strict."""
    out = np.zeros(shape, bool)
    x1, y1, x2, y2 = max(b[0], 0), max(b[1], 0), min(b[2], shape[1]), min(b[3], shape[0])
    if x2 > x1 and y2 > y1:
        out[y1:y2, x1:x2] = True
    elif strict:
        raise ValueError(f"box {b} lies outside {shape}")
    return out


def ring(b: tuple[int, int, int, int], mask: np.ndarray, others=(), inner: float = 1.5, outer: float = 2.5) -> np.ndarray:
    """Tissue between two boxes about a lesion, without other lesions. The lesion's own box is not cut to the mask."""
    def scaled(s: float) -> np.ndarray:
        cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        w, h = max(1, round((b[2] - b[0]) * s)), max(1, round((b[3] - b[1]) * s))
        return box_mask(mask.shape, (round(cx - w / 2), round(cy - h / 2), round(cx + w / 2), round(cy + h / 2)))

    out = scaled(outer) & ~scaled(inner) & mask
    for o in others:
        if tuple(o) != tuple(b):
            out &= ~box_mask(mask.shape, o)
    return out


# --- degradations


def clip01(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 1).astype(np.float32)


def dose_noise(x: np.ndarray, factor: float, sigma0: float, seed: int, variant: str = "evaluation") -> np.ndarray:
    """Noise that raises sigma0 to what a dose of that factor would have.

    The evaluation draws at that spread and rounds to single precision; the toolkit rounds the draws, then scales them.
    """
    if not 0 < factor <= 1 or sigma0 < 0:
        raise ValueError("the dose factor must be in (0, 1] and sigma0 at least 0")
    add = np.sqrt(max(sigma0**2 / factor - sigma0**2, 0.0))
    if add == 0:
        return x.astype(np.float32).copy()
    rng = np.random.default_rng(seed)
    if variant == "toolkit":
        return clip01(x + rng.standard_normal(x.shape).astype(np.float32) * np.float32(add))
    return clip01(x + rng.normal(0, add, x.shape).astype(np.float32))


def blur_kernel(length: int, angle: float = 0.0) -> np.ndarray:
    """A line of that length (odd) turned by angle degrees, sampled bilinearly; sums to 1."""
    n = max(1, int(length)) | 1
    k, c = np.zeros((n, n)), n // 2
    for t in np.linspace(-c, c, 8 * n + 1):
        x, y = c + t * np.cos(np.deg2rad(angle)), c - t * np.sin(np.deg2rad(angle))
        i, j = int(np.floor(y)), int(np.floor(x))
        for di in (0, 1):
            for dj in (0, 1):
                if 0 <= i + di < n and 0 <= j + dj < n:
                    k[i + di, j + dj] += (1 - abs(y - i - di)) * (1 - abs(x - j - dj))
    return k / k.sum()


def motion_blur(x: np.ndarray, length: int, angle: float = 0.0, variant: str = "evaluation") -> np.ndarray:
    """Horizontal mean of length pixels; borders mirror without the edge pixel, with it for the toolkit."""
    mode = "symmetric" if variant == "toolkit" else "reflect"
    length = int(length)
    if angle == 0:
        return clip01(correlate(x, np.full(length, 1 / length), 1, mode if x.shape[1] > length // 2 else "symmetric"))
    k = blur_kernel(length, angle)
    r = len(k) // 2
    p = np.pad(x, r, mode=mode)
    return clip01(sum(k[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(len(k)) for j in range(len(k)) if k[i, j]))


def odd_length(length_mm: float, spacing_mm: float) -> int:
    """A length in pixels: the nearest odd number, at least 1."""
    n = max(1, round(length_mm / spacing_mm))
    return n if n % 2 else n + 1


def reduce_contrast(x: np.ndarray, alpha: float, mask: np.ndarray | None = None, centre: str = "masked_median", variant: str = "evaluation") -> np.ndarray:
    """Towards a centre by alpha; inside the mask only, everywhere for the toolkit."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    inside = x[mask] if mask is not None and mask.any() and centre.startswith("masked") else x.ravel()
    at = {"masked_median": np.median, "median": np.median, "masked_mean": np.mean, "mean": np.mean}
    c = 0.5 if centre == "midpoint" else float(at[centre](inside))
    out = clip01(c + alpha * (x - c))
    return out if variant == "toolkit" or mask is None else np.where(mask, out, x).astype(np.float32)


def area_weights(n: int, m: int) -> np.ndarray:
    """m x n: the overlap of each of m equal parts with each of n pixels, rows summing to 1."""
    edges = np.arange(m + 1) * n / m
    low, high = edges[:-1, None], edges[1:, None]
    at = np.arange(n)[None, :]
    w = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
    return w / w.sum(axis=1, keepdims=True)


def cubic_weights(m: int, n: int, a: float = -0.75) -> np.ndarray:
    """n x m: cubic convolution from m to n pixels, edges repeated."""
    out = np.zeros((n, m))
    for i in range(n):
        s = (i + 0.5) * m / n - 0.5
        f = int(np.floor(s))
        for k in range(f - 1, f + 3):
            t = abs(s - k)
            w = (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0
            out[i, min(max(k, 0), m - 1)] += w
    return out


def reduce_resolution(x: np.ndarray, factor: float, variant: str = "evaluation") -> np.ndarray:
    """Down by area, up by cubic convolution. Sizes round down, to nearest for the toolkit."""
    if not 0 < factor <= 1:
        raise ValueError("the factor must be in (0, 1]")
    if factor == 1:
        return x.astype(np.float32).copy()
    h, w = x.shape
    sh, sw = (max(1, round(n * factor) if variant == "toolkit" else int(n * factor + 1e-9)) for n in (h, w))
    small = area_weights(h, sh) @ x @ area_weights(w, sw).T
    return clip01(cubic_weights(sh, h) @ small @ cubic_weights(sw, w).T)


def resolution_ladder(x: np.ndarray, severities=None, factors=(0.9, 0.8, 0.7, 0.6, 0.5, 0.4), variant: str = "evaluation") -> dict[int, np.ndarray]:
    """Severity to the image at that severity's resolution."""
    severities = range(1, len(factors) + 1) if severities is None else severities
    if bad := [s for s in severities if not 1 <= s <= len(factors)]:
        raise ValueError(f"severities {bad} are not in 1 to {len(factors)}")
    return {s: reduce_resolution(x, factors[s - 1], variant) for s in severities}


def lesions_dilated(shape: tuple[int, int], boxes, by: int = 16) -> np.ndarray:
    """Pixels within `by` of any box."""
    out = np.zeros(shape, bool)
    for b in boxes:
        out |= box_mask(shape, tuple(b))
    return dilate(out, by)


def blur_schedule(lengths=(3, 5, 7, 11, 15, 21), canvas_mm: float = 0.24) -> list[tuple[int, int, float]]:
    """Severity, length in pixels, and in millimetres on the canvas."""
    return [(k, n, n * canvas_mm) for k, n in enumerate(lengths, 1)]


#: JPEG 2000 codecs by name: functions of an image and a compression ratio. None is built in.
CODECS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {}


def jpeg2000(x: np.ndarray, ratio: float) -> np.ndarray:
    if "jpeg2000" not in CODECS:
        raise NotImplementedError("register a JPEG 2000 codec in CODECS['jpeg2000']: this build has none")
    return clip01(CODECS["jpeg2000"](x, ratio))


def wavelet_quant(x: np.ndarray, ratio: float) -> np.ndarray:
    """A surrogate of its own: Haar wavelets, of which only one coefficient in `ratio` stays. It is not JPEG 2000."""
    h, w = x.shape
    ph, pw = -h % 8, -w % 8
    y = np.pad(x.astype(np.float64), ((0, ph), (0, pw)), mode="edge")
    sizes = []
    for _ in range(3):
        n, m = (s >> len(sizes) for s in y.shape)
        a = y[:n, :m]
        a = np.concatenate([a[0::2] + a[1::2], a[0::2] - a[1::2]]) / np.sqrt(2)
        y[:n, :m] = np.concatenate([a[:, 0::2] + a[:, 1::2], a[:, 0::2] - a[:, 1::2]], axis=1) / np.sqrt(2)
        sizes.append((n, m))
    keep = max(1, int(y.size / ratio))
    y[np.abs(y) < np.partition(np.abs(y).ravel(), -keep)[-keep]] = 0
    for n, m in reversed(sizes):
        a = y[:n, :m]
        b = np.empty_like(a)
        b[:, 0::2], b[:, 1::2] = (a[:, : m // 2] + a[:, m // 2 :]) / np.sqrt(2), (a[:, : m // 2] - a[:, m // 2 :]) / np.sqrt(2)
        y[0:n:2, :m], y[1:n:2, :m] = (b[: n // 2] + b[n // 2 :]) / np.sqrt(2), (b[: n // 2] - b[n // 2 :]) / np.sqrt(2)
    return clip01(y[:h, :w])


def degrade(x: np.ndarray, name: str, value: float | None, mask: np.ndarray, sigma0: float, seed: int, variant: str = "evaluation") -> np.ndarray:
    if name in ("clean", "none"):
        return x.astype(np.float32).copy()
    if name == "noise":
        return dose_noise(x, value, sigma0, seed, variant)
    if name in ("blur", "motion_blur"):
        return motion_blur(x, int(value), variant=variant)
    if name == "contrast":
        return reduce_contrast(x, value, mask, variant=variant)
    if name == "jpeg2000":
        return jpeg2000(x, value)
    if name == "wavelet_quant":
        return wavelet_quant(x, value)
    if name == "resolution":
        return reduce_resolution(x, value, variant)
    raise ValueError(f"unknown degradation {name!r}")


def difference_map(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask, np.abs(a - b), 0).astype(np.float32)


# --- quality


def noise_variance(x: np.ndarray, b: tuple[int, int, int, int] | None) -> float:
    return float(np.var(x[b[1] : b[3], b[0] : b[2]])) if b else float("nan")


def tenengrad(x: np.ndarray, mask: np.ndarray | None = None) -> float:
    gx, gy = sobel(x.astype(np.float64))
    g = gx**2 + gy**2
    return float(g[mask].mean() if mask is not None and mask.any() else g.mean())


def ssim_map(a: np.ndarray, b: np.ndarray, size: int = 7) -> np.ndarray:
    """Structural similarity for a data range of 1, with sample covariances over size x size."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    n = size * size
    ma, mb = box_mean(a, size), box_mean(b, size)
    va, vb, vab = (n / (n - 1) * (box_mean(p * q, size) - mp * mq) for p, q, mp, mq in ((a, a, ma, ma), (b, b, mb, mb), (a, b, ma, mb)))
    c1, c2 = 0.01**2, 0.03**2
    return (2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))


def ssim_full(a: np.ndarray, b: np.ndarray) -> float:
    """Over the whole canvas, without a border of three."""
    return mean_inside(ssim_map(a, b))


def mean_inside(m: np.ndarray) -> float:
    return float(m[3:-3, 3:-3].mean())


def ssim_crop(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> float:
    """Over the mask's extent, with pixels outside the mask 0."""
    if not mask.any():
        return ssim_full(a, b)
    x1, y1, x2, y2 = crop_box(mask, 0)
    return ssim_full(*((v * mask)[y1:y2, x1:x2] for v in (a, b)))


def ssim_masked(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> float:
    """The map's mean over the mask."""
    return mean_over(ssim_map(a, b), mask)


def mean_over(m: np.ndarray, mask: np.ndarray) -> float:
    return float(m[mask].mean() if mask.any() else m.mean())


_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def _inner(mask: np.ndarray) -> np.ndarray:
    """Of the pixels not on the border: those whose neighbours are all in the mask."""
    h, w = mask.shape
    return np.logical_and.reduce([mask[1 + i : h - 1 + i, 1 + j : w - 1 + j] for i, j in [(0, 0), *_AROUND]])


def _weighted_threshold(values: np.ndarray, grid: np.ndarray) -> float:
    """The mean of grid, each threshold weighted by how many values exceed it; 0 if none does."""
    over = len(values) - np.searchsorted(np.sort(values), grid, side="right")
    return float((grid * over).sum() / over.sum()) if over.sum() else 0.0


def tau_nms(x: np.ndarray, mask: np.ndarray | None = None, steps: int = 2000) -> float:
    """Mean threshold below which pixels differ from all eight neighbours, on a grid over the range of the region."""
    x = x.astype(np.float32)
    h, w = x.shape
    c = x[1:-1, 1:-1]
    d = np.minimum.reduce([np.abs(c - x[1 + i : h - 1 + i, 1 + j : w - 1 + j]) for i, j in _AROUND]) if min(h, w) > 2 else np.zeros((0, 0), np.float32)
    d = d[_inner(mask)] if mask is not None else d.ravel()
    region = x[mask] if mask is not None else x.ravel()
    if not len(d) or not len(region):
        return float("nan")
    top = float(region.max() - region.min())
    return _weighted_threshold(d.astype(np.float64), np.arange(1, steps + 1) * (top / steps)) if top > 0 else 0.0


def tau_extrema(x: np.ndarray, mask: np.ndarray | None = None, diagonal: bool = True, most: int = 1000) -> float:
    """The same over heights of local extrema, on a grid from 0 whose step is the least height if that fits."""
    x = x.astype(np.float64)
    h, w = x.shape
    around = [p for p in _AROUND if diagonal or 0 in p]
    c = x[1:-1, 1:-1]
    gaps = [c - x[1 + i : h - 1 + i, 1 + j : w - 1 + j] for i, j in around]
    height = np.clip(np.minimum.reduce(gaps), 0, None) - np.clip(np.maximum.reduce(gaps), None, 0)
    v = height[_inner(mask)] if mask is not None else height.ravel()
    v = v[v > 0]
    if not len(v):
        return 0.0
    n = int(np.ceil(v.max() / v.min())) + 1
    return _weighted_threshold(v, v.min() * np.arange(n) if n <= most else v.max() / (most - 1) * np.arange(most))


def contrast_iqr(x: np.ndarray, mask: np.ndarray) -> float:
    v = x[mask].astype(np.float64)
    return float(np.subtract(*np.percentile(v, [75, 25]))) if len(v) >= 4 else float("nan")


def cnr_parts(x: np.ndarray, lesion: np.ndarray, around: np.ndarray) -> tuple[float, float, float, int]:
    """Mean in the lesion; mean, deviation and number of pixels around it."""
    if not lesion.any() or not around.any():
        return (float("nan"),) * 3 + (0,)
    return float(x[lesion].mean()), float(x[around].mean()), float(x[around].std()), int(around.sum())


def cnr(x: np.ndarray, lesion: np.ndarray, around: np.ndarray, variant: str = "evaluation") -> tuple[float, float]:
    """Contrast-to-noise ratio and contrast; without noise infinite for the toolkit, else steadied by 1e-8."""
    a, b, s, _ = cnr_parts(x, lesion, around)
    gap = abs(a - b)
    if variant == "toolkit":
        return (gap / s if s > 0 else float("inf") if gap == gap else gap), gap
    return gap / (s + 1e-8), gap


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    e = float(np.mean((a.astype(np.float64) - b) ** 2))
    return float("inf") if e == 0 else 10 * np.log10(1 / e)


METRICS: dict[str, Callable] = {"noise_var": noise_variance, "tenengrad": tenengrad, "ssim": ssim_masked, "tau": tau_extrema, "contrast_iqr": contrast_iqr}
