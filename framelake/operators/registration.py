"""Registration of frames: point matches, homographies, lens distortion, warps. Numpy kernels for Arrow functions."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from framelake.operators.ridges import filter_axis

Matcher = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
MATCHERS: dict[str, Matcher] = {}


def register_matcher(name: str) -> Callable[[Matcher], Matcher]:
    """Adds a matcher: two BGR images -> two (N, 2) arrays of matching x, y."""

    def add(f: Matcher) -> Matcher:
        MATCHERS[name] = f
        return f

    return add


def gray(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.114, 0.587, 0.299])


def corners(plane: np.ndarray, most: int = 600, border: int = 12) -> np.ndarray:
    """Harris corners as x, y, strongest first, one for each 5 x 5 neighbourhood."""
    box = np.ones(5) / 5
    gx, gy = filter_axis(plane, np.array([-1, 0, 1.0]), 1), filter_axis(plane, np.array([-1, 0, 1.0]), 0)
    xx, yy, xy = (filter_axis(filter_axis(p, box, 0), box, 1) for p in (gx * gx, gy * gy, gx * gy))
    score = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(score, 2, constant_values=-np.inf), (5, 5)).max(axis=(2, 3))
    ok = (score == windows) & (score > 1e-4 * max(score.max(), 1e-12))
    ok[:border], ok[-border:], ok[:, :border], ok[:, -border:] = False, False, False, False
    y, x = np.nonzero(ok)
    order = np.argsort(-score[y, x], kind="stable")[:most]
    return np.stack([x[order], y[order]], axis=1)


def descriptors(plane: np.ndarray, points: np.ndarray, half: int = 8) -> np.ndarray:
    """Standardised patches around points."""
    span = np.arange(-half, half + 1)
    patch = plane[points[:, 1, None, None] + span[:, None], points[:, 0, None, None] + span[None, :]].reshape(len(points), -1)
    patch = patch - patch.mean(axis=1, keepdims=True)
    return patch / np.maximum(np.sqrt((patch * patch).sum(axis=1, keepdims=True)), 1e-9)


@register_matcher("harris")
def harris_matches(a: np.ndarray, b: np.ndarray, ratio: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Corners whose nearest patch is nearer than ``ratio`` times the second nearest."""
    pa, pb = gray(a), gray(b)
    ca, cb = corners(pa), corners(pb)
    if len(ca) < 1 or len(cb) < 2:
        return np.empty((0, 2), int), np.empty((0, 2), int)
    distance = np.sqrt(np.maximum(2 - 2 * descriptors(pa, ca) @ descriptors(pb, cb).T, 0))
    two = np.argpartition(distance, 1, axis=1)[:, :2]
    d = np.take_along_axis(distance, two, axis=1)
    first = d.argmin(axis=1)
    best, second = np.min(d, axis=1), np.max(d, axis=1)
    ok = best < ratio * second
    return ca[ok], cb[two[np.arange(len(ca)), first][ok]]


def match_images(a: np.ndarray, b: np.ndarray, method: str = "harris") -> tuple[np.ndarray, np.ndarray]:
    if method not in MATCHERS:
        raise ValueError(f"unknown matcher {method}; registered: {', '.join(sorted(MATCHERS))}")
    return MATCHERS[method](a, b)


def thin(source: np.ndarray, target: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The match nearest to the centre of each grid cell of the source."""
    if not len(source):
        return source, target
    cell = np.floor(source / size)
    offset = ((source - (cell + 0.5) * size) ** 2).sum(axis=1)
    order = np.lexsort((np.arange(len(source)), offset, cell[:, 1], cell[:, 0]))
    ordered = cell[order]
    first = order[np.append(True, (np.diff(ordered, axis=0) != 0).any(axis=1))]
    return source[np.sort(first)], target[np.sort(first)]


def project(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    q = np.column_stack([points, np.ones(len(points))]) @ h.T
    w = np.where(q[:, 2] == 0, 1e-10, q[:, 2])
    return q[:, :2] / w[:, None]


def direct_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Least-squares homography of at least four points, on normalised coordinates."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s = p.mean(axis=0), max(np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1)).mean() / np.sqrt(2), 1e-9)
        t = np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])
        return (p - c) / s, t

    (a, ta), (b, tb) = scaled(np.asarray(source, float)), scaled(np.asarray(target, float))
    x, y, u, v, one, zero = a[:, 0], a[:, 1], b[:, 0], b[:, 1], np.ones(len(a)), np.zeros(len(a))
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], axis=1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], axis=1)])
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def estimate_homography(source: np.ndarray, target: np.ndarray, near: float = 10, rounds: int = 500, seed: str = "") -> tuple[np.ndarray | None, np.ndarray]:
    """Homography with most points within ``near``, refined on these; None for fewer than four points. Seeded."""
    source, target = np.asarray(source, float), np.asarray(target, float)
    none = np.zeros(len(source), bool)
    if len(source) < 4:
        return None, none
    rng = np.random.default_rng(zlib.crc32(seed.encode()))
    best, inliers = None, none
    for _ in range(rounds):
        own = rng.choice(len(source), 4, replace=False)
        h = direct_homography(source[own], target[own])
        if h is None or not np.isfinite(h).all():
            continue
        ok = np.hypot(*(project(h, source) - target).T) <= near
        if ok.sum() > inliers.sum():
            best, inliers = h, ok
            if ok.mean() > 0.99:
                break
    for _ in range(3):
        if best is None or inliers.sum() < 4:
            break
        best = direct_homography(source[inliers], target[inliers])
        inliers = np.hypot(*(project(best, source) - target).T) <= near
    return best, inliers


def rmse(h: np.ndarray, source: np.ndarray, target: np.ndarray) -> float:
    return float(np.sqrt((np.hypot(*(project(h, source) - target).T) ** 2).mean())) if len(source) else float("inf")


def distort(points: np.ndarray, k: np.ndarray, width: int, height: int) -> np.ndarray:
    """The lens model of ``framelake.functions.geometry.distort`` on arrays."""
    k1, k2, k3, p1, p2, k4, k5, k6 = k
    f, c = max(width, height), np.array([width / 2, height / 2])
    u, v = ((np.asarray(points, float) - c) / f).T
    r = u * u + v * v
    radial = (1 + k1 * r + k2 * r**2 + k3 * r**3) / (1 + k4 * r + k5 * r**2 + k6 * r**3)
    return np.stack([u * radial + 2 * p1 * u * v + p2 * (r + 2 * u * u), v * radial + p1 * (r + 2 * v * v) + 2 * p2 * u * v], axis=1) * f + c


def simplex(cost: Callable[[np.ndarray], float], start: np.ndarray, size: np.ndarray, rounds: int = 2000, close: float = 1e-7) -> np.ndarray:
    """Downhill simplex search."""
    points = [start] + [start + size * (np.arange(len(start)) == i) for i in range(len(start))]
    values = [cost(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < close:
            break
        center = np.mean(points[:-1], axis=0)
        turned = 2 * center - points[-1]
        value = cost(turned)
        if value < values[0]:
            far = 3 * center - 2 * points[-1]
            points[-1], values[-1] = min(((far, cost(far)), (turned, value)), key=lambda x: x[1])
        elif value < values[-2]:
            points[-1], values[-1] = turned, value
        else:
            half = (center + (turned if value < values[-1] else points[-1])) / 2
            if (v := cost(half)) < min(value, values[-1]):
                points[-1], values[-1] = half, v
            else:
                points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
                values = [values[0]] + [cost(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def estimate_distortion(pairs: list[tuple[np.ndarray, np.ndarray]], width: int, height: int, least_each: int = 10, least: int = 30, gain: float = 0.1) -> np.ndarray | None:
    """Lens parameters under which the pairs' homographies fit best; None for too few matches or no gain in the mean error."""
    pairs = [(np.asarray(a, float), np.asarray(b, float)) for a, b in pairs if len(a) >= least_each]
    if sum(len(a) for a, _ in pairs) < least:
        return None

    def cost(k: np.ndarray) -> float:
        if np.abs(k).max() > 1:
            return 1e6
        errors = []
        for a, b in pairs:
            p = distort(a, k, width, height)
            h = direct_homography(p, b)
            errors.append(1e6 if h is None else rmse(h, p, b))
        return float(np.mean(errors))

    zero = np.zeros(8)
    found = simplex(cost, zero, np.array([0.05, 0.02, 0.01, 0.002, 0.002, 0.02, 0.01, 0.01]))
    return found if cost(zero) - cost(found) >= gain else None


def warp(image: np.ndarray, h: np.ndarray, width: int, height: int, nearest: bool = False, lens: np.ndarray | None = None) -> np.ndarray:
    """The image (or mask) seen in the target's coordinates: each target pixel looks up its source; 0 outside.

    With lens parameters, h takes distortion-corrected source points to the
    target; the correction is undone by the negated parameters.
    """
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    points = project(np.linalg.inv(h), np.stack([x.ravel(), y.ravel()], axis=1).astype(float))
    if lens is not None:
        points = distort(points, -lens, image.shape[1], image.shape[0])
    px, py = points.T
    plane = image[..., None] if image.ndim == 2 else image
    rows, cols = plane.shape[:2]
    if nearest:
        ix, iy = np.rint(px).astype(int), np.rint(py).astype(int)
        ok = (ix >= 0) & (ix < cols) & (iy >= 0) & (iy < rows)
        out = np.zeros((height * width, plane.shape[2]), plane.dtype)
        out[ok] = plane[iy[ok], ix[ok]]
    else:
        x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
        fx, fy = (px - x0)[:, None], (py - y0)[:, None]
        total = np.zeros((height * width, plane.shape[2]))
        for dy, wy in ((0, 1 - fy), (1, fy)):
            for dx, wx in ((0, 1 - fx), (1, fx)):
                ix, iy = x0 + dx, y0 + dy
                ok = (ix >= 0) & (ix < cols) & (iy >= 0) & (iy < rows)
                total[ok] += (plane[iy[ok], ix[ok]] * wx[ok]) * wy[ok]
        out = np.rint(total).astype(plane.dtype) if plane.dtype != bool else total > 0.5
    return out.reshape(height, width, plane.shape[2])[..., 0] if image.ndim == 2 else out.reshape(height, width, -1)


def warp_line(line: np.ndarray, h: np.ndarray, width: int, height: int) -> np.ndarray:
    """A ridge in the target's coordinates: the top of a band two pixels either side."""
    mask = np.zeros((height, len(line)), bool)
    cols = np.flatnonzero(line >= 0)
    for d in range(-2, 3):
        y = line[cols] + d
        ok = (y >= 0) & (y < height)
        mask[y[ok], cols[ok]] = True
    moved = warp(mask, h, width, height, nearest=True)
    return np.where(moved.any(axis=0), moved.argmax(axis=0) + 2, -1).astype(np.int32)
