"""NumPy kernels for one frame or one pair of frames. They hold no state, and run inside
Arrow or pandas functions, one frame per row."""

from __future__ import annotations

import numpy as np

from lapsegrid.functions import runs


#: Taps up to which a filter is added up shift by shift.
FEW_TAPS = 25
#: Pixels up to which a graph's matrix is solved whole.
DENSE = 600


# -- smoothing ------------------------------------------------------------
def _taps(sigma: float) -> np.ndarray:
    r = max(1, int(np.ceil(4 * sigma)))
    x = np.arange(-r, r + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def _along(image: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Correlate along an axis, with mirrored borders (also where taps exceed the image). Few taps are
    added up shift by shift, many go through a Fourier transform."""
    r, n = len(taps) // 2, image.shape[axis]
    width = [(0, 0)] * image.ndim
    width[axis] = (r, r)
    wide = np.moveaxis(np.pad(image.astype(np.float64), width, mode="symmetric"), axis, 0)
    if len(taps) <= FEW_TAPS:
        out = sum(t * wide[k : k + n] for k, t in enumerate(taps.tolist()))
    else:
        size = n + 4 * r
        spectrum = np.fft.rfft(wide, size, axis=0)
        spectrum *= np.fft.rfft(taps[::-1], size).reshape(-1, *[1] * (image.ndim - 1))
        out = np.fft.irfft(spectrum, size, axis=0)[2 * r : 2 * r + n]
    return np.moveaxis(out, 0, axis)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable FIR Gaussian. sigma 0 leaves the image as it is."""
    if sigma <= 0:
        return image.astype(np.float64)
    taps = _taps(sigma)
    return _along(_along(image, taps, 0), taps, 1)


def subtract_background(image: np.ndarray, sigma: float = 40.0, truncate: bool = True) -> np.ndarray:
    """Pixel minus the smoothed frame, at least 0; whole numbers unless truncate is off."""
    out = np.maximum(image - gaussian(image, sigma), 0)
    return np.floor(out + 1e-9).astype(np.int64) if truncate else out


def laplacian_of_gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    taps = _taps(sigma)
    x = np.arange(len(taps)) - len(taps) // 2
    second = taps * (x**2 / sigma**4 - 1 / sigma**2)
    second -= second.mean()
    return _along(_along(image, second, 1), taps, 0) + _along(_along(image, second, 0), taps, 1)


def inside_distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each foreground pixel to the nearest background pixel; height plus
    width where there is none. Exact: distances along columns, then the least over shifts along rows,
    which end at the largest distance found."""
    h, w = mask.shape
    far = float(h + w)
    if mask.all():
        return np.full(mask.shape, far)
    column = np.where(mask, far, 0.0)
    for y in range(1, h):
        column[y] = np.minimum(column[y], column[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        column[y] = np.minimum(column[y], column[y + 1] + 1)
    own = column**2
    best = own.copy()
    for d in range(1, w):
        if d * d >= best.max():
            break
        np.minimum(best[:, d:], own[:, :-d] + d * d, out=best[:, d:])
        np.minimum(best[:, :-d], own[:, d:] + d * d, out=best[:, :-d])
    return np.where(mask, np.sqrt(best), 0.0)


def seed_response(image: np.ndarray, mask: np.ndarray, least: int = 15, most: int = 25) -> np.ndarray:
    """Largest scale-normalised negative Laplacian over the radii, at least 0, times the
    distance inside the mask; 0 outside."""
    best = np.zeros(image.shape)
    for r in range(least, most + 1):
        sigma = r / np.sqrt(2)
        best = np.maximum(best, -(sigma**2) * laplacian_of_gaussian(image, sigma))
    return np.where(mask, best * inside_distance(mask), 0.0)


# -- components -----------------------------------------------------------
def components(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Label of each foreground pixel: 1 + the smallest raster index of its component; 0 outside. Linear in pixels and runs."""
    own = runs.runs_of(np.asarray(mask).astype(np.int8), corners=connectivity == 8)
    return runs.drawn(own, own.part + 1, *mask.shape)


def sizes(label: np.ndarray) -> dict[int, int]:
    own, n = np.unique(label[label > 0], return_counts=True)
    return dict(zip(own.tolist(), n.tolist(), strict=True))


def keep_components(mask: np.ndarray, least: int = 0, most: int = 0, exact: bool = False) -> np.ndarray:
    """Foreground of 8-connected components of at least ``least`` and, if ``most`` > 0, fewer
    than ``most`` pixels. exact keeps the smallest of the too large ones unless all are too large."""
    label = components(mask)
    own = {k: n for k, n in sizes(label).items() if n >= least}
    if most > 0:
        large = sorted((k for k, n in own.items() if n >= most), key=lambda k: (-own[k], k))
        drop = large[:-1] if exact and large and len(large) < len(own) else large
        own = {k: n for k, n in own.items() if k not in drop}
    return np.isin(label, list(own)) & mask


def clean_labels(label: np.ndarray) -> np.ndarray:
    """Each label reduced to its largest 4-connected part, the first of equal ones. All labels are looked at together."""
    own = runs.runs_of(np.asarray(label), corners=False)
    size = np.bincount(own.part, own.x1 - own.x0 + 1, minlength=label.size)
    order = np.lexsort((own.part, -size[own.part], own.v))
    first = order[np.r_[True, own.v[order][1:] != own.v[order][:-1]][: len(order)]]
    best = np.zeros(label.size, dtype=bool)
    best[own.part[first]] = True
    return runs.drawn(own, np.where(best[own.part], own.v, 0), *label.shape).astype(label.dtype)


def sliding_max(image: np.ndarray, r: int) -> np.ndarray:
    """Greatest value within r rows and columns; what lies outside counts for nothing. Along each axis from maxima of blocks
    of the window's width, from their beginnings and ends: three looks at a pixel, whatever the width."""
    out = image.astype(np.float64)
    k = 2 * r + 1
    for axis in (0, 1):
        lines = np.moveaxis(out, axis, 0)
        n = len(lines)
        blocks = -(-(n + 2 * r) // k)
        wide = np.full((blocks * k, lines.shape[1]), -np.inf)
        wide[r : r + n] = lines
        cut = wide.reshape(blocks, k, -1)
        ahead = np.maximum.accumulate(cut, axis=1).reshape(wide.shape)
        behind = np.maximum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].reshape(wide.shape)
        out = np.moveaxis(np.maximum(behind[:n], ahead[k - 1 : k - 1 + n]), 0, axis)
    return np.ascontiguousarray(out)


def local_maxima(image: np.ndarray, window: int = 7) -> list[tuple[int, int]]:
    """(x, y) of pixels above zero that exceed all others within the window; a band of
    window + 1 at the border has none."""
    h, w = image.shape
    top = (image > 0) & (image >= sliding_max(image, window))
    out = []
    for y, x in np.argwhere(top).tolist():
        if window < x < w - window - 1 and window < y < h - window - 1:
            near = image[y - window : y + window + 1, x - window : x + window + 1]
            if (near == image[y, x]).sum() == 1:
                out.append((x, y))
    return out


# -- registration ---------------------------------------------------------
def box_sum(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums over all h x w windows that overlap the image, zeros outside ("full" size)."""
    wide = np.pad(image.astype(np.float64), ((h, h - 1), (w, w - 1)))
    total = wide.cumsum(0).cumsum(1)
    return total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w]


def ncc(image: np.ndarray, pattern: np.ndarray, exact: bool = False) -> np.ndarray:
    """Normalised cross-correlation with a pattern, in 0..1, at the size of the image.
    exact divides the local spread by the padded area instead of the pattern's."""
    h, w = pattern.shape
    full = (image.shape[0] + h - 1, image.shape[1] + w - 1)
    product = np.fft.irfft2(np.fft.rfft2(image, full) * np.fft.rfft2(pattern[::-1, ::-1], full), full)
    s1, s2 = box_sum(image, h, w), box_sum(image.astype(np.float64) ** 2, h, w)
    spread = np.sqrt(((pattern - pattern.mean()) ** 2).sum())
    area = full[0] * full[1] if exact else h * w
    local = np.sqrt(np.maximum(s2 - s1**2 / area, 0))
    out = 0.5 + (product - s1 * pattern.mean()) / (2 * max(spread, 1e-12) * np.maximum(local, max(spread, 1e-12) / 1e5))
    y, x = (h - 1) // 2, (w - 1) // 2
    return out[y : y + image.shape[0], x : x + image.shape[1]]


def drift(before: np.ndarray, after: np.ndarray) -> tuple[int, int]:
    """(dx, dy) to store: minus the motion of the content, by circular correlation; the
    first maximum in raster order wins."""
    match = np.fft.irfft2(np.fft.rfft2(after) * np.conj(np.fft.rfft2(before)), before.shape)
    y, x = np.unravel_index(np.argmax(np.round(match, 6)), match.shape)
    h, w = before.shape
    return -int(x if x <= w // 2 else x - w), -int(y if y <= h // 2 else y - h)


def crop(image: np.ndarray, cx: int, cy: int, size: int) -> np.ndarray:
    """size x size window around (cx, cy); zeros outside the frame."""
    half = (size - 1) // 2
    out = np.zeros((size, size), dtype=image.dtype)
    y0, x0 = cy - half, cx - half
    ys, xs = slice(max(0, y0), min(image.shape[0], y0 + size)), slice(max(0, x0), min(image.shape[1], x0 + size))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys.start - y0 : ys.stop - y0, xs.start - x0 : xs.stop - x0] = image[ys, xs]
    return out


# -- splitting ------------------------------------------------------------
def pixel_graph(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of each foreground pixel in raster order, as places (n, 9) and weights (n, 9):
    itself 1, a side neighbour exp(-1/4), a diagonal one exp(-1/2), none 0."""
    ys, xs = np.nonzero(mask)
    place = np.full((mask.shape[0] + 2, mask.shape[1] + 2), -1)
    place[ys + 1, xs + 1] = np.arange(len(ys))
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    near = np.stack([place[ys + 1 + dy, xs + 1 + dx] for dy, dx in steps], axis=1)
    weight = np.where(near >= 0, np.exp(-np.array([dy * dy + dx * dx for dy, dx in steps]) / 4.0), 0.0)
    return np.maximum(near, 0), weight, np.stack([ys, xs], axis=1)


def leading_vectors(near: np.ndarray, weight: np.ndarray, k: int, seed: int = 0, blocks: int = 120) -> np.ndarray:
    """Eigenvectors (n, k) of the k largest eigenvalues of the symmetric matrix with these entries, by
    block Lanczos with full reorthogonalisation; small matrices are solved whole. Memory is linear in n."""
    n = len(near)
    if n <= DENSE:
        whole = np.zeros((n, n))
        np.add.at(whole, (np.repeat(np.arange(n), near.shape[1]), near.ravel()), weight.ravel())
        return np.linalg.eigh(whole)[1][:, -k:]
    times = lambda v: (weight[:, :, None] * v[near]).sum(axis=1)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, k)))[0]
    image = times(basis)
    last = None
    for step in range(1, blocks + 1):
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        if last is not None and np.abs(values[-k:] - last).max() < 1e-13 and step > 8:
            break
        last = values[-k:]
        new = image[:, -k:] - basis @ (basis.T @ image[:, -k:])
        new -= basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        if np.abs(np.diag(r)).max() < 1e-10:
            break
        basis, image = np.hstack([basis, q]), np.hstack([image, times(q)])
    small = basis.T @ image
    return basis @ np.linalg.eigh((small + small.T) / 2)[1][:, -k:]


def spectral_split(mask: np.ndarray, k: int, least: int = 50, seed: int = 0) -> np.ndarray:
    """Labels 1..k of the foreground by normalised spectral clustering of the pixel graph
    (self 1, side neighbours exp(-1/4), diagonal exp(-1/2)). k = 1 is the whole mask; fewer
    than ``least`` pixels give zeros."""
    out = np.zeros(mask.shape, dtype=np.int64)
    if k == 1:
        out[mask] = 1
        return out
    near, weight, at = pixel_graph(mask)
    if len(at) < max(least, k):
        return out
    root = 1 / np.sqrt(weight.sum(axis=1))
    vectors = leading_vectors(near, weight * root[:, None] * root[near], k, seed)
    points = vectors * root[:, None]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    out[at[:, 0], at[:, 1]] = 1 + kmeans(points, k, seed)
    return out


def kmeans(points: np.ndarray, k: int, seed: int = 0, tries: int = 10, rounds: int = 50) -> np.ndarray:
    """Seeded Lloyd iterations from ``tries`` spread starts; the best total distance wins."""
    rnd, best = np.random.default_rng(seed), None
    for _ in range(tries):
        centre = points[[rnd.integers(len(points))]]
        while len(centre) < k:
            away = ((points[:, None] - centre[None]) ** 2).sum(-1).min(1)
            centre = np.vstack([centre, points[rnd.choice(len(points), p=away / away.sum()) if away.sum() > 0 else rnd.integers(len(points))]])
        for _ in range(rounds):
            own = ((points[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
            new = np.stack([points[own == j].mean(0) if (own == j).any() else centre[j] for j in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        cost = ((points - centre[own]) ** 2).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, own)
    return best[1]


def assign(weight: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) of greatest total weight; all of the smaller side is
    paired. Shortest augmenting paths, O(n^3)."""
    if weight.size == 0:
        return []
    turned = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if turned else weight)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in pairs) if turned else sorted(pairs)


# -- intensity k-means and multi-level response (optional stages) ----------
def intensity_kmeans(values: np.ndarray, k: int = 3, rounds: int = 100) -> np.ndarray:
    """Class 0..k-1 of each value, by ascending centre; starts at quantiles."""
    centre = np.quantile(values, (np.arange(k) + 0.5) / k)
    for _ in range(rounds):
        own = np.abs(values[..., None] - centre).argmin(-1)
        new = np.array([values[own == j].mean() if (own == j).any() else centre[j] for j in range(k)])
        if np.allclose(new, centre):
            break
        centre = new
    return np.argsort(np.argsort(centre))[own]


def level_response(image: np.ndarray, mask: np.ndarray, levels: int = 10) -> np.ndarray:
    """Sum over levels, from the least value of the mask up, of the smoothed inside distance of the level set, each
    component scaled to 1."""
    out = np.zeros(image.shape)
    if not mask.any():
        return out
    low, high = image[mask].min(), image[mask].max()
    for t in np.linspace(low, high, levels, endpoint=False):
        level = mask & (image >= t)
        d = gaussian(inside_distance(level), 1.0)
        label = components(level)
        peak = np.zeros(image.size + 1)
        np.maximum.at(peak, label.ravel(), d.ravel())
        out += np.where(level, d / np.maximum(peak[label], 1e-12), 0.0)
    return out


def association(mask: np.ndarray, effector: np.ndarray, reach: int = 10) -> float:
    """Ring-weighted effector signal around a mask over the whole effector signal."""
    away = inside_distance(~mask)
    weight = np.zeros(mask.shape)
    for r in range(1, reach + 1):
        weight += ((away > 0) & (away <= r)) / r**2
    total = effector.sum()
    return float((weight * effector).sum() / total) if total else 0.0
