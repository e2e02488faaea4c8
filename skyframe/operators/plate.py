"""Solving frames: extraction, pattern and pair matching, tangent-plane fit, statistical gate.

Everything here works on one frame at a time in numpy; ``plans.solve`` runs it over many
frames. Sets are bounded: at most 500 detections and 5000 catalogue stars of a frame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .geometry import components
from .quads import canonical_codes, point_patterns


@dataclass
class Solution:
    """Tangent-plane solution; pixels count from 0."""

    crval: np.ndarray
    crpix: np.ndarray
    cd: np.ndarray

    def to_sky(self, x, y):
        return from_plane(*(self.cd @ np.stack([np.asarray(x, float) - self.crpix[0], np.asarray(y, float) - self.crpix[1]])), *self.crval)

    def to_pixel(self, ra, dec):
        """NaN for places on or behind the horizon."""
        return np.linalg.solve(self.cd, np.stack(to_plane(ra, dec, *self.crval))) + self.crpix[:, None]

    @property
    def scale(self) -> float:
        return math.sqrt(abs(np.linalg.det(self.cd))) * 3600.0

    @property
    def parity(self) -> str:
        return "normal" if np.linalg.det(self.cd) < 0 else "mirrored"

    @property
    def orientation(self) -> float:
        return math.degrees(math.atan2(self.cd[0, 1], self.cd[1, 1])) % 360.0

    def full_frame(self, factor: int) -> Solution:
        return Solution(self.crval, self.crpix * factor + (factor - 1) / 2, self.cd / factor)


def separation(ra1, dec1, ra2, dec2):
    h = np.sin(np.radians(dec2 - dec1) / 2) ** 2 + np.cos(np.radians(dec1)) * np.cos(np.radians(dec2)) * np.sin(np.radians(ra2 - ra1) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.minimum(1, np.sqrt(h))))


def to_plane(ra, dec, ra0, dec0):
    dr, d, d0 = np.radians(np.asarray(ra, float) - ra0), np.radians(np.asarray(dec, float)), math.radians(dec0)
    depth = math.sin(d0) * np.sin(d) + math.cos(d0) * np.cos(d) * np.cos(dr)
    depth = np.where(depth > 1e-12, depth, np.nan)
    return np.degrees(np.cos(d) * np.sin(dr) / depth), np.degrees((math.cos(d0) * np.sin(d) - math.sin(d0) * np.cos(d) * np.cos(dr)) / depth)


def from_plane(xi, eta, ra0, dec0):
    x, y, d0 = np.radians(xi), np.radians(eta), math.radians(dec0)
    along = math.cos(d0) - y * math.sin(d0)
    return (ra0 + np.degrees(np.arctan2(x, along))) % 360.0, np.degrees(np.arctan2(math.sin(d0) + y * math.cos(d0), np.hypot(x, along)))


# ---- extraction ---------------------------------------------------------------------------


@dataclass
class ExtractParams:
    k_sigma: float = 5.0
    min_pix: int = 4
    filter_sigma: float = 0.0
    size_factor: float = 25.0
    max_ellipticity: float = 0.6
    margin: int = 8
    keep: int = 500
    saturation: float = 65535 * 0.999
    tile: int = 96


def background(px: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Level and noise at every pixel, from medians of tiles, bilinear between their centres."""
    ny, nx = px.shape
    ty, tx = -(-ny // tile), -(-nx // tile)
    level, noise = np.empty((ty, tx)), np.empty((ty, tx))
    for i in range(ty):
        for j in range(tx):
            v = np.sort(px[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile], axis=None)
            level[i, j] = v[len(v) // 2]
            noise[i, j] = max(1e-3, v[len(v) // 2] - v[len(v) * 1587 // 10000]) if len(v) >= 8 else 1.0

    def spread(grid):
        cy = np.clip((np.arange(ny) + 0.5) / tile - 0.5, 0, ty - 1)
        cx = np.clip((np.arange(nx) + 0.5) / tile - 0.5, 0, tx - 1)
        y0, x0 = cy.astype(int), cx.astype(int)
        y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
        dy, dx = (cy - y0)[:, None], (cx - x0)[None, :]
        rows = grid[y0] * (1 - dy) + grid[y1] * dy
        return rows[:, x0] * (1 - dx) + rows[:, x1] * dx

    return spread(level), spread(noise)


def smooth(px: np.ndarray, sigma: float) -> tuple[np.ndarray, float]:
    """Separable Gaussian with repeated edges, and its factor on the threshold (sum of squared weights)."""
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-((np.arange(2 * r + 1) - r) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(px, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        px = sum(w * np.take(padded, range(i, i + px.shape[axis]), axis=axis) for i, w in enumerate(k))
    return px, float((k * k).sum())


@dataclass
class Stars:
    x: np.ndarray
    y: np.ndarray
    flux: np.ndarray
    peak: np.ndarray
    npix: np.ndarray
    fwhm: np.ndarray
    ellipticity: np.ndarray
    theta: np.ndarray
    rejected: dict = field(default_factory=dict)
    detected: int = 0

    def __len__(self):
        return len(self.x)

    def take(self, at):
        return Stars(*[getattr(self, k)[at] for k in ("x", "y", "flux", "peak", "npix", "fwhm", "ellipticity", "theta")], self.rejected, self.detected)


def extract(px: np.ndarray, p: ExtractParams) -> Stars:
    """Stars of an image, strongest first, and counts of the rejected blobs."""
    ny, nx = px.shape
    level, noise = background(px, max(8, p.tile))
    if p.filter_sigma > 0:
        soft, factor = smooth(px - level, p.filter_sigma)
        mask = soft > p.k_sigma * noise * factor
    else:
        mask = px > level + p.k_sigma * noise
    ys, xs, label = components(mask)
    n = int(label.max()) + 1 if len(label) else 0
    w = np.maximum(px[ys, xs] - level[ys, xs], 0.0)
    total = lambda v: np.bincount(label, v, n)
    npix, s = np.bincount(label, minlength=n), total(w)
    peak = np.zeros(n)
    np.maximum.at(peak, label, px[ys, xs])
    near = (xs < p.margin) | (ys < p.margin) | (xs + p.margin >= nx) | (ys + p.margin >= ny)
    edge = total(near) > 0
    big = np.sort(npix[npix >= p.min_pix])
    limit = max((max(1, big[len(big) // 2]) if len(big) else 1) * p.size_factor, 4.0 * p.min_pix)
    with np.errstate(divide="ignore", invalid="ignore"):
        cx, cy = total(xs * w) / s, total(ys * w) / s
        mxx, myy = (np.maximum(0, total(v * v * w) / s - c * c) for v, c in ((xs.astype(float), cx), (ys.astype(float), cy)))
        mxy = total(xs.astype(float) * ys * w) / s - cx * cy
        common = np.sqrt(np.maximum(0, (mxx - myy) ** 2 / 4 + mxy * mxy))
        a, b = np.sqrt(np.maximum((mxx + myy) / 2 + common, 1e-9)), np.sqrt(np.maximum((mxx + myy) / 2 - common, 0))
        ell = 1 - b / a
    why = np.select([npix < p.min_pix, npix > limit, peak >= p.saturation, edge, s <= 0, ell > p.max_ellipticity], [1, 2, 3, 4, 1, 5], 0)
    names = ["kept", "too_small", "extended", "saturated", "edge", "elongated"]
    got = Stars(cx, cy, s, peak, npix, 2.354820045 * np.maximum(np.sqrt(a * b), 1e-6), ell, np.degrees(0.5 * np.arctan2(2 * mxy, mxx - myy)), {k: int((why == i).sum()) for i, k in enumerate(names) if i}, n)
    keep = np.flatnonzero(why == 0)
    return choose(got.take(keep[np.argsort(-s[keep], kind="stable")]), nx, ny, p.keep)


def choose(stars: Stars, nx: int, ny: int, keep: int) -> Stars:
    """The strongest stars, or rounds over a grid where the strongest crowd into few cells."""
    cell = lambda g, v, n: np.minimum((v / n * g).astype(int), g - 1)
    top = stars.take(slice(0, keep))
    if len(stars) <= keep or len(top) < 64:
        return top
    busiest = np.bincount(cell(8, top.y, ny) * 8 + cell(8, top.x, nx)).max()
    if busiest / (len(top) / 64) < 5.0:
        return top
    g = int(min(16, max(1, math.floor(2 * math.sqrt(len(stars) / keep) + 0.5))))
    where = cell(g, stars.y, ny) * g + cell(g, stars.x, nx)
    order = np.argsort(where, kind="stable")
    first = np.searchsorted(where[order], where[order])
    rnd = np.empty(len(stars), int)
    rnd[order] = np.arange(len(stars)) - first
    return stars.take(np.sort(np.lexsort((where, rnd))[:keep]))


# ---- patterns -----------------------------------------------------------------------------


@dataclass
class Quads:
    idx: np.ndarray
    code: np.ndarray
    diag: np.ndarray


def build_quads(x: np.ndarray, y: np.ndarray, k: int = 6, limit: int = 600) -> Quads:
    """Patterns of each point with three of its k nearest, one rank of every seed before the next."""
    idx, _, code, diag = point_patterns(x, y, np.zeros(min(1, len(x)), np.int64), k, limit)
    return Quads(idx, code, diag)


def merged_votes(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Votes of each bin (scale, rotation, parity) with those of all bins at most one step away; rotation wraps at 72."""
    code = lambda ds, dr: ((key[:, 0] - key[:, 0].min() + 1 + ds) * 2 + key[:, 2]) * 512 + key[:, 1] + dr + 128
    own = code(0, 0)
    order = np.argsort(own)
    merged = np.zeros(len(key), np.int64)
    for ds in (-1, 0, 1):
        for dr in (-72, -71, -1, 0, 1, 71, 72):
            want = code(ds, dr)
            at = order[np.minimum(np.searchsorted(own, want, sorter=order), len(own) - 1)]
            merged += np.where(own[at] == want, count[at], 0)
    return merged


def match_quads(ix, iy, iq: Quads, cx, cy, cq: Quads, tol: float = 0.02, expected: float | None = None, scale_tol: float = 0.05, min_votes: int = 4):
    """Image and catalogue stars paired by the patterns that agree in code, scale and rotation; None if too few."""
    found = []
    for mirrored in (False, True):
        sx = -cx if mirrored else cx
        code = canonical_codes(sx[cq.idx], cy[cq.idx])[0] if mirrored else cq.code
        for lo in range(0, len(iq.idx), 256):
            d2 = ((iq.code[lo : lo + 256, None, :] - code[None]) ** 2).sum(2)
            i, c = np.nonzero(d2 <= tol * tol)
            i = i + lo
            scale = cq.diag[c] / iq.diag[i]
            if expected:
                ok = np.abs(scale - expected) / expected <= scale_tol
                i, c, scale = i[ok], c[ok], scale[ok]
            ia, ib, ca, cb = iq.idx[i, 0], iq.idx[i, 1], cq.idx[c, 0], cq.idx[c, 1]
            rot = np.degrees(np.arctan2(cy[cb] - cy[ca], sx[cb] - sx[ca]) - np.arctan2(iy[ib] - iy[ia], ix[ib] - ix[ia])) % 360.0
            found.append(np.stack([np.log(scale) / 0.02, rot / 5.0, np.full(len(i), mirrored), i, c], axis=1))
    v = np.concatenate(found)
    if not len(v):
        return None
    v = v[np.lexsort((v[:, 2], v[:, 4], v[:, 3]))]
    key, first, inverse, count = np.unique(np.column_stack([np.floor(v[:, :2] + 0.5), v[:, 2]]).astype(int), axis=0, return_index=True, return_inverse=True, return_counts=True)
    merged = merged_votes(key, count)
    j = np.lexsort((first, -merged))[0]  # a tie goes to the bin seen first
    if merged[j] < min_votes:
        return None
    dr = np.abs(key[:, 1] - key[j, 1])
    chosen = (key[:, 2] == key[j, 2]) & (np.abs(key[:, 0] - key[j, 0]) <= 1) & (np.minimum(dr, 72 - dr) <= 1)
    won = v[chosen[inverse.ravel()]]
    pairs = np.stack([iq.idx[won[:, 3].astype(int)].ravel(), cq.idx[won[:, 4].astype(int)].ravel()], axis=1)
    both, first, n = np.unique(pairs, axis=0, return_index=True, return_counts=True)
    order = np.lexsort((first, -n, both[:, 0]))
    _, one = np.unique(both[order, 0], return_index=True)
    return both[order][one]


class Near:
    """Exact nearest-within-``tol`` lookup: a raster names the points that any place of a cell may be near."""

    def __init__(self, z: np.ndarray, tol: float):
        self.z, self.tol = z, tol
        self.x0, self.y0 = z.real.min(), z.imag.min()
        wide, high = np.ptp(z.real), np.ptp(z.imag)
        self.cell = max(tol, wide / 2048, high / 2048)
        self.nx, self.ny = int(wide / self.cell) + 5, int(high / self.cell) + 5
        lists: dict[tuple[int, int], list[int]] = {}
        for i, (x, y) in enumerate(zip(*self._cells(z))):
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    lists.setdefault((y + dy, x + dx), []).append(i)
        self.slot = np.full((self.ny, self.nx), -1, np.int32)
        most = max(map(len, lists.values()))
        self.names = np.array([v + v[:1] * (most - len(v)) for v in lists.values()])
        for k, at in enumerate(lists):
            self.slot[at] = k

    def _cells(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # points lie in cells from 2 on; the border cells are empty
        return (np.clip((v - o) / self.cell + 2, 0, n - 1).astype(np.int64) for v, o, n in ((at.real, self.x0, self.nx), (at.imag, self.y0, self.ny)))

    def __call__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and nearest point of each place of ``at`` that has one."""
        x, y = self._cells(at)
        slot = self.slot[y, x]
        r, c = np.nonzero(slot >= 0)
        names = self.names[slot[r, c]]
        dist = np.abs(self.z[names] - at[r, c][:, None])
        best = dist.argmin(1)
        ok = dist[np.arange(len(r)), best] <= self.tol
        return r[ok], c[ok], names[ok, best[ok]]


@dataclass
class PairMatch:
    """What pair matching found; ``pairs`` is empty unless ``sufficient``.

    ``runner_up`` is the best count of any other hypothesis tested, ``to_promise`` how many had
    been tested when one first reached the least count. ``truncated`` says that the ceiling ended
    the search, ``aborted`` that nothing had shown promise for long.
    """

    pairs: np.ndarray
    inliers: int
    runner_up: int
    image_stars: int
    cat_stars: int
    agreements: int
    hypotheses: int
    mirrored: bool
    truncated: bool
    to_promise: int | None
    aborted: bool
    sufficient: bool


def match_pairs(
    ix, iy, cx, cy, expected: float, tol_px: float = 2.5, scale_tol: float = 0.005, most: int = 80, min_inliers: int = 8, enough: int = 24, ceiling: int = 40_000_000, patience: int = 1_000_000
) -> PairMatch | None:
    """Stars paired by hypotheses from pairs of equal separation; None if there is nothing to compare.

    All pairs of the ``most`` strongest stars from 20 tolerances up are tried, the narrowest first,
    against all pairs of the catalogue's brightest; two stars of each fix shift, rotation and scale,
    in either order and parity: four hypotheses an agreement. The search ends once a hypothesis has
    ``enough`` inliers, after ``ceiling`` hypotheses, or after ``patience`` of them if none has had
    ``min_inliers`` by then.
    """
    n, m = min(len(ix), most), min(len(cx), max(60, min(300, 4 * len(ix))))
    if n < 4 or m < 4 or not expected > 0:
        return None
    z, image = (np.asarray(cx[:m]) + 1j * np.asarray(cy[:m])) / expected, np.asarray(ix[:n]) + 1j * np.asarray(iy[:n])

    def separations(p):
        a, b = np.triu_indices(len(p), 1)
        sep = np.abs(p[a] - p[b])
        order = np.argsort(sep, kind="stable")
        order = order[sep[order] >= 20 * tol_px]
        return a[order], b[order], sep[order]

    a, b, sep = separations(z)
    i, j, d = separations(image)
    if not len(sep) or not len(d):
        return None
    half = tol_px + d * scale_tol
    low, high = np.searchsorted(sep, d - half), np.searchsorted(sep, d + half, side="right")
    near, got = Near(z, tol_px), PairMatch(np.empty((0, 2), np.int64), 0, 0, n, m, 0, 0, False, False, None, False, False)
    best = None
    for k in np.flatnonzero(high > low):
        for lo in range(low[k], high[k], 2048):
            hi = min(lo + 2048, high[k])
            u, w = np.stack([a[lo:hi], b[lo:hi]], axis=1).ravel(), np.stack([b[lo:hi], a[lo:hi]], axis=1).ravel()
            first, last = np.repeat(u, 2), np.repeat(w, 2)
            # every other hypothesis is the mirrored one
            offset = np.stack([image - image[i[k]], np.conj(image - image[i[k]])])
            offset = offset / offset[:, j[k], None]
            at = ((z[last] - z[first]).reshape(-1, 2, 1) * offset + z[first].reshape(-1, 2, 1)).reshape(-1, n)
            r, c, name = near(at)
            hit = np.bincount(r, minlength=len(first))
            so_far = np.maximum(got.inliers, np.maximum.accumulate(hit.reshape(-1, 4).max(1)))
            tested = got.hypotheses + 4 * np.arange(1, len(so_far) + 1)
            promise = got.to_promise if got.to_promise is not None else next(iter(tested[so_far >= min_inliers].tolist()), None)
            ends = [(so_far >= enough), (tested >= patience) if promise is None else np.zeros(len(tested), bool), tested >= ceiling]
            stop = np.flatnonzero(np.any(ends, axis=0))
            done = int(stop[0]) + 1 if len(stop) else len(so_far)
            got.agreements, got.hypotheses = got.agreements + done, int(tested[done - 1])
            got.to_promise = promise if promise is not None and promise <= got.hypotheses else None
            hit = hit[: 4 * done]
            top = int(hit.argmax())
            others = np.sort(np.append(np.delete(hit, top), [got.runner_up, min(got.inliers, hit[top])]))
            if hit[top] > got.inliers:
                got.runner_up, got.inliers, got.mirrored = int(others[-1]), int(hit[top]), bool(top % 2)
                best = np.stack([c[r == top], name[r == top]], axis=1)
            else:
                got.runner_up = max(got.runner_up, int(hit[top]))
            if len(stop):
                got.aborted = bool(ends[1][done - 1] and not ends[0][done - 1])
                got.truncated = bool(ends[2][done - 1] and not ends[0][done - 1] and not got.aborted)
                break
        else:
            continue
        break
    got.sufficient = got.inliers >= min_inliers
    if got.sufficient:
        got.pairs = best
    return got


# ---- fit and gate -------------------------------------------------------------------------


@dataclass
class Fit:
    wcs: Solution
    used: int
    rms_deg: float
    worst_deg: float
    trend: float


def fit_tan(x, y, ra, dec, ra0: float, dec0: float, clip: float = 3.0) -> Fit | None:
    """Least-squares tangent-plane fit with up to two rounds of clipping; at least four pairs."""
    xi, eta = to_plane(ra, dec, ra0, dec0)
    keep = np.flatnonzero(np.isfinite(xi))
    for rnd in range(3):
        if len(keep) < 4:
            return None
        base = np.column_stack([np.ones(len(keep)), x[keep], y[keep]])
        middle = base.mean(0) * [0, 1, 1]
        if np.linalg.matrix_rank(base - middle) < 3:
            return None
        (a, b), _, _, _ = (lambda r: (r[0].T, *r[1:]))(np.linalg.lstsq(base - middle, np.column_stack([xi[keep], eta[keep]]), rcond=None))
        cd = np.array([a[1:], b[1:]])
        if abs(np.linalg.det(cd)) < 1e-30:
            return None
        wcs = Solution(np.array([ra0, dec0]), middle[1:] - np.linalg.solve(cd, [a[0], b[0]]), cd)
        res = separation(*wcs.to_sky(x[keep], y[keep]), *from_plane(xi[keep], eta[keep], ra0, dec0))
        rms = math.sqrt((res**2).mean())
        inside = res <= max(clip * rms, 1e-3 * wcs.scale / 3600)
        if rnd == 2 or len(keep) <= 6 or rms <= 0 or inside.all() or inside.sum() < 4:
            radius = np.hypot(x[keep] - x[keep].mean(), y[keep] - y[keep].mean())
            trend = float(np.corrcoef(radius, res)[0, 1]) if len(keep) > 2 and radius.std() > 0 and res.std() > 0 else 0.0
            return Fit(wcs, len(keep), rms, float(res.max()), trend)
        keep = keep[inside]
    return None


def decades(matched: int, n_image: int, n_cat: int, tol_deg: float, area: float) -> float:
    """How unlikely so many matches are by chance, in powers of ten."""
    if min(matched, n_image, n_cat, tol_deg, area) <= 0:
        return 0.0
    lam = n_image * n_cat * math.pi * tol_deg**2 / area
    if matched <= lam:
        return 0.0
    log_factorial = 0.0 if matched < 2 else matched * math.log(matched) - matched + 0.5 * math.log(2 * math.pi * matched)
    return max(0.0, (log_factorial + lam - matched * math.log(lam)) / math.log(10))


def reprojected(wcs: Solution, ra, dec, x, y, nx: int, ny: int, tol: float = 2.0) -> int:
    """Catalogue stars in the frame with any detection within ``tol`` pixels in both coordinates."""
    px, py = wcs.to_pixel(ra, dec)
    inside = np.flatnonzero((px >= -tol) & (py >= -tol) & (px <= nx - 1 + tol) & (py <= ny - 1 + tol))
    if not len(inside) or not len(x):
        return 0
    hit = (np.abs(px[inside, None] - x) <= tol) & (np.abs(py[inside, None] - y) <= tol)
    return int(hit.any(1).sum())


def solve(stars: Stars, nx: int, ny: int, ra, dec, ra0: float, dec0: float, scale: float | None, pairs: bool = False, min_decades: float = 12.0, blind: bool = False) -> dict:
    """Solve one frame against catalogue stars (brightest first); always returns an outcome."""
    fail = lambda reason, **more: {"solved": False, "reason": reason, "detected": len(stars)} | more
    if len(stars) == 0:
        r = stars.rejected
        return fail("EXTENDED_ONLY" if r.get("extended", 0) > 0 and stars.detected == r.get("extended") else "NO_STARS")
    if len(stars) < 4:
        return fail("TOO_FEW_STARS")
    xi, eta = to_plane(ra, dec, ra0, dec0)
    ok = np.isfinite(xi)
    ra, dec, xi, eta = ra[ok], dec[ok], xi[ok], eta[ok]
    if len(ra) < 4:
        return fail("INDEX_TOO_SHALLOW")
    deg = scale / 3600 if scale else None
    got, pair, matcher, budget = None, None, "quads", 0
    for budget in (600, 1500):
        got = match_quads(stars.x, stars.y, build_quads(stars.x, stars.y, 6, budget), xi, eta, build_quads(xi, eta, 6, budget), expected=deg)
        if got is not None and len(got) >= 4:
            break
    if (got is None or len(got) < 4) and pairs and deg:
        pair, matcher = match_pairs(stars.x, stars.y, xi, eta, deg), "pairs"
        got = pair.pairs if pair is not None else None
    how = {"matcher": matcher, "budget": budget, "pair": pair}
    if got is None or len(got) < 4:
        return fail("NO_QUAD_MATCH", **how)
    fit = fit_tan(stars.x[got[:, 0]], stars.y[got[:, 0]], ra[got[:, 1]], dec[got[:, 1]], ra0, dec0)
    if fit is None:
        return fail("NO_QUAD_MATCH", **how)
    # further rounds over all stars that the solution explains
    for _ in range(2):
        px, py = fit.wcs.to_pixel(ra, dec)
        d = np.hypot(px[None, :] - stars.x[:, None], py[None, :] - stars.y[:, None])
        near = d.argmin(1)
        good = np.flatnonzero(d[np.arange(len(near)), near] <= 2.0)
        more = fit_tan(stars.x[good], stars.y[good], ra[near[good]], dec[near[good]], ra0, dec0) if len(good) >= 4 else None
        fit = more if more is not None and more.used >= fit.used else fit
    matched = reprojected(fit.wcs, ra, dec, stars.x, stars.y, nx, ny)
    if blind:
        matched = max(0, matched - 4)
    area = nx * ny * (fit.wcs.scale / 3600) ** 2
    px, py = fit.wcs.to_pixel(ra, dec)
    n_cat = int(((px >= 0) & (py >= 0) & (px < nx) & (py < ny)).sum())
    odds = decades(matched, len(stars), n_cat, 2.0 * fit.wcs.scale / 3600, area)
    rms_px = fit.rms_deg * 3600 / fit.wcs.scale
    if matched < 10 or odds < min_decades or not math.isfinite(rms_px) or rms_px > 3.0:
        return fail("LOW_CONFIDENCE", matched=matched, log_odds=odds, **how)
    chance = len(stars) * n_cat * math.pi * (2.0 * fit.wcs.scale / 3600) ** 2 / area
    return {"solved": True, "reason": None, "detected": len(stars), "matched": matched, "log_odds": odds, "chance": chance, "fit": fit, **how}


# ---- blind candidates -----------------------------------------------------------------------


def candidate_fit(ix, iy, iq_diag: float, ra, dec, shape_tol: float = 0.01) -> Fit | None:
    """Four-star fit of one pattern candidate: distinct stars, like shape in either parity, agreeing scale."""
    if len({(float(a), float(b)) for a, b in zip(ra, dec)}) < 4 or not (np.isfinite(ra).all() and np.isfinite(dec).all()):
        return None
    xi, eta = to_plane(ra, dec, float(ra[0]), float(dec[0]))
    if not np.isfinite(xi).all():
        return None
    want = canonical_codes(np.array([ix]), np.array([iy]))[0][0]
    near = min(float(np.linalg.norm(canonical_codes(np.array([s * xi]), np.array([eta]))[0][0] - want)) for s in (1.0, -1.0))
    if not near <= shape_tol:
        return None
    fit = fit_tan(np.asarray(ix), np.asarray(iy), ra, dec, float(ra[0]), float(dec[0]))
    if fit is None:
        return None
    diag = max(math.hypot(xi[i] - xi[j], eta[i] - eta[j]) for i in range(4) for j in range(i))
    return fit if abs(fit.wcs.scale / 3600 - diag / iq_diag) / (diag / iq_diag) <= 0.005 else None


def spaced(ra: np.ndarray, dec: np.ndarray, radius: float, most: int = 40) -> list[int]:
    """Greedy choice in the given order: skip places within the radius of one already taken."""
    taken: list[int] = []
    left = np.arange(len(ra))
    while len(left) and len(taken) < most:
        i = int(left[0])
        taken.append(i)
        left = left[1:][separation(ra[i], dec[i], ra[left[1:]], dec[left[1:]]) > radius]
    return taken


def by_neighbours(ra: np.ndarray, dec: np.ndarray, rms: np.ndarray, radius: float) -> np.ndarray:
    """Places in the order of how many lie within the radius, then of the fit's rms, then of position; none is left out."""
    order = np.argsort(dec, kind="stable")
    r, d = ra[order], dec[order]
    low, high = np.searchsorted(d, d - radius - 1e-9), np.searchsorted(d, d + radius + 1e-9, side="right")
    near = np.empty(len(ra), np.int64)
    near[order] = [(separation(r[i], d[i], r[a:b], d[a:b]) <= radius).sum() for i, (a, b) in enumerate(zip(low, high))]
    return np.lexsort((dec, ra, rms, -near))


# ---- residuals ------------------------------------------------------------------------------


def local_centroid(px: np.ndarray, x: float, y: float, half: int = 6, least_snr: float = 4.0) -> tuple[float, float] | None:
    """Light centroid of the bright core in a box around a place; None at the border or without a star."""
    i, j = round(y), round(x)
    if i < half or j < half or i + half >= px.shape[0] or j + half >= px.shape[1]:
        return None
    box = px[i - half : i + half + 1, j - half : j + half + 1].astype(float)
    level = np.median(box)
    noise = max(1e-9, 1.4826 * np.median(np.abs(box - level)))
    light = box - level
    if light.max() < least_snr * noise:
        return None
    core = np.where(light > 0.25 * light.max(), light, 0.0)
    yy, xx = np.mgrid[-half : half + 1, -half : half + 1]
    return j + float((xx * core).sum() / core.sum()), i + float((yy * core).sum() / core.sum())


def residual_vectors(px: np.ndarray, wcs: Solution, ra, dec, most: float = 4.0) -> np.ndarray:
    """Rows (x, y, dx, dy): where catalogue stars are predicted, and how far their light is from there."""
    rows = []
    for x, y in zip(*wcs.to_pixel(ra, dec)):
        at = local_centroid(px, x, y) if np.isfinite(x) and np.isfinite(y) else None
        if at is not None and abs(at[0] - x) <= most and abs(at[1] - y) <= most:
            rows.append((x, y, at[0] - x, at[1] - y))
    return np.array(rows).reshape(-1, 4)
