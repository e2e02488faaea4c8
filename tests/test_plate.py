import math

import numpy as np
import pytest

from skyframe.operators import plate, quads
from skyframe.sources import fits, sidecar


def field(**more):
    px, cat, truth = fits.synthetic_field(more.pop("ra", 120.0), more.pop("dec", 35.0), 3.0, **more)
    cat = cat.sort_values("mag")
    return px, cat.ra.to_numpy(), cat.dec.to_numpy(), truth


@pytest.mark.parametrize("rotation,mirrored,ra", [(0, False, 120.0), (122.6, False, 0.05), (250, True, 359.97)])
def test_closed_loop(rotation, mirrored, ra):
    px, cra, cdec, truth = field(ra=ra, rotation=rotation, mirrored=mirrored, seed=5)
    _, im, _ = fits.read_image(fits.write_image(px))
    got = plate.solve(plate.extract(im, plate.ExtractParams()), 640, 480, cra, cdec, ra, 35.0, 3.0)
    assert got["solved"] and got["matched"] >= 10 and got["log_odds"] > 12
    w = got["fit"].wcs
    assert abs(w.scale - 3.0) < 0.02 and w.parity == truth.parity
    assert plate.separation(*w.to_sky(320, 240), *truth.to_sky(320, 240)) * 3600 < 3.0


def test_a_wrong_catalogue_is_refused():
    px, _, _, _ = field(seed=6)
    rng = np.random.default_rng(0)
    got = plate.solve(plate.extract(px.astype(np.float32), plate.ExtractParams()), 640, 480, 120 + rng.uniform(-0.3, 0.3, 60), 35 + rng.uniform(-0.2, 0.2, 60), 120.0, 35.0, 3.0, pairs=True)
    assert not got["solved"] and got["reason"] in ("NO_QUAD_MATCH", "LOW_CONFIDENCE")


def test_pairs_find_a_small_rotation():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 600, 30), rng.uniform(0, 400, 30)
    z = (x + 1j * y) * np.exp(1j * 0.7) + (50 - 20j)
    got = plate.match_pairs(x, y, z.real * 0.001, z.imag * 0.001, 0.001)
    assert got.sufficient and (got.pairs[:, 0] == got.pairs[:, 1]).sum() >= 24 and got.inliers >= 24 > got.runner_up
    assert got.hypotheses == 4 * got.agreements and got.to_promise <= got.hypotheses and not (got.truncated or got.aborted or got.mirrored)
    # the counts of every hypothesis up to the same end, one by one
    short = plate.match_pairs(x, y, z.real * 0.001, z.imag * 0.001, 0.001, ceiling=400, enough=1000)
    assert short.truncated and short.hypotheses == 400 and not short.aborted


def test_pairs_give_up_without_promise():
    rng = np.random.default_rng(2)
    got = plate.match_pairs(*(rng.uniform(0, 600, 40) for _ in range(2)), *(rng.uniform(0, 0.6, 60) for _ in range(2)), 0.001, min_inliers=30, patience=2000)
    assert got.aborted and not got.truncated and not got.sufficient and not len(got.pairs) and got.hypotheses == 2000 and got.to_promise is None
    assert 0 < got.runner_up <= got.inliers < 30
    assert plate.match_pairs(np.arange(3.0), np.arange(3.0), np.arange(9.0), np.arange(9.0), 0.001) is None


@pytest.mark.parametrize("mirrored", [False, True])
def test_pairs_within_a_small_catalogue_disc(mirrored):
    # 80 stars, of which the catalogue has those within 140 pixels of the centre, so its widest pair is below 280 pixels
    rng = np.random.default_rng(11)
    x, y = rng.uniform(0, 640, 80), rng.uniform(0, 480, 80)
    inside = np.flatnonzero(np.hypot(x - 320, y - 240) <= 140)
    z = (x[inside] + 1j * y[inside]) * np.exp(1j * 2.1)
    z = -np.conj(z) if mirrored else z
    got = plate.match_pairs(x, y, z.real * 0.001, z.imag * 0.001, 0.001)
    assert 8 <= len(inside) < 24 and got.mirrored == mirrored
    assert got.sufficient and (got.pairs[:, 0] == inside[got.pairs[:, 1]]).sum() == len(inside)


def test_a_cluster_over_nine_small_bins_wins():
    # two votes in each of nine bins around (0, 20), and three in each of 80 bins far from one another
    bins = [(i, 20 + j) for i in (-1, 0, 1) for j in (-1, 0, 1) for _ in range(2)] + [(100 + 10 * k, 40) for k in range(80) for _ in range(3)]
    n = len(bins)
    code = np.arange(n)[:, None] * 0.1 + 10 + np.zeros(4)  # each image pattern agrees with one catalogue pattern
    turn = np.radians([5.0 * b for _, b in bins])
    idx = np.arange(4 * n).reshape(n, 4)
    x, y, cx, cy = (np.tile([0.0, 1, 2, 3], n), np.tile([0.0, 0, 1, 5], n), np.zeros(4 * n), np.zeros(4 * n))
    cx[1::4], cy[1::4], cx[2::4], cy[3::4] = np.cos(turn), np.sin(turn), 5, 7
    got = plate.match_quads(x, y, plate.Quads(idx, code, np.ones(n)), cx, cy, plate.Quads(idx, code, np.exp([0.02 * a for a, _ in bins])))
    assert got is not None and sorted(got[:, 0]) == list(range(18 * 4)) and (got[:, 0] == got[:, 1]).all()


def test_merged_votes_against_all_pairs():
    rng = np.random.default_rng(13)
    key = np.unique(np.column_stack([rng.integers(-4, 4, 300), rng.choice([0, 1, 2, 70, 71, 72], 300), rng.integers(0, 2, 300)]), axis=0)
    count = rng.integers(1, 9, len(key))
    dr = np.abs(key[:, None, 1] - key[:, 1])
    near = (np.abs(key[:, None, 0] - key[:, 0]) <= 1) & (np.minimum(dr, 72 - dr) <= 1) & (key[:, None, 2] == key[:, 2])
    assert (plate.merged_votes(key, count) == (near * count).sum(1)).all()


def test_nearest_lookup_against_all_distances():
    rng = np.random.default_rng(12)
    z, at = (rng.uniform(0, 60, n) + 1j * rng.uniform(0, 40, n) for n in (50, 600))
    at = at.reshape(20, 30) * 1.2 - 5
    dist = np.abs(at[:, :, None] - z)
    r, c = np.nonzero(dist.min(2) <= 2.5)
    got = plate.Near(z, 2.5)(at)
    assert np.array_equal(got[0], r) and np.array_equal(got[1], c) and np.array_equal(got[2], dist.argmin(2)[r, c])


def test_a_flat_image_has_no_stars():
    got = plate.extract(np.full((64, 64), 1000.0, np.float32), plate.ExtractParams())
    assert len(got) == 0
    assert plate.solve(got, 64, 64, np.empty(0), np.empty(0), 0, 0, 1.0)["reason"] == "NO_STARS"


def test_components_against_flood_fill():
    mask = np.random.default_rng(2).random((60, 70)) < 0.35
    ys, xs, label = plate.components(mask)
    seen = {}
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        seen[start], todo = start, [start]
        while todo:
            y, x = todo.pop()
            for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= p[0] < 60 and 0 <= p[1] < 70 and mask[p] and p not in seen:
                    seen[p] = start
                    todo.append(p)
    assert len(ys) == mask.sum()
    pairs = {(seen[(y, x)], k) for y, x, k in zip(ys, xs, label)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_fit_clips_an_outlier():
    truth = plate.Solution(np.array([10.0, 20.0]), np.array([300.0, 200.0]), np.array([[-1e-3, 1e-4], [1e-4, 1e-3]]))
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 600, 40), rng.uniform(0, 400, 40)
    ra, dec = truth.to_sky(x, y)
    dec = dec + rng.normal(0, 1e-6, 40)
    dec[0] += 0.05
    got = plate.fit_tan(x, y, ra, dec, 10.0, 20.0)
    assert got.used == 39 and np.allclose(got.wcs.cd, truth.cd, atol=1e-7)
    assert plate.fit_tan(x[:3], y[:3], ra[:3], dec[:3], 10.0, 20.0) is None
    assert plate.fit_tan(x, x, ra, dec, 10.0, 20.0) is None


def test_gate_numbers():
    tol, area = 5 / 3600, 3.878
    assert plate.decades(118, 502, 300, tol, area) > 50 and plate.decades(0, 500, 300, tol, area) == 0
    assert plate.decades(3, 500, 300, 0.05, area) < 10


def test_header_rules():
    data = fits.write_image(np.zeros((4, 6)), [("OBJECT", "it''s"), ("X", 1.5)])
    cards, px, binned = fits.read_image(data)
    assert fits.text(cards, "OBJECT") == "it's" and fits.number(cards, "X") == 1.5 and px.shape == (4, 6) and binned == 1
    assert fits.read_image(fits.write_image(np.ones((5, 7)), [("BAYERPAT", "RGGB")]))[1].shape == (2, 3)
    for bad, reason in ((data[:2000], "CANNOT_READ"), (data[:2880], "CANNOT_READ"), (data.replace(b"BITPIX  =                   16", b"BITPIX  =                   64"), "UNSUPPORTED_FORMAT")):
        with pytest.raises(fits.FrameError) as e:
            fits.read_image(bad)
        assert e.value.reason == reason


def test_sidecars():
    assert sidecar.scientific(-1.5) == "-1.5000000000000000E+000" and sidecar.scientific(0.25) == " 2.5000000000000000E-001" and sidecar.scientific(2e-7).endswith("E-007")
    text = sidecar.ini([10, 20], [5, 6], [-1e-3, 0, 0, 1e-3], "x")
    assert text.splitlines()[0] == "PLTSOLVD=T" and text.splitlines()[1].startswith("CRPIX1= 6.0") and len(text.splitlines()) == 14
    cards = sidecar.merged_cards([("SIMPLE", True), ("CRPIX1", 1), ("COMMENT", "a")], [10, 20], [5, 6], [-1e-3, 0, 0, 1e-3])
    assert cards[1] == ("CRPIX1", 6) and cards[2] == ("COMMENT", "a")
    assert len(sidecar.card_block(cards)) % 2880 == 0 and all(len(sidecar.card(n, v)) == 80 for n, v in cards)


def test_centres_are_ranked_by_neighbours_then_rms():
    rng = np.random.default_rng(14)
    ra, dec = np.append(rng.uniform(0, 360, 900), rng.normal(10, 0.05, 30) % 360), np.append(rng.uniform(-89, 89, 900), rng.normal(80, 0.02, 30))
    rms = rng.permutation(930).astype(float)
    near = np.array([(plate.separation(a, b, ra, dec) <= 0.2).sum() for a, b in zip(ra, dec)])
    order = plate.by_neighbours(ra, dec, rms, 0.2)
    assert list(order) == sorted(range(930), key=lambda i: (-near[i], rms[i])) and order[0] >= 900


def test_mirrored_codes():
    x, y = np.random.default_rng(15).normal(size=(2, 200, 4))
    code, mirrored = quads.canonical_codes(x, y)[0], quads.canonical_codes(-x, y)[0]
    assert np.isfinite(code).all() and np.allclose(quads.mirrored_codes(code), mirrored, atol=1e-11)


def test_spaced_choice():
    assert plate.spaced(np.array([0.0, 0.01, 5.0]), np.zeros(3), 0.1) == [0, 2]
    assert math.isclose(plate.separation(0, 0, 90, 0), 90.0)
