"""The chunk solver, features, settings and run grids."""

import numpy as np
import pytest

from voxframe.engines import arrays as A
from voxframe.engines.demons import Demons, Result, Stage, engine
from voxframe.engines.features import SelfSimilarity, extractor, normalise_channels, principal, receptive_field, stratified_pick
from voxframe.plans import config
from voxframe.plans.rungrid import Scan, resolve


def blob(shape=(20, 18, 22), seed=3):
    a = A.smooth(np.random.default_rng(seed).random(shape), 2.0)
    return (a - a.min()) / (a.max() - a.min())


def test_demons_lowers_the_loss():
    a = blob()
    b = np.roll(a, 2, 0)
    u = Demons().solve(a[None], b[None], 0.05, [Stage(scales=(2, 1), iterations=(30, 20))]).u
    inner = slice(4, -4)
    before, after = ((a - b)[inner] ** 2).mean(), ((a - A.warp(b[None], u, 0.05)[0])[inner] ** 2).mean()
    assert after < 0.35 * before


def test_identical_images_stay():
    a = blob()[None]
    assert np.abs(Demons().solve(a, a, 0.05, [Stage()]).u).max() < 1e-9


def test_moments_find_a_shift():
    a = np.zeros((1, 20, 20, 20))
    a[0, 8:12, 8:12, 8:12] = 1
    u = Demons().solve(a, np.roll(a, 3, 1), 0.1, [Stage("moments")]).u
    assert u[0] == pytest.approx(0.3) and abs(u[1:]).max() < 1e-9


def test_engine_refuses():
    with pytest.raises(ValueError):
        engine("none")
    with pytest.raises(ValueError):
        Demons().solve(np.zeros((1, 4, 4, 4)), np.zeros((1, 4, 4, 5)), 1, [])
    with pytest.raises(ValueError):
        Demons().solve(np.zeros((1, 4, 4, 4)), np.zeros((1, 4, 4, 4)), 1, [Stage("affine")])
    with pytest.raises(ValueError):
        Result(np.zeros((2, 3, 3, 3)))


def test_self_similarity():
    f = SelfSimilarity()(blob())
    assert f.shape[0] == 12 and np.allclose((f * f).sum(0), 1) and receptive_field(SelfSimilarity(), 16) <= 3
    assert np.allclose(SelfSimilarity()(blob()), SelfSimilarity()(2 * blob()))


def test_specs_and_picks():
    assert extractor("intensity+mind@5").channels == 6
    with pytest.raises(ValueError):
        extractor("other")
    pick = stratified_pick([4, 12], 4, 0, 1, 2)
    assert len(pick) == 4 and (pick < 4).sum() == 1 and (stratified_pick([4, 12], 4, 0, 1, 2) == pick).all()
    x = np.random.default_rng(0).random((5, 2, 2, 2))
    assert np.allclose(normalise_channels(x, "standard").mean(0), 0)


def test_principal_directions():
    x = np.random.default_rng(0).normal(size=(500, 3)) * [3, 1, 0.1]
    basis, share = principal(np.cov(x.T), 2)
    assert abs(basis[0, 0]) > 0.99 and share[0] > 0.8


def test_settings_round_trip():
    run = config.load({"spacing": 0.1, "tiling": {"core": 16, "halo": 8}, "solver": {"stages": [{"kind": "greedy"}]}})
    again = config.load(config.dump(run))
    assert again == run and again.digest() == run.digest() and run.cap(0, 4) == 3 and run.cap(4, 4) == 2
    for bad in ({"nothing": 1}, {"tiling": {"core": 0}}, {"spacing": -1}, {"solver": {"engine": "x"}}, {"stopping": {"caps": []}}):
        with pytest.raises((ValueError, TypeError)):
            config.load(bad)


def test_run_grid():
    fine, coarse = Scan("a", (40, 40, 40), (0.05,) * 3), Scan("b", (16, 16, 16), (0.1,) * 3)
    grid, places = resolve([fine, coarse])
    assert grid.spacing == 0.05 and grid.shape == (40, 40, 40) and places[0].copied
    grid, places = resolve([fine, coarse], "coarsest")
    assert grid.shape == (20, 20, 20) and places[0].pool == (2, 2, 2) and places[1].copied
    with pytest.raises(ValueError):
        resolve([Scan("t", (4, 4, 4), (0.1, 0.05, 0.05))], reference="t")
