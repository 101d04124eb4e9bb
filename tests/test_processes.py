"""Processes and ordinal models against plain linear algebra, numerical slopes and search by brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from lakefold.operators import processes as P

BLOCKS = (P.Block("c", "category"), P.Block("l", "levels"), P.Block("p", "plain"), P.Block("m", "matern", 2))


def rows(n, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"user": seed, "item": np.arange(n), "c": list(np.eye(4)[rng.integers(0, 4, n)]), "l": list(np.eye(5)[rng.integers(0, 5, n)]), "p": list(rng.normal(0, 0.4, (n, 6))), "m": list(rng.normal(0, 1, (n, 2))), "v": rng.integers(1, 6, n).astype(float)})


def plain_gram(a, b, theta):
    """The kernel entry by entry, with the default order of parameters: tau, beta, two lengths, signal, noise, amplitudes."""
    tau, beta, l1, l2, signal, _, *amplitudes = theta
    tau, beta = 1 / (1 + math.exp(-tau)), math.log1p(math.exp(beta))
    path = np.diag([1.0, 2, 2, 2, 1]) - np.eye(5, k=1) - np.eye(5, k=-1)
    near, term = np.eye(5), np.eye(5)
    for k in range(1, 60):  # the exponential's series
        term = term @ (-beta * path) / k
        near = near + term
    near = near / np.sqrt(np.outer(np.diag(near), np.diag(near)))
    out = np.zeros((len(a), len(b)))
    for i, x in enumerate(a.itertuples()):
        for j, y in enumerate(b.itertuples()):
            r = math.sqrt(5 * (((x.m[0] - y.m[0]) / math.exp(l1)) ** 2 + ((x.m[1] - y.m[1]) / math.exp(l2)) ** 2))
            parts = [(1 - tau) * (x.c @ y.c) + tau, x.l @ near @ y.l, x.p @ y.p, (1 + r + r * r / 3) * math.exp(-r)]
            out[i, j] = math.exp(2 * signal) * (0.05 + sum(math.exp(2 * w) * p for w, p in zip(amplitudes, parts)))
    return out


def test_kernel_likelihood_and_slopes():
    kernel, d = P.SumKernel(BLOCKS), rows(12)
    theta = kernel.start + np.linspace(-0.4, 0.5, len(kernel.start))
    x = kernel.features(d)
    k = plain_gram(d, d, theta)
    assert np.allclose(kernel.gram(theta, x, x), k, atol=1e-10)
    y = np.linspace(-1, 2, 12)
    noisy = k + math.exp(2 * theta[5]) * np.eye(12)
    want = y @ np.linalg.inv(noisy) @ y / 2 + np.linalg.slogdet(noisy)[1] / 2 + (((theta - kernel.start) / kernel.width) ** 2).sum() / 2
    value, slope = kernel.loss(theta, x, y)
    assert math.isclose(value, want, rel_tol=1e-9)
    numeric = [(kernel.loss(theta + e, x, y)[0] - kernel.loss(theta - e, x, y)[0]) / 2e-5 for e in np.eye(len(theta)) * 1e-5]
    assert np.allclose(slope, numeric, atol=1e-5)


def test_fits_by_number_of_ratings():
    kernel = P.SumKernel(BLOCKS)
    for n in (1, 4, 5, 20, 21, 40):
        d = rows(n, n)
        fit = P.fitted(kernel, d, "v")
        moved = np.flatnonzero(fit.theta != kernel.start).tolist()
        assert moved == [] if n <= 4 else set(moved) <= {kernel.signal} if n <= 20 else len(moved) > 3
        y = (d.v.to_numpy() - fit.mean) / fit.scale
        assert fit.loss <= kernel.loss(kernel.start, fit.x, y)[0] + 1e-12
        rng = np.random.default_rng(0)
        for _ in range(40 if n > 20 else 0):  # no point nearby is better
            assert kernel.loss(fit.theta + rng.normal(0, 0.02, len(fit.theta)), fit.x, y)[0] >= fit.loss - 1e-6
        if 4 < n <= 20:
            grid = [kernel.loss(np.where(np.arange(len(fit.theta)) == kernel.signal, s, kernel.start), fit.x, y)[0] for s in np.linspace(-3, 3, 601)]
            assert fit.loss <= min(grid) + 1e-9


def test_posterior_and_believer():
    kernel, d, t = P.SumKernel(BLOCKS), rows(9), rows(6, 3)
    fit = P.fitted(kernel, d, "v", optimize=False)
    noisy, cross = plain_gram(d, d, fit.theta) + 0.09 * np.eye(9), plain_gram(t, d, fit.theta)
    mean, covariance = fit.posterior(kernel.features(t))
    assert np.allclose(mean, fit.mean + cross @ np.linalg.solve(noisy, d.v - fit.mean))
    assert np.allclose(covariance, (plain_gram(t, t, fit.theta) - cross @ np.linalg.solve(noisy, cross.T)) * fit.scale**2)
    noise = 0.09 * fit.scale**2
    chosen, left = [], list(range(6))
    for _ in range(4):  # from scratch, as if those chosen had been rated at their means
        s = covariance[np.ix_(chosen, chosen)] + noise * np.eye(len(chosen))
        spread = [covariance[j, j] - covariance[j, chosen] @ np.linalg.solve(s, covariance[chosen, j]) if chosen else covariance[j, j] for j in left]
        chosen.append(left.pop(int(np.argmax([mean[j] + math.sqrt(max(v, 0)) for j, v in zip(left, spread)]))))
    assert P.believer(mean, covariance, noise, 4) == chosen and P.believer(mean, covariance, noise, 99)[:4] == chosen
    draws = np.array([P.thompson(mean, covariance, np.random.default_rng(i)) for i in range(4000)])
    assert np.allclose(draws.mean(axis=0), mean, atol=0.1) and np.allclose(np.cov(draws.T), covariance, atol=0.15)
    with pytest.raises(np.linalg.LinAlgError):
        P.thompson(np.zeros(2), np.array([[1.0, 2], [2, 1]]), np.random.default_rng(0))


def test_bounds_hold():
    x, value = P.minimized(lambda z: ((z - [3, -1, 0.2]) ** 2).sum(), lambda z: 2 * (z - [3, -1, 0.2]), np.zeros(3), -np.ones(3) / 2, np.ones(3))
    assert np.allclose(x, [1, -0.5, 0.2]) and math.isclose(value, 4.25)
    assert math.isclose(P.minimized_scalar(lambda s: (s - 0.7) ** 2, -3, 3), 0.7, abs_tol=1e-6)


def test_normal_mass_far_out():
    z = np.array([-np.inf, -40.0, -30.5, -29.5, -1.0, 0.0, 9.0, np.inf])
    got = P.log_mass_below(z)
    assert got[0] == -np.inf and got[-1] == 0 and math.isclose(got[5], math.log(0.5))
    assert math.isclose(got[1], -804.608442, rel_tol=1e-6) and abs((got[2] - got[3]) - (P.log_mass_below(np.array([-30.4]))[0] - P.log_mass_below(np.array([-29.4]))[0]) ) < 1.1
    log_p, slope, bend = P.rating_terms(np.array([60.0, -60.0, 0.3]), np.array([0, 2, 1]), np.array([-1.0, 1.0]))
    assert np.isfinite(log_p).all() and np.isfinite(slope).all() and (bend < 0).all()


def test_modes_by_search():
    cuts = np.array([-0.8, 0.4, 1.0])
    k = np.array([[1.0, 0.6], [0.6, 1.2]])
    y = np.array([3, 0])
    mode = P.laplace(k, y, cuts)
    inverse = np.linalg.inv(k)
    grid = np.linspace(-2.5, 2.5, 501)
    a, b = np.meshgrid(grid, grid, indexing="ij")
    value = P.rating_terms(a.ravel(), np.full(a.size, 3), cuts)[0] + P.rating_terms(b.ravel(), np.full(a.size, 0), cuts)[0]
    value -= (inverse[0, 0] * a**2 + 2 * inverse[0, 1] * a * b + inverse[1, 1] * b**2).ravel() / 2
    best = np.unravel_index(int(np.argmax(value)), a.shape)
    assert np.allclose(mode.f, [grid[best[0]], grid[best[1]]], atol=0.011)
    # the evidence is near the integral of likelihood times prior
    step = grid[1] - grid[0]
    whole = np.log(np.exp(value).sum() * step**2 / (2 * math.pi * math.sqrt(np.linalg.det(k))))
    assert abs(mode.evidence - whole) < 0.1
    with pytest.raises(ArithmeticError):
        P.laplace(k, y, cuts, rounds=1)


def test_cut_points_have_the_highest_evidence():
    d = rows(25, 7)
    kernel = P.SumKernel(BLOCKS)
    x = kernel.features(d)
    k = kernel.gram(kernel.start, x, x) + 1e-8 * np.eye(25)
    y = d.v.to_numpy().astype(int) - 1
    cuts, mode = P.fitted_cuts(k, y, 5)
    assert (np.diff(cuts) > 0).all()
    start = P.first_cuts(y, 5, float(np.diag(k).mean()))
    at = np.concatenate((cuts[:1], np.log(np.diff(cuts))))
    score = lambda z: -P.laplace(k, y, P._cuts(z)).evidence + 0.01 * ((z - start) ** 2).sum()
    rng = np.random.default_rng(2)
    low, high = np.r_[-10.0, [-4.0] * 3], np.r_[10.0, [3.0] * 3]
    assert all(score(np.clip(at + rng.normal(0, 0.05, 4), low, high)) >= score(at) - 1e-5 for _ in range(60))


def frame(spark, d, columns):
    return spark.createDataFrame([tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in r) for r in d[columns].itertuples(index=False)], ", ".join(f"{c} {'bigint' if c in ('user', 'item') else 'double' if c == 'v' else 'array<double>'}" for c in columns))


def test_users_of_a_table(spark):
    a = pd.concat([rows(3, 1), rows(30, 2)])
    b = pd.concat([rows(5, 1), rows(5, 2), rows(2, 3)])
    features = ["user", "item", "c", "l", "p", "m"]
    train, test = frame(spark, a, [*features, "v"]), frame(spark, b, features)
    got = {(r.user, r.item): r for r in P.predictions(train, test, "user", "item", "v", BLOCKS).collect()}
    assert len(got) == 12 and got[3, 0].mean is None
    for u in (1, 2):
        fit = P.fitted(P.SumKernel(BLOCKS), a[a.user == u], "v")
        mean, _ = fit.posterior(fit.kernel.features(b[b.user == u]))
        assert np.allclose([got[u, i].mean for i in range(5)], mean)
    shares = P.rating_probabilities(train, test, "user", "item", "v", BLOCKS).where("user < 3").collect()
    assert all(math.isclose(sum(r.probabilities), 1, abs_tol=1e-9) and 1 <= r.expected <= 5 for r in shares) and len(shares) == 10
    fits = {r.user: r for r in P.user_fits(train, "user", "item", "v", BLOCKS).collect()}
    assert fits[2].loss < fits[2].start_loss and fits[1].loss == fits[1].start_loss
    more = test.withColumn("item", test["item"] + 2).unionByName(test.withColumn("item", test["item"] + 28))
    for draw in (None, 5):
        batch = P.batches(train, more, "user", "item", "v", BLOCKS, k=3, draw=draw).collect()
        assert {r.user for r in batch} == {1, 2} and all(r.item > 2 for r in batch) and all(r.item > 29 for r in batch if r.user == 2)
        assert [r.place for r in batch if r.user == 1] == [1, 2, 3] and len({r.item for r in batch if r.user == 1}) == 3
    with pytest.raises(Exception, match="more than 10 ratings: user 2"):
        P.predictions(train, test, "user", "item", "v", BLOCKS, most=10).collect()
    with pytest.raises(Exception, match="no whole number"):
        P.rating_probabilities(train.withColumn("v", train["v"] + 0.5), test, "user", "item", "v", BLOCKS).collect()
    assert P.predictions(train.limit(0), test, "user", "item", "v", BLOCKS).where("mean IS NOT NULL").count() == 0


def test_equal_items_are_one_place_and_a_fit_takes_few_steps_of_each_kind(monkeypatch):
    """The loss of repeated items is that of the whole matrix; a value and its slope share one factor; cut points have
    slopes of their own instead of eight searches each."""
    rng = np.random.default_rng(5)
    kernel = P.SumKernel((P.Block("e", "plain"), P.Block("m", "matern", 2)))
    x = [np.repeat(rng.normal(size=(9, d)), 4, axis=0) for d in (3, 2)]
    y = rng.normal(size=36)
    theta = kernel.start + rng.normal(0, 0.3, len(kernel.start))
    k = kernel.gram(theta, x, x) + math.exp(2 * theta[kernel.signal + 1]) * np.eye(36)
    gap = (theta - kernel.start) / kernel.width
    assert math.isclose(kernel.loss(theta, x, y)[0], y @ np.linalg.solve(k, y) / 2 + np.linalg.slogdet(k)[1] / 2 + gap @ gap / 2, rel_tol=1e-10)
    own = P.Likelihood(kernel, x, y)
    assert math.isclose(own.by_signal(theta)(theta[kernel.signal]), own.value(theta), rel_tol=1e-10)
    stars = rng.integers(0, 5, 36)
    cuts = np.array([-1.0, -0.2, 0.4, 1.1])
    score = lambda c: P.laplace(k, stars, c).evidence
    numeric = [(score(cuts + d) - score(cuts - d)) / 2e-5 for d in np.eye(4) * 1e-5]
    assert np.allclose(P.evidence_slope(k, stars, cuts, P.laplace(k, stars, cuts)), numeric, atol=1e-5)
    calls = []
    laplace = P.laplace
    monkeypatch.setattr(P, "laplace", lambda *a, **b: (calls.append(1), laplace(*a, **b))[1])
    P.fitted_cuts(k, stars, 5)
    assert len(calls) < 60


def test_many_users_at_once_and_items_apart(spark, monkeypatch):
    """Users are fitted together in few steps each, to the same last bit whoever is beside them, no worse than one by one; with
    items apart the rows are those of features in each row, and rows of items without features are left out."""
    kernel = P.SumKernel(BLOCKS)
    frames = [rows(n, seed) for n, seed in ((24, 1), (30, 2), (9, 3), (30, 4), (33, 5), (3, 6))]
    x, y = [kernel.features(d) for d in frames], [d.v.to_numpy() for d in frames]
    steps = []
    slopes = P.Together.slopes
    monkeypatch.setattr(P.Together, "slopes", lambda self, *a: (steps.append(len(self.y)), slopes(self, *a))[1])
    fits = P.fitted_many(kernel, x, y)
    assert 4 < sum(steps) < 4 * 30
    for u in range(len(frames)):
        alone = P.fitted_many(kernel, x[u : u + 1], y[u : u + 1])[0]
        assert np.array_equal(alone.theta, fits[u].theta) and alone.loss == fits[u].loss
        single = P._fit(kernel, P.Likelihood(kernel, x[u], (y[u] - fits[u].mean) / fits[u].scale), len(y[u]), kernel.start.copy(), x[u], fits[u].mean, fits[u].scale, True)
        assert fits[u].loss <= single.loss + 1e-7 and math.isclose(fits[u].start_loss, single.start_loss, rel_tol=1e-10)
        assert np.allclose(fits[u].posterior(x[0])[0], single.posterior(x[0])[0], atol=2e-3)
    monkeypatch.setattr(P, "MANY_PLACES", 8)
    assert abs(P.fitted_many(kernel, x[:1], y[:1])[0].loss - fits[0].loss) < 1e-5
    monkeypatch.undo()
    things = rows(40, 9)
    rng = np.random.default_rng(3)
    picked = pd.concat([things.iloc[rng.integers(0, 40, 24)].assign(user=u, v=rng.integers(1, 6, 24).astype(float)) for u in range(30)])
    asked = pd.concat([things.iloc[rng.permutation(40)[:9]].assign(user=u) for u in range(1, 31)])
    features = ["item", "c", "l", "p", "m"]
    train, test, items = frame(spark, picked, ["user", *features, "v"]), frame(spark, asked, ["user", *features]), frame(spark, things[things.item > 3], features)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for f in (P.predictions, P.batches, P.rating_probabilities):
            a = f(train.where("item > 3"), test.where("item > 3"), "user", "item", "v", BLOCKS).collect()
            b = f(train.select("user", "item", "v"), test.select("user", "item"), "user", "item", "v", BLOCKS, items=items).collect()
            assert len(a) > 60 and sorted(map(str, a)) == sorted(map(str, b))
        a = P.user_fits(train.where("item > 3"), "user", "item", "v", BLOCKS).collect()
        assert len(a) == 30 and sorted(map(str, a)) == sorted(map(str, P.user_fits(train.select("user", "item", "v"), "user", "item", "v", BLOCKS, items=items).collect()))
        with pytest.raises(Exception, match="more than 20 ratings: user"):
            P.user_fits(train, "user", "item", "v", BLOCKS, most=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
