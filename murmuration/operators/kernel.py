"""The particle model's updates in NumPy, for one frame of one video: scores, moments, posteriors, schedule.

Points are read by the scoring passes and by two moment passes; every other update runs on the moments, a row a blob.
Modes: `map` takes the most likely value of every conditional, `mean` posterior means of continuous ones, `sample` draws
every assignment, mean, covariance, rotation and translation. Every draw of every round has a key of its own, and draws
for points hang on their ids, so that nothing changes with the order or the partitions that points come in.

A step is a generator (updates) that asks for passes over the points and is sent their moments: step runs it over arrays,
operators/sweep.py over points that are spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass, field, replace

import numpy as np


@dataclass(frozen=True)
class Hypers:
    outlier: float = 1e-28
    gamma: tuple[float, float] = (1.0, 1.0)
    beta: float = 0.1
    sigma_v: float = 0.05
    sigma_h: float = 4.0
    sigma_f: float = 0.05
    sigma_f_h: float = 0.05  # of blob features about their hyperblob's
    alpha: float = 1.0  # of hyperblob weights
    prior_f: tuple[float, float] = (0.0, 1.0)
    nu0: float = 5.0
    psi0: float = 0.01
    motion: tuple[int, float] = (2, 0.05)
    cap: tuple[float, float] = (10.0, 5.0)  # rotation candidates: widest angle and step, degrees
    feature_weight: float = 1.0
    stickiness: float = 0.0
    means: int = 1
    covs: bool = False  # whether a frame updates the blobs' covariances, as a full sweep does
    hyper_rounds: int = 3
    by_weight: bool = False  # whether hyperblob weights follow their blobs' weights instead of their number
    mode: str = "map"
    seed: int = 0


@dataclass
class State:
    weight: np.ndarray  # L
    mean: np.ndarray  # L x 3
    cov: np.ndarray  # L x 3 x 3
    vel: np.ndarray  # L x 3
    vel_cov: np.ndarray
    feat: np.ndarray  # L x D
    hyper: np.ndarray  # L, hyperblob of each blob
    h_mean: np.ndarray  # K x 3
    h_cov: np.ndarray
    h_trans: np.ndarray
    h_rot: np.ndarray  # K x 3 x 3
    h_feat: np.ndarray
    h_weight: np.ndarray | None = None  # K; None counts as equal weights
    assigned: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    frame: int = 0


#: What is drawn; a draw's key is one of these and its round.
ASSIGN, FINAL, MEAN, VELOCITY, COV, VELOCITY_COV, HYPER, HYPER_MEAN, HYPER_COV, TURN, SHIFT, START, START_VELOCITY, START_HYPER = range(14)
Draw = tuple[int, int]


def stream(seed: int, frame: int, draw: Draw) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, frame, *draw])))


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed: int, frame: int, draw: Draw, ids: np.ndarray, n: int) -> np.ndarray:
    """len(ids) x n numbers in (0, 1) that hang on the key, the row's id and the column alone."""
    base = np.random.SeedSequence([seed, frame, *draw]).generate_state(1, np.uint64)
    rows = _mixed(np.asarray(ids, np.int64).view(np.uint64) + base)
    cells = _mixed(rows[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((cells >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def floor_eigen(m: np.ndarray, ratio: float = 1e6) -> np.ndarray:
    """Symmetric matrices with eigenvalues at least 1e-6 and at least the largest over `ratio`."""
    e, v = np.linalg.eigh((m + np.swapaxes(m, -1, -2)) / 2)
    e = np.maximum(e, 1e-6)
    e = np.maximum(e, e[..., -1:] / ratio)
    return np.einsum("...ij,...j,...kj->...ik", v, e, v)


def drawn_means(mean: np.ndarray, prec: np.ndarray, h: Hypers, frame: int, draw: Draw) -> np.ndarray:
    """In sample mode draws about the posterior means with these precisions, else the means."""
    if h.mode != "sample" or not len(mean):
        return mean
    low = np.linalg.cholesky(prec)
    return mean + np.linalg.solve(np.swapaxes(low, 1, 2), stream(h.seed, frame, draw).standard_normal(mean.shape)[..., None])[..., 0]


def drawn_cov(psi: np.ndarray, nu: np.ndarray, h: Hypers, frame: int, draw: Draw) -> np.ndarray:
    """Inverse-Wishart of each psi and nu: its mode (map), mean (mean) or a draw by Bartlett's decomposition (sample)."""
    d = psi.shape[-1]
    if h.mode == "map":
        return psi / (nu + d + 1)[:, None, None]
    if h.mode == "mean":
        return psi / np.maximum(nu - d - 1, 1)[:, None, None]
    rng = stream(h.seed, frame, draw)
    a = np.tril(rng.standard_normal((len(psi), d, d)), -1)
    a[:, np.arange(d), np.arange(d)] = np.sqrt(rng.chisquare(np.maximum(nu[:, None] - np.arange(d), 1e-3)))
    # W = L A A' L' with L L' = inv(psi); its inverse is C C' with C = inv(L A)'
    low = np.linalg.cholesky(np.linalg.inv(psi)) @ a
    c = np.swapaxes(np.linalg.inv(low), 1, 2)
    return c @ np.swapaxes(c, 1, 2)


def log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """N x L log densities; precisions and determinants once a blob, at most `most` pairs of point and blob at a time.

    x'Px - 2x'Pm + m'Pm is one product of matrices: of each point's products of coordinates with each blob's coefficients,
    both about the middle of the means, so that little is lost to cancellation.
    """
    p, d = np.linalg.inv(cov), x.shape[1]
    _, det = np.linalg.slogdet(cov)
    middle = mean.mean(axis=0) if len(mean) else np.zeros(d)
    m = mean - middle
    i, j = np.triu_indices(d)
    pm = np.einsum("lij,lj->li", p, m)
    square = p[:, i, j] * np.where(i == j, 1.0, 2.0)
    fixed = np.einsum("li,li->l", pm, m) + det + d * np.log(2 * np.pi)
    coefficients = np.concatenate([square, -2 * pm, fixed[:, None]], axis=1).T * -0.5
    out, block = np.empty((len(x), len(mean))), max(1, most // max(1, len(mean)))
    for k in range(0, len(x), block):
        y = x[k : k + block] - middle
        out[k : k + block] = np.concatenate([y[:, i] * y[:, j], y, np.ones((len(y), 1))], axis=1) @ coefficients
    return out


def scores(x: np.ndarray, v: np.ndarray, f: np.ndarray | None, s: State, h: Hypers, terms: str = "pvf") -> np.ndarray:
    """N x (L + 1): blobs, then the outlier column."""
    total = s.weight.sum() + h.outlier
    out = np.log(np.maximum(s.weight, 1e-300) / total)[None]
    if "p" in terms:
        out = out + log_normal(x, s.mean, s.cov)
    if "v" in terms:
        out = out + log_normal(v, s.vel, s.vel_cov)
    if "f" in terms and f is not None and f.shape[1]:
        d = ((f * f).sum(1)[:, None] - 2 * f @ s.feat.T + (s.feat * s.feat).sum(1)[None]) / h.sigma_f
        out = out + h.feature_weight * -0.5 * (d + f.shape[1] * np.log(2 * np.pi * h.sigma_f))
    a, b = h.gamma
    speed = np.linalg.norm(v, axis=1)
    last = (a - 1) * np.log(speed + 1e-8) - b * speed + a * np.log(b) + (np.log(h.outlier / total) if h.outlier > 0 else -np.inf)
    return np.hstack([np.broadcast_to(out, (len(x), len(s.weight))), last[:, None]])


def choose(score: np.ndarray, h: Hypers, frame: int, draw: Draw, ids: np.ndarray | None = None) -> np.ndarray:
    if h.mode == "sample":
        score = score - np.log(-np.log(uniform(h.seed, frame, draw, np.arange(len(score)) if ids is None else ids, score.shape[1])))
    return score.argmax(axis=1)


def summed(z: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    """n x ... sums of the rows of x by blob; outliers (z >= n) left out."""
    flat = x.reshape(len(x), -1)
    return np.stack([np.bincount(z, c, n + 1)[:n] for c in flat.T], axis=1).reshape(n, *x.shape[1:]) if flat.shape[1] else np.zeros((n, *x.shape[1:]))


def moments(z: np.ndarray, n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and second moments by blob; outliers (z >= n) left out."""
    z = np.minimum(z, n)
    return np.bincount(z, minlength=n + 1)[:n].astype(float), summed(z, n, x), summed(z, n, x[:, :, None] * x[:, None, :])


def posterior_cov(n: np.ndarray, s: np.ndarray, ss: np.ndarray, mean: np.ndarray, old: np.ndarray, h: Hypers, frame: int = 0, draw: Draw = (COV, 0)) -> np.ndarray:
    """The inverse-Wishart posterior about the current means, by the mode; the old one for fewer than three points."""
    sm = np.einsum("li,lj->lij", s, mean)
    psi = ss - sm - np.swapaxes(sm, 1, 2) + n[:, None, None] * np.einsum("li,lj->lij", mean, mean) + h.psi0 * np.eye(3)
    new = floor_eigen(drawn_cov(floor_eigen(psi, 1e9), h.nu0 + n, h, frame, draw), 1e3)
    return np.where((n >= 3)[:, None, None], new, old)


def predicted(s: State, k: np.ndarray | None = None) -> np.ndarray:
    """Velocities that hyperblob motions give blobs: t + (R - I)(x - m); of each blob's own hyperblob, or L x K of all."""
    if k is not None:
        a = s.h_rot[k] - np.eye(3)
        return s.h_trans[k] + np.einsum("lij,lj->li", a, s.mean - s.h_mean[k])
    a = s.h_rot - np.eye(3)
    return s.h_trans[None] + np.einsum("kij,lkj->lki", a, s.mean[:, None] - s.h_mean[None])


def blob_means(s: State, n: np.ndarray, sx: np.ndarray, h: Hypers, turn: int = 0) -> np.ndarray:
    """Hyperblob prior, points, and the blob's velocity, which its place explains in part: A x + b with A = R - I."""
    p0, p = np.linalg.inv(s.h_cov)[s.hyper], np.linalg.inv(s.cov)
    a = (s.h_rot - np.eye(3))[s.hyper]
    b = s.h_trans[s.hyper] - np.einsum("lij,lj->li", a, s.h_mean[s.hyper])
    prec = p0 + n[:, None, None] * p + np.einsum("lji,ljk->lik", a, a) / h.sigma_v
    rhs = np.einsum("lij,lj->li", p0, s.h_mean[s.hyper]) + np.einsum("lij,lj->li", p, sx) + np.einsum("lji,lj->li", a, s.vel - b) / h.sigma_v
    return drawn_means(np.linalg.solve(prec, rhs[..., None])[..., 0], prec, h, s.frame, (MEAN, turn))


def blob_velocities(s: State, n: np.ndarray, sv: np.ndarray, h: Hypers) -> np.ndarray:
    p = np.linalg.inv(s.vel_cov)
    prec = np.eye(3) / h.sigma_v + n[:, None, None] * p
    rhs = predicted(s, s.hyper) / h.sigma_v + np.einsum("lij,lj->li", p, sv)
    return np.where((n > 0)[:, None], drawn_means(np.linalg.solve(prec, rhs[..., None])[..., 0], prec, h, s.frame, (VELOCITY, 0)), 0.0)


def normal_means(n: np.ndarray, s: np.ndarray, cov: np.ndarray, prior_mean: np.ndarray, prior_cov: np.ndarray) -> np.ndarray:
    """Means with a prior of each blob's own (a transition's prediction, say); blobs without points keep it."""
    p0, p = np.linalg.inv(prior_cov), np.linalg.inv(cov)
    rhs = np.einsum("lij,lj->li", p0, prior_mean) + np.einsum("lij,lj->li", p, s)
    return np.linalg.solve(p0 + n[:, None, None] * p, rhs[..., None])[..., 0]


def flat_means(n: np.ndarray, sx: np.ndarray, cov: np.ndarray, h: Hypers) -> np.ndarray:
    """Blob means without the hierarchy: the prior is zero with variance sigma_h."""
    return normal_means(n, sx, cov, np.zeros_like(sx), np.repeat(h.sigma_h * np.eye(3)[None], len(n), 0))


def flat_velocities(n: np.ndarray, sv: np.ndarray, cov: np.ndarray, h: Hypers) -> np.ndarray:
    """Blob velocities without the hierarchy; zero for blobs without points."""
    return np.where((n > 0)[:, None], normal_means(n, sv, cov, np.zeros_like(sv), np.repeat(h.sigma_v * np.eye(3)[None], len(n), 0)), 0.0)


def feature_means(n: np.ndarray, sf: np.ndarray, h: Hypers) -> np.ndarray:
    m, var = h.prior_f
    return (m / var + sf / h.sigma_f) / (1 / var + n / h.sigma_f)[:, None]


def hyper_feature_means(n: np.ndarray, sf: np.ndarray, h: Hypers) -> np.ndarray:
    """Posterior of hyperblob features from their blobs' features; the prior for one without blobs."""
    m, var = h.prior_f
    return (m / var + sf / h.sigma_f_h) / (1 / var + n / h.sigma_f_h)[:, None]


def hyper_weights(n: np.ndarray, h: Hypers, weighted: np.ndarray | None = None) -> np.ndarray:
    """Posterior mean weights of hyperblobs from counts of blobs, or from the blobs' summed weights."""
    c = n if weighted is None else weighted
    return (h.alpha + c) / (len(n) * h.alpha + c.sum())


def hyper_scores(s: State, h: Hypers) -> np.ndarray:
    """L x K log weights and likelihoods of blobs: place, velocity, and feature where there are features."""
    weight = np.log(np.maximum(s.h_weight, 1e-300)) if s.h_weight is not None else 0.0
    out = weight + log_normal(s.mean, s.h_mean, s.h_cov) - 0.5 * (((s.vel[:, None] - predicted(s)) ** 2).sum(-1) / h.sigma_v + 3 * np.log(2 * np.pi * h.sigma_v))
    if s.feat.shape[1]:
        d = ((s.feat[:, None] - s.h_feat[None]) ** 2).sum(-1) / h.sigma_f_h
        out = out - 0.5 * h.feature_weight * (d + s.feat.shape[1] * np.log(2 * np.pi * h.sigma_f_h))
    return out


def motions(h: Hypers) -> tuple[np.ndarray, np.ndarray]:
    k, size = h.motion
    axis = np.arange(-k, k + 1) * size
    grid = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1).reshape(-1, 3)
    return grid, -0.5 * (grid**2).sum(1)


def rotations(h: Hypers) -> np.ndarray:
    """Rotations that take +z to directions on a cap: rings of theta, ceil(2 pi sin theta / step) of phi, at least one."""
    step, out = np.radians(h.cap[1]), []
    for theta in np.arange(0, np.radians(h.cap[0]) + 1e-9, step):
        n = max(1, int(np.ceil(round(2 * np.pi * np.sin(theta) / step, 9))))
        for phi in 2 * np.pi * np.arange(n) / n:
            v = np.array([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)])
            if v[2] < -1 + 1e-9:
                out.append(np.diag([1.0, -1.0, -1.0]))
                continue
            w = np.array([[0, 0, v[0]], [0, 0, v[1]], [-v[0], -v[1], 0]])  # of the axis z x v
            out.append(np.eye(3) + w + w @ w / (1 + v[2]))
    return np.array(out)


def hyperblobs(s: State, h: Hypers, turn: int = 0) -> State:
    """Assignments of blobs, then means, covariances, rotations and translations of hyperblobs."""
    k = len(s.h_mean)
    hyper = choose(hyper_scores(s, h), h, s.frame, (HYPER, turn))
    n, sx, sxx = moments(hyper, k, s.mean)
    h_weight = hyper_weights(n, h, np.bincount(hyper, s.weight, k) if h.by_weight else None)
    one = np.zeros((k, len(hyper)))
    one[hyper, np.arange(len(hyper))] = 1
    p, a = np.linalg.inv(s.h_cov), np.eye(3) - s.h_rot
    left = one @ s.vel - n[:, None] * s.h_trans + np.einsum("kij,kj->ki", a, sx)  # sum of v - (t - A x)
    prec = np.eye(3) / h.sigma_h + n[:, None, None] * (p + np.einsum("kji,kjl->kil", a, a) / h.sigma_v)
    mean = np.linalg.solve(prec, (np.einsum("kij,kj->ki", p, sx) + np.einsum("kji,kj->ki", a, left) / h.sigma_v)[..., None])[..., 0]
    mean = drawn_means(mean, prec, h, s.frame, (HYPER_MEAN, turn))
    cov = posterior_cov(n, sx, sxx, mean, s.h_cov, h, s.frame, (HYPER_COV, turn))
    s = replace(s, hyper=hyper, h_weight=h_weight, h_mean=mean, h_cov=cov)
    own, turns = s.mean - mean[hyper], rotations(h)
    spun = np.einsum("cij,lj->lci", turns - np.eye(3), own)
    rot = turns[choose(one @ -((s.vel[:, None] - s.h_trans[hyper][:, None] - spun) ** 2).sum(-1) / (2 * h.sigma_v), h, s.frame, (TURN, turn))]
    grid, prior = motions(h)
    rest = s.vel - np.einsum("lij,lj->li", (rot - np.eye(3))[hyper], own)
    trans = grid[choose(one @ -((rest[:, None] - grid[None]) ** 2).sum(-1) / (2 * h.sigma_v) + prior, h, s.frame, (SHIFT, turn))]
    return replace(s, h_rot=rot, h_trans=trans, h_feat=hyper_feature_means(n, one @ s.feat, h))


def start(x: np.ndarray, v: np.ndarray, f: np.ndarray, blobs: int, hypers: int, h: Hypers) -> State:
    """k-means on positions and velocities, then on blobs; closed-form parameters for each group."""
    z = kmeans(np.hstack([x, v]), blobs, h.seed)
    blobs = int(z.max()) + 1 if len(z) else 0
    n, sx, sxx = moments(z, blobs, x)
    _, sv, svv = moments(z, blobs, v)
    return replace(begun({"n": n, "x": sx, "xx": sxx, "v": sv, "vv": svv, "f": summed(z, blobs, f)}, [(np.arange(blobs), hypers)], h), assigned=z)


def begun(m: dict[str, np.ndarray], groups: list[tuple[np.ndarray, int]], h: Hypers) -> State:
    """A first state from the moments of blobs, none empty; each group of blobs makes up to so many hyperblobs, by k-means of its blobs."""
    n, blobs = m["n"], len(m["n"])
    mean, vel, feat = (m[c] / n[:, None] for c in "xvf")
    small = np.repeat(0.01 * np.eye(3)[None], blobs, 0)
    cov = posterior_cov(n, m["x"], m["xx"], mean, small, h, 0, (START, 0))
    vel_cov = posterior_cov(n, m["v"], m["vv"], vel, small, h, 0, (START_VELOCITY, 0))
    y, k = np.zeros(blobs, np.int64), 0
    for g, (own, most) in enumerate(groups):
        if len(own):
            y[own] = k + kmeans(np.hstack([mean, vel])[own], most, h.seed + 1 + g)
            k = int(y[own].max()) + 1
    count, sm, smm = moments(y, k, mean)
    h_mean = sm / count[:, None]
    weight = (h.beta + n) / (blobs * h.beta + n.sum())
    h_cov = posterior_cov(count, sm, smm, h_mean, np.repeat(np.eye(3)[None], k, 0), h, 0, (START_HYPER, 0))
    h_weight = hyper_weights(count, h, np.bincount(y, weight, k) if h.by_weight else None)
    return State(weight, mean, cov, vel, vel_cov, feat, y, h_mean, h_cov, summed(y, k, vel) / count[:, None], np.repeat(np.eye(3)[None], k, 0), hyper_feature_means(count, summed(y, k, feat), h), h_weight)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Labels 0 to at most k - 1, none empty; farthest-first start from a seeded point."""
    if len(x) <= k:
        return np.arange(len(x))
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(x[int(d.argmax())])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c, z = np.array(centres), None
    for _ in range(rounds):
        new = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]).argmin(1)
        if z is not None and (new == z).all():
            break
        z = new
        for j in np.unique(z):
            c[j] = x[z == j].mean(0)
    return np.unique(z, return_inverse=True)[1]


@dataclass(frozen=True)
class Ask:
    """A pass over a frame's points: assign each by these terms of the score, and sum up n and what is wanted (x, v, f) by blob."""

    state: State
    terms: str
    draw: Draw
    want: str = ""
    last: bool = False  # the frame's final assignment, which sticks to the one before


def swept(ask: Ask, x: np.ndarray, v: np.ndarray, f: np.ndarray, ids: np.ndarray | None, h: Hypers, before: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(assignment, moments by blob) of some or all points of a frame; before: their last assignment, negative where there is none."""
    s, n = ask.state, len(ask.state.weight)
    score = scores(x, v, f, s, h, ask.terms)
    if ask.last and h.stickiness and before is not None:
        some = np.flatnonzero(before >= 0)
        score[some, np.minimum(before[some], n)] += h.stickiness
    z = np.minimum(choose(score, h, s.frame, ask.draw, ids), n)
    m = {"n": np.bincount(z, minlength=n + 1)[:n].astype(float)}
    for name, values in (("x", x), ("v", v)):
        if name in ask.want:
            m[name], m[2 * name] = summed(z, n, values), summed(z, n, values[:, :, None] * values[:, None, :])
    if "f" in ask.want:
        m["f"] = summed(z, n, f)
    return z, m


def updates(s: State, h: Hypers) -> Generator[Ask, dict[str, np.ndarray], State]:
    """One frame: predict, hyperblobs, assignments with and without features, means, final assignment, velocities, features, hyperblobs. Yields passes over the points, is sent their moments, returns the state."""
    blobs = len(s.weight)
    weights = lambda n: (h.beta + n) / (blobs * h.beta + n.sum())
    s = replace(s, mean=s.mean + s.vel, frame=s.frame + 1)
    for i in range(h.hyper_rounds):
        s = hyperblobs(s, h, i)
    for i, (terms, want) in enumerate((("pvf", ""), ("pvf", ""), ("p", "x"))):
        m = yield Ask(s, terms, (ASSIGN, i), want)
        s = replace(s, weight=weights(m["n"]))
    for i in range(h.means):
        s = replace(s, mean=blob_means(s, m["n"], m["x"], h, i))
    if h.covs:
        s = replace(s, cov=posterior_cov(m["n"], m["x"], m["xx"], s.mean, s.cov, h, s.frame, (COV, 0)))
    m = yield Ask(s, "pvf", (FINAL, 0), "vf", True)
    s = replace(s, vel=blob_velocities(s, m["n"], m["v"], h), weight=weights(m["n"]))
    s = replace(s, vel_cov=posterior_cov(m["n"], m["v"], m["vv"], s.vel, s.vel_cov, h, s.frame, (VELOCITY_COV, 0)))
    if s.feat.shape[1]:
        s = replace(s, feat=feature_means(m["n"], m["f"], h))
    for i in range(h.hyper_rounds):
        s = hyperblobs(s, h, h.hyper_rounds + i)
    return s


def step(s: State, x: np.ndarray, v: np.ndarray, f: np.ndarray, h: Hypers, ids: np.ndarray | None = None) -> State:
    """updates over the arrays of one frame; draws hang on the points' ids, or else on their order."""
    before = s.assigned if len(s.assigned) == len(x) else None
    run = updates(s, h)
    ask = next(run)
    while True:
        z, m = swept(ask, x, v, f, ids, h, before)
        try:
            ask = run.send(m)
        except StopIteration as end:
            return replace(end.value, assigned=z)
