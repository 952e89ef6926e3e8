"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two words sums, over all subsequences of three letters, decay to the power of their spans, and is
normalised (Lodhi et al., 2002), so that inserted or missing letters lower it but do not end it. Landmarks are the words
that tell toxic from other training texts best, and some common words. A text's value at a landmark is the largest
kernel of any of its words with it, 0 below FLOOR; the landmark kernel's inverse root turns values into features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm._common import kept, mapped, work_dir, written
from murmuration.llm.langid import held_out

#: Letters of a subsequence, decay of each place it spans, least kernel that counts, longest word compared as a whole (longer ones in overlapping windows).
ORDER, DECAY, FLOOR, WIDTH = 3, 0.8, 0.45, 24
#: Expected training texts of each class, telling and common landmarks, words a Python worker remembers as far from every landmark.
SAMPLE, TELLING, COMMON, CACHE = 3000, 120, 8, 400_000

_EDGES = " \t\n.,;:!?$%&#*|()[]{}\"'«»„“”’-_+=/\\<>~^`@"
_SPELT = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
#: Three or more letters in turn, each parted from the next by signs other than white space.
_PARTED = re.compile(r"[^\W_](?:[^\w\s]{1,2}[^\W_]|_[^\W_]){2,}(?![^\W_])")
_LETTERS_OF = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    """Lower-case words of a text, runs of three or more single letters as a word, and words with signs between their letters (i-d-i-o-t) without them."""
    low = (text or "").lower()
    found = set(low.split())
    found.update("".join(m.split()) for m in _SPELT.findall(low))
    found.update("".join(_LETTERS_OF.findall(m)) for m in _PARTED.findall(low))
    return found


def _codes(ws: list[str]) -> np.ndarray:
    """Code points, WIDTH a row, 0 beyond the end."""
    return np.frombuffer("".join(w.ljust(WIDTH, "\0") for w in ws).encode("utf-32-le"), np.uint32).reshape(len(ws), WIDTH)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of each pair of rows."""
    ns, nt = (int((x != 0).any(axis=0).sum()) for x in (s, t))
    same = [[((s[:, i] == t[:, j]) & (s[:, i] != 0)).astype(np.float32) for j in range(nt)] for i in range(ns)]
    one, zero = np.ones(len(s), np.float32), np.zeros(len(s), np.float32)
    lower = [[one] * (nt + 1) for _ in range(ns + 1)]
    for _ in range(ORDER - 1):
        upper = [[zero] * (nt + 1) for _ in range(ns + 1)]
        for i in range(1, ns + 1):
            run = zero
            for j in range(1, nt + 1):
                run = DECAY * run + same[i - 1][j - 1] * (DECAY * DECAY) * lower[i - 1][j - 1]
                upper[i][j] = DECAY * upper[i - 1][j] + run
        lower = upper
    total = np.zeros(len(s), np.float64)
    for i in range(ns):
        for j in range(nt):
            total += same[i][j] * lower[i][j]
    return total * DECAY * DECAY


def _masks(codes: np.ndarray) -> np.ndarray:
    """Which letters a word has, by code modulo 64."""
    return np.bitwise_or.reduce(np.where(codes == 0, np.uint64(0), np.uint64(1) << (codes % 64).astype(np.uint64)), axis=1)


def _ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each letter, by code modulo 64, in each word; of missing ones 99 and -1."""
    first, last = np.full((len(codes), 64), 99, np.int8), np.full((len(codes), 64), -1, np.int8)
    for j in range(WIDTH):
        rows = np.flatnonzero(codes[:, j])
        last[rows, codes[rows, j] % 64] = j
        rows = np.flatnonzero(codes[:, WIDTH - 1 - j])
        first[rows, codes[rows, WIDTH - 1 - j] % 64] = WIDTH - 1 - j
    return first, last


def parts(word: str) -> tuple[np.ndarray, np.ndarray]:
    """A word's subsequences of three letters, by codes modulo 64, and the share of each in the square of its norm."""
    weight: dict[tuple[int, ...], float] = {}
    for at in combinations(range(len(word)), ORDER):
        key = tuple(ord(word[i]) for i in at)
        weight[key] = weight.get(key, 0.0) + DECAY ** (at[-1] - at[0] + 1)
    grams, mass = np.array(list(weight), np.int64).reshape(-1, ORDER) % 64, np.array(list(weight.values())) ** 2
    return grams, mass / max(mass.sum(), 1e-300)


def least_letters(grams: np.ndarray, mass: np.ndarray) -> int:
    """How many of its letters a word must share for a kernel of FLOOR: what the shared letters leave of the norm bounds the kernel (Cauchy-Schwarz)."""
    letters = np.unique(grams)
    if len(letters) > 12:
        return 2
    own = np.bitwise_or.reduce(1 << np.searchsorted(letters, grams), axis=1) if len(grams) else np.empty(0, np.int64)
    sets = np.arange(1 << len(letters))
    left = np.array([mass[(own & ~s) == 0].sum() for s in sets])
    return int(np.bitwise_count(sets[left >= FLOOR * FLOOR - 1e-6]).min(initial=64))


class Featurizer:
    """Largest kernel of a text's words with each landmark."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.codes = _codes([w[:WIDTH] for w in landmarks])
        self.own = np.sqrt(kernel(self.codes, self.codes)) if landmarks else np.empty(0)
        self.masks = _masks(self.codes)
        self.parts = [parts(w[:WIDTH]) for w in landmarks]
        self.least = np.array([least_letters(*p) for p in self.parts], np.uint8)
        self.near: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.far: dict[str, None] = {}

    def _learn(self, new: list[str]) -> None:
        parts, owner = [], []
        for n, w in enumerate(new):
            w = w.strip(_EDGES)
            for i in range(0, max(1, len(w) - WIDTH // 2), WIDTH // 2) if len(w) > WIDTH else (0,):
                if len(w) >= ORDER:
                    parts.append(w[i : i + WIDTH])
                    owner.append(n)
        got: dict[int, dict[int, float]] = {}
        order = np.argsort([len(p) for p in parts], kind="stable") if parts else []
        for at in range(0, len(order), 4096):  # words of like length, few pairs at a time
            rows = order[at : at + 4096]
            codes = _codes([parts[i] for i in rows])
            shared = np.bitwise_count(_masks(codes)[:, None] & self.masks[None, :])
            fit = shared >= self.least[None, :]
            first, last = _ends(codes)
            for n, (grams, mass) in enumerate(self.parts):  # what the letters in order leave of the norm bounds the kernel, too
                some = np.flatnonzero(fit[:, n])
                x, y, z = grams.T
                one, two = first[some], last[some]
                fit[some, n] = ((one[:, x] < two[:, y]) & (one[:, y] < two[:, z])) @ mass >= FLOOR * FLOOR - 1e-6
            a, b = np.nonzero(fit)
            if not len(a):
                continue
            used = np.unique(a)
            own = np.ones(len(rows))
            own[used] = np.sqrt(np.maximum(kernel(codes[used], codes[used]), 1e-12))
            value = np.concatenate([kernel(codes[a[i : i + 16384]], self.codes[b[i : i + 16384]]) for i in range(0, len(a), 16384)]) / (own[a] * np.maximum(self.own[b], 1e-6))
            for i in np.flatnonzero(value >= FLOOR):
                best = got.setdefault(owner[rows[a[i]]], {})
                best[int(b[i])] = max(best.get(int(b[i]), 0.0), float(min(1.0, value[i])))
        for n, w in enumerate(new):
            if n in got:
                self.near[w] = np.array(list(got[n])), np.array(list(got[n].values()))
            else:
                self.far[w] = None

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.landmarks)))
        if not self.landmarks:
            return out
        for i in range(0, len(texts), 256):
            if len(self.far) > CACHE:  # what came first is mostly what is common
                self.far = dict.fromkeys(islice(self.far, CACHE // 2))
            if len(self.near) > CACHE // 4:
                self.near.clear()
            sets = [words(t) for t in texts[i : i + 256]]
            new = set().union(*sets).difference(self.far).difference(self.near)
            if new:
                self._learn(sorted(new))
            for n, s in enumerate(sets):
                for w in s.difference(self.far):
                    at, value = self.near[w]
                    np.maximum.at(out[i + n], at, value)
        return out


@dataclass
class Model:
    landmarks: list[str]
    root: np.ndarray  # inverse root of the landmarks' kernel
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    base: float  # the score where nothing could be learned

    def scores(self, values: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(values), self.base)
        f = values @ self.root @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.offset, -40, 40)))


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; y is 1 or -1, classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    most = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    size, alpha, w = (x * x).sum(axis=1), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (w @ x[i])) / size[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (f, y), by Newton steps; classes weigh the same, targets as Platt has them."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / max(1, pos), 0.5 / max(1, neg))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -40, 40)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * f).sum() + 1e-4 * (a - 1), g.sum()])
        hess = np.array([[(h * f * f).sum() + 1e-4, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def learn(docs: DataFrame, labels: DataFrame, folder: str, sample: int = SAMPLE) -> Model:
    """Fit on docs (id, text) and labels (id, toxic: 0 or 1, an id once); on about `sample` labels of each class, chosen by hash (documented bound).

    The sampled labels are broadcast, their texts written once. Gathered on the driver: landmarks, and one row of values
    for each sampled text.
    """
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 1.0, 0.0, 1.0 if counts.get(1) else 0.0)
    rate = {k: min(1.0, sample / n) for k, n in counts.items()}
    limit = F.when(F.col("toxic") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0]))
    some = labels.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1_000_000)) < limit * 1_000_000)
    chosen = written(docs.where("text is not null").join(F.broadcast(some), "id").select("text", "toxic"), folder, "training")
    # copies count once among the words: a group of them would make its own words telling
    once = written(chosen.groupBy("text").agg(F.max("toxic").alias("toxic")), folder, "once")
    size = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in {x.strip(_EDGES)[:WIDTH] for x in words(text)}:
                    if len(w) >= ORDER:
                        seen.setdefault(w, [0, 0])[toxic] += 1
        items = list(seen.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part]), pa.array([n[0] for _, n in part], pa.int64()), pa.array([n[1] for _, n in part], pa.int64())], names=["w", "other", "toxic"])

    share = size.get(1, 0) / max(1, size.get(0, 0))
    expected = F.col("other") * share
    words_ = mapped(once, count, "w string, other long, toxic long").groupBy("w").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    words_ = words_.select("w", "other", "toxic", ((F.col("toxic") - expected) / F.sqrt(1 + expected)).alias("z"))
    telling = [r["w"] for r in words_.where((F.col("toxic") >= min(2, size.get(1, 0))) & (F.col("z") >= 1)).orderBy(F.desc("z"), "w").limit(TELLING).collect()]
    common = [r["w"] for r in words_.orderBy(F.desc("other"), "w").limit(COMMON).collect()]
    landmarks = list(dict.fromkeys(telling + common))
    if not landmarks:
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 1.0, 0.0, counts[1] / (counts[0] + counts[1]))
    x, y = [], []
    for r in values(chosen, landmarks, "text").collect():
        x.append(r["values"])
        y.append(1.0 if r["toxic"] else -1.0)
    order = np.lexsort(np.round(np.array(x).T, 9)) if x else []
    x, y = np.array(x)[order], np.array(y)[order]  # rows come in any order
    codes = _codes(landmarks)
    a, b = (i.ravel() for i in np.indices((len(landmarks), len(landmarks))))
    own = np.sqrt(kernel(codes, codes))
    k = (kernel(codes[a], codes[b]) / (own[a] * own[b])).reshape(len(landmarks), -1)
    e, v = np.linalg.eigh(k)
    root = v @ np.diag(1 / np.sqrt(np.maximum(e, 1e-2))) @ v.T
    w, bias = svm(x @ root, y)
    slope, offset = calibrate(x @ root @ w + bias, y)
    return Model(landmarks, root, w, bias, slope, offset, 0.0)


def featurizer(landmarks: list[str]) -> Featurizer:
    """Kept by each Python worker, with the words it has met."""
    return kept(tuple(landmarks), lambda: Featurizer(landmarks))


def values(rows: DataFrame, landmarks: list[str], text_col: str) -> DataFrame:
    """Every row's other columns, and values: its text's value at each landmark."""
    names = [c for c in rows.columns if c not in (text_col, "values")]
    rows = rows.select(*names, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = featurizer(landmarks)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([*c.columns[:-1], pa.array(list(f(c.column(len(names)).to_pylist())), pa.list_(pa.float64()))], names=[*names, "values"])

    return mapped(rows, run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", values array<double>")


def predict(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row's columns but the text, score and predicted. Null and empty texts are scored as texts without words."""
    names = [c for c in rows.columns if c not in (text_col, "score", "predicted")]
    rows = rows.select(*names, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = featurizer(model.landmarks)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                s = model.scores(f(c.column(len(names)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*c.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return mapped(rows, run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", score double, predicted int")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every row; learned from labelled rows whose crc32 of the id mod 5 is not 0.

    Labels other than 0 and 1 and labels of null ids are not learned from; an id with several labels is learned once, as
    toxic if any says so; rows that repeat an id are scored each. Without texts of both classes every score is 1 if all
    labels are 1, else 0. A null id is not held out. Empty table: empty result.
    """
    out = held_out(id_col, 5, 0)
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col, 5, 0) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = learn(rows.select("id", "text"), known, work_dir(docs.sparkSession))
    return predict(rows, model, "text")
