"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a 3-gram is the product of its letters' vectors, each rotated by its place;
a text is the sum of its 3-grams, a language that of its sample texts. Texts go to the language of highest cosine. All
sums are of integers, so that results do not hang on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm._common import kept, mapped

#: Dimensions of the vectors, seed of the letters, expected texts of each language that the profiles are learned from.
DIMS, SEED, SAMPLE = 1024, 7, 2000
UNKNOWN = "und"

#: Letters below this code point have their 3-grams in a table, as many of them as BOUND rows take; others are bound anew for each block of texts, CHUNK at a time.
DENSE_BELOW, BOUND, CHUNK = 0x180, 1 << 16, 8192

_LETTERS: dict[int, np.ndarray] = {}


def letter(code: int) -> np.ndarray:
    if code not in _LETTERS:
        _LETTERS[code] = (np.random.default_rng([SEED, code]).integers(0, 2, DIMS, dtype=np.int8) * 2 - 1).astype(np.int8)
    return _LETTERS[code]


class Letters:
    """Letters met so far, numbered from 1 (0 is everything else), those below DENSE_BELOW first. Kept by each Python worker, with the vectors of the first 3-grams of these."""

    def __init__(self) -> None:
        self.number = np.full(0x110000, -1, np.int32)  # of a code point; -1 not met yet
        self.number[:DENSE_BELOW] = 0
        low = [c for c in range(DENSE_BELOW) if chr(c).isalpha() and chr(c).lower() == chr(c)]
        self.count = len(low) + 1
        self.number[low] = np.arange(1, self.count)
        self.turned = np.stack([np.stack([np.roll(letter(c), 2 - place) for c in [32, *low]]) for place in range(3)])
        self.dense = 1 << (self.count - 1).bit_length()
        self.rows = np.full(self.dense**3, -1, np.int32)  # of a 3-gram in bound
        self.bound, self.used = np.zeros((4096, DIMS), np.int8), 0

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        n = self.number[codes]
        if n.min(initial=0) < 0:
            new = np.unique(codes[n < 0]).tolist()
            known = [c for c in new if chr(c).isalpha()]
            self.number[new] = 0
            self.number[known] = np.arange(self.count, self.count + len(known))
            while self.count + len(known) > self.turned.shape[1]:
                self.turned = np.concatenate([self.turned, np.zeros_like(self.turned)], axis=1)
            for c in known:
                for place in range(3):
                    self.turned[place, self.count] = np.roll(letter(c), 2 - place)
                self.count += 1
            n = self.number[codes]
        return n

    def bind(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.turned[0, a] * self.turned[1, b] * self.turned[2, c]

    def kept(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Row of each 3-gram in bound; -1 of those that have none."""
        k = self.dense
        if max(x.max(initial=0) for x in (a, b, c)) < k:
            fit, keys = True, (a * k + b) * k + c
        else:
            fit = (a < k) & (b < k) & (c < k)
            keys = np.where(fit, (a * k + b) * k + c, 0)
        rows = self.rows[keys]
        if self.used < BOUND and rows.min(initial=0) < 0:
            new = np.unique(keys[fit & (rows < 0)])[: BOUND - self.used]
            while self.used + len(new) > len(self.bound):
                self.bound = np.concatenate([self.bound, np.zeros_like(self.bound)])
            self.bound[self.used : self.used + len(new)] = self.bind(new // (k * k), new // k % k, new % k)
            self.rows[new] = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            rows = self.rows[keys]
        return rows if fit is True else np.where(fit, rows, -1)


def _add(out: np.ndarray, own: np.ndarray, kind: np.ndarray, kinds: int, vectors) -> None:
    """Add to each text's row the vectors of its 3-grams; own ascends, kind numbers the 3-grams; CHUNK of them are widened at a time."""
    exact = np.float32 if len(own) < 1 << 24 else np.float64
    step = max(1, (1 << 21) // max(1, kinds))  # texts whose counts are held at a time
    for i in range(0, len(out), step):
        a, b = np.searchsorted(own, [i, i + step])
        m = min(step, len(out) - i)
        if m * kinds <= 1 << 23:
            counts = np.bincount((own[a:b] - i).astype(np.int64) * kinds + kind[a:b], minlength=m * kinds).reshape(m, kinds)
            for at in range(0, kinds, CHUNK):
                out[i : i + m] += counts[:, at : at + CHUNK].astype(exact) @ vectors(at, min(kinds, at + CHUNK)).astype(exact)
        else:  # one text, a great many 3-grams
            here, times = np.unique(kind[a:b], return_counts=True)
            for at in range(0, len(here), CHUNK):
                out[i] += times[at : at + CHUNK].astype(exact) @ vectors(here[at : at + CHUNK], None).astype(exact)


def bundle(texts: list[str | None]) -> np.ndarray:
    """One vector for each text, the sum over its 3-grams of lower-case letters, other characters a single space; zero without a letter."""
    pick = lambda i, j: slice(i, j) if j is not None else i
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    own = np.concatenate([[0], own])[: len(codes)]
    state = kept("letters", Letters)
    n = state.numbers(codes)
    keep = np.flatnonzero(np.concatenate([[True], (n[1:] > 0) | (n[:-1] > 0)]))
    n, own = n[keep], own[keep]
    some = n[1:-1] > 0  # a 3-gram round a letter: words have a space on both sides
    a, b, c, own = n[:-2][some], n[1:-1][some], n[2:][some], own[1:-1][some]
    rows = state.kept(a, b, c)
    out = np.zeros((len(texts), DIMS))
    here = rows >= 0
    whole = bool(here.all())
    known, of = (rows, own) if whole else (rows[here], own[here])
    found = np.flatnonzero(np.bincount(known, minlength=state.used))
    small = np.zeros(state.used + 1, np.int32)
    small[found] = np.arange(len(found))
    _add(out, of, small[known], len(found), lambda i, j: state.bound[found[pick(i, j)]])
    if not whole:
        keys, kind = np.unique((a[~here].astype(np.int64) << 40) | (b[~here].astype(np.int64) << 20) | c[~here], return_inverse=True)
        mask = (1 << 20) - 1
        _add(out, own[~here], kind, len(keys), lambda i, j: state.bind(keys[pick(i, j)] >> 40, keys[pick(i, j)] >> 20 & mask, keys[pick(i, j)] & mask))
    return out


def _parts(texts: list[str | None], rows: int = 128, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i + 1 - begin == rows or size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def learn(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Unit profiles by language, from a hash sample of about `sample` texts of each (all, of those that have fewer).

    Rows with a null text or language are not learned from; every other label is learned, however rare. On the driver: one
    count and one vector a label.
    """
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    large = {k: n for k, n in counts.items() if n > sample}
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, sample / n)]), F.col("lang")), F.lit(1.0)) if large else F.lit(1.0)
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < rate * 1_000_000).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _parts(texts):
                for lang, v in zip(langs[i:j], bundle(texts[i:j]), strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(v.astype(np.int64))], names=["lang", "i", "v"])

    profiles: dict[str, np.ndarray] = {k: np.zeros(DIMS) for k in sorted(counts)}
    for r in mapped(chosen, run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        profiles[r["lang"]][r["i"]] = r["v"]
    return {k: v / max(1.0, float(np.linalg.norm(v))) for k, v in profiles.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Every row with lang_pred and score, its cosine with that language's profile (0 if negative).

    No text, no letter or no profile: lang_pred `und`, score 0. Ties go to the first language by name. Columns of these
    two names are replaced, all others stay.
    """
    names = sorted(profiles)
    matrix = np.stack([profiles[n] for n in names]) if names else None
    docs = docs.drop("lang_pred", "score")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            lang, score = [], []
            for i, j in _parts(texts):
                v = bundle(texts[i:j])
                size = np.linalg.norm(v, axis=1)
                if matrix is None:
                    lang += [UNKNOWN] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                cos = v @ matrix.T / np.maximum(size, 1e-9)[:, None]
                top = cos.argmax(axis=1)
                lang += [names[t] if s > 0 else UNKNOWN for t, s in zip(top, size, strict=True)]
                score += np.where(size > 0, np.clip(cos[np.arange(j - i), top], 0, 1), 0).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return mapped(docs, run, f"{fields}, lang_pred string, score double")


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; learned from the rows whose crc32 of the id mod 4 is not 2.

    A null id is not held out; rows that repeat an id are predicted each, equal texts alike. Whole texts, however long.
    Null, empty and letterless texts, and all where nothing could be learned: `und`, 0. Other columns are not read. Empty
    table: empty result.
    """
    out = held_out(id_col, 4, 2)
    profiles = learn(docs.where(~out), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return predict(rows, profiles).drop("text")
