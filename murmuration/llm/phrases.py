"""Fingerprints of texts by locally consistent parsing (Sahinalp and Vishkin, 1994; Cormode and Muthukrishnan, 2007).

A text is cut into phrases by what stands around each place alone: runs of one symbol by threes, all else before local
maxima of labels that deterministic coin tossing gives (the lowest bit in which a symbol differs from the one before it,
and its value there, three times over, so that labels are below 8). Phrases are named by a hash of their symbols and parsed
again, level upon level, until one is left. So equal substrings get equal phrases inside, wherever they stand; only the few
at their ends differ. A fingerprint keeps, of all phrases from the third level on, each with its number of occurrence, the
least hash in each of 128 bins; the share of bins that agree tells how many phrases two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm._common import TEXT_ROWS, mapped, work_dir, written

#: Bins of a fingerprint, 16 bits each; the value of an empty one.
BINS, EMPTY = 128, 0xFFFF
#: Levels left out where a text has at least ENOUGH phrases above them (a letter is level 0): short texts need theirs.
COARSE, ENOUGH = 2, 16
#: Code points parsed at a time, whole texts.
CHARS = 1 << 18

_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _tossed(symbols: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Labels below 8; neighbours of a stretch differ if their symbols do. The first of a stretch counts as differing in bit 0."""
    one = symbols.dtype.type(1)
    for _ in range(3):
        diff = np.empty_like(symbols)
        diff[0] = 1
        np.bitwise_xor(symbols[1:], symbols[:-1], out=diff[1:])
        diff[opens] = 1
        low = np.bitwise_count((diff & (~diff + one)) - one)  # trailing zeros
        bit = (symbols >> low.astype(symbols.dtype)) & one
        symbols, one = (low << np.uint8(1)) | bit.astype(np.uint8), np.uint8(1)
    return symbols


def cuts(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where phrases begin; starts: where texts do."""
    n = len(symbols)
    same = np.zeros(n + 1, bool)
    same[1:n] = symbols[1:] == symbols[:-1]
    same[starts] = False
    run = same[:n] | same[1:]
    opens = np.zeros(n, bool)
    opens[1:] = run[1:] != run[:-1]
    opens |= run & ~same[:n]
    opens[starts] = True
    label = _tossed(symbols, opens)
    begin = opens.copy()
    # maxima of stretches without equal neighbours, neither their first two nor their last place
    middle = label[1:-1]
    peak = (middle > label[:-2]) & (middle > label[2:]) & ~run[1:-1] & ~opens[1:-1] & ~opens[2:] & ~opens[:-2]
    begin[1:-1] |= peak
    if run.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(opens, at, 0))
        begin |= run & ((at - first) % 3 == 0)
    return np.flatnonzero(begin)


def _named(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of each phrase's symbols and their places in it."""
    place = np.arange(len(symbols), dtype=np.uint64) - np.repeat(begin, np.diff(np.append(begin, len(symbols)))).astype(np.uint64)
    return _mixed(np.add.reduceat(_mixed(symbols + (place + np.uint64(1)) * _STEP), begin))


def levels(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, text of each) of level 0, the code points, and of every further level, each text until it is one phrase. Every level has fewer: a run or the first two symbols make a phrase at least."""
    sizes = np.array([len(t) for t in texts])
    symbols, owner = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
    names = _mixed(symbols.astype(np.uint64))
    while len(names):
        yield names, owner
        more = (np.bincount(owner, minlength=len(texts)) > 1)[owner]  # a text of one phrase is done
        symbols, owner = symbols[more], owner[more]
        if not len(symbols):
            return
        begin = cuts(symbols, np.flatnonzero(np.diff(owner, prepend=-1)))
        symbols = names = _named(symbols.astype(np.uint64), begin)
        owner = owner[begin]


def fingerprints(texts: list[np.ndarray]) -> np.ndarray:
    """A row of BINS 16-bit values for each text, given as code points."""
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    if not sum(map(len, texts)):
        return out
    found = list(levels(texts))
    above = np.zeros(len(texts), np.int64)
    parts = []
    for k in range(len(found) - 1, -1, -1):
        names, owner = found[k]
        take = slice(None) if k >= COARSE else (above < ENOUGH)[owner]
        if k >= COARSE:
            above += np.bincount(owner, minlength=len(texts))
        elif not np.any(take):
            break
        parts.append((names[take] + np.uint64(k), owner[take]))
        if k < COARSE:
            above += np.where(above < ENOUGH, np.bincount(owner, minlength=len(texts)), 0)
    names, owner = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    at = np.arange(len(names))
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    times = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    e = _mixed(names ^ (times * _STEP))
    key = (owner.astype(np.uint64) << np.uint64(39)) | (e >> np.uint64(25))  # text, bin, 32 bits
    key.sort()
    slot = key >> np.uint64(32)
    least = np.ones(len(key), bool)
    least[1:] = slot[1:] != slot[:-1]
    slot = slot[least].astype(np.int64)
    out[slot >> 7, slot & 127] = (key[least] & np.uint64(0xFFFFFFFF)) % np.uint64(EMPTY)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of phrases that two texts share (Dice), by row: 2 J / (1 + J) of the bins that agree among those which either fills."""
    filled = (a != EMPTY) | (b != EMPTY)
    j = ((a == b) & filled).sum(axis=-1) / np.maximum(filled.sum(axis=-1), 1)
    return np.where(filled.any(axis=-1), 2 * j / (1 + j), 1.0)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def packed(fp: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in fp.astype(">u2")]


def hexed(fp: np.ndarray) -> list[str]:
    return [r.hex() for r in packed(fp)]


def in_blocks(texts: list[np.ndarray]) -> np.ndarray:
    """fingerprints(texts), about CHARS code points at a time."""
    out, at = [], 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHARS:
            size += len(texts[end])
            end += 1
        out.append(fingerprints(texts[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty((0, BINS), np.uint16)


#: As tasks give it: hashes and fingerprints are bytes until the end.
_RAW = "id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited(text: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text with its last third replaced by as many code points, or all, from the start of another."""
    k = len(text) // 3
    return np.concatenate([text[: len(text) - k], following[:k]]) if k else text


def _compared(ids: list, texts: list[np.ndarray], fps: np.ndarray, following: list[np.ndarray], following_fps: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new = in_blocks(changed)
    sha = [hashlib.sha256(c.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).digest() for c in changed]
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha, pa.binary()), pa.array(packed(fps), pa.binary()), pa.array(packed(new), pa.binary()), pa.array(likeness(fps, new)), pa.array(likeness(fps, following_fps))]


_NAMES = [c.split()[0] for c in _RAW.split(", ")]
_EDGE = "part int, edge string, whole string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in ascending order: each but the first is compared with the one before it, which is its next in descending order. The first and the last text come out as edges."""
    part, last, first = TaskContext.get().partitionId(), None, True
    none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]

    def edge(kind: str, key: int | None, text: np.ndarray) -> pa.RecordBatch:
        whole = text.tobytes().decode("utf-32-le", "surrogatepass")
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *none[1:], pa.array([part], pa.int32()), pa.array([kind]), pa.array([whole])], names=[*_NAMES, "part", "edge", "whole"])

    for b in batches:
        for i in range(0, b.num_rows, 256):
            c = b.slice(i, 256)
            ids, texts = c.column(0).to_pylist(), [points(t or "") for t in c.column(1).to_pylist()]
            fps = in_blocks(texts)
            if first:
                yield edge("first", ids[0], texts[0])
            skip = 1 if first else 0
            before = texts[:-1] if first else [last[1], *texts[:-1]]
            before_fps = fps[:-1] if first else np.vstack([last[2], fps[:-1]])
            if len(ids) > skip:
                n = len(ids) - skip
                yield pa.RecordBatch.from_arrays([*_compared(ids[skip:], texts[skip:], fps[skip:], before, before_fps), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=[*_NAMES, "part", "edge", "whole"])
            last, first = (ids[-1], texts[-1], fps[-1:]), False
    if last is not None:
        yield edge("last", *last[:2])


def _bordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            c = b.slice(i, 64)
            texts, following = ([points(t or "") for t in c.column(k).to_pylist()] for k in (1, 2))
            yield pa.RecordBatch.from_arrays(_compared(c.column(0).to_pylist(), texts, in_blocks(texts), following, in_blocks(following)), names=_NAMES)


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text, and how near it is to that and to the next document.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); hashes and fingerprints in hex.

    The next document has the next smaller id; after the smallest comes the largest, and a document alone is its own.
    Null texts count as empty, null ids come after all others; rows with one id go by text hash, equal rows follow each
    other and have likeness 1. Empty texts are alike (1). Very long texts are read and parsed whole. Other columns are not
    read. Empty table: empty result.

    Texts are dealt by ranges of id and read in order, so that a task holds a batch and one text more; the first and last
    text of each range meet in a second, small step.
    """
    folder = work_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    found = written(mapped(rows.repartitionByRange(*order).sortWithinPartitions(*order), _neighbours, f"{_RAW}, {_EDGE}"), folder, "neighbours", TEXT_ROWS)
    edges = found.where("edge is not null")
    # one small row a range is ordered in one task
    parts = found.where("edge = 'last'").select("part")
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    parts = parts.select(F.col("part").alias("at"), before.alias("before"))
    last = edges.where("edge = 'last'").select(F.col("part").alias("before"), F.col("whole").alias("following"))
    pairs = edges.where("edge = 'first'").join(parts, F.col("part") == F.col("at")).join(last, "before").select("id", "whole", "following")
    out = found.where("edge is null").select(*_NAMES).unionByName(mapped(pairs, _bordered, _RAW))
    return out.select(*[F.lower(F.hex(n)).alias(n) if n.endswith(("sha256", "fingerprint")) else n for n in _NAMES])


def fingerprint(text: str | None) -> str:
    """Of one text."""
    return hexed(fingerprints([points(text or "")]))[0]
