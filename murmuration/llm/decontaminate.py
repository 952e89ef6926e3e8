"""Benchmark decontamination: rare gapped 3-gram seeds find candidate passages, Smith-Waterman alignment scores them.

An alignment that reaches threshold t of an item of m words has M matched words and at most 2M - 2tm errors, each of which
lies between two consecutive matches and so in at most two runs of three consecutive matches. Hence at least tm - 2 of
these runs hold at most 3 errors: three words of the item, at most 3 skipped between them, stand in the text in that
order, at most 3 skipped between them. Such gapped 3-grams, ten a word, are the seeds. Of an item's k = ceil(tm) - 2 sure
seeds half may be missed, so that the places whose seeds are most frequent are left out, and the rest must be hit.

Where this leaves no sure seed (items of four words and fewer, at t = 0.5), pairs of words are the seeds. A copy has three
points at least, that is two matched words and errors of at most 2M - 3, fewer than two for each of the M - 1 runs of two
consecutive matches, so that one run skips at most one word. A one-word item is its own seed.

One pass over the corpus keeps the stretches round these hits, as numbers of benchmark words, with the items that have
enough of them and can reach the threshold by two upper bounds of the points, which hold for every text. These pairs are
aligned. No text that reaches the threshold is missed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm._common import TEXT_ROWS, mapped, work_dir, written

#: Least score that counts as a copy; words of the items of one block, which is broadcast (about 160 bytes a word): more are done block by block; words of one alignment.
THRESHOLD, ITEM_WORDS, STRETCH = 0.5, 500_000, 512
#: Alignment: points for a match, a mismatch, a gap of one word; the seeds rest on these. A score is points over those of a perfect copy.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Distances of a seed's second and third word from its first: at most 3 words skipped.
GAPS = [(a, b) for b in range(2, 6) for a in range(1, b)]
#: Distances of a pair's second word from its first, in short items.
PAIRS = (1, 2)

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) of each, one after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Block:
    """Some benchmark items: word numbers from 1, items as numbers, and where their seeds lie."""

    def __init__(self, items: list[tuple[int, list[str]]], threshold: float) -> None:
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        for _, w in items:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.items = [np.array([self.number[x] for x in w], np.int32) for _, w in items]
        self.base = len(self.number) + 1
        size = np.array([len(x) for x in self.items], np.int64)
        # one matched word alone is no copy of an item that has more
        self.points = np.maximum(threshold * MATCH * size, np.where(size > 1, MATCH + 1, MATCH))
        sure = np.ceil(threshold * size - 1e-9).astype(np.int64) - 2
        #: Words of each item's seeds; what texts are searched for.
        words_of = np.where(sure >= 1, 3, np.minimum(size, 2))
        self.kinds = set(words_of.tolist())
        sure = np.maximum(1, sure)
        self.need = np.maximum(1, sure - sure // 2)
        codes, owner, place = [], [], []
        for n, x in enumerate(self.items):
            at, c = self.codes(x, {int(words_of[n])})
            codes.append(c), owner.append(np.full(len(c), n, np.int32)), place.append(at.astype(np.int32))
        codes, owner, place = (np.concatenate([*x, np.empty(0, t)]) for x, t in ((codes, np.int64), (owner, np.int32), (place, np.int32)))
        _, inverse, often = np.unique(codes, return_inverse=True, return_counts=True)
        # the commonest places of each item are left out, as many as it can spare
        first = np.cumsum(size) - size
        flat = first[owner] + place
        weight = np.bincount(flat, often[inverse], int(size.sum()))
        item = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((np.arange(len(weight)), -weight, item))
        rank = np.empty(len(weight), np.int64)
        rank[order] = np.arange(len(weight)) - first[item]
        keep = (rank >= (sure - self.need)[item])[flat]
        codes, owner, flat = codes[keep], owner[keep], flat[keep].astype(np.int32)
        order = np.argsort(codes, kind="stable")
        self.owner, self.flat = owner[order], flat[order]
        self.grams, self.start, self.many = np.unique(codes[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(10, (16 * len(self.grams)).bit_length()))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self._slot(self.grams)] = True

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def codes(self, ids: np.ndarray, kinds: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and codes of the gapped 3-grams, pairs or words (kinds 3, 2, 1) that hold benchmark words only."""
        x, at, out = ids.astype(np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        some = np.flatnonzero(x)
        known = np.concatenate([x > 0, np.zeros(6, bool)])
        for a, b in GAPS if 3 in kinds else ():
            p = some[known[some + a] & known[some + b]]
            at.append(p), out.append((x[p] * self.base + x[p + a]) * self.base + x[p + b])
        for a in PAIRS if 2 in kinds else ():
            p = some[known[some + a]]
            at.append(p), out.append(x[p] * self.base + x[p + a])
        if 1 in kinds:
            at.append(some), out.append(x[some])
        return np.concatenate(at), np.concatenate(out)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the seeds in a text, ascending, and their grams."""
        if not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, codes = self.codes(ids, self.kinds)
        some = self.maybe[self._slot(codes)]
        at, codes = at[some], codes[some]
        g = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        fine = self.grams[g] == codes
        order = np.argsort(at[fine], kind="stable")
        return at[fine][order], g[fine][order]

    def enough(self, grams: np.ndarray) -> np.ndarray:
        """Items of which these grams hit as many places as a copy must."""
        grams = np.unique(grams)
        entries = _expand(self.start[grams], self.many[grams])
        places, which = np.unique(self.flat[entries], return_index=True)
        hit = np.bincount(self.owner[entries][which], minlength=len(self.ids))
        return np.flatnonzero(hit >= self.need)

    def of(self, grams: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which grams are seeds of one of the items."""
        fit = np.zeros(len(self.ids), bool)
        fit[items] = True
        kinds, back = np.unique(grams, return_inverse=True)
        some = np.array([fit[self.owner[self.start[g] : self.start[g] + self.many[g]]].any() for g in kinds], bool)
        return some[back]

    def able(self, text: np.ndarray, items: np.ndarray) -> list[int]:
        """Those of the items that can reach the threshold somewhere in this text.

        Matches are at most the item's words that the text has. Every text word of an alignment is a match, which only
        the item's words can be, or costs a point at least; so the best sum of a run bounds the points.
        """
        seen = np.zeros(self.base, bool)
        seen[text] = True
        seen[0] = False
        out = []
        for n in items.tolist():
            if MATCH * seen[self.items[n]].sum() < self.points[n]:
                continue
            own = np.zeros(self.base, bool)
            own[self.items[n]] = True
            total = np.cumsum(np.where(own[text], MATCH, max(MISMATCH, GAP)))
            before = np.minimum.accumulate(np.concatenate([[0], total[:-1]]))
            if (total - before).max() >= self.points[n]:
                out.append(n)
        return out


def align(text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of each pair of rows (0 pads, matches nothing): best points and the place after the last word aligned."""
    n, m = len(text), item.shape[1]
    j = np.arange(1, m + 1, dtype=np.int32)
    h = np.zeros((n, m + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(text.shape[1]):
        w = text[:, i : i + 1]
        new = np.maximum(h[:, :-1] + np.where((w == item) & (w > 0), MATCH, MISMATCH), h[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new - GAP * j, axis=1) + GAP * j  # gaps in the text: a run costs GAP a word
        h[:, 1:] = new
        top = new.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], i + 1
    return best, end


def stretches(at: np.ndarray, reach: int, n: int) -> list[tuple[int, int]]:
    """Merged stretches of `reach` words round the places, of at most STRETCH words, overlapping by 2 reach where one is cut."""
    out: list[tuple[int, int]] = []
    begin = end = -1
    spans = []
    for p in at.tolist():
        a, b = max(0, p - reach), min(n, p + 6 + reach)
        if begin >= 0 and a <= end:
            end = b
            continue
        if begin >= 0:
            spans.append((begin, end))
        begin, end = a, b
    if begin >= 0:
        spans.append((begin, end))
    most = max(STRETCH, 4 * reach)
    for a, b in spans:
        while b - a > most:
            out.append((a, a + most))
            a += most - 2 * reach
        out.append((a, b))
    return out


def _compare(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first, texts, items = (b.column(i).to_pylist() for i in range(1, 4))
        pairs = sorted(((r, n) for r, some in enumerate(items) for n in some), key=lambda p: (len(texts[p[0]]), len(block.items[p[1]])))
        rows = []
        for at in range(0, len(pairs), 256):
            part = pairs[at : at + 256]
            t = np.zeros((len(part), max(len(texts[r]) for r, _ in part)), np.int32)
            i = np.zeros((len(part), max(len(block.items[n]) for _, n in part)), np.int32)
            for k, (r, n) in enumerate(part):
                t[k, : len(texts[r])], i[k, : len(block.items[n])] = texts[r], block.items[n]
            size = (i > 0).sum(axis=1)
            best, end = align(t, i)
            hit = np.flatnonzero(best >= block.points[[n for _, n in part]])
            if not len(hit):
                continue
            back, rev = np.zeros_like(t[hit]), np.zeros_like(i[hit])
            for k, x in enumerate(hit):
                back[k, : end[x]] = t[x, : end[x]][::-1]
                rev[k, : size[x]] = i[x, : size[x]][::-1]
            span = align(back, rev)[1]
            rows += [(part[x][0], block.ids[part[x][1]], float(best[x]) / float(MATCH * size[x]), first[part[x][0]] + int(end[x] - s), first[part[x][0]] + int(end[x])) for x, s in zip(hit, span, strict=True)]
        if rows:
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:]], names=["id", "item_id", "score", "start_word", "end_word"])


FOUND = "item_id long, score double, start_word long, end_word long"


def _find_block(docs: DataFrame, block: Block, folder: str, threshold: float) -> DataFrame:
    # an alignment's text words that are no match cost a point each, so one that reaches the threshold spans so many at most
    reach = math.ceil(max(map(len, block.items), default=1) * (1 + MATCH * max(0, 1 - threshold)))
    id_type = docs.schema["id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, text in enumerate(b.column(1).to_pylist()):
                w = words(text)
                ids = np.fromiter(map(block.number.get, w, repeat(0)), np.int32, len(w))
                at, g = block.hits(ids)
                items = block.enough(g) if len(at) else ()
                if not len(items):
                    continue
                own = block.of(g, items)
                at, g = at[own], g[own]
                for a, e in stretches(at, reach, len(ids)):
                    i, j = np.searchsorted(at, [a, e])
                    near = block.enough(g[i:j])
                    if len(near) and (fit := block.able(ids[a:e], near)):
                        rows.append((row, a, ids[a:e], fit))
            if rows:
                d, a, t, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d, pa.int64())), pa.array(a, pa.int64()), pa.array(t, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["id", "first", "words", "items"])

    near = written(mapped(docs, gather, f"id {id_type}, first long, words array<int>, items array<int>"), folder, "stretches", TEXT_ROWS)
    # few rows, much work each: dealt anew, so that long documents' stretches do not stay in one task
    return mapped(near.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "first"), lambda it: _compare(it, block), f"id {id_type}, {FOUND}")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, item_id, score, start_word, end_word): every document and item whose best alignment reaches the threshold, once each.

    score is 1 for a perfect copy; the span counts words of the document, of equally good ones the first. Null and empty
    texts and wordless items match nothing; a copy of an item of several words has two of them at least, a one-word item is
    copied wherever its word stands. Rows that repeat a document id count as one
    document; of a repeated item id every text is compared. Ids are of any type; null ids stay null and are one document.
    Whole texts, however long. Other columns are not read. Empty tables: empty result.

    The corpus is read once for every ITEM_WORDS words of the benchmark; one block's items at a time are on the driver.
    """
    spark = docs.sparkSession
    folder = work_dir(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found, held, size = [], [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct().orderBy("i", "t").toLocalIterator():
        if w := words(r["t"]):
            if held and size + len(w) > ITEM_WORDS:
                found.append(_find_block(rows, Block(held, threshold), f"{folder}/{len(found)}", threshold))
                held, size = [], 0
            held.append((r["i"], w))
            size += len(w)
    if held:
        found.append(_find_block(rows, Block(held, threshold), f"{folder}/{len(found)}", threshold))
    if not found:
        return spark.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word")))
    return out.groupBy("id", "item_id").agg(best.alias("b")).select("id", "item_id", F.round("b.score", 6).alias("score"), "b.start_word", "b.end_word")
