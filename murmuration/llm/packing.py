"""Best-fit packing after Martello-Toth dominance reduction.

Lengths are integers up to the sequence length, so an instance of any size is a histogram of at most that many counts.
The reduction and the best-fit decreasing pass work on it, on the driver, and give patterns with multiplicities; pieces
are then dealt to the patterns' places by their rank among the pieces of the same length, without a global sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm._common import TEXT_ROWS, mapped, work_dir, written
from murmuration.llm.tokens import _rows, encoder, id_crc32

#: A pattern: ((length, how many), ...), and the number of sequences filled so.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def reduce_dominated(counts: np.ndarray, room: int) -> list[Pattern]:
    """Fix sets that dominate every other set with the same largest item; takes their items out of counts.

    For an item j and the largest k that fits beside it: {j} if nothing fits; {j, k} if that is full or nothing fits
    beside both even with the two smallest instead of k; {j, k, b}, b the largest that fits beside both, if at most two
    items fit beside j and no two larger than b do.
    """
    fixed: list[Pattern] = []

    def smallest(n: int, j: int, above: int = 0) -> list[int]:
        """The n smallest lengths over `above` of the items besides one j."""
        found: list[int] = []
        for s in np.flatnonzero(counts[above + 1 :]) + above + 1:
            found += [int(s)] * min(n - len(found), int(counts[s]) - (s == j))
            if len(found) == n:
                break
        return found

    def largest(most: int, *used: int) -> int:
        for s in np.flatnonzero(counts[: max(0, most) + 1])[::-1]:
            if counts[s] > used.count(int(s)):
                return int(s)
        return 0

    def fix(*items: int) -> None:
        each = {s: items.count(s) for s in items}
        times = min(int(counts[s]) // n for s, n in each.items())
        for s, n in each.items():
            counts[s] -= n * times
        fixed.append((tuple(sorted(each.items(), reverse=True)), times))

    for j in range(room, 0, -1):
        while counts[j] > 0:
            left = room - j
            k = largest(left, j)
            if not k:
                fix(j)
                continue
            two, three = smallest(2, j), smallest(3, j)
            if k == left or len(two) < 2 or sum(two) > left:
                fix(j, k)
                continue
            b = largest(left - k, j, k)
            if b and (len(three) < 3 or sum(three) > left):
                over = smallest(2, j, b)
                if len(over) < 2 or sum(over) > left:
                    fix(j, k, b)
                    continue
            break
    return fixed


def best_fit(counts: np.ndarray, room: int) -> list[Pattern]:
    """Best-fit decreasing of what counts holds: each item goes to the fullest sequence that has room for it."""
    open_: dict[int, list[list]] = {}
    for s in range(room, 0, -1):
        m = int(counts[s])
        while m:
            at = min((r for r in open_ if r >= s), default=None)
            t = (room if at is None else at) // s
            pattern, n = ((), m // t or 1) if at is None else open_[at][-1]
            used, t = (min(n, m // t), t) if m >= t else (1, m)
            if at is not None:
                open_[at][-1][1] -= used
                if not open_[at][-1][1]:
                    open_[at].pop()
                    if not open_[at]:
                        del open_[at]
            open_.setdefault((room if at is None else at) - t * s, []).append([(*pattern, (s, t)), used])
            m -= used * t
    return [(p, n) for groups in open_.values() for p, n in groups]


def plan(counts: dict[int, int], room: int) -> list[Pattern]:
    left = np.zeros(room + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    return reduce_dominated(left, room) + best_fit(left, room)


def places(patterns: list[Pattern], room: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, items a sequence, first sequence and offset of each run of places, by rank."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    next_rank, sequence = dict.fromkeys(range(room + 1), 0), 0
    for pattern, n in patterns:
        offset = 0
        for s, t in pattern:
            runs.setdefault(s, []).append((next_rank[s], t, sequence, offset))
            next_rank[s] += t * n
            offset += s * t
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than room if there are several."""
    first = n - (n - 1) // room * room
    return [(0, first), *((s, room) for s in range(first, n, room))]


def pieces(docs: DataFrame, tokenizer: str, room: int, id_col: str, text_col: str, end_id: int, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth[, ids]): nth counts the pieces of a length within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for keys, texts in _rows(batches):
            rows, kept = [], []
            for key, ids in zip(keys, enc.encode(texts), strict=True):
                ids = np.append(ids, np.array(end_id, enc.dtype))
                for i, (start, n) in enumerate(cut(len(ids), room)):
                    rows.append((key, i, start, n, id_crc32(ids[start : start + n]), part, int(seen[n])))
                    seen[n] += 1
                    if keep_ids:
                        kept.append(ids[start : start + n].tobytes())
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if keep_ids:
                cols.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * keep_ids
    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, schema)


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    ids are the piece's ids as little-endian unsigned integers, of 16 bits where the vocabulary allows, else of 32.

    A document is its ids and end_id; only those longer than room are cut. Null and empty texts are a piece of one id.
    Null and repeated ids stay, each row is a document. Other columns are not read. Empty table: empty result.
    Gathered on the driver: one count for each length, room rows at most.
    """
    folder = work_dir(docs.sparkSession)
    all_ = written(pieces(docs, tokenizer, room, id_col, text_col, end_id, keep_ids), folder, "pieces", TEXT_ROWS)
    held = written(all_.groupBy("part", "length").agg(F.count("*").alias("n")), folder, "held")
    patterns = plan({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room)
    where = places(patterns, room)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # base has a row for each part and length, which grows with the parts: never broadcast
    ranked = all_.join(base.hint("merge"), ["part", "length"]).select(*[c for c in all_.columns if c not in ("part", "nth")], (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for i in np.split(order, edges) if len(order) else []:
                first, t, seq, off = where[int(length[i[0]])]
                run = np.searchsorted(first, rank[i], side="right") - 1
                q = rank[i] - first[run]
                sequence[i], offset[i] = seq[run] + q // t[run], off[run] + q % t[run] * length[i]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    fields = [f"{c} {t}" for c, t in ranked.dtypes if c != "rank"]
    return mapped(ranked, place, ", ".join([*fields, "sequence_id long", "offset long"]))
