"""Repair of the turn structure of conversations by a backward cost-to-go and a greedy forward walk.

A conversation's rows are edited (keep, rerole, delete, insert) until the initials of its roles read `(s?(ua)+)?`, at the
least cost and, among those, with the ASCII-least string of edits. Grammar states: 0 nothing yet, 1 after s, 2 after u, 3
after a. A row is a 4 x 4 matrix of edit costs, so that pieces of a conversation fold on their own by min-plus products:
rows are dealt by range, each piece gives its matrix, the pieces of a conversation pass costs backwards and states forwards,
and no task holds a whole conversation but for its edits, a letter a row, which are a value of the result. Equal rows of a
turn count once, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm._common import join_groups, mapped, work_dir, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_SPACE = "\t\n\x0b\x0c\r "
INF = 1 << 60
#: The state that each state's next role leads to, by the role's initial; u and a are what an edit can insert or rerole to.
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: The only role that a state can be given by an insertion or another role.
GIVEN = ("user", "user", "assistant", "user")
#: Symbols of rows: initials, plus 4 where truncated; GONE must go.
INITIALS, GONE = "sua?", 8
LEGAL = ("su", "ua", "au")


def _closed() -> np.ndarray:
    """Least cost of insertions alone from state to state."""
    m = np.full((4, 4), INF)
    for q in range(4):
        m[q, q], r = 0, q
        for n in range(1, 4):
            r = NEXT[GIVEN[r][0], r]
            m[q, r] = min(m[q, r], n * INSERT)
    return m


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product; b a matrix or a vector."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), INF) if b.ndim == 2 else np.minimum((a + b[None]).min(axis=1), INF)


INSERTED = _closed()
#: Cost from each state to the end of a conversation.
END = times(INSERTED, np.array([0, INF, INF, 0]))


def _edited(symbol: int) -> np.ndarray:
    """Costs of a row's own edits, by state before and after."""
    m = np.full((4, 4), INF)
    for q in range(4):
        m[q, q] = DELETE
        if symbol < GONE:
            more = TRUNCATED if symbol & 4 else 0
            kept, given = NEXT.get((INITIALS[symbol & 3], q)), NEXT[GIVEN[q][0], q]
            m[q, given] = min(m[q, given], REROLE + more)
            if kept is not None:
                m[q, kept] = min(m[q, kept], KEEP + more)
    return m


_ROW = [times(INSERTED, _edited(s)) for s in range(GONE + 1)]


def folded(symbols: bytes, counts: list[int]) -> np.ndarray:
    """The matrix of a piece; a run of rows that must go shifts all costs alike."""
    m, more = INSERTED, 0
    for s, n in zip(reversed(symbols), reversed(counts), strict=True):
        if s == GONE:
            more += DELETE * n
        else:
            m = times(_ROW[s], m)
    return np.minimum(m + more, INF)


def walked(symbols: bytes, counts: list[int], after: np.ndarray, states: tuple[int, ...]) -> list[tuple[str, int]]:
    """(edits, state at the end) for each state at the start, `after` the cost from each state at the end on."""
    ahead = [after]
    for s, n in zip(reversed(symbols), reversed(counts), strict=True):
        ahead.append(ahead[-1] + DELETE * n if s == GONE else times(_ROW[s], ahead[-1]))
    ahead.reverse()
    out = []
    for q in states:
        edits: list[str] = []
        for i, (s, n) in enumerate(zip(symbols, counts, strict=True)):
            if s == GONE:  # as cheap now as later, and D comes first
                edits.append("D" * n)
                continue
            here, then = ahead[i], ahead[i + 1]
            more = TRUNCATED if s & 4 else 0
            while True:
                given, kept = NEXT[GIVEN[q][0], q], NEXT.get((INITIALS[s & 3], q))
                if here[q] == DELETE + then[q]:
                    edits.append("D")
                elif here[q] == INSERT + here[given]:
                    edits.append("I")
                    q = given
                    continue
                elif kept is not None and here[q] == KEEP + more + then[kept]:
                    edits.append("K")
                    q = kept
                else:
                    edits.append("R")
                    q = given
                break
        out.append(("".join(edits), q))
    return out


def ending(q: int) -> str:
    """Insertions that end a conversation."""
    return "" if q in (0, 3) else "I" + ending(NEXT[GIVEN[q][0], q])


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults that hang on crc32(`conv:turn`) % 20 alone: 0 drops the row, 1 empties its text, 2 takes its [.!?] out, 3 repeats it, 4 makes its role user. Nulls in role and text, and in the key, are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), lot.alias("lot")).where("lot != 0")
    shown = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), shown.alias("text"), "lot")
    return rows.withColumn("copy", F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("lot", "copy")


#: Rows of a conversation in order: turns, nulls first; of one turn by role, then text's MD5. `alike` is equal for equal rows of a conversation.
_KEY, _ORDER = ["nil", "conv"], ["timed", "turn", "role", "alike"]


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    shown = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    who = F.coalesce(F.col(role).cast("string"), F.lit(" "))
    at = F.col(turn).cast("long")
    name = F.col(conv).cast("long")
    alike = F.md5(F.concat_ws(":", F.coalesce(name.cast("string"), F.lit(" ")), F.char_length(who), who, shown).cast("binary"))
    return conversations.select(name.isNull().alias("nil"), F.coalesce(name, F.lit(0)).alias("conv"), at.isNotNull().alias("timed"), F.coalesce(at, F.lit(0)).alias("turn"), who.alias("role"), alike.alias("alike"), shown.alias("text"))


def _runs(rows: DataFrame, folder: str) -> DataFrame:
    """Equal rows of a turn as one, with the number n and whether it is the first such row of its conversation."""
    bare = F.rtrim("text", F.lit(_SPACE))
    runs = rows.select(*_KEY, *_ORDER, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    runs = written(runs.groupBy(*_KEY, *_ORDER, "blank", "cut").agg(F.count("*").alias("n")), folder, "runs")
    first = runs.groupBy("alike").agg(F.min(F.struct("timed", "turn")).alias("first"), F.count("*").alias("times"))
    first = written(first.where("times > 1"), folder, "repeated")
    met = join_groups(runs, first, "alike", "times", runs.count(), grows=True)
    return met.withColumn("first", F.coalesce(F.col("first") == F.struct("timed", "turn"), F.lit(True)))


def _counts(runs: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated of each conversation, summed by turn first."""
    told = F.when(F.col("blank"), 0).otherwise(1)
    turns = runs.groupBy(*_KEY, "timed", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(told * (F.col("n") - F.col("first").cast("long"))).alias("duplicate"),
        F.sum((~F.col("blank") & F.col("first") & F.col("cut")).cast("long")).alias("truncated"),
    )
    span = F.max(F.when(F.col("timed"), F.col("turn"))) - F.min(F.when(F.col("timed"), F.col("turn"))) + 1 - F.sum(F.col("timed").cast("long"))
    return turns.groupBy(*_KEY).agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


_PIECE = "nil boolean, conv long, piece int, symbols binary, counts array<long>, costs array<long>, edges string, illegal long"


def _pieces(runs: DataFrame) -> DataFrame:
    """One row a conversation and range of rows: symbols, matrix, first and last initial, illegal pairs within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def row() -> tuple:
            symbols, counts = bytes(held[0]), held[1]
            return (*now, symbols, counts, folded(symbols, counts).ravel().tolist(), held[2] + held[3], held[4])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])

        for b in batches:
            rows = []
            for nil, conv, piece, initial, symbol, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (nil, conv, piece):
                    if now is not None:
                        rows.append(row())
                    now, held = (nil, conv, piece), [bytearray(), [], initial, initial, 0]
                else:
                    held[4] += held[3] + initial not in LEGAL
                held[3] = initial
                held[4] += n - 1  # no initial may follow itself
                for s, k in ((symbol, 1), (GONE, n - 1)) if first and symbol != GONE else ((GONE, n),):
                    if not k:
                        continue
                    if s == GONE and held[0][-1:] == bytes([GONE]):
                        held[1][-1] += k
                    else:
                        held[0].append(s), held[1].append(k)
            if rows:
                yield out(rows)
        if now is not None:
            yield out([row()])

    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    initial = F.substring(F.lit(INITIALS), kind + 1, F.lit(1))
    symbol = F.when(F.col("blank") | ~F.col("first"), GONE).otherwise(kind + F.when(F.col("cut"), 4).otherwise(0))
    dealt = runs.repartitionByRange(*_KEY, *_ORDER).sortWithinPartitions(*_KEY, *_ORDER)
    return mapped(dealt.select(*_KEY, F.spark_partition_id().alias("piece"), initial.alias("initial"), symbol.alias("symbol"), "n", "first"), run, _PIECE)


def _after(pieces: DataFrame) -> DataFrame:
    """(nil, conv, piece, after, illegal between): the cost from each state behind a piece, from the matrices of those behind it.

    A conversation has a matrix for each range of rows that it reaches into, so at most as many as there are partitions.
    """
    lists = pieces.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("piece", "costs", "edges", "illegal"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for nil, conv, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                after, last = END, None
                for k in range(len(parts) - 1, -1, -1):
                    p = parts[k]
                    before = parts[k - 1]["edges"][1] + p["edges"][0] if k else "ua"
                    rows.append((nil, conv, p["piece"], after.tolist(), k == 0, last is None, p["illegal"] + (before not in LEGAL)))
                    after, last = times(np.array(p["costs"]).reshape(4, 4), after), p
            kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["nil", "conv", "piece", "after", "opens", "closes", "illegal"])

    return mapped(lists, run, "nil boolean, conv long, piece int, after array<long>, opens boolean, closes boolean, illegal long")


def _edits(pieces: DataFrame) -> DataFrame:
    """(nil, conv, audit, cost, illegal): every piece is walked from each state that it may begin in, then the walks are strung together."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            walks, ends = [], []
            for symbols, counts, after, opens, closes in zip(*(b.column(c).to_pylist() for c in ("symbols", "counts", "after", "opens", "closes")), strict=True):
                states = (0,) if opens else (0, 1, 2, 3)
                found = walked(symbols, counts, np.array(after), states)
                walks.append([e + (ending(q) if closes else "") for e, q in found]), ends.append([q for _, q in found])
            cols = [b.column(c) for c in ("nil", "conv", "piece", "illegal")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(walks, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=["nil", "conv", "piece", "illegal", "walks", "ends"])

    met = pieces.drop("illegal", "costs", "edges").join(_after(pieces), [*_KEY, "piece"])
    strung = mapped(met, walk, "nil boolean, conv long, piece int, illegal long, walks array<string>, ends array<int>")
    grouped = strung.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("piece", "walks", "ends"))).alias("p"), F.sum("illegal").alias("illegal"))
    chain = F.aggregate("p", F.struct(F.lit(0).alias("q"), F.array().cast("array<string>").alias("e")), lambda a, p: F.struct(F.element_at(p["ends"], a["q"] + 1).alias("q"), F.concat(a["e"], F.array(F.element_at(p["walks"], a["q"] + 1))).alias("e")))
    return grouped.select(*_KEY, F.concat_ws("", chain["e"]).alias("audit"), "illegal")


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(heads: DataFrame, rows: DataFrame, emit_rows: bool) -> DataFrame:
    """Conversations are rebuilt in streams: each one's edits come first, then its rows in order; a batch is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at, q, digest, place, cost = None, 0, 0, None, 0, 0
        kinds = (pa.int64(), *(pa.int64(),) * 6, pa.string(), pa.string())
        done: list[tuple] = []
        built: list[tuple] = []

        def put(role: str, text: str) -> None:
            nonlocal place
            digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            if emit_rows:
                built.append((None if head[0] else head[1], place, role, text))
            place += 1

        def inserted() -> None:
            nonlocal at, q, cost
            while at < len(head[3]) and head[3][at] == "I":
                put(GIVEN[q], "")
                at, q, cost = at + 1, NEXT[GIVEN[q][0], q], cost + INSERT

        def close() -> None:
            if head is not None:
                inserted()
                done.append((None if head[0] else head[1], *head[2], cost, head[3], digest.hexdigest()))

        def out() -> pa.RecordBatch:
            if emit_rows:
                cols, kinds_ = list(zip(*built, strict=True)), (pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["conv_id", "place", "role", "text"]
            else:
                cols, kinds_ = list(zip(*done, strict=True)), kinds
                names = [c.split()[0] for c in OUT.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], names=names)
            built.clear(), done.clear()
            return batch

        for b in batches:
            for nil, conv, is_row, role, text, cut, stats in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not is_row:
                    close()
                    head, at, q, digest, place, cost = (nil, conv, stats, text), 0, 0, hashlib.sha256(), 0, 0
                    continue
                inserted()
                letter = head[3][at]
                at += 1
                if letter == "D":
                    cost += DELETE
                    continue
                cost += TRUNCATED if cut else 0
                if letter == "R":
                    role, cost = GIVEN[q], cost + REROLE
                put(role, text)
                q = NEXT[role[:1], q]
            if built if emit_rows else done:
                yield out()
        close()
        if built if emit_rows else done:
            yield out()

    stats = F.array("gaps", "blank", "duplicate", "truncated", "illegal")
    nothing = F.lit(None)
    first = heads.select(*_KEY, F.lit(False).alias("is_row"), F.lit(False).alias("timed"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("alike"), F.col("audit").alias("text"), F.lit(False).alias("cut"), stats.alias("stats"))
    bare = F.rtrim("text", F.lit(_SPACE))
    then = rows.select(*_KEY, F.lit(True).alias("is_row"), *_ORDER, "text", (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), nothing.cast("array<long>").alias("stats"))
    dealt = first.unionByName(then).repartition(*_KEY).sortWithinPartitions(*_KEY, "is_row", *_ORDER)
    return mapped(dealt.select(*_KEY, "is_row", "role", "text", "cut", "stats"), run, "conv_id long, place long, role string, text string" if emit_rows else OUT)


def _heads(conversations: DataFrame, rows: DataFrame, conv: str) -> DataFrame:
    """gaps, blank, duplicate, truncated, illegal and audit of every conversation, those without rows left included."""
    folder = work_dir(rows.sparkSession)
    runs = written(_runs(rows, folder), folder, "told")
    edits = _edits(written(_pieces(runs), folder, "pieces"))
    name = F.col(conv).cast("long")
    every = conversations.select(name.isNull().alias("nil"), F.coalesce(name, F.lit(0)).alias("conv")).distinct()
    heads = every.join(_counts(runs), _KEY, "left").join(edits, _KEY, "left")
    return written(heads.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal"]).na.fill("", ["audit"]), folder, "heads")


def audit(rows: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """OUT: for each conversation its faults, the cost and edits of the cheapest repair, and the SHA-256 of what it gives.

    Each row's first fault counts: blank (only white space), duplicate (an earlier row has its role and text), truncated
    (does not end in . ! or ?). illegal counts neighbours whose roles' initials are not su, ua or au; gaps counts missing
    turns. Repairs: K keep, R another role, D delete, I insert an empty row; ties go to the ASCII-least edits.

    every: more conversations, told even where they have no row (zeros, no edits, hash of the empty text). Null roles and
    texts count as one space, null conv_ids are one conversation, null turns come first and make no gap; rows of one turn go
    by role, then by text's hash; repeated rows are duplicates. Ids and turns are whole numbers. Very long texts are read
    whole; other columns are not read. Empty table: empty result. A SHA-256 runs over a conversation in order, so one task
    streams it, a batch at a time; all else works on pieces of conversations.
    """
    told = _rows(rows, conv, turn, role, text)
    named = rows.select(conv) if every is None else every.select(conv)
    return _repaired(_heads(named, told, conv), told, False)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, places from 0; audit tells how and treats odd rows alike."""
    told = _rows(rows, conv, turn, role, text)
    return _repaired(_heads(rows.select(conv), told, conv), told, True)
