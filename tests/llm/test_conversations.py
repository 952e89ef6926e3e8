"""Repairs against an exhaustive search over edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from murmuration.llm import conversations

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows):
    """Uniform-cost search over (cost, edits): the first full repair is the cheapest with the least edits. Roles are checked by the grammar's own pattern."""
    kinds = faults(rows)
    able = lambda s: any(GRAMMAR.fullmatch(s + t) for t in ("", "a", "ua"))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, i, roles, built = heapq.heappop(queue)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, edits, built
        state = i, roles[-1:], bool(roles)
        if state in done:
            continue
        done.add(state)
        for given in ("user", "assistant"):
            if able(roles + given[0]):
                heapq.heappush(queue, (cost + 5, edits + "I", i, roles + given[0], (*built, (given, ""))))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(queue, (cost + 2, edits + "D", i + 1, roles, built))
        if kinds[i] in ("blank", "duplicate"):
            continue
        more = 5 if kinds[i] == "truncated" else 0
        for letter, new, c in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
            if new and able(roles + new[0]):
                heapq.heappush(queue, (cost + c + more, edits + letter, i + 1, roles + new[0], (*built, (new, text))))


def brute(original, rows):
    convs, out = {c for c, *_ in original}, []
    md5 = lambda c, r, t: hashlib.md5(f"{' ' if c is None else c}:{len(r)}:{r}:{t}".encode()).hexdigest()
    for conv in convs:
        own = sorted(((t is not None, t or 0, r, md5(c, r, x), x) for c, t, r, x in rows if c == conv))
        pairs = [(r, x) for _, _, r, _, x in own]
        turns = [t for timed, t, *_ in own if timed]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, built = cheapest(pairs)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in built).encode()).hexdigest()
        out.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha))
    return sorted(out, key=str)


def sample(seed, convs=60):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "summary", "", "U", None], ["Fine.", "so what", "really?  ", " \t\n", "", "x. y", "Well!\x0b", None, "é über.", "line\n:user."]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(8)]), rng.choice(roles[: rng.randint(2, 8)]), rng.choice(texts)) for _ in range(convs * 5)]


def rows_of(df):
    return sorted([(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()], key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_damage(spark):
    rows = sample(3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted([tuple(r) for r in conversations.damaged(df).collect()], key=str)
    assert got == sorted(damage(rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_repairs(spark, seed):
    rows = sample(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", alike string")
    got = conversations.audit(conversations.damaged(df), every=df.select("conv_id").withColumnRenamed("conv_id", "conv"), conv="conv")
    assert rows_of(got) == brute(rows, damage(rows))


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", f"{i}.", f"{i}", ""])) for i in range(600)] + [(1, 700, "user", "same again.")] * 300 + [(2, 0, "user", "Hi.")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("23", "false")):
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(7)
        pieces = conversations._pieces(conversations._runs(conversations._rows(df, "conv_id", "turn", "role", "text"), conversations.work_dir(spark))).collect()
        assert len([p for p in pieces if p.conv == 1]) > 5  # no task holds it whole
        assert rows_of(conversations.audit(df)) == brute(rows, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rows_without_rows_left(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)
    got = conversations.audit(conversations.damaged(df), every=df.select(df.conv_id.alias("conv")), conv="conv")
    assert rows_of(got) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Sure."), (1, 2, "assistant", "Sure."), (2, 0, "user", "long " * 50_000 + "."), (2, 1, "user", "Now.")]
    got = [tuple(r) for r in conversations.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "user", "Be kind."), (1, 1, "assistant", "Sure."), (2, 0, "user", rows[3][3]), (2, 1, "assistant", "Now.")]
    assert rows_of(conversations.audit(spark.createDataFrame(rows, SCHEMA))) == brute(rows, rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversations.audit(df).collect() == [] and conversations.repair(df).collect() == []
