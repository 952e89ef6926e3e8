"""Queries of this subpackage against their SQL."""

import random

import duckdb
import pytest

from murmuration.llm import licenses, queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001") > 0


def test_licenses(spark):
    mit = dict(licenses.TEMPLATES[:1])["MIT"]
    text = "Title\n\nCopyright (c) 2020 A\n\n" + mit.upper().replace(" SUBJECT", ",\nSUBJECT") + ".\n\nbye"
    rows = [(1, text), (2, "some words here before\nReleased under the MIT License.\nand more after it"), (3, None), (4, ""), (5, "word"), (6, "released under the gnu license"), (None, "All rights reserved!"), (7, "prose " * 3000), (2, "some words here before\nReleased under the MIT License.\nand more after it")]
    got = licenses.scan(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, unit string")).collect()
    one = [(2, "line", 1, "MIT")] * 2 + [(2, "window", 4, "MIT")] * 2
    assert sorted((r.id or 0, r.unit, r.unit_no, r.license) for r in got) == [(0, "line", 0, "All rights reserved"), (0, "window", 0, "All rights reserved"), (1, "block", 2, "MIT"), (1, "text", 0, "MIT"), (1, "window", 5, "MIT"), *one]


def test_licenses_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licenses_within_longer_texts(spark, tmp_path):
    mit, bsd = (next(t for n, t in licenses.TEMPLATES if n == name) for name in ("MIT", "BSD-3-Clause"))
    whole = lambda t, k=3: "\n\n".join([" ".join(t.split()[len(t.split()) * i // k : len(t.split()) * (i + 1) // k]) for i in range(k)])
    changed = mit.split()
    for i in range(20, len(changed), 25):
        changed[i] = "changed"
    rows = [
        (1, whole(mit) + "\n\n" + "block " * 150),
        (2, "intro " * 400 + whole(bsd, 7).title() + " end" * 300),
        (3, " ".join(changed) + " and on it goes " * 99),
        (4, "x " * 99 + mit + " " + mit + " " + bsd),
        (5, "permission is hereby granted to leave " * 50),
        (6, " ".join(mit.split()[:60])),
        (7, None),
        (8, "permission is hereby"),
        (9, "PERMISSION\n* is hereby, " + " ".join(mit.split()[3:]) + " prose" * 20_000),
        (10, "of late " * 30 + " ".join(["permit", *mit.split()[1:]]) + " then" * 40),
        (11, "of late " * 30 + " ".join([mit.split()[1], mit.split()[0], *mit.split()[2:]]) + " then" * 40),
        (12, "of late " * 30 + " ".join(mit.split()[3:]) + " then" * 40),
        (13, "This module is licensed under the Apache License, Version 2.0 and was written by many hands over some years."),
        (14, "Note: all rights\nreserved by nobody, all rights reserved by none. " + "All Rights Reserved. " * 50),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    found = {}
    for r in licenses.scan(docs).where("unit = 'window'").collect():
        found.setdefault((r.id, r.license), []).append((r.unit_no, r.dice))
    n = len(mit.split())
    at = {k: [p for p, _ in sorted(v)] for k, v in found.items()}
    assert {k for k in at if k[0] != 2} == {(i, "MIT") for i in (1, 3, 4, 9, 10, 11, 12)} | {(4, "BSD-3-Clause"), (4, "BSD-2-Clause"), (13, "Apache-2.0"), (14, "All rights reserved")}
    assert at[1, "MIT"] == [0] and at[3, "MIT"] == [0] and at[9, "MIT"] == [0] and at[4, "MIT"] == [99, 99 + n] and (99 + 2 * n, 1.0) in found[4, "BSD-3-Clause"] and (400, 1.0) in found[2, "BSD-3-Clause"]
    assert at[10, "MIT"] in ([60], [61]) and at[11, "MIT"] == [60] and at[12, "MIT"][0] in (57, 58, 59, 60) and at[13, "Apache-2.0"] == [3] and len(at[14, "All rights reserved"]) == 52
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/sf/documents.parquet/*.parquet')")
    want = con.sql(licenses.scan_sql()).fetchall()
    assert sorted((r.id, r.unit, r.unit_no, r.license, r.dice) for r in licenses.scan(docs).collect()) == sorted(want)


def dice(words, template):
    p, g = set(licenses.bigrams(" ".join(words))), set(licenses.bigrams(template))
    return 2 * len(p & g) / (len(p) + len(g))


def test_windows_against_every_start(spark):
    """Edited notices and texts in prose of their own words, so that nearly all windows share bigrams with a template."""
    rng = random.Random(3)
    templates = tuple(t for t in licenses.TEMPLATES if len(t[1].split()) < 60)[:9]
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += rng.choices(vocabulary, k=rng.randint(0, 12))
            copy = rng.choice(templates)[1].split()
            for _ in range(rng.randint(0, max(1, len(copy) // 8))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice(([], [rng.choice(vocabulary)], [copy[k], "more"]))
            words += copy
        rows.append((i, " ".join(words)))
    want = set()
    for i, text in rows:
        w = text.split()
        for name, t in templates:
            m, runs = len(t.split()), []
            for s in range(len(w) - m + 1):
                if (d := dice(w[s : s + m], t)) >= licenses.THRESHOLD:
                    if runs and 2 * (s - runs[-1][-1][1]) < m:
                        runs[-1].append((-d, s))
                    else:
                        runs.append([(-d, s)])
            for r in runs:
                for cell in {(s - r[0][1]) // m for _, s in r}:
                    d, s = min(x for x in r if (x[1] - r[0][1]) // m == cell)
                    want.add((i, s, name, round(-d, 6)))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).where("unit = 'window'").collect()
    assert len(want) > 60 and {(r.id, r.unit_no, r.license, r.dice) for r in got} == want


def test_templates_from_texts(spark, tmp_path):
    body = " ".join(f"clause{i} says this and that" for i in range(80))
    (tmp_path / "Own-1.0.txt").write_text("Own License\n\n" + body.replace("clause40", "\n\nClause40,"))
    (tmp_path / "Empty.txt").write_text("")
    templates = licenses.read_templates(spark, str(tmp_path))
    assert [n for n, _ in templates] == ["Own-1.0"]
    docs = spark.createDataFrame([(1, "before " * 300 + "own license " + body + " after" * 300), (2, "own license of nobody")], "doc_id long, text string")
    assert [(r.id, r.unit, r.unit_no, r.license, r.dice) for r in licenses.scan(docs, templates=templates).where("unit = 'window'").collect()] == [(1, "window", 300, "Own-1.0", 1.0)]
    assert licenses.scan(docs, templates=(("short", "only a few words"),)).collect() == []
