"""Operators 11 to 13 against SQL and brute force, and odd input."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import groupby, product

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framequery.llm import conversations, line_dedup, periodic, registry
from tests.llm.fixtures import documents, odd

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\v\f\r"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(map(str, found.fetchall()))


# operator 11


def plain_lines(docs, min_docs, min_chars):
    """(id, text) rows -> the texts that stay."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return [(i, "\n".join(x for x in (text or "").split("\n") if keeper.get(key(x), i) == i)) for i, text in docs]


def test_lines_as_by_hand(spark):
    a, b = "A line that is common to many of the documents here", "Ünd this one is held by four documents and stays"
    docs = [(i, f"own {i}\n{a}\n\n  {a.upper()}\t\n{b}\n" if i < 4 else f"{a}\nown {i}") for i in range(6)]
    docs += [(2, f"{a}\nthe second row of two"), (None, f"x\n{a}\n{b}"), (7, None), (8, ""), (9, "\n\n"), (5, f"{a}\nown 5"), (10, "é" * 40), (11, "É" * 40)]
    df = documents(spark, [t for _, t in docs], [i for i, _ in docs]).withColumn("n_lines", F.lit("clash"))
    got = line_dedup.drop_common_lines(df)
    assert set(got.columns) == {*df.columns, "n_dropped"} and dict(got.dtypes)["n_lines"] == "bigint"
    rows = got.collect()
    want = plain_lines(docs, 5, 40)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(want, key=str)
    assert {r["n_lines"] - r["n_dropped"] for r in rows if r["doc_id"] == 0} == {4}
    assert {r["n_dropped"] for r in rows if r["doc_id"] == 5} == {0}


def test_lines_at_the_threshold_and_beyond(spark):
    line = "x" * 40
    at = lambda n, width: sum(r["n_dropped"] for r in line_dedup.drop_common_lines(documents(spark, [line[:width]] * n)).collect())
    assert (at(4, 40), at(5, 39), at(5, 40)) == (0, 0, 4)


def test_lines_without_broadcast(spark, monkeypatch):
    """The same through shuffled joins, as for tables beyond the broadcast bound."""
    monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda df: df)
    docs = [(i, "\n".join(f"the line number {k} that is shared by several of all documents" for k in range(i % 9))) for i in range(60)]
    got = line_dedup.drop_common_lines(documents(spark, [t for _, t in docs])).select("doc_id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(plain_lines(docs, 5, 40))


def test_lines_of_odd_and_empty_tables(spark):
    assert line_dedup.drop_common_lines(odd(spark)).count() == odd(spark).count()
    assert line_dedup.drop_common_lines(odd(spark).limit(0)).count() == 0


def test_no_python_in_line_dedup(spark):
    plan = line_dedup.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# operator 12


def plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        for same, own in groupby(range(n - q), lambda i: w[i] == w[i + q]):
            own = list(own)
            size = len(own) + q
            part = w[own[0] : own[0] + size]
            shorter = any(part[r:] == part[:-r] for r in range(1, q))
            if same and size >= max(6, 4 * q) and not shorter:
                out.add((own[0], size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(rnd, n, k):
    w = [rnd.randrange(k) for _ in range(n)]
    if n > 10 and rnd.random() < 0.6:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(3, 10)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@given(st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_runs_as_by_hand(seed):
    rnd = random.Random(seed)
    texts = [looped(rnd, rnd.choice([0, 1, 3, 6, 10, 40, 150, 400]), rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(1, 8))]
    got = periodic.runs_of([np.array(w, np.int64) for w in texts])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(w) for w in texts]


def test_grid_in_small_pieces(monkeypatch):
    rnd = random.Random(3)
    texts = [looped(rnd, 300, 2) for _ in range(4)]
    monkeypatch.setattr(periodic, "PLACES", 7)
    assert [[tuple(r) for r in g.tolist()] for g in periodic.runs_of([np.array(w) for w in texts])] == [plain_runs(w) for w in texts]


def test_extensions_as_by_hand():
    rnd = random.Random(5)
    for n in (2, 3, 17, 200):
        w = [rnd.randrange(2) for _ in range(n)]
        a, b = zip(*[p for p in product(range(n), repeat=2) if p[0] != p[1]], strict=True)
        far = lambda i, j: next((k for k in range(n - max(i, j)) if w[i + k] != w[j + k]), n - max(i, j))
        assert periodic.Extensions(np.array(w)).of(np.array(a), np.array(b)).tolist() == [far(i, j) for i, j in zip(a, b, strict=True)]


def test_runs_and_what_is_left(spark):
    texts = ["a b a b a b a b c", "x " * 5, "x " * 6, "q r q r", "1 2 3 " * 4 + "end", "z z z z z z y y y y y y"]
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(documents(spark, texts)).collect()}
    runs = {i: [tuple(x) for x in r["runs"]] for i, r in rows.items()}
    assert runs == {0: [(0, 8, 2)], 1: [], 2: [(0, 6, 1)], 3: [], 4: [(0, 12, 3)], 5: [(0, 6, 1), (6, 6, 1)]}
    assert [rows[i]["collapsed"] for i in range(6)] == ["a b c", "x x x x x", "x", "q r q r", "1 2 3 end", "z y"]
    best = periodic.periodic_runs(documents(spark, texts)).select("doc_id", periodic.longest(F.col("runs")).alias("top"))
    assert {r["doc_id"]: r["top"] and tuple(r["top"]) for r in best.collect()}[5] == (0, 6, 1)


def test_runs_of_odd_and_empty_tables(spark):
    rows = periodic.periodic_runs(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and [tuple(x) for r in rows if r["doc_id"] == 6 for x in r["runs"]] == [(0, 30_000, 1)]
    assert {(r["collapsed"], len(r["runs"])) for r in rows if r["doc_id"] in (0, 1, 2)} == {("", 0)}
    assert periodic.periodic_runs(odd(spark).limit(0)).count() == 0
    assert periodic.with_loops(odd(spark)).count() == len(rows)
    words = odd(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))  # ids need not be numbers
    assert {r["doc_id"] for r in periodic.periodic_runs(words).collect()} >= {"d6", None}


def test_a_text_beyond_a_block(spark):
    n = 3 * periodic.BLOCK
    text = " ".join(f"w{i}" for i in range(n)) + " " + "loop the loop " * 5000
    (row,) = periodic.periodic_runs(documents(spark, [text])).collect()
    assert [tuple(r) for r in row["runs"]] == [(n, 15_000, 3)]


# operator 13


def all_edits(marks):
    """Every audit with up to two insertions in each gap, by brute force."""
    gaps = [[""] + ["I", "II"]] * (len(marks) + 1)
    per = [["D"] if gone else ["D", "K", "R"] for _, gone, _ in marks]
    best = None
    for edits in product(*per):
        for fills in product(*gaps):
            audit = "".join(f + e for f, e in zip(fills, (*edits, ""), strict=True))
            for roles in product("ua", repeat=audit.count("R") + audit.count("I")):
                free, left = iter(roles), iter(marks)
                seen, cost = "", 0
                for e in audit:
                    initial, _, cut = next(left) if e != "I" else ("", False, False)
                    seen += "" if e == "D" else initial if e == "K" else next(free)
                    cost += {"D": 3, "K": cut, "R": 2 + cut, "I": 2}[e]
                if re.fullmatch("(s?(ua)+)?", seen) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


@given(st.lists(st.tuples(st.sampled_from("suat"), st.booleans(), st.booleans()), max_size=3))
@settings(max_examples=40, deadline=None)
def test_cheapest_edits_as_by_hand(marks):
    marks = [(i, gone, cut and not gone) for i, gone, cut in marks]
    assert conversations.best_edits(marks) == all_edits(marks)


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string, audit long, there boolean")


def test_faults_and_repairs(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 4, "user", "and then"),
        (2, None, None, None), (2, 0, "user", "One?"), (2, 2, "tool", "Two. \n"),
        (3, 5, "system", "Be kind."), (3, 6, "user", "Ask?"), (3, 7, "assistant", "Tell."),
        (None, 1, "user", "q."), (4, None, "user", "é ."), (4, None, "assistant", "ok."),
    ]
    df = turns_of(spark, [(*r, "x", 1, True) for r in rows] + [(9, 1, "user", "a.", "x", 1, False)])
    got = {r["conv_id"]: r for r in conversations.repair(df, F.col("there")).collect()}
    say = lambda i: tuple(got[i][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    assert say(1) == (2, 0, 1, 1, 1, 6, "KKDD") and got[1]["repaired"] == "user:Hi.\nassistant:Yes!"
    assert say(2) == (1, 1, 0, 0, 2, 5, "DKR") and got[2]["repaired"] == "user:One?\nassistant:Two. \n"
    assert say(3) == (0, 0, 0, 0, 0, 0, "KKK")
    assert say(None) == (0, 0, 0, 0, 0, 2, "KI") and got[None]["repaired"] == "user:q.\nassistant:"
    assert say(4) == (0, 0, 0, 0, 0, 4, "IKKI")  # turns of one number are read in the order of their roles
    assert say(9) == (0, 0, 0, 0, 0, 0, "") and got[9]["repaired"] == ""


def test_conversations_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(c, t, ("user", "assistant")[t % 2], f"Say {t}.", "", 0, True) for c in range(9) for t in range(2 * c)]
        got = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversations.repair(turns_of(spark, rows)).collect()}
        assert got == {c: (0, "K" * 2 * c) for c in range(1, 9)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_long_conversation(spark):
    rows = [(0, t, ("user", "assistant")[t % 2], f"Say {t}", "", 0, True) for t in range(5000)]
    (row,) = conversations.repair(turns_of(spark, rows)).collect()
    assert (row["cost"], row["truncated"], row["audit"]) == (5000, 5000, "K" * 5000)


def test_empty_conversations(spark):
    assert conversations.repair(turns_of(spark, [])).count() == 0
    assert conversations.damaged(turns_of(spark, [])).count() == 0
