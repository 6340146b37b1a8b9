"""Conversation structure repair by a forward Viterbi search.

A repaired conversation reads, in the initials of its roles, ``(s?(ua)+)?``: it
may open with a system turn, then user and assistant alternate and the assistant
has the last word.  Each conversation's turns are walked once in order, over four
states of this grammar; each state carries its least (cost, audit string).  After
every turn the layer is closed by insertions, of which two reach every state.

One shuffle by conversation; its sorted turns stream through Arrow batches.  The
result holds a conversation's repaired text as one value, so the memory of a task
is that of one conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.common import crc32_sql, table

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, for each state that allows it.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: From each state, the one initial that an inserted or re-roled turn can have.
FREE = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
RE_ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The characters [\x20\x09-\x0D] are blanks; a whole turn ends with one of these.
BLANKS = " \t\n\v\f\r"
ENDS = (".", "!", "?")

Layer = dict[int, tuple[int, str]]


def closed(layer: Layer) -> Layer:
    """The layer with what insertions reach, two in a row at most."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            _better(layer, NEXT[state, FREE[state]], (cost + INSERT, audit + "I"))
    return layer


def _better(layer: Layer, state: int, found: tuple[int, str]) -> None:
    if state not in layer or found < layer[state]:
        layer[state] = found


def best_edits(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """(initial, must go, truncated) of the turns -> (cost, audit): the cheapest
    edits' initials (Keep, Re-role, Delete, Insert), the ASCII-least of equals."""
    layer = closed({START: (0, "")})
    for initial, must_go, cut in turns:
        after: Layer = {}
        extra = TRUNCATED * cut
        for state, (cost, audit) in layer.items():
            _better(after, state, (cost + DELETE, audit + "D"))
            if must_go:
                continue
            if (state, initial) in NEXT:
                _better(after, NEXT[state, initial], (cost + extra, audit + "K"))
            _better(after, NEXT[state, FREE[state]], (cost + RE_ROLE + extra, audit + "R"))
        layer = closed(after)
    return min(layer[s] for s in (START, ASSISTANT) if s in layer)


def edited(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) turns that the audit leaves or makes."""
    state, left, out = START, iter(turns), []
    for edit in audit:
        role, text = next(left) if edit != "I" else ("", "")
        if edit == "D":
            continue
        role = role if edit == "K" else ROLES[FREE[state]]
        state = NEXT[state, role[:1]]
        out.append((role, text))
    return out


@dataclass
class Conversation:
    """One conversation as its turns come in order."""

    turns: list[tuple[str, str]] = field(default_factory=list)
    marks: list[tuple[str, bool, bool]] = field(default_factory=list)
    seen: set[tuple[str, str]] = field(default_factory=set)
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0))
    last: int | None = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        bare, f = text.strip(BLANKS), self.faults
        fault = "blank" if not bare else "duplicate" if (role, text) in self.seen else None if bare.endswith(ENDS) else "truncated"
        if fault:
            f[fault] += 1
        self.seen.add((role, text))
        if self.turns and self.turns[-1][0][:1] + role[:1] not in LEGAL:
            f["illegal"] += 1
        if turn is not None:
            f["gaps"] += turn - self.last - 1 if self.last is not None and turn != self.last else 0
            self.last = turn
        self.turns.append((role, text))
        self.marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def row(self, conv_id: object) -> dict:
        cost, audit = best_edits(self.marks)
        repaired = "\n".join(f"{role}:{text}" for role, text in edited(self.turns, audit))
        return {"conv_id": conv_id, **self.faults, "cost": cost, "audit": audit, "repaired": repaired}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    ``turns`` holds (conv_id, turn, role, text), one row a turn, read by turn,
    nulls first, then role and text.  Null roles and texts are one space.  Rows for
    which ``present`` is not true are no turns, they only name their conversation.
    A turn's first fault counts: blank; duplicate (role and text came before);
    truncated (its last character that is no blank is none of ``.!?``).  ``gaps``
    counts turn numbers that are missing between the first and the last; ``illegal``
    neighbours that are not s-u, u-a or a-u.  A role of another initial, or empty, is
    never kept.  ``repaired`` joins ``role:text`` by
    newlines.  A null conv_id is a conversation; one without turns has zeros and
    empty strings; an empty table gives an empty result; other columns are ignored.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    spaced = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    cut = turns.select("conv_id", F.col("turn").cast("long").cast("string").alias("turn"), *spaced, there.alias("there"), F.col("turn").cast("long").alias("_turn"))
    ordered = cut.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("_turn"), "role", "text").drop("_turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_id, now = None, None
        for batch in batches:
            out = []
            ids = batch["conv_id"].astype(object).where(batch["conv_id"].notna(), None)
            for conv_id, turn, role, text, there in zip(ids, *[batch[c] for c in ("turn", "role", "text", "there")], strict=True):
                if now is None or conv_id != open_id:
                    if now is not None:
                        out.append(now.row(open_id))
                    open_id, now = conv_id, Conversation()
                if there:
                    now.add(None if turn is None else int(turn), role, text)
            yield frame(out)
        if now is not None:
            yield frame([now.row(open_id)])

    def frame(rows: list[dict]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["conv_id", *COLUMNS])
        return made.astype({"conv_id": "Int64"}) if kind in ("bigint", "int") else made

    counts = ", ".join(f"{c} long" for c in COLUMNS[:-2])
    return ordered.mapInPandas(run, f"conv_id {kind}, {counts}, audit string, repaired string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by the crc32 of 'conv_id:turn' modulo 20, with ``present``: 0
    takes the turn away, 1 empties its text, 2 takes the marks ``.!?`` out, 3 repeats
    it, 4 makes it the user's.  Nulls are read as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", code.alias("code"), text("role").alias("role"), text("text").alias("text"))
    changed = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), (F.col("code") != 0).alias("present"), copies.alias("copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair(damaged(table(spark, sf_dir, "conversations")), F.col("present"))
    return found.select("conv_id", *COLUMNS[:-1], F.sha2("repaired", 256).alias("repaired_sha256"))


def _oracle() -> str:
    def add(state: str, cost: str, edit: str, turn: str = "''") -> str:
        key = f"lpad(CAST(CAST({state}.k[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {state}.k[10:] || '{edit}'"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'k': {key}, 't': {state}.t || {turn}}} END"

    least = lambda *s: f"list_min([{', '.join(s)}])"
    gone = [add(f"s{i}", "3", "D") for i in range(4)]
    own = "role || ':' || text || chr(10)"
    keep = lambda i, s: f"CASE WHEN NOT goes AND sym = '{i}' THEN {add(s, 'cut', 'K', own)} END"
    role = lambda r, s: f"CASE WHEN NOT goes THEN {add(s, '2 + cut', 'R', f"'{r}:' || text || chr(10)")} END"
    user = [f(x, s) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (role, "user"))]
    put = lambda s, r: add(s, "2", "I", f"'{r}:' || chr(10)")
    closing = lambda rows: f"SELECT conv, r, s0, s1, s2, {least('s3', put('s2', 'assistant'))} AS s3 FROM (SELECT conv, r, s0, s1, {least('s2', *[put(s, 'user') for s in ('s0', 's1', 's3')])} AS s2, s3 FROM ({rows}))"
    none = "CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR))"
    first = f"SELECT conv, CAST(0 AS BIGINT) AS r, {{'k': '000000000', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM (SELECT DISTINCT conv FROM ids)"
    step = f"""SELECT w.conv, m.r, {gone[0]} AS s0, {least(gone[1], keep('s', 's0'))} AS s1, {least(gone[2], *user)} AS s2,
            {least(gone[3], keep('a', 's2'), role('assistant', 's2'))} AS s3 FROM walk w JOIN marked m ON m.conv = w.conv AND m.r = w.r + 1"""
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
coded AS (SELECT *, {crc32_sql("conv || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM raw),
ids AS (SELECT DISTINCT conv_id, conv FROM raw),
damaged AS (SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS again FROM coded WHERE code <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, again) AS r, role[1] AS sym FROM damaged),
faults AS (SELECT *, CASE WHEN {blank} THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY r) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(sym) OVER (PARTITION BY conv ORDER BY r) || sym AS pair FROM numbered),
marked AS (SELECT *, fault IN ('blank', 'duplicate') AS goes, CAST(fault = 'truncated' AS INTEGER) AS cut FROM faults),
walk AS ({closing(first)} UNION ALL {closing(step)}),
ends AS (SELECT conv, {least('s0', 's3')} AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY r DESC) AS back FROM walk) WHERE back = 1),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(best.k[1:9] AS BIGINT) AS cost, best.k[10:] AS audit, sha256(best.t[1:-2]) AS repaired_sha256
FROM ids JOIN ends ON ends.conv = ids.conv LEFT JOIN counts ON counts.conv = ids.conv"""


#: The same search as a recursive query.
ORACLE = _oracle()
