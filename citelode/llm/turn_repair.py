"""Repair of conversations whose turns are missing, repeated, blank, cut off or out of order.

A conversation is legal where its roles' initials are nothing or ``s?(ua)+``. Its turns are
encoded as one short string, a letter for each turn's role and fault; conversations repeat far
more in these signatures than in their texts, so each distinct signature is solved once, by
memoised recursion over the turns left and the state of the grammar, and the audits are joined
back. They are then replayed: a conversation's audit comes first and its turns after it, in one
sorted partition, so texts are exchanged once and stream through; a task holds a batch of turns
and the audit's letters, however long the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelode.llm.common import SPACES, meet, stage, trim

#: Costs of the edits Delete, Insert, Keep and Rerole, in the order of ties; what a cut-off turn that stays adds.
COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
CUT = 5
#: States of the grammar: before anything, after system, after user, after a reply. Where each
#: initial leads, which turn is wanted next, and where that leads.
_START, _SYSTEM, _USER, _REPLY = range(4)
_AFTER = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _REPLY}, {"u": _USER})
_WANTED = ("user", "user", "assistant", "user")
_NEXT = (_USER, _USER, _REPLY, _USER)
_NEVER = float("inf")


def solve(signature: str) -> tuple[int, str]:
    """The least cost of making a conversation legal, and the edits' initials, of equals the least string.

    A letter for each turn: ``x`` has to go; ``s u a`` or ``o`` (any other role) may stay, in
    capitals where it is cut off. An edit's letter says all: the state settles the role that a
    Rerole or Insert gives. Since the options at a turn differ in their letter, the least string
    takes the least letter that still reaches the least cost.
    """
    n, memo = len(signature), {}

    def edits(at: int, state: int) -> list[tuple[str, int, int]]:
        """Edits that take the next turn: letter, cost, state after it."""
        code = signature[at]
        out = [("D", COSTS["D"], state)]
        if code != "x":
            extra = CUT * code.isupper()
            if (kept := _AFTER[state].get(code.lower())) is not None:
                out.append(("K", COSTS["K"] + extra, kept))
            out.append(("R", COSTS["R"] + extra, _NEXT[state]))
        return out

    def taking(at: int, state: int) -> float:
        """The least cost from here where no turn is inserted first."""
        if at == n:
            return 0 if state in (_START, _REPLY) else _NEVER
        return min(cost + best(at + 1, after) for _, cost, after in edits(at, state))

    def best(at: int, state: int) -> float:
        if (at, state) not in memo:
            once, twice = _NEXT[state], _NEXT[_NEXT[state]]
            memo[at, state] = min(taking(at, state), COSTS["I"] + taking(at, once), 2 * COSTS["I"] + taking(at, twice))
        return memo[at, state]

    # from the last turn on, so that the recursion never goes deeper than one turn
    for at in range(n, -1, -1):
        for state in range(4):
            best(at, state)
    audit, at, state = [], 0, _START
    while at < n or best(at, state) > 0:
        options = [(letter, at + 1, after) for letter, cost, after in (edits(at, state) if at < n else []) if cost + best(at + 1, after) == best(at, state)]
        if COSTS["I"] + best(at, _NEXT[state]) == best(at, state):
            options.append(("I", at, _NEXT[state]))
        letter, at, state = min(options)
        audit.append(letter)
    return int(best(0, _START)), "".join(audit)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


def _turns(df: DataFrame, present: str | None) -> DataFrame:
    """The operator's columns: null role and text as one space, ``key`` for equality and order of ties."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return df.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("key"), there.alias("there"))


_ORDER = ("turn", "role", "key")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _signatures(turns: DataFrame) -> DataFrame:
    """``conv_id``, its counts of faults and its signature; one exchange, without texts."""
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    cut = ~F.col("text").rlike(f"[.!?][{SPACES}]*\\z")
    initial = F.substring("role", 1, 1)
    short = turns.select("conv_id", "turn", "role", "key", "there", blank.alias("is_blank"), cut.alias("is_cut"), initial.alias("initial")).repartition("conv_id")
    order = [F.asc_nulls_first(c) for c in _ORDER]
    seen = F.row_number().over(Window.partitionBy("conv_id", "there", "key").orderBy(*order)) > 1
    w = Window.partitionBy("conv_id", "there").orderBy(*order)
    fault = F.when(F.col("is_blank"), "b").when(F.col("seen"), "d").when(F.col("is_cut"), "t").otherwise("")
    short = short.withColumn("seen", seen).withColumn("fault", fault).withColumn("pos", F.row_number().over(w))
    pair = F.concat(F.lag("initial").over(w), F.col("initial"))
    short = short.withColumn("wrong", ~pair.isin("su", "ua", "au")).withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(w)))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(letter)).otherwise(letter)
    at = F.when(F.col("there"), F.col("turn"))

    def number(condition: Column) -> Column:
        return F.count(F.when(F.col("there") & condition, 1))

    return short.groupBy("conv_id").agg(
        F.coalesce(F.max(at) - F.min(at) + 1 - number(F.col("new_turn")), F.lit(0)).cast("long").alias("gaps"),
        number(F.col("fault") == "b").alias("blank"),
        number(F.col("fault") == "d").alias("duplicate"),
        number(F.col("fault") == "t").alias("truncated"),
        number(F.col("wrong")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("pos", code.alias("code"))))), lambda x: x["code"]), "").alias("signature"),
    )


def audits(df: DataFrame, present: str | None = None) -> DataFrame:
    """For each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit``.

    Turns stand by number, nulls first, then by role and a hash of role and text. The first fault
    of a turn counts: blank, duplicate (role and text stand earlier), truncated (its last
    character other than white space isn't one of ``.!?``). ``gaps`` are numbers missing between
    the least and the greatest, ``illegal`` neighbours whose initials aren't ``su``, ``ua`` or
    ``au``. A null role or text counts as one space; turns without a conversation's id form one
    without id. With ``present``, a boolean column, rows where it isn't true only tell that the
    conversation exists; one without turns has zeros and empty strings. An empty table gives no
    rows; further columns are left out.
    """
    convs = stage(_signatures(_turns(df, present)), "turn-signatures", clean=False)
    known = convs.groupBy("signature").agg(F.lit(1).alias("one")).select("signature").mapInArrow(_solved, "signature string, cost long, audit string")
    return meet(convs, known, "signature", F.xxhash64("conv_id"))


def _replayed(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Turns after each conversation's audit: what the edits leave of them, or one digest for each conversation."""
    told: tuple | None = None
    letters, at, state, made, sha = "", 0, _START, 0, hashlib.sha256()
    out: list[tuple] = []

    def put(turn: int | None, role: str, text: str, edit: str) -> None:
        nonlocal made
        if digest:
            sha.update(f"{chr(10) * (made > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
        else:
            out.append((told[0], made, turn, role, text, edit))
        made += 1

    def inserted() -> None:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            put(None, _WANTED[state], "", "I")
            state, at = _NEXT[state], at + 1

    def ended() -> None:
        if told is not None:
            inserted()
            if digest:
                out.append((*told, sha.hexdigest()))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(shape)], names=[name for name, _ in shape])

    shape = [("conv_id", pa.int64())]
    shape += [(c, pa.int64()) for c in (*_COUNTS, "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())] if digest else []
    shape += [] if digest else [("pos", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
    for batch in batches:
        if batch.num_rows:
            shape[0] = ("conv_id", batch.schema.field("conv_id").type)
        for conv, audit, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "about", "turn", "role", "text")), strict=True):
            if audit is not None:
                ended()
                told = (conv, *(audit[c] for c in (*_COUNTS, "cost", "audit")))
                letters, at, state, made, sha = audit["audit"], 0, _START, 0, hashlib.sha256()
                continue
            inserted()
            letter, at = letters[at], at + 1
            if letter == "K":
                put(turn, role, text, letter)
                state = _AFTER[state][role[:1]]
            elif letter == "R":
                put(turn, _WANTED[state], text, letter)
                state = _NEXT[state]
        if out:
            yield batch_of(out)
            out.clear()
    ended()
    if out:
        yield batch_of(out)
    trim()


def _replay(df: DataFrame, present: str | None, digest: bool, schema: str) -> DataFrame:
    about = F.struct(*_COUNTS, "cost", "audit").alias("about")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("key", "long"))]
    heads = audits(df, present).select("conv_id", F.lit(0).alias("is_turn"), about, *none)
    turns = _turns(df, present).where("there").select("conv_id", F.lit(1).alias("is_turn"), F.lit(None).cast(heads.schema["about"].dataType).alias("about"), "turn", "role", "text", "key")
    dealt = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "is_turn", *(F.asc_nulls_first(c) for c in _ORDER))
    kind = df.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(lambda batches: _replayed(batches, digest), f"conv_id {kind}, {schema}")


def repair(df: DataFrame, present: str | None = None) -> DataFrame:
    """The repaired turns: ``conv_id, pos, turn, role, text, edit`` with ``pos`` from 0.

    ``edit`` is K, R or I, as in ``audits``, which also says what nulls, ties and empty tables
    give; an inserted turn has no number and an empty text. Conversations of which nothing is
    left have no rows.
    """
    return _replay(df, present, False, "pos int, turn long, role string, text string, edit string")


def report(df: DataFrame, present: str | None = None) -> DataFrame:
    """``audits`` with ``repaired_sha256``: the hash of the repaired ``role:text``, joined by newlines."""
    counts = ", ".join(f"{c} long" for c in (*_COUNTS, "cost"))
    return _replay(df, present, True, f"{counts}, audit string, repaired_sha256 string")
