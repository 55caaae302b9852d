"""Chat formatting, repair of conversations and cascading erasure against plain versions."""

import hashlib
import itertools
import re
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from citelode.llm import chat_format, erasure, queries, turn_repair
from tests.test_registry import SF

TURNS = "conv_id long, turn long, role string, text string"
tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables aren't here")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# chat formatting

NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "[ROLE]", "[ROLE]\n", "[SYS", "<", "</", "\\", "", "é😀\n", "[/\\INST]", "<s></s>", "$1 \\1", "x" * 300_000]


def brute_examples(rows):
    """conv: turns, trainable texts."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    pieces = ["<", "/", "\\", "s>", "[", "INST]", "a", "SYS]", "ROLE]"]
    texts = sorted({"".join(p) for n in range(5) for p in itertools.product(pieces, repeat=n)})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = df.withColumn("e", chat_format.escaped(F.col("text"))).withColumn("back", chat_format.unescaped(F.col("e"))).collect()
    assert all(r.back == r.text for r in out)
    assert not any(m in r.e for r in out for m in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]"))
    assert len({r.e for r in out}) == len(texts)


def test_examples_hold_every_prefix_and_mask(spark):
    rows = [(1, i, ("user", "assistant", "system", "tool\n</s>", None)[i % 5], t) for i, t in enumerate(NASTY)]
    rows += [(2, None, "assistant", None), (2, None, "assistant", None), (2, 0, "user", "hm"), (None, 1, "user", "x"), (None, 1, "assistant", "y"), (3, 5, "user", "only")]
    df = spark.createDataFrame(rows, TURNS).withColumn("example", F.lit(1)).withColumn("pos", F.lit("a"))
    out = chat_format.examples(df)
    got = out.withColumn("turns", chat_format.parsed(F.col("text"))).collect()
    want = brute_examples(rows)
    for conv, turns in want.items():
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.example)
        replies = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        ends = replies + ([len(turns) - 1] if not replies or replies[-1] < len(turns) - 1 else [])
        assert [r.n_turns for r in mine] == [i + 1 for i in ends] and [r.last for r in mine] == [False] * (len(ends) - 1) + [True]
        for r, end in zip(mine, ends, strict=True):
            assert [tuple(t) for t in r.turns] == turns[: end + 1]
            if end in replies:
                assert r.text[r.loss_start + r.loss_chars :] == "</s>"
                assert re.sub(chat_format.ESCAPED, r"\1\2\3", r.text[r.loss_start : r.loss_start + r.loss_chars]) == turns[end][1]
            else:
                assert (r.loss_start, r.loss_chars) == (len(r.text), 0)
    for r in chat_format.digest(out).collect():
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars == sum(len(g.text) for g in got if g.conv_id == r.conv_id)


def test_examples_of_an_empty_table(spark):
    assert chat_format.digest(chat_format.examples(spark.createDataFrame([], TURNS))).count() == 0


def test_formatting_runs_no_python_and_one_exchange(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], TURNS)
    plan = chat_format.digest(chat_format.examples(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


@tables
def test_op11_has_the_planted_conversation(spark):
    r = queries.op11_prefix_targets(spark, str(SF)).where("conv_id = -7").first()
    said = queries.PLANTED
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))


# repair


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if how == 0:
            out.append((c, None))
            continue
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        out += [(c, (t, "user" if how == 4 else r, x))] * (2 if how == 3 else 1)
    return out


def brute_repair(turns):
    """Counts, cost, audit and repaired turns by trying every edit, cheapest first."""
    import heapq

    gone = r"\x20\x09-\x0D"
    codes, seen = [], set()
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        rest = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not re.search(f"[^{gone}]", text) else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        codes.append(fault)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, tail, made = heapq.heappop(heap)
        if (at, tail) in done:
            continue
        done.add((at, tail))
        if at == len(turns) and tail in ("", "a"):
            return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in made))
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[tail]
        for r in ("user", "assistant"):
            if r[0] in after:
                heapq.heappush(heap, (cost + 5, audit + "I", at, r[0], (*made, (r, ""))))
        if at < len(turns):
            _, role, text = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, tail, made))
            if codes[at] not in ("blank", "duplicate"):
                more = 5 * (codes[at] == "truncated")
                for r, c, e in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if r[:1] and r[:1] in after:
                        heapq.heappush(heap, (cost + c + more, audit + e, at + 1, r[0], (*made, (r, text))))


def brute_report(rows):
    convs = {}
    for c, turn in brute_damage(rows):
        convs.setdefault(c, []).extend([turn] if turn else [])
    return {c: brute_repair(sorted(v, key=lambda t: (t[0] is not None, t[0] or 0))) for c, v in convs.items()}


def as_reported(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_solve_equals_trying_every_audit():
    def brute(signature, most):
        found = []

        def go(at, made, cost, audit):
            if cost > most:
                return
            if at == len(signature) and re.fullmatch("(s?(ua)+)?", made):
                found.append((cost, audit))
            for r in "ua":
                go(at, made + r, cost + 5, audit + "I")
            if at < len(signature):
                go(at + 1, made, cost + 2, audit + "D")
                if (code := signature[at]) != "x":
                    for r, c, e in ((code.lower(), 0, "K"), ("u", 1, "R"), ("a", 1, "R")):
                        if re.fullmatch("(s?(ua)*u?)?", made + r):
                            go(at + 1, made + r, cost + c + 5 * code.isupper(), audit + e)

        go(0, "", 0, "")
        return min(found)

    for n in range(5):
        for signature in map("".join, itertools.product("xsuaoSUA", repeat=n)):
            if zlib.crc32(signature.encode()) % (1, 1, 1, 2, 16)[n] == 0:
                assert turn_repair.solve(signature) == brute(signature, turn_repair.solve(signature)[0])
    assert turn_repair.solve("ua" * 30_000 + "u")[0] == 2


def test_repair_of_odd_rows(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "No"), ("user", "Hi."), ("tool", "Yes!"), ("", "What?"), ("system", "Be.\x0b "), ("assistant", "\xa0")])]
    rows += [(2, None, None, "a."), (2, 3, "user", None), (2, 9, "assistant", "x" * 200_000 + "."), (None, 0, "user", "b."), (None, 1, "assistant", "c."), (4, 0, "user", "twice."), (4, 0, "user", "twice.")]
    df = spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit(1)).withColumn("audit", F.lit("z")).withColumn("cost", F.lit(None))
    assert as_reported(turn_repair.report(queries.damaged(df), "present")) == brute_report(rows)
    # without damage, and as turns
    turns = turn_repair.repair(df)
    made = {}
    for r in turns.orderBy("conv_id", "pos").collect():
        assert r.pos == len(made.setdefault(r.conv_id, []))
        made[r.conv_id].append((r.role, r.text))
    told = {r.conv_id: r.repaired_sha256 for r in turn_repair.report(df).collect()}
    assert told == {c: sha("\n".join(f"{a}:{b}" for a, b in made.get(c, []))) for c in told}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in v)) for v in made.values())


def test_conversations_that_lose_all_turns_stay(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", False), (2, 0, "user", "a.", True), (3, 0, "user", "a.", None)], TURNS + ", there boolean")
    assert as_reported(turn_repair.report(df, "there")) == {1: (0, 0, 0, 0, 0, 0, "", sha("")), 2: (0, 0, 0, 0, 0, 2, "D", sha("")), 3: (0, 0, 0, 0, 0, 0, "", sha(""))}
    assert turn_repair.report(df.limit(0)).count() == 0 and turn_repair.repair(df.limit(0)).count() == 0


@tables
def test_op12(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_reported(queries.op12_turn_repair(spark, str(SF))) == brute_report(rows)


# erasure


def brute_erasure(data):
    """name: file_no: rows kept, rows erased, by plain sorting; ``data`` has lists of tuples, columns as in the shop's tables."""
    master = {}
    for r in data["clients"]:
        if r[1] is not None:
            master.setdefault(r[1], set()).add(r[0])
    clicks = {}
    for r in data["clicks"]:
        clicks[r[3]] = clicks.get(r[3], 0) + 1
    victims = {m for m in master if zlib.crc32(str(m).encode()) % 100 == 0}
    if master:
        victims.add(min(master, key=lambda m: (-sum(clicks.get(c, 0) for c in master[m] if c is not None), m)))
    people = {c for m in victims for c in master[m] if c is not None}
    owner = {}
    for r in data["sales"]:
        if r[0] is not None and r[1] is not None:
            owner[r[0]] = min(owner.get(r[0], r[1]), r[1])
    sold = {r[0] for r in data["sales"] if r[1] in people and r[0] is not None}
    gone = {"clients": lambda r: r[1] in victims, "clicks": lambda r: r[3] in people, "sales": lambda r: r[1] in people, "sale_lines": lambda r: r[0] in sold}
    client = {"clients": lambda r: r[0], "clicks": lambda r: r[3], "sales": lambda r: r[1], "sale_lines": lambda r: owner.get(r[0])}
    out = {}
    for name, rows in data.items():
        key = lambda r: (zlib.crc32(("" if client[name](r) is None else str(client[name](r))).encode()), [(x is not None, x if x is not None else 0) for x in r])  # noqa: B023, E731
        rows, size = sorted(rows, key=key), 1 + len(rows) // erasure.FILES
        for no in range(0, -(-len(rows) // size)):
            held = rows[no * size : (no + 1) * size]
            left = [r for r in held if not gone[name](r)]
            if left:
                out[name, no] = left, len(held) - len(left)
    return out


AMOUNT = {"clients": 9, "clicks": 5, "sales": 3, "sale_lines": 5}


def check_erasure(result, data):
    import math

    rows = result.collect()
    want = brute_erasure(data)
    assert {(r.table_name, r.file_no) for r in rows} == set(want)
    folders = set()
    for r in rows:
        left, gone = want[r.table_name, r.file_no]
        table = pq.ParquetFile(r.path).read()
        assert ",".join(table.schema.names) == r.columns
        assert [tuple(x.values()) for x in table.to_pylist()] == left
        assert (r.n_rows, r.n_erased, r.rewritten) == (len(left), gone, gone > 0)
        assert r.ids_sha256 == sha(",".join("" if x[0] is None else str(x[0]) for x in left))
        assert r.cents == sum(math.floor(100 * x[AMOUNT[r.table_name]] + 0.5) for x in left if x[AMOUNT[r.table_name]] is not None)
        footer = pq.ParquetFile(r.path).metadata
        firsts = [x[0] for x in left if x[0] is not None]
        stats = [footer.row_group(i).column(0).statistics for i in range(footer.num_row_groups)]
        if firsts:
            assert min(s.min for s in stats if s.has_min_max) == min(firsts) and max(s.max for s in stats if s.has_min_max) == max(firsts)
        folders.add(Path(r.path).parent.parent)
    files = {str(p) for f in folders for p in f.rglob("*.parquet")}
    assert files == {r.path for r in rows}
    assert len({f.parent for f in folders}) == 1


@tables
def test_op13(spark):
    data = {t: [tuple(x.values()) for x in pq.read_table(f"{SF}/{t}.parquet").to_pylist()] for t in AMOUNT}
    check_erasure(queries.op13_cascading_erasure(spark, str(SF)), data)


SHOP = {
    "clients": "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double",
    "clicks": "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string",
    "sales": "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int",
    "sale_lines": "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz",
}


def shop(spark, data):
    return [spark.createDataFrame(data[t], SHOP[t]) for t in SHOP]


def test_erasure_of_hot_null_and_repeated_rows(spark, monkeypatch):
    """One client has most of all rows; ids are null, repeated or without a partner; a master has no clicks."""
    monkeypatch.setattr(erasure, "FILES", 25)
    n = None
    data = {
        "clients": [(i, i // 2 if i % 7 else n, "web", n, f"n{i}", n, n, n, n, float(i) if i % 3 else n) for i in range(200)] + [(n, 3, n, n, n, n, n, n, n, 0.005)] * 2,
        "clicks": [(i % 50, n, n, (8 if i % 2 else i % 200) if i % 11 else n, "view", i / 7, n) for i in range(700)],
        "sales": [(i if i % 13 else n, 8 if i % 3 == 0 else i % 200 if i % 5 else n, "done", -1.5, n, n, i % 4) for i in range(300)],
        "sale_lines": [((3 if i % 2 else i % 350) if i % 17 else n, i % 3, n, n, n, i / 3, n, "kept", n) for i in range(900)],
    }
    check_erasure(erasure.erase_clients(*shop(spark, data)), data)


def test_erasure_of_empty_tables(spark):
    assert erasure.erase_clients(*shop(spark, {t: [] for t in SHOP})).count() == 0
    data = {t: [] for t in SHOP} | {"clients": [(5, 5, *[None] * 8), (6, 4, *[None] * 8)]}
    check_erasure(erasure.erase_clients(*shop(spark, data)), data)


def test_layout_keeps_a_column_of_the_folders_name(spark):
    df = spark.range(400).selectExpr("id as `a.b`", "id % 3 as file_no", "'x' as path")
    laid = erasure.layout(df, f"{erasure.shared_dir(spark)}/clash", F.crc32(F.col("`a.b`").cast("string")))
    assert laid.number == "file_no_" and laid.read().where("file_no_ = 133").count() == 1
    before = {p: p.stat().st_mtime_ns for p in Path(laid.folder.removeprefix("file://")).rglob("*.parquet")}
    gone = erasure.erase(laid, spark.range(5), "a.b")
    after = {p: p.stat().st_mtime_ns for p in Path(laid.folder.removeprefix("file://")).rglob("*.parquet")}
    assert sum(gone.values()) == 5 and laid.read().count() == 395
    kept = set(before.items()) & set(after.items())
    assert len(kept) == len(before) - len(gone)
    assert erasure.erase(laid, spark.range(5), "a.b") == {}
