"""Commands over libraries in a folder."""

import json

import pytest

from citelode import commands
from citelode.operators.schemas import LIBRARY_DOCUMENTS, RUNS
from tests.test_operators import BASE, found


def stored(spark, root, name, query, titles):
    from datetime import datetime

    folder = root / name
    spark.createDataFrame([(1, query, name, datetime(2024, 1, 1))], RUNS).coalesce(1).write.parquet(str(folder / "runs.parquet"))
    rows = [(i, 1, t, f"u{i}", "arxiv", "A", "2001", None, f"{t}.pdf" if t != "gone" else "", None, None, 9) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, LIBRARY_DOCUMENTS).coalesce(1).write.parquet(str(folder / "documents.parquet"))


def test_libraries(spark, tmp_path):
    stored(spark, tmp_path, "old-5-1", "whales", ["b", "A", "gone"])
    stored(spark, tmp_path, "new-9-1", "deep whales", ["x"])
    rows = commands.list_libraries(spark, str(tmp_path)).collect()
    assert [(r.library, r.query, r.n_docs) for r in rows] == [("new-9-1", "deep whales", 1), ("old-5-1", "whales", 3)] and all(r.size_bytes > 0 for r in rows)
    assert [r.library for r in commands.list_libraries(spark, str(tmp_path), "DEEP", "docs").collect()] == ["new-9-1"]
    assert [r.title for r in commands.list_library_docs(spark, str(tmp_path), "old-5-1").collect()] == ["A", "b"]
    for bad in ("..", "../x", "none"):
        with pytest.raises(commands.CommandError):
            commands.open_library(spark, str(tmp_path), bad) if bad == "none" else commands.delete_library(str(tmp_path), bad)
    with pytest.raises(commands.CommandError):
        commands.delete_library(str(tmp_path), "")
    commands.delete_library(str(tmp_path), "old-5-1")
    assert not (tmp_path / "old-5-1").exists() and (tmp_path / "new-9-1").exists()


def test_manifest_and_log(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "manifest.json").write_text(json.dumps({"query": "q", "documents": [{"title": "t", "url": "u", "authors": ["a", "b"], "local_path": "t.pdf"}] * 2}))
    runs, docs = commands.open_library(spark, str(tmp_path), "lib")
    assert runs.first().query == "q" and [(r.url, r.authors) for r in docs.collect()] == [("u", "a, b")]
    log = tmp_path / "log"
    assert commands.run_log_info(str(log)) == {"path": str(log), "exists": False, "size_bytes": 0}
    log.mkdir()
    (log / "a.jsonl").write_text("".join(json.dumps({"ts": f"2024-01-01T00:00:0{i}Z", "event": {"SourceHit": {"source": "a", "count": i}}}) + "\n" for i in range(5)))
    assert commands.run_log_info(str(log))["size_bytes"] > 0
    assert [r.event.SourceHit["count"] for r in commands.run_log_tail(spark, str(log), 2).collect()] == [3, 4]
    files, size = commands.export_library_zip(spark, str(tmp_path), "lib", str(tmp_path / "out.zip"))
    assert files == 1 and size > 0


def test_start_run(spark):
    rows = [{**BASE, "title": f"whales and seas {i}", "url": f"https://a/{i}.pdf", "source_id": s, "source": s, "rank_in_source": i} for i in range(6) for s in ("arxiv", "odd")]
    asked = spark.createDataFrame([(BASE["run_id"], "whales", ["arxiv", "odd"]), (77, "!", ["arxiv"])], "run_id long, query string, sources array<string>")
    out = commands.start_run(asked, found(spark, *rows)).collect()
    assert {r.source for r in out} == {"arxiv"} and len(out) == 6 and {r.run_id for r in out} == {BASE["run_id"]}


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id long, query string, sources array<string>")


def test_runs_are_planned_in_two_waves(spark):
    asked = requests(spark, (1, "deep whales, cold seas", ["zenodo", "meta_search", "web", "odd"]), (2, "?", ["zenodo"]), (3, "ants", ["arxiv"]))
    extras = spark.createDataFrame([(1, 0, "COLD seas"), (1, 1, "polar oceans"), (1, 2, "polar oceans ice"), (3, 0, "  ")], "run_id long, idx int, sub_query string")
    tasks = [(r.run_id, r.wave, r.sub_idx, r.sub_query, r.keywords, r.source_idx, r.source_id) for r in commands.plan_run(asked, extras).collect()]
    # covered and unknown sources are out; what the first wave has isn't asked again
    assert {t[6] for t in tasks if t[0] == 1} == {"zenodo", "meta_search"} and {t[0] for t in tasks} == {1, 3}
    subs = {t[1:4] for t in tasks if t[0] == 1}
    assert {s for s in subs if s[0] == 2} == {(2, 1, "polar oceans"), (2, 2, "polar oceans ice")}
    assert {s[2] for s in subs if s[0] == 1} == {"deep whales", "cold seas"}
    assert len(tasks) == 4 * 2 + 1


def test_answers_belong_to_their_tasks(spark):
    asked = requests(spark, (1, "deep whales, cold seas", ["zenodo", "doaj"]))
    rows = [(1, q, s, i, f"{q} {i}", f"u{s}{q}{i}", s, [], None, None, None) for q in ("deep whales", "cold seas", "never asked") for s in ("zenodo", "doaj", "arxiv") for i in (1, 2, 3)]
    answers = spark.createDataFrame(rows, "run_id long, sub_query string, source_id string, rank_in_source int, title string, url string, source string, authors array<string>, year string, abstract string, identifier string")
    out = commands.start_run(asked, answers, per_source=2).collect()
    # two sub-queries at two sources, two results each; short titles without authors don't merge
    assert sorted(r.url for r in out) == sorted(f"u{s}{q}{i}" for q in ("deep whales", "cold seas") for s in ("zenodo", "doaj") for i in (1, 2))
    assert {s for r in out for s in r.sources} == {"zenodo", "doaj"}


def test_search_asks_both_waves(spark):
    asked = requests(spark, (1, "deep whales", ["zenodo", "meta_search"]), (2, "cold seas", ["zenodo"]))
    extras = spark.createDataFrame([(1, 0, "polar oceans"), (2, 0, "short ice")], "run_id long, idx int, sub_query string")
    fetch = "tests.fake_net:answer"
    out = commands.search(asked, fetch, max_total=500, per_source=12, extras=extras)
    rows = out.collect()
    # documents of one address are one, whichever sub-queries and engines found it
    assert len({(r.run_id, r.url) for r in rows}) == len(rows)
    assert {s for r in rows if r.run_id == 1 for s in r.sources} == {"zenodo", "meta_search"} and {s for r in rows if r.run_id == 2 for s in r.sources} == {"zenodo"}
    assert max(x.rank for r in rows for x in r.source_ranks) == 12
    assert any(len(r.source_ranks) > 2 for r in rows if r.run_id == 1)
    # a run that is full after the first wave has no second
    small = commands.search(asked.where("run_id = 2"), fetch, max_total=5, per_source=12, extras=extras).collect()
    assert len(small) == 5


def test_folders_with_a_manifest_alone_are_listed(spark, tmp_path):
    stored(spark, tmp_path, "new-9-1", "deep whales", ["x"])
    docs = [{"title": "t", "url": u, "authors": []} for u in ("u", "v", "u")]
    for name, body in (("old-3-1", json.dumps({"query": "whales", "documents": docs})), ("bad-1-1", "{"), ("none-1-1", json.dumps({"query": "whale bones", "documents": []}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(body)
    (tmp_path / "other").mkdir()
    rows = [(r.library, r.query, r.n_docs) for r in commands.list_libraries(spark, str(tmp_path)).collect()]
    assert rows == [("new-9-1", "deep whales", 1), ("old-3-1", "whales", 2), ("none-1-1", "whale bones", 0)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert commands.list_libraries(spark, str(empty)).count() == 0


def test_cancel_adds_a_whole_row(tmp_path):
    commands.cancel_run(str(tmp_path), 7)
    (name,) = [p.name for p in tmp_path.iterdir()]
    assert json.loads((tmp_path / name).read_text()) == {"run_id": 7, "event": "cancel", "arrival_seq": 2**62}
