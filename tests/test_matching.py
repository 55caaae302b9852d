"""The matcher by components against the fold, and the passes that it rests on."""

import random

import pytest
from pyspark.sql import functions as F

from citelode.operators import dedup, matching, staging
from citelode.operators.schemas import DISCOVERY
from tests.test_operators import BASE, found, plain_fold


def odd_rows(seed, runs, most):
    """Rows that share addresses, DOIs, titles and fingerprints in every way; one run is large."""
    rng = random.Random(seed)
    titles = ["Untitled", None, "!!", "Annual Report", "Annual report", "The Art of", "The Art of Things", "The Art of Things Revised", "a study of very deep things", "a study of very deep thoughts"]
    titles += [f"Volume {i}" for i in range(6)] + ["word " * 3 + "x" * 190]
    rows = []
    for run in range(runs):
        seqs = rng.sample(range(most * 9), most if run == 0 else rng.randint(1, 30))
        for seq in sorted(seqs):
            doi = rng.choice([None] * 6 + [f"10.1234/{i}{e}" for i in range(4) for e in ("", ".pdf")])
            url = f"https://h{rng.randint(0, 1)}/{doi}" if doi and rng.random() < 0.5 else f"u{rng.randint(0, most // 2)}"
            rows.append(
                {**BASE, "run_id": run or None, "arrival_seq": seq, "source_id": rng.choice("abc"), "rank_in_source": seq, "title": rng.choice(titles), "url": url, "identifier": doi,
                 "authors": rng.choice([[], ["Doe, J"], ["A Doe"], ["B Roe"], ["C Poe"]]), "year": rng.choice([None, "2000", "2001", "99", "20é"])}
            )
    rng.shuffle(rows)
    return rows


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.run_id, {})[r.insert_idx] = (r.title, r.url, r.identifier, [(x.source, x.rank) for x in r.source_ranks])
    return out


@pytest.mark.parametrize(("seed", "cap"), [(1, None), (2, 7), (3, 40)])
def test_components_equal_the_fold(spark, seed, cap):
    df = found(spark, *odd_rows(seed, 25, 400))
    keyed = {}
    for r in dedup.with_keys(df).orderBy("run_id", "arrival_seq").collect():
        keyed.setdefault(r.run_id, []).append(r.asDict())
    got = {}
    for r in matching.matched(df, cap).collect():
        got.setdefault(r.run_id, {}).setdefault(r.insert_idx, []).append(r.arrival_seq)
    for run, rows in keyed.items():
        want = plain_fold(rows)
        if cap is not None and len(want) >= cap:
            last = want[cap - 1][0]
            want = [[s for s in seqs if s <= last] for seqs in want[:cap]]
        assert {i: sorted(s) for i, s in got[run].items()} == dict(enumerate(want))
    whole = grouped(matching.resolve_large(df, cap))
    assert whole == grouped(dedup.resolve(df, 10**9 if cap is None else cap))


def test_hot_keys_reach_the_fold_once(spark):
    """Rows of one address, one DOI or one tuple of title and authors become one row before the fold."""
    rows = [{"title": "Annual Report", "url": "same"}] * 300 + [{"title": f"t{i}", "url": f"https://h/10.1234/x?{i}"} for i in range(300)]
    rows += [{"title": "a study of very deep things", "url": f"v{i}"} for i in range(300)] + [{"title": None, "url": f"w{i}"} for i in range(50)]
    out = matching.resolve_large(found(spark, *rows)).orderBy("insert_idx").collect()
    assert [len(r.source_ranks) for r in out] == [300, 300, 300] + [1] * 50
    assert [r.insert_idx for r in out] == list(range(53))


def test_no_rows(spark):
    none = spark.createDataFrame([], DISCOVERY)
    assert matching.resolve_large(none).count() == 0 and matching.matched(none, 3).count() == 0
    assert matching.matched(found(spark, {"title": "t", "url": "u"}), 0).count() == 0


def test_numbers_along_a_group_of_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(staging, "STRETCH", 10)
    rng = random.Random(4)
    rows = [(run, x) for run in (None, 1, 2) for x in rng.sample(range(10**6), 500 if run else 3)] + [(3, 10**15), (3, 1)]
    got = staging.numbered(spark.createDataFrame(rows, "run long, x long"), "run", "x", "n").collect()
    want = {}
    for run in {r for r, _ in rows}:
        want |= {(run, x): i for i, x in enumerate(sorted(x for r, x in rows if r == run))}
    assert {(r.run, r.x): r.n for r in got} == want and len(got) == len(rows)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5000, 5200)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.root for r in staging.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert staging.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fold_of_components_holds_one_component(spark):
    """No pandas group: the plan folds sorted partitions, and texts stay out of Python."""
    df = found(spark, {"title": "t", "url": "u"})
    out = matching.matched(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert df.where(F.lit(False)).count() == 0
