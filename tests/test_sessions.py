"""Settings, run state and caches on small tables."""

from pyspark.sql import functions as F

from citelode.operators import discovery, events, library, session


def test_numbers_that_are_no_limits(spark):
    df = spark.createDataFrame([(25.9,), (0.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,)], "n double")
    assert [r[0] for r in df.select(session.positive(F.col("n"), 7)).collect()] == [25, 7, 7, 7, 7, 7]


def test_run_state(spark):
    rows = [
        ("start", None, None), ("found", None, 1), ("found", None, 2), ("download_started", "a", None), ("download_started", "b", None), ("download_done", "a", 2),
    ]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "run_id int, seq int, type string, url string, total long")
    for c in ("count", "done", "failed", "kept", "rejected"):
        df = df.withColumn(c, F.lit(None).cast("long"))
    for c in ("source", "kind", "folder", "message"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    r = session.reduce_run(df).first()
    assert (r.running, r.found, r.total, r.active, r.fatal_error) == (True, 2, 2, 1, None)
    ended = df.unionByName(df.where("seq = 0").withColumn("seq", F.lit(9)).withColumn("type", F.lit("error")).withColumn("message", F.lit("m")))
    r = session.reduce_run(ended).first()
    assert (r.running, r.active, r.fatal_error) == (False, 0, "m")


def test_source_status(spark):
    def state(*types):
        df = spark.createDataFrame([(1, i, t, "arxiv") for i, t in enumerate(types)], "run_id int, seq int, type string, source string")
        r = session.source_states(df, F.array(F.lit("arxiv"))).first()
        return r.status, r.hits, r.active

    assert state("source_start", "source_start", "found", "source_done") == ("querying", 1, 1)
    assert state("source_start", "source_error", "source_done") == ("error", 0, 0)
    assert state("source_start", "source_error", "found", "source_done") == ("done", 1, 0)
    assert state("source_start", "source_start", "found_total") == ("done", 0, 0)


def test_throttle_measures_from_the_last_report_let_through(spark):
    rows = [(0, "progress"), (150, "progress"), (300, "progress"), (310, "done"), (400, "progress"), (520, "progress")]
    df = spark.createDataFrame([(1, "u", i, ms, s) for i, (ms, s) in enumerate(rows)], "run_id int, url string, seq long, ms long, status string")
    assert sorted(r.seq for r in events.throttle(df).collect()) == [0, 2, 3, 5]


def test_retries(spark):
    df = spark.createDataFrame([(429, 1, None), (429, 2, 3), (500, 1, None), (503, 1, 60), (None, 2, 1), (502, 3, None)], "s int, a int, r int")
    assert [r[0] for r in df.select(discovery.retry_delays(F.col("s"), F.col("a"), F.col("r"))).collect()] == [5.0, 3.0, None, 8.0, 4.0, None]


def test_cache_and_toggles(spark):
    entries = spark.createDataFrame([("a", 10.0, "old"), ("a", 50.0, "new"), ("b", 0.0, "x")], "key string, stored_at double, value string")
    asked = spark.createDataFrame([("a", 60.0), ("a", 20.0), ("b", 300.0), ("c", 1.0)], "key string, at double")
    assert sorted((r.key, r.at, r.value) for r in session.cached(entries, asked, 100, ["key"]).collect()) == [("a", 20.0, "old"), ("a", 60.0, "new"), ("b", 300.0, None), ("c", 1.0, None)]
    chosen, bulk = F.array(F.lit("x"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))
    r = spark.range(1).select(session.enable_all(chosen, bulk), session.disable_all(chosen, bulk), session.inverted(chosen, bulk)).first()
    assert list(r) == [["x", "a", "b"], ["x"], ["x", "b"]]


def test_runs_get_ids(spark):
    old = spark.createDataFrame([("l", 4, "q")], "library string, id long, query string")
    new = spark.createDataFrame([("l", "r", 2), ("l", "s", 1), ("m", "t", 1)], "library string, query string, seq int")
    assert sorted((r.library, r.id, r.query) for r in session.insert_runs(old, new).collect()) == [("l", 4, "q"), ("l", 5, "s"), ("l", 6, "r"), ("m", 1, "t")]


def test_library_docs_in_order(spark):
    df = spark.createDataFrame([(1, "b", "u", "f"), (1, "A", "v", "g"), (1, "c", "w", ""), (1, "d", "x", None), (1, "a", "t", "f")], "library int, title string, url string, local_path string")
    assert [(r.title, r.url) for r in library.library_docs(df).collect()] == [("a", "t"), ("A", "v"), ("b", "u")]
    assert sorted((r.title, r.place) for r in library.library_docs(df, spark.createDataFrame([("f",)], "path string"), "library").collect()) == [("a", 1), ("b", 2)]


def test_content_checks_tell_whole_texts_from_truncated_ones(spark, tmp_path):
    import hashlib

    from citelode.plans import sessions

    texts = ["", "a" * 501, "a" * 1000, "a" * 1001, "a" * 2000, "a" * 2001, "é" * 1000, "é" * 1000 + "a", "a" + "é" * 1000, "😀" * 500, "a😀" * 400 + "b", "😀" * 501]
    spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.hash, r.fits, r.whole, r.body) for r in sessions.q_content_checks(spark, str(tmp_path)).collect()}
    raw = [t.encode() for t in texts]
    assert got == {i: (hashlib.sha256(b).hexdigest(), i % 2 == 0, len(b) <= 2000, hashlib.md5(b).hexdigest() if len(b) <= 1000 else None) for i, b in enumerate(raw)}
