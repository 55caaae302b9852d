"""The ten operators and the pipeline against brute force, round trips and edge cases."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelode.llm import common, html_text, lang_id, license_scan, line_dedup, ngram_join, packing, sentence_pieces, substring_dedup, vector_search, webp
from citelode.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SEED = 7


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def edge_rows():
    """Nulls, empties, white space, one word, a very long text, repeats of rows and of texts."""
    rng = random.Random(SEED)
    long = prose(rng, 30_000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, long), (6, long), (6, long), (None, "null key here"), (7, "one"), (8, prose(rng, 40))]


# --- shared -------------------------------------------------------------------------------------


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    rng = random.Random(SEED)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "test", local).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "test", local).count() == 0


# --- 1: line dedup ------------------------------------------------------------------------------


def test_line_dedup_drops_templates_and_keeps_copies(spark):
    rng = random.Random(SEED)
    rows = [(i, f"{prose(rng, 60)}\nPosted by user {i} on 2024-01-{i % 28 + 1:02d}\n\n{prose(rng, 40)}\nShared today by {prose(rng, 1)} with all of our readers") for i in range(20)]
    rows += [(100 + i, "Just the same line of text again") for i in range(20)]  # copies: equal texts are one document
    out = {r.doc_id: r for r in line_dedup.drop_recurring(documents(spark, rows)).collect()}
    for i in range(20):
        assert out[i].n_lines == 5 and out[i].n_dropped == 2
        assert out[i].text.split("\n") == [rows[i][1].split("\n")[k] for k in (0, 2, 3)]
    assert all(out[100 + i].text == rows[20][1] and not out[100 + i].n_dropped for i in range(20))


def test_line_dedup_leaves_mostly_recurring_documents_whole(spark):
    rng = random.Random(SEED)
    shared = prose(rng, 50)
    rows = [(i, f"{shared}\n{prose(rng, 3)}") for i in range(15)]
    assert {r.n_dropped for r in line_dedup.drop_recurring(documents(spark, rows)).collect()} == {0}


def test_line_dedup_drops_frames_from_short_documents(spark):
    rng = random.Random(SEED)
    head, foot = prose(rng, 12), prose(rng, 12)
    rows = [(i, f"{head}\n{prose(rng, 200)}\n{foot}") for i in range(15)]
    rows += [(100 + i, f"{head}\n{prose(rng, 3)}\n{foot}") for i in range(5)]  # mostly frame
    copied = [prose(rng, 20) for _ in range(10)]
    rows += [(200 + i, "\n".join([head, *copied[:i % 10], prose(rng, 20), *copied[i % 10 + 1 :]])) for i in range(30)]  # a family of near copies
    out = {r.doc_id: r for r in line_dedup.drop_recurring(documents(spark, rows), most=0.3).collect()}
    for i, t in rows:
        assert out[i].text.split("\n") == [x for x in t.split("\n") if x not in (head, foot)]


def test_line_dedup_keeps_short_lines_with_a_common_lead(spark):
    rng = random.Random(SEED)
    rows = [(i, f"{prose(rng, 60)}\nI do not {prose(rng, 1 + i % 2)}\n{prose(rng, 40)}") for i in range(60)]
    assert {r.n_dropped for r in line_dedup.drop_recurring(documents(spark, rows)).collect()} == {0}


def test_line_dedup_finds_templates_in_mixed_leaves(spark):
    rng = random.Random(SEED)
    name = lambda: prose(rng, 1, "klmnopqrstuvw") + prose(rng, 1, "klmnop")
    lines = [f"Posted in the news section by {name()} for readers" for _ in range(50)]
    lines += [f"Posted in the evening with {name()} to all members" for _ in range(30)]
    other = [f"Posted in the {' '.join(name() for _ in range(6))}" for _ in range(20)]
    rows = [(i, f"{prose(rng, 60)}\n{x}\n{prose(rng, 40)}") for i, x in enumerate(lines + other)]
    out = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring(documents(spark, rows)).collect()}
    assert out == {i: int(i < len(lines)) for i in range(len(rows))}


def test_line_dedup_leaves_only_what_its_result_reads(spark):
    rng = random.Random(SEED)
    name = lambda: prose(rng, 1, "klmnopqrstuvw") + prose(rng, 1, "klmnop")
    rows = [(i, f"{prose(rng, 60)}\nPosted in the news section by {name()} for readers\nShared on day {i}") for i in range(40)]
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = line_dedup.drop_recurring(documents(spark, rows))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"line-gone"}
    assert {r.n_dropped for r in out.collect()} == {2} == {r.n_dropped for r in out.collect()}


def test_line_dedup_edges(spark):
    rows = [(*r, "x") for r in edge_rows()]
    out = line_dedup.drop_recurring(documents(spark, rows, "doc_id long, text string, size string"))
    assert out.columns == ["doc_id", "text", "size", "n_lines", "n_dropped"]
    assert sorted((r.text for r in out.collect()), key=str) == sorted((r[1] for r in rows), key=str)
    assert line_dedup.drop_recurring(documents(spark, rows, "doc_id long, text string, size string").where("false")).count() == 0


# --- 2: HTML extraction -------------------------------------------------------------------------


def page(article, noise="<nav><a>menu</a></nav>", end="<footer>foot</footer>"):
    return f"<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body>{noise}{article}{end}</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (page("<article><h1>T &amp; t</h1><p>a  b<br>c<p>d&nbsp;&#233;</article>"), "T & t\n\na b c\n\nd é"),
        (page("<article><p>x</p><aside>s</aside><div class='share-box'>share</div><form>f</form><!-- c --><p>y <b>z</b>!</p></article>"), "x\n\ny z!"),
        (page("<main><p>m</p></main><section id='comments'><article class='comment'><p>c</p></article></section>"), "m"),
        (page("<div class='with-sidebar'><article><p>in</p></article></div><div class=sidebar>out</div>"), "in"),
        (page("<div>plain</div>"), "plain"),
        ("just text", "just text"),
        ("<p>unclosed <a href='x", "unclosed <a href='x"),
        ("", ""),
        (None, ""),
    ],
)
def test_html_single_pages(spark, html, want):
    df = spark.createDataFrame([(1, "https://h/a", html)], "page_id long, url string, html string")
    r = html_text.extract(df).first()
    assert (r.text, r.n_chars) == (want, len(want))


def test_html_site_frame_is_learned(spark):
    rng = random.Random(SEED)
    rows, want = [], {}
    for i in range(40):
        body = [prose(rng, 20) for _ in range(3)]
        html = f"<body><div class=q1><span>Welcome to our house</span></div><div class=q2><p>{'</p><p>'.join(body)}</p></div><div class=q3>All of it is ours</div></body>"
        rows.append((i, f"https://h/{i}", html))
        want[i] = "\n\n".join(body)
    rows += [(100 + i, "https://other/x", rows[0][2]) for i in range(3)]  # too few pages to tell
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: out[i] for i in range(40)} == want and out[100].startswith("Welcome")


def test_html_article_keeps_blocks_that_many_pages_hold(spark):
    rng = random.Random(SEED)
    rows, want = [], {}
    for i in range(60):
        body = [prose(rng, 20), *(["the same paragraph in most articles"] if i % 3 else []), prose(rng, 20)]
        rows.append((i, "https://h/x", page(f"<article><p>{'</p><p>'.join(body)}</p></article>")))
        want[i] = "\n\n".join(body)
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == want


def test_html_names_inside_an_article(spark):
    rng = random.Random(SEED)
    rows, want = [], {}
    for i in range(30):
        own = [prose(rng, 12) for _ in range(3)]
        html = page(f"<article><p>We share the <span class='related'>related</span> {own[0]}</p><div class='notice-of-award'>{own[1]}</div><div class='share'>tell {prose(rng, 1)}</div><p>{own[2]}</p></article>")
        rows.append((i, "https://h/x" if i < 25 else f"https://h{i}/x", html))
        want[i] = f"We share the related {own[0]}\n\n{own[1]}\n\n{own[2]}"
    rows.append((99, "https://h/deep", "<div>" * 3000 + "deep" + "</div>" * 3000))
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == want | {99: "deep"}


def test_html_importance_is_the_entropy_of_shared_nodes(spark):
    """Importances of one host's nodes against a count by hand."""
    import math

    pages = [f"<div class=a><p>same</p></div><div class=b><p>{'twice' if i < 2 else 'own' + str(i)}</p></div>" for i in range(8)]
    roots = [html_text.parse(p) for p in pages]
    held = [html_text.nodes_of(r) for r in roots]
    low = {n: 1 - math.log(k) / math.log(8) for n in set().union(*held) if (k := sum(n in h for h in held)) > 1}
    value = html_text.importances(roots[0], low)
    a, b = (x for x in roots[0].holds)
    same, twice = 0.0, 1 - math.log(2) / math.log(8)
    leaf = lambda content: (1 - html_text.DAMP) * 0 + html_text.DAMP * content  # noqa: E731  (all pages share the presentation)
    assert value[id(a)] == pytest.approx(leaf(leaf(same))) and value[id(b)] == pytest.approx(leaf(leaf(twice)))
    assert html_text.main_blocks(roots[5], low) == ["own5"]


def test_html_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old", 7), (1, "u", "<p>x</p>", "old", 7)], "page_id long, url string, html string, text string, n_chars int")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and [(r.text, r.n_chars) for r in out.collect()] == [("x", 1)] * 2
    assert html_text.extract(df.where("false")).count() == 0


def test_html_copies_keep_their_text(spark):
    html = page("<article><p>the same words on every page</p></article>")
    rows = [(i, None if i % 2 else "https://h/x", html) for i in range(20)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in out.collect()} == {"the same words on every page"} and out.count() == 20


# --- 3: language ID -----------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(SEED)
    rows = [(i, prose(rng, 30, "abcdef" if i % 2 else "uvwxyzéü"), "aa" if i % 2 else "zz", "s", 1) for i in range(200)]
    rows += [(1000, None, "aa", "s", 1), (1001, "12 !?", "aa", "s", 1), (None, "abc fed", None, None, None), (1002, "A" * 3_000_000, "aa", "s", 1), (1003, "", None, "s", 1)]
    df = documents(spark, rows, DOCS)
    out = {r.doc_id: r for r in lang_id.identify(df, dim=512).collect()}
    assert len(out) == len(rows)
    assert all(out[i].lang_pred == rows[i][2] for i in range(200) if out[i].held_out)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(200))
    assert [out[i].lang_pred for i in (1000, 1001, 1003, 1002)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = {r.doc_id for r in lang_id.keep_known(df.withColumn("score", F.lit("own"))).collect()}
    assert kept == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}


def test_language_rejects_what_was_not_learned(spark):
    rng = random.Random(SEED)
    rows = [(i, prose(rng, 60, "bcdaei" if i % 2 else "rstouéü"), "aa" if i % 2 else "zz", "s", 1) for i in range(200)]
    scripts = ["αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыьэюя", "אבגדהוזחטיכלמנסעפצקרשת", "abcdefghijklmnopqrstuvwxyz"]
    rows += [(1000 + i, prose(rng, (5, 40, 400)[i % 3], scripts[i % 4]), None, "s", 1) for i in range(120)]
    kept = {r.doc_id for r in lang_id.keep_known(documents(spark, rows, DOCS)).collect()}
    assert kept == set(range(200))


def test_language_without_labels(spark):
    df = documents(spark, [(1, "abc", None, "s", 3), (2, None, "en", "s", 0)], DOCS)
    assert {r.lang_pred for r in lang_id.identify(df).collect()} == {"und"}
    assert [r.doc_id for r in lang_id.keep_known(df).collect()] == [1]
    assert lang_id.identify(df.where("false")).count() == 0


def test_counts_do_not_depend_on_windows(monkeypatch):
    text = prose(random.Random(SEED), 400) + "  é!!"
    whole = dict(zip(*map(np.ndarray.tolist, lang_id.Encoder(64).counts(text)), strict=True))
    monkeypatch.setattr(lang_id, "_WINDOW", 37)
    assert dict(zip(*map(np.ndarray.tolist, lang_id.Encoder(64).counts(text)), strict=True)) == whole


# --- 4: n-gram Jaccard join ---------------------------------------------------------------------


def brute_components(rows, n, percent):
    def grams(t):
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [(k, grams(t)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets}


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1024), (5, 80, 4), (2, 60, 1024)])
def test_jaccard_join(spark, n, percent, block):
    rng = random.Random(SEED)
    rows = []
    for base in range(14):
        words = prose(rng, rng.choice([1, 2, 4, 6, 10, 13, 17, 20, 30, 60, 130, 300])).split()
        for _ in range(rng.randint(1, 12)):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w) + 1)
                w[at : at + 1] = rng.choice([[], ["zz"], [*w[at : at + 1], prose(rng, 1)]])
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(documents(spark, rows), n, percent, block=block).collect()}
    assert got == brute_components(rows, n, percent)


def test_fragments_of_linked_sets_always_meet():
    rng = np.random.default_rng(SEED)
    for percent in (80, 90):
        for size in [*range(1, 60), 100, 257, 600]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                away = int(size * (100 - percent) / percent)
                gone = rng.integers(0, away + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, away - gone, dtype=np.uint64))))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    assert len(np.intersect1d(ngram_join.fragment_keys(a, percent), ngram_join.fragment_keys(b, percent)))


def test_pairs_are_counted_in_rounds_that_exchange_a_share_of_the_sets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS", 2)
    rng = np.random.default_rng(SEED)
    core = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    held = {i: np.unique(np.concatenate((core[rng.random(400) < rng.choice([0.9, 0.97])], rng.integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2)))) for i in range(25)}
    held[25] = np.array([1], np.uint64)
    asked = [(a, b, False) for a in held for b in held if a < b]
    share = lambda a, b: (both := len(np.intersect1d(held[a], held[b]))) * 100 >= 80 * (len(held[a]) + len(held[b]) - both)
    want = {(a, b) for a, b, _ in asked if share(a, b)}
    sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in held.items()], "cls long, grams binary")
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    links = ngram_join._counted(spark.createDataFrame(asked, "a long, b long, hot boolean"), sets, 80, len(asked))
    assert {(r.a, r.b) for r in links.collect()} == want and 0 < len(want) < len(asked)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"ngram-links"}

    where = spark.createDataFrame([(i, list(range(i % 3 + 1))) for i in held], "cls long, buckets array<int>")
    rounds = [range(at, at + ngram_join.PARTS // ngram_join.ROUNDS) for at in range(0, ngram_join.PARTS, ngram_join.PARTS // ngram_join.ROUNDS)]
    sent = [ngram_join._pieces(sets, where, r).agg(F.sum(F.octet_length("grams"))).first()[0] for r in rounds]
    assert sum(sent) == sum(8 * len(x) * (i % 3 + 1) for i, x in held.items()) and max(sent) < 0.35 * sum(sent)


def test_jaccard_edges(spark):
    rows = [(*r, 1) for r in edge_rows()]
    out = ngram_join.ngram_jaccard_join(documents(spark, rows, "doc_id long, text string, n int"), 3, 90).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == [1, 2, 3, 4, 5, 5, 4, 8, None]
    kept = ngram_join.keep_one(documents(spark, rows, "doc_id long, text string, n int"))
    assert kept.columns == ["doc_id", "text", "n"] and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "8", "None"]
    assert ngram_join.keep_one(documents(spark, rows, "doc_id long, text string, n int").where("false")).count() == 0


# --- 5: SentencePiece ---------------------------------------------------------------------------


def test_sentence_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(SEED)
    letters = "aabbcde tthesrion.,  \n1é日🙂▁-=_/\\<>0x"
    texts = ["", " ", "a", "日本語 🙂🙂", "<s> </s> <0x41> <unk>", "▁▁x ▁y", "aaaaaaaa bbbb ", "\x00\x7f", "x" * 5000, "ab" * 4000, "   x  \n y"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(500)]
    df = documents(spark, [(i, t) for i, t in enumerate(texts)] + [(9999, None)])
    out = {r.doc_id: (np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in sentence_pieces.encode_column(df, path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert out[i] == (ids, lib.decode(ids)), t
    assert out[9999] == ([1, 2], "")


# --- 6: vantage-point trees ---------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(SEED)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # many copies of one vector
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None] * 4), (2400, [float("inf")] * 8), (2500, []), (2600, [1.0, 2.0]), (None, rows[0][1]), rows[5]]
    out = {}
    for r in vector_search.nearest(documents(spark, rows, "vec_id long, embedding array<float>"), shard=200).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = {k: np.array(v, np.float64) for k, v in rows if k is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    assert sorted(out) == sorted(k for k in fine if k % 100 == 0)
    for q, found in out.items():
        d = sorted((float(np.sqrt(np.cumsum((fine[q] - v) ** 2)[-1])), k) for k, v in fine.items() if k != q)[:10]
        assert sorted(found) == [(i + 1, k, pytest.approx(s, abs=0)) for i, (s, k) in enumerate(d)]


def test_vectors_at_one_distance_and_none_at_all(spark):
    x = np.eye(1536)
    tree = vector_search.VantageTree(x, np.arange(1536))
    found, d = tree.search(x[:3], np.arange(3), 4)
    assert found.tolist() == [[1, 2, 3, 4], [0, 2, 3, 4], [0, 1, 3, 4]] and np.allclose(d, 2**0.5)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, rank int, score double")
    assert vector_search.nearest(empty).count() == 0
    far = [(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1.0, 1.0])]  # distances overflow, candidates stay
    out = vector_search.nearest(spark.createDataFrame(far, "vec_id long, embedding array<double>"), every=1).collect()
    assert sorted((r.query_id, r.vec_id) for r in out) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_relaxed_search_keeps_recall():
    rng = np.random.default_rng(SEED)
    x, ids = rng.normal(size=(3000, 4)), np.arange(3000)
    tree = vector_search.VantageTree(x, ids)
    exact, _ = tree.search(x[:50], ids[:50], 10)
    near, _ = tree.search(x[:50], ids[:50], 10, relax=1.5)
    assert np.mean([len(np.intersect1d(a, b)) / 10 for a, b in zip(exact, near, strict=True)]) >= 0.9
    few, d = vector_search.VantageTree(x[:3], ids[:3]).search(x[:1], ids[:1], 10)
    assert np.isfinite(d[0]).sum() == 2 and set(few[0][:2]) == {1, 2}


# --- 7: packing ---------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib, rng = Tokenizer.from_file(path), random.Random(SEED)
    texts = [prose(rng, rng.choice([1, 5, 50, 200, 900])) for _ in range(150)] + ["", "naïve “q” 日本 <|endoftext|> x", " a\t\n b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "k")]
    out = packing.pack_documents(documents(spark, rows), path, length=256).toPandas()
    seen = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.dropna().itertuples()}
    for i, t in rows[:-1]:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want = [len(ids) % 256 or 256] if len(ids) > 256 else [len(ids)]
        want += [256] * ((len(ids) - want[0]) // 256)
        start = 0
        for p, n in enumerate(want):
            assert seen[i, p] == (start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))
            start += n
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 256 and (s["offset"] == s["length"].cumsum() - s["length"]).all()
    assert out.sequence_id.nunique() <= -(-out["length"].sum() // 256) * 1.02 + 1


def test_packing_rounds(spark):
    rng = random.Random(SEED)
    pieces = spark.createDataFrame([(i, rng.choice([3, 40, 90, 100])) for i in range(900)], "item long, length long")
    out = packing.pack(pieces, 100, slack=0, group=40).toPandas()
    assert len(out) == 900 and sorted(out["item"]) == list(range(900))
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 100 and (s["offset"] == s["length"].cumsum() - s["length"]).all()
    assert packing.pack(pieces.where("false"), 100).count() == 0


def test_packing_ends_where_pieces_dont_combine(spark, monkeypatch):
    """No two of these fit together: the rounds end instead of gathering everything in one group."""
    held, rounds = [], packing._round
    monkeypatch.setattr(packing, "_round", lambda items, length, number: held.append(items.groupBy("g").count().agg(F.max("count")).first()[0]) or rounds(items, length, number))
    sizes = [600 + i * 7 % 400 for i in range(4000)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "item long, length long").withColumn("sequence", F.lit("kept")).withColumn("fill", F.lit(1))
    out = packing.pack(pieces, 1024, group=200).toPandas()
    assert len(held) == 1 and max(held) < 300
    assert out["sequence_id"].nunique() == 4000 and set(out["offset"]) == {0} and set(out["sequence"]) == {"kept"}
    # with small ones among them later rounds still join what groups left
    held.clear()
    sizes += [20 + i % 300 for i in range(4000)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    out = packing.pack(pieces, 1024, group=200).toPandas()
    assert max(held) < 300 and len(held) > 1
    fills = out.groupby("sequence_id")["length"].sum()
    _, _, best = packing.best_fit(np.array(sizes), 1024)
    assert (fills <= 1024).all() and len(fills) <= 1.02 * len(best)



# --- 9: substring dedup -------------------------------------------------------------------------


def brute_passages(rows, window):
    """(key, text) in corpus order to (words, removed, kept words)."""
    seen, out = set(), {}
    for k, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone[i : i + window] = [True] * window
            seen.add(g)
        out[k] = (len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y))
    return out


@pytest.mark.parametrize("window", [3, 8, 20])
def test_passages(spark, window):
    rng = random.Random(SEED)
    shared = [prose(rng, window + k).split() for k in (0, 1, 5, 30)]
    rows = []
    for i in range(80):
        w = prose(rng, rng.choice([2, 10, 60])).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(shared)
        if rng.random() < 0.15:
            w = ["ab"] * 60
        rows.append((i, rng.choice([" ", " \n", "\t"]).join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    out = substring_dedup.drop_repeats(documents(spark, rows), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, b" ".join(r.text.encode().split())) for r in out} == brute_passages(rows, window)


def test_groups_that_do_not_fit_are_dealt_by_longer_prefixes(spark):
    rng = random.Random(SEED)
    start = prose(rng, 8)
    rows = [(i, f"{start} {prose(rng, i % 5)} {start} {prose(rng, 30, 'ab')}") for i in range(60)] + [(100 + i, f"{prose(rng, 9)} {start} same {prose(random.Random(i % 7), 30)}") for i in range(60)]
    found = substring_dedup.repeats(documents(spark, rows), 20, fit=20)
    starts = {r.rk: sorted(n for x in r.starts for n in np.frombuffer(bytes(x), np.uint32).tolist()) for r in found.collect()}
    keys = {r.doc_id: r.rk for r in documents(spark, rows).select("doc_id", substring_dedup.row_key().alias("rk")).collect()}
    seen = set()
    for k, t in rows:
        w = t.split()
        at = [i for i in range(len(w) - 19) if tuple(w[i : i + 20]) in seen or seen.add(tuple(w[i : i + 20]))]
        assert starts.get(keys[k], []) == at
    assert substring_dedup.depths(20) == [8, 12, 16, 20] and substring_dedup.depths(3) == [3]
    a, b, c = (np.array(x) for x in ([1, 1, 1, 2], [5, 5, 6, 6], [9, 9, 9, 9]))
    assert substring_dedup.met_at([a, b, c]).tolist() == [0, 3, 1, 0]


def test_passages_edges(spark):
    rows = [(*r, 5) for r in edge_rows()]
    out = substring_dedup.drop_repeats(documents(spark, rows, "doc_id long, text string, rk int")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(out) == len(rows) and by[1][0].text is None and by[2][0].text == ""
    assert by[5][0].n_removed == 0 and [r.n_removed for r in by[6]] == [30_000] * 2
    assert all(r.rk == 5 for r in out) and by[3][0].text == " \t\n "
    assert substring_dedup.drop_repeats(documents(spark, rows, "doc_id long, text string, rk int").where("false")).count() == 0


def test_cut_keeps_separators():
    text = "  a b\tc\n\nd e f \n"
    assert substring_dedup.cut_words(text, np.array([1]), 2) == ("  a\n\nd e f \n", 6, 2)
    assert substring_dedup.cut_words(text, np.array([0]), 2) == ("c\n\nd e f \n", 6, 2)
    assert substring_dedup.cut_words(text, None, 3) == ("", 6, 6)


# --- 10: licence scan ---------------------------------------------------------------------------


def test_license_scan(spark):
    rng = random.Random(SEED)
    names = sorted(license_scan.TEMPLATES)
    rows, want = [], set()
    for i, name in enumerate(names * 3):
        w = license_scan.TEMPLATES[name].split()
        if i >= len(names) * 2 and len(w) > 40:
            w[len(w) // 2] = "changed"  # still 0.8 of the shingles
        at = rng.randint(0, 300)
        rows.append((i, f"{prose(rng, at)}\n{' '.join(w)}\n{prose(rng, 200)}"))
        want.add((i, name))
    rows += [(5000, "licensed to nobody"), (5001, None), (5002, "")]
    out = license_scan.scan(documents(spark, rows)).collect()
    assert want <= {(r.doc_id, r.license) for r in out}
    exact = {}
    for k, t in rows:
        words = license_scan.words_of(t or "")
        for name, text in license_scan.TEMPLATES.items():
            need, n = set(license_scan.shingle_list(license_scan.words_of(text))), license_scan.class_of(len(license_scan.words_of(text)))
            for s in range(0, len(words), n):
                share = len(need & set(license_scan.shingle_list(words[s : s + 2 * n]))) / len(need)
                if share >= license_scan.LEAST:
                    exact[k, name] = max(exact.get((k, name), 0), round(share, 6))
    assert {(r.doc_id, r.license): r.containment for r in out} == exact
    assert license_scan.scan(documents(spark, rows).where("false")).count() == 0


def test_cues_cover_every_template():
    cues = set(license_scan.cue_words(license_scan.TEMPLATES))
    for text in license_scan.TEMPLATES.values():
        some = [set(s.split()) for s in license_scan.shingle_list(license_scan.words_of(text))]
        assert sum(bool(s & cues) for s in some) > (1 - license_scan.LEAST) * len(some)


# --- clashing names -----------------------------------------------------------------------------


def test_columns_with_the_new_names_are_replaced(spark):
    rows = [(1, "one two three", "aa", "old", 7), (1, "one two three", "aa", "old", 7), (2, None, None, "old", 7)]

    def run(f, a, b, drop=()):
        df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {a} string, {b} int")
        out = f(df)
        assert sorted(out.columns) == sorted([*(c for c in df.columns if c not in drop and c not in (a, b)), a, b, *(c for c in out.columns if c not in df.columns)])
        assert out.count() == 3 and out.where(F.col(a).cast("string") == "old").count() == 0 and f(df.where("false")).count() == 0
        return out

    run(lambda d: lang_id.predict(d, lang_id.train(d)), "lang_pred", "score")
    run(lambda d: sentence_pieces.encode_column(d, tokenizer_path("piece_bpe_32k.model")), "decoded", "ids", ("text",))
    run(webp.media_columns, "feature", "width", ("text",))
    run(lambda d: line_dedup.drop_recurring(d), "n_lines", "n_dropped")
    run(lambda d: substring_dedup.drop_repeats(d, 3), "n_words", "n_removed")


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(SEED)
    passage = prose(rng, 70)
    texts = {i: prose(rng, 120) for i in range(30)}
    rows = [(i, t, "aa", "s", len(t)) for i, t in texts.items()]
    rows += [(40, texts[0], "aa", "s", 1), (41, texts[1] + " extra", "aa", "s", 1), (42, "12345 !!", "aa", "s", 8), (43, None, "aa", "s", None)]
    rows += [(50 + i, f"{prose(rng, 80)} {passage} {prose(rng, 80)}", "aa", "s", 1) for i in range(3)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        docs = common.stage(step(spark, docs, str(tmp_path)), "test")
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert ids("language_id") == {r[0] for r in rows} - {42, 43} == ids("line_dedup")
    assert ids("ngram_jaccard") == ids("line_dedup") - {40, 41}
    kept = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    assert passage in kept[50].text and passage not in kept[51].text and passage not in kept[52].text
    assert all(kept[i].text == texts[i] for i in texts) and all(r.n_chars == len(r.text) for r in kept.values() if r.doc_id >= 50)
    assert {r.doc_id for r in seen["best_fit_packing"].collect()} == set(kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["best_fit_packing"].count()
