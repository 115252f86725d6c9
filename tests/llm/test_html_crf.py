import itertools
import re
import time

import numpy as np

from quire.llm import html_crf as X


def test_blocks_of_broken_markup():
    page = ("<html><head><title>no</title></head><body><script>if (a<b) '</p>'</script><div class='ad big'>x &lt; y</div>"
            "<p>one <b>two<br>three<p>four\n  five</p>a < b<ul><li><a href=q>l1</a><li>l2</ul><!-- c > --><p title='>'>six &am")
    got = X.blocks(page)
    assert [b.text for b in got] == ["x < y", "one two three", "four five", "a < b", "l1", "l2", "six &am"]
    assert got[0].names == {"ad", "big"} and got[4].linked == 2 and got[4].tags[-1] == "li" and got[2].tags == ("html", "body", "p")


def test_elements_without_end_tag_lose_no_text():
    texts = lambda page: [b.text for b in X.blocks(page)]
    assert texts("<html><head><title>x</title><meta a=b><body><p>one</p><p>two") == ["one", "two"]
    assert texts("<head><title>x</title><script>a</script>text<p>one") == ["text", "one"]
    assert texts("<head><title>x<p>one") == texts("<head><noscript><link></noscript></head><p>one") == ["one"]
    for tag in ("select", "svg", "object", "audio", "video", "noscript", "template", "iframe", "canvas"):
        assert texts(f"<div><{tag} a=b></div><p>one</p><{tag}>no <p>no</{tag}><p>two") == ["one", "two"]
        assert texts(f"<p>one</p><{tag}><p>two") == ["one", "two"]
    assert texts("<p>one</p><script>if (a) '<p>two'") == ["one"]
    assert texts("<p>if <math><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup></math> holds") == ["if a=b2 holds"]
    assert texts("<svg><a href=q></svg><p>one") == ["one"] and X.blocks("<svg><a href=q></svg><p>one")[0].linked == 0


def test_quotes_open_values_only_behind_an_equals_sign():
    texts = lambda page: [b.text for b in X.blocks(page)]
    assert texts("<p title=it's>one</p><p>isn't two</p><p>three</p>") == ["one", "isn't two", "three"]
    assert texts("<p it's>one</p><p \"x>two</p><p a=b\"c>three</p>") == ["one", "two", "three"]
    assert texts("<p a = '>'>one<p a=\"x > y\" b='\"'>two<p a==\"q>three") == ["one", "two", "three"]
    assert X.blocks("<p title=it's class=ad>one</p>")[0].names == {"ad"}


def test_time_follows_the_page():
    n = 100_000
    pages = ["<div class=x>word " * n, "<b>" * n + "<div>a</div>" * n, "<div>" * n + "</section>" * n + "x",
             "<p><table>" + "<i>" * n + "<ul>a</ul>" * n, "<p a='" * n, "<span>" * n + "<p>a" * n]
    start = time.process_time()
    got = [X.blocks(p) for p in pages]
    assert time.process_time() - start < 5 * len(pages)          # the quadratic reading took minutes
    assert [len(b) for b in got][:3] == [n, n, 1] and got[0][0].tags == ("div",) and len(got[0][-1].tags) == n
    start = time.process_time()
    assert len(X.features(got[0])) == n and time.process_time() - start < 3


def test_cues_are_read_in_the_whole_block():
    long = "word " * 200
    with_cue, without = (X.features(X.blocks(f"<p>{long}{t}"))[0] for t in ("\u00a9 2020", "x 2020"))
    assert set(with_cue) - set(without) == {X._slot("cue \u00a9 False")}


def test_viterbi_equals_enumeration():
    rnd = np.random.default_rng(0)
    m = X.Chain(rnd.normal(size=(X.DIMENSION, 2)), rnd.normal(size=(2, 2)) * 2)
    for n in range(1, 9):
        rows = [tuple(rnd.integers(0, X.DIMENSION, 3).tolist()) for _ in range(n)]
        e = [m.emit[list(r)].sum(axis=0) for r in rows]
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: sum(e[i][y[i]] for i in range(n)) + sum(m.move[y[i], y[i + 1]] for i in range(n - 1)))
        assert m.decode(rows) == list(best)


def test_held_out_pages():
    pages = X.labelled_pages(80, seed=99)
    m = X.default_model()
    good = [g == y for p, ys in pages for g, y in zip(m.decode(X.features(X.blocks(p))), ys)]
    assert all(len(X.blocks(p)) == len(y) for p, y in pages) and np.mean(good) > 0.97


def test_table_pages_and_odd_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in X.extract_pages(df).collect()}
    import html
    right = 0
    for r in df.collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r["html"], re.S)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        right += got[r["page_id"]]["text"] == "\n".join(w for w in want if w)
    assert right >= 0.97 * df.count()
    odd = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (2, None, "", "t"), (3, "u", "<p>" + "Long text here. " * 60000, "t"),
                                 (None, "u", "<<<>", "t")], "page_id long, url string, html string, text string")
    rows = X.extract_pages(odd).collect()
    assert len(rows) == 5 and {(r["text"], r["n_chars"]) for r in rows if r["page_id"] in (1, 2)} == {("", 0)}
    assert X.extract_pages(odd.where("false")).count() == 0
