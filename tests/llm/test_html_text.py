import random
import time

import pytest
from pyspark.sql import functions as F

from logsieve.llm import html_text


def text_of(html, starts=()):
    return html_text.kept_text(html_text.blocks_of(html), list(starts))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<p>a<p>b<br>c</p>d", "a\n\nb c\n\nd"),
        ("<title>t</title><body><nav><a>n</a></nav><article><h1>H &amp; &lt;x&gt; &eacute;&#233;&nbsp;y</h1><p><b>one<br><p>two\n  three</p></article><footer>f</footer>", "H & <x> éé y\n\none\n\ntwo three"),
        ("<article><p>a</p><!-- <p>x</p> --><script>var t='</p>';</script><style>p{}</style><p>b</p></article>", "a\n\nb"),
        ("<main><p>a</p><div class='ad-box'>x</div><div id=comments><article>c</article></div><form>f</form><aside>s</aside><p>b</p></main>", "a\n\nb"),
        ("<header>h</header><article><header><h1>T</h1></header><p>x < y and 1<2</p></article>", "T\n\nx < y and 1<2"),
        ("<article><p title='a>b'>kept</p><div hidden>x</div><div style='display: none'>x</div><ul><li>i<li>j</ul></article>", "kept\n\ni\n\nj"),
        ("<div role=navigation>n</div><div role=main><p>m</p></div>", "m"),
        ("<article><p>never closed <b>bold", "never closed bold"),
        ("<article><p>a</p></div></section><p>b</p></article><p class=cookie-notice>c</p>", "a\n\nb"),
        ("<script>unclosed", ""),
        ("<!-- unclosed <p>x</p>", ""),
        ("<p>&bogus; &#xZZ; &copy;</p>", "&bogus; &#xZZ; ©"),
    ],
)
def test_blocks(html, text):
    assert text_of(html) == text


def site(k):
    share = "<div>Share this fine story with all of your friends today</div>"
    return f"<body>{share}<div>Story number {k} tells of thing{k} and place{k} and time{k} at length here, with word{k} upon word{k}a.</div>"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")


def test_repeated_runs_of_a_host_go(spark):
    rows = [(k, f"http://Host.example/{k}", site(k)) for k in range(4)] + [(9, "http://other.example/", site(9))]
    found = {r.page_id: r.text for r in html_text.main_text(pages_of(spark, rows)).collect()}
    assert "Share this" in found[9]
    for k in range(4):
        assert found[k].startswith(f"Story number {k} tells") and "Share" not in found[k]


def test_copies_are_no_boilerplate(spark):
    rows = [(k, f"http://a.example/{k}", site(1)) for k in range(5)]
    assert all("Story number 1" in r.text and "Share" in r.text for r in html_text.main_text(pages_of(spark, rows)).collect())


def test_article_text_stays_however_often_it_comes(spark):
    line = "Released under the terms of a licence that everyone repeats"
    rows = [(k, "http://a.example/", f"<article><p>own{k}</p><p>{line}</p></article><footer>{line}</footer>") for k in range(5)]
    assert all(r.text == f"own{r.page_id}\n\n{line}" for r in html_text.main_text(pages_of(spark, rows)).collect())


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, "", "<p>x</p>"), (1, "", "<p>x</p>"), (2, "http://h/", "<article>" + "<p>w é</p>" * 20_000 + "</article>")]
    found = html_text.main_text(pages_of(spark, rows)).collect()
    assert sorted(r.n_chars for r in found) == [0, 0, 1, 1, 20_000 * 3 + 19_999 * 2]
    assert html_text.main_text(pages_of(spark, rows).limit(0)).collect() == []


def test_names_inside_an_article_do_not_cut_its_text():
    html = (
        "<article><h2 id='related-work'>Related work</h2><p>text</p><section id='social-history'><p>whole section</p></section>"
        "<p class='notice-period'>clause</p><p><label>kept?</label> rest</p><ul class='comment-list'><li>first!</li></ul></article>"
    )
    assert text_of(html) == "Related work\n\ntext\n\nwhole section\n\nclause\n\nkept? rest"


def test_hinted_blocks_go_where_the_host_repeats_them(spark):
    def page(k):
        related = f"<div class='related-posts'><p>{'read our ten most popular stories of the year' if k < 6 else 'a story of its own, told once'}</p></div>"
        return f"<article><p>own text {k}</p>{related}</article>"

    rows = [(k, "http://a.example/", page(k)) for k in range(8)]
    found = {r.page_id: r.text for r in html_text.main_text(pages_of(spark, rows)).collect()}
    assert found[0] == "own text 0" and found[6] == "own text 6\n\na story of its own, told once"


def plain(pages):
    """Texts of pages without any role or name, by comparing all stretches of RUN tokens of one host."""
    run, streams = html_text.RUN, {}
    for page, (host, paragraphs) in pages.items():
        tokens = [""]
        for p in paragraphs:
            tokens += [*p.split(), ""]
        streams[page] = host, tokens
    holders = {}
    for host, tokens in streams.values():
        for i in range(len(tokens) - run + 1):
            holders.setdefault((host, *tokens[i : i + run]), set()).add(tuple(tokens))
    out = {}
    for page, (host, tokens) in streams.items():
        hit = [i for i in range(len(tokens) - run + 1) if len(holders[host, *tokens[i : i + run]]) >= html_text.LEAST_PAGES]
        covered = {i + j for i in hit for j in range(run)}
        kept, own, at = [], 0, 1
        for p in pages[page][1]:
            places = range(at, at + len(p.split()))
            inside = {i + j for i in hit if i >= at and i + run <= at + len(places) for j in range(run)}
            gone = set(places) if covered.issuperset(places) else inside
            own += len(places) - len(gone)
            kept.append(" ".join(tokens[i] for i in places if i not in gone))
            at += len(places) + 1
        out[page] = "\n\n".join(pages[page][1] if own < run else [k for k in kept if k])
    return out


def test_unmarked_sites_equal_brute_force(spark):
    rng = random.Random(4)
    stock = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(14)]
    pages = {}
    for k in range(60):
        paragraphs = [rng.choice(stock) if rng.random() < 0.6 else " ".join(rng.choice("ijkl") + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 15))) for _ in range(rng.randint(1, 9))]
        pages[k] = f"h{k % 3}.example", paragraphs
    pages[60] = pages[0]
    rows = [(k, f"http://{host}/", "".join(f"<p>{p}</p>" for p in ps)) for k, (host, ps) in pages.items()]
    found = {r.page_id: r.text for r in html_text.main_text(pages_of(spark, rows)).collect()}
    expected = plain(pages)
    assert found == expected
    assert any(len(t) < len("\n\n".join(pages[k][1])) for k, t in expected.items())


def test_stretches_of_articles_stay_on_unmarked_pages(spark):
    line = "Released under the terms of a licence that everyone repeats"
    share = "Share this fine story with all of your friends today"
    own = "told in word{0} and in term{0} and in tale{0} alone".format
    marked = [(k, "http://a.example/", f"<article><p>{own(k)}</p><p>{line}</p></article><footer>{share}</footer>") for k in range(3)]
    bare = [(k, "http://a.example/", f"<p>{own(k)}</p><p>{line}</p><div>{share}</div>") for k in range(3, 6)]
    found = {r.page_id: r.text for r in html_text.main_text(pages_of(spark, marked + bare)).collect()}
    assert found == {k: f"{own(k)}\n\n{line}" for k in range(6)}
    # a fourth page has the line outside its article: it is more often there
    found = {r.page_id: r.text for r in html_text.main_text(pages_of(spark, [*marked, *bare, (6, "http://a.example/", f"<article>x</article><footer>{line}</footer>")])).collect()}
    assert found == {k: own(k) if k in (3, 4, 5) else f"{own(k)}\n\n{line}" if k < 3 else "x" for k in range(7)}


def longest(streams, run, least):
    """(page, at): (length, own) of the longest stretch of run, 2 run, 4 run, ... tokens, by counting all of them."""
    out, length = {}, run
    while True:
        holders = {}
        for (page, content, article), tokens in streams.items():
            for i in range(len(tokens) - length + 1):
                holders.setdefault(tuple(tokens[i : i + length]), {}).setdefault(content, []).append((page, i, article))
        found = False
        for contents in holders.values():
            outside = sum(not all(article for *_, article in places) for places in contents.values())
            if outside >= least:
                found = True
                out |= {(page, i): (length, len(contents) - outside >= outside) for places in contents.values() for page, i, article in places if not article}
        if not found:
            return out
        length *= 2


def test_stretches_equal_brute_force(spark):
    rng = random.Random(7)
    stock = [[rng.randint(1, 3) for _ in range(rng.randint(2, 30))] for _ in range(8)]
    streams, rows = {}, []
    for k in range(24):
        page, content, at = b"%d" % k, k // 2 if k < 6 else k, 0
        for article in (False, True):
            random_ = random.Random(content * 2 + article)
            tokens = [t for _ in range(random_.randint(0, 5)) for t in random_.choice([*stock, [random_.randint(4, 99) for _ in range(5)]])]
            streams[page, content, article] = tokens
            rows += [("h", page, content, at + i, t, article) for i, t in enumerate(tokens)]
            at += len(tokens) + 1
    table = spark.createDataFrame(rows, "host string, page binary, content long, at int, token long, article boolean")
    found = {(bytes(r.page), r["at"]): (r.length, r.own) for r in html_text.shared_stretches(table, 3, 3).collect()}
    assert found == longest(streams, 3, 3)
    assert len({length for length, _ in found.values()}) > 2 and len({own for _, own in found.values()}) == 2


def test_short_stories_under_a_long_menu_lose_the_menu(spark):
    menu = "".join(f"<div>entry{i} of this long menu</div>" for i in range(40))
    rows = [(k, "http://a.example/", f"<body>{menu}<p>story{k} is told in word{k} and in term{k} alone</p>") for k in range(5)]
    found = html_text.main_text(pages_of(spark, rows)).collect()
    assert {r.page_id: r.text for r in found} == {k: f"story{k} is told in word{k} and in term{k} alone" for k in range(5)}


def test_versions_of_one_page_stay_whole(spark):
    rows = [(k, "http://a.example/", f"<p>{' '.join(f'w{i}' for i in range(90))} version {k}</p>") for k in range(5)]
    assert all(r.text.startswith("w0 w1") and r.text.endswith(f"version {r.page_id}") for r in html_text.main_text(pages_of(spark, rows)).collect())


def test_unclosed_elements_cost_no_more_than_their_number():
    def seconds(n):
        begin = time.process_time()
        assert len(html_text.blocks_of("<article>" + "<div><i>x</b></span>" * n + "y" + "</td></em>" * n)) == n
        return time.process_time() - begin

    assert seconds(40_000) < 5


def test_columns_of_any_name(spark):
    pages = pages_of(spark, [(1, "http://a/", site(1)), (2, "http://a/", "<article>x</article>")])
    for name in ("page", "host", "open", "content", "kinds", "texts", "_split", "key", "rank", "at", "token"):
        pages = pages.withColumn(name, F.lit("theirs"))
    assert {r.page_id for r in html_text.main_text(pages).collect()} == {1, 2}
