import html as entities
import re
import random

import numpy as np

from skyledger.llm import html


def article(page):
    """The pages of the given tables hold one article of headings and paragraphs."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_given_table(spark, monkeypatch):
    monkeypatch.setattr(html, "GROUP_PAGES", 3)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = html.page_rows(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(got) == len(want)


def test_suffix_array_and_prefixes_equal_sorting():
    rnd = random.Random(8)
    for n in (0, 1, 2, 30, 200):
        t = [rnd.randrange(3) for _ in range(n)]
        order, ranks = html.suffix_array(np.array(t, "int64"))
        want = sorted(range(n), key=lambda i: t[i:])
        assert order.tolist() == want
        lcp = html.common_prefixes(order, ranks)
        for k in range(1, n):
            a, b = t[want[k - 1] :], t[want[k] :]
            assert lcp[k] == next((x for x, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def page(body, n, host="h.example"):
    return (n, f"http://{host}/{n}", body)


def test_template_text_of_the_host_goes_unique_text_stays(frame, monkeypatch):
    chrome = "<div>Welcome to the site of all things we have ever sold to you</div>"
    rows = [page(f"<html><body>{chrome}<div>unique words number {n} of this very page and nothing else {n * 7}</div>{chrome.upper()}</body>", n) for n in range(20)]
    rows.append(page(chrome + "<p>alone</p>", 99, "other.example"))
    want = {n: f"unique words number {n} of this very page and nothing else {n * 7}" for n in range(20)}
    want[99] = "Welcome to the site of all things we have ever sold to you\nalone"
    for size in (1024, 4, 1):
        monkeypatch.setattr(html, "GROUP_PAGES", size)
        for known in (50_000, 0):
            monkeypatch.setattr(html, "KNOWN_HOSTS", known)
            got = {r.page_id: r.text for r in html.main_texts(frame(rows, "page_id long, url string, html string")).collect()}
            assert got == want


def test_markup():
    def text(p):
        return "\n".join(t for k, t in html.blocks_of(p)[0] if k != html._FURN)

    assert text('<nav>a</nav><main><h1>T &amp; U</h1><p>one\n two<br>three<p>four &lt;5&gt; <b>b</b>c</main><footer>f</footer>') == "T & U\none two three\nfour <5> bc"
    assert text('<header>top</header><article><header><h1>Head</h1></header><p>x</p><div class="comments"><p>no</p></div><aside>no</aside></article>') == "Head\nx"
    assert text('<div class="ad">no</div><div id=cookie-notice>no</div><div class="adventure">yes</div><form><p>no</p></form>') == "yes"
    assert text('<script>var t="<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><p title="a>b">yes</p>') == "yes"
    assert text("<p>cut <b") == "cut < b" or text("<p>cut <b") == "cut <b"
    assert text(None) == text("") == "" and text("plain") == "plain"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table>") == "a\nb\nc\nd"
    assert text('<div role="navigation">no</div><section class="sidebar-left">no</section><p>&#233;&eacute;&nbsp;x</p>') == "éé x"


def test_odd_rows(frame):
    rows = [(1, None, None), (1, None, None), (None, "http://a/", "<p>x y</p>"), (3, "not a url", ""), (4, "http://a/", "<article>" + "<p>long text</p>" * 30_000 + "</article>")]
    df = frame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, part int")
    got = sorted([(r.page_id, r.url, r.text, r.n_chars) for r in html.page_rows(df).collect()], key=str)
    long = "\n".join(["long text"] * 30_000)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "http://a/", "x y", 3), (3, "not a url", "", 0), (4, "http://a/", long, len(long))], key=str)
    assert html.page_rows(df.limit(0)).count() == 0


def test_script_and_style_end_at_their_own_end_tag_only():
    def text(p):
        return "\n".join(t for k, t in html.blocks_of(p)[0] if k != html._FURN)

    assert text("<article><p>a</p><script>for(i=0;i<n;i++) { f(i); }</script><p>b</p></article>") == "a\nb"
    assert text("<p>a</p><script>x='<!--';</SCRIPT ><p>b</p><style>p{} <!-- </style><p>c</p>") == "a\nb\nc"
    assert text("<title>x <b</title><p>a</p><script>s='</scripted>'</script>b<p>c</p><script>open") == "a\nb\nc"


def test_wrappers_and_names_inside_an_article():
    def text(p):
        return "\n".join(t for k, t in html.blocks_of(p)[0] if k != html._FURN)

    body = "<article><h2>T</h2><p>one two</p></article>"
    for names in ("layout no-sidebar", "page has-header", "with_sidebar", "headerless", "sidebar-left"):
        assert text(f'<div class="{names}">{body}<p>after</p></div>').startswith("T\none two")
    assert text(f'<div class="sidebar-left">{body}<p>after</p></div>') == "T\none two"
    assert text('<article><section id="search-methods"><p>a</p></section><div class="social-history"><p>b</p></div><h2 id="related">c</h2><section id="comments"><p>no</p></section></article>') == "a\nb\nc"
    gone = '<div class="{}"><article><p>no</p></article><p>no</p></div><p>yes</p>'
    for names in ("comments", "post-comments", "related", "comment-list", "ad-slot", "AdBanner", "newsletterSignup"):
        assert text(gone.format(names)) == "yes"
    for names in ("cookie-notice", "site-header", "side-bar", "x sidebar", "sidebar_2", "top-banner"):
        assert text(f'<div class="{names}"><p>no</p></div><p>yes</p>') == "yes"
    for names in ("adventure", "header-story", "searchable", "foot-notes", "socialist party", "menu-planning"):
        assert text(f'<div class="{names}"><p>yes</p></div>') == "yes"
