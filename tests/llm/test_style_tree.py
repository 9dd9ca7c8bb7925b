import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freqloom.llm.style_tree import ANNOUNCED, DECAY, FEW_WORDS, INNER, LEAST_REPEAT, LIMIT, NEUTRAL, NO_MEASURE, OUTER, WHOLE, Page, distinct_pages, extract, importance, judged, page_blocks, parse, signed

PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>site <b>head</b></header><nav><ul><li>a<li>b</ul></nav><!-- x --><div class="ad">buy</div><div class="cookie-notice">cookies</div>
<article class="post with-comments-open"><header><h1>The  title &amp;
more</h1></header><p>first <b>para<br>graph<p>second&nbsp;<i>one</i> &lt;tag&gt; &#233; &am<ul><li>x<li>y</ul>
<form><input>name</form><aside>side</aside><div id="comments"><p>reader says</p></div><table><tr><td>c1<td>c2</table>tail</article>
<footer>&copy; foot</footer></body>"""
SCHEMA = "page_id long, url string, html string"


def text(html):
    return "\n".join(b.text for b in page_blocks(html))


def test_article_page():
    assert text(PAGE) == "The title & more\nfirst para graph\nsecond one <tag> é &am\nx\ny\nc1\nc2\ntail"


def test_odd_pages():
    assert text("") == "" and text("plain & simple") == "plain & simple"
    assert text("<p>a</p></div></b><p>b") == "a\nb"
    assert text("<nav>m<p>n</nav>k") == "k"
    assert text("<div>x<script>if (a</b>) y</script>z</div>") == "xz"
    assert text("<article></article><p>outside</p>") == "outside"
    assert text("<main><p>in</p></main><p>out</p>") == "in"
    assert text("<article class='comment'>hi</article><div>real</div>") == "real"
    assert text("<div hidden>a</div><div role='navigation'>b</div><DIV CLASS='Footer'>c</DIV><P>d") == "d"
    assert text("<title>t</title><p>y") == "y" and text("<html><head><title>t</title><body><p>y") == "y"
    assert text("<head><meta charset=x><title>t</title><p>y<p style='display: none'>z") == "y"
    assert text("<html><head></head><body><div class='layout-with-sidebar'><p>y</div>") == "y"
    assert text("<style>never closed") == "" and text("<a <b>c") is not None
    assert text("<main><article><p>one story</p></article><article><p>two story</p></article><article><p>six story</p></article><article><p>ten story</p></article></main>").count("story") == 4


def test_malformed_declarations():
    assert text("<p>a</p><![foo[ x ]]><p>b</p>") == "a\nb" and text("<p>a</p><![ x><p>b</p>") == "a\nb"
    assert text("<p>a<!-->b") == "ab" and text("<p>a<!--->b") == "ab" and text("<p>a<!-- > --!>b") == "ab"
    assert text("<p>a<!-- never closed <p>b") == "a" and text("<p>a<![CDATA[x]]>b") == "ab" and text("<p>a<!x") == "a"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<!", "<![", "[", "]]>", "--", "<!--", "-->", ">", "<p", "<div ", "a='b", '"', "</", "/>", "<", "&", "&#x", "<script>", "</script>", "x y", "<?", "CDATA[", "<title>", "<svg>", "=", "\n", "\0", "<article>", "if "]) | st.text(max_size=5), max_size=30))
def test_any_markup_is_read(parts):
    page = Page("".join(parts))
    assert all(b.text == " ".join(b.text.split()) for b in page.blocks()) and all(x["held"] > 0 for x in page.tree())


def test_names_that_only_contain_a_word_of_noise():
    page = "<article><p>The long story of it all, told once.</p><section class='related-work'><p>Others did it</p></section><p class='share-price'>It rose</p>{}</article>"
    kept = "The long story of it all, told once.\nOthers did it\nIt rose"
    assert text(page.format("")) == kept
    for noise in ("<article class='comment-body' id='comment-12'><p>I think so too, and it is a long opinion</p></article>", "<div class='related-posts'>more</div>", "<ul class='share-buttons'><li>x</ul>", "<article><p>another teaser</p></article>"):
        assert text(page.format(noise)) == kept
    assert text("<article class='teaser'>Read on</article>" + page.format("") + "<article><a href=x>Another story</a></article>") == kept


@pytest.mark.parametrize("depth", (3000, 60_000))
def test_deep_pages_take_linear_time(depth):
    assert text("<p>" * depth + "deep") == "deep" and text("<div>" * depth + "deep") == "deep"
    page = Page("<div>x" * depth)
    nodes = page.tree()
    assert len(page.texts) == depth and len(nodes) == depth + 1 and max(x["held"] for x in nodes) == depth
    assert len(Page("<div><b>x</i>" * depth + "<p>y").texts) == depth + 1


def prose(n=12):
    return " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(n))


def site(spark, n=30):
    random.seed(1)
    rows = []
    for k in range(n):
        html = f"<div class='top'>Welcome to us</div><div class='body'><p>story {k} {prose()}</p></div><div class='strip'>All rights kept</div>"
        rows.append((k, "http://one.example.com/x", html, "clash", "clash"))
    rows += [(100 + k, "http://two.example.com/x", "<div class='top'>Welcome to us</div>", "clash", "clash") for k in range(3)]
    return spark.createDataFrame(rows, SCHEMA + ", host string, turned string")


def test_branches_that_repeat_over_a_host_are_removed(spark, monkeypatch):
    from freqloom.llm import style_tree

    want = None
    for bound in (20_000, 0):  # by broadcast and by the salted join
        monkeypatch.setattr(style_tree, "BROADCAST_ROWS", bound)
        got = {r.page_id: r.text for r in extract(site(spark)).collect()}
        assert all(got[k].startswith(f"story {k} ") and "\n" not in got[k] for k in range(30))
        assert all(got[100 + k] == "Welcome to us" for k in range(3))  # copies count once: too few pages to tell
        assert want in (None, got)
        want = got


def test_copies_of_a_page_count_once(spark):
    one = spark.createDataFrame([(k, "http://h/x", "<div><p>the same page</p></div>") for k in range(40)], SCHEMA)
    assert {r.text for r in extract(one).collect()} == {"the same page"}


def brute_trees(pages):
    """The recursion and the bound as they are written, over one host's distinct pages: {branch: (name, pages, composites, evidence)}."""
    out = {}
    for root in (0, 1):
        held, styles, words, kids, of, own = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(set), {}, Counter()
        large = set()
        for page in map(Page, sorted(set(pages))):
            if page.keys[0] != root:
                continue
            for x in page.tree():
                held[x["branch"]] += 1
                styles[x["branch"]][x["style"]] += 1
                of[x["branch"]] = x
                own[x["branch"]] += x["own"]
                if x["parent"] is not None:
                    kids[x["parent"]].add(x["branch"])
            said = defaultdict(set)
            for b in page.blocks():
                said[b.branch] |= {re.sub(r"\d+", "0", w) for w in b.text.split(" ")}
            for branch, some in said.items():
                words[branch].update(some)
                large |= {branch} if len(some) > FEW_WORDS else set()
        for branch in large:
            words[branch] = {w: n for w, n in words[branch].items() if signed(xxhash.xxh64_intdigest(w)) < LIMIT}

        def nlogn(counts):
            return sum(n * math.log(n) for n in counts)

        def all_words(b):
            return own[b] + sum(all_words(c) for c in kids[b])

        def composite(b, by):
            m = held[b]
            content = 1.0
            if m > 1 and own[b]:
                n = words[b].values()
                content = 1 - (sum(map(math.log, n)) / len(n) if by == 0 else nlogn(n) / sum(n)) / math.log(m)
            held_in = ((own[b] and own[b] * content) + sum(all_words(c) * composite(c, by) for c in kids[b])) / all_words(b)
            share = 1.0 if set(styles[b]) == {0} else DECAY ** len(styles[b])
            look = 1 - nlogn(styles[b].values()) / m / math.log(m) if m > 1 else 1.0
            return (1 - share) * look + share * held_in

        def below(b):
            return {b}.union(*(below(c) for c in kids[b]))

        if held:
            top = max(own, key=lambda b: (own[b] > 0, of[b]["prior"] > NO_MEASURE, own[b], b))
            around = of[top]["parent"]
            section = below(around) if around is not None and all_words(around) <= WHOLE * sum(own.values()) else below(top)
            both = {b: [composite(b, k) for k in (0, 1)] for b in held}
            for b in held:
                r = max((1 - x) / max(LEAST_REPEAT, 1 - y) for x, y in zip(both[b], both[top]))
                out[b] = of[b]["name"], held[b], both[b], max(-1, min(1, math.log2((INNER if b in section and of[b]["prior"] > NO_MEASURE else OUTER) / r))) if r > 1e-12 else 1.0
    return out


def host_pages(n, seed):
    random.seed(seed)
    out = []
    for k in range(n):
        body = "".join(f"<p>{random.choice(['again', str(random.random())])}</p>" + "<ul><li>a<li>b</ul>" * random.randint(0, 1) for _ in range(random.randint(1, 3)))
        out.append(f"<div class='top'>Hello <b>you</b><div>{k % 3}</div></div><nav><ul><li>{k % 4}<li>x</ul></nav><article><h1>{k}</h1>{body}<p>{prose(random.randint(10, 60))}</p></article>" if k % 5 else f"<div class='top'>Hello</div><section>{body}</section>")
    return out


def test_importance_equals_the_recursion(spark):
    pages = host_pages(23, 4)
    rows = [(k, "http://h/", html) for k, html in enumerate(pages)] + [(99, "http://h/other", pages[0])]
    got = {r.branch: (r.name, r.pages, r.composite, r.composite_page) for r in importance(distinct_pages(parse(spark.createDataFrame(rows, SCHEMA)))).collect()}
    want = brute_trees(pages)
    assert got.keys() == want.keys() and all(got[b][:2] == want[b][:2] and abs(got[b][2] - want[b][2][0]) + abs(got[b][3] - want[b][2][1]) < 1e-8 for b in want)


def test_query_equals_brute_force(spark):
    """The whole operator: the rows of extract() from the recursion above and the bound."""
    pages = {"h": host_pages(40, 5), "i": host_pages(9, 6), "j": host_pages(2, 7)}
    rows = [(n, f"http://{h}/", html) for n, (h, html) in enumerate((h, x) for h, all_pages in pages.items() for x in all_pages)]
    trees, want, turned = {h: brute_trees(x) for h, x in pages.items()}, {}, 0
    for k, url, html in rows:
        tree, kept = trees[url[7:-1]], []
        for b in Page(html).blocks():
            _, m, _, evidence = tree[b.branch]
            stays = b.prior + 8 * m / (m + 8) * evidence >= 0
            turned += stays != (b.prior >= 0)
            kept += [b.text] if stays else []
        want[k] = "\n".join(kept)
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want and turned


def test_the_tree_judges_pages_with_articles(spark):
    random.seed(2)
    rows = []
    for k in range(30):
        html = f"<article class='teaser'><p>Read our magazine</p></article><div class='story'><p>main {k} {prose()}</p></div><div class='strip'>All rights kept</div>"
        rows.append((k, "http://one.example.com/x", html))
        html = f"<article><p>story {k} {prose()}</p><p class='end'>Thank you for your visit</p></article><div class='strip'>All rights kept</div>"
        rows.append((100 + k, "http://two.example.com/x", html))
    rows.append((200, "http://three.example.com/x", "<article><p>in</p></article><p>out</p>"))  # too few pages to tell
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].startswith(f"main {k} ") and "\n" not in got[k] for k in range(30))
    assert all(got[100 + k].startswith(f"story {k} ") and "\n" not in got[100 + k] for k in range(30))
    assert got[200] == "in"


def test_announced_noise_goes_even_where_it_varies(spark):
    said = [prose() for _ in range(60)]
    rows = [(k, "http://h/", f"<nav>menu {prose()}</nav><p>text {k} of {said[k]}</p><div class='comments'>I say {prose(30)}</div>") for k in range(60)]
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {k: f"text {k} of {said[k]}" for k in range(60)}
    tree = judged(importance(distinct_pages(parse(spark.createDataFrame(rows, SCHEMA))))).where(F.col("prior") < ANNOUNCED + 3)
    assert {(r.name, r.stays) for r in tree.collect()} == {("nav", False), ("div.comments", False)}


def test_named_adverts_in_the_article_go_though_they_vary(spark):
    random.seed(11)
    rows = [(k, "http://h/", f"<article><p>{prose(60)}</p><div class='related-posts'>{prose(8)}</div><div class='ad'>{prose(8)}</div></article>") for k in range(200)]
    assert not any("\n" in r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect())


def test_an_advert_that_varies_goes_by_its_words(spark):
    """Beside the article, of a class that says nothing, with a number or a word of its own on each page."""
    random.seed(9)
    for slot in (str, lambda k: prose(1)):
        rows = [(k, "http://h/", f"<article><p>{prose(60)} and the story of the day</p></article><div class='x2'><p>Buy cheap thing {slot(k)} now</p></div>") for k in range(200)]
        assert not any("Buy" in r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect())


def test_without_names_the_tree_finds_the_noise(spark):
    """On the test pages, with the prior of every branch taken away: nine tenths of the noise go and no content does."""
    tree = judged(importance(distinct_pages(parse(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))))).collect()
    gone = lambda r: r.pages / (r.pages + 8) * r.evidence < 0
    noise = [gone(r) for r in tree if r.prior < -NEUTRAL and r.pages > 1]
    assert len(noise) > 100 and sum(noise) >= 0.9 * len(noise) and not any(gone(r) for r in tree if r.prior >= 0)


def test_awkward_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>x"), (2, "http://h", ""), (2, "http://h", ""), (3, "http://h", "<p>" + "word " * 200_000)]
    got = extract(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("page", "branch", "salt", "nodes", "id", "text")})).collect()
    assert len(got) == 5 and {r.page_id: r.text for r in got}[None] == "x" and max(len(r.text) for r in got) == 999_999
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0
