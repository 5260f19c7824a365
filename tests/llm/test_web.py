import html
import re

import pytest

from tiffin.llm import styletree, urls
from tiffin.llm.common import table

PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use</div><nav>a b</nav><div class="sidebar"><p>side</p></div>
<div class="content"><h2>Title</h2><p>One &amp; two &#233; <b>b</b>old<p>three<br>four<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table></div>
<section id="comments"><p>nice post</p></section><form><input> Name</form><footer>c</footer><script>if(a<b){"</p>"}</script></body>"""


def test_marked_furniture_goes():
    assert styletree.main_text(PAGE).split("\n\n") == ["Title", "One & two é bold", "three four", "x", "y", "c1", "c2"]
    page = '<article><header><h1>T</h1></header><div class="ad">buy</div><p>x</p><aside>no</aside><article class="comment">me too</article></article><p>tail</p>'
    assert styletree.main_text(page).split("\n\n") == ["T", "x"]


def test_names_are_no_proof_for_the_wrapper_of_the_article():
    page = '<div class="layout with-sidebar"><div class="sidebar">a b</div><main><h1>T</h1><p>long text here that is more</p></main></div>'
    assert styletree.main_text(page).split("\n\n") == ["T", "long text here that is more"]
    page = '<h1>T</h1><p>x</p><div class="comments"><p>very long comments that dominate the text of the page by far</p></div>'
    assert styletree.main_text(page).split("\n\n") == ["T", "x"]
    assert styletree.main_text('<p>one <button>press</button> two <span class="share">s <b>t</b></span>three</p><label><p>lab</p></label>') == "one two three"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain < text & more", "plain < text & more"), ("<p>a<div>b</div>c<p", "a\n\nb\n\nc"),
                                       ("<p>a&nbsp;\n b", "a b"), ("<!-- <p>x</p> --><p>y", "y"), ("<script>x", ""), ("</p></div>z", "z"),
                                       ("<p title='a>b'>q</p>", "q"), ("<div " * 3, "")])
def test_odd_markup(page, text):
    assert styletree.main_text(page) == text


def test_long_and_deep_pages_are_read_whole():
    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 3000
    assert styletree.main_text(deep) == "in"
    many = "".join(f"<p>word {i}</p>" for i in range(20_000))
    assert styletree.main_text(many).count("\n\n") == 19_999
    styletree.main_text("<" * 20_000)
    styletree.main_text("<a b='" * 5_000)


def site(n=20):
    """Pages without telling names: the template is known by its sameness only."""
    words = lambda i: " ".join(f"w{i * 37 + k}" for k in range(30))
    for i in range(n):
        yield (i, f"http://h.example/{i}", f"<body><div class=x1><p>Home and away</p><p>Our shop sells things</p></div><div class=x2><p>{words(i)}</p><p>{words(i + 1000)}</p></div>"
                  "<div class=x3><span>All about us</span></div></body>", words(i) + "\n\n" + words(i + 1000))


def test_style_tree_removes_unmarked_templates(spark):
    rows = list(site())
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h, _ in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in styletree.extract(df).collect()}
    assert got == {i: (u, t, len(t)) for i, u, _, t in rows}


def test_articles_are_weighed_and_titles_stay():
    cards = "".join(f"<article><h2>Card {i}</h2><p>read more</p></article>" for i in range(3))
    story = "<h1>Storm</h1><p>" + "the storm came over the hills and took the roofs " * 5 + "</p>"
    for page in (f"<div class=content>{story}</div>{cards}", f"<div class=x7>{story}</div>{cards}", f"<div class=content>{story}</div><article><p>one card</p></article>"):
        text = styletree.main_text(page)
        assert text.startswith("Storm\n\nthe storm") and "card" not in text.lower() and "read more" not in text
    assert styletree.main_text(f"<article>{story}</article>{cards}").startswith("Storm\n\nthe storm")
    for head in ("<header class=entry-header><h1>T</h1></header>", "<div class=entry-header><h1>T</h1></div>"):
        assert styletree.main_text(f"<article>{head}<p>x</p><div class=share>s</div></article>").split("\n\n") == ["T", "x"]


STORY = "<h1>Storm</h1><p>" + "the storm came over the hills and took the roofs " * 20 + "</p>"


def test_one_article_is_no_free_pass():
    text = styletree.main_text(f'<div class="wrap">{STORY}</div><article><p>a short teaser</p></article>')
    assert text.startswith("Storm\n\nthe storm") and "teaser" not in text
    assert styletree.main_text("<div><p>one two three four</p></div><article><p>five six seven</p></article>") == "five six seven"


@pytest.mark.parametrize("name", ["share-price", "promo-code-story", "related-work", "menu-items", "header-compression", "search-algorithms"])
def test_names_that_mention_furniture_stay_in_articles(name):
    for part in (f'<p class="{name}">kept words</p>', f'<ul class="{name}"><li>kept words</li></ul>', f'<div id="{name}"><p>kept words</p></div>'):
        for page in (f"<article>{STORY}{part}</article>", f'<div class="content">{STORY}{part}</div>'):
            assert styletree.main_text(page).endswith("\n\nkept words")


@pytest.mark.parametrize("name", ["share", "share-buttons", "reader-comments", "comment-list", "cookie-notice", "ad-300x250", "related-posts", "newsletter-box", "post__share", "x sidebar"])
def test_names_of_furniture_go_from_articles(name):
    assert "gone" not in styletree.main_text(f'<article>{STORY}<div class="{name}"><p>gone words</p></div></article>')


def test_a_hint_needs_links_or_sameness(spark):
    linked = '<div class="related-work"><a href=x>gone words</a> or <a href=y>others</a></div>'
    assert "gone" not in styletree.main_text(f"<article>{STORY}{linked}</article>")
    words = lambda i: " ".join(f"w{i * 37 + k}" for k in range(30))
    pages = lambda host, part: [(len(host) * 100 + i, f"http://{host}/{i}", f"<article><h1>T{i}</h1><p>{words(i)}</p>{part(i)}</article>") for i in range(12)]
    same = pages("a.example", lambda i: f'<div class="share-price"><p>Prices of {("oil", "tea")[i % 2]} today</p></div>')
    new = pages("bb.example", lambda i: f'<div class="share-price"><p>Price of the day {words(i + 500)}</p></div>')
    got = {r["page_id"]: r["text"] for r in styletree.extract(spark.createDataFrame(same + new, "page_id long, url string, html string")).collect()}
    for (i, _, page), (j, _, other) in zip(same, new):
        assert "Prices of" in styletree.main_text(page) and "Prices of" not in got[i] and got[i].count("\n\n") == 1
        assert "Price of the day" in got[j] and got[j] == styletree.main_text(other)


def test_marks_alone_fail_on_every_page_of_a_host_that_the_tree_gets_right():
    for _, _, page, text in site():
        assert styletree.main_text(page) != text and set(text.split("\n\n")) < set(styletree.main_text(page).split("\n\n"))


def test_style_tree_removes_a_notice_inside_articles(spark):
    words = lambda i: " ".join(f"w{i * 37 + k}" for k in range(30))
    rows = [(i, f"http://h.example/{i}", f"<article><h1>Daily news</h1><p>{words(i)}</p><p>All rights kept by us</p><ul><li>{words(i + 500)}</li><li>Write to us</li></ul></article>") for i in range(20)]
    copied = [(100 + i, f"http://copy.example/{i}", f"<article><p>{words(7)}</p><p>w{i}</p></article>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in styletree.extract(spark.createDataFrame(rows + copied, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Daily news\n\n{words(i)}\n\n{words(i + 500)}" for i, *_ in rows} | {100 + i: f"{words(7)}\n\nw{i}" for i in range(20)}


def test_importance_matches_the_formula(spark):
    import math
    rows = [(p, "h", 7, 1 if p < 9 else 2, None) for p in range(12)] + [(p, "h", 7, None, 5) for p in range(12)] + [(p, "h", 7, None, 100 + p) for p in range(12)]
    got = styletree.importance(spark.createDataFrame(rows, "page long, host string, path long, look long, block long")).first()["importance"]
    presentation = -(9 / 12 * math.log(9 / 12) + 3 / 12 * math.log(3 / 12)) / math.log(12)
    content = 1 - (12 * 1 + 12 * 0) / 24
    assert got == pytest.approx((1 - 0.81) * presentation + 0.81 * content)


def test_pages_match_their_articles(spark):
    from tiffin.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in table(spark, sf, "pages").collect()}
    got = QUERIES["op2_style_tree"](spark, sf).collect()
    assert {r["page_id"] for r in got} == set(pages)
    for r in got:
        page = pages[r["page_id"]]
        article = page[page.index("<article>") + 9:page.index("</article>")].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", article)]
        assert r["text"] == "\n\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


def test_page_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "<p>a</p>"), (2, "x", None), (None, "http://h/", "<p>b</p>"), (4, "http://h/", ""), (4, "http://h/", "")],
                               "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in styletree.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "a", 1), (2, "x", "", 0), (None, "http://h/", "b", 1), (4, "http://h/", "", 0), (4, "http://h/", "", 0)], key=str)
    assert styletree.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ URL filter
def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


URLS = ["http://example.com/en/1", "http://www.Example.COM/en/1?x=1", "http://a.www.example.com/en/", "https://x.net/es/a#b", "https://x.net/fr", "https://xnet/fr/",
        "http://com/", "http://com", "no scheme", "", None, "a://b://c/d", "http:///p", "http://notexample.com/en/", "http://É.net/es/\nx", "http://h.org?q=/en/"]


def test_rules_match_brute_force(spark, sf):
    texts = spark.createDataFrame([("cheap pills and thin thread", )], "text string")
    known = list(enumerate(URLS)) + [(100 + r["page_id"], r["url"]) for r in table(spark, sf, "pages").collect()]
    df = spark.createDataFrame([(i, u, "x") for i, u in known], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, texts).collect()}
    assert len(got) == len(known)
    for i, u in known:
        host, path, rule, verdict = brute_rule(u)
        assert got[i][:3] == (host, path, rule) and got[i][3] in (verdict, *(() if verdict else ("allow", "block"))), u


def test_split_matches_all_splits():
    import itertools
    import math
    model = urls.Unigrams.of({"cheap": 50, "pills": 40, "pill": 30, "s": 20, "he": 500, "the": 900, "ap": 3, "c": 10})
    cost = lambda ws: sum(model.cost.get(w, model.unknown * len(w)) for w in ws)
    for run in ("cheappills", "thecheap", "xq", "s", "hecthe"):
        every = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            at = [0] + [i + 1 for i, c in enumerate(cuts) if c] + [len(run)]
            every.append([run[a:b] for a, b in zip(at, at[1:])])
        assert math.isclose(cost(model.split(run)), min(map(cost, every)))
    assert model.split("cheappills") == ["cheap", "pills"]


def test_naive_bayes_matches_brute_force(spark):
    import math
    rules = [("bad.org", "/", "block"), ("good.org", "/", "allow")]
    texts = spark.createDataFrame([("cheap cheap pills win casino bets news daily garden",), (None,), ("cheap news",)], "text string")
    rows = [(0, "http://cheappills.bad.org/win"), (1, "http://casinobets.bad.org/win/2"), (2, "http://dailynews.good.org/garden"), (3, "http://gardennews.good.org/"),
            (4, "http://cheapcasino.net/win"), (5, "http://dailygarden.net/news"), (6, "http://zzz.net/"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(df, texts, rules=rules).collect()}
    words = urls.Unigrams.of({r["word"]: r["n"] for r in urls.count_words(texts).collect()})
    count = {"block": {}, "allow": {}}
    for i, u in rows[:4]:
        host, path, *_ = brute_rule(u)
        for t in urls.tokens(host, path, words):
            c = count["block" if i < 2 else "allow"]
            c[t] = c.get(t, 0) + 1
    v = len(set(count["block"]) | set(count["allow"])) + 1
    tb, ta = (sum(count[k].values()) for k in ("block", "allow"))
    for i, u in rows[4:]:
        host, path, *_ = brute_rule(u)
        odds = sum(math.log((count["block"].get(t, 0) + 1) / (tb + v)) - math.log((count["allow"].get(t, 0) + 1) / (ta + v)) for t in urls.tokens(host, path, words))
        assert got[i]["log_odds"] == pytest.approx(odds, abs=1e-5) and got[i]["verdict"] == ("block" if odds > 0 else "allow")
    assert got[4]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert urls.judge(df.limit(0), texts.limit(0)).count() == 0


def test_rare_and_long_words_split_hosts(spark):
    """Words seen once among 60,000 others, and words of over 20 letters, are known to the model."""
    common = " ".join("".join(chr(97 + i // 26 ** k % 26) for k in range(5)) for i in range(60_000))
    long = "donaudampfschifffahrtsgesellschaft"
    texts = spark.createDataFrame([(common + " " + common,), (f"zebra quilt {long}",), (None,), ("y" * 200,)], "text string")
    hosts = spark.createDataFrame([("zebraquilt.example.org",), (f"zebra{long}.org",), ("",), ("x" * 300 + ".org",)], "host string")
    got = dict(tuple(r) for r in urls.split_hosts(hosts, texts).collect())
    assert got["zebraquilt.example.org"][:2] == ["h:zebra", "h:quilt"]
    assert got[f"zebra{long}.org"] == ["h:zebra", f"h:{long}", "t:org"]
    assert got[""] == [] and got["x" * 300 + ".org"][-1] == "t:org"
    whole = urls.Unigrams.of({r["word"]: r["n"] for r in urls.count_words(texts).collect()})
    assert got == {h: urls.host_tokens(h, whole) for h in got}
