import time

from packetlens.llm import html

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
    "<article><h1>A &amp; B</h1><p><b>First   one.<br><p>Second &lt;b&gt;\n here, and a good deal longer than the first.</p><ul><li>x item<li>y item</ul></article>"
    "<section class='comments'><div class='comment'><p>Nice read, thank you!</p></div></section><form><label>Mail</label></form><footer>&copy; me</footer>"
)


def test_page():
    assert html.main_blocks(PAGE) == ["A & B", "First one.", "Second <b> here, and a good deal longer than the first.", "x item", "y item"]


def test_generated_pages_held_out():
    right = total = 0
    for page in html.labelled_pages(150, seed=77):
        nodes = html.model().parsed(page)
        for x, p in zip(nodes, html.model().marginals(nodes)):
            if x.tag == "#":
                total += 1
                right += (p > 0.5) == bool(x.label)
    assert right / total > 0.94


def test_marginals_are_exact():
    import itertools
    import math

    m = html.model()
    nodes = m.parsed("<div class='content box zzz'><h2>Title</h2><div><p>Some text here.</p></div><div class='ad content'>Buy</div></div><p>End</p>")
    own = [[0.0, 0.0] for _ in nodes]
    own[0][0] = -20.0
    for x, o in zip(nodes[1:], own[1:]):
        for e in html.evidence(x) + html.above(nodes, x):
            a, b = m.own.get(e, (0.0, 0.0))
            o[0], o[1] = o[0] + a, o[1] + b
    total, ones = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(own[i][y[i]] for i in range(len(nodes)))
        score += sum(m.pair[x.kind, x.place][y[x.parent]][y[i]] for i, x in enumerate(nodes) if i)
        w = math.exp(score)
        total += w
        for i, v in enumerate(y):
            ones[i] += w * v
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(m.marginals(nodes), ones))


def test_odd_rows(spark):
    pages = [None, "", "   ", "plain words without tags, a whole sentence of them.", "<", "<<<>>>", "<p", "<!-- open", "<script>x", "&amp;&lt;", "<div>" * 8000 + "deep" + "</div>" * 8000, PAGE, PAGE, "<a" + " b='" * 3000]
    df = spark.createDataFrame([(k % 12, f"u{k}", p, "clash", 3) for k, p in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    rows = html.extracted(df).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    by = {r.url: r.text for r in rows}
    assert by["u0"] == by["u1"] == by["u2"] == by["u8"] == "" and by["u11"] == by["u12"] == "\n\n".join(html.main_blocks(PAGE))
    assert html.extracted(df.limit(0)).count() == 0


def test_layouts():
    p, s, t = "<p>Ouwhea the of rend and threlyes of the stor nd of ouble, more words follow here.</p>", "<p>And onesea.</p>", "<h1>Some title here</h1>"
    comments = "<section class='comments'><h2>Comments</h2><p>Nice article, thank you so much for it.</p><p>I do not agree with this at all.</p></section>"
    layouts = [
        f"<article>{t}{p}<aside>Related: other story about things.</aside>{s}</article>",
        f"<article>{t}{p}<div class='ad'>Buy this now, it is great.</div>{s}{comments}</article>",
        f"<article>{t}{p}<form><input name=q><label>Mail</label><p>Subscribe to our letter today.</p></form>{s}</article>{comments}",
        f"<header><a href='/'>Site name</a></header><article><header>{t}</header>{p}{s}<footer>Posted in stuff</footer></article>",
        f"<div class='cookie-banner'><p>We use cookies to make this site better for all of you.</p><button>OK</button></div><main><article>{t}{p}{s}</article></main>",
        f"<div class='layout'><aside class='sidebar'><h3>Popular</h3><ul><li><a href=x>One story</a></li></ul><p>About this site.</p></aside><article>{t}{p}{s}</article></div>",
        f"<nav><a href=/>Home</a></nav><main>{t}{p}{s}</main><footer><p>Copyright 2024 Some Company. All rights reserved.</p></footer>",
        f"<div id='header'>Site</div><div id='content'>{t}{p}{s}</div><div id='sidebar'><p>About this site and its authors.</p></div><div id='footer'>Imprint</div>",
    ]
    for x in layouts:
        assert html.main_blocks(f"<!DOCTYPE html><html><body>{x}</body></html>") == ["Some title here", p[3:-4], "And onesea."], x


P, S, T = "<p>Ouwhea the of rend and threlyes of the stor nd of ouble, more words follow here.</p>", "<p>And onesea.</p>", "<h1>Some title here</h1>"
TEXT = ["Some title here", P[3:-4], "And onesea."]
PAGES = ("<html><body><nav><a href=/>Home</a></nav><article>{}</article><footer>Imprint</footer></body></html>", "<html><body><div id=header>Site</div><main>{}</main><aside class=sidebar><p>About us.</p></aside></body></html>")


def wrapped(x, k, tag="div"):
    return f"<{tag}>" * k + x + f"</{tag}>" * k


def test_nesting_changes_nothing():
    for page in PAGES:
        for k in (0, 1, 2, 5, 12, 50, 400):
            for tag in ("div", "section", "x-part", "div class='col-md-8 mb-0 px-3'", "center"):
                close = tag.split()[0]
                deep = lambda x: f"<{tag}>" * k + x + f"</{close}>" * k  # noqa: B023, E731
                assert html.main_blocks(page.format(T + deep(P) + deep(S))) == TEXT, (k, tag)
                assert html.main_blocks(page.format(deep(T + P + S))) == TEXT, (k, tag)
                assert html.main_blocks(deep(page.format(T + P + S))) == TEXT, (k, tag)


def test_twenty_thousand_levels():
    began = time.monotonic()
    assert html.main_blocks(PAGES[0].format(T + wrapped(P, 20_000) + S)) == TEXT
    assert html.main_blocks(PAGES[0].format(T + "<div>" * 20_000 + P + S)) == TEXT
    assert html.main_blocks(PAGES[0].format(T + wrapped(P, 20_000, "b") + S)) == TEXT
    assert html.main_blocks(PAGES[0].format(T + "</div></p></b>" * 20_000 + P + S)) == TEXT
    html.main_blocks(PAGES[0].format(T + "<div class='content post'><ul><li>" * 20_000 + P + S))
    assert time.monotonic() - began < 30


def test_unclosed_and_transparent_elements():
    for page in PAGES:
        for odd in ("<button>", "<select>", "<button type=submit class='btn'>", "<textarea>", "<iframe src=x>", "<svg>", "<template>", "<select name=s><option value=1>"):
            assert html.main_blocks(page.format(T + P + odd + S)) == TEXT, odd
        assert html.main_blocks(page.format(T + P + "<button>OK</button><select><option>One<option>Two</select><svg><text>x</text></svg><script>a</script><style>b</style>" + S)) == TEXT
        for tag in ("math", "object", "button", "noscript", "canvas"):
            assert html.main_blocks(page.format(T + P.replace("rend", f"<{tag}>rend</{tag}>") + S)) == TEXT, tag
        for tag in ("noscript", "object", "div", "x-y"):
            assert html.main_blocks(page.format(T + P + f"<{tag}>{S}</{tag}>")) == TEXT, tag


def test_quotes_in_tags():
    assert html.main_blocks(PAGES[0].format(T + P.replace("<p>", "<p title='a > b' data-x=\"it's > 1\" y='" + ">" * 50 + "'>") + S)) == TEXT
    assert html.main_blocks(PAGES[0].format(T + P + S.replace("<p>", "<p title=\"never closed>"))) == TEXT
    assert html.main_blocks(PAGES[0].format(T + P.replace("<p>", "<p it's>") + S)) == TEXT


def test_many_marks_above():
    """Words that the model does not know, however many, hide none that it knows."""
    noise = lambda k: " ".join(f"u{chr(97 + j)}{chr(97 + k % 26)}x" for j in range(20))
    inner = "<p>Nice article, thank you so much for it, it was a pleasure to read.</p>"
    for k in range(12):
        inner = f"<div class='{noise(k)}'>{inner}</div>"
    assert html.main_blocks(PAGES[0].format(T + P + S + f"<section class='comments {noise(3)}'>{inner}</section>")) == TEXT
