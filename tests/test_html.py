from pagelake.operators import nodes as N
from pagelake.operators import shell as SH

def page(body, title="Harbour log", head=""):
    return f"<!doctype html><html><head><title>{title}</title>{head}</head><body>{body}</body></html>"


PROSE = ["Boats left the north pier at dawn and came back with the tide, their holds full of mackerel and their crews soaked through.",
         "By noon the market hall was loud with bidding, and the last crates went to a cook who wanted them for a wedding.",
         "In the evening the keeper wrote the day's catch into the ledger, as every keeper before had done since the pier was built."]
LONG_SCRIPT = "<script>var routes = [" + ",".join(f"'/pier/{i}'" for i in range(60)) + "];</script>"

STATIC = page("<main><article><h1>Day at the pier</h1>" + "".join(f"<p>{p}</p>" for p in PROSE) + "</article></main>")
BOOT_SHELL = page('<div id="app">Loading</div><noscript>Turn JavaScript on: this app needs it.</noscript><script src="/b.js"></script>', head=LONG_SCRIPT)
NEXT_SHELL = page('<div id="root"></div>', head='<script id="__NEXT_DATA__" type="application/json">{"page":"/pier"}</script>' + LONG_SCRIPT)
SHORT = page("<main><h1>Gone</h1><p>No such berth in this harbour.</p></main>")
LOADING = page("<div><h1>Tide tables for every harbour of the coast</h1><p>" + PROSE[0] + "</p><p>" + PROSE[1]
               + "</p><h2>Loading ...</h2><p>Please enable JavaScript.</p></div><script src='/t.js'></script>")
NOSCRIPT_SHELL = page('<div id="app"></div><noscript>' + "".join(f"<p>{p}</p>" for p in PROSE) + "<p>JavaScript is off.</p></noscript>")

BROKEN = """<html><head><title> Salt &amp; Rope </title><script>var t="</p>";</script></head>
<body><nav><a href="/a">A</a><a href="mailto:x@y.z">m</a><a href="#top">t</a></nav>
<div class="content main"><p><b>bold<p>two <a href="../up?x=1">up</a></div>
<ul><li>one<li>two</ul></body></html>"""


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_verdicts(spark):
    cases = [(1, STATIC, "static"), (2, BOOT_SHELL, "likely_shell"), (3, NEXT_SHELL, "likely_shell"),
             (4, SHORT, "ambiguous"), (5, LOADING, "likely_shell"), (6, NOSCRIPT_SHELL, "likely_shell")]
    pages = _pages(spark, [(i, f"https://ex.com/{i}", h) for i, h, _ in cases])
    nodes = N.html_nodes(pages)
    got = {r.page_id: r.js_detection for r in SH.js_shell(nodes, pages).collect()}
    assert got == {i: w for i, _, w in cases}


def test_user_marker(spark):
    html = "<html><body><div data-my-shell>hi</div></body></html>"
    pages = _pages(spark, [(1, "https://ex.com/", html)])
    nodes = N.html_nodes(pages)
    assert SH.js_shell(nodes, pages).first().js_detection == "ambiguous"
    assert SH.js_shell(nodes, pages, ["  DATA-MY-SHELL ", " "]).first().js_detection == "likely_shell"


def test_tree_title_links_selectors(spark):
    pages = _pages(spark, [(7, "https://ex.com/dir/page", BROKEN)])
    nodes = N.html_nodes(pages).cache()
    assert N.page_title(nodes).first().title == "Salt & Rope"
    links = [(r.link_pos, r.link) for r in N.page_links(nodes, pages).orderBy("link_pos").collect()]
    assert links == [(1, "https://ex.com/a"), (2, "https://ex.com/up?x=1")]
    # the script's "</p>" does not end anything; <p> closes the open <p>; <li> closes <li>
    text_of = lambda tag: [r.text for r in N.element_text(nodes, nodes.filter(f"tag = '{tag}'")).orderBy("node_id").collect()]
    assert text_of("p") == ["bold", "two up"]
    assert text_of("li") == ["one", "two"]
    sel = [r.tag for r in N.select_nodes(nodes, "div.content p, nav a[href]").orderBy("node_id").collect()]
    assert sel == ["a", "a", "a", "p", "p"]
    assert N.select_nodes(nodes, ".main.content").count() == 1
    assert N.select_nodes(nodes, "ul li").count() == 2
    nodes.unpersist()


def table(rows, attrs=""):
    return f"<table {attrs}>" + "".join("<tr>" + "".join(r) + "</tr>" for r in rows) + "</table>"


def td(text, tag="td", **spans):
    return f"<{tag}{''.join(f' {k}={v}' for k, v in spans.items())}>{text}</{tag}>"


CATCH = table([[td("Boat", "th"), td("Fish", "th"), td("Crates", "th")], [td("Gull"), td("cod"), td("12")], [td("Tern"), td("ling"), td("7")]])
SPANS = table([[td("Berth", "th"), td("Summer", "th"), td("Winter", "th")], [td("A", rowspan=2), td("closed", colspan=2)], [td("9 kr"), td("4 kr")]])
LINES = table([[td("Key"), td("Value")], [td("hours"), td("from dawn<br>to dusk")], [td("a|b"), td("bar")]])
LAYOUT = table([[td("left"), td("right")], [td("below"), td("beside")]], "role=presentation")


def test_tables(spark):
    from pagelake.operators import extract as X
    from pagelake.plans import composite as CP
    pages = _pages(spark, [(1, "https://pier.test/catch", page(f"<nav>menu</nav><main><article><h1>Catch</h1><p>{PROSE[0]}</p>{CATCH}</article></main>"))])
    md = X.refine_pages(pages, N.html_nodes(pages)).first().markdown
    assert "|Boat|Fish|Crates|\n|---|---|---|\n|Gull|cod|12|\n|Tern|ling|7|" in md, md
    big = table([[td(f"r{r}", colspan=99999, rowspan=88888)] for r in range(3)])
    pages = _pages(spark, [(2 ** 45, "u", SPANS), (3, "u", LINES), (4, "u", LAYOUT), (5, "u", big)])
    got = {r.page_id: r.markdown for r in CP.extract_html(pages, "table").collect()}
    assert "|Berth|Summer|Winter|\n|---|---|---|\n|A|closed||\n||9 kr|4 kr|" in got[2 ** 45], got
    assert "|Key|Value|\n|---|---|\n|hours|from dawn  <br />to dusk|\n|a\\|b|bar|" in got[3], got[3]
    assert "---" not in got[4] and all(w in got[4] for w in ("left", "right", "below", "beside"))
    assert got[5].startswith("|r0|")
    miss = CP.extract_html(pages.filter("page_id = 3"), "#nothing").first()
    assert miss.error_kind == "not_found"


def test_markdown_of_lists_code_and_quotes(spark):
    from pagelake.operators import extract as X
    cases = {
        "<ol><li>cast off<li>row<li>tie up</ol>": "1. cast off\n2. row\n3. tie up",
        "<ol start=4><li>four</li></ol><ul><li>dot</li></ul>": "4. four\n\n- dot",
        "<pre><code>a = 1\nb = `2`</code></pre>": "```\na = 1\nb = `2`\n```",
        "<p>use <code>tide()</code></p>": "use `tide()`",
        "<blockquote><p>one</p><p>two</p></blockquote><p>after</p>": "> one\n>\n> two\n\nafter",
    }
    pages = _pages(spark, [(i, "u", page(h)) for i, h in enumerate(cases)])
    got = {r.page_id: r.markdown for r in X.to_markdown(N.html_nodes(pages)).collect()}
    for i, want in enumerate(cases.values()):
        clean = "\n".join(line.rstrip() for line in got[i].split("\n"))
        assert clean == want, (clean, want)


def test_main_content_is_not_the_wrapper(spark):
    from pagelake.operators import extract as X
    banner = "<div>We use cookies, " + "and more cookies, " * 8 + "as <a href='/c'>told here</a>.</div>"
    pages = _pages(spark, [(1, "u", page(f"<div>{banner}<article>{''.join(f'<p>{p}</p>' for p in PROSE)}</article></div>"))])
    nodes = N.html_nodes(pages)
    best = X.main_content(nodes).first()
    assert nodes.where(f"node_id = {best.node_id}").first().tag == "article"


def test_selectors(spark):
    html = page("<div class='x' data-k='a b'><p id=p1>1</p><section><p title='u v, w'>2</p></section></div><div><p>3</p></div>"
                "<a href='https://a.test/z.pdf'>4</a><a href='/rel'>5</a>")
    nodes = N.html_nodes(_pages(spark, [(1, "u", html)])).cache()
    wants = {"p": 3, "div > p": 2, "div p": 3, ".x > section > p": 1, "a[href^='https:']": 1, "a[href$=\".pdf\"]": 1, "a[href*=el]": 1,
             "[data-k~=b]": 1, "p[title='u v, w'], #p1": 2, "div.x p": 2, "section>p[title]": 1, "body > p": 0}
    assert {q: N.select_nodes(nodes, q).count() for q in wants} == wants
    for bad in ("", "> p", "p >", "p,,a", "a[href", "p > > a", "p + ~ a", ":not(p", "p:hover", "p:nth-child(x)", "a,", ":not(a b)", "#", "p a:"):
        try:
            N.select_nodes(nodes, bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    nodes.unpersist()


RESULTS = """<html><body><div class="results">
<div class="result results_links"><h2 class="result__title"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx&rut=1">First <b>hit</b></a></h2>
<a class="result__snippet">Snippet one</a></div>
<div class="result"><h2 class="result__title"><a class="result__a" href="">No link</a></h2></div>
<div class="result"><h2 class="result__title"><a class="result__a" href="https://b.example/">Second</a></h2>
<div class="result__snippet"> Snippet two </div></div>
<div class="result"><h2 class="result__title"><a class="result__a" href="https://c.example/">Third</a></h2></div>
</div></body></html>"""


def test_result_page_rows(spark):
    from pagelake.sources.result_pages import result_page_rows
    pages = _pages(spark, [(9, "https://duckduckgo.com/html/?q=x", RESULTS)])
    nodes = N.html_nodes(pages)
    got = [(r.rank, r.title, r.url, r.description) for r in result_page_rows(nodes, 2).orderBy("rank").collect()]
    assert got == [(1, "First hit", "https://a.example/x", "Snippet one"), (2, "Second", "https://b.example/", "Snippet two")]


def _brute_verdict(html):
    """Per-page reference formulation of the shell verdict (plain Python over
    one parsed page), to check the relational aggregation on real pages."""
    import re
    rows = N.parse_html(html)
    text = {r[0]: "".join(x[6] for x in rows[r[0] + 1:r[2] + 1] if x[4] == "#text") for r in rows}
    norm = lambda s: " ".join(re.split(r"[\t\n\x0b\x0c\r \x85\xa0  -     　]+", s)).strip()
    vis, meaningful, script, noscript_js = [], 0, 0, False
    body = None
    for r in rows:
        tag = r[4]
        t = text.get(r[0], "")
        if tag in SH.VISIBLE_TAGS:
            nt = norm(t)
            if nt:
                vis.append(nt)
                if tag in SH.MEANINGFUL_TAGS and len(nt.encode()) > 20:
                    meaningful += 1
        if tag == "script":
            script += len(t.encode())
        if tag == "noscript" and "javascript" in t.lower():
            noscript_js = True
        if tag == "body" and body is None:
            body = t
    if body is None:
        def above(r):
            while r[1] >= 0:
                r = rows[r[1]]
                yield r[4]

        body = "".join(r[6] for r in rows if r[4] == "#text" and not {"head", "body"} & set(above(r)))
    v = " ".join(vis)
    vb = len(v.encode())
    low = html.lower()
    req = lambda s: any(p in s for p in SH.JS_PHRASES)
    denom = max(vb, 1)
    if vb >= 200:
        if "loading" in v.lower() and req(v.lower()):
            return "likely_shell"
        if script > denom * 8 and any(m in low for m in SH.CLIENT_RENDER_MARKERS):
            return "likely_shell"
        return "static"
    if meaningful > 2:
        return "ambiguous"
    if noscript_js or req(body.lower()) or any(m in low for m in SH.SPA_MARKERS) \
            or any(m in low for m in SH.APP_SHELL_MARKERS) or script > denom * 3:
        return "likely_shell"
    return "ambiguous"


def test_verdicts_equal_brute_force_on_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    extra = [(1000 + i, f"https://ex.com/{i}", h) for i, h in enumerate([STATIC, BOOT_SHELL, NEXT_SHELL, SHORT, LOADING, NOSCRIPT_SHELL])]
    pages = pages.unionByName(_pages(spark, extra))
    got = {r.page_id: r.js_detection for r in SH.js_shell(N.html_nodes(pages), pages).collect()}
    want = {r.page_id: _brute_verdict(r.html) for r in pages.collect()}
    assert got == want


def test_unclosed_elements_cost_no_more_than_others(spark):
    """100,000 open elements: the stack is whole, rows carry nothing that grows
    with depth, and every fold gets through."""
    import time

    from pagelake.operators import extract as X
    html = "<html><body>" + "<div><i>" * 50_000 + "deep text" + "</b>" * 1000 + "</div>" * 10 + "<p>after"
    pages = _pages(spark, [(1, "u", html)])
    started = time.time()
    nodes = N.html_nodes(pages).cache()
    r = nodes.selectExpr("count(*) n", "max(depth) d", "max_by(data, node_id) t").first()
    assert (r.n, r.d, r.t) == (100_005, 100_002, "after")
    p = nodes.where("tag = 'p'").first()
    assert p.depth == 2 + 2 * (50_000 - 10) and nodes.where(f"node_id = {p.parent_id}").first().tag == "i"
    assert X.to_markdown(nodes).first().markdown == "_deep text_\n\n_after_"
    assert N.select_nodes(nodes, "div > i > p").count() == 1
    assert SH.js_shell(nodes, pages).first().vis_bytes == 5
    assert time.time() - started < 60
    nodes.unpersist()


def test_script_below_hundreds_of_open_elements_stays_out(spark):
    from pagelake.operators import extract as X
    html = page("<font>" * 520 + f"<p>{PROSE[0]} {PROSE[1]}</p><script>var hidden = 1;</script><p>{PROSE[2]}</p>")
    pages = _pages(spark, [(1, "u", html)])
    nodes = N.html_nodes(pages)
    verdict = SH.js_shell(nodes, pages).first()
    assert verdict.js_detection == "static" and verdict.vis_bytes == len(" ".join(PROSE))
    assert X.to_markdown(nodes).first().markdown == f"{PROSE[0]} {PROSE[1]}\n\n{PROSE[2]}"


def test_phrases_across_blocks_and_nested_text(spark):
    """Signals off running sums equal those off the text written out."""
    import random
    rng = random.Random(4)
    words = ["Loading", "enable", "Java", "Script", "javascript", "is", "required", "x\u00a0y", "", " ", "\u2003", "\u00e9\u00e9", "and"]
    rows = []
    for i in range(60):
        body, openers = "", ["<p>", "<div>", "<li>", "<b>", "</p>", "</div>", "<h2>", "</h2>", "<section>", "</section>", "<td>", "<blockquote>", "</blockquote>"]
        for _ in range(rng.randrange(40)):
            body += rng.choice(openers) + rng.choice(words) + rng.choice(["", " ", "\n"]) + rng.choice(words)
        rows.append((i, "u", page(body) if i % 3 else body))
    pages = _pages(spark, rows)
    got = {r.page_id: r.js_detection for r in SH.js_shell(N.html_nodes(pages), pages).collect()}
    assert got == {i: _brute_verdict(h) for i, _, h in rows}
    for i, _, h in rows:
        p = N.page_of(N.parse_html(h))
        vis = [t for k, g in enumerate(p.tag) if g in SH.VISIBLE_TAGS and (t := _norm(p.text(k)))]
        seen = SH.signals(p)
        text = " ".join(vis)
        assert seen[0] == len(text.encode())
        assert seen[1] == sum(1 for k, g in enumerate(p.tag) if g in SH.MEANINGFUL_TAGS and len(_norm(p.text(k)).encode()) > 20)
        assert seen[5] == ("loading" in text.lower() and any(x in text.lower() for x in SH.JS_PHRASES)), text


def _norm(s):
    import re
    from pagelake.operators.markdown import WS
    return re.sub(f"^[{WS}]+|[{WS}]+$", "", re.sub(f"[{WS}]+", " ", s))


def test_folds_refuse_pages_in_pieces(spark):
    import pytest
    from pagelake.operators import extract as X
    pages = _pages(spark, [(i, "u", page("<p>a</p><p>b</p>")) for i in range(20)])
    nodes = N.html_nodes(pages).cache()
    whole = sorted(X.to_markdown(nodes).collect())
    for broken in (nodes.where("node_id <> 3"), nodes.repartition(7, "node_id"), N.html_nodes(pages, keep=["p"])):
        with pytest.raises(Exception, match="in_page_order"):
            X.to_markdown(broken).collect()
    assert sorted(X.to_markdown(N.in_page_order(nodes.repartition(7, "node_id"))).collect()) == whole
    nodes.unpersist()


def test_selectors_of_every_kind(spark):
    html = ("<div id=d class='a b'><p class=x>1</p><p>2</p><span>s</span><p lang=en-GB data-v='q r'>3</p><ul><li>i</li><li>j<b></b></li><li>k</li></ul></div>"
            "<section data-kind=news><h2>h</h2><p>4</p><p>5</p><div><p>6</p></div></section>")
    wants = {"p + p": 2, "p ~ p": 3, "h2 + p": 1, "span ~ p": 1, "p:first-child": 2, "p:not(.x)": 5, "li:nth-child(2)": 1, "li:nth-child(odd)": 2,
             "li:nth-child(2n)": 1, "li:nth-child(-n+2)": 2, "li:last-child": 1, "li:nth-last-child(2)": 1, "p:only-child": 1, "p:first-of-type": 3,
             "p:last-of-type": 3, "p:nth-of-type(2)": 2, "[data-kind] p": 3, "[data-kind=news] > p": 2, "section[data-kind^=ne] div > p": 1,
             "div:not(#d) p": 1, "p[lang|=en]": 1, "p[data-v~=r]": 1, ":is(h2, span)": 2, "b:empty": 1, "*": 16, "div.a.b > p ~ ul li + li": 2,
             "#d p:not(:first-child):not([lang])": 1, "li:not(:first-child, :last-child)": 1, "section > :nth-child(3)": 1, "span:only-of-type": 1}
    nodes = N.html_nodes(_pages(spark, [(1, "u", html)])).cache()
    got = {r.selector: r.n for r in N.select_many(nodes, {q: q for q in wants}).groupBy("selector").count().withColumnRenamed("count", "n").collect()}
    assert got == wants
    one = {q: N.select_nodes(nodes, q).count() for q in ("p ~ p", "li:nth-child(odd)", "[data-kind] p")}
    assert one == {q: wants[q] for q in one}
    nodes.unpersist()


def test_markdown_of_blocks_in_blocks(spark):
    from pagelake.operators import extract as X
    cases = {
        "<ol><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ol><p>e</p>": "1. a\n   - b\n   - c\n2. d\n\ne",
        "<pre>def f():\n    if x:\n\n\n        return 1\n</pre>": "```\ndef f():\n    if x:\n\n\n        return 1\n```",
        "<blockquote>q<pre>x\n\n\n  y</pre></blockquote>z": "> q\n>\n> ```\n> x\n>\n>\n>   y\n> ```\n\nz",
        "<p>a<b> bold </b>c</p>": "a **bold** c",
        "x<b>a</b><b>b</b> <i> q </i>,<b> </b>": "x**ab** _q_ ,",
        "<table><tr><td>x<a href=/l>link</a> <b>b</b><td><table><tr><td>in<td>ner</table></table>": "|x[link](/l) **b**|in ner|\n|---|---|",
        "<a href=/x><h3>T</h3><p>par</p></a>": "### [T](/x)\n\n[par](/x)",
        "<ul><li><p>one</p><p>two</p></li><li>three<pre>c\n d</pre></li></ul>": "- one\n\n  two\n\n- three\n\n  ```\n  c\n   d\n  ```",
        "<blockquote><ul><li>a<blockquote>deep</blockquote></li></ul></blockquote>": "> - a\n>\n>   > deep",
        "<pre><code class='language-go'>x := `a`\n```\n</code></pre>": "````go\nx := `a`\n```\n````",
        "<code>a`b</code>": "``a`b``",
        "<table><caption>Cap</caption><tr><td>k</td></tr><tr><td>a<p>p2</p></td></tr></table>": "|k|\n|---|\n|a<br /><br />p2|\n\nCap",
        "<table><tr><td rowspan=0>k</td><td>1</td></tr><tr><td>2</td></tr><tr><td>3</td></tr></table>": "|k|1|\n|---|---|\n||2|\n||3|",
        "<ul><li></li><li>x</li></ul><dl><dt>t<dd>d</dl>": "- x\n\nt\n\nd",
    }
    pages = _pages(spark, [(i, "u", page(h)) for i, h in enumerate(cases)])
    got = {r.page_id: r.markdown for r in X.to_markdown(N.html_nodes(pages)).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_an_article_split_over_sections_is_whole(spark):
    from pagelake.operators import extract as X
    html = page(f"<div class=sidebar><p>{PROSE[1]}</p></div><div id=content><section><h2>One</h2><p>{PROSE[0]}</p><p>{PROSE[1]}</p></section>"
                f"<section><h2>Two</h2><p>{PROSE[2]}</p><p>{PROSE[0]}</p></section></div><div><p><a href=/x>{PROSE[2]}</a></p></div>")
    pages = _pages(spark, [(1, "u", html)])
    md = X.refine_pages(pages, N.html_nodes(pages)).first().markdown
    assert md == f"## One\n\n{PROSE[0]}\n\n{PROSE[1]}\n\n## Two\n\n{PROSE[2]}\n\n{PROSE[0]}"
    split = page("<div class=wide>" + "".join(f"<div class=part><h2>{i}</h2><p>{PROSE[i]}</p><p>{PROSE[i]} {PROSE[0]}, {PROSE[1]}</p></div>" for i in (0, 1)) + "</div>")
    pages = _pages(spark, [(1, "u", split)])
    md = X.refine_pages(pages, N.html_nodes(pages)).first().markdown
    assert "## 0" in md and "## 1" in md
    empty = _pages(spark, [(1, "u", ""), (2, "u", None), (3, "u", page("")), (4, "u", page("<p>short</p>"))])
    assert {r.page_id: r.markdown for r in X.refine_pages(empty, N.html_nodes(empty)).collect()} == {1: "", 2: "", 3: "", 4: "short"}


def test_a_fold_of_parsed_pages_makes_no_node_rows(spark):
    from pagelake.operators import extract as X
    pages = _pages(spark, [(i, "", h) for i, h in enumerate([STATIC, BROKEN, "", None, LOADING, "<p>a<table><td>1"])]).repartition(2)
    nodes = N.html_nodes(pages)
    once = X.to_markdown(nodes)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    stored = X.to_markdown(N.in_page_order(N.html_nodes(pages)))
    assert stored._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    got = sorted(map(tuple, once.collect()))
    assert got == sorted(map(tuple, stored.collect())) and [i for i, _ in got] == [0, 1, 4, 5]


def test_plain_tokens_are_those_of_the_library():
    for h in (STATIC, BROKEN, BOOT_SHELL, "<!-- c --><p a=1 A='2' b>x &amp; y<a href=/x/>z</a ><br>", "<style>a&amp;</style>", "<script>a</p></script>", "<p a='x>y'>", "a < b", "<b", "<title>a&lt;"):
        b = N._TreeBuilder()
        b.feed(h)
        b.finish()
        assert N.parse_html(h) == b.rows, h
    assert N._plain_tokens(STATIC) and N._plain_tokens(BOOT_SHELL) and N._plain_tokens("a < b") is None
