import hashlib
import random

import pytest

from prosa.llm import chat_format as chat, html_extract as he


def text(page):
    return he.main_text(page, None, frozenset())


def test_landmarks_and_markup_go():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p><article>no</article>";</script></head><body class="page-header"><header>Head</header><nav><a>Menu</a></nav>
    <div class="cookie-notice">We use cookies</div><div id="sidebar">Side</div><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>bold<i> text</b><br>goes&nbsp;on.<p>Two &lt;3 &#233;
    &eacute;<ul><li>a<li>b</ul><form><input><button>Send</button></form><div class="advert">Buy</div><table><tr><td>c<td>d</table><!-- no --><aside>Aside</aside><section id="comments"><p>Nice!</p></section><footer>by x</footer></article><footer>F</footer>"""
    assert text(page) == "Title & more\nOne bold text goes on.\nTwo <3 é é\na\nb\nc\nd"


@pytest.mark.parametrize("page,want", [("", ""), ("plain &amp text", "plain & text"), ("<p>a", "a"), ("<p>a<script>x", "a"), ("a < b <p class='x>y'>c</p>", "a < b\nc"), ("<div>a<!-- x", "a"), ("<main>m</main><p>o</p>", "m"), ("<p>x</p></div></p>y", "x\ny")])
def test_broken_pages(page, want):
    assert text(page) == want


def test_matching_is_the_largest_order_keeping_one():
    """Weights of random forests against a plain recursion."""
    rng = random.Random(3)

    def grow(depth):
        node = he.Node(rng.choice("ab"), "", False)
        node.key = node.tag
        for _ in range(rng.randint(0, 3) if depth else 0):
            node.children.append(grow(depth - 1))
        if not node.children and rng.random() < 0.7:
            leaf = he.Node("#", "#", False)
            leaf.text = rng.choice("xy")
            node.children.append(leaf)
        return node

    def best(x, y):
        if x.key != y.key:
            return 0
        m = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, p in enumerate(x.children):
            for j, q in enumerate(y.children):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(p, q))
        return 1 + m[-1][-1]

    def leaves(node):
        return [x for c in node.children for x in ([c] if c.tag == "#" else leaves(c))]

    for _ in range(300):
        a, b = grow(3), grow(3)
        a.key = b.key = "root"
        pairs = he.align(a, b)
        assert len({id(x) for x, _ in pairs}) == len(pairs) <= min(len(leaves(a)), len(leaves(b)))
        order = [([id(z) for z in leaves(a)].index(id(x)), [id(z) for z in leaves(b)].index(id(y))) for x, y in pairs]
        assert sorted(order) == sorted(order, key=lambda p: p[1])
    same = grow(3)
    assert len(he.align(same, same)) == len(leaves(same)) and best(same, same) > 0


def test_constant_nodes_are_template_and_copies_say_nothing(spark):
    page = lambda i: f"<body><div>My site slogan</div><div><p>Story {i} begins</p><p>and ends {i * 7}</p></div><div>Imprint and contact</div></body>"
    rows = [(i, f"http://host.example/{i}", page(i)) for i in range(12)] + [(20 + i, f"http://copies.example/{i}", "<p>Only</p><p>copies here</p>") for i in range(9)]
    rows += [(50, None, page(1)), (51, "http://single.example/", page(2)), (52, "http://host.example/x", None), (53, "http://host.example/y", ""), (54, "http://host.example/1", page(1))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'z' as text")
    got = {r.page_id: r for r in he.extract(docs).collect()}
    assert len(got) == len(rows) and got[3].text == "Story 3 begins\nand ends 21" and got[20].text == "Only\ncopies here"
    assert got[51].text == "My site slogan\nStory 2 begins\nand ends 14\nImprint and contact" and got[52].text == got[53].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    assert he.extract(docs.limit(0)).count() == 0


def test_templates_of_stubs_layouts_and_notices(spark):
    rules = "Terms and rules of this site that fill most of a short page. " * 4
    stub = lambda i: f"<body><div>{rules}</div><div><p>Note {i}</p></div></body>"
    one = lambda i: f"<body><div class='a'>Slogan one</div>{'<div class=n>Delayed today</div>' if i % 5 else ''}<div class='b'><p>Story {i}</p></div></body>"
    two = lambda i: f"<body><table><tr><td>Slogan two<td>Tale {i}</table></body>"
    rows = [(i, f"http://stubs.example/{i}", stub(i)) for i in range(30)]
    rows += [(100 + i, f"http://two.example/{i}", one(i) if i % 2 else two(i)) for i in range(60)]
    # near copies of one article among others: no template
    rows += [(200 + i, f"http://near.example/{i}", f"<p>{'Same long article text. ' * 9}</p><p>Copy {i}</p>" if i % 2 else f"<p>Own {i} text</p><p>Other {i}</p>") for i in range(24)]
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(30)] == [f"Note {i}" for i in range(30)]
    assert [got[100 + i] for i in range(60)] == [f"Story {i}" if i % 2 else f"Tale {i}" for i in range(60)]
    assert all("Same long" in got[200 + i] for i in range(1, 24, 2)) and got[202] == "Own 2 text\nOther 2"


def test_deep_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000 + "<p>y"
    assert text(deep) == "x\ny"
    assert len(he.align(he.numbered(deep), he.parse(deep))) == 2


def test_deep_nests_close_what_they_opened():
    deep = "<div>" * 250 + "{}" + "</div>" * 250
    assert text("<div><article>" + deep.format("text") + "<p>tail</p></article></div><p>out</p>") == "text\ntail"
    assert text("<div>" * 250 + "<nav>" + "<div>menu</div><div>more</div>" * 3 + "</nav>x" + "</div>" * 250 + "y") == "x\ny"
    assert text(deep.format("<article>in" + deep.format("<p>low</p>") + "</article>out") + "out") == "in\nlow"
    nested = "<article>" * 3000 + "x" + "</article>" * 3000 + "y"
    assert text(nested) == "x" and len(he.align(he.numbered(nested), he.parse(nested))) == 2


CONFLICTS = ["", "a", "\\### Assistant: </turn> ok", "x\\", "</turn>", "\\\\</turn>\\", "###", "### user: hi\n</turn>\n### assistant: ", "\n", "a\n</turn", "\\", "\\\n</turn>\n"]


def test_turns_parse_back():
    rng = random.Random(1)
    cases = CONFLICTS + ["".join(rng.choice(("###", "</turn>", "\\", "\n", " ", "x", ": ")) for _ in range(rng.randint(0, 8))) for _ in range(2000)]
    for role in ("user", "assistant", "", "a: b\n%3a### \\"):
        whole = [chat.format_turn(role, c) for c in cases]
        assert [(r, t) for r, t, *_ in chat.parse("".join(w[0] for w in whole))] == [(role, c) for c in cases]
        assert all(chat.unescape(f[a:b]) == c for (f, a, b), c in zip(whole, cases))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 0, "user", "### y"), (None, 0, "assistant", "z"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (4, 0, "assistant", "é" * 50000)]
    rows += [(5, k, "assistant" if k % 2 else "user", c) for k, c in enumerate(CONFLICTS)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted", "2 as loss_begin")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    formatted = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert set(got) == set(formatted) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        turns = [(role or "", t or "") for c, n, role, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))]
        learnt = "".join(t for role, t in turns if role == "assistant")
        whole = formatted[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole.formatted))
        assert [x[:2] for x in chat.parse(whole.formatted)] == turns
        assert "".join(chat.unescape(whole.formatted[s.begin : s.end]) for s in whole.loss_spans) == learnt
    assert chat.digests(df.limit(0)).count() == 0 and chat.format_conversations(df.limit(0)).count() == 0


def test_names_inside_articles_and_broken_attributes():
    page = "<article><p class='related-work'>Related</p><div id='search-algorithms'>Search</div><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p><div class='comment-list'>no</div><div class='site-footer'>no</div></article>"
    assert text(page) == "Related\nSearch\nIf x=1 then"
    assert text("<p title=\"a>bad attr</p><p>next") == "bad attr\nnext" and text("<a href=it's>that's</a> all") == "that's all" and text("<p>end<p class=x") == "end"
    assert text("<p data-x='a>b' title=\"c>d\">e</p>") == "e"


def test_the_wrapper_alone_finds_blocks_that_change_from_page_to_page(spark, monkeypatch):
    """No names at all: menus, adverts and footers whose texts differ on each page go by their place and structure, articles of any length stay."""
    for names in ("LANDMARKS", "ROLES", "MARKS", "CONTENT"):
        monkeypatch.setattr(he, names, frozenset())
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    said = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        story = [said(rng.randint(5, 60)) for _ in range(rng.randint(1, 8))]
        menu = "".join(f"<li>{word()}</li>" for _ in range(rng.randint(4, 6)))
        html = f"<body><div><ul>{menu}</ul></div><div>{said(4)}</div><div><h1>{said(3)} {i}</h1>{''.join(f'<p>{p}</p>' for p in story)}</div><div>(c) {said(3)}</div></body>"
        rows.append((i, f"http://host.example/{i}", html))
        want[i] = html.split("<h1>")[1].split("</h1>")[0] + "\n" + "\n".join(story)
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_long_lists_of_unlike_siblings_are_matched_in_a_band():
    rng = random.Random(7)
    lists = lambda n: "".join(f"<li class=c{rng.randrange(40)}><p>t{k}</p><p>u</p></li>" for k in range(n))
    a = he.numbered("<ul>" + lists(20_000) + "</ul>")
    b = he.parse("<ul>" + lists(20_000) + "</ul>")
    pairs = he.align(a, b)  # a full match would need 4e8 steps
    place = {id(x): k for k, x in enumerate(he.every_node(b))}
    order = [place[id(y)] for _, y in sorted(pairs, key=lambda p: p[0].slot)]
    assert 2_000 < len(pairs) <= 40_000 and order == sorted(order)


def test_a_band_that_holds_everything_gives_the_full_match(monkeypatch):
    rng = random.Random(8)
    page = lambda: "<div>" + "".join(f"<div class=c{rng.randrange(6)}><p>t{rng.randrange(9)}</p><p>u</p></div>" for _ in range(rng.randint(1, 14))) + "</div>"
    for _ in range(60):
        a, b = he.numbered(page()), he.parse(page())
        full = he.align(a, b)
        with monkeypatch.context() as m:
            m.setattr(he, "MOST_CELLS", 0)
            m.setattr(he, "BAND", 20)
            assert len(he.align(a, b)) == len(full)


def test_a_very_long_page():
    page = "<article>" + "".join(f"<p>Paragraph {k} of a long page</p>" for k in range(100_000)) + "</article>"
    assert text(page).count("\n") == 99_999 and len(he.align(he.numbered(page), he.parse(page))) == 100_000


def test_a_very_long_turn(spark):
    long = "### x </turn> " * 100_000
    df = spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = chat.digests(df).first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (1, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_long_lists_get_the_largest_match_whatever_their_length(monkeypatch):
    """A block that moved far from its place among many siblings is found, as it is in a short list; so is what stands beyond any band."""
    rng = random.Random(5)
    item = lambda: rng.choice(("<p>a</p>", "<p>a<b>x</b><i>y</i></p>", "<li>u</li>", "<div><p>q</p><ul><li>1</li><li>2</li></ul></div>", "<div><p>q</p></div>", "<hr>"))
    for _ in range(6):
        common = [item() for _ in range(40)]
        one, other = ([*(item() for _ in range(rng.randrange(60))), *(x for x in common if rng.random() < 0.9), *(item() for _ in range(rng.randrange(60)))] for _ in range(2))
        a, b = he.numbered("<body>" + "".join(one) + "</body>"), he.numbered("<body>" + "".join(other) + "</body>")
        found = {}
        for cells in (10**9, 0):
            with monkeypatch.context() as m:
                m.setattr(he, "MOST_CELLS", cells)
                m.setattr(he, "BAND", 3)
                found[cells] = sorted((x.slot, y.slot) for x, y in he.matches(a, b))
        assert found[0] == found[10**9]
    shared = "".join(f"<h2><i{k}></i{k}></h2>" for k in range(150))  # 150 siblings in order, 300 places apart
    a, b = he.numbered("<body>" + "<section><p>x</p></section>" * 300 + shared + "</body>"), he.numbered("<body>" + shared + "<table><tr></tr></table>" * 300 + "</body>")
    assert sum(x.tag == "h2" for x, _ in he.matches(a, b)) == 150
