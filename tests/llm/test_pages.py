"""Main text of pages whose article is known, over many page layouts; consensus of hosts."""

import html
import random

from foliary.llm import pages

SCHEMA = "page_id long, url string, html string, text int, winner string"


def text_of(source, winner=None):
    return pages.main_text(source, winner)[0]


def test_markup_cases():
    assert text_of(None) == "" and text_of("") == "" and text_of("<nav>menu</nav>") == ""
    assert text_of("plain words &amp; more") == "plain words & more"
    assert text_of("<p>a<b>b</b>c<br>d</p><p>e\n\t f&nbsp;g") == "abc d e f g"
    assert text_of("<p><b>one<br><p>two</p><p>three</b></p></p>four") == "one two three four"
    assert text_of("<div>a<!-- <p>hidden</p> -->b<script>var x='</p>';</script><style>p{}</style></div>") == "ab"
    assert text_of("<div>a<!-- open <p>x") == "a"
    assert text_of("<div>1 < 2 &lt; 3 & 4 &#233;&#x1F600;</div>") == "1 < 2 < 3 & 4 é😀"
    assert text_of("<div title='a > b'>kept</div>") == "kept"
    assert text_of("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") != ""
    assert text_of("<div hidden>x</div><div style='display: none'>y</div><p>z</p>") == "z"
    assert text_of("<P CLASS=big>Upper</P><DIV ID=Cookie-Notice>no</DIV>") == "Upper"
    assert text_of("<p>a</i></span></div></p><p>b") == "a b"
    assert len(text_of("<p>" + "w " * 400_000 + "</p>")) == 799_999
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def layout(draw, paragraphs, i):
    """A page around the paragraphs, with noise before, inside and after them."""
    noise = [
        "<nav><ul><li><a href='/a'>Menu entry</a></ul></nav>", "<header><h2>Site name</h2></header>", "<aside>Side words here</aside>",
        "<div class='ad-box'>Buy now</div>", f"<div id='cookieNotice{i}'>We use cookies</div>", "<form><p>Your mail</p><input></form>",
        "<script>if (a < b) { document.write('<p>no</p>') }</script>", "<section class='comments'><article class='comment'><p>First!</p></article></section>",
        "<div role='complementary'>aside</div>", "<footer>&copy; words</footer>", "<!-- <p>note</p> -->", "<div class='newsletter signup'>Join</div>",
    ]
    def some():
        return "".join(draw.sample(noise, draw.randrange(0, 4)))

    body = "".join(f"<p class='t{draw.randrange(9)}'>{html.escape(p)}</p>{some() if draw.random() < 0.2 else ''}" for p in paragraphs)
    kind = draw.randrange(3)
    around = [f"<article>{body}</article>", f"<main><div class='story'>{body}</div></main>", f"<div class='wrap{i}'><div class='post post-{i}'>{body}</div></div>"][kind]
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='has-sidebar'>{some()}{around}{some()}</body></html>"


def test_layouts(spark):
    draw = random.Random(6)
    rows, expected = [], {}
    for i in range(200):
        paragraphs = [" ".join(f"wörd{draw.randrange(99)} & <x>" for _ in range(draw.randrange(5, 30))) for _ in range(draw.randrange(1, 9))]
        rows.append((i, f"https://host{i % 7}.example.org/p/{i}", layout(draw, paragraphs, i), 1, "x"))
        expected[i] = " ".join(paragraphs)
    rows += [(900, None, None, 1, "x"), (901, None, "", 1, "x"), (902, "no address", "<p>a</p>", 1, "x"), (902, "no address", "<p>a</p>", 1, "x")]
    found = pages.extracted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_chars == len(r.text)
        assert r.text == expected.get(r.page_id, "a" if r.page_id == 902 else ""), r.page_id
    assert pages.extracted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_consensus_beats_one_page(spark):
    """On one page a long sidebar outweighs the story; the host's other pages outvote it."""
    def page(story, side):
        return f"<body><div class='story'><p>{story}</p></div><div class='extra'><p>{side}</p></div></body>"

    rows = [(i, "http://h.org/", page("story " * 30, "x"), 1, "") for i in range(5)] + [(5, "http://H.org:80/b", page("story " * 20, "side " * 60), 1, "")]
    found = {r.page_id: r for r in pages.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[5].text == ("story " * 20).strip() and found[5].path.endswith("div.story")
    alone = pages.extracted(spark.createDataFrame([(5, "http://other.org/b", rows[5][2], 1, "")], SCHEMA)).first()
    assert alone.text == ("side " * 60).strip()
