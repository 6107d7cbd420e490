"""Article text that stands beside the best container, and generated pages with known text."""

import random

import pytest

from lexforge.llm.html_extract import main_text

P = "<p>" + "Words of a paragraph, with commas, that goes on for a while. " * 4 + "</p>"
TEXT = " ".join(("Words of a paragraph, with commas, that goes on for a while. " * 4).split())


@pytest.mark.parametrize("page,want", [
    (f"<div id=main><section><h2>A</h2>{P}{P}</section><section><h2>B</h2><ul><li>one<li>two</ul></section><section><h2>C</h2><p>short</p></section></div>", ["A", TEXT, TEXT, "B", "one", "two", "C", "short"]),
    (f"<div class=page><h1>Title</h1><p class=lead>Lead text.</p><div class=body>{P}{P}</div><p>Last.</p></div>", ["Title", "Lead text.", TEXT, TEXT, "Last."]),
    (f"<div class=wrap><div class=a>{P}{P}</div><div class=b><p>Closing remark without stop</p></div></div>", [TEXT, TEXT, "Closing remark without stop"]),
    (f"<body><h1>T</h1><div><div>{P}{P}</div></div></body>", ["T", TEXT, TEXT]),
    (f"<article>{P}<p class='legal'>The legal case went on.</p><p class='ad'>Buy now.</p>{P}</article>", [TEXT, "The legal case went on.", TEXT]),
    (f"<article><header><h1>Title</h1></header>{P}</article>", ["Title", TEXT]),
    (f"<body><ul><li><a href=/>Home</a><li><a href=/x>News of the day</a></ul><div>My site</div><div>{P}{P}</div><div><a href=/>More of the same stories</a></div></body>", [TEXT, TEXT]),
    (f"<div>Loose words before <b>bold</b> <div>{P}{P}</div> and after.</div>", ["Loose words before bold", TEXT, TEXT, "and after."]),
])
def test_nothing_of_the_article_is_lost(page, want):
    assert main_text(page).split("\n") == want


CHROME = [
    "<nav><ul><li><a href=/a>Home</a></ul></nav>", "<div class='sidebar'><p>Read, also, this, long, text, beside, the article, as you like.</p></div>", "<aside><p>Something, else, entirely, beside the article, in an aside.</p></aside>",
    "<div id='cookie-notice'><p>We use, many, cookies, here, please, agree to all of them.</p></div>", "<form><p>Sign up, please, now.</p><input></form>", "<script>var a = '<p>no</p>';</script>", "<div class='ad'>Buy, buy, buy.</div>",
    "<ul><li><a href=/1>First story</a><li><a href=/2>Second story</a></ul>", "<footer>&copy; nobody</footer>", "<div id='comments'><p>I, too, think, so, and, more.</p></div>", "<!-- <p>not, this</p> -->", "<header><h2>The site</h2></header>",
]


def article(rng, depth, blocks, n):
    """Random nesting of containers around numbered blocks."""
    out = []
    for _ in range(n):
        kind = rng.randrange(9 if depth else 7)
        word = lambda: f"block {len(blocks)} {rng.choice(['says', 'tells'])}"
        if kind < 3:
            blocks.append(word() + " something, with commas, at some length, as paragraphs do, on and on." * rng.randrange(1, 4))
            out.append(f"<p>{blocks[-1]}</p>")
        elif kind == 3:
            blocks.append(word())
            out.append(f"<h2>{blocks[-1]}</h2>")
        elif kind == 4:
            blocks.append(word())
            out.append(f"<p class=lead>{blocks[-1]}</p>")
        elif kind == 5:
            items = [f"item {len(blocks)} {j}" for j in range(rng.randrange(1, 4))]
            blocks.extend(items)
            out.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
        elif kind == 6:
            blocks.append(word())
            out.append(f"<figure><img src=x><figcaption>{blocks[-1]}</figcaption></figure>")
        else:
            tag = rng.choice(["div", "section"])
            out.append(f"<{tag}>{article(rng, depth - 1, blocks, rng.randrange(1, 4))}</{tag}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(120))
def test_generated_pages(seed):
    """Whatever the nesting: all blocks of the article, in order, and no chrome around, beside or between them."""
    rng, blocks = random.Random(seed), []
    parts = []
    for _ in range(rng.randrange(1, 4)):
        if rng.random() < 0.5:
            parts.append(rng.choice(CHROME))
        parts.append(article(rng, 2, blocks, rng.randrange(1, 4)))
    blocks.append("the end of it, with commas, and with enough, words, to be a paragraph, of the article, that closes it.")
    body = "".join(parts) + f"<p>{blocks[-1]}</p>"
    wrap = rng.choice(["<div class=wrap>{}</div>", "<div><div id=content>{}</div></div>", "<article>{}</article>", "{}", "<main><div>{}</div></main>"])
    if wrap == "<article>{}</article>" or "<main>" in wrap:
        body = body.replace("<header><h2>The site</h2></header>", "").replace("<ul><li><a href=/1>First story</a><li><a href=/2>Second story</a></ul>", "")
    around = [rng.choice(CHROME) for _ in range(rng.randrange(4))]
    page = "<html><head><title>t</title></head><body>" + "".join(around[:2]) + wrap.format(body) + "".join(around[2:]) + "</body></html>"
    assert main_text(page).split("\n") == blocks
