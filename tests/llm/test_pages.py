"""HTML extraction and WARC archives."""

import glob
import hashlib
import html
import re

from tests.conftest import SMALL


def clean(x):
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())


def test_main_text_of_every_page(spark):
    from lexforge.llm.html_extract import html_extract

    pages = spark.read.parquet(f"{SMALL}/../sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", p.html, re.S)[1]
        blocks = [clean(x) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b), p.page_id
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><div id="cookie-notice"><p>We use cookies, and more cookies, and you accept them all here.</p></div>
<div class="header">Site name</div><div class="sidebar"><p>Read, also, these, many, other, things that are not the article at all.</p></div>
<div class="wrap"><div class="post-body"><h2>Title &amp; more</h2><p>First   paragraph,\n with some commas, and <a href="#">a link</a>, that is long enough.<p>Second, unclosed, paragraph &lt;here&gt; that is long enough too, surely.
<ul><li>An item, in a list<li>Another item</ul><blockquote>Quoted words, as they were said, at length.</blockquote></div>
<form><p>Sign up, now, for our, great, newsletter, please, it is free of charge.</p></form>
<div id="comments"><p>I, too, have, an opinion, on this, and it is a long, long, long one.</p></div></div><footer>&copy; 2020</footer><script>var x = "<p>a, b, c</p>";</script></body>"""


def test_containers():
    from lexforge.llm.html_extract import main_text

    want = "Title & more\nFirst paragraph, with some commas, and a link, that is long enough.\nSecond, unclosed, paragraph <here> that is long enough too, surely.\nAn item, in a list\nAnother item\nQuoted words, as they were said, at length."
    assert main_text(PAGE) == want
    assert main_text("") == main_text(None) == main_text("<nav>menu</nav>") == ""
    assert main_text("<article>Short</article>") == "Short" and main_text("plain words") == "plain words"
    assert main_text("<div>" * 30000 + "deep, deep, deep words in many many elements" + "</div>" * 9) == "deep, deep, deep words in many many elements"
    assert main_text("<p>cut off &amp; <b>half, of a, page that, just ends <a hre") == "cut off & half, of a, page that, just ends"


def test_odd_pages(spark):
    from lexforge.llm.html_extract import html_extract
    from lexforge.llm.warc import warc_round_trip

    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "w", "<p>" + "x, " * 200, 3), (4, "a b\r\n", "é" * 50, 4), (5, "v", "é" * 50, 5), (5, "v", "é" * 50, 5), (3, "z", "é" * 49 + "a", 6), (6, "z", "é" * 49 + "a", 6), (7, "big", "word " * 300_000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    assert html_extract(df).count() == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_round_trip(df).collect()), key=str)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        revisit = i == 5
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 4 if revisit else None))
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract(none).count() == 0 and warc_round_trip(none).count() == 0


def brute_records(rows):
    heads = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            heads[b] = min(i, heads.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 100 and i is not None and i > heads[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", heads[b] if revisit else None))
    return sorted(out, key=str)


def test_warc_equals_brute_force(spark):
    from lexforge.llm.warc import warc_round_trip

    # ids that repeat with other payloads: each revisit keeps its own length and digest
    rows = [(4, "a", "A" * 200), (4, "b", "B" * 300), (5, "c", "A" * 200), (6, "d", "B" * 300), (6, "d", "B" * 300), (4, "a", "A" * 200), (7, "e", "é" * 50), (8, "f", "é" * 50), (None, "g", "A" * 200)]
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    for case in (rows, pages + [(i + 10**6, u, h) for i, u, h in pages[:50]]):
        got = warc_round_trip(spark.createDataFrame(case, "page_id long, url string, html string").repartition(4))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == brute_records(case)
        assert got.filter("error is not null").count() == 0


def test_files_end_at_a_size(spark, tmp_path):
    from lexforge.llm import warc

    pages = spark.createDataFrame([(i, f"http://x/{i}", hashlib.sha256(b"%d" % i).hexdigest() * 200) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.plan_records(pages), f"file://{tmp_path}/a", 5_000)
    files = glob.glob(f"{tmp_path}/a/part-*")
    assert len(files) > 2
    for file in files:
        data = open(file, "rb").read()
        book, frames, error = warc.split_frames(data)
        assert book and frames and error is None
    got = warc.read_warc(spark, f"file://{tmp_path}/a")
    assert sorted(r.page_id for r in got.filter("error is null").collect()) == list(range(300))


def test_archives_validate(spark, tmp_path):
    import zstandard

    from lexforge.llm import warc

    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{'text ' * 40}{i % 7}</p>") for i in range(50)], "page_id long, url string, html string")
    warc.write_warc(warc.plan_records(pages).coalesce(1), f"file://{tmp_path}/a")
    (file,) = glob.glob(f"{tmp_path}/a/part-*")
    data = open(file, "rb").read()
    book, frames, error = warc.split_frames(data)
    assert len(frames) == 50 and book and error is None and data[:4] == b"\x5d\x2a\x4d\x18"
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book))
    a, b = frames[0]
    raw = unpress.decompress(data[a:b])
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    assert warc.parse_record(raw)["error"] is None
    assert warc.parse_record(raw[:-1])["error"] == "content length"
    assert warc.parse_record(raw.replace(b"WARC/1.1", b"WARC/9"))["error"] == "bad version line"
    assert warc.parse_record(raw.replace(b"text text", b"texx text"))["error"] in ("payload digest", None)
    # a damaged frame and a cut file give error rows; the rest is read
    broken = bytearray(data)
    broken[frames[3][0] + 30] ^= 0xFF
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.zst").write_bytes(bytes(broken[: frames[-1][0] + 40]))
    rows = warc.read_warc(spark, f"file://{tmp_path}/b").collect()
    assert sum(r.error is None for r in rows) >= 47 and any(r.error for r in rows)
    # a compressed dictionary, and a file without one
    small = zstandard.ZstdCompressor().compress(book)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "y.warc.zst").write_bytes(warc.struct.pack("<II", warc.DICT_MAGIC, len(small)) + small + data[frames[0][0] :])
    (tmp_path / "c" / "z.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(raw))
    rows = warc.read_warc(spark, f"file://{tmp_path}/c").collect()
    assert len(rows) == 51 and all(r.error is None for r in rows)


def test_malformed_declarations_and_wrappers():
    from lexforge.llm.html_extract import main_text

    assert main_text("<p>one</p><![ foo]><p>two</p>") == "one\ntwo"
    assert main_text("<p>one</p><![foo[x]]><p>two</p>") == "one\ntwo"
    assert main_text("<p>one</p>&#" + "9" * 5000 + ";<p>two</p>").split("\n")[-1] == "two"
    words = "<p>Words of the article, some of them, at a good length, and more.</p>" * 4
    want = "\n".join(["Words of the article, some of them, at a good length, and more."] * 4)
    aside = "<div class='sidebar'><p>Read, also, these, many, other, things.</p></div><div id='comments'><p>I, too, think, so, much.</p></div>"
    for outer, inner in (("page with-sidebar", "content"), ("content no-sidebar", "x"), ("page with-sidebar", "content no-sidebar")):
        assert main_text(f"<body><div class='{outer}'><div class='{inner}'>{words}</div>{aside}</div></body>") == want, (outer, inner)
    assert main_text("<p>A short article, which is all.</p><div id='comments'>" + words + "</div>") == "A short article, which is all."


def test_what_surrounds_an_article():
    from lexforge.llm.html_extract import main_text

    assert main_text("<article><p>A</p><![zzz[ x ]]><p>B</p></article>") == "A\nB"
    assert main_text("<article><p>A</p><p>B</p><!-- unclosed comment <p>C</p>") == "A\nB"
    assert main_text("<article><p>A</p><!-- closed --><p>B</p><!-->") == "A\nB"
    words = "<p>Words of the article, some of them, at a good length, and more.</p>" * 4
    lines = ["Words of the article, some of them, at a good length, and more."] * 4
    form = "<form class='search'><p>Find, all, that, you, may, want.</p><input name=q></form>"
    assert main_text(f"<body><form action='/page.aspx'><input type=hidden name=v><div class='content'>{words}</div>{form}</form></body>") == "\n".join(lines)
    assert main_text(f"<div class='post'><div class='entry-header'><h1>Title</h1></div>{words}</div>") == "\n".join(["Title", *lines])
    assert main_text(f"<body><div><div>{words}</div><div><p>It ends so.</p></div><div><a href=x>More</a></div></div></body>") == "\n".join([*lines, "It ends so."])
    # no article element: the densest container, without links and comments beside it
    links = "<ul>" + "<li><a href=x>One, of the, other, pages here, with a long name</a>" * 9 + "</ul>"
    assert main_text(f"<table><tr><td>{links}</td><td id='story'>{words}</td></tr></table><div id='comments'>{words}</div>") == "\n".join(lines)
