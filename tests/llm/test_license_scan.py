"""Notices without a licence word, and whole texts of the longer licences."""

from pathlib import Path


def test_every_line_and_whole_texts(spark):
    from lexforge.llm import license_scan as ls
    from lexforge.llm.license_texts import LICENSES, whole_texts

    notices = [(k, t) for k, t in LICENSES if "\n" not in t]
    rows = [(i, f"some words\n{t.upper()}\n\nmore words", None, k) for i, (k, t) in enumerate(notices)]
    rows += [(100 + i, t, k, None) for i, (k, t) in enumerate(whole_texts())]
    assert {k for k, _ in whole_texts()} >= {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notices) for r in ls.license_scan(docs).collect()}
    for i, _, whole, notice in rows:
        assert got[i][0] == whole and (notice is None or got[i][1] == notice), i
    own = spark.createDataFrame([("X", "Do as you like."), ("Y", "Ask first.")], "license_id string, text string")
    text = spark.createDataFrame([(1, "a\nDo as you like\nask first!\nb"), (2, "do as you"), (3, None)], "doc_id long, text string")
    want = {(1, "X,Y"), (2, ""), (3, "")}
    assert {(r.doc_id, r.notices) for r in ls.license_scan(text, own).collect()} == want
    ls.INLINE_ROWS, kept = 1, ls.INLINE_ROWS
    try:
        assert {(r.doc_id, r.notices) for r in ls.license_scan(text, own).collect()} == want
    finally:
        ls.INLINE_ROWS = kept


def test_license_files_are_in_the_package():
    from lexforge.llm import license_texts

    assert len(list((Path(license_texts.__file__).parent / "license_files").glob("*.txt"))) == len(license_texts.whole_texts()) > 0
