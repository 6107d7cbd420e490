"""Line dedup and licence scans (DataFrame functions only), and the SentencePiece transducer."""

import random
import re

import pytest

from tests.conftest import SMALL
from tests.llm.test_corpus_ops import key, odd_rows


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[n + 1 :] == b[n + 1 :] or a[n:] == b[n + 1 :] or a[n + 1 :] == b[n:]


def brute_lines(rows):
    last = 2**63 - 1
    first, order = {}, sorted(range(len(rows)), key=lambda i: last if rows[i][0] is None else rows[i][0])
    for i in order:
        for k, line in enumerate((rows[i][1] or "").split("\n")):
            if re.search("[^\x20\x09-\x0d]", line):
                first.setdefault(line, (last if rows[i][0] is None else rows[i][0], k, i))
    lines = list(first)
    edited = {a for a in lines if len(a) >= 20 and any(first[b][:2] < first[a][:2] and len(b) >= 20 and within_one(a, b) for b in lines)}
    out = []
    for i, (d, t) in enumerate(rows):
        if not t:
            out.append((d, t, 0, 0))
            continue
        parts = t.split("\n")
        kept = [x for k, x in enumerate(parts) if x not in first or (first[x][:2] == (last if d is None else d, k) and rows[first[x][2]][1] == t and x not in edited)]
        out.append((d, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def line_rows():
    long = "the quick brown fox jumps over the lazy dog"
    rows = [(0, f"{long}\nkeep me, I am unique here\n\n{long}"), (1, f"{long[:20]}X{long[21:]}\nshort\nshorz"), (2, long[1:]), (3, long + "s"), (4, f"  {long}"), (5, None), (6, ""), (7, "\n\n \n"), (8, f"{long}\n" * 300), (9, "ünïcödé lïnés ärë lïnës töö, thäts it"), (10, "ünïcödé lïnés ärë lïnës töö, thäts Xt")]
    rows += [(20 + i, f"the template line number {i:03d} of many\nsecond line {i} stays, as its edit is longer {'x' * i}") for i in range(40)]
    return rows + [(3, long + "s"), (None, f"no id line, of its own kind\n{long}")]


@pytest.mark.parametrize("which", ["lines", "odd", "documents"])
def test_line_dedup(spark, which):
    from lexforge.llm.line_dedup import line_dedup

    rows = line_rows() if which == "lines" else odd_rows() if which == "odd" else [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    names = ["gone", "base", "row", "parts", "place", "pos", "line", "__base", "__gone", "__parts"]
    df = spark.createDataFrame([(d, t, 5, *names) for d, t in rows], "doc_id long, text string, n_lines int" + "".join(f", {n} string" for n in names)).repartition(3)
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", *names, "n_lines", "n_dropped"]
    assert got.select(*names).distinct().collect() == [tuple(names)]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key) == sorted(brute_lines(rows), key=key)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_line_dedup_of_repeated_ids_and_long_lines(spark):
    import time
    from collections import Counter

    from lexforge.llm.line_dedup import line_dedup

    random.seed(11)
    long = "".join(random.choice("abcdefghij é") for _ in range(1_000_000))
    rows = [(5, "first of five\nthis line is in all of them"), (5, "second of five\nthis line is in all of them"), (5, "second of five\nthis line is in all of them"), (None, "this line is in all of them\nno id, one"), (None, "no id, two\nno id, both"), (None, "no id, both\nno id, three")]
    rows += [(6, long), (7, long[:700_000] + "X" + long[700_001:]), (8, long[:1] + long[2:]), (9, long + "."), (10, long[:10] + "XY" + long[12:]), (11, long[:500_000])]
    start = time.time()
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert time.time() - start < 90
    kept = {r.doc_id: r.text for r in got if r.doc_id and r.doc_id > 5}
    # 10 is two edits from 6, 7, 8 and 9
    assert kept == {6: long, 7: "", 8: "", 9: "", 10: rows[-2][1], 11: long[:500_000]}
    lines = Counter(x for r in {(r.doc_id, r.text) for r in got if r.doc_id in (5, None)} for x in r[1].split("\n"))
    assert lines == {"first of five": 1, "second of five": 1, "this line is in all of them": 1, "no id, one": 1, "no id, two": 1, "no id, both": 1, "no id, three": 1}
    assert len({(r.text) for r in got if r.doc_id == 5}) == 2


def test_license_scan(spark):
    from lexforge.llm.license_scan import license_scan
    from lexforge.llm.license_texts import BSD_3, MIT

    rows = [(1, MIT), (2, "Copyright (c) 2020 Some One\n(C) 2021 another\n\n" + MIT.partition("\n\n")[2].upper().replace(",", " ;")), (3, BSD_3.replace("LIABLE", "Liable").replace("\n\n", "\n")), (4, MIT + " and more"), (5, None), (6, ""), (7, "!!!"),
            (8, "text\nReleased under the MIT Licence!\n  licensed under CC BY 4.0\nReleased under the MIT License."), (8, "text\nReleased under the MIT Licence!\n  licensed under CC BY 4.0\nReleased under the MIT License."), (None, "Licensed under the Apache License, Version 2.0."), (9, "word " * 100_000)]
    df = spark.createDataFrame([(d, t, "q", "z") for d, t in rows], "doc_id long, text string, digest string, notices string")
    got = sorted(((r.doc_id, r.license_id, r.notices) for r in license_scan(df).collect()), key=key)
    want = [(1, "MIT", ""), (2, "MIT", ""), (3, "BSD-3-Clause", ""), (4, None, ""), (5, None, ""), (6, None, ""), (7, None, ""), (8, None, "CC-BY-4.0,MIT"), (8, None, "CC-BY-4.0,MIT"), (None, "Apache-2.0", "Apache-2.0"), (9, None, "")]
    assert got == sorted(want, key=key)
    assert license_scan(df.limit(0)).count() == 0


def test_native_oracles(spark):
    import duckdb

    from lexforge.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        got = queries.queries()[name](spark, SMALL)
        assert sorted(got.columns) == sorted(names)
        assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key), name


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    from lexforge.llm.sentencepiece_fst import decode, encode

    random.seed(1)
    alpha = "abcdefgh  ▁  \n\t\0éñ漢字🙂.,!=<s>0123 THEtheing"
    cases = ["".join(random.choice(alpha) for _ in range(random.randrange(60))) for _ in range(400)]
    cases += ["", "   ", " a", "a ", "▁x y▁▁z", " " * 40, "a" * 90, "=" * 70, "hello</s><unk><0x0A>", "\r\n\r\n", "word " * 20_000, "x" * 3000, None]
    cases += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "old", 3) for i, t in enumerate(cases)], "doc_id int, text string, ids string, decoded int").repartition(4)
    got = {r.doc_id: r for r in decode(encode(df, MODEL), MODEL).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in enumerate(cases):
        want = lib.encode(t or "")
        assert got[i].ids == want, t
        assert got[i].decoded == lib.decode(want), t
    assert decode(encode(df.limit(0), MODEL), MODEL).count() == 0
    odd = spark.createDataFrame([([195],), ([3 + 0xC3],), (None,), ([],), ([1, 2, 415],)], "ids array<int>")
    assert [r.decoded for r in decode(odd, MODEL).collect()] == [lib.decode([195]), lib.decode([3 + 0xC3]), "", "", lib.decode([1, 2, 415])]


def message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            import struct

            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def hand_made(kind, texts, rules, fallback, user):
    """A model of short strings of the texts, with made-up scores; nothing is trained."""
    import struct

    rng = random.Random(3)
    words = ["▁" + w for t in texts for w in (t or "").split()]
    names = sorted({w[a : a + n] for w in words for n in (1, 2, 3, 5) for a in range(0, len(w), 2) if len(w[a : a + n]) == n})
    rng.shuffle(names)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    pieces += [(u, 0.0, 4) for u in user]
    # in 1/8 steps, so that many paths weigh the same
    pieces += [(p, -rng.randrange(8, 80) / 8 if kind == 1 else -float(i), 1) for i, p in enumerate(x for x in names if x not in user)]
    size = lambda b: bytes([len(b)]) if len(b) < 128 else bytes([len(b) & 127 | 128, len(b) >> 7 & 127 | 128, len(b) >> 14 & 127 | 128, len(b) >> 21])
    body = b"".join(b"\x0a" + size(m) + m for m in (message([(1, p.encode()), (2, s), (3, k)]) for p, s, k in pieces))
    spec = message([(1, b"hand-made"), (3, 1), (4, 1), (5, 1)]) + (b"\x12" + size(rules) + rules if rules else b"")
    trainer = message([(3, kind)]) + struct.pack("<BBB", 0x98, 0x02, int(fallback))
    return body + b"\x12" + size(trainer) + trainer + b"\x1a" + size(spec) + spec


@pytest.mark.parametrize(("kind", "rewritten", "fallback", "user"), [(1, True, False, ()), (1, True, True, ("[TAG]",)), (2, True, True, ("[TAG]", "ab")), (2, False, True, ()), (1, False, False, ())])
def test_sentencepiece_kinds_equal_the_library(spark, tmp_path, kind, rewritten, fallback, user):
    import sentencepiece

    from lexforge.llm.sentencepiece_fst import Transducer, _fields, decode, encode

    rules = dict(_fields(dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]))[2] if rewritten else b""
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    model = hand_made(kind, docs[:40], rules, fallback, user)
    (tmp_path / "m.model").write_bytes(model)
    random.seed(4)
    alpha = "abcde ﬁ①Ａ́e\u0301\u0308가\u1100\u1161\t\u00a0\u200b\u3000 [TAG]ab ½Å漢\x07"
    cases = ["".join(random.choice(alpha) for _ in range(random.randrange(50))) for _ in range(200)] + docs + ["", None, " ", "[TAG]", "x[TAG] [TAG]y", "ab" * 400, "é" * 300, "№ ™ ﷺ"]
    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r for r in decode(encode(df, str(tmp_path / "m.model")), str(tmp_path / "m.model")).collect()}
    wrong = [t for i, t in enumerate(cases) if got[i].ids != lib.encode(t or "") or got[i].decoded != lib.decode(got[i].ids)]
    assert not wrong, (len(wrong), wrong[0], Transducer(model))


def test_chunks_together_equal_chunks_alone():
    from lexforge.llm.sentencepiece_fst import Transducer

    with open(MODEL, "rb") as f:
        fst = Transducer(f.read())
    random.seed(5)
    chunks = ["▁" * random.randrange(3) + "".join(random.choice("abcdetheing漢é\n0=") for _ in range(random.randrange(1, 40))) for _ in range(3000)]
    flat, many = fst.shortest_all(chunks)
    at = 0
    for c, n in zip(chunks, many.tolist(), strict=True):
        assert [fst._name(p) for p in flat[at : at + n].tolist()] == fst.shortest(c)
        at += n
    assert fst.shortest_all([])[0].tolist() == []


def test_unigram_takes_the_lightest_path():
    import numpy as np

    from lexforge.llm.sentencepiece_fst import Transducer

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -1.5, 1), ("▁", -2.0, 1), ("ab", -1.2, 1), ("a", -3.0, 1), ("bb", -2.0, 1)]
    model = b"".join(message([(1, message([(1, p.encode()), (2, s), (3, k)]))]) for p, s, k in pieces) + message([(2, message([(3, 1)])), (3, message([(3, 1), (4, 1), (5, 1)]))])
    fst = Transducer(model)
    for text, want in (("ab", ["▁a", "b"]), ("abb", ["▁a", "bb"]), ("  a   ab ", ["▁a", "▁a", "b"]), ("aab", ["▁a", "ab"]), ("azb", ["▁a", "<unk>", "b"])):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = fst.encode(data, np.array([0, len(data)]))
        assert [fst.pieces[i][0] for i in ids] == want, text
