"""Token counts (op3), WARC (op4), HTML (op7), BPE (op9), licences (op10) and the pipeline."""

import gzip
import hashlib
import os
import random
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, common, decontaminate, html_extract, jaccard_join, licenses, quality_crf, queries, token_counts, toxicity, warc

SMALL = "/root/testdata/sf0.001"
ODD = ["", "a", " ", "\n \n", "don't we'll they'RE it's 'S ' s''s 'tis", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>x", "the" * 400, "é ñ ß 🙂 　x y", "²½ 12٣ Ⅷ", "\x1c \x85 ﻿", "aaaa" * 3000, "x " * 20000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def texts(spark):
    return [r["text"] for r in common.table(spark, SMALL, "documents").collect()] + ODD


def test_bpe_equals_library(spark, library):
    enc, all_texts = bpe.encoder(bpe.default_vocabulary()), texts(spark)
    want = library.encode_batch(all_texts, add_special_tokens=False)
    for t, p, w in zip(all_texts, enc.encode_packed(all_texts), want):
        ids = np.frombuffer(p, "<u4")
        assert ids.tolist() == w.ids, t[:40]
        assert enc.decode(ids).decode() == library.decode(w.ids, skip_special_tokens=False)
    assert enc.decode(np.array([64, 50256, 100])).decode() == library.decode([64, 50256, 100], skip_special_tokens=False)


def test_bpe_equals_library_on_random_texts(library):
    """20,000 random texts, among them letters of recent Unicode versions and special tokens."""
    rng = random.Random(9)
    bits = ["<|endoftext|>", "<|endoftext|", "'s", "'ll", " ", "  ", "\n", "\t", "\u1c89", "\ua7cb", "\U00010d40", "\U00016d41", "é", "ß", "中", "🙂", "\u0301", "٣", "Ⅷ", "a", "The", "ing", "1", "!", "'", "\u3000", "\x85"]
    some = lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(128), rng.randrange(0x1C80, 0x1CC0)]))
    all_texts = ["".join(rng.choice(bits) if rng.random() < 0.7 else some() for _ in range(rng.randint(0, 24))) for _ in range(20_000)]
    all_texts += ["<|endoftext|>" * 10_000, "a <|endoftext|>" * 5_000, "\u1c89x"]
    enc = bpe.encoder(bpe.default_vocabulary())
    for t, p, w in zip(all_texts, enc.encode_packed(all_texts), library.encode_batch(all_texts, add_special_tokens=False)):
        assert np.frombuffer(p, "<u4").tolist() == w.ids, t[:60]


def test_bpe_classes_of_all_code_points(library):
    """A letter stays with a letter and a number with a number before it, as the library splits them."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for first in "a1":
        text = "\n".join(first + chr(c) for c in points)
        want = {span[0] for _, span in library.pre_tokenizer.pre_tokenize_str(text)}
        got = bpe.split_points(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.zeros(1, np.int64))
        assert set(got.tolist()) == want


def test_bpe_query(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "q", "x"), (3, None, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = Counter(tuple(r) for r in bpe.roundtrip_digests(df, bpe.default_vocabulary()).collect())
    want = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        want[i, len(ids), len(back), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()] += 1
    assert got == want
    assert bpe.roundtrip_digests(df.where("false"), bpe.default_vocabulary()).count() == 0
    back = bpe.decode(bpe.encode(df, bpe.default_vocabulary()), bpe.default_vocabulary()).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t, _ in rows)


def test_token_counts(spark, library):
    rows = [(k, t, 1) for k, t in enumerate(texts(spark))] + [(None, "q", 1), (0, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ordinal int").repartition(3)
    df = common.materialize(df, "token-docs")
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.document_counts(df, bpe.default_vocabulary()).collect())
    assert got == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert token_counts.document_counts(df.where("false"), bpe.default_vocabulary()).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_boundaries_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    sizes = rng.integers(0, 12, 40)
    flat = np.concatenate([np.append(rng.integers(1, 9, n), 0) for n in sizes] + [np.array([5, 5])]).astype("<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([0, 0, 3, 0], "<u2").tobytes())
    (tmp_path / "c.bin").write_bytes(b"")
    got = {}
    for r in token_counts.counts(spark, str(tmp_path), block=block).collect():
        got.setdefault(os.path.basename(r["file"]), {})[r["ordinal"]] = (r["n_tokens"], r["closed"])
    assert [got["a.bin"][k] for k in range(41)] == [(n, True) for n in sizes] + [(2, False)]
    assert got["b.bin"] == {0: (0, True), 1: (0, True), 2: (1, True)} and "c.bin" not in got


@pytest.mark.parametrize("width", [2, 4])
def test_documents_across_files(spark, tmp_path, width):
    """Files that are cut anywhere are one stream; blocks are scanned apart and stitched."""
    rng = np.random.default_rng(width)
    sizes = rng.integers(0, 30, 200)
    flat = np.concatenate([np.append(rng.integers(1, 60_000, n), 0) for n in sizes]).astype(f"<u{width}")
    cut = np.sort(rng.integers(0, len(flat), 12))
    for k, part in enumerate(np.split(flat, cut)):
        (tmp_path / f"s-{k:02d}.bin").write_bytes(part.tobytes())
    stream = (F.lit("s"), F.regexp_extract("path", r"-(\d+)[.]bin", 1))
    got = token_counts.counts(spark, str(tmp_path), block=16, width=width, stream=stream).orderBy("ordinal").collect()
    assert [(r["n_tokens"], r["closed"]) for r in got] == [(n, True) for n in sizes]
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends within an id"):
        token_counts.counts(spark, str(tmp_path / "odd.bin"), width=width).collect()


def test_counts_of_rows_not_from_files(spark, library, monkeypatch):
    """Rows that another plan could partition in another way keep their own counts; several files of a partition."""
    monkeypatch.setattr(token_counts, "FILE_ROWS", 1)
    monkeypatch.setattr(token_counts, "CHUNK", 60)
    df = spark.range(300).selectExpr("id doc_id", "repeat('word ', cast(id % 37 as int)) text").repartition(7).groupBy("doc_id").agg(F.first("text").alias("text"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_counts(df, bpe.default_vocabulary()).collect()}
    assert got == {k: len(library.encode("word " * (k % 37), add_special_tokens=False).ids) for k in range(300)}


def raw_record(payload, page=1, kind="response", digest=None):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = digest or hashlib.sha1(payload).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Page-ID: {page}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def ids(found):
    return [r.headers["warc-page-id"] for r in found if isinstance(r, warc.Record)], [(g.offset, g.end) for g in found if isinstance(g, warc.Gap)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    raws = [raw_record(b"page %d " % k * 50, k) for k in range(6)]
    whole = [gzip.compress(r) for r in raws] if packed else raws
    at = np.cumsum([0, *map(len, whole)])
    data = b"".join(whole)
    assert ids(list(warc.records(data))) == ([str(k) for k in range(6)], [])
    cut = data[: at[2] + 30] + data[at[3] :]  # a record cut short
    assert ids(list(warc.records(cut))) == (["0", "1", "3", "4", "5"], [(at[2], at[2] + 30)])
    bad = bytearray(data)
    bad[at[1] + 60] ^= 0xFF if packed else 0x01
    middle = len(whole[4]) // 2
    bad[at[4] + middle : at[4] + middle + 4] = b"\0\0\0\0"
    got, gaps = ids(list(warc.records(bytes(bad))))
    assert "4" not in got and {"0", "2", "3", "5"} <= set(got) and (at[4], at[5]) in gaps
    tail = data + b"junk at the end"
    assert ids(list(warc.records(tail)))[1] == [(len(data), len(tail))]
    assert ids(list(warc.records(b""))) == ([], []) and ids(list(warc.records(b"no archive")))[1] == [(0, 10)]


def test_payload_may_hold_version_lines():
    inner = b"x\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = raw_record(inner, 1) + raw_record(b"y", 2)
    assert ids(list(warc.records(data))) == (["1", "2"], [])
    assert [r.payload for r in warc.records(data)][0] == inner


def test_gzip_member_of_several_records():
    raw = [raw_record(b"x" * 50, k) for k in range(4)]
    whole = gzip.compress(b"".join(raw))
    assert ids(list(warc.records(whole))) == (["0", "1", "2", "3"], [])
    junk = gzip.compress(raw[0] + b"junk\r\n" + raw[1] + b"rest") + gzip.compress(raw[2])
    found, gaps = ids(list(warc.records(junk)))
    assert found == ["0", "1", "2"] and len(gaps) == 2


def test_damage_among_many_members():
    """Long records, an empty member and thousands of false starts are read in linear time."""
    raws = [raw_record(os.urandom(200_000), 1), raw_record(b"y", 2)]
    data = warc.member(raws[0]) + gzip.compress(b"", mtime=0) + b"\x1f\x8b\x08junk" * 20_000 + warc.member(raws[1])
    got, gaps = ids(list(warc.records(data)))
    assert got == ["1", "2"] and len(gaps) == 1
    big = warc.member(raw_record(b"x" * (1 << 24), 3))
    assert big[-1] == 0 and ids(list(warc.records(big + warc.member(raws[1])))) == (["3", "2"], [])


@pytest.mark.parametrize("hot", [100_000, 1])
def test_warc_round_trip(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_PAYLOADS", hot)
    big, big2 = "<p>é</p>" * 200, "z" * 1000
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "u", big2), (3, "u", big2), (4, "u v\r\nx", "z" * 999), (5, "u", "z" * 999), (6, "u", None), (7, "u", ""), (None, "u", big2), (8, "u", "WARC/1.1\r\n\r\n" * 200)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = common.scratch(spark, "warc-test")
    monkeypatch.setattr(warc, "CHUNK", 300)
    warc.write(df, path, file_rows=2)
    found = warc.salvage(spark, path, payload=True).collect()
    assert all(r["kind"] == "record" for r in found) and len(found) == len(rows)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        target = {big: 9, big2: 3}.get(h)
        revisit = target is not None and i != target
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", target if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == want
    assert next(r["payload"] for r in found if r["page_id"] == 9) == big.encode()
    empty = common.scratch(spark, "warc-empty")
    warc.write(df.where("false"), empty)
    assert warc.salvage(spark, empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="nav-open"><header><h1>Site</h1></header>
<div class="cookie-banner">Cookies</div><nav><ul><li><a href="/x">x</a></li><li><a>y</a></li></ul></nav><div class="ad">Buy</div>
<article><header><h1>Head &amp; line</h1><p>by me</p></header><p>One  <b>two</b>
 three&nbsp;four<br>five<p>Six &lt;7&gt;</p><ul><li>a<li>b</ul><aside>aside</aside><form>f<input></form><style>.x{}</style><div class="ad">ad</div><p>last</p></article>
<section id="comments"><article class="comment"><p>me too</p></article></section><footer>&copy; foot</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(k, f"http://h{k % 2}.example.com/{k}", PAGE) for k in range(8)]
    rows += [(20, "http://h0.example.com/z", None), (21, None, "<p>alone</p><p>two"), (21, None, "<p>alone</p><p>two"), (22, "not a url", "plain &amp; text"), (23, "http://one.example.org", "<div><div class=menu>m</div><div><p>" + "word " * 50000 + "</p></div></div>"), (None, "http://h0.example.com/", "<article></article>"), (24, "http://odd/", "<<p>a</b></p <!-- x")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in html_extract.main_texts(df).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append(r["text"])
    want = "Head & line\nOne two three four five\nSix <7>\na\nb\nlast"
    assert all(got[k] == [want] for k in range(8))
    assert got[20] == [""] and got[None] == [""] and got[21] == ["alone\ntwo"] * 2 and got[22] == ["plain & text"]
    assert got[23] == [("word " * 50000).strip()] and 24 in got
    assert html_extract.main_texts(df.where("false")).count() == 0


def test_hosts_without_semantic_tags(spark):
    """Plain divs, with classes and without, beside hosts of one page and of equal pages."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        title, text, more = say(4), say(60), say(50 + k)
        for host, (a, b, c) in enumerate(((" class='c1'", " class='c2'", " class='c3'"), ("", "", ""))):
            body = f"<div{b}><h1>{title}</h1><p>Read on.</p><p>{text}</p><p>{more}</p></div>"
            recent = f"<div class='c4'><p>{say(3)}</p></div>" if not host else ""
            rows.append((100 * host + k, f"http://plain{host}.org/{k}", f"<html><body><div{a}><ul><li>Home<li>Products</ul></div>{body}{recent}<div{c}>All rights are ours. <p>Imprint</p></div></body></html>"))
            want[100 * host + k] = f"{title}\nRead on.\n{text}\n{more}"
    rows += [(300 + k, f"http://equal.org/{k}", "<div>Home</div><div>Text</div>") for k in range(2)] + [(400, "http://single.org/", "<div>Home</div><div>Text</div>")]
    want.update({300: "Home\nText", 301: "Home\nText", 400: "Home\nText"})
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html_extract.main_texts(df).collect()} == want


def test_words_of_sections_are_not_furniture():
    page = """<body><div class="site-header">Site</div><article><h1>T</h1><section id='discussion'><h2 id='side-effects'>Side effects</h2><p>d</p></section>
<div class='legal-analysis'>law</div><div class='article-header'>lead</div><p title="a hidden gem">gem</p><p data-id='menu'>dish</p><p data-x="1" hidden>no</p>
<div class='notice'>n</div><div class='ad-box wide'>ad</div><ul class='share-buttons'><li>s</ul><div class='related posts'>r</div><p>x <span class='tags'>t</span></p></article></body>"""
    path = html_extract.main_path(html_extract.form(page))
    assert html_extract.extract(page, path) == "T\nSide effects\nd\nlaw\nlead\ngem\ndish\nn\nx"


def read_alone(page):
    return html_extract.extract(page, html_extract.main_path(html_extract.form(page)))


def test_articles_in_other_parts():
    own = "<article><h1>T</h1><p>own text of the page, long enough</p>{}</article>"
    for other in ("<aside>{}</aside>", "<section id='comments'><h2>3 comments</h2>{}</section>", "<footer>{}</footer>", "<nav>{}</nav>"):
        assert read_alone(own.format("") + other.format("<article><p>me too</p></article>")) == "T\nown text of the page, long enough"
    # an article within an article is a comment on it, unless it holds nearly all of the text
    assert read_alone(own.format("<div><h3>Replies</h3><article><p>me too</p></article></div>")) == "T\nown text of the page, long enough\nReplies"
    assert read_alone("<article><article><h1>T</h1><p>all of it</p></article></article>") == "T\nall of it"
    assert read_alone("<main><div>crumbs</div>" + own.format("") + "</main>").endswith("long enough")
    assert read_alone("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><div class='side-by-side'>both</div><p class=discussion>d</p></article>") == "so x=1\nboth\nd"


def test_hard_pages_are_read_in_linear_time():
    deep = "<div>" * 5000 + "<article>" + "<div>" * 5000 + "core" + "</div>" * 10_000
    assert read_alone(deep) == "core"
    for page in ("<a x " * 200_000, '<a x="' * 200_001 + ">", "<" * 1_000_000, "<!-- " * 200_000, "<div>" * 100_000, "<p><b>" * 100_000, "<li>x" * 100_000, "".join(f"<{t}>x" for t in ("h2", "ul", "table", "p", "dl") * 20_000), "<![CDATA[" * 50_000):
        read_alone(page)
    assert read_alone("<article>1 < 2 and <b title=\"a > b\">bold</b> it's</article>") == "1 < 2 and bold it's"


def test_template_within_articles_is_left_out(spark):
    """Text that is equal on all pages of a host is template, though only the wrapper can tell."""
    rows, want = [], {}
    for k in range(6):
        text = " ".join(f"w{random.Random(k * 100 + i).randrange(900)}" for i in range(60))
        rows.append((k, f"http://t.org/{k}", f"<article><h1>No {k}</h1><p>{text}</p><div>Write to our desk at the old address</div><table><tr><td>Total</td></tr></table></article>"))
        want[k] = f"No {k}\n{text}\nTotal"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert {r["page_id"]: r["text"] for r in html_extract.main_texts(df).collect()} == want
    alone = {k: read_alone(page) for k, _, page in rows}
    assert all(alone[k] != want[k] and "old address" in alone[k] for k in want)


def test_wrapper_generalises():
    a = html_extract.form("<div><h1>t</h1><p>x</p><p>y</p><ul><li>1<li>2</ul></div>")
    b = html_extract.form("<div><h1>t</h1><p>x</p><div class=ad>z</div></div>")
    both = html_extract.merge(a, b)
    assert both.expression() == "<><div><h1>#</h1>(<p>#</p>)+(<ul>(<li>#</li>)+</ul>)?(<div.furniture>#</div.furniture>)?</div></>"
    assert html_extract.merge(both, a).expression() == both.expression()
    assert html_extract.Node.unpack(both.pack()).expression() == both.expression()


def run_oracle(sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table)
    found = con.sql(sql)
    return sorted(map(repr, found.fetchall())), found.columns


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal in the Software\n# without restriction, including this.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (1, "text. Licensed under the Apache License, Version 2.0. more"), (2, "a\n * Licensed under the Apache\n * License, Version 1.1.\nx"), (3, mit), (4, None), (5, ""), (6, "licensed"), (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (8, "You may not use this file except in compliance with the License."), (8, "This work is licensed under the GNU General Public License, version 3."), (None, "Released under the MIT License."), (9, "no " * 100000),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, licenses string")
    out = licenses.scan(df)
    got = {(r["doc_id"], r["licenses"]) for r in out.collect()}
    assert {(1, "Apache-2.0"), (2, "Apache-1.1"), (4, ""), (5, ""), (6, ""), (7, "MIT;CC-BY-NC-4.0"), (8, ""), (8, "GPL-3"), (None, "MIT"), (9, "")} <= got
    want, columns = run_oracle(licenses.ORACLE, documents=df.select("doc_id", "text").toArrow())
    assert sorted(repr(tuple(r)) for r in out.select(columns).collect()) == want
    assert licenses.scan(df.where("false")).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
APACHE_TEXT = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
BSD_TEXT = """Copyright (c) 2020, Jane Doe
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the University of Somewhere nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_published_licenses(spark):
    texts = {
        "MIT": MIT_TEXT, "Apache-2.0": APACHE_TEXT, "BSD-2-Clause": BSD_TEXT, "BSD-3-Clause": BSD_TEXT + BSD_NAMES, "GPL-3-or-later": GPL_TEXT.format("", 3),
        "LGPL-2.1-or-later": GPL_TEXT.format("Lesser ", 2.1), "AGPL-3-or-later": GPL_TEXT.format("Affero ", 3), "GPL-2": GPL_TEXT.format("", 2).replace("either ", "").replace(", or\n(at your option) any later version", ""),
        "CC-BY-SA-4.0": "This work is licensed under the Creative Commons\nAttribution-ShareAlike 4.0 International License.", "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not",
        "ISC": "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above",
    }
    tags = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0-or-later", "GPL-2.0": "GPL-2.0-only", "LGPL-2.1": "LGPL-2.1", "BSD-3-Clause": "BSD-3-Clause", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC0-1.0": "CC0-1.0", "ISC": "ISC"}
    narrow = {k: "\n".join(textwrap.wrap(t, 24)) for k, t in texts.items()}
    rows = [(k, wrap(t)) for k, t in texts.items() for wrap in (str, lambda t: t.replace("\n", " "), lambda t: "/*\n * " + t.replace("\n", "\n * ") + "\n */\nint main;")]
    rows += [(k, f"// SPDX-License-Identifier: {t}\nint x;") for k, t in tags.items()]
    rows += [(k, "\n".join(t.split())) for k, t in texts.items()]  # a word a line
    rows += [(k, t) for k, t in narrow.items()] + [("", "the terms of the MIT are short; the license of this is Apache"), ("MIT", "All code here is released under the MIT license unless noted")]
    df = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert [got[n] for n in range(len(rows))] == [k for k, _ in rows]


def test_op4_oracle(spark):
    got = queries.QUERIES["op4_warc"](spark, SMALL)
    want, columns = run_oracle(warc.ORACLE, pages=common.table(spark, SMALL, "pages").toArrow())
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == want


def test_pipeline(spark):
    """run() against its stages applied one row at a time, with a brute-force join."""
    docs, labels, bench = (common.table(spark, SMALL, n) for n in ("documents", "labels", "benchmark"))
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality_crf.train(docs, labels)
    rows = {i: t for i, t in rows.items() if quality_crf.score_texts(model, [t.encode()])[0][0] >= quality_crf.THRESHOLD}
    kept = docs.where(docs.doc_id.isin(list(rows)))
    model = toxicity.train(kept, labels)
    rows = {i: t for i, t in rows.items() if toxicity.score_texts(model, [t.encode()])[0, -1] < toxicity.THRESHOLD}
    from test_pairs import brute_jaccard

    rows = {i: rows[i] for i, _, c in brute_jaccard(sorted(rows.items())) if i == c}
    items = decontaminate._items([(r["item_id"], r["text"].encode()) for r in bench.collect()])
    finder = decontaminate.Finder(items)
    rows = {i: t for i, t in rows.items() if not decontaminate.contaminations(finder, [t.encode()])}
    enc = bpe.encoder(bpe.default_vocabulary())
    assert out == {i: len(enc.encode_packed([t])[0]) // 4 for i, t in rows.items()}
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "bpe"] and jaccard_join.WORDS == 5
