import io
import re
import struct
import zipfile

import pytest

from quire.functions import books as B
from quire.sources import books as S


def epub(encrypted=False, nav=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        if encrypted:
            z.writestr("META-INF/encryption.xml", "<x/>")
        items = '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b%20c.xhtml" media-type="x"/><item id="u" href="../../u" media-type="x"/><item id="gone" href="gone.xhtml" media-type="x"/>'
        items += '<item id="n" href="nav.xhtml" properties="nav" media-type="x"/>' if nav else '<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/>'
        z.writestr("O/p.opf", f'<package xmlns:dc="urn:d"><metadata><dc:title>Book</dc:title><dc:creator>Me</dc:creator></metadata><manifest>{items}</manifest><spine><itemref idref="a"/><itemref idref="n" linear="no"/><itemref idref="b"/><itemref idref="gone"/></spine></package>')
        z.writestr("O/a.xhtml", "<html><body><h1>H</h1><p>text one</p></body></html>")
        z.writestr("O/b c.xhtml", "<html><body><h2>Two</h2><p>more</p></body></html>")
        z.writestr("O/nav.xhtml", '<nav><ol><li><a href="a.xhtml#x">First</a></li></ol></nav>')
        z.writestr("O/t.ncx", '<ncx><navMap><navPoint><navLabel><text>Label</text></navLabel><content src="a.xhtml"/></navPoint></navMap></ncx>')
    return out.getvalue()


def mobi(text: bytes):
    head = bytearray(78)
    head[0:5] = b"A_Ttl"
    head[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", head, 76, 2)
    first = struct.pack(">HHIHH", 2, 0, len(text), 1, 4096) + b"\0" * 4
    at = 78 + 16
    entries = struct.pack(">II", at, 0) + struct.pack(">II", at + len(first), 1)
    return bytes(head) + entries + first + text


PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nstream\nBT (Hello \\(x\\)) Tj [(wor) -20 (ld)] TJ ET\nendstream\nendobj"


def test_detection_and_decoding():
    assert [B.detect(x) for x in (epub(), b"PK\x03\x04zz", PDF, mobi(b""), b'{"a":1}', b"<?xml?><rss/>", b"<!DOCTYPE html>", b"text", b"")] == ["epub", "zip", "pdf", "mobi", "json", "feed", "html", "text", "text"]
    assert B.decode("é".encode()) == ("é", "utf-8") and B.decode("第一章".encode("gbk"))[0] == "第一章"
    assert B.decode(b"\xff\xfea\0") == ("a", "utf-16-le") and B.decode(b"\xef\xbb\xbfa") == ("a", "utf-8")
    with pytest.raises(ValueError):
        B.decode(b"\xff\xff\xff")


def test_chapters():
    text = "开头\n第1章 甲\nx\n\n第二章 乙\ny\nChapter 3\nz"
    assert B.split_chapters(text) == [("序章", "开头"), ("第1章 甲", "x"), ("第二章 乙", "y"), ("Chapter 3", "z")]
    assert B.split_chapters(text, re.compile("^第")) == [("第1章 甲", "x"), ("第二章 乙", "y\nChapter 3\nz")]
    assert B.split_chapters("no headings") == [("正文", "no headings")]
    long = "é" * 20_000
    parts = B.split_chapters(long)
    assert parts == [("第1章(1)", long)]  # a piece ends at a line's end
    lines = "".join(f"line {k} {'x' * 90}\n" for k in range(1000))
    spans = B.chapter_spans(lines)
    assert [t for t, *_ in spans][:2] == ["第1章(1)", "第2章(1)"] and all(lines[a:e].strip("\n") == c for _, c, a, e in spans)
    assert spans[0][2] == 0 and spans[-1][3] == len(lines) and all(x[3] == y[2] for x, y in zip(spans, spans[1:]))
    assert all(B.CHUNK < len(lines[a:e].encode()) <= B.CHUNK + 100 for _, _, a, e in spans[:-1]) and all(c.count("line") for _, c, _, _ in spans)
    short = "y" * 10_300 + "\n" + "tail"
    assert B.split_by_size(short) == [("第1章(1)", "y" * 10_300 + "\ntail", 0, len(short))]
    assert B.chapter_spans(text)[1] == ("第1章 甲", "x", 3, 12) and text[3:12] == "第1章 甲\nx\n\n"
    assert B.split_by_marker("A\n1#B\n2# ", "#") == [("A", "1"), ("B", "2")]
    assert B.merge_short([("a", "x" * 200), ("b", "y")], 100) == [("a", "x" * 200 + "\nb\ny")]
    assert [t for t, _ in B.greedy_matches("#1" + "é" * 600 + "#2aa#3", re.compile(r"#\d"))] == ["#1", "#2"]


def test_numbers():
    assert [B.chinese_number(s) for s in ("十二", "一百零五", "二〇二四", "三千", "１２", "两万三", "x", "")] == [12, 105, 2024, 3000, 12, 20003, None, None]
    assert B.number_chapter("第十二章 始") == "第12章 始" and B.number_chapter("第x章") == "第-1章"


def test_packages():
    b = B.read_book(epub(), "dir/name.epub")
    assert (b["title"], b["author"], b["format"]) == ("Book", "Me", "epub")
    assert b["chapters"] == [("First", "H text one"), ("Two", "Two more")]
    assert b["diagnostics"] == ["unsafe path ../../u", "missing gone"]
    assert B.read_book(epub(nav=False))["chapters"][0][0] == "Label"
    assert B.read_book(epub(encrypted=True))["diagnostics"] == ["encrypted"]
    assert B.read_book(b"PK\x03\x04META-INF/container.xml")["diagnostics"][0].startswith("unreadable")
    m = B.read_book(mobi(b"Hello\x80\x28 wor" + bytes([0xC0 | ord("l")]) + b"\x01d"))
    assert m["format"] == "mobi" and m["title"] == "A Ttl" and "Hello" in m["chapters"][0][1]
    assert B.palmdoc(b"abc\x80\x18") == b"abcabc"
    assert B.read_book(PDF)["chapters"] == [("", "Hello (x)\nworld")]
    assert B.read_book(b"%PDF-1.4")["diagnostics"] == ["no text"]


RSS = "<rss><channel><title>F</title><link>http://f</link><item><title>A</title><guid>1</guid><description>s</description><pubDate>d</pubDate></item><item><title>B</title><link>l</link></item><item><title>A2</title><guid>1</guid></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><id>1</id><title>A</title><link rel="self" href="s"/><link rel="alternate" href="a"/><author><name>N</name></author><updated>u</updated><published>p</published></entry></feed>'


def test_feeds():
    f = B.parse_feed("﻿" + RSS)
    assert (f["title"], f["link"]) == ("F", "http://f") and [(e["id"], e["title"], e["published_at"]) for e in f["entries"]] == [("1", "A", "d"), ("l", "B", None)]
    e = B.parse_feed(ATOM)["entries"][0]
    assert (e["id"], e["link"], e["author"], e["published_at"]) == ("1", "a", "N", "u")
    assert B.parse_feed('{"feed_url":"u","items":[{"id":"1","title":"T"},{"id":"1"}]}')["entries"][0]["title"] == "T"
    for bad in ("", "text", "<html/>", "{broken", "<rss>"):
        with pytest.raises(ValueError):
            B.parse_feed(bad)


def test_request_rules():
    r = B.parse_url_rule("/s?q={{key}},{'method':'post', body: \"k={{key}}\", headers: {A: 1}}")
    assert (r["url"], r["method"], r["body"], r["headers"]) == ("/s?q={{key}}", "POST", "k={{key}}", '{"A": "1"}')
    assert B.parse_url_rule("/a,{broken")["url"] == "/a,{broken" and B.parse_url_rule("/a@js:x")["script"] == "x"


def test_sources(spark, rows, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.txt").write_bytes("第1章 甲\r\nx\r\n第2章 乙\r\ny".encode("gbk"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xff\xff")
    out = {(r.path.rsplit("/", 1)[1], r.chapter_index): (r.title, r.chapter_title, r.content) for r in S.read_books(spark, str(tmp_path)).collect()}
    assert out["a.epub", 0] == ("Book", "First", "H text one") and out["b.txt", 1] == ("b", "第2章 乙", "y")
    assert out["c.txt", None] == ("c", None, None)
    df = spark.createDataFrame([(1, RSS, "c"), (2, None, "c"), (3, "", "c"), (4, "no feed", "c")], "k bigint, x string, title string")
    got = [(r.k, r.pos, r.id, r.error is None) for r in S.feed_entries(df, "k", "x").orderBy("k", "pos").collect()]
    assert got == [(1, 0, "1", True), (1, 1, "l", True), (4, None, None, False)]
    assert S.chapters(df, "k", "x", marker="<item>").filter("k = 1").count() == 4
    assert rows(S.requests(df, "k", "title").select("k", "url").distinct()) == [(k, "c") for k in (1, 2, 3, 4)]
    assert S.feed_entries(df.limit(0), "k", "x").count() == 0


@pytest.mark.parametrize("line, want", [(x, True) for x in ("第一部 起", "第二篇", "【第一章 开端】", "序章", "楔子", "番外 一", "Prologue", "CHAPTER IV: x", "chapter 12", "第壹卷", "《尾声》")] + [(x, False) for x in ("第 章", "番外" + "x" * 21, "chapters of", "Chapter", "序章 x", "第一章" + "x" * 60, "", "Civil war")])
def test_the_wider_sense_of_a_heading(line, want):
    assert B.is_book_heading(line) == want


def test_plain_texts_with_titles():
    text = "\ufeffBook\r\n\r\nbefore\r\n序章\r\na \r\n\r\n第一部 起\r\nb"
    assert B.read_text(text) == ("Book", [("序", "before"), ("序章", "a"), ("第一部 起", "b")])
    assert B.read_text("第一章\nx") == ("", [("第一章", "x")]) and B.read_text("only") == ("only", []) and B.read_text("t\nbody") == ("t", [("正文", "body")])
    assert B.read_text("t\n第一章\n" + "x" * 200 + "\n第二章\ny", least=100)[1] == [("第一章", "x" * 200 + "\n第二章\ny")]
    tree = [{"title": "A", "href": "a", "children": [{"title": "B", "href": "b", "children": [{"title": "C"}]}]}, {"title": "D"}]
    assert [(x["title"], x["level"], x["place"]) for x in B.flatten_toc(tree)] == [("A", 0, 0), ("B", 1, 1), ("C", 2, 2), ("D", 0, 3)]
    assert [B.resource_kind(*x) for x in (("i.png", "image/png"), ("c.css", ""), ("f.x", "application/font-woff"), ("p.xhtml", ""), ("z.bin", "")) ] == ["image", "stylesheet", "font", "document", "other"]
    assert B.resource_kind("i.png", "image/png", True) == "cover" and B.preview("<p>a <b>b</b></p><script>x</script>", 2) == "a "[:2]


def test_feed_pages_and_items(spark):
    from quire.functions.text import ReplaceRule
    from quire.sources import books as S

    rss = "<rss><channel><title>f</title><link rel='next' href=' /p2 '/><item><guid>1</guid><title> A x </title></item><item><guid>1</guid><title>B</title></item><item><guid>2</guid><title>C</title></item></channel></rss>"
    js = '{"title":"j","next_url":"u2","items":[{"id":"a","title":"x"},{"id":"a","title":"y"}]}'
    df = spark.createDataFrame([(1, rss, "/p1"), (2, rss, "/p2"), (3, js, None), (4, "no feed", None), (5, None, None), (6, "<rss><channel><item><link/></item></channel></rss>", None)], "k int, x string, u string")
    assert {r.k: (r.entries, r.next_url) for r in S.feed_pages(df, "k", "x", "u").collect()} == {1: (2, "/p2"), 2: (2, None), 3: (1, "u2")}
    assert sorted((r.k, r.pos) for r in S.feed_entries(df, "k", "x", all_items=True).filter("error is null").collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1)]
    assert {r.k for r in S.feed_entries(df, "k", "x").filter("error is not null").collect()} == {4, 6}
    items = S.feed_items(df, "k", "x", [ReplaceRule("X", "y", flags="i")], most=1)
    assert {r.k: (r.id, r.title) for r in items.collect()} == {1: ("1", "A y"), 2: ("1", "A y"), 3: ("a", "y")}
    assert [tuple(r)[1:3] for r in S.book_texts(spark.createDataFrame([(1, "T\\n序章\\na".replace("\\n", chr(10))), (2, "T"), (3, None)], "k int, t string"), "k", "t").collect()] == [("T", 0), ("T", None)]
