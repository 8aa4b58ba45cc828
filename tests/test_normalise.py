import hmac

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import normalise as N


@pytest.mark.parametrize(
    "raw, want",
    [
        ("&#39;&#x4e2d;&lsquo;x&rsquo;", "'中‘x’"), ("&amp;lt; &#38;lt;", "&lt; &lt;"), ("a & b; &lt;", "a & b; <"), ("&nope; &thinsp;.", "&nope; ."),
        ("&#xD800; &#1114112; &#;", "&#xD800; &#1114112; &#;"), ("no end &lt", "no end &lt"), ("", ""), (None, None),
    ],
)
def test_entities(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(T.decode_entities(F.col("t"))).first()[0] == want
    assert raw is None or N.decode_entities(raw) == want


def test_fragments_and_content(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(T.format_fragment, "<p>a<b>b</b></p><!-- x --><img alt='y' data-src='/u.png'> 1 <> 2 <DIV>&nbsp;z&#39;</div><img>") == "ab\n<img src=\"/u.png\"> 1 <> 2\nz'"
    assert one(T.extracted_content, "\ufeffx\r\n\r\n\r\n\r\ny &lt; z\n") == "x\n\ny < z"
    assert one(T.extracted_content, "<p>x</p>\n\n\n<p>y</p>") == "x\ny"
    assert one(T.unwrap_json, " <script class='t'>[1,2]</script>") == "[1,2]" and one(T.unwrap_json, "[1]") == "[1]"
    parts = one(T.url_parts, "HTTPS://u:p@Ex.test:8080/a/b?x=1&y#f")
    assert tuple(parts) == ("https", "ex.test", 8080, "/a/b", "x=1&y", "f") and one(T.url_parts, "http://a.test").path == "/" and one(T.url_parts, "x").host is None


def test_functions():
    assert N.normalise("﻿é\r\n\n\n\nｂ&nbsp;&#65;&amp;lt;\n", half_width=True, entities=True) == "é\n\nb A&lt;"
    assert N.normalise("  a \n b ", squeeze=True) == "a b" and N.normalise("萬書", script="t2s") == "万书" and N.normalise("万书", script="s2t") == "萬書"
    assert N.decode_entities("&zz; &#65; &#xD800; &#x110000; &") == "&zz; A &#xD800; &#x110000; &"
    assert N.without_title("书名 第1章 甲\n正文", "书名", "第1章甲") == "正文"
    assert N.without_title("Chapter 1\nx", "", "Chapter 1") == "x" and N.without_title("Chapter 12 x", "", "Chapter 1") == "Chapter 12 x" and N.without_title("T", "", "T") == ""


def test_operators(spark):
    df = spark.createDataFrame([(1, "B", "T", "T\n\np1 \n\n\n\np2", 9), (2, None, None, None, 9), (3, "B", "T", "T", 9), (1, "B", "T", "T\n\np1 \n\n\n\np2", 9)], "k bigint, book string, title string, text string, n_chars int")
    got = {r.k: (r.content, r.paragraphs, r.valid) for r in N.chapter_documents(df, "k", "book", "title", "text").collect()}
    assert got == {1: ("p1\n\np2", ["p1", "p2"], True), 2: ("", [], False), 3: ("", [], False)}
    n = {r.k: (r.text, r.n_chars) for r in N.normalise_texts(df, "k", "text").collect()}
    assert n[2] == (None, None) and n[3] == ("T", 1)
    assert N.normalise_texts(df.limit(0), "k", "text").count() == 0
    h = {r.k: r.digest for r in df.select("k", T.hmac_digest(F.col("book"), "key", "md5").alias("digest")).collect()}
    assert h[2] is None and h[1] == hmac.new(b"key", b"B", "md5").hexdigest()
    long = "k" * 200
    assert df.select(T.hmac_digest(F.col("book"), long, "SHA-512")).first()[0] == hmac.new(long.encode(), b"B", "sha512").hexdigest()
    assert df.select(T.hmac_digest(F.col("book"), "key", "none")).first()[0] == "" and df.select(T.fnv1a64(F.lit("hello"))).first()[0] == "a430d84680aabd0b"
    d = {r.k: r.digest for r in N.rare_digest(df.withColumn("book", F.lit("abc")), "k", "book").collect()}
    assert d[1] in ("", "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0")
    assert {r.digest for r in N.rare_digest(df, "k", "book", "no such").collect()} == {"", None}
