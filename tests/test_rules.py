import pytest

from quire.functions import dom, jsonpath
from quire.operators import extract as X
from quire.plans import rules as R

BOOKS = {
    "total": 3,
    "results": [
        {"id": 1, "title": "A", "tags": ["x", "y"], "meta": {"year": 2001, "rating": 4.5}},
        {"id": 2, "title": "B", "tags": ["z"], "meta": {"year": 2011, "rating": 3.5}},
        {"id": 3, "title": "c", "tags": [], "meta": {"year": 1999, "rating": 5}},
    ],
    "a.b": {"k": None},
}


@pytest.mark.parametrize(
    "path, want",
    [
        ("$.results[*].title", ["A", "B", "c"]),
        ("$..year", ["2001", "2011", "1999"]),
        ("$['a.b'].k", ["null"]),
        ("$.results[-1].title", ["c"]),
        ("$.results[7].title", []),
        ("$.results[0,2].id", ["1", "3"]),
        ("$.results[::-1].id", ["3", "2", "1"]),
        ("$.results[1:].id", ["2", "3"]),
        ("$.total.x", []),
        ("$.results[?(@.meta.year > 2000)].title", ["A", "B"]),
        ("$.results[?(@.title =~ /^[ab]/i)].id", ["1", "2"]),
        ("$.results[?(@.title != 'A')].id", ["2", "3"]),
        ("$.results[?(@.missing != 'A')].id", []),
        ("$.results[?(@.tags anyof ['x','z'])].id", ["1", "2"]),
        ("$.results[?(@.tags noneof ['x','z'])].id", ["3"]),
        ("$.results[?(@.tags subsetof ['x','y','q'])].id", ["1", "3"]),
        ("$.results[?(@.tags size 2)].id", ["1"]),
        ("$.results[?(@.tags empty)].id", ["3"]),
        ("$.results[?(@.id in [1,3] && !(@.id == 1))].id", ["3"]),
        ("$.results[?(@.id nin [1,3] || @.title == 'c')].id", ["2", "3"]),
        ("$.results[?(@.id == $.total)].id", ["3"]),
        ("$.results.length()", ["3"]),
        ("$.results.first().id", ["1"]),
        ("$.results[*].title.last()", ["c"]),
        ("$..rating.sum()", ["13.0"]),
        ("$..rating.min()", ["3.5"]),
        ("$..rating.max()", ["5.0"]),
        ("$..title.sum()", []),
        ("$.keys()", ["a.b", "results", "total"]),
        ("$.results[0].meta.values()", ["4.5", "2001"]),
        ("$.results[*].title.concat('!')", ["ABc!"]),
        ("$.results[1].tags.append('q')", ['["z","q"]']),
        ("$.none||$.total", ["3"]),
        ("$.results[*].id%%$.results[*].title", ["1", "A", "2", "B", "3", "c"]),
        ("$.total&&$.results[0].id", ["3", "1"]),
        ("{$.total} items", ["3 items"]),
    ],
)
def test_jsonpath(path, want):
    assert jsonpath.evaluate(path, BOOKS) == want


@pytest.mark.parametrize("path", ["results", "$.", "$.a[", "$[0:1:0]", "$.a[?(@.b", "$.a b", "$['x"])
def test_bad_paths(path):
    with pytest.raises(ValueError):
        jsonpath.parse(path)


PAGE = dom.parse_html(
    '<main><article class="book featured"><a class="book-link" href="/1" data-id=7><span class="t">A <em>b</em>&nbsp;c</span></a><p>one<p>two<br>three</article>'
    '<article class=book><a class="book-link"><span class=t>Z</span></a><script>var x="</p>"</script></article><ul><li>1<li>2<li>3</ul><!-- note --></main>'
)


@pytest.mark.parametrize(
    "css, want",
    [
        ("article.book a.book-link[href]", ["A b c"]),
        ("li:eq(1)", ["2"]),
        ("li:eq(-1)", ["3"]),
        ("li:lt(1), li:gt(1)", ["1", "3"]),
        ("li:nth-child(odd)", ["1", "3"]),
        ("li:nth-child(2n+2)", ["2"]),
        ("li:not(:first-child)", ["2", "3"]),
        ("article:has(a[href]) .t", ["A b c"]),
        ("article:not(.featured) .t", ["Z"]),
        ("p:contains(TWO)", ["two three"]),
        ("span:containsOwn(b)", []),
        ("p:matches(^t)", ["two three"]),
        ("li + li", ["2", "3"]),
        ("li:first-child ~ li", ["2", "3"]),
        ("main > ul > li:last", ["3"]),
        ("a[data-id='7']", ["A b c"]),
        ("[class^=book]", ["A b c one two three", "A b c", "Z", "Z"]),
        ("script:containsData(VAR)", ['var x="</p>"']),
    ],
)
def test_css(css, want):
    assert [n.text() if n.tag != "script" else n.raw_text() for n in dom.query(PAGE, css)] == want


@pytest.mark.parametrize(
    "path, want",
    [
        ("//article/@class", ["book featured", "book"]),
        ("//li[2]/text()", ["2"]),
        ("//li[last()]", ["3"]),
        ("//li[last()-1]", ["2"]),
        ("//a[@href]/span//text()", ["A ", "b", "\xa0c"]),
        ("//article[contains(@class,'featured')]//em", ["b"]),
        ("count(//li)", ["3"]),
        ("//li[position()<3]", ["1", "2"]),
        ("normalize-space(//span)", ["A b c"]),
        ("//li | //em", ["1", "2", "3", "b"]),
        ("//a[@data-id='7' and @href='/1']/@href", ["/1"]),
        ("//li[not(.='2')]", ["1", "3"]),
        ("//em/..", ["A b\xa0c"]),
        ("//li[1]/following-sibling::li", ["2", "3"]),
        ("//nothing", []),
    ],
)
def test_xpath(path, want):
    assert dom.xpath(PAGE, path) == want


def test_html_out_and_broken_input():
    assert dom.query(PAGE, "ul")[0].outer_html() == "<ul><li>1</li><li>2</li><li>3</li></ul>"
    assert dom.query(PAGE, "p")[1].inner_html() == "two<br>three"
    deep = dom.parse_html("<div>" * 3000 + "x")
    assert deep.text() == "x"
    for bad in ("", "<", "</p>", "<!-- open", "a & b <"):
        dom.parse_html(bad).text()
    for bad in ("a[", ":nope", "", "a:not(b"):
        with pytest.raises(ValueError):
            dom.query(PAGE, bad)


DOC = R.Document('<div class="list main"><a href="/1" class="x y"><b>One</b></a><a href="/2" class="x"><b>Two</b></a></div><p id="intro">In: text 12</p>')


@pytest.mark.parametrize(
    "rule, want",
    [
        ("class.x@text", ["One", "Two"]),
        ("class.x y@href", ["/1"]),
        ("tag.a.-1@text", ["Two"]),
        ("tag.a.9@text", []),
        ("id.intro@text##\\d+##N", ["In: text N"]),
        ("id.intro@text##(\\d+)##<$1>###", ["<12>"]),
        ("id.intro@text##nope##x###", [""]),
        ("id.intro@text##(##x", ["In: text 12"]),
        ("@css:.x b@text", ["One", "Two"]),
        ("//a/@href", ["/1", "/2"]),
        ("class.none@text||tag.b@text", ["One", "Two"]),
        ("tag.a@href&&tag.b@text", ["/1", "/2", "One", "Two"]),
        ("tag.a@href%%tag.b@text", ["/1", "One", "/2", "Two"]),
        ("class.list@tag.a.0@html", ['<a href="/1" class="x y"><b>One</b></a>']),
        ("tag.b@text<js>upper</js>", ["ONE", "TWO"]),
        ('@put:{"k":"v"}tag.b@text', ["One", "Two"]),
    ],
)
def test_raw_rules(rule, want):
    assert R.compile_rule(rule).run(DOC) == want


def test_modes_scripts_variables_and_completion():
    assert [R.mode_of(r)[0] for r in ("@css:a", "@@a", "@XPath://a", "@json:$.a", "$.a", "$[0]", "/a", "a")] == ["css", "css", "xpath", "json", "json", "json", "xpath", "css"]
    with pytest.raises(R.Unsupported):
        R.compile_rule("tag.b@text@js:java.ajax(x)").run(DOC)
    scope = {}
    j = R.Document('{"a":{"t":"x"},"x":9}')
    assert R.compile_rule('@put:{"n":"$.a.t"}$.x').run(j, scope) == ["9"] and scope == {"n": "x"}
    assert R.compile_rule("$.@get:{n}").run(j, scope) == ["9"]
    assert R.substitute("u/{{$.a.t}}/{{page}}/{{other}}", {"page": "2"}, j) == "u/x/2/{{other}}"
    assert [R.complete(r, k) for r, k in (("class.x", "text"), ("//a", "href"), ("$.a", "text"), ("tag.a||tag.b", "src"), ("a@href", "text"), ("a##x", "text"))] == ["class.x@text", "//a/@href", "$.a", "tag.a@src||tag.b@src", "a@href", "a##x"]


def test_chains():
    c = R.compile_steps([{"kind": "css", "selector": "a"}, {"kind": "regexExtract", "pattern": r"(\w)(\w+)", "group": 2}])
    assert c.run(DOC) == ["ne", "wo"]
    assert R.compile_steps([{"kind": "css", "selector": "i"}, {"kind": "fallback", "values": ["none"]}]).run(DOC) == ["none"]
    assert R.compile_steps([{"kind": "css", "selector": "i"}, {"kind": "css", "selector": "b"}]).run(DOC) == []
    assert R.compile_steps([{"kind": "regexReplace", "pattern": "(?P<a>O)ne", "replacement": "${a}$$1", "first": True}]).run(R.Document("One One")) == ["O$1 One"]
    for bad in ([{"kind": "regexExtract", "pattern": "(a)", "group": 2}], [{"kind": "regexReplace", "pattern": "a", "replacement": "$x"}], [{"kind": "what"}], [{"kind": "jsonPath", "path": "x"}], [{"kind": "css", "selector": "a["}]):
        with pytest.raises(ValueError):
            R.compile_steps(bad)


def test_operators(spark, rows):
    df = spark.createDataFrame([(1, DOC.text, "z"), (1, DOC.text, "z"), (2, None, "z"), (3, "", "z"), (4, "{broken", "z")], "k bigint, t string, b string")
    out = X.extract(df, "k", "t", {"b": "tag.b@text", "j": "$.a"})
    assert rows(out) == sorted([(1, ["One", "Two"], [])] * 2 + [(2, [], []), (3, [], []), (4, [], [])], key=str)
    with pytest.raises(ValueError):
        X.extract(df, "k", "t", {"k": "a@text"})
    with pytest.raises(ValueError):
        X.extract(df, "k", "t", {"x": "$.["})
    found = X.items(df, "k", "t", "-class.x", {"name": "tag.b", "url": ("tag.a", "href"), "tpl": "u/{{n}}"}, {"n": "5"})
    assert rows(found.filter("k = 1").distinct()) == [(1, 0, "Two", "/2", "u/5"), (1, 1, "One", "/1", "u/5")]
    js = spark.createDataFrame([(1, '[{"title":"A","u":"/a"},{"title":" "}]')], "k bigint, t string")
    assert rows(X.items(js, "k", "t", None, {"title": "title", "u": "$.u"})) == [(1, 0, "A", "/a"), (1, 1, None, None)]
    assert X.items(df.limit(0), "k", "t", None, {"title": "title"}).count() == 0


def test_pages_and_pairs(spark, rows):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", " "), ("x", None)], "url string, next_url string")
    start = spark.createDataFrame([(1, "a"), (2, "x"), (3, ""), (4, "none"), (1, "c")], "key int, url string")
    walked = {(r.key, r.step, r.url) for r in X.follow_pages(start, pages).collect()}
    assert walked == {(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 0, "c"), (1, 1, "a"), (1, 2, "b"), (2, 0, "x")}
    assert X.follow_pages(start, pages, most=2).count() == 5
    v = spark.createDataFrame([(["t", "u", "v", "w", "odd"],), ([],)], "v array<string>").select(X.flat_pairs(F.col("v")).alias("p"))
    assert [[tuple(x) for x in r.p] for r in v.collect()] == [[(0, "t", "u"), (1, "v", "w")], []]
    base = spark.createDataFrame([(1, "old", "x"), (2, "old", "y")], "k int, title string, other string")
    new = spark.createDataFrame([(1, "new")], "k int, title string")
    assert rows(X.merge_fields(base, new, "k", ["title"])) == [(1, "new", "x"), (2, "old", "y")]
