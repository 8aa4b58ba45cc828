import pytest

from quire.plans.rules import Document, compile_rule
from quire.plans.scripts import Unsupported, evaluate, text


@pytest.mark.parametrize(
    "source, value, want",
    [
        ("result", "a", "a"),
        ("result.trim().replace(/(\\d+)/g, '<$1>')", " a1 b22 ", "a<1> b<22>"),
        ("'https://x.test/' + result.split('-')[1] + '?p=' + (1 + 2)", "a-b-c", "https://x.test/b?p=3"),
        ("var m = result.match(/id=(\\d+)/); m ? m[1] : 'none'", "x?id=42", "42"),
        ("let m = result.match(/id=(\\d+)/)\nm ? m[1] : 'none'", "x", "none"),
        ("JSON.parse(result).data.list[1].name", '{"data":{"list":[{"name":"a"},{"name":"b"}]}}', "b"),
        ("JSON.parse(result).list.join('|')", '{"list":[1,2.5,"x"]}', "1|2.5|x"),
        ("java.md5Encode(result)", "abc", "900150983cd24fb0d6963f7d28e17f72"),
        ("java.md5Encode16(result)", "abc", "3cd24fb0d6963f7d"),
        ("java.base64Decode(java.base64Encode(result))", "é 中", "é 中"),
        ("java.HMacHex(result, 'HmacSHA256', 'key')", "The quick brown fox jumps over the lazy dog", "f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8"),
        ("java.timeFormatUTC(1713106400000, 'yyyy-MM-dd HH:mm:ss', 0)", "", "2024-04-14 14:53:20"),
        ("java.toNumChapter(result)", "第十二章 x", "第12章 x"),
        ("encodeURIComponent(result)", "a b/中", "a%20b%2F%E4%B8%AD"),
        ("result.length > 3 && result != 'abcd' ? 'long' : 'short'", "abcde", "long"),
        ("result || 'empty'", "", "empty"),
        ("parseInt(result) * 10 % 7", "12px", "1"),
        ("result.substring(1, 3) + result.slice(-2)", "abcdef", "bcef"),
        ("/^a/.test(result) ? 1 : 0", "abc", "1"),
        ("a = result.toUpperCase(); return a + '!'; ignored", "x", "X!"),
        ("'it\\'s \\u4e2d'", "", "it's 中"),
    ],
)
def test_scripts(source, value, want):
    assert text(evaluate(source, value)) == want


@pytest.mark.parametrize("source", ["java.ajax(result)", "for (;;) {}", "function f() {}", "new Date()", "eval('1')", "result.constructor('x')", "unknown", "", "a b", "result.map(x => x)", "__import__('os')", "(" * 5000])
def test_what_the_language_has_not(source):
    with pytest.raises(Unsupported):
        evaluate(source, "x")


def test_failing_values():
    for source in ("JSON.parse(result)", "result.match(/z/)[0]", "JSON.parse('{}').a.b"):
        with pytest.raises(ValueError):
            evaluate(source, "x")


def test_scripts_in_rules():
    run = lambda rule, s, scope=None: compile_rule(rule).run(Document(s), scope)
    page = "<p> <b>hi</b> </p><p>no</p>"
    assert run("tag.p@html<js>trim</js>tag.b@text", page) == ["hi"]  # a selector after a script
    assert run("tag.p@text@js:result.trim() + '!'", page) == ["hi!", "no!"]
    assert run("tag.p@text<js>JSON.parse(result)</js>", "<p>1</p><p>x</p>") == ["1"]  # a failing value is dropped
    assert run("<js>result.length</js>", "abc") == ["3"]
    assert run("tag.p@text<js>result.trim()</js>##h##H", page) == ["Hi", "no"]
    assert run("p:contains({{'h' + 'i'}})@text", page) == ["hi"]
    assert run("$.a<js>result + 1</js>", '{"a": "x"}') == ["x1"]
    with pytest.raises(Unsupported):
        run("tag.p@text@js:java.ajax(result)", page)
    with pytest.raises(ValueError, match="undeclared prefix"):
        compile_rule("//r:book/text()")
