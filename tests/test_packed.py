import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import packed


def split(f, xs):
    p, k, v = f(pa.array(xs, pa.large_string()))
    out = [[] for _ in xs]
    for i, j, s in sorted(zip(p.tolist(), k.tolist(), v.to_pylist())):
        assert j == len(out[i])
        out[i].append(s)
    return out


@pytest.mark.parametrize(
    "text, want",
    [
        ("小说,悬疑", ["小说", "悬疑"]),
        (' Light Novel , "R&D Picks"；a', ["Light Novel", "R&D Picks", "a"]),
        ("小说 书库", ["小说", "书库"]),
        ('小说　"男频/女频"  x', ["小说", "男频/女频", "x"]),
        ('"Say ""Hi""" 儿童', ['Say "Hi"', "儿童"]),
        ("“News, Daily”&é", ["News, Daily", "é"]),
        ("a\nb c\td", ["a", "b c", "d"]),
        ('""', []),
        ("、 ", []),
        ("", []),
        (None, []),
        ('a "b', ["a", '"b']),
        ('"Audio Book"', ["Audio Book"]),
        ("a,,a", ["a", "a"]),
        ("，".join(["x"] * 3), ["x"] * 3),
    ],
)
def test_list(text, want):
    assert split(packed.split_list, [text, "z", text]) == [want, ["z"], want]


@pytest.mark.parametrize(
    "text, want",
    [
        ("A::/a && B :: /b", ["A::/a", "B::/b"]),
        ("A::/a\r\n\r\nB", ["A::/a", "B"]),
        ("A\\nB::/b", ["A", "B::/b"]),
        ('"A\nx"::/a&&"C::d"', ["A\nx::/a", "C::d"]),
        ('"q ""x"" r"::/u', ['q "x" r::/u']),
        ('T::/c,{"method":"POST","body":"a&&b"}&&U::', ['T::/c,{"method":"POST","body":"a&&b"}', "U"]),
        ('[{"title":" T ","url":"/u"},{"title":"V","url":""},{"title":"W"}]', ["T::/u", "V", "W"]),
        ("[{title: \"T\", url: \"/u\"},\n{'title':'V','url':'/v'},]", ["T::/u", "V::/v"]),
        ("[New]::/n\nB", ["[New]::/n", "B"]),
        ("@js: x", []),
        (" <js>\nx</js>", []),
        ("Crime & Co::/c", ["Crime & Co::/c"]),
        (None, []),
        ("  \n", []),
    ],
)
def test_entries(text, want):
    assert split(packed.split_entries, ["P", text]) == [["P"], want]


def test_lenient_depth_and_errors():
    deep = "[" * 5000 + "]" * 5000
    assert packed.objects(deep) is not None
    for bad in ("[{a}", "nonsense", "[1]]", "{1:"):
        with pytest.raises(ValueError):
            packed.lenient(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='ab,;"“” 　\n、é𝄞', max_size=30), max_size=8))
def test_rows_do_not_touch_each_other(xs):
    """A batch gives what each value gives by itself, and nothing is lost but marks and blanks."""
    together = split(packed.split_list, xs)
    assert together == [split(packed.split_list, [x])[0] for x in xs]
    for x, items in zip(xs, together):
        for i in items:
            assert i == i.strip() and i


def test_round_trip_of_quoted_items():
    items = ["a,b", "c d", 'e"f', "g"]
    text = ",".join('"' + i.replace('"', '""') + '"' for i in items)
    assert split(packed.split_list, [text])[0] == items


def test_operator(spark, rows):
    long = ",".join(str(i) for i in range(50_000))
    df = spark.createDataFrame([(1, "a,b", None, 7), (1, "a,b", None, 7), (2, None, None, 7), (3, long, "T::/u", 7)], "rec_id bigint, g string, e string, pos int")
    out = packed.split_packed(df, "rec_id", {"g": "list", "e": "entries"})
    assert out.columns == ["rec_id", "field_name", "pos", "item"]
    got = rows(out.filter("rec_id < 3"))
    assert got == [(1, "g", 0, "a"), (1, "g", 0, "a"), (1, "g", 1, "b"), (1, "g", 1, "b")]
    assert out.filter("rec_id = 3 and field_name = 'g'").count() == 50_000
    assert packed.split_packed(df.limit(0), "rec_id", {"g": "list"}).count() == 0


def read_alone(s):
    """Entries of one value in an object notation, parsed by itself; None if it is none."""
    return packed.objects(s)


def test_object_notations_by_masks_equal_values_parsed_alone():
    rng = random.Random(7)
    words = ["a", "title", "url", "中 x", "q\"q", "s's", "b\\\\", "\u00e9\n", "", " t ", "::", "[x]", "{y}", "a,b", "https://x.test/?a=1&b={{page}}", "😀"]

    def value(depth=0):
        k = rng.randrange(9 if depth < 3 else 6)
        if k < 4:
            return rng.choice(words)
        if k < 6:
            return rng.choice([None, True, 12, -3, 1.5, 10**20, 0])
        if k < 8:
            return {rng.choice(["title", "url", "style", "t", "Title"]): value(depth + 1) for _ in range(rng.randrange(4))}
        return [value(depth + 1) for _ in range(rng.randrange(3))]

    def lax(v):
        if isinstance(v, dict):
            return "{" + ",".join(f"{k if rng.random() < 0.5 else json.dumps(k)}: {lax(x)}" for k, x in v.items()) + rng.choice(["}", ",}"] if v else ["}"])
        if isinstance(v, list):
            return "[" + " ,\n".join(map(lax, v)) + rng.choice(["]", ",]"] if v else ["]"])
        return json.dumps(v, ensure_ascii=rng.random() < 0.5)

    texts = []
    for _ in range(4000):
        v = [{"title": rng.choice(words), "url": rng.choice([*words, None, 5])} if rng.random() < 0.8 else value() for _ in range(rng.randrange(4))] if rng.random() < 0.8 else value()
        s = json.dumps(v, ensure_ascii=rng.random() < 0.5) if rng.random() < 0.5 else lax(v)
        if rng.random() < 0.2:
            s = s.replace("'", " ").replace('"', "'")
        if rng.random() < 0.3 and s:  # broken somewhere
            k = rng.randrange(len(s))
            s = s[:k] + rng.choice(["", "\\", '"', "{", "}", ",", ":", "\u3000", "\x01", "'"]) + s[k + rng.randrange(2) :]
        if s[:1] in ("[", "{"):
            texts.append(s)
    column = pa.array(texts, pa.large_string())
    good, parent, place, items = packed.split_objects(column)
    got = [[] for _ in texts]
    for r, k, x in zip(parent.tolist(), place.tolist(), items.to_pylist()):
        assert k == len(got[r])
        got[r].append(x)
    wrong = [(s, got[r], read_alone(s)) for r, s in enumerate(texts) if good[r] and got[r] != read_alone(s)]
    assert not wrong, wrong[:3]
    assert good.sum() > 0.5 * len(texts)


def test_no_half_of_a_pair_and_no_depth_breaks_a_batch():
    deep = "[" * 5000 + "]" * 5000
    texts = ['[{"title":"\\ud83d","url":"x"}]', deep, '[{"title":"' + "y" * 200_000 + '"}]', "[", "{}", "[]", '[{"title":["a"],"url":"u"}]', "[{title:'A',url:'/a'}, {title:'B'}]"]
    parent, place, item = packed.split_entries(pa.array([*texts, None, ""], pa.large_string()))
    got = {}
    for r, _, x in sorted(zip(parent.tolist(), place.tolist(), item.to_pylist())):
        got.setdefault(r, []).append(x)
    assert got[0] == ["\ufffd::x"] and got[2] == ["y" * 200_000] and got[6] == ['["a"]::u'] and got[7] == ["A::/a", "B"] and 4 not in got and 5 not in got
