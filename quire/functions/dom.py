"""A tree for HTML as it is found, CSS selectors over it, and a part of XPath.

The tree is built on the standard library's tokenizer: void elements, implied end tags of p, li, dt,
dd, tr, td, th, option, raw text of script and style. It is an approximation of the HTML5 algorithm,
good for extraction; it doesn't reparent misnested formatting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

# Elements without content, those that start a new block of text, and implied ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPE = {"ul", "ol", "dl", "table", "select", "html", "body"}
ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "br", "body"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag[0] != "!"]

    def descend(self) -> Iterator[Node]:
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.elements()[::-1]

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def raw_text(self) -> str:
        """All text as written."""
        out, stack = [], list(self.children[::-1])
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag[0] != "!":
                stack += n.children[::-1]
        return "".join(out)

    def text(self) -> str:
        """Visible text: blocks and line breaks separate words, white space squeezed."""
        out: list[str] = []
        stack: list[Node | str] = list(self.children[::-1])
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag in ("script", "style") or n.tag[0] == "!":
                continue
            elif n.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
                stack += n.children[::-1]
            else:
                stack += n.children[::-1]
        return " ".join("".join(out).split())

    def own_text(self) -> str:
        return " ".join("".join(c for c in self.children if isinstance(c, str)).split())

    def inner_html(self) -> str:
        return "".join(_html(c) for c in self.children)

    def outer_html(self) -> str:
        return _html(self)


def _escape(s: str, quote: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("\xa0", "&nbsp;")
    return s.replace('"', "&quot;") if quote else s.replace("<", "&lt;").replace(">", "&gt;")


def _html(top: Node | str) -> str:
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = [top]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(_escape(n))
        elif n.tag[0] == "!":
            out.append(f"<!--{n.attrs.get('data', '')}-->")
        else:
            out.append(f"<{n.tag}" + "".join(f' {k}="{_escape(v, True)}"' for k, v in n.attrs.items()) + ">")
            if n.tag in VOID:
                continue
            stack.append((f"</{n.tag}>",))
            if n.tag in ("script", "style"):
                out.append(n.raw_text())
            else:
                stack += n.children[::-1]
    return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPE:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            self._close(CLOSES[tag])
        if tag in ENDS_P and any(n.tag == "p" for n in self.open):
            self._close({"p"})
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        node = Node(tag, known, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].children.append(Node("!comment", {"data": data}, self.open[-1]))


def parse_html(text: str) -> Node:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


# ---- CSS ----------------------------------------------------------------------------------------

_SIMPLE = re.compile(r"\*|(?P<tag>[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+))?\s*\]|:(?P<pseudo>[A-Za-z-]+)")
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?:(?P<a>[+-]?\d*)n\s*)?(?P<b>[+-]?\s*\d+)?)\s*$")


class SelectorError(ValueError):
    pass


def _parenthesis(s: str, at: int) -> tuple[str, int]:
    depth, quote, start = 0, "", at + 1
    for i in range(at, len(s)):
        c = s[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return s[start:i], i + 1
    raise SelectorError(f"open parenthesis in {s!r}")


@lru_cache(2048)
def selector(text: str) -> tuple:
    """Groups of (combinator, tests): a selector as data."""
    groups, at, n = [], 0, len(text)
    chain: list[tuple[str, tuple]] = []
    tests: list[tuple] = []
    join = " "
    while at <= n:
        while at < n and text[at].isspace() and not tests:
            at += 1
        if at == n or text[at] == ",":
            if tests:
                chain.append((join, tuple(tests)))
            if not chain:
                raise SelectorError(f"empty selector in {text!r}")
            groups.append(tuple(chain))
            chain, tests, join, at = [], [], " ", at + 1
            continue
        c = text[at]
        if c.isspace() or c in ">+~":
            if tests:
                chain.append((join, tuple(tests)))
                tests = []
            m = re.compile(r"\s*([>+~]?)\s*").match(text, at)
            join, at = m[1] or " ", m.end()
            continue
        m = _SIMPLE.match(text, at)
        if not m:
            raise SelectorError(f"bad selector {text!r} at {at}")
        at = m.end()
        if m["tag"]:
            tests.append(("tag", m["tag"].lower()))
        elif m["id"]:
            tests.append(("id", m["id"]))
        elif m["cls"]:
            tests.append(("class", m["cls"]))
        elif m["attr"]:
            tests.append(("attr", m["attr"].lower(), m["op"], (m["val"] or "").strip("\"'")))
        elif m["pseudo"]:
            argument = None
            if at < n and text[at] == "(":
                argument, at = _parenthesis(text, at)
            tests.append(("pseudo", m["pseudo"].lower(), argument))
        else:
            tests.append(("any",))
    return tuple(groups)


PICKS = {"eq", "lt", "gt", "first", "last"}


def _nth(argument: str, place: int) -> bool:
    m = _NTH.match(argument.lower())
    if not m:
        return False
    if m["word"]:
        return place % 2 == (m["word"] == "odd")
    b = int((m["b"] or "0").replace(" ", ""))
    if m["a"] is None:
        return place == b
    a = int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"])
    return (place - b) % a == 0 and (place - b) // a >= 0 if a else place == b


def _passes(n: Node, test: tuple) -> bool:
    kind = test[0]
    if kind == "any":
        return True
    if kind == "tag":
        return n.tag == test[1]
    if kind == "id":
        return n.attrs.get("id") == test[1]
    if kind == "class":
        return test[1] in n.classes()
    if kind == "attr":
        _, name, op, want = test
        have = n.attrs.get(name)
        if op is None:
            return have is not None
        if op == "!=":
            return have != want
        if have is None:
            return False
        return {"=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"), "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have}[op]
    _, name, argument = test
    own = (argument or "").strip().strip("\"'")
    if name == "not":
        return not matches(n, own) if own != ":parent" else not n.children
    if name == "has":
        return any(matches(x, own.lstrip("> ")) for x in (n.elements() if own.startswith(">") else n.descend()))
    if name == "is":
        return matches(n, own)
    if name in ("contains", "containsown", "containswholetext", "containswholeowntext", "matches", "matchesown", "containsdata"):
        if name == "containsdata":
            data = "".join(c for c in n.children if isinstance(c, str)) if n.tag in ("script", "style") else "".join(c.attrs.get("data", "") for c in n.children if isinstance(c, Node) and c.tag[0] == "!")
            return own.lower() in data.lower()
        text = n.own_text() if "own" in name and "whole" not in name else n.raw_text() if name == "containswholetext" else "".join(c for c in n.children if isinstance(c, str)) if "whole" in name else n.text()
        if name.startswith("matches"):
            return bool(re.search(own, text))
        return own in text if "whole" in name else own.lower() in text.lower()
    if name == "parent":
        return bool(n.children)
    if name == "empty":
        return not n.elements() and not n.raw_text().strip()
    if name == "root":
        return n.parent is not None and n.parent.tag == "#root"
    if n.parent is None:
        return False
    among = n.parent.elements()
    if name.endswith("of-type"):
        among = [x for x in among if x.tag == n.tag]
    place = next(i for i, x in enumerate(among) if x is n)
    if name in ("first-child", "first-of-type"):
        return place == 0
    if name in ("last-child", "last-of-type"):
        return place == len(among) - 1
    if name in ("only-child", "only-of-type"):
        return len(among) == 1
    if name in ("nth-child", "nth-of-type"):
        return _nth(own, place + 1)
    if name in ("nth-last-child", "nth-last-of-type"):
        return _nth(own, len(among) - place)
    raise SelectorError(f"unknown :{name}")


def _fits(n: Node, chain: tuple, k: int) -> bool:
    join, tests = chain[k]
    if not all(_passes(n, t) for t in tests if not (t[0] == "pseudo" and t[1] in PICKS)):
        return False
    if k == 0:
        return True
    if join == ">":
        return n.parent is not None and _fits(n.parent, chain, k - 1)
    if join == " ":
        up = n.parent
        while up is not None:
            if _fits(up, chain, k - 1):
                return True
            up = up.parent
        return False
    if n.parent is None:
        return False
    among = n.parent.elements()
    place = next(i for i, x in enumerate(among) if x is n)
    before = among[place - 1 : place] if join == "+" else among[:place]
    return any(_fits(x, chain, k - 1) for x in before)


def matches(n: Node, text: str) -> bool:
    return any(_fits(n, g, len(g) - 1) for g in selector(text))


def _pick(found: list[Node], name: str, argument: str | None) -> list[Node]:
    n = int(argument) if argument else 0
    if name == "first":
        return found[:1]
    if name == "last":
        return found[-1:]
    if name == "eq":
        return found[n : n + 1] if n >= 0 else found[n:][:1]
    return found[:n] if name == "lt" else found[n + 1 :]


def query(top: Node, text: str) -> list[Node]:
    """Elements under top that a selector finds, in document order. :eq :lt :gt :first :last pick from
    the list found, each group of a comma list for itself."""
    groups = selector(text)
    picked = [[t for t in g[-1][1] if t[0] == "pseudo" and t[1] in PICKS] for g in groups]
    nodes = list(top.descend())
    if not any(picked):
        return [n for n in nodes if any(_fits(n, g, len(g) - 1) for g in groups)]
    out: list[Node] = []
    for g, picks in zip(groups, picked):
        found = [n for n in nodes if _fits(n, g, len(g) - 1)]
        for p in picks:
            found = _pick(found, p[1], p[2])
        out += found
    return out


# ---- XPath --------------------------------------------------------------------------------------

_STEP = re.compile(r"(//|/)?(@[\w:*-]+|text\(\)|node\(\)|\.\.|\.|\*|(?:(?:child|descendant|parent|self|following-sibling|preceding-sibling|ancestor)::)?[\w*-]+(?:\(\))?)")


class XPathError(ValueError):
    pass


def _predicates(s: str, at: int) -> tuple[list[str], int]:
    out = []
    while at < len(s) and s[at] == "[":
        depth, quote, start = 0, "", at + 1
        for i in range(at, len(s)):
            c = s[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    out.append(s[start:i].strip())
                    at = i + 1
                    break
        else:
            raise XPathError(f"open predicate in {s!r}")
    return out, at


@lru_cache(2048)
def _steps(path: str) -> tuple:
    out, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise XPathError(f"bad path {path!r} at {at}")
        preds, at = _predicates(path, m.end())
        out.append((m[1] or "", m[2], tuple(preds)))
    return tuple(out)


def _string(v: object) -> str:
    if isinstance(v, Node):
        return v.raw_text()
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else repr(v)
    if isinstance(v, list):
        return _string(v[0]) if v else ""
    return str(v)


def _args(s: str) -> list[str]:
    from quire.functions.jsonpath import split_top

    return [x.strip() for x in split_top(s, ",")]


def _value(expr: str, node: object, place: int, size: int) -> object:
    from quire.functions.jsonpath import split_top

    expr = expr.strip()
    for word in (" or ", " and "):
        if len(parts := split_top(expr, word)) > 1:
            truths = [_truth(_value(p, node, place, size), place) for p in parts]
            return any(truths) if word == " or " else all(truths)
    for op in ("!=", "<=", ">=", "=", "<", ">"):
        if len(parts := split_top(expr, op)) == 2 and parts[0].strip() and parts[1].strip():
            a, b = (_value(p, node, place, size) for p in parts)
            return _compare(a, b, op)
    if expr[:1] in "'\"" and expr[-1:] == expr[:1]:
        return expr[1:-1]
    if re.fullmatch(r"-?\d+(\.\d+)?", expr):
        return float(expr)
    if m := re.fullmatch(r"([\w-]+)\((.*)\)", expr, re.S):
        name, args = m[1], _args(m[2]) if m[2].strip() else []
        own = [_value(a, node, place, size) for a in args]
        if name == "last":
            return float(size)
        if name == "position":
            return float(place)
        if name == "not":
            return not _truth(own[0], place)
        if name == "contains":
            return _string(own[1]) in _string(own[0])
        if name == "starts-with":
            return _string(own[0]).startswith(_string(own[1]))
        if name == "count":
            return float(len(own[0])) if isinstance(own[0], list) else 0.0
        if name == "concat":
            return "".join(map(_string, own))
        if name in ("string", "normalize-space"):
            s = _string(own[0]) if own else _string(node)
            return " ".join(s.split()) if name == "normalize-space" else s
        if name == "string-length":
            return float(len(_string(own[0]) if own else _string(node)))
        if name == "substring-before":
            a, b = map(_string, own)
            return a.split(b, 1)[0] if b in a else ""
        if name == "substring-after":
            a, b = map(_string, own)
            return a.split(b, 1)[1] if b in a else ""
        if name not in ("text", "node"):
            raise XPathError(f"unknown function {name}")
    if m := re.fullmatch(r"(last\(\))\s*-\s*(\d+)", expr):
        return float(size - int(m[2]))
    return _walk(expr, [node])


def _compare(a: object, b: object, op: str) -> bool:
    left = [_string(x) for x in a] if isinstance(a, list) else [a]
    right = [_string(x) for x in b] if isinstance(b, list) else [b]

    def one(x: object, y: object) -> bool:
        if isinstance(x, float) or isinstance(y, float) or op not in ("=", "!="):
            try:
                x, y = float(_string(x)), float(_string(y))
            except ValueError:
                return False
        return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    return any(one(x, y) for x in left for y in right)


def _truth(v: object, place: int) -> bool:
    if isinstance(v, float):
        return v == place
    return bool(v)


def _walk(path: str, nodes: list) -> list:
    for join, name, preds in _steps(path.strip()):
        out: list = []
        seen: set[int] = set()
        for n in nodes:
            if not isinstance(n, Node):
                continue
            if join == "//" and name == "text()" and not preds:
                out += _texts(n)
                continue
            starts = [n, *n.descend()] if join == "//" else [n]
            for s in starts:
                found = _axis(s, name)
                for p in preds:
                    if m := re.fullmatch(r"last\(\)\s*-\s*(\d+)", p):
                        k = len(found) - int(m[1])
                        found = found[k - 1 : k] if k > 0 else []
                    else:
                        found = [x for i, x in enumerate(found, 1) if _truth(_value(p, x, i, len(found)), i)]
                for x in found:
                    if not isinstance(x, Node) or id(x) not in seen:
                        seen.add(id(x))
                        out.append(x)
        nodes = out
    return nodes


def _texts(top: Node) -> list[str]:
    """All text nodes in document order."""
    out, stack = [], list(top.children[::-1])
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            stack += n.children[::-1]
    return out


def _axis(n: Node, name: str) -> list:
    if name == ".":
        return [n]
    if name == "..":
        return [n.parent] if n.parent is not None else []
    if name == "text()":
        return [c for c in n.children if isinstance(c, str)]
    if name == "node()":
        return [c for c in n.children if isinstance(c, str) or c.tag[0] != "!"]
    if name[0] == "@":
        return list(n.attrs.values()) if name == "@*" else [n.attrs[name[1:].lower()]] if name[1:].lower() in n.attrs else []
    axis, _, test = name.rpartition("::")
    among = n.parent.elements() if n.parent is not None else []
    place = next((i for i, x in enumerate(among) if x is n), 0)
    up: list[Node] = []
    if axis == "ancestor":
        p = n.parent
        while p is not None and p.tag != "#root":
            up.append(p)
            p = p.parent
    found = {"": n.elements, "child": n.elements, "descendant": lambda: list(n.descend()), "self": lambda: [n], "parent": lambda: [n.parent] if n.parent else [], "ancestor": lambda: up, "following-sibling": lambda: among[place + 1 :], "preceding-sibling": lambda: among[:place][::-1]}[axis]()
    return [x for x in found if test in ("*", "node()") or x.tag == test.lower()]


def xpath(top: Node, expression: str) -> list[str]:
    """Results as strings: of a node set each, in document order; of a value one."""
    from quire.functions.jsonpath import split_top

    if len(parts := split_top(expression, "|")) > 1:
        return [x for p in parts for x in xpath(top, p)]
    e = expression.strip()
    v = _walk(e, [top]) if e[:1] in "/." or e[:1] == "@" else _value(e, top, 1, 1)
    return [_string(x) for x in v] if isinstance(v, list) else [_string(v)]
