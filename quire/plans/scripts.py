"""A small script language for rules: expressions over a value, without loops, input or output.

It reads the part of JavaScript that rules use to touch a value up: literals, operators, conditions,
names bound once, properties and methods of texts and lists, regular expressions, JSON, and the pure
helpers of the ``java`` object. Anything else is Unsupported when the script is read, so that a rule
never pretends to have run.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from collections.abc import Callable
from datetime import UTC, datetime
from functools import lru_cache
from urllib.parse import quote, unquote, urlsplit

from quire.functions import dom
from quire.functions.books import number_chapter


class Unsupported(ValueError):
    """A script that this language doesn't have."""


TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`$\\]*`)|(?P<mark>===|!==|==|!=|<=|>=|&&|\|\||=>|[-+*/%!<>?:.,;()\[\]{}=])|(?P<end>$))""", re.S)
REGEX = re.compile(r"\s*/((?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+)/([gimsuy]*)")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}
Value = object
Node = Callable[[dict[str, Value]], Value]


class Regex:
    def __init__(self, source: str, flags: str):
        bits = (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0) | (re.S if "s" in flags else 0)
        try:
            self.own = re.compile(source.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!").replace("\\/", "/"), bits)
        except re.error as e:
            raise Unsupported(f"pattern {source[:40]!r}: {e}") from None
        self.all = "g" in flags


def text(v: Value) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)
    if isinstance(v, list):
        return ",".join("" if x is None else text(x) for x in v)
    return "null" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def number(v: Value) -> float:
    try:
        return float(v) if not isinstance(v, str) else float(v.strip() or 0)
    except (TypeError, ValueError):
        return float("nan")


def truth(v: Value) -> bool:
    return bool(v) and v == v if not isinstance(v, list | dict | Regex) else True


def same(a: Value, b: Value, strict: bool) -> bool:
    if isinstance(a, float | str | bool) and isinstance(b, float | str | bool) and type(a) is not type(b):
        return not strict and number(a) == number(b)
    return a == b


# ---- methods ------------------------------------------------------------------------------------


def span(n: int, start: Value, end: Value, clamp: bool) -> tuple[int, int]:
    a, b = (int(number(x)) if x is not None else d for x, d in ((start, 0), (end, n)))
    a, b = (max(0, min(n, x)) if clamp else max(0, min(n, x + n if x < 0 else x)) for x in (a, b))
    return (min(a, b), max(a, b)) if clamp else (a, max(a, b))


def replaced(s: str, what: Value, by: Value, everywhere: bool) -> str:
    if isinstance(what, Regex):
        new = re.sub(r"\$(\$|&|\d{1,2})", lambda m: "$" if m[1] == "$" else r"\g<0>" if m[1] == "&" else rf"\g<{m[1]}>", text(by).replace("\\", "\\\\"))
        try:
            return what.own.sub(new, s, count=0 if what.all or everywhere else 1)
        except (re.error, IndexError) as e:
            raise Unsupported(str(e)) from None
    return s.replace(text(what), text(by), -1 if everywhere else 1)


def matched(s: str, what: Value) -> Value:
    own = what if isinstance(what, Regex) else Regex(text(what), "")
    if own.all:
        return [m[0] for m in own.own.finditer(s)] or None
    return None if (m := own.own.search(s)) is None else [m[0], *m.groups()]


def pieces(s: str, by: Value) -> list[Value]:
    if by is None:
        return [s]
    if isinstance(by, Regex):
        return [x for x in by.own.split(s) if x is not None]
    return list(s) if by == "" else list(s.split(text(by)))


TEXT: dict[str, Callable[..., Value]] = {
    "trim": lambda s: s.strip(), "toLowerCase": lambda s: s.lower(), "toUpperCase": lambda s: s.upper(), "toString": lambda s: s,
    "replace": lambda s, a, b="": replaced(s, a, b, False), "replaceAll": lambda s, a, b="": replaced(s, a, b, True), "match": matched, "split": lambda s, by=None, *_: pieces(s, by),
    "substring": lambda s, a=0.0, b=None: s[slice(*span(len(s), a, b, True))], "slice": lambda s, a=0.0, b=None: s[slice(*span(len(s), a, b, False))],
    "substr": lambda s, a=0.0, n=None: s[span(len(s), a, None, False)[0] :][: None if n is None else max(0, int(number(n)))],
    "indexOf": lambda s, x: float(s.find(text(x))), "lastIndexOf": lambda s, x: float(s.rfind(text(x))), "includes": lambda s, x: text(x) in s,
    "startsWith": lambda s, x: s.startswith(text(x)), "endsWith": lambda s, x: s.endswith(text(x)), "concat": lambda s, *x: s + "".join(map(text, x)), "charAt": lambda s, k=0.0: s[int(number(k)) : int(number(k)) + 1],
    "padStart": lambda s, n, c=" ": s.rjust(int(number(n)), text(c)[:1]), "padEnd": lambda s, n, c=" ": s.ljust(int(number(n)), text(c)[:1]), "search": lambda s, r: float(m.start() if (m := r.own.search(s)) else -1),
}
LIST: dict[str, Callable[..., Value]] = {
    "join": lambda v, by=",": text(by).join("" if x is None else text(x) for x in v), "reverse": lambda v: v[::-1], "slice": lambda v, a=0.0, b=None: v[slice(*span(len(v), a, b, False))],
    "indexOf": lambda v, x: float(v.index(x) if x in v else -1), "includes": lambda v, x: x in v, "concat": lambda v, *x: v + [y for z in x for y in (z if isinstance(z, list) else [z])], "toString": text,
}


def algorithm(name: Value) -> str:
    own = re.sub(r"^hmac|[^a-z0-9]", "", text(name).lower())
    return own if own in ("md5", "sha1", "sha256", "sha512") or own == "sm3" and own in hashlib.algorithms_available else ""


def digest(data: Value, name: Value) -> bytes:
    return hashlib.new(own, text(data).encode()).digest() if (own := algorithm(name)) else b""


def keyed(data: Value, name: Value, key: Value) -> bytes:
    return hmac.new(text(key).encode(), text(data).encode(), own).digest() if (own := algorithm(name)) else b""


def time_format(ms: Value, pattern: str = "yyyy/MM/dd HH:mm", offset: float = 28_800_000.0) -> str:
    try:
        at = datetime.fromtimestamp((number(ms) + number(offset)) / 1000, UTC)
    except (ValueError, OverflowError, OSError):
        return ""
    for mark, form in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
        pattern = pattern.replace(mark, at.strftime(form))
    return pattern


def url(v: Value) -> dict[str, Value]:
    u = urlsplit(text(v))
    return {"href": text(v), "protocol": u.scheme, "host": u.netloc, "hostname": u.hostname, "pathname": u.path, "search": u.query, "hash": u.fragment}


MARKS = "-_.!~*'()"
b64 = lambda data: base64.b64encode(data).decode()
unb64 = lambda s: base64.b64decode(re.sub(r"\s", "", text(s)) + "=" * (-len(re.sub(r"\s", "", text(s))) % 4), b"-_" if re.search("[-_]", text(s)) else None)
HELPERS: dict[str, Callable[..., Value]] = {
    "base64Encode": lambda s, *_: b64(text(s).encode()), "base64Decode": lambda s, *_: unb64(s).decode("utf-8", "replace"), "base64Decoder": lambda s, *_: unb64(s).decode("utf-8", "replace"),
    "hexEncode": lambda s: text(s).encode().hex(), "hexEncodeToString": lambda s: text(s).encode().hex(), "hexDecode": lambda s: bytes.fromhex(text(s)).decode("utf-8", "replace"), "hexDecodeToString": lambda s: bytes.fromhex(text(s)).decode("utf-8", "replace"),
    "base64DecodeToByteArray": lambda s, *_: [float(x) for x in unb64(s)], "hexDecodeToByteArray": lambda s: [float(x) for x in bytes.fromhex(text(s))],
    "strToBytes": lambda s, *_: [float(x) for x in text(s).encode()], "bytesToStr": lambda v, *_: bytes(int(x) for x in v).decode("utf-8", "replace"),
    "md5Encode": lambda s: digest(s, "md5").hex(), "md5Encode16": lambda s: digest(s, "md5").hex()[8:24], "hashDigest": lambda s, a: digest(s, a).hex(), "digestHex": lambda s, a: digest(s, a).hex(), "digestBase64Str": lambda s, a: b64(digest(s, a)),
    "hmacDigest": lambda s, a, k: keyed(s, a, k).hex(), "HMacHex": lambda s, a, k: keyed(s, a, k).hex(), "hmacHex": lambda s, a, k: keyed(s, a, k).hex(), "HMacBase64": lambda s, a, k: b64(keyed(s, a, k)), "hmacBase64": lambda s, a, k: b64(keyed(s, a, k)),
    "encodeURI": lambda s, *_: quote(text(s), safe=MARKS + ";/?:@&=+$,#"), "encodeURIComponent": lambda s: quote(text(s), safe=MARKS),
    "timeFormat": time_format, "timeFormatUTC": lambda ms, pattern="yyyy/MM/dd HH:mm", offset=0.0: time_format(ms, text(pattern), offset), "toNumChapter": lambda s: number_chapter(text(s)),
    "htmlFormat": lambda s: " ".join(dom.parse_html(text(s)).text().split()), "toURL": lambda v, *_: url(v), "log": lambda v=None: v, "logType": lambda v=None: v,
}


def read_json(s: Value) -> Value:
    try:
        return json.loads(text(s), parse_int=float)
    except (ValueError, RecursionError) as e:
        raise ValueError(f"not JSON: {e}") from None


GLOBALS: dict[str, Callable[..., Value]] = {
    "String": lambda v="": text(v), "Number": lambda v=0.0: number(v), "parseFloat": lambda v: number(m[0]) if (m := re.match(r"\s*-?\d+(?:\.\d+)?", text(v))) else float("nan"),
    "parseInt": lambda v, *_: float(int(m[0])) if (m := re.match(r"\s*-?\d+", text(v))) else float("nan"), "encodeURIComponent": HELPERS["encodeURIComponent"], "encodeURI": HELPERS["encodeURI"],
    "decodeURIComponent": lambda s: unquote(text(s)), "decodeURI": lambda s: unquote(text(s)),
}
OBJECTS: dict[str, dict[str, Callable[..., Value]]] = {
    "java": HELPERS,
    "JSON": {"parse": read_json, "stringify": lambda v, *_: json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=text) if not isinstance(v, float) else text(v)},
    "Math": {"floor": lambda v: float(number(v) // 1), "ceil": lambda v: float(-(-number(v) // 1)), "round": lambda v: float((number(v) + 0.5) // 1), "abs": lambda v: abs(number(v)), "max": lambda *v: max(map(number, v)), "min": lambda *v: min(map(number, v))},
}


# ---- reading ------------------------------------------------------------------------------------


class Reader:
    """Reads a script into functions of its names. Precedence is a table; there is nothing that repeats."""

    LEVELS = [("||",), ("&&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%")]

    def __init__(self, source: str):
        self.source, self.at = source, 0

    def peek(self) -> re.Match[str]:
        m = TOKEN.match(self.source, self.at)
        if not m:
            raise Unsupported(f"can't read {self.source[self.at : self.at + 20]!r}")
        return m

    def mark(self, *marks: str) -> str | None:
        m = self.peek()
        if m["mark"] in marks:
            self.at = m.end()
            return m["mark"]
        return None

    def need(self, mark: str) -> None:
        if not self.mark(mark):
            raise Unsupported(f"{mark} expected at {self.source[self.at : self.at + 20]!r}")

    def program(self) -> Node:
        steps: list[tuple[str | None, Node]] = []
        while True:
            while self.mark(";"):
                pass
            m = self.peek()
            if m["end"] is not None:
                break
            name = None
            if m["name"] in ("var", "let", "const", "return"):
                self.at = m.end()
                if m["name"] != "return":
                    name = self.peek()["name"]
                    if name is None:
                        raise Unsupported("a name expected")
                    self.at = self.peek().end()
                    self.need("=")
            elif m["name"] and re.match(r"\s*=(?![=>])", self.source[m.end() :]):
                name, self.at = m["name"], m.end()
                self.need("=")
            steps.append((name, self.expression()))
            if m["name"] == "return":
                break
            rest = self.peek()
            if rest["mark"] != ";" and rest["end"] is None and "\n" not in self.source[self.at : rest.end()]:
                raise Unsupported(f"can't read {self.source[self.at : self.at + 20]!r}")
        if not steps:
            raise Unsupported("an empty script")

        def run(scope: dict[str, Value]) -> Value:
            own, value = dict(scope), None
            for bound, node in steps:
                value = node(own)
                if bound:
                    own[bound] = value
            return value

        return run

    def expression(self) -> Node:
        test = self.binary(0)
        if not self.mark("?"):
            return test
        yes = self.expression()
        self.need(":")
        no = self.expression()
        return lambda s: yes(s) if truth(test(s)) else no(s)

    def binary(self, level: int) -> Node:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.mark(*self.LEVELS[level]):
            left = joined(op, left, self.binary(level + 1))
        return left

    def unary(self) -> Node:
        if op := self.mark("!", "-", "+"):
            own = self.unary()
            return {"!": lambda s: not truth(own(s)), "-": lambda s: -number(own(s)), "+": lambda s: number(own(s))}[op]
        return self.postfix()

    def arguments(self) -> list[Node]:
        out: list[Node] = []
        while not self.mark(")"):
            out.append(self.expression())
            if not self.mark(","):
                self.need(")")
                break
        return out

    def postfix(self) -> Node:
        m = self.peek()
        if m["name"] in OBJECTS:
            self.at = m.end()
            self.need(".")
            name = self.peek()
            self.at = name.end()
            if (call := OBJECTS[m["name"]].get(name["name"] or "")) is None:
                raise Unsupported(f"{m['name']}.{name['name']}")
            self.need("(")
            own: Node = called(call, self.arguments())
        elif m["name"] in GLOBALS and re.match(r"\s*\(", self.source[m.end() :]):
            self.at = m.end()
            self.need("(")
            own = called(GLOBALS[m["name"]], self.arguments())
        else:
            own = self.primary()
        while op := self.mark(".", "["):
            if op == "[":
                key = self.expression()
                self.need("]")
                own = item(own, key)
                continue
            name = self.peek()
            if name["name"] is None:
                raise Unsupported("a name expected")
            self.at = name.end()
            own = method(own, name["name"], self.arguments()) if self.mark("(") else item(own, lambda s, n=name["name"]: n)
        return own

    def primary(self) -> Node:
        if m := REGEX.match(self.source, self.at):
            self.at = m.end()
            pattern = Regex(m[1], m[2])
            return lambda s: pattern
        m = self.peek()
        self.at = m.end()
        if m["number"]:
            n = float(m["number"])
            return lambda s: n
        if m["text"]:
            t = re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda e: chr(int(e[1], 16)) if e[1] else ESCAPES.get(e[2], e[2]), m["text"][1:-1], flags=re.S)
            return lambda s: t
        if m["name"]:
            if m["name"] in ("true", "false", "null", "undefined"):
                v = {"true": True, "false": False}.get(m["name"])
                return lambda s: v
            if m["name"] in ("function", "new", "for", "while", "if", "do", "switch", "throw", "try", "class", "this", "eval", "async", "await", "delete", "typeof"):
                raise Unsupported(m["name"])
            return named(m["name"])
        if m["mark"] == "(":
            own = self.expression()
            self.need(")")
            return own
        if m["mark"] == "[":
            items: list[Node] = []
            while not self.mark("]"):
                items.append(self.expression())
                if not self.mark(","):
                    self.need("]")
                    break
            return lambda s: [x(s) for x in items]
        raise Unsupported(f"can't read {self.source[m.start() : m.start() + 20]!r}")


def joined(op: str, a: Node, b: Node) -> Node:
    def plus(s: dict[str, Value]) -> Value:
        x, y = a(s), b(s)
        return x + y if isinstance(x, float) and isinstance(y, float) else text(x) + text(y)

    def either(s: dict[str, Value]) -> Value:
        return x if truth(x := a(s)) else b(s)

    def both(s: dict[str, Value]) -> Value:
        return b(s) if truth(x := a(s)) else x

    def compare(s: dict[str, Value]) -> bool:
        x, y = a(s), b(s)
        if not (isinstance(x, str) and isinstance(y, str)):
            x, y = number(x), number(y)
        return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def divided(s: dict[str, Value]) -> float:
        x, y = number(a(s)), number(b(s))
        if y == 0:
            return float("nan") if x == 0 or op == "%" else float("inf") if x > 0 else float("-inf")
        return x / y if op == "/" else x - y * int(x / y)

    table: dict[str, Node] = {
        "+": plus, "-": lambda s: number(a(s)) - number(b(s)), "*": lambda s: number(a(s)) * number(b(s)), "/": divided, "%": divided, "||": either, "&&": both,
        "==": lambda s: same(a(s), b(s), False), "===": lambda s: same(a(s), b(s), True), "!=": lambda s: not same(a(s), b(s), False), "!==": lambda s: not same(a(s), b(s), True),
    }
    return table.get(op, compare)


def called(call: Callable[..., Value], args: list[Node]) -> Node:
    def run(s: dict[str, Value]) -> Value:
        try:
            return call(*(x(s) for x in args))
        except (TypeError, AttributeError, OverflowError) as e:
            raise ValueError(f"bad arguments: {e}") from None

    return run


def method(own: Node, name: str, args: list[Node]) -> Node:
    if name not in TEXT and name not in LIST:
        raise Unsupported(f"method {name}")

    def run(s: dict[str, Value]) -> Value:
        v = own(s)
        if isinstance(v, Regex) and name == "test":
            return bool(v.own.search(text(args[0](s))))
        if v is None:
            raise ValueError(f"{name} of nothing")
        table = LIST if isinstance(v, list) else TEXT
        if name not in table:
            raise ValueError(f"no {name} there")
        return called(lambda *x: table[name](v if isinstance(v, list) else text(v), *x), args)(s)

    return run


TEXT["test"] = lambda s, *_: False  # of a pattern; see method()


def item(own: Node, key: Node) -> Node:
    def run(s: dict[str, Value]) -> Value:
        v, k = own(s), key(s)
        if v is None:
            raise ValueError(f"{text(k)} of nothing")
        if k == "length" and isinstance(v, str | list):
            return float(len(v))
        if isinstance(v, dict):
            return v.get(text(k))
        n = number(k)
        return v[int(n)] if isinstance(v, str | list) and n == n and 0 <= n < len(v) else None

    return run


def named(name: str) -> Node:
    def run(s: dict[str, Value]) -> Value:
        if name not in s:
            raise Unsupported(f"no name {name}")
        return s[name]

    return run


@lru_cache(4096)
def compile_script(source: str) -> Node:
    return Reader(source).program()


def evaluate(source: str, value: Value, scope: dict[str, Value] | None = None) -> Value:
    """The value of a script's last expression; ``result`` is the value it is given. Unsupported for what
    the language hasn't, another ValueError for what fails on this value."""
    try:
        return compile_script(source)({**(scope or {}), "result": value})
    except RecursionError:
        raise Unsupported("nested too deeply") from None
