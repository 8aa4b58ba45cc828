"""JSONPath: a parser to segments, and their evaluation over decoded JSON.

Paths start with $ and use .f ['f'] [n] [-n] [*] .* ..f [a,b] [s:e:t] [?(...)] and functions at the
end. Type mismatches select nothing; only bad paths are errors. Filters select from arrays.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import lru_cache

_NAME = re.compile(r"[^\s.\[\]()'\",|&%=!<>~]+")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_OPERATOR = re.compile(r"\s*(==|!=|=~|>=|<=|>|<|(?:in|nin|anyof|noneof|subsetof|size|empty)\b)\s*")
FUNCTIONS = {"length", "size", "first", "last", "index", "sum", "min", "max", "avg", "stddev", "keys", "values", "concat", "append"}


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Segment:
    kind: str  # field, index, wild, descend, union, slice, filter, call
    value: object = None


@dataclass(frozen=True)
class Path:
    root: str  # $ or @
    segments: tuple[Segment, ...]


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str) -> PathError:
        return PathError(f"{what} at {self.at} of {self.text!r}")

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.peek(s):
            self.at += len(s)
            return True
        return False

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def match(self, pattern: re.Pattern[str]) -> re.Match[str] | None:
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
        return m

    def quoted(self) -> str:
        mark, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                out.append(self.text[self.at])
                self.at += 1
            elif c == mark:
                return "".join(out)
            else:
                out.append(c)
        raise self.fail("open quotation")

    def path(self) -> Path:
        root = self.text[self.at : self.at + 1]
        if root not in ("$", "@"):
            raise self.fail("no root")
        self.at += 1
        out: list[Segment] = []
        while True:
            if self.take(".."):
                if self.peek("["):
                    out.append(Segment("descend"))
                elif self.take("*"):
                    out += [Segment("descend"), Segment("wild")]
                elif m := self.match(_NAME):
                    out += [Segment("descend"), Segment("field", m[0])]
                else:
                    raise self.fail("nothing to descend to")
            elif self.take("."):
                if self.take("*"):
                    out.append(Segment("wild"))
                elif m := self.match(_NAME):
                    if m[0] in FUNCTIONS and self.take("("):
                        out.append(Segment("call", (m[0], tuple(self.arguments()))))
                    else:
                        out.append(Segment("field", m[0]))
                else:
                    raise self.fail("no name")
            elif self.take("["):
                out.append(self.bracket())
            else:
                return Path(root, tuple(out))

    def arguments(self) -> list[object]:
        out: list[object] = []
        while True:
            self.blanks()
            if self.take(")"):
                return out
            out.append(self.operand())
            self.blanks()
            if not self.take(",") and not self.peek(")"):
                raise self.fail("bad argument")

    def bracket(self) -> Segment:
        self.blanks()
        if self.take("?"):
            self.blanks()
            if not self.take("("):
                raise self.fail("filter without parenthesis")
            test = self.either()
            self.blanks()
            if not self.take(")"):
                raise self.fail("open filter")
            self.blanks()
            if not self.take("]"):
                raise self.fail("open bracket")
            return Segment("filter", test)
        if self.take("*"):
            self.blanks()
            if not self.take("]"):
                raise self.fail("open bracket")
            return Segment("wild")
        keys: list[object] = []
        while True:
            self.blanks()
            if self.peek("'") or self.peek('"'):
                keys.append(self.quoted())
            elif m := self.match(re.compile(r"(-?\d+)?\s*:\s*(-?\d+)?\s*(?::\s*(-?\d+)?)?")):
                s, e, t = (int(x) if x else None for x in m.groups())
                if t == 0:
                    raise self.fail("step 0")
                keys.append((s, e, t))
            elif m := self.match(re.compile(r"-?\d+")):
                keys.append(int(m[0]))
            elif m := self.match(_NAME):
                keys.append(m[0])
            else:
                raise self.fail("bad key")
            self.blanks()
            if self.take("]"):
                break
            if not self.take(","):
                raise self.fail("open bracket")
        if len(keys) > 1:
            return Segment("union", tuple(keys))
        k = keys[0]
        return Segment("slice", k) if isinstance(k, tuple) else Segment("index", k) if isinstance(k, int) else Segment("field", k)

    # Filters: nested tuples (name, ...)

    def either(self) -> tuple:
        out = [self.both()]
        self.blanks()
        while self.take("||"):
            out.append(self.both())
            self.blanks()
        return out[0] if len(out) == 1 else ("or", *out)

    def both(self) -> tuple:
        out = [self.single()]
        self.blanks()
        while self.take("&&"):
            out.append(self.single())
            self.blanks()
        return out[0] if len(out) == 1 else ("and", *out)

    def single(self) -> tuple:
        self.blanks()
        if self.take("!"):
            return ("not", self.single())
        if self.take("("):
            out = self.either()
            self.blanks()
            if not self.take(")"):
                raise self.fail("open parenthesis")
            return out
        left = self.operand()
        if m := self.match(_OPERATOR):
            if m[1] == "empty":
                want = self.operand() if self.at < len(self.text) and not re.match(r"\s*(?:\)|&&|\|\|)", self.text[self.at :]) else True
                return ("empty", left, want)
            return (m[1], left, self.operand())
        return ("exists", left)

    def operand(self) -> object:
        self.blanks()
        if self.peek("$") or self.peek("@"):
            return self.path()
        if self.peek("'") or self.peek('"'):
            return self.quoted()
        if self.take("["):
            out: list[object] = []
            while True:
                self.blanks()
                if self.take("]"):
                    return tuple(out)
                out.append(self.operand())
                self.blanks()
                self.take(",")
        if self.take("/"):
            end = self.at
            while end < len(self.text) and (self.text[end] != "/" or self.text[end - 1] == "\\"):
                end += 1
            pattern = self.text[self.at : end]
            self.at = end + 1
            flags = self.match(re.compile("[ims]*"))
            return re.compile(pattern.replace("\\/", "/"), sum(getattr(re, f.upper()) for f in flags[0]))
        if m := self.match(_NUMBER):
            return float(m[0]) if re.search("[.eE]", m[0]) else int(m[0])
        for word, value in (("true", True), ("false", False), ("null", None)):
            if self.take(word):
                return value
        raise self.fail("bad operand")


@lru_cache(1024)
def parse(text: str) -> Path:
    p = _Parser(text.strip())
    out = p.path()
    if p.at != len(p.text):
        raise p.fail("rest")
    if out.root != "$":
        raise PathError("a path starts with $")
    return out


def _number(v: object) -> float | None:
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None


def _equal(a: object, b: object) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return a == b


def _select(seg: Segment, node: object, root: object, out: list) -> None:
    kind, v = seg.kind, seg.value
    if kind == "field":
        if isinstance(node, dict) and v in node:
            out.append(node[v])
    elif kind == "index":
        if isinstance(node, list) and -len(node) <= v < len(node):
            out.append(node[v])
    elif kind == "wild":
        if isinstance(node, list):
            out += node
        elif isinstance(node, dict):
            out += [node[k] for k in sorted(node)]
    elif kind == "slice":
        if isinstance(node, list):
            out += node[slice(*v)]
    elif kind == "union":
        for k in v:
            _select(Segment("slice" if isinstance(k, tuple) else "index" if isinstance(k, int) else "field", k), node, root, out)
    elif kind == "filter":
        if isinstance(node, list):
            out += [x for x in node if _test(v, x, root)]
    elif kind == "descend":
        stack = [node]
        while stack:
            x = stack.pop()
            out.append(x)
            stack += reversed(x if isinstance(x, list) else [x[k] for k in sorted(x)] if isinstance(x, dict) else [])


def _call(name: str, args: tuple, nodes: list, root: object) -> list:
    value = lambda a: (select(a, root) if isinstance(a, Path) else [a])
    if name in ("length", "size"):
        return [len(x) for x in nodes if isinstance(x, list | dict | str)]
    if name in ("first", "last", "index"):
        n = {"first": 0, "last": -1}.get(name)
        if n is None:
            given = [x for x in value(args[0]) if isinstance(x, int)] if args else []
            n = given[0] if given else None
        if n is None:
            return []
        lists = nodes if all(isinstance(x, list) for x in nodes) else [nodes]
        return [x[n] for x in lists if -len(x) <= n < len(x)]
    if name in ("sum", "min", "max", "avg", "stddev"):
        flat = [y for x in nodes for y in (x if isinstance(x, list) else [x])] + [y for a in args for y in value(a)]
        numbers = [_number(y) for y in flat]
        if not numbers or None in numbers:
            return []
        n = len(numbers)
        if name == "stddev":
            spread = sum(x * x for x in numbers) / n - (sum(numbers) / n) ** 2
            return [math.sqrt(spread)] if spread >= 0 else []
        return [{"sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / n}[name](numbers)]
    if name == "keys":
        return [k for x in nodes if isinstance(x, dict) for k in sorted(x)]
    if name == "values":
        return [x[k] for x in nodes if isinstance(x, dict) for k in sorted(x)]
    extra = [y for a in args for y in value(a)]
    if name == "concat":
        flat = [y for x in nodes for y in (x if isinstance(x, list) else [x])]
        return ["".join(as_text(y) for y in [*flat, *extra])]
    return [[*x, *extra] for x in nodes if isinstance(x, list)]  # append


def select(path: Path, root: object, context: object = None) -> list:
    nodes = [context if path.root == "@" else root]
    for seg in path.segments:
        if seg.kind == "call":
            nodes = _call(*seg.value, nodes, root)
        else:
            out: list = []
            for n in nodes:
                _select(seg, n, root, out)
            nodes = out
    return nodes


def _test(test: tuple, item: object, root: object) -> bool:
    name = test[0]
    if name == "or":
        return any(_test(t, item, root) for t in test[1:])
    if name == "and":
        return all(_test(t, item, root) for t in test[1:])
    if name == "not":
        return not _test(test[1], item, root)
    value = lambda a: (select(a, root, item) if isinstance(a, Path) else [list(a) if isinstance(a, tuple) else a])
    left = value(test[1])
    if name == "exists":
        return bool(left) and (isinstance(test[1], Path) or bool(left[0]))
    if not left:
        return False  # a missing path
    a = left[0]
    right = value(test[2])
    if not right:
        return False
    b = right[0]
    if name == "==":
        return _equal(a, b)
    if name == "!=":
        comparable = type(a) is type(b) or (_number(a) is not None and _number(b) is not None)
        return comparable and not _equal(a, b)
    if name == "=~":
        return isinstance(a, str) and bool((b if isinstance(b, re.Pattern) else re.compile(str(b))).search(a))
    if name in (">", ">=", "<", "<="):
        x, y = _number(a), _number(b)
        return x is not None and y is not None and {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[name]
    if name == "empty":
        return isinstance(a, list | dict | str) and (len(a) == 0) == bool(b)
    if name == "size":
        return isinstance(a, list | dict | str) and len(a) == _number(b)
    if not isinstance(b, list):
        return False
    if name in ("in", "nin"):
        return any(_equal(a, x) for x in b) == (name == "in")
    if not isinstance(a, list):
        return False
    if name in ("anyof", "noneof"):
        return any(_equal(x, y) for x in a for y in b) == (name == "anyof")
    return all(any(_equal(x, y) for y in b) for x in a)  # subsetof


def as_text(v: object) -> str:
    """Strings as they are, null as null, numbers and nested values as compact JSON with sorted keys."""
    if isinstance(v, str):
        return v
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return f"{v:.1f}"
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def split_top(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside quotation and brackets."""
    out, depth, quote, start, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth <= 0 and text.startswith(mark, i):
            out.append(text[start:i])
            i += len(mark)
            start = i
            continue
        i += 1
    return [*out, text[start:]]


def interleave(branches: list[list[str]]) -> list[str]:
    """First of each, second of each ...; empty branches don't count; as long as the first that isn't."""
    full = [b for b in branches if b]
    return [b[i] for i in range(len(full[0])) for b in full if i < len(b)] if full else []


@lru_cache(1024)
def expression(text: str) -> tuple:
    """A path expression as data: (operator, parts), (append, literal, inner) or (path, segments)."""
    text = text.strip()
    for mark in ("||", "%%", "&&"):
        if len(parts := split_top(text, mark)) > 1:
            return (mark, *(expression(p) for p in parts))
    if text.startswith("{") and (end := text.find("}")) > 0 and text[1:].lstrip().startswith("$"):
        return ("append", text[end + 1 :], expression(text[1:end]))
    return ("path", parse(text))


def evaluate(text: str, value: object) -> list[str]:
    """A path expression as texts: || takes the first branch with a result, then %% interleaves, then
    && joins; {path}literal appends the literal to each result."""
    return _results(expression(text), value)


def _results(e: tuple, value: object) -> list[str]:
    if e[0] == "path":
        return [as_text(x) for x in select(e[1], value)]
    if e[0] == "append":
        return [x + e[1] for x in _results(e[2], value)]
    if e[0] == "||":
        return next((r for p in e[1:] if (r := _results(p, value))), [])
    found = [_results(p, value) for p in e[1:]]
    return interleave(found) if e[0] == "%%" else [x for r in found for x in r]
