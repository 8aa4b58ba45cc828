"""Extraction rules as plans: parsed once on the driver, run over many documents by workers.

A raw rule is read in a fixed order: prefix of the mode, @put, @get, templates, the ## suffix, script
segments; then branches joined by the first of || && %% that stands outside quotation and brackets.
Step chains (regular expressions, JSONPath, CSS, XPath, fallbacks) are the explicit form of the same.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from quire.functions import dom, jsonpath
from quire.plans import scripts
from quire.plans.scripts import Unsupported

#: Scripts that are a name: value, variables → value. Others are read by quire.plans.scripts.
FUNCTIONS: dict[str, Callable[[str, dict[str, str]], str]] = {
    "trim": lambda v, _: v.strip(),
    "lower": lambda v, _: v.lower(),
    "upper": lambda v, _: v.upper(),
    "htmlFormat": lambda v, _: " ".join(dom.parse_html(v).text().split()),
}


def register(name: str, function: Callable[[str, dict[str, str]], str]) -> None:
    """Lets a script of this name run as a function of a value and the rule's variables. Scripts are
    looked up when a rule runs, so the function must be registered where workers import it."""
    FUNCTIONS[name] = function


class Document:
    """A text and what it parses to, each made once and only if a rule asks."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def html(self) -> dom.Node:
        return dom.parse_html(self.text)

    @cached_property
    def json(self) -> object:
        return json.loads(self.text)


# ---- CSS with steps -----------------------------------------------------------------------------

#: Words that take a value from an element; any other last part that isn't a selector is an attribute.
TAKES = {"text", "textnodes", "owntext", "html", "all"}
ATTRIBUTES = {"href", "src", "alt", "content", "value", "title", "data-src", "data-original", "id", "class"}


@dataclass(frozen=True)
class CssPlan:
    selects: tuple[tuple[str, int | None], ...]
    take: str

    def run(self, doc: Document) -> list[str]:
        found = [doc.html]
        for select, place in self.selects:
            own = [x for n in found for x in (n.elements() if select == "children" else dom.query(n, select))]
            unique = list({id(x): x for x in own}.values())
            found = unique if place is None else [unique[place]] if -len(unique) <= place < len(unique) else []
        if not self.selects:
            found = found[0].elements()[:1] or found
        return take(found, self.take)


def take(found: list[dom.Node], how: str) -> list[str]:
    low = how.lower()
    if low == "text":
        return [n.text() for n in found]
    if low == "textnodes":
        return [n.raw_text().strip() for n in found]
    if low == "owntext":
        return [t for n in found if (t := n.own_text())]
    if low in ("html", "all"):
        return [t for n in found if (t := n.outer_html())]
    return [n.attrs[low] for n in found if low in n.attrs]


def css_step(part: str) -> tuple[str, int | None]:
    """class.a b, tag.x, id.x as selectors, and a place at the end: .0, .-1."""
    place = None
    if m := re.fullmatch(r"(.+?)\.(-?\d+)", part):
        part, place = m[1], int(m[2])
    if part.startswith("class."):
        part = "." + ".".join(part[6:].split())
    elif part.startswith("tag."):
        part = part[4:]
    elif part.startswith("id."):
        part = "#" + part[3:]
    elif part.startswith("text."):
        part = f":containsOwn({part[5:]})"
    if part != "children":
        dom.selector(part)
    return part, place


def css_plan(rule: str) -> CssPlan:
    parts = [p.strip() for p in jsonpath.split_top(rule, "@") if p.strip()]
    last = parts[-1] if parts else "text"
    is_take = last.lower() in TAKES | ATTRIBUTES or (len(parts) > 1 and bool(re.fullmatch(r"data-[\w-]+|[a-z]+", last)) and "." not in last)
    return CssPlan(tuple(css_step(p) for p in (parts[:-1] if is_take else parts)), last if is_take else "text")


# ---- raw rules ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Suffix:
    """##pattern##replacement, a third ## for the first match alone."""

    pattern: str
    replacement: str = ""
    first_only: bool = False

    @cached_property
    def regex(self) -> re.Pattern[str] | None:
        try:
            return re.compile(self.pattern)
        except re.error:
            return None

    def apply(self, value: str) -> str:
        new = re.sub(r"\$(\d+|\{\w+\})", lambda m: rf"\g<{m[1].strip('{}')}>", self.replacement.replace("\\", "\\\\"))
        try:
            if self.first_only:
                if self.regex is None:
                    return self.replacement
                m = self.regex.search(value)
                return m.expand(new) if m else ""
            return value.replace(self.pattern, self.replacement) if self.regex is None else self.regex.sub(new, value)
        except (re.error, IndexError):
            return value


def mode_of(rule: str) -> tuple[str, str]:
    for prefix, mode in (("@css:", "css"), ("@@", "css"), ("@xpath:", "xpath"), ("@json:", "json")):
        if rule[: len(prefix)].lower() == prefix:
            return mode, rule[len(prefix) :]
    if rule.startswith(("$.", "$[")):
        return "json", rule
    return ("xpath", rule) if rule.startswith("/") else ("css", rule)


def branches(rule: str) -> tuple[str, list[str]]:
    """The first operator outside quotation and brackets splits, unless it leaves a branch empty."""
    at = {op: len(parts[0]) for op in ("||", "&&", "%%") if len(parts := jsonpath.split_top(rule, op)) > 1}
    if at:
        op = min(at, key=lambda k: at[k])
        parts = [p.strip() for p in jsonpath.split_top(rule, op)]
        if all(parts):
            return op, parts
    return "", [rule]


def combine(op: str, results: list[list[str]]) -> list[str]:
    if op == "||":
        return next((r for r in results if r), [])
    return jsonpath.interleave(results) if op == "%%" else [x for r in results for x in r]


@dataclass(frozen=True)
class Segment:
    """A stretch of a rule: branches of selectors joined by an operator, or a script."""

    op: str = ""
    selectors: tuple[str, ...] = ()
    script: str = ""


@dataclass(frozen=True)
class RawRule:
    """Segments run in turn: each value of one goes to the next; a value that a script or a later
    selector can't take is dropped. A script that nothing stands for is Unsupported if no value is left."""

    mode: str
    segments: tuple[Segment, ...]
    suffix: Suffix | None = None
    puts: tuple[tuple[str, str], ...] = ()
    gets: bool = False

    def run(self, doc: Document, scope: dict[str, str] | None = None) -> list[str]:
        scope = {} if scope is None else scope
        for name, rule in self.puts:
            scope[name] = next(iter(compile_rule(rule).run(doc, scope)), "") if rule.startswith(("$", "/", "@", ".", "#")) else rule
        values: list[str] = []
        for k, segment in enumerate(self.segments):
            if k == 0:
                values = [doc.text] if segment.script else self.select(doc, segment, scope)
                if not segment.script:
                    continue
            found: list[str] = []
            failed: ValueError | None = None
            for v in values:
                try:
                    found += [run_script(segment.script, v, scope)] if segment.script else self.select(Document(v), segment, scope)
                except ValueError as e:
                    failed = e
            if failed and not found and segment.script:
                raise failed
            values = found
        return [self.suffix.apply(v) for v in values] if self.suffix else values

    def select(self, doc: Document, segment: Segment, scope: dict[str, str]) -> list[str]:
        selectors = [substitute(s, scope, doc) for s in segment.selectors] if self.gets else segment.selectors
        results = [self.one(doc, s) for s in selectors]
        return combine(segment.op, results) if segment.op else results[0]

    def one(self, doc: Document, selector: str) -> list[str]:
        if not selector:
            return [doc.text]
        if self.mode == "json":
            return jsonpath.evaluate(selector, doc.json)
        return dom.xpath(doc.html, selector) if self.mode == "xpath" else css_plan_of(selector).run(doc)


css_plan_of = lru_cache(4096)(css_plan)


def substitute(text: str, scope: dict[str, str], doc: Document | None = None) -> str:
    """@get:{name} by the variable or nothing; {{$.path}} by its first value or nothing, {{name}} by the
    variable, any other {{script}} by its value; what has none is left as it is."""
    text = re.sub(r"@get:\{([^}]*)\}", lambda m: scope.get(m[1], ""), text)

    def template(m: re.Match[str]) -> str:
        inner = m[1].strip()
        if inner.startswith("$") and doc is not None:
            try:
                return next(iter(jsonpath.evaluate(inner, doc.json)), "")
            except ValueError:
                return ""
        if inner in scope or re.fullmatch(r"[\w.-]+", inner):
            return scope.get(inner, m[0])
        try:
            return run_script(inner, doc.text if doc is not None else "", scope)
        except ValueError:
            return m[0]

    return re.sub(r"\{\{(.+?)\}\}", template, text)


def run_script(source: str, value: str, scope: dict[str, str]) -> str:
    """A script's value as text: a named function, or a script in the language of quire.plans.scripts."""
    if own := FUNCTIONS.get(source.strip().rstrip(";")):
        return own(value, scope)
    found = scripts.evaluate(source, value, scope)
    if found is None:
        raise ValueError("a script without a value")
    return scripts.text(found)


@lru_cache(4096)
def compile_rule(rule: str) -> RawRule:
    """A raw rule's plan. ValueError if a selector in it can't be read."""
    rule = rule.strip()
    puts: list[tuple[str, str]] = []

    def put(m: re.Match[str]) -> str:
        try:
            puts.extend((k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in json.loads(m[1]).items())
        except (ValueError, AttributeError):
            pass
        return ""

    rule = re.sub(r"@put:(\{[^}]*\})", put, rule)
    mode, body = mode_of(rule)
    body, _, tail = body.partition("##")
    suffix = None
    if tail:
        parts = tail.split("##")
        suffix = Suffix(parts[0], parts[1] if len(parts) > 1 else "", len(parts) > 2)
    gets = "@get:" in body or "{{" in body
    segments: list[Segment] = []
    pieces = re.split(r"<js>(.*?)</js>|@js:(.*)", body, flags=re.S)
    for k, piece in enumerate(pieces):
        text = (piece or "").strip()
        if k % 3:
            segments += [Segment(script=text)] if text else []
        elif text or len(pieces) == 1:
            op, selectors = branches(text)
            segments.append(Segment(op, tuple(selectors)))
            if not gets:
                check(mode, selectors)
    return RawRule(mode, tuple(segments), suffix, tuple(puts), gets)


def check(mode: str, selectors: list[str]) -> None:
    """Fails on the driver what would fail in every row."""
    for s in selectors:
        if mode == "json":
            for p in re.split(r"\|\||%%|&&", s) if "?(" not in s else ():
                if p.strip().startswith("$"):
                    jsonpath.parse(p.strip())
        elif mode == "css" and s:
            css_plan_of(s)
        elif mode == "xpath" and (names := prefixes(s)):
            raise ValueError(f"undeclared prefix {names[0]!r} in {s!r}")


def prefixes(expression: str) -> list[str]:
    """Namespace prefixes of an XPath expression; axes, and what stands in quotation marks, are none."""
    bare = re.sub(r"'[^']*'|\"[^\"]*\"", "''", expression)
    return re.findall(r"(?<![\w.-])([A-Za-z_][\w.-]*):(?!:)[A-Za-z_*]", bare)


IMAGE_TEXT = re.compile(r"(?:^|(?<=[@/])|(?<=&&|%%|\|\|))img((?:\[@?.+?\]|\.[-\w]+)?)([@/])[@/]*text(?:\(\))?(?=&&|%%|\|\||$)")


def repair_images(rule: str) -> str:
    """A rule that takes an image's text made one that takes its alternative text, as it has no other."""
    xpath = mode_of(rule.strip())[0] == "xpath"
    return IMAGE_TEXT.sub(lambda m: f"img{m[1]}{'/@' if xpath else '@'}alt", rule)


def complete(rule: str, kind: str = "text") -> str:
    """A rule for an element made one for its value: @text, @href or @src (//text(), /@href ... in
    XPath). JSON, scripts, templates and rules with a suffix stay."""
    r = repair_images(rule.strip())
    if not r or "##" in r or "{{" in r or "@js:" in r or "<js>" in r or mode_of(r)[0] == "json":
        return r
    if mode_of(r)[0] == "xpath":
        return r if re.search(r"(?:text\(\)|@[\w-]+|\))$", r) else r + {"text": "//text()", "href": "/@href", "src": "/@src"}[kind]
    op, parts = branches(r)
    done = [p if p.rpartition("@")[2].lower() in TAKES | ATTRIBUTES else f"{p}@{kind}" for p in parts]
    return op.join(done) if op else done[0]


# ---- step chains --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """kind: regex (pattern, group, first), replace (pattern, replacement, first), json, css (selector,
    attribute), xpath, fallback (values)."""

    kind: str
    pattern: str = ""
    replacement: str = ""
    group: int | str = 0
    first: bool = False
    values: tuple[str, ...] = field(default=())

    def check(self) -> Step:
        """Fails on the driver what would fail in every row."""
        if self.kind in ("regex", "replace"):
            own = re.compile(self.pattern)
            wanted = [self.group] if self.kind == "regex" else [w for w in re.findall(r"\$\{?(\w+)\}?", self.replacement.replace("$$", ""))]
            for w in wanted:
                if str(w).isdigit() and int(w) > own.groups or not str(w).isdigit() and w not in own.groupindex:
                    raise ValueError(f"no group {w} in {self.pattern!r}")
        elif self.kind == "json":
            jsonpath.parse(self.pattern) if not re.search(r"\|\||%%|&&|^\{", self.pattern) else None
        elif self.kind == "css":
            dom.selector(self.pattern)
        elif self.kind not in ("xpath", "fallback"):
            raise ValueError(f"unknown step {self.kind}")
        return self

    def run(self, value: str) -> list[str]:
        if self.kind == "regex":
            found = [m[self.group] for m in re.finditer(self.pattern, value) if m[self.group] is not None]
            return found[:1] if self.first else found
        if self.kind == "replace":
            new = re.sub(r"\$\$|\$\{?(\w+)\}?", lambda m: "$" if m[0] == "$$" else rf"\g<{m[1]}>", self.replacement.replace("\\", "\\\\"))
            return [re.sub(self.pattern, new, value, count=1 if self.first else 0)]
        if self.kind == "json":
            return jsonpath.evaluate(self.pattern, json.loads(value))
        if self.kind == "css":
            found = dom.query(dom.parse_html(value), self.pattern)
            return [n.inner_html() for n in found] if self.replacement == "html" else take(found, self.replacement or "text")
        if self.kind == "xpath":
            return dom.xpath(dom.parse_html(value), self.pattern)
        return list(self.values) if value == "" else [value]


@dataclass(frozen=True)
class Chain:
    """Steps from left to right: each value of one goes to the next, results in order. Nothing left
    ends the chain, unless a fallback comes later. A step's error names its place."""

    steps: tuple[Step, ...]

    def run(self, doc: Document, scope: dict[str, str] | None = None) -> list[str]:
        values = [doc.text]
        for k, step in enumerate(self.steps):
            if not values:
                rest = [s for s in self.steps[k:] if s.kind == "fallback"]
                return list(rest[0].values) if rest else []
            try:
                values = [x for v in values for x in step.run(v)]
            except (ValueError, re.error) as e:
                raise ValueError(f"step {k}: {e}") from e
        return values


def compile_steps(spec: list[dict]) -> Chain:
    names = {"regexExtract": "regex", "regexReplace": "replace", "jsonPath": "json", "css": "css", "xPath": "xpath", "xpath": "xpath", "fallback": "fallback"}
    out = []
    for s in spec:
        kind = names.get(s.get("kind", ""), s.get("kind", ""))
        pattern = s.get("pattern") or s.get("path") or s.get("selector") or s.get("expression") or ""
        out.append(Step(kind, pattern, s.get("replacement") or s.get("attribute") or "", s.get("group", 0), bool(s.get("first", False)), tuple(s.get("values", ()))).check())
    return Chain(tuple(out))


def compile_any(rule: str | list[dict] | None) -> RawRule | Chain | None:
    if not rule:
        return None
    return compile_steps(rule) if isinstance(rule, list) else compile_rule(rule)
