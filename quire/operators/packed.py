"""Several values packed in one field: one row per value, with its place in the field.

The work is done on Arrow string buffers: code points, quote parity and delimiter masks are numpy
arrays over a whole batch, child offsets come from the masks, and the values are compacted into one
list array that is flattened with its parents' ordinals. Object notations (JSON, and literals with bare
keys, single quotation marks or commas too many) are read by masks as well: which places lie in strings,
how deep each bracket is, which token may follow which. What these rules don't cover, such as lists
within lists or objects as values, is parsed value by value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space, list marks of either width, line ends, quotation marks (code points).
BLANKS = [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
LINE_ENDS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]
LIST_MARKS = [ord(c) for c in ",，、､;；|｜/／&＆"]
STRAIGHT, OPEN, CLOSE = [0x22, 0xFF02], [0x201C], [0x201D]


@dataclass
class Text:
    """A batch's strings as bytes, code points and rows."""

    data: np.ndarray  # bytes
    lead: np.ndarray  # byte of each code point, and the end
    codes: np.ndarray
    bounds: np.ndarray  # code point at which each row starts, and the end

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def scan(column: pa.Array) -> Text:
    """Code points of an Arrow string array; nulls count as empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, len(data)))
    at = lambda k: data[np.minimum(lead + k, max(len(data) - 1, 0))].astype(np.uint32)
    codes = at(0) if len(lead) else np.zeros(0, np.uint32)
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        if (sized := size == n).any():
            code = at(0) & mask
            for k in range(1, n):
                code = (code << 6) | (at(k) & 0x3F)
            codes = np.where(sized, code, codes)
    return Text(data, np.append(lead, len(data)), codes, np.searchsorted(lead, ends - ends[0]))


def running(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and at the end."""
    return np.concatenate([[0], np.cumsum(mask)])


def quoted(t: Text, curly: bool = True) -> np.ndarray:
    """Which code points lie inside quotation marks. An odd last straight mark opens nothing; unequal
    curly ones protect nothing in their row."""
    straight = np.isin(t.codes, STRAIGHT)
    n = running(straight)
    per_row = np.diff(n[t.bounds])
    if (odd := per_row % 2 == 1).any():
        straight = straight.copy()
        straight[np.flatnonzero(straight)[n[t.bounds[1:]][odd] - 1]] = False
        n = running(straight)
    rows = t.rows
    inside = (n[1:] - n[t.bounds[:-1]][rows]) % 2 == 1
    if curly:
        o, c = running(np.isin(t.codes, OPEN)), running(np.isin(t.codes, CLOSE))
        depth = (o - c)[1:] - (o - c)[t.bounds[:-1]][rows]
        even = np.diff(o[t.bounds]) == np.diff(c[t.bounds])
        inside |= (depth > 0) & even[rows]
    return inside


class Trim:
    """Cuts blanks from both ends of many ranges at once."""

    def __init__(self, codes: np.ndarray):
        n, full = len(codes), ~np.isin(codes, BLANKS + LINE_ENDS)
        place = np.arange(n)
        self.next = np.append(np.minimum.accumulate(np.where(full, place, n)[::-1])[::-1], n)
        self.last = np.append(-1, np.maximum.accumulate(np.where(full, place, -1)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.minimum(self.next[start], end)
        return start, np.maximum(self.last[end] + 1, start)


def ranges(t: Text, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of what lies between separators."""
    cut = np.flatnonzero(separator)
    start = np.sort(np.concatenate([t.bounds[:-1], cut + 1]))
    end = np.sort(np.concatenate([cut, t.bounds[1:]]))
    parent = np.repeat(np.arange(len(t.bounds) - 1), np.diff(running(separator)[t.bounds]) + 1)
    return start, end, parent


def slices(t: Text, trim: Trim, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The ranges as strings: outer blanks and enclosing quotation marks go, a doubled mark is one."""
    start, end = trim(start, end)
    long = end - start >= 2
    first = t.codes[np.where(long, start, 0)] if len(t.codes) else np.zeros(len(start), np.uint32)
    final = t.codes[np.where(long, end - 1, 0)] if len(t.codes) else first
    marks = running(np.isin(t.codes, STRAIGHT))
    straight = long & np.isin(first, STRAIGHT) & np.isin(final, STRAIGHT)
    bare = straight & (marks[end] - marks[start] == 2)
    both = running(np.isin(t.codes, OPEN + CLOSE))
    bare |= long & np.isin(first, OPEN) & np.isin(final, CLOSE) & (both[end] - both[start] == 2)
    doubled = straight & ~bare & (marks[end] - marks[start] > 2)
    start, end = trim(np.where(bare, start + 1, start), np.where(bare, end - 1, end))
    low, high = t.lead[start], t.lead[end]
    size = high - low
    offsets = running(size)[:-1] if len(size) == 0 else np.concatenate([[0], np.cumsum(size)])
    data = t.data[np.repeat(low - offsets[: len(low)], size) + np.arange(int(size.sum()))] if size.sum() else np.zeros(0, np.uint8)
    out = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    if doubled.any():
        old = out.filter(pa.array(doubled)).to_pylist()
        new = [s[1:-1].replace('""', '"').replace("＂＂", "＂").strip() if re.fullmatch(r'(?:[^"＂]|""|＂＂)*', s[1:-1]) else s for s in old]
        out = pc.replace_with_mask(out, pa.array(doubled), pa.array(new, pa.large_string()))
    return out


def numbered(parent: np.ndarray, items: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Drops empty items, builds the list array of the rows and flattens it: parent, place, item."""
    keep = pc.fill_null(pc.not_equal(items, ""), False)
    items, parent = items.filter(keep), parent[keep.to_numpy(zero_copy_only=False)]
    offsets = np.searchsorted(parent, np.arange(rows + 1))
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), items)
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return parent, np.arange(len(parent)) - offsets[parent], lists.flatten()


def split_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Values of a list field. Blanks separate only in a row without any list mark outside quotation."""
    t = scan(column)
    outside = ~quoted(t)
    mark = np.isin(t.codes, LIST_MARKS + LINE_ENDS) & outside
    without = np.diff(running(mark)[t.bounds]) == 0
    mark |= np.isin(t.codes, BLANKS) & outside & without[t.rows]
    start, end, parent = ranges(t, mark)
    return numbered(parent, slices(t, Trim(t.codes), start, end), len(column))


def split_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Entries title::url separated by && or line ends, written out or as backslash and letter."""
    t = scan(column)
    outside = ~quoted(t, curly=False)
    code, rows = t.codes, t.rows
    same = np.append(rows[1:] == rows[:-1], False) if len(rows) else np.zeros(0, bool)
    then = lambda a, *b: (code == a) & same & np.isin(np.append(code[1:], 0), b)
    pair = (then(0x26, 0x26) | then(0x5C, ord("n"), ord("r"))) & outside
    mark = (pair | np.concatenate([[False], pair[:-1]]) if len(pair) else pair) | np.isin(code, [0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]) & outside
    start, end, parent = ranges(t, mark)
    colons = np.flatnonzero(then(0x3A, 0x3A) & outside)
    first = np.append(colons, len(code) + 2)[np.searchsorted(colons, start)]
    has = first + 1 < end
    trim = Trim(code)
    title = slices(t, trim, start, np.where(has, first, end))
    url = slices(t, trim, np.where(has, first + 2, end), end)
    return numbered(parent, entry(title, url), len(column))


def entry(title: pa.Array, url: pa.Array) -> pa.Array:
    with_url = pc.binary_join_element_wise(title, url, pa.scalar("::", title.type))
    return pc.if_else(pc.equal(url, ""), title, with_url)


# ---- object notation --------------------------------------------------------------------------

TOKEN = re.compile(r"""\s*(?:([\[\]{},:])|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^\s\[\]{},:"']+))""", re.DOTALL)
ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.DOTALL)
PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def plain_text(s: str) -> str:
    """s without halves of surrogate pairs, which are no text."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unescape(s: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else PLAIN.get(m[1], m[1]), s) if "\\" in s else s


def lenient(text: str):
    """Arrays and objects with bare keys, single quotation marks or commas too many. ValueError if
    the text is something else. An explicit stack holds the open ones, so depth costs no recursion."""
    top: list = []
    stack: list = [top]
    keys: list = [None]
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise ValueError("not an object notation")
            break
        at = m.end()
        mark, here = m[1], stack[-1]
        if mark in ("[", "{"):
            value: object = [] if mark == "[" else {}
        elif mark in ("]", "}"):
            if len(stack) == 1 or isinstance(here, list) != (mark == "]"):
                raise ValueError("unbalanced")
            stack.pop()
            keys.pop()
            continue
        elif mark:
            continue
        else:
            value = unescape(m[2] if m[2] is not None else m[3]) if m[4] is None else {"null": None, "true": True, "false": False}.get(m[4], m[4])
        if isinstance(here, dict):
            if keys[-1] is None and mark is None:
                keys[-1] = "" if value is None else str(value)
                continue
            if keys[-1] is None:
                raise ValueError("a value without a name")
            here[keys[-1]] = value
            keys[-1] = None
        else:
            here.append(value)
        if mark:
            stack.append(value)
            keys.append(None)
    if len(stack) != 1 or len(top) != 1 or not isinstance(top[0], list | dict):
        raise ValueError("not one array or object")
    return top[0]


def objects(text: str) -> list[str] | None:
    """Entries of an array of objects, or None if the text isn't one."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        try:
            value = lenient(text)
        except ValueError:
            return None
    if isinstance(value, dict):
        value = [value]
    if not isinstance(value, list):
        return None
    word = lambda x: "" if x is None else str(x).strip() if not isinstance(x, list | dict) else json.dumps(x, ensure_ascii=False)
    out = []
    for x in value:
        if isinstance(x, dict):
            title, url = word(x.get("title")), word(x.get("url"))
            out.append(f"{title}::{url}" if url else title)
        else:
            out.append(word(x))
    return [plain_text(x) for x in out if x]


OPEN_LIST, CLOSE_LIST, OPEN_OBJECT, CLOSE_OBJECT, COMMA, COLON, STRING, BARE = range(8)
MARKS = [ord(c) for c in "[]{},:"]
SCALAR = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"
# What a code point may be, as bits of a table over the first plane; others are none of it.
MARK, BLANK, OTHER_BLANK, CONTROL, HEX, ESCAPED, NO_BARE = (1 << k for k in range(7))
CLASSES = np.zeros(0x10000, np.uint8)
for _bit, _codes in ((MARK, MARKS), (BLANK, BLANKS + LINE_ENDS), (OTHER_BLANK, [c for c in BLANKS + LINE_ENDS if c not in (0x20, 0x09, 0x0A, 0x0D)]), (CONTROL, range(0x20)), (HEX, map(ord, "0123456789abcdefABCDEF")), (ESCAPED, map(ord, '"\\/bfnrtu')), (NO_BARE, [0x22, 0x27, *range(0x1C, 0x20)])):
    CLASSES[list(_codes)] |= _bit
KIND_OF = np.zeros(0x80, np.int64)
KIND_OF[MARKS] = np.arange(len(MARKS))
DEEPEST = 32  # brackets within brackets; deeper values are parsed by themselves


def cut_out(t: Text, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The ranges of code points as strings, as they are."""
    low, size = t.lead[start], t.lead[end] - t.lead[start]
    offsets = running(size).astype(np.int64)
    data = t.data[np.repeat(low - offsets[:-1], size) + np.arange(int(offsets[-1]))] if offsets[-1] else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))


def split_objects(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Which rows are arrays of objects or texts, or one object, that masks can read; and of those the
    row, place and text of each entry title::url, empty ones dropped.

    The same entries as objects() gives. A row counts as JSON, or, if it has a single-quoted text, a
    bare key, a comma before a bracket or the like, as the lenient notation.
    """
    t = scan(column)
    n_rows, n = len(t.bounds) - 1, len(t.codes)
    code, rows = t.codes, t.rows
    first_of_row = t.bounds[:-1][rows] if n else np.zeros(0, np.int64)
    place = np.arange(n)
    own = CLASSES[np.minimum(code, 0xFFFF)]
    per_row = lambda mask: np.bincount(rows[np.flatnonzero(mask)], minlength=n_rows)
    any_of = lambda mask: per_row(mask) > 0
    after_ = np.append(own[1:], 0) if n else own

    # strings: quotation marks that no odd number of backslashes stands before; one kind for a row
    slash = code == 0x5C
    escaped = np.zeros(n, bool)
    if len(runs := np.flatnonzero(slash)):  # every second one of a run, and what stands after an odd run
        begin = np.append(True, (np.diff(runs) > 1) | (rows[runs[1:]] != rows[runs[:-1]]))
        length = runs - runs[np.maximum.accumulate(np.where(begin, np.arange(len(runs)), 0))]
        escaped[runs[length % 2 == 1]] = True
        left = runs[(length % 2 == 0) & (runs + 1 < n)]
        left = left[rows[np.minimum(left + 1, n - 1)] == rows[left]] + 1
        escaped[left] = True
    double, single = code == 0x22, code == 0x27
    by_single = ~any_of(double) & any_of(single)
    quote = np.where(by_single[rows], single, double) & ~escaped
    count = running(quote)
    odd = (count[:-1] - count[first_of_row]) % 2 == 1 if n else np.zeros(0, bool)
    inside = odd & ~quote
    outside = ~odd & ~quote
    good = per_row(quote) % 2 == 0
    lenient_row = by_single | any_of(inside & ((own & CONTROL) > 0)) | any_of(slash & inside & ~escaped & ((after_ & ESCAPED) == 0))
    hexed = np.flatnonzero(escaped & (code == ord("u")) & inside)
    four = np.ones(len(hexed), bool)
    for k in range(1, 5):
        four &= (own[np.minimum(hexed + k, n - 1)] & HEX) > 0 if n else four
    lenient_row |= np.bincount(rows[hexed[~four]], minlength=n_rows) > 0

    # tokens
    blank = outside & ((own & BLANK) > 0)
    lenient_row |= any_of(outside & ((own & OTHER_BLANK) > 0))
    mark = outside & ((own & MARK) > 0)
    bare = outside & ~blank & ~mark
    good &= ~any_of(bare & ((own & NO_BARE) > 0))
    starts = bare & ~(np.append(False, bare[:-1]) & (np.append(-1, rows[:-1]) == rows)) if n else bare
    ends = bare & ~(np.append(bare[1:], False) & (np.append(rows[1:], -1) == rows)) if n else bare
    opening = quote & ~odd
    at = np.flatnonzero(opening | mark | starts)
    row = rows[at]
    kind = np.full(len(at), BARE)
    kind[opening[at]] = STRING
    marked = mark[at]
    kind[marked] = KIND_OF[code[at[marked]]]
    end = at + 1
    end[kind == BARE] = np.flatnonzero(ends) + 1
    closing = np.flatnonzero(quote & odd)
    opened = np.flatnonzero(opening)
    if len(opened) != len(closing):  # in rows with an odd number; pair within the others
        ok = good[rows]
        closing, opened = np.flatnonzero(quote & odd & ok), np.flatnonzero(opening & ok)
    close_of = np.full(n + 1, 0)
    close_of[opened] = closing
    end[kind == STRING] = close_of[at[kind == STRING]]

    # depth, and what kind of bracket each token is in
    opens, shuts = np.isin(kind, [OPEN_LIST, OPEN_OBJECT]), np.isin(kind, [CLOSE_LIST, CLOSE_OBJECT])
    total = running(opens.astype(np.int64) - shuts)
    row_from = np.searchsorted(row, np.arange(n_rows))
    row_to = np.searchsorted(row, np.arange(n_rows), side="right")
    depth = total[1:] - total[row_from[row]] if len(at) else np.zeros(0, np.int64)
    token_any = lambda mask: np.bincount(row[mask], minlength=n_rows) > 0
    good &= (row_to > row_from) & ~token_any(depth < 0) & ~token_any(depth > DEEPEST) & (total[row_to] == total[row_from])
    places = np.arange(len(at))
    inner = np.full(len(at), -1)
    for k in range(1, min(int(depth.max(initial=0)), DEEPEST) + 1):
        latest = np.maximum.accumulate(np.where(opens & (depth == k), places, -1))
        own = depth == k
        inner[own] = kind[latest[own]]

    # which token may follow which
    first, final = np.zeros(len(at), bool), np.zeros(len(at), bool)
    first[row_from[row_to > row_from]] = True
    final[row_to[row_to > row_from] - 1] = True
    prev = np.append(-1, kind[:-1])
    prev[first] = -1
    after = np.append(kind[1:], -1)
    after[final] = -1
    in_object = inner == OPEN_OBJECT
    is_key = np.isin(kind, [STRING, BARE]) & in_object & np.isin(prev, [OPEN_OBJECT, COMMA])
    value_next = np.isin(after, [OPEN_LIST, OPEN_OBJECT, STRING, BARE])
    ended = (np.isin(kind, [STRING, BARE]) & ~is_key) | shuts
    shut_next = after == np.where(in_object, CLOSE_OBJECT, CLOSE_LIST)
    fine = np.select(
        [kind == OPEN_LIST, kind == OPEN_OBJECT, kind == COMMA, kind == COLON, is_key, ended & (depth == 0), ended],
        [value_next | (after == CLOSE_LIST), np.isin(after, [STRING, BARE, CLOSE_OBJECT]), np.where(in_object, np.isin(after, [STRING, BARE]), value_next) | shut_next, value_next & in_object, after == COLON, final, (after == COMMA) | shut_next],
        False,
    )
    good &= ~token_any(~fine) & ~token_any(first & ~opens)
    lenient_row |= token_any(is_key & (kind == BARE)) | token_any((kind == COMMA) & shut_next)
    values = np.flatnonzero((kind == BARE) & ~is_key)
    plain = pc.match_substring_regex(cut_out(t, at[values], end[values]), SCALAR).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, bool)
    lenient_row |= np.bincount(row[values[~plain]], minlength=n_rows) > 0

    # entries: objects and texts of the outer array, or the outer object
    outer_object = np.zeros(n_rows, bool)
    outer_object[row[first & (kind == OPEN_OBJECT)]] = True
    level = np.where(outer_object, 1, 2)[row]
    entry_open = (kind == OPEN_OBJECT) & (depth == level)
    text_entry = (kind == STRING) & (depth == 1) & (inner == OPEN_LIST)
    good &= ~token_any((kind == OPEN_LIST) & (depth == 2) & ~outer_object[row]) & ~token_any((kind == BARE) & (depth == 1) & (inner == OPEN_LIST))
    ordinal = running(entry_open)[1:] - 1
    member = is_key & (depth == level)
    escapes = running(slash & inside)
    has_escape = np.zeros(len(at), bool)
    has_escape[kind == STRING] = escapes[end[kind == STRING]] > escapes[at[kind == STRING]]
    good &= ~token_any(member & has_escape)
    start = at + (kind == STRING)
    number = int(entry_open.sum())
    held: dict[str, np.ndarray] = {}
    for name in ("title", "url"):
        found = member & (end - start == len(name))
        for k, c in enumerate(name):
            found[found] = code[start[found] + k] == ord(c)
        held[name] = np.full(number, -1)
        keys = np.flatnonzero(found & (places + 2 < len(at)))
        held[name][ordinal[keys]] = keys + 2  # of a name repeated in one object the last counts
    used = np.concatenate([held["title"], held["url"]])
    used = used[used >= 0]
    bad_value = opens[used]
    words = used[kind[used] == BARE]
    word_text = cut_out(t, at[words], end[words])
    whole = pc.match_substring_regex(word_text, r"^(?:null|-?(?:0|[1-9][0-9]{0,17}))$").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)
    for tokens in (used[bad_value], words[~whole]):
        good[row[tokens]] = False

    def texts(tokens: np.ndarray) -> pa.Array:
        """The values of tokens (-1: none) as trimmed text."""
        there = np.where(tokens >= 0, tokens, 0) if len(at) else tokens
        usable = (tokens >= 0) & good[row[there]] if len(at) else np.zeros(len(tokens), bool)
        a, b = np.where(usable, start[there], 0), np.where(usable, end[there], 0)
        out = cut_out(t, a, b)
        none = usable & (kind[there] == BARE) & pc.equal(out, "null").to_numpy(zero_copy_only=False)
        out = pc.if_else(pa.array(none), pa.scalar("", pa.large_string()), out)
        special = usable & has_escape[there]
        if special.any():
            easy = lenient_row[row[there[special]]]
            new = [plain_text(unescape(s)) if lax else plain_text(json.loads(f'"{s}"')) for s, lax in zip(out.filter(pa.array(special)).to_pylist(), easy)]
            out = pc.replace_with_mask(out, pa.array(special), pa.array(new, pa.large_string()))
        return pc.utf8_trim_whitespace(out)

    if not len(at):
        return good, np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    object_at = np.flatnonzero(entry_open)
    text_at = np.flatnonzero(text_entry)
    items = pa.concat_arrays([entry(texts(held["title"]), texts(held["url"])), texts(text_at)])
    token = np.concatenate([object_at, text_at])
    order = np.argsort(token, kind="stable")
    order = order[good[row[token[order]]]]
    parent, where, out = numbered(row[token[order]], items.take(pa.array(order)), n_rows)
    return good, parent, where, out


def split_entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Titled entries in any notation: object arrays, lines or && lists; scripts give none."""
    text = pc.fill_null(column, "")
    start = pc.utf8_ltrim_whitespace(text)
    script = pc.match_substring_regex(start, r"^(?:@[jJ][sS]:|<[jJ][sS]>)").to_numpy(zero_copy_only=False)
    notation = pc.match_substring_regex(start, r"^[\[{]").to_numpy(zero_copy_only=False)
    special = np.flatnonzero(notation)
    read, p, k, v = split_objects(text.take(pa.array(special)))
    parts = [(special[p], k, v)]
    lines = pc.if_else(pa.array(script | notation), pa.scalar("", column.type), text)
    rest = special[~read]
    if len(rest):
        alone = [objects(text[int(r)].as_py()) for r in rest]
        plain = np.array([x is None for x in alone])  # no object notation after all
        mask = np.zeros(len(text), bool)
        mask[rest[plain]] = True
        lines = pc.if_else(pa.array(mask), text, lines)
        sizes = [len(x or ()) for x in alone]
        parts.append((np.repeat(rest, sizes), np.concatenate([np.arange(n) for n in sizes]).astype(np.int64), pa.array([y for x in alone for y in x or ()], pa.large_string())))
    parts.append(split_lines(lines))
    return np.concatenate([p for p, _, _ in parts]).astype(np.int64), np.concatenate([k for _, k, _ in parts]).astype(np.int64), pa.concat_arrays([v for _, _, v in parts])


SPLITTERS = {"list": split_list, "entries": split_entries}


def split_packed(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row per value of each field: key, field_name, pos (from 0), item.

    fields: the notation of each field, ``list`` or ``entries``. Null, empty and blank fields give no
    row; values that are empty after trimming are dropped and take no place; repeated values stay,
    each at its own place; other columns of df are ignored, so their names can't clash. A narrow
    operation: no shuffle, and no row is ever larger than its field.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, field_name string, pos int, item string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for k, (field, notation) in enumerate(fields.items()):
                column = batch.column(k + 1)
                if not pa.types.is_large_string(column.type):
                    column = column.cast(pa.large_string())  # a flattened batch may pass 2 GB
                parent, place, item = SPLITTERS[notation](column)
                if len(parent):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(parent)), pa.repeat(field, len(parent)), pa.array(place, pa.int32()), item.cast(pa.string())], [key, "field_name", "pos", "item"])

    names = [key, *fields]
    return df.select(*[F.col(f"`{c}`") for c in names]).filter(F.coalesce(*[F.col(f"`{c}`") for c in fields]).isNotNull()).mapInArrow(run, schema)
