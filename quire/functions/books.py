"""Local books and feeds: detection, decoding, chapters, packages, feed formats. Pure functions."""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import zipfile
import zlib
from urllib.parse import unquote
from xml.etree import ElementTree

from quire.functions import dom

# ---- bytes --------------------------------------------------------------------------------------


def detect(data: bytes) -> str:
    """epub, zip, pdf, mobi, tar, feed, json, html or text, from the first bytes."""
    head = data[:4096]
    if head.startswith(b"PK\x03\x04"):
        return "epub" if b"application/epub+zip" in head or b"META-INF/container.xml" in data[:65536] else "zip"
    if head.startswith(b"%PDF-"):
        return "pdf"
    if head[60:68] in (b"BOOKMOBI", b"TEXtREAd"):
        return "mobi"
    if head[257:262] == b"ustar":
        return "tar"
    text = head.lstrip(b"\xef\xbb\xbf \t\r\n")
    if text[:1] in (b"{", b"["):
        return "json"
    low = text[:512].lower()
    if b"<rss" in low or b"<feed" in low or b"<rdf:rdf" in low:
        return "feed"
    return "html" if low.startswith((b"<!doctype html", b"<html")) else "text"


def decode(data: bytes) -> tuple[str, str]:
    """Text and encoding: by mark, then UTF-8, GBK, GB18030. ValueError if none fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name), name
    for name in ("utf-8", "gbk", "gb18030"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    raise ValueError("no known encoding")


# ---- chapters of plain text ---------------------------------------------------------------------

NUMERAL = "0-9０-９零〇一二三四五六七八九十百千万两"
HEADING = re.compile(rf"(?:第[{NUMERAL}]{{1,16}}[章回节卷].*|卷[0-9零〇一二三四五六七八九十百千]{{1,6}}.{{0,36}}|chapter[\s\d].*)", re.I)
LONGEST_HEADING, CHUNK, RUNT = 80, 10_240, 100

Span = tuple[str, str, int, int]  # title, content, and where it comes from: characters of the source


def is_heading(line: str) -> bool:
    s = line.strip()
    return 0 < len(s) <= LONGEST_HEADING and bool(HEADING.fullmatch(s))


def chapter_spans(text: str, pattern: re.Pattern[str] | None = None) -> list[Span]:
    """A heading line begins a chapter. Without a pattern the usual headings count and text before the
    first is a preface; a text without any is one chapter, or pieces if it is long. With a pattern, text
    before the first match is dropped. A chapter comes from its heading to the next one."""
    starts: list[tuple[str, int, int]] = []  # title, start of the heading, start of the content
    at = 0
    for line in text.split("\n"):
        if pattern.search(line.strip()) if pattern else is_heading(line):
            starts.append((line.strip(), at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    ends = [a for _, a, _ in starts[1:]] + [len(text)]
    chapters = [(t, text[c:e].strip(), a, e) for (t, a, c), e in zip(starts, ends)]
    if pattern:
        return chapters
    first = starts[0][1] if starts else len(text)
    before = text[:first].strip()
    if chapters:
        return [("序章", before, 0, first), *chapters] if before else chapters
    return [("正文", before, 0, len(text))] if len(text.encode("utf-8", "surrogatepass")) <= CHUNK else split_by_size(text)


def split_chapters(text: str, pattern: re.Pattern[str] | None = None) -> list[tuple[str, str]]:
    return [(t, c) for t, c, _, _ in chapter_spans(text, pattern)]


def split_by_size(text: str, size: int = CHUNK) -> list[Span]:
    """Pieces that end with the first line that ends at or after ``size`` bytes; what is left over under
    RUNT characters goes to the piece before."""
    out: list[Span] = []
    start = held = at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        held += len(line.encode("utf-8", "surrogatepass"))
        at += len(line)
        if held > size and line.endswith("\n") or at == len(text):
            out.append((f"第{len(out) + 1}章(1)", text[start:at].strip("\n"), start, at))
            start, held = at, 0
    if len(out) > 1 and len(out[-1][1]) < RUNT:
        (title, content, a, _), (_, rest, _, e) = out[-2], out[-1]
        out[-2:] = [(title, f"{content}\n{rest}" if content and rest else content + rest, a, e)]
    return out


# Headings without a number, and marks that may stand round a heading.
SPECIAL = "楔子 序章 序言 前言 引子 引言 后记 尾声 终章 终卷 结语 prologue epilogue prolog epilog".split()
AROUND = ["【】", "《》", "[]", "「」", "“”"]
BOOK_HEADING = re.compile(rf"第[{NUMERAL}亿壹贰叁肆伍陆柒捌玖拾佰仟]+[章节卷回部篇].*|chapter\s*(?:[0-9]+|[ivxlcdm]+)(?![0-9ivxlcdm]).*|番外.{{0,20}}|{'|'.join(SPECIAL)}", re.I | re.S)


def is_book_heading(line: str) -> bool:
    """The wider sense of a heading: up to 50 characters, parts and sections too, Roman numerals,
    headings without a number, and one pair of brackets round any of them."""
    s = line.strip()
    if not 0 < len(s) <= 50:
        return False
    inner = next((s[1:-1] for a, b in AROUND if len(s) > 2 and s[0] == a and s[-1] == b), None)
    return bool(BOOK_HEADING.fullmatch(s)) or inner is not None and bool(BOOK_HEADING.fullmatch(inner))


def read_text(text: str, with_title: bool = True, least: int = 0) -> tuple[str, list[tuple[str, str]]]:
    """A plain text's title (its first line, if that is no heading) and chapters by is_book_heading(): text
    before the first is 序, a text without any is 正文; chapters under ``least`` characters are merged."""
    lines = [x.rstrip() for x in text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    own = lambda x: "\n".join(x).strip("\n") if any(map(str.strip, x)) else ""
    first = next((k for k, x in enumerate(lines) if x.strip()), len(lines))
    title = ""
    if with_title and first < len(lines) and not is_book_heading(lines[first]):
        title, lines = lines[first].strip(), lines[first + 1 :]
    at = [k for k, x in enumerate(lines) if is_book_heading(x)]
    if not at:
        body = own(lines)
        return title, [("正文", body)] if body else []
    found = [(lines[a].strip(), own(lines[a + 1 : e])) for a, e in zip(at, [*at[1:], len(lines)])]
    if before := own(lines[: at[0]]):
        found.insert(0, ("序", before))
    return title, merge_short(found, least) if least else found


def byte_chunks(text: str, size: int) -> list[str]:
    """Pieces of at most size bytes that never cut a character."""
    data, out, at = text.encode(), [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end].decode())
        at = end
    return out


def flatten_toc(items: list[dict]) -> list[dict]:
    """Entries (title, href, level, place) of a tree of {title, href, children}, parents before children;
    an explicit stack, so depth costs no recursion."""
    out: list[dict] = []
    stack = [(x, 0) for x in reversed(items)]
    while stack:
        x, level = stack.pop()
        out.append({"title": x.get("title"), "href": x.get("href"), "level": level, "place": len(out)})
        stack += [(c, level + 1) for c in reversed(x.get("children") or [])]
    return out


# Kinds of a package's resources by media type and extension.
KINDS = {"image": ("image/", "jpg jpeg png gif webp svg bmp"), "stylesheet": ("text/css", "css"), "font": ("font/", "ttf otf woff woff2"), "audio": ("audio/", "mp3 m4a ogg wav"), "video": ("video/", "mp4 webm")}


def resource_kind(path: str, media_type: str, cover: bool = False) -> str:
    """cover, image, stylesheet, font, audio, video or other; document for what is read."""
    extension = posixpath.splitext(path)[1].lstrip(".").lower()
    if media_type in ("application/xhtml+xml", "text/html") or not media_type and extension in ("xhtml", "html", "htm"):
        return "document"
    kind = next((k for k, (m, x) in KINDS.items() if media_type.startswith(m) or extension in x.split()), "font" if "font" in media_type else "other")
    return "cover" if cover and kind == "image" else kind


def preview(html: str, most: int = 64) -> str:
    """The first ``most`` characters of a page's visible text."""
    return " ".join(dom.parse_html(html).text().split())[:most]


def split_by_marker(text: str, marker: str) -> list[tuple[str, str]]:
    """Between literal markers; the first line of a part is its title."""
    out = []
    for part in text.split(marker):
        if part.strip():
            title, _, rest = part.strip().partition("\n")
            out.append((title.strip(), rest.strip()))
    return out


def merge_short(chapters: list[tuple[str, str]], least: int = 100) -> list[tuple[str, str]]:
    """Chapters under ``least`` characters go to the end of the one before."""
    out: list[tuple[str, str]] = []
    for title, text in chapters:
        if out and len(text) < least:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n{title}\n{text}")
        else:
            out.append((title, text))
    return out


def greedy_matches(text: str, pattern: re.Pattern[str], gap: int = 1000) -> list[tuple[str, str]]:
    """Chapters begun by matches at least ``gap`` bytes after the last accepted one."""
    starts: list[re.Match[str]] = []
    last = None
    for m in pattern.finditer(text):
        at = len(text[: m.start()].encode()) if last is None else last + len(text[starts[-1].start() : m.start()].encode())
        if last is None or at - last >= gap:
            starts.append(m)
            last = at
    ends = [m.start() for m in starts[1:]] + [len(text)]
    return [(m[0].strip(), text[m.end() : e].strip()) for m, e in zip(starts, ends)]


DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2} | {chr(0xFF10 + i): i for i in range(10)} | {str(i): i for i in range(10)}
UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_number(s: str) -> int | None:
    """第...: digits in a row, or with units; None if it is something else."""
    if not s or any(c not in DIGITS and c not in UNITS and c not in "万亿" for c in s):
        return None
    if all(c in DIGITS for c in s):
        return int("".join(str(DIGITS[c]) for c in s))
    total = part = digit = 0
    for c in s:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in UNITS:
            part += (digit or 1) * UNITS[c]
            digit = 0
        else:
            total = (total + part + digit) * (10_000 if c == "万" else 100_000_000)
            part = digit = 0
    return total + part + digit


def number_chapter(title: str) -> str:
    """第十二章 → 第12章; -1 where the number can't be read."""

    def put(m: re.Match[str]) -> str:
        n = chinese_number(m[1])
        return f"第{-1 if n is None else n}章"

    return re.sub(r"第([^第章\s]+)章", put, title)


# ---- packages -----------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def read_epub(data: bytes) -> dict:
    """title, author, chapters [(title, text)] and diagnostics of an EPUB: container, package, manifest,
    linear spine, titles from the navigation document or NCX. Encrypted packages have no chapters."""
    out: dict = {"title": None, "author": None, "chapters": [], "diagnostics": []}
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = set(z.namelist())
        if "META-INF/encryption.xml" in names:
            out["diagnostics"].append("encrypted")
            return out
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in root.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
        out["diagnostics"].append(f"unreadable: {type(e).__name__}")
        return out
    base = posixpath.dirname(opf)
    path = lambda href, at=base: posixpath.normpath(posixpath.join(at, unquote(href.partition("#")[0])))
    manifest: dict[str, tuple[str, str]] = {}
    spine: list[str] = []
    nav = ncx = None
    for e in package.iter():
        tag = _local(e.tag)
        if tag == "title" and out["title"] is None:
            out["title"] = (e.text or "").strip() or None
        elif tag == "creator" and out["author"] is None:
            out["author"] = (e.text or "").strip() or None
        elif tag == "item" and {"id", "href"} <= e.attrib.keys():
            p = path(e.attrib["href"])
            if p.startswith(("..", "/")):
                out["diagnostics"].append(f"unsafe path {e.attrib['href']}")
                continue
            manifest[e.attrib["id"]] = (p, e.attrib.get("media-type", ""))
            if "nav" in e.attrib.get("properties", "").split():
                nav = p
            if e.attrib.get("media-type") == "application/x-dtbncx+xml":
                ncx = p
        elif tag == "itemref" and e.attrib.get("linear", "yes") != "no":
            spine.append(e.attrib.get("idref", ""))
    titles = nav_titles(z, names, nav) or ncx_titles(z, names, ncx)
    for ref in spine:
        p = manifest.get(ref, ("", ""))[0]
        if p not in names:
            out["diagnostics"].append(f"missing {ref}")
            continue
        tree = dom.parse_html(z.read(p).decode("utf-8", "replace"))
        heading = next((n.text() for n in tree.descend() if n.tag in ("h1", "h2", "h3", "title") and n.text()), "")
        body = next((n for n in tree.descend() if n.tag == "body"), tree)
        out["chapters"].append((titles.get(p) or heading or posixpath.basename(p), body.text()))
    return out


def nav_titles(z: zipfile.ZipFile, names: set[str], p: str | None) -> dict[str, str]:
    if p not in names:
        return {}
    tree = dom.parse_html(z.read(p).decode("utf-8", "replace"))
    out: dict[str, str] = {}
    for a in dom.query(tree, "nav a[href]"):
        out.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(p), unquote(a.attrs["href"].partition("#")[0]))), a.text())
    return out


def ncx_titles(z: zipfile.ZipFile, names: set[str], p: str | None) -> dict[str, str]:
    out: dict[str, str] = {}
    if p not in names:
        return out
    for point in ElementTree.fromstring(z.read(p)).iter():
        if _local(point.tag) == "navPoint":
            src = next((e.attrib.get("src", "") for e in point if _local(e.tag) == "content"), "")
            label = next(("".join(e.itertext()).strip() for e in point if _local(e.tag) == "navLabel"), "")
            out.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(p), unquote(src.partition("#")[0]))), label)
    return out


def palmdoc(data: bytes) -> bytes:
    """LZ77 as PalmDoc has it."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("a distance before the start")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def read_mobi(data: bytes) -> dict:
    """title and text of a PalmDoc or MOBI file; Huffman-coded ones have a diagnostic instead."""
    n = struct.unpack_from(">H", data, 76)[0]
    at = [struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(n)] + [len(data)]
    first = data[at[0] : at[1]]
    method, _, _, records = struct.unpack_from(">HHIH", first)
    title = data[:32].split(b"\0")[0].decode("latin-1").replace("_", " ").strip()
    if method not in (1, 2):
        return {"title": title, "chapters": [], "diagnostics": [f"compression {method}"]}
    parts = [data[at[k] : at[k + 1]] for k in range(1, min(records, n - 1) + 1)]
    text = b"".join(palmdoc(p) if method == 2 else p for p in parts).decode("utf-8", "replace")
    if "<" in text:
        text = dom.parse_html(text).text()
    return {"title": title, "chapters": split_chapters(text), "diagnostics": []}


def read_pdf(data: bytes) -> dict:
    """Text drawn by Tj and TJ in plain or deflated streams; no fonts' own encodings, no images."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for t in re.finditer(rb"\[((?:[^\]\\]|\\.)*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*Tj", body, re.S):
            raw = b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", t[1])) if t[1] is not None else t[2]
            out.append(re.sub(rb"\\([()\\])", rb"\1", raw).decode("latin-1"))
    return {"title": None, "chapters": [("", "\n".join(out))] if out else [], "diagnostics": [] if out else ["no text"]}


def read_book(data: bytes, name: str = "") -> dict:
    """title, author, format, chapters and diagnostics of a book in any format known."""
    kind = detect(data)
    try:
        if kind == "epub":
            found = read_epub(data)
        elif kind == "mobi":
            found = read_mobi(data)
        elif kind == "pdf":
            found = read_pdf(data)
        else:
            text, encoding = decode(data)
            text = text.replace("\r\n", "\n").replace("\r", "\n")
            found = {"chapters": chapter_spans(text), "diagnostics": [], "encoding": encoding}
    except (ValueError, IndexError, struct.error) as e:
        found = {"chapters": [], "diagnostics": [f"unreadable: {e}"]}
    stem = posixpath.splitext(posixpath.basename(name))[0]
    return {"title": found.get("title") or stem or None, "author": found.get("author"), "format": kind, "chapters": found["chapters"], "diagnostics": found["diagnostics"]}


# ---- feeds --------------------------------------------------------------------------------------


def parse_feed(text: str) -> dict:
    """title, link and entries (id, title, link, summary, author, published_at as written) of RSS, Atom
    or JSON Feed; the first entry of an id counts. ValueError for anything else."""
    s = text.lstrip("﻿ \t\r\n")
    if s.startswith("{"):
        value = json.loads(s)
        if not isinstance(value.get("items"), list):
            raise ValueError("not a feed: no items")
        entries = [{"id": x.get("id") or x.get("url") or x.get("title"), "title": x.get("title"), "link": x.get("url") or x.get("external_url"), "summary": x.get("summary") or x.get("content_text") or x.get("content_html"), "author": None, "published_at": x.get("date_published")} for x in value.get("items", []) if isinstance(x, dict)]
        return {"title": value.get("title") or value.get("feed_url"), "link": value.get("home_page_url"), "next": value.get("next_url"), "entries": first_of_each(entries), "items": entries}
    try:
        root = ElementTree.fromstring(s)
    except ElementTree.ParseError as e:
        raise ValueError(f"not a feed: {e}") from e
    kind = _local(root.tag).lower()
    if kind not in ("rss", "feed", "rdf", "channel"):
        raise ValueError(f"not a feed: {kind}")
    word = lambda e, *names: next((t for n in names for c in e if _local(c.tag) == n and (t := "".join(c.itertext()).strip())), None)
    if kind == "feed":
        def link(e: ElementTree.Element) -> str | None:
            links = [c for c in e if _local(c.tag) == "link" and c.attrib.get("href")]
            return next((c.attrib["href"] for rel in ("alternate", None) for c in links if c.attrib.get("rel") == rel), links[0].attrib["href"] if links else None)

        entries = [{"id": word(e, "id") or link(e) or word(e, "title"), "title": word(e, "title"), "link": link(e), "summary": word(e, "summary", "content"), "author": next((word(c, "name") for c in e if _local(c.tag) == "author"), None) or word(e, "creator"), "published_at": word(e, "updated", "published", "date")} for e in root if _local(e.tag) == "entry"]
        return {"title": word(root, "title"), "link": link(root), "next": next_link(root), "entries": first_of_each(entries), "items": entries}
    channel = next((e for e in root.iter() if _local(e.tag) == "channel"), root)
    found = [e for e in root.iter() if _local(e.tag) == "item"]
    entries = [{"id": word(e, "guid") or word(e, "link") or word(e, "title"), "title": word(e, "title"), "link": word(e, "link"), "summary": word(e, "description", "encoded", "summary"), "author": word(e, "author", "creator"), "published_at": word(e, "pubDate", "date")} for e in found]
    return {"title": word(channel, "title"), "link": word(channel, "link"), "next": next_link(channel), "entries": first_of_each(entries), "items": entries}


def next_link(e: ElementTree.Element) -> str | None:
    """Where the feed goes on: the first link of relation next."""
    return next((c.attrib["href"].strip() for c in e.iter() if _local(c.tag) == "link" and c.attrib.get("rel") == "next" and c.attrib.get("href", "").strip()), None)


def first_of_each(entries: list[dict]) -> list[dict]:
    """ValueError if an entry has neither id nor link nor title."""
    seen: dict[str, dict] = {}
    for e in entries:
        if not e["id"]:
            raise ValueError("an entry without id, link or title")
        seen.setdefault(e["id"], e)
    return list(seen.values())


# ---- requests -----------------------------------------------------------------------------------


def parse_url_rule(raw: str) -> dict:
    """url, method, body, headers (JSON) and charset of ``url,{options}``; lenient options. A script
    suffix is split off; options that can't be read are part of the url."""
    from quire.operators.packed import lenient

    text, _, script = raw.partition("@js:")
    for m in re.finditer(r",\s*\{", text):
        try:
            options = lenient(text[m.start() + 1 :])
        except ValueError:
            continue
        if isinstance(options, dict):
            body = options.get("body")
            body = body if body is None or isinstance(body, str) else json.dumps(body, ensure_ascii=False, sort_keys=True)
            headers = options.get("headers")
            return {"url": text[: m.start()].strip(), "method": str(options.get("method") or "GET").upper(), "body": body, "headers": json.dumps(headers, ensure_ascii=False, sort_keys=True) if headers else None, "charset": options.get("charset"), "script": script or None}
    return {"url": text.strip(), "method": "GET", "body": None, "headers": None, "charset": None, "script": script or None}
