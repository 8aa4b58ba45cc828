"""Text normalisation, slicing, fingerprints and codecs as column expressions.

Everything here is built from engine functions, so it stays inside generated code. White space means
Unicode white space: engine trim() would know only the blank. Null in gives null out, unless said
otherwise.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def utrim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def line_endings(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"^\x{FEFF}", "")


def normalize_content(c: Column) -> Column:
    """Line ends, at most one empty line in a row, no line ends at the edges."""
    return F.regexp_replace(collapse_blank_lines(line_endings(c)), "^\n+|\n+$", "")


def normalize_chapter(c: Column) -> Column:
    """The stricter form: lines without blanks at their end, runs of blank lines as one empty line, no
    blanks at the edges."""
    lines = F.regexp_replace(line_endings(strip_bom(c)), rf"(?m)[^\S\n]+$", "")
    return utrim(F.regexp_replace(lines, r"\n(?:[^\S\n]*\n){2,}", "\n\n"))


def strip_comments(c: Column) -> Column:
    """Without <!-- -->; an open one takes the rest."""
    return F.regexp_replace(c, r"(?s)<!--.*?(?:-->|$)", "")


def remove_invisible(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x{2009}\x{200C}\x{200D}]", "")


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the edges."""
    return utrim(collapse_whitespace(c))


def trim_lines(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), utrim), "\n")


def paragraphs(c: Column) -> Column:
    """array<string>: what lies between empty lines, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, "\n\n"), utrim), lambda p: p != "")


def sentences(c: Column) -> Column:
    """array<string>: cut after 。！？.!? and trimmed, without blank ones."""
    parts = F.regexp_extract_all(c, F.lit("([^。！？.!?]*[。！？.!?]|[^。！？.!?]+$)"), F.lit(1))
    return F.filter(F.transform(parts, utrim), lambda p: p != "")


WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def half_width(c: Column) -> Column:
    return F.translate(c, WIDE, NARROW)


# ---- HTML ---------------------------------------------------------------------------------------

# The tags that break lines, and entities by name.
BLOCK_TAGS = "article br dd div dl h1 h2 h3 h4 h5 h6 hr li p".split()
ENTITIES = {
    "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": "", "zwnj": "", "zwj": "", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "ndash": "–", "mdash": "—", "hellip": "…", "middot": "·",
}
LONGEST_ENTITY = 32


def is_block_tag(c: Column) -> Column:
    return F.lower(c).isin(BLOCK_TAGS)


def character(code: Column) -> Column:
    """The character with a code point (bigint); null where there is none."""
    valid = (code >= 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(c: Column) -> Column:
    """Entities by name and by number, decimal or hexadecimal, in one pass: nothing is decoded twice. What
    stands between & and the next ; is an entity's name; an unknown one stays as it is."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def piece(x: Column, before: Column) -> Column:
        """What follows an & up to the next one; before: the piece before, ; for the first, null for none."""
        name = F.substring_index(x, ";", 1)
        number = F.coalesce(F.conv(F.nullif(F.regexp_extract(name, r"^#[xX]([0-9a-fA-F]{1,8})$", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(name, r"^#0*([0-9]{1,10})$", 1), F.lit("")))
        text = F.when(name.startswith("#"), character(number.cast("bigint"))).otherwise(F.element_at(names, name))
        closed = F.contains(x, F.lit(";")) & F.contains(before, F.lit(";")) & (F.length(name) <= LONGEST_ENTITY)
        return F.when(before.isNull(), x).otherwise(F.coalesce(F.when(closed, F.concat(text, F.substr(x, F.length(name) + 2))), F.concat(F.lit("&"), x)))

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string"), F.lit(";")), F.slice(parts, 2, F.size(parts)))
        return F.array_join(F.zip_with(parts, before, piece), "")

    return once(c, lambda t: F.when(F.contains(t, F.lit("&")), once(F.split(t, "&", -1), joined)).otherwise(t))


def once(c: Column, f) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _lines(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), utrim), lambda x: x != ""), "\n")


def strip_tags(c: Column) -> Column:
    """Text of a fragment: comments out, block tags as line ends, other tags out, lines trimmed,
    blank lines out."""
    c = strip_comments(c)
    c = F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:\s[^<>]*)?/?>", "\n")
    return _lines(decode_entities(F.regexp_replace(c, r"</?[A-Za-z][^<>]*>", "")))


def looks_like_html(c: Column) -> Column:
    return c.rlike(r"</?\s*[A-Za-z]")


def format_fragment(c: Column) -> Column:
    """Like strip_tags(), but images stay as <img src="...">, with their source, data-src or first other
    data attribute; what has no tag's name between < and > stays as it is."""

    def piece(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"^<\s*/?\s*([A-Za-z0-9]+)", 1))
        source = F.coalesce(*(F.nullif(attribute(x, n), F.lit("")) for n in ("src", "data-src", r"data-[\w-]+")))
        image = F.when(source.isNotNull(), F.concat(F.lit('<img src="'), source, F.lit('">'))).otherwise("")
        return F.when(~x.startswith("<") | ~x.endswith(">") | (name == ""), x).when(is_block_tag(name), "\n").when(name == "img", image).otherwise("")

    pieces = F.regexp_extract_all(strip_comments(c), F.lit(r"(?s)(<[^>]*>|<[^>]*$|[^<]+)"), F.lit(1))
    return _lines(remove_invisible(decode_entities(F.array_join(F.transform(pieces, piece), ""))))


def extracted_content(c: Column) -> Column:
    """What a content rule gave, as text: a fragment of HTML is formatted, other text loses its entities
    and invisible characters and has its lines put in order."""
    c = strip_bom(c)
    return F.when(looks_like_html(c), format_fragment(c)).otherwise(normalize_content(remove_invisible(decode_entities(c))))


def unwrap_json(c: Column) -> Column:
    """What an outermost tag around JSON holds; a value that doesn't begin with a tag stays."""
    inner = F.regexp_extract(c, r"(?s)^\s*<[^>]*>(.*)</", 1)
    return F.when(c.rlike(r"(?s)^\s*<[^>]*>.*</"), utrim(inner)).otherwise(c)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag's text, quoted either way or bare; empty if it is missing."""
    return F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?i)[\s]{name}\s*=\s*{p}", 1), F.lit("")) for p in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")), F.lit(""))


def summary(c: Column) -> Column:
    """Without tags, entities decoded, white space squeezed; null if nothing is left."""
    return F.nullif(squeeze(decode_entities(F.regexp_replace(strip_comments(c), r"<[^<>]*>", " "))), F.lit(""))


# ---- rules that replace -------------------------------------------------------------------------


@dataclass(frozen=True)
class ReplaceRule:
    """pattern and replacement (Java references, $1), in order; scope tokens restrict where it runs."""

    pattern: str
    replacement: str = ""
    is_regex: bool = True
    order: int = 0
    enabled: bool = True
    in_title: bool = False
    in_content: bool = True
    scope: str = ""
    exclude: str = ""
    flags: str = ""  # i, m, s: letter case, lines, dots over line ends


def scope_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,;|]"), lambda t: F.lower(utrim(t))), lambda t: t != "")


def in_scope(scope: str, exclude: str, *fields: Column) -> Column:
    """Any token of scope within any field, or no token at all; a token of exclude within a field wins."""

    def any_of(tokens: str) -> Column | None:
        parts = [t.strip().lower() for t in tokens.replace(";", ",").replace("|", ",").split(",") if t.strip()]
        found = [F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(t)) for t in parts for f in fields]
        out = None
        for x in found:
            out = x if out is None else out | x
        return out

    include, without = any_of(scope), any_of(exclude)
    ok = F.lit(True) if include is None else include
    return ok if without is None else ok & ~without


def replace_rules(c: Column, rules: list[ReplaceRule], title: bool = False, *fields: Column) -> Column:
    """Applies rules in order (equal ones as given). Rules that are disabled, empty, not for this
    target or with a bad pattern do nothing."""
    import re

    for r in sorted(rules, key=lambda r: r.order):
        if not r.enabled or not r.pattern or not (r.in_title if title else r.in_content):
            continue
        if r.is_regex:
            pattern = f"(?{own}){r.pattern}" if (own := "".join(x for x in "ims" if x in r.flags)) else r.pattern
            try:
                re.compile(pattern)
            except re.error:
                continue
            changed = F.regexp_replace(c, pattern, r.replacement)
        else:
            changed = F.replace(c, F.lit(r.pattern), F.lit(r.replacement))
        c = F.when(in_scope(r.scope, r.exclude, *fields), changed).otherwise(c) if r.scope or r.exclude else changed
    return c


# ---- identity -----------------------------------------------------------------------------------


def fnv1a64(c: Column) -> Column:
    """FNV-1a, 64 bits, as 16 hex digits: two 32-bit halves, so nothing overflows."""
    data = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("bigint"))
    start = F.struct(F.lit(3421674724).cast("bigint").alias("hi"), F.lit(2216829733).cast("bigint").alias("lo"))
    mask = F.lit(4294967295).cast("bigint")

    def step(s: Column, b: Column) -> Column:
        x = s["lo"].bitwiseXOR(b)
        t = x * 435
        return F.struct((s["hi"] * 435 + F.shiftrightunsigned(t, 32) + x * 256).bitwiseAND(mask).alias("hi"), t.bitwiseAND(mask).alias("lo"))

    return F.aggregate(data, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def checksum(*parts: Column) -> Column:
    return F.concat(F.lit("fnv1a64:"), fnv1a64(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))))


def identity(c: Column) -> Column:
    """Trimmed, without a fragment, ASCII letters lower; null if blank."""
    return F.nullif(F.translate(F.regexp_replace(utrim(c), r"#.*$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def locator_key(c: Column) -> Column:
    """Without a fragment, query parameters in order, empty ones out."""
    bare = F.regexp_replace(c, r"#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(ordered != "", F.concat(F.regexp_extract(bare, r"^([^?]*)", 1), F.lit("?"), ordered)).otherwise(F.regexp_extract(bare, r"^([^?]*)", 1))


def title_key(c: Column) -> Column:
    return F.lower(utrim(c))


def switch_title(c: Column) -> Column:
    """A chapter title without its numbering, for matching between sources."""
    c = F.regexp_replace(utrim(c), rf"^第[^章]*章{SPACE}*", "")
    c = F.regexp_replace(c, rf"(?i)^chapter{SPACE}+[0-9]+{SPACE}*", "")
    c = F.regexp_replace(c, rf"^[0-9]+(?:{SPACE}|[.:-])+", "")
    return F.lower(squeeze(c))


def extension(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(utrim(c), r"^.*?\.?([A-Za-z0-9]+)$", 1)), F.lit(""))


# What is masked, as pattern and replacement.
SECRETS = [
    (r"(?i)\b(Bearer|Basic|Digest)\s+[A-Za-z0-9+/=._~-]+", "$1 [REDACTED]"),
    (r"(?i)\b(password|passwd|token|cookie|authorization|secret|api_key)(\s*[=:]\s*)[^\s&;,\"']+", "$1$2[REDACTED]"),
]


def redact(c: Column) -> Column:
    for pattern, replacement in SECRETS:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def resolve_url(base: Column, current: Column, value: Column) -> Column:
    """A link as it stands with a scheme; with the base's scheme after //; at the origin after /; else
    in the folder of the current page, or of the base where there is none. Dots aren't resolved."""
    v = utrim(value)
    here = F.coalesce(F.nullif(utrim(current), F.lit("")), utrim(base))
    origin = F.regexp_extract(here, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(here, r"[?#].*$", ""), r"^(.*/)", 1)
    return (
        F.when(v == "", F.lit(""))
        .when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), v)
        .when(v.startswith("//"), F.concat(F.regexp_extract(here, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), v))
        .when(v.startswith("/"), F.concat(origin, v))
        .otherwise(F.concat(folder, v))
    )


def url_parts(c: Column) -> Column:
    """struct<scheme, host, port, path, query, fragment> of a URL as it is written, host in lower case;
    parts that aren't there are null, the path is / then."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    path = F.when(c.rlike(pattern), F.coalesce(part(4), F.lit("/")))
    return F.struct(F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), part(3).cast("int").alias("port"), path.alias("path"), part(5).alias("query"), part(6).alias("fragment"))


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single dashes; the fingerprint where none are left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", fnv1a64(c)).otherwise(s)


def item_id(url: Column, place: Column, title: Column) -> Column:
    """An item's id: its page, or generated from its place and title; null for one without page and title,
    which is no item."""
    blank = lambda c: F.coalesce(utrim(c), F.lit("")) == ""
    made = F.concat(F.lit("generated:"), place.cast("string"), F.lit(":"), slug(utrim(title)))
    return F.when(~blank(url), utrim(url)).when(~blank(title), made)


# ---- time ---------------------------------------------------------------------------------------


def format_millis(ms: Column, pattern: str, offset_ms: int = 0) -> Column:
    """Only yyyy MM dd HH mm ss are understood in patterns."""
    return F.date_format(F.timestamp_millis((ms + offset_ms).cast("bigint")), pattern)


# ---- codecs -------------------------------------------------------------------------------------


def md5_16(c: Column) -> Column:
    return F.substring(F.md5(F.encode(c, "UTF-8")), 9, 16)


def digest(c: Column, algorithm: str) -> Column:
    """Hex digest; empty for an algorithm that isn't there."""
    data = F.encode(c, "UTF-8")
    return {"md5": lambda: F.md5(data), "sha1": lambda: F.sha1(data), "sha256": lambda: F.sha2(data, 256), "sha512": lambda: F.sha2(data, 512)}.get(algorithm.lower().replace("-", ""), lambda: F.lit(""))()


def hmac_digest(c: Column, secret: str, algorithm: str = "sha256") -> Column:
    """Hex HMAC from two digests of the engine; empty for an algorithm that isn't there."""
    hashes = {"md5": (64, F.md5), "sha1": (64, F.sha1), "sha256": (64, lambda x: F.sha2(x, 256)), "sha512": (128, lambda x: F.sha2(x, 512))}
    if algorithm.lower().replace("-", "") not in hashes:
        return F.lit("")
    block, own = hashes[algorithm.lower().replace("-", "")]
    key = secret.encode()
    if len(key) > block:
        key = hashlib.new(algorithm.lower().replace("-", ""), key).digest()
    key = key.ljust(block, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(k ^ x for k in key).hex())) for x in (0x36, 0x5C))
    return own(F.concat(outer, F.unhex(own(F.concat(inner, F.encode(c, "UTF-8"))))))


def to_hex(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c, "UTF-8")))


def from_hex(c: Column) -> Column:
    return F.decode(F.unhex(c), "UTF-8")


def to_base64(c: Column) -> Column:
    return F.base64(F.encode(c, "UTF-8"))


def from_base64(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")


def encode_component(c: Column) -> Column:
    """Percent encoding of everything but letters, digits and -_.!~*'(): form encoding, corrected."""
    e = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def encode_uri(c: Column) -> Column:
    """Like encode_component, but marks of a URL's own grammar stay."""
    e = encode_component(c)
    for ch in ";/?:@&=+$,#":
        e = F.replace(e, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return e


def sign_payload(params: Column) -> Column:
    """name=value of all pairs with a value, in order of name, joined by &."""
    kept = F.map_filter(params, lambda k, v: v.isNotNull() & (v != ""))
    return F.array_join(F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), F.element_at(kept, k))), "&")
