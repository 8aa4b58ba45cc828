"""Text normalisation that engine expressions can't say: Unicode forms, all entities, scripts, titles
repeated in their own text. One Arrow stage for whatever is asked."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ENTITIES, LONGEST_ENTITY, fnv1a64
from quire.session import spread

# Some characters whose two Chinese forms differ, traditional to simplified.
SIMPLER = dict(zip("萬與專業東絲兩嚴喪個豐臨為麗舉義烏樂喬習鄉書買亂爭於雲亞產親億僅從倉儀們價眾優會傘偉傳傷倫偽體餘傭側僑債傾償儲兒黨蘭關興養獸內岡冊寫軍農馮衝決況凍淨準涼減湊龍說話語讀進過還這邊達遠運連選門問間開閱頁頭題顏類風飛馬驗魚鳥點",
                   "万与专业东丝两严丧个丰临为丽举义乌乐乔习乡书买乱争于云亚产亲亿仅从仓仪们价众优会伞伟传伤伦伪体余佣侧侨债倾偿储儿党兰关兴养兽内冈册写军农冯冲决况冻净准凉减凑龙说话语读进过还这边达远运连选门问间开阅页头题颜类风飞马验鱼鸟点"))
_TO_SIMPLE = str.maketrans(SIMPLER)
_TO_TRADITIONAL = str.maketrans({v: k for k, v in SIMPLER.items()})
_ENTITY = re.compile(r"&([^;]*);", re.S)


def decode_entities(s: str) -> str:
    """As functions.text.decode_entities()."""

    def put(m: re.Match[str]) -> str:
        name = m[1]
        if name in ENTITIES:
            return ENTITIES[name]
        if not (n := re.fullmatch(r"#(?:[xX]([0-9a-fA-F]{1,8})|0*([0-9]{1,10}))", name)) or len(name) > LONGEST_ENTITY:
            return m[0]
        code = int(n[1], 16) if n[1] else int(n[2])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(put, s) if "&" in s else s


def without_title(content: str, book: str, title: str) -> str:
    """content without its own title, and the book's before it, at the beginning; blanks in a title may
    be written otherwise. A title that goes on as a word stays."""
    rest = content.lstrip()
    flexible = lambda t: r"\s*".join(map(re.escape, re.sub(r"\s+", "", t)))
    for t in (book, title):
        if t.strip():
            m = re.match(rf"(?:[\s—\-_|·]*){flexible(t)}(?:\s+|$)", rest)
            if m:
                rest = rest[m.end() :].lstrip()
    return rest


def normalise(s: str, form: str | None = "NFC", half_width: bool = False, entities: bool = False, squeeze: bool = False, script: str | None = None) -> str:
    """Mark, form, width, entities, script, line ends, empty lines, white space, edges: in this order."""
    s = s.removeprefix("﻿")
    if form and not s.isascii():
        s = unicodedata.normalize(form, s)
    if half_width:
        s = s.translate({c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20})
    if entities:
        s = decode_entities(s)
    if script:
        s = s.translate(_TO_SIMPLE if script == "t2s" else _TO_TRADITIONAL)
    s = re.sub(r"\n{3,}", "\n\n", s.replace("\r\n", "\n").replace("\r", "\n"))
    return " ".join(s.split()) if squeeze else s.strip("\n")


def normalise_texts(df: DataFrame, key: str, text: str, **options: object) -> DataFrame:
    """key, text, n_chars and FNV-1a of every text under the options of normalise(); null stays null."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, text string, n_chars int"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if s is None else normalise(s, **options) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array([None if s is None else len(s) for s in out], pa.int32())], [key, "text", "n_chars"])

    out = spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), df).mapInArrow(run, schema)
    return out.withColumn("fingerprint", fnv1a64(F.col("text")))


def chapter_documents(df: DataFrame, key: str, book: str, title: str, text: str) -> DataFrame:
    """key, content, paragraphs, char_len, fingerprint, valid of chapters: normalised, without their own
    title, cut into paragraphs. Texts with nothing left are not valid."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, content string, paragraphs array<string>, char_len int, valid boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = []
            for name, own, s in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                lines = [x.rstrip() for x in normalise(s or "").split("\n")]
                content.append(without_title(re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(), name or "", own or ""))
            parts = [[p.strip() for p in s.split("\n\n") if p.strip()] for s in content]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.string()), pa.array(parts, pa.list_(pa.string())), pa.array(map(len, content), pa.int32()), pa.array([bool(s) for s in content])], [key, "content", "paragraphs", "char_len", "valid"])

    out = spread(df.select(*(F.col(f"`{c}`") for c in (key, book, title, text))), df).mapInArrow(run, schema)
    return out.withColumn("fingerprint", fnv1a64(F.col("content")))


def rare_digest(df: DataFrame, key: str, text: str, algorithm: str = "sm3") -> DataFrame:
    """key and the hex digest of every text by an algorithm that the engine hasn't; null for null, empty
    where the worker's library hasn't it either."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, digest string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = algorithm in hashlib.algorithms_available
        for b in batches:
            out = [None if s is None else hashlib.new(algorithm, s.encode()).hexdigest() if there else "" for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "digest"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
