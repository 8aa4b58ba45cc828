"""Parsing of instants written in many forms. Pure functions; operators.instants runs them."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import product
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Instants that count lie in [FIRST_MS, END_MS): 2015-01-01 to 2028-01-01, UTC.
FIRST_MS, END_MS = 1_420_070_400_000, 1_830_297_600_000

# Month names and their short forms in several languages.
MONTHS = {
    1: "january jan januar jänner jänn enero ene janvier janv janeiro gennaio gen januari",
    2: "february feb februar febrero febr février févr fevrier fevereiro fev febbraio februari",
    3: "march mar märz mär mrz maerz marzo mars março marco maart mrt",
    4: "april apr abril abr avril avr aprile",
    5: "may mai mayo maio maggio mag mei",
    6: "june jun juni junio juin junho giugno giu",
    7: "july jul juli julio juillet juil julho luglio lug",
    8: "august aug agosto ago août aout augustus",
    9: "september sep sept septiembre setiembre septembre setembro set settembre",
    10: "october oct oktober okt octubre octobre outubro out ottobre ott",
    11: "november nov noviembre novembre novembro",
    12: "december dec dezember dez diciembre dic décembre déc decembre dezembro dicembre",
}
MONTH = {name: n for n, names in MONTHS.items() for name in names.split()}
# Weekday names in several languages; they don't count, whether right or wrong.
WEEKDAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun "
    "montag mo dienstag di mittwoch mi donnerstag do freitag fr samstag sa sonnabend sonntag so "
    "lunes lun martes mié miércoles miercoles jueves jue viernes vie sábado sabado sáb domingo dom "
    "lundi mardi mer mercredi jeu jeudi ven vendredi sam samedi dim dimanche "
    "segunda-feira terça-feira quarta-feira quinta-feira sexta-feira lunedì martedì mercoledì giovedì venerdì sabato domenica "
    "星期一 星期二 星期三 星期四 星期五 星期六 星期日 星期天 周一 周二 周三 周四 周五 周六 周日 "
    "月曜日 火曜日 水曜日 木曜日 金曜日 土曜日 日曜日"
)
# Minutes from UTC of zone abbreviations that the feed's own zone doesn't use.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "ist": 330, "npt": 345, "pkt": 300, "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
UNIVERSAL = {"z", "ut", "utc", "gmt"}

_MON = "|".join(sorted(map(re.escape, MONTH), key=len, reverse=True))
_DAY = "|".join(sorted(map(re.escape, WEEKDAYS.split()), key=len, reverse=True))
_CLOCK = r"(?:(?P<before>上午|下午|午前|午後|凌晨|中午|晚上)\s*)?(?P<h>\d{1,2})\s*[:时時h]\s*(?P<mi>\d{1,2})(?:\s*[:分]\s*(?P<s>\d{1,2})(?:[.,](?P<f>\d{1,9})\d*)?)?\s*[分秒]?(?:\s*(?P<after>[ap]\.?\s?m\b\.?))?(?:\s*uhr)?"
_ZONE = r"(?:\s*(?P<off>(?:gmt|utc|ut|z)?\s?[+-]\d{1,2}(?::?\d{2})?)(?![\d:]))?(?:\s*[\[(]?\s*(?P<zone>[a-z]+(?:/[a-z_+-]+\d*)+|(?!de\b)[a-z]{1,5})\s*[\])]?)?"
_SHAPES = {
    "ymd": r"(?P<y>\d{4})(?:-(?P<m>\d{1,2})-|/(?P<m2>\d{1,2})/|\.(?P<m3>\d{1,2})\.|\s*年\s*(?P<m4>\d{1,2})\s*月\s*)(?P<d>\d{1,2})\s*日?",
    "compact": r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
    "dots": r"(?P<d>\d{1,2})\.\s?(?P<m>\d{1,2})\.\s?(?P<y>\d{4}|\d{2})",
    "slash": r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}|\d{2})",
    "dashes": r"(?P<d>\d{1,2})-(?P<m>\d{1,2})-(?P<y>\d{4})",
    "named": rf"(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th|er|º)?[\s-]*(?:(?:de|of)\s+)?(?P<mon>{_MON})\b\.?,?[\s-]*(?:(?:de|del)\s+)?(?P<y>\d{{4}}|\d{{2}})",
    "american": rf"(?P<mon>{_MON})\b\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})",
}
_FRONT = rf"(?:(?:{_DAY})\b\.?,?\s*)?"
FORMS = [re.compile(rf"{_FRONT}{d}(?:(?:\s*,\s*|\s*t\s*|\s+(?:um|at|às|as|a las|à)\s+|\s+|(?<=日)){_CLOCK}{_ZONE})?", re.I) for d in _SHAPES.values()]
FORMS += [
    re.compile(rf"{_FRONT}(?P<mon>{_MON})\b\.?\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE.replace('zone', 'zone0').replace('off', 'off0')}\s+(?P<y>\d{{4}}){_ZONE}", re.I),
    re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t?\s?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}})\d*)?)?{_ZONE}", re.I),
]
NUMBER = re.compile(r"\+?(\d{1,20})(?:\.(\d*))?")
OFFSET = re.compile(r"([+-])(\d{1,2}):?(\d{2})?$")
#: A remark at the end, as mail headers have it; a zone in brackets is read first.
COMMENT = re.compile(r"\s*\([^()]*\)$")
EPOCH = datetime(1970, 1, 1)


@lru_cache(4096)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        pass
    if "/" not in name:
        return None
    parts = ["_".join(w[:1].upper() + w[1:].lower() for w in p.split("_")) for p in name.split("/")]
    try:
        return ZoneInfo("/".join(parts))
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(4096)
def abbreviations(name: str) -> dict[str, int]:
    """Minutes from UTC of the abbreviations that a zone uses in the years that count."""
    zone, out = zone_of(name), {}
    for year in range(2015, 2028) if zone else ():
        for month in (1, 4, 7, 10):
            at = datetime(year, month, 1, 12, tzinfo=zone)
            out[at.tzname().lower()] = int(at.utcoffset().total_seconds() // 60)
    return out


def within(ms: int | None) -> int | None:
    return ms if ms is not None and FIRST_MS <= ms < END_MS else None


def milliseconds(local: datetime, micros: int, minutes: int) -> int:
    whole = (local - EPOCH) // timedelta(seconds=1) - minutes * 60
    return whole * 1000 + micros // 1000


def in_zone(local: datetime, zone: ZoneInfo) -> int:
    """Minutes from UTC. fold=0: a clock time that occurs twice is the first, and one that is skipped
    counts with the offset before the gap, which moves it forward by the gap."""
    return int(local.replace(tzinfo=zone, fold=0).utcoffset().total_seconds() // 60)


def number(digits: str, fraction: str, zone: ZoneInfo) -> int | None:
    """Seconds, milli-, micro- or nanoseconds since 1970, or a date spelled in digits: whichever falls
    into the years that count. The ranges don't overlap."""
    n = int(digits)
    if fraction:
        return within(n * 1000 + int((fraction + "000")[:3]))
    for ms in (n * 1000, n, n // 1000, n // 1_000_000):
        if within(ms) is not None:
            return ms
    if len(digits) in (8, 12, 14, 17):
        part = [int(digits[a:b] or 0) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14), (14, 17))]
        try:
            local = datetime(*part[:6])
        except ValueError:
            return None
        return within(milliseconds(local, part[6] * 1000, in_zone(local, zone)))
    return None


def parse(raw: str | None, zone_name: str | None = "UTC", day_first: bool | None = True) -> int | None:
    """The UTC instant in milliseconds that raw states, or None.

    zone_name: the zone of values without one, and of abbreviations (UTC if null or unknown);
    day_first: how dates with slashes and the year last are read (day first if null). An offset
    outweighs a zone name. None: null, blank, impossible dates, words, instants outside 2015-2027.
    """
    if raw is None:
        return None
    s = unicodedata.normalize("NFKC", raw).strip()
    if not s:
        return None
    own = zone_of(zone_name or "UTC") or zone_of("UTC")
    if m := NUMBER.fullmatch(s):
        return number(m[1], m[2] or "", own)
    s = s.strip("\"'").lower()
    bare = COMMENT.sub("", s)
    for form, value in product(FORMS, (s,) if bare == s else (s, bare)):
        if not (m := form.fullmatch(value)):
            continue
        g = m.groupdict()
        try:
            return within(stated(g, zone_name or "UTC", own, day_first is not False))
        except (ValueError, OverflowError):
            return None  # an impossible date or clock
    return None


def stated(g: dict[str, str | None], zone_name: str, own: ZoneInfo, day_first: bool) -> int | None:
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    if g.get("a"):
        day, month = (int(g["a"]), int(g["b"])) if day_first else (int(g["b"]), int(g["a"]))
    else:
        day = int(g["d"])
        month = MONTH[g["mon"]] if g.get("mon") else int(next(g[k] for k in ("m", "m2", "m3", "m4") if g.get(k)))
    hour, minute, second = (int(g.get(k) or 0) for k in ("h", "mi", "s"))
    half = (g.get("before") or g.get("after") or "").replace(".", "").replace(" ", "")
    if half in ("am", "pm", "上午", "下午", "午前", "午後"):
        if not (1 <= hour <= 12 or hour == 0 and half not in ("am", "pm")):
            raise ValueError("no such hour")
        hour = hour % 12 + (12 if half in ("pm", "下午", "午後") else 0)
    local = datetime(year, month, day, hour, minute, second)
    micros = int(((g.get("f") or "") + "000000")[:6])
    if off := g.get("off") or g.get("off0"):
        sign, h, m = OFFSET.search(off).groups()
        if int(h) > 15 or int(m or 0) > 59:
            raise ValueError("no such offset")
        return milliseconds(local, micros, (1 if sign == "+" else -1) * (int(h) * 60 + int(m or 0)))
    if name := g.get("zone") or g.get("zone0"):
        if "/" in name:
            if (zone := zone_of(name)) is None:
                return None
            return milliseconds(local, micros, in_zone(local, zone))
        if name in UNIVERSAL:
            return milliseconds(local, micros, 0)
        known = abbreviations(zone_name).get(name, ABBREVIATIONS.get(name))
        return None if known is None else milliseconds(local, micros, known)
    return milliseconds(local, micros, in_zone(local, own))


def number_instant(c: Column) -> Column:
    """Like parse(), for a bigint column in UTC: epoch counts in any unit, or digits of a date."""
    first, end = F.lit(FIRST_MS), F.lit(END_MS)
    whole = lambda ms: (ms >= first) & (ms < end)
    digits = c.cast("string")
    shape = F.when(F.length(digits) == 14, F.lit("yyyyMMddHHmmss")).when(F.length(digits) == 12, F.lit("yyyyMMddHHmm")).when(F.length(digits) == 8, F.lit("yyyyMMdd"))
    spelled = F.unix_millis(F.try_to_timestamp(digits, shape))
    micro, nano = (F.call_function("div", c, F.lit(n)) for n in (1000, 1_000_000))
    return (
        F.when((c >= FIRST_MS // 1000) & (c < END_MS // 1000), c * 1000)
        .when(whole(c), c)
        .when(whole(micro), micro)
        .when(whole(nano), nano)
        .when(whole(spelled), spelled)
    )
