"""Exhaustive parsing of written times, and local time to UTC over a zone's whole rule set.

Pure Python and numpy; `eventweave.operators.timenorm` runs it once per distinct text.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np

#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

#: The first three letters of month names in English, German, French and Spanish.
#: French juin and juillet share theirs and are told apart by the fourth letter.
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "avr": 4, "abr": 4,
    "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8, "aoû": 8, "aou": 8, "ago": 8, "sep": 9, "oct": 10, "okt": 10,
    "nov": 11, "dec": 12, "dez": 12, "déc": 12, "dic": 12, "juin": 6, "juil": 7,
}

#: Instants outside are no times, unless a caller says otherwise: years 1900 to 2199. Zone rules are worked out for these years.
EARLIEST_MS, LATEST_MS = -2_208_988_800_000, 7_258_118_400_000
DAY_MS = 86_400_000

_CLOCK = r"(?:(?:[T,]?\s*)(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?|Uhr)(?![A-Za-z]))?)?"
_ZONE = r"\s*(?P<z>[+-]\d{2}(?::?\d{2})?|[A-Z]{1,5}|[A-Za-z]+(?:/[A-Za-z_+-]+)+)?\s*(?:\[(?P<r>[A-Za-z_/+-]+)\])?"
_WORD = r"[A-Za-zÀ-ÿ]{3,10}"


def _shape(day: str) -> re.Pattern:
    return re.compile(day + r"(?:(?<=\d)|(?<=日))(?:\s*)" + _CLOCK + _ZONE + r"$")


_YMD = _shape(r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})")
_CJK = _shape(r"(?P<y>\d{4})年\s*(?P<m>\d{1,2})月\s*(?P<d>\d{1,2})日")
_YWD = _shape(rf"(?P<y>\d{{4}})[\s-](?P<w>{_WORD})\.?[\s-](?P<d>\d{{1,2}})")
_ORDINAL = _shape(r"(?P<y>\d{4})-(?P<o>\d{3})")
_BASIC = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:T?(?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?P<ap>)" + _ZONE + r")?$")
_NUMBERS = _shape(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d{2})")
_DWY = _shape(rf"(?:[A-Za-zÀ-ÿ]{{2,10}}\.?,?\s+)?(?P<d>\d{{1,2}})\.?[\s-](?P<w>{_WORD})\.?,?[\s-](?P<y>\d{{4}})")
_WDY = _shape(rf"(?P<w>{_WORD})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})")
_EPOCH = re.compile(r"(\d{10})(?:[.,](\d{1,9}))?$|(\d{13})$|(\d{16})$|(\d{19})$")

_TO_1970 = date(1970, 1, 1).toordinal()


def _month(word: str) -> int | None:
    w = word.lower()
    return MONTHS.get(w[:4]) or MONTHS.get(w[:3])


def order_of(locale_code: str | None) -> str:
    """Order of day, month and year in all-number dates: en_US month first, East Asian and C year first, else day first."""
    code = (locale_code or "").replace("-", "_")
    if code == "en_US":
        return "mdy"
    return "ymd" if not code or code in ("C", "POSIX") or code[:2] in ("ja", "zh", "ko") else "dmy"


def _year(y: int) -> int:
    return y + 2000 if y < 100 else y


def parse_text(raw: str | None, order: str) -> tuple[int, int | None, str | None, int] | None:
    """(local ms, minutes east of UTC or None, named zone or None, precision in ms), or None where the text names no time.

    An epoch count comes back with 0 minutes. Digits beyond ms are dropped; parts not written are zero. A second 60 (a leap second) is the
    first of the minute after it. Texts may be of any length.
    """
    if raw is None:
        return None
    # White space of any length is one space, so that no pattern has to go over it twice.
    s = " ".join(raw.split())
    if not s:
        return None
    try:
        if s[:4].isdigit():
            if s.isdigit() or "." in s[10:11] or "," in s[10:11]:
                if k := _EPOCH.match(s):
                    if k[1]:
                        frac = (k[2] or "")[:3]
                        return int(k[1]) * 1000 + int(frac.ljust(3, "0") or 0), 0, None, 10 ** (3 - len(frac))
                    return int(k[3] or k[4] or k[5]) // (1 if k[3] else 1000 if k[4] else 1_000_000), 0, None, 1
            m = _YMD.match(s) or _BASIC.match(s) or _ORDINAL.match(s) or _CJK.match(s) or _YWD.match(s)
        elif s[0].isdigit():
            m = _NUMBERS.match(s) or _DWY.match(s)
        else:
            m = _DWY.match(s) or _WDY.match(s)
        if not m:
            return None
        g = m.groupdict()
        if "a" in g:
            a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
            if order == "ymd" and len(g["c"]) == 2:
                y, mo, d = a, b, c
            elif order == "mdy":
                mo, d, y = a, b, c
            else:
                d, mo, y = a, b, c
            day = date(_year(y), mo, d)
        elif g.get("o"):
            day = date(int(g["y"]), 1, 1) + timedelta(days=int(g["o"]) - 1)
            if int(g["o"]) < 1 or day.year != int(g["y"]):
                return None
        else:
            mo = _month(g["w"]) if g.get("w") else int(g["m"])
            if not mo:
                return None
            day = date(int(g["y"]), mo, int(g["d"]))
    except (ValueError, OverflowError):
        return None
    h, mi, sec, frac, ap = int(g["h"] or 0), int(g["mi"] or 0), int(g["s"] or 0), (g["f"] or "")[:3], (g["ap"] or "").lower()
    if ap[:1] in ("a", "p"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (ap[0] == "p")
    if h > 23 or mi > 59 or sec > 60:
        return None
    local = (day.toordinal() - _TO_1970) * DAY_MS + ((h * 60 + mi) * 60 + sec) * 1000 + int(frac.ljust(3, "0") or 0)
    precision = DAY_MS if g["h"] is None else 60_000 if g["s"] is None else 10 ** (3 - len(frac))
    zone, region = g["z"], g["r"]
    if zone:
        if zone[0] in "+-":
            minutes = int(zone[1:3]) * 60 + int(zone[-2:] if len(zone) > 3 else 0)
            return local, -minutes if zone[0] == "-" else minutes, None, precision
        if zone in ABBREVIATIONS:
            return local, ABBREVIATIONS[zone], None, precision
        if "/" not in zone:
            return None
        region = zone
    return local, None, region, precision


@lru_cache(maxsize=256)
def zone_rules(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Instants (ms) at which the zone's offset changes from EARLIEST_MS to LATEST_MS, and the offset (ms) from each on; None for an unknown zone."""
    try:
        zone = ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None
    at = lambda sec: int(datetime.fromtimestamp(sec, timezone.utc).astimezone(zone).utcoffset().total_seconds())
    low, high, step = EARLIEST_MS // 1000 - 86_400, LATEST_MS // 1000 + 86_400, 7 * 86_400
    starts, offsets, sec, now = [-(2**62)], [at(low)], low, at(low)
    while sec < high:
        if (after := at(sec + step)) != now:
            a, b = sec, sec + step
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if at(mid) == now else (a, mid)
            now = at(b)
            starts.append(b * 1000)
            offsets.append(now)
            sec = b
            continue
        sec += step
    return np.array(starts, "int64"), np.array(offsets, "int64") * 1000


def to_utc(local: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First UTC ms, last UTC ms, and whether the clock showed the local time at all (an unknown zone showed none)."""
    rules = zone_rules(name)
    if rules is None:
        return local, local, np.zeros(len(local), bool)
    starts, offsets = rules
    first, last, shown = np.full(len(local), 2**62), np.full(len(local), -(2**62)), np.zeros(len(local), bool)
    for off in np.unique(offsets):
        u = local - off
        fits = offsets[np.searchsorted(starts, u, "right") - 1] == off
        first, last, shown = np.where(fits & (u < first), u, first), np.where(fits & (u > last), u, last), shown | fits
    return first, last, shown
