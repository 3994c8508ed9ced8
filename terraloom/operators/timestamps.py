"""Timestamps of mixed formats, precisions and zones to one UTC instant.

Each text becomes a character-class shape mask (digits ``9``, letters ``A``, the rest itself). A distinct mask is compiled to a
parser once per worker process; the texts of a batch that share a mask are then sliced as one character matrix and converted with
numpy. Local times go through transition tables built from the tz database, whose version is kept with each table.

Defined results: null, blank, dateless, clockless or impossible texts give null. A local time that occurs twice is the earlier
instant; a skipped one is read with the offset before the change. More than six decimals are truncated.
"""

from __future__ import annotations

import re
import zoneinfo
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH_NUMBER = {name[:n]: i for i, name in enumerate(MONTHS, 1) for n in (3, len(name))} | {"sept": 9}
# Abbreviations the tz database writes as digits only, with offsets in minutes.
EXTRA_ABBREVIATIONS = {
    "Asia/Kathmandu": {"NPT": 345},
    "Australia/Lord_Howe": {"LHST": 630, "LHDT": 660},
}
UTC_NAMES = {"Z", "UTC", "GMT", "UT", "ZULU"}
INVALID = np.iinfo(np.int64).min
_TO_MASK = {c: "9" for c in range(48, 58)} | {c: "A" for c in [*range(65, 91), *range(97, 123)]}
_MICROS = 1_000_000


@lru_cache(maxsize=1)
def tz_version() -> str:
    """Version of the tz database in use, 'unknown' where the system doesn't say."""
    for root in zoneinfo.TZPATH:
        for name, pattern in (("tzdata.zi", r"version (\S+)"), ("+VERSION", r"(\S+)")):
            try:
                with open(f"{root}/{name}") as f:
                    if m := re.search(pattern, f.readline()):
                        return m[1]
            except OSError:
                pass
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@dataclass
class ZoneTable:
    """Offsets of one zone: segment i starts at UTC second ``start[i]`` and has ``offset[i]`` seconds."""

    version: str
    start: np.ndarray
    offset: np.ndarray
    abbreviations: dict[str, int] = field(default_factory=dict)

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        """Local seconds to UTC seconds: the first segment that hasn't ended; in a gap the offset before it."""
        local_end = np.append(self.start[1:] + self.offset[:-1], np.iinfo(np.int64).max)
        i = np.searchsorted(np.maximum.accumulate(local_end), local, side="right")
        skipped = (i > 0) & (local < self.start[i] + self.offset[i])
        return local - self.offset[np.where(skipped, i - 1, i)]


@lru_cache(maxsize=1024)
def zone_table(name: str, first_year: int = 1970, last_year: int = 2100) -> ZoneTable | None:
    """Transition table of an IANA zone, or None for an unknown name. Offset changes are found by weekly probes and bisection."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def state(t: int) -> tuple[int, str]:
        d = datetime.fromtimestamp(t, timezone.utc).astimezone(zone)
        return int(d.utcoffset() / timedelta(seconds=1)), d.tzname()

    lo, hi = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (first_year, last_year))
    starts, states = [np.iinfo(np.int64).min // 4], [state(lo)]
    step, t = 7 * 86400, lo
    while t < hi:
        if (after := state(t + step)) != states[-1]:
            a, b = t, t + step
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if state(m) == states[-1] else (a, m)
            starts.append(b)
            states.append(state(b))
            t = b
            continue
        t += step
    found: dict[str, int] = {}
    for off, abbr in states:  # the latest meaning of an abbreviation holds
        if abbr.isalpha():
            found[abbr.upper()] = off
    found |= {k: v * 60 for k, v in EXTRA_ABBREVIATIONS.get(name, {}).items()}
    return ZoneTable(tz_version(), np.array(starts, np.int64), np.array([s[0] for s in states], np.int64), found)


@dataclass
class Parser:
    """What a mask says about its texts: where each part stands (start, end), and how to read it."""

    date: dict[str, tuple[int, int]] | None = None
    clock: dict[str, tuple[int, int]] | None = None
    half: tuple[int, int] | None = None  # AM or PM
    zone: tuple[int, int] | None = None  # letters: abbreviation, IANA name or Z
    offset: tuple[int, int, int, int] | None = None  # sign place, hours start, end, minutes start (or -1)
    receiver: bool = False  # clock parts split by blanks: UTC
    epoch: int = 0  # digits of a bare number
    fraction: tuple[int, int] | None = None


_DATES = [
    re.compile(r"(?P<y>9{4})(?P<s>[:/-])(?P<m>9{1,2})(?P=s)(?P<d>9{1,2})(?!9)"),
    re.compile(r"(?P<d>9{1,2})\.(?P<m>9{1,2})\.(?P<y>9{4})(?!9)"),
    re.compile(r"(?P<y>9{4})-(?P<j>9{3})(?!9)"),
    re.compile(r"(?:A{3,9},? )?(?P<n>A{3,9})\.? (?P<d>9{1,2}),? (?P<y>9{4})(?!9)"),
    re.compile(r"(?:A{3,9},? )?(?P<d>9{1,2})[ -](?P<n>A{3,9})\.?,?[ -](?P<y>9{4})(?!9)"),
    re.compile(r"(?P<y>9{4})(?P<m>99)(?P<d>99)(?=$|[A ])"),
]
_COMPACT = re.compile(r"(?P<y>9{4})(?P<m>99)(?P<d>99)(?P<h>99)(?P<i>99)(?P<c>99)(?=$|[A .,+-])")
_CLOCKS = [
    re.compile(r"(?P<h>9{1,2}):(?P<i>99):(?P<c>99)(?:[.,](?P<f>9+)|(?P<g>9+))?(?!9)"),
    re.compile(r"(?P<h>9{1,2}) +(?P<i>9{1,2}) +(?P<c>9{1,2})(?:[.,](?P<f>9+))?(?!9)"),
    re.compile(r"(?P<h>99)(?P<i>99)(?P<c>99)(?:[.,](?P<f>9+))?(?!9)"),
]
_EPOCH = re.compile(r"(9{10}|9{13}|9{16})(?:\.(9+))?$")
_OFFSET = re.compile(r" ?(?P<s>[+−-])(?P<h>9{1,2})(?::?(?P<m>99))?$")
_ZONE = re.compile(r" ?\[?(?P<z>A+(?:[/_+-][A9]+)*)\]?$")
_HALF = re.compile(r" ?(?P<p>A\.?A\.?)(?=$| )")


@lru_cache(maxsize=65536)
def compile_mask(mask: str) -> Parser | None:
    """The parser of a mask, or None where no reading fits. Pure: the same mask always compiles to the same parser."""
    if m := _EPOCH.match(mask):
        return Parser(epoch=len(m[1]), fraction=m.span(2) if m[2] else None)
    p, at = Parser(), 0
    spans = lambda m: {k: m.span(k) for k, v in m.groupdict().items() if v is not None and k != "s"}
    if m := _COMPACT.match(mask):
        parts = spans(m)
        p.date, p.clock = {k: parts[k] for k in "ymd"}, {k: parts[k] for k in "hic"}
        at = m.end()
        if f := re.compile(r"[.,](9+)").match(mask, at):
            p.clock["f"], at = f.span(1), f.end()
    else:
        for d in _DATES:
            if m := d.match(mask):
                p.date, at = spans(m), m.end()
                break
        if p.date and at < len(mask):
            if gap := re.compile(r" +|A(?=9)|, ?").match(mask, at):
                at = gap.end()
            else:
                return None
        if at < len(mask):
            for k, c in enumerate(_CLOCKS):
                if (m := c.match(mask, at)) and (k < 2 or p.date and m.end() - m.start() >= 6):
                    p.clock, p.receiver, at = spans(m), k == 1, m.end()
                    break
            else:
                return None
    if p.clock is not None:
        if m := _HALF.match(mask, at):
            if at + len(m[0]) == len(mask) or mask[m.end()] == " ":
                p.half = m.span("p")
                rest = m.end()
                if rest == len(mask):
                    return p  # AM, PM or a two-letter zone: told apart by value
                at = rest
        if at < len(mask):
            if m := _OFFSET.match(mask, at):
                p.offset = (m.start("s"), *m.span("h"), m.start("m") if m["m"] else -1)
            elif m := _ZONE.match(mask, at):
                p.zone = m.span("z")
            else:
                return None
    return p


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for k in range(*span):
        out = out * 10 + (chars[:, k].astype(np.int64) - 48)
    return out


def _micros(chars: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    if span is None:
        return np.zeros(len(chars), np.int64)
    n = min(6, span[1] - span[0])
    return _number(chars, (span[0], span[0] + n)) * 10 ** (6 - n)


def _words(texts: list[str], span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.array([t[span[0] : span[1]] for t in texts], dtype=object).astype(str), return_inverse=True)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01 of proleptic Gregorian dates, and which dates exist."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    ok = (m >= 1) & (m <= 12) & (y >= 1)
    mm = np.where(ok, m, 1)
    ok &= (d >= 1) & (d <= length[mm] + ((mm == 2) & leap))
    months = (np.where(ok, y, 1970) - 1970) * 12 + mm - 1
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + np.where(ok, d, 1) - 1, ok


def _date(p: Parser, texts: list[str], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = _number(chars, p.date["y"])
    if "j" in p.date:
        j = _number(chars, p.date["j"])
        one = np.ones_like(y)
        first, ok = _days(y, one, one)
        after, _ = _days(y + 1, one, one)
        return first + j - 1, ok & (j >= 1) & (j <= after - first)
    if "n" in p.date:
        names, at = _words(texts, p.date["n"])
        m = np.array([MONTH_NUMBER.get(x.lower(), 0) for x in names])[at]
    else:
        m = _number(chars, p.date["m"])
    return _days(y, m, _number(chars, p.date["d"]))


def _matrix(texts: list[str]) -> np.ndarray:
    a = np.array(texts, dtype=str)
    return a.view(np.uint32).reshape(len(texts), -1)


def _group(mask: str, texts: list[str], dates: list[str | None], zones: list[str | None]) -> np.ndarray:
    """UTC microseconds of texts that share a mask; INVALID where there is no instant."""
    bad = np.full(len(texts), INVALID, np.int64)
    p = compile_mask(mask)
    if p is None or (not p.epoch and p.clock is None):
        return bad
    chars = _matrix(texts)
    if p.epoch:
        n = _number(chars, (0, p.epoch))
        return n * {10: _MICROS, 13: 1000, 16: 1}[p.epoch] + (_micros(chars, p.fraction) if p.epoch == 10 else 0)
    if p.date is not None:
        day, ok = _date(p, texts, chars)
    else:
        day, ok = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for m, idx in _by_mask(dates):
            q = compile_mask(m)
            if q is not None and q.date is not None and q.clock is None:
                part = [dates[i].strip() for i in idx]
                day[idx], ok[idx] = _date(q, part, _matrix(part))
    h, i, c = (_number(chars, p.clock[k]) for k in "hic")
    micros = _micros(chars, p.clock.get("f") or p.clock.get("g"))
    zone_words: tuple[np.ndarray, np.ndarray] | None = None
    if p.half:
        words, at = _words(texts, p.half)
        half = np.array([{"AM": 1, "PM": 2}.get(x.upper().replace(".", ""), 0) for x in words])[at]
        ok &= (half == 0) | ((h >= 1) & (h <= 12))
        h = np.where(half == 0, h, h % 12 + 12 * (half == 2))
        if (half == 0).any():
            if p.zone or p.offset or not (half == 0).all():
                ok &= half > 0
            else:
                zone_words = (words, at)
    ok &= (h <= 23) & (i <= 59) & (c <= 59)
    local = day * 86400 + h * 3600 + i * 60 + c
    utc = np.full(len(texts), INVALID, np.int64)
    if p.receiver:
        utc = local
    elif p.offset:
        s, a, b, m = p.offset
        oh, om = _number(chars, (a, b)), _number(chars, (m, m + 2)) if m >= 0 else 0
        ok &= (oh <= 15) & (om <= 59)
        utc = local - np.where(chars[:, s] == ord("+"), 1, -1) * (oh * 3600 + om * 60)
    else:
        if p.zone:
            zone_words = _words(texts, p.zone)
        words, at = zone_words if zone_words is not None else (np.array([""]), np.zeros(len(texts), int))
        sites, site_at = np.unique(np.array([z or "" for z in zones], dtype=object).astype(str), return_inverse=True)
        pair = at * len(sites) + site_at
        for k in np.unique(pair):
            rows, word, site = pair == k, str(words[k // len(sites)]), str(sites[k % len(sites)])
            table = zone_table(site) if site else None
            if word.upper() in UTC_NAMES:
                utc[rows] = local[rows]
            elif word == "":
                if table is not None:
                    utc[rows] = table.to_utc(local[rows])
            elif table is not None and word.upper() in table.abbreviations:
                utc[rows] = local[rows] - table.abbreviations[word.upper()]
            elif "/" in word and (named := zone_table(word)) is not None:
                utc[rows] = named.to_utc(local[rows])
    ok &= utc != INVALID
    return np.where(ok, np.where(ok, utc, 0) * _MICROS + micros, INVALID)


def _by_mask(texts: list[str | None]) -> list[tuple[str, np.ndarray]]:
    groups: dict[str, list[int]] = {}
    for k, t in enumerate(texts):
        if t is not None:
            groups.setdefault(t.strip().translate(_TO_MASK), []).append(k)
    return [(m, np.array(v)) for m, v in groups.items()]


def to_utc_micros(texts: list[str | None], dates: list[str | None], zones: list[str | None]) -> np.ndarray:
    """UTC microseconds of a batch of texts; INVALID where a text names no instant."""
    out = np.full(len(texts), INVALID, np.int64)
    for mask, idx in _by_mask(texts):
        out[idx] = _group(mask, [texts[i].strip() for i in idx], [dates[i] for i in idx], [zones[i] for i in idx])
    return out


@F.pandas_udf(T.LongType())
def _utc_micros(text: pd.Series, date: pd.Series, zone: pd.Series) -> pd.Series:
    out = to_utc_micros(*([x if isinstance(x, str) else None for x in s] for s in (text, date, zone)))
    return pd.Series(out, dtype="Int64").mask(out == INVALID)


def utc_micros(text: Column, date: Column, zone: Column) -> Column:
    """UTC microseconds since 1970 of a timestamp text, with its date stamp and the IANA zone of its place; null if there is none."""
    return _utc_micros(text, date, zone)


def shape_mask(text: Column) -> Column:
    """The shape mask of a text as a native expression, for inventories of formats."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "[0-9]", "9"), "[A-Za-z]", "A")


def normalise_timestamps(df: DataFrame, key: str, text: Column, date: Column, zone: Column) -> DataFrame:
    """One row (key, utc_micros) for each key with an instant. Repeated rows of a key count once (the earliest instant of them); null keys are dropped."""
    parsed = df.select(F.col(key).alias(key), utc_micros(text, date, zone).alias("utc_micros"))
    # The filter on the result stands behind the aggregate: in front of it, the texts would be parsed a second time.
    return parsed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("utc_micros").alias("utc_micros")).filter("utc_micros is not null")
