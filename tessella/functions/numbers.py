"""Numbers of Chinese-English pairs: values to compare, with scales, decades and month names, in one Arrow UDF.

Compatibility normalisation (NFKC) has no built-in expression, so this runs in Python, a batch at a time; plans call it only for
the zh-en pair.
"""

from __future__ import annotations

import calendar
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import functions as F

from . import text as T

_BEFORE, _NO_DIGIT = f"(?<!{T.LETTER})(?<![0-9])", r"(?<!\d)"
_PLAIN = re.compile(f"{_BEFORE}(?:{T.GROUPED}|{T.DECIMAL})")
_ZH_SCALES = {"万多亿": 12, "万亿": 12, "亿": 8, "万": 4}
_EN_SCALES = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12}
_SCALES = _ZH_SCALES | _EN_SCALES
_SPACED = r"\d{1,3}" + r"(?:[\s,]\d{3})+"
_SCALED = re.compile(rf"{_BEFORE}({T.SIGN}(?:{_SPACED}|{T.DIGITS}){T.FRACTION})[-\s]*({'|'.join(_SCALES)})(?!{T.LETTER})", re.I)
_TWO = r"(\d{1,2})\s*"
_ZH_DECADE = re.compile(rf"{_BEFORE}{_TWO}世纪\s*{_TWO}年代")
_MONTH_NUMBER = "|".join(["1[012]", "0?[1-9]"])
_ZH_MONTH = re.compile(rf"{_NO_DIGIT}({_MONTH_NUMBER})\s*月份?")
_ZH_YEAR = re.compile(_NO_DIGIT + r"\d{1,4}" + r"\s*年(?!代)")
_MONTHS = {name: k for k, name in enumerate(calendar.month_name) if name}
_EN_MONTH = re.compile(rf"\b(?:{'|'.join(_MONTHS)})\b")
_EN_DECADE = re.compile(_NO_DIGIT + r"(\d{3,4})" + r"s\b", re.I)
_ZH_LEFT = re.compile(rf"{T.DIGITS}(?:[,.]{T.DIGITS})?\s*(?:{'|'.join(['世纪', '年代', '年份?', '月份?', '日', *_ZH_SCALES, '兆', '千', '百'])})")
_EN_LEFT = re.compile(rf"\b(?:{'|'.join(['late', 'mid', 'early', 'decades?', 'centuries', 'century'])})\b|\d{{3,4}}s\b", re.I)
_SLASH, _HYPHEN, _DASH = "⁄", "－", "–"
_FRACTION = re.compile(T.DIGITS + _SLASH + T.DIGITS)
_PART = f"(?:{T.THOUSANDS}|{T.DIGITS}){T.FRACTION}"
_RANGE = re.compile(f"{T.SIGN}{_PART}(?:-{_PART})+")
_TOKEN = re.compile(T.NUMBER)
_WHOLE = re.compile(f"(?:{T.GROUPED}|{T.DECIMAL})")
SCHEMA = "source array<string>, target array<string>, unsupported boolean"


def canonical(value: str, power: int = 0) -> str:
    """Decimal string without idle zeros, times a power of ten."""
    try:
        return format((Decimal(re.sub(r"[\s,]", "", value)) * 10**power).normalize(), "f")
    except InvalidOperation:
        return value


def comparable(text: str) -> str:
    """NFKC, but a full-width hyphen becomes a dash (no sign), and fractions are blanked."""
    folded = unicodedata.normalize("NFKC", text.replace(_HYPHEN, _DASH))
    return _FRACTION.sub(" ", folded)


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in spans:
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def _english_months(text: str) -> list[int]:
    """Months by name; a sentence's first "May" counts only before a digit."""
    found = []
    for m in _EN_MONTH.finditer(text):
        if m[0] == "May":
            head, tail = text[: m.start()].rstrip(), text[m.end() :].lstrip(" ,")
            if (not head or head[-1] in ".!?") and not tail[:1].isdecimal():
                continue
        found.append(_MONTHS[m[0]])
    return found


class _Side:
    """Values found in one text, and the spans that they explain."""

    def __init__(self, text: str):
        self.text, self.values, self.taken, self.known = text, [], [], []

    def take(self, m: re.Match, value: str) -> None:
        self.values.append(value)
        self.taken.append(m.span())
        self.known.append(m.span())

    def scaled(self) -> None:
        for m in _SCALED.finditer(self.text):
            self.take(m, canonical(m[1], _SCALES[m[2].lower()]))

    def rest(self, left: re.Pattern) -> tuple[list[str], bool]:
        """All values, and whether something is left that can't be judged."""
        plain = [canonical(m[0]) for m in _PLAIN.finditer(_blank(self.text, self.taken))]
        return sorted(self.values + plain), bool(left.search(_blank(self.text, self.known)))


def compare(chinese: str, english: str) -> tuple[list[str], list[str], bool]:
    """(values of the Chinese text, of the English text, whether either has numbers beyond these rules); texts with space normalised."""
    odd = any(not _WHOLE.fullmatch(t) and not _RANGE.fullmatch(t) for x in (chinese, english) for t in _TOKEN.findall(x))
    zh, en = _Side(comparable(chinese)), _Side(comparable(english))
    months = {int(m[1]) for m in _ZH_MONTH.finditer(zh.text)} & set(_english_months(en.text))
    decades = set()
    for m in _ZH_DECADE.finditer(zh.text):
        century, decade = int(m[1]), int(m[2])
        if century > 0 and decade < 100:
            decades.add(year := (century - 1) * 100 + decade)
            zh.take(m, str(year))
    zh.scaled()
    for m in _ZH_MONTH.finditer(zh.text):
        if int(m[1]) in months:
            zh.take(m, str(int(m[1])))
    zh.known += [m.span() for m in _ZH_YEAR.finditer(zh.text)]
    en.scaled()
    en.values += [str(k) for k in _english_months(en.text) if k in months]
    for m in _EN_DECADE.finditer(en.text):
        if int(m[1]) in decades:
            en.take(m, str(int(m[1])))
    (a, left_a), (b, left_b) = zh.rest(_ZH_LEFT), en.rest(_EN_LEFT)
    return a, b, left_a or left_b or odd


def zh_en(source_is_chinese: bool):
    """Arrow UDF (source, target) -> struct of sorted values and ``unsupported``."""

    @F.pandas_udf(SCHEMA)
    def values(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for source, target in pairs:
            rows = []
            for x, y in zip(source.fillna(""), target.fillna("")):
                if source_is_chinese:
                    rows.append(compare(x, y))
                else:
                    a, b, odd = compare(y, x)
                    rows.append((b, a, odd))
            yield pd.DataFrame(rows, columns=["source", "target", "unsupported"])

    return values
