"""Text metrics as column expressions (no Python per row).

Classes of characters follow Python's ``str`` methods and ``unicodedata``, which differ from Java's regex classes in places;
where they do, the ranges are generated once on the driver and embedded in the pattern.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``str.isspace`` and ``\s`` accept.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DIGITS, SIGN, LETTER = r"\d+", "[-+]?", "[a-zA-Z]"
FRACTION = rf"(?:\.{DIGITS})?"
NUMBER = f"{SIGN}{DIGITS}(?:[-/:,.]{DIGITS})*"
_CONVERSION = rf"[-+#0]?\d*{FRACTION}[{''.join(sorted('diouxXeEfFgGcrs'))}](?!{LETTER})"
BRACED, DOLLAR = r"\{[^{}]+\}", rf"\${DIGITS}"
PLACEHOLDER = "|".join([BRACED, rf"%\([^)]+\){_CONVERSION}", f"%{_CONVERSION}", DOLLAR])
TAG = f"</?{LETTER}[^>]{{0,80}}>"
_UNITS = "|".join(["世纪", "年代", "年", "月", "日", "万", "亿", "千", "百"])
PERIODS = "|".join([f"(?:{'|'.join(['early', 'late', 'mid'])})\\b", f"(?:decad|centur)(?:{'|'.join(['ies', 'es', 'e', 'y'])})\\b", r"\d{3,4}s\b"])
COMPLEX = rf"(?iu){DIGITS}(?:[,.]{DIGITS})?\s*(?:{_UNITS})|{PERIODS}"
THOUSANDS = r"\d{1,3}" + r"(?:,\d{3})+"
GROUPED = SIGN + THOUSANDS + FRACTION
DECIMAL = SIGN + DIGITS + FRACTION

_CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
_SCRIPTS = {
    "latin": "af ca cs da de en es et fi fr hr hu id it ms nl no pl pt ro sk sl sv tr vi",
    "cjk": "ja zh",
    "hangul": "ko",
    "cyrillic": "be bg kk mk ru sr uk",
    "arabic": "ar fa ps ur",
    "devanagari": "hi",
    "thai": "th",
    "hebrew": "he",
}
SCRIPT_OF = {lang: script for script, langs in _SCRIPTS.items() for lang in langs.split()}
#: Blocks with letters that are newer than the JVM's Unicode tables.
_NEW = ((0x870, 0x8C8), (0xC00, 0xCFF), (0x1700, 0x171F), (0x1B4C, 0x1B4C), (0x2C2F, 0x2C5F), (0xA7C0, 0xA7F4), (0x10570, 0x107BF), (0x10EC0, 0x10EFF), (0x10F70, 0x10F8F), (0x11070, 0x11075), (0x11240, 0x11241), (0x116B9, 0x116B9), (0x11740, 0x11746), (0x11AB0, 0x11ABF), (0x11F00, 0x11F5F), (0x12F90, 0x12FFF), (0x13430, 0x13455), (0x16A70, 0x16ACF), (0x1AFF0, 0x1B155), (0x1DF00, 0x1DF2A), (0x1E030, 0x1E08F), (0x1E290, 0x1E2AE), (0x1E4D0, 0x1E4FF), (0x1E7E0, 0x1E7FE), (0x2A6DE, 0x2A6DF), (0x2B735, 0x2B739), (0x2EBF0, 0x2EE5D), (0x31350, 0x323AF))


def _ranges(codes) -> str:
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


@lru_cache
def _newer(letters: bool) -> str:
    spans = (c for a, b in _NEW for c in range(a, b + 1))
    return _ranges(c for c in spans if (chr(c).isalpha() if letters else not unicodedata.category(chr(c)).startswith("C")))


def _above(low: int, ranges: str) -> str:
    """Class of ranges behind one comparison, so that common characters don't walk through all of them."""
    return rf"[\x{{{low:x}}}-\x{{10ffff}}&&[{ranges}]]+"


@lru_cache
def letters() -> str:
    """Pattern of letters that count for the script ratio: ``str.isalpha`` or the CJK ranges."""
    return rf"\p{{L}}+|{_above(0x870, _newer(True) + ''.join(f'\\x{{{a:x}}}-\\x{{{b:x}}}' for a, b in _CJK))}"


@lru_cache
def script_letters(script: str) -> str:
    """Pattern of a script's letters: CJK by range, others by their character name."""
    if script == "cjk":
        return _above(0x3400, "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _CJK))
    name, top = script.upper(), 0xE000 if script == "hangul" else 0x20000
    codes = [c for c in range(0x80, top) if chr(c).isalpha() and name in unicodedata.name(chr(c), "")]
    common = LETTER + "+|" if script == "latin" else ""
    return common + _above(codes[0], _ranges(codes))


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def nonspace_len(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long")


def length_ratio(source: Column, target: Column) -> Column:
    """target / source; 0 where the source is empty."""
    return F.when(source == 0, F.lit(0.0)).otherwise(target.cast("double") / source)


def control_ratio(text: Column) -> Column:
    """Share of characters of a category C*, without tab, line feed and carriage return."""
    n = _count(text, rf"[\p{{C}}&&[^\t\n\r{_newer(False)}]]+")
    return F.when(text == "", F.lit(0.0)).otherwise(n.cast("double") / F.length(text))


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)(.)\1+"), F.lit(0))
    single = F.when(text == "", F.lit(0)).otherwise(F.lit(1))
    return F.greatest(F.array_max(F.transform(runs, F.length)), single).cast("long")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def normalized_number(token: Column) -> Column:
    """``1,234.5`` without separators, a plain decimal as it is, else null."""
    return F.when(token.rlike(f"^(?:{GROUPED})$"), F.replace(token, F.lit(","), F.lit(""))).when(token.rlike(f"^(?:{DECIMAL})$"), token)


def number_value(token: Column) -> Column:
    """Canonical decimal string (no plus, no idle zeros); a token that is no decimal stays as it is.

    Tokens keep all their digits, also beyond 28.
    """
    plain = normalized_number(token)
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    whole = F.regexp_replace(F.regexp_extract(plain, r"^[+-]?(\d+)", 1), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.regexp_extract(plain, r"\.(\d+)$", 1), r"0+$", "")
    return F.coalesce(F.concat(sign, whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part))), token)


def number_values(tokens: Column) -> Column:
    return F.transform(tokens, number_value)


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def html_tags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), F.lower)


def complex_numbers(text: Column) -> Column:
    """Numbers that plain comparison can't judge: units of time and scale, or tokens that are no decimals."""
    return text.rlike(COMPLEX) | F.exists(numbers(text), lambda t: normalized_number(t).isNull())


def overlap(source: Column, target: Column) -> Column:
    """Multiset Jaccard index of two arrays; 1 of two empty ones."""
    kinds = F.array_union(source, target)

    def total(pick) -> Column:
        each = F.transform(kinds, lambda k: pick(F.size(F.filter(source, lambda x: x == k)), F.size(F.filter(target, lambda x: x == k))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(kinds) == 0, F.lit(1.0)).otherwise(total(F.least).cast("double") / total(F.greatest))


def script_text(text: Column) -> Column:
    """Text without tags, placeholders and numbers."""
    for pattern in (TAG, PLACEHOLDER, NUMBER):
        text = F.regexp_replace(text, pattern, " ")
    return text


def script_chars(text: Column, lang: str) -> Column:
    if lang not in SCRIPT_OF:
        return F.lit(0).cast("long")
    return _count(script_text(text), letters())


def script_ratio(text: Column, lang: str) -> Column:
    """Share of letters in the script of ``lang``; null without letters or without an expected script."""
    if lang not in SCRIPT_OF:
        return F.lit(None).cast("double")
    bare = script_text(text)
    all_, own = _count(bare, letters()), _count(bare, script_letters(SCRIPT_OF[lang]))
    return F.when(all_ > 0, own.cast("double") / all_)


def text_units(text: Column) -> Column:
    """Spoken units: an ideograph each, a run of letters and digits each, at least 1; marks don't end a run."""
    han = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2ebef}\x{30000}-\x{323af}"
    word = rf"[\p{{L}}\p{{N}}{_newer(True)}&&[^{han}]]"
    units = F.regexp_count(text, F.lit(rf"[{han}]|{word}(?:\p{{M}}|{word})*"))
    return F.greatest(units, F.lit(1)).cast("long")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it: the optimizer would repeat it at every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def metrics(text: Column, lang: str) -> Column:
    """All metrics of a text as a struct; they see it with white space normalised."""
    script = SCRIPT_OF.get(lang)

    def measured(t: Column) -> Column:
        letters_of = lambda bare: F.struct(_count(bare, letters()).alias("all"), _count(bare, script_letters(script)).alias("own"))
        found = bind(script_text(t), letters_of) if script else F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("own"))
        return bind(
            found,
            lambda n: F.struct(
                t.alias("normalized"),
                F.length(F.replace(t, F.lit(" "), F.lit(""))).cast("long").alias("chars"),  # no other white space is left
                control_ratio(t).alias("control_ratio"),
                longest_run(t).alias("repeated_run"),
                numbers(t).alias("numbers"),
                n["all"].alias("script_chars"),
                F.when(n["all"] > 0, n["own"].cast("double") / n["all"]).alias("script_ratio"),
            ),
        )

    return bind(normalize_space(text), measured)
