"""Scalar text functions as column expressions; all stay inside the JVM but ``segmented``, ``classified`` and ``bold_names``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import groupby
from string import ascii_uppercase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that results depend on.
CJK = "[一-龥]"
LATIN = "[a-zA-Z]"
LETTER = "[A-Za-z一-龥]"
CITATION = r"(?U)\s*\[\s*\d+\s*\]\s*[A-Z][a-z]+(\s+([A-Z]\.?|\w+))?"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
BIBLIOGRAPHY = "(?iu)(Proceedings|Journal|Conference|pages|vol|ACM|IEEE|arXiv|Springer)"
INITIALS = r"[A-Z]\.?,(?U)\s*[A-Z]"
SENTENCE = "[.?!。]"
TOKEN = r"(?s)[A-Za-z0-9]+(?:\.\d+)?%?|."
FILENAME_WORDS = ["中文", "文档", "报告", "论文", "章节", "附录", "chinese", "zhongwen", "zh"]
BLANK, SOLID = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
#: All white space: what BLANK matches with Unicode classes.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SAMPLE_CHARS, CHINESE_SHARE = 500, 0.2
SHORT = 10


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(BLANKS))


def is_valid_string(x: Column) -> Column:
    """Not null and not blank."""
    return x.isNotNull() & (strip(x) != "")


def word_count(x: Column) -> Column:
    """Words between white space of any kind."""
    return F.regexp_count(x, F.lit(f"(?U){SOLID}+"))


def has_three_words(x: Column) -> Column:
    """Whether there are three words or more; looks no further than the third."""
    return x.rlike(f"(?U){SOLID}++{BLANK}++{SOLID}++{BLANK}++{SOLID}")


def token_count(x: Column) -> Column:
    """Alphanumeric runs, and every other character as one; stands in for a segmenter."""
    return F.regexp_count(x, F.lit(TOKEN))


def segmented(segment: Callable[[str], Iterable[str]]) -> Callable[[Column], Column]:
    """Counts by a segmenter in place of ``token_count`` (F3); ``segment`` is sent to the executors, and gives the tokens of a text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sum(1 for _ in segment(t)))

    return count


def chinese_segmenter() -> Callable[[Column], Column] | None:
    """``segmented`` with the library for Chinese, where it is installed; else None."""
    try:
        import jieba
    except ImportError:
        return None
    return segmented(lambda t: jieba.cut(t))


def classified(classify: Callable[[str], str | None], chars: int = 1000) -> Callable[[Column], Column]:
    """Languages by a classifier (P4): it sees the first ``chars`` characters, and only what it says of zh and en counts; null where it fails."""

    def one(text: str | None) -> str | None:
        try:
            found = classify(text[:chars]) if text else None
        except Exception:
            return None
        return next((x for x in ("zh", "en") if found and str(found).startswith(x)), None)

    @F.pandas_udf("string")
    def languages(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return languages


def installed_classifier() -> Callable[[Column], Column] | None:
    """``classified`` with the library for language detection, where it is installed; else None."""
    try:
        from fasttext_langdetect import detect
    except ImportError:
        return None
    return classified(lambda t: detect(t)[0].get("lang") if detect(t) else None)


def is_reference(x: Column) -> Column:
    """Looks like an entry of a bibliography, or holds an e-mail address."""
    # A pattern is only tried where a sign that it needs is in the text, and the rare one of two goes first.
    has = lambda sign: F.contains(x, F.lit(sign))
    return (has("[") & x.rlike(CITATION)) | (has("@") & x.rlike(EMAIL)) | (has(",") & x.rlike(INITIALS) & x.rlike(BIBLIOGRAPHY))


def reject_reason(x: Column, tokens: Column | None = None) -> Column:
    """The first test that a block fails: empty, no_letter, few_words, reference, no_sentence; null for a valid block (F1-F5, SNK9).

    ``tokens`` is a count by a segmenter, if there is one.
    """
    return (
        F.when(x.isNull() | (x == ""), "empty")
        .when(~x.rlike(LETTER), "no_letter")
        .when(~has_three_words(x) & ((token_count(x) if tokens is None else tokens) <= 2), "few_words")
        .when(is_reference(x), "reference")
        .when(~x.rlike(SENTENCE), "no_sentence")
    )


def is_valid_block(x: Column) -> Column:
    return reject_reason(x).isNull()


def language_of_text(x: Column) -> Column:
    """'zh' if over a fifth of the letters in the first 500 characters are Chinese, else 'en'; null without letters."""
    head = F.left(x, F.lit(SAMPLE_CHARS))
    zh, en = F.regexp_count(head, F.lit(CJK)), F.regexp_count(head, F.lit(LATIN))
    return F.when(zh + en == 0, None).when(zh / (zh + en) > CHINESE_SHARE, "zh").when(zh + en > 0, "en")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of_filename(name: Column) -> Column:
    """'zh' for a Chinese character or one of FILENAME_WORDS in the name, else 'en' (P5)."""
    hit = name.rlike(CJK)
    for word in FILENAME_WORDS:
        hit = hit | F.contains(F.lower(name), F.lit(word))
    return F.when(F.coalesce(hit, F.lit(False)), "zh").otherwise("en")


def document_language(x: Column, path: Column, classified: Column | None = None) -> Column:
    """By a classifier's answer where there is one, then by text, then by file name."""
    found = [language_of_text(x), language_of_filename(file_name(path)), F.lit("en")]
    return F.coalesce(*([classified] if classified is not None else []), *found)


def token_estimate(x: Column) -> Column:
    """Chinese characters, and a quarter of the others."""
    zh = F.regexp_count(x, F.lit(CJK))
    return F.coalesce(zh + F.floor((F.length(x) - zh) / 4), F.lit(0)).cast("long")


def coarse_token_estimate(x: Column) -> Column:
    """Half the characters; 100 where the text is unknown (P10)."""
    return F.coalesce(F.floor(F.length(x) / 2), F.lit(100)).cast("long")


def preview(x: Column, n: int = 200) -> Column:
    """The first n characters, with dots if there are more."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def normalise_name(x: Column) -> Column:
    """Stripped, without spaces, tabs and line feeds inside."""
    return F.translate(strip(x), " \t\n", "")


def escape_label(x: Column) -> Column:
    """Backticks doubled (SNK3)."""
    return F.replace(x, F.lit("`"), F.lit("``"))


@lru_cache(maxsize=256)
def _one_of(chars: frozenset[str]) -> re.Pattern[str]:
    return re.compile("[" + "".join(re.escape(c) for c in sorted(chars)) + "]")


def _bold_plain(text: str, names: list[str]) -> str:
    """``bold_names`` for names without an asterisk, in the order of their replacing.

    The text is read once. A place waits at the longest name that begins there, and goes on to the next shorter one only where that name cannot be set bold.
    """
    rank = {n: i for i, n in enumerate(names)}
    head = min(3, len(names[-1]))
    lengths: dict[str, list[int]] = {}  # by the first characters, longest first
    for n in names:
        found = lengths.setdefault(n[:head], [])
        if not found or found[-1] != len(n):
            found.append(len(n))
    places: list[list[int]] = [[] for _ in names]

    def wait(start: int, below: int) -> None:
        for length in lengths.get(text[start : start + head], ()):
            if length < below and (i := rank.get(text[start : start + length])) is not None:
                return places[i].append(start)

    first = {n[0] for n in names}
    if not first.isdisjoint(ascii_uppercase):  # all capitals, so that most texts share a compiled pattern
        first.update(ascii_uppercase)
    for m in _one_of(frozenset(first)).finditer(text):
        wait(m.start(), len(names[0]) + 1)
    signs = bytearray(len(text) + 1)  # 1 where a sign was put in before this character
    cuts: list[int] = []
    for n, starts in zip(names, places):
        taken: list[int] = []
        last = 0
        for start in sorted(starts):
            end = start + len(n)
            if start and text[start - 1] == "*" or signs[start]:
                continue  # nothing that begins here can be set bold any more
            if start < last or text.startswith("*", end) or signs.find(1, start + 1, end + 1) >= 0:
                wait(start, len(n))
                continue
            last = end
            taken += (start, end)
        for at in taken:  # only now: copies that touch are all set bold
            signs[at] = 1
        cuts += taken
    cuts.sort()
    return "**".join(text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)]))


def _bold(text: str | None, names: Iterable[str | None] | None) -> str | None:
    if text is None or names is None:
        return None
    order = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
    for starred, group in groupby(order, key=lambda n: "*" in n):
        if not starred:
            text = _bold_plain(text, list(group))
            continue
        for n in group:  # may take in signs put in before, so it is looked for in the text as it is by then
            text = re.sub(rf"(?<!\*){re.escape(n)}(?!\*)", lambda m: f"**{m[0]}**", text)
    return text


def bold_names(text: Column, names: Column) -> Column:
    """Each name in ``names`` set between ** where no asterisk touches it; longest first, equals by name."""

    @F.pandas_udf("string")
    def bold(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_bold(t, n) for t, n in zip(texts, names)], dtype=object)

    return bold(text, names)


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
