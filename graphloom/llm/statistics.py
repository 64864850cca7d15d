"""Statistics of whole texts, for many at once: exact counts for the base rules and features for the models.

A null text counts as empty; an empty text has zeros everywhere. Long texts are counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from graphloom.llm.arrays import U, Words, mix, powers, inverse, rolling

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the models; shares are of characters, words or lines.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "log_lines", "words_per_line", "digit_share", "upper_share",
    "punct_share", "wide_share", "distinct_share", "top_share", "caps_words", "digit_words", "long_words", "short_words", "exclaim_share", "pipe_share",
    "stop_share", "url_share", "end_lines", "word_spread", "brace_share",
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_DIGIT, _UPPER, _PUNCT = _class(b"0123456789"), _class(bytes(range(65, 91))), _class(b".,;:!?\"'()-")
_EXCLAIM, _PIPE, _BRACE, _STOP = _class(b"!"), _class(b"|"), _class(b"{}[]\\/=_@~^`+"), _class(b".!?\"'")
_START = np.ones(256, dtype=bool)
_START[0x80:0xC0] = False
_WIDE = np.zeros(256, dtype=bool)
_WIDE[0xC0:] = True
_SPACE = _class(b" \t\n\x0b\x0c\r")


def _group_counts(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value how often its text has it; a flag on one value of each kind; the key's order is not kept."""
    key = mix(names + text.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    lead = np.zeros(len(key), dtype=bool)
    lead[first] = True
    return count[back], lead, back


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features): for each text a row of COUNTS (int64) and one of FEATURES (float64)."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return _measure(column)


def _measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = Words(column)
    data, m = w.data, len(w.first) - 1
    n_words = np.diff(w.first)
    text = w.text_of()

    def total(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of a value for each byte or word, by text; ``at`` has the bounds of the texts."""
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    def of_bytes(kind: np.ndarray) -> np.ndarray:
        return total(kind[data], w.offsets)

    chars = of_bytes(_START)
    word_chars = chars - of_bytes(_SPACE)
    symbols = of_bytes(_SYMBOL)

    # Lines: a text starts one, and so does every byte after a line feed.
    head = np.zeros(len(data) + 1, dtype=bool)
    head[w.offsets] = True
    head[1:][data == 10] = True
    starts = np.flatnonzero(head[: len(data)])
    ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    inner = np.where((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(starts) else ends
    solid = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~_SPACE[data], out=solid[1:])
    with_word = solid[inner] > solid[starts]
    starts, inner = starts[with_word], inner[with_word]
    line_text = np.searchsorted(w.offsets, starts, side="right") - 1
    base = 0xD1B54A32D192ED03
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * U(0xA0761D6478BD642F) * powers(base, len(data)), out=sums[1:])
    line_name = mix((sums[inner] - sums[starts]) * powers(inverse(base), len(data) + 1)[starts]) + U(0)
    line_name = mix(line_name ^ (inner - starts).astype(np.uint64))
    _, lead, _ = _group_counts(line_name, line_text)
    by_line = np.searchsorted(starts, w.offsets)
    n_lines = np.diff(by_line)
    dup_lines = total(~lead, by_line)
    last = data[np.maximum(inner - 1, 0)] if len(inner) else data[:0]
    end_lines = total(_STOP[last], by_line)

    # Words in three-word windows that their text has twice or more.
    three = rolling(w.name, 3)
    again = np.zeros(len(w.name) + 1, dtype=np.int64)
    if len(three):
        whole = text[2:] == text[:-2]
        at = np.flatnonzero(whole)
        count, _, _ = _group_counts(three[at], text[at])
        hit = at[count > 1]
        np.add.at(again, hit, 1)
        np.add.at(again, hit + 3, -1)
    covered = np.cumsum(again)[: len(w.name)] > 0
    repeat = total(covered, w.first)

    size = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_START[data], out=size[1:])
    length = size[w.end] - size[w.start]
    count, lead, _ = _group_counts(w.name, text)
    distinct = total(lead, w.first)
    top = np.zeros(m, dtype=np.int64)
    np.maximum.at(top, text, count)

    def words_with(kind: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(kind[data], out=sums[1:])
        return sums[w.end] - sums[w.start]

    caps = total((words_with(_UPPER) >= 2) & (words_with(_UPPER) * 2 > length), w.first)
    digit_words = total(words_with(_DIGIT) > 0, w.first)
    squares = total(length * length, w.first)
    per_word = lambda x: x / np.maximum(n_words, 1)
    per_char = lambda x: x / np.maximum(chars, 1)
    per_line = lambda x: x / np.maximum(n_lines, 1)
    mean = per_word(word_chars)
    colon = np.flatnonzero((data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47)) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    urls = np.bincount(np.searchsorted(w.offsets, colon, side="right") - 1, minlength=m)[:m] if m else np.zeros(0)
    features = np.column_stack([
        np.log1p(n_words), mean, per_char(symbols), per_line(dup_lines), per_word(repeat), np.log1p(n_lines), np.log1p(per_line(n_words)), per_char(of_bytes(_DIGIT)), per_char(of_bytes(_UPPER)),
        per_char(of_bytes(_PUNCT)), per_char(of_bytes(_WIDE)), per_word(distinct), per_word(top), per_word(caps), per_word(digit_words), per_word(total(length > 12, w.first)), per_word(total(length <= 2, w.first)), per_char(of_bytes(_EXCLAIM)), per_char(of_bytes(_PIPE)),
        per_word(total(_STOP[data[np.maximum(w.end - 1, 0)]] if len(w.end) else np.zeros(0, bool), w.first)), per_word(urls), per_line(end_lines), np.sqrt(np.maximum(per_word(squares) - mean * mean, 0)), per_char(of_bytes(_BRACE)),
    ]).astype(np.float64)
    counts = np.column_stack([n_words, word_chars, symbols, dup_lines, repeat]).astype(np.int64)
    return counts, features
