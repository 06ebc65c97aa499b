"""Rule statistics of whole texts, in Python workers. Words are runs of characters other than blanks and U+0009 to U+000D."""

from __future__ import annotations

from itertools import compress

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_has_word = str.maketrans("", "", BLANKS)

#: Whole numbers of base(), then of more().
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_exclaim", "n_lines", "n_short_words", "n_distinct_words", "n_separators")
#: Words that only part others.
SEPARATORS = frozenset(x.encode() for x in ("|", "-", "–", "—", "*", "/", "\\", ">", "»", "•", "·", "::", "||"))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    add = seen.add
    for w in windows:
        if w in seen:
            twice.add(w)
        else:
            add(w)
    at = np.fromiter(compress(range(n), map(twice.__contains__, windows)), np.int64)
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def count_all(text: str) -> tuple[int, ...]:
    """BASE and MORE of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        chars,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - len(raw.translate(None, _UPPER)),
        text.count("!"),
        len(lines),
        sum([len(w) <= 3 for w in words]),
        len(set(words)),
        sum(map(SEPARATORS.__contains__, words)),
    )


def table(texts: list[str]) -> np.ndarray:
    """A row of count_all() for each text."""
    return np.array([count_all(t) for t in texts], np.int64).reshape(len(texts), len(BASE) + len(MORE))


def ratios(counts: np.ndarray) -> np.ndarray:
    """Columns: symbols, repeated lines, repeated words, upper case, exclamation marks, word length, short words, distinct words, separators."""
    n, chars, symbols, dup, repeat, upper, exclaim, lines, short, distinct, parting = counts.astype(np.float64).T
    words, chars1 = np.maximum(n, 1), np.maximum(chars, 1)
    return np.column_stack([symbols / chars1, dup / np.maximum(lines, 1), repeat / words, upper / chars1, exclaim / chars1, chars / words, short / words, distinct / words, parting / words])
