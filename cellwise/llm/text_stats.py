"""Document statistics from UTF-8 bytes: the counts of the base rules and the inputs of both quality models."""

from __future__ import annotations

import numpy as np

#: Fixed values of the base rules: characters that separate words, and those that count as symbols.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"

FEATURES = [
    "log_words", "word_length", "symbols_per_word", "pipes_per_word", "marks_per_word", "upper_share", "digit_share",
    "stops_per_word", "commas_per_word", "brackets_per_word", "at_slash_per_word", "non_ascii_share", "dup_line_share",
    "repeat_share", "distinct_share", "top_word_share", "words_per_line", "short_word_share", "long_word_share", "same_length_share",
]

_CLASSES = {
    "symbol": SYMBOLS, "pipe": b"|", "mark": b"!?", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789",
    "stop": b".", "comma": b",;:", "bracket": b"(){}[]<>=", "at": b"@/\\_", "continuation": bytes(range(128, 192)), "lead": bytes(range(192, 256)), "space": SPACE, "newline": b"\n",
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _k] = 1


def repeated_words(words: list[bytes]) -> tuple[int, int, int]:
    """Words inside 3-word windows that occur twice or more, distinct words, and uses of the commonest word."""
    n = len(words)
    if not n:
        return 0, 0, 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(n)), np.int64, n)
    top = int(np.bincount(ids).max())
    if n < 3:
        return 0, len(seen), top
    if n >= 1 << 21:  # keys of three positions would not fit 63 bits
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * n + ids[2:]
    else:
        keys = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0, len(seen), top
    at = np.isin(keys, twice)
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= at
    return int(covered.sum()), len(seen), top


def describe(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts (long arrays) and a feature matrix with the columns of FEATURES; an empty text has zeros."""
    base = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    features = np.zeros((len(texts), len(FEATURES)))
    names = list(_CLASSES)
    for i, text in enumerate(texts):
        counts = dict(zip(names, np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE))
        words = text.split()  # for bytes, exactly at the six separators
        n = len(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        repeats, distinct, top = repeated_words(words)
        chars = int(len(text) - counts["continuation"] - counts["space"])
        base["n_words"][i], base["word_chars"][i], base["n_symbols"][i] = n, chars, int(counts["symbol"])
        base["n_dup_lines"][i], base["n_repeat_words"][i] = len(lines) - len(set(lines)), repeats
        if not n:
            continue
        lengths = np.fromiter(map(len, words), np.int64, n)
        letters = max(1.0, counts["upper"] + counts["lower"])
        features[i] = (
            np.log1p(n), chars / n, counts["symbol"] / n, counts["pipe"] / n, counts["mark"] / n, counts["upper"] / letters, counts["digit"] / max(1, chars),
            counts["stop"] / n, counts["comma"] / n, counts["bracket"] / n, counts["at"] / n, counts["lead"] / max(1, chars), base["n_dup_lines"][i] / len(lines),
            repeats / n, distinct / n, top / n, np.log1p(n / len(lines)), (lengths <= 3).mean(), (lengths >= 12).mean(), (lengths[1:] == lengths[:-1]).mean() if n > 1 else 0.0,
        )
    return base, features
