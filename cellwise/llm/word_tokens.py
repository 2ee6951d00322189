"""Ids of a white-space-insensitive `tokenizers` file, word by word, with a bounded memory of words seen."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

from cellwise.llm.word_hashes import WHITE, word_hashes


#: Fixed value: the pattern of a file's pre-tokenizer by which `letter_runs` may cut words.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_OTHER = ~(_LETTER | WHITE)
_OTHER[128:] = False
_BEFORE_LETTER = _OTHER.copy()
_BEFORE_LETTER[ord("'")] = False


def letter_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with A-Z in lower case, and marks at the seams of words between an ASCII letter and another ASCII character.

    No match of `RUNS` crosses these seams: a run of letters ends or begins there, and a contraction begins with its apostrophe, behind
    which there is no seam. Bytes from 128 on may be letters or not, so no seam is beside them; and a letter before one keeps its
    case, since NFC, which comes before lower-casing, composes some marks with small letters only.
    """
    letter, inner = _LETTER[data], np.zeros(len(data), bool)
    inner[1:] = (letter[:-1] & _OTHER[data[1:]]) | (_BEFORE_LETTER[data[:-1]] & letter[1:])
    lower = _UPPER[data]
    lower[:-1] &= data[1:] < 128
    return data + (lower * np.uint8(32)), inner


def _cuts_letter_runs(path: str) -> bool:
    """Whether the file lower-cases and then takes the matches of `RUNS`, each for itself."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normal, split = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    lowers = [n["type"] for n in normal.get("normalizers", [])][-1:] == ["Lowercase"] and all(n["type"] in ("NFC", "Replace", "Lowercase") for n in normal["normalizers"])
    first = (split.get("pretokenizers") or [{}])[0]
    return lowers and all(n.get("pattern") == {"Regex": r"\s+"} for n in normal["normalizers"] if n["type"] == "Replace") and first.get("pattern") == {"Regex": RUNS} and first.get("behavior") == "Removed" and first.get("invert") is True


class Memory:
    """Two generations of a dictionary: what is used stays, and at most 2 * `size` entries outlive a call of `fill`."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def fill(self, keys: Iterable, make: Callable[[list], Iterable]) -> dict:
        """A dictionary that has all of `keys`; `make` gives the values of those that are new."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old, missing = self.young, self.old, []
        for k in set(keys):
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    missing.append(k)
        young.update(zip(missing, make(missing)))
        return young


def gathered(key: np.ndarray, begin: np.ndarray, end: np.ndarray, of_text: np.ndarray, data: np.ndarray, memory: Memory, new: Callable[[list[bytes]], Iterable[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows of chunks (data[begin:end], equal where `key` is), each distinct chunk encoded once: ids, and where each text's begin.

    A chunk is known by its 64-bit key within the slice of texts, and by its bytes in the memory.
    """
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    raw = data.tobytes()
    chunks = [raw[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist())]
    known = memory.fill(chunks, new)
    found = [known[c] for c in chunks]
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), "<u4")
    n = counts[which]
    ends = np.r_[0, np.cumsum(n)]
    ids = flat[np.repeat((np.cumsum(counts) - counts)[which] - ends[:-1], n) + np.arange(ends[-1])]
    return ids, ends[of_text]


class WordEncoder:
    """Ids as `tokenizers` gives them for whole texts (add_special_tokens=False, special strings are ordinary text).

    The file's rules never look across white space, so a text's ids are those of its words in order. Words are cut
    further, by `letter_runs`, where the file's rules are of that kind. New words are encoded many at once: runs of ASCII
    letters side by side, since each one's last id alone has the suffix of word ends, others with a separator behind each.
    """

    MARK = "\x01"

    def __init__(self, path: str, remember: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        (self.mark,) = self._one(self.MARK)
        self.memory = Memory(remember)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.marks, self.last = np.zeros(size, bool), np.zeros(size, bool)
        self.marks[self.mark] = True
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.last[[i for word, i in vocabulary.items() if suffix and word.endswith(suffix)]] = True
        self.cut = letter_runs if suffix and _cuts_letter_runs(path) else None

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _new(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        alone = [i for i, w in enumerate(words) if self.cut and w.isalpha() and len(w) < 1000]
        rest = set(range(len(words))).difference(alone)
        texts = {i: words[i].decode("utf-8", "replace") for i in rest}
        plain = [i for i, t in texts.items() if self.MARK not in t and len(t) < 1000]
        for i in rest.difference(plain):
            out[i] = np.array(self._one(texts[i]), "<u4").tobytes()
        self._runs(alone, lambda part: b" ".join([words[i] for i in part]).decode(), self.last, 0, out)
        self._runs(plain, lambda part: f" {self.MARK} ".join([texts[i] for i in part]) + f" {self.MARK}", self.marks, 1, out)
        return out

    def _runs(self, which: list[int], join: Callable[[list[int]], str], closing: np.ndarray, dropped: int, out: list[bytes]) -> None:
        """Encode words 50 at a time. Each one's ids end with one that is `closing`; the last `dropped` ids are not the word's."""
        parts = [which[k : k + 50] for k in range(0, len(which), 50)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([join(p) for p in parts], add_special_tokens=False) if parts else []):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(closing[ids]) + 1).tolist()
            raw = ids.tobytes()
            for i, a, b in zip(part, [0, *ends], ends):
                out[i] = raw[4 * a : 4 * (b - dropped)]
            if len(ends) != len(part):
                raise ValueError("a run of words and its ids do not match")

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (and the end)."""
        h, first, end, of_text, data = word_hashes(texts, self.cut)
        return gathered(h, first, end, of_text, data, self.memory, self._new)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_flat(texts)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker: later tasks find the words that earlier ones met."""
    return WordEncoder(path)
