"""Byte-level BPE as a tree reduction: halves are encoded apart and joined where they meet.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs. So a
join re-encodes a window around the seam and is done as soon as the window's outer tokens agree with the
neighbours outside; until then the window grows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.llm.common import map_rows, texts_of
from cellwise.llm.word_hashes import mixed, word_hashes
from cellwise.llm.word_tokens import Memory, gathered

#: The Unicode property White_Space, which the pattern's \s stands for.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class TreeBPE:
    """Encodes and decodes by a rank table. `leaf`: bytes up to which a string is encoded without halving."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 12, remember: int = 100_000) -> None:
        self.ranks, self.leaf, self.memory = ranks, leaf, Memory(remember)
        self.none = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {(ranks[t[:i]] * (self.none + 1) + ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        self.leaf_ids: dict[bytes, list[int]] = {}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.table = np.empty(self.none, object)
        self.table[list(self.bytes_of)] = list(self.bytes_of.values())
        own = pattern.replace("[^\\s", f"[^{WHITE}").replace("(?!\\S)", f"(?![^{WHITE}])").replace("\\s", f"[{WHITE}]")
        self.pieces: Callable[[str], list[str]] = regex.compile(own).findall
        #: White space before a word belongs to the word's matches; no match goes on behind a word.
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.other_white = re.compile(f"(?![\t-\r ])[{WHITE}]").search
        self.agree = lru_cache(1 << 17)(self._agree)
        self.half = lru_cache(1 << 17)(self._tree)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> TreeBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _short(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        none = 1 << 60
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _long(self, data: bytes) -> list[int]:
        """The same with a heap, for windows that grew large."""
        n, get = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != e:
                continue
            end[i], end[j] = e, -1
            if e < n:
                before[e] = i
                if (r := get(data[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (k := before[i]) >= 0 and (r := get(data[k:e])) is not None:
                heapq.heappush(heap, (r, k, e))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def _direct(self, data: bytes) -> list[int]:
        return self._short(data) if len(data) <= 96 else self._long(data)

    def _agree(self, a: int, b: int) -> bool:
        return self._direct(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded strings put together."""
        if not left or not right:
            return left or right
        if self.agree(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self._direct(b"".join([self.bytes_of[t] for t in (*left[-a:], *right[:b])]))
            firm_left = a == len(left) or self.agree(left[-a - 1], window[0])
            firm_right = b == len(right) or self.agree(window[-1], right[b])
            if firm_left and firm_right:
                return left[:-a] + window + right[b:]
            a = a if firm_left else min(len(left), 2 * a)
            b = b if firm_right else min(len(right), 2 * b)

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        return [self.ranks[data]] if data in self.ranks else self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.leaf_ids[data] if data in self.leaf_ids else self._short(data)
        half = len(data) // 2
        if half > 32:
            return self.join(self._tree(data[:half]), self._tree(data[half:]))
        return self.join(self.half(data[:half]), self.half(data[half:]))

    def _leaves(self, pieces: set[bytes]) -> None:
        """Encode the leaves of the trees of `pieces` side by side: in every round each leaf merges its lowest-ranked pair, leftmost first."""
        todo: set[bytes] = set()

        def split(data: bytes) -> None:
            if len(data) <= self.leaf:
                todo.add(data)
            else:
                half = len(data) // 2
                split(data[:half]), split(data[half:])

        for p in pieces:
            if p not in self.ranks:
                split(p)
        if len(self.leaf_ids) > 1 << 17:
            self.leaf_ids.clear()
        new = [p for p in todo if p not in self.leaf_ids]
        if not new:
            return
        length = np.fromiter(map(len, new), np.int64, len(new))
        data = np.frombuffer(b"".join(p.ljust(self.leaf, b"\0") for p in new), np.uint8).reshape(len(new), self.leaf)
        tokens = np.full((len(new), self.leaf + 1), self.none, np.int64)
        tokens[:, :-1] = np.where(np.arange(self.leaf) < length[:, None], self.single[data], self.none)

        def ranks_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            pair = left * (self.none + 1) + right
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            return np.where(self.pairs[at] == pair, self.merged[at], self.none)

        rows, columns = np.arange(len(new)), np.arange(self.leaf + 1)
        t, rank = tokens, ranks_of(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            best = rank.argmin(1)
            least = rank[np.arange(len(rows)), best]
            on = least < self.none
            tokens[rows[~on]] = t[~on]
            rows, t, rank, best, least = rows[on], t[on], rank[on], best[on], least[on]
            i = np.arange(len(rows))
            t[i, best] = least
            move = np.minimum(columns + (columns > best[:, None]), self.leaf)
            t = np.take_along_axis(t, move, 1)
            t[:, -1] = self.none
            rank = np.take_along_axis(rank, np.minimum(move[:, :-1], self.leaf - 1), 1)
            rank[:, -1] = self.none
            rank[i, best] = ranks_of(t[i, best], t[i, best + 1])
            before = np.maximum(best - 1, 0)
            rank[i, before] = np.where(best > 0, ranks_of(t[i, before], t[i, before + 1]), rank[i, before])
        lists = tokens.tolist()
        counts = (tokens < self.none).sum(1).tolist()
        self.leaf_ids.update((p, x[:n]) for p, x, n in zip(new, lists, counts))

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        split = [[p.encode() for p in self.pieces(c)] for c in chunks]
        distinct = {p for pieces in split for p in pieces}
        self._leaves(distinct)
        known = {p: struct.pack(f"<{len(ids)}I", *ids) for p in distinct for ids in (self.encode_bytes(p),)}
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def _odd(self, text: str) -> bytes:
        return b"".join(self._chunks(self.chunks(text)))

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (and the end). Chunks are a word with the white space
        before it, and what is behind the last word; texts with other white space than ASCII's are cut by the pattern itself."""
        h, first, end, of_text, data = word_hashes(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        stop = np.cumsum(sizes) - 1
        begin = np.empty(len(h), np.int64)
        begin[1:] = end[:-1]
        some = of_text[1:] > of_text[:-1]
        begin[of_text[:-1][some]] = (stop - sizes + 1)[some]
        key, raw = h.copy(), data.tobytes()
        gap = first - begin
        space = (gap == 1) & (data[np.minimum(begin, len(data) - 1)] == 32)
        key[space] = mixed(key[space] + np.uint64(1))
        rest = np.flatnonzero((gap > 0) & ~space)
        white = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(begin[rest].tolist(), first[rest].tolist())), np.uint64, len(rest))
        key[rest] = mixed(key[rest] ^ white)
        ids, ends = gathered(key, begin, end, of_text, data, self.memory, lambda new: self._chunks([c.decode("utf-8", "replace") for c in new]))
        last = np.where(some, end[np.maximum(of_text[1:] - 1, 0)] if len(end) else 0, stop - sizes + 1)
        other = {i: self._chunks([texts[i][a:].decode()])[0] for i, a in zip(np.flatnonzero(last < stop).tolist(), (last - stop + sizes - 1)[last < stop].tolist())}
        other = {i: (True, tail) for i, tail in other.items()}
        for i, t in enumerate(texts):
            if not t.isascii() and self.other_white(t.decode("utf-8", "replace")):
                other[i] = (False, self._odd(t.decode("utf-8", "replace")))
        if not other:
            return ids, ends
        parts = []
        for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
            follows, more = other.get(i, (True, b""))
            parts += [ids[a:b]] * follows + [np.frombuffer(more, "<u4")]
            sizes[i] = (b - a) * follows + len(more) // 4
        return np.concatenate(parts), np.r_[0, np.cumsum(sizes)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_flat([t.encode() for t in texts])
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, concatenated up a tree of runs."""
        if len(ids) <= 4096:
            return b"".join(self.table[ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def tree_coder(path: str, pattern: str) -> TreeBPE:
    """The coder of this Python worker: later tasks find the chunks that earlier ones met."""
    return TreeBPE.from_file(path, pattern)


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and `ids`, little-endian uint32, on request).

    A null or empty text has no tokens and the digest of nothing. Repeated rows give repeated results, an empty
    table an empty one; a null id stays null; other columns are not looked at.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    fields = [source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def make():
        coder = tree_coder(ranks_file, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = coder.encode_flat(texts_of(batch.column("text")))
            runs = [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            raw, decoded = [r.tobytes() for r in runs], [coder.decode(r) for r in runs]
            columns = [batch.column("doc_id"), pa.array([len(r) // 4 for r in raw], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in v]) for v in (raw, decoded))]
            return pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=schema.names)

        return one

    return map_rows(source, make, schema, "text")
