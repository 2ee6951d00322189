"""N-gram Jaccard join by PartEnum signatures.

Sets are dealt into size bands whose bounds grow by 4/3, so sets with a Jaccard similarity of 3/4 or more lie in the same
or in neighbouring bands. A pair of bands has a partition of the feature domain in two levels: `parts` parts of
three subparts each, and a set has a signature for every subset of two subparts of every part (its features in them).
Two similar sets differ in a known number of features at most, each of which can spoil two signatures of its part
the first time and one more after, so they share a known number of signatures. A candidate pair must reach that
number, less the signatures that are empty or frequent.

Sets whose links frequent signatures could hide ("open" sets: members of large groups, and texts that are mostly
common passages) are compared further by their features. Features that few open sets have are enumerated, the
frequent ones only counted: what two sets have in common is at most the rare features that they share and the smaller number
of frequent ones. Pairs that pass this bound are candidates. Pairs without a common rare feature can only be linked if
both sets consist of frequent features almost entirely ("core" sets); these meet under their signatures again, first each
with one central set; a set that is still apart from a component in which the bound allows a link is then compared with all of it, in blocks. Every candidate is verified on its texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellwise.llm.common import map_rows, slices, texts_of
from cellwise.llm.word_hashes import mixed, word_hashes
from cellwise.operators.graph import components
from cellwise.session import stored

WORDS = 5
#: A signature or feature that more sets than this share is frequent.
FREQUENT = 24
#: Entries of a bucket, about: what one reducing task holds at once.
BUCKET = 1_000_000
#: Core sets of a block, of which a task compares two at most.
BLOCK = 2048
#: Rounds in which core sets meet one central set of each signature.
TURNS = 3
#: Id lists up to this many rows (16 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_NONE = np.empty(0, np.int64)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of all texts (A-Z lower-cased), one text after another, and where each text's begin."""
    h, _, _, of_text, _ = word_hashes([t.lower() for t in texts])
    words = np.diff(of_text)
    n = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    first = np.r_[0, np.cumsum(n)]
    flat = np.empty(first[-1], np.uint64)
    runs = len(h) - WORDS + 1
    g = mixed(sum((h[i : i + runs] * _MIX[i] for i in range(1, WORDS)), h[:runs] * _MIX[0])) if runs > 0 else h[:0]
    for w, a, b, count in zip(of_text.tolist(), first.tolist(), first[1:].tolist(), words.tolist()):
        if count >= WORDS:
            flat[a:b] = np.sort(g[w : w + count - WORDS + 1])
        elif count:
            flat[a] = mixed((h[w : w + count] * _MIX[:count]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count))[0]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[first[:-1][n > 0]] = True
    return flat[new], np.r_[0, np.cumsum(new)][first]


def class_keys(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 62-bit key of each set, 0 for the empty set."""
    raw = flat.data.cast("B") if len(flat) else b""
    return np.array([(xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) >> 2 or 1) if b > a else 0 for a, b in zip(first.tolist(), first[1:].tolist())], np.int64)


def band_bounds(most: int) -> np.ndarray:
    """Smallest size of each band, until one exceeds `most` twice."""
    bounds = [1, 2]
    while bounds[-2] <= most:
        bounds.append(max(bounds[-1] + 1, 4 * (bounds[-1] - 1) // 3 + 1))
    return np.array(bounds + [bounds[-1] * 2], np.int64)


def parts_of(low: np.ndarray) -> np.ndarray:
    """First-level parts of the domain for the pair of bands that begins at size `low`; each has three subparts."""
    return low // 4 + 4


def shared_at_least(parts: np.ndarray, different: np.ndarray) -> np.ndarray:
    """Signatures, empty ones included, that two sets share which differ in so many features: the first difference in
    a part spoils two of its three, a second one in another subpart the last."""
    return np.maximum(3 * parts - 2 * different, 2 * parts - different)


def pair_of_bands(sizes: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair of bands in which a set is in the lower (0) or upper (1) one, or -1; and its parts (0 for none)."""
    bounds = band_bounds(int(sizes.max(initial=1)))
    pair = np.where(sizes > 0, np.searchsorted(bounds, sizes, side="right") - 1 - role, -1)
    return pair, np.where(pair >= 0, parts_of(bounds[np.maximum(pair, 0)]), 0)


def most_different(sizes: np.ndarray, role: int) -> np.ndarray:
    """Features in which a set of this size and role can differ from a similar one at most: a seventh of both sizes."""
    bounds = band_bounds(int(sizes.max(initial=1)))
    pair = np.maximum(np.searchsorted(bounds, sizes, side="right") - 1 - role, 0)
    partner = np.minimum(4 * sizes // 3, bounds[pair + 2] - 1) if role == 0 else bounds[pair + 1] - 1
    return (sizes + partner) // 7


def signatures(flat: np.ndarray, first: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the set and signature, for all that are not empty, in the order of the sets; and how many each set has."""
    sizes = np.diff(first)
    pair, parts = pair_of_bands(sizes, role)
    which = np.repeat(np.arange(len(sizes)), sizes)
    on = parts[which] > 0
    which, elements = which[on], flat[on]
    if not len(which):
        return _NONE, _NONE.view(np.uint64), np.zeros(len(sizes), np.int64)
    cells = np.r_[0, np.cumsum(3 * parts)]
    cell = (((elements >> np.uint64(32)) * (3 * parts)[which].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + cells[which]
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sums, has = np.zeros(cells[-1], np.uint64), np.zeros(cells[-1], np.int8)
    sums[cell[begin]] = np.add.reduceat(mixed(elements ^ _MIX[4]), begin)
    has[cell[begin]] = 1
    sums, has = sums.reshape(-1, 3), has.reshape(-1, 3)
    there = (has.sum(1, keepdims=True) - has > 0).ravel()
    owner = np.repeat(np.arange(len(sizes)), 3 * parts)[there]
    place = (np.arange(len(there)) - np.repeat(cells[:-1], 3 * parts)).astype(np.uint64)[there]
    sums = (sums.sum(1, keepdims=True) - sums).ravel()[there]
    return owner, mixed(sums + place * _MIX[0] + pair[owner].astype(np.uint64) * _MIX[2]), np.bincount(owner, minlength=len(sizes))


SETS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(x, T.LongType()) for x in ("n", "k", "parts", "empty", "spare0", "spare1"))])


def _describe(docs: DataFrame) -> DataFrame:
    """Per document: size and key of its set; parts and empty signatures in the lower band; and for each role the signatures that are
    not empty and that the least similar partner must share."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, first = shingle_sets(texts_of(batch.column("text")))
            n = np.diff(first)
            columns, spare = [n, class_keys(flat, first)], []
            for role in (0, 1):
                parts = pair_of_bands(n, role)[1]
                empty = 3 * parts - signatures(flat, first, role)[2]
                columns += [parts, empty] if role == 0 else []
                spare.append(np.where(parts > 0, shared_at_least(parts, most_different(n, role)) - empty, 1 << 30))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns + spare)], names=SETS.names)

        return one

    return map_rows(docs, make, SETS, "text")


DEALT = T.StructType([T.StructField("bucket", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("keys", "counts", "values", "more"))])
PAIRS = T.StructType([*(T.StructField(n, T.LongType()) for n in ("a", "b", "n")), T.StructField("frequent", T.BinaryType())])
_PAIRS = to_arrow_schema(PAIRS)


def _packed(buckets: int, key: np.ndarray, value: np.ndarray, more: np.ndarray | None = None) -> Iterator[tuple]:
    """Entries (key, value) by bucket of the value's upper half; only the lower half is stored. Neighbours whose keys differ in the lowest
    bit at most, the even one first, share a record: the key without that bit, a byte with the count for each bit, and one `more`.
    So what a set costs in a bucket besides its values, which weighs more the more buckets there are, is 10 bytes."""
    bucket = ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, key, value = bucket[order], key[order], value[order].astype(np.uint32)
    if not len(bucket):
        return
    run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
    counts = np.diff(np.r_[run, len(key)])
    if counts.max() > 255:
        n = -(-counts // 255)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        run, counts = np.repeat(run, n) + 255 * part, np.minimum(np.repeat(counts, n) - 255 * part, 255)
    base, bit = key[run] >> 1, key[run] & 1
    new = np.r_[True, (base[1:] != base[:-1]) | (bit[1:] <= bit[:-1]) | (bucket[run[1:]] != bucket[run[:-1]])]
    both = np.zeros((np.count_nonzero(new), 2), np.uint8)
    both[np.cumsum(new) - 1, bit] = counts
    base, first = base[new], run[new]
    more = more[order[first]] if more is not None else None
    edges = np.flatnonzero(np.r_[True, bucket[first[1:]] != bucket[first[:-1]]])
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(first)]):
        end = first[b] if b < len(first) else len(value)
        yield int(bucket[first[a]]), base[a:b].tobytes(), both[a:b].tobytes(), value[first[a] : end].tobytes(), more[a:b].tobytes() if more is not None else b""


def _frequent_here(values: np.ndarray) -> np.ndarray:
    """Which entries have a value that more than FREQUENT entries have; a table of counts leaves few to sort."""
    cells = 1 << max(10, int(len(values)).bit_length())
    at = (values >> np.uint64(7)).astype(np.int64) & (cells - 1)
    many = np.flatnonzero((np.bincount(at, minlength=cells) > FREQUENT)[at])
    out = np.zeros(len(values), bool)
    if len(many):
        _, where, counts = np.unique(values[many], return_inverse=True, return_counts=True)
        out[many] = counts[where] > FREQUENT
    return out


def _deal_texts(rows: DataFrame, make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], Iterator[tuple]]) -> DataFrame:
    """Rows of DEALT that `make` gives for slices of `rows` (text, ...) with their sets."""
    arrow = to_arrow_schema(DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                out = list(make(part, *shingle_sets(texts_of(part.column("text")))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, DEALT)


def _deal_signatures(rows: DataFrame, buckets: int) -> DataFrame:
    """All signatures by bucket, under doubled keys whose lowest bit is the role. One that is frequent within a slice goes on
    as a mark (key 0) alone, and its members to a bucket of their key (negative) with the whole of what names it."""

    def make(part: pa.RecordBatch, flat: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        keys = class_keys(flat, first)
        once = np.zeros(len(keys), bool)
        once[np.unique(keys, return_index=True)[1]] = True
        once &= keys > 0
        place, sig = [], []
        for role in (0, 1):
            who, s, _ = signatures(flat, first, role)
            on = once[who]
            place.append(2 * who[on] + role), sig.append(s[on])
        place, sig = np.concatenate(place), np.concatenate(sig)
        order = np.argsort(place, kind="stable")  # both roles of a set side by side
        place, sig = place[order], sig[order]
        key = 2 * keys[place >> 1] + (place & 1)
        hot = _frequent_here(sig)
        if hot.any():
            k, s = key[hot], sig[hot]
            names = (((s >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))
            home = -1 - (k % buckets)
            order = np.lexsort((k, home))
            home, k, names = home[order], k[order], names[order]
            edges = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True])
            for a, b in zip(edges, edges[1:]):
                begin = np.flatnonzero(np.r_[True, k[a + 1 : b] != k[a : b - 1]])
                yield int(home[a]), k[a:b][begin].tobytes(), np.diff(np.r_[begin, b - a]).astype(np.uint32).tobytes(), b"", names[a:b].tobytes()
            marks = np.unique(s)
            key, sig = np.r_[key[~hot], np.zeros(len(marks), np.int64)], np.r_[sig[~hot], marks]
        yield from _packed(buckets, key, sig)

    return _deal_texts(rows, make)


def _deal_features(rows: DataFrame, buckets: int) -> DataFrame:
    """All features of texts (k, text), each key once, by bucket. Of those that are frequent within a slice only marks go on, and how many each set has (negative bucket)."""

    def make(part: pa.RecordBatch, flat: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        key = np.repeat(part.column("k").to_numpy(zero_copy_only=False), np.diff(first))
        hot = _frequent_here(flat)
        if hot.any():
            k, c = np.unique(key[hot], return_counts=True)
            yield -1 - int(k[0] % buckets), k.tobytes(), c.astype(np.uint32).tobytes(), b"", b""
            marks = np.unique(flat[hot])
            key, flat = np.r_[key[~hot], np.zeros(len(marks), np.int64)], np.r_[flat[~hot], marks]
        yield from _packed(buckets, key, mixed(flat))

    return _deal_texts(rows, make)


def _entries(table: pa.Table, more: type | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Key, value and further field of all entries of a bucket whose value occurs more than once."""
    of = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    counts, value = of("counts", np.uint8), of("values", np.uint32)
    at = np.arange(len(value))
    for shift in (0, 10):  # alone in a cell of a table: alone
        bits = min(32 - shift, max(10, int(len(at)).bit_length() + 1))
        cell = (value[at] >> np.uint32(shift)) & np.uint32((1 << bits) - 1)
        at = at[np.bincount(cell, minlength=1 << bits)[cell] > 1]
    owner = np.searchsorted(np.cumsum(counts, dtype=np.int64), at, side="right")
    return 2 * of("keys", np.int64)[owner >> 1] + (owner & 1), value[at], of("more", more)[owner >> 1] if more else None


def _runs(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries by value and key, each once: key, value, their order, and where each value begins (and the end)."""
    order = np.lexsort((key, value))
    key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = (value[1:] != value[:-1]) | (key[1:] != key[:-1])
    key, value = key[new], value[new]
    return key, value, order[new], np.flatnonzero(np.r_[True, value[1:] != value[:-1], True]) if len(value) else np.zeros(1, np.int64)


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unordered pairs of different keys, with how often each occurs."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else _NONE
    return a[first], b[first], np.diff(np.r_[first, len(a)])


def _together(key: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs within runs of at most FREQUENT keys; and which keys lie in longer or marked ones."""
    sizes = np.diff(edges)
    hot = (sizes > FREQUENT) | (key[edges[:-1]] == 0) if len(key) else np.empty(0, bool)
    a, b = [_NONE], [_NONE]
    for m in range(2, FREQUENT + 1):
        begin = edges[:-1][(sizes == m) & ~hot]
        if len(begin):
            members = key[begin[:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            a.append(members[:, i].ravel()), b.append(members[:, j].ravel())
    return np.concatenate(a), np.concatenate(b), np.repeat(hot, sizes)


def _as_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray, frequent: list | None = None) -> pa.Table:
    return pa.table([*(pa.array(c, pa.int64()) for c in (a, b, n)), pa.array(frequent if frequent is not None else [None] * len(a), pa.binary())], schema=_PAIRS)


def _meet_signatures(table: pa.Table) -> pa.Table:
    """Pairs of classes with the rare signatures that they share here; and (b = -1) for each doubled key its frequent ones."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        of = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        key, name = np.repeat(of("keys", np.int64), of("counts", np.uint32)), of("more", np.uint64)
        order = np.argsort(key, kind="stable")
        pairs, key, name = (_NONE,) * 3, key[order], name[order]
    else:
        key, value, _, edges = _runs(*_entries(table)[:2])
        a, b, hot = _together(key, edges)
        on = (a & 1 == 0) | (b & 1 == 0)
        pairs = _counted(a[on] >> 1, b[on] >> 1)
        key, name = key[hot], value[hot].astype(np.uint64) | np.uint64(bucket << 32)
        order = np.argsort(key, kind="stable")
        key, name = key[order], name[order]
        name, key = name[key > 0], key[key > 0]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else _NONE
    lists = [name[a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(key)])]
    columns = (np.r_[x, y] for x, y in zip(pairs, (key[first], np.full(len(first), -1), np.zeros(len(first), np.int64))))
    return _as_pairs(*columns, [None] * len(pairs[0]) + lists)


def _meet_features(table: pa.Table) -> pa.Table:
    """Pairs with the rare features that they share here; and (b = -1) how many frequent ones a set has."""
    if table.column("bucket")[0].as_py() < 0:
        of = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        k, where = np.unique(of("keys", np.int64), return_inverse=True)
        return _as_pairs(k, np.full(len(k), -1), np.bincount(where, of("counts", np.uint32)).astype(np.int64))
    key, _, _, edges = _runs(*_entries(table)[:2])
    a, b, hot = _together(key, edges)
    k, c = np.unique(key[hot], return_counts=True)
    k, c = k[k > 0], c[k > 0]
    return _as_pairs(*(np.r_[x, y] for x, y in zip(_counted(a, b), (k, np.full(len(k), -1), c))))


#: What core sets carry into a bucket: size, frequent features, component.
CORE = np.dtype([("n", np.uint32), ("h", np.uint32), ("c", np.int64)])


def _deal_core(rows: DataFrame, buckets: int) -> DataFrame:
    """Signatures of core sets (k, text, n, h, thin, component) by bucket. A thin set, whose links may share no signature with
    features in it, gives all its features as well: two such sets that are linked share one of these."""

    def make(part: pa.RecordBatch, flat: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        of = lambda name: part.column(name).to_numpy(zero_copy_only=False)
        facts = np.empty(part.num_rows, CORE)
        facts["n"], facts["h"], facts["c"] = of("n"), of("h"), of("component")
        key, sig, more = [], [], []
        for role in (0, 1):
            who, s, _ = signatures(flat, first, role)
            key.append(2 * of("k")[who] + role), sig.append(s), more.append(facts[who])
        which = np.repeat(np.arange(part.num_rows), np.diff(first))
        thin = np.array(part.column("thin").to_pylist(), bool)[which]
        key.append(2 * of("k")[which[thin]]), sig.append(mixed(flat[thin] ^ _MIX[3])), more.append(facts[which[thin]])
        key, sig, more = map(np.concatenate, (key, sig, more))
        order = np.argsort(key, kind="stable")
        yield from _packed(buckets, key[order], sig[order], more[order])

    return _deal_texts(rows, make)


def _possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether frequent features alone suffice for a link between core sets, which are in different components."""
    n, m, h = x["n"].astype(np.int64), y["n"].astype(np.int64), np.minimum(x["h"], y["h"]).astype(np.int64)
    return (7 * h >= 3 * (n + m)) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (x["c"] != y["c"])


def _stars(turn: int):
    """Of each signature, every core set with one of role 0: first that with the fewest features of its own, then others by a hash."""

    def stars(table: pa.Table) -> pa.Table:
        key, value, facts = _entries(table, CORE)
        key, _, order, edges = _runs(key, value)
        if not len(key):
            return _as_pairs(key, key, key)
        facts = facts[order]
        rank = mixed((key >> 1).astype(np.uint64) ^ np.uint64(turn)) >> np.uint64(44)
        if turn == 0:
            rank += (facts["n"] - facts["h"]).astype(np.uint64) << np.uint64(20)
        rank[key & 1 == 1] = np.iinfo(np.uint64).max
        run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        centre = np.lexsort((rank, run))[edges[:-1]][run]
        on = (key[centre] & 1 == 0) & (facts["c"][centre] != facts["c"])
        a, b, n = _counted(key[on] >> 1, key[centre][on] >> 1)
        return _as_pairs(a, b, n)

    return stars


def _apart(table: pa.Table) -> pa.Table:
    """Of each signature, core sets outside its largest component (a), with the other components (b) in which frequent features alone allow a link."""
    key, value, facts = _entries(table, CORE)
    key, _, order, edges = _runs(key, value)
    facts = facts[order] if len(key) else facts
    found = {}
    for begin, end in zip(edges, edges[1:]):
        k, x = key[begin:end], facts[begin:end]
        c, size = np.unique(x["c"], return_inverse=True, return_counts=True)[1:]
        if len(size) > 1:
            for i in np.flatnonzero(c != size.argmax()).tolist():
                other = _possible(x[i], x) & ((k & 1 == 0) | (k[i] & 1 == 0))
                found.update(dict.fromkeys((int(k[i] >> 1), v) for v in np.unique(x["c"][other]).tolist()))
    a, b = np.array(list(found), np.int64).reshape(-1, 2).T
    return _as_pairs(a, b, np.ones(len(a), np.int64))


def _searched(apart: DataFrame, core: DataFrame) -> DataFrame:
    """For core sets and components (a, b): one link (a, b: keys) with a member of each block of the component that has any.

    Sets and members are dealt out in blocks, each of which meets each of the other side, so no task holds a whole component.
    """
    members = core.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    plan = apart.groupBy(F.col("b").alias("component")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")).join(members, "component")
    plan = stored(plan, "blocks")
    deal = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    facts = ("k", "n", "h", "text")
    asking = apart.select(F.col("a").alias("k"), F.col("b").alias("component")).join(plan, "component").join(core.select(*facts), "k")
    asking = asking.select("component", deal("k", "chunks").alias("chunk"), every("blocks").alias("block"), F.lit(True).alias("asks"), *facts)
    asked = core.join(plan, "component").select("component", every("chunks").alias("chunk"), deal("k", "blocks").alias("block"), F.lit(False).alias("asks"), *facts)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        k, n, h = (table.column(c).to_numpy() for c in ("k", "n", "h"))
        here = [table.filter(pa.array(on)).column("text") for on in (asks, ~asks)]
        (left, of_left), (right, of_right) = (shingle_sets([t.encode() for t in c.to_pylist()]) for c in here)
        a, b = [], []
        if len(here[0]) and len(here[1]):
            names, place = np.unique(right, return_inverse=True)
            mark = np.zeros(len(names) + 1, np.int64)
            m, hm, km = n[~asks], h[~asks], k[~asks]
            for i, (x, size, common) in enumerate(zip(k[asks].tolist(), n[asks].tolist(), h[asks].tolist())):
                most = np.minimum(hm, common)
                if not ((7 * most >= 3 * (m + size)) & (km != x)).any():
                    continue
                own = left[of_left[i] : of_left[i + 1]]
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                at = at[names[at] == own]
                mark[at] = 1
                both = np.add.reduceat(mark[place], of_right[:-1])
                mark[at] = 0
                linked = np.flatnonzero((100 * both >= 75 * (m + size - both)) & (km != x))
                if len(linked):
                    a.append(x), b.append(int(km[linked[0]]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=schema.names)

    return asking.union(asked).groupBy("component", "chunk", "block").applyInArrow(search, schema).distinct()


def _similar(pairs: DataFrame, texts: DataFrame, sizes: tuple[int, int] = (75, 100)) -> DataFrame:
    """Those pairs (a, b: keys) whose shingle sets reach the similarity."""
    t = texts.select("k", "text")
    rows = pairs.select("a", "b").join(t.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b").join(t.select(F.col("k").alias("a"), "text"), "a")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends, at = [], []
            for keys, column in (("a", "text"), ("b", "text_b")):
                k, first, where = np.unique(batch.column(keys).to_numpy(), return_index=True, return_inverse=True)
                column = batch.column(column).take(pa.array(first))
                ends.append(shingle_sets(texts_of(column))), at.append(where)
            (left, of_left), (right, of_right) = ends
            on = []
            for i, j in zip(*(w.tolist() for w in at)):
                x, y = left[of_left[i] : of_left[i + 1]], right[of_right[j] : of_right[j + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                on.append(sizes[1] * common >= sizes[0] * (len(x) + len(y) - common))
            return batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

        return one

    return map_rows(rows.select("a", "b", "text", "text_b"), make, schema, "text")


def _own_texts(rows: DataFrame) -> DataFrame:
    """Rows whose text has the set that `k` names: an id that occurs with several texts brings all of them."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = class_keys(*shingle_sets(texts_of(batch.column("text"))))
            return batch.filter(pa.array(keys == batch.column("k").to_numpy(zero_copy_only=False), pa.bool_()))

        return one

    return map_rows(rows, make, rows.schema, "text")


def _buckets(entries: int) -> int:
    return max(8, int(entries) // BUCKET)


def _frequent_signatures(met: DataFrame) -> DataFrame:
    """Per class, how many frequent signatures it has in each role; copies in several tasks count once."""
    lists = met.where("b = -1").groupBy("a").agg(F.collect_list("frequent").alias("frequent"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(np.unique(np.frombuffer(b"".join(x), np.uint64))) for x in batch.column("frequent").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(n, pa.int64())], names=schema.names)

    of_role = lambda r: F.sum(F.when(F.col("a").bitwiseAND(1) == r, F.col("n"))).alias(f"hot{r}")
    return lists.mapInArrow(run, schema).groupBy(F.shiftright("a", 1).alias("k")).agg(of_role(0), of_role(1))


def _enough(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose sizes allow the similarity and that share as many rare signatures as the smaller set must with so similar a set."""
    side = lambda x: known.select(F.col("k").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "parts", "empty", "hot0")))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    different = F.floor((F.col("n_a") + F.col("n_b")) / 7)
    need = lambda x: F.greatest(3 * F.col(f"parts_{x}") - 2 * different, 2 * F.col(f"parts_{x}") - different) - F.col(f"empty_{x}") - F.col(f"hot0_{x}")
    small = F.when(F.col("n_a") <= F.col("n_b"), need("a")).otherwise(need("b"))
    return rows.where((F.col("n") >= small) & (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))).select("a", "b")


def _by_features(texts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates among open sets that share a rare feature; and the core sets (k, rep, text, n, h)."""
    features = known.where("open").agg(F.sum("n")).first()[0] or 0
    dealt = _deal_features(texts.where("open").select("k", "text"), _buckets(features))
    met = stored(dealt.groupBy("bucket").applyInArrow(_meet_features, PAIRS), "features")
    h = met.where("b = -1").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("h"))
    of_open = stored(known.where("open").select("k", "n", F.expr("spare0 <= 0 OR spare1 <= 0").alias("thin")).join(h, "k", "left").withColumn("h", F.coalesce("h", F.lit(0))), "open")
    side = lambda x: of_open.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("h").alias(f"h_{x}"))
    rare = met.where("b >= 0").groupBy("a", "b").agg(F.sum("n").alias("r")).join(side("a"), "a").join(side("b"), "b")
    fits = (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")) & (7 * (F.col("r") + F.least("h_a", "h_b")) >= 3 * (F.col("n_a") + F.col("n_b")))
    core = texts.select("k", "rep", "text").join(of_open.where("4 * h >= 3 * n"), "k")
    return rare.where(fits).select("a", "b"), core


def ngram_jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id linked with it, directly or through others).

    Two documents are linked when 100 * (shared distinct 5-word shingles) >= 75 * (all of both); a text of fewer words is one
    shingle; without words or with a null text a document has none and is linked with nothing. Equal sets share a
    class and are compared once, by a 62-bit key. Repeated rows of a document get equal results; a null id is linked
    with nothing and has a null component; an empty table gives an empty result; other columns are not
    looked at. Ids are integers. Texts of any length are taken whole.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    described = stored(_describe(source), "sets")
    classes = stored(described.where("k <> 0 AND doc_id IS NOT NULL").groupBy("k").agg(
        F.min("doc_id").alias("rep"), *(F.max(c).alias(c) for c in ("n", "parts", "empty", "spare0", "spare1"))), "classes")
    features = classes.agg(F.sum("n")).first()[0] or 0
    dealt = _deal_signatures(source.where("doc_id IS NOT NULL").select("text"), _buckets(features))
    met = stored(dealt.groupBy("bucket").applyInArrow(_meet_signatures, PAIRS), "met")
    known = classes.join(_frequent_signatures(met), "k", "left").withColumns({f"hot{r}": F.coalesce(F.col(f"hot{r}"), F.lit(0)) for r in (0, 1)})
    known = stored(known.withColumn("open", F.expr("spare0 <= hot0 OR spare1 <= hot1")), "known")
    rare = stored(_enough(met.where("b >= 0").groupBy("a", "b").agg(F.sum("n").alias("n")), known), "pairs")

    wanted = rare.select(F.col("a").alias("k")).union(rare.select(F.col("b").alias("k"))).union(known.where("open").select("k")).distinct()
    wanted = stored(wanted.join(known.select("k", "rep", "open"), "k"), "wanted")
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = stored(_own_texts(source.join(ids, source.doc_id == ids.rep).select("k", "rep", "open", "text")).dropDuplicates(["k"]), "texts")
    by_features, core = _by_features(texts, known)
    core = stored(core, "core")
    first = stored(rare.union(by_features).distinct(), "pairs")

    nodes = classes.select("k", "rep")
    links: list[DataFrame] = []

    def try_pairs(pairs: DataFrame) -> int:
        links.append(stored(_similar(pairs, texts), "links"))
        return links[-1].count()

    def component() -> DataFrame:
        edges = reduce(DataFrame.union, links)
        of = lambda x, end: nodes.select(F.col("k").alias(x), F.col("rep").alias(end))
        return stored(components(edges.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v")), "components")

    def placed(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        c = placed(texts.select("k", "rep"), found)
        rows = pairs.join(c.select(F.col("k").alias("a"), F.col("component").alias("ca")), "a").join(c.select(F.col("k").alias("b"), F.col("component").alias("cb")), "b")
        return rows.where("ca <> cb").select("a", "b")

    # Core sets with central ones and every other set with its first partner; then all pairs that are still apart.
    one = first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    members, buckets = (x or 0 for x in core.agg(F.count("*"), F.sum("n")).first())
    buckets = _buckets(buckets)

    def meeting(how, found: DataFrame | None) -> DataFrame:
        rows = placed(core, found) if found is not None else core.withColumn("component", F.col("rep"))
        return _deal_core(rows, buckets).groupBy("bucket").applyInArrow(how, PAIRS).select("a", "b").distinct()

    if members:
        one = one.union(meeting(_stars(0), None)).distinct()
    try_pairs(one)
    found = component()
    rest = apart(first, found)
    if members:
        rest = rest.union(meeting(_stars(1), found)).distinct()
    if try_pairs(rest):
        found = component()
    for turn in range(2, TURNS):
        if members and try_pairs(meeting(_stars(turn), found)):
            found = component()
    if members:
        links.append(stored(_searched(stored(meeting(_apart, found), "apart"), placed(core, found)), "links"))
        found = component()
    of_class = placed(nodes, found).select("k", F.col("component").alias("component_id"))
    placed_rows = described.where("k <> 0 AND doc_id IS NOT NULL").join(of_class, "k").select("doc_id", "n", "component_id")
    alone = described.where("k = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return placed_rows.union(alone).withColumnRenamed("n", "n_shingles")
