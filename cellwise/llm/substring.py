"""Substring dedup by repeated-phrase automata.

1. Confirm recurring passages: of every run of 50 words, the 8-word phrase with the smallest hash is its phrase
   (winnowing), so two documents that share 50 words share a phrase; phrases of one document only are dropped. A phrase
   travels as 32 symbols, four for each word, so long words cost no more than short ones.
2. Compile sharded automata: a shard is a slice of documents with the confirmed phrases that these hold, as an Aho-Corasick
   automaton; its size is bounded by the slice, not by the corpus. Documents without a confirmed phrase
   can't hold a repeated run, so no shard has anything for them.
3. Stream the slice's documents, as symbols, through the shard: it alone finds where phrases occur. Every occurrence gives the
   50-word windows whose phrase it is (equal windows have the same one), and of each window (by a 96-bit hash of its words) the
   smallest document is found. Windows travel by runs of neighbours, with a start and a length for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cellwise.llm.common import map_rows, slices, texts_of
from cellwise.llm.word_hashes import mixed, up_and_down, word_hashes
from cellwise.session import stored

WINDOW = 50
PHRASE = 8
#: Symbols of a word, and of a phrase.
SYMBOLS = 4
LENGTH = SYMBOLS * PHRASE
#: Windows of a bucket, about: what one reducing task holds at once.
BUCKET = 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_STEP = 1 << 17


def symbols(h: np.ndarray) -> np.ndarray:
    """Four symbols a word, of which the first tells that a word begins; equal words have equal ones."""
    five = [(h >> np.uint64(5 * i + 3)).astype(np.uint8) & np.uint8(31) for i in range(SYMBOLS)]
    return np.stack([five[0] + np.uint8(64), *(x + np.uint8(96) for x in five[1:])], 1)


def phrase_hashes(signs: np.ndarray) -> np.ndarray:
    """A hash for every phrase of a row of words (as symbols), by its first word."""
    words = signs.view(np.uint32).ravel().astype(np.uint64)
    n = len(words) - PHRASE + 1
    return mixed(sum((words[i : i + n] * _ODD[i] for i in range(1, PHRASE)), words[:n] * _ODD[0])) if n > 0 else words[:0]


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every run of `width` values."""
    n = len(x) - width + 1
    rows = np.full(-(-len(x) // width) * width, x[-1], x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    forward = best.accumulate(rows, 1).ravel()
    backward = best.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return best(backward[:n], forward[width - 1 : width - 1 + n])


def _in_one_text(of_text: np.ndarray) -> np.ndarray:
    """Whether a window begins and ends in one text, by its first word."""
    fits = np.zeros(of_text[-1] - WINDOW + 2, np.int64)
    long = np.diff(of_text) >= WINDOW
    fits[of_text[:-1][long]] += 1
    np.add.at(fits, of_text[1:][long] - WINDOW + 1, -1)
    return np.cumsum(fits[:-1]) > 0


def chosen_phrases(signs: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """First words of the phrases with the smallest hash of some window of one text."""
    w = WINDOW - PHRASE + 1
    if len(signs) < WINDOW:
        return np.empty(0, np.int64)
    g = phrase_hashes(signs)
    least = _sliding(g, w, np.minimum)
    least = np.where(_in_one_text(of_text), least, np.uint64(0))
    around = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    around[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(_sliding(around, w, np.maximum) == g)


def window_hashes(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows that begin at `starts` (ascending): differences of prefix sums, moved to the origin."""
    out = [np.empty(len(starts), np.uint64) for _ in _BASES]
    for a in range(0, len(h), _STEP):
        i, j = np.searchsorted(starts, (a, a + _STEP))
        if i == j:
            continue
        part, at = h[a : a + _STEP + WINDOW], starts[i:j] - a
        for base, words, to in zip(_BASES, (part, mixed(part ^ _ODD[5])), out):
            up, down = up_and_down(base, _STEP + WINDOW)
            sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
            to[i:j] = mixed((sums[at + WINDOW] - sums[at]) * down[at])
    return out[0], out[1]


PHRASES = T.StructType([T.StructField("bucket", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("docs", "known", "signs"))])
HELD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("phrases", T.BinaryType())])
DEALT = T.StructType([T.StructField("bucket", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("docs", "counts", "starts", "hash1", "hash2"))])
REPEATS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("runs", T.BinaryType())])


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else [0]
    for a, b in zip(edges, edges[1:]):
        yield int(bucket[a]), *(c[a:b].tobytes() for c in columns)


def _phrases(docs: DataFrame, buckets: int) -> DataFrame:
    """Chosen phrases by bucket of their hash. One that several documents of a slice hold is known to recur: it goes on once (for the
    smallest document, marked as known), and its holders go to a bucket of their document (negative)."""
    arrow = to_arrow_schema(PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                h, _, _, of_text, _ = word_hashes(texts_of(part.column("text")))
                signs = symbols(h)
                at = chosen_phrases(signs, of_text)
                if not len(at):
                    continue
                doc = ids[np.searchsorted(of_text, at, side="right") - 1]
                g = phrase_hashes(signs)[at]
                order = np.lexsort((doc, g))
                at, doc, g = at[order], doc[order], g[order]
                new = np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]
                at, doc, g = at[new], doc[new], g[new]
                first = np.r_[True, g[1:] != g[:-1]]
                known = np.repeat(np.diff(np.r_[np.flatnonzero(first), len(g)]) > 1, np.diff(np.r_[np.flatnonzero(first), len(g)]))
                texts = signs[at[:, None] + np.arange(PHRASE)].reshape(-1, LENGTH)
                out = [*_by_bucket(((g[first] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64), doc[first], known[first], texts[first])]
                out += _by_bucket(-1 - (doc[known] % buckets), doc[known], known[known], texts[known])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.mapInArrow(run, PHRASES)


def _recurring(table: pa.Table) -> pa.Table:
    """The phrases of a bucket that several documents hold, by document."""
    of = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    doc, known, signs = of("docs", np.int64), of("known", bool), of("signs", np.uint8).reshape(-1, LENGTH)
    if table.column("bucket")[0].as_py() >= 0:
        g = mixed((np.ascontiguousarray(signs).view(np.uint32).astype(np.uint64) * _ODD).sum(1, dtype=np.uint64))
        order = np.lexsort((doc, g))
        doc, known, signs, g = doc[order], known[order], signs[order], g[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        counts = np.diff(np.r_[first, len(g)])
        recurs = np.logical_or.reduceat(known, first) | (doc[first] < doc[first + counts - 1])
        on = np.repeat(recurs, counts) & ~known
        doc, signs = doc[on], signs[on]
    order = np.argsort(doc, kind="stable")
    doc, signs = doc[order], signs[order]
    edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else [0]
    return pa.table([pa.array(doc[edges[:-1]], pa.int64()), pa.array([signs[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], schema=to_arrow_schema(HELD))


def compile_shard(phrases: set[bytes]) -> ahocorasick.Automaton | None:
    """An automaton over phrases, as symbols."""
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(p.decode("latin-1"), 0)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def occurrences(automaton: ahocorasick.Automaton, signs: np.ndarray) -> np.ndarray:
    """First words of all phrases of the automaton in a row of words, in order."""
    last = np.fromiter((end for end, _ in automaton.iter(signs.tobytes().decode("latin-1"))), np.int64)
    return last // SYMBOLS - PHRASE + 1


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of neighbouring windows of a document begin in windows by document and start, and how many windows each has."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.empty(0, np.int64)
    return new, np.diff(np.r_[new, len(doc)]).astype(np.uint32)


def _windows(rows: DataFrame, buckets: int) -> DataFrame:
    """Windows whose smallest phrase is confirmed (doc_id, text, phrases), packed by bucket.

    Of equal windows in a slice, only those of the smallest document go on; the others are known to be repeats
    and go to a negative bucket without their hashes.
    """
    arrow = to_arrow_schema(DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                raw = [b"".join(x) for x in part.column("phrases").to_pylist()]
                automaton = compile_shard({x[i : i + LENGTH] for x in raw for i in range(0, len(x), LENGTH)})
                if automaton is None:
                    continue
                h, _, _, of_text, _ = word_hashes(texts_of(part.column("text")))
                if len(h) < WINDOW:
                    continue
                signs = symbols(h)
                g = phrase_hashes(signs)
                occurs = np.zeros(len(g), bool)
                for a, b in zip(of_text.tolist(), of_text[1:].tolist()):
                    if b - a >= WINDOW:
                        occurs[a + occurrences(automaton, signs[a:b])] = True
                least = _sliding(g, WINDOW - PHRASE + 1, np.minimum)
                confirmed = _sliding(np.where(occurs, g, ~np.uint64(0)), WINDOW - PHRASE + 1, np.minimum)
                start = np.flatnonzero((confirmed == least) & _in_one_text(of_text))
                if not len(start):
                    continue
                one, two = window_hashes(h, start)
                # Equal windows have the same smallest phrase, and neighbours mostly too, so a bucket gets runs of a document.
                place = (least[start] >> np.uint64(8)) % np.uint64(buckets)
                text = np.searchsorted(of_text, start, side="right") - 1
                doc, start = ids[text], start - of_text[text]
                order = np.lexsort((doc, two, one))
                doc, start, one, two, place = doc[order], start[order], one[order], two[order], place[order]
                first = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
                least = doc[first][np.cumsum(first) - 1]
                bucket = np.where(doc > least, -1 - (doc % buckets), place.astype(np.int64)).astype(np.int64)
                order = np.lexsort((start, doc, bucket))
                bucket, doc, start, one, two = bucket[order], doc[order], start[order].astype(np.uint32), one[order], (two[order] >> np.uint64(32)).astype(np.uint32)
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                out = []
                for a, b in zip(edges, edges[1:]):
                    new, counts = _runs(doc[a:b], start[a:b])
                    more = (one[a:b].tobytes(), two[a:b].tobytes()) if bucket[a] >= 0 else (b"", b"")
                    out.append((int(bucket[a]), doc[a:b][new].tobytes(), counts.tobytes(), start[a:b][new].tobytes(), *more))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, DEALT)


def _later(table: pa.Table) -> pa.Table:
    """Windows of a bucket that a smaller document has too: runs (start, number of windows) by document."""
    of = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    doc, counts, start = of("docs", np.int64), of("counts", np.uint32).astype(np.int64), of("starts", np.uint32)
    if table.column("bucket")[0].as_py() >= 0:
        start = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        doc, start = np.repeat(doc, counts), start.astype(np.uint32)
        one, two = of("hash1", np.uint64), of("hash2", np.uint32)
        order = np.lexsort((doc, two, one))
        doc, start, one, two = doc[order], start[order], one[order], two[order]
        first = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        later = doc > doc[first][np.cumsum(first) - 1]
        doc, start = doc[later], start[later]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new, counts = _runs(doc, start)
        doc, start = doc[new], start[new]
    else:
        order = np.argsort(doc, kind="stable")
        doc, start, counts = doc[order], start[order], counts[order]
    runs = np.stack([start, counts.astype(np.uint32)], 1)
    edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else [0]
    return pa.table([pa.array(doc[edges[:-1]], pa.int64()), pa.array([runs[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], schema=to_arrow_schema(REPEATS))


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """_doc and _starts (a list of packed pairs of uint32): runs of windows that a document with a smaller id has too, by first word and number."""
    key = F.col(id_column).cast("long")
    source = docs.select(key.alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    # A text has at most one window for every two of its bytes, and on these six; a line that repeats counts as often as it occurs.
    buckets = max(8, (source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6 // BUCKET)
    phrases = _phrases(source, buckets).groupBy("bucket").applyInArrow(_recurring, HELD)
    held = stored(phrases, "held").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("phrases").alias("_starts"))
    # All columns and no condition on the text, so that this shuffle of the documents is the one that `substring_dedup` joins with, too.
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (id_column.lower(), text_column.lower())]
    rest = [F.struct(*others).alias("rest")] if others else []
    rows = docs.where(key.isNotNull()).join(held, key == F.col("_doc"))
    dealt = _windows(rows.select(F.col("_doc").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col("_starts").alias("phrases"), *rest), buckets)
    found = dealt.groupBy("bucket").applyInArrow(_later, REPEATS)
    return found.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("runs").alias("_starts"))


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", prefix: str = "") -> DataFrame:
    """All columns of `docs`, n_words, n_removed and kept_text (kept words joined by one space).

    A word goes if a run of 50 words around it occurs in a document with a smaller id as well; runs are
    judged on the input. A null or empty text has no words and an empty kept_text. Rows of one id are one
    document and don't count as repeats of each other; a row with a null id keeps all words and makes no one
    lose any; an empty table gives an empty result; other columns pass through (`prefix` keeps the new names apart).
    """
    names = [prefix + n for n in ("n_words", "n_removed", "kept_text")]
    if clash := {*names, "_starts", "_doc"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; choose another prefix")
    key = F.col(id_column).cast("long")
    starts = repeated_windows(docs, id_column, text_column)
    rows = docs.where(key.isNotNull()).join(starts, key == F.col("_doc"), "left").drop("_doc")
    rows = rows.union(docs.where(key.isNull()).withColumn("_starts", F.lit(None).cast("array<binary>")))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.StringType())])
    old = to_arrow_schema(docs.schema)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, removed, kept = [], [], []
            for text, lists in zip(texts_of(batch.column(text_column)), batch.column("_starts").to_pylist()):
                words = text.split()
                n.append(len(words))
                if lists:
                    edges = np.zeros(len(words) + 1, np.int64)
                    at, count = np.frombuffer(b"".join(lists), np.uint32).astype(np.int64).reshape(-1, 2).T
                    end = np.minimum(at + count + WINDOW - 1, len(words))  # other rows of this id may be longer
                    fits = end - at >= WINDOW
                    np.add.at(edges, at[fits], 1)
                    np.add.at(edges, end[fits], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            columns = [batch.column(f.name).cast(f.type) for f in old]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

        return one

    return map_rows(rows, make, schema, text_column)
