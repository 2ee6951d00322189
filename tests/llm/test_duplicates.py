"""N-gram join, substring dedup and embedding near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from cellwise.llm import ngram_join, substring
from cellwise.llm.cap_filters import embedding_near_dedup
from cellwise.llm.ngram_join import band_bounds, most_different, ngram_jaccard_join, parts_of, shared_at_least, shingle_sets, signatures
from cellwise.llm.substring import WINDOW, chosen_phrases, compile_shard, occurrences, substring_dedup, symbols, window_hashes
from cellwise.llm.word_hashes import word_hashes

SPACE = "[^\x20\x09-\x0d]+"


def words_of(text):
    return re.findall(SPACE, text or "")


def groups(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_join(rows):
    sets = {}
    for i, t in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in groups(sets, links).items()}


def noisy(r, words, rate):
    return [("x%d" % r.randrange(10**6)) if r.random() < rate else w for w in words]


def corpus(seed=4):
    """Sizes of all bands; groups of near copies at and around the threshold; one passage that many texts share; one large group."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(5000)
    texts = [None, "", " \n", "one", "One", "one two three", "ONE two three", "É x", "é x"]
    for n in [*range(4, 40), 60, 90, 140, 300, 700]:
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join(base).upper().replace("W", "W"), " ".join(noisy(r, base, 1.5 / n)), " ".join(noisy(r, base, 0.02)), " ".join(base[: n - n // 5]), " ".join(base[n // 8 :] + [word()])]
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(r.randrange(5, 120))]) for _ in range(70)]
    big = [word() for _ in range(120)]
    texts += [" ".join(noisy(r, big, 0.012)) for _ in range(60)]
    near = [word() for _ in range(80)]
    for k in range(40):
        near = near[:]
        near[r.randrange(80)] = word()
        texts.append(" ".join(near))
    r.shuffle(texts)
    return list(enumerate(texts, 3))


def test_join_equals_brute_force(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, k int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(d).collect()}
    assert got == brute_join(rows)


def test_join_with_small_limits_takes_every_pass(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 1)
    rows = corpus(9)[:330]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(d).collect()} == brute_join(rows)


def test_join_on_odd_rows(spark):
    d = spark.createDataFrame([(5, "a b"), (5, "a b"), (2, "a b"), (None, "a b"), (None, None), (7, None), (8, "")], "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_jaccard_join(d).collect())
    assert got == Counter({(5, 1, 2): 2, (2, 1, 2): 1, (None, 1, None): 1, (None, 0, None): 1, (7, 0, 7): 1, (8, 0, 8): 1})
    assert ngram_jaccard_join(d.limit(0)).count() == 0


def test_similar_sets_share_as_many_signatures_as_promised():
    r = np.random.default_rng(0)
    bounds = band_bounds(5000)
    assert all(4 * (b - 1) // 3 < c for b, c in zip(bounds[1:], bounds[2:]))
    for n in (1, 2, 3, 4, 5, 7, 11, 30, 77, 240, 900):
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            drop = r.integers(0, n // 4 + 1)
            b = np.unique(np.r_[a[drop:], r.integers(0, 2**63, int(r.integers(0, n // 4 + 1)), dtype=np.uint64)])
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < 75 * (len(a) + len(b) - common):
                continue
            if len(a) > len(b):
                a, b = b, a
            band = lambda s: int(np.searchsorted(bounds, len(s), side="right"))
            role = band(b) - band(a)
            assert role in (0, 1)
            low = int(bounds[band(a) - 1])
            _, x, filled = signatures(a, np.array([0, len(a)]), 0)
            _, y, _ = signatures(b, np.array([0, len(b)]), role)
            parts = int(parts_of(np.int64(low)))
            empty = 3 * parts - filled[0]
            need = shared_at_least(np.array(parts), np.array((len(a) + len(b)) // 7)) - empty
            assert len(np.intersect1d(x, y)) >= need >= shared_at_least(np.array(parts), most_different(np.array([len(a)]), 0)[0]) - empty
    assert (parts_of(bounds) > 0).all()


def test_shingles():
    flat, first = shingle_sets([b"A b c d e f", "a B c d e f\ta b c d e".encode()])
    a, b = flat[: first[1]], flat[first[1] :]
    assert len(a) == 2 and len(b) == 6 and len(np.intersect1d(a, b)) == 2


def brute_substrings(rows):
    split = {i: words_of(t) for i, t in rows}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - WINDOW + 1):
            first.setdefault(tuple(split[i][k : k + WINDOW]), i)
    out = {}
    for i, w in split.items():
        gone = {j for k in range(len(w) - WINDOW + 1) if first[tuple(w[k : k + WINDOW])] < i for j in range(k, k + WINDOW)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def passages(seed=1):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(60))
    parts = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 120, 200)]
    rows = [(0, None), (1, ""), (2, "a " * 300), (3, "a " * 120), (4, " ".join(parts[5])), (5, "\n".join(parts[5] * 2))]
    for i in range(6, 60):
        text = []
        for _ in range(r.randrange(1, 5)):
            text += [word() for _ in range(r.randrange(0, 60))]
            p = r.choice(parts)
            a = r.randrange(0, len(p))
            text += p if r.random() < 0.5 else p[a : a + r.randrange(30, 90)]
        rows.append((i * 7 % 61 + 100, r.choice((" ", "\t", " \n")).join(text)))
    return rows


def test_substrings_equal_brute_force(spark):
    rows = passages()
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, starts string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(d).collect()}
    assert got == brute_substrings(rows) and any(r for _, r, _ in got.values())


def test_substrings_on_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(70))
    d = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text), (3, "short")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup(d).collect())
    assert got == Counter({(4, 0): 2, (None, 0): 1, (9, 70): 1, (3, 0): 1})
    assert substring_dedup(d.limit(0)).count() == 0
    for name in ("n_words", "_doc", "_starts"):
        with pytest.raises(ValueError):
            substring_dedup(d.withColumnRenamed("text", name), text_column=name)


def test_every_window_holds_a_chosen_phrase():
    h = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    signs = symbols(h)
    phrases = lambda a, b: {signs[a + k : a + k + 8].tobytes() for k in chosen_phrases(signs[a:b], np.array([0, b - a])).tolist()}
    whole = phrases(0, 400)
    for k in range(400 - WINDOW + 1):
        part = phrases(k, k + WINDOW)
        assert len(part) == 1 and part <= whole
    cut = chosen_phrases(signs, np.array([0, 30, 30, 90, 400]))
    apart = [a + chosen_phrases(signs[a:b], np.array([0, b - a])) for a, b in ((0, 30), (30, 90), (90, 400))]
    assert cut.tolist() == np.concatenate(apart).tolist()
    a, b = window_hashes(h, np.arange(351)), window_hashes(h[17:], np.arange(300))
    assert (a[0][17:317] == b[0]).all() and (a[1][17:317] == b[1]).all()


def test_the_automaton_alone_finds_phrases(monkeypatch, spark):
    r = np.random.default_rng(5)
    h = r.integers(0, 3, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    signs = symbols(h)
    wanted = {signs[k : k + 8].tobytes() for k in range(0, 3000, 100)}
    assert occurrences(compile_shard(wanted), signs).tolist() == [k for k in range(2993) if signs[k : k + 8].tobytes() in wanted]
    assert compile_shard(set()) is None
    run = " ".join(f"t{i}" for i in range(60))
    docs = pa.record_batch([pa.array([1, 2]), pa.array([run, "x " + run]), pa.array([[], []], pa.list_(pa.binary()))], names=["doc_id", "text", "phrases"])

    class Rows:  # without confirmed phrases no window goes on, whatever the texts share
        def mapInArrow(self, run, schema):
            return list(run(iter([docs])))

    assert substring._windows(Rows(), 8) == []


def test_substrings_in_very_long_texts(spark):
    r = random.Random(8)
    run = [f"r{i}" for i in range(90)]
    long = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(run)), (2, " ".join(long[:200_000] + run + long[200_000:])), (3, "z" * 3_000_000 + " " + " ".join(run)), (4, "same line\n" * 60_000), (5, "same line\n" * 100)]
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (90, 0), 2: (300_090, 90), 3: (91, 90), 4: (120_000, 0), 5: (200, 200)}


def test_windows_go_on_once_in_runs_with_the_phrase_they_are_compared_by():
    text = " ".join(f"t{i * i % 997}" for i in range(400)).encode()
    signs = symbols(word_hashes([text])[0])
    g = substring.phrase_hashes(signs)
    p = int(chosen_phrases(signs, np.array([0, 400]))[7])
    docs = pa.record_batch([pa.array([5]), pa.array([text.decode()]), pa.array([[signs[p : p + 8].tobytes()]], pa.list_(pa.binary()))], names=["doc_id", "text", "phrases"])

    class Rows:
        def mapInArrow(self, run, schema):
            return list(run(iter([docs])))

    (out,) = substring._windows(Rows(), 8)
    docs_, counts, starts, one, two = (b"".join(out.column(c).to_pylist()) for c in ("docs", "counts", "starts", "hash1", "hash2"))
    got = [k for a, n in zip(np.frombuffer(starts, np.uint32).tolist(), np.frombuffer(counts, np.uint32).tolist()) for k in range(a, a + n)]
    assert got == [k for k in range(351) if g[k : k + 43].min() == g[p]] and 0 < len(got) < 43
    assert len(docs_) == 8 * len(counts) // 4 == 8 and len(one) + len(two) == 12 * len(got)


def test_substrings_shuffle_the_texts_once(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in passages(3)] + [(None, "a " * 60, "x")], "doc_id long, text string, phrases string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substring_dedup(d)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {**brute_substrings(passages(3)), None: (60, 0, " ".join("a" * 60))}
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_runs_of_an_id_stop_at_the_end_of_its_shorter_rows(spark):
    words = [f"t{i}" for i in range(200)]
    d = spark.createDataFrame([(i, " ".join(words[:n])) for i, n in ((1, 200), (9, 200), (9, 120), (9, 50), (9, 30))], "doc_id int, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(d).collect()) == [(1, 200, 0), (9, 30, 0), (9, 50, 50), (9, 120, 120), (9, 200, 200)]


def vectors(n=700, d=16, seed=2):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    for i in range(0, n - 1, 3):
        x[i + 1] = x[i] + r.uniform(0, 0.5) * r.standard_normal(d) * 0.3
    x[600:690] = x[0] + 0.02 * r.standard_normal((90, d))
    x[690:695] = x[5]
    return x.astype(np.float32)


def test_embeddings_equal_brute_force(spark):
    x = vectors()
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, []]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(None, x[0].tolist(), 0), (2000, x[0].tolist()[:3], 0), (2001, (2 * x[0][:3]).tolist(), 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, filters int").repartition(3)
    out = {r.vec_id: r for r in embedding_near_dedup(d).collect()}
    assert len(out) == len(rows)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    component = groups(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(linked)))])
    truth, found = linked.sum(1), np.array([out[i].n_links for i in range(len(x))])
    assert (found <= truth).all() and found.sum() >= 0.99 * truth.sum()
    assert sum(out[i].component_id == component[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all(out[i].kept == (out[i].component_id == i) for i in range(len(x)))
    assert all((out[1000 + i].n_links, out[1000 + i].component_id) == (0, 1000 + i) for i in range(len(odd)))
    assert out[None].n_links == 0 and out[None].component_id is None and not out[None].kept
    assert (out[2001].n_links, out[2001].component_id, out[2000].kept) == (1, 2000, True)


def test_equal_vectors_link_with_each_other(spark):
    d = spark.createDataFrame([(3, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (8, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in embedding_near_dedup(d).collect()) == Counter({(3, 2, 1, False): 1, (1, 2, 1, True): 2, (8, 0, 8, True): 1})
    assert embedding_near_dedup(d.limit(0)).count() == 0


def test_digest_of_kept_words_is_plain_utf8():
    assert hashlib.sha256(b" ".join("é ü".encode().split())).hexdigest() == hashlib.sha256("é ü".encode()).hexdigest()


def test_packed_entries_are_small_and_whole():
    random = np.random.default_rng(5)
    key = np.sort(np.r_[np.repeat(2 * random.integers(1, 1 << 61, 200), 150) + random.integers(0, 2, 30_000), np.zeros(700, np.int64), np.repeat(np.int64(2 * (1 << 61) + 1), 40_000)])
    value = random.integers(0, 1 << 63, len(key)).astype(np.uint64)
    value[::2] = value[1::2]  # each lower half occurs twice, so no entry is left out
    more = (key >> 1).astype(np.int32)
    bucket = (value >> np.uint64(32)) % np.uint64(40)
    rows = list(ngram_join._packed(40, key, value, more))
    assert sorted(r[0] for r in rows) == list(range(40)) and not list(ngram_join._packed(40, key[:0], value[:0]))
    for row in rows:
        table = pa.table([pa.array([c]) for c in row], names=ngram_join.DEALT.names)
        k, v, m = ngram_join._entries(table, np.int32)
        on = bucket == row[0]
        order, wanted = np.lexsort((v, k)), np.lexsort((value[on].astype(np.uint32), key[on]))
        assert (k[order] == key[on][wanted]).all() and (v[order] == value[on].astype(np.uint32)[wanted]).all() and (m == (k >> 1).astype(np.int32)).all()
    small = slice(700, 30_700)
    assert sum(len(x) for r in ngram_join._packed(40, key[small], value[small]) for x in r[1:]) <= 30_000 * 4 + 200 * 40 * 10
