"""Byte-level BPE, packing and token counts against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from cellwise.llm.bpe_tree import TreeBPE, encode_decode
from cellwise.llm.packing import binary_lengths, pack_documents
from cellwise.llm.token_counts import at_limits, length_histogram, length_quantiles, token_lengths
from cellwise.llm.word_tokens import Memory, WordEncoder

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
random.seed(3)
ALPHABET = " \n\t\r\x1c\x85\xa0ab¼²Ⅷ'sStréèä中文🎉́‍_-9٣%ª\x01"
ODD = ["", " ", "a" * 3000, " " * 2000, "ab" * 900, "thththth" * 200 + "x", "don't they'll\n\n  x", "<|endoftext|> a", "x\x01y \x01 z", *("".join(random.choice(ALPHABET) for _ in range(random.randrange(120))) for _ in range(400))]


def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def reference_words(text):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (0, None, 1)], "doc_id long, text string, start int")


def test_tree_bpe_equals_the_library():
    coder, enc = TreeBPE.from_file(RANKS, P.PATTERN), reference_bpe()
    for text, raw in zip(ODD, coder.encode(ODD)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == enc.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_joins_at_every_seam():
    coder = TreeBPE.from_file(RANKS, P.PATTERN)
    for word in ("internationalization", "aaaaaaaaaaaaaaaaab", "ÜberraschungenÄÖ", "thththththththtion"):
        data = word.encode()
        for cut in range(1, len(data)):
            assert coder.join(coder._direct(data[:cut]), coder._direct(data[cut:])) == coder._direct(data) == coder._long(data)


def test_encode_decode_rows(spark):
    enc = reference_bpe()
    out = encode_decode(frame(spark, ODD), RANKS, P.PATTERN).collect()
    assert len(out) == len(ODD) + 2
    wanted = Counter()
    for i, t in [*enumerate(ODD), (None, "a b"), (0, "")]:
        ids = enc.encode_ordinary(t)
        wanted[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in out) == wanted
    assert encode_decode(frame(spark, []).limit(0), RANKS, P.PATTERN).count() == 0


def test_word_encoder_equals_the_library():
    coder = WordEncoder(WORDS, remember=50)
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    for _ in range(2):
        for k in range(0, len(ODD), 40):
            got = coder.encode([x.encode() for x in ODD[k : k + 40]])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in ODD[k : k + 40]]


def test_memory_is_bounded():
    m = Memory(10)
    for k in range(100):
        m.fill(range(k, k + 5), lambda new: [x * 2 for x in new])
        assert len(m.young) + len(m.old) <= 2 * (10 + 5)
    assert m.fill([99], lambda new: [1 / 0 for _ in new])[99] == 198


def test_binary_lengths():
    assert binary_lengths(0, 8) == [] and binary_lengths(21, 8) == [8, 8, 4, 1] and binary_lengths(7, 8) == [4, 2, 1]


def test_packing(spark):
    texts = [*ODD[:60], "word " * 5000]
    out = pack_documents(frame(spark, texts), WORDS, longest=64, with_ids=True).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert len({r.sequence_id for r in out}) == len(out)
    for i, t in enumerate(texts):
        if i == 0:
            assert sorted((r.start, r.length) for r in by[0]) == [(0, 1), (0, 1)]  # an empty text and a null one
            continue
        pieces = sorted(by[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist()
        assert ids == reference_words(t) + [1] and all(r.doc_tokens == len(ids) for r in pieces)
    assert pack_documents(frame(spark, []).limit(0), WORDS).count() == 0


def test_token_counts(spark):
    lengths = [len(reference_words(t or "")) for t in [*ODD, "a b", None]]
    assert sorted(r.n_tokens for r in token_lengths(frame(spark, ODD), WORDS).collect()) == sorted(lengths)
    many = lengths + [5000, 5000, 1023, 1024, 1025, 2048]
    h = length_histogram(spark.createDataFrame([(x,) for x in [*many, None]], "n_tokens long")).cache()
    for r in h.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_from, r.tokens_from) == (many.count(n), sum(x >= n for x in many), sum(x for x in many if x >= n))
        assert r.truncated_tokens == sum(min(x, n) for x in many) and abs(r.share_to - sum(x <= n for x in many) / len(many)) < 1e-12
    for r in at_limits(h, [0, 7, 1024, 9999]).collect():
        limit = r.context_limit
        assert (r.docs_from, r.tokens, r.truncated_tokens) == (sum(x >= limit for x in many), sum(many), sum(min(x, limit) for x in many))
    got = {r.share: r.n_tokens for r in length_quantiles(h, [0.5, 1.0]).collect()}
    assert got == {0.5: sorted(many)[-(-len(many) // 2) - 1], 1.0: 5000}
    empty = length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert empty.count() == 0 and at_limits(empty, [3]).first().tokens == 0
