"""WARC archives and HTML extraction."""

import hashlib
import io
import random
import zlib

import pytest

from cellwise.llm.dom import parse
from cellwise.llm.html_content import extract_content, labelled_nodes, trained
from cellwise.llm.html_training import labelled_page
from cellwise.llm.warc import Gap, Record, SalvageReader, archive_folder, member, read_archives, record_bytes, write_archives


def records(n=6, plain=False):
    out = []
    for i in range(n):
        payload = f"<p>page {i} WARC/1.1\r\n\r\n{'x' * 50 * i}</p>".encode()
        data = record_bytes(i, f"http://a.example/{i}\r\nEvil: 1", payload, hashlib.sha256(payload).hexdigest(), 0 if i == 4 else None)
        out.append(data if plain else member(data))
    return out


def read(data):
    return list(SalvageReader(io.BytesIO(data)))


@pytest.mark.parametrize("plain", [False, True])
def test_round_trip(plain):
    parts = records(plain=plain)
    got = read(b"".join(parts))
    assert [type(x) for x in got] == [Record] * 6 and [x.length for x in got] == list(map(len, parts))
    assert [x.headers["warc-type"] for x in got] == ["response"] * 4 + ["revisit", "response"]
    assert all("evil" not in x.headers for x in got) and read(b"") == []


@pytest.mark.parametrize("plain", [False, True])
def test_later_records_survive_damage(plain):
    r = random.Random(5)
    for _ in range(60):
        parts = records(plain=plain)
        k = r.randrange(6)
        at = r.randrange(len(parts[k]))
        change = r.choice(("flip", "cut", "insert", "drop"))
        bad = bytearray(parts[k])
        if change == "flip":
            bad[at] ^= 1 << r.randrange(8)
        elif change == "cut":
            bad = bad[:at]
        elif change == "insert":
            bad[at:at] = bytes(r.randrange(256) for _ in range(r.randrange(1, 40)))
        else:
            del bad[at : at + 7]
        damaged = parts[:k] + [bytes(bad)] + parts[k + 1 :]
        got = read(b"".join(damaged))
        ids = [x.headers["warc-record-id"] for x in got if isinstance(x, Record)]
        assert [f"<urn:x-page:{i}>" for i in range(6) if i != k] == [i for i in ids if i != f"<urn:x-page:{k}>"]
        assert sum(x.length for x in got) == sum(map(len, damaged))
        end = 0
        for x in got:  # records and gaps tile the file
            assert x.offset == end
            end += x.length


def test_noise_is_one_gap():
    got = read(b"\x1f\x8b\x08junk WARC/1.1\r\nno" * 50)
    assert len(got) == 1 and isinstance(got[0], Gap) and got[0].length == 50 * len(b"\x1f\x8b\x08junk WARC/1.1\r\nno")


def test_pages_through_archives(spark, tmp_path):
    long = "<p>" + "y" * 200 + "</p>"
    pages = [(1, "u1", long), (7, "u7", long), (3, None, "short"), (4, "u4", "short"), (5, "http://é/ ü", None), (6, "", ""), (None, "n", long), (9, "z", "é" * 50), (8, "z", "é" * 50)]
    d = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, first int")
    archives = write_archives(d, f"file://{tmp_path}/a", roll=300)
    out = {r.record_id: r for r in read_archives(archives).collect()}
    assert len(out) == len(pages) and archives.count() > 1
    for page, _, html in pages:
        r, data = out[f"<urn:x-page:{'' if page is None else page}>"], (html or "").encode()
        first = {7: 1, None: 1, 9: 8}.get(page)
        assert (r.record_type, r.payload_bytes, r.payload_digest) == ("revisit" if first else "response", len(data), hashlib.sha256(data).hexdigest())
        assert r.refers_to == (f"<urn:x-page:{first}>" if first else None) and r.quarantined is None
        assert first or bytes(r.payload) == data
    empty = write_archives(d.limit(0), archive_folder(spark))
    assert empty.count() == 0 and read_archives(empty).count() == 0


def test_gaps_are_logged(spark, tmp_path):
    parts = records()
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"garbage" + parts[1] + parts[2][:-9] + parts[3])
    d = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",), (None,)], "path string")
    rows = read_archives(d).orderBy("offset").collect()
    assert [r.record_id for r in rows if not r.quarantined] == [f"<urn:x-page:{i}>" for i in (0, 1, 3)]
    assert [(r.offset, r.length) for r in rows if r.quarantined] == [(len(parts[0]), 7), (len(parts[0]) + 7 + len(parts[1]), len(parts[2]) - 9)]


def test_parser():
    dom = parse("<!-- a --><p class='x y'>One&nbsp;<b>two<br>three<p>F&ouml;ur &lt;<li>a<li>b</ul><script>'</p>'</script><style>x</style><a href=q>l<i>n</i></a> tail < 3")
    assert [t for t in dom.text if t] == ["One two three", "Föur <", "a", "bln tail < 3"] and "x y" in dom.names
    assert [t for t in parse("<div>" * 3000 + "deep").text if t] == ["deep"]
    assert parse("").tag == ["html"] and [t for t in parse("<!-- open").text if t] == []


def test_held_out_pages():
    model, exact, found, wanted, right = trained(), 0, 0, 0, 0
    for k in range(150):
        html, kept = labelled_page(5_000_000 + k)
        got = model.text(html).split("\n\n") if model.text(html) else []
        exact += got == kept
        found, wanted, right = found + len(got), wanted + len(kept), right + len(set(got) & set(kept))
    assert exact >= 0.75 * 150 and right >= 0.95 * wanted and right >= 0.9 * found


def test_messages_equal_enumeration():
    from itertools import product
    from math import exp

    from cellwise.llm.html_content import features, kind_of

    model = trained()
    html = "<body><nav><a href=x>m</a></nav><article><h1>T</h1><p>A good sentence, long enough.</p></article></body>"
    dom, _ = labelled_nodes(html, [])
    n = len(dom.tag)
    unary = [max(-12.0, min(12.0, sum(model.weights[k] for k in f))) for f in features(dom)]
    weight, total = [0.0] * n, 0.0
    for labels in product((0, 1), repeat=n):
        p = exp(sum(u for u, y in zip(unary, labels) if y))
        for i in range(1, n):
            p *= model.tables[kind_of(dom.tag[dom.parent[i]])][2 * labels[dom.parent[i]] + labels[i]]
        total += p
        for i, y in enumerate(labels):
            weight[i] += p * y
    assert model.marginals(dom) == pytest.approx([w / total for w in weight], abs=1e-9)


def test_pages(spark):
    html = "<html><body><nav><ul><li><a href=a>menu</a></li></ul></nav><article><h1>A title</h1><p>Some text  of\n the article, with &amp; marks.</p></article><footer>&copy; x</footer></body></html>"
    d = spark.createDataFrame([(1, "u", html, 0), (1, "u", html, 0), (2, None, None, 0), (None, "v", "", 0)], "page_id long, url string, html string, extra int")
    out = extract_content(d).collect()
    text = "A title\n\nSome text of the article, with & marks."
    assert sorted(((r.page_id or 0), r.url or "", r.text, r.n_chars) for r in out) == [(0, "v", "", 0), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, "", "", 0)]
    assert extract_content(d.limit(0)).count() == 0
