import collections
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import packing, warc
from tests.llm.cases import LONG, TEXTS, docs

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", LONG * 3), (6, "u", LONG * 3), (7, "u v\r\nw", "WARC/1.1\r\n\r\n\r\n"), (7, "u", "WARC/1.1\r\n\r\n\r\n"),
         (None, "u", "<p>x</p>"), (None, "u", "alone"), (8, "u", "ü🎉" * 20_000), (8, "u", "ü🎉" * 20_000)]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 64))
def test_frames_round_trip(payload, size):
    assert warc.unframe(warc.frame(payload, size)) == payload


def test_archives_round_trip(spark):
    d = spark.createDataFrame([(*r, 1, "x") for r in PAGES], "page_id long, url string, html string, digest int, segment string")
    for segment in (300, warc.SEGMENT):
        got = warc.round_trip(d, segment=segment).collect()
        assert len(got) == len(PAGES) and all(r.problem is None for r in got)
        groups = collections.defaultdict(list)
        for i, _, h in PAGES:
            groups[h or ""].append(i)
        want = collections.Counter()
        for i, _, h in PAGES:
            first = min((x for x in groups[h or ""] if x is not None), default=None)
            body = (h or "").encode()
            want[(i, len(body), warc.sha1_base32(body), "response" if i == first else "revisit", None if i == first else first)] += 1
        assert collections.Counter(tuple(r)[:5] for r in got) == want


def test_archive_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_segments_are_named(spark, tmp_path):
    recs = list(warc.write_records("urn:x", "u", b"y" * 5000, None, 1000))
    whole = b"".join(x + b"\r\n\r\n" for x in recs)
    for name, data in (("a", whole), ("b", b"".join(x + b"\r\n\r\n" for x in recs[:1] + recs[2:])), ("c", b"".join(x + b"\r\n\r\n" for x in recs[:-1]))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
    read = lambda n: [(r.record_id, r.payload and bytes(r.payload), r.problem) for r in warc.read_archive(spark, str(tmp_path / n)).collect()]
    assert read("a") == [("urn:x", b"y" * 5000, None)]
    assert read("b") == [("urn:x", None, "segments missing")]
    assert read("c") == [("urn:x", None, "total length")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold_capacity(sizes):
    at, k = packing.windows(sizes, 100)
    assert len(at) == len(sizes) and np.bincount(at, sizes, k).max() <= 100 and set(at) <= set(range(k))


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 600).tolist()
    sums = np.bincount(packing.differencing(sizes, 50), sizes, 50)
    assert sums.max() - sums.min() <= 20


def test_packing_is_whole(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs(spark)).collect()
    want = collections.Counter()
    for i, t in TEXTS:
        want[(i, zlib.crc32(np.asarray(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))] += 1
    ids = {}
    for i, t in TEXTS:
        ids.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        assert sum(r.length for r in pieces) == sum(map(len, ids[i]))
        for r in pieces:
            assert any(len(x) == r.doc_tokens and zlib.crc32(np.asarray(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[i])
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 2048
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_words_and_whole_texts_encode_alike(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    e = packing.WordEncoder()
    odd = ["don't they'll we've I'm 's ''s x'd.", "a \n  b\r\n\tc ", "1234 5½ ①② 7., 8,.", "End. END, End.. ., . , a., É. é, ß. Ä.", "ΑΣ. ΑΣ, İ. ŉ.", "x\u0301. y,\u0301 e\u0301.", "µ. ª, ¼. À\xad."]
    every = [t or "" for _, t in TEXTS] + odd
    for t in every:
        assert e([t]) == [e._bytes(t)]
    assert e(every) == [e._bytes(t) for t in every]
