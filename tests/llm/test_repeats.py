from types import SimpleNamespace

import numpy as np
from plain import SF, docs_of, edge_rows

from lectern.llm import repeats


def expected(rows, size):
    texts = {}
    for i, text in rows:
        if i is not None:
            texts[i] = (text or "").encode()
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i]
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - size + 1):
            if raw[k : k + size] in seen:
                gone[k : k + size] = True
            else:
                seen.add(raw[k : k + size])
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out[i] = (len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def check(spark, rows, size=100, **settings):
    found = repeats.remove_repeats(docs_of(spark, rows), size, **settings).collect()
    assert len(found) == len(rows)
    want = expected(rows, size)
    by_text = {t: 0 for _, t in rows}
    for r in found:
        if r.doc_id is None:
            assert r.n_removed == 0 and r.spans == [] and len(r.kept) == r.n_bytes
        else:
            spans = [(s["first"], s["last"]) for s in r.spans]
            assert (r.n_bytes, r.n_removed, spans, bytes(r.kept)) == want[r.doc_id]
    assert len(by_text) > 0 or not rows


def test_edges(spark):
    check(spark, edge_rows(), bucket_bytes=4096)


def test_other_size(spark):
    check(spark, [(i, t) for i, t in edge_rows(8) if i != 40], size=57)


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, bucket_bytes=1 << 15)


def test_empty_table(spark):
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


def test_long_texts_are_worked_on_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 110, 3000)))
    monkeypatch.setattr(repeats, "PIECE", 512)
    for rows in ([(1, text), (2, text[700:1900] + "é" + text[:400])], [(5, text[:150] + text), (4, text[2000:])]):
        body = [(i, t.encode()) for i, t in rows]
        table = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [i for i, _ in body], "text": [t for _, t in rows]})
        hot = SimpleNamespace(value=np.arange(1 << repeats.GRAM_BITS) % 3 == 0)
        packed = [b for b in repeats._gathered(100, 3, hot)(iter([table]))]
        by_bucket = __import__("pyarrow").Table.from_batches(packed).sort_by("bucket").combine_chunks().to_batches()
        got = {i: set() for i, _ in body}
        for batch in repeats._bucketwise(100)(iter(by_bucket)):
            for d, s, n in zip(*(c.to_pylist() for c in batch.columns)):
                got[d] |= {x for k in range(s, s + n) for x in range(k, k + 100)}
        want = expected(rows, 100)
        assert {i: len(x) for i, x in got.items()} == {i: want[i][1] for i in got}


def test_cover_has_every_difference():
    differences = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert differences == set(range(repeats.PERIOD))


def later(body, at, order, size):
    seen, out = {}, []
    for p, n in zip(at.tolist(), order.tolist()):
        seen.setdefault(body[p : p + size].tobytes(), []).append(n)
    for p, n in zip(at.tolist(), order.tolist()):
        out.append(n > min(seen[body[p : p + size].tobytes()]))
    return out


def test_windows_with_bytes_of_their_own_are_not_ranked(monkeypatch):
    rng = np.random.default_rng(7)
    body = rng.integers(97, 123, 20_000).astype(np.uint8)
    # Many windows share their first 32 bytes, few all 100.
    for place in range(500, 19_000, 200):
        body[place : place + 40] = body[:40]
    body[15_000:15_230] = body[9_000:9_230]
    at = np.arange(len(body) - 99)
    ranked = []
    ranks = repeats.cover_ranks
    monkeypatch.setattr(repeats, "cover_ranks", lambda head, place, size: ranked.append(len(place)) or ranks(head, place, size))
    order = rng.permutation(len(at))
    assert repeats.later_windows(body, at, order, 100).tolist() == later(body, at, order, 100)
    assert sum(later(body, at, order, 100)) == 131 and sum(ranked) < 300


def test_windows_that_share_a_hash_are_compared(monkeypatch):
    rng = np.random.default_rng(8)
    for size in (40, 41, 57, 100, 128):
        body = rng.integers(97, 99, 4000).astype(np.uint8)
        body[2500:3500] = body[100:1100]
        body[3600:3900] = 97
        at = np.flatnonzero(rng.random(len(body) - size + 1) < 0.8)
        order = rng.permutation(len(at))
        want = later(body, at, order, size)
        assert repeats.later_windows(body, at, order, size).tolist() == want
        with monkeypatch.context() as patch:
            whole = repeats.window_hashes
            patch.setattr(repeats, "window_hashes", lambda *given: whole(*given) & np.uint64(0xFF << 56))
            assert repeats.later_windows(body, at, order, size).tolist() == want
