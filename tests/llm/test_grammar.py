import random
import zlib
from itertools import accumulate

import numpy as np
import pytest
from plain import SF, docs_of, edge_rows
from tokenizers import Tokenizer

from lectern.llm import grammar, queries
from lectern.llm.queries import END_ID, WORD_BPE

ODD = ["", "a<|endoftext|>b <|startoftext|>", "xꟋ yꟜ", "z" * 3000, "# # 2 #", "日本語 ΑΣΣ İ ﬁ", "the " * 4000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def plain(library, rows):
    """``doc_id, start, ids`` of the rows in the file's order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [library.encode(text or "", add_special_tokens=False).ids + [END_ID] for _, text in rows]
    starts = accumulate([0, *map(len, ids)][:-1])
    return [(doc, start, found) for (doc, _), start, found in zip(rows, starts, ids)]


@pytest.fixture(params=[1 << 20, 3000])
def written(request, spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(grammar, "SHARD_IDS", request.param)
    monkeypatch.setattr(grammar, "LEAST_USES", 3)
    # Rows that share an id are alike here, so that their order is plain.
    rows = [(i, t) for i, t in edge_rows() if i is not None] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "a b")]
    path = str(tmp_path / "ids")
    grammar.write_ids(docs_of(spark, rows), path, grammar.word_ids(WORD_BPE, END_ID))
    return path, plain(library, rows)


def test_read_back(spark, written):
    path, expected = written
    found = grammar.read_ids(spark, path).collect()
    found = sorted((r.start, r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    assert found == [(start, doc, len(ids), ids) for doc, start, ids in expected]


def test_ranges(spark, written):
    path, expected = written
    flat = [i for _, _, ids in expected for i in ids]
    rng = random.Random(2)
    ranges = [(i, rng.randrange(len(flat)), rng.randrange(4000)) for i in range(40)]
    ranges += [(90, 0, len(flat)), (91, len(flat) - 3, 100), (92, len(flat) + 5, 9), (93, -4, 10), (94, 5, 0), (95, None, 1), (96, 7, 7), (96, 7, 7)]
    wanted = spark.createDataFrame(ranges, "range_id bigint, start bigint, size bigint")
    found = {}
    for r in grammar.read_ranges(spark, path, wanted).orderBy("start").collect():
        got = found.setdefault(r.range_id, {})
        got[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for i, start, size in ranges:
        want = flat[max(start, 0) : max(start + size, 0)] if start is not None else []
        pieces = found.get(i, {})
        assert [x for _, ids in sorted(pieces.items()) for x in ids] == want
        at = max(start or 0, 0)
        for place, ids in sorted(pieces.items()):
            assert place == at
            at += len(ids)


def test_grammar_of_any_ids():
    rng = np.random.default_rng(4)
    for trial in range(60):
        n = int(rng.integers(0, 3000))
        ids = rng.integers(0, rng.choice([1, 2, 5, 70_000]) + 1, n).astype(np.uint32)
        if trial % 3 == 0 and n:
            ids = np.tile(ids[:50], 40)
        ends = np.sort(np.r_[rng.integers(0, len(ids) + 1, 5), len(ids)])
        shard = grammar.Shard(grammar.compress(ids, ends))
        assert shard.ids().tolist() == ids.tolist()
        assert shard.documents().tolist() == [0, *ends.tolist()]
        low, high = sorted(rng.integers(0, len(ids) + 2, 2).tolist())
        assert shard.ids(low, high).tolist() == ids[low:high].tolist()


def test_repeats_become_rules():
    ids = np.tile(np.arange(100, dtype=np.uint32), 200)
    raw = grammar.compress(ids, np.array([len(ids)]))
    shard = grammar.Shard(raw)
    assert len(shard.symbols) <= 250 and len(raw) < 4 * len(ids) / 10
    assert shard.lengths.max() >= 100


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    grammar.write_ids(docs_of(spark, []), path, grammar.word_ids(WORD_BPE, END_ID))
    assert grammar.read_ids(spark, path).count() == 0
    ranges = spark.createDataFrame([(1, 0, 5)], "range_id bigint, start bigint, size bigint")
    assert grammar.read_ranges(spark, path, ranges).count() == 0


def test_query(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op11_grammar_ids(spark, SF).collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert found == {doc: (start, len(ids), crc(ids)) for doc, start, ids in plain(library, rows)}


def test_pairs_that_share_a_slot_are_found(monkeypatch):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 30, 20_000).astype(np.uint32)
    ends = np.r_[0, 0, np.sort(rng.integers(0, len(ids), 40)), len(ids), len(ids)]
    whole = grammar.compress(ids, ends)
    monkeypatch.setattr(grammar, "_SLOT_BITS", 3)
    assert grammar.compress(ids, ends) == whole
    shard = grammar.Shard(whole)
    assert np.array_equal(shard.ids(), ids) and shard.documents().tolist() == [0, *ends.tolist()]


def test_pairs_are_found_without_bisection(monkeypatch):
    rng = np.random.default_rng(5)
    searched = []
    search = np.searchsorted
    monkeypatch.setattr(grammar.np, "searchsorted", lambda a, v, *more: searched.append(np.size(v)) or search(a, v, *more))
    ids = rng.integers(0, 200, 50_000).astype(np.uint32)
    shard = grammar.Shard(grammar.compress(ids, np.array([20_000, 50_000])))
    # It was a search for each place of a pair that becomes a rule, 50,000 in the first round.
    assert sum(searched) < len(ids) / 2
    assert np.array_equal(shard.ids(), ids)
