import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import tiktoken
from plain import SF, edge_rows
from test_leaks import expected as leak
from test_near_copies import expected as copies
from test_personal_data import plain as personal

from lectern.llm import byte_bpe, pii
from lectern.llm.queries import BYTE_RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), "own") for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, leak string")


def test_stages_on_edges(spark):
    rows = edge_rows() + [(95, "write to a@b.cd please, " + " ".join(f"q{i}" for i in range(30)))]
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
    last = corpus_pipeline.encode_tokens(spark, docs, SF)
    assert last.columns[: len(docs.columns)] == docs.columns
    assert all(r.round_trip for r in last.collect())


def test_stages_on_empty_tables(spark):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text)}

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    _, component = copies(rows)
    unique = stages["near_copies"](spark, kept, SF)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, c in component.items() if i == c)

    clean = stages["decontaminate"](spark, unique, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in unique.collect() if not leak(r.text, items)[-1]}

    redacted = stages["personal_data"](spark, clean, SF)
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in redacted.collect():
        spans = personal(before[r.doc_id])
        if not spans:
            assert r.text == before[r.doc_id]
        assert r.n_chars == len(r.text)
        assert all(before[r.doc_id][b:e] not in r.text for b, e, _ in spans)
        assert pii.base_spans(r.text) == []

    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in stages["tokens"](spark, redacted, SF).collect():
        assert r.token_ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) and r.round_trip


def test_one_row_of_each_group_of_copies(spark):
    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(7, text[0]), (3, text[0]), (3, text[0]), (None, text[0])]
    rows += [(None, text[1]), (None, text[1]), (None, text[1] + " more")]
    rows += [(9, text[2]), (9, text[2]), (12, ""), (12, ""), (13, ""), (None, None), (None, "")]
    rows += [(20, text[3]), (20, text[0] + " more")]
    found = corpus_pipeline.drop_near_copies(spark, table(spark, rows), SF).collect()
    kept = sorted(((r.doc_id or 0), (r.text or "")[:1]) for r in found)
    assert kept == [(0, ""), (0, ""), (0, "b"), (3, "a"), (9, "c"), (12, ""), (13, ""), (20, "d")]


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns[:5] == COLUMNS and 0 < found.count() < 200


def test_python_gets_short_batches(spark):
    docs = table(spark, [(i, f"w{i} " * 20_000) for i in range(80)]).coalesce(1)
    longest = 120_000
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.encode_tokens):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        made = stage(spark, docs, SF)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint")
        # All rows together are three times as long.
        assert max(r.n for r in sizes.collect()) <= corpus_pipeline.BATCH_BYTES + longest
        assert made.count() == 80
