import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from plain import SF, docs_of, edge_rows
from tokenizers import Tokenizer

from lectern.llm import alignment, queries

ODD = ["<s> </s> <unk> <|endoftext|> <0x41>", "a  b   c ", "▁x", "日本語テキスト。。。。" * 20, "\U0001f468‍\U0001f469é\r\n\tx", "z" * 3000, " lead", "ﬁ①", "İ"]
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def letters():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}


def groups_of(text, sides):
    """Groups as (ids of A, ids of B), by walking both token lists."""
    if not text:
        return []
    a, b = sides
    of = letters()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(of[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return []
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    cuts = sorted(set(a_ends) & set(b_ends))
    out, i, j = [], 0, 0
    for cut in cuts:
        group = ([], [])
        while i < len(a_ends) and a_ends[i] <= cut:
            group[0].append(a_ids[i])
            i += 1
        while j < len(b_ends) and b_ends[j] <= cut:
            group[1].append(b_ids[j])
            j += 1
        out.append(group)
    return out


def expected(texts, sides):
    groups = [groups_of(t, sides) for t in texts]
    links = [Counter() for _ in texts]
    for found, mine in zip(groups, links):
        for a, b in found:
            for x, n in Counter(a).items():
                for y, m in Counter(b).items():
                    mine[x, y] += n * m
    count = Counter(pair for mine in links for pair in mine)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for found, mine in zip(groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        out.append((
            sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), sum(mine.values()),
            sum(n for p, n in mine.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in mine.items()),
            hashlib.sha256(text.encode()).hexdigest() if found else "",
        ))
    return out


def report(docs, **options):
    found = alignment.report(docs, queries.PLAIN_RANKS, public_tokenizers.PATTERN, queries.PIECES, **options)
    assert found.columns == ["doc_id", *COLUMNS]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("head", [1 << 20, 40, 0])
def test_report(spark, sides, head, monkeypatch):
    if head == 40:
        for name in ("LINKS_AT_ONCE", "PLAIN_LINKS", "PAIRS_HELD"):
            monkeypatch.setattr(alignment, name, 64)
    rows = edge_rows() + [(100 + i, t) for i, t in enumerate(ODD)]
    wanted = expected([t for _, t in rows], sides)
    found = report(docs_of(spark, rows), head_pairs=head)
    assert found == sorted(((i, *w) for (i, _), w in zip(rows, wanted)), key=repr)
    assert any(w[2] and w[2] < w[0] for w in wanted)


def test_groups(spark, sides):
    rows = list(enumerate([*ODD, "plain words, and more", None]))
    found = alignment.align(docs_of(spark, rows), queries.PLAIN_RANKS, public_tokenizers.PATTERN, queries.PIECES)
    assert "language" in found.columns
    for r in found.collect():
        groups, a, b = [], iter(r.aligned.a_ids), iter(r.aligned.b_ids)
        for n, m in zip(r.aligned.a_sizes, r.aligned.b_sizes):
            groups.append(([next(a) for _ in range(n)], [next(b) for _ in range(m)]))
        assert groups == groups_of(r.text, sides)


def test_the_piece_model_meets_short_parts_only(sides):
    ours = alignment.PieceSide(queries.PIECES)
    assert ours.parted
    met = []

    class Watched:
        def encode(self, texts, num_threads):
            met.extend(texts)
            return model.encode(texts, num_threads=num_threads)

    model, ours.model = ours.model, Watched()
    words = "ab  c, \n d\u3000e   "
    texts = [*ODD, "", " ", "   ", "x" + " " * 700, " " * 300 + "y z", "w" * 255 + "  v", "w " * 600, *(words * n for n in (1, 30, 31, 90)), "long " * 40_000]
    found = ours.encode(texts)
    assert [x.tolist() for x in found] == [sides[1].encode(t) for t in texts]
    assert max(len(m) for m in met if " " in m.strip()) < 2 * alignment.PART
    assert [x.tolist() for x in ours.encode(["a b"])] == [sides[1].encode("a b")]


def test_pointers_reach_the_end_of_long_chains():
    a = np.r_[np.arange(3, 30_000, 2), 30_000]
    b = np.r_[np.arange(2, 30_000, 2), 30_000]
    assert set(alignment.group_ends(a, b).tolist()) == {0}
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.r_[rng.integers(1, n + 1, n), n]) for _ in range(2))
        cuts = np.intersect1d(a, b)
        assert alignment.group_ends(a, b).tolist() == [*np.searchsorted(cuts, a), *np.searchsorted(cuts, b)]


@pytest.mark.parametrize("held", [1, 40, 300])
def test_pairs_are_counted_whatever_a_task_holds(spark, sides, held):
    # One task, a batch for each text: pairs are handed on between batches.
    texts = [f"{t} number{i} of the plain words, and m{i}re" for i, t in enumerate(ODD * 3)]
    docs = docs_of(spark, list(enumerate(texts))).coalesce(1)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "1")
    try:
        _, parts = alignment.mark(docs, queries.PLAIN_RANKS, public_tokenizers.PATTERN, queries.PIECES, held)
    finally:
        spark.conf.set(rows, before)
    found = Counter()
    for r in parts.collect():
        found[r.pair >> 32, r.pair & 0xFFFFFFFF] += r.n
    wanted = Counter()
    for t in texts:
        wanted.update({(x, y) for a, b in groups_of(t, sides) for x in a for y in b})
    assert found == wanted


def test_empty_table(spark):
    assert report(docs_of(spark, [])) == []


def test_query(spark, sides):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_alignment(spark, SF).collect()}
    assert found == {i: w for (i, _), w in zip(rows, expected([t for _, t in rows], sides))}
