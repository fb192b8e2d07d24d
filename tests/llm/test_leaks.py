import hashlib

from plain import SF, docs_of, edge_rows, words

from lectern.llm import decontaminate

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def expected(text, items):
    found = words(text, PATTERN)
    hit, which = set(), set()
    for item_id, item in items:
        passage = words(item, PATTERN)
        if item_id is None or not passage:
            continue
        for i in range(max(len(passage) - 9, 1)):
            window = passage[i : i + 10]
            for k in range(len(found) - len(window) + 1):
                if found[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    which.add(item_id)
    ids = ",".join(sorted(map(str, which)))
    return len(found), len(hit), len(which), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def check(spark, rows, items, **settings):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, leak string")
    found = decontaminate.digests(decontaminate.find_items(docs_of(spark, rows), table, **settings)).collect()
    got = sorted((tuple(r) for r in found), key=repr)
    assert got == sorted(((i, *expected(t, items)) for i, t in rows), key=repr)


def items_of(rows):
    text = dict(rows)
    passage = text[20].split()
    return [
        (1, " ".join(passage[3:20])), (2, " ".join(passage[5:14])), (10, text[7].upper()), (3, None), (4, ""), (5, "!!"),
        (6, "one"), (None, "one two"), (6, "one"), (7, "nothing like this occurs in any of the given documents at all here"),
    ]


def test_edges(spark):
    rows = edge_rows()
    check(spark, rows, items_of(rows))


def test_blocks_of_the_benchmark(spark):
    rows = [r for r in edge_rows() if r[0] != 40]
    check(spark, rows, items_of(rows), block_bytes=300)


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, rows, items)


def test_empty_tables(spark):
    rows = edge_rows()[:6]
    check(spark, rows, [])
    check(spark, [], items_of(edge_rows()))
