import random
import re

import numpy as np
from plain import SF, docs_of, edge_rows

from lectern.llm import boost, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    for k in range(8000):
        letters = "aB1234567890.@+- ()%\n" if k % 2 else "a1.@.@bé"
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for letter in "a1.+@ -":
        pii.find(letter * 300_000 + "@", None)
        assert pii.candidates(letter * 300_000) == []or letter == "1"


def test_added_spans_cross_no_base_span(spark):
    # Ten addresses that overlap an email, all of which start before the number in it.
    text = "1.1.1.1a" * 10 + "555-123-4567@x.yz"
    everything = pii.Detector(boost.fit(np.zeros((4, pii.FEATURES)), np.ones(4)), dict.fromkeys(pii.KINDS, 0.0))
    base, found = pii.find(text, everything)
    assert base == plain(text) and found == base
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("a1234567.@+- ()[at]") for _ in range(rng.randint(0, 120)))
        base, found = pii.find(text, everything)
        added = [s for s in found if s not in base]
        every = base + added
        assert set(base) <= set(found)
        assert not any(a[0] < b[1] and b[0] < a[1] for a in added for b in every if a is not b)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    detector = pii.fit(docs)
    for r in pii.detect(docs, detector).collect():
        base = plain(r.text)
        assert r.pii.base == pii.listed(base)
        assert [r.pii[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        # The method may add spans; the base ones stay.
        assert set(filter(None, r.pii.base.split(","))) <= set(filter(None, r.pii.spans.split(",")))
        if not base and not re.search(r"[0-9@]", r.text):
            assert r.pii.redacted == r.text


def test_disguised_data_is_found_and_numbers_are_left(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    kinds = [
        lambda: f"{name()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
        lambda: f"{rng.randint(10**9, 10**10 - 1)} v{rng.randint(1, 9)}.{rng.randint(0, 9)} 20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-12",
    ]
    rows = [(i, " ".join([name(), rng.choice(kinds)(), name(), name()])) for i in range(1500)]
    docs = docs_of(spark, rows)
    detector = pii.fit(docs)
    base, found = pii.find("write to someone [at] mail3 [dot] example [dot] com today", detector)
    assert not base and [s[2] for s in found] == ["email"]
    assert pii.find("in 2024-05-12 we sold 120 of them, version 3.1 of 1000000", detector)[1] == []


def test_edges(spark):
    rows = edge_rows() + [(90, "mail a@b.cd, a@b.cd"), (91, "4111 1111 1111 1111"), (92, "+1 (017) 555-7713 at 10.0.0.1")]
    docs = docs_of(spark, rows)
    found = pii.detect(docs, pii.fit(docs)).collect()
    assert len(found) == len(rows)
    text = {r.doc_id: r.pii.redacted for r in found if r.doc_id and r.doc_id >= 90}
    assert text == {90: "mail [EMAIL], [EMAIL]", 91: "[CARD]", 92: "[PHONE] at [IP]"}
    assert all((r.pii.redacted is None) == (r.text is None) for r in found)
    none = docs_of(spark, [])
    assert pii.detect(none, pii.fit(none)).count() == 0


def test_thresholds_come_from_all_documents(spark):
    # More documents than a sample of 10,000 would hold.
    rows = [(i, f"a{i % 7}.b@mail.example.com and +1 (017) 555-77{i % 90 + 10} at 10.0.{i % 200}.1 of 5500{i % 800:04}00") for i in range(12_000)]
    cells = pii._cells(docs_of(spark, rows)).collect()
    wanted = sum(len(list(pii.training_rows(t))) for _, t in rows)
    assert sum(sum(c[1:]) for c in cells) == wanted
    assert len(cells) == len({x for _, t in rows for _, _, x in pii.training_rows(t)})


def test_sums_in_tasks_give_the_same_detector(spark):
    docs = docs_of(spark, [(i, f"a{i % 7}.b@mail{i}.example.com, +1 (017) 555-77{i % 90 + 10}, 10.0.{i}.1, 2024-05-{i % 28}, 5500{i:04}00") for i in range(250)])
    held, passed = pii.fit(docs), pii.fit(docs.repartition(2), driver_cells=0)
    assert (held.trees.feature == passed.trees.feature).all() and (held.trees.threshold == passed.trees.threshold).all()
    assert np.allclose(held.trees.value, passed.trees.value, atol=1e-6)
    assert held.thresholds.keys() == passed.thresholds.keys()
    assert np.allclose(list(held.thresholds.values()), list(passed.thresholds.values()), atol=1e-3)
    assert {2.0} != set(held.thresholds.values())
