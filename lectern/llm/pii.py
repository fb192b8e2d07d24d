"""Personal data: exact base patterns, and candidates that boosted trees accept beside them."""

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import boost
from lectern.llm.batches import annotate, longs, per_text
from lectern.plans.shared import saved

KINDS = ("email", "ip", "card", "phone")
# Redaction needs this precision on candidates kept for calibration.
PRECISION = 0.995
# So many distinct candidates are summed on the driver (58 bytes each); more of them in tasks.
DRIVER_CELLS = 1 << 16
# Distinct candidates that a task counts before it hands them on.
CELLS_HELD = 1 << 16

# The base patterns of the contract; linear-time forms of the same matches.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NO_DIGIT.sub("", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches in order. Every match holds its first ``@``, so only those are visited."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Base matches of every kind, by start and then kind."""
    out = [(b, e, "email") for b, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Generators: more than personal data is proposed, and spans may overlap.
_MASKED_MAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,6}", re.I
)
_MASKED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?\. ?|[\[({]\.[\])}]| ?[\[({]dot[\])}] ?)[0-9]{1,3}){3}(?![0-9.])", re.I)
_NUMBERS = re.compile(r"(?<![0-9])[(]?[0-9](?:[ ./()_-]{0,2}[0-9]){6,24}(?![0-9])")
_SIGNS = re.compile(r"[\[({][ ]?(?:at|dot|\.)[ ]?[\])}]| ?@ |\. [0-9]| @", re.I)
_LONG_NUMBER = re.compile(r"[0-9](?:[ ./()_-]{0,2}[0-9]){6}")


def candidates(text: str) -> list[Span]:
    out = []
    if _SIGNS.search(text):
        out += [(m.start(), m.end(), "email") for m in _MASKED_MAIL.finditer(text)]
        out += [(m.start(), m.end(), "ip") for m in _MASKED_IP.finditer(text)]
    if _LONG_NUMBER.search(text):
        for m in _NUMBERS.finditer(text):
            n = len(_digits(m.group()))
            if 7 <= n <= 15:
                out.append((m.start(), m.end(), "phone"))
            if 12 <= n <= 19:
                out.append((m.start(), m.end(), "card"))
            if m.group().count(".") == 3:
                out.append((m.start(), m.end(), "ip"))
    return out


# Context words, any language of the corpus or none.
_CUES = {
    "email": re.compile(r"mail|contact|write|schreib|escrib|écri", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|client|from", re.I),
    "card": re.compile(r"card|visa|master|amex|karte|tarjeta|carte|paid|pay", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobile|anruf|llam|appel|whatsapp", re.I),
}
FEATURES = 26


def features(text: str, span: Span) -> bytes:
    """Format of the span and its surroundings, a whole number up to 255 each."""
    begin, end, kind = span
    body = text[begin:end]
    digits = _digits(body)
    before, after = text[max(0, begin - 30) : begin], text[end : end + 12]
    groups = [len(g) for g in re.findall(r"[0-9]+", body)] or [0]
    last = before[-1:]
    octets = re.findall(r"[0-9]+", body)
    found = [
        *(kind == k for k in KINDS),
        len(digits),
        len(body),
        sum(c.isalpha() for c in body),
        body.count(" "),
        body.count("-"),
        body.count("."),
        body.count("(") + body.count(")"),
        body.count("/") + body.count("_"),
        body.count("@"),
        len(groups),
        min(groups),
        max(groups),
        bool(digits) and 12 <= len(digits) <= 19 and luhn(digits),
        len(octets) == 4 and all(len(o) <= 3 and int(o) <= 255 for o in octets),
        digits[:1] == "0",
        last == "+",
        last.isalnum() or last in "\"'=_",
        after[:1].isalnum() or after[:1] in "\"'=_",
        last.isspace() or last in "(:<,",
        bool(_CUES[kind].search(before)),
        100 * len(set(digits)) // max(len(digits), 1),
        bool(re.match(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}", body)),
    ]
    return bytes(min(int(value), 255) for value in found)


def _crossing(held: list[Span]) -> Callable[[Span], bool]:
    """Whether a span overlaps any of ``held``, which is sorted by start."""
    starts = [s[0] for s in held]
    reach = list(accumulate((s[1] for s in held), max))

    def crosses(span: Span) -> bool:
        before = bisect_left(starts, span[1])
        return before > 0 and reach[before - 1] > span[0]

    return crosses


def _disguise(text: str, span: Span, number: int) -> tuple[str, Span]:
    """A base match written the way people hide one: a positive that no base pattern finds."""
    begin, end, kind = span
    body = text[begin:end]
    if kind == "email":
        body = body.replace("@", (" [at] ", "(at)", " @ ")[number % 3]).replace(".", (" [dot] ", ".", "(dot)")[number // 3 % 3])
    elif kind == "ip":
        body = body.replace(".", ("[.]", " . ", "[dot]", "(.)")[number % 4])
    elif kind == "phone":
        body = body.lstrip("+") if number % 2 else body.lstrip("+").replace("-", ".")
    else:
        d = _digits(body)
        body = ("  ", ".", "/")[number % 3].join(d[i : i + 4] for i in range(0, len(d), 4))
    return text[:begin] + body + text[end:], (begin, begin + len(body), kind)


def training_rows(text: str) -> Iterator[tuple[int, float, bytes]]:
    """``start, label, features``: base matches and their disguises against other candidates.

    A number that merely fails a check (a wrong card sum, an octet above 255) and every
    candidate away from base matches is a negative.
    """
    base = base_spans(text)
    for i, span in enumerate(base):
        body = (max(0, span[0] - 40), min(len(text), span[1] + 40))
        near = text[body[0] : body[1]]
        moved = (span[0] - body[0], span[1] - body[0], span[2])
        yield span[0], 1.0, features(near, moved)
        hidden, place = _disguise(near, moved, span[0] + i)
        yield span[0], 1.0, features(hidden, place)
    crosses = _crossing(base)
    for span in candidates(text):
        if not crosses(span):
            yield span[0], 0.0, features(text, span)


@dataclass(frozen=True)
class Detector:
    trees: boost.Trees
    thresholds: dict[str, float]


def fit(docs: DataFrame, precision: float = PRECISION, driver_cells: int = DRIVER_CELLS) -> Detector:
    """Fit and calibrate on the candidates of all documents.

    Candidates are told apart by their features alone, so how many of either label each
    distinct vector of features has is all that trees, calibration and thresholds need. The
    table of them, of two thirds to fit on and a third kept apart by the hash of document and
    place, is counted in the tasks. Up to ``driver_cells`` vectors come to the driver; more of
    them stay in the table, each level of a tree is a pass over it, and only sums come back.
    A kind's threshold is the least at which accepted candidates kept apart reach
    ``precision``.
    """
    cells = saved(_cells(docs), "candidates")

    def passes(function: Callable[..., dict], columns: str) -> list:
        """Sums by key over the cells: ``function`` gives numbers by key of some of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, FEATURES)
                numbers = [batch.column(i).to_numpy().astype(float) for i in range(1, 5)]
                yield pa.RecordBatch.from_pydict(function(x, *numbers))

        names = [c.split()[0] for c in columns.split(", ")]
        found = cells.mapInArrow(run, columns)
        return found.groupBy(names[:-2]).agg(*[F.sum(c).alias(c) for c in names[-2:]]).orderBy(names[:-2]).collect()

    def values(x, no, yes, *_):
        at = np.add(x, np.arange(FEATURES) * 256, dtype=np.int64)
        both = [np.bincount(at.ravel(), np.repeat(n, FEATURES), FEATURES * 256) for n in (no, yes)]
        place = np.flatnonzero(both[0] + both[1])
        return {"place": place, "no": both[0][place], "yes": both[1][place]}

    counts = np.zeros((2, FEATURES * 256))
    for r in passes(values, "place bigint, no double, yes double"):
        counts[:, r.place] = r.no, r.yes
    n_no, n_yes = counts[:, :256].sum(1)
    cuts = boost.quantile_cuts(counts.sum(0).reshape(FEATURES, 256))

    def sums_of_table(growing: boost.Growing) -> np.ndarray:
        shape = (2, 2**growing.level, FEATURES, boost.BINS)

        def level(x, no, yes, *_):
            grad, hess = boost.Cells(cuts, x, no, yes).sums(growing).reshape(2, -1)
            place = np.flatnonzero(hess)
            return {"place": place, "grad": grad[place], "hess": hess[place]}

        out = np.zeros((2, int(np.prod(shape[1:]))))
        for r in passes(level, "place bigint, grad double, hess double"):
            out[:, r.place] = r.grad, r.hess
        return out.reshape(shape)

    if cells.count() <= driver_cells:
        rows = sorted(cells.collect())
        x = np.frombuffer(b"".join(r.x for r in rows), np.uint8).reshape(-1, FEATURES)
        no, yes = (np.array([r[i] for r in rows], float) for i in (1, 2))
        sums = boost.Cells(cuts, x, no, yes).sums
    else:
        sums = sums_of_table
    trees = boost.grow(n_yes / (n_no + n_yes), cuts, sums) if n_no + n_yes else boost.fit(np.zeros((0, FEATURES)), np.zeros(0))

    def margins(x, _, __, no, yes):
        apart = no + yes > 0
        kind = np.argmax(x[apart, : len(KINDS)], 1) if apart.any() else np.zeros(0, np.int64)
        return {"kind": kind, "margin": trees.margin(x[apart]), "no": no[apart], "yes": yes[apart]}

    # Rounded margins: their number does not grow with the table.
    kept = passes(margins, "kind bigint, margin double, no double, yes double")
    kind, margin, no, yes = np.array([tuple(r) for r in kept]).reshape(-1, 4).T
    trees = boost.calibrate_margins(trees, margin, no, yes)
    p = trees.of_margin(margin)
    thresholds = {}
    for i, name in enumerate(KINDS):
        order = np.flatnonzero(kind == i)
        order = order[np.argsort(-p[order], kind="stable")]
        accepted = np.cumsum(no[order] + yes[order])
        good = np.flatnonzero(np.cumsum(yes[order]) >= precision * accepted)
        # Without evidence nothing is added beside the base matches.
        enough = len(good) and accepted[good[-1]] >= 20
        thresholds[name] = max(float(p[order][good[-1]]) * (1 - 1e-12), 0.5) if enough else 2.0
    return Detector(trees, thresholds)


def _cells(docs: DataFrame) -> DataFrame:
    """``x, no, yes, apart_no, apart_yes``: how many training rows have the features ``x``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike("[0-9@]"))
    names = ["no", "yes", "apart_no", "apart_yes"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out():
            numbers = np.array(list(held.values()), np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), *map(longs, numbers.T)], names=["x", *names])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for place, y, x in training_rows(text.as_py() or ""):
                    apart = zlib.crc32(f"{doc_id}:{place}".encode()) % 3 == 2
                    held.setdefault(x, [0, 0, 0, 0])[2 * apart + int(y)] += 1
                if len(held) >= CELLS_HELD:
                    yield out()
                    held = {}
        yield out()

    counted = docs.mapInArrow(rows, "x binary, no bigint, yes bigint, apart_no bigint, apart_yes bigint")
    return counted.groupBy("x").agg(*[F.sum(c).alias(c) for c in names])


def find(text: str, detector: Detector | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those together with accepted candidates that cross none of them."""
    base = base_spans(text)
    if detector is None:
        return base, base
    crosses = _crossing(base)
    open_ones = [s for s in dict.fromkeys(candidates(text)) if not crosses(s)]
    if not open_ones:
        return base, base
    p = detector.trees.probability(np.frombuffer(b"".join(features(text, s) for s in open_ones), np.uint8).reshape(-1, FEATURES))
    # Sorted and without overlap, so that only the last one that starts before can overlap.
    taken: list[Span] = []
    for score, span in sorted(zip(-p, open_ones)):
        if -score >= detector.thresholds[span[2]]:
            place = bisect_left(taken, (span[1],))
            if place == 0 or taken[place - 1][1] <= span[0]:
                taken.insert(place, span)
    return base, sorted([*base, *taken], key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each run of touching spans becomes its first kind in brackets."""
    out, at = [], 0
    upto = -1
    for begin, end, kind in spans:
        if begin >= upto:
            out += [text[at:begin], f"[{kind.upper()}]"]
        upto = max(upto, end)
        at = upto
    return "".join([*out, text[at:]])


SCHEMA = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base:string,spans:string,redacted:string>"


def detect(docs: DataFrame, detector: Detector | None = None, name: str = "pii", redact: bool = True) -> DataFrame:
    """``docs`` with ``name``: struct of base counts by kind, ``base`` and ``spans`` (each
    ``kind:start:end``, comma-joined) and the ``redacted`` text (null unless asked for).

    Offsets are code points, ends exclusive. Null and empty texts have no spans; a null
    stays null when redacted. Without a detector only base matches are found. Rows and
    other columns pass unchanged, an older column ``name`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(detector)

    def start():
        learned = held.value

        def work(texts):
            counts, first, every, clean = [], [], [], []
            for text in texts:
                body = text.as_py()
                base, spans = find(body or "", learned)
                counts.append([sum(s[2] == k for s in base) for k in KINDS])
                first.append(listed(base))
                every.append(listed(spans))
                clean.append(redacted(body, spans) if redact and body is not None else None)
            table = np.array(counts, np.int64).reshape(len(first), len(KINDS))
            return {
                **{f"n_{k}": longs(table[:, i]) for i, k in enumerate(KINDS)},
                "base": pa.array(first, pa.string()),
                "spans": pa.array(every, pa.string()),
                "redacted": pa.array(clean, pa.string()),
            }

        return work

    return annotate(docs, name, per_text(start, SCHEMA))
