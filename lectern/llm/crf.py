"""Document quality from a linear-chain conditional random field over its lines."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.batches import annotate, per_text, text_slices
from lectern.llm.sample import least_hashes
from lectern.llm.words import LOWER, NOT_SPACE, hashed_words

# Labelled documents that the field is fitted on at most.
SAMPLE_DOCS = 6_000
BAD, GOOD = 0, 1


def _kind(*ranges) -> np.ndarray:
    table = np.zeros(256)
    for r in ranges:
        table[r] = 1
    return table


_LOWER, _UPPER, _DIGIT = slice(0x61, 0x7B), slice(0x41, 0x5B), slice(0x30, 0x3A)
# Shares of a line's bytes.
_BYTE_KINDS = np.stack([
    _kind(_LOWER),
    _kind(_UPPER),
    _kind(_DIGIT),
    _kind(slice(0x80, 0x100)),
    _kind(list(b" \t")),
    _kind(list(b".,;:'\"?-")),
    _kind(list(b"!")),
    _kind(list(b"|<>{}[]=/\\_~^`")),
    _kind(list(b"#$%&*+@")),
])
OWN = len(_BYTE_KINDS) + 8
# Own features, those of both neighbours, first line, last line, constant.
WIDTH = 3 * OWN + 3


def line_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features, lengths, first line`` of each text; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 0x0A)
    text = np.searchsorted(starts, breaks, "right") - 1
    # A break at a text's end opens no line.
    inner = breaks + 1 < starts[text + 1]
    breaks, text = breaks[inner], text[inner]
    lines = np.concatenate([starts[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(starts) - 1), text])
    order = np.lexsort((lines, owner))
    lines, owner = lines[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(starts)))
    ends = np.r_[lines[1:], len(data)]
    ends[first[1:] - 1] = starts[1:]
    stops = ends - ((ends > lines) & (np.r_[data, 0][np.maximum(ends - 1, 0)] == 0x0A))
    length = stops - lines
    n = np.maximum(length, 1)
    x = np.zeros((len(lines), OWN))
    for k, table in enumerate(_BYTE_KINDS):
        sums = np.r_[0, np.cumsum(table[data])]
        x[:, k] = (sums[stops] - sums[lines]) / n
    k = len(_BYTE_KINDS)
    _, _, words, word_first = hashed_words(data, np.r_[lines, len(data)], NOT_SPACE)
    count = np.diff(word_first)
    line = np.repeat(np.arange(len(lines)), count)
    order = np.lexsort((words, line))
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=len(lines))
    x[:, k] = np.log1p(length)
    x[:, k + 1] = np.log1p(count)
    x[:, k + 2] = n / np.maximum(count, 1)
    x[:, k + 3] = np.minimum(x[:, k + 2], 40)
    x[:, k + 4] = distinct / np.maximum(count, 1)
    x[:, k + 5] = np.log1p(count) * (1 - x[:, k + 4])
    tail = np.r_[data, 0][np.maximum(stops - 1, 0)]
    x[:, k + 6] = (length > 0) & np.isin(tail, list(b".!?"))
    head = np.r_[data, 0][np.minimum(lines, len(data))]
    x[:, k + 7] = (length > 0) & (LOWER[head] != head)
    x[:, k + 2] = np.log(x[:, k + 2])
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    opens, closes = first[:-1], first[1:] - 1
    before[opens] = 0
    after[closes] = 0
    edge = np.zeros((len(lines), 3))
    edge[opens, 0] = edge[closes, 1] = edge[:, 2] = 1
    return np.hstack([x, before, after, edge]), length, first


@dataclass
class Field:
    """Weights of the good state against the bad one, and scores of the four transitions."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


class Chains:
    """Lines of several texts, longest text first, so that step ``t`` is a slice of them."""

    def __init__(self, first: np.ndarray):
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        self.first, self.last = first[:-1][order], first[1:][order] - 1
        self.active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")

    def forward_backward(self, u: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log messages of both directions, ``lines x 2``, normalised at each line."""
        alpha, beta = np.zeros((len(u), 2)), np.zeros((len(u), 2))
        for t, n in enumerate(self.active):
            at = self.first[:n] + t
            step = np.stack([np.zeros(n), u[at]], 1)
            if t:
                past = alpha[at - 1]
                step += np.logaddexp(past[:, :1] + moves[0], past[:, 1:] + moves[1])
            alpha[at] = step - np.logaddexp(step[:, 0], step[:, 1])[:, None]
            if t:
                after = self.last[:n] - t
                come = beta[after + 1] + np.stack([np.zeros(n), u[after + 1]], 1)
                back = np.logaddexp(come[:, :1] + moves[:, 0], come[:, 1:] + moves[:, 1])
                beta[after] = back - np.logaddexp(back[:, 0], back[:, 1])[:, None]
        return alpha, beta


def marginals(u: np.ndarray, moves: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alpha, beta = chains.forward_backward(u, moves)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50))), alpha, beta


def train(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 2.0) -> Field:
    """Gradient ascent (Adam) on the conditional likelihood of line labels.

    Every line of a labelled document carries its label; rare labels weigh as much in sum
    as frequent ones.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    z = (x - mean) / scale
    sizes = np.diff(first)
    y = np.repeat(label, sizes).astype(float)
    share = np.clip(label.mean(), 0.02, 0.98)
    # Each document counts as one, whatever its number of lines.
    weight = np.repeat(np.where(label == GOOD, 0.5 / share, 0.5 / (1 - share)) / sizes, sizes)
    chains = Chains(first)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    later = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        u = z @ w
        p, alpha, beta = marginals(u, moves, chains)
        grad = np.zeros_like(theta)
        grad[:-4] = z.T @ (weight * (y - p))
        if len(later):
            come = beta[later] + np.stack([np.zeros(len(later)), u[later]], 1)
            joint = alpha[later - 1][:, :, None] + moves + come[:, None, :]
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            joint /= joint.sum((1, 2), keepdims=True)
            seen = np.zeros((len(later), 2, 2))
            seen[np.arange(len(later)), y[later - 1].astype(int), y[later].astype(int)] = 1
            grad[-4:] = (weight[later, None, None] * (seen - joint)).sum(0).ravel()
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def document_margin(p: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of the lines' marginals."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    weight = np.bincount(text, length, len(first) - 1)
    plain = np.bincount(text, p, len(first) - 1) / np.maximum(np.diff(first), 1)
    mean = np.where(weight > 0, np.bincount(text, p * length, len(first) - 1) / np.maximum(weight, 1), plain)
    mean = np.clip(mean, 1e-9, 1 - 1e-9)
    return np.log(mean / (1 - mean))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit on at most ``sample_docs`` labelled documents, those with the least id hashes.

    ``labels`` is ``doc_id, label``; a document labelled more than once has its greater
    label, null labels are left out. Whole texts of the sample are read. The last fifth of
    them calibrates the score.
    """
    labels = labels.where("label IS NOT NULL AND doc_id IS NOT NULL")
    one = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = least_hashes(one, "doc_id", sample_docs, one.count())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, starts, low, high in text_slices(batch.column("text")):
                x, length, first = line_features(data, starts)
                raw = [x[a:b].astype(np.float32).tobytes() for a, b in zip(first, first[1:])]
                size = [length[a:b].astype(np.int64).tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), batch.column("label").slice(low, high - low), pa.array(raw, pa.binary()), pa.array(size, pa.binary())],
                    names=["doc_id", "label", "x", "length"],
                )

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    schema = "doc_id bigint, label int, x binary, length binary"
    found = sample.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), "text").mapInArrow(rows, schema).collect()
    found.sort(key=lambda r: (r.doc_id * 0x9E3779B1 % (1 << 32), r.doc_id, r.x))
    if not found:
        return Field(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH).astype(float) for r in found]
    length = [np.frombuffer(r.length, np.int64) for r in found]
    label = np.array([r.label for r in found])
    cut = len(found) - len(found) // 5
    ends = lambda parts: np.r_[0, np.cumsum([len(p) for p in parts])]
    field = train(np.vstack(x[:cut]), ends(x[:cut]), label[:cut])
    if cut < len(found):
        first = ends(x[cut:])
        p, _, _ = marginals(field.unary(np.vstack(x[cut:])), field.moves, Chains(first))
        margin = document_margin(p, np.concatenate(length[cut:]), first)
        field.slope, field.shift = _platt(margin, label[cut:])
    return field


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    target = np.where(y == GOOD, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        w, d = np.maximum(p * (1 - p), 1e-6), target - p
        hess = np.array([[(w * margin**2).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hess, [(d * margin).sum(), d.sum()])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = max(a + step[0], 0.01), b + step[1]
    return float(a), float(b)


def quality(docs: DataFrame, field: Field, name: str = "quality") -> DataFrame:
    """``docs`` with ``name``: a double from 0 to 1, higher for better texts.

    A null or empty text is one empty line and is scored as such. Whole texts are read,
    rows and other columns pass unchanged, an older column ``name`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)

    def start():
        learned = held.value

        def work(texts):
            out = [np.zeros(0)]
            for data, starts, _, _ in text_slices(texts):
                x, length, first = line_features(data, starts)
                p, _, _ = marginals(learned.unary(x), learned.moves, Chains(first))
                margin = learned.slope * document_margin(p, length, first) + learned.shift
                out.append(1 / (1 + np.exp(-np.clip(margin, -40, 40))))
            return {"score": pa.array(np.concatenate(out))}

        return work

    scored = annotate(docs, name, per_text(start, "struct<score:double>"))
    return scored.withColumn(name, F.col(f"{name}.score"))


def predicted(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")
