"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features are counts of its own bytes and those of the lines before and after. The field is
fitted on all lines of a bounded sample of labelled documents; they carry the document's label. Forward and backward passes
give each line's chance to be good; the document's score is their mean, weighted by length.

Features of the sample stay in a table in the shared folder. Each step of the fit is a job in which tasks add up the slope
over their rows; only the 52 parameters and their slope pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrays import text_chunks
from touchline.llm.hashing import RangeHasher, mixed
from touchline.llm.tables import written

#: Labelled documents that the field is fitted on, at most; taken in the order of a hash of their ids.
SAMPLE = 4000
#: Lines of a chain in fitting. A longer document makes several chains, all of which are used; together they weigh as much
#: as one of this length, so that no document outweighs many others. Scoring takes a document as one chain.
CHAIN = 400
STEPS, MEMORY, RIDGE = 60, 8, 1e-3

_CLASSES = {"letter": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\x0b\x0c\r", "symbol": b"#*$%&<>=@^~\\{}[]_+", "bar": b"|", "mark": b"!?", "stop": b".,;:", "wide": bytes(range(128, 256))}
NAMES = [*_CLASSES, "repeated words", "length", "word length", "seen before", "first", "last"]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every line; a text without a line feed is one line, also the empty text."""
    feeds = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    ends = np.sort(np.concatenate([feeds, offsets[1:]]))
    counts = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), counts)


def repeated_windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per line, the share of three-word windows starting there that stand elsewhere in the text too."""
    out = np.zeros(len(starts))
    solid = ~_GAP[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    opens, closes = edge[:-1] == 1, edge[1:] == -1
    cut = starts[(starts > 0) & (starts < len(raw))]
    cut = cut[solid[cut] & solid[cut - 1]]  # where one text ends in a word and the next begins with one
    opens[cut], closes[cut - 1] = True, True
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if len(first) < 3:
        return out
    words = RangeHasher(raw, seed=13).of(first, last)
    line = np.searchsorted(starts, first, side="right") - 1
    of = doc[line]
    inside = of[2:] == of[:-2]
    windows = mixed(words[:-2] * np.uint64(3) + mixed(words[1:-1]) * np.uint64(5) + words[2:] * np.uint64(7) + of[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[inside]
    line = line[:-2][inside]
    order = np.argsort(windows)
    twin = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][twin]] = True
    again[order[:-1][twin]] = True
    n = np.bincount(line, minlength=len(starts))
    return np.bincount(line, again, minlength=len(starts)) / np.maximum(n, 1)


def line_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A row of own, previous and next features per line."""
    length = (ends - starts).astype(np.float64)
    own = np.empty((len(starts), len(NAMES)))
    for k, chars in enumerate(_CLASSES.values()):
        member = np.zeros(256, np.int32)
        member[list(chars)] = 1
        sums = np.append(0, np.cumsum(member[raw]))
        own[:, k] = (sums[ends] - sums[starts]) / np.maximum(length, 1)
    blanks = own[:, list(_CLASSES).index("blank")] * length
    own[:, -6] = repeated_windows(raw, starts, ends, doc)
    own[:, -5] = np.log1p(length) / 5
    own[:, -4] = np.log1p(length / (blanks + 1)) / 3
    same = RangeHasher(raw, seed=12).of(starts, ends)
    order = np.lexsort((np.arange(len(doc)), same, doc))
    repeated = np.zeros(len(doc))
    repeated[order[1:]] = (same[order[1:]] == same[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (length[order[1:]] > 0)
    own[:, -3] = repeated
    edge = np.diff(doc, prepend=-1) != 0
    own[:, -2] = edge
    own[:, -1] = np.append(edge[1:], True)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = np.where(edge[1:, None], 0, own[:-1])
    after[:-1] = np.where(edge[1:, None], 0, own[1:])
    return np.concatenate([own, before, after], 1)


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # evidence for good, the last one is the bias
    moves: np.ndarray  # 2 x 2, from state to state; 0 is bad, 1 is good

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]


def marginals(evidence: np.ndarray, counts: np.ndarray, moves: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(chance of good per line, expected moves 2 x 2, log of the partition sums) of chains of ``counts`` lines each.

    Moves and logs are summed, each line by its ``weight`` if given. All chains step side by side; those that end leave.
    """
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    begin, counts = begin[order], counts[order]
    step = np.exp(moves)
    local = np.stack([np.zeros_like(evidence), evidence], 1)
    local = np.exp(local - local.max(1, keepdims=True))
    ahead, back = np.empty_like(local), np.ones_like(local)
    size = np.empty(len(evidence))
    longest = int(counts.max()) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")  # chains with more than t lines
    for t in range(longest):
        at = begin[: alive[t]] + t
        a = local[at] if t == 0 else (ahead[at - 1] @ step) * local[at]
        size[at] = a.sum(1)
        ahead[at] = a / size[at][:, None]
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        b = (local[at + 1] * back[at + 1]) @ step.T
        back[at] = b / b.sum(1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(1)
    inner = np.ones(len(evidence), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    pair = ahead[at - 1][:, :, None] * step * (local[at] * back[at])[:, None, :]
    by = np.ones(len(evidence)) if weight is None else weight
    expected = (pair / pair.sum((1, 2), keepdims=True) * by[at, None, None]).sum(0)
    return good, expected, float(by @ (np.log(size) + np.maximum(evidence, 0)))


def loss_and_slope(params: np.ndarray, z: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over chains, one label and one weight (of its lines) each; ``z``: standardised features and a one."""
    width = z.shape[1]
    y, w = np.repeat(labels.astype(np.float64), counts), np.repeat(weights, counts)
    evidence, moves = z @ params[:width], params[width:].reshape(2, 2)
    good, expected, whole = marginals(evidence, counts, moves, w)
    stays = np.bincount(labels, weights * (counts - 1), 2)  # the lines of a chain share a label
    loss = whole - (w * y) @ evidence - stays @ np.diag(moves)
    return loss, np.concatenate([z.T @ (w * (good - y)), (expected - np.diag(stays)).ravel()])


def descend(evaluate, size: int) -> np.ndarray:
    """The least point of a convex function, from zero, by limited-memory quasi-Newton steps that are halved until they help."""
    at = np.zeros(size)
    value, slope = evaluate(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        if np.abs(slope).max() < 1e-5:
            break
        way, shares = -slope, []
        for s, y in reversed(past):
            shares.append((s @ way) / (s @ y))
            way = way - shares[-1] * y
        if past:
            s, y = past[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), share in zip(past, reversed(shares)):
            way = way + (share - (y @ way) / (s @ y)) * s
        length = 1.0 if past else min(1.0, 1 / np.abs(slope).sum())
        while length > 1e-9:
            there = at + length * way
            there_value, there_slope = evaluate(there)
            if there_value <= value + 1e-4 * length * (slope @ way):
                break
            length /= 2
        else:
            break
        s, y = there - at, there_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-MEMORY:]
        at, value, slope = there, there_value, there_slope
    return at


def fit(chains: DataFrame) -> Field:
    """From rows ``(label int, weight double, x binary)``: chains of lines with features as 32-bit floats.

    Without chains, or with one label only, the field answers 0.5 or near that label's share. Sums of tasks come in no fixed
    order, so the parameters are rounded to six digits.
    """
    width = 3 * len(NAMES)

    def summed(body, columns: int) -> np.ndarray:
        """``body(x, counts, labels, weights)`` gives a row of sums per batch; a task adds its own up, the driver the tasks'."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(columns)
            for batch in batches:
                if batch.num_rows:
                    blocks = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, width) for x in batch.column("x")]
                    sums += body(np.concatenate(blocks).astype(np.float64), np.array([len(b) for b in blocks]), batch.column("label").to_numpy(), batch.column("weight").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

        return sum((np.array(r.sums) for r in chains.mapInArrow(run, "sums array<double>").collect()), np.zeros(columns))

    def moments(x, counts, _, weights):
        w = np.repeat(weights, counts)
        return np.concatenate([[w.sum()], w @ x, w @ (x * x)])

    n, *sums = summed(moments, 2 * width + 1)
    if not n:
        return Field(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)))
    mean, square = np.array(sums).reshape(2, width) / n
    mean, scale = mean.round(6), np.maximum(np.sqrt(np.maximum(square - mean**2, 0)), 1e-3).round(6)

    def evaluate(params: np.ndarray) -> tuple[float, np.ndarray]:
        def body(x, counts, labels, weights):
            z = np.append(np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1)), 1)
            loss, slope = loss_and_slope(params, z, counts, labels, weights)
            return np.append(loss, slope)

        loss, *slope = summed(body, width + 6) / n
        return loss + RIDGE / 2 * (params @ params), np.array(slope) + RIDGE * params

    params = descend(evaluate, width + 5).round(6)
    return Field(mean, scale, params[: width + 1], params[width + 1 :].reshape(2, 2))


def score_texts(field: Field, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One score per text, from 0 to 1; every line counts by its bytes, an empty one as one."""
    starts, ends, doc = lines_of(raw, offsets)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    good, _, _ = marginals(field.evidence(line_features(raw, starts, ends, doc)), counts, field.moves)
    weight = np.maximum(ends - starts, 1)
    return np.clip(np.bincount(doc, weight * good) / np.bincount(doc, weight), 0, 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on at most ``SAMPLE`` rows of ``labels`` whose label is 0 or 1 and whose document exists.

    Rows with a null id or label take no part; empty texts are one empty line; a long text gives chains of ``CHAIN`` lines.
    Features of the sample are written to the shared folder, never collected.
    """
    good = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    sample = good.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id")  # SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in text_chunks(batch, "text"):
                starts, ends, doc = lines_of(raw, offsets)
                x = line_features(raw, starts, ends, doc).astype(np.float32)
                label = batch.column("label").slice(first, end - first).to_numpy()
                at = 0
                for k, n in enumerate(np.bincount(doc, minlength=end - first)):
                    parts = [x[a : min(a + CHAIN, at + n)].tobytes() for a in range(at, at + n, CHAIN)]
                    weight = CHAIN / max(int(n), CHAIN)
                    yield pa.RecordBatch.from_arrays([pa.array([label[k]] * len(parts), pa.int32()), pa.array([weight] * len(parts)), pa.array(parts, pa.binary())], names=["label", "weight", "x"])
                    at += n

    return fit(written(rows.select("label", "text").mapInArrow(run, "label int, weight double, x binary"), "crf-sample"))


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` per row: the chance that the text is good. Null and empty texts are one empty line. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in text_chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, end - first), pa.array(score_texts(field, raw, offsets))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
