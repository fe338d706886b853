"""Quality of documents from their lines, by a linear-chain conditional random field.

Every line is good or bad. Its state depends on measures of the line and of its neighbours and on the states
beside it; forward and backward passes give the chance that a line is good, and a document's score
is the mean of these chances by the length of the lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.llm import text as words
from ladle.llm.storage import bound_batches

#: The field is fitted to so many labelled documents at most, those with the smallest hashes of their ids, of so many lines each at most.
SAMPLE_DOCS, SAMPLE_LINES = 4_000, 200
#: Weight of the squared parameters in the fit, and its steps.
RIDGE, STEPS = 1e-3, 150
#: Lines whose chances are computed side by side.
BLOCK_LINES = 1 << 18

MEASURES = ("bytes", "words", "word_bytes", "letters", "upper", "digits", "symbols", "exclaims", "bars", "stops", "other", "repeats", "runs", "known", "closed", "copied", "blank")
_N = len(MEASURES)


def _classes() -> np.ndarray:
    """The class of each byte: letters (and all bytes from 0x80), capitals, digits, symbols, ! and ?, |, . and ,, others, blanks."""
    to = np.full(256, 6, np.uint8)
    to[0x80:] = 0
    for b in range(0x80):
        c = chr(b)
        to[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "#*$%&<>{}[]=+/\\^~_@" else 4 if c in "!?" else 5 if c == "|" else 7 if c in ".," else 8 if b == 0x20 or 9 <= b <= 13 else 6
    return to


_CLASS = _classes()


def measure(column: pa.Array):
    """Yields (first row, measures of lines, lines up to each row's end, bytes of lines) of some neighbouring texts of a column at a time.

    Lines end at \\n; an empty or null text is one blank line. Capitals beyond ASCII count as letters."""
    for chunk in words.chunks(column, "lower"):
        yield chunk.first, *_measured(chunk, *_texts(column, chunk))


def _texts(column: pa.Array, chunk) -> tuple[np.ndarray, np.ndarray]:
    at, data = words.string_buffers(column.slice(chunk.first, len(chunk.docs)))
    return at - at[0], data[at[0] : at[-1]]


def _measured(chunk, at: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(buf == 10)
    # of each document its lines end at its line breaks and at its end
    n_lines = np.diff(np.searchsorted(breaks, at)) + 1
    to = np.cumsum(n_lines)
    n = int(to[-1])
    last = np.zeros(n, bool)
    last[to - 1] = True
    end, start = np.empty(n, np.int64), np.empty(n, np.int64)
    end[last], end[~last] = at[1:], breaks
    start[0], start[1:] = 0, np.where(last[:-1], end[:-1], end[:-1] + 1)
    length = end - start
    kinds, sums = _CLASS[buf], np.zeros(len(buf) + 1, np.int32)
    counts = np.empty((9, n), np.int64)
    for k in range(9):
        np.cumsum(kinds == k, out=sums[1:])
        counts[k] = sums[end] - sums[start]
    small, upper, digits, symbols, exclaims, bars, other, stops, blanks = counts
    filled = np.maximum(length - blanks, 1)
    line = np.searchsorted(end, chunk.start, side="right")
    n_words = np.bincount(line, minlength=n)
    some = np.maximum(n_words, 1)
    order = np.lexsort((chunk.hash, line))
    again = np.zeros(len(order), bool)
    again[1:] = (chunk.hash[order][1:] == chunk.hash[order][:-1]) & (line[order][1:] == line[order][:-1])
    repeats = np.bincount(line[order][again], minlength=n)
    same = np.zeros(len(order), bool)
    same[1:] = (chunk.hash[1:] == chunk.hash[:-1]) & (line[1:] == line[:-1])
    runs = np.bincount(line[same], minlength=n)
    short = np.bincount(line, weights=(chunk.end - chunk.start) <= 4, minlength=n)
    closing = np.zeros(n, bool)
    if len(buf):
        closing[length > 0] = np.isin(buf[end[length > 0] - 1], np.frombuffer(b".!?\"')", np.uint8))
    # a line that an earlier one of its document equals, by the hash of its words
    document = np.searchsorted(to, np.arange(n), side="right")
    own = np.zeros(n, np.uint64)
    np.add.at(own, line, chunk.hash * (2 * np.arange(len(chunk.hash), dtype=np.uint64) - 2 * np.searchsorted(line, line).astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((np.arange(n), own, document))
    copied = np.zeros(n, bool)
    copied[order[1:]] = (own[order][1:] == own[order][:-1]) & (document[order][1:] == document[order][:-1]) & (n_words[order][1:] > 0)
    shares = [x / filled for x in (small + upper, upper, digits, symbols, exclaims, bars, stops, other)]
    return np.column_stack([np.log1p(length), np.log1p(n_words), np.minimum(filled / some, 40), *shares, repeats / some, runs / some, short / some, closing, copied, n_words == 0]).astype(np.float32), to, length


def with_neighbours(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Measures of each line, of the line before and of the line after it (zeros at a document's ends), and whether these exist."""
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    last[to - 1] = True
    first[np.append(0, to[:-1])] = True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([x, before, after, ~first, ~last, np.ones(len(x))])


@dataclass
class Field:
    """Parameters: standardisation of the measures, a weight for each measure of a line and its neighbours that speaks for a good line,
    and one for each pair of states (bad, good) of neighbouring lines."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray

    def evidence(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, to) @ self.weights


def _passes(evidence: np.ndarray, to: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of a good line, sums over documents of the chances of neighbouring states, log of each document's normaliser).

    Documents stand side by side in the order of their number of lines; a step takes the k-th line of all that have one."""
    sizes = np.diff(np.append(0, to))
    order = np.argsort(-sizes, kind="stable")
    begin = (to - sizes)[order]
    longer = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right")
    ahead, back = np.zeros((len(evidence), 2)), np.zeros((len(evidence), 2))
    unary = np.column_stack([np.zeros(len(evidence)), evidence])
    ahead[begin] = unary[begin]
    for k in range(1, len(longer)):
        at = begin[: longer[k]] + k
        p = ahead[at - 1]
        ahead[at] = unary[at] + np.logaddexp(p[:, :1] + pairs[0], p[:, 1:] + pairs[1])
    for k in range(len(longer) - 2, -1, -1):
        at = begin[: longer[k + 1]] + k
        q = back[at + 1] + unary[at + 1]
        back[at] = np.logaddexp(q[:, :1] + pairs[:, 0], q[:, 1:] + pairs[:, 1])
    both = ahead + back
    last = np.zeros(len(evidence), bool)
    last[to - 1] = True
    norm = np.logaddexp(*ahead[to - 1].T)
    here = np.flatnonzero(~last)
    of = np.repeat(norm, sizes)[here]
    joint = np.exp(ahead[here][:, :, None] + pairs[None] + (unary + back)[here + 1][:, None, :] - of[:, None, None]).sum(axis=0) if len(here) else np.zeros((2, 2))
    return both[:, 1] - both[:, 0], joint, norm


def chances(field: Field, x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The chance of each line to be good, by forward and backward passes over the lines of its document."""
    return 1 / (1 + np.exp(-np.clip(_passes(field.evidence(x, to), to, field.pairs)[0], -500, 500)))


def fit(x: np.ndarray, to: np.ndarray, good: np.ndarray) -> Field:
    """The parameters that make the labels of the lines likeliest, a document's label being that of all its lines, under a ridge.

    What is maximised is the mean over documents of the log of the chance of all their labels together. Steps follow the gradient with the memory of the last ten (L-BFGS); without documents all weights are zero, and every chance is 0.5."""
    if not len(to):
        return Field(np.zeros(_N), np.ones(_N), np.zeros(3 * _N + 3), np.zeros((2, 2)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    sizes = np.diff(np.append(0, to))
    design = with_neighbours((x - mean) / scale, to)
    state = np.repeat(good.astype(int), sizes)
    links = np.array([(sizes - 1)[good == k].sum() for k in (0, 1)], float)
    n = len(to)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, pairs = p[:-4], p[-4:].reshape(2, 2)
        evidence = design @ w
        odds, joint, norm = _passes(evidence, to, pairs)
        chance = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        value = norm.sum() - (evidence * state).sum() - (pairs.diagonal() * links).sum()
        slope = np.append(design.T @ (chance - state), (joint - np.diag(links)).ravel())
        return value / n + RIDGE * p @ p / 2, slope / n + RIDGE * p

    p = descend(loss, np.zeros(design.shape[1] + 4))
    return Field(mean, scale, p[:-4], p[-4:].reshape(2, 2))


def descend(loss, p: np.ndarray) -> np.ndarray:
    """A minimum of a smooth convex function that gives (value, gradient)."""
    value, slope = loss(p)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        to, kept = slope.copy(), []
        for s, y in reversed(moves):
            a = s @ to / (s @ y)
            to -= a * y
            kept.append(a)
        if moves:
            s, y = moves[-1]
            to *= s @ y / (y @ y)
        for (s, y), a in zip(moves, reversed(kept)):
            to += s * (a - y @ to / (s @ y))
        step = 1.0 if moves else 1 / max(1.0, np.abs(slope).max())
        while True:
            new = p - step * to
            found, turned = loss(new)
            if found <= value - 1e-4 * step * (slope @ to) or step < 1e-10:
                break
            step /= 2
        s, y = new - p, turned - slope
        if s @ y > 1e-12:
            moves = [*moves, (s, y)][-10:]
        done = value - found < 1e-9 * max(1.0, abs(value))
        p, value, slope = new, found, turned
        if done:
            break
    return p


def _measures(batches):
    for batch in batches:
        for first, x, to, _ in measure(batch.column(2)):
            n = len(to)
            sizes = np.diff(np.append(0, to))
            cells = [x[b - s : b].tobytes() if s <= SAMPLE_LINES else None for b, s in zip(to.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(cells, pa.binary())], ["id", "good", "lines"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """A field fitted to a sample of documents with a label, bounded by SAMPLE_DOCS and SAMPLE_LINES.

    labels has (id_col, label_col), 1 for good and 0 for bad. Of several labels of an id most decide, good in a tie; null ids and labels count
    for nothing. Of documents that share an id the first text in order is used. An empty sample gives a field whose every chance is 0.5."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("good"))
    place = F.xxhash64(F.col("id").cast("string"))
    few = known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").orderBy(place, "id").limit(SAMPLE_DOCS)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id").groupBy("id", "good").agg(F.min("text").alias("text"))
    rows = sample.mapInArrow(_measures, f"id {sample.schema['id'].dataType.simpleString()}, good int, lines binary").where("lines is not null").orderBy(F.xxhash64(F.col("id").cast("string")), "id").select("good", "lines").collect()
    x = [np.frombuffer(r["lines"], np.float32).reshape(-1, _N) for r in rows]
    return fit(np.concatenate(x or [np.zeros((0, _N), np.float32)]).astype(np.float64), np.cumsum([len(m) for m in x]).astype(np.int64), np.array([r["good"] for r in rows], int))


def _judge(field: Field):
    def run(batches):
        for batch in batches:
            for first, x, to, length in measure(batch.column(1)):
                good = chances(field, x, to)
                begin, weight = np.append(0, to[:-1]), length + 1.0
                score = np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, to).astype(np.int32)), pa.array(good))
                bad = np.add.reduceat((good < 0.5).astype(np.int64), begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(to)), pa.array(score), pa.array(np.diff(np.append(0, to))), pa.array(bad), lists], ["id", "score", "n_lines", "n_bad_lines", "lines"])

    return run


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of each document: (id_col, score, n_lines, n_bad_lines, lines), a row per row of docs.

    lines has the chance of every line to be good, n_bad_lines counts those under 0.5, score is their mean, each line weighing
    its bytes and its end. A null or empty text is one blank line. Only the whole text is looked at; ids may repeat or be null."""
    bound_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(_judge(field), f"id {kind}, score double, n_lines long, n_bad_lines long, lines array<double>").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
