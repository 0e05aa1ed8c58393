"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. A line's features are shares of character classes and lengths,
its own and those of the lines before and after it; neighbouring labels have weights of
their own. Forward and backward messages give each line's marginal, and the mean over the
lines, weighted by length, is the document's quality; a logistic curve fitted on the
training documents turns it into the probability of label 1.

Labels mark whole documents, so training alternates: lines of good documents are good;
those of bad ones start as bad and are then labelled by the field itself, at least one
staying bad. The field is fitted on the driver, on a bounded sample of labelled rows (the
SAMPLE_DOCS with the smallest hashes; of a text with more than SAMPLE_LINES lines a run of so
many, from a line that its checksum names); scoring runs over all rows and whole texts.

Labels, language, source and id are no features. Null or empty text: one line without
characters, scored as such. Very long texts: whole, their lines counted in pieces of PIECE
bytes with the same result, so that memory grows with the number of lines only. Null doc_id: not held out and
never a training row. Repeated rows are scored alike; of rows with one id the smallest text
is the training row. Labels with null or other values than 0 and 1 are passed over; of
several labels of an id the smaller counts. Without any usable labels of both kinds each
score is 0.5. Ties don't arise. Further columns, also of clashing names, are passed over.
Empty table: empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from leadweave.llm.common import batch_slices, pick

SAMPLE_DOCS, SAMPLE_LINES = 3000, 128  # the sample: documents, lines of each; lines are whole
PIECE = 1 << 20
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
ROUNDS, STEPS = 3, 100

_CLASSES = ("lower", "upper", "digit", "space", "high", "stop", "pipe", "mark", "symbol", "other")


def _byte_classes() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\r\x0b\x0c"), ("high", range(128, 256)), ("stop", b".,;:'\"()-"), ("pipe", b"|"), ("mark", b"!?"), ("symbol", b"#$%&*+/<=>@[\\]^_`{}~")):
        out[list(chars)] = _CLASSES.index(name)
    return out


BYTE_CLASS = _byte_classes()
OWN_FEATURES = len(_CLASSES) + 6


_WHITE = (b" ", b"\t", b"\r", b"\x0b", b"\x0c", b"\n")
_SOME_WHITE = re.compile(rb"[ \t\r\x0b\x0c\n]")


def _sums(blob: bytes, offset: int = 0, before: tuple[int, ...] = ()) -> tuple[np.ndarray, tuple[int, ...]]:
    """For each line of a blob (each ends with a newline): bytes of each class, bytes, words,
    bytes of words, words that repeat the word before and the one before that, a checksum; and
    the codes of the last line's last two words. The first line may go on with one of which
    `offset` bytes and the words `before` are known."""
    b = np.frombuffer(blob, dtype=np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.r_[0, ends[:-1] + 1]
    n, k = len(ends), len(_CLASSES)
    out = np.zeros((n, k + 6))
    kind = BYTE_CLASS[b]
    kind[ends] = k  # the line's end is no character of it
    for c in range(k):
        out[:, c] = np.add.reduceat(kind == c, starts, dtype=np.int32)
    out[:, k] = ends - starts
    inside = (kind != _CLASSES.index("space")) & (kind != k)
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, stop = edge[::2], edge[1::2]  # the blob ends outside a word
    tail = before if n == 1 else ()
    if len(begin):
        line = np.searchsorted(ends, begin)
        place = np.arange(len(b), dtype=np.int32) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(b)])).astype(np.int32)
        code = np.add.reduceat(np.where(inside, b.astype(np.int32) * (1 + place % 53 * 97), 0), begin, dtype=np.int64) * 64 + (stop - begin) % 64
        out[:, k + 1] = np.bincount(line, minlength=n)
        out[:, k + 2] = np.bincount(line, weights=stop - begin, minlength=n)
        code, line = np.r_[np.array(before, dtype=np.int64), code], np.r_[np.zeros(len(before), dtype=line.dtype), line]
        for lag in (1, 2):
            same = (code[lag:] == code[:-lag]) & (line[lag:] == line[:-lag])
            same[: max(0, len(before) - lag)] = False  # counted by the piece before
            out[:, k + 2 + lag] = np.bincount(line[lag:], weights=same, minlength=n)
        tail = tuple(code[max(0, len(code) - 2) :][line[max(0, len(code) - 2) :] == n - 1].tolist())
    at = np.arange(len(b), dtype=np.int32) - np.repeat(starts, ends - starts + 1).astype(np.int32)
    at[: ends[0] + 1] += offset % 61
    kept = b.astype(np.int32)
    kept[ends] = 0
    out[:, k + 5] = np.add.reduceat(kept * (1 + at % 61), starts, dtype=np.int64)
    return out, tail


def _word_sums(word: bytes, offset: int) -> tuple[np.ndarray, int]:
    """_sums of a line that is one long word, and the word's code; offset: bytes of the line before it."""
    k = len(_CLASSES)
    out, total = np.zeros(k + 6), 0
    for at in range(0, len(word), PIECE):
        b = np.frombuffer(word, dtype=np.uint8, count=min(PIECE, len(word) - at), offset=at)
        place = np.arange(at, at + len(b), dtype=np.int64)
        out[:k] += np.bincount(BYTE_CLASS[b], minlength=k)[:k]
        out[k + 5] += int((b * (1 + (place + offset) % 61)).sum())
        total += int((b * (1 + place % 53 * 97)).sum())
    out[k], out[k + 1], out[k + 2] = len(word), 1, len(word)
    return out, total * 64 + len(word) % 64


def _long_sums(text: bytes) -> np.ndarray:
    """_sums of one long text, piece by piece, and the same numbers. A piece ends after its last
    white space; a word without any as long as a piece is one of its own. What a line needs to
    know of the pieces before (its length so far, its last two words) is carried on."""
    parts, at, offset, before = [], 0, 0, ()
    while at <= len(text):
        end = len(text) if at + PIECE > len(text) else max(text.rfind(c, at, at + PIECE) for c in _WHITE) + 1
        if end > at or at == len(text):
            x, tail = _sums(text[at:end] + b"\n", offset, before)  # a piece that ends with a line opens the next one
        else:
            m = _SOME_WHITE.search(text, at)
            end = m.start() if m else len(text)
            x, code = _word_sums(text[at:end], offset)
            x = x[None, :]
            x[0, -3:-1] = [len(before) >= lag and before[-lag] == code for lag in (1, 2)]
            tail = (*before, code)[-2:]
        if parts:  # the piece goes on with the line that the last one left open
            parts[-1][-1] += x[0]
            offset = int(x[0, len(_CLASSES)]) + offset if len(x) == 1 else int(x[-1, len(_CLASSES)])
            x = x[1:]
        else:
            offset = int(x[-1, len(_CLASSES)])
        if len(x):
            parts.append(x)
        before, at = tail, end
        if end >= len(text):
            break
    return np.vstack(parts)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, their weights (length and 1), and lines of each text."""
    parts, small = [], []
    for t in texts:
        if len(t) > PIECE:
            if small:
                parts.append(_sums(b"\n".join(small) + b"\n")[0])
                small = []
            parts.append(_long_sums(t))
        else:
            small.append(t)
    if small:
        parts.append(_sums(b"\n".join(small) + b"\n")[0])
    sums, k = np.vstack(parts) if parts else np.zeros((0, len(_CLASSES) + 6)), len(_CLASSES)
    size, words, total = sums[:, k], np.maximum(sums[:, k + 1], 1), sums[:, k + 5]
    x = np.zeros((len(sums), OWN_FEATURES))
    x[:, :k] = sums[:, :k] / np.maximum(size, 1)[:, None]
    x[:, -6], x[:, -5] = sums[:, k + 3] / words, sums[:, k + 4] / words
    x[:, -4] = np.minimum(sums[:, k + 2] / words, 20) / 20
    x[:, -3] = np.log1p(size) / 10
    x[:, -2] = size == 0
    # a line of the same length and checksum as the one before it most likely repeats it
    x[1:, -1] = (total[1:] == total[:-1]) & (size[1:] == size[:-1]) & (size[1:] > 0)
    each = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    x[np.cumsum(each) - each, -1] = 0
    return x, size + 1, each


def sample_of(text: bytes) -> bytes:
    """The whole text, or SAMPLE_LINES of its lines from one that its checksum names."""
    lines = text.split(b"\n")
    if len(lines) > SAMPLE_LINES:
        at = zlib.crc32(text) % (len(lines) - SAMPLE_LINES + 1)
        lines = lines[at : at + SAMPLE_LINES]
    return b"\n".join(lines)


def with_neighbours(x: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features and a constant; zeros beyond a text's ends."""
    first = np.cumsum(each) - each
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first] = 0
    after[first + each - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


@dataclass
class Field:
    """weights: of a line's features for good; moves: [label before, label] (0 bad, 1 good)."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 0.0
    shift: float = 0.0

    def messages(self, e: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good from the left with the line itself, and from the right."""
        order = np.argsort(-each, kind="stable")
        n, first = each[order], (np.cumsum(each) - each)[order]
        t, left, right = self.moves, e.copy(), np.zeros_like(e)
        for k in range(1, int(n[0]) if len(n) else 0):
            at = first[: np.searchsorted(-n, -k, side="left")] + k
            f = left[at - 1]
            left[at] = e[at] + np.logaddexp(f + t[1, 1], t[0, 1]) - np.logaddexp(f + t[1, 0], t[0, 0])
        for k in range(int(n[0]) - 2 if len(n) else -1, -1, -1):
            at = first[: np.searchsorted(-n, -(k + 1), side="left")] + k
            g = e[at + 1] + right[at + 1]
            right[at] = np.logaddexp(g + t[1, 1], t[1, 0]) - np.logaddexp(g + t[0, 1], t[0, 0])
        return left, right

    def marginals(self, x: np.ndarray, each: np.ndarray) -> np.ndarray:
        left, right = self.messages(x @ self.weights, each)
        return _sigmoid(left + right)

    def quality(self, x: np.ndarray, weight: np.ndarray, each: np.ndarray) -> np.ndarray:
        """Length-weighted mean of a text's marginals."""
        first = np.cumsum(each) - each
        return np.add.reduceat(self.marginals(x, each) * weight, first) / np.add.reduceat(weight, first)

    def score(self, quality: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * quality + self.shift)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit_field(x: np.ndarray, each: np.ndarray, y: np.ndarray, field: Field, steps: int) -> Field:
    """Raises the log-likelihood of line labels y by Adam, with a small ridge."""
    pairs = np.flatnonzero(np.r_[np.repeat(np.arange(len(each)), each)[1:] == np.repeat(np.arange(len(each)), each)[:-1], False])
    theta, m, v = np.r_[field.weights, field.moves.ravel()], 0.0, 0.0
    seen = np.bincount(2 * y[pairs] + y[pairs + 1], minlength=4)
    for step in range(1, steps + 1):
        f = Field(theta[:-4], theta[-4:].reshape(2, 2))
        e = x @ f.weights
        left, right = f.messages(e, each)
        g = x.T @ (y - _sigmoid(left + right)) / len(x)
        a, b = left[pairs], e[pairs + 1] + right[pairs + 1]
        joint = np.stack([np.full(len(a), f.moves[0, 0]), f.moves[0, 1] + b, f.moves[1, 0] + a, f.moves[1, 1] + a + b])
        joint = np.exp(joint - joint.max(axis=0, initial=-1e9))
        expected = (joint / joint.sum(axis=0)).sum(axis=1)
        g = np.r_[g, (seen - expected) / len(x)] - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def train(x: np.ndarray, weight: np.ndarray, each: np.ndarray, label: np.ndarray) -> Field:
    """A field and its curve from lines (with neighbours) of documents labelled 0 and 1."""
    field = Field(np.zeros(x.shape[1] if x.ndim == 2 else 1), np.zeros((2, 2)))
    if len(set(label.tolist())) < 2:
        return field
    owner = np.repeat(np.arange(len(each)), each)
    y = label[owner].astype(np.int64)
    for r in range(ROUNDS):
        field = _fit_field(x, each, y, field, STEPS)
        if r + 1 < ROUNDS:
            p = field.marginals(x, each)
            worst = np.full(len(each), np.inf)
            np.minimum.at(worst, owner, p)
            y = np.where(label[owner] == 1, 1, (p > 0.5) & (p > worst[owner])).astype(np.int64)
    q = field.quality(x, weight, each)
    # a ridge keeps the curve finite where the two kinds don't overlap
    w, z = np.zeros(2), np.stack([q, np.ones(len(q))], axis=1)
    for _ in range(50):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(2)
        w = w + np.linalg.solve(h, z.T @ (label - p) - 1e-1 * w)
    field.slope, field.shift = float(w[0]), float(w[1])
    return field


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, quality, text of the sample, a row for each id: labelled rows that are not held out."""
    usable = pick(labels, "doc_id", "quality", types={"quality": IntegerType()}).filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    usable = usable.filter(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(chosen)  # at most `sample` rows
    rows = pick(docs, "doc_id", "text").join(chosen, "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Field:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_slices(batches, 2, PIECE):
            x, weight, each = line_features([sample_of(t) for t in b.column(2).cast(pa.binary()).to_pylist()])
            at = np.r_[0, np.cumsum(each)]
            parts = [pa.array([z[at[j] : at[j + 1]].astype(np.float32).tobytes() for j in range(len(each))], pa.binary()) for z in (x, weight)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *parts], names=["doc_id", "quality", "x", "weight"])

    # at most `sample` rows of SAMPLE_LINES lines
    rows = training_rows(docs, labels, sample).mapInArrow(features, "doc_id long, quality int, x binary, weight binary").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    if not rows:
        return Field(np.zeros(3 * OWN_FEATURES + 1), np.zeros((2, 2)))
    weight = [np.frombuffer(r.weight, dtype=np.float32) for r in rows]
    each = np.array([len(w) for w in weight])
    x = np.frombuffer(b"".join(r.x for r in rows), dtype=np.float32).reshape(-1, OWN_FEATURES).astype(float)
    return train(with_neighbours(x, each), np.concatenate(weight).astype(float), each, np.array([r.quality for r in rows]))


def text_scores(field: Field, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, lines, and lines more likely bad of each text."""
    x, weight, each = line_features(texts)
    x, first = with_neighbours(x, each), np.cumsum(each) - each
    p = field.marginals(x, each)
    q = np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)
    return field.score(q), each, np.add.reduceat((p < 0.5).astype(np.int64), first)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score, predicted, and lines labelled bad, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_slices(batches, 2, PIECE):
            s, each, bad = text_scores(field, [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()])
            cols = [b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(each), pa.array(bad)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "n_lines", "n_bad_lines"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    d = pick(docs, "doc_id", "text").select("doc_id", held.alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_bad_lines long")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
