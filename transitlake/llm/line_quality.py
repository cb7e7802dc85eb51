"""Quality of documents from a linear-chain conditional random field over their lines.

Each line is good or bad. Its evidence is a linear function of what the line, the line
before and the line behind look like; neighbouring labels are tied by a 2 x 2 table. A
line's probability of being good is its forward-backward marginal, and a document's quality
is the mean of its lines' marginals, weighted by length. Labels are known per document only:
for learning, every line has the label of its document.

The recursions of all documents of a batch run together: products of 2 x 2 matrices are
associative, so a scan by doubling needs log2(longest document) array steps, however long a
document is, and a document's first matrix, whose rows are equal, forgets what came before.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import bounded_batches, stored

#: labelled documents per label, lines per document and lines in all that the fit may take
SAMPLE_DOCS, SAMPLE_DOC_LINES, SAMPLE_LINES = 4000, 2000, 200_000
#: features of one line; the same again of the line before and the line behind
FEATURES = [
    "bias", "no_words", "few_words", "many_words", "symbols", "any_symbols", "marks", "any_marks", "capitals", "mostly_capitals",
    "digits", "beyond_ascii", "adjacent_equal", "any_adjacent", "few_different", "seen_before", "long_words", "no_stop", "length",
]
WIDTH = len(FEATURES)
#: evidence of one line and table entries stay within this many nats
REACH = 30.0
_SYMBOLS, _MARKS = b"#$%&*<=>@\\^_`{|}~+", b"!?"
_CAPITALS, _SMALL, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_BEYOND = bytes(range(128, 256))


def described(raw: bytes) -> tuple[list[tuple], list[int]]:
    """Features and length of each line of a text; an empty text has one empty line."""
    rows, lengths, seen = [], [], set()
    for line in raw.split(b"\n"):
        size = len(line)
        words = line.split()
        n = len(words)
        lengths.append(size + 1)
        if not n:
            rows.append((1.0, 1.0) + (0.0,) * (WIDTH - 2))
            continue
        symbols = size - len(line.translate(None, _SYMBOLS))
        marks = size - len(line.translate(None, _MARKS))
        capitals = size - len(line.translate(None, _CAPITALS))
        small = size - len(line.translate(None, _SMALL))
        digits = size - len(line.translate(None, _DIGITS))
        beyond = size - len(line.translate(None, _BEYOND))
        adjacent = sum(map(eq, words, words[1:]))
        again = line in seen
        seen.add(line)
        letters = capitals + small
        rows.append((
            1.0, 0.0, float(n < 4), float(n > 40), min(symbols / n, 3.0), float(5 * symbols > n), min(marks / n, 3.0), float(5 * marks > n),
            capitals / letters if letters else 0.0, float(2 * capitals > letters), digits / size, beyond / size,
            adjacent / n, float(10 * adjacent > n), 1.0 - len(set(words)) / n, float(again),
            float(size > 14 * n), float(line[-1] not in b".!?:;"), min(size, 2000) / 1000,
        ))
    return rows, lengths


def matrices(evidence: np.ndarray, first: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Per line exp(tie + evidence) as (bad, good) x (bad, good), rows by the label before; a
    document's first line has no label before, so its rows are equal."""
    good = np.exp(np.clip(evidence, -REACH, REACH))
    out = np.exp(np.clip(ties, -REACH, REACH))[None].repeat(len(good), 0)
    out[first] = 1.0
    out[:, :, 1] *= good[:, None]
    return out


def scanned(m: np.ndarray, longest: int) -> np.ndarray:
    """Products of each matrix with at least ``longest - 1`` before it, each scaled."""
    m, reach = m / m.max(axis=(1, 2), keepdims=True), 1
    while reach < longest and reach < len(m):
        m = np.concatenate([m[:reach], m[:-reach] @ m[reach:]])
        m /= m.max(axis=(1, 2), keepdims=True)
        reach *= 2
    return m


def marginals(evidence: np.ndarray, starts: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, the joint table with the line before (0 for first lines), and
    the log of the normaliser's part of every line. ``starts``: first line of each document."""
    n = len(evidence)
    first = np.zeros(n, bool)
    first[starts] = True
    longest = int(np.diff(np.append(starts, n)).max())
    m = matrices(evidence, first, ties)
    ahead = scanned(m, longest).sum(axis=1)
    ahead /= ahead.sum(axis=1, keepdims=True)
    # behind line t: the product of the matrices after it, up to its document's last
    after = np.concatenate([m[1:], np.ones((1, 2, 2))])
    after[np.append(first[1:], True)] = 1.0
    behind = scanned(after[::-1].transpose(0, 2, 1), longest)[::-1].transpose(0, 2, 1).sum(axis=2)
    both = ahead * behind
    good = both[:, 1] / both.sum(axis=1)
    before = np.concatenate([np.ones((1, 2)), ahead[:-1]])
    before[first] = 0.5
    step = before[:, :, None] * m
    normal = np.log(step.sum(axis=(1, 2)))
    joint = step * behind[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    joint[first] = 0
    return good, joint, normal


def evidence_of(lines: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted features of each line and its neighbours; documents do not see each other."""
    own, before, behind = (lines @ w for w in weights.reshape(3, WIDTH))
    out = own.copy()
    inner = np.ones(len(lines), bool)
    inner[starts] = False
    out[1:] += np.where(inner[1:], before[:-1], 0)
    out[:-1] += np.where(inner[1:], behind[1:], 0)
    return out


def objective(point: np.ndarray, lines: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray, penalty: float):
    """Negative penalised log-likelihood of the labels and its gradient. ``label`` and
    ``weight`` per line."""
    weights, ties = point[:-4], point[-4:].reshape(2, 2)
    evidence = np.clip(evidence_of(lines, starts, weights), -REACH, REACH)
    good, joint, normal = marginals(evidence, starts, ties)
    inner = np.ones(len(lines), bool)
    inner[starts] = False
    one = label.astype(int)
    told = np.where(inner, np.clip(ties, -REACH, REACH)[one, one], 0.0) + label * evidence
    loss = float((weight * (normal - told)).sum())
    off = weight * (good - label)
    slope = np.zeros((3, WIDTH))
    slope[0] = off @ lines
    slope[1] = (off[1:] * inner[1:]) @ lines[:-1]
    slope[2] = (off[:-1] * inner[1:]) @ lines[1:]
    tie = (weight[:, None, None] * joint).sum(axis=0)
    for c in (0, 1):
        tie[c, c] -= weight[inner & (one == c)].sum()
    # the bias is not held back, so that rare labels keep their share
    held = np.ones(len(point))
    held[0] = 0.0
    return loss + 0.5 * penalty * float((held * point * point).sum()), np.concatenate([slope.ravel(), tie.ravel()]) + penalty * held * point


def minimised(function, point: np.ndarray, rounds: int = 120, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving."""
    value, slope = function(point)
    kept: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, alphas = -slope, []
        for s, y, scale in reversed(kept):
            alphas.append(scale * float(s @ direction))
            direction = direction - alphas[-1] * y
        if kept:
            s, y, _ = kept[-1]
            direction = direction * float(s @ y) / float(y @ y)
        else:
            direction = direction / max(1.0, float(np.linalg.norm(slope)))
        for (s, y, scale), a in zip(kept, reversed(alphas)):
            direction = direction + s * (a - scale * float(y @ direction))
        downhill, step = float(slope @ direction), 1.0
        while True:
            moved = point + step * direction
            new, new_slope = function(moved)
            if new <= value + 1e-4 * step * downhill or step < 1e-9:
                break
            step /= 2
        s, y = moved - point, new_slope - slope
        done = value - new <= 1e-7 * max(1.0, abs(value))
        if float(s @ y) > 1e-12:
            kept = [*kept, (s, y, 1 / float(s @ y))][-memory:]
        point, value, slope = moved, new, new_slope
        if done:
            break
    return point


def fit_lines(documents: list[tuple[np.ndarray, int, float]], penalty: float = 1.0) -> np.ndarray:
    """Weights and ties from (lines, label, weight) of documents; all 0 without any."""
    point = np.zeros(3 * WIDTH + 4)
    if not documents:
        return point
    lines = np.concatenate([d[0] for d in documents]).astype(np.float64)
    sizes = np.array([len(d[0]) for d in documents])
    starts = np.cumsum(sizes) - sizes
    label = np.repeat([float(d[1]) for d in documents], sizes)
    weight = np.repeat([d[2] for d in documents], sizes)
    return minimised(lambda p: objective(p, lines, starts, label, weight, penalty), point)


def scores_of(texts: list[bytes], model: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each text."""
    rows, lengths, starts = [], [], []
    for t in texts:
        r, n = described(t)
        starts.append(len(lengths))
        rows.append(np.array(r, np.float32))
        lengths += n
    starts = np.array(starts)
    evidence = evidence_of(np.concatenate(rows), starts, model[:-4])
    good, _, _ = marginals(evidence, starts, model[-4:].reshape(2, 2))
    size = np.array(lengths, np.float64)
    return np.clip(np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts), 0.0, 1.0)


def chosen(labels: DataFrame, id: str, label: str, learned: Column, most: int) -> DataFrame:
    """``_id, _label, _weight``: up to ``most`` labelled ids of each label, by hash; the
    weights restore the labels' shares. Of several labels of an id the worst counts."""
    told = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & learned)
    told = told.groupBy(F.col(id).alias("_id")).agg((F.min(label) >= 1).cast("int").alias("_label"))
    told = stored(told.withColumn("_hash", F.xxhash64("_id")))
    every = told.agg(F.count("*")).scalar()
    out = None
    for value in (0, 1):
        mine = told.where(F.col("_label") == value)
        # of n ids with this label ``most`` at most are taken: each stands for n / taken
        held = mine.agg(F.count("*")).scalar()
        part = mine.orderBy("_hash", "_id").limit(most).select("_id", "_label", "_hash", (held / F.least(held, F.lit(most)) / every).alias("_weight"))
        out = part if out is None else out.unionByName(part)
    return out


def sample(docs: DataFrame, picked: DataFrame, id: str, text: str) -> list[tuple[np.ndarray, int, float]]:
    """Lines, label and weight of the picked documents, ``SAMPLE_LINES`` at most. ``picked``
    has ``2 * SAMPLE_DOCS`` rows at most, and so is broadcast; texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(described(t or b"")[0], np.float32) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            small = [f if len(f) <= SAMPLE_DOC_LINES else None for f in found]
            columns = [batch.column(1), batch.column(2), batch.column(3), pa.array([len(f) for f in found], pa.int64()), pa.array([None if f is None else f.tobytes() for f in small], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "weight", "hash", "n", "lines"])

    held = docs.select(F.col(id).alias("_own"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_own") == F.col("_id"))
    described_rows = held.select("_text", "_label", "_weight", "_hash").mapInArrow(run, "label int, weight double, hash long, n long, lines binary")
    rows = stored(described_rows.where("lines is not null"))
    # repeated ids: no more rows than ids were asked for
    first = rows.orderBy("hash", "n", "lines").limit(2 * SAMPLE_DOCS)
    out, lines = [], 0
    for r in first.toLocalIterator():
        lines += r["n"]
        if lines > SAMPLE_LINES:
            break
        out.append((np.frombuffer(r["lines"], np.float32).reshape(-1, WIDTH), r["label"], r["weight"]))
    scale = sum(w for _, _, w in out) / max(len(out), 1)
    return [(a, y, w / scale) for a, y, w in out]


def score(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    folds: int = 5, cutoff: float = 0.3, penalty: float = 1.0,
) -> DataFrame:
    """One row per document: ``id, held_out, score, predicted``.

    ``held_out``: CRC-32 of the id's text modulo ``folds`` is 0 (a null id counts as empty
    text); labels of such ids are not looked at. A null or empty text is one empty line.
    Repeated rows are scored alike. Scoring is map-only and covers whole texts; the fit takes
    up to ``SAMPLE_DOCS`` labelled documents of each label, those of over
    ``SAMPLE_DOC_LINES`` lines left out, and up to ``SAMPLE_LINES`` lines. Without labels the
    score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    part = F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % folds
    picked = chosen(labels, id, label, part != 0, SAMPLE_DOCS)
    model = fit_lines(sample(docs, picked, id, text), penalty)
    kind = docs.select(F.col(id)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = scores_of([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["id", "held_out", "score"])

    narrow = docs.select(F.col(id).alias("id"), (part == 0).alias("held_out"), F.col(text).alias("text"))
    scored = narrow.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id), "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
