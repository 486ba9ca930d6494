"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line and its two neighbours; transition weights tie the
labels of adjacent lines. Only documents carry labels, so the lines of a document start with the label of
the document; after a first fit the lines of bad documents are relabelled by their marginals (each keeps at
least one bad line) and the fit goes on. The forward-backward marginals of the good label, weighted by line
length, give a document's share of good text, and a logistic curve fitted on the training documents turns
that share into the score.

Fitting uses at most `TRAIN_DOCUMENTS` labelled documents, those with the least hash of their id, and of each at
most `TRAIN_WINDOWS` windows of `WINDOW` lines, spread evenly over it. Features are computed on the executors; the
driver gets `len(NAMES)` numbers for each line of the sample. Windows are fitted as sequences of their own.
Scoring uses whole texts of any length.

Nulls and empty texts are one empty line and get a score like any other. Null ids keep their rows (held_out
false). Without labels, or with labels of one kind only, every score is that kind's (0.5 without any).
Repeated label rows count once, with the least label; of training documents that repeat an id the one with the
least features counts; repeated documents get equal rows. An empty table gives an empty result. Other columns, also
such with the names of results, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

TRAIN_DOCUMENTS = 3000
WINDOW, TRAIN_WINDOWS = 64, 16
THRESHOLD = 0.3
NAMES = ("log_words", "word_length", "upper", "digit", "symbol", "exclaim", "bar", "repeat", "copy", "stop", "empty", "short")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_SYMBOL = _table(b"#$%&*+/<=>@[\\]^_`{}~")
_STOP = _table(b".!?:;\"')")
_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of all texts: features (lines x names), bytes, and lines of each text."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
    end = np.flatnonzero(joined == 10)
    start = np.append(0, end[:-1] + 1)
    doc = np.searchsorted(offset, start, side="right") - 1

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.zeros(len(joined) + 1, np.int32)
        np.cumsum(mask[joined], out=total[1:])
        return (total[end] - total[start]) / of

    size = end - start
    least = np.maximum(size, 1)
    in_doc, h, at, until = common.word_hashes(texts)
    line = np.searchsorted(end, at + offset[in_doc])
    words = np.bincount(line, minlength=len(end))
    letters = np.bincount(line, until - at, minlength=len(end))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeat = np.bincount(line, same, minlength=len(end)) / np.maximum(words, 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    bound = np.searchsorted(line, np.arange(len(end) + 1))
    key = total[bound[1:]] - total[bound[:-1]]
    order = np.lexsort((key, doc))
    copy = np.zeros(len(end))
    twin = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (words[order][1:] > 0)
    copy[order[1:]] = twin
    upper = share(_UPPER, 1.0)
    letter = np.maximum(share(_LETTER, 1.0), 1)
    x = np.stack(
        [
            np.log1p(words) / 4,
            letters / np.maximum(words, 1) / 8,
            upper / letter,
            share(_DIGIT, least),
            share(_SYMBOL, least) * 4,
            share(_table(b"!"), least) * 8,
            share(_table(b"|"), least) * 8,
            repeat,
            copy,
            _STOP[joined[np.maximum(end - 1, 0)]] & (size > 0),
            size == 0,
            (words > 0) & (words < 4),
        ],
        axis=1,
    ).astype(np.float32)
    return x, size, np.bincount(doc, minlength=len(texts))


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after (zero at the ends of a text), and 1."""
    n = len(x)
    first = np.cumsum(lines) - lines
    before, after = np.zeros_like(x), np.zeros_like(x)
    if n:
        before[1:], after[:-1] = x[:-1], x[1:]
        before[first[lines > 0]] = 0
        after[(first + lines - 1)[lines > 0]] = 0
    return np.concatenate([x, before, after, np.ones((n, 1), np.float32)], axis=1)


def marginals(emit: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(bad) of each line, and the expected transitions (2 x 2) summed over all texts.

    emit: score of bad over good of each line; trans: 2 x 2 scores from label to label (good 0, bad 1).
    """
    n = len(emit)
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    first, count = first[order], lines[order]
    e = np.stack([np.zeros(n), np.clip(emit, -30, 30)], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    t = np.exp(trans)
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")  # texts with more lines than k
    for k in range(longest):
        at = first[: active[k]] + k
        a = e[at] if k == 0 else (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for k in range(longest - 1, 0, -1):
        at = first[: active[k]] + k
        after = beta[at] * e[at]
        b = after @ t.T
        joint = alpha[at - 1][:, :, None] * t[None] * after[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return (p[:, 1] / p.sum(axis=1)) if n else np.empty(0), pairs


def _fit_chain(x, lines, y, w, trans, steps, l2=1e-4, rate=0.15):
    """Adam on the conditional likelihood of the line labels y."""
    first = np.cumsum(lines) - lines
    inner = np.ones(len(y), bool)
    inner[first[lines > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    n = len(y)
    for k in range(1, steps + 1):
        p, pairs = marginals(x @ w, lines, trans)
        grads = [x.T @ (p - y) / n + l2 * w, (pairs - seen) / n + l2 * trans]
        for i, (theta, g) in enumerate(zip((w, trans), grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta -= rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return w, trans


def shares(p_bad: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Length-weighted marginal of good lines of each text."""
    doc = np.repeat(np.arange(len(lines)), lines)
    weight = np.maximum(size, 1).astype(float)
    return np.bincount(doc, weight * (1 - p_bad), len(lines)) / np.bincount(doc, weight, len(lines))


def fit(features: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> dict:
    """Model from the line features and line lengths of documents and the documents' labels (1 good)."""
    if not len(good) or good.min() == good.max():
        return {"constant": 0.5 if not len(good) else float(good[0])}
    lines = np.array([len(f) for f, _ in features])
    size = np.concatenate([s for _, s in features])
    x = with_neighbours(np.concatenate([f for f, _ in features]), lines).astype(float)
    doc = np.repeat(np.arange(len(lines)), lines)
    # windows, so that one long document doesn't set the number of steps
    parts = np.concatenate([[WINDOW] * (n // WINDOW) + ([n % WINDOW] if n % WINDOW else []) for n in lines]).astype(int)
    y = 1 - good[doc].astype(int)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    for steps in (60, 40, 40):
        w, trans = _fit_chain(x, parts, y, w, trans, steps)
        p, _ = marginals(x @ w, parts, trans)
        worst = np.zeros(len(lines))
        np.maximum.at(worst, doc, p)
        y = np.where(good[doc] == 1, 0, (p >= 0.5) | (p >= worst[doc])).astype(int)
    p, _ = marginals(x @ w, lines, trans)
    q = shares(p, size, lines)
    # logistic curve over the share, by Newton steps; the weak prior keeps it finite for separable labels
    z = np.stack([q, np.ones(len(q))], axis=1)
    c = np.zeros(2)
    for _ in range(50):
        f = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        step = np.linalg.solve((z.T * (f * (1 - f))) @ z + np.diag([1e-2, 1e-3]), z.T @ (good - f) - np.array([1e-2, 1e-3]) * c)
        c = c + np.clip(step, -5, 5)
    c[0] = max(c[0], 1e-3)
    return {"w": w, "trans": trans, "curve": c}


def score_texts(model: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, share of good text and number of bad lines of each text."""
    if "constant" in model:
        return np.full(len(texts), model["constant"]), np.full(len(texts), model["constant"]), np.zeros(len(texts), int)
    x, size, lines = line_features(texts)
    p, _ = marginals(with_neighbours(x, lines) @ model["w"], lines, model["trans"])
    q = shares(p, size, lines)
    bad = np.bincount(np.repeat(np.arange(len(lines)), lines), p >= 0.5, len(lines)).astype(int)
    return 1 / (1 + np.exp(-np.clip(q * model["curve"][0] + model["curve"][1], -30, 30))), q, bad


def held_out(doc_id):
    """Column: rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most limit labelled documents outside the held-out fold.

    The ids are bounded by limit, so they are broadcast; rows that repeat an id give one row.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def sampled_lines(n: int) -> np.ndarray:
    """Which of a document's n lines are used for fitting."""
    line = np.arange(n)
    return line[line // WINDOW % -(-n // (WINDOW * TRAIN_WINDOWS)) == 0]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> dict:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [t or b"" for t in common.binary(batch.column(1))]
            for rows in common.chunks(zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()), lambda r: len(r[1])):
                x, size, lines = line_features([r[1] for r in rows])
                cut = np.cumsum(lines)[:-1]
                keep = [sampled_lines(n) for n in lines]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([f[k].tobytes() for f, k in zip(np.split(x, cut), keep)], pa.binary()),
                        pa.array([s[k].astype(np.int64).tobytes() for s, k in zip(np.split(size, cut), keep)], pa.binary()),
                    ],
                    ["doc_id", "label", "x", "size"],
                )

    sample = label_sample(docs, labels, "quality", limit)
    found = {}
    for r in sample.mapInArrow(run, "doc_id long, label int, x binary, size binary").toLocalIterator():
        if r[0] not in found or (r[2], r[3]) < (found[r[0]][2], found[r[0]][3]):
            found[r[0]] = r
    rows = [found[k] for k in sorted(found)]
    feats = [(np.frombuffer(r[2], np.float32).reshape(-1, len(NAMES)), np.frombuffer(r[3], np.int64)) for r in rows]
    return fit(feats, np.array([r[1] for r in rows], int))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    model = train(docs, labels)
    return common.filter_texts(docs, lambda texts: score_texts(model, texts)[0] >= THRESHOLD)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, good_share, bad_lines) of every row of docs."""
    model = train(docs, labels)
    out = common.map_texts(docs, lambda texts: score_texts(model, texts), "score double, good_share double, bad_lines long", ["score", "good_share", "bad_lines"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "good_share", "bad_lines")
