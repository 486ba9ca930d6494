"""Toxicity by a chain of linear classifiers over categories.

The categories of an ordered list are predicted one after another; the model of each sees the features of a
document and the probabilities of all earlier categories. For fitting, those probabilities come from models
that did not see the document (out of fold); for scoring, from the models fitted on all training documents.
The last link of the chain is `toxic` itself.

The label table has one toxicity column. Its finer categories are latent: toxic training documents are
grouped by the marker features they share (spherical k-means with fixed seeds), and membership of each group
is one category. A caller with real category columns passes them to `fit_chain`.

Features are counts of words without punctuation and of word beginnings (four and five bytes), hashed; the
`MARKERS` features that tell toxic from other training documents best are kept. Every fold picks its markers
and groups from the other folds alone; its groups take the numbers of those of all documents that they overlap
most. Near copies (equal least hashes of their features) share a fold.

Fitting uses at most `TRAIN_DOCUMENTS` labelled documents of at most `TRAIN_BYTES` bytes, those with the least
hash of their id; the driver gets their distinct hashed features, not their texts. Scoring uses whole texts of
any length.

Null and empty texts have no features and get the score of the intercepts. Without labels of both kinds every
score is that of the one kind there is, 0 without any. Null ids stay null. Repeated label rows count once (the
least label); of training documents that repeat an id the one with the least features counts; repeated documents
get equal rows. An empty table gives an empty result. Other columns, also such with the names of results, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.quality_crf import label_sample

TRAIN_DOCUMENTS = 4000
TRAIN_BYTES = 200_000
#: Least hashes of two orders each that near copies have in common.
BANDS = 6
MARKERS = 256
CATEGORIES = 4
FOLDS = 5
THRESHOLD = 0.15
#: Hashed features: words, beginnings of four bytes, beginnings of five bytes.
SPACE_BITS = 20
SPACE = 3 << SPACE_BITS


def hashed_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text index and feature of each occurrence."""
    doc, h, start, end = common.word_hashes(texts, common.PUNCTUATED)
    mask = np.uint64((1 << SPACE_BITS) - 1)
    out = [(doc, (h & mask).astype(np.int64))]
    if len(h):
        joined = np.frombuffer(b"\n".join(texts) + b"\n\0\0\0\0\0", np.uint8)
        offset = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=offset[1:])
        at, size = start + offset[doc], end - start
        key = np.zeros(len(h), np.uint64)
        for k in range(5):
            key = common.mix(key * np.uint64(31) + common._LOWER[joined[at + k]] + np.uint64(k << 9))
            if k >= 3:
                long = size > k
                out.append((doc[long], (key[long] & mask).astype(np.int64) + ((k - 2) << SPACE_BITS)))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def counts(texts: list[bytes], markers: np.ndarray) -> np.ndarray:
    """Damped counts of the marker features of each text (texts x markers)."""
    where = np.full(SPACE, -1, np.int32)
    where[markers] = np.arange(len(markers))
    doc, f = hashed_features(texts)
    col = where[f]
    hit = col >= 0
    n = np.bincount(doc[hit] * len(markers) + col[hit], minlength=len(texts) * len(markers))
    return np.log1p(n.reshape(len(texts), len(markers))).astype(np.float32)


def pick_markers(found: list[np.ndarray], toxic: np.ndarray, limit: int = MARKERS) -> np.ndarray:
    """Features with the highest log-likelihood ratio of being commoner in toxic documents."""
    count = lambda kind: np.bincount(np.concatenate([np.empty(0, np.int32), *(f for f, t in zip(found, toxic) if t == kind)]), minlength=SPACE).astype(float)
    pos, neg = count(1), count(0)
    n, m = toxic.sum(), len(toxic) - toxic.sum()
    some = np.flatnonzero(pos >= 2)
    if not len(some):
        return some
    p, q = pos[some], neg[some]
    both = (p + q) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (p * np.log(p / (n * both)) + np.where(q > 0, q * np.log(q / (m * both)), 0))
    g[p / n <= q / m] = 0
    order = np.lexsort((some, -g))[:limit]
    return np.sort(some[order[g[order] > 8]])


def latent_categories(x: np.ndarray, k: int = CATEGORIES) -> np.ndarray:
    """Group of each row of x, by spherical k-means from the rows farthest from one another."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = unit.mean(axis=0, keepdims=True)
    for _ in range(min(k, len(x))):
        nearest = (unit @ centre.T).max(axis=1)
        centre = np.concatenate([centre, unit[[int(np.argmin(nearest))]]])
    centre = centre[1:]
    for _ in range(20):
        group = (unit @ centre.T).argmax(axis=1)
        centre = np.stack([unit[group == g].mean(axis=0) if (group == g).any() else centre[g] for g in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return group


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01, steps: int = 90) -> np.ndarray:
    """Weights and intercept of an L2 logistic regression, by accelerated gradient steps."""
    z = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    penal = np.full(z.shape[1], l2 / np.sqrt(max(len(x), 1)))
    penal[-1] = 0
    vector = np.ones(z.shape[1]) / np.sqrt(z.shape[1])  # the Lipschitz constant, by power iteration
    for _ in range(12):
        vector = z.T @ (z @ vector)
        vector /= np.linalg.norm(vector)
    rate = 1 / (0.25 * np.linalg.norm(z @ vector) ** 2 / len(z) + penal.max())
    w = u = np.zeros(z.shape[1], np.float32)
    penal, y = penal.astype(np.float32), y.astype(np.float32)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ u, -30, 30)))
        new = u - rate * (z.T @ (p - y) / len(z) + penal * u)
        u, w = new + k / (k + 3) * (new - w), new
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(x: np.ndarray, targets: list[tuple[str, np.ndarray]], fold: np.ndarray | None = None, views: dict | None = None) -> list[tuple[str, np.ndarray]]:
    """Models of the targets in order; each sees x and the out-of-fold probabilities of the earlier ones.

    fold: number of each row's fold. views: for each fold the features and targets that the other folds gave it;
    x and targets where there are none.
    """
    fold = np.arange(len(x)) % FOLDS if fold is None else fold
    views = views or {k: (x, [y for _, y in targets]) for k in np.unique(fold)}
    chain, earlier = [], np.zeros((len(x), 0), np.float32)
    for j, (name, y) in enumerate(targets):
        chain.append((name, _logistic(np.concatenate([x, earlier], axis=1).astype(np.float32), y)))
        out = out_of_fold(j, earlier, fold, views)
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return chain


def out_of_fold(j: int, earlier: np.ndarray, fold: np.ndarray, views: dict) -> np.ndarray:
    """Probabilities of target j for each row, by a model of the rows of the other folds."""
    out = np.zeros(len(fold), np.float32)
    for k, (own, goals) in views.items():
        test = fold == k
        seen = np.concatenate([own, earlier], axis=1).astype(np.float32)
        out[test] = _apply(_logistic(seen[~test], goals[j][~test], steps=45), seen[test]) if not test.all() else goals[j].mean()
    return out


def run_chain(chain: list[tuple[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Probabilities of all targets (rows x targets)."""
    seen, out = x.astype(float), []
    for _, w in chain:
        out.append(_apply(w, seen))
        seen = np.concatenate([seen, out[-1][:, None]], axis=1)
    return np.stack(out, axis=1)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> dict:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), common.binary(batch.column(1)))
            for part in common.chunks(rows, lambda r: len(r[2] or b"")):
                doc, f = hashed_features([r[2] or b"" for r in part])
                pair, n = np.unique(doc * SPACE + f, return_counts=True)
                cut = np.searchsorted(pair, np.arange(1, len(part)) * SPACE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()),
                        pa.array([r[1] for r in part], pa.int32()),
                        pa.array([p.astype(np.int32).tobytes() for p in np.split(pair % SPACE, cut)], pa.binary()),
                        pa.array([p.astype(np.int32).tobytes() for p in np.split(n, cut)], pa.binary()),
                    ],
                    ["doc_id", "label", "f", "n"],
                )

    sample = label_sample(docs, labels, "toxic", limit).where(F.octet_length("text") <= TRAIN_BYTES)
    rows = {}
    for r in sample.mapInArrow(run, "doc_id long, label int, f binary, n binary").toLocalIterator():
        if r[0] not in rows or (r[2], r[3]) < (rows[r[0]][2], rows[r[0]][3]):
            rows[r[0]] = r
    rows = [rows[k] for k in sorted(rows)]
    return fit([np.frombuffer(r[2], np.int32) for r in rows], [np.frombuffer(r[3], np.int32) for r in rows], np.array([r[1] for r in rows], int))


def folds_of(feats: list[np.ndarray], folds: int = FOLDS) -> np.ndarray:
    """Fold of each document; documents with equal least hashes in some band share one."""
    rng = np.random.default_rng(5)
    key = rng.integers(1, 2**63, (BANDS, 2), dtype=np.uint64)
    a, b = [], []
    for pair in key:
        least = [tuple(common.mix(f.astype(np.uint64) ^ k).min() if len(f) else np.uint64(0) for k in pair) for f in feats]
        first: dict[tuple, int] = {}
        for at, band in enumerate(least):
            if (other := first.setdefault(band, at)) != at:
                a.append(at)
                b.append(other)
    group = np.arange(len(feats))
    child, root = common.forest(np.array(a, np.int64), np.array(b, np.int64)) if a else (group[:0], group[:0])
    group[child] = root
    return (common.mix(group.astype(np.uint64) + np.uint64(1)) % np.uint64(folds)).astype(int)


def _matrix(feats: list[np.ndarray], times: list[np.ndarray], markers: np.ndarray) -> np.ndarray:
    """Damped counts of the markers (documents x markers)."""
    where = np.full(SPACE, -1, np.int32)
    where[markers] = np.arange(len(markers))
    x = np.zeros((len(feats), len(markers)), np.float32)
    for k, (f, n) in enumerate(zip(feats, times)):
        col = where[f]
        x[k, col[col >= 0]] = np.log1p(n[col >= 0])
    return x


def _view(feats, times, toxic: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Markers, features and group of each document (-1: none) as some rows alone give them."""
    markers = pick_markers([feats[k] for k in rows], toxic[rows])
    x = _matrix(feats, times, markers)
    group = np.full(len(feats), -1)
    bad = rows[toxic[rows] == 1]
    if len(markers) and len(bad):
        group[bad] = latent_categories(x[bad])
    return markers, x, group


def _renamed(group: np.ndarray, like: np.ndarray) -> np.ndarray:
    """group with the numbers of the groups of like that its own overlap most, each used once."""
    both = np.zeros((CATEGORIES, CATEGORIES), int)
    some = (group >= 0) & (like >= 0)
    np.add.at(both, (group[some], like[some]), 1)
    name = np.zeros(CATEGORIES, int)
    for _ in range(CATEGORIES):
        g, to = np.unravel_index(both.argmax(), both.shape)
        name[g] = to
        both[g], both[:, to] = -1, -1
    return np.where(group >= 0, name[group], -1)


def _targets(group: np.ndarray, toxic: np.ndarray) -> list[tuple[str, np.ndarray]]:
    return [(f"category_{g}", (group == g).astype(float)) for g in range(CATEGORIES)] + [("toxic", toxic.astype(float))]


def fit(feats: list[np.ndarray], times: list[np.ndarray], toxic: np.ndarray) -> dict:
    """Model from the documents' distinct features, how often they occur, and the documents' labels."""
    if not len(toxic) or toxic.min() == toxic.max():
        return {"constant": float(toxic[0]) if len(toxic) else 0.0}
    markers, x, group = _view(feats, times, toxic, np.arange(len(feats)))
    if not len(markers):
        return {"constant": 0.0}
    fold, views = folds_of(feats), {}
    for k in np.unique(fold):
        _, own, theirs = _view(feats, times, toxic, np.flatnonzero(fold != k))
        views[k] = own, [y for _, y in _targets(_renamed(theirs, np.where(fold == k, -1, group)), toxic)]
    return {"markers": markers, "chain": fit_chain(x, _targets(group, toxic), fold, views)}


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    """Probabilities of the categories and of toxic (texts x (CATEGORIES + 1))."""
    if "constant" in model:
        return np.full((len(texts), CATEGORIES + 1), model["constant"])
    return run_chain(model["chain"], counts(texts, model["markers"]))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not toxic."""
    model = train(docs, labels)
    return common.filter_texts(docs, lambda texts: score_texts(model, texts)[:, -1] < THRESHOLD)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, toxic_probability, category_probabilities) of every row of docs."""
    model = train(docs, labels)

    def run(texts):
        p = score_texts(model, texts)
        return p[:, -1], list(p[:, :-1])

    out = common.map_texts(docs, run, "toxic_probability double, category_probabilities array<double>", ["toxic_probability", "category_probabilities"])
    return out.select("doc_id", (F.col("toxic_probability") >= THRESHOLD).cast("int").alias("toxic"), "toxic_probability", "category_probabilities")
