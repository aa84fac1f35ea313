"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Potentials come from features of the line and of its neighbours and from the pair of labels
of adjoining lines; forward-backward gives each line's marginal, and the length-weighted mean of the marginals, put on
a fitted scale, is the document's score.

Only documents are labelled. Fitting starts from lines that have their document's label, fits the field, takes the lines of a
bad document that the field holds good as good (and the reverse), and fits again; last, the scale is fitted to the labels.
Features are shapes of characters and words, the same in any language: no language, source or id is looked at.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole_row

SAMPLE = 4000  # labelled documents that are fitted at most: those of smallest hash
SAMPLE_LINES = 400_000  # lines that are fitted at most, of whole documents in that order
LONGEST = 1000  # lines of a document that is fitted; longer ones are scored like others
ROUNDS, STEPS, RATE, DECAY = 3, 150, 0.08, 1e-3
_OWN = 17  # features of a line by itself
_CLASSES = 7  # other, upper, lower, digit, space, stop, symbol


@cache
def _char_classes() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        k = unicodedata.category(chr(c))
        kinds[c] = 1 if k == "Lu" else 2 if k[0] in "LM" else 3 if k[0] == "N" else 4 if k[0] == "Z" or 9 <= c <= 13 else 6 if k[0] in "SP" else 0
    for c in ".,;:?'\"()-¿¡«»“”‘’–—":
        kinds[ord(c)] = 5
    kinds[0x3000:0xFB00] = 2
    return kinds


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line of the whole text, and the lines' lengths. An empty text has no line."""
    if not text:
        return np.empty((0, 3 * _OWN), np.float32), np.empty(0, np.float32)
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _char_classes()[codes]
    ends = np.concatenate((np.flatnonzero(codes == 10), [len(codes)]))
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = (ends - starts).astype(np.float32)
    counts = np.empty((len(lines), _CLASSES), np.float32)
    for k in range(_CLASSES):
        total = np.concatenate(([0], np.cumsum(kinds == k)))
        counts[:, k] = total[ends] - total[starts]
    symbol_end = np.concatenate(((kinds[:-1] == 6) & (kinds[1:] == 4), [False])) | np.concatenate(((kinds[:-1] == 6) & False, [bool(kinds[-1] == 6)]))
    total = np.concatenate(([0], np.cumsum(symbol_end)))
    symbol_words = total[ends] - total[starts]
    words = [line.split() for line in lines]
    n = np.array([len(w) for w in words], np.float32)
    twice = np.array([sum(map(str.__eq__, w, w[1:])) for w in words], np.float32)
    kinds_of = np.array([len(set(w)) for w in words], np.float32)
    times = Counter(lines)
    one, some = np.maximum(length, 1), np.maximum(n, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    own = np.empty((len(lines), _OWN), np.float32)
    own[:, 0] = np.log1p(length) / 5
    own[:, 1] = counts[:, 1] / letters
    own[:, 2] = (counts[:, 1] / letters > 0.6) & (counts[:, 1] > 3)
    own[:, 3] = counts[:, 3] / one
    own[:, 4] = counts[:, 6] / one
    own[:, 5] = np.minimum(symbol_words / some, 1)
    own[:, 6] = counts[:, 5] / one
    own[:, 7] = np.log1p(n) / 4
    own[:, 8] = np.minimum(length / some / 10, 3)
    own[:, 9] = twice / some
    own[:, 10] = twice / some > 0.3
    own[:, 11] = 1 - kinds_of / some
    own[:, 12] = symbol_words / some > 0.25
    own[:, 13] = [line.rstrip()[-1:] in (".", "?", "!") for line in lines]
    own[:, 14] = [line[:1].isupper() for line in lines]
    own[:, 15] = [times[line] > 1 for line in lines]
    own[:, 16] = length == 0
    zero = np.zeros((1, _OWN), np.float32)
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])]), length


@dataclass
class Field:
    """weights of good against bad by feature, with the bias last; pair[i, j] for label i before label j; scale, offset."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    pair: np.ndarray
    scale: float = 1.0
    offset: float = 0.0

    def scores_of(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.spread).clip(-6, 6) @ self.weights[:-1] + self.weights[-1]

    def marginals(self, unary: np.ndarray) -> np.ndarray:
        """P(good) of each line of one document, by forward-backward."""
        n = len(unary)
        if n < 2:
            return 1 / (1 + np.exp(-unary))
        pair = np.exp(self.pair - self.pair.max()).tolist()
        (p00, p01), (p10, p11) = pair
        good = (1 / (1 + np.exp(-unary))).tolist()
        forward, a, b = [], 1 - good[0], good[0]
        forward.append((a, b))
        for g in good[1:]:
            a, b = (a * p00 + b * p10) * (1 - g), (a * p01 + b * p11) * g
            s = a + b or 1.0
            a, b = a / s, b / s
            forward.append((a, b))
        out, x, y = np.empty(n), 1.0, 1.0
        for i in range(n - 1, -1, -1):
            a, b = forward[i]
            s = a * x + b * y
            out[i] = b * y / s if s else 0.5
            g = good[i]
            x, y = (p00 * (1 - g) * x + p01 * g * y), (p10 * (1 - g) * x + p11 * g * y)
            s = x + y or 1.0
            x, y = x / s, y / s
        return out

    def share(self, text: str) -> float:
        """Length-weighted mean of the lines' marginals; an empty text has the middle one."""
        features, length = line_features(text)
        if not len(features):
            return 0.5
        good = self.marginals(self.scores_of(features))
        return float(good @ (length + 1) / (length.sum() + len(length)))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.scale * self.share(text) + self.offset))))


class _Chains:
    """Documents' lines, one document after another. Steps go over all documents that are long enough at once, so that
    memory is that of the lines, however unlike their numbers are."""

    def __init__(self, sizes: list[int]):
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(-self.sizes, kind="stable")
        self.deep = self.starts[order]
        top = int(self.sizes.max(initial=0))
        self.active = np.searchsorted(-self.sizes[order], -np.arange(top), "left")  # documents of over t lines
        self.follows = np.ones(int(self.sizes.sum()), bool)  # lines with one before them
        self.follows[self.starts] = False

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.empty(0)

    def expected(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all lines, and the expected counts of adjoining labels. No document is without lines."""
        p = np.exp(pair - pair.max())
        node = np.stack([1 / (1 + np.exp(unary)), 1 / (1 + np.exp(-unary))], axis=1)
        f, b = node.copy(), np.ones_like(node)
        for t in range(1, len(self.active)):
            at = self.deep[: self.active[t]] + t
            x = (f[at - 1] @ p) * node[at]
            f[at] = x / x.sum(axis=1, keepdims=True)
        for t in range(len(self.active) - 1, 0, -1):
            at = self.deep[: self.active[t]] + t
            x = (node[at] * b[at]) @ p.T
            b[at - 1] = x / x.sum(axis=1, keepdims=True)
        m = f * b
        at = np.flatnonzero(self.follows)
        both = f[at - 1][:, :, None] * p * (node[at] * b[at])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        return m[:, 1] / m.sum(axis=1), both.sum(axis=0)


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray) -> Field:
    """A field from documents' line features and their labels (1 good, 0 bad)."""
    kept = [i for i, f in enumerate(features) if len(f)]
    features, lengths, labels = [features[i] for i in kept], [lengths[i] for i in kept], labels[kept].astype(float)
    width = 3 * _OWN
    if not kept or labels.min() == labels.max():  # nothing to tell apart
        lean = 0.0 if not kept else 2.0 * labels[0] - 1
        return Field(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)), 0.0, lean)
    order = np.argsort([len(f) for f in features], kind="stable")  # batches of like lengths
    batches = [order[i : i + 256] for i in range(0, len(order), 256)]
    lines_in = sum(map(len, features))
    mean = sum(f.sum(axis=0, dtype=np.float64) for f in features) / lines_in
    spread = np.sqrt(sum(((f - mean) ** 2).sum(axis=0) for f in features) / lines_in) + 1e-3
    weigh = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    data = []
    for rows in batches:
        x = np.concatenate([((features[i] - mean) / spread).clip(-6, 6).astype(np.float32) for i in rows])
        chains = _Chains([len(features[i]) for i in rows])
        data.append((rows, x, chains, np.concatenate([lengths[i] + 1.0 for i in rows]), np.repeat(labels[rows], chains.sizes)))
    weights, pair = np.zeros(width + 1), np.zeros((2, 2))
    lines = [own.copy() for *_, own in data]
    for _ in range(ROUNDS):
        theta = np.concatenate([weights, pair.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            weights, pair = theta[:-4], theta[-4:].reshape(2, 2)
            grad = np.zeros_like(theta)
            n = 0.0
            k = step % len(data)
            for (rows, x, chains, _, _), y in [(data[k], lines[k]), (data[-1 - k], lines[-1 - k])]:
                good, both = chains.expected(x @ weights[:-1] + weights[-1], pair)
                gap = (y - good) * np.repeat(weigh[rows], chains.sizes)
                grad[:width] += gap @ x
                grad[width] += gap.sum()
                b = np.flatnonzero(chains.follows)
                first, second = y[b - 1] > 0.5, y[b] > 0.5
                seen = np.array([[(~first & ~second).sum(), (~first & second).sum()], [(first & ~second).sum(), (first & second).sum()]], float)
                grad[-4:] += (seen - both).ravel()
                n += len(y)
            grad = grad / n - DECAY * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, pair = theta[:-4], theta[-4:].reshape(2, 2)
        shares = np.empty(len(labels))
        for j, (rows, x, chains, length, own) in enumerate(data):
            good, _ = chains.expected(x @ weights[:-1] + weights[-1], pair)
            shares[rows] = chains.sums(good * length) / chains.sums(length)
            sure = np.where(good > 0.9, 1.0, np.where(good < 0.1, 0.0, own))
            # a document keeps at least its most typical line
            typical = np.where(own > 0, good, 1 - good) * length
            best = [a + int(np.argmax(typical[a : a + size])) for a, size in zip(chains.starts.tolist(), chains.sizes.tolist())]
            sure[best] = labels[rows]
            lines[j] = sure
    scale, offset = _scaled(shares, labels)
    return Field(mean, spread, weights, pair, scale, offset)


def _scaled(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset on a share: the cut that errs least, in the widest gap, and the steepness that fits best there."""
    order = np.argsort(shares, kind="stable")
    s, y = shares[order], labels[order]
    wrong = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    best = np.flatnonzero(wrong <= wrong.min() + 0.002 * len(s))  # but for a few odd labels
    edge = np.concatenate(([0.0], s, [1.0]))
    k = int(best[np.argmax(edge[best + 1] - edge[best])])  # the widest gap of those
    cut = (edge[k] + edge[k + 1]) / 2
    slopes = np.array([4.0, 8.0, 16.0, 32.0])
    z = (2 * y - 1)[None, :] * slopes[:, None] * (s - cut)[None, :]
    slope = float(slopes[np.argmin(np.logaddexp(0, -z).mean(axis=1))])
    return slope, -slope * float(cut)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES, longest: int = LONGEST) -> Field:
    """Fit on at most `sample` labelled documents that aren't held out, of at most `longest` lines each and `sample_lines` together. Their features, and no texts, come to the driver.

    Documents are taken whole, in order of a hash of their ids; one that would go over the lines is left out. Null labels, ids
    and texts are left out; a document with several labels or an id with several texts counts as often. Without labels of
    both kinds the field leans to the one there is, and without any it scores one half.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("own"), F.col(label_col).cast("int").alias("label"))
    known = known.where(~held_out("own") & F.col("own").isNotNull())
    chosen = known.orderBy(F.xxhash64("own"), "own").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    mine = texts.join(F.broadcast(chosen), F.col("id") == F.col("own")).select("id", "label", "t")  # sample rows at most
    n_lines = F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1
    sized = mine.groupBy("id", F.xxhash64("id").alias("place")).agg(F.sum(n_lines).alias("n")).orderBy("place", "id").limit(sample).collect()
    room, taken = sample_lines, []
    for r in sized:
        if r["n"] <= min(room, longest):
            room -= r["n"]
            taken.append((r["id"],))
    taken = docs.sparkSession.createDataFrame(taken, "id long")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [line_features(t) for t in batch["t"]]
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "f": [f.tobytes() for f, _ in made], "n": [n.tobytes() for _, n in made]})

    fitted = mine.join(F.broadcast(taken), "id", "left_semi").select("id", "label", "t")
    rows = fitted.mapInPandas(features, "id long, label int, f binary, n binary").toPandas().sort_values(["id", "label", "f"])
    made = [np.frombuffer(f, np.float32).reshape(-1, 3 * _OWN) for f in rows["f"]]
    return fit(made, [np.frombuffer(n, np.float32) for n in rows["n"]], rows["label"].to_numpy())


def score_documents(docs: DataFrame, field: Field, text_col: str = "text"):
    """The score of a text, as a column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([field.score(t) for t in texts], dtype="float64")

    return score(F.coalesce(F.col(text_col), F.lit("")))


def classify(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Nulls: a null text is an empty one, and an empty text gets the score of a share of one half; a null id isn't held out. Repeated rows get equal scores. An empty
    table gives no rows; other columns are ignored.
    """
    score = score_documents(docs, field, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of docs that the field doesn't reject, all columns kept. Rows with null or empty texts have the score of a share of one half; repeated rows stay or go alike."""
    return docs.select(whole_row(docs), score_documents(docs, field, text_col).alias("score")).where("score >= 0.5").select("row.*")
