"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the text alone go in (never ids, languages, sources or labels). The trees are grown on at most `most_rows`
labelled documents, those with the least hashes of their ids, so the fit has the same cost for any corpus; every document is
scored. A fitted forest is flattened into arrays of equal depth, and a batch walks all trees level by level in numpy.

Defined cases: null text is the empty text and is scored like any other. A document with several labels counts as 1 if half
of them or more are 1; if its id has several texts, the least by its statistics stands for it. Without labelled rows, or with
one class, the score is the share of 1 (0.5 without any). Rows of equal text get equal scores. Of equal splits the first
statistic's lowest edge is taken. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from texmill.llm.text import doc_schema, packed, small_batches, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Byte classes that are counted.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "high": range(128, 256),
    "stop": b".",
    "comma": b",",
    "mark": b"!?",
    "symbol": b"#*$%&<>=@~^+\\",
    "bar": b"|",
    "quote": b"\"'`",
    "bracket": b"()[]{}",
    "dash": b"-_/:;",
}
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _members in enumerate(CLASSES.values()):
    CLASS_OF[list(_members)] = _k
NAMES = [
    *("log_words", "mean_word", "log_longest", "distinct_share", "top_share", "repeat_next", "pair_share", "title_share", "capital_share"),
    *("log_lines", "line_words", "dup_lines", "short_lines", "end_stop", *CLASSES, "entropy"),
]


def features(text: str) -> list[float]:
    """NAMES of a text."""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if x.strip()]
    n, data = len(words), np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(CLASS_OF[data], minlength=len(CLASSES) + 1) if len(data) else np.zeros(len(CLASSES) + 1)
    letters = max(1, len(data))
    sizes = [len(w) for w in words]
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = set(zip(words, words[1:]))  # noqa: B905
    of = max(1, n)
    share = np.bincount(data, minlength=256)
    share = share[share > 0] / letters
    return [
        math.log1p(n),
        sum(sizes) / of,
        math.log1p(max(sizes, default=0)),
        len(tally) / of,
        max(tally.values(), default=0) / of,
        sum(a == b for a, b in zip(words, words[1:])) / of,  # noqa: B905
        len(pairs) / max(1, n - 1),
        sum(w.istitle() for w in words) / of,
        sum(w.isupper() for w in words) / of,
        math.log1p(len(lines)),
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        sum(x.endswith((".", "!", "?")) for x in lines) / max(1, len(lines)),
        *(counts[: len(CLASSES)] / letters).tolist(),
        float(-(share * np.log(share)).sum()),
    ]


@dataclass(frozen=True)
class Boosting:
    trees: int = 120
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    min_rows: int = 10
    l2: float = 1.0
    #: Bound of the labelled rows that are gathered to fit; rows with the least hash of doc_id are taken.
    most_rows: int = 30_000


@dataclass
class Forest:
    """All trees, complete to the same depth: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    edge: np.ndarray  # a row goes right if its value is above
    leaf: np.ndarray  # trees x leaves, log odds
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        odds = np.full(len(x), self.start)
        for at in range(0, len(x), 4096):
            rows = x[at : at + 4096]
            node = np.zeros((len(rows), trees), np.int32)
            tree, line = np.arange(trees), np.arange(len(rows))[:, None]
            for _ in range((inner + 1).bit_length() - 1):
                right = rows[line, self.feature[tree, node]] > self.edge[tree, node]
                node = 2 * node + 1 + right
            odds[at : at + 4096] += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, how: Boosting = Boosting()) -> Forest:
    """Boosts trees on the logistic loss; a level of a tree is grown from histograms of gradients for all its nodes at once."""
    inner, leaves = 2**how.depth - 1, 2**how.depth
    mean = float(y.mean()) if len(y) else 0.5
    if mean in (0.0, 1.0) or not len(y):
        even = np.zeros((1, inner), np.int32), np.full((1, inner), np.inf), np.zeros((1, leaves))
        return Forest(*even, start=math.log((mean + 1e-9) / (1 - mean + 1e-9)))
    quantiles = np.linspace(0, 1, how.bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], quantiles, method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    d, b = x.shape[1], how.bins
    padded = np.stack([np.append(e, np.full(b - len(e), np.inf)) for e in edges])
    start = math.log(mean / (1 - mean))
    odds, out = np.full(len(y), start), Forest(np.zeros((how.trees, inner), np.int32), np.full((how.trees, inner), np.inf), np.zeros((how.trees, leaves)), start)
    for t in range(how.trees):
        p = 1 / (1 + np.exp(-odds))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(how.depth):
            n = 2**level
            cell = node * b
            sums = np.empty((3, d, n, b))
            for j in range(d):
                k = cell + binned[:, j]
                for s, w in enumerate((g, h, None)):
                    sums[s, j] = np.bincount(k, w, minlength=n * b).reshape(n, b)
            left = sums.cumsum(axis=3)
            total = left[..., -1:]
            worth = lambda s: s[0] ** 2 / (s[1] + how.l2)
            gain = worth(left) + worth(total - left) - worth(total)
            gain[(left[2] < how.min_rows) | (total[2] - left[2] < how.min_rows)] = 0
            flat = gain.transpose(1, 0, 2).reshape(n, d * b)
            best = flat.argmax(axis=1)
            j, cut = best // b, best % b
            good = flat[np.arange(n), best] > 1e-6
            out.feature[t, n - 1 : 2 * n - 1] = np.where(good, j, 0)
            out.edge[t, n - 1 : 2 * n - 1] = np.where(good, padded[j, np.minimum(cut, b - 1)], np.inf)
            node = 2 * node + (good[node] & (binned[np.arange(len(y)), j[node]] > cut[node]))
        value = -np.bincount(node, g, minlength=leaves) / (np.bincount(node, h, minlength=leaves) + how.l2)
        out.leaf[t] = how.rate * value
        odds += out.leaf[t][node]
    return out


def trained(docs: DataFrame, labels: DataFrame, train: Column, how: Boosting = Boosting()) -> Forest:
    """A forest from the rows of docs whose labels(doc_id, quality) hold and for whose doc_id train holds."""
    small_batches(docs.sparkSession)
    known = labels.filter(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.most_rows)  # the documented bound of the fit
    texts = docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(known), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    each = texts.mapInArrow(made, "doc_id long, quality double, x array<float>")
    got = each.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.quality", "r.x").toArrow()  # most_rows at most
    got = got.sort_by("doc_id").combine_chunks()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES)).astype(float)
    return fit(x, (got.column("quality").to_numpy() >= 0.5).astype(float), how)


def scored(docs: DataFrame, forest: Forest, with_text: bool = False) -> DataFrame:
    """_doc: the columns of docs (text only if asked for); score: how likely label 1 is."""
    small_batches(docs.sparkSession)
    rows = docs.select(packed(docs, with_text), whole(F.col("text")).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("_text").to_pylist()], np.float32).reshape(-1, len(NAMES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(held.value.score(x))], names=["_doc", "score"])

    return rows.mapInArrow(run, doc_schema(rows, ("score", DoubleType())))
