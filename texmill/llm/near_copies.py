"""Operator 6 for the pipeline: groups of texts with Jaccard >= 4/5 over their five-word shingles.

SimHash fingerprints of the shingles are linked through simhash's pigeonhole blocks, at its distance. That alone does not reach
0.8: such pairs differ in up to 12 bits and more, and 12 of 64 would take a key for each choice of 4 out of 16 blocks, 1820 a
text. So beside it 128 minima of the shingles' hashes, in 32 bands of four, add the candidates beyond that distance; a pair at
0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 32, under 5 in 10**8. An exact check of the Jaccard similarity follows.

A vertex is the hash of a text's words, so copies are one. Vertices that either way links are joined to candidate components,
and each text goes once to its component, where all pairs are decided on whole shingle sets. Jaccard distance is a metric: members
near one pivot are joined already, and only those within twice the limit of a pivot need a look at the members around it. A
component of much text is cut into tiles of two chunks each; its comparisons grow with its square.

Defined cases: null text is the empty text. A text under five words is one shingle; texts without words are copies of each
other and near to nothing else. Repeated rows and ties of doc_id are told apart by a row number of their own. Columns of any
name are kept in _doc. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from texmill.llm.components import components
from texmill.llm import simhash
from texmill.llm.simhash import LOWER, SEED, WORD
from texmill.llm.text import column, doc_schema, packed, small_batches, whole
from texmill.storage import stash

SHINGLE, BANDS, WIDTH, TILE = 5, 32, 4, 8 << 20
#: Least Jaccard as a fraction.
ALIKE = (4, 5)
_rng = np.random.default_rng(SEED)
_TIMES = _rng.integers(1 << 63, size=(BANDS * WIDTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(1 << 63, size=(BANDS * WIDTH, 1), dtype=np.uint64) * np.uint64(2)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles, copies included."""
    found = WORD.findall(text.encode().translate(LOWER))
    line, ends, at = b" ".join(found), [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    if len(found) <= size:
        return np.frombuffer(xxhash.xxh64_digest(line, SEED) if found else b"", np.uint64)
    digest = xxhash.xxh64_digest
    starts = [0, *(e + 1 for e in ends)]
    return np.frombuffer(b"".join([digest(line[i:j], SEED) for i, j in zip(starts, ends[size - 1 :])]), np.uint64)  # noqa: B905


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024] * _TIMES + _PLUS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least.reshape(BANDS, WIDTH))]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        vertex = [xxhash.xxh64_intdigest(b" ".join(WORD.findall(t.encode().translate(LOWER))), SEED) - (1 << 63) for t in texts]
        hashes = [shingles(t) for t in texts]
        fp = pa.array(np.array([simhash.majority(h.view(np.uint8).reshape(-1, 8)) for h in hashes], np.uint64).view(np.int64))
        keys = pa.array([bands(h) for h in hashes], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_row"), pa.array(vertex, pa.int64()), fp, keys], names=["_doc", "_row", "vertex", "fp", "bands"])


def sketched(docs: DataFrame) -> DataFrame:
    """_doc: the columns of docs; _row: a number of the row; vertex: the hash of the words; fp: the SimHash fingerprint; bands: the keys."""
    small_batches(docs.sparkSession)
    rows = docs.select(packed(docs), F.monotonically_increasing_id().alias("_row"), whole(column("text")).alias("_text"))
    return rows.mapInArrow(_sketches, doc_schema(rows, ("_row", LongType()), ("vertex", LongType()), ("fp", LongType()), ("bands", ArrayType(LongType()))))


def forest(sets: list[np.ndarray], alike: tuple[int, int] = ALIKE) -> list[tuple[int, int]]:
    """Links (i, j) that join what pairs at that Jaccard or above join, fewer than there are sets; sets are distinct hashes.

    Each set is compared with all others at most once, by the lists of sets that hold its hashes.
    """
    n, (p, q) = len(sets), alike
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = often[codes] > 1  # a hash of one set alone is shared with none
    owner, codes = owner[common], codes[common]
    starts = np.searchsorted(owner, np.arange(n + 1))
    holders = owner[np.argsort(codes, kind="stable")]
    firsts = np.cumsum(np.where(often > 1, often, 0)) - often

    def shared(i: int) -> np.ndarray:
        own = codes[starts[i] : starts[i + 1]]
        runs = often[own]
        ends = np.cumsum(runs)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[own] - ends + runs, runs)
        found = np.bincount(holders[at], minlength=n)
        found[i] = sizes[i]
        return found

    group, ball, links, wide = np.arange(n), np.full(n, -1), [], {}

    def join(i: int, near: np.ndarray) -> None:
        for g in np.unique(group[near]):
            if g != group[i]:
                links.append((i, int(near[group[near] == g][0])))
                group[group == g] = group[i]

    done = np.zeros(n, bool)
    while len(rest := np.flatnonzero(ball < 0)):
        pivot = int(rest[len(rest) // 2])
        both, either = shared(pivot), sizes + sizes[pivot]
        near = np.flatnonzero((p + q) * both >= p * either)
        done[pivot] = True
        if len(near) > 1:
            wide[pivot] = np.flatnonzero(2 * p * both >= (2 * p - q) * either)
        ball[near[ball[near] < 0]] = pivot
        join(pivot, near)
    for pivot, others in wide.items():  # the other members of its ball may be near what the pivot is not
        for j in others.tolist():
            if not done[j] and group[j] != group[pivot]:
                done[j] = True
                join(j, np.flatnonzero((p + q) * shared(j) >= p * (sizes + sizes[j])))
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) vertices to join, from (key, vertex, text) sorted by key; a key's members may lie in several batches."""
    last, held = None, []

    def made() -> pa.RecordBatch:
        pairs = forest([s for _, s in held]) if len(held) > 1 else []
        a, b = ([held[x[k]][0] for x in pairs] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for key, vertex, text in zip(*(batch.column(c).to_pylist() for c in ("key", "vertex", "text"))):  # noqa: B905
            if key != last:
                yield made()
                last, held = key, []
            held.append((vertex, np.unique(shingles(text))))
    yield made()


def _stars(filed: DataFrame) -> DataFrame:
    """(a, b): the least vertex of each key of filed(vertex, key) and each other one of it."""
    least = filed.groupBy("key").agg(F.min("vertex").alias("a"), F.max("vertex").alias("z")).filter("a <> z").select("key", "a")
    return filed.join(least, "key").filter("a <> vertex").select("a", F.col("vertex").alias("b"))


def by_simhash(one: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """(a, b): vertices of one(vertex, fp) that join what fingerprints within the distance join; equal ones are one of simhash's."""
    fps = stash(one.groupBy("fp").agg(F.min("vertex").alias("id")))
    return _stars(one.select("vertex", F.col("fp").alias("key"))).union(simhash.links(fps, distance))


def links(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): vertices of rows(_doc, _row, vertex, fp, bands) that join what pairs of near texts join."""
    one = rows.groupBy("vertex").agg(F.min("_row").alias("_rep"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    filed = one.select("vertex", F.explode("bands").alias("key"))
    near = components(by_simhash(one.filter(F.size("bands") > 0)).union(_stars(filed)).distinct())
    reps = near.join(one.select("vertex", "_rep"), F.col("id") == F.col("vertex")).select("vertex", "_rep", "component")
    texts = rows.select(F.col("_row").alias("_at"), whole(F.col("_doc.text")).alias("text")).join(reps, F.col("_at") == F.col("_rep"))
    texts = stash(texts.select("vertex", "component", "text"))
    sizes = texts.groupBy("component").agg(F.sum(F.length("text")).alias("n")).select("component", F.greatest(F.lit(1), F.ceil(F.col("n") / tile)).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("vertex"), F.col("chunks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.xxhash64(F.col("component"), F.least(k, own), F.greatest(k, own)))
    dealt = texts.join(sizes, "component").select(F.explode(pair).alias("key"), "vertex", "text")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "a long, b long")


def grouped(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """_row, doc_id and component, a vertex, of rows as links() takes them."""
    joined = components(links(rows, tile))
    slim = rows.select("vertex", "_row", "_doc.doc_id")
    return slim.join(joined, F.col("vertex") == F.col("id"), "left").select("_row", "doc_id", F.coalesce("component", "vertex").alias("component"))
