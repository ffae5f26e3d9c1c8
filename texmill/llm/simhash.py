"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, and verified Hamming distances.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's shingles. The 64 bits are cut into BLOCKS
blocks; two fingerprints that differ in `distance` bits or fewer agree in BLOCKS - distance blocks at least, so each
fingerprint is filed under every choice of that many blocks, and only fingerprints under one key are compared.

Copies never meet as pairs: equal fingerprints are one vertex, and a key's members give a spanning forest of their links,
not all of them. A key with over `tile` members is cut into tiles of two chunks each, so that any two members share a tile.

Defined cases: null text is the empty text; texts without words have fingerprint zero and link like any other. Vertices are
fingerprints, so rows with null doc_id link too; null is no smallest id, so a group of null ids only has a null component.
Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from texmill.llm.components import components
from texmill.llm.text import doc_schema, packed, small_batches, whole
from texmill.storage import stash

SHINGLE, SEED, DISTANCE, TILE = 4, 42, 4, 20_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64 bits as an unsigned number."""
    found = WORD.findall(text.encode().translate(LOWER))
    if not found:
        return 0
    if len(found) <= size:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    line, ends, at = b" ".join(found), [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[i:j], SEED) for i, j in zip(starts, ends[size - 1 :])])  # noqa: B905
    return majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8))


def majority(rows: np.ndarray) -> int:
    """The bits set in over half of the digests, one a row of eight bytes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(made)], names=["_doc", "fp"])


def fingerprinted(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """_doc: the columns of docs (text only if asked for); fp: the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(packed(docs, with_text), whole(F.col("text")).alias("_text"))
    return rows.mapInArrow(_fingerprints, doc_schema(rows, ("fp", LongType())))


def choices(n: int, distance: int = DISTANCE) -> list[tuple[np.uint64, int]]:
    """Masks of the blocks that make up each key, enough bits for n fingerprints to be mostly alone under a key."""
    for blocks in (6, 7, 8, 9):
        edges = [round(64 * k / blocks) for k in range(blocks + 1)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]  # noqa: B905
        if 2 ** (64 * (blocks - distance) // blocks + 2) >= n:
            break
    return [sum(c) for c in combinations(masks, blocks - distance)]


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links (i, j) that join what distances under the limit join, fewer than there are members.

    Each round takes a member as pivot and links all that lie near it; members that are already joined need not be compared
    among themselves, so a cluster of near copies costs a few rounds, not one a pair.
    """
    n = len(fps)
    group, links = np.arange(n), []

    def join(i: int, near: np.ndarray) -> None:
        for g in np.unique(group[near]):
            if g != group[i]:
                links.append((i, int(near[group[near] == g][0])))
                group[group == g] = group[i]

    ball = np.full(n, -1)
    while len(rest := np.flatnonzero(ball < 0)):
        pivot = int(rest[len(rest) // 2])
        near = np.flatnonzero(_near(fps, fps[pivot], distance))
        ball[near[ball[near] < 0]] = pivot
        join(pivot, near)
    for pivot in np.unique(ball):  # members of different balls may be near each other too
        others = np.flatnonzero((group != group[pivot]) & _near(fps, fps[pivot], 2 * distance))
        members = np.flatnonzero(ball == pivot) if len(others) else others
        for j in others:
            if group[j] != group[pivot] and len(near := members[_near(fps[members], fps[j], distance)]):
                join(int(j), near[:1])
    return links


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """(a, b) ids to join, from (key, fp, id) sorted by key; a key's members may lie in several batches."""
    held: list[np.ndarray] = [np.empty(0, t) for t in (np.int64, np.uint64, np.int64)]

    def whole_keys(key: np.ndarray, fp: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.intp)
        sizes = np.diff(np.r_[starts, len(key)])
        run = np.repeat(sizes, sizes)
        small = (run > 1) & (run <= 16)
        for step in range(1, 16):
            i = np.flatnonzero(small[:-step] & (key[:-step] == key[step:])) if len(key) > step else np.empty(0, np.intp)
            i = i[_near(fp[i], fp[i + step], distance)]
            found.append((at[i], at[i + step]))
        for start, n in zip(starts[sizes > 16], sizes[sizes > 16]):  # noqa: B905
            pairs = forest(fp[start : start + n], distance)
            if pairs:
                i, j = np.array(pairs).T + start
                found.append((at[i], at[j]))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "id")]
        new[1] = new[1].view(np.uint64)  # bits of a negative number are not counted as they stand
        key, fp, at = (np.concatenate(x) for x in zip(held, new))  # noqa: B905
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield from whole_keys(key[:cut], fp[:cut], at[:cut])
        held = [key[cut:], fp[cut:], at[cut:]]
    if len(held[0]):
        yield from whole_keys(*held)


def links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """(a, b): ids of fps(fp, id), with distinct fp, that join what pairs of at most that distance join."""
    masks = choices(fps.count(), distance)
    key = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks))))
    filed = fps.select(key.alias("key"), "fp", "id")
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sized = filed.join(sizes.select("key", F.when(F.col("n") > tile, F.ceil(F.col("n") / tile)).otherwise(1).cast("int").alias("chunks")), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.xxhash64(F.col("key"), F.least(k, own), F.greatest(k, own)))
    dealt = sized.select(F.explode(F.when(F.col("chunks") == 1, F.array("key")).otherwise(pair)).alias("key"), "fp", "id")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: _links(batches, distance), "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def grouped(rows: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """rows(_doc, fp) with component_id, the least doc_id that links reach."""
    fps = stash(rows.groupBy("fp").agg(F.min("_doc.doc_id").alias("id")))
    joined = components(links(fps.select("fp", F.col("fp").alias("id")), distance, tile)).withColumnRenamed("id", "_fp")
    placed = fps.join(joined, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("_group"), "id")
    least = placed.groupBy("_group").agg(F.min("id").alias("component_id"))
    named = placed.join(least, "_group").select("_fp", "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp"), "left").drop("_fp")
