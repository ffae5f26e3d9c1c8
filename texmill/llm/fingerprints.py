"""Document fingerprints from prefix polynomial hashes.

A text is a polynomial over two primes' worth of code points. Its modular prefix arrays give the hash of any span in O(1),
so spans of any texts can be compared, and binary search over span lengths finds the longest common extension of two
places. A fingerprint holds the length, the hash of the whole text, and for each of BINS classes of its window spans the
class's least window hash, cut to a byte; likeness() of two fingerprints estimates the Jaccard similarity of the texts'
sets of windows.

Defined cases: null text is the empty text; equal texts have equal fingerprints, the empty one too, and likeness 1; the
empty text is unlike any other (0). Texts shorter than a window count as one span. Documents are ordered by doc_id (null
first), ties by text; after the last comes the first.

Memory of a worker: a batch of texts, four bytes a code point for the two texts at hand and the edited one, and the arrays of
one block; fingerprints and common prefixes go block by block. PrefixHash, for spans anywhere in a text, holds two arrays of
eight bytes a code point of the text that it is given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from texmill.llm.text import small_batches, whole

#: Modulus of both hashes, a Mersenne prime, and their bases.
P = (1 << 31) - 1
BASES = (1_000_003, 48_271_009)
WINDOW, BINS, BLOCK = 12, 128, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod P for x under 2**62, without a division."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """base**k mod P for k < n; n is a power of two, to have few tables."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, _mod(out * pow(base, len(out), P))])
    return out


def powers(base: int, n: int) -> np.ndarray:
    """A table of a block, if that is enough: it serves all shorter ones, and is the only one kept of its base."""
    return _powers(base, 1 << max(0, max(n, BLOCK + WINDOW) - 1).bit_length())[:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _terms(code: np.ndarray, base: int) -> np.ndarray:
    return _mod((code.astype(np.int64) + 1) * powers(base, len(code)))


class PrefixHash:
    """Prefix arrays of one text: any span's hash, span equality and longest common extensions."""

    def __init__(self, text: str | np.ndarray) -> None:
        code = points(text) if isinstance(text, str) else text
        self.n = len(code)
        self.sums = []
        for base in BASES:
            sums = np.zeros(self.n + 1, np.int64)
            for i in range(0, self.n, BLOCK):  # sums of a block stay far under 2**62
                block = np.cumsum(_mod(_terms(code[i : i + BLOCK], base) * pow(base, i, P))) + sums[i]
                sums[i + 1 : i + 1 + len(block)] = _mod(block)
            self.sums.append(sums)

    def span(self, start: int, end: int) -> int:
        """Hash of text[start:end]; spans of equal content have equal hashes wherever they stand."""
        out = 0
        for base, sums in zip(BASES, self.sums, strict=True):
            out = out << 31 | (int(sums[end] - sums[start]) * pow(base, -start, P)) % P
        return out

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return i + length <= self.n and j + length <= other.n and self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common prefix of text[i:] and other[j:], by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.span(i, i + mid) == other.span(j, j + mid) else (low, mid - 1)
        return low


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix of two texts' code points: equal blocks by their hashes, then a binary search."""
    n = min(len(a), len(b))
    for at in range(0, n, BLOCK):
        x, y = PrefixHash(a[at : min(n, at + BLOCK)]), PrefixHash(b[at : min(n, at + BLOCK)])
        if not x.equal(0, y, 0, x.n):
            return at + x.extension(0, y, 0)
    return n


def _windows(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of that size in a block, from its prefix array."""
    base = BASES[0]
    sums = np.empty(len(code) + 1, np.int64)
    sums[0] = 0
    np.cumsum(_terms(code, base), out=sums[1:])
    sums = _mod(sums)
    back = powers(pow(base, -1, P), len(code) - size + 1)
    return _mod((sums[size:] - sums[:-size] + P) * back)


def _least(windows: np.ndarray, into: np.ndarray) -> None:
    """Lowers into[bin] to the least mixed hash of that bin."""
    mixed = (windows.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= MIX
    shift = np.uint64(64 - BINS.bit_length() + 1)
    if len(mixed) > 64 * BINS:  # the least are among the small ones, unless a bin has none of these
        rest = mixed & ((np.uint64(1) << shift) - np.uint64(1))
        small = mixed[rest < np.uint64((1 << int(shift)) // len(mixed) * 16 * BINS)]
        if len(np.unique(small >> shift)) == BINS:
            mixed = small
    np.minimum.at(into, (mixed >> shift).astype(np.intp), mixed)


def fingerprint(text: str | np.ndarray) -> str:
    """length:whole hash:bins, in hexadecimal; a bin without windows is 00."""
    code = points(text) if isinstance(text, str) else text
    n, ends, least = len(code), [0, 0], np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    size = max(1, min(WINDOW, n))
    for at in range(0, n, BLOCK):
        block = code[at : at + BLOCK]
        for k, base in enumerate(BASES):
            own = int(_terms(block, base).sum()) % P
            ends[k] = (ends[k] + own * pow(base, at, P)) % P
        with_next = code[at : at + BLOCK + size - 1]
        if len(with_next) >= size:
            _least(_windows(with_next, size), least)
    bins = np.where(least == np.iinfo(np.uint64).max, 0, (least * MIX >> np.uint64(40)) % np.uint64(255) + np.uint64(1))
    return f"{n:x}:{ends[0] << 31 | ends[1]:016x}:{bins.astype(np.uint8).tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated share of windows in common: 1 for equal fingerprints, below 1 for others."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(":")[2]), np.uint8) for f in (a, b))
    used = (x > 0) | (y > 0)
    if not used.any():
        return 0.0
    same = float((x == y)[used].mean())
    return min(0.999, max(0.0, (same - 1 / 255) / (1 - 1 / 255)))


def edited(code: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last quarter of a text replaced by as much of the beginning of the next."""
    q = len(code) // 4
    return np.concatenate([code[: len(code) - q], following[:q]])


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("common_prefix", pa.int64()),
    ]
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, from rows in order by which each document is followed by the next; look marks guests."""
    held: tuple | None = None
    for batch in batches:
        rows: list[tuple] = []
        for k in range(batch.num_rows):
            part, look, doc_id, text = (batch.column(c)[k].as_py() for c in ("part", "look", "doc_id", "text"))
            code = points(text)
            print_ = fingerprint(code)
            if held and held[0] == part and not held[1]:
                rows.append(_compared(*held[2:], code, print_))
            held = (part, look, doc_id, code, print_)
        yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, r, strict=True)) for r in rows], schema=OUT)


def _compared(doc_id: int, code: np.ndarray, print_: str, after: np.ndarray, print_after: str) -> tuple:
    new = edited(code, after)
    print_new = fingerprint(new)
    sha = hashlib.sha256()
    for at in range(0, len(new), BLOCK):
        sha.update(new[at : at + BLOCK].tobytes().decode("utf-32-le").encode())
    same = len(code) if print_ == print_new else common_prefix(code, new)
    return (doc_id, len(code), sha.hexdigest(), print_, print_new, likeness(print_, print_new), likeness(print_, print_after), same)


def successors(docs: DataFrame) -> DataFrame:
    """Rows (part, look, doc_id, text), dealt out by part and sorted, so that each document is followed by the next one.

    Parts are ranges of doc_id of about equal size, as many as there are shuffle partitions. The first documents of a part
    also go, as guests (look), to the end of the part before; so no task needs more than its own rows. The driver has a few
    numbers a part.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    shares = [k / n for k in range(1, n)]
    cuts = ids.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None  # n - 1 ids
    cuts = sorted(set(cuts or []))

    part = _part(F.col("doc_id"), cuts)
    firsts = ids.select(part.alias("part"), "doc_id").groupBy("part")
    firsts = firsts.agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).orderBy("part").collect()  # a row a part
    before, first, nulls = [-1] * (len(cuts) + 1), [0] * (len(cuts) + 1), [False] * (len(cuts) + 1)
    for k, row in enumerate(firsts):
        before[row["part"]], first[row["part"]], nulls[row["part"]] = firsts[k - 1]["part"], row["first"] or 0, row["nulls"] > 0
    of = lambda values: F.get(F.lit(values), F.col("part"))
    starts = F.when(of(nulls), F.col("doc_id").isNull()).otherwise(F.col("doc_id").eqNullSafe(of(first)))

    placed = docs.select(part.alias("part"), "doc_id", whole(F.col("text")).alias("text"))
    own = F.struct(F.col("part"), F.lit(False).alias("look"))
    guest = F.struct(of(before).alias("part"), F.lit(True).alias("look"))
    dealt = placed.select(F.explode(F.when(starts, F.array(own, guest)).otherwise(F.array(own))).alias("p"), "doc_id", "text")
    dealt = dealt.select("p.part", "p.look", "doc_id", "text").repartitionById(n, F.col("part"))
    return dealt.sortWithinPartitions("part", "look", "doc_id", "text")


def _part(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at doc_id or under it, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    held = F.lit(cuts)

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = (acc["low"] < acc["high"]) & (F.get(held, mid) <= doc_id)
        return F.when(right, F.struct((mid + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), F.least(mid, acc["high"]).alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    return F.when(doc_id.isNull(), 0).otherwise(F.aggregate(steps, start, step, lambda acc: acc["low"]))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """OUT for each of docs(doc_id, text): its fingerprint, that of its edited text, and what they have in common."""
    small_batches(docs.sparkSession)
    return successors(docs).mapInArrow(_pairs, _ddl())


def _ddl() -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in OUT)
