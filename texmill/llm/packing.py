"""Packing: cutting-stock column generation over the histogram of piece lengths.

A document's ids are cut into full sequences and one shorter rest. The lengths' histogram, of at most `size` bins however
large the corpus is, goes to the driver. There a linear program chooses how often to use each pattern (a set of lengths that
fits one sequence): it starts from patterns filled greedily, and a knapsack over the dual prices, solved by dynamic
programming, prices in better ones until the bound is met. Whole uses of each pattern are taken, and what remains is filled
greedily. Documents are ranked within their length, and a pattern's places take ranges of ranks.

Defined cases: null text is the empty text, which has the end id only. Ties in a length are ranked by doc_id; repeated rows
are packed one by one. An empty table gives no rows. Texts of any length are cut. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from texmill.llm.text import small_batches, whole
from texmill.storage import stash

SIZE, END = 2048, 1
#: Gap to a bound (that of the duals, or of the ids alone) at which pricing stops, and the most pivots.
GAP, PIVOTS = 2e-4, 4000


class Encoder:
    """ids of a byte-level BPE file as the tokenizers library gives them; the same vocabulary's fast coder does the work."""

    def __init__(self, path: str) -> None:
        import tiktoken
        import tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.exact = tokenizers.Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # its regular expressions give up, by a panic, on some very long runs
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """PIECE: each document's ids, then the end id, cut into full sequences and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = np.append(code.ids(text), end).astype("<u4").tobytes()
                for at in range(0, len(data), 4 * size):
                    part = data[at : at + 4 * size]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).mapInArrow(cut, PIECE)


def fill(have: np.ndarray, first: int, size: int) -> Counter:
    """A pattern that holds first and fills size as well as a short search can; have[i]: how often length i may be used."""
    pattern, room, left = Counter({first: 1}), size - first, have.copy()
    left[first] -= 1
    while room > 0:
        if left[room] > 0:
            pattern[room] += 1
            break
        two = np.flatnonzero((left[1:room] > 0) & (left[room - 1 : 0 : -1] > 0)) + 1
        two = two[(2 * two != room) | (left[two] > 1)]
        if len(two):
            pattern.update((int(two[-1]), room - int(two[-1])))
            break
        one = np.flatnonzero(left[: room + 1] > 0)
        if not len(one):
            break
        pattern[int(one[-1])] += 1
        left[one[-1]] -= 1
        room -= int(one[-1])
    return pattern


def greedy(demand: np.ndarray, size: int, whole_uses: bool) -> list[tuple[Counter, float, list[int]]]:
    """Patterns, longest length first, each used until some of its lengths (the third value) are met."""
    rest, out = demand.astype(float), []
    for length in range(size, 0, -1):
        while rest[length] > 0:
            pattern = fill(rest if whole_uses else np.where(rest > 0, np.inf, 0), length, size)
            uses = min(rest[i] / a for i, a in pattern.items())
            uses = max(1, int(uses)) if whole_uses else uses
            met = [i for i, a in pattern.items() if rest[i] / a <= uses]
            for i, a in pattern.items():
                rest[i] = 0 if i in met else rest[i] - uses * a
            out.append((pattern, uses, met))
    return out


def knapsack(price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room, any length used any number of times, and the length taken there (0: none)."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, int)
    for room in range(1, size + 1):
        value = price[1 : room + 1] + best[room - 1 :: -1][:room]
        i = int(value.argmax())
        best[room], took[room] = (value[i], i + 1) if value[i] > best[room - 1] else (best[room - 1], 0)
    return best, took


def unwind(took: np.ndarray, room: int) -> Counter:
    pattern: Counter = Counter()
    while room > 0:
        length = int(took[room])
        pattern[length] += length > 0
        room -= length or 1
    return +pattern


def patterns(demand: np.ndarray, size: int = SIZE) -> list[tuple[Counter, int]]:
    """Patterns and whole numbers of uses that meet demand[length] exactly, few in all."""
    lengths = np.flatnonzero(demand)
    row = {int(n): k for k, n in enumerate(lengths)}
    used = greedy(demand, size, whole_uses=False)
    if not used:
        return []
    m = len(lengths)
    # A pattern for each length that it meets: itself for the first, and, unused, one of that length alone for the others.
    start = [x for p, u, met in used for x in ((p, u, met[0]), *((Counter({i: size // i}), 0.0, i) for i in met[1:]))]
    basis, x = [p for p, _, _ in start], np.array([u for _, u, _ in start])
    # Later patterns hold no length that is met before, so the basis is triangular and its inverse comes row by row.
    inverse, holding = np.zeros((m, m)), {int(n): [] for n in lengths}
    for k, (p, _, met) in enumerate(start):
        inverse[k, row[met]] = 1
        for j, a in holding[met]:
            inverse[k] -= a * inverse[j]
        inverse[k] /= p[met]
        for i, a in p.items():
            holding[i].append((k, a))
    dual = inverse.sum(axis=0)
    pivots, least = 0, float((demand[lengths] * lengths).sum() / size)  # no packing has fewer sequences than its ids fill
    while pivots < PIVOTS:
        price = np.zeros(size + 1)
        price[lengths] = np.maximum(dual, 0)
        best, took = knapsack(price, size)
        gains = price[lengths] + best[size - lengths]
        if gains.max() <= 1 + GAP:  # the duals, scaled, bound the optimum
            break
        before = pivots
        for k in np.argsort(-gains)[:64]:
            pattern = unwind(took, size - int(lengths[k])) + Counter({int(lengths[k]): 1})
            gain = sum(dual[row[i]] * a for i, a in pattern.items()) - 1
            if gain <= GAP / 2:
                continue
            step = sum(inverse[:, row[i]] * a for i, a in pattern.items())
            able = step > 1e-9
            ratio = np.where(able, x / np.where(able, step, 1), np.inf)
            out = int(ratio.argmin())
            x = np.maximum(x - ratio[out] * step, 0)
            x[out] = ratio[out]
            pivot_row = inverse[out] / step[out]
            some = np.flatnonzero(np.abs(step) > 1e-12)
            inverse[some] -= np.outer(step[some], pivot_row)
            inverse[out] = pivot_row
            dual = dual - gain * pivot_row
            basis[out] = pattern
            pivots += 1
        if pivots == before or x.sum() <= least * (1 + GAP):
            break
    uses = [(p, int(u + 1e-6)) for p, u in zip(basis, x, strict=True) if u + 1e-6 >= 1]
    rest = demand.astype(np.int64).copy()
    whole_uses = []
    for p, u in uses:
        u = min([u, *(int(rest[i]) // a for i, a in p.items())])
        for i, a in p.items():
            rest[i] -= u * a
        if u:
            whole_uses.append((p, u))
    return whole_uses + [(p, int(u)) for p, u, _ in greedy(rest, size, whole_uses=True)]


def places(used: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): where the documents of each length and rank go."""
    taken: Counter = Counter()
    out, sequence = [], 0
    for pattern, uses in used:
        offset = 0
        for length in sorted(pattern, reverse=True):
            for _ in range(pattern[length]):
                out.append((length, taken[length], uses, sequence, offset))
                taken[length] += uses
                offset += length
        sequence += uses
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank, from 0 within each length. Ranks are counted in salted parts, and the parts' sizes summed, so that
    a length that a third of the rows have is not ranked in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(sizes, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """PIECE with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, path, size, end))
    demand = np.zeros(size + 1)
    for length, n in cut.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most size rows
        demand[length] = n
    table = places(patterns(demand, size)) or [(0, 0, 0, 0, 0)]
    at = spark.createDataFrame(table, "length long, first long, uses long, sequence long, offset long")
    fits = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("uses"))
    # the patterns of a basis and of what it leaves over: a few for each of the lengths, whatever the corpus
    found = ranked(cut).join(F.broadcast(at), "length").filter(fits)
    sequence = (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence, "offset")
