"""Token counts by a linear longest-match automaton.

The pieces that may begin a word and those that may continue one form a trie with two roots. A node's failure link leads to
where matching goes on after the longest pieces on its path are cut off, and beside it stands how many pieces these are. A
word then costs one step a byte and adds up counts; no piece is ever built. New words of a batch walk the automaton together.

Defined cases: null text is the empty text, with no words. A word that the pieces cannot spell counts as one unknown piece.
Words of any length are taken. Repeated rows give equal rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from texmill.llm.text import small_batches, whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIRST, LATER, NOWHERE = 0, 1, -1


class Automaton:
    """Counts greedy longest-match pieces of words; pieces are bytes."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes]) -> None:
        children: list[dict[int, int]] = [{}, {}]
        ends: set[int] = set()
        for root, pieces in ((FIRST, first), (LATER, later)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in children[node]:
                        children[node][byte] = len(children)
                        children.append({})
                    node = children[node][byte]
                if node != root:
                    ends.add(node)
        fail, popped = [NOWHERE] * len(children), [0] * len(children)
        queue = deque((FIRST, LATER))
        while queue:
            above = queue.popleft()
            for byte, node in children[above].items():
                queue.append(node)
                if node in ends:
                    fail[node], popped[node] = LATER, 1
                    continue
                at, n = fail[above], popped[above]
                while at != NOWHERE and byte not in children[at]:
                    at, n = fail[at], n + popped[at]
                if at != NOWHERE:
                    fail[node], popped[node] = children[at][byte], n
        steps = sorted((node * 256 + byte, to) for node, c in enumerate(children) for byte, to in c.items())
        self.keys = np.array([k for k, _ in steps] + [1 << 60], np.int64)
        self.to = np.array([t for _, t in steps] + [NOWHERE], np.int64)
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, 0 if it cannot be spelled; words are not empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        node, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        place = np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        while len(live):  # each round takes every word one byte on or one failure link back
            at, reading = node[live], place[live] < sizes[live]
            key = at * 256 + flat[np.where(reading, start[live] + place[live], 0)]
            found = np.searchsorted(self.keys, key)
            step = np.where(reading & (self.keys[found] == key), self.to[found], NOWHERE)
            on = step != NOWHERE
            back = self.fail[at]
            total[live] += np.where(on, 0, self.popped[at])
            node[live] = np.where(on, step, back)
            place[live] += on
            lost = ~on & (back == NOWHERE)
            total[live[lost]] = 0
            done = lost | ((node[live] == LATER) & (place[live] >= sizes[live]))
            live = live[~done]
        return total


def word_pieces(path: str | None) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin and that continue a word, from a byte-level vocabulary whose tokens mark a space before them.
    Any single byte may begin or continue a word."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    spec = json.load(open(path, encoding="utf-8"))
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec["added_tokens"]}
    tokens = [bytes(map(alphabet.__getitem__, t)) for t in spec["model"]["vocab"] if t not in special]
    single = [bytes([b]) for b in range(256)]
    return [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1] + single, [t for t in tokens if t[:1] != b" "] + single


@cache
def automaton(path: str | None) -> Automaton:
    return Automaton(*word_pieces(path))


def counted(docs: DataFrame, path: str | None = None, keep: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_pieces, n_unknown for each of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, young, old = automaton(path), {}, {}
        for batch in batches:
            split = [WORD.findall(t) for t in batch.column("text").to_pylist()]
            if len(young) > keep:
                young, old = {}, young
            new = []
            for w in {w for ws in split for w in ws}:
                if w not in young:
                    if (n := old.get(w)) is None:
                        new.append(w)
                    else:
                        young[w] = n
            if new:
                young.update(zip(new, machine.count([w.encode() for w in new]).tolist(), strict=True))
            rows = [[young[w] for w in ws] for ws in split]
            unknown = [r.count(0) for r in rows]
            sums = [sum(r) + u for r, u in zip(rows, unknown, strict=True)]
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in ([len(r) for r in rows], sums, unknown))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_pieces", "n_unknown"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long")
