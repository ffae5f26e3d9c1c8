"""BPE encoding and decoding by speculation and verification.

Words that a worker has not met lately are split by greedy longest match, a proposal only. A token sequence is the one that
the merges give exactly if no two neighbours would have merged across their border before each was complete; that is tested
for all neighbours of a batch at once, by undoing the later merge of each pair, step by step, on arrays. Words with a failing
pair, and no others, are merged exactly.

Needs a vocabulary whose ids follow the order of the merges, checked when it is loaded. Defined cases: null text is the empty
text and has no ids; its decoded text is empty. Texts and words of any length are taken. Repeated rows give equal rows. Special tokens' strings
become their ids, as the library does by default. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, functions as F

from texmill.llm.text import small_batches, whole

#: Letters outside these ranges may be of another class, case or form in the library's version of Unicode.
SURE = r"\x00-\u02ff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf"
#: Unicode white space, as the library's regular expressions have it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
NEVER = np.int64(1 << 40)


class Bpe:
    """Coder for a file of the tokenizers library with byte-level BPE and an end-of-word suffix."""

    def __init__(self, path: str, keep: int = 150_000) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in plain]
        self.letters = [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = np.array([[self.vocab[a], self.vocab[b], self.vocab[a + b]] for a, b in merges], np.int64)
        self.base = int(ids[0, 2])
        if not (np.diff(ids[:, 2]) == 1).all() or (ids[:, :2] >= ids[:, 2:]).any():
            raise ValueError(f"{path}: ids don't follow the order of the merges")
        self.size = int(ids.max()) + 1
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.left[ids[:, 2]], self.right[ids[:, 2]] = ids[:, 0], ids[:, 1]
        keys = ids[:, 0] * self.size + ids[:, 1]
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], NEVER), np.append(ids[order, 2], NEVER)
        self.merged = dict(zip(keys.tolist(), ids[:, 2].tolist(), strict=True))
        own = self.compatible(ids[:, 0], ids[:, 1], ids[:, 2])  # tokens that the merges build from their own letters
        good = set(ids[own, 2].tolist())
        tokens = {t: i for t, i in self.vocab.items() if i < self.base or i in good}
        self.inside = {t: i for t, i in tokens.items() if not (self.suffix and t.endswith(self.suffix))}
        self.ending = {t[: len(t) - len(self.suffix)]: i for t, i in tokens.items() if t.endswith(self.suffix)}
        self.longest = max(map(len, self.vocab))
        self.words = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.codes = {c: i for i, c in enumerate(self.letters)}
        self.odd = regex.compile(f"[^{SURE}]")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.young: dict[str, tuple[str, int, str]] = {s: (str(i), 1, s) for s, i in self.special.items()}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.keep = keep
        self.failed = self.proposed = 0

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id that each pair merges to, NEVER if to none."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of neighbours stays as it is; merges from limit on don't count.

        Goes back in time: if the two innermost tokens have a merge that comes before the later of them was built, they
        would have merged. Otherwise the later one is taken apart and its inner half looked at.
        """
        a, b, out = a.copy(), b.copy(), np.ones(len(a), bool)
        limit = np.full(len(a), NEVER) if limit is None else limit.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            crossed = self.merge_of(x, y) < limit[live]
            out[live[crossed]] = False
            split_left, on = x > y, ~crossed & (np.maximum(x, y) >= self.base)
            limit[live] = np.where(split_left, x, y + 1)
            a[live] = np.where(split_left, self.right[x], x)
            b[live] = np.where(split_left, y, self.left[y])
            live = live[on]
        return out

    def greedy(self, word: str) -> list[int]:
        out, at, n = [], 0, len(word)
        inside, ending, longest = self.inside, self.ending, self.longest
        while at < n:
            if n - at <= longest and (last := ending.get(word[at:])) is not None:
                out.append(last)
                break
            for end in range(min(n - 1, at + longest), at, -1):
                if (token := inside.get(word[at:end])) is not None:
                    break
            out.append(token)
            at = end
        return out

    def exact(self, word: str) -> list[int]:
        """Merges in order of rank, leftmost first, on a linked list."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := self.merged.get(a * self.size + b)) is not None]  # noqa: B905
        heapq.heapify(heap)
        n = len(ids)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := self.merged.get(ids[p] * self.size + ids[q])) is not None:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[str], wide: int = 48) -> list[list[int]]:
        """exact() of each word; words of up to `wide` letters advance together, one merge each at a time."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 8), (8, 16), (16, wide)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(rows):
                for k, code in zip(rows.tolist(), self._together([words[k] for k in rows.tolist()], high), strict=True):
                    out[k] = code
        for k in np.flatnonzero(lengths > wide).tolist():
            out[k] = self.exact(words[k])
        return out

    def _together(self, words: list[str], width: int) -> list[list[int]]:
        none = -1
        ids = np.full((len(words), width + 1), none, np.int64)  # the last column stays empty
        for k, w in enumerate(words):
            ids[k, : len(w)] = [*map(self.vocab.__getitem__, w[:-1]), self.vocab[w[-1] + self.suffix]]
        made = self._pairs(ids[:, :-1], ids[:, 1:])
        columns, live = np.arange(width), np.arange(len(words))
        x = ids
        while len(live):
            at = made.argmin(axis=1)
            best = made[np.arange(len(made)), at]
            on = best < NEVER
            ids[live[~on]] = x[~on]
            live, x, made, at, best = live[on], x[on], made[on], at[on], best[on]
            rows = np.arange(len(live))
            x[rows, at] = best
            later = columns + (columns > at[:, None])
            x[:, :-1] = np.take_along_axis(x, later, axis=1)
            x[:, -1] = none
            made = np.take_along_axis(np.pad(made, ((0, 0), (0, 1)), constant_values=NEVER), later, axis=1)
            made[rows, at] = self._pairs(best, x[rows, at + 1])
            before = np.flatnonzero(at > 0)
            made[before, at[before] - 1] = self._pairs(x[before, at[before] - 1], best[before])
        sizes = (ids >= 0).sum(axis=1)
        return [r[:n] for r, n in zip(ids.tolist(), sizes.tolist(), strict=True)]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a >= 0) & (b >= 0), self.merge_of(np.maximum(a, 0), np.maximum(b, 0)), NEVER)

    def learn(self, words: list[str]) -> None:
        """Codes of words that are in neither generation of the memory."""
        spelled = ["".join(map(self.letters.__getitem__, w.encode())) for w in words]
        codes = [self.greedy(w) for w in spelled]
        sizes = np.array([len(c) for c in codes])
        flat = np.fromiter((i for c in codes for i in c), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(codes)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, place = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pair // self.size, pair % self.size)[place]
        wrong = np.unique(owner[inner[~fine]])
        for k, code in zip(wrong.tolist(), self.merge_all([spelled[k] for k in wrong.tolist()]), strict=True):
            codes[k] = code
        self.proposed, self.failed = self.proposed + len(codes), self.failed + len(wrong)
        names = self.names
        for w, c in zip(words, codes, strict=True):
            self.young[w] = (" ".join(map(str, c)), len(c), " ".join([names[i] for i in c]))

    def split(self, text: str) -> list[str]:
        if self.odd.search(text):  # letters whose class or case depends on the version of Unicode: by the library itself
            spelled = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.codes.__getitem__, s)).decode() for s, _ in spelled]
        return self.words.findall(unicodedata.normalize("NFC", text).lower())

    def encode(self, texts: list[str], at_once: int = 1 << 20) -> Iterator[tuple[str, int, str]]:
        """For each text: its ids joined by spaces, their number, and the decoded text. Takes texts together until they
        have at_once letters, so that their new words are learned together."""
        held, letters = [], 0
        for text in texts:
            held.append(text)
            letters += len(text)
            if letters >= at_once:
                yield from self._encode(held)
                held, letters = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        parts = [[p for p in self.cut.split(t) if p] if self.cut and self.cut.search(t) else [t] for t in texts]
        split = [[w for p in ps for w in ([p] if p in self.special else self.split(p))] for ps in parts]
        self._recall({w for ws in split for w in ws})
        known = self.young
        for words in split:
            codes = [known[w] for w in words]
            yield " ".join([c[0] for c in codes]), sum([c[1] for c in codes]), " ".join([c[2] for c in codes])

    def _recall(self, words: set[str]) -> None:
        """Puts the codes of all the words into the young generation; the old one is forgotten when the young is full."""
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {s: (str(i), 1, s) for s, i in self.special.items()}
        missing = []
        for w in words:
            if w not in self.young:
                if (code := self.old.get(w)) is not None:
                    self.young[w] = code
                else:
                    missing.append(w)
        if missing:
            self.learn(missing)


@cache
def coder(path: str | None) -> Bpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Bpe(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (decimal, joined by spaces), n_tokens, decoded for each of docs(doc_id, text)."""
    return _mapped(docs, path, "ids string, n_tokens long, decoded string", lambda ids, n, text: (ids, n, text))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, n, text: (n, sha(ids), sha(text)))


def _mapped(docs: DataFrame, path: str | None, ddl: str, made) -> DataFrame:
    names = ["doc_id", *(c.split()[0] for c in ddl.split(", "))]
    types = [pa.int64(), *(pa.int64() if c.endswith(" long") else pa.string() for c in ddl.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = [made(*x) for x in code.encode(texts)]
            columns = [batch.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * (len(names) - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, types, strict=True)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).mapInArrow(run, f"doc_id long, {ddl}")
