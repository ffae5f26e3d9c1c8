"""LM scoring by a hidden Markov model that Baum-Welch trains on the whole corpus.

A token is a lower-cased word, or the end of a text. The `symbols` most frequent tokens are symbols of their own; any other
belongs to the class that its last letters hash to. States emit symbols; a class emits its words by their counts, less a
discount that goes to the words never seen in it. So the probability of a text is that of its symbols (the forward recursion,
scaled as it goes, which is exact) times that of each word within its class, and the probabilities of all continuations
of a text sum to one, words unseen in a class counted as one.

Everything is gathered from all training documents: token counts; where the passes start (each document's symbols are added
to those of the frequent word that it has most in excess, and the driver merges these sums down to the states); and the
expected counts of each Baum-Welch pass, by partition and then by symbol. The counts of the `table` most frequent tokens go
to the workers; the rest, a few for each document, meet their counts in a join.

Defined cases: null text is the empty text, of one token (its end). Without training documents N, V and all counts are zero,
and states emit evenly. Tokens of equal count are ranked by their letters. Rows with equal texts have equal scores. Null
doc_id counts as held out. Other columns are ignored. Scoring takes a text of any length whole; for training one of more than
`piece` tokens is cut into pieces, so that a worker's arrays stay bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from texmill.llm.text import id_remainder, small_batches, whole
from texmill.storage import stash

#: The end of a text as a token; no word is empty.
END = ""
#: Marks that may follow a word's letters.
MARKS = ".,;:!?\"')"


@dataclass(frozen=True)
class Setup:
    states: int = 8
    symbols: int = 4096
    classes: int = 2048
    table: int = 131_072
    passes: int = 2
    discount: float = 0.6
    #: Frequent words that documents are sorted by for the starting point.
    anchors: int = 32
    piece: int = 65_536

    @property
    def kinds(self) -> int:
        return self.symbols + self.classes


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, lower-cased A-Z, in one array; how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    there = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty word
    ends = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return flat.filter(there), np.diff(ends)


def klass(word: str, how: Setup) -> int:
    """Symbol of a word that has none of its own: by its last three letters, and a mark if it ends in none."""
    bare = word.rstrip(MARKS)
    return how.symbols + zlib.crc32((bare[-3:] + "." * (bare != word)).encode()) % how.classes


def klasses(words: pa.Array, how: Setup) -> np.ndarray:
    """klass() of each of an array of words; only the endings that differ go through Python."""
    bare = pc.utf8_rtrim(words, characters=MARKS)
    mark = pc.if_else(pc.equal(pc.binary_length(bare), pc.binary_length(words)), "", ".")
    found = pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, -3), mark, "").dictionary_encode()
    of_ending = np.array([how.symbols + zlib.crc32(x.encode()) % how.classes for x in found.dictionary.to_pylist()], np.int64)
    return of_ending[found.indices.to_numpy()]


def klass_of(word: Column, how: Setup) -> Column:
    """klass() as a native expression."""
    bare = F.rtrim(word, F.lit(MARKS))
    ending = F.concat(F.right(bare, F.lit(3)), F.when(bare != word, ".").otherwise(""))
    return (F.lit(how.symbols) + F.crc32(ending.cast("binary")) % how.classes).cast("int")


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # kinds x states


def layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts in order of place, then of length: (symbols, first index of each place, texts there, order of texts)."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    there = len(texts) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), side="right")
    first = np.concatenate([[0], np.cumsum(there)])
    flat = np.empty(first[-1], np.int64)
    for rank, k in enumerate(order):
        flat[first[: lengths[k]] + rank] = texts[k]
    return flat, first, there, order


def forward(model: Model, out: np.ndarray, first: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state probabilities after each token, probability of each token given those before); out: emissions of the tokens."""
    alpha, scale = np.empty_like(out), np.empty(len(out))
    for t, n in enumerate(there):
        i, j = first[t], first[t + 1]
        now = alpha[i:j]
        if t:
            np.matmul(alpha[first[t - 1] : first[t - 1] + n], model.move, out=now)
            now *= out[i:j]
        else:
            np.multiply(model.start, out[i:j], out=now)
        total = np.add.reduce(now, axis=1, out=scale[i:j])
        now /= total[:, None]
    return alpha, scale


def likelihoods(model: Model, texts: list[np.ndarray], stride: int = 8) -> np.ndarray:
    """log10 probability of each text. The forward recursion, scaled at every stride-th token, holds one token of each text."""
    flat, first, there, order = layout(texts)
    logs, now = np.zeros(len(texts)), np.ones((len(texts), 1)) * model.start
    for t, n in enumerate(there):
        now = (now[:n] @ model.move if t else now) * model.emit[flat[first[t] : first[t + 1]]]
        going = there[t + 1] if t + 1 < len(there) else 0
        if going < n:  # the others end here
            logs[going:n] += np.log10(now[going:].sum(axis=1))
        if t % stride == stride - 1:
            total = now.sum(axis=1, keepdims=True)
            now /= total
            logs[:going] += np.log10(total[:going, 0])
    back = np.empty_like(logs)
    back[order] = logs
    return back


def expected(model: Model, texts: list[np.ndarray], kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (kinds x states): the scaled forward and backward recursions. What is held
    of each token are its emissions and its state probabilities."""
    flat, first, there, _ = layout(texts)
    out = model.emit[flat]
    alpha, scale = forward(model, out, first, there)
    out /= scale[:, None]
    moves, back_move = np.zeros_like(model.move), np.ascontiguousarray(model.move.T)
    after = np.ones((there[-1], out.shape[1]))  # of the tokens of one place: the probability of what comes after, scaled
    for t in range(len(there) - 1, 0, -1):
        i, j, before = first[t], first[t + 1], first[t - 1]
        ahead = out[i:j]
        ahead *= after
        moves += alpha[before : before + there[t]].T @ ahead
        alpha[i:j] *= after
        after = np.ones((there[t - 1], out.shape[1]))
        np.matmul(ahead, back_move, out=after[: there[t]])
    moves *= model.move
    alpha[: there[0]] *= after
    emitted = np.stack([np.bincount(flat, alpha[:, s], minlength=kinds) for s in range(out.shape[1])], axis=1)
    return alpha[: there[0]].sum(axis=0), moves, emitted


def estimate(starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray, kept: float = 0.01) -> Model:
    starts, moves, emitted = starts + 1, moves + 1, emitted + kept
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))


def anchored(texts: list[np.ndarray], shares: np.ndarray, kinds: int) -> np.ndarray:
    """Counts of kinds, and of texts in a last row, by the anchor that each text has most in excess. Anchors are symbols
    1 to len(shares), shares their shares of all tokens."""
    a = len(shares)
    flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    of = np.flatnonzero((flat >= 1) & (flat <= a))
    found = np.bincount(owner[of] * a + flat[of] - 1, minlength=len(texts) * a).reshape(-1, a)
    due = sizes[:, None] * shares
    most = ((found - due) / np.sqrt(due + 1)).argmax(axis=1)
    counts = np.bincount(most[owner] * kinds + flat, minlength=a * kinds).reshape(a, kinds)
    return np.vstack([counts.T, np.bincount(most, minlength=a)]).astype(float)


def beginning(sums: np.ndarray, how: Setup) -> Model:
    """Where the passes start, from the summed counts by anchor: the likest two anchors are merged until a state has one."""
    rows = [row for row in sums.T if row[-1] > 0]
    while len(rows) > how.states:
        weight = np.array([row[:-1].sum() for row in rows])
        root = np.sqrt(np.array([row[:-1] for row in rows]) / weight[:, None])
        loss = (2 - 2 * root @ root.T) * (weight[:, None] * weight / (weight[:, None] + weight))
        i, j = divmod(int(np.where(np.eye(len(rows), dtype=bool), np.inf, loss).argmin()), len(rows))
        rows[i] = rows[i] + rows[j]
        del rows[j]
    rng, every = np.random.default_rng(7), sums.sum(axis=1)
    while len(rows) < how.states:  # states that no anchor has begin as the corpus, moved a little
        rows.append(every * rng.uniform(0.5, 1.5, len(every)) / how.states)
    emit = np.array([row[:-1] for row in rows]).T + 0.05
    mean = (every[:-1] + 0.05) / (every[:-1] + 0.05).sum()
    emit = emit / emit.sum(axis=0) + 0.1 * mean[:, None]
    weight = np.array([row[-1] for row in rows]) + 1.0
    move = np.full((how.states,) * 2, 0.1 / how.states) + np.eye(how.states) * 0.9
    return Model(weight / weight.sum(), move, emit / emit.sum(axis=0))


def parts(texts: list[np.ndarray], most: int = 300_000) -> Iterator[list[int]]:
    """Places of texts, longest first, split so that no part but one of a single text has more than `most` tokens."""
    held, size = [], 0
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        if held and size + len(texts[k]) > most:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(texts[k])
    if held:
        yield held


def gathered(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.Table]:
    """The rows of batches, together until they have that many bytes: texts of like length can then go together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, split so that no slice but one of a single text has more than `most` bytes of text."""
    ends, at = np.r_[0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)], 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), summed within a task until the words are many (Spark sums what comes twice); END counts texts."""
    held: list[pa.Table] = []
    for batch in (some for b in batches for some in slices(b)):
        words, sizes = tokens(batch.column("text"))
        found = pc.value_counts(words)
        ends = pa.table({"word": pa.array([END], pa.string()), "n": pa.array([len(sizes)], pa.int64())})
        held += [pa.table({"word": found.field("values"), "n": found.field("counts")}), ends]
        if sum(t.num_rows for t in held) > 300_000:
            held = [_summed(held)]
            if held[0].num_rows > 150_000:
                yield from held.pop().to_batches(50_000)
    if held:
        yield from _summed(held).to_batches(50_000)
    pa.default_memory_pool().release_unused()  # the worker lives on


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()


@dataclass
class Vocabulary:
    """What the workers know of the counts: the frequent tokens, and sums of the others by class."""

    n: int
    v: int
    end: int  # count of the end token; it always has a place
    words: pa.Array  # by place, the end token first; as an array, which takes a tenth of what a dict takes in each worker
    count: np.ndarray  # by place
    kind: np.ndarray  # by place: the symbol of its own, or the class
    in_class: np.ndarray  # tokens of each class in training
    types: np.ndarray  # words of each class in training

    def tables(self, how: Setup) -> tuple[np.ndarray, np.ndarray]:
        """By place: base score, and log probability within the class (0 for a symbol of its own)."""
        own = self.kind < how.symbols
        inner = np.where(own, 0.0, np.log10(np.maximum(self.count - how.discount, 1e-300) / np.where(own, 1.0, np.maximum(self.in_class[self.kind], 1e-300))))
        return np.log10((self.count + 0.1) / (self.n + 0.1 * (self.v + 1))), inner


def vocabulary(counts: DataFrame, how: Setup) -> Vocabulary:
    of_end = F.coalesce(F.max(F.when(F.col("word") == END, F.col("c"))), F.lit(0))
    n, v, end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), of_end).first()
    top = counts.filter(F.col("word") != END).orderBy(F.desc("c"), "word").limit(how.table).toArrow()  # a bounded table of the most frequent
    words = pa.concat_arrays([pa.array([END], pa.string()), *top.column("word").cast(pa.string()).chunks])
    count = np.r_[float(end), top.column("c").to_numpy()]
    kind = klasses(words, how)
    each = counts.groupBy(klass_of(F.col("word"), how).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("types"))
    in_class, types = np.zeros(how.kinds), np.zeros(how.kinds)
    for k, total, kinds in each.collect():  # a row a class
        in_class[k], types[k] = total, kinds
    seen = np.flatnonzero(count[: how.symbols])  # those have symbols of their own
    np.subtract.at(in_class, kind[seen], count[seen])
    np.subtract.at(types, kind[seen], 1)
    own = min(how.symbols, len(words))
    kind[:own] = np.arange(own)
    return Vocabulary(n, v, end, words, count, kind.astype(np.int32), in_class, types)


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, symbols binary, rare array<string>, rare_n array<int>, rare_k array<int>"


def _encoded(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, how: Setup) -> Iterator[pa.RecordBatch]:
    """Symbols of each text, what the frequent tokens add to its sums, and its other words with their numbers."""
    kind, (base, inner) = vocab.kind, vocab.tables(how)
    for batch in (some for b in batches for some in slices(b)):
        words, sizes = tokens(batch.column("text"))
        rows = len(sizes)
        owner = np.repeat(np.arange(rows), sizes)
        at = pc.index_in(words, value_set=vocab.words).fill_null(-1).to_numpy()
        known, missing = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        codes = kind[at]  # -1 takes the last entry, put right below
        rare = words.take(pa.array(missing)).dictionary_encode()
        names, which = len(rare.dictionary), rare.indices.to_numpy()
        of_name = klasses(rare.dictionary, how)
        codes[missing] = of_name[which]
        pair, often = np.unique(owner[missing] * max(1, names) + which, return_counts=True)
        name, offsets = pair % max(1, names), np.searchsorted(pair, np.arange(rows + 1) * max(1, names)).astype(np.int32)
        listed = lambda values, offsets=offsets: pa.ListArray.from_arrays(pa.array(offsets), values)

        first = np.r_[0, np.cumsum(sizes + 1)]  # of each text; an end token comes before the next
        symbols = np.full(first[-1], kind[0], "<u2")
        symbols[np.arange(len(codes)) + owner] = codes
        summed = lambda values, known=known, owner=owner, at=at, rows=rows: np.bincount(owner[known], values[at[known]], rows) + values[0]
        columns = {
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "n_tokens": pa.array(sizes + 1, pa.int64()),
            "n_known": pa.array(np.bincount(owner[known], minlength=rows) + (vocab.end > 0), pa.int64()),
            "base": pa.array(summed(base)),
            "inner": pa.array(summed(inner)),
            "symbols": pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(symbols)]),
            "rare": listed(rare.dictionary.take(pa.array(name))),
            "rare_n": listed(pa.array(often, pa.int32())),
            "rare_k": listed(pa.array(of_name[name], pa.int32())),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _texts(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2") for b in rows.column("symbols").to_pylist()]


def _added(rows: DataFrame, count, names: list[str], shape: tuple[int, int]) -> np.ndarray:
    """Sums over all rows of the tables that count(texts) gives, one a task; only shape[0] rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for some in gathered(batches):
            total += count(_texts(some))
        there = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(total[there, s]) for s in range(shape[1]))], names=["k", *names])

    counted = rows.select("symbols").mapInArrow(run, "k int, " + ", ".join(f"{s} double" for s in names))
    total = np.zeros(shape)
    for row in counted.groupBy("k").agg(*(F.sum(s).alias(s) for s in names)).collect():  # a row for each symbol, and a few more
        total[row[0]] = row[1:]
    return total


def train(encoded: DataFrame, vocab: Vocabulary, how: Setup) -> Model:
    """Baum-Welch over the rows that are not held out."""
    spark = encoded.sparkSession
    rows = encoded.filter(~F.col("held_out"))
    n = min(how.anchors, how.symbols - 1)
    shares = np.zeros(n)
    there = vocab.count[1 : n + 1] / max(1, vocab.n)
    shares[: len(there)] = there

    def by_anchor(texts: list[np.ndarray]) -> np.ndarray:
        return sum(anchored([texts[k] for k in some], shares, how.kinds) for some in parts(texts))

    model = beginning(_added(rows, by_anchor, [f"a{k}" for k in range(n)], (how.kinds + 1, n)), how)
    for _ in range(how.passes):
        held = spark.sparkContext.broadcast(model)

        def count(texts: list[np.ndarray], held=held) -> np.ndarray:
            total = np.zeros((how.kinds + how.states + 1, how.states))
            pieces = [t[at : at + how.piece] for t in texts for at in range(0, len(t), how.piece)]
            for some in parts(pieces):
                starts, moves, emitted = expected(held.value, [pieces[k] for k in some], how.kinds)
                total[: how.kinds] += emitted
                total[how.kinds : -1] += moves
                total[-1] += starts
            return total

        total = _added(rows, count, [f"s{s}" for s in range(how.states)], (how.kinds + how.states + 1, how.states))
        model = estimate(total[-1], total[how.kinds : -1], total[: how.kinds])
    return model


def scored(docs: DataFrame, how: Setup = Setup(), held_out_of: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each of docs(doc_id, text).

    Documents whose crc32 of doc_id is 0 modulo held_out_of are not learned from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = id_remainder(F.col("doc_id"), held_out_of) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), whole(F.col("text")).alias("text"))
    counted = rows.filter(~F.col("held_out")).select("text").mapInArrow(_counts, "word string, n long")
    counts = stash(counted.groupBy("word").agg(F.sum("n").alias("c")))
    vocab = vocabulary(counts, how)
    given = spark.sparkContext.broadcast(vocab)
    encoded = rows.mapInArrow(lambda b: _encoded(b, given.value, how), ENCODED)
    encoded = stash(encoded.withColumn("row", F.monotonically_increasing_id()))
    model = spark.sparkContext.broadcast(train(encoded, vocab, how))
    slim = ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches):
            texts, logs = _texts(rows), np.empty(rows.num_rows)
            for some in parts(texts):
                logs[some] = likelihoods(model.value, [texts[k] for k in some])
            yield from rows.select(list(slim)).append_column("hmm", pa.array(logs)).combine_chunks().to_batches()

    rows = encoded.select(*slim, "symbols").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, hmm double")
    sizes = {"k": pa.array(range(how.symbols, how.kinds), pa.int32()), "in_class": vocab.in_class[how.symbols :], "types": vocab.types[how.symbols :]}
    classes = F.broadcast(spark.createDataFrame(pa.table(sizes)))  # a row a class; as Arrow, which needs no Python on the executors
    each = encoded.select("row", F.explode(F.arrays_zip("rare", "rare_n", "rare_k")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"), F.col("r.rare_k").alias("k"))
    met = each.join(counts, "word", "left").join(classes, "k")
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 0.1) / F.lit(vocab.n + 0.1 * (vocab.v + 1)))
    seen = F.log10((c - F.lit(how.discount)) / F.col("in_class"))
    unseen = F.when(F.col("in_class") > 0, F.log10(F.lit(how.discount) * F.col("types") / F.col("in_class"))).otherwise(0.0)
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * base).alias("more_base"),
        F.sum(F.col("n") * F.when(c > 0, seen).otherwise(unseen)).alias("more_inner"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    out = rows.join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("n_known", "more_known").alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        (plus("inner", "more_inner") + F.col("hmm")).alias("score"),
    )
