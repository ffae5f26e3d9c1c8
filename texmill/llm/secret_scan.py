"""Secret scans: spans of credential-like values, and how widely the corpus shares each value.

Every candidate value is hashed; the hashes are counted by distinct repositories and owners over the whole corpus. A value
that at least `min_owners` owners hold is an example that people copy; one that stays with fewer owners looks live.
Kinds assign, access and hex are always reported. Kind blob (a long mixed token) is reported only where it looks live and
touches no other span. DataFrame operations only.

Defined cases: null text is the empty text and has no spans. Null owner or repository counts as one more value. Repeated
rows are scanned one by one; as one repository they count once. Texts may hold any characters and any number of spans: the
work grows with the text and with n log n of its spans. Spans that begin at one place are ordered by kind. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from texmill.llm.text import packed, whole
from texmill.storage import stash

#: Patterns of the base kinds; fixed by the contract. Group 1 leads, group 2 is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]{12,})"
HEX = r"()([0-9a-f]{32,})"
BLOB = r"()([A-Za-z0-9+/_=-]{20,})"
KINDS = ("assign", "access", "hex", "blob")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Noncharacters that mark where a match begins, its value begins, and it ends; in a text they count as one other character.
BEGIN, VALUE, END, OTHER = "\ufdd0", "\ufdd1", "\ufdd2", "\ufffd"
SPAN = "struct<start:int,kind:int,end:int,hash:string>"
#: Letters that redacted() takes together, so that no place is counted out from the beginning of a long text.
CHUNK = 1024


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under add: each round adds what lies twice as far back, so n values take n log n steps."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    back = lambda acc, k: F.concat(F.array_repeat(F.lit(None).cast("int"), F.call_function("shiftleft", F.lit(1), k).cast("int")), acc)
    step = lambda acc, k: F.zip_with(acc, F.slice(back(acc, k), 1, F.size(acc)), lambda x, y: F.when(y.isNull(), x).otherwise(add(x, y)))
    return F.aggregate(rounds, values, step)


def matches(text: Column, pattern: str, kind: str, good: Callable[[Column], Column]) -> Column:
    """Array of SPAN: leftmost non-overlapping matches whose value is good; kind is a place in KINDS."""
    parts = F.split(F.regexp_replace(text, pattern, f"{BEGIN}$1{VALUE}$2{END}"), BEGIN)

    def piece(part: Column) -> Column:
        lead, after = F.split(part, VALUE)[0], F.split(part, VALUE)[1]
        value, rest = F.split(after, END)[0], F.split(after, END)[1]
        length = (F.length(lead) + F.length(value)).alias("length")
        return F.struct(length, F.length(rest).alias("rest"), good(value).alias("good"), F.when(good(value), F.sha2(value, 256)).alias("hash"))

    def placed(pieces: Column, first: Column) -> Column:
        after = running(F.transform(pieces, lambda p: p["length"] + p["rest"]), lambda x, y: x + y)
        begin = lambda p, at: first + at - p["rest"] - p["length"]
        span = lambda p, at: F.struct(begin(p, at).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (first + at - p["rest"]).alias("end"), p["hash"].alias("hash"))
        return F.filter(F.zip_with(pieces, after, lambda p, at: F.when(p["good"], span(p, at))), lambda s: s.isNotNull())

    made = lambda x: F.struct(F.length(x[0]).alias("first"), F.transform(F.slice(x, 2, F.size(x)), piece).alias("pieces"))
    return once(once(parts, made), lambda x: placed(x["pieces"], x["first"])).cast(f"array<{SPAN}>")


def spans(text: Column) -> Column:
    """Candidate spans of all kinds in a text that is not null, in no particular order."""
    none = F.array().cast(f"array<{SPAN}>")
    clean = F.when(text.rlike(f"[{BEGIN}{VALUE}{END}]"), F.translate(text, BEGIN + VALUE + END, OTHER * 3)).otherwise(text)
    low = F.lower(text)
    named = low.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        named = named | low.contains(word)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    return F.concat(
        F.when(named, matches(clean, ASSIGN, "assign", lambda v: F.length(v) >= 8)).otherwise(none),
        F.when(text.contains("AKIA"), matches(clean, ACCESS, "access", lambda v: F.length(v) >= 16)).otherwise(none),
        F.when(text.rlike("[0-9a-f]{32}"), matches(clean, HEX, "hex", lambda v: F.length(v) >= 32)).otherwise(none),
        F.when(text.rlike("[A-Za-z0-9+/_=-]{20}"), matches(clean, BLOB, "blob", mixed)).otherwise(none),
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, repositories, owners: how many of each hold a value, from rows (hash, owner, repository).

    Three nested counts instead of count(distinct): each shuffle takes rows that are already summed, so a value that
    is everywhere puts no more than one row for each task, repository and owner in front of it.
    """
    by_repository = candidates.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def scanned(docs: DataFrame, owner: str = "source", repository: str = "doc_id", min_owners: int = 3, with_text: bool = False) -> DataFrame:
    """_doc: the columns of docs (text only if asked for); _spans: the reported spans by start and kind, each with live."""
    row = docs.select(
        packed(docs, with_text), F.col(owner).alias("owner"), F.col(repository).alias("repository"), spans(whole(F.col("text"))).alias("_found")
    )
    row = stash(row.withColumn("_row", F.monotonically_increasing_id()))
    holding = row.filter(F.size("_found") > 0)
    each = holding.select("_row", "owner", "repository", F.explode("_found").alias("s")).withColumn("hash", F.col("s.hash"))
    known = ownership(each).select("hash", (F.col("owners") < min_owners).alias("live"))
    blob = KINDS.index("blob")
    span = F.struct(*(F.col(f"s.{c}").alias(c) for c in ("start", "kind", "end")), F.col("live"))
    told = each.join(known, "hash").filter((F.col("s.kind") != blob) | F.col("live"))
    told = told.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_all"))
    told = told.select("_row", _apart(F.col("_all"), blob).alias("_spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    with_spans = holding.join(told, "_row", "left").select("_doc", F.coalesce("_spans", none).alias("_spans"))
    return with_spans.unionByName(row.filter(F.size("_found") == 0).select("_doc", none.alias("_spans")))


def _apart(spans: Column, blob: int) -> Column:
    """The sorted spans without those of kind blob that touch one of another kind, by what ends before and begins after them."""
    ends = running(F.transform(spans, lambda s: F.when(s["kind"] != blob, s["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y))
    starts = F.reverse(F.transform(spans, lambda s: F.when(s["kind"] != blob, s["start"]).otherwise(2**31 - 1)))
    starts = F.reverse(running(starts, lambda x, y: F.least(x, y)))
    around = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("before"), s.alias("after")))
    touching = lambda s, a: (s["kind"] == blob) & ((a["before"] > s["start"]) | (a["after"] < s["end"]))
    return F.filter(F.zip_with(spans, around, lambda s, a: F.when(~touching(s, a), s)), lambda s: s.isNotNull())


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, live_as: str = "[SECRET]", example_as: str = "[EXAMPLE]") -> Column:
    """The text with each run of overlapping spans replaced, and no other change; spans are sorted by start."""

    def between(chunks: Column, start: Column, end: Column) -> Column:
        i, j = (F.floor(x / CHUNK).cast("int") for x in (start, end))
        first, last = (F.coalesce(F.get(chunks, k), F.lit("")) for k in (i, j))
        within = F.substr(first, start % CHUNK + 1, end - start)
        across = F.concat(F.substr(first, start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.substr(last, F.lit(1), end % CHUNK))
        return F.when(i == j, within).otherwise(across)

    def joined(x: Column) -> Column:
        tag = lambda s: F.when(s["live"], F.lit(live_as)).otherwise(F.lit(example_as))
        part = lambda s, at: F.when(s["start"] >= at, F.concat(between(x["chunks"], at, s["start"]), tag(s))).otherwise("")
        ahead = F.slice(F.concat(F.array(F.lit(0)), x["ends"]), 1, F.size(x["ends"]))
        return F.concat(F.array_join(F.zip_with(spans, ahead, part), ""), between(x["chunks"], F.element_at(x["ends"], -1), x["length"]))

    ends = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    whole_text = F.struct(chunks.alias("chunks"), F.length(text).alias("length"), ends.alias("ends"))
    return F.when(F.size(spans) == 0, text).otherwise(once(whole_text, joined))
