"""Secrets in texts: a trigram inverted index proposes texts, regular expressions verify them.

Each rule's pattern yields a Boolean trigram query (any of some sets, all trigrams of
the set). One scan builds the index: for each shard of texts and each trigram that a query
names, the sorted list of the hashes of the texts that hold it. Lists of a set are
intersected in each shard, the shortest first, and sets are united; what is left becomes a bitmap
of candidates for each rule, of a size that is bounded whatever the input. A second scan asks the bitmaps where its texts lie, so no text is
shuffled, and verifies the candidates by the rule; two texts of one slot of the bitmap only add
candidates. A rule that demands no trigram scans all documents.
Everything runs as Spark SQL functions.
"""

from __future__ import annotations

import re._parser as sre  # the standard library's own view of a pattern
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpoint


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`, kept where `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order of their kinds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # a run and its tail from AKIA on: as AKIA[A-Z0-9]+ of 20 characters
    Rule("hex", r"[0-9a-f]{24,}"),  # a whole run, as [0-9a-f]+ of 24 characters
)
#: Further rules, each with trigrams that its matches must hold.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    # it begins its run of such characters, so that each run is gone through once
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams, one of which every match holds in full; None if nothing is sure.

    Runs of the pattern that spell out at most `most` strings give clauses; the
    run with the longest shortest string is taken.
    """
    Clauses = list[frozenset[str]]

    def clauses(strings: set[str]) -> Clauses:
        out = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
        return out if all(out) else []

    def better(a: Clauses, b: Clauses) -> Clauses:
        return b if b and (not a or min(map(len, b)) > min(map(len, a))) else a

    def walk(items, strings: set[str]) -> tuple[set[str], Clauses]:
        """Strings that may stand right before the place reached, and the best query of what was spelt out before."""
        best: Clauses = []
        for op, value in items:
            name = str(op)
            grown: set[str] | None = None
            if name == "LITERAL":
                grown = {s + chr(value).lower() for s in strings}
            elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
                grown = {s + chr(c).lower() for s, (_, c) in product(strings, value)}
            elif name == "SUBPATTERN":
                grown, inner = walk(value[-1], strings)
                best = better(best, inner)
            elif name == "BRANCH":
                # a match takes one alternative: only what each of them demands, taken together, is sure
                parts = [walk(x, strings) for x in value[1]]
                each = [better(inner, clauses(tail)) for tail, inner in parts]
                best = better(best, [c for e in each for c in e] if all(each) else [])
                grown = set().union(*(tail for tail, _ in parts))
            elif name == "MAX_REPEAT" and value[1] == 1 and len(value[2]) == 1 and str(value[2][0][0]) == "LITERAL":
                tail = chr(value[2][0][1]).lower()
                grown = {s + tail for s in strings} | (strings if value[0] == 0 else set())
            if grown is None or len(grown) > most:
                best = better(best, clauses(strings))
                strings = {""}
            else:
                strings = grown
        return strings, best

    tail, best = walk(sre.parse(pattern), {""})
    return better(best, clauses(tail)) or None


#: Distinct texts of a shard of the index, about.
SHARD = 4_096
#: Slots of a rule's bitmap for each text, and at most: 8 MB for each rule, which are sent to all tasks.
SLOTS, MOST_SLOTS = 8, 1 << 26
_KEYS = "array<bigint>"


def posting(trigram: str) -> Column:
    """Whether a row of (lower) belongs to the list of a lower-case trigram."""
    return F.contains(F.col("lower"), F.lit(trigram))


def build_index(texts: DataFrame, trigrams: list[str], shards: int) -> DataFrame:
    """(shard, trigram, keys): the inverted index of texts(text); keys are the sorted hashes of the shard's texts that hold the trigram.

    A text that repeats has one entry, and its rows are folded before the shuffle, which holds a hash and a trigram for each entry.
    """
    rows = texts.select(F.xxhash64("text").alias("key"), F.lower("text").alias("lower"))
    held = F.explode(F.array_compact(F.array(*[F.when(posting(t), F.lit(t)) for t in trigrams])))
    entries = rows.select("key", held.alias("trigram"))
    return entries.groupBy(F.pmod("key", F.lit(shards)).alias("shard"), "trigram").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def _intersected(lists: Column) -> Column:
    """The keys that all of `lists` hold, the shortest list first, so that what is left stays short."""
    by_size = lambda ordered: F.aggregate(F.slice(ordered, F.lit(2), F.size(ordered)), F.get(ordered, F.lit(0)).cast(_KEYS), F.array_intersect)
    return _bound(F.array_sort(lists, lambda a, b: F.size(a) - F.size(b)), by_size)


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(key, no): the texts that the trigram query of each rule number admits, from the lists of the index alone."""
    shard = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    of = lambda t: F.coalesce(F.col("lists")[t], F.array().cast(_KEYS))
    admitted = {no: F.array_distinct(F.concat(*[_intersected(F.array(*[of(t) for t in sorted(c)])) for c in query])) for no, query in queries.items()}
    pair = lambda no: lambda k: F.struct(k.alias("key"), F.lit(no).alias("no"))
    pairs = F.concat(*[F.transform(keys, pair(no)) for no, keys in admitted.items()])
    return shard.select(F.explode(pairs).alias("c")).select("c.key", "c.no")


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(key, F.lit(slots)) + 1


def candidate_bitmaps(found: DataFrame, numbers: list[int], slots: int) -> DataFrame:
    """(bucket, c0, c1, ...): for each rule number a bitmap of the slots of its candidates; slots / 2^15 rows of 4 kB a rule at most."""
    slot = _slot(F.col("key"), slots)
    bits = [F.bitmap_construct_agg(F.when(F.col("no") == no, F.bitmap_bit_position(slot))).alias(f"c{no}") for no in numbers]
    return found.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(*bits)


def _bit(bitmap: Column, slot: Column) -> Column:
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


_SPAN = "array<struct<start:bigint,no:int,stop:bigint,kind:string>>"


#: Matches of a text whose places are summed in one fold.
RUN = 256


def _bound(value: Column, body) -> Column:
    """body(value), with value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(parts: Column) -> Column:
    """(start, stop) of each of `parts`, an array of (gap, size): what stands before a match and the match.

    Runs of RUN matches are summed first, and each is placed from its offset, so that no
    fold copies an array that grows with the text.
    """
    part = lambda i: F.slice(parts, i * RUN + 1, RUN)
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<start:bigint,stop:bigint>>")
    runs = F.sequence(F.lit(0), F.floor((F.greatest(F.size(parts), F.lit(1)) - 1) / RUN).cast("int"))
    total = F.transform(runs, lambda i: F.aggregate(part(i), zero, lambda acc, x: acc + x["gap"] + x["size"]))
    offsets = F.aggregate(total, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def placed(i: Column, offset: Column) -> Column:
        begin = F.struct(offset.alias("at"), none.alias("spans"))
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("stop")))).alias("spans"),
        )
        return F.aggregate(part(i), begin, step, lambda acc: acc["spans"])

    return F.flatten(F.zip_with(runs, F.slice(offsets, F.lit(1), F.size(runs)), placed))


def _spans(text: Column, rule: Rule, no: int) -> Column:
    """All kept matches of the rule: what stands between matches gives their places."""
    pattern = F.lit(rule.pattern)
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    groups = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sizes = F.zip_with(found, between, lambda m, b: F.struct(F.length(b).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    placed = _bound(F.filter(sizes, lambda x: x["size"].isNotNull()), _places)  # one more part stands between than matches
    kept = F.filter(F.zip_with(placed, groups, lambda s, g: F.when(F.length(g) >= rule.least, s)), lambda s: s.isNotNull())
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["stop"].alias("stop"), F.lit(rule.kind).alias("kind"))).cast(_SPAN)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, most_slots: int = MOST_SLOTS) -> DataFrame:
    """(doc_id, text, spans) of each row of docs(doc_id, text), which is read twice and must hold the same texts each time.

    spans: structs (start, no, stop, kind) in code points, stop exclusive, sorted by
    start, then by the rule's number. Spans of one rule never overlap; those of
    different rules may. most_slots bounds the bitmaps of candidates: with many more candidates than slots
    more texts are gone through, and spans are the same.

    Defined results: a null text is empty and has no spans; null and repeated doc_ids
    are scanned row by row; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {no: q for no, q in ((no, trigram_query(r.pattern)) for no, r in enumerate(rules)) if q}
    admits = {}
    if queries:
        rows = max(docs.count(), 1)
        slots = min(1 << max(15, (SLOTS * rows - 1).bit_length()), most_slots)
        trigrams = sorted({t for q in queries.values() for c in q for t in c})
        index = checkpoint(build_index(docs, trigrams, -(-rows // SHARD)))
        bitmaps = checkpoint(candidate_bitmaps(candidates(index, queries), list(queries), slots))
        slot = _slot(F.xxhash64("text"), slots)
        docs = docs.withColumn("slot", slot).join(F.broadcast(bitmaps), F.bitmap_bucket_number("slot") == F.col("bucket"), "left")
        admits = {no: _bit(F.col(f"c{no}"), F.col("slot")) for no in queries}
    spans = []
    for no, rule in enumerate(rules):
        asked = admits[no] if no in admits else F.col("text").rlike(rule.pattern)
        spans.append(F.when(asked, _spans(F.col("text"), rule, no)).otherwise(F.array().cast(_SPAN)))
    return docs.select("doc_id", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that `scan_secrets` found."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["no"] < len(BASE_RULES))
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"),
    )
