"""Repeats, collocations and ranked search against plain implementations, on edge rows; bounds and weights of the others."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyscape.llm import collocations, decontam, lexical, mixing, runtime, secrets, substring, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows, columns="doc_id long, text string", parts=3):
    """Rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, columns).withColumns({"hash": F.lit("x"), "at": F.lit(1), "rank": F.lit(0), "n": F.lit(None).cast("string")}).repartition(parts)


# --- op11 --------------------------------------------------------------------------------


def plain_repeats(rows, window):
    first, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = WORD.findall(text or "")
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first.setdefault(tuple(own[i : i + window]), (doc_id, i)) != (doc_id, i):
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(own), sum(gone), " ".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return out


def repeat_rows(seed=1):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(70)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "a " * 500), (5, "A " * 25 + "a " * 25), (6, "é " * 19), (7, "é " * 20), (8, "é\xa0b " * 40), (None, " ".join(passage))]
    for k in range(10, 60):
        text = [rng.choice("xyz") + str(rng.randrange(400)) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            lo = rng.randrange(40)
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[lo : lo + rng.choice((19, 20, 21, 30))]
        rows.append((k, rng.choice((" ", "\n", " \t ")).join(text)))
    return rows + [(k + 100, t) for k, t in rows[20:30]]


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 60}, {"slice_bytes": 3_000, "part_bytes": 10}])
def test_repeats_as_plain(spark, options):
    rows = repeat_rows()
    got = substring.repeats(docs(spark, rows), window=20, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == sorted(plain_repeats(rows, 20), key=str)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_repeats_of_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (1, text + " x"), (None, text), (None, None), (2, "y " + text)]
    out = substring.repeats(docs(spark, rows), window=20).collect()
    same = [r.n_removed for r in out if r.doc_id == 1 and r.n_words == 30]
    assert len(out) == 6 and same[0] == same[1] and {r.n_removed for r in out if r.doc_id == 2} == {30} and [r.n_removed for r in out if r.doc_id is None and r.n_words] == [30]
    assert sorted(r.n_removed for r in out if r.doc_id == 1) in ([0, 0, 30], [0, 30, 30])
    assert substring.digest(substring.repeats(docs(spark, rows).filter("false"), window=20)).count() == 0


def test_one_long_text(spark):
    unit = " ".join(f"w{k % 9_000}" for k in range(400_000))
    r = substring.repeats(docs(spark, [(1, unit), (2, "short")]), window=20).filter("doc_id = 1").first()
    assert (r.n_words, r.n_removed) == (400_000, 391_000)


def test_packed_numbers():
    rng = np.random.default_rng(0)
    for values in ([], [0], [0, 0, 1], [5], [255, 256, 70_000, 2**63], np.sort(rng.integers(0, 2**62, 999))):
        assert substring.decode(substring.encode(np.array(values, np.uint64))).tolist() == [int(v) for v in values]


# --- op12 --------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            own = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und" if lang is None else lang] += len(own)
            for n in (1, 2, 3):
                f[lang if lang is not None else "und"].update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    out = []
    for lang, count in f.items():
        best = []
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"held": 40, "part_words": 3}, {"part_words": 1}])
def test_collocations_as_plain(spark, options):
    rng = random.Random(2)
    rows = [(None, "en"), ("", "en"), ("..,;\n", None), ("word", None), ("x" * 100_000 + " y", "en")]
    for k in range(150):
        own = [rng.choice(["New", "york", "CITY", "é", "\U0001F600", "a", "b", "c", "-", "new york"]) for _ in range(rng.randrange(40))]
        rows.append((rng.choice((" ", "\t", "  ")).join(x + rng.choice(("", "", "", ".", ",", "\n", "\x0b")) for x in own), rng.choice(("en", "en", "de", None, ""))))
    df = docs(spark, rows, "text string, lang string").withColumn("f", F.lit(3)).withColumn("h", F.lit("h"))
    for least, top in ((2, 1000), (5, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(df, least=least, top=top, **options).collect())
        assert got == plain_collocations(rows, least, top)
    assert collocations.collocations(df.filter("false")).count() == 0


def test_collocation_counts_beyond_64_bits(spark):
    score = lambda a, l, r: spark.range(1).select(collocations._score(*[F.lit(x).cast("long") for x in (a, l, r)]).alias("s")).first().s
    for a, l, r in ((10**12, 10**12, 10**13), (3 * 10**12 + 7, 4 * 10**12, 9 * 10**12 + 1), (10, 10, 10), (10, 3 * 10**9, 10**9)):
        assert score(a, l, r) == 1_000_000 * a * a // (l * r)


def test_hat_trie_bursts_and_spills():
    rng = np.random.default_rng(1)
    trie, whole = collocations.HatTrie(burst=50), Counter()
    spilled = []
    for _ in range(60):
        ids = rng.zipf(1.4, (200, 3)).clip(1, 2_000)
        keys, counts = np.unique(ids[:, 0] << 42 | ids[:, 1] << 21 | ids[:, 2], return_counts=True)
        whole.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        trie.add(keys, counts)
        if len(trie) > 2_000:
            spilled.append(trie.spill(1_000))
            assert len(trie) <= 1_000
    spilled.append(trie.spill(0))
    found = Counter()
    for keys, counts in spilled:
        assert (np.diff(keys) > 0).all()  # a sorted run, each phrase once
        found.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert found == whole and len(trie) == 0 and len(trie.leaves) > 10 and trie.low == sorted(trie.low)


# --- op13 --------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, top):
    terms = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(d, Counter(terms(t))) for d, t in rows]
    texts = [(d, c, sum(c.values())) for d, c in texts if c]
    n_docs, total, df = len(texts), sum(n for *_, n in texts), Counter(t for _, c, _ in texts for t in c)
    by_item = defaultdict(set)
    for i, t in items:
        by_item[i] |= set(terms(t))
    out = []
    for i, own in by_item.items():
        found = []
        for d, c, n in texts:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def search_rows():
    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(60)] + ["É", "\U0001F600", "Ab", "AB"]
    rows = [(0, None), (1, ""), (2, "-- !!"), (3, "rare"), (4, "t1 " * 3_000), (None, "t1 t2 rare")]
    rows += [(k, " ".join(rng.choice(vocabulary[: rng.randrange(1, 64)]) for _ in range(rng.choice((1, 5, 40, 300))))) for k in range(10, 200)]
    rows += [(k + 1000, t) for k, t in rows[20:60]] + [(k + 2000, rows[30][1]) for k in range(150)]  # copies, and a large group of them
    items = [(1, "t1 t2 t3"), (2, "rare É"), (3, None), (4, ""), (5, "nowhere"), (6, "ab AB aB \U0001F600"), (None, "t59"), (7, rows[30][1]), (8, "t5"), (8, "t6"), (9, " ".join(vocabulary))]
    return rows, items


@pytest.mark.parametrize("options", [{}, {"part_terms": 5}, {"most_ids": 0}])
def test_search_as_plain(spark, options):
    rows, items = search_rows()
    bench = docs(spark, items, "item_id long, text string")
    for top in (3, 10):
        got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs(spark, rows), bench, top=top, **options).collect()]
        assert sorted(got, key=str) == plain_search(rows, items, top)
    assert lexical.search(docs(spark, rows).filter("false"), bench).count() == 0 and lexical.search(docs(spark, rows), bench.filter("false")).count() == 0


def test_bounds_are_never_below_scores_and_exclude_most():
    rows, items = search_rows()
    rows = [r for r in rows if r[1]]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    row, value, count, size = lexical._terms(batch)
    block = lexical._Block(1 << 10)
    for r, (d, _) in enumerate(rows):
        block.ids.append(d)
        block.sizes.append(int(size[r]))
        block.words.append(value[row == r])
        block.counts.append(count[row == r])
    held = {c: block.batch().column(c)[0].as_py() for c in ("width", "ids", "sizes", "slices")}
    pairs = []
    for i, t in items:
        own = lexical._terms(pa.RecordBatch.from_arrays([pa.array([t or ""])], ["text"]))[1]
        pairs += [(i, int(h)) for h in own]
    model = lexical._Items(pairs)
    model.weigh({t: len(set(row[value == h])) for t, h in enumerate(model.words)}, sum(size > 0), int(size.sum()))
    m, close = model.damping(np.maximum(size, 1)), 0
    for i, bound in lexical._bounds(model, held):
        own = model.term[model.cut[i] : model.cut[i + 1]]
        exact = np.zeros(len(rows), np.int64)
        for t in own:
            for at in np.flatnonzero(value == model.words[t]):
                exact[row[at]] += model.weight[t] * lexical._gain(count[at], m[row[at]])
        assert (bound >= exact).all()
        close += (bound <= exact * 1.1).sum()
    assert close > 0.8 * len(rows) * len(model.ids)


# --- words, parts, weights, rules --------------------------------------------------------


def test_long_words_and_strips():
    text = ["ab " * 5 + "x" * 9_000 + " é", "", None, "y" * 700 + " " + "y" * 700, "one"]
    data, ends = runtime.text_buffer(pa.array(text, pa.string()))
    start, stop, first = words.words(data, ends, words.SPACED)
    for strip in (1, 7, 1 << 22):
        a, b, c, h = words.hashed_words(data, ends, words.SPACED, strip=strip)
        assert a.tolist() == start.tolist() and b.tolist() == stop.tolist() and c.tolist() == first.tolist() and (h == words.hashes(data, start, stop)).all()
    assert words.strings(data, start, stop).to_pylist() == [x for t in text for x in (t or "").split()]
    # Thue-Morse words, whose polynomials modulo 2**64 are equal whatever the base
    t = [bin(k).count("1") % 2 for k in range(2048)]
    one, two = ("".join("ab"[x ^ flip] for x in t) for flip in (0, 1))
    data, ends = runtime.text_buffer(pa.array([one, two]))
    h = words.hashed_words(data, ends, words.SPACED)[3]
    assert h[0] != h[1]


def test_passes_keep_their_bound(spark):
    rows = runtime.checkpoint(spark.range(500).selectExpr("id % 100 as k", "if(id % 100 = 7, 50L, 1L + id % 3) as n"))
    for most in (10, 60, 10_000):
        parts = runtime.passes(rows, ["k"], "n", most)
        got = [(p.agg(F.sum("n")).first()[0], p.select("k").distinct().count()) for p in parts]
        assert sum(n for n, _ in got) == rows.agg(F.sum("n")).first()[0] and all(n <= most or k == 1 for n, k in got) and sum(k for _, k in got) == 100
    assert runtime.passes(rows.filter("false"), ["k"], "n", 5) == []


def test_benchmark_parts_keep_their_bound(spark, monkeypatch):
    """Repeated and long items: no pass is empty or over its bound, and results are those of one pass."""
    item = " ".join(f"w{k}" for k in range(2_000))
    bench = spark.createDataFrame([(1, item)] * 3 + [(2, "w5 w6 w7"), (3, "w1999")], "item_id long, text string")
    texts = [(1, "a " + " ".join(f"w{k}" for k in range(240, 275)) + " b w5 w6 w7 w1999"), (2, "w1 w2"), (3, item), (4, None)]
    seen = []
    plain = decontam.Phrases.__init__

    def begin(self, items, window):
        seen.append(sum(len((t or "").split()) for _, t in items))
        plain(self, items, window)

    monkeypatch.setattr(decontam.Phrases, "__init__", begin)
    columns = ("doc_id", "n_words", "n_hit", "contaminated", "items", "words", "chars")
    read = lambda **o: sorted(str([r[c] for c in columns]) for r in decontam.removal_spans(docs(spark, texts), bench, **o).collect())
    whole = read()
    assert seen == [2004]
    seen.clear()
    assert read(part_words=400) == whole and 6 <= len(seen) <= 30 and all(0 < n <= 400 for n in seen)
    assert decontam.digest(decontam.removal_spans(docs(spark, texts), bench)).filter("doc_id = 1").first().spans == "1:36,37:41"


def test_weights_of_any_value(spark):
    values = [0.0, -1.0, float("inf"), float("-inf"), float("nan"), None, 5e-324, 1e308, 1.0, 2.0]
    df = spark.createDataFrame([(k, "s", "a b c", v) for k, v in enumerate(values)] + [(99, "t", "d " * 5, 1.0)], "doc_id long, source string, text string, w double")
    out = mixing.mix(df, weight=F.col("w")).collect()
    assert sorted(r.doc_id for r in out) == [*range(10), 99]
    for source in "st":
        own = [r for r in out if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target)
    drawn = Counter()
    for k in range(5):
        drawn.update(r.doc_id for r in mixing.mix(df.filter("source = 's' or doc_id = 99"), weights=(1, 9), most=3, seed=f"s{k}", weight=F.col("w")).collect() if r.taken)
    assert drawn[2] == drawn[7] == 5 and max(drawn[k] for k in (0, 1, 3, 6)) < drawn[8] == 5  # bounded above and below


def test_rules_take_linear_time(spark):
    def seconds(size):
        began = time.perf_counter()
        df = spark.createDataFrame([(1, ".eyJx " + "eyJ" * (size // 3))], "doc_id long, text string")
        assert secrets.digest(secrets.scan_secrets(df)).first().n_spans == 0
        return time.perf_counter() - began

    seconds(30)
    assert seconds(1_000_000) < 20
    token = "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0." + "SflKxwRJSMeKKF2QT"
    found = secrets.scan_secrets(spark.createDataFrame([(1, f"a {token} {token[:-14]}, x{token}")], "doc_id long, text string")).first()
    assert [s.start for s in found.spans if s.kind == "web_token"] == [2]


def test_exact_scores_by_fractions():
    """The floors of lexical scores are those of exact division."""
    tf, m = np.array([1, 2, 7, 20_000]), np.array([10, 100, 3, 99_999])
    assert lexical._gain(tf, m).tolist() == [math.floor(Fraction(10**9 * int(a), 1000 * int(a) + 8 * int(b))) for a, b in zip(tf, m, strict=True)]
