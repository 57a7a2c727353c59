"""The whole job on tables that are not one clean row per key: lists in texts, repeated and null ids, large keys."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyscape.llm import decontam, pii, quality, setsketch

# --- personal data in lists ------------------------------------------------------------

LISTS = {
    "phone": ["415-555-0132", "415-555-0199", "(724) 555-7058", "646.555.0110"],
    "ssn": ["123-45-6789", "219-09-9999", "987-65-4321"],
    "card": ["4111111111111111", "5500000000000004", "4000-0566-5566-5556"],
}


@pytest.mark.parametrize("sep", [", ", "\n", ",\n", "; ", ",", " / ", "\n- "])
@pytest.mark.parametrize("kind", sorted(LISTS))
def test_pii_lists_give_each_item(kind, sep):
    model = pii.train()
    for n in (1, 2, 3, 6):
        items = [LISTS[kind][k % len(LISTS[kind])] for k in range(n)]
        for lead, tail in (("", ""), ("numbers: ", "."), ("call ", " now")):
            text = lead + sep.join(items) + tail
            assert [(pii.KINDS[k], text[a:b]) for a, k, b, _ in pii._found([text], model)[0]] == [(kind, x) for x in items]


def test_pii_base_spans_part_a_run():
    model = pii.train()
    found = lambda t: [(t[a:b], base) for a, _, b, base in pii._found([t], model)[0]]
    assert found("+1 415-555-0132, 415-555-0199, 212-555-0144") == [("+1 415-555-0132", 1), ("415-555-0199", 0), ("212-555-0144", 0)]
    assert found("415-555-0132 a@b.co 415-555-0199") == [("415-555-0132", 0), ("a@b.co", 1), ("415-555-0199", 0)]
    assert found("1,200,300,400 items") == []


# --- contaminated documents ------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def stored(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


PASSAGE = " ".join(f"t{i}" for i in range(20))


def test_decontaminate_judges_each_row(spark, tmp_path):
    folder = stored(spark, tmp_path, benchmark=spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"))
    rows = [(None, PASSAGE), (None, "clean"), (1, PASSAGE), (1, "clean too"), (2, None), (3, "")]
    kept = corpus_pipeline.decontaminate(spark, corpus(spark, rows), folder)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str) == [(1, "clean too", 9), (2, None, None), (3, "", 0), (None, "clean", 5)]


def test_carried_rows_in_small_batches_and_many_parts(spark, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "q r s")], "item_id long, text string")
    rows = [(k % 7 or None, ("q r s " if k % 3 else "") + f"word{k} " * (k % 5) + (PASSAGE if k % 4 == 0 else "")) for k in range(60)]
    docs = corpus(spark, rows)
    monkeypatch.setattr(decontam, "HELD_BYTES", 64)
    for options in ({}, {"part_words": 2}, {"part_words": 1, "shard_words": 5}):
        shuffled = docs.repartition(7) if options else docs
        out = decontam.removal_spans(shuffled, bench, carry=["text", "doc_id"], **options).collect()
        assert sorted(((r.doc.doc_id, r.doc.text) for r in out), key=str) == sorted(rows, key=str) and all(r.doc_id == r.doc.doc_id for r in out)
        assert all(r.contaminated == any(x in r.doc.text for x in ("q r s", PASSAGE)) for r in out)


# --- near duplicates by row ------------------------------------------------------------


def test_near_dedup_by_row(spark):
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    near = lambda tag: text(tag) + " more"
    rows = [
        (1, text("a")), (1, text("b")), (1, text("b")),  # one id, two texts, one of them twice
        (2, near("a")), (3, near("b")),  # near copies of both
        (None, text("c")), (None, text("c")), (None, text("d")), (4, near("d")),  # null ids
        (5, None), (5, None), (None, ""), (6, " \n"),
    ]
    kept = corpus_pipeline.near_dedup(spark, corpus(spark, rows).repartition(5), "")
    assert kept.columns == corpus_pipeline.COLUMNS
    expected = [(1, text("a")), (1, text("b")), (None, text("c")), (4, near("d")), (5, None), (5, None), (None, ""), (6, " \n")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_run_hands_on_written_tables(spark, tmp_path, monkeypatch):
    docs = corpus(spark, [(k, f"text {k}") for k in range(9)])
    folder = stored(spark, tmp_path, documents=docs)
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs.withColumn("n_chars", F.col("n_chars") + F.rand())

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    corpus_pipeline.run(spark, folder)
    assert len(seen) == 3 and len({tuple(x) for x in seen}) == 3 and all(seen)


# --- benchmark items without an id, several passes ---------------------------------------


def test_null_items_hit(spark):
    bench = spark.createDataFrame([(None, PASSAGE), (1, "q r s"), (2, None)], "item_id long, text string")
    docs = corpus(spark, [(1, PASSAGE), (2, "q r s " + PASSAGE), (3, "none")])
    for options in ({}, {"part_words": 2}):
        out = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontam.removal_spans(docs, bench, **options).collect()}
        assert out == {1: (20, [], True), 2: (23, [1], True), 3: (0, [], False)}


def test_passes_read_the_same_numbered_rows(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    docs = corpus(spark, [(k, PASSAGE if k % 2 else "q r s") for k in range(20)])
    docs = docs.mapInArrow(seen, docs.schema)
    bench = spark.createDataFrame([(k, f"{PASSAGE} u{k}") for k in range(8)], "item_id long, text string")
    out = decontam.removal_spans(docs, bench, part_words=20).collect()
    assert calls.value == 20 and len(out) == 20 and all(r.contaminated == (r.doc_id % 2 == 1) for r in out)


# --- labelled ids that repeat ------------------------------------------------------------


def test_repeated_labelled_ids_train_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, **_: seen.extend(rows))
    docs = corpus(spark, [(1, f"text {k}") for k in range(50)] + [(2, "other"), (3, "unlabelled")])
    quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert sorted(label for _, label in seen) == [0, 1]


# --- each stage on edge rows, and the whole pipeline by brute force ---------------------------


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows(spark, tmp_path, stage):
    """Nulls in any column, repeated rows, empty and long texts, clashing columns, no rows at all."""
    folder = stored(
        spark, tmp_path, benchmark=spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string"),
        labels=spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int"),
    )
    rows = [(1, "good words here", "en", "s", 15), (1, "good words here", "en", "s", 15), (2, None, None, None, None), (None, "", "en", None, 0), (3, " \n\t", None, "t", 3), (4, "word " * 60_000, "en", "t", 300_000), (None, PASSAGE, "en", "s", None)]
    clash = [F.lit("clash").alias(c) for c in ("score", "predicted", "_text", "_key", "doc", "row", "spans", "size", "key", "bin", "taken", "component_id", "h", "weight")]
    docs = spark.createDataFrame(rows, DOCS).select("*", *clash)
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, folder)
    if stage == "mix":
        assert {"doc_id", "source", "text", "taken"} <= set(out.columns) and all(0 < r.taken <= 3 * r["size"] for r in out.collect())
    else:
        assert out.columns == corpus_pipeline.COLUMNS
        kept = [tuple(r) for r in out.collect()]
        dropped = {"near_dedup": [rows[1]], "decontaminate": [rows[6]]}.get(stage, [])
        if stage != "quality":
            left = list(rows)
            for r in dropped:
                left.remove(r)
            lengths = [(i, t, lang, s, len(t) if stage == "pii" and t is not None else n) for i, t, lang, s, n in left]
            assert sorted(kept, key=str) == sorted(lengths, key=str)
        else:
            assert set(kept) <= set(rows)
    assert run(spark, docs.limit(0), folder).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() against the five stages written down plainly, over one small corpus; the classifier's weights are the operator's own."""
    import math
    import random
    import re

    import pyarrow as pa

    from keyscape.llm import mixing

    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "light", "house", "green", "field"]) + str(rng.randrange(30)) for _ in range(n))
    bench = [(k, prose(20)) for k in range(4)]
    rows = []
    for k in range(120):
        t = prose(rng.randrange(20, 60))
        if k % 7 == 0:
            t = "BUY!!! NOW!!! CHEAP!!! " * 6 + t[:20]
        elif k % 5 == 0 and rows:
            t = rows[-1][1] + ("" if k % 2 else " tail")
        elif k % 11 == 0:
            t += " " + bench[k % 4][1]
        elif k % 13 == 0:
            t += " mail a@b.example.org or 415-555-0132"
        rows.append((k, t, "en", f"s{k % 4}" if k % 9 else None, len(t)))
    rows.append((500, None, None, "s1", None))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 7 > 0)) for k in range(120)], "doc_id long, quality int")
    folder = stored(spark, tmp_path, documents=docs, labels=labels, benchmark=spark.createDataFrame(bench, "item_id long, text string"))

    weights = quality.fit(docs.select("doc_id", "text"), labels)

    def good(t):
        slots = set(quality.features(pa.array([t or ""]))[0].tolist())
        return sum(float(weights[i]) for i in slots) / math.sqrt(max(1, len(slots))) + float(weights[-1]) >= 0

    one = [r for r in rows if good(r[1])]
    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r[1] or "").lower().split()) else set() for r in one}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    two = [r for r in one if find(r[0]) == r[0]]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    windows = {tuple(w[i : i + 13]) for _, t in bench for w in [words(t)] for i in range(len(w) - 12)}

    def clean(t):
        w = words(t)
        hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
        return not hit or 20 * len(hit) < len(w)

    three = [r for r in two if clean(r[1])]
    model, four = pii.train(), []
    for i, t, lang, s, _ in three:
        at, out = 0, ""
        for a, no, b, _ in pii._found([t], model)[0] if t else []:
            out, at = out + t[at:a] + f"<{pii.KINDS[no].upper()}>", b
        four.append((i, out + t[at:] if t else t, lang, s))
    assert len(rows) > len(one) > len(two) > len(three) and any("<PHONE>" in (t or "") for _, t, *_ in four)

    size = {i: len((t or "").split()) for i, t, *_ in four}
    own = {}
    for i, _, _, s in four:
        own.setdefault(s, []).append(i)
    left, total, open_, target = sum(size.values()), {s: sum(size[i] for i in d) for s, d in own.items()}, {}, {}
    for k, s in enumerate(sorted(own, key=lambda s: (s is None, s or ""))):
        open_[s] = (5, 2, 1)[k % 3]
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 3 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
            del open_[s]
    target |= share
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), "mix").alias("u")).collect()}
    expected = {}
    for s, ids in own.items():
        text = {i: t or "" for i, t, *_ in four}
        key = {i: -math.log(u[i]) / (sum(c.isalpha() for c in text[i]) / max(1, len(text[i])) + 0.1) for i in ids}
        epochs = int(target[s] // total[s])
        budget = math.floor(target[s] - epochs * total[s])
        for i in sorted(ids, key=lambda i: (key[i], i)):
            part = max(0, min(budget, size[i]))
            expected[i] = epochs * size[i] + part
            budget -= part
    got = {r.doc_id: (r.taken, r.text) for r in corpus_pipeline.run(spark, folder).collect()}
    texts = {i: t for i, t, *_ in four}
    assert got == {i: (n, texts[i]) for i, n in expected.items() if n > 0}
