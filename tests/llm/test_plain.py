"""Operators against plain implementations of what they compute, and texts and columns of extreme shapes."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyscape.llm import chat, embed_dedup, langid, mixing, pii, quality, queries, runtime, secrets, setsketch, tokencount

SF = "/root/testdata/sf0.001"


# --- op1: many matches, and postings ------------------------------------------------------


def test_many_secrets_in_a_text(spark):
    n = 80_000
    df = spark.createDataFrame([(1, "é " + "0123456789abcdef01234567 " * n), (2, "token=abcdef " * 1000)], "doc_id long, text string")
    began = time.monotonic()
    many, few = (r.spans for r in secrets.scan_secrets(df).orderBy("doc_id").collect())
    assert [(s.start, s.stop) for s in many] == [(2 + 25 * k, 26 + 25 * k) for k in range(n)]
    assert [(s.start, s.stop) for s in few] == [(13 * k, 13 * k + 12) for k in range(1000)]
    assert time.monotonic() - began < 100


def test_secret_scan_moves_no_text(spark):
    plan = secrets.scan_secrets(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 0 and "Python" not in plan and "Arrow" not in plan


def test_candidates_hold_all_matches(spark):
    """The index lists the texts that hold a trigram, and the candidates are those that its lists admit: all matches among them."""
    texts = ["", "nothing", "PassWord = abcdef", "api-key", "apiKEY: 123456", "xapi_keyx=123456", "AKIA" + "Z" * 16, "akia", "gho_" + "a" * 36, "github_pat_" + "b" * 22, "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10, "xoxb-0123456789", "-----BEGIN RSA PRIVATE KEY-----", "pas ass ssw swo wor ord"]
    df = spark.createDataFrame([(t,) for t in texts * 2], "text string")
    key = {r.k: r.text for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    queries = {no: q for no, r in enumerate(rules) if (q := secrets.trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    for shards in (1, 3):
        index = secrets.build_index(df, trigrams, shards)
        lists = {t: {key[k] for r in index.filter(F.col("trigram") == t).collect() for k in r["keys"]} for t in trigrams}
        assert lists == {t: {x for x in texts if t in x.lower()} for t in trigrams}
        found = {(key[r.key], r.no) for r in secrets.candidates(index, queries).collect()}
        assert found == {(x, no) for x in texts for no, q in queries.items() if any(all(t in x.lower() for t in c) for c in q)}
    for no in queries:
        rows = df.select("text", F.col("text").rlike(rules[no].pattern).alias("match")).collect()
        assert {(r.text, no) for r in rows if r.match} <= found and any(r.match for r in rows)


def test_few_slots_change_no_span(spark):
    texts = [f"{'x' * k} token=abcdef{k}" if k % 3 else "plain " + "AKIA" + "Z" * 16 * (k % 2) for k in range(60)] + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    few, many = (sorted(map(tuple, secrets.digest(secrets.scan_secrets(df, most_slots=n)).collect())) for n in (1, secrets.MOST_SLOTS))
    assert few == many and sum(r[1] for r in few) == 40


# --- op2: the network evaluated plainly over whole texts -------------------------------------


def plain_language(text, model):
    if text is None or not any(c.isalpha() for c in text):
        return langid.UNKNOWN, 0.0
    data, mass = text.encode(), np.zeros(len(model.languages))
    for lo in range(0, len(data), model.window):
        row = [int(langid.CLASS[b]) for b in data[lo : lo + model.window + 3]] + [0] * (model.window + 3)
        best = np.full(len(model.bias), -np.inf)
        for at in range(model.window):
            best = np.maximum(best, sum(model.taps[k][row[at + k]].astype(float) for k in range(4)))
        logit = np.maximum(best + model.bias, 0) @ model.dense + model.dense_bias
        p = np.exp(logit - logit.max())
        mass += p / p.sum() * sum(c > 0 for c in row[: min(model.window, len(data) - lo)])
    return model.languages[int(mass.argmax())], mass.max() / mass.sum()


def test_language_by_plain_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.filter(queries._fold(4) != 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in queries.op2_byte_cnn_language(spark, SF).collect()}
    assert out.keys() == texts.keys()
    for i in sorted(texts)[::7]:
        lang, score = plain_language(texts[i], model)
        assert out[i].lang_pred == lang and abs(out[i].score - score) < 1e-4


def test_all_languages_are_learnt(spark):
    """More languages than there is room for keep a text each."""
    rows = [(k, f"text {k}", f"l{k % 40:02}") for k in range(400)]
    picked = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=300, most=50, most_bytes=1 << 20).collect()
    assert [r.lang for r in picked] == [f"l{k:02}" for k in range(40)]
    full = langid.training_rows(spark.createDataFrame(rows + rows, "doc_id long, text string, lang string"), per_language=5, most=10_000, most_bytes=1 << 20).collect()
    assert len(full) == 200 and len({r.text for r in full}) == 200  # repeated rows count once


def test_training_texts_are_whole(spark):
    """The number of texts gives way to their bytes: none is cut."""
    texts = [(k, f"{k} " + "abc " * (250 if k else 5_000), "x") for k in range(40)] + [(100, "short", "y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    for most in (1 << 20, 20_000, 100):
        picked = langid.training_rows(docs, 30, 1000, most).collect()
        own = [r.text for r in picked if r.lang == "x"]
        assert {r.text for r in picked} <= {t for _, t, _ in texts} and sum(map(len, own)) <= most // 2
        assert len(own) == (30 if most == 1 << 20 else most // 2 // 1004) or (most == 1 << 20 and len(own) == 30) or abs(len(own) - most // 2 // 1003) <= 1


def test_long_text_takes_little_memory(spark):
    """A text of 50 MB: windows are cut as they are scored."""
    import tracemalloc

    model = langid.train(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30, steps=20)
    data = np.frombuffer(b"der hund " * 5_600_000, np.uint8)
    ends = np.array([0, len(data)])
    tracemalloc.start()
    codes = langid.CLASS[data]
    begin, owner = langid.place_windows(ends, model.window)
    for k in range(0, 4 * langid.BLOCK, langid.BLOCK):
        model.windows(langid.cut_windows(codes, ends, model.window, begin[k : k + langid.BLOCK], owner[k : k + langid.BLOCK]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * len(data)


# --- op3: weights of the caller's, carried columns ----------------------------------------------


def test_mix_with_given_weights(spark):
    """A heavy document's key is smaller on average; the mix equals a plain one over sorted keys."""
    rows = [(i, "s" if i % 3 else "t", "w " * (i % 9 + 1), 10.0 if i % 2 else 0.01) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, w double").withColumn("taken", F.lit("clash"))
    out = {r.doc_id: r for r in mixing.mix(df, weights=(5, 2), weight=F.col("w"), carry=("text", "w")).collect()}
    assert all(out[i].text == t and out[i].w == w for i, _, t, w in rows)
    u = {r.doc_id: r.u for r in df.select("doc_id", mixing.uniform(F.col("doc_id"), "mix").alias("u")).collect()}
    for s in "st":
        own = sorted((-math.log(u[i]) / w, i, len(t.split())) for i, source, t, w in rows if source == s)
        size, target = sum(n for *_, n in own), out[own[0][1]].target
        epochs = int(target // size)
        left = int(target - epochs * size)
        for _, i, n in own:
            part = max(0, min(left, n))
            assert out[i].taken == epochs * n + part
            left -= part


# --- op4: ties, doubles, and the recall of bounded visits ------------------------------------------


def test_embedding_ties(spark):
    rows = [(1, [10.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (2, [9.0, 4.0, 1.0, 1.0, 1.0, 0.0]), (3, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0]), (4, [9.0, 4.0, 1.0, 1.0, 1.0, 1e-6]), (5, [0.0, 0.0, 1e-300, 0.0, 0.0, 0.0])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    # 1 and 2 have a cosine of 0.9 exactly; 4, whose last component only a double tells from 2's, lies below it from 1
    assert out == {1: (2, 1), 2: (3, 1), 3: (2, 1), 4: (1, 1), 5: (0, 5)}


@pytest.mark.parametrize("cosine,least", [(0.9, 0.95), (0.98, 0.998)])
def test_recall_of_bounded_visits(spark, cosine, least):
    """Partners at the given cosine in random directions, among vectors spread evenly over the sphere: the hardest case."""
    rng = np.random.default_rng(4)
    x = embed_dedup.unit(rng.normal(size=(3000, 64)))
    z = rng.normal(size=x.shape)
    z = embed_dedup.unit(z - (z * x).sum(1, keepdims=True) * x)
    c = cosine + 1e-6
    both = np.concatenate([x, c * x + math.sqrt(1 - c * c) * z])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    out = embed_dedup.near_embeddings(df, cosine=cosine, cell_size=60).collect()  # 100 cells, of which 6 are visited
    links = {r.vec_id: r.n_links for r in out}
    found = [i for i in range(3000) if links[i]]
    assert len(found) >= least * 3000
    assert all(links[i + 3000] for i in found) and all(r.component_id == r.vec_id % 3000 for r in out if links[r.vec_id])


# --- op6: long words, many base spans, recall and precision of the model ----------------------------


def test_pii_is_linear():
    model = pii.train()
    began = time.monotonic()
    text = "x" * 1_000_000 + " 415-555-0132 " + "漢" * 1_000_000 + "7 " + "a@b.co 415-555-0132 " * 20_000
    spans = pii._found([text], model)[0]
    assert len(spans) == 40_001 and time.monotonic() - began < 60
    assert [text[a:b] for a, b in pii.loaded("ab1 c @ d2\n\n3e f")] == [] or [("ab1 c @ d2\n\n3e f")[a:b] for a, b in pii.loaded("ab1 c @ d2\n\n3e f")] == ["ab1", "@", "d2", "3e"]


def test_pii_model_recall_and_precision():
    """Of spans that no base pattern finds, in sentences that aren't in the labelled table."""
    rng, model = random.Random(9), pii.train()
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"]
    ssn = [lambda: f"{d(3)}-{d(2)}-{d(4)}"]
    plain = [lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(1)},{d(3)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}.{d(1)} %", lambda: f"v{d(1)}.{d(2)}", lambda: d(7), lambda: f"{d(3)}-{d(3)}", lambda: f"#{d(4)}", lambda: f"{d(2)}/{d(2)}/{d(4)}"]
    lead = ["you may reach us under", "their line is", "she wrote down", "as noted,", "see also", "on file:", ""]
    tail = ["since monday", "at the desk", ".", ", thanks", ""]
    wanted = found = right = 0
    for k in range(3000):
        kind, make = [("phone", rng.choice(phone)), ("ssn", rng.choice(ssn)), (None, rng.choice(plain))][k % 3]
        item = make()
        text = f"{rng.choice(lead)} {item} {rng.choice(tail)}".strip()
        spans = [(pii.KINDS[no], text[a:b]) for a, no, b, base in pii._found([text], model)[0] if not base]
        wanted += kind is not None
        found += len(spans)
        right += (kind, item) in spans
    assert right >= 0.98 * wanted and right >= 0.98 * found


# --- op7: FTRL as written down ------------------------------------------------------------------------


def test_ftrl_by_plain_updates():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 64, rng.integers(0, 12))), int(rng.random() < 0.8)) for _ in range(60)]
    got = quality.train(rows, bits=6, epochs=2)
    alpha, beta, l1, l2, bias_alpha = 0.5, 1.0, 0.002, 0.05, 0.02
    z, n = [0.0] * 65, [0.0] * 65
    share = sum(y for _, y in rows) / len(rows)
    start = max(-2.0, min(2.0, math.log((share + 1e-9) / (1 - share + 1e-9))))

    def weight(i):
        if i == 64:
            return start - z[i] / ((beta + math.sqrt(n[i])) / bias_alpha + l2)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(2):
        for slots, y in rows:
            x = 1 / math.sqrt(max(1, len(slots)))
            w = {int(i): weight(int(i)) for i in slots} | {64: weight(64)}
            p = 1 / (1 + math.exp(-(sum(v for i, v in w.items() if i < 64) * x + w[64])))
            g = (p - y) * min(8.0, 0.5 / max(1e-3, share if y else 1 - share))
            for i, v in w.items():
                step, rate = (g, bias_alpha) if i == 64 else (g * x, alpha)
                z[i] += step - (math.sqrt(n[i] + step * step) - math.sqrt(n[i])) / rate * (v - (start if i == 64 else 0))
                n[i] += step * step
    assert np.allclose(got, [weight(i) for i in range(65)], atol=1e-5)


def test_quality_by_plain_dot_products(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality.fit(docs, labels.filter(queries._fold(3) != 1))
    out = {r.doc_id: r for r in queries.op7_ftrl_quality(spark, SF).collect()}
    rows = docs.collect()
    assert len(out) == len(rows)
    for r in rows:
        slots, _ = quality.features(pa.array([r.text or ""], pa.string()))
        own = sorted(set(slots.tolist()))
        logit = sum(float(weights[i]) for i in own) / math.sqrt(max(1, len(own))) + float(weights[-1])
        assert abs(out[r.doc_id].score - 1 / (1 + math.exp(-logit))) < 1e-6 and out[r.doc_id].predicted == (out[r.doc_id].score >= 0.5)


def test_quality_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, **_: seen.append(rows))
    docs = spark.createDataFrame([(k, " ".join(f"w{k * 1000 + j}" for j in range(300))) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 > 0)) for k in range(60)], "doc_id long, quality int")
    quality.fit(docs, labels, per_label=20)
    assert sorted(y for _, y in seen[0]) == [0] * 10 + [1] * 20
    whole = {k: np.unique(quality.features(pa.array([t], pa.string()))[0]).tolist() for k, t in docs.collect()}
    assert all(i.tolist() in whole.values() for i, _ in seen[0])  # whole texts
    size = max(len(t) for _, t in docs.collect())
    quality.fit(docs.unionByName(spark.createDataFrame([(3, "x" * 60_000)], docs.schema)), labels, per_label=20, most_bytes=2 * (4 * size + 10))
    assert sorted(y for _, y in seen[1]) in ([0] * 4 + [1] * 4, [0] * 4 + [1] * 3) and all(i.tolist() in whole.values() for i, _ in seen[1])


def test_hash_shares(spark):
    n = spark.range(10_000).filter(runtime.below(F.xxhash64("id"), 0.25)).count()
    assert 2300 < n < 2700 and runtime.spare(100, 150) == 1.0 and runtime.spare(100, 10_000) == 0.032


# --- op8: columns that belong to other layouts -----------------------------------------------------------


@pytest.mark.parametrize("extra", [["input"], ["prompt", "answer"], ["prompt", "response"], ["instruction", "input", "output"], ["messages"], ["score"]])
def test_clashing_columns_change_no_layout(spark, extra):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    plain = chat.canonical_turns(rows).collect()
    for c in extra:
        rows = rows.withColumn(c, F.lit("clash"))
    assert chat.canonical_turns(rows).collect() == plain


def test_json_with_fields_of_other_layouts(spark):
    records = [(1, '{"prompt":"p","completion":"c","answer":"z","input":"i"}'), (2, '{"instruction":"do","input":"x","output":"done","prompt":"q","response":"r"}'), (3, '{"input":"i"}')]
    out = {r.conv_id: r.layout for r in chat.json_turns(spark.createDataFrame(records, "conv_id long, json string")).collect()}
    assert out == {1: "prompt_completion", 2: "instruction_input", 3: None}


# --- op9: blanks, long texts, empty tables, wide vocabularies ----------------------------------------------


def test_token_edges(spark, monkeypatch):
    with open(tokencount.VOCABULARY, "rb") as f:
        encoder = tokencount.Encoder(f.read())
    texts = [" " * 2_000_000, "x" + "\n" * 1_200_000 + "y", "a" * 300_000, "word  word\n\n word" * 20_000, "　" * 30_000 + "x", ""]
    rows = [(k, t, "en", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, n_tokens long")
    out = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, block=1000).collect()}
    assert out == {k: len(encoder.encode(t)) for k, t in enumerate(texts)} and out[5] == 0
    assert out[3] == len(encoder.by_pattern.encode_ordinary(texts[3])) and out[2] == len(encoder.by_pattern.encode_ordinary(texts[2]))
    assert tokencount.count_tokens(df.limit(0)).count() == 0
    assert tokencount.token_type(65_535) is np.uint16 and tokencount.token_type(65_536) is np.uint32
    spark.conf.set(tokencount.SETTING, "/nowhere")
    try:
        with pytest.raises(FileNotFoundError, match="spark.keyscape.vocabulary"):
            queries.op9_separator_token_counts(spark, SF)
    finally:
        spark.conf.unset(tokencount.SETTING)


def test_parts_change_no_token(monkeypatch):
    with open(tokencount.VOCABULARY, "rb") as f:
        encoder = tokencount.Encoder(f.read())
    monkeypatch.setattr(tokencount, "PART", 10)
    monkeypatch.setattr(tokencount, "_BLANK_RUN", tokencount.re.compile(tokencount._BLANK_RUN.pattern.replace("10000", "5")))
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice([" ", "  ", "\n", "a", "bc", "1", "-", "é", "'s", "\t", "　", " " * 9, "\n" * 7]) for _ in range(rng.randrange(60)))
        assert encoder.encode(s) == encoder.by_pattern.encode_ordinary(s)


# --- op10: documents of several texts, recall -----------------------------------------------------------------


def test_documents_of_several_texts(spark):
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    rows = [(5, text("a")), (5, text("b")), (7, text("a") + " more"), (3, text("b") + " more"), (9, text("c")), (9, text("c")), (8, ""), (8, text("c")), (None, text("a"))]
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(5, 56, 3, False), (7, 57, 3, False), (3, 57, 3, True), (9, 56, 8, False), (8, 56, 8, True), (8, 0, 8, True), (None, 56, None, True)}


def test_near_is_a_superset_of_what_likelihood_keeps():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 65_536, (40, 140)).astype(np.uint16)
    b = np.where(rng.random((40, 140)) < rng.random((40, 1)), a, rng.integers(0, 65_536, (40, 140))).astype(np.uint16)
    size = rng.integers(80, 120, 40)
    near = setsketch._near(a, size, b, size, 85, 100)
    for i in range(40):
        by_size = 100 * np.minimum(size[i], size) >= 85 * np.maximum(size[i], size)
        kept = by_size & setsketch.may_reach(np.broadcast_to(a[i], b.shape), b, size[i], size, 0.85) & ((a[i] == b).sum(1) > 100)
        assert (near[i] | ~kept).all() and not near[i][~by_size].any()
