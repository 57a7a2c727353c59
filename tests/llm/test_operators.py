"""Edge rows and brute-force checks of the corpus operators."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyscape.llm import chat, decontam, embed_dedup, langid, mixing, pii, quality, secrets, setsketch
from keyscape.llm import words as w
from keyscape.llm.components import connected_components
from keyscape.llm.fm_index import FMIndex
from keyscape.llm.runtime import slices, text_buffer

LONG = "word " * 40_000
#: Null and repeated ids, null, empty, blank and very long texts, ties, and columns whose names clash with the operators' own.
ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "   \n"), (None, "a b c d e f"), (None, None), (5, LONG), (6, "x"), (7, "é ß 漢字 \x00 \U0001f600 z")]
DOCS = "doc_id long, text string, lang string, source string, size long, row_key string, spans string, key string, value string, n long, component_id long"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 2 else "s", 1, "k", "s", "k", "v", 1, 9) for i, t in rows], DOCS)


def brute_sets(texts, width):
    out = []
    for t in texts:
        ws = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        out.append({tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set())
    return out


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- words, index, components ---------------------------------------------------


def test_words_of_bytes():
    texts = ["Ab c-1  é\tx", "", None, "9z", " a"]
    data, ends = text_buffer(pa.array(texts, pa.string()))
    start, stop, first = w.words(data, ends, w.ALNUM)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, stop, strict=True)] == ["Ab", "c", "1", "é", "x", "9z", "a"]
    assert first.tolist() == [0, 5, 5, 5, 6, 7]
    h = w.hashes(data, start, stop)
    other, oe = text_buffer(pa.array(["zz aB"]))
    s2, e2, _ = w.words(other, oe, w.ALNUM)
    assert w.hashes(other, s2, e2)[1] == h[0] and len(set(h.tolist())) == 7


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 10, 3000, 5, 0, 700)] + [None]})
    parts = list(slices(iter([batch]), "text", 1000))
    assert sum(p.num_rows for p in parts) == 7 and [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()


def test_fm_index():
    rng = np.random.default_rng(1)
    seq = rng.integers(1, 6, 2000)
    index = FMIndex(seq, 6, 4)
    patterns = [seq[i : i + n] for i, n in zip(rng.integers(0, 1900, 40), rng.integers(1, 9, 40), strict=True)] + [np.array([5, 5, 5, 5, 5, 5, 5, 5, 1])]
    width = max(map(len, patterns))
    matrix = np.array([np.pad(p, (width - len(p), 0)) for p in patterns])
    lo, hi = index.search(matrix, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        expected = [i for i in range(len(seq) - len(p) + 1) if (seq[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)]
    have = set(links) | {(b, a) for a, b in links}
    expected = components(460, lambda i, j: (i, j) in have)
    df = spark.createDataFrame([*links, (None, 3)], "src long, dst long")
    out = {r.node: r.component for r in connected_components(df).collect()}
    assert all(out.get(i, i) == expected[i] for i in range(460))
    assert connected_components(df.limit(0)).count() == 0


# --- edge rows ----------------------------------------------------------------------


def test_secrets_edges(spark):
    assert secrets.digest(secrets.scan_secrets(docs(spark))).count() == len(ROWS)
    texts = ["é Password: 'abc123'", "x token=short", "AKIA" + "A" * 16 + " " + "a" * 24, "secret=token token:abcdef", None, "ghp_" + "a" * 36]
    found = secrets.digest(secrets.scan_secrets(docs(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
    assert [r.spans for r in found] == ["assign:2:19", "", "access:0:20,hex:21:45", "assign:13:25", "", "code_host:0:40,hex:4:40"]
    assert secrets.trigram_query(r"[0-9a-f]+") is None and {frozenset({"aki", "kia"})} == set(secrets.trigram_query("AKIA[A-Z0-9]+"))
    assert secrets.scan_secrets(docs(spark).limit(0)).count() == 0


def test_language_edges(spark):
    model = langid.train(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30, steps=150)
    out = langid.predict(docs(spark), model).collect()
    assert len(out) == len(ROWS) and all(r.lang_pred == "und" for r in out if r.doc_id in (2, 3, 4))
    more = langid.predict(docs(spark, [(1, "12 34 !"), (2, "und die katze"), (3, "—…“”")]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in more] == ["und", "de", "und"]
    none = langid.predict(docs(spark), langid.fit(docs(spark).limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_windows_are_scored_whole():
    """The window network equals a plain evaluation of its filters."""
    model = langid.train(["ab ba"] * 5 + ["xy yx"] * 5, ["a"] * 5 + ["b"] * 5, steps=30, window=16)
    data, ends = text_buffer(pa.array(["abxy yxba aabb " * 3]))
    rows = langid.cut_windows(langid.CLASS[data], ends, 16, *langid.place_windows(ends, 16))
    logp, _ = model.windows(rows)
    conv = sum(model.taps[k][rows[:, k : 16 + k]] for k in range(4)).max(1) + model.bias
    logit = np.maximum(conv, 0) @ model.dense + model.dense_bias
    assert np.allclose(np.exp(logp), np.exp(logit) / np.exp(logit).sum(1, keepdims=True), atol=1e-5)


def test_mix_edges(spark):
    out = mixing.mix(docs(spark)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in out)
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    rows = [(i, f"s{i % 4}" if i % 5 else None, "w " * (i % 30 + 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    a, b = (sorted(map(tuple, mixing.mix(x).collect()), key=str) for x in (df, df.repartition(7)))
    assert a == b
    by = {}
    for _, source, _, size, target, taken in a:
        by.setdefault(source, [size, target, 0])[2] += taken
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - total) < 1e-6 and all(v[1] <= 3 * v[0] and v[2] == int(v[1] + 1e-9) for v in by.values())


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x"), (10, " ".join(f"t{i}" for i in range(20)))], "item_id long, text string")
    rows = [*ROWS, (20, "z " + " ".join(f"T{i}" for i in range(3, 18)) + ". a, b! C"), (21, "t1 " * 300), (22, "a b a b c a b c c")]
    out = {r.doc_id: r for r in decontam.removal_spans(docs(spark, rows), bench).collect() if r.doc_id}
    assert (out[1].n_words, out[1].n_hit, out[1]["items"], out[1].contaminated) == (6, 3, [1], True)
    assert (out[2].n_words, out[2].n_hit, out[3].n_words) == (0, 0, 0)
    assert (out[20].n_words, out[20].n_hit, out[20]["items"]) == (19, 18, [1, 10])
    text = dict(rows)[20]
    assert [text[s.a : s.b] for s in out[20].chars] == [text[2:]]
    assert out[21].n_hit == 0 and out[22].n_hit == 6 and [tuple(s) for s in out[22].words] == [(2, 8)]
    assert decontam.removal_spans(docs(spark), bench.limit(0)).filter("n_hit > 0").count() == 0
    # in several parts of the benchmark, and in tiny shards, the result is the same
    one = decontam.digest(decontam.removal_spans(docs(spark, rows), bench)).collect()
    two = decontam.digest(decontam.removal_spans(docs(spark, rows), bench, shard_words=4, part_words=20)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_pii_edges(spark):
    assert pii.digest(pii.scan_pii(docs(spark))).count() == len(ROWS)
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("ab1209.@+-() 5") for _ in range(rng.randrange(30)))
        spans = pii.base_spans(t)
        assert all(x[2] <= y[0] for k in range(4) for x, y in zip(*(lambda s: (s, s[1:]))([s for s in spans if s[1] == k]), strict=False))
    model = pii.train()
    found = lambda t: [(pii.KINDS[k], t[a:b], base) for a, k, b, base in pii._found([t], model)[0]]
    assert found("call (724) 555-7058 now") == [("phone", "(724) 555-7058", 0)] and found("ssn 123-45-6789.") == [("ssn", "123-45-6789", 0)]
    assert found("on 2020-01-02 at 12:30 we had 1,200 of 3.5") == [] and found("a@b@c.com") == [("email", "b@c.com", 1)]
    clean = pii.redact(spark.createDataFrame([(1, "x a@b.co y +1 (555) 555-1234"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["x <EMAIL> y <PHONE>", None]


def test_crf_decodes_exactly():
    model = pii.train(epochs=5)
    rng = np.random.default_rng(0)
    k = len(pii.TAGS)
    runs = [rng.normal(size=(n, k)) for n in (1, 2, 3, 4, 2)]
    for run, tags in zip(runs, model.viterbi(runs), strict=True):
        import itertools

        score = lambda t: sum(run[i, x] for i, x in enumerate(t)) + model.move[0, t[0]] + model.move[t[-1], 0] + sum(model.move[a, b] for a, b in zip(t, t[1:], strict=False))  # noqa: B023, E731
        assert np.isclose(score(tuple(tags)), max(map(score, itertools.product(range(k), repeat=len(run)))))


def test_quality_edges(spark):
    train = spark.createDataFrame([(i, "good plain words here" if i % 2 else "BAD!! WORDS!! HERE!!") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 1), (None, 0), (5, None)], "doc_id long, quality int")
    weights = quality.fit(train, labels)
    out = quality.score(docs(spark, [*ROWS, (50, "plain words"), (51, "BAD!! WORDS!!")]), weights).collect()
    assert len(out) == len(ROWS) + 2 and {r.doc_id: r.predicted for r in out if r.doc_id in (50, 51)} == {50: 1, 51: 0}
    assert {r.score for r in quality.score(docs(spark), quality.fit(train, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs(spark).limit(0), weights).count() == 0


def test_chat_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}],"score":3}'), (2, '{"instruction":"do","input":"","output":"done"}'), (3, '{"instruction":"do","output":"done"}'),
        (4, '{"prompt":"p","completion":"c"}'), (5, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'), (6, '{"other":1}'), (7, "{broken"), (8, None), (9, '{"question":"q","answer":null}'),
    ]
    out = chat.json_turns(spark.createDataFrame(records, "conv_id long, json string")).orderBy("conv_id", "turn").collect()
    got = {}
    for r in out:
        got.setdefault(r.conv_id, (r.layout, []))[1].append((r.role, r.text))
    assert got[1] == ("messages", [("user", "hi"), ("assistant", "yo")]) and got[2] == ("instruction_input", [("user", "do"), ("assistant", "done")]) and got[3][0] == "instruction"
    assert got[4][0] == "prompt_completion" and got[5] == ("from_value", [("user", "a"), ("assistant", "b")]) and got[9] == ("question_answer", [("user", "q"), ("assistant", None)])
    assert all(got[k] == (None, [(None, None)]) for k in (6, 7, 8))
    nested = spark.createDataFrame([(1, [("u", "t")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert chat.canonical_turns(nested).collect()[0][:] == (1, 0, "u", "t")
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_chat_round_trip(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "\\", "\\[INST]\\\\", "a\n</s>\n", " [/INST]\n[INST] x", "<<SYS>><</SYS>>", "<<<SYS>>", "[ROLE] eA==\n [/ROLE]\n", "é\U0001f600\r\x00", "$1 \\$2"]
    roles = ["user", "assistant", "system", None, "tool\nx", "USER", ""]
    rows = [(i, None if i % 3 == 0 else i, r, t) for i, (r, t) in enumerate((r, t) for r in roles for t in texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns)
    back = {r.conv_id: (r.role, r.text, r.loss_text) for r in chat.read_back(formatted).collect()}
    for i, _, r, t in rows:
        assert back[i] == (r or "", t or "", (t or "") if r == "assistant" else "")
    for r in formatted.collect():  # no control string of a text stays as it is
        body = r.formatted.split(" ", 1)[1].rsplit(" ", 1)[0]
        assert r.role not in chat.OPEN or all(("\\" + c in body) or c not in body for c in ("[INST]", "[/INST]", "</s>", "<<SYS>>"))
    assert chat.digest(chat.read_back(chat.format_turns(turns.limit(0)))).count() == 0


# --- near duplicates ------------------------------------------------------------------


def variants(rng, n, base_words=40, edits=3):
    base = [f"w{rng.randrange(1000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(1000)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block,sketch_block", [(256, 2048), (8, 8), (8, 16)])
def test_near_duplicates_by_brute_force(spark, block, sketch_block):
    rng = random.Random(block + sketch_block)
    texts = [t for _ in range(6) for t in variants(rng, 3)] + variants(rng, 60, 60, 4) + [" ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randrange(1, 30))) for _ in range(30)]
    texts += ["", None, "a", "A", "a b", texts[0], texts[0].upper().lower()]
    rng.shuffle(texts)
    sets = brute_sets(texts, 3)
    expected = components(len(texts), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    out = {r.doc_id: r for r in setsketch.near_duplicates(docs(spark, list(enumerate(texts))), width=3, threshold=(85, 100), block=block, sketch_block=sketch_block).collect()}
    assert [out[i].component_id for i in range(len(texts))] == expected
    assert [out[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets] and all(out[i].kept == (expected[i] == i) for i in out)


def test_near_duplicate_edges(spark):
    out = setsketch.near_duplicates(docs(spark)).collect()
    assert len(out) == len(ROWS) and all(r.kept for r in out if r.doc_id is None)
    assert {r.doc_id: r.n_shingles for r in out if r.doc_id} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 2}
    assert setsketch.near_duplicates(docs(spark).limit(0)).count() == 0


def test_registers_follow_similarity():
    rng = np.random.default_rng(5)
    pool = w.mix(rng.integers(1, 1 << 60, 3000).astype(np.uint64))
    a, b = pool[:2000], pool[400:2400]  # 1600 of 2400
    s = setsketch.sketch(np.repeat([0, 1, 2], [2000, 2000, 2400]), np.concatenate([a, b, pool[:2400]]), 3, 1024)
    assert abs((s[0] == s[1]).mean() - 2 / 3) < 0.06 and (np.maximum(s[0], s[1]) == s[2]).all()  # and registers merge
    size = np.array([2000])
    assert not setsketch.may_reach(s[0], s[1:2], size, size, 0.85)[0] and setsketch.may_reach(s[0], s[1:2], size, size, 0.68)[0]


@pytest.mark.parametrize("cell_size,block", [(8192, 8192), (20, 16)])
def test_embeddings_by_brute_force(spark, cell_size, block):
    rng = np.random.default_rng(cell_size)
    base = rng.normal(size=(12, 8))
    x = np.concatenate([base[rng.integers(0, 12, 150)] + rng.normal(size=(150, 8)) * 0.25, rng.normal(size=(60, 8)), np.repeat(base[:1], 9, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [None] + [1.0] * 7, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 2), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").withColumn("links", F.lit("clash"))
    out = {r.vec_id: r for r in embed_dedup.near_embeddings(df, cell_size=cell_size, block=block).collect()}
    u = embed_dedup.unit(x)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    expected = components(len(x), lambda i, j: bool(near[i, j]))
    assert [out[i].n_links for i in range(len(x))] == near.sum(1).tolist() and [out[i].component_id for i in range(len(x))] == expected
    assert all(out[i].n_links == 0 and out[i].kept for i in (900, 901, 902, 903, 904, None)) and out[906].component_id == 905
    assert embed_dedup.near_embeddings(df.limit(0)).count() == 0
