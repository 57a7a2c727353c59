"""Corpus queries against DuckDB, or against brute force where SQL can't express them."""

import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from keyscape.llm import pii, queries, tokencount
from tests.helpers import assert_same, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


def test_language_held_out(spark):
    out = queries.op2_byte_cnn_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == 200 and len(held) > 20
    assert (held.lang == held.lang_pred).mean() >= 0.95 and out.score.between(0, 1).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_ftrl_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95 and out.score.between(0, 1).all()


def _plain_pii(t):
    digits = lambda s: "".join(re.findall("[0-9]", s))
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_pii_by_plain_patterns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    found = queries.op6_crf_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(docs)
    for r in found:
        spans = _plain_pii(docs[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(filter(None, r.spans.split(",")))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))


def test_token_counts(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, ""), (-2, None), (-3, "<|endoftext|>")], "doc_id long, text string")
    with open(tokencount.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    both = docs.unionByName(odd).repartition(3)
    expected = {r.doc_id: len(enc.encode_ordinary(r.text or "")) for r in both.collect()}
    for block in (7, 1 << 16):  # documents over many blocks, and blocks of many documents
        assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(both, block=block).collect()} == expected


def test_flat_files(spark, tmp_path):
    import numpy as np

    lengths = [3, 0, 20, 1, 7]
    (tmp_path / "a.bin").write_bytes(b"".join(np.array([*range(n), 99], np.uint16).tobytes() for n in lengths) + np.array([1, 2], np.uint16).tobytes())
    out = tokencount.stitch(tokencount.scan_blocks(tokencount.read_flat(spark, str(tmp_path), block=4), 99))
    assert [r.n_tokens for r in out.orderBy("ordinal").collect()] == [*lengths, 2]


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "mix"]
    before = docs
    for name, stage in p.STAGES:
        out = stage(spark, before, SF).cache()
        if name != "mix":
            assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        if name in ("near_dedup", "decontaminate"):  # what stays is as it was
            assert out.exceptAll(before.select(*out.columns)).isEmpty()
        if name == "pii":
            assert out.count() == before.count() and out.filter(F.col("text").rlike(r"[a-z0-9]@mail[0-9]\.example\.com")).isEmpty()
        before = out
    sums = before.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(r.target - 1 <= r.t <= r.target + 1e-6 for r in sums)
    assert before.filter("taken > 3 * size").isEmpty()
