"""One registered query for each corpus operator, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontam, embed_dedup, langid, lexical, mixing, pii, quality, secrets, substring, tokencount
from .runtime import table
from .setsketch import near_duplicates


def op1_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def _fold(parts: int):
    """The doc_id's fold, by which labels are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts))


def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those of folds 0, 1 and 3."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(_fold(4) != 2))
    return langid.predict(docs, model).select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source: weights 5, 2, 1 in turn, at most 3 epochs."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_kmeans_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings: cosine of 0.9 or more."""
    return embed_dedup.near_embeddings(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of 13 words in all documents."""
    return decontam.digest(decontam.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13))


def op6_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.scan_pii(table(spark, sf_dir, "documents")))


def op7_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learnt from labels of folds 0 and 2."""
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").filter(_fold(3) != 1))
    return quality.score(docs, weights).select("doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op8_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that speaks in control strings, formatted and read back."""
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(odd)
    return chat.digest(chat.read_back(chat.format_turns(turns)))


def op9_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all documents, counted between end-of-document ids of flat token files."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.vocabulary_of(spark))


def op10_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=(85, 100))


def op11_anchor_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 20 words that repeat in all documents."""
    return substring.digest(substring.repeats(table(spark, sf_dir, "documents"), window=20))


def op12_hat_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language, of phrases that occur ten times or more."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, top=2_000)


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


QUERIES = {f.__name__: f for f in (op1_trigram_secrets, op2_byte_cnn_language, op3_source_mix, op4_kmeans_embedding_dedup, op5_fm_index_decontamination, op6_crf_pii, op7_ftrl_quality, op8_fingerprint_chat, op9_separator_token_counts, op10_setsketch_dedup, op11_anchor_substring_dedup, op12_hat_trie_collocations, op13_bit_sliced_search)}


def _secrets_oracle() -> str:
    """Spans by what stands between matches, as lists in DuckDB."""
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    cols, parts = [], []
    for no, r in enumerate(rules):
        p, group, skip = r.pattern.replace("'", "''"), r.group, "0"
        if p.startswith("(?<!"):  # DuckDB looks at the character in front by matching it too
            behind, body = p[4:].split(")", 1)
            p, group, skip = f"(?:^|{behind.replace('[', '[^', 1)})({body.replace('}+', '}')})", 1, f"length(m{no}[i]) - length(g{no}[i])"
        cols += [f"regexp_extract_all(t, '{p}') AS m{no}", f"regexp_extract_all(t, '{p}', {group}) AS g{no}", f"string_split_regex(t, '{p}') AS b{no}"]
        at = f"list_sum(list_transform(b{no}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{no}[1:i - 1], lambda x: length(x))), 0)"
        parts.append(
            f"list_transform(list_filter(range(1, len(m{no}) + 1), lambda i: length(g{no}[i]) >= {r.least}), "
            f"lambda i: {{'s': CAST({at} + {skip} AS BIGINT), 'n': {no}, 'e': CAST({at} + length(m{no}[i]) AS BIGINT), 'k': '{r.kind}'}})"
        )
    text = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    base = "list_filter(a, lambda x: x.n < 3)"
    counts = ", ".join(f"CAST(len(list_filter(a, lambda x: x.n = {no})) AS BIGINT) AS n_{r.kind}" for no, r in enumerate(secrets.BASE_RULES))
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(cols)} FROM d), "
        f"s AS (SELECT doc_id, list_sort({' || '.join(parts)}) AS a FROM m) "
        f"SELECT doc_id, {counts}, sha256(coalesce({text.format(base)}, '')) AS base_sha256, coalesce({text.format('a')}, '') AS spans, CAST(len(a) AS BIGINT) AS n_spans FROM s"
    )


ORACLES = {
    "op1_trigram_secrets": _secrets_oracle(),
    "op3_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
      / (coalesce(CAST(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS DOUBLE) / greatest(length(text), 1), 0.0) + 0.1) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w, 3 * source_size AS lim FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM w),
f AS (SELECT *, (total - spent) * w > lim * rest AS at_limit FROM r),
t AS (SELECT source, source_size, CASE WHEN at_limit THEN CAST(lim AS DOUBLE) ELSE
  CAST((total - coalesce(sum(CASE WHEN at_limit THEN lim END) OVER (), 0)) * w AS DOUBLE) / coalesce(sum(CASE WHEN NOT at_limit THEN w END) OVER (), 1) END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (SELECT doc_id, size, source_size, target, epochs, CAST(floor(target - epochs * source_size) AS BIGINT) AS budget,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(budget - before, size)) AS BIGINT) AS taken FROM x
""",
    "op4_kmeans_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
t(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, t.root FROM t JOIN p ON p.a = t.vec_id)
SELECT vec_id, CAST(coalesce(any_value(n_links), 0) AS BIGINT) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM t LEFT JOIN n ON n.a = t.vec_id GROUP BY vec_id
""",
    "op5_fm_index_decontamination": r"""
WITH l AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents, l),
i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark, l),
p AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM
  (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
n AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, n)),
h AS (SELECT doc_id, k, g.n, item_id FROM g JOIN p ON g.g = p.g AND g.n = p.n),
x AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM x GROUP BY doc_id),
sp AS (SELECT doc_id, string_agg((a - 1) || ':' || b, ',' ORDER BY a) AS spans FROM (SELECT doc_id, min(x) AS a, max(x) AS b FROM (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS run FROM x) GROUP BY doc_id, run) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN sp ON d.doc_id = sp.doc_id
""",
    "op8_fingerprint_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(regexp_replace(replace(t, '\', '\\'), '(<<SYS>>|<</SYS>>|\[/?INST\]|</?s>|\[/?ROLE\])', '\\\1', 'g'))
  + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE 17 + length(base64(encode(role))) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
    "op10_setsketch_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN ws IS NULL OR len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
  FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
df AS (SELECT g, count(*) AS c FROM u GROUP BY g),
o AS (SELECT doc_id, n, u.g, row_number() OVER (PARTITION BY doc_id ORDER BY c, u.g) AS r FROM u JOIN df ON u.g = df.g),
p AS (SELECT doc_id, n, g FROM o WHERE r <= n - CAST(ceil(0.85 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
      WHERE 100 * len(list_intersect(x.sh, y.sh)) >= 85 * (len(x.sh) + len(y.sh) - len(list_intersect(x.sh, y.sh)))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.doc_id)
SELECT s.doc_id, CAST(len(any_value(s.sh)) AS BIGINT) AS n_shingles, min(t.root) AS component_id, s.doc_id = min(t.root) AS kept
FROM s JOIN t USING (doc_id) GROUP BY s.doc_id
""",
    "op11_anchor_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS g FROM d),
l AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM g) WHERE r > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM l),
r AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN x ON x.doc_id = p.doc_id AND x.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
""",
    "op12_hat_trie_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
t AS (SELECT lang, k, phrase, f AS a, 1 AS cut, ws[1] AS x, array_to_string(ws[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, k, phrase, f, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
s AS (SELECT t.*, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * t.a * t.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM t JOIN f x ON x.lang = t.lang AND x.phrase = t.x JOIN f y ON y.lang = t.lang AND y.phrase = t.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, f, ws[1] || ' ' || ws[2] AS part FROM c WHERE k = 3 UNION ALL SELECT lang, f, ws[2] || ' ' || ws[3] FROM c WHERE k = 3) GROUP BY lang, part)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.part = phrase WHERE b.k = 3 OR i.f IS NULL OR 100 * i.f < 50 * a
QUALIFY rank <= 2000
""",
    "op13_bit_sliced_search": r"""
WITH l AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, l),
t AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
c AS (SELECT count(*) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark, l),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * n * nn // ll)))) AS BIGINT) AS score
  FROM q JOIN f ON q.term = f.term JOIN w ON w.term = q.term, c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
""",
}
