"""One query per operator over its whole table, and the same results in SQL where it can say them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ocheline.llm import (
    bpe_tree,
    ftrl,
    importance,
    kd_shards,
    negatives,
    phrases,
    pstable,
    secrets,
    simple8b,
    unigram,
    url_trust,
    vptree,
    wu_manber,
)
from ocheline.plans.storage import session_folder

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block each page's url, by rule or by the trust of its host."""
    return url_trust.judge(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def _place(name: Column) -> Column:
    """Where a name stands in the order of bytes, as a number: its first six bytes as digits."""
    raw = F.rpad(F.hex(F.substring(name.cast("binary"), 1, 6)), 12, "0")
    return F.conv(raw, 16, 10).cast("double")


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes by a k-d tree over length, script and language."""
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (size + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.log(1.0 + F.col("n_chars")).alias("length"),
        ((size + 1) / (F.length(text) + 1)).alias("script"),
        _place(F.coalesce("lang", F.lit(""))).alias("language"),
    )
    dealt = kd_shards.kd_shards(rows, "size", ("length", "script", "language"), shards=SHARDS)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, written as Simple-8b blocks and read back."""
    path = f"{session_folder(spark)}/simple8b-{uuid.uuid4().hex}"
    with open(BYTE_BPE, encoding="utf-8") as f:
        simple8b.write_ids(table(spark, sf_dir, "documents"), path, f.read(), END_ID)
    return simple8b.read_ids(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op4_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.93 or more within a label."""
    return pstable.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the windows that recur anywhere."""
    return phrases.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, decoded again."""
    return unigram.round_trip(table(spark, sf_dir, "documents"), unigram.load(PIECES))


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document lie in windows of benchmark items?"""
    return wu_manber.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op8_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    return vptree.near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op9_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels of four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ftrl.train(docs, table(spark, sf_dir, "labels"))
    return ftrl.with_score(docs, model).select(
        "doc_id",
        F.coalesce(ftrl.fold("doc_id") == 0, F.lit(True)).alias("held_out"),
        "score",
        ftrl.predicted(F.col("score")).alias("predicted"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, by kind and place."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, long ones by tree concatenation, decoded again."""
    with open(BYTE_BPE, encoding="utf-8") as f:
        vocabulary = f.read()
    return bpe_tree.encoded(table(spark, sf_dir, "documents"), vocabulary, round_trip=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by how likely their words are in the benchmark."""
    return importance.resampled(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).select("doc_id", "n_features", "weight", "score", "rank")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the first positives of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_trust,
        op2_kd_shards,
        op3_simple8b,
        op4_pstable,
        op5_phrases,
        op6_sentencepiece,
        op7_wu_manber,
        op8_vptree,
        op9_ftrl,
        op10_secrets,
        op11_bpe_tree,
        op12_importance,
        op13_negatives,
    )
}

# The patterns below are those of the rules, in RE2's spelling.
_ASSIGN = (
    "(?i)(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
_KINDS = [
    (0, "assign", _ASSIGN, 2, 12),
    (1, "access", "AKIA[A-Z0-9]+", 0, 18),
    # Maximal runs: those of 16 and more are all runs without the short ones.
    (2, "hex", "[0-9a-f]{16,}", 0, 16),
    (3, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    (4, "slack", "xox[abprs]-[A-Za-z0-9-]{20,}", 0, 1),
]


def _op10_sql() -> str:
    found = "\nUNION ALL ".join(
        f"""SELECT doc_id, {rank} AS r, '{kind}' AS kind, {least} AS least,
        regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS j,
        string_split_regex(t, '{pattern}') AS b FROM texts"""
        for rank, kind, pattern, group, least in _KINDS
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT doc_id, r, kind, least, m, j, b, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (
    SELECT doc_id, r, kind, length(j[i]) >= least AS ok, length(m[i]) AS size,
        sum(length(b[i])) OVER w + coalesce(sum(length(m[i])) OVER
            (PARTITION BY doc_id, r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
    FROM each WINDOW w AS (PARTITION BY doc_id, r ORDER BY i)),
spans AS (
    SELECT doc_id, r, kind, s, kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT AS span
    FROM placed WHERE ok),
lists AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
        count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(span, ',' ORDER BY s, r) FILTER (r < 3), '') AS base,
        string_agg(span, ',' ORDER BY s, r) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans
FROM texts LEFT JOIN lists USING (doc_id)"""



def _op1_sql() -> str:
    """Trust goes along the links, distrust against them; what comes over k links is a step of a recursion."""
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    fits = [
        f"WHEN (h = '{r.host}' OR ends_with(h, '.{r.host}')) AND starts_with(p, '{r.path}') THEN "
        for r in sorted(url_trust.RULES, key=lambda r: (-len(r.text), r.text))
    ]
    by_text = sorted(url_trust.RULES, key=lambda r: (-len(r.text), r.text))
    rule = " ".join(f"{f}'{r.text}'" for f, r in zip(fits, by_text))
    verdict = " ".join(f"{f}'{r.verdict}'" for f, r in zip(fits, by_text))
    sums = []
    for name, seed, a, b in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        sums.append(
            f"""{name}_out AS MATERIALIZED (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS share
    FROM links),
{name}_by AS (
    SELECT 0 AS k, h, count(*) / sum(count(*)) OVER () * (1 - {url_trust.DAMPING}) AS s FROM judged
    WHERE h <> '' AND v = '{seed}' GROUP BY h
    UNION ALL SELECT k + 1, b, sum(s * share * {url_trust.DAMPING}) FROM {name}_by JOIN {name}_out ON a = h
    WHERE k < {url_trust.ROUNDS} GROUP BY k, b),
{name} AS (SELECT h, sum(s) AS s FROM {name}_by GROUP BY h)"""
        )
    return f"""
WITH RECURSIVE parsed AS (
    SELECT page_id, coalesce(html, '') AS html,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {low}) AS h,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p FROM pages),
judged AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS v FROM parsed),
hrefs AS (
    SELECT h, unnest(regexp_extract_all(html,
        '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS href FROM judged),
chain AS (
    SELECT DISTINCT array_to_string(l[k:], '.') AS h
    FROM (SELECT l, unnest(range(1, len(l) + 1)) AS k
        FROM (SELECT DISTINCT string_split(h, '.') AS l FROM judged))),
sites AS (
    SELECT h AS a, regexp_replace(h, '^[^.]*\\.', '') AS b FROM chain
    WHERE contains(h, '.') AND contains(regexp_replace(h, '^[^.]*\\.', ''), '.')),
links AS MATERIALIZED (
    SELECT src, dst, count(*) AS n FROM (
        SELECT h AS src, translate(regexp_extract(CASE WHEN starts_with(href, '//')
            THEN 'x:' || href ELSE href END, '(?s)^.*?://([^/?#]*)', 1), {low}) AS dst FROM hrefs
        UNION ALL SELECT a, b FROM sites UNION ALL SELECT b, a FROM sites)
    WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
{", ".join(sums)},
hosts AS (SELECT count(DISTINCT h) AS n FROM judged WHERE h <> '')
SELECT page_id, judged.h AS host, p AS path, rule, coalesce(v, CASE
    WHEN coalesce(d.s, 0) > {url_trust.THRESHOLD} / n AND coalesce(d.s, 0) > coalesce(t.s, 0)
    THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN hosts ON true LEFT JOIN t ON t.h = judged.h LEFT JOIN d ON d.h = judged.h"""


ORACLES = {
    "op1_url_trust": _op1_sql(),
    "op4_pstable": """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)
        AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b USING (label)
    WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN roots ON roots.a = vec_id LEFT JOIN counts ON counts.a = vec_id""",
    "op5_phrases": r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
    SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS phrase
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
repeats AS (SELECT phrase FROM places GROUP BY phrase HAVING count(*) > 1),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i
    FROM places SEMI JOIN repeats USING (phrase)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
    FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""",
    "op7_wu_manber": r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items
        WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes
        WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, phrase)),
counted AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_secrets": _op10_sql(),
    "op12_importance": r"""
WITH RECURSIVE steps AS (
    SELECT range AS byte, range AS crc, 0 AS k FROM range(256)
    UNION ALL SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, k + 1
    FROM steps WHERE k < 8),
lookup AS MATERIALIZED (SELECT list(crc ORDER BY byte) AS crcs FROM steps WHERE k = 8),
texts AS (
    SELECT 's' AS side, doc_id AS id, text FROM documents
    UNION ALL SELECT 't', NULL, text FROM benchmark),
words AS MATERIALIZED (
    SELECT row_number() OVER () AS r, side, id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
each AS MATERIALIZED (
    SELECT r, side, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS feature
    FROM words),
hexed AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM each)),
coded AS MATERIALIZED (
    SELECT feature, xor(list_reduce(
        [('0x' || h[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, len(h) // 2 + 1)],
        lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
    FROM hexed, lookup),
counts AS (
    SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
    FROM each JOIN coded USING (feature) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
    FROM counts, sums),
weights AS (
    SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM each JOIN coded USING (feature) JOIN gains USING (bucket) WHERE side = 's' GROUP BY r),
scored AS (
    SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
            / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (r) WHERE side = 's'),
places AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_words >= 20) OVER () AS n_all FROM scored)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_words >= 20 AND place <= 25 * n_all // 100 THEN place END AS rank
FROM places""",
    "op13_negatives": """
WITH given AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
        list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score
    FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, other_id))::INTEGER AS rank,
    other_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scores s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5""",
}
