"""Queries of the operators on the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minpair.llm import (
    ann, bisector, bpe, chat, langid, lm, mixing, quality, rules, simhash, syncmers, toxicity, whitening)
from minpair.llm.texts import crc_mod
from minpair.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled ones whose id's crc32 mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         F.transform("evidence", lambda e: e["id"]).alias("evidence"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and digests of the ids and the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, word_tokenizer(), ["doc_id"])


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, learnt from those whose id's crc32 mod 10 is not 0."""
    held = crc_mod(F.col("doc_id"), 10) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return lm.score(docs, ~F.col("held_out"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of a preference pair from every conversation with a reply."""
    pairs = chat.mismatched_pairs(table(spark, sf_dir, "conversations"))

    def flat(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(spans)

    return chat.format_pairs(pairs).select(
        "conv_id", "partner_id", "n_common", "prompt", "chosen_completion", flat("chosen_spans"),
        "rejected_completion", flat("rejected_spans"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; thresholds by language from all labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = materialise(rules.measure(docs))
    cuts = rules.cutoffs(measured, table(spark, sf_dir, "labels"), "lang")
    return rules.judge(measured, cuts, "lang").select(
        "doc_id", *rules.MEASURES, "base_failed", "kept", *rules.RULES, *(f"c_{r}" for r in rules.RULES))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, sources weighing 1, 2, 3 in turn, three epochs
    at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document under a model of all documents labelled good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.score(docs, table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose id's crc32 mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 4) == 2
    trees = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), trees).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    names = ("anchors", "edited_anchors", "next_anchors")
    rows = syncmers.edited(table(spark, sf_dir, "documents"))
    own, edited, after = ((F.col(f"links_{n}"), F.col(f"spots_{n}")) for n in names)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.fingerprint(F.col("anchors")).alias("fingerprint"), syncmers.fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        syncmers.likeness(own, edited).alias("near_edited"), syncmers.likeness(own, after).alias("near_next"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding of 64 components, after three rounds from 16 drawn ones."""
    return bisector.cluster(table(spark, sf_dir, "embeddings"), 64)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_lm": op3_lm,
    "op4_chat": op4_chat,
    "op5_rules": op5_rules,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_ann": op10_ann,
    "op11_fingerprints": op11_fingerprints,
    "op12_whitening": op12_whitening,
    "op13_clusters": op13_clusters,
}

OP4_SQL = """
WITH raw AS (
    SELECT conv_id, k, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i, role, text
    FROM (SELECT *, coalesce(conv_id::VARCHAR, 'row ' || row_number() OVER ()) AS k FROM conversations)),
t AS (
    SELECT conv_id, k, i, role, text,
           '<|im_start|>' || replace(coalesce(role, ''), '<|im_', '<| im_') || chr(10) AS head,
           replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' AS body FROM raw),
cut AS (SELECT k, max(i) AS li FROM t WHERE role = 'assistant' GROUP BY k),
reply AS (SELECT t.conv_id, t.k, t.role, t.text, t.head, t.body FROM t JOIN cut ON t.k = cut.k AND t.i = cut.li),
pair AS (
    SELECT a.conv_id, a.k, b.conv_id AS partner_id, cut.li,
           CASE WHEN b.conv_id IS NULL THEN 0
                WHEN a.text IS NOT DISTINCT FROM b.text THEN cut.li + 1 ELSE cut.li END AS n_common,
           a.head AS c_head, a.body AS c_body, b.head AS r_head, b.body AS r_body
    FROM reply a JOIN cut ON a.k = cut.k LEFT JOIN reply b ON b.conv_id = xor(a.conv_id, 1::BIGINT)),
placed AS (
    SELECT p.k, p.n_common, t.i, t.role, t.head || t.body || chr(10) AS piece,
           length(t.head) AS lh, length(t.body) AS lb,
           coalesce(sum(CASE WHEN t.i >= p.n_common THEN length(t.head) + length(t.body) + 1 ELSE 0 END)
               OVER (PARTITION BY p.k ORDER BY t.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM pair p JOIN t ON p.k = t.k AND t.i <= p.li),
texts AS (
    SELECT k, coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE i < n_common), '') AS prompt,
           coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE i >= n_common), '') AS chosen_completion,
           coalesce(string_agg((pos + lh)::BIGINT || '-' || (pos + lh + lb)::BIGINT, ',' ORDER BY i)
               FILTER (WHERE i >= n_common AND role = 'assistant'), '') AS chosen_spans
    FROM placed GROUP BY k)
SELECT p.conv_id, p.partner_id, p.n_common::INTEGER AS n_common, x.prompt, x.chosen_completion, x.chosen_spans,
       CASE WHEN p.partner_id IS NULL THEN NULL WHEN p.n_common > p.li THEN '' ELSE p.r_head || p.r_body || chr(10) END AS rejected_completion,
       CASE WHEN p.partner_id IS NULL THEN NULL WHEN p.n_common > p.li THEN ''
            ELSE length(p.r_head) || '-' || (length(p.r_head) + length(p.r_body)) END AS rejected_spans
FROM pair p JOIN texts x ON p.k = x.k
"""

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '')"

OP5_SQL = rf"""
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS txt, {WORDS_SQL} AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) AS ls FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM t)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(step) AS n FROM (SELECT r, least(8, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8)) AS step FROM twice) GROUP BY r),
c AS (
    SELECT t.r, doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(txt, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS nl,
           length(regexp_replace(txt, '[^\p{{Lu}}]', '', 'g')) AS upper_n, length(regexp_replace(txt, '[^!?]', '', 'g')) AS mark_n
    FROM t LEFT JOIN rep ON t.r = rep.r),
m AS (
    SELECT r, doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           CASE WHEN word_chars > 0 THEN least(1.0::DOUBLE, n_symbols::DOUBLE / word_chars) ELSE 0.0::DOUBLE END AS symbol_share,
           CASE WHEN nl > 0 THEN least(1.0::DOUBLE, n_dup_lines::DOUBLE / nl) ELSE 0.0::DOUBLE END AS dup_line_share,
           CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, n_repeat_words::DOUBLE / n_words) ELSE 0.0::DOUBLE END AS repeat_share,
           CASE WHEN word_chars > 0 THEN least(1.0::DOUBLE, upper_n::DOUBLE / word_chars) ELSE 0.0::DOUBLE END AS upper_share,
           CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, mark_n::DOUBLE / n_words) ELSE 0.0::DOUBLE END AS mark_share,
           n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
long AS (
    SELECT lang, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'upper_share', 'mark_share']) AS rule,
           unnest([symbol_share, dup_line_share, repeat_share, upper_share, mark_share]) AS v
    FROM m WHERE doc_id IN (SELECT doc_id FROM good)),
grid AS (SELECT unnest(range(0, 64)) AS b),
k AS (SELECT lang, rule, b, count(*) AS n, count(*) FILTER (WHERE v * 64 > b) AS k FROM long CROSS JOIN grid GROUP BY ALL),
p AS (
    SELECT lang, rule, b, CASE WHEN k >= n * (0.01 / 5)::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
               exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln((0.01 / 5)::DOUBLE) + (n - i) * ln((1 - 0.01 / 5)::DOUBLE)))) END AS tail FROM k),
cut AS (
    SELECT lang, rule, min(b) / 64.0::DOUBLE AS cutoff FROM p
    WHERE tail <= 0.05::DOUBLE / ((SELECT count(DISTINCT coalesce('=' || lang, '')) FROM long) * 5) GROUP BY lang, rule),
wide AS (
    SELECT lang, max(cutoff) FILTER (WHERE rule = 'symbol_share') AS c_symbol_share, max(cutoff) FILTER (WHERE rule = 'dup_line_share') AS c_dup_line_share,
           max(cutoff) FILTER (WHERE rule = 'repeat_share') AS c_repeat_share, max(cutoff) FILTER (WHERE rule = 'upper_share') AS c_upper_share,
           max(cutoff) FILTER (WHERE rule = 'mark_share') AS c_mark_share FROM cut GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbol_share, dup_line_share, repeat_share,
       upper_share, mark_share, c_symbol_share, c_dup_line_share, c_repeat_share, c_upper_share, c_mark_share,
       NOT base_failed AND NOT (coalesce(symbol_share > c_symbol_share, false) OR coalesce(dup_line_share > c_dup_line_share, false)
           OR coalesce(repeat_share > c_repeat_share, false) OR coalesce(upper_share > c_upper_share, false)
           OR coalesce(mark_share > c_mark_share, false)) AS kept
FROM m LEFT JOIN wide ON m.lang IS NOT DISTINCT FROM wide.lang
"""

OP6_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size,
           ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
lev AS (
    SELECT source, ss, w, 3.0::DOUBLE * ss AS cap,
           ((SELECT sum(ss) FROM s) - coalesce(sum(3.0::DOUBLE * ss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
    FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * ss / w, source NULLS LAST)),
final AS (SELECT arg_min(level, cap / w) FILTER (WHERE w * level <= cap AND ss > 0) AS level FROM lev),
line AS (
    SELECT lev.source, ss, CASE WHEN ss = 0 THEN 0.0 ELSE least(cap, w * final.level) END AS target FROM lev, final),
plan AS (
    SELECT source, ss, target, floor(target / ss) AS whole, (target / ss - floor(target / ss)) * ss AS part FROM line WHERE ss > 0),
g AS (SELECT source, place, sum(size) AS sz FROM d GROUP BY source, place),
cut AS (
    SELECT g.source, g.place, sum(sz) OVER (PARTITION BY g.source ORDER BY g.place) - sz / 2.0::DOUBLE AS pos FROM g),
more AS (SELECT cut.source, cut.place FROM cut JOIN plan ON cut.source IS NOT DISTINCT FROM plan.source WHERE plan.part > 0 AND cut.pos <= plan.part)
SELECT d.doc_id, d.size, line.ss AS source_size, line.target,
       (d.size * (coalesce(plan.whole, 0) + CASE WHEN more.place IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM d JOIN line ON d.source IS NOT DISTINCT FROM line.source LEFT JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
LEFT JOIN more ON d.source IS NOT DISTINCT FROM more.source AND d.place = more.place
"""

OP13_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT k, x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM v) WHERE k < 16),
a0 AS (
    SELECT r, arg_min(k, struct_pack(d := d, k := k)) AS k FROM (
        SELECT r, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c0 c) GROUP BY r),
c1 AS (
    SELECT c.k, coalesce(m.x, c.x) AS x FROM c0 c LEFT JOIN (
        SELECT k, list(x ORDER BY i) AS x FROM (
            SELECT k, i, (CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT AS x FROM (
                SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT a.k, unnest(v.x) AS e, unnest(range(1, 65)) AS i FROM v JOIN a0 a USING (r)) GROUP BY k, i))
        GROUP BY k) m USING (k)),
a1 AS (
    SELECT r, arg_min(k, struct_pack(d := d, k := k)) AS k FROM (
        SELECT r, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c1 c) GROUP BY r),
c2 AS (
    SELECT c.k, coalesce(m.x, c.x) AS x FROM c1 c LEFT JOIN (
        SELECT k, list(x ORDER BY i) AS x FROM (
            SELECT k, i, (CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT AS x FROM (
                SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT a.k, unnest(v.x) AS e, unnest(range(1, 65)) AS i FROM v JOIN a1 a USING (r)) GROUP BY k, i))
        GROUP BY k) m USING (k)),
a2 AS (
    SELECT r, arg_min(k, struct_pack(d := d, k := k)) AS k FROM (
        SELECT r, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c2 c) GROUP BY r),
c3 AS (
    SELECT c.k, coalesce(m.x, c.x) AS x FROM c2 c LEFT JOIN (
        SELECT k, list(x ORDER BY i) AS x FROM (
            SELECT k, i, (CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)::BIGINT AS x FROM (
                SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT a.k, unnest(v.x) AS e, unnest(range(1, 65)) AS i FROM v JOIN a2 a USING (r)) GROUP BY k, i))
        GROUP BY k) m USING (k)),
fin AS (
    SELECT r, vec_id, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (
        SELECT r, vec_id, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c3 c)
    GROUP BY r, vec_id)
SELECT vec_id, fin.k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY fin.k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM fin JOIN c3 ON fin.k = c3.k
"""

ORACLE: dict[str, str] = {
    "op13_clusters": OP13_SQL,
    "op5_rules": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op4_chat": OP4_SQL,
}
