"""One registered query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers

from tabloom.llm import bpe, divergence, embeddings, exact, fertility, fim, mixing, quality, simhash, surrogates, tokencount, toxicity, warc
from workload.registry import query, table

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op1_exact_dedup", EXACT_SQL)
def exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op2_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op4_bpe_roundtrip")
def bpe_roundtrip(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.roundtrip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


MIX_SQL = """
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
           (cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12)
                 AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
    FROM documents
), sources AS (
    SELECT source, source_size, w, 3.0 * source_size AS bound, 3.0 * source_size / w AS ratio FROM (
        SELECT source, sum(size)::BIGINT AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
        FROM sized GROUP BY source)
), shares AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
    FROM sources
), targets AS (
    SELECT source, source_size, CASE WHEN share >= ratio OR free IS NULL THEN bound ELSE least(w * free, bound) END::DOUBLE AS target
    FROM (SELECT *, first_value(CASE WHEN share < ratio THEN share END IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS free FROM shares)
), parts AS (
    SELECT d.*, t.source_size, t.target, floor(r) AS sure, r - floor(r) AS part FROM sized d JOIN (
        SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS r FROM targets) t
    ON d.source IS NOT DISTINCT FROM t.source
), keyed AS (
    SELECT *, CASE WHEN part > 0 AND size > 0 THEN least(floor(odds / (1 + odds) * 4503599627370496.0), 4503599627370495.0) END AS k
    FROM (SELECT *, CASE WHEN part > 0 THEN u / (1 - u) * (1 - part) / part END AS odds FROM parts)
), wanted AS (
    SELECT source, greatest(round(any_value(target) - sum(sure * size)), 0.0) AS want FROM keyed GROUP BY source
), units AS (
    SELECT source, k, want, n, sum(n) OVER (PARTITION BY source ORDER BY k) AS total FROM (
        SELECT d.source, k, want, sum(size) AS n FROM keyed d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source
        WHERE k IS NOT NULL GROUP BY ALL)
), cuts AS (
    SELECT source, coalesce(max(k) FILTER (total <= want), -1) AS cut,
           any_value(want) - coalesce(max(total) FILTER (total <= want), 0) AS gap FROM units GROUP BY source
), fits AS (
    SELECT source, arg_min(k, (abs(n - gap), k)) AS last
    FROM (SELECT u.*, c.cut, c.gap FROM units u JOIN cuts c ON u.source IS NOT DISTINCT FROM c.source)
    WHERE k > cut AND n < 2 * gap GROUP BY source
)
SELECT d.doc_id, d.size::BIGINT AS size, d.source_size::BIGINT AS source_size, d.target,
       (size * (sure + CASE WHEN k <= cut OR k = last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM keyed d LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN fits f ON d.source IS NOT DISTINCT FROM f.source
"""


@query("op9_pareto_mix", MIX_SQL)
def pareto_mix(spark, sf_dir):
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


@query("op5_quality_network")
def quality_network(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_toxicity")
def toxicity_scores(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_warc_records")
def warc_records(spark, sf_dir):
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query("op10_token_counts")
def token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokencount.document_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op3_embedding_near_dedup")
def embedding_near_dedup(spark, sf_dir):
    return embeddings.near_components(table(spark, sf_dir, "embeddings"))


@query("op6_pii_surrogates")
def pii_surrogates(spark, sf_dir):
    return surrogates.replace_report(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), words AS (
    SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3
), counts AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
    SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), sizes AS (
    SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), grid AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
           (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + v.v))::HUGEINT AS p,
           (1 + 1000000000::HUGEINT * (k.total + 1) // (v.n + v.v))::HUGEINT AS q
    FROM sizes s JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), listed AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM grid WHERE n > 0 AND p > q
)
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM listed)
WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark, sf_dir):
    return divergence.source_audit(table(spark, sf_dir, "documents"))


FIM_SQL = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), cut AS (
    SELECT *, cast('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, cast('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR cast('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                WHEN cast('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, substr(text, 1, least(x, y)) AS prefix, substr(text, least(x, y) + 1, abs(x - y)) AS middle,
           substr(text, greatest(x, y) + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_fill_in_middle", FIM_SQL)
def fill_in_middle(spark, sf_dir):
    return fim.fim_report(table(spark, sf_dir, "documents"))


@query("op13_fertility_rules")
def fertility_rules(spark, sf_dir):
    names = ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")
    byte_level, with_fallback = (public_tokenizers.path(name) for name in names)
    return fertility.fertility_report(table(spark, sf_dir, "documents"), byte_level, public_tokenizers.PATTERN, with_fallback)
