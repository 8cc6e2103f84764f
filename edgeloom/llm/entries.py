"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.byte_bpe import encode
from edgeloom.llm.common import table
from edgeloom.llm.context_tree import lm_score
from edgeloom.llm.exact_dedup import exact_dedup
from edgeloom.llm.language_id import language_id
from edgeloom.llm.line_dedup import line_dedup
from edgeloom.llm.metric_join import metric_dedup
from edgeloom.llm.mixing import mix_sources
from edgeloom.llm.simhash import simhash_dedup
from edgeloom.llm.substring_dedup import substring_dedup
from edgeloom.llm.url_filter import rules, url_filter

RULES = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"]
#: Repetition limit of the mixture.
MAX_EPOCHS = 1.25


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_dedup(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), max_epochs=MAX_EPOCHS)
    # The SQL has places in last blocks only.
    return mixed.withColumn("before", F.when(F.col("full"), -1).otherwise(F.col("before"))).drop("full")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules(RULES))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
w AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(words, s, s + 19), ' ')) AS window_hash
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM d)),
late AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY window_hash ORDER BY doc_id, s) AS k FROM w)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM late, range(20) AS r(o)),
gathered AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gathered USING (doc_id)
"""


#: Distances between all lines of about the same length; slow, but plain.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
f AS (
  SELECT line, row_number() OVER (ORDER BY doc_id, i) AS k, doc_id, i, strlen(line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, i) = 1),
pairs AS (
  SELECT a.k AS a, b.k AS b FROM f a JOIN f b ON a.n >= 12 AND b.n >= 12 AND a.n BETWEEN b.n - 2 AND b.n + 2 AND a.k <> b.k
  WHERE levenshtein(a.line, b.line) <= 2),
c(k, least) USING KEY (k) AS (
  SELECT k, k FROM f
  UNION SELECT p.b, min(c.least) FROM c JOIN pairs p ON p.a = c.k JOIN recurring.c r ON r.k = p.b WHERE c.least < r.least GROUP BY p.b),
kept AS (SELECT f.doc_id, f.i FROM f JOIN c USING (k) WHERE c.least = f.k),
left_over AS (
  SELECT l.doc_id, l.i, l.line FROM l LEFT JOIN kept USING (doc_id, i) WHERE kept.i IS NOT NULL OR NOT regexp_matches(l.line, '[^\x20\x09-\x0D]')),
joined AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM left_over GROUP BY doc_id)
SELECT d.doc_id, len(lines) AS n_lines, len(lines) - coalesce(n, 0) AS n_removed, sha256(coalesce(joined.text, '')) AS kept_sha256 FROM d LEFT JOIN joined USING (doc_id)
"""


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
c(vec_id, component_id) USING KEY (vec_id) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.b, min(c.component_id) FROM c JOIN links l ON l.a = c.vec_id
  JOIN recurring.c r ON r.vec_id = l.b WHERE c.component_id < r.component_id GROUP BY l.b)
SELECT c.vec_id, count(l.b) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN links l ON l.a = c.vec_id GROUP BY c.vec_id, c.component_id
"""


#: In a last block's order, documents of one source and id (the table has none) would need the hash of their texts, too.
OP8_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens
  FROM documents),
c AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS BIGINT) AS total FROM c),
shares AS (SELECT source, tokens, tokens / total AS p, total FROM c, total WHERE tokens > 0),
one AS (SELECT list(p) AS ps FROM shares),
b(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN epochs > LIMIT_ THEN middle ELSE low END, CASE WHEN epochs > LIMIT_ THEN high ELSE middle END
  FROM (
    SELECT i, low, high, (low + high) / 2 AS middle,
      list_max(list_transform(ps, lambda p: pow(p, (low + high) / 2) / p)) / list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2))) AS epochs
    FROM b, one WHERE i < 60)),
a AS (
  SELECT CASE WHEN (SELECT max(1.0 / p) / count(*) FROM shares) <= LIMIT_ THEN 0.0::DOUBLE ELSE high END AS a FROM b WHERE i = 60),
w AS (SELECT source, tokens, total, a, pow(p, a) / sum(pow(p, a)) OVER () AS weight FROM shares, a),
plan AS (
  SELECT source, weight, a, tokens, CAST(floor(weight * total) AS BIGINT) // tokens AS n_full,
    CAST(floor(weight * total) AS BIGINT) % tokens AS rest FROM w),
whole AS (
  SELECT doc_id, t.source, unnest(range(n_full)) AS block, n_tokens, weight, a, CAST(-1 AS BIGINT) AS before
  FROM t JOIN plan ON t.source IS NOT DISTINCT FROM plan.source),
last AS (
  SELECT doc_id, t.source, n_full AS block, n_tokens, weight, a, rest,
    CAST(sum(n_tokens) OVER (PARTITION BY t.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || n_full || ':17'), n_tokens ROWS UNBOUNDED PRECEDING) AS BIGINT) - n_tokens AS before
  FROM t JOIN plan ON t.source IS NOT DISTINCT FROM plan.source WHERE rest > 0)
SELECT doc_id, source, block, n_tokens, round(weight, 9) AS weight, round(a, 9) AS exponent, before FROM (
  SELECT * FROM whole UNION ALL SELECT * EXCLUDE (rest) FROM last WHERE before + n_tokens <= rest)
""".replace("LIMIT_", str(MAX_EPOCHS))


def _apart(x: str, n: str, y: str, m: str) -> str:
    pooled = f"(({x} + {y}) / ({n} + {m}))"
    return f"(abs({x} / {n} - {y} / {m}) > 1.96 * sqrt(greatest({pooled} * (1 - {pooled}), 0) * (1 / {n} + 1 / {m})))"


def _op9_sql() -> str:
    """Written out for paths of up to four segments; the tables have no deeper ones."""
    fits = [(f"host = '{r.host}' OR ends_with(host, '.{r.host}')", r) for r in sorted(rules(RULES), key=lambda r: -len(r.text))]
    case = lambda what: "CASE " + " ".join(f"WHEN ({f}) AND starts_with(path, '{r.path}') THEN '{what(r)}'" for f, r in fits) + " END"
    sql = r"""WITH u AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^((?s).*?)://([^/?#]*)([^?#]*)', ['head', 'host', 'path']) AS m FROM pages),
p AS (SELECT page_id, translate(m.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, m.path AS path FROM u),
s AS (SELECT host, path, count(*) AS n, """ + f"{case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS verdict" + """ FROM p GROUP BY host, path),
l0 AS (
  SELECT *, CASE WHEN verdict IS NULL THEN 0 ELSE n END AS labelled, CASE WHEN verdict = 'block' THEN n ELSE 0 END AS bad,
    q AS parts, q[-1] AS last, '' AS template, '' AS shape
  FROM (SELECT *, string_split(substr(path, 2), '/') AS q FROM s))"""
    for k in range(1, 5):
        sql += f""",
v{k} AS (
  SELECT host, template FROM (
    SELECT host, template, parts[{k}] AS segment, sum(n) AS n FROM l{k - 1} WHERE len(parts) >= {k} GROUP BY ALL)
  GROUP BY host, template HAVING count(*) >= 8 AND count(*) >= 0.02 * sum(n)),
l{k} AS (
  SELECT l.* REPLACE (
    CASE WHEN len(parts) < {k} THEN l.template ELSE l.template || '/' || CASE WHEN v.host IS NULL THEN parts[{k}] ELSE '*' END END AS template,
    CASE WHEN len(parts) < {k} THEN shape ELSE shape || CASE WHEN v.host IS NULL THEN '=' ELSE '*' END END AS shape)
  FROM l{k - 1} l LEFT JOIN v{k} v ON l.host = v.host AND l.template = v.template)"""
    return sql + """,
leaves AS (
  SELECT host, template, shape, CAST(sum(labelled) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS x,
    CAST(sum(n) AS DOUBLE) AS pages, CAST(count(*) AS DOUBLE) AS paths, CAST(count_if(regexp_matches(last, '^[0-9]+$')) AS DOUBLE) AS numbers FROM l4 GROUP BY ALL),
lead AS (
  SELECT host, shape, template AS t, n AS m, x AS y, pages AS lead_pages, paths AS lead_paths, numbers AS lead_numbers FROM leaves WHERE n > 0
  QUALIFY row_number() OVER (PARTITION BY host, shape ORDER BY n DESC, template DESC) = 1),
classed AS (
  SELECT a.*, CASE WHEN n > 0 AND m > 0 AND NOT """ + _apart("x", "n", "y", "m") + """
      OR n = 0 AND m >= 20 AND contains(shape, '*') AND NOT """ + _apart("numbers", "paths", "lead_numbers", "lead_paths") + " AND NOT " + _apart("paths", "pages", "lead_paths", "lead_pages") + """ THEN t ELSE template END AS class
  FROM leaves a LEFT JOIN lead USING (host, shape)),
share AS (SELECT coalesce(sum(x) / nullif(sum(n), 0), 0) AS share FROM leaves),
pure AS (SELECT host, class, (sum(x) + 4.0::DOUBLE * any_value(share)) / (sum(n) + 4.0::DOUBLE) AS purity, sum(n) AS l FROM classed, share GROUP BY host, class)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN purity >= 0.9 AND l > 0 THEN 'block' ELSE 'allow' END) AS verdict, l4.template, c.class, round(purity, 9) AS purity
FROM p JOIN l4 ON p.host = l4.host AND p.path = l4.path JOIN classed c ON c.host = l4.host AND c.template = l4.template AND c.shape = l4.shape
JOIN pure ON pure.host = c.host AND pure.class = c.class"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_language_id": op3_language_id,
        "op4_line_dedup": op4_line_dedup,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_source_mixing": op8_source_mixing,
        "op9_url_filter": op9_url_filter,
        "op10_simhash_dedup": op10_simhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op6_embedding_dedup": OP6_SQL, "op8_source_mixing": OP8_SQL, "op9_url_filter": _op9_sql()}
