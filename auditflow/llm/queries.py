"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import clustering, quality
from .clustering import cluster
from .linededup import dedup_lines
from .lm import lm_scores
from .mixing import mix_sources
from .neardup import near_components
from .negatives import hard_negatives, labelled, with_noise
from .packing import pack_documents
from .quality import quality_verdicts
from .secretscan import scan_secrets
from .store import table
from .substring import dedup_texts
from .tokencount import count_tokens
from .topk import top_k
from .urlfilter import LOWER, UPPER, judge_urls, parse_rule

#: The rules of op13.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_texts(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(with_noise(labelled(table(spark, sf_dir, "embeddings"))))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, common.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: The words of a text; a regular expression's escapes are its own.
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TEXT = "coalesce(text, '')"
_LOW = f"translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS pos FROM d)),
n AS (SELECT d.doc_id, count(s)::BIGINT AS n FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS low FROM d UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.node AND reach.low < link.b)
SELECT n.doc_id, n.n AS n_shingles, min(low) AS component_id, n.doc_id = min(low) AS kept FROM n JOIN reach ON reach.node = n.doc_id GROUP BY n.doc_id, n.n
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_TEXT)} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, w FROM d),
v AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 12 <= len(w) THEN array_to_string(w[pos:pos + 12], ' ') END AS win FROM p),
m AS (SELECT win, min(doc_id) AS low FROM v WHERE win IS NOT NULL GROUP BY win),
j AS (SELECT v.doc_id, v.pos, v.word, coalesce(m.low < v.doc_id, false) AS later FROM v LEFT JOIN m USING (win)),
c AS (SELECT *, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM j)
SELECT d.doc_id, count(c.pos)::BIGINT AS n_words, (count(*) FILTER (c.gone))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.pos) FILTER (NOT c.gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
"""


def _op9() -> str:
    """The base counts, quartiles by rank of rounded ratios, and fences on them."""
    r, p, base = quality.REACH, quality.PRIOR, quality.GROWTH
    value = f"coalesce(2 * pow({base}, b) / ({base} + 1), 0.0)"
    ranked = lambda by, name: f"{name} AS (SELECT {by}metric, max(total) AS n, max(v) FILTER (rn = greatest(ceil(total * 0.25), 1)) AS q1, max(v) FILTER (rn = greatest(ceil(total * 0.75), 1)) AS q3 FROM (SELECT {by}metric, {value} AS v, row_number() OVER (PARTITION BY {by}metric ORDER BY b NULLS FIRST) AS rn, count(*) OVER (PARTITION BY {by}metric) AS total FROM rounded) GROUP BY {by}metric)"
    ratios = {"word_length": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words"}
    long_ = " UNION ALL ".join(f"SELECT doc_id, lang, source, n_words, '{m}' AS metric, {c} / greatest(n_words, 1) AS x FROM stats" for m, c in ratios.items())
    chance = "CASE metric " + " ".join([f"WHEN '{m}' THEN {quality.NOISE} * sqrt({v} / greatest(n_words, 1))" for m, v in quality.VARIANCE.items()] + [f"WHEN '{m}' THEN {v}" for m, v in quality.BUNCH.items()]) + " END"
    lower = ", ".join(f"'{m}'" for m in quality.LOWER)
    return f"""
WITH d AS (SELECT doc_id, lang, source, {_TEXT} AS t, {_WORDS.format(_TEXT)} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, w FROM d),
v AS (SELECT doc_id, pos, CASE WHEN pos + 7 <= len(w) THEN array_to_string(w[pos:pos + 7], ' ') END AS win FROM p),
twice AS (SELECT doc_id, win FROM v WHERE win IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM (SELECT v.doc_id, v.pos, twice.win IS NOT NULL AS again FROM v LEFT JOIN twice USING (doc_id, win))),
r AS (SELECT doc_id, (count(*) FILTER (covered))::BIGINT AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
stats AS (SELECT d.doc_id, d.lang, d.source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
          coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
long AS ({long_}),
rounded AS (SELECT *, CASE WHEN x >= {quality.LEAST} THEN ceil(ln(x) / ln({base}))::INT END AS b FROM long),
{ranked("lang, source, ", "own")}, {ranked("lang, ", "wide")}, {ranked("", "everything")},
around AS (SELECT o.*, (w.n * w.q1 + {p} * e.q1) / (w.n + {p}) AS w1, (w.n * w.q3 + {p} * e.q3) / (w.n + {p}) AS w3 FROM own o JOIN wide w ON o.lang IS NOT DISTINCT FROM w.lang AND o.metric = w.metric JOIN everything e ON o.metric = e.metric),
middle AS (SELECT *, (n * q1 + {p} * w1) / (n + {p}) AS m1, (n * q3 + {p} * w3) / (n + {p}) AS m3, sqrt(n * {p}) / (n + {p}) AS doubt FROM around),
fences AS (SELECT lang, source, metric, m3 + {r} * (m3 - m1) + doubt * abs(q3 - w3) AS high, m1 - {r} * (m3 - m1) - doubt * abs(q1 - w1) AS low FROM middle),
judged AS (SELECT g.doc_id, bool_and(x <= high + {chance} AND (metric NOT IN ({lower}) OR x >= low - {chance})) AS fits FROM long g JOIN fences f USING (metric) WHERE g.lang IS NOT DISTINCT FROM f.lang AND g.source IS NOT DISTINCT FROM f.source GROUP BY g.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words) AND fits AS kept FROM stats JOIN judged USING (doc_id)
"""


OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def _op12() -> str:
    """Lloyd's rounds one after the other, every vector compared with every centroid each time."""
    parts = [f"""
v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
      WHERE len(embedding) = {clustering.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || vec_id)) - 1)::INT AS k, q FROM v QUALIFY k < {clustering.CENTROIDS})"""]
    for r in range(clustering.ROUNDS + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min((d, k)) AS best FROM (
      SELECT v.vec_id, v.q, k, list_sum(list_transform(list_zip(v.q, c{r}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{r}) GROUP BY vec_id)""")
        if r < clustering.ROUNDS:
            parts.append(f"""
m{r} AS (SELECT k, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS q FROM (
      SELECT best[2] AS k, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM (SELECT best, q, unnest(range(1, {clustering.DIMENSIONS} + 1)) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    last = clustering.ROUNDS
    return f"""WITH {",".join(parts)}
SELECT vec_id, best[2] AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} c ON c.k = best[2]
"""


def _op13() -> str:
    rules = ", ".join("('{}', '{}', '{}', '{}')".format(v, r, *parse_rule(r)) for v, r in URL_RULES)
    part = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
    return f"""
WITH p AS (SELECT page_id, translate({part.format(1)}, '{UPPER}', '{LOWER}') AS host, {part.format(2)} AS path FROM pages),
r(verdict, rule, h, p) AS (VALUES {rules}),
m AS (SELECT page_id, max((len(string_split(h, '.')), length(r.p), rule, r.verdict)) AS best FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT page_id, host, path, best[3] AS rule, coalesce(best[4], 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11, "op12_centroid_clustering": _op12(), "op13_url_filter": _op13(), "op4_minhash_dedup": OP4, "op5_exact_topk": OP5, "op6_line_dedup": OP6, "op7_substring_dedup": OP7, "op9_quality_rules": _op9()}
