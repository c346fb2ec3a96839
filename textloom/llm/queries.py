"""The registered queries of this subpackage: thin views of its operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lexical, licenses, mixing, packing, pii, quality, runs, simhash, suffixes, tokens, topk
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


QUALITY = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                      list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
         u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
         t AS (SELECT doc_id, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS k FROM u WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
         r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM t WHERE k IS NOT NULL),
         p AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, range(0, 3) AS o(j) WHERE n > 1 GROUP BY doc_id),
         m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
                      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN p ON d.doc_id = p.doc_id),
         v AS (SELECT *, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""


@query(
    "op10_quality_rules",
    QUALITY
    + """
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (10 * n_symbols > 3 * n_words) AND NOT (n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines)
           AND NOT (word_chars > 30 * n_words) AS kept
    FROM v
    """,
)
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.apply(table(spark, folder, "documents"))


@query(
    "quality_ablation",
    QUALITY
    + """,
         f AS (SELECT doc_id, CASE WHEN n_words < 50 THEN 1 ELSE 0 END AS too_few_words, CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 1 ELSE 0 END AS repeated_words,
                      CASE WHEN 10 * n_symbols > 3 * n_words THEN 1 ELSE 0 END AS symbol_heavy, CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines THEN 1 ELSE 0 END AS duplicate_lines,
                      CASE WHEN word_chars > 30 * n_words THEN 1 ELSE 0 END AS long_words FROM v),
         s AS (SELECT *, too_few_words + repeated_words + symbol_heavy + duplicate_lines + long_words AS total FROM f),
         x AS (UNPIVOT s ON too_few_words, repeated_words, symbol_heavy, duplicate_lines, long_words INTO NAME rule VALUE failed)
    SELECT rule, sum(failed)::BIGINT AS n_failed, count(*) FILTER (WHERE failed = 1 AND total = 1) AS n_only, count(*) FILTER (WHERE total = failed) AS n_kept_without
    FROM x GROUP BY rule
    """,
)
def quality_ablation(spark: SparkSession, folder: str) -> DataFrame:
    return quality.ablation(quality.ledger(table(spark, folder, "documents")))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op9_mixing")
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query(
    "op4_exact_topk",
    """
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
               FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
    SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM p QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 10
    """,
)
def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def license_sql() -> str:
    """The scan as SQL, by its rule: the templates as rows, every place of their phrases, diagonals on which all of them stand, votes."""
    rows = ", ".join(f"({n}, '{t.label}', '{t.text}', {list(t.phrases)!r})" for n, t in enumerate(licenses.TEMPLATES))
    common = ", ".join(f"'{w}'" for w in sorted(licenses.COMMON))
    at = lambda phrase: " AND ".join(f"{'word' if k == 0 else f'lead(word, {k}) OVER s'} = '{p}'" for k, p in enumerate(phrase.split()))
    base = " UNION ALL ".join(f"SELECT r, p, '{label}' AS label FROM (SELECT r, p, {at(phrase)} AS here FROM u WINDOW s AS (PARTITION BY r ORDER BY p)) WHERE here" for phrase, label in licenses.PHRASES)
    return rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.BETWEEN}'), lambda x: x <> '') AS w FROM documents),
         u AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
         t AS (SELECT t, label, string_split(text, ' ') AS tw, phrases FROM (VALUES {rows}) AS t(t, label, text, phrases)),
         i AS (SELECT t, n AS q, tw[n + 1] AS word FROM (SELECT *, unnest(range(0, len(tw))) AS n FROM t) WHERE length(tw[n + 1]) > 1 AND tw[n + 1] NOT IN ({common})),
         z AS (SELECT t, count(*) AS size, least(6, ceil(count(*) * 3 / 5.0)) AS least FROM i GROUP BY t),
         f AS (SELECT t, k, p, list_filter(range(0, len(tw)), lambda n: tw[n + 1:n + len(p)] = p)[1] AS q FROM (SELECT t, tw, unnest(generate_series(1, len(phrases))) AS k, unnest(list_transform(phrases, lambda x: string_split(x, ' '))) AS p FROM t)),
         o AS MATERIALIZED (SELECT r, t, k, u.p - q AS diagonal FROM f JOIN u ON u.word = f.p[1] JOIN d USING (r) WHERE w[u.p + 1:u.p + len(f.p)] = f.p),
         h AS (SELECT a.r, a.t, a.diagonal FROM o AS a JOIN (SELECT t, count(*) AS n FROM f GROUP BY t) AS m USING (t)
               LEFT JOIN o AS b ON b.r = a.r AND b.t = a.t AND b.k > 1 AND abs(b.diagonal - a.diagonal) <= {licenses.DRIFT} WHERE a.k = 1 GROUP BY a.r, a.t, a.diagonal, m.n HAVING count(DISTINCT b.k) = m.n - 1),
         g AS (SELECT r, t, diagonal, count(*) / any_value(size)::DOUBLE AS share FROM h JOIN i USING (t) JOIN z USING (t) JOIN u USING (r, word) WHERE u.p = diagonal + q GROUP BY r, t, diagonal HAVING count(*) >= any_value(least)),
         p AS ({base}),
         pb AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY r),
         a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION ALL SELECT r, label FROM g JOIN t USING (t)) GROUP BY r),
         s AS (SELECT r, max(share) AS share FROM g GROUP BY r)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
    FROM d LEFT JOIN pb USING (r) LEFT JOIN a USING (r) LEFT JOIN s USING (r)
    """


@query("op1_license_scan", license_sql())
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(table(spark, folder, "documents"))


@query("op5_pii")
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(table(spark, folder, "documents"))


@query(
    "op3_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
         w AS (SELECT doc_id, s, md5(substring(h, 2 * s + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS s FROM d)),
         r AS (SELECT doc_id, s FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
         n AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
         i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM n),
         g AS (SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM i GROUP BY doc_id, i),
         p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM g),
         k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.strip(table(spark, folder, "documents")).drop("kept")


#: The words of texts in DuckDB, once A-Z are in lower case.
TERMS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.BETWEEN}'), lambda x: x <> '')"


@query(
    "op11_periodic_runs",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
         h AS (SELECT *, len(w) AS n, xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) AS h FROM d),
         a AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS p FROM h),
         t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM a),
         f AS (SELECT r, n, i, hash(array_to_string(w[i + 1:i + 4], ' ')) AS k, w[i + 1:i + 4] AS k4 FROM (SELECT *, unnest(range(0, n - 3)) AS i FROM t)),
         e AS (SELECT x.r, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.r = y.r AND x.k = y.k AND x.k4 = y.k4 AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
         g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
         s AS (SELECT r, q, min(i) AS a, max(i) + 4 + q AS b FROM g GROUP BY r, q, island),
         u AS (SELECT r, a, b - a AS length, min(q) AS q FROM s WHERE b - a >= greatest(6, 4 * q) GROUP BY r, a, b),
         l AS (SELECT r, count(*) AS n_runs, string_agg(a || ',' || length || ',' || q || chr(10), '' ORDER BY a, q) AS printed FROM u GROUP BY r),
         o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, a, q) = 1),
         x AS (SELECT DISTINCT r, unnest(range(a + q, a + length)) AS i FROM u),
         c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(0, n)) AS i FROM t) AS v ANTI JOIN x USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, a::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
           sha256(coalesce(printed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM t LEFT JOIN l USING (r) LEFT JOIN o USING (r) LEFT JOIN c USING (r)
    """,
)
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digest(runs.with_tails(table(spark, folder, "documents"))).drop("n_words", "runs")


@query(
    "op12_decontamination",
    f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
         b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {TERMS} AS w FROM benchmark) AS i WHERE len(w) > 0),
         x AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)),
         g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM x))),
         h AS (SELECT DISTINCT r, i, n, item_id FROM g JOIN x USING (n, k)),
         c AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM h, range(0, 10) AS z(o) WHERE o < n GROUP BY r),
         t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
    """,
)
def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items", "spans")


@query(
    "op13_lexical_search",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
         i AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct({TERMS})) AS term FROM benchmark),
         c AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS total FROM d),
         p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
         f AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY term, n),
         m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w) * n) // total AS m FROM d, c WHERE len(w) > 0),
         s AS (SELECT i, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
               FROM i JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
    """,
)
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
