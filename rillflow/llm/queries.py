"""The registered queries of the corpus operators, and DuckDB SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the default of the tokenizer queries' path parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from rillflow.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), path or vocabulary("byte_bpe_50k.json"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.simhash import simhash_classes

    return simhash_classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.exact_dedup import exact_groups

    digest = {"text_sha256": F.sha2(F.encode("__norm", "UTF-8"), 256)}
    return exact_groups(table(spark, sf_dir, "documents"), carry=digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.toxicity import fit, fold, score

    docs, held = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    model = fit(docs, table(spark, sf_dir, "labels"), usable=~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item; clean documents have no row."""
    from rillflow.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.ctw_lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op10_huffman_ids(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from rillflow.llm.huffman_ids import ids_digest, read_ids, write_ids

    where = write_ids(table(spark, sf_dir, "documents"), path or vocabulary("word_bpe_49k.json"), end_id=2)
    return ids_digest(read_ids(spark, where))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.merkle import lowered, manifest, proofs

    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return proofs(manifest(table(spark, sf_dir, "documents"), claim=lowered(tampered)))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.lexical import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm.url_filter import fit, judged, labelled_urls

    return judged(table(spark, sf_dir, "pages"), fit(labelled_urls(spark)))


ORACLE_OP4 = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

#: The same units as in rillflow.llm.decontaminate.
UNITS = "kilograms?|kg|grams?|g|mg|pounds?|lbs?|oz|kilomet(?:er|re)s?|km|met(?:er|re)s?|m|cm|mm|miles?|mi|feet|foot|ft|inch(?:es)?|hours?|hrs?|h|minutes?|mins?|min|seconds?|sec|s|days?|weeks?|months?|years?|dollars?|usd|euros?|eur|cents?|percent|lit(?:er|re)s?|l|ml"
ORACLE_OP8 = rf"""
WITH forms AS (
  SELECT item_id AS id, 0 AS form, regexp_replace(coalesce(text, ''), '([a-z0-9,;] )([A-Z][a-z])', '\1¤\2', 'g') AS t, true AS item FROM benchmark
  UNION ALL SELECT item_id, 1, coalesce(text, ''), true FROM benchmark
  UNION ALL SELECT doc_id, 0, regexp_replace(coalesce(text, ''), '([a-z0-9,;] )([A-Z][a-z])', '\1¤\2', 'g'), false FROM documents
), words AS (
  SELECT id, form, item, regexp_extract_all(regexp_replace(lower(t), '([0-9] ?)((?:{UNITS})(?:[^0-9a-z]|$))', '\1¦\2', 'g'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM forms
), slots AS (
  SELECT id, form, item, w, list_transform(w, lambda x: CASE WHEN x[1] = '¤' THEN '¤' WHEN x[1] = '¦' THEN '¦' WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE x END) AS c FROM words WHERE len(w) >= 5
), wins AS (
  SELECT id, form, item, c[i:i + 4] AS k, w[i:i + 4] AS v FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS i FROM slots)
), sizes AS (
  SELECT id AS item_id, form, count(DISTINCT k) AS n_windows FROM wins WHERE item GROUP BY ALL
), hits AS (
  SELECT d.id AS doc_id, b.id AS item_id, b.form, b.k, list_zip(b.v, d.v, b.k) AS z FROM wins d JOIN wins b ON d.k = b.k WHERE NOT d.item AND b.item
), pairs AS (
  SELECT doc_id, item_id, form, count(DISTINCT p[1]) AS n_slots, count(DISTINCT (p[1], p[2])) AS n_pairs, count(DISTINCT (p[1], p[2])) FILTER (p[1] <> p[2]) AS n_changed
  FROM (SELECT doc_id, item_id, form, unnest(list_filter(z, lambda p: p[3] IN ('0', '¤', '¦'))) AS p FROM hits) GROUP BY ALL
), matched AS (
  SELECT doc_id, item_id, form, count(DISTINCT k) AS n_matched FROM hits GROUP BY ALL
), held AS (
  SELECT doc_id, item_id, n_windows, n_matched, n_matched / n_windows AS containment, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed
  FROM matched JOIN sizes USING (item_id, form) LEFT JOIN pairs USING (doc_id, item_id, form) WHERE n_matched >= 0.8 * n_windows AND coalesce(n_pairs, 0) = coalesce(n_slots, 0)
)
SELECT doc_id, item_id, n_windows, n_matched, containment, n_slots, n_changed FROM held
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n_matched DESC, n_windows DESC, n_slots DESC, n_changed DESC) = 1
"""

#: CRC-32 of an ASCII text, bit by bit.
CRC32_SQL = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
FIELD_SQL = "coalesce(concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}), '-')".format
LEAF_SQL = lambda text: "sha256(concat(" + ", ".join(FIELD_SQL(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
ORACLE_OP11 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS k, {LEAF_SQL("text")} AS leaf,
    CASE WHEN {CRC32_SQL.format(text="CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {LEAF_SQL("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {LEAF_SQL("text")} END AS claim,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p FROM documents
), trees(k, lv, p, n, h) AS (
  SELECT k, 0, p, count(*) OVER (PARTITION BY k), leaf FROM leaves
  UNION ALL SELECT k, lv + 1, p // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM trees WHERE n > 1 GROUP BY k, lv, p // 8
), subroots AS (
  SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS p FROM trees WHERE n = 1
), tops(lv, p, n, h) AS (
  SELECT 0, p, count(*) OVER (), subroot FROM subroots
  UNION ALL SELECT lv + 1, p // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY lv, p // 8
), runs AS (
  SELECT k, lv, p // 8 AS run, list(h ORDER BY p) AS hs FROM trees WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT '*', lv, p // 8, list(h ORDER BY p) FROM tops WHERE n > 1 GROUP BY ALL
), inner_walk(doc_id, k, lv, p, h, sib) AS (
  SELECT doc_id, k, 0, p, claim, '' FROM leaves
  UNION ALL SELECT w.doc_id, w.k, w.lv + 1, w.p // 8, sha256(list_aggregate(list_concat(hs[:w.p % 8], [w.h], hs[w.p % 8 + 2:]), 'string_agg', '')),
    sib || coalesce(list_aggregate(list_concat(hs[:w.p % 8], hs[w.p % 8 + 2:]), 'string_agg', ''), '')
  FROM inner_walk w JOIN runs r ON r.k = w.k AND r.lv = w.lv AND r.run = w.p // 8
), starts AS (
  SELECT w.doc_id, w.k, s.p, w.h, w.sib FROM (SELECT * FROM inner_walk QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY lv DESC) = 1) w JOIN subroots s USING (k)
), outer_walk(doc_id, k, lv, p, h, sib) AS (
  SELECT doc_id, k, 0, p, h, sib FROM starts
  UNION ALL SELECT w.doc_id, w.k, w.lv + 1, w.p // 8, sha256(list_aggregate(list_concat(hs[:w.p % 8], [w.h], hs[w.p % 8 + 2:]), 'string_agg', '')),
    sib || coalesce(list_aggregate(list_concat(hs[:w.p % 8], hs[w.p % 8 + 2:]), 'string_agg', ''), '')
  FROM outer_walk w JOIN runs r ON r.k = '*' AND r.lv = w.lv AND r.run = w.p // 8
), ends AS (
  SELECT * FROM outer_walk QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY lv DESC) = 1
)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(e.sib) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM leaves l JOIN subroots s USING (k) JOIN ends e ON e.doc_id = l.doc_id AND e.k = l.k JOIN tops t ON t.n = 1
"""


TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS w FROM documents
), totals AS (
  SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0
), counts AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM counts, totals GROUP BY t, docs
), items AS (
  SELECT q, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS q, item_id, {TERMS_SQL} AS w FROM benchmark)
), scores AS (
  SELECT q, item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * docs) // terms))))::BIGINT AS score
  FROM items JOIN weights USING (t) JOIN counts USING (t) JOIN d USING (r), totals GROUP BY ALL
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 50
"""


def _oracle_op13() -> str:
    """The rules, and the fit and score of the same labelled table (ASCII addresses)."""
    from rillflow.llm import url_filter as U

    given = ", ".join(f"('{u}', {y}.0)" for y, whole in ((1, U.addresses(U.BLOCKED)), (0, U.addresses(U.ALLOWED))) for u in whole)
    place = "regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {})".format
    host = f"translate(coalesce({place(1)}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}', '{action}')" for action, text in U.RULES)
    grams = "list_concat(" + ", ".join(f"list_transform(range(1, length(t) - {n} + 2), lambda i: substring(t, i, {n}))" for n in U.SIZES) + ")"
    half = "list_transform({0}, lambda x: {{'b': x, 'c': 1.0 / sqrt(len({0})::DOUBLE)}})".format
    return f"""
WITH RECURSIVE labelled(url, y) AS (VALUES {given}
), every AS (
  SELECT NULL::BIGINT AS page_id, y::DOUBLE AS y, url, {host} AS host, coalesce({place(2)}, '') AS path FROM labelled
  UNION ALL SELECT page_id, NULL::DOUBLE, url, {host}, coalesce({place(2)}, '') FROM pages
), texts AS (
  SELECT host, path, k, t FROM (SELECT DISTINCT host, path FROM every), LATERAL (SELECT unnest(['h', 'p']) AS k, unnest([CASE WHEN host <> '' THEN '.' || host || '.' ELSE '' END, regexp_replace(lower(path), '[0-9]+', '0', 'g')]) AS t)
), hashed AS (
  SELECT host, path, k, list_sort(list_distinct(list_transform({grams}, lambda g: {CRC32_SQL.format(text="k || g")} % {U.BUCKETS} + 1))) AS d FROM texts
), described AS (
  SELECT a.host, a.path, list_concat({half("a.d")}, {half("b.d")}) AS f FROM hashed a JOIN hashed b ON a.host = b.host AND a.path = b.path AND a.k = 'h' AND b.k = 'p'
), examples AS (
  SELECT row_number() OVER (ORDER BY url, y) AS i, y, f FROM every JOIN described USING (host, path) WHERE y IS NOT NULL
), known AS (
  SELECT b, row_number() OVER (ORDER BY b) AS j, held FROM (SELECT x.b AS b, list({{'i': i, 'c': x.c}} ORDER BY i, x.c) AS held FROM (SELECT i, unnest(f) AS x FROM examples) GROUP BY ALL)
), consts AS (
  SELECT (SELECT list({{'y': y, 'f': list_transform(f, lambda x: {{'j': list_position(ks, x.b), 'c': x.c}})}} ORDER BY i) FROM examples, (SELECT list(b ORDER BY b) AS ks FROM known)) AS ex, (SELECT list(held ORDER BY b) FROM known) AS lists
), m(t, b, p, w, q) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, list_transform(lists, lambda l: 0.0::DOUBLE), list_transform(lists, lambda l: 0.0::DOUBLE) FROM consts
  UNION ALL
  SELECT t + 1, b + {U.MOMENTUM} * (b - p) + {U.RATE}::DOUBLE / len(r) * list_sum(r), b,
    list_transform(lists, lambda l, k: w[k] * {U.DECAY}::DOUBLE + {U.MOMENTUM}::DOUBLE * (w[k] - q[k]) + {U.RATE}::DOUBLE / len(r) * list_sum(list_transform(l, lambda x: r[x.i] * x.c))), w
  FROM (SELECT m.*, lists, list_transform(ex, lambda e: e.y - 1.0 / (1.0 + exp(-(b + list_sum(list_transform(e.f, lambda x: w[x.j] * x.c)))))) AS r FROM m, consts WHERE t < {U.STEPS})
), model AS (
  SELECT round(b * {U.MILLIONTHS}) AS bias, w FROM m WHERE t = {U.STEPS}
), weights AS (
  SELECT b, round(w[j] * {U.MILLIONTHS}) AS w FROM known, model
), scored AS (
  SELECT host, path, bias + coalesce(sum(weights.w * x.c), 0) AS z FROM (SELECT host, path, unnest(list_concat(f, [{{'b': 0, 'c': 0.0}}])) AS x FROM described) LEFT JOIN weights ON weights.b = x.b, model GROUP BY host, path, bias
), fits AS (
  SELECT host, path, max_by({{'rule': rule, 'action': action}}, length(rule)) AS found FROM (SELECT DISTINCT host, path FROM every) JOIN (VALUES {rules}) r(rule, h, p, action) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.action, CASE WHEN z > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM (SELECT page_id, host, path FROM every WHERE y IS NULL) LEFT JOIN fits USING (host, path) JOIN scored USING (host, path)
"""


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_license_scan": op7_license_scan,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_context_tree_weighting": op9_context_tree_weighting,
    "op10_huffman_ids": op10_huffman_ids,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_url_filter": op13_url_filter,
}
ORACLES = {"op4_exact_dedup": ORACLE_OP4, "op8_benchmark_decontamination": ORACLE_OP8, "op11_merkle_manifest": ORACLE_OP11, "op12_ranked_search": ORACLE_OP12, "op13_url_filter": _oracle_op13()}
