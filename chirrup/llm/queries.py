"""One registered query per operator, over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chirrup.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    license_scan,
    mixing,
    personal_data,
    repeated_spans,
    secret_ledger,
    token_alignment,
    toxicity,
    vector_codes,
)
from chirrup.llm.common import table
from chirrup.llm.license_rules import BASE, RULES


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predictions(docs, language_id.learn(docs))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: one scan into a new ledger, findings joined back to every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_ledger.Ledger(spark)
    secret_ledger.scan(docs, "doc_id", "text", ledger)
    rows = secret_ledger.findings(docs, "doc_id", "text", ledger)
    base = tuple(r.kind for r in secret_ledger.BASE)
    return rows.select(
        "doc_id",
        *[secret_ledger.count_of(F.col("found"), k).alias(f"n_{k}") for k in base],
        F.sha2(secret_ledger.in_order(F.col("found"), base), 256).alias("base_sha256"),
        secret_ledger.in_order(F.col("found"), tuple(r.kind for r in secret_ledger.RULES)).alias("spans"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a long passage of one: a row per document and item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts look like control strings, rendered and read back."""
    odd = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema))
    return chat_format.read_back(chat_format.rendered(chat_format.messages(chat_format.turns_as_events(rows))))


def op7_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.removed(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data.spans(table(spark, sf_dir, "documents"), personal_data.train(spark))
    return rows.select("doc_id", *[f"n_{k}" for k in personal_data.BASE], F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken", "_mix.copies")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"), token_alignment.Vocabularies.read())


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents")).drop("found")


def _secret_spans() -> str:
    """Spans of one text per rule, from the lengths of what a pattern matches and of what lies between."""
    patterns = {
        "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "private_key": "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    }
    least = {"assign": (2, 6), "access": (0, 20), "hex": (0, 24), "private_key": (0, 0)}
    parts = []
    for place, (kind, p) in enumerate(patterns.items()):
        part, n = least[kind]
        parts.append(
            f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, unnest([{{'b': list_sum(g[1:i]) + coalesce(list_sum(m[1:i-1]), 0),
            'until': list_sum(g[1:i]) + list_sum(m[1:i])}} FOR i IN range(1, len(m) + 1) IF o[i] >= {n}]) AS s FROM (
            SELECT doc_id, [length(x) FOR x IN string_split_regex(t, '{p}')] AS g, [length(x) FOR x IN regexp_extract_all(t, '{p}', 0)] AS m,
            [length(x) FOR x IN regexp_extract_all(t, '{p}', {part})] AS o FROM texts)"""
        )
    return " UNION ALL ".join(parts)


OP2 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_secret_spans()}),
written AS (SELECT doc_id, kind, s.b AS b, place, kind || ':' || s.b::BIGINT || ':' || s.until::BIGINT AS w FROM spans),
of_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(w, ',' ORDER BY b, place) FILTER (place < 3) AS base,
  string_agg(w, ',' ORDER BY b, place) AS spans FROM written GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN of_doc USING (doc_id)
"""

OP3 = r"""
WITH rows AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
  row_number() OVER () AS r FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM rows
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked
"""

OP6 = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<\n]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP9 = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  (('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, ''))))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
  [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sources),
levels AS (SELECT *, row_number() OVER o AS k, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
level AS (SELECT arg_min(level, k) AS level FROM levels WHERE cap / w > level),
aims AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM level)), cap) AS target FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aims),
spread AS (SELECT *, target - whole * source_size AS rest FROM parts),
levelled AS (SELECT source, 1.0::DOUBLE / sqrt(greatest(size, 1)::DOUBLE) AS x, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
tried AS (SELECT l.source, x, coalesce((rest - (sum(words) OVER (f ROWS UNBOUNDED PRECEDING) - words)) / nullif(sum(words * x) OVER (r ROWS UNBOUNDED PRECEDING), 0), 0) AS c
  FROM levelled l JOIN spread p ON l.source IS NOT DISTINCT FROM p.source WINDOW f AS (PARTITION BY l.source ORDER BY x DESC), r AS (PARTITION BY l.source ORDER BY x)),
scales AS (SELECT source, arg_max(c, x) AS c FROM tried WHERE x * c < 1 GROUP BY source),
chances AS (SELECT s.*, least(1.0::DOUBLE, 1.0::DOUBLE / sqrt(greatest(size, 1)::DOUBLE) * coalesce(c, 0)) AS p
  FROM sized s LEFT JOIN scales k ON s.source IS NOT DISTINCT FROM k.source),
ranked AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.rest,
  sum(s.size) OVER (PARTITION BY s.source ORDER BY u * (1 - s.p) / (u * (1 - s.p) + (1 - u) * s.p), doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM chances s JOIN spread p ON s.source IS NOT DISTINCT FROM p.source),
copied AS (SELECT *, (whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM ranked)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM copied
"""

OP11 = """
WITH whole AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN v] AS v
  FROM whole WHERE len(v) = (SELECT len(v) FROM whole ORDER BY vec_id NULLS LAST, v LIMIT 1)),
parts AS (SELECT r, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM kept, range(16) AS t(p)),
b0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64),
a0 AS (SELECT r, p, min(list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT * 64 + e) AS de FROM parts JOIN b0 USING (p) GROUP BY r, p),
m1 AS (SELECT p, de % 64 AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM a0 JOIN parts USING (r, p), unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL),
b1 AS (SELECT p, e, coalesce(list(m ORDER BY i) FILTER (m IS NOT NULL), any_value(c)) AS c FROM b0 LEFT JOIN m1 USING (p, e) GROUP BY p, e),
a1 AS (SELECT r, p, min(list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT * 64 + e) AS de FROM parts JOIN b1 USING (p) GROUP BY r, p),
m2 AS (SELECT p, de % 64 AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM a1 JOIN parts USING (r, p), unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL),
b2 AS (SELECT p, e, coalesce(list(m ORDER BY i) FILTER (m IS NOT NULL), any_value(c)) AS c FROM b1 LEFT JOIN m2 USING (p, e) GROUP BY p, e),
a2 AS (SELECT r, p, min(list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT * 64 + e) AS de FROM parts JOIN b2 USING (p) GROUP BY r, p),
coded AS (SELECT r, string_agg(printf('%02x', (de % 64)::INTEGER), '' ORDER BY p) AS code, sum(de // 64)::BIGINT AS error FROM a2 GROUP BY r),
digest AS (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: Spaces are doubled, so that matches of neighbouring words need not share one.
OP13 = rf"""
WITH rules (number, label, keyword, pattern, priority) AS (VALUES {_values((r.number, r.label, r.keyword.replace(" ", "  "), " (?:" + r.pattern.replace(" ", "  ") + ") ", r.priority) for r in RULES)}),
phrases (label, pattern) AS (VALUES {_values((label, " " + p.replace(" ", "  ") + " ") for p, label in BASE)}),
texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spaced AS (SELECT r, doc_id, len(w) AS n_words, ' ' || array_to_string(w, '  ') || ' ' AS t FROM texts),
matches AS (SELECT r, number, label, priority, pattern, t, unnest(range(1, len(m) + 1)) AS i, m, string_split_regex(t, pattern) AS g
  FROM (SELECT r, number, label, priority, pattern, t, regexp_extract_all(t, pattern) AS m FROM spaced JOIN rules ON contains(t, keyword)) WHERE len(m) > 0),
placed AS (SELECT r, number, label, priority, (length(b) - length(replace(b, ' ', ''))) // 2 AS a, (length(m[i]) - length(replace(m[i], ' ', ''))) // 2 AS n FROM (
  SELECT *, array_to_string(g[1:i], '') || array_to_string(m[1:i-1], '') AS b FROM matches)),
kept AS (SELECT * FROM placed x WHERE NOT EXISTS (SELECT 1 FROM placed y WHERE y.r = x.r AND y.a <= x.a AND x.a + x.n <= y.a + y.n
  AND (-y.priority, -y.n, y.a, y.number) < (-x.priority, -x.n, x.a, x.number))),
base_places AS (SELECT r, label, (length(b) - length(replace(b, ' ', ''))) // 2 AS a FROM (
  SELECT r, label, unnest([array_to_string(g[1:i], '') || repeat(pattern, (i - 1)::BIGINT) FOR i IN range(1, len(g))]) AS b FROM (
    SELECT r, label, pattern, string_split(t, pattern) AS g FROM spaced JOIN phrases ON contains(t, pattern)))),
base AS (SELECT r, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base_places GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(priority) AS priority FROM (
  SELECT r, label, priority FROM kept UNION ALL SELECT r, label, {license_scan.BASE_WEIGHT} FROM base_places) GROUP BY r)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(priority, 0) / 100.0::DOUBLE AS score
FROM spaced LEFT JOIN base USING (r) LEFT JOIN named USING (r)
"""

QUERIES = {
    "op1_language": op1_language,
    "op2_secrets": op2_secrets,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_repeated_spans": op7_repeated_spans,
    "op8_personal_data": op8_personal_data,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_alignment": op12_token_alignment,
    "op13_license_scan": op13_license_scan,
}
ORACLE = {"op2_secrets": OP2, "op3_exact_dedup": OP3, "op6_chat_format": OP6, "op9_mixing": OP9, "op11_vector_codes": OP11, "op13_license_scan": OP13}
