"""Registered queries over text, labelled data, features and evaluation, each with its SQL."""

import uuid

from pyspark.sql import functions as F

from chirrup.constants import NEGATIONS, SADS, SENTIMENTS, SMILES, STOPWORDS
from chirrup.functions import social_text as st
from chirrup.functions import strings
from chirrup.operators import evaluation as ev
from chirrup.operators import features, labelled
from chirrup.session import shared_folder
from chirrup.sources.star_adapter import FRAGMENTS
from registry.core import on
from registry.intake import WS
from registry.relations_sql import LABELLED, SCORED, sql


def _social(s, **kw):
    return st.normalise_corpus(s.social_text, "text", **kw)


def _tokens(s):
    return st.normalise_corpus(s.labelled_text, "post_text")


def _char_term_totals(s):
    """A word is taken apart once, however often it occurs."""
    words = _social(s).select(F.explode(st.words(F.col("normalised"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select(F.explode(st.char_ngrams(F.col("word"))).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def _word_weights(s):
    return features.tfidf(features.term_counts(_tokens(s), "text_id", F.col("tokens"), pairs=True), "text_id")


def _char_weights(s):
    return features.tfidf(features.term_counts(_tokens(s), "text_id", st.words(F.col("normalised")), parts=st.grams_of), "text_id")


def _per_document(weights):
    return weights.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n_features"), F.round(F.sum("weight"), 6).alias("weight_sum")
    )


def _union_cells(s):
    word, char = _word_weights(s), _char_weights(s)
    both = word.withColumn("arm", F.lit("word")).unionByName(char.withColumn("arm", F.lit("char")))
    return both.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n_features"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squared_norm")
    )


def _split_counts(s):
    split = labelled.stratified_split(s.labelled_text)
    return split.groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("rows"))


def _manifest(s):
    return labelled.split_manifest(labelled.stratified_split(s.labelled_text)).select("task", "label", "split", "rows", "id_overlap")


def _fold_counts(s):
    return labelled.with_folds(s.labelled_text, "sentiment_label", 5).groupBy("sentiment_label", "fold").agg(F.count(F.lit(1)).alias("rows"))


def _confusion(s):
    return ev.confusion(s.scored_text, SENTIMENTS)


def _ovr(s):
    return ev.one_vs_rest(s.scored_text, SENTIMENTS)


def _sliced(s):
    return ev.slice_metrics(st.normalise_corpus(s.scored_text, "post_text", attributes=True), SENTIMENTS)


def _errors(s):
    return ev.error_samples(st.with_base_clean(s.scored_text, "post_text"))


def _store_metrics(s):
    """A step of its own: both metrics from the scored rows, label by label, written out."""
    folder = f"{shared_folder(s.spark)}/chirrup-metrics-{uuid.uuid4().hex}"
    n, hit = F.count(F.lit(1)), F.count_if(F.col("true") == F.col("pred"))
    side = F.explode(F.array(*[F.struct(F.col(c).alias("label"), (F.col("true") == F.col("pred")).cast("int").alias("hit")) for c in ("true", "pred")])).alias("x")
    per_label = s.scored_text.select(side).select("x.*").groupBy("label").agg((F.sum("hit") / n).alias("f1"))  # two hits a match over both sides
    f1 = per_label.agg((F.sum("f1") / len(SENTIMENTS)).alias("value")).select(F.lit("f1_macro").alias("metric"), "value")
    accuracy = s.scored_text.agg((hit / n).alias("value")).select(F.lit("accuracy").alias("metric"), "value")
    accuracy.unionByName(f1).write.parquet(folder)
    return folder


def _stored(s, store=_store_metrics):
    stored = s.spark.read.parquet(store(s))
    again = ev.summary(_confusion(s)).select("accuracy", "f1_macro").unpivot([], ["accuracy", "f1_macro"], "metric", "value")
    return ev.stored_equals(stored, again)


def _lengths(s):
    split = s.labelled_text.withColumn("part", F.when(F.col("text_id") % 5 == 0, "test").otherwise("train"))
    return ev.length_histogram(st.with_base_clean(split, "post_text").withColumn("len", F.length("clean")), "len", "part")


QUERIES = {
    "T1_T3_normalised": on(lambda s: _social(s).select("doc_id", "clean", "normalised")),
    "T4_T5_tokens": on(lambda s: _social(s).select("doc_id", F.array_join("tokens", " ").alias("tokens"))),
    "T6_bigrams": on(
        lambda s: _social(s).select(F.explode(st.with_bigrams(F.col("tokens"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ),
    "T7_char_ngrams": on(_char_term_totals),
    "T8_attributes": on(
        lambda s: _social(s, attributes=True).select(
            "doc_id", "n_chars", "n_tokens", "has_url", "has_mention", "has_hashtag", "has_emoji", "has_negation", "has_elong"
        )
    ),
    "T9_strip_tags": on(lambda s: s.pages.select("page_id", strings.strip_tags(F.col("html")).alias("text"))),
    "T9_strip_embed": on(lambda s: s.pages.select("page_id", strings.strip_embed(F.col("html")).alias("text"))),
    "T10_devanagari": on(
        lambda s: s.event_log.groupBy(F.coalesce(strings.has_devanagari(F.col("text")), F.lit(False)).alias("devanagari")).agg(F.count(F.lit(1)).alias("n"))
    ),
    "T11_shorten": on(lambda s: s.table("documents").select("doc_id", strings.shorten(F.col("text"), 80).alias("shown"))),
    "N1_audit": on(lambda s: labelled.audit(s.labelled_text, SENTIMENTS[:2])),
    "N2_hold_outs": on(lambda s: labelled.hold_out(s.labelled_text).counts),
    "N2_duplicate_ids": on(lambda s: labelled.hold_out(s.labelled_text).duplicates.select("text_id")),
    "N3_conflicting_texts": on(lambda s: labelled.conflicting_texts(labelled.hold_out(s.labelled_text).modelled)),
    "N4_label_counts": on(lambda s: labelled.label_counts(s.labelled_text)),
    "N4_length_profile": on(lambda s: labelled.length_profile(labelled.hold_out(s.labelled_text).modelled)),
    "N5_split_counts": on(_split_counts),
    "N5_manifest": on(_manifest),
    "N6_word_tfidf": on(lambda s: _word_weights(s).select("text_id", "term", F.round("weight", 9).alias("weight"))),
    "N6_char_tfidf": on(lambda s: _per_document(_char_weights(s))),
    "N7_union_features": on(_union_cells),
    "N8_topic_vocabulary": on(
        lambda s: features.topic_vocabulary(features.term_counts(_tokens(s), "text_id", F.col("tokens")), "text_id").select(
            "term", "df", "total", F.col("idx").cast("long").alias("idx")
        )
    ),
    "N14_fold_counts": on(_fold_counts),
    "X1_summary": on(lambda s: ev.summary(_confusion(s))),
    "X2_per_class": on(lambda s: ev.per_class(_confusion(s))),
    "X3_auc_per_class": on(lambda s: ev.auc_per_class(_ovr(s))),
    "X3_roc_auc_macro": on(lambda s: ev.roc_auc_macro(_ovr(s))),
    "X4_log_loss": on(lambda s: ev.log_loss(s.scored_text, SENTIMENTS)),
    "X5_brier": on(lambda s: ev.brier(_ovr(s))),
    "X6_confusion": on(_confusion),
    "X7_mcnemar": on(lambda s: ev.mcnemar(s.scored_text)),
    "X8_error_samples": on(_errors),
    "X9_slice_metrics": on(_sliced),
    "X10_roc_points": on(lambda s: ev.roc_points(_ovr(s)).drop("threshold")),
    "X11_reliability": on(lambda s: ev.reliability(_ovr(s))),
    "X13_agreement": on(lambda s: ev.agreement(s.scored_text, "true", "pred_b").select(*[F.round(c, 10).alias(c) for c in ("nmi", "ari", "homogeneity", "completeness")])),
    "X13_contingency": on(lambda s: ev.contingency(s.scored_text, "true", "pred_b")),
    "X14_top_confusions": on(lambda s: ev.top_confusions(_confusion(s))),
    "X14_slice_deltas": on(lambda s: ev.slice_deltas(_sliced(s))),
    "X14_length_extremes": on(lambda s: ev.length_extremes(_sliced(s))),
    "X15_length_histogram": on(_lengths),
    "X16_stored_equals": on(_stored),
    "X17_example_texts": on(lambda s: ev.example_texts(_social(s, attributes=True), "doc_id", "clean")),
}

# ------------------------------------------------------------------------------ SQL
def q(text):
    return text.replace("'", "''")


def squeeze(x):
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


SOCIAL = "social AS (SELECT doc_id AS id, text || CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{q(f)}'" for i, f in enumerate(FRAGMENTS)) + " ELSE '' END AS text FROM documents)"
DOCS = "social AS (SELECT doc_id AS id, text FROM documents JOIN labels USING (doc_id))"
UNENT = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{2B00}-\\x{2BFF}\\x{FE0F}]"
URL = f"https?://[^{WS}]+|www\\.[^{WS}]+"


def _escape(word):
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in word)


def _faces(words):
    return "|".join(q(_escape(w)) for w in sorted(words, key=len, reverse=True))


def _stretch(x):
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}{c}', 'g')"
    return x


STRETCHED = "|".join(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyz")


def _marked(x):
    for pattern, mark in (
        (URL, " <url> "), ("@[a-z0-9_]+", " <user> "), ("#([a-z0-9_]+)", "\\1 <hashtag> "), (_faces(SMILES), " <smile> "),
        (_faces(SADS), " <sad> "), (EMOJI, " <emoji> "), ("\\bcan''t\\b", "can not"), ("\\bwon''t\\b", "will not"), ("n''t\\b", " not"),
        ("''re\\b", " are"), ("''ve\\b", " have"), ("''ll\\b", " will"), ("''d\\b", " would"), ("''m\\b", " am"), ("''s\\b", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return x


NORMAL = f""", n1 AS (SELECT *, replace(coalesce(text, ''), '\\u2019', chr(8217)) AS a FROM social),
  n2 AS (SELECT *, {squeeze("translate(" + UNENT.format(UNENT.format("a")) + ", '’‘“”', '''''\"\"')")} AS clean FROM n1),
  n3 AS (SELECT *, {_marked("lower(clean)")} AS b FROM n2),
  n4 AS (SELECT *, CASE WHEN regexp_matches(b, '{STRETCHED}') THEN {_stretch("b")} || ' <elong>' ELSE b END AS c FROM n3),
  n5 AS (SELECT * EXCLUDE (a, b, c), {squeeze(f"regexp_replace(c, '[^a-z0-9{WS}<>]', ' ', 'g')")} AS normalised FROM n4)"""

WORDS = f""", w1 AS (SELECT id, i, w, w IN ({", ".join(f"'{n}'" for n in NEGATIONS)}) AS neg, regexp_full_match(w, '<[a-z]+>') AS mark
    FROM (SELECT id, unnest(string_split(normalised, ' ')) AS w, generate_subscripts(string_split(normalised, ' '), 1) AS i FROM n5)
    WHERE w <> '' AND w NOT IN ({", ".join(f"'{n}'" for n in STOPWORDS)})),
  w2 AS (SELECT *, sum(CAST(NOT neg AND NOT mark AS INT)) OVER (PARTITION BY id ORDER BY i) AS c FROM w1),
  w3 AS (SELECT *, max(CASE WHEN neg THEN c END) OVER (PARTITION BY id ORDER BY i) AS at_neg FROM w2),
  w4 AS (SELECT id, i, CASE WHEN NOT neg AND NOT mark AND c - at_neg <= 3 THEN 'NOT_' || w ELSE w END AS t FROM w3),
  tok AS (SELECT id, i, t FROM w4 UNION ALL SELECT id, 1, '<empty>' FROM n5 WHERE id NOT IN (SELECT id FROM w4))"""
TERMS = WORDS + """, terms AS (SELECT id, t AS term FROM tok UNION ALL
  SELECT id, t || ' ' || nx FROM (SELECT id, t, lead(t) OVER (PARTITION BY id ORDER BY i) AS nx FROM tok) WHERE nx IS NOT NULL)"""
GRAMS = """, p AS (SELECT id, ' ' || unnest(string_split(normalised, ' ')) || ' ' AS w FROM n5 WHERE normalised <> ''),
  terms AS (SELECT id, unnest(CASE WHEN len(w) <= 3 THEN [w] ELSE flatten(list_transform([3, 4, 5], lambda k: CASE WHEN k <= len(w)
      THEN list_transform(range(1, len(w) - k + 2), lambda j: substr(w, j, k)) ELSE CAST([] AS VARCHAR[]) END)) END) AS term FROM p)"""
TFIDF = """, tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
  raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT id) FROM tf))::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
  weights AS (SELECT id AS text_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""
CLEAN_LABELLED = f""", cl AS (SELECT *, {squeeze("translate(" + UNENT.format(UNENT.format("post_text")) + ", '’‘“”', '''''\"\"')")} AS clean FROM labelled),
  ranked AS (SELECT *, clean = '' AS empty, row_number() OVER (PARTITION BY clean = '', post_text, sentiment_label, topic_category ORDER BY text_id) > 1 AS again FROM cl)"""
CM = """, grid AS (SELECT a.label AS t, b.label AS p, count(s.text_id) AS n FROM classes a CROSS JOIN classes b
   LEFT JOIN scored s ON s.truth = a.label AND s.pred = b.label GROUP BY ALL),
  cls AS (SELECT c.label, sum(n) FILTER (t = c.label AND p = c.label) AS hit, sum(n) FILTER (t = c.label) AS sup, sum(n) FILTER (p = c.label) AS prd FROM classes c, grid GROUP BY 1)"""
ATTR = f""", attr AS (SELECT n5.id AS text_id, len(clean) AS n_chars, coalesce(k.n, 0) AS n_tokens, regexp_matches(text, '{URL}', 'i') AS has_url,
    regexp_matches(text, '@[A-Za-z0-9_]+') AS has_mention, regexp_matches(text, '#[A-Za-z0-9_]+') AS has_hashtag,
    regexp_matches(text, '{EMOJI}') OR regexp_matches(lower(text), '{_faces(SMILES)}|{_faces(SADS)}') AS has_emoji,
    regexp_matches(text, '(?i)(?:^|[^\\pL\\pN_])(?:{"|".join(NEGATIONS)}|can''t|won''t)(?:$|[^\\pL\\pN_])') AS has_negation,
    regexp_matches(text, '{STRETCHED}|{STRETCHED.upper()}') AS has_elong
    FROM n5 LEFT JOIN (SELECT id, count(*) AS n FROM w4 GROUP BY 1) k ON k.id = n5.id)"""
SLICES = NORMAL + WORDS + ATTR + """, joined AS (SELECT s.truth, s.pred, a.*, (SELECT quantile_cont(n_tokens, [0.25, 0.5, 0.75]) FROM attr) AS e,
    (SELECT count(DISTINCT x) FROM (SELECT unnest(quantile_cont(n_tokens, [0.0, 0.25, 0.5, 0.75, 1.0])) AS x FROM attr)) AS k FROM scored s JOIN attr a USING (text_id)),
  sl AS (SELECT truth, pred, unnest(['overall', 'len_' || CASE WHEN k < 5 THEN 'all' WHEN n_tokens <= e[1] THEN 'short' WHEN n_tokens <= e[2] THEN 'medium'
      WHEN n_tokens <= e[3] THEN 'long' ELSE 'very_long' END, CASE WHEN has_negation THEN 'negation_yes' ELSE 'negation_no' END,
      CASE WHEN has_emoji THEN 'emoji_yes' ELSE 'emoji_no' END, CASE WHEN has_url THEN 'url_yes' ELSE 'url_no' END]) AS slice FROM joined),
  per AS (SELECT slice, label, count(*) FILTER (truth = label AND pred = label) AS hit, count(*) FILTER (truth = label) + count(*) FILTER (pred = label) AS both_ FROM sl, classes GROUP BY ALL),
  by_slice AS (SELECT sl.slice, any_value(f.n) AS n, round(any_value(f.acc), 4) AS accuracy, round(avg(coalesce(2.0::DOUBLE * hit / nullif(both_, 0), 0)), 4) AS f1_macro
    FROM per sl JOIN (SELECT slice, count(*) AS n, avg(CAST(truth = pred AS INT)) AS acc FROM sl GROUP BY 1) f USING (slice) GROUP BY sl.slice)"""


def scored(body):
    return sql(DOCS, SCORED, body=SLICES + body)


STRATA = """
      , g AS (SELECT sentiment_label || '||' || topic_category AS both_, sentiment_label AS one_ FROM labelled),
      s AS (SELECT CASE WHEN (SELECT min(c) FROM (SELECT count(*) AS c FROM g GROUP BY both_)) >= 2 THEN both_ ELSE one_ END AS stratum FROM g),
      c AS (SELECT stratum, count(*) AS n, (SELECT count(*) FROM s) AS t FROM s GROUP BY 1),
      e AS (SELECT *, n * ceil(t * 0.2::DOUBLE) / t AS x FROM c), f AS (SELECT *, floor(x) AS fl FROM e),
      z AS (SELECT *, fl + CAST(row_number() OVER (ORDER BY x - fl DESC, stratum) <= ceil(t * 0.2::DOUBLE) - (SELECT sum(fl) FROM f) AS INT) AS k FROM f)"""

ORACLE = {
    "T1_T3_normalised": sql(SOCIAL, body=NORMAL + " SELECT id AS doc_id, clean, normalised FROM n5"),
    "T4_T5_tokens": sql(SOCIAL, body=NORMAL + WORDS + " SELECT id AS doc_id, string_agg(t, ' ' ORDER BY i) AS tokens FROM tok GROUP BY id"),
    "T6_bigrams": sql(SOCIAL, body=NORMAL + TERMS + " SELECT term, count(*) AS n FROM terms GROUP BY term"),
    "T7_char_ngrams": sql(SOCIAL, body=NORMAL + GRAMS + " SELECT term AS gram, count(*) AS n FROM terms GROUP BY term"),
    "T8_attributes": sql(SOCIAL, body=NORMAL + WORDS + ATTR + " SELECT text_id AS doc_id, * EXCLUDE (text_id) FROM attr"),
    "T9_strip_tags": f" SELECT page_id, {squeeze("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS text FROM pages",
    "T9_strip_embed": f" SELECT page_id, {squeeze("replace(replace(" + UNENT.format("regexp_replace(regexp_replace(html, '<br\\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g')") + ", '&middot;', '·'), '&copy;', '©')")} AS text FROM pages",
    "T10_devanagari": "SELECT event_id % 4 <> 0 AND event_id % 6 = 0 AS devanagari, CAST(sum(CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY 1",
    "T11_shorten": "SELECT doc_id, CASE WHEN len(text) > 80 THEN left(text, 79) || '…' ELSE text END AS shown FROM documents",
    "N1_audit": sql(LABELLED, body="""
      SELECT 'blank text_id' AS problem, 0::BIGINT AS "rows" UNION ALL SELECT 'unexpected sentiment_label', count(*) FROM labelled WHERE sentiment_label NOT IN ('Negative', 'Neutral')
      UNION ALL SELECT 'blank topic_category', count(*) FROM labelled WHERE trim(topic_category) = ''
      UNION ALL SELECT 'repeated text_id', count(*) - count(DISTINCT text_id) FROM labelled"""),
    "N2_hold_outs": sql(LABELLED, body=CLEAN_LABELLED + """
      SELECT count(*) AS n_raw, count(*) FILTER (empty) AS n_empty, count(*) FILTER (NOT empty AND again) AS n_duplicate,
             count(*) FILTER (NOT empty AND NOT again) AS n_modelled, true AS closes FROM ranked"""),
    "N2_duplicate_ids": sql(LABELLED, body=CLEAN_LABELLED + " SELECT text_id FROM ranked WHERE NOT empty AND again"),
    "N3_conflicting_texts": sql(LABELLED, body=CLEAN_LABELLED + """
      SELECT count(*) AS conflicting_texts FROM (SELECT 1 FROM ranked WHERE NOT empty AND NOT again GROUP BY post_text
        HAVING count(DISTINCT sentiment_label) > 1 OR count(DISTINCT topic_category) > 1)"""),
    "N4_label_counts": sql(LABELLED, body="""
      SELECT 'sentiment_label' AS task, sentiment_label AS label, count(*) AS "rows" FROM labelled GROUP BY 2
      UNION ALL SELECT 'topic_category', topic_category, count(*) FROM labelled GROUP BY 2"""),
    "N4_length_profile": sql(LABELLED, body=CLEAN_LABELLED + """
      SELECT min(len(clean)) AS min, round(avg(len(clean)), 1) AS mean, max(len(clean)) AS max, quantile_cont(len(clean)::DOUBLE, 0.5) AS p50 FROM ranked WHERE NOT empty AND NOT again"""),
    "N5_split_counts": sql(LABELLED, body=STRATA + """
      SELECT 'test' AS split, stratum, CAST(k AS BIGINT) AS "rows" FROM z WHERE k > 0 UNION ALL SELECT 'train', stratum, CAST(n - k AS BIGINT) FROM z WHERE n > k"""),
    "N5_manifest": sql(LABELLED, body=STRATA + """
      , p AS (SELECT 'test' AS split, stratum, CAST(k AS BIGINT) AS r FROM z UNION ALL SELECT 'train', stratum, CAST(n - k AS BIGINT) FROM z),
      l AS (SELECT split, r, 'sentiment_label' AS task, split_part(stratum, '||', 1) AS label FROM p UNION ALL SELECT split, r, 'topic_category', split_part(stratum, '||', 2) FROM p)
      SELECT task, label, split, CAST(sum(r) AS BIGINT) AS "rows", 0::BIGINT AS id_overlap FROM l GROUP BY ALL HAVING sum(r) > 0"""),
    "N6_word_tfidf": sql(DOCS, body=NORMAL + TERMS + TFIDF + " SELECT text_id, term, round(weight, 9) AS weight FROM weights"),
    "N6_char_tfidf": sql(DOCS, body=NORMAL + GRAMS + TFIDF + " SELECT text_id, count(*) AS n_features, round(sum(weight), 6) AS weight_sum FROM weights GROUP BY 1"),
    "N7_union_features": sql(DOCS, body=NORMAL + TERMS + TFIDF + GRAMS.replace("terms AS", "grams AS") + """
      , tf2 AS (SELECT id, term FROM grams GROUP BY ALL), df2 AS (SELECT term FROM tf2 GROUP BY 1 HAVING count(*) >= 2),
      u AS (SELECT text_id, 'w' AS arm FROM weights UNION ALL SELECT id, 'c' FROM tf2 JOIN df2 USING (term))
      SELECT text_id, count(*) AS n_features, count(DISTINCT arm)::DOUBLE AS squared_norm FROM u GROUP BY 1"""),
    "N8_topic_vocabulary": sql(DOCS, body=NORMAL + WORDS + """
      , tf AS (SELECT id, t AS term, count(*) AS tf FROM tok GROUP BY ALL),
      v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.9::DOUBLE * (SELECT count(DISTINCT id) FROM tf))
      SELECT *, row_number() OVER (ORDER BY total DESC, term) - 1 AS idx FROM v"""),
    "N14_fold_counts": sql(LABELLED, body="""
      , c AS (SELECT sentiment_label, count(*) AS n FROM labelled GROUP BY 1), k AS (SELECT greatest(2, least(5, min(n))) AS k FROM c)
      SELECT sentiment_label, CAST(f AS INTEGER) AS fold, CAST(n // k AS BIGINT) + CAST(f < n % k AS BIGINT) AS "rows" FROM c, k, range(5) r(f) WHERE f < k"""),
    "X1_summary": sql(SCORED, body=CM + """
      , s AS (SELECT sum(n)::DOUBLE AS n, sum(n) FILTER (t = p)::DOUBLE AS hit FROM grid),
      b AS (SELECT avg(coalesce(2.0::DOUBLE * hit / nullif(sup + prd, 0), 0)) AS f, sum(coalesce(2.0::DOUBLE * hit / nullif(sup + prd, 0), 0) * sup) / sum(sup) AS fw,
                   sum(sup * prd)::DOUBLE AS tp, sum(sup * sup)::DOUBLE AS tt, sum(prd * prd)::DOUBLE AS pp FROM cls)
      SELECT hit / n AS accuracy, f AS f1_macro, fw AS f1_weighted, hit / n AS f1_micro, coalesce((hit * n - tp) / nullif(sqrt((n * n - tt) * (n * n - pp)), 0), 0) AS mcc,
             CAST(n AS BIGINT) AS n FROM s, b"""),
    "X2_per_class": sql(SCORED, body=CM + """
      SELECT label, coalesce(hit::DOUBLE / nullif(prd, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(sup, 0), 0) AS recall,
             coalesce(2.0::DOUBLE * hit / nullif(sup + prd, 0), 0) AS f1, CAST(sup AS BIGINT) AS support FROM cls"""),
    "X3_auc_per_class": sql(SCORED, body="""
      SELECT label, (SELECT sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) / count(*) FROM per_class a JOIN per_class b
        ON a.label = c.label AND b.label = c.label AND a.y = 1 AND b.y = 0) AS auc FROM classes c"""),
    "X3_roc_auc_macro": sql(SCORED, body="""
      SELECT avg(x) AS roc_auc_ovr FROM (SELECT a.label, sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) / count(*) AS x
        FROM per_class a JOIN per_class b ON a.label = b.label AND a.y = 1 AND b.y = 0 GROUP BY 1)"""),
    "X4_log_loss": sql(SCORED, body=" SELECT avg(-ln(p)) AS log_loss FROM per_class WHERE y = 1"),
    "X5_brier": sql(SCORED, body=" SELECT label, avg((p - y) * (p - y)) AS brier FROM per_class GROUP BY label"),
    "X6_confusion": sql(SCORED, body=CM + """ SELECT t AS "true", p AS pred, n, n::DOUBLE / nullif(sum(n) OVER (PARTITION BY t), 0) AS row_share FROM grid"""),
    "X7_mcnemar": sql(SCORED, body="""
      , k AS (SELECT count(*) FILTER (pred = truth AND pred_b <> truth) AS b, count(*) FILTER (pred <> truth AND pred_b = truth) AS c FROM scored),
      t AS (SELECT *, CASE WHEN b = c THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
              lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS x FROM k)
      SELECT b AS b_a_right_b_wrong, c AS c_a_wrong_b_right, x AS p_value, x < 0.05 AS significant_05 FROM t"""),
    "X8_error_samples": sql(SCORED, body=f"""
      , e AS (SELECT *, {squeeze("translate(" + UNENT.format(UNENT.format("post_text")) + ", '’‘“”', '''''\"\"')")} AS c FROM scored WHERE truth <> pred)
      SELECT text_id, truth AS "true", pred, CASE WHEN len(c) > 220 THEN left(c, 219) || '…' ELSE c END AS text FROM e
      QUALIFY row_number() OVER (PARTITION BY truth, pred ORDER BY text_id) <= 3"""),
    "X9_slice_metrics": scored(" SELECT * FROM by_slice"),
    "X10_roc_points": sql(SCORED, body="""
      , s AS (SELECT DISTINCT label, p FROM per_class)
      SELECT s.label, round(count(*) FILTER (y = 0 AND c.p >= s.p)::DOUBLE / count(*) FILTER (y = 0), 4) AS fpr, round(count(*) FILTER (y = 1 AND c.p >= s.p)::DOUBLE / count(*) FILTER (y = 1), 4) AS tpr
      FROM s JOIN per_class c USING (label) GROUP BY s.label, s.p UNION ALL SELECT label, 0.0::DOUBLE, 0.0::DOUBLE FROM classes"""),
    "X11_reliability": sql(SCORED, body="""
      SELECT label, len(list_filter(list_transform(range(1, 10), lambda i: i * 0.1::DOUBLE), lambda e: p > e)) AS bin, avg(p) AS prob_pred, avg(y) AS prob_true, count(*) AS n FROM per_class GROUP BY ALL"""),
    "X13_agreement": sql(SCORED, body="""
      , c AS (SELECT truth, pred_b, count(*)::DOUBLE AS n, (SELECT count(*) FROM scored)::DOUBLE AS t FROM scored GROUP BY ALL),
      a AS (SELECT truth, sum(n) AS n, any_value(t) AS t FROM c GROUP BY 1), b AS (SELECT pred_b, sum(n) AS n, any_value(t) AS t FROM c GROUP BY 1),
      v AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM a) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b) AS hb,
                   (SELECT sum(c.n / c.t * ln(c.n * c.t / (a.n * b.n))) FROM c JOIN a USING (truth) JOIN b USING (pred_b)) AS mi,
                   (SELECT sum(n * (n - 1) / 2) FROM c) AS pc, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
                   (SELECT any_value(t) * (any_value(t) - 1) / 2 FROM c) AS pt)
      SELECT round(2 * mi / (ha + hb), 10) AS nmi, round((pc - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 10) AS ari, round(mi / ha, 10) AS homogeneity, round(mi / hb, 10) AS completeness FROM v"""),
    "X13_contingency": sql(SCORED, body=""" SELECT truth AS "true", pred_b, count(*) AS n FROM scored GROUP BY ALL"""),
    "X14_top_confusions": sql(SCORED, body=CM + """ SELECT t AS "true", p AS pred, n FROM grid WHERE t <> p ORDER BY n DESC, t DESC, p DESC LIMIT 4"""),
    "X14_slice_deltas": scored("""
      , v AS (SELECT map(list(slice), list(accuracy)) AS m, min(accuracy) FILTER (slice LIKE 'len%') AS lo, max(accuracy) FILTER (slice LIKE 'len%') AS hi FROM by_slice),
      r AS (SELECT unnest(['negation', 'emoji', 'url', 'length']) AS contrast, m, lo, hi FROM v),
      d AS (SELECT contrast, CASE contrast WHEN 'length' THEN hi ELSE m[contrast || '_yes'] END AS first, CASE contrast WHEN 'length' THEN lo ELSE m[contrast || '_no'] END AS second FROM r)
      SELECT *, round(first - second, 4) AS delta FROM d"""),
    "X14_length_extremes": scored("""
      SELECT (SELECT slice FROM by_slice WHERE slice LIKE 'len%' ORDER BY accuracy, slice LIMIT 1) AS worst,
             (SELECT slice FROM by_slice WHERE slice LIKE 'len%' ORDER BY accuracy DESC, slice DESC LIMIT 1) AS best"""),
    "X15_length_histogram": sql(LABELLED, body=CLEAN_LABELLED + """
      SELECT CASE WHEN text_id % 5 = 0 THEN 'test' ELSE 'train' END AS part, least(CAST(floor(len(clean) / ((SELECT max(len(clean)) FROM cl) / 39.0::DOUBLE)) AS BIGINT), 38) AS bin, count(*) AS n FROM cl GROUP BY ALL"""),
    "X16_stored_equals": sql(SCORED, body=CM + """
      , v AS (SELECT 'accuracy' AS metric, sum(n) FILTER (t = p)::DOUBLE / sum(n) AS x FROM grid UNION ALL SELECT 'f1_macro', avg(coalesce(2.0::DOUBLE * hit / nullif(sup + prd, 0), 0)) FROM cls)
      SELECT metric, x AS stored, x AS recomputed, true AS agrees FROM v"""),
    "X17_example_texts": sql(SOCIAL, body=NORMAL + WORDS + ATTR + """
      , c AS (SELECT text_id, unnest(list_filter([CASE WHEN has_url OR has_mention OR has_hashtag THEN 'URLs / mentions / hashtags' END, CASE WHEN has_negation THEN 'negation' END,
                 CASE WHEN has_emoji OR has_elong THEN 'emoji / elongation' END, CASE WHEN n_tokens BETWEEN 8 AND 25 THEN 'ordinary post' END], lambda x: x IS NOT NULL)) AS example FROM attr),
      m AS (SELECT example, min(text_id) AS k FROM c GROUP BY 1) SELECT example, k AS doc_id, clean AS text FROM m JOIN n5 ON id = k"""),
}
