"""The registered queries on the driver's tables, and SQL that gives the same rows.

``samples`` is the documents with their labels in the shape of a manifest; scores are
hashes of ids, moved up for positives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.audio import crop_pad, mean_std, pooled, sigmoid, tone_frequency
from ..functions.text import contained_path, hash_fraction, normalize_text, public_endpoint, retry_seed, text_identity, token_cap
from ..operators import gates, generation, graph, metrics, rag, reports, rules, selection, workers
from ..operators.quantiles import quantiles
from ..operators.runs import digests
from ..session import cut, shared_dir, table
from ..sources import adapters, formats
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def samples(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    c = F.col
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("doc_"), "doc_id").alias("sample_id"), c("lang").alias("language"), c("source").alias("source_dataset"),
        F.when(c("toxic") == 1, "synthetic").otherwise("real").alias("label"), F.concat(F.lit("spk_"), F.floor(c("doc_id") / 3)).alias("speaker_id"),
        "n_chars", "text", "quality", "toxic",
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    own = samples(spark, sf).where("toxic is not null")
    score = F.round(0.7 * hash_fraction(F.concat(F.lit("score:"), "doc_id")) + 0.3 * F.col("toxic"), 2)
    return own.select("doc_id", "language", F.col("source_dataset").alias("source"), F.col("toxic").cast("int").alias("y"), score.alias("score"))


# --- shared SQL -----------------------------------------------------------------------------
FRACTION = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
SAMPLES = """samples AS (SELECT d.doc_id, 'doc_' || d.doc_id AS sample_id, d.lang AS language, d.source AS source_dataset, CASE WHEN l.toxic = 1 THEN 'synthetic' ELSE 'real' END AS label,
 'spk_' || (d.doc_id // 3) AS speaker_id, d.n_chars, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""
SCORED = f"{SAMPLES}, scored AS (SELECT doc_id, language, source_dataset AS source, toxic AS y, round(0.7 * {FRACTION.format("'score:' || doc_id")} + 0.3 * toxic, 2) AS score FROM samples WHERE toxic IS NOT NULL)"
POINTS = """by_score AS (SELECT kind, key, score, sum(y) AS p, sum(1 - y) AS n FROM sliced GROUP BY ALL),
 pts AS (SELECT *, sum(p) OVER s AS pos, sum(n) OVER s AS neg, count(*) OVER s AS u, min(score) OVER s AS lo, max(score) OVER s AS hi, sum(p) OVER d AS tp, sum(n) OVER d AS fp FROM by_score
  WINDOW s AS (PARTITION BY kind, key), d AS (PARTITION BY kind, key ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 roc AS (SELECT *, tp::DOUBLE / nullif(pos, 0) AS tpr, fp::DOUBLE / nullif(neg, 0) AS fpr FROM pts),
 roc2 AS (SELECT *, lag(tpr, 1, 0) OVER w AS tpr0, lag(fpr, 1, 0) OVER w AS fpr0 FROM roc WINDOW w AS (PARTITION BY kind, key ORDER BY score DESC))"""
METRICS = f"""{POINTS},
 agg AS (SELECT kind, key, first(pos) AS pos, first(neg) AS neg, first(u) AS u, first(lo) AS lo, first(hi) AS hi, sum((fpr - fpr0) * (tpr + tpr0) / 2) AS auc,
  arg_max(CASE WHEN fpr + tpr - 1 = 0 THEN fpr ELSE fpr0 + (fpr - fpr0) * (1 - fpr0 - tpr0) / nullif(fpr + tpr - fpr0 - tpr0, 0) END, score) FILTER (fpr + tpr - 1 >= 0) AS eer,
  arg_max(CASE WHEN tpr = tpr0 THEN fpr ELSE fpr0 + (fpr - fpr0) * (0.95 - tpr0) / (tpr - tpr0) END, score) FILTER (tpr >= 0.95) AS f95 FROM roc2 GROUP BY kind, key),
 st AS (SELECT *, CASE WHEN pos = 0 OR neg = 0 THEN 'undefined_single_class' WHEN u = 1 THEN 'degenerate_constant_scores' ELSE 'ok' END AS status FROM agg)
SELECT kind, key, (pos + neg)::BIGINT AS n, status, CASE WHEN status = 'ok' THEN round(auc, 6) END AS roc_auc, CASE WHEN status = 'ok' THEN round(eer, 6) END AS eer,
 CASE WHEN status = 'ok' THEN round(f95, 6) END AS fpr_at_tpr95, CASE WHEN pos > 0 AND neg > 0 THEN u END AS unique_scores, CASE WHEN pos > 0 AND neg > 0 THEN lo END AS score_min, CASE WHEN pos > 0 AND neg > 0 THEN hi END AS score_max FROM st"""


def sliced(*columns: str) -> str:
    parts = ["SELECT 'overall' AS kind, 'all' AS key, y, score FROM scored", *(f"SELECT '{c}', coalesce({c}, 'unknown'), y, score FROM scored" for c in columns)]
    return f"{SCORED}, sliced AS ({' UNION ALL '.join(parts)})"


# --- detection metrics ----------------------------------------------------------------------
@query(f"WITH {sliced()}, {METRICS}")
def detection_metrics_overall(spark, sf):
    return metrics.detection_metrics(metrics.slices(scored(spark, sf)))


@query(f"WITH {sliced('language')}, {METRICS}")
def detection_metrics_by_language(spark, sf):
    return metrics.detection_metrics(metrics.slices(scored(spark, sf), "language"))


@query(f"WITH {sliced('source')}, {METRICS}")
def detection_metrics_by_source(spark, sf):
    return metrics.detection_metrics(metrics.slices(scored(spark, sf), "source"))


@query(
    f"""WITH {sliced('language')}, {POINTS}, gaps AS (SELECT *, abs(fpr - (1 - tpr)) AS gap FROM roc WHERE pos > 0 AND neg > 0 AND u > 1)
SELECT kind, key, score AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM gaps QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY gap, score DESC) = 1"""
)
def eer_threshold(spark, sf):
    return metrics.eer_threshold(metrics.slices(scored(spark, sf), "language"))


@query(
    f"""WITH {sliced('language')} SELECT kind, key, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 0 AND score >= 0.5) AS fp,
 count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 1 AND score >= 0.5) AS tp FROM sliced GROUP BY kind, key"""
)
def confusion_at_threshold(spark, sf):
    return metrics.confusion(metrics.slices(scored(spark, sf), "language"), 0.5)


@query(f"WITH {SCORED}, keys AS (SELECT DISTINCT source AS key FROM scored WHERE y = 1), sliced AS (SELECT 'source' AS kind, k.key, s.y, s.score FROM keys k JOIN scored s ON s.y = 0 OR s.source = k.key), {METRICS}")
def slices_with_all_real(spark, sf):
    return metrics.shared_negative_metrics(scored(spark, sf), "source")


@query(
    f"""WITH {SAMPLES}, scored AS (SELECT 'g' || (doc_id % 397) AS g, toxic AS y, 0.8 * {FRACTION.format("'exact:' || doc_id")} + 0.2 * toxic AS score FROM samples WHERE toxic IS NOT NULL),
 keys AS (SELECT DISTINCT g AS key FROM scored WHERE y = 1), sliced AS (SELECT 'generator' AS kind, k.key, s.y, s.score FROM keys k JOIN scored s ON s.y = 0 OR s.g = k.key), {METRICS}"""
)
def generators_with_all_real(spark, sf):
    """Hundreds of generators, each against every real row, by scores that are not rounded."""
    own = samples(spark, sf).where("toxic is not null")
    score = 0.8 * hash_fraction(F.concat(F.lit("exact:"), "doc_id")) + 0.2 * F.col("toxic")
    return metrics.shared_negative_metrics(own.select(F.concat(F.lit("g"), F.col("doc_id") % 397).alias("generator"), F.col("toxic").cast("int").alias("y"), score.alias("score")), "generator")


@query(
    """WITH p AS (SELECT doc_id FROM labels UNION ALL SELECT o_orderkey FROM orders), pc AS (SELECT doc_id, count(*) AS c FROM p GROUP BY 1)
SELECT coalesce(e.doc_id, pc.doc_id) AS doc_id, CASE WHEN pc.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'extra' ELSE 'duplicate' END AS problem
FROM documents e FULL JOIN pc ON e.doc_id = pc.doc_id WHERE pc.doc_id IS NULL OR e.doc_id IS NULL OR pc.c > 1"""
)
def prediction_coverage(spark, sf):
    """Every document is expected; labels and orders both predict for the ids they have."""
    named = table(spark, sf, "labels").select("doc_id").unionByName(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")))
    return metrics.coverage(table(spark, sf, "documents").select("doc_id"), named.withColumn("score", F.lit(0.5)), "doc_id")


# --- identity -------------------------------------------------------------------------------
NORMAL = "replace(lower(trim(regexp_replace(text, '[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))), 'ß', 'ss')"
IDENTITY = f"ids AS (SELECT doc_id, lang, source, {NORMAL} AS norm, 'text_' || lang || '_' || substr(sha256(lang || chr(0) || {NORMAL}), 1, 20) AS text_id FROM documents)"


def identities(spark, sf):
    norm = normalize_text("text")
    return table(spark, sf, "documents").select("doc_id", "lang", "source", norm.alias("norm")).withColumn("text_id", text_identity(F.col("lang"), F.col("norm")))


@query(f"WITH {IDENTITY} SELECT doc_id, text_id, sha256(norm) AS norm_sha256 FROM ids")
def text_identities(spark, sf):
    return identities(spark, sf).select("doc_id", "text_id", F.sha2("norm", 256).alias("norm_sha256"))


@query(f"WITH {IDENTITY} SELECT text_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids, count(*) AS n FROM ids GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    own = reports.duplicate_groups(identities(spark, sf), "text_id", "doc_id")
    return own.select("text_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n")


@query(f"WITH {IDENTITY} SELECT text_id, doc_id, min(doc_id) OVER w AS first, count(*) OVER w AS n FROM ids WINDOW w AS (PARTITION BY text_id) QUALIFY count(*) OVER w > 1")
def duplicate_members(spark, sf):
    """The same groups as a membership table."""
    return reports.duplicate_members(identities(spark, sf), "text_id", "doc_id")


@query(f"WITH {IDENTITY} SELECT text_id, doc_id, min(doc_id) OVER w AS first, count(*) OVER w AS n, (SELECT count(DISTINCT source) > 1 FROM ids j WHERE j.text_id = ids.text_id) AS conflict FROM ids WINDOW w AS (PARTITION BY text_id)")
def inventory_members(spark, sf):
    """The inventory's rows with the row that won their item."""
    rows = identities(spark, sf).select("text_id", "doc_id", F.col("source").alias("split"))
    return selection.first_wins(rows, "text_id", "doc_id").select("text_id", "doc_id", "first", F.col("rows").alias("n"), "conflict")


@query(
    f"""WITH {IDENTITY}, g AS (SELECT text_id, arg_min(norm, doc_id) AS norm, arg_min(lang, doc_id) AS language, arg_min(source, doc_id) AS split, string_agg('doc_' || doc_id, ',' ORDER BY doc_id) AS ids,
 count(DISTINCT source) > 1 AS conflict FROM ids GROUP BY 1) SELECT text_id, sha256(norm) AS norm_sha256, language, split, ids, conflict FROM g"""
)
def inventory_first_wins(spark, sf):
    rows = identities(spark, sf).select("text_id", F.col("norm").alias("normalized_text"), F.col("lang").alias("language"), F.col("source").alias("split"), F.concat(F.lit("doc_"), "doc_id").alias("sample_id"), "doc_id")
    return selection.inventory(rows, "doc_id").select("text_id", F.sha2("normalized_text", 256).alias("norm_sha256"), "language", "split", F.array_join("source_sample_ids", ",").alias("ids"), "conflict")


# --- groups and splits ----------------------------------------------------------------------
def grouped(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("sample_id"), F.concat(F.lit("speaker:"), F.floor(F.col("doc_id") / 3)).alias("s"), F.concat(F.lit("text:"), F.sha2("text", 256)).alias("t"))
    return graph.group_samples(docs, docs.select("sample_id", F.explode(F.array("s", "t")).alias("token")))


GROUPS = """RECURSIVE t AS (SELECT 'doc_' || doc_id AS sample_id, unnest(['s:' || (doc_id // 3), 't:' || sha256(text)]) AS token FROM documents),
 h AS (SELECT token, min(sample_id) AS hub FROM t GROUP BY 1), e AS (SELECT DISTINCT sample_id AS a, hub AS b FROM t JOIN h USING (token) UNION SELECT DISTINCT hub, sample_id FROM t JOIN h USING (token)),
 r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a), g AS (SELECT id AS sample_id, min(reach) AS component FROM r GROUP BY 1)"""


@query(f"WITH {GROUPS} SELECT component, count(*) AS n FROM g GROUP BY 1")
def component_sizes(spark, sf):
    return grouped(spark, sf).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


SPLITS = f"""{GROUPS}, k AS (SELECT component, {FRACTION.format("'42:' || string_agg(sample_id, '|' ORDER BY sample_id)")} AS f FROM g GROUP BY 1),
 s AS (SELECT g.sample_id, g.component, CASE WHEN k.f < 0.7 THEN 'train' WHEN k.f < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM g JOIN k USING (component))"""


def split_rows(spark, sf):
    return graph.assign_splits(grouped(spark, sf), seed=42, train=0.7, validation=0.15)


@query(f"WITH {SPLITS} SELECT * FROM s")
def assign_splits(spark, sf):
    return split_rows(spark, sf)


@query(f"WITH {SPLITS}, {SAMPLES} SELECT split, count(*) AS n, count(DISTINCT label) AS classes, count(*) FILTER (label = 'synthetic') AS synthetic FROM s JOIN samples USING (sample_id) GROUP BY 1")
def split_class_presence(spark, sf):
    own = split_rows(spark, sf).join(samples(spark, sf).select("sample_id", "label"), "sample_id")
    return own.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes"), F.count_if(F.col("label") == "synthetic").alias("synthetic"))


@query(
    f"""WITH {SPLITS}, {SAMPLES}, v AS (SELECT split, unnest([{{'c': 'speaker_id', 'v': speaker_id}}, {{'c': 'source_dataset', 'v': source_dataset}}, {{'c': 'text_sha256', 'v': sha256(text)}}]) AS x FROM s JOIN samples USING (sample_id)),
 p AS (SELECT x.c AS col, x.v, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM v GROUP BY ALL)
SELECT col, count(*) FILTER (a AND b) AS train_val, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS val_test FROM p GROUP BY 1"""
)
def leakage_audit(spark, sf):
    own = split_rows(spark, sf).join(samples(spark, sf).withColumn("text_sha256", F.sha2("text", 256)), "sample_id")
    return graph.overlap(own, ["speaker_id", "source_dataset", "text_sha256"])


@query(f"WITH {SPLITS}, {SAMPLES} SELECT split, label, round(quantile_cont(n_chars / 15.0, 0.5), 6) AS median FROM s JOIN samples USING (sample_id) GROUP BY ALL")
def duration_medians(spark, sf):
    own = split_rows(spark, sf).join(samples(spark, sf), "sample_id")
    found = quantiles(own.select(F.struct("split", "label").alias("key"), (F.col("n_chars") / 15.0).alias("seconds")), "key", "seconds", 0.5, "median")
    return found.select("key.*", F.round("median", 6).alias("median"))


@query("SELECT l_suppkey % 3 AS third, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def price_quantiles(spark, sf):
    """The 90th percentile of three large groups, each a third of the lines."""
    return quantiles(table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("third"), "l_extendedprice"), "third", "l_extendedprice", 0.9, "p90").withColumn("p90", F.round("p90", 6))


@query("SELECT DISTINCT conv_id * 1000 + turn AS id, conv_id * 1000 + min(turn) OVER (PARTITION BY conv_id) AS root, (turn - min(turn) OVER (PARTITION BY conv_id))::BIGINT AS depth, 'ok' AS status FROM conversations")
def lineage_closure(spark, sf):
    """Each turn's parent is the turn before."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))
    return graph.lineage(rows)


# --- selection ------------------------------------------------------------------------------
@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM documents) WHERE running <= 20000")
def duration_budget(spark, sf):
    return selection.budget(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "n_chars", "doc_id", 20000, by="source").select("source", "doc_id", "running")


@query(
    """WITH a AS (SELECT doc_id, source, n_chars, row_number() OVER w AS k, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
 b AS (SELECT doc_id, source, n_chars FROM a WHERE source IN ('src0', 'src1', 'src2', 'src3') AND k <= CASE WHEN source <> 'src3' THEN 30 ELSE k END AND s <= CASE WHEN source = 'src2' THEN s ELSE 60000 END),
 c AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT doc_id, source FROM c WHERE k <= 90 AND s <= 180000"""
)
def composed_budgets(spark, sf):
    """Rows and lengths limited for each source first, then for all of them."""
    limits = spark.createDataFrame([("src0", 30, 60000.0), ("src1", 30, 60000.0), ("src2", 30, None), ("src3", None, 60000.0)], "source string, max_rows long, max_amount double")
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return selection.composed(rows, "n_chars", "doc_id", "source", limits, 90, 180000).select("doc_id", "source")


@query("SELECT doc_id, running FROM (SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM documents) WHERE running <= 400000")
def global_budget(spark, sf):
    return selection.budget(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 400000).select("doc_id", "running")


@query("SELECT lang AS language, doc_id, rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INTEGER AS rn FROM documents WHERE lang IN ('en', 'de', 'fr') AND length(text) <= 2000) WHERE rn <= 25")
def topk_texts_per_language(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("lang", "language")
    return selection.top_k(selection.text_filter(docs, ["en", "de", "fr"], 2000), "language", "doc_id", 25).select("language", "doc_id", "rn")


@query("SELECT doc_id AS id, 'documents' AS origin FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src0', 'src1') UNION ALL SELECT page_id, 'pages' FROM pages WHERE url LIKE 'https://%'")
def source_filters_union(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("source_id"))
    own = selection.canonical_filter(docs, {"language": ["de", "fr"], "source_id": ["src0", "src1"]}).select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"))
    return own.unionByName(table(spark, sf, "pages").where(F.col("url").startswith("https://")).select(F.col("page_id").alias("id"), F.lit("pages").alias("origin")))


def flagged(spark, sf):
    """Synthetic rows with gates and flags by id; the quality label is a three-valued flag."""
    gate = F.element_at(F.array(*map(F.lit, ("pass", "warning", "fail"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return samples(spark, sf).withColumns({"quality_gate": gate, "training_eligible": F.col("quality") == 1, "diagnostic_only": F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("doc_id") % 5 == 0), "intended_role": F.when(F.col("doc_id") % 7 == 0, "validation").otherwise("train")})


FLAGGED = f"{SAMPLES}, f AS (SELECT *, ['pass', 'warning', 'fail'][doc_id % 3 + 1] AS gate, quality = 1 AS eligible, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 5 = 0 END AS diag, CASE WHEN doc_id % 7 = 0 THEN 'validation' ELSE 'train' END AS role FROM samples)"


@query(f"WITH {FLAGGED} SELECT doc_id FROM f WHERE label = 'synthetic' AND gate = 'pass' AND eligible IS TRUE AND diag IS FALSE AND role = 'train'")
def eligibility_compose(spark, sf):
    return flagged(spark, sf).where(selection.compose_eligible()).select("doc_id")


@query(f"WITH {FLAGGED} SELECT doc_id FROM f WHERE label = 'real' OR (eligible IS TRUE AND gate IN ('pass', 'warning') AND diag IS NOT TRUE)")
def eligibility_training(spark, sf):
    return flagged(spark, sf).where(selection.training_eligible()).select("doc_id")


ROLE = "['train', 'validation', 'unseen_test', 'external_challenge', NULL][doc_id % 5 + 1]"


@query(
    f"""WITH r AS (SELECT doc_id, {ROLE} AS role, ['train', 'val', 'test'][doc_id % 3 + 1] AS split FROM documents) SELECT split, role, count(*) AS n FROM r
WHERE role = 'external_challenge' OR (split = 'train' AND role <> 'train') OR (split = 'val' AND role NOT IN ('train', 'validation')) GROUP BY ALL"""
)
def role_violations(spark, sf):
    pick = lambda xs, m: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % m + 1).cast("int"))
    rows = table(spark, sf, "documents").select(pick(("train", "validation", "unseen_test", "external_challenge", None), 5).alias("role"), pick(("train", "val", "test"), 3).alias("split"))
    return rows.where(rules.role_problem(F.col("role"), F.col("split"))).groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {SAMPLES}, f AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'bad id' ELSE sample_id END AS sid, CASE WHEN label = 'synthetic' AND doc_id % 2 = 0 THEN 'g1' WHEN label = 'real' AND doc_id % 13 = 0 THEN 'g2' END AS gen,
 CASE WHEN doc_id % 17 = 0 THEN '/abs' ELSE 'rel' END AS path, CASE WHEN doc_id % 19 = 0 THEN 'TODO later' ELSE 'cc' END AS license FROM samples)
SELECT 'id_pattern' AS rule, sid AS key FROM f WHERE NOT regexp_full_match(sid, '[a-zA-Z0-9_-]+') UNION ALL SELECT 'V1', sid FROM f WHERE (label = 'synthetic' AND gen IS NULL) OR (label = 'real' AND gen IS NOT NULL)
UNION ALL SELECT 'V16', sid FROM f WHERE path LIKE '/%' UNION ALL SELECT 'V10', sid FROM f WHERE license LIKE 'TODO%'
UNION ALL SELECT 'V8', sid FROM f GROUP BY sid HAVING count(*) > 1"""
)
def rule_violations(spark, sf):
    i = F.col("doc_id")
    rows = samples(spark, sf).withColumns({
        "sample_id": F.when(i % 11 == 0, "bad id").otherwise(F.col("sample_id")),
        "generator_id": F.when((F.col("label") == "synthetic") & (i % 2 == 0), "g1").when((F.col("label") == "real") & (i % 13 == 0), "g2"),
        "path": F.when(i % 17 == 0, "/abs").otherwise("rel"), "license": F.when(i % 19 == 0, "TODO later").otherwise("cc"),
    })
    own = rules.row_rules(rows.columns, languages=("en", "de", "fr", "es"))
    return rules.violations(rows, own).unionByName(rules.duplicate_keys(rows))


# --- reports --------------------------------------------------------------------------------
@query(
    f"""WITH {SAMPLES}, v AS (SELECT unnest([{{'f': 'language', 'v': language}}, {{'f': 'label', 'v': label}}, {{'f': 'quality', 'v': quality::VARCHAR}}]) AS x FROM samples)
SELECT x.f AS field, coalesce(nullif(nullif(x.v, ''), '0'), 'unknown') AS value, count(*) AS n FROM v GROUP BY ALL"""
)
def dataset_report_distributions(spark, sf):
    return reports.distribution(samples(spark, sf), "language", "label", "quality")


@query("SELECT lang AS language, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def duration_by_language(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("language")).agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"), F.count_distinct("source").alias("sources"))


@query(
    f"""WITH {SAMPLES} SELECT 'quality' AS field, greatest(count(*) FILTER (doc_id % 6 = 0), count(*) FILTER (quality IS NULL)) AS n FROM samples
UNION ALL SELECT 'speaker_id', greatest(count(*) FILTER (doc_id % 9 = 0), count(*) FILTER (speaker_id IS NULL)) FROM samples"""
)
def missing_metadata(spark, sf):
    named = F.array_compact(F.array(F.when(F.col("doc_id") % 6 == 0, "quality"), F.when(F.col("doc_id") % 9 == 0, "speaker_id")))
    return reports.missing_metadata(samples(spark, sf).withColumn("missing_metadata", named), ["quality", "speaker_id"])


@query(
    """SELECT CASE WHEN GROUPING(event_type) = 0 THEN 'event_type' WHEN GROUPING(bucket) = 0 THEN 'bucket' ELSE 'user_group' END AS dimension,
 CASE WHEN GROUPING(event_type) = 0 THEN coalesce(event_type, 'default') WHEN GROUPING(bucket) = 0 THEN coalesce(bucket, 'default') ELSE coalesce(user_group, 'default') END AS value, count(*) AS n, sum(cents)::BIGINT AS amount
FROM (SELECT event_type, CASE WHEN value > 50 THEN 'high' END AS bucket, (user_id % 7)::VARCHAR AS user_group, floor(coalesce(value, 0))::BIGINT AS cents FROM events) GROUP BY GROUPING SETS ((event_type), (bucket), (user_group))"""
)
def dimension_counts(spark, sf):
    dims = {"event_type": F.col("event_type"), "bucket": F.when(F.col("value") > 50, "high"), "user_group": F.col("user_id") % 7}
    return reports.dimension_counts(table(spark, sf, "events"), dims, F.floor(F.coalesce("value", F.lit(0.0))).cast("long"))


@query("SELECT o_orderstatus AS status, count(*) FILTER (o_totalprice > 100000) AS large, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = 'none') AS none FROM orders GROUP BY 1")
def conditional_counts(spark, sf):
    c = F.col
    return table(spark, sf, "orders").groupBy(c("o_orderstatus").alias("status")).agg(F.count_if(c("o_totalprice") > 100000).alias("large"), F.count_if(c("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(c("o_orderpriority") == "none").alias("none"))


@query(
    """WITH g AS (SELECT * FROM (VALUES ('g1', 'train', 'en', 'v1'), ('g1', 'train', 'en', 'v2'), ('g2', 'unseen_test', 'de', NULL), ('g2', 'unseen_test', 'en', NULL), ('g3', 'validation', 'de', 'v3')) t(gid, role, lang, voice)),
 t AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END AS lang, ['train', 'val', 'test'][item_id % 3 + 1] AS split, 'text_' || substr(sha256(text), 1, 20) AS text_id FROM benchmark),
 j AS (SELECT gid AS generator_id, t.lang AS language, text_id, voice AS voice_id, '{"generator_id":"' || gid || '","language":"' || t.lang || '","text_id":"' || text_id || '","voice_id":' || coalesce('"' || voice || '"', 'null') || '}' AS payload
  FROM t JOIN g ON g.lang = t.lang WHERE role = 'train' OR (role = 'validation' AND split IN ('val', 'test')) OR (role = 'unseen_test' AND split = 'test'))
SELECT 'job_' || substr(sha256(payload), 1, 24) AS job_id, generator_id, language, text_id, voice_id, ('0x' || substr(sha256(payload), 1, 16))::UBIGINT::VARCHAR AS seed FROM j"""
)
def job_plan(spark, sf):
    texts = table(spark, sf, "benchmark").select(
        F.when(F.col("item_id") % 2 == 0, "en").otherwise("de").alias("language"), F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("item_id") % 3 + 1).cast("int")).alias("split"),
        F.concat(F.lit("text_"), F.substring(F.sha2("text", 256), 1, 20)).alias("text_id"),
    )
    generators = spark.createDataFrame([("g1", "train", ["en"], ["v1", "v2"]), ("g2", "unseen_test", ["de", "en"], None), ("g3", "validation", ["de"], ["v3"])], "generator_id string, role string, languages array<string>, voices array<string>")
    jobs = reports.job_plan(texts, generators, ["generator_id", "language", "text_id", "voice_id"], rules.role_accepts_split(F.col("role"), F.col("split")))
    return jobs.select("job_id", "generator_id", "language", "text_id", "voice_id", F.col("seed").cast("string").alias("seed"))


@query(
    """WITH r AS (SELECT l_orderkey AS k, max(l_linenumber) <= 4 AS valid FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(p.k, r.k) AS job, CASE WHEN p.k IS NULL THEN 'unplanned' WHEN valid IS NULL THEN 'run' WHEN valid THEN 'skip' ELSE 'error_invalid' END AS action FROM p FULL JOIN r ON p.k = r.k"""
)
def resume_actions(spark, sf):
    """Orders that aren't pending are planned; those with lines that weren't returned have an output."""
    plan = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("job"))
    outputs = table(spark, sf, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("job")).agg((F.max("l_linenumber") <= 4).alias("valid"))
    return reports.resume_actions(plan, outputs, "job", "skip")


GATES = "SELECT o_orderpriority AS p, CASE WHEN o_totalprice > 450000 AND o_orderpriority = '1-URGENT' THEN 'fail' WHEN o_totalprice < 2000 THEN 'warning' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'pass' END AS gate, o_totalprice > 1000 AS eligible, o_orderstatus = 'F' AS diagnostic, o_orderkey % 1000 = 1 AS candidate FROM orders"


@query(
    f"""SELECT p AS priority, CASE WHEN count(*) FILTER (gate = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (gate = 'pending') > 0 THEN 'pending' WHEN count(*) FILTER (gate = 'warning') > 0 THEN 'warning' ELSE 'passed' END AS gate,
 bool_and(eligible) AS all_eligible, bool_and(diagnostic) AS all_diagnostic, bool_or(candidate) AS any_candidate, count(*) AS n FROM ({GATES}) GROUP BY 1"""
)
def quality_gate(spark, sf):
    c = F.col
    gate = F.when((c("o_totalprice") > 450000) & (c("o_orderpriority") == "1-URGENT"), "fail").when(c("o_totalprice") < 2000, "warning").when(c("o_orderstatus") == "P", "pending").otherwise("pass")
    rows = table(spark, sf, "orders").select(c("o_orderpriority").alias("priority"), gate.alias("gate"), (c("o_totalprice") > 1000).alias("eligible"), (c("o_orderstatus") == "F").alias("diagnostic"), (c("o_orderkey") % 1000 == 1).alias("candidate"))
    return reports.quality_gate(rows, "priority")


EPOCHS = "SELECT (year(l_shipdate) * 12 + month(l_shipdate))::INTEGER AS epoch, round(count(*) FILTER (l_returnflag = 'N') / count(*)::DOUBLE, 6) AS auc, round(count(*) FILTER (l_linestatus = 'O') / count(*)::DOUBLE, 6) AS loss FROM lineitem GROUP BY 1"


@query(
    f"""WITH e AS ({EPOCHS}), b AS (SELECT *, coalesce(auc > max(auc) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM e),
 s AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS since FROM b),
 x AS (SELECT *, coalesce(bool_or(since >= 12) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM s) SELECT epoch, auc, loss FROM x WHERE NOT stopped ORDER BY auc DESC, loss, epoch LIMIT 1"""
)
def best_epoch(spark, sf):
    c = F.col
    rows = table(spark, sf, "lineitem").groupBy((F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("epoch"))
    n = F.count(F.lit(1))
    return reports.best_epoch(rows.agg(F.round(F.count_if(c("l_returnflag") == "N") / n, 6).alias("auc"), F.round(F.count_if(c("l_linestatus") == "O") / n, 6).alias("loss")), 12)


# --- answers --------------------------------------------------------------------------------
def answers(spark, sf):
    """User turns with the next turn as the answer, for two runs; expectations and citations follow from ids."""
    c = F.col
    turns = table(spark, sf, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    cases = turns.where("role = 'user' AND answer IS NOT NULL").withColumn("run_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    i = c("conv_id") + c("turn")
    cite = lambda *xs: F.array(*(F.struct(F.lit("d").alias("document_id"), x.cast("string").alias("section")) for x in xs))
    return cases.select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), "run_id", (5 + i % 7 + F.when(c("run_id") == "b", 3).otherwise(0)).cast("double").alias("latency_ms"),
        F.when((c("run_id") == "b") & (i % 4 == 0), "").otherwise(c("answer")).alias("answer"), F.substring("answer", 3, 9).alias("expected_answer"),
        cite(i % 3, i % 5).alias("expected"), F.when(c("run_id") == "a", cite(i % 3)).otherwise(cite(i % 5, i % 2 + 9)).alias("given"), F.array(F.lit("THE "), F.lit("zzz")).alias("forbidden_claims"),
        F.when(i % 6 == 0, "version_awareness").otherwise("other").alias("category"), F.when(i % 2 == 0, "en").otherwise("de").alias("question_language"), F.array(F.lit("en")).alias("document_languages"),
    )


ANSWERS = """turns AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ans FROM conversations),
 cases AS (SELECT *, conv_id + turn AS i, unnest(['a', 'b']) AS run_id FROM turns WHERE role = 'user' AND ans IS NOT NULL),
 c2 AS (SELECT conv_id || '-' || turn AS case_id, run_id, i, (5 + i % 7 + CASE WHEN run_id = 'b' THEN 3 ELSE 0 END)::DOUBLE AS latency_ms, CASE WHEN run_id = 'b' AND i % 4 = 0 THEN '' ELSE ans END AS answer, substr(ans, 3, 9) AS want,
  list_distinct([i % 3, i % 5]) AS e, list_distinct(CASE WHEN run_id = 'a' THEN [i % 3] ELSE [i % 5, i % 2 + 9] END) AS g FROM cases),
 c3 AS (SELECT *, contains(trim(regexp_replace(replace(lower(answer), 'ё', 'е'), '\\s+', ' ', 'g')), trim(regexp_replace(replace(lower(want), 'ё', 'е'), '\\s+', ' ', 'g')))::INT::DOUBLE AS ok, len(list_intersect(e, g))::DOUBLE AS hit FROM c2),
 sc AS (SELECT case_id, run_id, latency_ms, ok AS answer_correctness, hit / len(g) AS citation_precision, hit / len(e) AS citation_completeness,
  (contains(lower(answer), 'the ') OR contains(lower(answer), 'zzz') OR len(list_filter(g, lambda x: NOT list_contains(e, x))) > 0)::INT::DOUBLE AS hallucination_rate,
  CASE WHEN i % 6 = 0 THEN hit / len(e) END AS version_awareness, CASE WHEN i % 2 <> 0 THEN ok END AS cross_language_score FROM c3)"""


@query(f"WITH {ANSWERS} SELECT case_id, run_id, latency_ms, answer_correctness, round(citation_precision, 6) AS citation_precision, round(citation_completeness, 6) AS citation_completeness, hallucination_rate, round(version_awareness, 6) AS version_awareness, cross_language_score FROM sc")
def rag_case_scores(spark, sf):
    own = rag.score_cases(answers(spark, sf))
    return own.withColumns({c: F.round(c, 6) for c in ("citation_precision", "citation_completeness", "version_awareness")})


@query(
    f"""WITH {ANSWERS}, m AS (SELECT run_id, unnest([{', '.join(f"{{'m': '{m}', 'v': round(avg({m}), 4)}}" for m in rag.METRICS)}, {{'m': 'latency_mean_ms', 'v': round(avg(latency_ms), 2)}}]) AS x FROM sc GROUP BY 1)
SELECT run_id, x.m AS metric, round(x.v, 4) AS value FROM m WHERE x.v IS NOT NULL UNION ALL SELECT run_id, 'latency_p50_ms', list_sort(list(latency_ms))[(count(*) - 1) // 2 + 1] FROM sc GROUP BY 1
UNION ALL SELECT run_id, 'latency_p95_ms', list_sort(list(latency_ms))[least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1] FROM sc GROUP BY 1"""
)
def rag_aggregate(spark, sf):
    return rag.aggregate(rag.score_cases(answers(spark, sf))).withColumn("value", F.round("value", 4))


@query(f"WITH {ANSWERS} SELECT a.case_id, a.answer_correctness AS first, b.answer_correctness AS second FROM sc a JOIN sc b USING (case_id) WHERE a.run_id = 'a' AND b.run_id = 'b' AND a.answer_correctness <> b.answer_correctness")
def rag_compare(spark, sf):
    return rag.compare(rag.score_cases(answers(spark, sf)), "a", "b")


@query("SELECT event_type AS key, count(value) AS n, list_sort(list(value))[(count(value) - 1) // 2 + 1] AS p50, list_sort(list(value))[least(count(value) - 1, floor(count(value) * 0.95)::BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_percentiles(spark, sf):
    return rag.latency_percentiles(table(spark, sf, "events").select(F.col("event_type").alias("key"), "value"))


# --- arrays and files -----------------------------------------------------------------------
@query("SELECT vec_id, round(list_sum([x::DOUBLE for x in embedding[(len(embedding) - 8) // 2 + 1:(len(embedding) - 8) // 2 + 8]]), 4) AS cropped, len(embedding) AS size FROM embeddings")
def crop_pad_vectors(spark, sf):
    own = crop_pad(F.col("embedding"), 8)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), 4).alias("cropped"), F.size("embedding").cast("long").alias("size"))


@query("SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 9) AS mean, round(list_aggregate(embedding::DOUBLE[], 'stddev_samp'), 9) AS std FROM embeddings")
def pooled_vectors(spark, sf):
    """Mean and sample deviation of each vector's components."""
    m = mean_std(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(m.mean, 9).alias("mean"), F.round(m.std, 9).alias("std"))


@query("SELECT label, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def pooled_labels(spark, sf):
    """The same over all vectors of a label, from one triple a vector."""
    own = pooled(table(spark, sf, "embeddings"), "label", "embedding")
    return own.withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@query("SELECT page_id, sha256(html) AS digest, strlen(html) AS bytes FROM pages")
def page_digests(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))


@query("SELECT md5(string_agg(item_id::VARCHAR || ':' || sha256(text), chr(10) ORDER BY item_id)) AS digest, count(*) AS n FROM benchmark")
def multi_digest(spark, sf):
    """One digest over names and digests of contents, in order of the items."""
    rows = table(spark, sf, "benchmark").select("item_id", F.concat_ws(":", "item_id", F.sha2("text", 256)).alias("line"))
    digest = digests(rows, [], [F.col("item_id")], F.col("line"), b"\n", "digest", algorithm="md5")
    return digest.withColumn("n", F.lit(rows.count()))


@query(
    """WITH files AS (SELECT coalesce(source, 'none') || '.jsonl' AS name, doc_id, text FROM documents), parts AS (SELECT name, string_agg(text, chr(10) ORDER BY doc_id) AS content FROM files GROUP BY 1)
SELECT sha256(string_agg(name || content, '' ORDER BY name)) AS dataset_hash, (SELECT count(*) FROM parts) AS files FROM parts"""
)
def dataset_hash(spark, sf):
    """The documents as one file for each source: a digest over names and contents, in order of the names."""
    docs = table(spark, sf, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit(".jsonl")).alias("name"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return reports.dataset_hash(docs, "name", ["doc_id"], F.col("text"), "\n")


@query("SELECT source, sha256(string_agg(doc_id || ':' || coalesce(text, ''), chr(10) ORDER BY doc_id)) AS digest, count(*) AS n FROM documents GROUP BY 1")
def source_digests(spark, sf):
    """A digest over all documents of each source, in order of their ids."""
    docs = table(spark, sf, "documents").select("source", "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))).alias("line"))
    own = digests(docs, ["source"], [F.col("doc_id")], F.col("line"), b"\n", "digest")
    n = docs.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(n, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


# --- gates, protocols and generation --------------------------------------------------------
@query(
    f"""WITH {SCORED}, sliced AS (SELECT 'protocol' AS kind, unnest(CASE WHEN y = 0 THEN ['overall', 'test_seen', 'test_unseen'] WHEN source IN ('src1', 'src2') THEN ['overall', 'test_unseen'] ELSE ['overall', 'test_seen'] END) AS key, y, score FROM scored), {METRICS}"""
)
def protocol_slices(spark, sf):
    return metrics.protocol_slices(scored(spark, sf), "source", ["src1", "src2"])


@query(f"WITH {SAMPLES} SELECT language, count(*) FILTER (label = 'real') AS real, count(*) FILTER (label = 'synthetic') AS synthetic, count(*) FILTER (label = 'real') / nullif(count(*) FILTER (label = 'synthetic'), 0) AS weight FROM samples GROUP BY 1")
def class_weight(spark, sf):
    return gates.class_weight(samples(spark, sf), "language")


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / nullif(sum(CASE WHEN l_discount IS NOT NULL THEN l_quantity END), 0), 6) AS mean FROM lineitem GROUP BY 1")
def batch_weighted_mean(spark, sf):
    return gates.weighted_mean(table(spark, sf, "lineitem"), "l_discount", "l_quantity", "l_suppkey").withColumn("mean", F.round("mean", 6))


@query(
    """SELECT event_type, count(*) AS n, count(*) FILTER (value > 10) AS succeeded, min(value) AS min_ms, round(avg(value), 6) AS mean_ms, max(value) AS max_ms,
 array_to_string(list_sort(list(DISTINCT 'm' || user_id % 5)), ',') AS models, array_to_string(list_sort(list(DISTINCT 'd' || user_id % 7)), ',') AS digests FROM events GROUP BY 1"""
)
def call_summary(spark, sf):
    calls = table(spark, sf, "events").select("event_type", F.col("value").alias("latency_ms"), (F.col("value") > 10).alias("ok"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model_id"), F.concat(F.lit("d"), F.col("user_id") % 7).alias("model_sha256"))
    return gates.call_summary(calls, "event_type").withColumns({"mean_ms": F.round("mean_ms", 6), "models": F.array_join("models", ","), "digests": F.array_join("digests", ",")})


@query(f"WITH {FLAGGED}, g AS (SELECT count(*) FILTER (label = 'synthetic' AND gate = 'pass' AND source_dataset IN ('src0', 'src1')) AS synthetic, count(*) FILTER (label = 'real' AND gate = 'pass') AS real FROM f) SELECT *, synthetic >= 50 AND real >= 50 AS ready FROM g")
def protected_gate(spark, sf):
    return gates.protected_gate(flagged(spark, sf).withColumn("generator_id", F.col("source_dataset")), ["src0", "src1"])


@query("SELECT p_brand AS brand, p_type AS type, p_partkey AS id, rank() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC NULLS LAST)::INTEGER AS rank FROM part")
def comparable_ranks(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_partkey").alias("id"), "p_retailprice")
    return gates.comparable_ranks(rows, "p_retailprice", ("brand", "type")).drop("p_retailprice")


@query("SELECT o_orderkey AS job, o_orderstatus AS state FROM orders WHERE o_orderkey <= coalesce((SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 300000), 9223372036854775807)")
def failure_prefix(spark, sf):
    status = F.when(F.col("o_totalprice") > 300000, "failed").otherwise("completed")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("state"), status.alias("status"))
    return gates.until_failure(rows, "job", "stop").select("job", "state")


@query(
    """WITH j AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT coalesce(j.k, r.k) AS customer, CASE WHEN r.k IS NULL THEN 'unreviewed' ELSE 'unknown_job' END AS problem FROM j FULL JOIN r ON j.k = r.k WHERE j.k IS NULL OR r.k IS NULL"""
)
def uncovered_reviews(spark, sf):
    jobs, reviews = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer")), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("customer"))
    return gates.uncovered_reviews(jobs, reviews, "customer")


@query("SELECT count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'training' ELSE o_orderpriority END) AS partitions, count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'training' ELSE o_orderpriority END) = 1 AS single FROM orders")
def role_partitions(spark, sf):
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "train").when(F.col("o_orderpriority") == "2-HIGH", "validation").otherwise(F.col("o_orderpriority"))
    return gates.same_partition(table(spark, sf, "orders").select(role.alias("intended_role")))


@query(
    """SELECT doc_id, 'pages_' || substr(sha256('pages' || chr(0) || doc_id), 1, 20) AS sample_id, CASE lang WHEN 'en' THEN 'other' WHEN 'de' THEN 'kk_ru' ELSE lang END AS language,
 CASE WHEN doc_id % 4 = 0 THEN 'unknown_pages_' || substr(sha256('pages' || chr(0) || doc_id), 1, 20) ELSE 's' || doc_id // 3 END AS speaker_id, CASE WHEN doc_id % 4 = 0 THEN 'speaker_id' ELSE '' END AS missing_metadata,
 CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END AS bad FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')"""
)
def source_projection(spark, sf):
    """Documents as a source of its own columns and languages, every fourth without a speaker."""
    c = F.col
    rows = table(spark, sf, "documents").select("source", c("doc_id").cast("string").alias("utterance"), F.concat(F.lit("a/"), "doc_id", F.lit(".wav")).alias("file"), c("lang").alias("raw"), F.when(c("doc_id") % 4 != 0, F.concat(F.lit("s"), F.floor(c("doc_id") / 3))).alias("who"))
    own = adapters.canonical(rows, "pages", columns={"path": "file", "speaker_id": "who", "source_id": "utterance", "language": "raw"}, filters={"source": ["src0", "src1", "src2", "src3"]}, languages={"en": "other", "de": "kk_ru"})
    return own.select(F.regexp_extract("path", "(\\d+)", 1).cast("long").alias("doc_id"), "sample_id", "language", "speaker_id", F.array_join("missing_metadata", ",").alias("missing_metadata"), "bad")


@query("SELECT doc_id, (('0x' || substr(sha256('doc_' || doc_id || chr(0) || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE lang END || chr(0) || doc_id * 7), 1, 4))::INTEGER % 440 + 220)::INTEGER AS frequency_hz FROM documents")
def tone_frequencies(spark, sf):
    voice = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", tone_frequency(F.concat(F.lit("doc_"), "doc_id"), voice, F.col("doc_id") * 7).alias("frequency_hz"))


@query(
    """SELECT 'synth_' || o_orderkey AS sample_id, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END, 'g' || o_orderstatus || '_default') AS speaker_id,
 CASE WHEN o_orderstatus = 'O' THEN 'r1' ELSE 'v1' END AS generator_version, CASE WHEN o_orderstatus = 'F' THEN 'http://m' ELSE 'generator config' END AS rights_reference,
 (CASE WHEN n % 2 = 0 THEN n + 100 ELSE o_custkey END)::VARCHAR AS seed, CASE WHEN n % 2 = 0 THEN '{"effective_seed":"' || n + 100 || '","generation_attempt":"' || n || '","k":"1"}' ELSE '{"k":"1"}' END AS generation_params
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE n <> 7"""
)
def made_samples(spark, sf):
    """Orders as jobs, their lines as results (seven of them count as a failure), customers as texts."""
    c = F.col
    jobs = table(spark, sf, "orders").select(
        c("o_orderkey").cast("string").alias("job_id"), F.concat(F.lit("g"), "o_orderstatus").alias("generator_id"), c("o_custkey").cast("string").alias("text_id"), F.lit("en").alias("language"),
        F.when(c("o_orderpriority") == "1-URGENT", c("o_orderpriority")).alias("voice_id"), F.lit(None).cast("string").alias("speaker_name"), c("o_custkey").alias("seed"), F.lit("x.wav").alias("output_path"),
        F.create_map(F.lit("k"), F.lit("1")).alias("generation_params"), F.lit("train").alias("intended_role"),
    )
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("attempt"))
    results = n.select(
        c("l_orderkey").cast("string").alias("job_id"), F.when(c("attempt") == 7, "failed").otherwise("completed").alias("status"), F.lit("00").alias("output_sha256"), F.lit("wav").alias("codec"),
        F.lit(8000).alias("sample_rate"), F.lit(1.0).alias("duration_sec"), F.when(c("attempt") % 2 == 0, c("attempt") + 100).alias("effective_seed"), "attempt",
    )
    texts = table(spark, sf, "customer").select(c("c_custkey").cast("string").alias("text_id"), c("c_name").alias("text"), F.lower("c_name").alias("normalized_text"), F.lit("customers").alias("source_dataset"), F.lit("train").alias("split"))
    names = "generator_id string, license string, license_url string, model_url string, homepage_url string, family string, model_revision string, model_version string, quality_gate string, training_eligible boolean, diagnostic_only boolean, candidate boolean"
    rows = [(f"g{s}", None, None, "http://m" if s == "F" else None, None, "f", "r1" if s == "O" else None, "v1", "pass", True, False, False) for s in "FOP"]
    own = generation.made_samples(jobs, results, texts, spark.createDataFrame(rows, names))
    return own.select("sample_id", "speaker_id", "generator_version", "rights_reference", c("generation_seed").cast("string").alias("seed"), "generation_params")


# --- role partitions, limits, totals, runs -----------------------------------------------------
@query(
    f"""WITH {FLAGGED}, g AS (SELECT *, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE role END AS r, 'gen' || doc_id % 3 AS gen, CASE WHEN doc_id % 7 = 3 AND doc_id % 2 = 0 THEN NULL ELSE 'f' END AS family FROM f)
SELECT DISTINCT gen AS generator_id, coalesce(r, 'missing_role') AS role FROM g WHERE label = 'synthetic' AND (r IS NOT NULL OR family IS NOT NULL) AND coalesce(r NOT IN ('unseen_test'), true)"""
)
def partition_violations(spark, sf):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = flagged(spark, sf).withColumns({
        "intended_role": F.when(i % 7 == 3, none).otherwise(F.col("intended_role")), "generator_id": F.concat(F.lit("gen"), i % 3),
        "generator_family": F.when((i % 7 == 3) & (i % 2 == 0), none).otherwise("f"), "source_text_id": none,
    })
    return rules.partition_violations(rows, "protected_test")


@query(f"WITH {SPLITS} SELECT sample_id, component FROM s WHERE split = 'val'")
def split_export(spark, sf):
    """The rows of one exported split."""
    return split_rows(spark, sf).where("split = 'val'").select("sample_id", "component")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 40 ORDER BY doc_id LIMIT 120")
def limits_per_source(spark, sf):
    return selection.limits(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 40, 120)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50")
def longest_texts(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", F.struct((-F.col("n_chars")).alias("n"), "doc_id").alias("rank"))
    return selection.first_sorted(rows, "rank", 50).select("doc_id", "n_chars")


@query(f"WITH {SAMPLES} SELECT count(DISTINCT speaker_id) AS speakers FROM samples WHERE doc_id % 9 <> 0")
def known_speakers(spark, sf):
    named = F.array_compact(F.array(F.when(F.col("doc_id") % 9 == 0, "speaker_id"), F.when(F.col("doc_id") % 2 == 0, "codec")))
    return reports.known_speakers(samples(spark, sf).withColumn("missing_metadata", named))


STATUS = "['completed', 'skipped', 'failed'][o_orderkey % 3 + 1]"


@query(
    f"""WITH j AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN {STATUS} END AS status, o_orderkey % 4 <> 1 AS valid FROM orders)
SELECT count(*) AS planned, count(*) FILTER (status = 'completed' AND valid) AS completed, count(*) FILTER (status = 'skipped' AND valid) AS skipped,
 count(*) FILTER (status = 'failed' OR (status IN ('completed', 'skipped') AND NOT valid)) AS failed, count(DISTINCT o_custkey) FILTER (status IN ('completed', 'skipped') AND valid) AS texts FROM j"""
)
def generation_totals(spark, sf):
    orders = table(spark, sf, "orders")
    i = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("completed", "skipped", "failed"))), (i % 3 + 1).cast("int"))
    results = orders.where(i % 5 > 0).select(i.alias("job_id"), status.alias("status"), (i % 4 != 1).alias("valid"))
    return reports.generation_totals(orders.select(i.alias("job_id"), F.col("o_custkey").alias("text_id")), results)


@query(
    """WITH r AS (SELECT 'g' || o_custkey % 7 AS generator_id, ['passed', 'warning', 'pending', 'fail'][CASE WHEN o_custkey % 7 < 3 THEN 0 ELSE o_orderkey % (o_custkey % 7 - 1) END + 1] AS gate, o_orderkey % 11 <> 0 OR o_custkey % 7 = 2 AS eligible FROM orders WHERE o_orderkey % 2 = 0)
SELECT generator_id, CASE WHEN bool_or(gate = 'fail') THEN 'fail' WHEN bool_or(gate = 'pending') THEN 'pending' WHEN bool_or(gate = 'warning') THEN 'warning' ELSE 'passed' END AS gate, bool_and(eligible) AS all_eligible, count(*) AS n FROM r GROUP BY 1"""
)
def gates_by_generator(spark, sf):
    """Reviews of every other order; the orders are the jobs, their customers' remainders the generators."""
    o, g, k = table(spark, sf, "orders"), F.col("o_custkey") % 7, F.col("o_orderkey")
    jobs = o.select(k.alias("job_id"), F.concat(F.lit("g"), g).alias("generator_id"))
    gate = F.try_element_at(F.array(*map(F.lit, ("passed", "warning", "pending", "fail"))), F.when(g < 3, 1).otherwise(k % F.greatest(g - 1, F.lit(1)) + 1).cast("int"))
    reviews = o.where(k % 2 == 0).select(F.concat(F.lit("synth_"), k).alias("sample_id"), gate.alias("gate"), ((k % 11 != 0) | (g == 2)).alias("eligible"), F.lit(False).alias("diagnostic"), F.lit(False).alias("candidate"))
    return reports.gates_by_generator(reviews, jobs).select("generator_id", "gate", "all_eligible", "n")


@query(f"WITH {SAMPLES}, scored AS (SELECT language, source_dataset AS source, toxic AS y, 0.7 * {FRACTION.format(chr(39) + 'score:' + chr(39) + ' || doc_id')} + 0.3 * toxic AS score FROM samples WHERE toxic IS NOT NULL), sliced AS (SELECT 'overall' AS kind, 'all' AS key, y, score FROM scored UNION ALL SELECT 'source', source, y, score FROM scored), {METRICS}")
def detection_metrics_unrounded(spark, sf):
    """Nearly every row has a score of its own."""
    own = samples(spark, sf).where("toxic is not null")
    score = 0.7 * hash_fraction(F.concat(F.lit("score:"), "doc_id")) + 0.3 * F.col("toxic")
    return metrics.detection_metrics(metrics.slices(own.select(F.col("source_dataset").alias("source"), F.col("toxic").cast("int").alias("y"), score.alias("score")), "source"))


ODD_SCORE = "CASE WHEN doc_id % 10 = 0 THEN 'NaN'::DOUBLE WHEN doc_id % 10 = 1 THEN 'inf'::DOUBLE WHEN doc_id % 10 = 2 THEN NULL ELSE 0.5 END"


def odd_scores(i):
    return F.when(i % 10 == 0, float("nan")).when(i % 10 == 1, float("inf")).when(i % 10 == 2, F.lit(None).cast("double")).otherwise(0.5)


@query(f"WITH s AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 2 ELSE doc_id % 2 END AS y, {ODD_SCORE} AS score FROM documents) SELECT 'overall' AS kind, 'all' AS key, CASE WHEN y = 2 THEN 'label' ELSE 'score' END AS problem, count(*) AS n FROM s WHERE y = 2 OR score IS NULL OR NOT isfinite(score) GROUP BY 3")
def score_problems(spark, sf):
    i = F.col("doc_id")
    return metrics.score_problems(metrics.slices(table(spark, sf, "documents").select(F.when(i % 13 == 0, 2).otherwise(i % 2).alias("y"), odd_scores(i).alias("score"))))


@query(f"SELECT doc_id, CASE WHEN doc_id % 10 IN (0, 1, 2) THEN 'not_finite' END AS problem FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def coverage_of_odd_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return metrics.coverage(docs, docs.withColumn("score", odd_scores(F.col("doc_id"))), "doc_id")


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, conv_id * 1000 + CASE WHEN conv_id % 3 = 0 AND turn = 0 THEN 999 WHEN conv_id % 3 = 1 AND turn = 0 THEN max(turn) OVER (PARTITION BY conv_id) ELSE turn - 1 END AS p FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT id, CASE WHEN conv_id % 3 = 0 THEN 'orphan' WHEN conv_id % 3 = 1 THEN 'cycle' ELSE 'ok' END AS status FROM t"""
)
def lineage_problems(spark, sf):
    """Chains without a first parent, chains closed to cycles, and good ones."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    c, t = F.col("conv_id"), F.col("turn")
    parent = F.when(t > 0, c * 1000 + t - 1).when(c % 3 == 0, c * 1000 + 999).when(c % 3 == 1, c * 1000 + F.col("last"))
    return graph.lineage(turns.join(last, "conv_id").select((c * 1000 + t).alias("id"), parent.alias("parent"))).select("id", "status")


RESUME = """WITH p AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(p.id, o.id) AS id, CASE WHEN p.id IS NULL THEN 'unplanned' WHEN o.id IS NULL THEN 'run' ELSE '{0}' END AS action FROM p FULL JOIN o ON p.id = o.id"""


def resumed(spark, sf, policy):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return reports.resume_actions(ids.where("id % 2 = 0"), ids.where("id % 3 = 0").withColumn("valid", F.col("id") % 5 > 0), "id", policy)


@query(RESUME.format("error_exists"))
def resume_fail(spark, sf):
    return resumed(spark, sf, "fail")


@query(RESUME.format("redo"))
def resume_regenerate(spark, sf):
    return resumed(spark, sf, "regenerate")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0")
def extract_new(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return selection.extract_new(docs, docs.where("doc_id % 4 = 0"), "doc_id")


@query("SELECT o_orderkey AS id, CASE WHEN d + f < n THEN 'incomplete' WHEN f > 0 THEN 'complete_with_failures' ELSE 'complete' END AS status FROM (SELECT o_orderkey, o_orderkey % 4 + 1 AS n, o_orderkey % 3 AS f, o_orderkey % 5 AS d FROM orders)")
def run_statuses(spark, sf):
    i = F.col("o_orderkey")
    return table(spark, sf, "orders").select(i.alias("id"), reports.run_status(i % 4 + 1, i % 3, i % 5).alias("status"))


@query("SELECT page_id, url LIKE 'https://%' AS public FROM pages UNION ALL SELECT * FROM (VALUES (-1, false), (-2, false), (-3, true), (-4, false), (-5, true), (-6, false), (-7, false), (-8, true))")
def public_endpoints(spark, sf):
    """The pages' hosts are public names; the added ones are addresses and local names."""
    odd = ["https://203.0.113.5/", "https://198.18.0.1", "https://10.example.com/", "https://[::ffff:10.0.0.1]/", "https://8.8.8.8/x", "https://localhost", "http://8.8.8.8", "https://[2606:4700::1111]:8443/a"]
    extra = spark.createDataFrame([(-k - 1, u) for k, u in enumerate(odd)], "page_id long, url string")
    rows = table(spark, sf, "pages").select("page_id", "url").unionByName(extra)
    return rows.select("page_id", public_endpoint(F.col("url")).alias("public"))


@query(
    f"""WITH {SPLITS}, p AS (SELECT component, CASE WHEN count(*) FILTER (doc % 50 = 0) > 0 THEN 'unset' WHEN count(DISTINCT CASE WHEN doc % 50 = 0 THEN NULL WHEN doc % 20 = 1 THEN 'test' ELSE split END) > 1 THEN 'several_splits'
  WHEN bool_or(doc % 31 = 0 AND coalesce(CASE WHEN doc % 50 = 0 THEN NULL WHEN doc % 20 = 1 THEN 'test' ELSE split END, '') <> 'test') THEN 'holdout_outside_test' END AS problem FROM (SELECT *, substr(sample_id, 5)::BIGINT AS doc FROM s) GROUP BY 1) SELECT * FROM p WHERE problem IS NOT NULL"""
)
def split_problems(spark, sf):
    """Given splits with some unset, some moved to test, and rows held out."""
    doc = F.substring("sample_id", 5, 20).cast("long")
    rows = cut(split_rows(spark, sf)).withColumn("split", F.when(doc % 50 == 0, None).when(doc % 20 == 1, "test").otherwise(F.col("split")))
    return graph.split_problems(rows, doc % 31 == 0)


# --- workers ---------------------------------------------------------------------------------
@query(
    """WITH t AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ans FROM conversations),
 c AS (SELECT conv_id || '-' || turn AS case_id, ans, (conv_id + turn) % 5 = 0 AS wrong, (conv_id + turn) % 7 = 0 AS moved, unnest(['mock-a', 'mock-b']) AS target FROM t WHERE role = 'user' AND ans IS NOT NULL)
SELECT target || '/' || case_id AS id, CASE WHEN target = 'mock-b' AND wrong THEN 'В документе достаточно оснований, поэтому ответ можно подтвердить.' ELSE ans END AS answer,
 CASE WHEN target = 'mock-b' AND wrong THEN 'policy-v1 1.1' WHEN target = 'mock-b' AND moved THEN 'policy-v1 9.9' ELSE case_id || ' 1' END AS cited,
 CASE WHEN target = 'mock-a' THEN 5 WHEN wrong THEN 9 ELSE 8 END AS latency_ms, NULL::VARCHAR AS error FROM c"""
)
def mock_targets(spark, sf):
    """Each user turn as a case with the next turn as the answer, put to both demonstration targets."""
    c = F.col
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    cases = table(spark, sf, "conversations").withColumn("expected_answer", after).where("role = 'user' and expected_answer is not null")
    cases = cases.select(F.concat_ws("-", "conv_id", "turn").alias("case_id"), (c("conv_id") + c("turn")).alias("i"), "expected_answer")
    # the chosen cases carry the fixture's names of theirs, the others their own
    named = F.when(c("i") % 5 == 0, "VE-003").when(c("i") % 7 == 0, "VE-005").otherwise(c("case_id"))
    cited = F.array(F.struct(c("case_id").alias("document_id"), F.lit("1").alias("section")))
    outputs = "answer string, citations array<struct<document_id: string, section: string>>, latency_ms int"
    parts = []
    for target in ("mock-a", "mock-b"):
        rows = cases.select(F.concat(F.lit(f"{target}/"), "case_id").alias("id"), named.alias("case_id"), "expected_answer", cited.alias("expected_citations"))
        parts.append(workers.apply_worker(rows, lambda t=target: workers.MockTarget(t), "id", outputs))
    return parts[0].unionByName(parts[1]).select("id", "answer", F.concat_ws(" ", c("citations")[0]["document_id"], c("citations")[0]["section"]).alias("cited"), "latency_ms", "error")


@query(
    f"""WITH o AS (SELECT o_orderkey AS job, o_custkey * 1000003 AS seed, 60 + o_orderkey % 240 AS max_tokens FROM orders),
 t AS (SELECT job, seed, max_tokens, unnest([0, 1, 2]) AS k FROM o), d AS (SELECT *, floor({FRACTION.format("(seed + k * 7919)::VARCHAR")} * 3000) / 100 AS seconds FROM t),
 first AS (SELECT job, max_tokens, min(k) FILTER (seconds < max_tokens / 12.0 * 0.9) AS k, string_agg(printf('%.2fs', seconds), ', ' ORDER BY k) AS every FROM d GROUP BY job, max_tokens)
SELECT f.job, (d.seed + f.k * 7919)::VARCHAR AS effective_seed, f.k + 1 AS attempt, d.seconds AS duration_sec, CASE WHEN f.k IS NULL THEN 'RuntimeError: every attempt ran away (' || every || '; max_tokens=' || f.max_tokens || ')' END AS error
FROM first f LEFT JOIN d ON d.job = f.job AND d.k = f.k"""
)
def runaway_retries(spark, sf):
    """Orders as synthesis jobs of a generator whose duration is a hash of its seed: up to three attempts each."""
    c = F.col
    jobs = table(spark, sf, "orders").select(c("o_orderkey").alias("job"), (c("o_custkey") * 1000003).alias("seed"), (60 + c("o_orderkey") % 240).cast("int").alias("max_tokens"))
    own = workers.apply_worker(jobs, lambda: workers.Retrying(workers.HashedDurations(), 3, 7919), "job", "effective_seed string, attempt int, duration_sec double")
    return own.select("job", "effective_seed", "attempt", "duration_sec", "error")


# --- files and streams of their own ----------------------------------------------------------
@query()
def job_state_stream(spark, sf):
    """Each conversation as a run, its turns as jobs that start a minute apart; a seventh of them fails, and what starts after the first failure is stopped."""
    c = F.col
    source = table(spark, sf, "conversations")
    # a pattern, as a stream's path that is none must be a folder
    rows = spark.readStream.schema(source.schema).parquet(f"{sf}/conversations.parque[t]").where("conv_id is not null and turn is not null")
    at = F.timestamp_seconds(1_704_067_200 + c("turn") * 60)  # after the epoch, where a watermark begins
    failed = F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 7 == 0
    none = F.lit(None).cast("string")
    event = lambda when, kind, seed, error: F.struct(when.alias("at"), kind.alias("kind"), seed.alias("seed"), error.alias("error"))
    seed = (c("conv_id") * 100 + c("turn")).cast("string")
    told = F.array(event(at, F.lit("start"), seed, none), event(at + F.expr("INTERVAL 30 SECONDS"), F.when(failed, "failed").otherwise("done"), none, F.when(failed, "checksum")))
    events = rows.select(c("conv_id").cast("string").alias("run_id"), c("turn").cast("string").alias("job_id"), F.inline(told).alias("at", "kind", "seed", "error"))
    return jobs.changes_now(events, shared_dir(spark), policy="stop", attempts=1, timeout=0).select("run_id", "job_id", "attempt", "status", "seed", "error")


@query()
def exported_line_numbers(spark, sf):
    """The documents exported as lines in order of their ids, over several files, and numbered again from the files alone."""
    folder = shared_dir(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("\t", "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n\t]", " ")).alias("value"))
    docs.orderBy("doc_id").select("value").write.text(folder)
    rows = formats.numbered_lines(spark, folder, 1 << 20)
    return rows.select(F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), "ordinal")


# --- small operators on whole tables -----------------------------------------------------------
@query(
    """WITH RECURSIVE m AS (SELECT 'doc_' || d.doc_id AS sample_id, coalesce(l.toxic, 0) = 0 AS is_real, d.* FROM documents d LEFT JOIN labels l USING (doc_id)),
 t AS (SELECT sample_id, unnest(list_filter([CASE WHEN is_real THEN 'speaker:spk_' || doc_id // 4 END, 'source:' || source || '_' || doc_id // 2, 'sample:' || sample_id, CASE WHEN doc_id % 10 = 5 THEN 'sample:doc_' || (doc_id - 5) END,
   'hash:' || sha256(coalesce(text, '')), CASE WHEN doc_id % 9 = 2 THEN 'text:' || doc_id % 90 END, CASE WHEN is_real AND doc_id % 8 = 1 THEN 'speaker:spk_' || (doc_id // 4 + 1) END], lambda x: x IS NOT NULL)) AS token FROM m),
 h AS (SELECT token, min(sample_id) AS hub FROM t GROUP BY 1), e AS (SELECT DISTINCT sample_id AS a, hub AS b FROM t JOIN h USING (token) UNION SELECT DISTINCT hub, sample_id FROM t JOIN h USING (token)),
 r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT m.sample_id, coalesce(min(reach), m.sample_id) AS component FROM m LEFT JOIN r ON r.id = m.sample_id GROUP BY m.sample_id"""
)
def sample_components(spark, sf):
    """Groups by all kinds of tokens: speakers of real rows and related ones, sources, parents, digests and texts."""
    c = F.col
    i = c("doc_id")
    own = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").select(
        F.concat(F.lit("doc_"), i).alias("sample_id"), F.when(F.coalesce("toxic", F.lit(0)) == 0, "real").otherwise("synthetic").alias("label"), F.concat(F.lit("spk_"), F.floor(i / 4)).alias("speaker_id"),
        F.when(i % 8 == 1, F.array(F.concat(F.lit("spk_"), F.floor(i / 4) + 1))).alias("related_speaker_ids"), F.concat("source", F.lit("_"), F.floor(i / 2)).alias("source_id"),
        F.when(i % 10 == 5, F.concat(F.lit("doc_"), i - 5)).alias("parent_sample_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"),
        F.lit(None).cast("string").alias("source_text_id"), F.when(i % 9 == 2, (i % 90).cast("string")).alias("text_id"),
    )
    return graph.group_samples(own)


@query("SELECT doc_id, doc_id % 6 IN (0, 4) AS contained FROM documents")
def contained_paths(spark, sf):
    """Paths that stay below their root, and some that do not."""
    shapes = F.array(*map(F.lit, ("a/{}.wav", "../{}.wav", "a/../../{}.wav", "/a/{}.wav", "a/./../{}.wav", "C:\\{}.wav")))
    path = F.replace(F.get(shapes, (F.col("doc_id") % 6).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", contained_path(path).alias("contained"))


@query(
    """SELECT o_orderkey AS job, least(4096, greatest(64, ceil(length(o_orderpriority) * o_shippriority_like) + 32))::INTEGER AS max_tokens, ((o_custkey::HUGEINT * 1000000007 + (o_orderkey % 3)::HUGEINT * 9223372036854775783) % 18446744073709551616)::VARCHAR AS seed
FROM (SELECT *, 0.5 * (o_orderkey % 40) AS o_shippriority_like FROM orders)"""
)
def token_caps_and_seeds(spark, sf):
    """Token limits by length, and seeds of later attempts, modulo 2^64."""
    c = F.col
    chars = F.length("o_orderpriority") * (0.5 * (c("o_orderkey") % 40))
    seed = retry_seed(c("o_custkey").cast("decimal(20,0)") * 1000000007, c("o_orderkey") % 3, 9223372036854775783)
    return table(spark, sf, "orders").select(c("o_orderkey").alias("job"), token_cap(chars, 1.0, 32, 64, 4096).alias("max_tokens"), seed.cast("string").alias("seed"))


@query(
    """SELECT vec_id, round(1 / (1 + exp(-4 * embedding[1]::DOUBLE)), 9) AS probability, printf('%.10f', 1 / (1 + exp(-4 * embedding[1]::DOUBLE))) AS written,
 CASE WHEN 1 / (1 + exp(-4 * embedding[1]::DOUBLE)) >= 0.5 THEN 'synthetic' ELSE 'real' END AS decision FROM embeddings"""
)
def written_decisions(spark, sf):
    """Scores from logits, as they are written with their decisions."""
    c = F.col
    rows = table(spark, sf, "embeddings").select(c("vec_id").alias("sample_id"), sigmoid(4 * F.get("embedding", F.lit(0)).cast("double")).alias("synthetic_score"))
    probability = F.round(c("synthetic_score") * 1e9) / 1e9  # scaled, as SQL rounds: F.round(x, 9) goes by the shortest decimal
    written = adapters.decisions(rows, 0.5, probability.alias("probability"))
    return written.select(c("sample_id").alias("vec_id"), "probability", c("synthetic_score").alias("written"), "decision")


@query(
    """SELECT 'V15' AS rule, CAST(k AS VARCHAR) AS key FROM (SELECT DISTINCT l_suppkey % 130 AS k FROM lineitem) WHERE k NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'V8', 'line_' || l_orderkey || '_' || l_linenumber // 2 FROM lineitem GROUP BY l_orderkey, l_linenumber // 2 HAVING count(*) > 1"""
)
def snapshot_violations(spark, sf):
    """Suppliers as models and lines as samples: repeated ids, and samples of unknown models."""
    c = F.col
    models = table(spark, sf, "supplier").select(c("s_suppkey").alias("model_id"))
    lines = table(spark, sf, "lineitem").select((c("l_suppkey") % 130).alias("model_id"), F.concat_ws("_", F.lit("line"), "l_orderkey", F.floor(c("l_linenumber") / 2)).alias("sample_id"))
    return adapters.snapshot_problems(models, lines)


@query(
    """WITH r AS (SELECT 'a' || c_custkey AS sample_id, c_mktsegment AS language FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
 s AS (SELECT 'b' || c_custkey AS sample_id, c_mktsegment AS language FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 3 = 0 AND c_custkey % 4 <> 0 AND c_custkey % 5 <> 0)
SELECT sample_id, 'audio/' || sample_id || '.wav' AS path, NULL::VARCHAR AS split, language FROM r UNION ALL SELECT sample_id, 'audio/' || sample_id || '.wav', NULL, language FROM s"""
)
def composed_corpus(spark, sf):
    """Customers as real rows, and again as synthetic ones of which some are eligible."""
    c = F.col
    i = c("c_custkey")
    base = table(spark, sf, "customer").select(i, c("c_mktsegment").alias("language"), F.concat(F.lit("raw/"), i, F.lit(".wav")).alias("path"), F.lit("train").alias("split"))
    real = base.select(F.concat(F.lit("a"), i).alias("sample_id"), F.lit("real").alias("label"), "language", "path", "split")
    made = base.select(
        F.concat(F.lit("b"), i).alias("sample_id"), F.lit("synthetic").alias("label"), "language", "path", "split", F.when(i % 3 == 0, "pass").when(i % 3 == 1, "fail").alias("quality_gate"),
        F.when(i % 4 != 0, True).alias("training_eligible"), (i % 5 == 0).alias("diagnostic_only"), F.lit("train").alias("intended_role"),
    )
    return selection.compose(real, made, ["BUILDING", "MACHINERY"]).select("sample_id", "path", "split", "language")
