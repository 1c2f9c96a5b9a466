"""Queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import Settings, fold, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id", Settings().folds) == 0).alias("held_out"), "score", "predicted")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", F.lower(F.hex("label")).alias("class_key"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    return derivatives(responses(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), b"corpus pseudonyms, key 1")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import find_licenses

    return find_licenses(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits per document, at places given by its id: an insertion, a replacement and a deletion."""
    import public_tokenizers

    from .token_counts import count_with_edits

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    at = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(size, F.lit(1))).cast("int") for k in range(3)]
    edits = [(at[0], at[0], " (added words)"), (at[1], at[1] + 12, "changed"), (at[2], at[2] + 20, "")]
    docs = docs.withColumn("edits", F.array(*(F.struct(s.alias("start"), e.alias("end"), F.lit(t).alias("text")) for s, e, t in edits)))
    return count_with_edits(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of the sales that arrived before 20 March 2024, overwritten by what arrived later; the files stay below the shared folder."""
    from ..session import Scratch, shared_dir
    from .late_overwrite import DAY_MICROS, Names, days_later, late_overwrite, micros, source_rows

    sales = table(spark, sf_dir, "sales")
    ntz = {c: t == "timestamp_ntz" for c, t in sales.dtypes}
    h = lambda sale_id: F.crc32(sale_id.cast("string").cast("binary"))
    day = F.floor(micros(F.col("sold_at"), ntz["sold_at"]) / DAY_MICROS)
    copies = F.when((h(F.col("sale_id")) % 3 == 0) & (day % 4 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    changed = {
        "total": lambda get: get("total") + 1,
        "sold_at": lambda get: days_later(get("sold_at"), (h(get("sale_id")) % 2).cast("int"), ntz["sold_at"]),
        "arrived_at": lambda get: days_later(get("arrived_at"), (1 + h(get("sale_id")) % 97).cast("int"), ntz["arrived_at"]),
    }
    late = F.col("arrived") >= 1_710_892_800_000_000  # 2024-03-20 00:00 UTC
    with Scratch(spark) as scratch:
        job = late_overwrite(source_rows(sales, copies, changed), Names("sale_id", "sold_at", "arrived_at"), 1 + sales.count() // 1100, late, shared_dir(spark), scratch)
        row = F.col("row")
        text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        times = [text(micros(row[c], ntz[c])) for c in ("sold_at", "arrived_at")]
        return job.report(
            cents=F.sum(F.coalesce(F.floor(row.total * 100 + 0.5), F.lit(0)).cast("long")),
            rows_crc=F.sum(F.crc32(F.concat_ws(":", text(row.sale_id), *times).cast("binary"))),
        ).select("day", "file_no", "n_rows", "cents", "rows_crc", "path", "columns", "ids_sha256", "rewritten")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of each fiftieth vector with all others."""
    from ..session import Scratch
    from .top_k import top_k

    with Scratch(spark) as scratch:
        return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5, scratch)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the contract's checksum and repaired."""
    from ..session import Scratch
    from .conversations import damaged, repair_report

    rows = table(spark, sf_dir, "conversations")
    with Scratch(spark) as scratch:
        return repair_report(damaged(rows), rows, scratch)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_warc, op2_bpe, op3_toxicity, op4_secrets, op5_quality, op6_pii, op7_decontaminate, op8_licenses, op9_near_dedup, op10_token_counts, op11_late_overwrite, op12_topk, op13_conversations, pipeline)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
#: The others can't be expressed in DuckDB's SQL (hashes, automata, trained models, merges, files); tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op12_topk": """
        WITH usable AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored) WHERE rank <= 5
    """,
    # the checksum bit by bit: a byte is xored in, then eight shifts (-1); the search keeps the repaired turns beside the audit
    "op13_conversations": """
        WITH RECURSIVE plain AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
        ), summed AS (
            SELECT *, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(name, '')])),
                lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 20 AS kind
            FROM plain
        ), hurt AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END)
            FROM summed WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended FROM hurt
        ), judged AS (
            SELECT *, left(role, 1) AS first, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
                CASE WHEN ended = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
            FROM placed
        ), counted AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || first NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id
        ), follows(source, letter, target) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
        ), filled AS (
            SELECT source, source AS goal, 0 AS cost, '' AS letters, []::VARCHAR[] AS said FROM (SELECT DISTINCT source FROM follows)
            UNION ALL SELECT source, target, 3, 'I', [CASE WHEN letter = 'u' THEN 'user:' ELSE 'assistant:' END] FROM follows WHERE letter <> 's'
        ), steps AS (
            SELECT conv_id, pos, f.source, f.goal AS target, f.cost + 4 AS cost, f.letters || 'D' AS letters, f.said FROM judged, filled f
            UNION ALL SELECT conv_id, pos, f.source, m.target, f.cost + CASE WHEN fault = 't' THEN 3 ELSE 0 END, f.letters || 'K', list_append(f.said, role || ':' || text)
            FROM judged JOIN follows m ON m.letter = first JOIN filled f ON f.goal = m.source WHERE fault NOT IN ('b', 'd')
            UNION ALL SELECT conv_id, pos, f.source, m.target, f.cost + 3 + CASE WHEN fault = 't' THEN 3 ELSE 0 END, f.letters || 'R', list_append(f.said, CASE WHEN m.letter = 'u' THEN 'user:' ELSE 'assistant:' END || text)
            FROM judged JOIN follows m ON m.letter <> 's' JOIN filled f ON f.goal = m.source WHERE fault NOT IN ('b', 'd')
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS pos, '' AS state, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS best FROM counted
            UNION ALL
            SELECT w.conv_id, s.pos, s.target, min({'cost': (w.best.cost + s.cost)::BIGINT, 'audit': w.best.audit || s.letters, 'said': list_concat(w.best.said, s.said)})
            FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1 AND s.source = w.state GROUP BY w.conv_id, s.pos, s.target
        ), whole AS (
            SELECT w.conv_id, min({'cost': w.best.cost + f.cost, 'audit': w.best.audit || f.letters, 'said': list_concat(w.best.said, f.said)}) AS best
            FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos JOIN filled f ON f.source = w.state WHERE f.goal IN ('', 'a') GROUP BY w.conv_id
        )
        SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM i.conv_id
    """,
}
