"""Empty tables, nulls, repeated rows and clashing columns through every operator, and the two queries that have SQL."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, decontaminate, licenses, near_dedup, pseudonyms, quality, queries, secrets, token_counts, toxicity, warc

VOCABULARY = "word_bpe_49k.json"
LONG = "plain words that say nothing much at all, over and over, " * 3000


def odd(spark):
    """Null and empty texts, white space, a long text, an id that comes twice with the same row, a null id, and columns by the names that operators use within."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "a token=abcdef123456 b"), (5, "a token=abcdef123456 b"), (None, "call +44 20 7946 0958"), (7, "MIT License")]
    names = "doc_id long, text string, n int, row string, node int, spans int, label int, size int, y int, f int, at int, file string, key int"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6, 7, 8, "y", 9) for r in rows], names)


def benchmark(spark):
    return spark.createDataFrame([(1, "what is the capital of the country that lies to the north of here"), (2, None), (3, "")], "item_id long, text string")


def model(spark):
    docs = spark.createDataFrame([(i, "kind gentle words here" if i % 4 else "vile awful words here") for i in range(200)], "doc_id long, text string")
    return toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")), toxicity.Settings(z=2.0))


def edits():
    return F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("new ").alias("text")))


OPERATORS = {
    "bpe": lambda spark, d: bpe.encode_documents(d, public_tokenizers.path(VOCABULARY), with_ids=False),
    "toxicity": lambda spark, d: toxicity.score(d, model(spark)),
    "secrets": lambda spark, d: secrets.secret_report(d),
    "secret_spans": lambda spark, d: secrets.find_secrets(d),
    "quality": lambda spark, d: quality.quality(d, spark.createDataFrame([(4,), (None,), (4,)], "doc_id long")),
    "pseudonyms": lambda spark, d: pseudonyms.pseudonymise(d, b"k"),
    "decontaminate": lambda spark, d: decontaminate.contaminated(d, benchmark(spark)),
    "near_dedup": lambda spark, d: near_dedup.near_duplicates(d),
    "token_counts": lambda spark, d: token_counts.count_with_edits(d.withColumn("edits", edits()), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
}
EVERY_ROW = set(OPERATORS) - {"secret_spans", "decontaminate"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_tables(spark, name):
    make = OPERATORS[name]
    docs = odd(spark)
    rows = make(spark, docs).collect()
    ids = sorted((r["doc_id"] for r in rows), key=str)
    if name in EVERY_ROW:
        assert ids == sorted([1, 2, 3, 4, 5, 5, None, 7], key=str)
    twice = [tuple(r) for r in rows if r["doc_id"] == 5]
    assert not twice or len(twice) == 2 and twice[0] == twice[1]  # repeated rows have one result each
    none = make(spark, docs.limit(0))
    assert none.count() == 0 and none.columns == make(spark, docs).columns


def test_licences_of_odd_and_empty_tables(spark):
    found = licenses.find_licenses(odd(spark))
    assert {r["doc_id"] for r in found.collect()} <= {1, 2, 3, 4, 5, 7, None} and licenses.find_licenses(odd(spark).limit(0)).count() == 0


def test_defined_results(spark):
    docs = odd(spark)
    report = {r["doc_id"]: r for r in secrets.secret_report(docs).collect()}
    assert (report[1]["n_assign"], report[1]["spans"]) == (0, "") and report[5]["n_assign"] == 1
    tokens = {r["doc_id"]: r["n_tokens"] for r in OPERATORS["bpe"](spark, docs).collect()}
    assert tokens[1] == tokens[2] == tokens[3] == 0
    names = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(docs, b"k").collect()}
    assert names[1] is None and names[2] == "" and names[None].startswith("call +44 ") and names[None] != "call +44 20 7946 0958"
    figures = {r["doc_id"]: r for r in OPERATORS["quality"](spark, docs).collect()}
    assert (figures[1]["n_words"], figures[1]["base_failed"], figures[1]["kept"]) == (0, True, False)


def test_filtering_stages_keep_columns_and_repeats(spark):
    docs = odd(spark)
    for stage in (lambda d: toxicity.drop_toxic(d, model(spark)), lambda d: decontaminate.drop_contaminated(d, benchmark(spark)), secrets.redact):
        kept = stage(docs)
        assert kept.columns == docs.columns and kept.count() == 8
        assert stage(docs.limit(0)).count() == 0
    assert secrets.redact(docs).where("doc_id = 5").first()["text"] == "a [SECRET] b"


def test_pages_of_odd_and_empty_tables(spark):
    rows = [(1, "https://a.b/c", "<p>Hello</p>"), (1, "https://a.b/c", "<p>Hello</p>"), (2, None, None), (None, "", ""), (4, "https://a.b/d", "<p>" + LONG + "</p>")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, key int, id string")
    found = warc.derivatives(warc.responses(pages))
    counts = {r["key"]: r["count"] for r in found.groupBy("key").count().collect()}
    assert set(counts) == {1, 2, None, 4} and counts[1] == 2 * counts[4]
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
