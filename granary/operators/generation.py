"""Voices and parameters of generators, and manifests of what they made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Generators (configuration, a few KB each) up to which they are broadcast.
FEW = 1000


def voice_options(generators: DataFrame) -> DataFrame:
    """One row per voice: the generator's fixed voice, else the entry's voices, else its own, else null.

    ``entry_voices`` that the generator doesn't have are listed in ``unknown``; ``params`` are the
    generator's with the entry's put over them. Generators are configuration, a few rows by nature.
    """
    c = F.col
    chosen = F.coalesce("entry_voices", "voices")
    options = F.when(c("voice_id").isNotNull(), F.array("voice_id")).when(F.size(chosen) > 0, chosen).otherwise(F.array(F.lit(None).cast("string")))
    unknown = F.array_sort(F.array_except(F.coalesce(chosen, F.array().cast("array<string>")), F.coalesce("voices", F.array().cast("array<string>"))))
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("params", empty), lambda k, _: ~F.map_contains_key(F.coalesce("entry_params", empty), k))
    return generators.select("generator_id", F.explode(options).alias("voice_id"), unknown.alias("unknown"), F.map_concat(kept, F.coalesce("entry_params", empty)).alias("params"))


def made_samples(jobs: DataFrame, results: DataFrame, texts: DataFrame, generators: DataFrame) -> DataFrame:
    """Manifest rows of completed or skipped jobs that left an output.

    Fallbacks: revision, then version; speaker, then voice, then ``<generator>_default``; the chain
    of links for rights; the seed that took effect, then the planned one. ``generators`` are broadcast when a count finds
    at most ``FEW`` of them, so a generator that made a third of all rows is no hot key.
    """
    c = F.col
    if generators.limit(FEW + 1).count() <= FEW:
        generators = F.broadcast(generators)
    done = results.where("status in ('completed', 'skipped') and output_sha256 is not null").select("job_id", "output_sha256", "codec", "sample_rate", "duration_sec", "effective_seed", "attempt")
    own = texts.select("text_id", c("text").alias("transcript"), "normalized_text", "source_dataset", "split")
    rows = jobs.join(done, "job_id").join(own, "text_id").join(generators, "generator_id")
    retry = F.when(c("effective_seed").isNotNull(), F.map_from_arrays(F.array(F.lit("effective_seed"), F.lit("generation_attempt")), F.array(c("effective_seed").cast("string"), c("attempt").cast("string"))))
    empty = F.create_map().cast("map<string,string>")
    params = F.coalesce("generation_params", empty)
    retry = F.coalesce(retry, empty)
    merged = F.map_concat(F.map_filter(params, lambda k, _: ~F.map_contains_key(retry, k)), retry)
    in_order = F.map_from_entries(F.array_sort(F.map_entries(merged)))
    return rows.select(
        F.concat(F.lit("synth_"), "job_id").alias("sample_id"), c("output_path").alias("path"), F.lit("synthetic").alias("label"), "language",
        F.coalesce("speaker_name", "voice_id", F.concat("generator_id", F.lit("_default"))).alias("speaker_id"), "source_dataset", c("job_id").alias("source_id"), "generator_id",
        F.coalesce("license", F.lit("unverified; explicit acknowledgement recorded")).alias("license"), c("output_path").alias("original_path"),
        F.coalesce("license_url", "model_url", "homepage_url", F.lit("generator config")).alias("rights_reference"), F.lit("approved").alias("usage_permission"),
        F.coalesce("codec", F.lit("unknown")).alias("codec"), "split", c("output_sha256").alias("source_sha256"), c("output_sha256").alias("processed_sha256"), "sample_rate", "duration_sec",
        "transcript", "normalized_text", "text_id", c("text_id").alias("source_text_id"), c("family").alias("generator_family"),
        F.coalesce("model_revision", "model_version").alias("generator_version"), "voice_id", F.coalesce("effective_seed", "seed").cast("decimal(20,0)").alias("generation_seed"),
        F.to_json(in_order).alias("generation_params"), "intended_role", "quality_gate", "training_eligible", "diagnostic_only", "candidate",
    )
