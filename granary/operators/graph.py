"""Leakage-safe grouping: shared-token edges, components, hash splits, lineage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import digest_fraction
from ..session import Scratch, cut, ship
from .runs import digests
from .skew import join_groups, lookup, with_groups


#: Links that are joined to stars in one task: bounded, whatever the input.
IN_ONE_TASK = 100_000


def _contract(edges: DataFrame, n: int) -> DataFrame:
    """Stars instead of the links of each of n / ``IN_ONE_TASK`` parts: the same components with fewer links."""
    names, schema = edges.columns, edges.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for x, y in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        found = [(x, find(x)) for x in list(root)]
        found = [(x, y) for x, y in found if x != y]
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found[at : at + 10_000]), to_arrow_schema(schema), strict=True)], names=names)

    ship(edges.sparkSession)
    parts = -(-n // IN_ONE_TASK)
    # all links of a greater node are in one part, or in neighbouring ones if there are many
    return (edges.coalesce(1) if parts == 1 else edges.repartitionByRange(parts, *names)).mapInArrow(run, schema)


def _peel(edges: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``node, up``: the greater nodes with one link that are nobody's lesser one, which take their lesser node's label later; and the other links."""
    lesser = edges.select(F.col("b").alias("a"), F.lit(True).alias("inner")).distinct()
    groups = edges.groupBy("a").agg(F.count(F.lit(1)).alias("size"), F.min("b").alias("up"))
    groups = scratch.cut(groups.join(lesser.hint("merge"), "a", "left").withColumn("leaf", (F.col("size") == 1) & F.col("inner").isNull()).drop("inner"))
    rest = join_groups(edges, groups.where("not leaf").drop("up"), "a", n).select("a", "b")
    return groups.where("leaf").select(F.col("a").alias("node"), "up"), scratch.cut(rest)


def _star(edges: DataFrame, large: bool, n: int, scratch: Scratch) -> DataFrame:
    """Links neighbours (all greater ones, or all smaller ones and the node) with the least node around.

    Only minima are grouped and joined back: no group of neighbours is ever gathered, and nodes with many are broadcast.
    """
    turned = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        turned = turned.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = scratch.cut(turned.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size")).select("u", F.least("u", "m").alias("m"), "size"))
    joined = join_groups(turned, least, "u", 2 * n if large else n)
    out = joined.where("v > u") if large else joined
    out = out.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (the least node of its component) for each node of ``links`` (a, b); other nodes stand alone.

    Links are joined to stars within parts of a bounded size first. What crosses parts is settled by large and small
    stars in turn, whose rounds grow with the logarithm of the diameter; before each round, nodes that hang on one link
    are set aside, and links that fit into one task are settled there. What was set aside takes its labels in the end, last ones first.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
        n = edges.count()
        if n:
            edges = scratch.cut(_contract(edges, n))
        aside = []
        while True:
            leaves, rest = _peel(edges, edges.count(), scratch)
            aside.append(leaves)
            scratch.drop(edges)
            n = rest.count()
            if not n:
                break
            if n <= IN_ONE_TASK:
                edges = scratch.cut(_contract(rest, n))
            else:
                large = scratch.cut(_star(rest, True, n, scratch))
                edges = scratch.cut(_star(large, False, large.count(), scratch))
                scratch.drop(large)
            scratch.drop(rest)
        found = aside.pop().select("node", F.col("up").alias("label"))
        while aside:
            leaves = aside.pop()
            own = lookup(leaves, found.withColumnRenamed("node", "up"), "up", leaves.count())
            found = scratch.cut(found.unionByName(own.select("node", F.coalesce("label", "up").alias("label"))))
        return scratch.keep(found.unionByName(found.select(F.col("label").alias("node"), "label").distinct()))


def sample_tokens(samples: DataFrame) -> DataFrame:
    """``sample_id, token``: what makes rows belong together. Speakers bind real rows only."""
    real = F.col("label") == "real"
    tokens = F.concat(
        F.array(
            F.when(real, F.concat(F.lit("speaker:"), "speaker_id")), F.concat(F.lit("source:"), "source_id"), F.concat(F.lit("sample:"), "sample_id"),
            F.concat(F.lit("sample:"), "parent_sample_id"), F.concat(F.lit("hash:"), "source_sha256"), F.concat(F.lit("text:"), F.coalesce("source_text_id", "text_id")),
        ),
        F.when(real, F.transform(F.coalesce("related_speaker_ids", F.array().cast("array<string>")), lambda s: F.concat(F.lit("speaker:"), s))).otherwise(F.array().cast("array<string>")),
    )
    return samples.select("sample_id", F.explode(F.array_compact(tokens)).alias("token"))


def group_samples(samples: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """``sample_id, label`` of the component. Rows link to the least row of each token, one link a row and token; the rows of a hot token stay where they are."""
    with Scratch(samples.sparkSession) as scratch:
        tokens = scratch.cut(tokens if tokens is not None else sample_tokens(samples))
        linked = with_groups(tokens, "token", tokens.count(), scratch, least=2, hub=F.min("sample_id"))
        found = components(linked.select(F.col("sample_id").alias("a"), F.col("hub").alias("b")).distinct())
    return samples.select("sample_id").join(found.withColumnRenamed("node", "sample_id"), "sample_id", "left").select("sample_id", F.coalesce("label", "sample_id").alias("component"))


def assign_splits(grouped: DataFrame, *, seed: int, train: float, validation: float, holdout: Column | None = None) -> DataFrame:
    """``sample_id, component, split``: the hash of seed and sorted member ids decides; components with a held-out row are test.

    The sorted ids of a component stream through a digest, so no task holds a component, however large. ``grouped`` is
    read twice; ids are unique.
    """
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("fractions must be positive and leave a rest for test")
    with Scratch(grouped.sparkSession) as scratch:
        rows = scratch.keep(grouped.select("sample_id", "component", F.coalesce(holdout if holdout is not None else F.lit(False), F.lit(False)).alias("held")))
        keys = digests(rows, ["component"], [F.col("sample_id")], F.col("sample_id"), b"|", "digest", prefix=f"{seed}:".encode())
        groups = rows.groupBy("component").agg(F.bool_or("held").alias("held"), F.count(F.lit(1)).alias("size")).join(keys.hint("merge"), "component")
        at = digest_fraction(F.col("digest"))
        split = F.when(F.col("held"), "test").when(at < train, "train").when(at < train + validation, "val").otherwise("test")
        found = scratch.keep(groups.select("component", split.alias("split"), "size"))
        return join_groups(rows, found, "component", rows.count()).select("sample_id", "component", "split")


def split_problems(rows: DataFrame, holdout: Column) -> DataFrame:
    """Checks on given splits (component, split): partly set, one component in several splits, held-out rows outside test."""
    per = rows.groupBy("component").agg(F.count_distinct("split").alias("splits"), F.count_if(F.col("split").isNull()).alias("unset"), F.bool_or(holdout & ~F.col("split").eqNullSafe("test")).alias("held"))
    problem = F.when(F.col("unset") > 0, "unset").when(F.col("splits") > 1, "several_splits").when(F.col("held"), "holdout_outside_test")
    return per.select("component", problem.alias("problem")).where("problem is not null")


def lineage(rows: DataFrame) -> DataFrame:
    """``id, root, depth, status`` of a table ``id, parent``; status ok, orphan (a parent is missing) or cycle.

    Pointer doubling: each round joins the table with itself once and doubles the distance
    looked back, so a chain of n takes log2 n rounds. Parents of many rows are looked up by broadcast.
    """
    rows = cut(rows.select("id", F.col("parent").alias("up")))
    n, reach = rows.count(), 1
    linked = lookup(rows, rows.select(F.col("id").alias("up"), F.lit(True).alias("there")), "up", n)
    there = F.col("there").isNotNull()
    state = cut(linked.select("id", F.when(there, F.col("up")).alias("up"), F.when(there, 1).otherwise(0).cast("long").alias("depth"), F.when(there, F.col("up")).otherwise(F.col("id")).alias("root"), (F.col("up").isNotNull() & ~there).alias("orphan")))
    while reach < 2 * n:
        if state.where("up is not null").isEmpty():
            break
        up = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"), F.col("orphan").alias("o2"))
        state = cut(lookup(state, up, "up", n).select("id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("r2", "root").alias("root"), (F.col("orphan") | F.coalesce("o2", F.lit(False))).alias("orphan")))
        reach *= 2
    status = F.when(F.col("up").isNotNull(), "cycle").when(F.col("orphan"), "orphan").otherwise("ok")
    return state.select("id", F.when(F.col("up").isNull(), F.col("root")).alias("root"), F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), status.alias("status"))


def overlap(rows: DataFrame, columns: list[str], splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """For each column and pair of splits, the values that both hold: one pass over (column, value) groups."""
    stacked = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns))
    values = rows.select("split", F.inline(stacked)).where("value is not null")
    per = values.groupBy("col", "value").agg(*(F.bool_or(F.col("split") == s).alias(s) for s in splits))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    counted = per.groupBy("col").agg(*(F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs))
    return counted
