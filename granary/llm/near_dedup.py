"""Near duplicates by Order MinHash over occurrence-labelled five-word shingles.

For sketches a text's shingles are labelled with their occurrence number, so that all are
distinct. For each of ``hashes`` hash functions the ``width`` least shingles are taken and kept in text
order: their sequence is one bucket key, which texts share only if the same shingles are
least *and* stand in the same order. Texts of at most ``short`` shingles have as many keys of
``short_width`` shingles besides.

In each bucket all texts are compared with a hub. While a bucket of more than ``many`` texts belongs to more
than one class, and the last round has linked a tenth of the texts it asked, more hubs are asked; at last
the pairs across classes that are left are compared too, so no pair of a bucket is left undecided, and a large group of
copies costs one comparison per text. Filters spare pairs the comparison: bit maps of the shingles rule the
similarity out for sure (small ones within buckets, then maps of 8 bits a shingle).

Two texts are linked if an alignment inside a diagonal band matches shingles in order with
matched / (n1 + n2 - matched) >= ``similarity``. The band is as wide as two texts at that
similarity can shift. Shingles are aligned without labels: any two occurrences match. Classes are the connected components of the links.

With width 4 and 20 hashes a pair of long texts at similarity 0.8 shares no bucket with probability
3e-5; the shorter keys bring it below that for texts of few shingles.

Buckets, classes and hubs may be hot: groups with more than 1 / 2000 of the rows are broadcast to
their rows, not gathered (``operators.skew``); a hub's text is sent once to each of ``spread`` groups of
its partners; pairs across classes of a large bucket are dealt out by both texts, ``ACROSS`` of them on each side.

Equal texts are one node from the start and are never paired. A null text counts as
empty; texts without words are linked with nothing but equal texts. A null id is kept. Ids can be of any
type, and repeated rows are one node; an empty table gives an empty result. Other columns can have any names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.skew import join_groups, with_groups
from ..session import Scratch
from .rows import Shingler, map_groups, map_rows, mix

#: Nodes up to this number (16 bytes each) are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_NODES = 400_000
#: Texts of a bucket that meet in one task in the comparison across classes, on each side.
ACROSS = 500


@dataclass(frozen=True)
class Settings:
    hashes: int = 20
    width: int = 4
    short: int = 40
    short_width: int = 2
    similarity: float = 0.8
    many: int = 4096
    bits: int = 4096
    spread: int = 64


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Makes repeats distinct by their occurrence number."""
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    new = np.append(True, s[1:] != s[:-1])
    if new.all():
        return shingles
    starts = np.flatnonzero(new)
    number = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    out = shingles.copy()
    again = order[number > 0]
    out[again] = mix(out[again] + number[number > 0].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return out


def sketch(shingles: np.ndarray, settings: Settings) -> np.ndarray:
    """One key per hash function, two for a short text; none for a text without shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    widths = (settings.width, settings.short_width) if len(shingles) <= settings.short else (settings.width,)
    out = np.empty((len(widths), settings.hashes), np.uint64)
    step = max(1, 500_000 // len(shingles))
    for at in range(0, settings.hashes, step):
        seeds = mix(np.arange(at + 1, min(at + step, settings.hashes) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        x = (shingles[None, :] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        for k, wanted in enumerate(widths):
            width = min(wanted, len(shingles))
            least = np.sort(np.argpartition(x, width - 1, axis=1)[:, :width], axis=1)  # in text order
            key = seeds + np.uint64(k)
            for c in range(width):
                key = mix(key * np.uint64(0xE7037ED1A0B428DB | 1) + shingles[least[:, c]])
            out[k, at : at + len(seeds)] = key
    return out.reshape(-1).view(np.int64)


def bit_map(shingles: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    out[(shingles % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def large_map(shingles: np.ndarray) -> bytes:
    """8 to 16 bits a shingle; the size is a power of two."""
    return bit_map(shingles, 8 << max(3, len(shingles).bit_length()))


def shared_at_most(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> int:
    """A bound on the shingles that two sets (number, large map) share: all but those whose bits only one has."""
    (n, x), (m, y) = a, b
    size = min(len(x), len(y))
    if len(x) > size:
        x = np.bitwise_or.reduce(x.reshape(-1, size), axis=0)
    if len(y) > size:
        y = np.bitwise_or.reduce(y.reshape(-1, size), axis=0)
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, repeats included: all match positions as bits of one integer a row."""
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[:least] != b[:least])
    head = int(differ[0]) if len(differ) else least
    a, b, least = a[head:], b[head:], least - head
    differ = np.flatnonzero(a[len(a) - least :][::-1] != b[len(b) - least :][::-1])
    tail = int(differ[0]) if len(differ) else least
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    at: dict[int, list[int]] = {}
    for k, x in enumerate(a.tolist()):
        at.setdefault(x, []).append(k)
    masks = {x: sum(1 << k for k in ks) for x, ks in at.items() if len(ks) > 16}  # few; others are made when met
    full = (1 << len(a)) - 1
    free = full
    for x in b.tolist():
        match = free & (masks[x] if x in masks else sum(1 << k for k in at.get(x, ())))
        if match:
            free = (free + match | free - match) & full
    return head + tail + len(a) - free.bit_count()


class Prepared:
    """A text's shingles, sorted to be looked up by others."""

    def __init__(self, labels: np.ndarray, plain: np.ndarray | None) -> None:
        self.labels, self.plain = labels, plain
        self.order = np.argsort(labels, kind="stable")
        self.sorted = labels[self.order]

    def similarity(self, labels: np.ndarray, plain: np.ndarray | None, least: float) -> float:
        """matched / (n1 + n2 - matched) of the longest chain in the band; 0.0 where it can't reach ``least``."""
        own, n = len(self.labels), len(self.labels) + len(labels)
        if not own or not len(labels) or min(own, len(labels)) < least * max(own, len(labels)):
            return 0.0
        place = np.minimum(np.searchsorted(self.sorted, labels), own - 1)
        j = np.flatnonzero(self.sorted[place] == labels)
        i = self.order[place[j]]
        if len(i) < n * least / (1 + least) - 1e-9:  # even regardless of order
            return 0.0
        if self.plain is not None or plain is not None:
            # a repeat matches any other: labels would tie the k-th to the k-th. A chain that reaches ``least`` stays in the band
            matched = longest_common(self.labels if self.plain is None else self.plain, labels if plain is None else plain)
            return matched / (n - matched)
        i = i[np.abs(i - j) <= n * (1 - least) / (1 + least)]
        if len(i) < n * least / (1 + least) - 1e-9:
            return 0.0
        if np.all(i[1:] > i[:-1]):
            matched = len(i)
        else:
            tails: list[int] = []
            for x in i.tolist():
                k = bisect_left(tails, x)
                tails[k : k + 1] = [x]
            matched = len(tails)
        return matched / (n - matched)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    x, y = labelled(a), labelled(b)
    return Prepared(x, None if x is a else a).similarity(y, None if y is b else b, least)


def node(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def dealt(pairs: DataFrame, profiles: DataFrame, settings: Settings, scratch: Scratch, *columns: str) -> DataFrame:
    """``a, g, b`` and the columns of b, in order within a partition; a row without b brings those of a.

    Partners b of a text a are dealt to ``spread`` groups, each of which meets one copy of a's columns.
    """
    needed = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)
    own = profiles.select("node", *columns).join(needed, "node", "left_semi")
    pairs = pairs.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(settings.spread)).cast("int"))
    none = F.lit(None).cast("binary")
    heads = pairs.select("a", "g").distinct().join(own.withColumnRenamed("node", "a").hint("merge"), "a").select("a", "g", none.alias("b"), *columns)
    partners = pairs.join(own.withColumnRenamed("node", "b").hint("merge"), "b").select("a", "g", "b", *columns)
    return heads.unionByName(partners).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())


def closer(pairs: DataFrame, profiles: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """The pairs whose large maps leave the similarity possible; loses none that have it."""
    share = settings.similarity / (1 + settings.similarity)

    def make():
        head: tuple[int, np.ndarray] = (0, np.zeros(0, np.uint8))

        def step(row: dict) -> Iterator[tuple]:
            nonlocal head
            own = row["n"], np.frombuffer(row["map"], np.uint8)
            if row["b"] is None:
                head = own
            elif shared_at_most(head, own) >= (head[0] + own[0]) * share - 1e-9:
                yield row["a"], row["b"]

        return step

    return map_rows(dealt(pairs, profiles, settings, scratch, "n", "map"), make, "a binary, b binary")


def verify(pairs: DataFrame, profiles: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the similarity."""

    def make():
        head = Prepared(np.zeros(0, np.uint64), None)

        def step(row: dict) -> Iterator[tuple]:
            nonlocal head
            own = np.frombuffer(row["labels"], np.uint64), None if row["plain"] is None else np.frombuffer(row["plain"], np.uint64)
            if row["b"] is None:
                head = Prepared(*own)
                return
            s = head.similarity(*own, settings.similarity)
            if s >= settings.similarity - 1e-12:
                yield row["a"], row["b"], s

        return step

    return map_rows(dealt(pairs, profiles, settings, scratch, "labels", "plain"), make, "a binary, b binary, similarity double")


def profiled(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """``node, shared, keys, n, bits, map, labels, plain`` of the nodes in ``wanted`` (node, shared, keys): their shingles, hashed once."""
    nodes = wanted.select("node")
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    # the texts are shuffled once, for both steps
    texts = docs.select("node", "text").join(nodes, "node", "left_semi").dropDuplicates(["node"]).join(wanted, "node")

    def make():
        shingler = Shingler()

        def step(row: dict) -> Iterator[tuple]:
            plain = shingler.shingles(shingler.words(row["text"]))
            s = labelled(plain)
            yield row["node"], row["shared"], row["keys"], len(s), bit_map(s, settings.bits), large_map(s), s.tobytes(), None if s is plain else plain.tobytes()

        return step

    return map_rows(texts, make, "node binary, shared long, keys array<long>, n int, bits binary, map binary, labels binary, plain binary")


def ordered_pair(x: Column, y: Column) -> list[Column]:
    """``a``, ``b`` of two structs (shared, node): the text that shares more buckets is a."""
    return [F.greatest(x, y)["node"].alias("a"), F.least(x, y)["node"].alias("b")]


def hub_pairs(own: DataFrame, turn: int, hubs: int, n: int, scratch: Scratch) -> DataFrame:
    """Each text of a bucket with the bucket's hubs of other classes; hubs are the texts that share most buckets among those of a slot."""
    me = F.struct("shared", "node", "label")
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(hubs))
    best = own.groupBy("key", slot.alias("slot")).agg(F.max(me).alias("hub"), F.count(F.lit(1)).alias("size"))
    groups = scratch.cut(best.groupBy("key").agg(F.collect_list("hub").alias("found"), F.sum("size").alias("size")))  # ``hubs`` at most
    met = join_groups(own.drop("size"), groups, "key", n).select("shared", "node", "label", F.explode("found").alias("hub")).where("label <> hub.label")
    return met.select(*ordered_pair(F.struct("shared", "node"), F.struct("hub.shared", "hub.node"))).distinct()


def pairs_across(own: DataFrame, profiles: DataFrame, settings: Settings) -> DataFrame:
    """All pairs of a bucket that are in two classes, each in the first bucket alone that the two share; those that bit maps rule out are left out."""
    whole = own.select("key", "node", "label", "size").join(profiles.select("node", "shared", "n", "bits", "keys"), "node")
    parts = F.ceil(F.col("size") / ACROSS).cast("int")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    # a large bucket is parts x parts groups, a small one is one: side 1 has one part of the texts, side 2 another, 3 stands for both
    all_parts = F.sequence(F.lit(0), parts - 1)
    places = F.when(parts == 1, F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(3).alias("side")))).otherwise(
        F.concat(
            F.transform(all_parts, lambda c: F.struct(part.alias("r"), c.alias("c"), F.lit(1).alias("side"))),
            F.transform(all_parts, lambda r: F.struct(r.alias("r"), part.alias("c"), F.lit(2).alias("side"))),
        )
    )
    rows = whole.select("key", "node", "label", "shared", "n", "bits", "keys", F.inline(places))
    least = settings.similarity

    def make():
        def step(group: list[dict]) -> Iterator[tuple]:
            one, other = ([g for g in group if g["side"] & side] for side in (1, 2))
            if not one or not other:
                return
            n, bits = np.array([g["n"] for g in other]), np.stack([np.frombuffer(g["bits"], np.uint64) for g in other])
            for g in one:
                near = np.flatnonzero((np.minimum(n, g["n"]) >= least * np.maximum(n, g["n"])))
                own_bits = np.frombuffer(g["bits"], np.uint64)
                most = np.minimum(
                    g["n"] - np.bitwise_count(own_bits & ~bits[near]).sum(axis=1, dtype=np.int64),
                    n[near] - np.bitwise_count(bits[near] & ~own_bits).sum(axis=1, dtype=np.int64),
                )
                for k in near[most >= (n[near] + g["n"]) * least / (1 + least) - 1e-9].tolist():
                    h = other[k]
                    if (g["shared"], g["node"]) > (h["shared"], h["node"]) and g["label"] != h["label"]:
                        if next(x for x, y in zip(g["keys"], h["keys"], strict=False) if x == y) == g["key"]:
                            yield g["node"], h["node"]

        return step

    return map_groups(rows, ["key", "r", "c"], make, "a binary, b binary")


def node_labels(docs: DataFrame, sketches: DataFrame, settings: Settings, scratch: Scratch) -> DataFrame:
    """``node, label`` (least node of its class) of the nodes that have a link; ``docs`` has ``node, text``."""
    texts = scratch.cut(sketches.select("node", "keys").dropDuplicates(["node"]))
    entries = scratch.cut(texts.select("node", F.explode("keys").alias("key")))
    own = scratch.cut(with_groups(entries, "key", entries.count(), scratch, least=2))
    scratch.drop(entries)
    shared = scratch.cut(own.groupBy("node").agg(F.sum("size").alias("shared")))
    profiles = scratch.cut(profiled(docs, scratch.cut(shared.join(texts, "node")), settings))
    own = own.join(shared, "node").withColumn("label", F.col("node"))

    # own: the buckets in which more than one class is left; tried: pairs that need no second look
    own, found = scratch.cut(own), scratch.cut(profiles.select("node", F.col("node").alias("label")).limit(0))
    tried: DataFrame | None = None
    turn, ask = 0, True
    while n := own.count():
        new = hub_pairs(own, turn, min(4**turn, 16), n, scratch) if ask else pairs_across(own, profiles, settings)
        pairs = scratch.cut(new if tried is None else new.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        near = scratch.cut(closer(pairs, profiles, settings, scratch))
        links = scratch.cut(verify(near, profiles, settings, scratch).select("a", "b"))
        linked = links.count()
        if linked:
            found = components(links.unionByName(found.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        if not ask:
            break
        labelled = scratch.cut(own.drop("label", "size").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))
        marked = with_groups(labelled, "key", n, scratch, mixed=F.min("label") != F.max("label"))
        asked = own.select("node").distinct().count()
        scratch.drop(own)
        own = scratch.cut(marked.where("mixed").drop("mixed"))
        scratch.drop(labelled)
        largest = own.agg(F.max("size")).first()[0] or 0
        turn, ask = turn + 1, largest > settings.many and 10 * linked >= asked
    return found


def sketched(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, node, keys`` of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        shingler = Shingler()

        def step(row: dict) -> Iterator[tuple]:
            s = labelled(shingler.shingles(shingler.words(row["text"])))
            yield row["doc_id"], row["node"], sketch(s, settings)

        return step

    return map_rows(docs, make, f"doc_id {kind}, node binary, keys array<long>")


def labelled_nodes(df: DataFrame, settings: Settings, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node`` of every row, and ``node, size, least, label`` of every node: its rows, its least id, its class."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), node(text_col).alias("node"))
    sketches = scratch.cut(sketched(docs, settings))
    found = node_labels(docs, sketches, settings, scratch)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("least")
    nodes = sketches.groupBy("node").agg(F.count(F.lit(1)).alias("size"), least)
    nodes = scratch.cut(nodes.join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))
    return sketches.select("doc_id", "node"), nodes


def near_duplicates(df: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, node, label, class_id`` (least id of its class; null if it has none) ``, class_size`` of every row.

    Classes with null or repeated ids can share a ``class_id``; the label (least node) tells them apart.
    """
    with Scratch(df.sparkSession) as scratch:
        rows, nodes = labelled_nodes(df, settings, id_col, text_col, scratch)
        whole = with_groups(nodes.withColumnRenamed("size", "copies").select("node", "label", "least", "copies"), "label", nodes.count(), scratch, class_id=F.min("least")["id"], class_size=F.sum("copies"))
        whole = scratch.cut(whole.select("node", "label", "class_id", "class_size", F.col("copies").alias("size")))
        n = rows.count()
        return scratch.keep(join_groups(rows, whole, "node", n).select("doc_id", "node", "label", "class_id", "class_size"))


def keep_one(df: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with the least id (of rows that repeat it, one; a null id comes last), with all columns.

    Rows are matched by id and text digest together, so that no group of copies meets in one task.
    """
    with Scratch(df.sparkSession) as scratch:
        _, nodes = labelled_nodes(df, settings, id_col, text_col, scratch)
        first = F.min(F.struct("least.none", "least.id", "node")).alias("first")
        kept = scratch.keep(nodes.groupBy("label").agg(first).select(F.col("first.id").alias("i"), F.col("first.node").alias("n")))
    marked = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.col(id_col).alias("own_id"), node(text_col).alias("own_node"))
    same = F.col("own_node").eqNullSafe(F.col("n")) & F.col("own_id").eqNullSafe(F.col("i"))
    return marked.join(kept, same).dropDuplicates(["i", "n"]).select("row.*")
