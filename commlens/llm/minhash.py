"""Near duplicates by one-permutation hashing.

A document's set is its distinct five-word shingles over words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered; with fewer words, all
words as one; without words it is empty and linked with nothing. Two documents are linked if their sets' Jaccard similarity is at
least NEED per cent, which is confirmed on the full sets.

Signature: the hashes of a set, in order, fall into BANDS * ROWS bins of equal width; a bin's value is its smallest hash, and an empty bin
takes the value of another one, chosen by a fixed random order of its own (optimal densification). ROWS values make a band. At the
threshold, a pair shares no band with a probability of (1 - 0.75^5)^40, about 2 in 100,000; above it, less.

Documents with equal sets are one node. In the bucket of a band, nodes are not paired with each other but with a hub (a star): the node
that meets most others in all its buckets. After the first round a bucket keeps only
the nodes that could have an untested link to another component: a hub is done, and so is a node if all nodes whose distance to the hub
differs from its own by at most the distance of a link are in its component, because the Jaccard distance is a metric.

What is left is dealt anew. Let a node x have no link with its hub h. If x has a link with m, and m is not smaller than h, then x and m
share a shingle that h lacks: otherwise x and m would have no more in common than x and h, which is too little. So nodes meet in buckets
named by a hub and a shingle beyond it, the rarest first; x leaves out all but one of the shingles that such a link must share at least.
The few nodes that a smaller m could link without such a shingle stay in their old bucket. From then on the hub of a bucket is its
smallest node, so that no m is smaller, and leaves it; the others are tested against it and dealt anew in the same way, until each bucket
has one component. The hubs that two nodes meet one after another grow, so this ends. A bucket of n nodes has n - 1 pairs in every
round, whatever links there are among them, and no link is given up. A bucket with few nodes outside its most frequent component (FEW)
is finished at once: each of these is a hub, so that the pairs grow with n.

Rows without doc_id link with nothing: component null, kept. Rows that share a doc_id are separate nodes. Repeated rows are linked by equal
sets. An empty table gives an empty result. Other columns may have any name; `kept` takes a free name for its own.

What a step reads more than once is a table, so that a plan holds few shuffles: the driver's memory goes by the size of its plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, free_name, in_slices, mix, shingles, stored, tidy, words
from .graph import components

SHINGLE, NEED = 5, 75
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Bytes of text a task holds as strings.
HELD = 1 << 20
#: A bucket with at most so many nodes outside its most frequent component is finished by as many stars.
FEW = 32
#: Classes of distance, as wide as the distance of a link.
QUARTERS = 100 // (100 - NEED)
_EDGES = (np.arange(1, BINS, dtype=object) * (1 << 64) // BINS).astype(np.uint64)
#: For each bin the other bins in a random order.
_ORDER = np.stack([np.random.default_rng(i).permutation(BINS) for i in range(BINS)])


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower() lowers A-Z only."""
    return np.unique(shingles(hashes.of(words_lower(text)), SHINGLE))


def words_lower(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a set that is not empty."""
    edges = np.concatenate(([0], np.searchsorted(hashes, _EDGES), [len(hashes)]))
    full = edges[1:] > edges[:-1]
    values = hashes[np.minimum(edges[:-1], len(hashes) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        donor = _ORDER[empty, full[_ORDER[empty]].argmax(axis=1)]
        values = values.copy()
        values[empty] = values[donor]
    values = values.reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN)
    for j in range(ROWS):
        key = mix(key * GOLDEN + values[:, j])
    return key


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in (some for whole in batches for some in in_slices(whole, 1, HELD)):
        n, digest, keys = [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_set(text, hashes)
            n.append(len(own))
            digest.append(xxhash.xxh3_128_digest(own) if len(own) else None)
            keys.append(bands(own).view(np.int64) if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "digest", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the nodes' texts, where the text is the node's."""
    hashes = WordHashes()
    for batch in (some for whole in batches for some in in_slices(whole, 2, HELD)):
        nodes, found = [], []
        for node, digest, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = shingle_set(text, hashes)
            if xxhash.xxh3_128_digest(own) == digest:
                nodes.append(node)
                found.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "set"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and union of two sets."""
    for batch in batches:
        both, either = [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            joint = np.sort(np.concatenate((x, y)), kind="stable")
            n = int(np.count_nonzero(joint[1:] == joint[:-1]))
            both.append(n)
            either.append(len(joint) - n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())],
            names=["hub", "node", "both", "either"],
        )


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, node, both, either for pairs(hub, node, n_hub, n_node). Sets whose sizes alone rule a link out are not fetched: for
    them both / either is the ratio of the sizes, an upper bound."""
    small, large = F.least("n_hub", "n_node"), F.greatest("n_hub", "n_node")
    possible = 100 * small >= NEED * large
    ruled_out = pairs.where(~possible).select("hub", "node", small.alias("both"), large.alias("either"), F.lit(False).alias("known"))
    of_hub = sets.select(F.col("node").alias("hub"), F.col("set").alias("x"))
    of_node = sets.select("node", F.col("set").alias("y"))
    found = pairs.where(possible).select("hub", "node").join(of_node, "node").join(of_hub, "hub").select("hub", "node", "x", "y")
    found = found.mapInArrow(tidy(_compared), "hub long, node long, both long, either long").withColumn("known", F.lit(True))
    return stored(found.unionByName(ruled_out), "tested")


def _links(tested: DataFrame) -> DataFrame:
    return tested.where(f"100 * both >= {NEED} * either").select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _joined(linked: DataFrame, links: DataFrame) -> DataFrame:
    """linked(node, component) after links(a, b) between components: only the linked components' names are a graph, not all nodes."""
    links = stored(links, "links")
    if links.isEmpty():
        return linked
    merged = stored(components(links), "merged")
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    named = linked.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = merged.join(linked, "node", "left_anti").select("node", "component")
    return stored(named.unionByName(alone), "components")


def _several(rows: DataFrame) -> DataFrame:
    """The rows (key, node, n, component) in buckets of several components; one bucket of those with the same nodes."""
    buckets = rows.groupBy("key").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        F.count(F.lit(1)).alias("nodes"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("names"),
    )
    single = buckets.where("x <> y").groupBy("nodes", "names").agg(F.min("key").alias("key"))
    return rows.join(single, "key", "left_semi")


def _labelled(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """rows(node, ...) with the node's component."""
    return rows.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _components_of(measured: DataFrame, linked: DataFrame) -> DataFrame:
    """hub, node, n_hub, n, common, alone (shingles beyond the hub) and component of the measured pairs."""
    pairs = measured.select("hub", "node", "n_hub", "n", "common", F.size("beyond").alias("alone"))
    return stored(_labelled(pairs, linked), "labelled")


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much hub and node have in common, and the node's shingles beyond the hub."""
    for batch in (some for whole in batches for some in in_slices(whole, 5, HELD)):
        common, beyond = [], []
        for x, y in zip(batch.column(4), batch.column(5), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            rest = np.setdiff1d(y, x, assume_unique=True)
            common.append(len(y) - len(rest))
            beyond.append(rest.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array(common, pa.int64()), pa.array(beyond, pa.list_(pa.int64()))],
            names=["hub", "node", "n_hub", "n", "common", "beyond"],
        )


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, node, n_hub, n, common, beyond of pairs(hub, node, n_hub, n)."""
    of_hub = sets.select(F.col("node").alias("hub"), F.col("set").alias("x"))
    of_node = sets.select("node", F.col("set").alias("y"))
    pairs = pairs.join(of_node, "node").join(of_hub, "hub").select("hub", "node", "n_hub", "n", "x", "y")
    schema = "hub long, node long, n_hub long, n long, common long, beyond array<long>"
    return stored(pairs.mapInArrow(tidy(_beyond), schema), "beyond")


def _dealt(measured: DataFrame, labelled: DataFrame) -> DataFrame:
    """key, node, n, component of the new buckets: one for each hub and shingle beyond it that its nodes share. labelled: as from
    _components_of(measured).

    A link of two nodes of a hub shares at least `must` shingles beyond it. With a node's shingles ordered by how many nodes of the
    hub have them, rarest first, the first one they share is among all but the last `must` - 1 of either.
    """
    groups = labelled.groupBy("hub").agg(
        F.min("n").alias("least"), F.min("component").alias("first"), F.max("component").alias("last")
    )
    rows = labelled.join(groups.where("first <> last").select("hub", "least"), "hub")
    smallest = f"greatest(least, ({NEED} * n + 99) div 100)"
    must = f"greatest(1L, ({NEED} * (n + {smallest}) + {99 + NEED}) div {100 + NEED} - common)"
    rows = rows.select("hub", "node", "n", "component", "alone", F.expr(f"alone - {must} + 1").alias("take")).where("take > 0")
    rows = stored(rows, "dealt")
    beyond = measured.select("hub", "node", "beyond").join(rows.select("hub", "node"), ["hub", "node"], "left_semi")
    each = beyond.select("hub", "node", F.explode("beyond").alias("shingle"))
    met = each.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    # of one document's own shingles
    shared = each.join(met, ["hub", "shingle"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("met", "shingle"))).alias("shared"))
    rows = rows.join(shared, ["hub", "node"])
    rows = rows.withColumn("take", F.expr("cast(take - alone + size(shared) as int)")).where("take > 0")
    rows = rows.select("hub", "node", "n", "component", F.explode(F.slice("shared", F.lit(1), F.col("take"))).alias("at"))
    return rows.select(F.xxhash64("hub", "at.shingle").alias("key"), "node", "n", "component")


def _kept_back(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """key, node, n, component of the nodes of rows(key, hub, node) that a node smaller than the hub could link without a shingle
    beyond it: these stay in their bucket."""
    # the largest set that could be linked with the node without a shingle beyond the hub: smaller than the hub
    reach = F.floor(((100 + NEED) * F.col("common") - NEED * F.col("n")) / NEED)
    apart = (100 + NEED) * F.col("common") < NEED * (F.col("n") + F.col("n_hub"))
    known = rows.join(labelled.select("hub", "node", "n", "component", F.when(apart, reach).alias("reach")), ["hub", "node"])
    known = stored(known, "known")
    bound = known.groupBy("key").agg(F.max("reach").alias("largest"), F.min("n").alias("smallest")).where("largest >= smallest")
    return known.join(bound, "key").where("n <= largest or reach >= smallest").select("key", "node", "n", "component")


def _counted(pending: DataFrame) -> DataFrame:
    """key, component, others: the most frequent component of each bucket and the number of nodes outside it."""
    sizes = pending.groupBy("key", "component").agg(F.count(F.lit(1)).alias("nodes"))
    most = sizes.groupBy("key").agg(F.max(F.struct("nodes", "component")).alias("most"), F.sum("nodes").alias("all"))
    return most.select("key", "most.component", (F.col("all") - F.col("most.nodes")).alias("others"))


def _crossing(pending: DataFrame, few: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components in buckets of few(key, component, others): each node outside the component is a hub."""
    rows = pending.join(few.select("key", F.col("component").alias("common")), "key")
    hubs = rows.where("component <> common").select(
        "key", F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("component").alias("of_hub")
    )
    # two hubs meet once
    pairs = rows.join(hubs, "key").where("component <> of_hub and (component = common or hub < node)")
    pairs = pairs.groupBy("hub", "node").agg(*(F.first(c).alias(c) for c in ("n_hub", "n", "of_hub", "component")))
    pairs = stored(pairs, "pairs")
    tested = _tested(pairs.select("hub", "node", "n_hub", F.col("n").alias("n_node")), sets)
    return _named(_links(tested).toDF("hub", "node"), pairs)


def _named(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """links(hub, node) of pairs(hub, node, of_hub, component) as links (a, b) of components."""
    ends = pairs.where("component <> of_hub").select("hub", "node", F.col("of_hub").alias("a"), F.col("component").alias("b"))
    return links.join(ends, ["hub", "node"]).select("a", "b").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_shingles long, digest binary, keys array<long>"
    signed = stored(documents.select("doc_id", "text").mapInArrow(tidy(_signatures), schema), "signatures")
    named = signed.where("doc_id is not null and digest is not null")
    # one node for each distinct set; the node's number is that of its row in this table
    nodes = stored(
        named.groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "doc_id", "n", "keys"),
        "nodes",
    )
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    pending = stored(members.join(shared, "key").select("key", "node", "n", "met"), "buckets")
    weight = pending.groupBy("node").agg(F.sum("met").alias("weight"), F.first("n").alias("n"))
    weight = stored(weight, "weights")
    wanted = nodes.join(weight.select("node"), "node").select("node", "digest", "doc_id")
    texts = documents.select("doc_id", "text").where("doc_id is not null")
    sets = texts.join(wanted, "doc_id").select("node", "digest", "text").mapInArrow(tidy(_sets), "node long, set binary")
    sets = stored(sets.dropDuplicates(["node"]), "sets")
    size = weight.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"))

    pending = pending.select("key", "node", "n")
    heaviest = pending.join(weight.select("node", "weight"), "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"))
    hubs = stored(heaviest.select("key", F.col("top.node").alias("hub")), "hubs")
    rows = pending.join(hubs, "key")
    pairs = rows.where("node <> hub").groupBy("hub", "node").agg(F.first("n").alias("n_node")).join(size, "hub")
    now = _tested(stored(pairs, "pairs"), sets)
    linked = stored(components(_links(now)), "components")
    rows = stored(_left(pending, hubs, now, linked), "buckets").join(hubs, "key")
    pairs = rows.groupBy("hub", "node").agg(F.first("n").alias("n")).join(size, "hub")
    measured = _measured(pairs, sets)
    labelled = _components_of(measured, linked)
    again = _kept_back(rows.select("key", "hub", "node"), labelled)
    dealt = stored(_dealt(measured, labelled).unionByName(again), "dealt")
    pending = stored(_several(dealt), "buckets")
    sets = stored(sets.join(pending.select("node").distinct(), "node", "left_semi"), "sets")
    while not pending.isEmpty():
        few = stored(_counted(pending).where(f"others <= {FEW}"), "few")
        links = _crossing(pending, few, sets)
        many = stored(pending.join(few, "key", "left_anti"), "buckets")
        if many.isEmpty():
            linked = _joined(linked, links)
            break
        smallest = many.groupBy("key").agg(F.min(F.struct("n", "node", "component")).alias("hub"))
        rows = many.join(smallest.select("key", "hub.*").toDF("key", "n_hub", "hub", "of_hub"), "key").where("node <> hub")
        pairs = rows.groupBy("hub", "node").agg(*(F.first(c).alias(c) for c in ("n_hub", "n", "of_hub", "component")))
        pairs = stored(pairs, "pairs")
        measured = _measured(pairs, sets)
        found = measured.where(f"100 * common >= {NEED} * (n + n_hub - common)").select("hub", "node")
        linked = _joined(linked, links.unionByName(_named(found, pairs)))
        dealt = stored(_dealt(measured, _components_of(measured, linked)), "dealt")
        pending = stored(_several(dealt), "buckets")
    found = nodes.select("node", "digest", "doc_id").join(linked, "node", "left")
    found = found.withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_nodes = found.join(least, "component").select("digest", "component_id")
    rows = named.select("doc_id", "n_shingles", "digest").join(named_nodes, "digest").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _left(pending: DataFrame, hubs: DataFrame, tested: DataFrame, linked: DataFrame) -> DataFrame:
    """The nodes of each bucket that may still have an untested link to another component."""
    label = linked.select("node", "component")
    rows = (
        pending.join(hubs, "key")
        .join(tested, ["hub", "node"], "left")
        .join(label, "node", "left")
        .join(label.select(F.col("node").alias("hub"), F.col("component").alias("of_hub")), "hub", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("of_hub", F.coalesce("of_hub", "hub"))
    )
    own = F.col("node") == F.col("hub")
    # distances to the hub in quarters; where only an upper bound of the similarity is known, any larger distance is possible
    low = F.least(F.lit(QUARTERS - 1), F.floor(QUARTERS * (F.col("either") - F.col("both")) / F.col("either")))
    low = F.when(own, F.lit(0)).otherwise(F.coalesce(low, F.lit(0)))
    high = F.when(own | F.coalesce("known", F.lit(False)), low).otherwise(F.lit(QUARTERS - 1))
    rows = rows.select("key", "hub", "node", "n", "component", low.alias("low"), high.alias("high"), own.alias("own"))
    rows = stored(rows, "distances")
    inside = [F.when((F.col("low") <= q) & (F.col("high") >= q), F.col("component")) for q in range(QUARTERS)]
    ranges = rows.groupBy("key", "hub").agg(
        *(F.min(c).alias(f"min{q}") for q, c in enumerate(inside)), *(F.max(c).alias(f"max{q}") for q, c in enumerate(inside))
    )
    settled = F.lit(True)
    for q in range(QUARTERS):
        alike = (F.col(f"min{q}") == F.col("component")) & (F.col(f"max{q}") == F.col("component"))
        beyond = (F.col("low") - 1 > q) | (F.col("high") + 1 < q)
        settled = settled & (beyond | F.coalesce(alike, F.lit(True)))
    rest = (
        rows.join(ranges, ["key", "hub"])
        .groupBy("key", "node")
        .agg(F.max(F.col("own") | settled).alias("done"), F.first("n").alias("n"), F.first("component").alias("component"))
        .where("not done")
    )
    rest = stored(rest, "open")
    several = rest.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return rest.join(several, "key", "left_semi").select("key", "node", "n")


def kept(documents: DataFrame) -> DataFrame:
    """One document of each component, all columns: that with the smallest doc_id. A doc_id with several rows stays, with all of
    them, if one of them stays."""
    columns = documents.columns
    gone = free_name("_dropped", columns)
    found = near_duplicates(documents).groupBy(F.col("doc_id").alias(gone)).agg(F.max("kept").alias("kept"))
    dropped = found.where("not kept").select(gone)
    return documents.join(dropped, F.col("doc_id") == F.col(gone), "left_anti").select(*(F.col(f"`{c}`") for c in columns))
