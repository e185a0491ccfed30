"""Trie of conversation prefixes, as a node table with minimal perfect hashing.

Every conversation is rebuilt: the first h original turns of its template conversation, then its own turns after the first h. Each distinct
sequence of the first d rebuilt turns is a node; a conversation is a member of all its prefixes' nodes.

How it works. Turns are range-sorted by conversation and turn into shards of about `shard` rows; a long conversation spans
several. Positions and prefix digests in a shard continue those of the shards before it: counts and digests of a conversation's parts are
put together first, one small row per part (a digest is a polynomial in the turns' SHA-256 values modulo 2^255 - 19, so
that parts compose). Each shard then enumerates its distinct prefix digests and gives each a slot by a minimal perfect
hash (levels of bit arrays, ranks as slots). A lookup compares the whole 32-byte digest kept in the slot, so a collision or a
prefix of another shard is told apart. Counts are scattered into flat arrays by slot and summed through the array of
parent slots from the deepest level to the root. Shards' sums of a node are added by digest: a prefix that a third of all
conversations share is one row in each shard.

What lies below a node is counted once by giving every node to its smallest member. Along a conversation, the nodes it
owns are those from some depth on. So a second pass over the shards needs three numbers for each owner, and adds
its leaf and the lengths of its own nodes to all its prefixes through the same parent slots.

Defined cases: turns are ordered by (turn, null first; then SHA-256 of role and text, so that ties have one order); a null role or text is
empty; repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out. c % 100 has the sign of c, as in SQL. A
conversation without rebuilt turns ends at the root. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, stored

SHARD = 1 << 17
#: Templates are the conversations whose conv_id is a multiple of PERIOD; h is below LONGEST.
PERIOD, LONGEST = 100, 6
MODULUS = 2**255 - 19
BASE = int.from_bytes(hashlib.sha256(b"conversation prefix trie").digest(), "big") % MODULUS
ROOT = 1


class PerfectHash:
    """A minimal perfect hash of distinct digests (n rows of four 64-bit numbers), with the digests in slot order."""

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        rest, first = np.arange(len(digests)), 0
        slots = np.empty(len(digests), np.int64)
        while len(rest):
            size = 2 * len(rest) + 1
            place = self._place(digests[rest], size)
            alone = np.bincount(place, minlength=size) == 1
            ranks = np.cumsum(alone) - 1
            settled = alone[place]
            slots[rest[settled]] = first + ranks[place[settled]]
            self.levels.append((alone, ranks, first))
            first += int(alone.sum())
            rest = rest[~settled]
        self.digests = np.empty_like(digests)
        self.digests[slots] = digests

    def _place(self, digests: np.ndarray, size: int) -> np.ndarray:
        seed = np.uint64(len(self.levels) * 0x632BE59BD9B4E019 % 2**64)
        value = mix(digests[:, 3] ^ seed) + digests[:, 2]
        return (mix(value ^ digests[:, 1]) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where it is not in the table."""
        found = np.full(len(digests), -1, np.int64)
        rest = np.arange(len(digests))
        levels, self.levels = self.levels, []
        for alone, ranks, first in levels:
            place = self._place(digests[rest], len(alone))
            hit = alone[place]
            found[rest[hit]] = first + ranks[place[hit]]
            rest = rest[~hit]
            self.levels.append((alone, ranks, first))
        hits = np.flatnonzero(found >= 0)
        found[hits[(self.digests[found[hits]] != digests[hits]).any(axis=1)]] = -1
        return found


def _hash_of(part: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(part).cast("string"), F.lit(":"), part), 256)


def turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest (of role and text), n_chars, row of all turns with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return stored(
        conversations.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv"),
            F.col("turn").cast("long").alias("turn"),
            F.unhex(F.sha2(F.concat(_hash_of(role), _hash_of(text)), 256)).alias("digest"),
            F.length(text).cast("long").alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "turns",
    )


def borrowed(h: Column) -> Column:
    return F.pmod(F.crc32(h.cast("string").cast("binary")), F.lit(LONGEST)).cast("int")


def shards(rows: DataFrame, shard: int) -> DataFrame:
    """part, conv, own, n_chars, digest, at: borrowed and own turns, range-sorted; `at` is the place in the part."""
    order = ["turn", "digest", "row"]
    heads = (
        rows.where(F.col("conv") % PERIOD == 0)
        .withColumn("at", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), *order[1:])))
        .where(F.col("at") < LONGEST)
        .select(F.col("conv").alias("template"), F.col("at").alias("turn"), "digest", "n_chars")
    )
    convs = rows.select("conv").distinct().withColumn("template", F.col("conv") - F.col("conv") % PERIOD)
    taken = convs.join(heads, "template").where(F.col("turn") <= borrowed(F.col("conv")))
    everything = rows.select("conv", F.lit(1).alias("own"), *order, "n_chars").unionByName(
        taken.select("conv", F.lit(0).alias("own"), F.col("turn").cast("long"), "digest", F.lit(0).cast("long").alias("row"), "n_chars")
    )
    keys = ["conv", "own", F.col("turn").asc_nulls_first(), "digest", "row"]
    parts = max(1, -(-rows.count() // shard))
    sorted_rows = everything.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows_before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            place = pa.array(np.arange(rows_before, rows_before + n))
            rows_before += n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *batch.columns, place], names=names)

    names = ["part", "conv", "own", "n_chars", "digest", "at"]
    return stored(
        sorted_rows.select("conv", "own", "n_chars", "digest").mapInArrow(
            number, "part int, conv long, own int, n_chars long, digest binary, at long"
        ),
        "shards",
    )


def _digests(values: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_bytes(32, "big") for v in values), ">u8").astype(np.uint64).reshape(-1, 4)


def _as_bytes(digests: np.ndarray) -> list[bytes]:
    raw = digests.astype(">u8").tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


def _rebuilt(own: np.ndarray, run: dict) -> np.ndarray:
    """Which rows of a conversation's part are rebuilt turns: the borrowed ones and, after h of them, its own."""
    number = run["own_before"] + np.cumsum(own)
    return (own == 0) | (number > run["h"])


def runs(sharded: DataFrame) -> DataFrame:
    """One row for each part of a conversation: h, turns before, and what earlier and later parts hold.

    Only conversations that span parts (at most two for each part begin or end elsewhere) are put together from their parts.
    """
    by_part = Window.partitionBy("conv").orderBy("part")
    counted = (
        sharded.groupBy("part", "conv")
        .agg(F.sum("own").alias("n_own"))
        .withColumn("own_before", F.sum("n_own").over(by_part) - F.col("n_own"))
        .withColumn("is_first", F.col("part") == F.min("part").over(Window.partitionBy("conv")))
        .withColumn("is_last", F.col("part") == F.max("part").over(Window.partitionBy("conv")))
        .withColumn("h", borrowed(F.col("conv")))
    )
    counted = stored(counted, "runs")
    crossing = counted.where("not (is_first and is_last)")

    def partial(key, rows: pa.Table, known: pa.Table) -> pa.Table:
        found = _parts(rows.sort_by("at"), known)
        out = [(p.run["part"], p.conv, len(p.chars), _horner(0, p.digests), int(p.chars.sum())) for p in found]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        columns[3] = [v.to_bytes(32, "big") for v in columns[3]]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, partial_types, strict=True)], names=partial_names)

    partial_names = ["part", "conv", "n", "digest", "n_chars"]
    partial_types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    # at most two conversations of a part cross into another one
    some = sharded.join(F.broadcast(crossing.select("part", "conv")), ["part", "conv"])
    pieces = (
        some.select("part", "conv", "own", "n_chars", "digest", "at")
        .groupBy("part")
        .cogroup(crossing.groupBy("part"))
        .applyInArrow(partial, "part int, conv long, n long, digest binary, n_chars long")
    )

    def chain(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        n, chars, state = 0, 0, ROOT
        out = []
        total = sum(rows.column("n_chars").to_pylist())
        for piece in rows.to_pylist():
            out.append((piece["part"], piece["conv"], n, state.to_bytes(32, "big"), chars, total))
            n += piece["n"]
            chars += piece["n_chars"]
            state = (state * pow(BASE, piece["n"], MODULUS) + int.from_bytes(piece["digest"], "big")) % MODULUS
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), chain_types, strict=True)], names=chain_names)

    chain_names = ["part", "conv", "before", "state", "chars_before", "chars_total"]
    chain_types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    chained = pieces.groupBy("conv").applyInArrow(
        chain, "part int, conv long, before long, state binary, chars_before long, chars_total long"
    )
    return stored(counted.drop("n_own").join(chained, ["part", "conv"], "left"), "parts")


@dataclass
class Part:
    """Rebuilt turns of one conversation in one part."""

    conv: int
    run: dict
    digests: list[bytes]
    chars: np.ndarray


def _parts(rows: pa.Table, known: pa.Table) -> list[Part]:
    conv = rows.column("conv").to_numpy()
    own, chars = rows.column("own").to_numpy(), rows.column("n_chars").to_numpy()
    digests = rows.column("digest").to_pylist()
    run_of = {r["conv"]: r for r in known.to_pylist()}
    cuts = np.flatnonzero(np.diff(conv)) + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(conv)], strict=True):
        if a == b:
            continue
        run = run_of[int(conv[a])]
        keep = np.flatnonzero(_rebuilt(own[a:b], run)) + a
        out.append(Part(int(conv[a]), run, [digests[i] for i in keep], chars[keep]))
    return out


def _horner(state: int, digests: list[bytes]) -> int:
    for digest in digests:
        state = (state * BASE + int.from_bytes(digest, "big")) % MODULUS
    return state


@dataclass
class Shard:
    """A shard's prefixes, row by row (conversation after conversation, depth ascending), and its node table.

    `ends` are the last rows of conversations with rows here and `runs` what is known of those; `finished` are conversations
    whose last turn is here, with the digest they end at. A conversation that comes from an earlier part is counted there at the
    prefixes above its first row here; `entered` are the rows of such conversations and the slot above them, if another
    conversation gave that prefix a slot. The fields from `firsts` on are in slot order.
    """

    convs: np.ndarray
    depths: np.ndarray
    chars: np.ndarray
    upto: np.ndarray
    ends: np.ndarray
    runs: list[dict]
    finished: list[tuple[int, int]]
    entered: list[tuple[int, int, int]]
    slots: np.ndarray
    firsts: np.ndarray
    parents: np.ndarray
    digests: np.ndarray
    parent_digests: np.ndarray

    def nodes(self, values: np.ndarray) -> np.ndarray:
        """The rows' values in slot order (they agree among a node's rows)."""
        return values[self.firsts]

    def accumulated(self, weights: np.ndarray) -> np.ndarray:
        """Per slot: the weights of its rows and of all rows below, summed through parent slots in depth order."""
        sums = np.zeros(len(self.firsts), weights.dtype)
        np.add.at(sums, self.slots, weights)
        for first, end, slot in self.entered:
            if slot >= 0:
                sums[slot] -= weights[first : end + 1].sum()
        depths = self.nodes(self.depths)
        order = np.argsort(-depths, kind="stable")
        order = order[self.parents[order] >= 0]
        cuts = np.flatnonzero(np.diff(depths[order])) + 1
        for level in np.split(order, cuts):
            np.add.at(sums, self.parents[level], sums[level])
        return sums


def _shard(rows: pa.Table, known: pa.Table) -> Shard:
    """Prefix digests of a part's conversations, their slots and parent slots."""
    parts = _parts(rows.sort_by("at"), known)
    convs, depths, chars, upto, values, above = [], [], [], [], [], []
    ends, present, finished, entered = [], [], [], []
    for part in parts:
        run = part.run
        before = run["before"] or 0
        state = int.from_bytes(run["state"], "big") if run["state"] else ROOT
        total = run["chars_before"] or 0
        first = len(values)
        if run["is_first"]:
            values.append(ROOT)
            above.append(0)
            convs.append(part.conv)
            depths.append(0)
            chars.append(0)
            upto.append(0)
        for place, digest in enumerate(part.digests, 1):
            above.append(state)
            state = (state * BASE + int.from_bytes(digest, "big")) % MODULUS
            values.append(state)
            convs.append(part.conv)
            depths.append(before + place)
            total += int(part.chars[place - 1])
            chars.append(int(part.chars[place - 1]))
            upto.append(total)
        if len(values) > first:
            ends.append(len(values) - 1)
            present.append(run)
            if not run["is_first"]:
                entered.append((first, len(values) - 1))
        if run["is_last"]:
            finished.append((part.conv, state))
    digests, parent_digests = _digests(values), _digests(above)
    distinct, firsts = _distinct(digests)
    table = PerfectHash(distinct)
    slots = table.slots(digests)
    in_slot_order = np.empty(len(distinct), np.int64)
    in_slot_order[table.slots(distinct)] = firsts
    return Shard(
        np.array(convs, np.int64),
        np.array(depths, np.int64),
        np.array(chars, np.int64),
        np.array(upto, np.int64),
        np.array(ends, np.int64),
        present,
        finished,
        [(a, b, int(table.slots(parent_digests[a : a + 1])[0])) for a, b in entered],
        slots,
        in_slot_order,
        table.slots(parent_digests[in_slot_order]),
        table.digests,
        parent_digests[in_slot_order],
    )


def _distinct(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct digests and the first row of each."""
    order = np.lexsort(digests.T[::-1])
    ordered = digests[order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    return ordered[new], np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order


def _each_shard(sharded: DataFrame, known: DataFrame, schema: str, work: Callable[[Shard], pa.Table]) -> DataFrame:
    def run(key, rows: pa.Table, own: pa.Table) -> pa.Table:
        return work(_shard(rows, own))

    return sharded.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, schema)


_NODES = "node binary, parent binary, depth long, n_chars long, upto long, conv_id long, n_convs long, weighted long, end_of long"


def _counted(shard: Shard) -> pa.Table:
    """Partial nodes: members, the smallest one, and the lengths from the node on of all members. And a row (node, end_of) for
    every conversation that ends here."""
    ones, lengths = np.zeros(len(shard.convs), np.int64), shard.chars.copy()
    ones[shard.ends] = 1
    # a part counts a conversation's turns in later parts at its own last prefix
    totals = [r["chars_total"] for r in shard.runs]
    later = [0 if t is None else t - u for t, u in zip(totals, shard.upto[shard.ends].tolist(), strict=True)]
    lengths[shard.ends] += np.array(later, np.int64)
    least = np.full(len(shard.firsts), np.iinfo(np.int64).max)
    np.minimum.at(least, shard.slots, shard.convs)
    depths = shard.nodes(shard.depths)
    parents = pa.array(_as_bytes(shard.parent_digests), pa.binary())
    n, m = len(least), len(shard.finished)
    columns = [
        pa.array(_as_bytes(shard.digests) + [state.to_bytes(32, "big") for _, state in shard.finished], pa.binary()),
        pa.concat_arrays([pc.if_else(pa.array(depths > 0), parents, None), pa.nulls(m, pa.binary())]),
    ]
    for values in (
        depths, shard.nodes(shard.chars), shard.nodes(shard.upto), least, shard.accumulated(ones), shard.accumulated(lengths),
    ):
        columns.append(pa.concat_arrays([pa.array(values), pa.nulls(m, pa.int64())]))
    columns.append(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([c for c, _ in shard.finished], pa.int64())]))
    return pa.table(columns, names=[f.split()[0] for f in _NODES.split(", ")])


def _below(shard: Shard) -> pa.Table:
    """Partial leaves and lengths of distinct nodes below, both counted by the conversations that own them."""
    n = len(shard.convs)
    leaves, lengths = np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin = 0
    for end, run in zip(shard.ends.tolist(), shard.runs, strict=True):
        if run["owned_from"] is not None:
            rows = slice(begin, end + 1)
            lengths[rows] = np.where(shard.depths[rows] >= run["owned_from"], shard.chars[rows], 0)
            lengths[end] += run["owned_to"] - max(int(shard.upto[end]), run["not_owned"])
            leaves[end] = int(run["is_leaf"])
        begin = end + 1
    return pa.table(
        [pa.array(_as_bytes(shard.digests), pa.binary()), pa.array(shard.accumulated(leaves)), pa.array(shard.accumulated(lengths))],
        names=["node", "n_leaves", "once"],
    )


def ends_hashed(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of each node's conv_ids, ascending and comma-joined.

    The ids are sorted over range partitions and joined there, some thousands in a row; only these rows go through the one
    task in which a node's hash has to be computed in order.
    """
    ordered = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(nodes)) if not i or nodes[i] != nodes[i - 1]]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[a] for a in starts], pa.binary()), pa.array([ids[a] for a in starts], pa.int64()), pa.array(texts, pa.string())],
                names=["node", "first", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own == node:
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(text.encode())
            yield _pairs(out)
        if node is not None:
            yield _pairs([(node, state.hexdigest())])

    def _pairs(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["node", "ends_sha256"]
        )

    joined = ordered.mapInArrow(join, "node binary, first long, ids string").repartition("node").sortWithinPartitions("node", "first")
    return joined.mapInArrow(digest, "node binary, ends_sha256 string")


def node_table(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sharded = shards(turns(conversations), shard)
    known = runs(sharded)
    partial = stored(_each_shard(sharded, known, _NODES, _counted), "partial")
    nodes = (
        partial.where("end_of is null")
        .groupBy("node")
        .agg(
            *(F.min(c).alias(c) for c in ("parent", "depth", "n_chars", "upto", "conv_id")),
            F.sum("n_convs").alias("n_convs"),
            F.sum("weighted").alias("weighted"),
        )
    )
    nodes = stored(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stored(nodes, "counted")
    owners = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("owned_from"),
        F.min(F.col("upto") - F.col("n_chars")).alias("not_owned"),
        F.max("upto").alias("owned_to"),
        F.max(F.col("n_children") == 0).alias("is_leaf"),
    )
    below = _each_shard(sharded, known.join(owners, "conv", "left"), "node binary, n_leaves long, once long", _below)
    below = below.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("once").alias("once"))
    ends = ends_hashed(partial.where("end_of is not null").select("node", F.col("end_of").alias("conv_id")))
    root = nodes.where("depth = 0").select("conv_id").first()
    least = F.lit(root["conv_id"] if root else None).cast("long")
    # the root's children know their parent; another node with very many children is a skewed join, which AQE splits
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    rows = nodes.join(below, "node").join(ends, "node", "left").withColumn("parent", F.when(F.col("depth") > 1, F.col("parent")))
    return rows.join(above, "parent", "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 1, least).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("weighted") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
