"""Best-fit packing by hierarchical residual packing.

Every document becomes its token ids and SEPARATOR. Only a document of more than `size` ids is cut: into pieces of `size`, the
first of which may be shorter. A piece of `size` is a sequence of its own. The other pieces are items: they are dealt to blocks of
about `block` items by a hash of their row, and each block is packed by best fit, longest item first. Nearly full bins (residual
below NEAR) are final. The others, "underfull", are items themselves in the next rounds, which merge FAN groups into one and
again put each into the fullest bin that takes it, until one group is left.

What a round hands on is bounded. Best fit leaves at most one bin of a group filled to half: two of them would have been put together. So a
merge has at most FAN bins that can move, and no two bins above half fit together. Of equally full bins above half at most
FAN can receive one in each round; those beyond FAN times the number of rounds are final as well, which changes no result. A group
therefore hands on at most half of `size` times that many rows, at any size of the corpus. At most one bin of a group moves in a round, so the table of
moves has fewer rows than there are blocks, and is broadcast.

Ids are those of the unchanged tokenizer file with add_special_tokens=False, so a marker in a text is one id. Texts of ordinary
characters are encoded from the same vocabulary as ranks, which gives equal ids several times as fast.

Repeated rows and repeated or null doc_ids are packed as they come; a null or empty text is just the separator. An empty table gives an
empty result. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, stored

SIZE = 2048
SEPARATOR = 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Items a block should hold, groups merged into one, and the residual below which a bin is nearly full.
BLOCK, FAN, NEAR = 1 << 17, 8, 16
#: Both encoders agree on other characters than these; a text with one goes through the tokenizer file itself.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e¡-ſ‐-‧€]")
#: Long runs are slow to merge by ranks.
LONG, SPACES = 800, re.compile(r"\s{800}")
MARKER = "<|"
#: Bytes of text a task holds as Python strings.
HELD = 1 << 20


class Encoder:
    """Ids of a text, as numpy array of 16-bit numbers (the vocabulary has fewer than 65,536)."""

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        plain = self.quick and not UNUSUAL.search(text) and MARKER not in text
        if plain and max(map(len, text.split()), default=0) < LONG and not SPACES.search(text):
            return np.array(self.quick.encode_ordinary(text), "<u2")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2")


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder_of(path: str, ranks: str | None) -> Encoder:
    """One for each Python worker: reading a vocabulary takes as long as encoding a few MB."""
    key = path, ranks
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def pieces(documents: DataFrame, size: int, path: str, ranks: str | None, with_ids: bool) -> DataFrame:
    """part, row (a piece's number in its task), doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, rows = encoder_of(path, ranks), TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in in_slices(batch, 1, HELD):
                owner, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    ids = np.append(encoder.ids(text or ""), np.uint16(SEPARATOR))
                    at, number = 0, 0
                    while at < len(ids):
                        n = min((len(ids) - at) % size or size, len(ids) - at)
                        own = ids[at : at + n]
                        owner.append(i)
                        piece.append(number)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(own.astype("<u4")))
                        if with_ids:
                            raw.append(own.astype(np.int32))
                        at, number = at + n, number + 1
                columns = [pa.array(np.full(len(owner), part, np.int32)), pa.array(np.arange(rows, rows + len(owner)))]
                columns += [some.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
                columns += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                columns += [pa.array(raw, pa.list_(pa.int32()))] * with_ids
                rows += len(owner)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "row", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"part int, row long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return stored(documents.select("doc_id", "text").mapInArrow(cut, schema), "pieces")


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit of the lengths in their order: each one's bin and offset, and every bin's fill."""
    residuals: dict[int, list[int]] = {}
    mask, fills, bins, offsets = 0, [], [], []
    for length in lengths:
        fitting = mask >> length
        if fitting:
            residual = length + (fitting & -fitting).bit_length() - 1
            stack = residuals[residual]
            chosen = stack.pop()
            if not stack:
                mask ^= 1 << residual
        else:
            residual, chosen = size, len(fills)
            fills.append(0)
        bins.append(chosen)
        offsets.append(size - residual)
        residual -= length
        fills[chosen] = size - residual
        if residual:
            residuals.setdefault(residual, []).append(chosen)
            mask |= 1 << residual
    return bins, offsets, fills


def handed_on(fills: list[int], size: int, rounds: int) -> np.ndarray:
    """Which bins a later round may need: underfull, and of equal ones above half no more than it can use."""
    fills = np.asarray(fills, np.int64)
    order = np.argsort(fills, kind="stable")
    place = np.arange(len(fills)) - np.searchsorted(fills[order], fills[order])
    surplus = np.empty(len(fills), bool)
    surplus[order] = place >= FAN * rounds
    return (fills <= size - NEAR) & ~(surplus & (2 * fills > size))


def rounds_for(blocks: int) -> int:
    rounds = 0
    while blocks > 1:
        blocks, rounds = -(-blocks // FAN), rounds + 1
    return rounds


def packed_blocks(items: DataFrame, size: int, blocks: int) -> DataFrame:
    """items with block, bin, offset, and at each bin's first item its fill, if a later round needs the bin."""
    rounds = rounds_for(blocks)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not tables:
            return
        block = TaskContext.get().partitionId()
        rows = pa.Table.from_batches(tables).sort_by([("length", "descending"), ("part", "ascending"), ("row", "ascending")])
        bins, offsets, fills = best_fit(rows.column("length").to_pylist(), size)
        bins, offsets = np.asarray(bins, np.int64), np.asarray(offsets, np.int64)
        open_bin = handed_on(fills, size, rounds)[bins] & (offsets == 0)
        rows = rows.append_column("block", pa.array(np.full(len(bins), block, np.int32)))
        rows = rows.append_column("bin", pa.array((np.int64(block) << np.int64(32)) + bins))
        rows = rows.append_column("offset", pa.array(offsets))
        rows = rows.append_column("fill", pa.array(np.asarray(fills, np.int64)[bins], mask=~open_bin))
        yield from rows.to_batches(max_chunksize=1 << 14)

    schema = items.schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    dealt = items.repartition(blocks, "part", "row")
    return stored(dealt.mapInArrow(pack, schema + ", block int, bin long, offset long, fill long"), "blocks")


def merged_round(bins: DataFrame, size: int, left: int) -> DataFrame:
    """One round over bins(group, bin, fill): the same for the merged groups, with `target` and `shift` for bins that moved."""

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("fill", "descending"), ("bin", "ascending")])
        chosen, offsets, fills = best_fit(rows.column("fill").to_pylist(), size)
        names = rows.column("bin").to_numpy()
        firsts = np.zeros(len(fills), np.int64)
        chosen, offsets = np.asarray(chosen, np.int64), np.asarray(offsets, np.int64)
        stays = offsets == 0
        firsts[chosen[stays]] = names[stays]
        useful = handed_on(fills, size, left)[chosen]
        keep = ~stays | useful
        return pa.table(
            {
                "group": rows.column("group"),
                "bin": rows.column("bin"),
                "fill": pa.array(np.asarray(fills, np.int64)[chosen], mask=~stays),
                "target": pa.array(firsts[chosen], mask=stays),
                "shift": pa.array(offsets, mask=stays),
            }
        ).filter(pa.array(keep))

    merged = bins.select(F.floor(F.col("group") / FAN).cast("int").alias("group"), "bin", "fill")
    return stored(merged.groupBy("group").applyInArrow(merge, "group int, bin long, fill long, target long, shift long"), "merged")


def merged_bins(placed: DataFrame, size: int, blocks: int) -> DataFrame | None:
    """from_bin, target, shift of the bins that tree-merging moved into others; None where there is one block only."""
    bins = placed.where("fill is not null").select(F.col("block").alias("group"), "bin", "fill")
    moves = None
    for left in reversed(range(rounds_for(blocks))):
        found = merged_round(bins, size, left)
        new = found.where("target is not null").select(F.col("bin").alias("from_bin"), "target", "shift")
        if moves is not None:
            later = new.select(F.col("from_bin").alias("target"), F.col("target").alias("last"), F.col("shift").alias("more"))
            moves = moves.join(later, "target", "left").select(
                "from_bin",
                F.coalesce("last", "target").alias("target"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            )
        moves = new if moves is None else moves.unionByName(new)
        bins = found.where("target is null").select("group", "bin", "fill")
    return moves


def packed(
    documents: DataFrame,
    size: int = SIZE,
    path: str | None = None,
    ranks: str | None = None,
    with_ids: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (array) if asked for.

    `path` is a tokenizer file, `ranks` the same vocabulary as ranks; with another `path` and no `ranks` only the file is used.
    """
    if path is None:
        path, ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
    cut = pieces(documents, size, path, ranks, with_ids)
    narrow = cut.drop("ids")
    columns = ["part", "row", "doc_id", "piece", "start", "length", "ids_crc32"]
    items = narrow.where(F.col("length") < size)
    blocks = max(1, -(-items.count() // block))
    placed = packed_blocks(items, size, blocks)
    sequence, offset = F.col("bin"), F.col("offset")
    moves = merged_bins(placed, size, blocks)
    if moves is not None:
        # fewer rows than there are blocks
        placed = placed.join(F.broadcast(moves), F.col("bin") == F.col("from_bin"), "left")
        sequence = F.coalesce("target", "bin")
        offset = F.col("offset") + F.coalesce("shift", F.lit(0))
    own = -(F.shiftleft(F.col("part").cast("long"), 36) + F.col("row")) - 1
    full = narrow.where(F.col("length") == size).select(*columns, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = placed.select(*columns, sequence.alias("sequence_id"), offset.alias("offset")).unionByName(full)
    result = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not with_ids:
        return rows.select(*result)
    return rows.join(cut.select("part", "row", "ids"), ["part", "row"]).select(*result, "ids")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, its ids (at most `size`) and the doc_ids of its pieces, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p")
    return packed_pieces.groupBy("sequence_id").agg(parts).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )
