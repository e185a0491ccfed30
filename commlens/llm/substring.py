"""Repeated passages by recompression.

Words are 64-bit hashes. A text is parsed like this: each run of one word becomes a symbol; then, in LEVELS rounds, each symbol
tosses a coin that depends on its name only, and a "heads" symbol followed by a "tails" symbol becomes one new symbol. Names are hashes
of what they stand for, so they agree in all documents and rounds without a table of names. Two different stretches with one name cost
candidates, never a wrong result: what is equal is decided by the words. Symbols of runs take no part in pairs.

Equal passages are parsed alike except near their ends: a round changes at most one symbol at each end, of at most 2^round words, and
the run step one word; so all symbols of a window of SIZE words that lie MARGIN words or more inside it are the same wherever the
window occurs (runs apart). A window's anchor is the longest pair of neighbours among these, or else the longest of them, the largest
name deciding ties, then the leftmost. Every window with this anchor holds the MARGIN words before and after it, too: the hash of all
these words is the window's mark. Windows that are equal have equal marks; a window whose mark occurs in one document only is not
repeated. The others, and those without a symbol inside, are verified:

1. Neighbouring windows with one mark are a stretch of the text, of at most STRETCH windows. Stretches are grouped by the digest of
   their words, so a passage that is repeated in full is one group for each of its stretches, however often it occurs.
2. One stretch of each group is cut into windows, and these are grouped by the digests of their words. What is found goes back to all
   occurrences of the stretch.

Digests are the first 16 bytes of the SHA-256 of the words joined by spaces: with 10^13 windows, two different ones are equal with a
probability of about 10^-13. Digests of many rows are joined by broadcasting them: there are fewer than HOT.

A window is removed if its words also start in a document with a smaller doc_id. Of documents with equal word sequences, the one with
the smallest doc_id stands for all: the others are removed whole, if they have SIZE words. A null text has no words; fewer than SIZE
words give no window. Rows with a null doc_id are neither compared nor cut. Rows that share a doc_id are one document for comparing (none
is cut because of another) and each is cut for itself. An empty table gives an empty result. Columns other than doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordHashes, in_slices, mix, stored, tidy, words

SIZE, LEVELS = 50, 4
MARGIN = 1 << LEVELS
#: GOLDEN's inverse modulo 2^64.
INVERSE = np.uint64(pow(int(GOLDEN), -1, 1 << 64))
#: Windows of a stretch, at most.
STRETCH = 64
#: A digest with more than one of HOT rows is joined by broadcast.
HOT = 2000
#: Bytes of text, or of compressed text, that a task parses at once.
SLICE, PACKED_SLICE = 1 << 20, 1 << 18
EMPTY = hashlib.sha256(b"").hexdigest()


def parse(hashes: np.ndarray, barrier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, names of the symbols, and whether they are runs. Places of `barrier` belong to no text and join no symbol."""
    n = len(hashes)
    barrier = np.zeros(n, bool) if barrier is None else barrier
    start = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | barrier[1:] | barrier[:-1])))
    end = np.append(start[1:], n)
    length = end - start
    run = (length > 1) | barrier[start]
    name = np.where(run, mix(hashes[start] + length.astype(np.uint64) * GOLDEN), hashes[start])
    for level in range(LEVELS):
        coin = (mix(name + np.array([level + 1], np.uint64) * GOLDEN) & np.uint64(1)).astype(bool) & ~run
        heads = ~coin & ~run
        first = np.flatnonzero(heads[:-1] & coin[1:])
        name = name.copy()
        name[first] = mix(mix(name[first] + np.uint64(level)) * GOLDEN + name[first + 1])
        end = end.copy()
        end[first] = end[first + 1]
        stay = np.ones(len(name), bool)
        stay[first + 1] = False
        start, end, name, run = start[stay], end[stay], name[stay], run[stay]
    return start, end, name, run


def anchors(hashes: np.ndarray, barrier: np.ndarray | None = None) -> np.ndarray:
    """The mark of each window; 0 for a window without an anchor."""
    start, end, name, run = parse(hashes, barrier)
    # sums of hashes times powers: divided by the power of its start, a difference depends on the stretch's words only
    n = len(hashes)
    power, inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (GOLDEN, INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * power[:n], dtype=np.uint64)))

    def marks(start: np.ndarray, end: np.ndarray, name: np.ndarray, run: np.ndarray) -> np.ndarray:
        low, high = np.maximum(start - MARGIN, 0), np.minimum(end + MARGIN, n)
        value = mix((sums[high] - sums[low]) * inverse[low] + (end - start).astype(np.uint64)) | np.uint64(1)
        return np.append(value, np.uint64(0))[_longest(n, start, end, name, run)]

    best = marks(start[:-1], end[1:], mix(name[:-1] * GOLDEN + name[1:]), run[:-1] | run[1:])
    none = best == 0
    if none.any():
        best[none] = marks(start, end, name, run)[none]
    return best


def anchors_of(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The marks of several texts of SIZE words or more, parsed in one go with a barrier after each."""
    if not parts:
        return []
    size = np.array([len(p) for p in parts])
    first = np.cumsum(size + 1) - size - 1
    whole = np.zeros(int(size.sum()) + len(parts), np.uint64)
    for a, part in zip(first.tolist(), parts, strict=True):
        whole[a : a + len(part)] = part
    barrier = np.zeros(len(whole), bool)
    barrier[first + size] = True
    marks = anchors(whole, barrier)
    return [marks[a : a + n - SIZE + 1] for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def _longest(n_words: int, start: np.ndarray, end: np.ndarray, name: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each window the longest symbol well inside it, by largest name, then the leftmost; -1 without one."""
    n = n_words - SIZE + 1
    best = np.full(n, -1)
    if not len(start):
        return best
    rank = ((end - start).astype(np.uint64) << np.uint64(56)) | (name >> np.uint64(8))
    rank[run] = 0
    first = np.arange(n)
    low = np.searchsorted(start, first + MARGIN)
    high = np.searchsorted(end, first + SIZE - MARGIN, side="right")
    count = high - low
    # largest of 1, 2, 4, ... symbols; two of these stretches cover a window's symbols
    width, table = 1, np.arange(len(rank))
    while True:
        some = np.flatnonzero((count >= width) & (count < 2 * width))
        best[some] = _larger(rank, table[low[some]], table[high[some] - width])
        if 2 * width > len(table) or not (count >= 2 * width).any():
            break
        table = np.concatenate((_larger(rank, table[:-width], table[width:]), table[-width:]))
        width *= 2
    best[(best >= 0) & (rank[best] == 0)] = -1
    return best


def _larger(rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.where(rank[left] >= rank[right], left, right)


def _digest(flat: bytes) -> bytes:
    return hashlib.sha256(flat).digest()[:16]


def _offsets(found: list[bytes]) -> np.ndarray:
    """Where each word starts in the words joined by spaces, and one past the end of that text."""
    return np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in (piece for whole in batches for piece in in_slices(whole, 1, SLICE)):
        own = [words(text) for text in batch.column(1).to_pylist()]
        found, open_ended = [[]] * len(own), [False] * len(own)
        large = [i for i, w in enumerate(own) if len(w) >= SIZE]
        for i, marks in zip(large, anchors_of([hashes.of(own[i]) for i in large]), strict=True):
            some = np.unique(marks[np.concatenate(([True], marks[1:] != marks[:-1]))])
            open_ended[i] = bool(some[0] == 0)
            found[i] = some[some > 0].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(w) for w in own], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).digest() for w in own], pa.binary()),
                pa.array(found, pa.list_(pa.int64())),
                pa.array(open_ended, pa.bool_()),
            ],
            names=["doc_id", "n_words", "digest", "anchors", "open_ended"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with a window, the digest and the compressed words: this is what shuffles move."""
    packer = zstandard.ZstdCompressor()
    for batch in (piece for whole in batches for piece in in_slices(whole, 1, SLICE)):
        at, digest, packed = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = words(text)
            if len(own) >= SIZE:
                flat = b" ".join(own)
                at.append(i)
                digest.append(hashlib.sha256(flat).digest())
                packed.append(packer.compress(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at, pa.int64())), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())],
            names=["doc_id", "digest", "packed"],
        )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, row, doc_id, first window and number of windows of the stretches whose mark is shared, or that have none."""
    hashes, unpacker = WordHashes(), zstandard.ZstdDecompressor()
    for batch in (piece for whole in batches for piece in in_slices(whole, 3, PACKED_SLICE)):
        texts = [unpacker.decompress(packed) for packed in batch.column(3).to_pylist()]
        own = [flat.split() for flat in texts]
        digest, at, places, sizes = [], [], [], []
        for i, marks in enumerate(anchors_of([hashes.of(w) for w in own])):
            known = np.array(batch.column(2)[i].as_py() or [], np.int64)
            cut = np.concatenate(([True], marks[1:] != marks[:-1]))
            first = np.flatnonzero(cut)
            # long stretches are cut every STRETCH windows from their own start
            since = np.arange(len(marks)) - first[np.cumsum(cut) - 1]
            first = np.flatnonzero(since % STRETCH == 0)
            end = np.append(first[1:], len(marks))
            some = (marks[first] == 0) | np.isin(marks[first].view(np.int64), known)
            first, end = first[some], end[some]
            byte = _offsets(own[i])
            flat = texts[i]
            digest += [_digest(flat[a:b]) for a, b in zip(byte[first].tolist(), (byte[end + SIZE - 1] - 1).tolist(), strict=True)]
            at.append(np.full(len(first), i))
            places.append(first)
            sizes.append(end - first)
        of = pa.array(np.concatenate(at))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(digest, pa.binary()),
                batch.column(0).take(of),
                batch.column(1).take(of),
                pa.array(np.concatenate(places).astype(np.int32)),
                pa.array(np.concatenate(sizes).astype(np.int32)),
            ],
            names=["stretch", "row", "doc_id", "first", "size"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of stretches: digest, stretch, place in the stretch; and the stretch's smallest and largest doc_id and rows."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in (piece for whole in batches for piece in in_slices(whole, 0, PACKED_SLICE)):
        lists = batch.column(1)
        fields = lists.values if isinstance(lists, pa.ListArray) else lists.flatten()
        bounds = lists.offsets.to_numpy()
        first, size = (fields.field(c).to_numpy() for c in ("first", "size"))
        digest, of, place = [], [], []
        for i, packed in enumerate(batch.column(0).to_pylist()):
            flat = unpacker.decompress(packed)
            byte = _offsets(flat.split())
            begin, end = byte[:-SIZE].tolist(), (byte[SIZE:] - 1).tolist()
            for j in range(bounds[i], bounds[i + 1]):
                a, n = int(first[j]), int(size[j])
                digest += [_digest(flat[x:y]) for x, y in zip(begin[a : a + n], end[a : a + n], strict=True)]
                of.append(np.full(n, j))
                place.append(np.arange(n, dtype=np.int32))
        at = pa.array(np.concatenate(of))
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.binary()), fields.field("stretch").take(at), pa.array(np.concatenate(place))]
            + [fields.field(c).take(at) for c in ("least", "most", "rows")],
            names=["window", "stretch", "place", "least", "most", "rows"],
        )


def meet(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left joined by key with right, which has `n`, the rows of left (of `total`) with that key.

    Keys with more than a HOT-th of the rows, so fewer than HOT, are broadcast; no other key is large."""
    frequent = F.col("n") > max(total // HOT, HOT)
    often = F.broadcast(right.where(frequent).select(F.col(key).alias("_often"), F.struct(*right.columns).alias("_found")))
    marked = left.join(often, left[key] == F.col("_often"), "left")
    more = [c for c in right.columns if c != key]
    hot = marked.where("_often is not null").select(*left.columns, *(F.col("_found")[c].alias(c) for c in more))
    cold = marked.where("_often is null").select(*left.columns).join(right.where(~frequent), key)
    return hot.unionByName(cold.select(*left.columns, *more))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the kept words, their text, and the removed runs of words."""
    unpacker = zstandard.ZstdDecompressor()
    for batch in (piece for whole in batches for piece in in_slices(whole, 2, PACKED_SLICE)):
        out = []
        for packed, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own = unpacker.decompress(packed).split()
            edge = np.zeros(len(own) + 1, np.int64)
            places = [p for some in places for p in some]
            np.add.at(edge, np.array(places), 1)
            np.add.at(edge, np.array(places) + SIZE, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, x in zip(own, gone.tolist(), strict=True) if not x])
            turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            runs = [{"first": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
            out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), runs))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.string()),
                pa.array([x[2] for x in out], pa.string()),
                pa.array([x[3] for x in out], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
            ],
            names=["doc_id", "digest", "n_cut", "cut_sha256", "cut_text", "cut_runs"],
        )


def repeats(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, removed (runs of words, first and end), kept_text.

    kept_text is set for rows that are cut in part only: other texts are untouched or empty, and are not moved.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    parsed = stored(
        documents.select("doc_id", "text").mapInArrow(
            tidy(_parsed), f"doc_id {kind}, n_words long, digest binary, anchors array<long>, open_ended boolean"
        ).withColumn("entry", F.monotonically_increasing_id()),
        "parsed",
    )
    known = parsed.where(f"doc_id is not null and n_words >= {SIZE}")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("least"))
    base = parsed.select("doc_id", "n_words", "digest").join(first, "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= SIZE)

    # symbols of the first of each group of copies that occur in other documents too
    first = first.withColumnRenamed("digest", "of")
    single = known.join(first, (known["digest"] == first["of"]) & (known["doc_id"] == first["least"]), "left_semi")
    marks = single.select("entry", "doc_id", F.explode("anchors").alias("anchor"))
    shared = marks.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("anchor")
    found = marks.select("entry", "anchor").join(shared, "anchor", "left_semi").select("entry", "anchor")
    found = found.unionByName(single.where("open_ended").select("entry", F.lit(None).cast("long").alias("anchor")))
    found = found.groupBy("entry").agg(F.collect_set("anchor").alias("shared"))  # of one document's own symbols
    found = known.select("entry", "doc_id", "digest").join(found, "entry").drop("entry")
    found = found.dropDuplicates(["doc_id", "digest"])
    texts = documents.select("doc_id", "text").where("doc_id is not null")
    texts = texts.mapInArrow(tidy(_packed), f"doc_id {kind}, digest binary, packed binary")
    joined = texts.join(found, ["doc_id", "digest"])
    suspects = stored(
        joined.select(F.monotonically_increasing_id().alias("row"), "doc_id", "shared", "packed", "digest"), "suspects"
    )
    stretches = stored(
        suspects.select("row", "doc_id", "shared", "packed").mapInArrow(
            tidy(_stretches), f"stretch binary, row long, doc_id {kind}, first int, size int"
        ),
        "stretches",
    )
    # equal words have equal sizes, and any occurrence in the smallest row will do
    distinct = stretches.groupBy("stretch").agg(
        F.min("row").alias("row"), F.min_by("first", "row").alias("first"), F.min("size").alias("size"),
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("rows"),
    )
    distinct = distinct.groupBy("row").agg(F.collect_list(F.struct("stretch", "first", "size", "least", "most", "rows")).alias("some"))
    windows = stored(
        suspects.select("row", "packed").join(distinct, "row").select("packed", "some").mapInArrow(  # of one document's own stretches
            tidy(_windows), f"window binary, stretch binary, place int, least {kind}, most {kind}, rows long"
        ),
        "windows",
    )
    twice = windows.groupBy("window").agg(F.min("least").alias("x"), F.max("most").alias("y"), F.count(F.lit(1)).alias("n"))
    hits = meet(windows, twice.where("x < y").drop("y"), "window", windows.count()).where("most > x")
    # at most STRETCH windows of each
    hits = hits.groupBy("stretch").agg(F.max("rows").alias("n"), F.collect_list(F.struct("place", "x")).alias("hits"))
    own = meet(stretches.select("stretch", "row", "doc_id", "first"), hits, "stretch", stretches.count())
    own = own.select("row", F.expr("transform(filter(hits, h -> h.x < doc_id), h -> first + h.place)").alias("some")).where("size(some) > 0")
    places = own.groupBy("row").agg(F.collect_list("some").alias("places"))  # of one document's own windows
    cut = (
        suspects.join(places, "row")
        .select("doc_id", "digest", "packed", "places")
        .mapInArrow(
            tidy(_cut),
            f"doc_id {kind}, digest binary, n_cut long, cut_sha256 string, cut_text string, "
            "cut_runs array<struct<first:int,end:int>>",
        )
        .dropDuplicates(["doc_id", "digest"])
    )
    cut = cut.withColumnsRenamed({"doc_id": "cut_id", "digest": "cut_digest"})
    rows = base.join(cut, (base["doc_id"] == cut["cut_id"]) & (base["digest"] == cut["cut_digest"]), "left")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("end")))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("cut_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("cut_runs", F.expr("cast(array() as array<struct<first:int,end:int>>)"))).alias("removed"),
        F.when(~copy, F.col("cut_text")).alias("kept_text"),
    )
