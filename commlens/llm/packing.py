"""Concatenate and cut.

Pass one tokenizes each document, appends SEPARATOR, and writes the ids with their place in their task; the tasks' token totals,
one row for each task, are summed up to the offset of each task in the one long row of all tokens. Pass two cuts that row into
windows of `size` tokens. A document that crosses a window's edge gives several pieces. Only the last sequence is not full.

Order: by task, then by row as read; the written table fixes it, so retries and later reads agree. Repeated rows and repeated or null
doc_ids are packed as they come. A null or empty text is just the separator. An empty table gives no pieces.

A text may hold the vocabulary's markers, such as "<|endoftext|>". With special_tokens, each becomes its own id, as in the tokenizer's
default; without, markers are text like any other.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_slices, stored, tidy

SIZE = 2048
SEPARATOR = 1
#: Words whose ids a worker remembers (about 120 MB), pieces of words across tasks and within one (60 and 15 MB), and bytes of text
#: held at once. They bound memory and never change a result.
KNOWN_WORDS, KNOWN_PIECES, PIECES_OF_A_TASK, HELD = 800_000, 400_000, 100_000, 1 << 20
VOCABULARY = "word_bpe_49k.json"

#: How the tokenizer splits a text before its merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters are split here; any other word goes through the tokenizer whole.
SIMPLE = regex.compile(r"[\x21-\x7eÀ-ÿ]+")
#: All markers of the vocabulary begin so; texts that hold it go through the tokenizer whole if markers are to be found.
MARKER = "<|"
#: Characters that str.split() takes for white space and the tokenizer does not.
NOT_SPACE = regex.compile(r"[\x1c-\x1f]")


class Encoder:
    """Ids of a text. A word's ids do not depend on its neighbours, so each is encoded once and remembered."""

    def __init__(self, path: str, special_tokens: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special_tokens
        self.marker = MARKER if special_tokens else None
        self.model = self.whole.model
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most_pieces = KNOWN_PIECES
        # byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        self.letters = [chr(b if b in plain else next(others)) for b in range(256)]

    def forget(self) -> None:
        """Free what a task remembered: an idle worker holds the vocabulary only."""
        self.known, self.pieces = {}, {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= self.most_pieces:
                self.pieces.clear()
            letters = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            ids = [t.id for t in self.model.tokenize(letters)]
            found = self.pieces[piece] = np.array(ids, "<u2").tobytes()
        return found

    def _word(self, word: str) -> bytes:
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        if SIMPLE.fullmatch(word):
            word_ids = b"".join(map(self._piece, PIECES.findall(word.lower())))
        else:
            word_ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        self.known[word] = word_ids
        return word_ids

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 16-bit numbers (the vocabulary has fewer than 65,536)."""
        if self.marker and self.marker in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if NOT_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        get, make = self.known.get, self._word
        return b"".join([x if (x := get(w)) is not None else make(w) for w in text.split()])


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_tokens: bool) -> Encoder:
    """One for each Python worker: the vocabulary is read once."""
    key = path, special_tokens
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def tokenized(documents: DataFrame, path: str, special_tokens: bool = False, remember: bool = True) -> DataFrame:
    """part, start (in the part), doc_id, doc_tokens, ids (16 bits each)."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, total = encoder(path, special_tokens), TaskContext.get().partitionId(), 0
        known.most_pieces = KNOWN_PIECES if remember else PIECES_OF_A_TASK
        end = np.array([SEPARATOR], "<u2").tobytes()
        last, last_ids = "", end
        for batch in (some for whole in batches for some in in_slices(whole, 1, HELD)):
            ids = []
            for text in batch.column(1).to_pylist():
                # a document that mixing repeats comes several times in a row
                if (text or "") != last:
                    last = text or ""
                    last_ids = known.ids(last) + end
                ids.append(last_ids)
            sizes = np.array([len(x) // 2 for x in ids], np.int64)
            starts = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), batch.column(0), pa.array(sizes), pa.array(ids, pa.binary())],
                names=["part", "start", "doc_id", "doc_tokens", "ids"],
            )
        if not remember:
            known.forget()

    schema = f"part int, start long, doc_id {id_type}, doc_tokens long, ids binary"
    return stored(documents.select("doc_id", "text").mapInArrow(tidy(encode), schema), "tokens")


def packed(
    documents: DataFrame,
    size: int = SIZE,
    path: str | None = None,
    with_ids: bool = True,
    special_tokens: bool = False,
    remember: bool = True,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array) if asked for.

    A worker remembers the words of its earlier tasks, which is faster; in a job with other Python stages, `remember` = False gives that
    memory back after each task.
    """
    tokens = tokenized(documents, path or public_tokenizers.path(VOCABULARY), special_tokens, remember)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task of pass one, and never more
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select(
        "doc_id", "doc_tokens", (F.col("base") + F.col("start")).alias("at"), "ids"
    )
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            row, start, length, crc, sequence, offset, parts = [], [], [], [], [], [], []
            for i, (raw, place) in enumerate(zip(ids, at, strict=True)):
                own = np.frombuffer(raw, "<u2").astype("<u4")
                done = 0
                while done < len(own):
                    inside = (place + done) % size
                    n = min(size - inside, len(own) - done)
                    piece = own[done : done + n]
                    row.append(i)
                    start.append(done)
                    length.append(n)
                    crc.append(zlib.crc32(piece))
                    sequence.append((place + done) // size)
                    offset.append(inside)
                    if with_ids:
                        parts.append(piece.astype(np.int32))
                    done += n
            rows = pa.array(row, pa.int64())
            columns = [batch.column(0).take(rows), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            columns += [pa.array(crc, pa.int64()), batch.column(1).take(rows)]
            columns += [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(tidy(cut), schema + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, its ids (at most `size`) and the doc_ids of its pieces."""
    return pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p")).select(
        "sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )
