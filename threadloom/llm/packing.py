"""Operator 1, best-fit packing of token pieces into sequences.

Best-fit decreasing treats pieces of one length alike, so the whole decision depends on the
histogram of lengths: at most ``capacity`` numbers, whatever the corpus. The driver runs exact
best-fit decreasing over that histogram with a segment tree over remaining capacities (a whole run
of equal bins is filled at once); the plan it gives maps (length, rank among pieces of this length)
to (sequence, offset). Ranks are distributed: rows are salted, counted per (length, salt), and
numbered inside each salt, so that a length that a third of all pieces share is no hot key.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import WordCache, worker_state, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The longest word in bytes that is kept with its ids in a Python worker.
CACHED_BYTES = 64
#: What an entry takes besides its bytes: two objects' heads, and its share of a table that is half full.
ENTRY_BYTES = 170
_ENDS = b".,;:!?)"


def _byte_letters() -> list[str]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable Latin-1 bytes stand
    for themselves, the others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(rest.get(b, b)) for b in range(256)]


class WordIds(WordCache):
    """Token ids of a word as little-endian 32-bit bytes. White space never joins two words' tokens,
    so a text's ids are those of its words in turn. A word's ids are those of its letters followed by
    those of its last punctuation mark, since the vocabulary's rule parts letters from marks."""

    most = 64 << 20

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters go straight to the model, as do others that no normal form changes
            ids = array("I", [t.id for t in self.model.tokenize(word.lower().decode())]).tobytes()
        elif word[-1] in _ENDS and word[-2:-1].isalpha() and b"<" not in word:
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            text = word.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0130":
                found = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, text.lower().encode())))]
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = array("I", found).tobytes()
        if len(word) <= CACHED_BYTES:
            self.bytes += len(word) + len(ids) + ENTRY_BYTES
            if self.bytes > self.most:
                self.clear()
                self.bytes = 0
            self[word] = ids
        return ids

    def of(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if b"<|" not in text:  # else case may matter: special tokens are found before letters are lowered
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(tokenizer: str) -> WordIds:
    """One per Python worker and vocabulary. ``tokenizer`` is a file, or the bare name of one of the
    installed public vocabularies."""

    def make() -> WordIds:
        if "/" in tokenizer:
            return WordIds(tokenizer)
        import public_tokenizers

        return WordIds(str(public_tokenizers.path(tokenizer)))

    return worker_state("packing", tokenizer, make)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Ids of each document followed by ``end_id``, cut into pieces of at most ``capacity``.

    A null text counts as empty and gives the one-token piece ``end_id``; repeated rows give repeated
    pieces.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for b in it:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = memoryview(words.of(text.as_py()) + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while bins with that
    remainder are open. ``first(s)`` gives the tightest remainder that still holds s."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, r: int, there: bool) -> None:
        k = r + self.size
        self.any[k] = there
        while k > 1:
            k >>= 1
            now = self.any[2 * k] | self.any[2 * k + 1]
            if self.any[k] == now:
                break
            self.any[k] = now

    def first(self, s: int) -> int | None:
        k = s + self.size
        if self.any[k]:
            return s
        while k > 1:
            if not k & 1 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, pieces a bin, offset) of best-fit decreasing, and the
    number of bins. Runs of bins with equal contents are filled together."""
    tree, open_bins, bins, rows = CapacityTree(capacity), {}, 0, []

    def add(r: int, start: int, count: int) -> None:
        if r and count:
            if not open_bins.setdefault(r, []):
                tree.put(r, True)
            open_bins[r].append((start, count))

    for s in sorted(histogram, reverse=True):
        done, n = 0, histogram[s]
        while done < n:
            r = tree.first(s)
            if r is None:
                r, start, count = capacity, bins, -(-(n - done) // (capacity // s))
                bins += count
            else:
                start, count = open_bins[r].pop()
                if not open_bins[r]:
                    tree.put(r, False)
            k = r // s
            full = min(count, (n - done) // k)
            if full:
                rows.append((s, done, start, k, capacity - r))
                add(r - k * s, start, full)
                done += full * k
            if full < count:
                if rest := n - done:
                    rows.append((s, done, start + full, rest, capacity - r))
                    add(r - rest * s, start + full, 1)
                    full, done = full + 1, n
                add(r, start + full, count - full)
    return np.asarray(rows, np.int64).reshape(-1, 5), bins


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32). ``pieces`` is
    read more than once: hand over a written table. No row gives no row."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = best_fit_plan(histogram, capacity)
    salts = 256
    while sum(histogram.values()) > salts << 20:
        salts *= 2
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))

    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (plan[:, 0] << 48) | plan[:, 1]
        for b in it:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = plan[np.searchsorted(key, (length << 48) | rank, side="right") - 1] if b.num_rows else plan[:0]
            i = rank - row[:, 1]
            each = np.maximum(row[:, 3], 1)
            columns = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + i // each), pa.array(row[:, 4] + i % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every document's pieces with the sequence and the offset that best-fit decreasing gives them.

    Null and empty texts are one ``end_id``; texts over ``capacity`` tokens are cut, no other; ties and
    repeated rows each get a place of their own; an empty table gives no rows; further columns of
    ``docs`` are ignored.
    """
    return place(written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
