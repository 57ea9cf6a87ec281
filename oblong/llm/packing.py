"""Harmonic packing of token sequences into bins of fixed capacity.

A piece of length n belongs to class k = capacity // n: k pieces of that class fill one bin. Documents may be cut, so a
length that would leave much of its share of a bin empty gives up one piece as long as the next class allows, and the
rest is classed again. Every worker keeps one open bin a class and closes it when it holds k pieces: no worker needs to
know of another, and no row is shuffled. What stays in open bins when a worker has read all is laid end to end and cut
at the capacity; the last stretch is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.shared import lean
from oblong.llm.tokens import UnitCache, blocks, joined_encoder

#: The rank file with the vocabulary of the tokenizer file; the ids are equal (tests compare them).
RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


@functools.lru_cache(maxsize=2)
def added_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizer file cuts out before it encodes, and their ids."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def encode_around(cache: UnitCache, texts: pa.Array, added: dict[str, int]) -> list[bytes]:
    """Ids of texts in which added tokens have their own ids; what stands between them is encoded by itself."""
    if not added:
        return cache.encode(texts)
    cutter = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
    holds = pc.match_substring_regex(texts, cutter.pattern).to_numpy(zero_copy_only=False)
    plain = iter(cache.encode(texts.filter(pa.array(~holds))))
    out = []
    for text, cut in zip(texts, holds.tolist(), strict=True):
        if not cut:
            out.append(next(plain))
            continue
        parts = cutter.split(text.as_py())
        between = iter(cache.encode(pa.array(parts[0::2], pa.string())))
        out.append(b"".join(np.array([added[p]], dtype="<u4").tobytes() if i % 2 else next(between) for i, p in enumerate(parts)))
    return out




def cut(length: int, capacity: int, tolerance: float) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document of ``length`` ids, in order.

    A piece is left whole when it wastes at most ``tolerance`` of its share, capacity // class.
    """
    pieces = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if share - rest <= tolerance * share:
            pieces.append((k, rest))
            break
        share = capacity // (k + 1)
        pieces.append((k + 1, share))
        rest -= share
    return pieces


def powers(length: int) -> list[int]:
    """The powers of two that add up to ``length``, largest first."""
    return [1 << bit for bit in range(length.bit_length() - 1, -1, -1) if length >> bit & 1]


class Packer:
    """The open bins of one worker. Pieces are (document, start, ids as little-endian bytes, document's length)."""

    def __init__(self, capacity: int, tolerance: float, first_sequence: int):
        self.capacity, self.tolerance, self.next = capacity, tolerance, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for document, start, ids, total in pieces:
            yield document, start, ids, total, self.next, offset
            offset += len(ids) // 4
        self.next += 1

    def add(self, document, ids: bytes) -> Iterator[tuple]:
        start, total = 0, len(ids) // 4
        for k, length in cut(total, self.capacity, self.tolerance):
            held = self.open.setdefault(k, [])
            held.append((document, start, ids[4 * start : 4 * (start + length)], total))
            start += length
            if len(held) == k:
                del self.open[k]
                yield from self._close(held)

    def rest(self) -> Iterator[tuple]:
        """Empties the open bins."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) // 4 for p in left)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        left.reverse()
        for size in sizes:
            held = []
            while size:
                document, start, ids, total = left.pop()
                n = min(size, len(ids) // 4)
                held.append((document, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    left.append((document, start + n, ids[4 * n :], total))
                size -= n
            yield from self._close(held)


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str | None = None, end_id: int = 1,
         capacity: int = 2048, tolerance: float = 1 / 64, with_ids: bool = False, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: where its ids stand in their document and in their sequence.

    Null and empty texts are documents of the end id alone. Equal ids, equal texts and repeated rows are packed each for
    itself; other columns are ignored; an empty table gives no rows. Ids of sequences depend on how the input is split
    into partitions. ``with_ids`` adds the pieces' ids (column ``ids``, array of int). A worker holds at most one open
    bin for each class in memory, and one text whole, however long it is. Strings of the tokenizer's added tokens have their own ids.
    """
    path = ranks or public_tokenizers.path(RANKS)
    added = added_tokens(tokenizer or public_tokenizers.path(TOKENIZER)) if ranks is None or tokenizer else {}
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = UnitCache(joined_encoder(path))
        packer = Packer(capacity, tolerance, TaskContext.get().partitionId() << 36)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            document, start, ids, total, sequence, offset = zip(*rows, strict=True)
            columns = [pa.array(document, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        rows: list[tuple] = []
        for batch in batches:
            for part in blocks(batch, 1):
                encoded = encode_around(cache, pc.fill_null(part.column(1), ""), added)
                for document, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    rows.extend(packer.add(document, ids + end))
                if len(rows) >= 1000:
                    yield table(rows)
                    rows = []
        rows.extend(packer.rest())
        if rows:
            yield table(rows)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(lean(run), schema)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves from ``pack(..., with_ids=True)``: ids padded to the capacity, or not at a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    wanted = F.when(F.expr("size(ids) & (size(ids) - 1)") == 0, n).otherwise(F.lit(capacity))
    return filled.select("sequence_id", n.alias("n_tokens"), F.concat("ids", F.array_repeat(F.lit(pad_id), (wanted - n).cast("int"))).alias("ids"))
