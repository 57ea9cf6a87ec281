"""Byte-level BPE through a sentencepiece model that is written directly from a rank vocabulary.

Byte b stands as the character U+0100+b, so each token is a piece of such characters; a piece's score is its negative
rank, so that the merge of lowest rank comes first, and normalisation is the identity. Each pre-token is encoded by
itself; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oblong.llm.shared import lean
from oblong.llm.tokens import UnitCache, blocks, load_ranks

#: The vocabulary of the production query.
RANKS = "byte_bpe_multi_50k.tiktoken"

#: Stands between pre-tokens; outside the characters of bytes.
_BETWEEN = chr(0x200)

_TO_CHARACTERS = {b: 0x100 + b for b in range(256)}
_TO_CHARACTERS_OR_BETWEEN = _TO_CHARACTERS | {0: _BETWEEN}

#: Field numbers and enum values of the public sentencepiece ModelProto.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_MODEL_TYPE, _BPE, _UNK_ID = 3, 2, 40
_NAME, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5


def characters(data: bytes) -> str:
    """The bytes as characters of the model."""
    return data.decode("latin-1").translate(_TO_CHARACTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """The model whose piece i is tokens[i] with score -i; the unknown piece stands last."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _block(_PIECES, _block(_PIECE, text.encode()) + _varint(_SCORE << 3 | 5) + struct.pack("<f", score) + _number(_TYPE, kind))

    pieces = [piece(characters(token), -float(i), _NORMAL) for i, token in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, _UNKNOWN))
    trainer = _number(_MODEL_TYPE, _BPE) + _number(_UNK_ID, len(tokens))
    normalizer = _block(_NAME, b"identity") + _number(_DUMMY_PREFIX, 0) + _number(_EXTRA_SPACES, 0) + _number(_ESCAPE_SPACES, 0)
    return b"".join(pieces) + _block(_TRAINER, trainer) + _block(_NORMALIZER, normalizer)


class Codec:
    """Encodes and decodes texts by one rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.tokens = [token for token, _ in by_rank]
        self.ranks = np.array([rank for _, rank in by_rank], dtype="<u4")
        by_id: list[bytes | None] = [None] * (int(self.ranks.max()) + 1 if len(self.ranks) else 0)
        for token, rank in by_rank:
            by_id[rank] = token
        self.bytes_of = pa.array(by_id, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(len(by_id))], pa.large_binary())
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.pattern = regex.compile(pattern)
        # A whole pre-token that is a token is that token, also where merges would not arrive at it.
        found = self.model.encode([characters(t) for t in self.tokens], num_threads=1)
        self.unreachable = {characters(t): i for i, (t, x) in enumerate(zip(self.tokens, found, strict=True)) if x != [i]}
        self.cache = UnitCache((self._stretches, self._texts))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, one after another, and where each pre-token's begin.

        Many pre-tokens go to the model in one call: _BETWEEN is in no piece, so no merge reaches over it.
        """
        ids, counts = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            line = "\0".join(part)
            if line.count("\0") == len(part) - 1:
                mapped = line.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_CHARACTERS_OR_BETWEEN)
            else:
                mapped = _BETWEEN.join([characters(w.encode("utf-8", "surrogatepass")) for w in part])
            found = np.array(self.model.encode(mapped), dtype=np.int64)
            ends = np.append(np.flatnonzero(found == len(self.tokens)), len(found))
            ids.append(self.ranks[found[found < len(self.tokens)]])
            counts.append(np.diff(ends, prepend=-1) - 1)
        sizes = np.concatenate(counts)
        return np.concatenate(ids), np.cumsum(sizes) - sizes

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _ids, where some tokens can't be reached by merges: a pre-token that is such a token is taken whole."""
        parts = []
        for w in words:
            own = self.unreachable.get(characters(w.encode("utf-8", "surrogatepass")))
            parts.append(self._ids([w])[0] if own is None else self.ranks[[own]])
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return np.concatenate([np.zeros(0, dtype="<u4"), *parts]), np.cumsum(sizes) - sizes

    def _slices(self, words: list[str], firsts: list[int]) -> list[bytes]:
        """The ids as bytes of runs of pre-tokens that begin at the pre-tokens numbered ``firsts``."""
        ids, at = (self._whole if self.unreachable else self._ids)(words)
        data = ids.tobytes()
        bounds = [*(4 * np.append(at, len(ids))[firsts]).tolist(), len(data)]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _texts(self, texts: list[str]) -> list[bytes]:
        words, firsts = [], []
        for t in texts:
            firsts.append(len(words))
            words += self.pattern.findall(t)
        return self._slices(words, firsts)

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        words = self.pattern.findall("".join(stretches))
        return self._slices(words, [i for i, w in enumerate(words) if w[0] == " "])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(ids, dtype="<u4") for ids in self.cache.encode(texts)]

    def write(self, ids: np.ndarray) -> memoryview:
        """The ids in decimal, joined by commas."""
        return _bytes(self.decimals.take(pa.array(ids)))[:-1]

    def decode(self, ids: np.ndarray) -> memoryview:
        return _bytes(self.bytes_of.take(pa.array(ids)))


def _bytes(values: pa.LargeBinaryArray) -> memoryview:
    """All values, one after another."""
    if not len(values):
        return memoryview(b"")
    total = int(np.frombuffer(values.buffers()[1], dtype=np.int64)[len(values)])
    return memoryview(values.buffers()[2])[:total]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(load_ranks(path))


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Ids of every whole text, and their decoding, as counts and digests; ``with_ids`` adds ``ids`` and ``decoded``.

    Null texts count as empty: no ids, and the digests of nothing. Rows are independent, so repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows. No shuffle; a worker holds one batch and a bounded cache.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for whole in batches:
            for batch in blocks(whole, 1):
                counts, ids_digests, decoded_digests, all_ids, all_bytes = [], [], [], [], []
                for ids in tool.encode(pc.fill_null(batch.column(1), "")):
                    decoded = tool.decode(ids)
                    counts.append(len(ids))
                    ids_digests.append(hashlib.sha256(tool.write(ids)).hexdigest())
                    decoded_digests.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        all_bytes.append(bytes(decoded))
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded_digests, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(lean(run), schema)
