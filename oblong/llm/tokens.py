"""Byte-level BPE ids of whole texts, with a cache of the ids of short stretches."""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: A white space character followed by a space: there, cutting before the space could change the pre-tokens.
_DOUBLED = r"[\s\x0b\x1c-\x1f\x85\pZ] "


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@functools.lru_cache(maxsize=2)
def rank_encoding(path: str) -> tiktoken.Encoding:
    """An encoding without special tokens: their strings are ordinary text. One for each Python worker."""
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def joined_encoder(path: str):
    """A function from stretches, each cut before a space, to their ids as little-endian bytes; it encodes them in one call.

    An id whose token starts with a space begins a stretch, as no stretch has another space.
    """
    encoding = rank_encoding(path)
    ranks = load_ranks(path)
    opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
    opens[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True

    def encode(stretches: list[str]) -> list[bytes]:
        ids = np.array(encoding.encode_ordinary("".join(stretches)), dtype="<u4")
        at = np.flatnonzero(opens[ids])
        data = ids.tobytes()
        bounds = [*(4 * at).tolist(), len(data)]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def one_by_one(stretches: list[str]) -> list[bytes]:
        return [np.array(encoding.encode_ordinary(x), dtype="<u4").tobytes() for x in stretches]

    return encode, one_by_one


def strings(values: pa.Array) -> list[str]:
    """The values as a list; much faster than to_pylist()."""
    return values.to_numpy(zero_copy_only=False).tolist()


class UnitCache:
    """Encodes texts stretch by stretch, each distinct short stretch once.

    A pre-token never reaches over a space that follows another character than white space, so a text without white
    space before a space can be cut before each space: its ids are those of the stretches, one after another. Other texts
    are encoded in one piece. ``of_stretches`` gives the ids for a list of stretches that begin with their only space,
    ``of_texts`` for a list of any texts. Of two generations of at most ``most`` stretches, the cache drops the older one
    when the younger is full; it never keeps long stretches.
    """

    def __init__(self, encoders, most: int = 100_000, longest: int = 48):
        self.of_stretches, self.of_texts = encoders
        self.most, self.longest = most, longest
        self.young: dict[str, bytes] = {}  # by the stretch without its space
        self.old: dict[str, bytes] = {}

    def _ids(self, bare: list[str]) -> list[bytes]:
        """The ids of distinct stretches, given without their space."""
        found = list(map(self.young.get, bare))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(lacking, map(self.old.get, [bare[i] for i in lacking]), strict=True):
            found[i] = ids
        lacking_now = [i for i in lacking if found[i] is None]
        # Joined, stretches that end in white space would put it before a space.
        ending = [i for i in lacking_now if not bare[i][-1:].strip()]
        joined = [i for i in lacking_now if bare[i][-1:].strip()] if ending else lacking_now
        for i, ids in zip(joined, self.of_stretches([" " + bare[i] for i in joined]), strict=True):
            found[i] = ids
        for i, ids in zip(ending, self.of_texts([" " + bare[i] for i in ending]), strict=True):
            found[i] = ids
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        for i in lacking:
            if len(bare[i]) < self.longest:
                self.young[bare[i]] = found[i]
        return found

    def _cut(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts that can be cut before each space."""
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        heads = self.of_texts([t[: t.find(" ")] if " " in t else t for t in strings(texts)])
        which = coded.indices.to_numpy().copy()
        used = np.zeros(len(coded.dictionary), dtype=bool)  # stretches that stand after a space somewhere
        inner = np.ones(len(which), dtype=bool)
        inner[bounds[:-1]] = False
        used[which[inner]] = True
        bare = strings(coded.dictionary.filter(pa.array(used)))
        renumbered = np.cumsum(used) - 1
        which = renumbered[which]
        which[bounds[:-1]] = len(bare) + np.arange(len(texts))
        ids = pa.array(self._ids(bare) + heads, pa.large_binary()).take(pa.array(which))
        at = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1][bounds]
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids as little-endian bytes."""
        whole = pc.match_substring_regex(texts, _DOUBLED)
        out = iter(self._cut(texts.filter(pc.invert(whole))))
        pieces = iter(self.of_texts(strings(texts.filter(whole))))
        return [next(pieces) if alone else next(out) for alone in whole.to_pylist()]


def blocks(batch: pa.RecordBatch, column: int, most: int = 1 << 20, rows: int = 512):
    """Slices of a batch with about ``most`` bytes of text and at most ``rows`` rows, so that what is derived from them stays small.

    A longer text is a slice of its own: whole texts are never cut.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        end = min(end, at + rows)
        yield batch.slice(at, end - at)
        at = end
