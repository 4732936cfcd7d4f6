"""Byte-level BPE encoding and decoding with the ranks of an existing vocabulary."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from plaudit.llm.common import texts

# Pieces that a task remembers between documents; a full memory starts anew, answers stay.
MEMO_PIECES = 300_000

# Pieces encoded in one array pass; characters of short texts encoded together; pieces of a longer
# text held at a time.
BATCH_PIECES, GROUP_CHARS, STRETCH = 8192, 2_000_000, 200_000

_NONE = np.iinfo(np.int32).max

# A tree node packs a rank and a place below it. Any text that fits a string has fewer bytes than 2 ** 31.
PLACE_BITS = 31


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 tokens with their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Merges by rank. The ranks are those of the joined bytes, and ranks are the token ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.text = {str(i).encode(): token for token, i in ranks.items()}
        self.decimal = {i: str(i).encode() for i in ranks.values()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[token[:i]] << 32 | ranks[token[i:]], rank) for token, rank in ranks.items()
                 for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [_NONE], np.int64)
        self.memo: dict[str, bytes] = {}

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of pieces of at most the same power of two of bytes, merged side by side.

        Each piece has a segment tree over its byte positions. A leaf holds (rank, position) of the
        pair that starts there, packed so that the smallest value is the smallest rank and, among
        equal ranks, the leftmost position. A merge takes the root's pair, joins it with the next
        live position and updates the leaves of the two pairs whose rank changed, and the one that
        is gone, up to the root.
        """
        n, longest = len(pieces), max(map(len, pieces))
        width = 1 << max(1, (longest - 1).bit_length())
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        place = np.arange(width)
        live = place < lengths[:, None]
        ids[~live] = -1
        following = np.where(place + 1 < lengths[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE << PLACE_BITS, np.int64)
        has_pair = following >= 0
        first = np.full((n, width), _NONE, np.int64)
        rows, at = np.nonzero(has_pair)
        first[rows, at] = self._pair_rank(ids[rows, at], ids[rows, at + 1])
        tree[:, width:] = first << PLACE_BITS | place
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])

        def put(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = rank << PLACE_BITS | at
            while node.size and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        active = np.arange(n)
        while True:
            best = tree[active, 1]
            going = best >> PLACE_BITS != _NONE
            active, best = active[going], best[going]
            if not len(active):
                break
            at, rank = best & (1 << PLACE_BITS) - 1, best >> PLACE_BITS
            gone = following[active, at]
            after = following[active, gone]
            ids[active, at], ids[active, gone] = rank, -1
            following[active, at] = after
            ends = after >= 0
            before[active[ends], after[ends]] = at[ends]
            put(active, gone, np.full(len(active), _NONE))
            fresh = np.full(len(active), _NONE)
            fresh[ends] = self._pair_rank(rank[ends], ids[active[ends], after[ends]])
            put(active, at, fresh)
            left = before[active, at]
            some = left >= 0
            put(active[some], left[some], self._pair_rank(ids[active[some], left[some]], rank[some]))
        kept = ids >= 0
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        flat = ids[kept].tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of new pieces, as decimal text, into the memory."""
        memo, ranks, decimal = self.memo, self.ranks, self.decimal
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = ranks.get(raw)
            if rank is not None:
                memo[piece] = decimal[rank]
            else:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, group in by_width.items():
            step = max(1, min(BATCH_PIECES, (1 << 20) >> bits))
            for i in range(0, len(group), step):
                part = group[i:i + step]
                for (piece, _), ids in zip(part, self.merge([raw for _, raw in part])):
                    memo[piece] = b" ".join([decimal[i] for i in ids])

    def _coded(self, lists: list[list[str]]) -> list[bytes]:
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        new = set().union(*lists).difference(self.memo)
        if new:
            self.learn(new)
        return [b" ".join(map(self.memo.__getitem__, pieces)) for pieces in lists]

    def encode(self, text: str) -> Iterator[bytes]:
        """Decimal ids joined by one space, for one stretch of pieces after the other."""
        matches = (m.group() for m in self.pattern.finditer(text))
        while stretch := list(islice(matches, STRETCH)):
            yield self._coded([stretch])[0]

    def encode_all(self, texts: list[str]) -> Iterator[Iterable[bytes]]:
        """``encode`` of each text. Short texts share a group, whose new pieces are merged together."""
        group: list[str] = []
        chars = 0
        for text in texts:
            if len(text) > GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
                yield self.encode(text)
                continue
            group.append(text)
            chars += len(text)
            if chars > GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, group: list[str]) -> Iterator[list[bytes]]:
        for coded in self._coded([self.pattern.findall(text) for text in group]) if group else ():
            yield [coded] if coded else []

    def decode(self, ids: bytes) -> bytes:
        """Bytes of decimal ids joined by one space."""
        return b"".join(map(self.text.__getitem__, ids.split()))


_encoders: dict[tuple, Encoder] = {}


def _encoder(key: tuple, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def _with_encoder(df: DataFrame, vocabulary: str, pattern: str):
    """The vocabulary is read on the driver and broadcast; its size is that of the file, about a megabyte."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    return lambda: _encoder((vocabulary, pattern), ranks.value, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, an array of token ids of each whole text. A null text has none."""
    make = _with_encoder(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            coded = encoder.encode_all([t.decode() for t in texts(batch, text)])
            ids = [[int(i) for part in parts for i in part.split()] for parts in coded]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))],
                                             [*batch.schema.names, "ids"])

    return docs.drop("ids").mapInArrow(run, _schema(docs.drop("ids")) + ", ids array<int>")


def decode(coded: DataFrame, vocabulary: str, pattern: str, out: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its ``ids`` as column ``out``."""
    make = _with_encoder(coded, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            found = [encoder.decode(" ".join(map(str, ids or [])).encode()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

    return coded.drop(out).mapInArrow(run, _schema(coded.drop(out)) + f", `{out}` binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids, in one pass.

    A null or empty text has no token: both digests are those of nothing. Long texts go through in
    stretches, so a task holds one text and a stretch of its pieces.
    """
    make = _with_encoder(docs, vocabulary, pattern)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            out = []
            for parts in encoder.encode_all([t.decode() for t in texts(batch)]):
                count, coded, decoded, join = 0, hashlib.sha256(), hashlib.sha256(), b""
                for part in parts:
                    coded.update(join + part)
                    decoded.update(encoder.decode(part))
                    count, join = count + part.count(b" ") + 1, b" "
                out.append((count, coded.hexdigest(), decoded.hexdigest()))
            count, coded, decoded = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(count, pa.int64()), pa.array(coded, pa.string()),
                 pa.array(decoded, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
