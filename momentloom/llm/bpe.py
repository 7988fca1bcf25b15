"""Byte-level BPE: encoding and decoding of whole texts by a rank file.

A piece of text starts as one part per byte. A segment tree over the byte positions holds, at
each live part, the rank its merge with the next live part would have; the root is the smallest
rank, the leftmost of equals. A merge changes three leaves (the part, its live left neighbour and
the part swallowed), and each change climbs one path of the tree. Pieces of similar length are
merged side by side as rows of one array; a very long one has a tree of its own.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces remembered by a task, to encode each once; then it starts afresh.
CACHED = 200_000
#: Bytes of text worked on at once, and cells of one merge array.
CHUNK_BYTES, CELLS = 1 << 20, 1 << 19
#: Width from which a piece is merged alone: there an array row costs more than a walk up its tree.
ALONE = 4096
_NONE = np.int64(2**62)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PieceEncoder:
    """Encodes pieces (UTF-8 bytes) into token ids with the given ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _NONE)
        self.merged = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], 0)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; ``_NONE`` where there is none (a part is -1: no part)."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif not piece:
                out[i] = b""
            else:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            if width >= ALONE:
                for i in rows:
                    out[i] = self._merge_alone(pieces[i], width)
                continue
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        place = np.arange(width)
        live = place < size[:, None]
        # Column ``width`` stands for "no part" on either side.
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[:, :width] = np.where(live, self.byte_ids[text], -1)
        after = np.minimum(np.tile(np.arange(1, width + 2), (n, 1)), np.maximum(size, 1)[:, None])
        after[after == size[:, None]] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        # Leaves hold rank * width + position, so that the least is the leftmost of the lowest rank.
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        first = self._rank(ids[:, :width].ravel(), np.take_along_axis(ids, after[:, :width], 1).ravel()).reshape(n, width)
        tree[:, width:] = np.where(first < _NONE, first * width + place, _NONE)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2

        def put(rows, at, value):
            node = at + width
            tree[rows, node] = value
            node >>= 1
            while len(node) and node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1

        rows = np.nonzero(tree[:, 1] < _NONE)[0]
        while len(rows):
            best = tree[rows, 1]
            token, at = best // width, best % width
            gone = after[rows, at]
            then, prior = after[rows, gone], before[rows, at]
            ids[rows, at] = token
            live[rows, gone] = False
            after[rows, at] = then
            before[rows, then] = at  # column ``width`` is a bin here
            put(rows, gone, _NONE)
            rank = self._rank(token, np.where(then == width, -1, ids[rows, then]))
            put(rows, at, np.where(rank < _NONE, rank * width + at, _NONE))
            left = prior < width
            r, p = rows[left], prior[left]
            rank = self._rank(ids[r, p], token[left])
            put(r, p, np.where(rank < _NONE, rank * width + p, _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        flat = ids[:, :width][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]


    def _merge_alone(self, piece: bytes, width: int) -> bytes:
        """The same tree over one long piece, its updates stopping where a node's minimum stays."""
        n, shift, none, pairs = len(piece), width.bit_length() - 1, int(_NONE), self.pairs
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def value(at: int) -> int:
            then = after[at]
            rank = pairs.get(ids[at] << 32 | ids[then]) if then < n else None
            return none if rank is None else rank << shift | at

        tree = [none] * (2 * width)
        tree[width:width + n] = map(value, range(n))
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, new: int) -> None:
            node = at + width
            tree[node] = new
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < none:
            best = tree[1]
            at = best & (width - 1)
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone], after[at] = best >> shift, -1, then
            if then < n:
                before[then] = at
            put(gone, none)
            put(at, value(at))
            if before[at] >= 0:
                put(before[at], value(before[at]))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (token ids as little-endian unsigned 32-bit integers, binary) and ``n_tokens``.

    Each match of ``pattern`` in the whole text is encoded on its own; a piece that is itself a
    token is that token, others are merged by rank. No special tokens: their strings are plain
    text. A null or empty text has no ids. Columns of ``docs`` named ids or n_tokens are replaced.
    The rank file is read once by the driver; its size does not depend on the data.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens")]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute
        import regex

        encoder, pieces_of, cache = PieceEncoder(shared.value), regex.compile(pattern).findall, {}
        for batch in batches:
            column = batch.column(text)
            start, size, n = 0, 0, batch.num_rows
            lengths = [v or 0 for v in pa.compute.binary_length(column).to_pylist()]
            for end in range(1, n + 1):
                size += lengths[end - 1]
                if end < n and size < CHUNK_BYTES:
                    continue
                texts = [pieces_of(t or "") for t in column.slice(start, end - start).to_pylist()]
                new = set().union(*texts).difference(cache)
                if len(cache) + len(new) > CACHED:
                    cache.clear()
                    new = set().union(*texts)
                new = list(new)
                cache.update(zip(new, encoder.encode([p.encode() for p in new])))
                ids = [b"".join(map(cache.__getitem__, t)) for t in texts]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                    names=kept + ["ids", "n_tokens"])
                start, size = end, 0

    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = source.limit(0).withColumns({"ids": F.lit(b""), "n_tokens": F.lit(0).cast("bigint")}).schema
    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes the ids stand for (binary; null ids: null). A cut character
    stays a cut character, so nothing is lost. A column named decoded is replaced."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [c for c in tokens.columns if c != "decoded"]

    def run(batches):
        import pyarrow as pa

        words: list[bytes] = [b""] * (max(shared.value.values()) + 1)
        for token, rank in shared.value.items():
            words[rank] = token
        for batch in batches:
            out = [None if x is None else b"".join(map(words.__getitem__, np.frombuffer(x, dtype="<u4").tolist()))
                   for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, pa.binary())], names=kept + ["decoded"])

    source = tokens.select(*[F.col(f"`{c}`") for c in kept])
    return source.mapInArrow(run, source.limit(0).withColumn("decoded", F.lit(b"")).schema)
