"""Removal of repeated passages: a count-min sketch first, exact grouping second.

A window is ``WINDOW`` consecutive words of one document. A window that a document with a smaller
id has too covers words to remove. Chunks of documents sketch their windows; the sketches, cut by
hash into shards, are merged into counts that can only be too high. The exact grouping then sees
just the windows estimated in two chunks or more, and none that is repeated is lost. Windows
repeated inside a chunk are found there.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.llm.neardup import _SEED, Shingler, _mix

WINDOW = 50
#: Documents and bytes of text of a chunk on average, and windows of a shard of the sketch. Larger chunks and shards make the
#: sketches of a larger corpus denser, at the price of memory in a task.
CHUNK_DOCS, CHUNK_BYTES, SHARD_WINDOWS = 800, 8 << 20, 1_000_000
#: Sketch: rows, and cells of a row per window.
DEPTH, CELLS_PER_WINDOW = 2, 8
_CELLS = np.uint64(SHARD_WINDOWS * CELLS_PER_WINDOW)
_ROW_KEYS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_SALTS = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def window_hashes(words: np.ndarray, salt: np.uint64) -> np.ndarray:
    """64-bit hash of each window from the hashes of its words. Sums over 1, 2, 4, ... words are
    doubled along the text, and a window is put together from the bits of ``WINDOW``."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, sums = np.zeros(n, dtype=np.uint64), _mix(words ^ salt)
    done, span = 0, 1
    while span <= WINDOW:
        if WINDOW & span:
            total = _mix(total * _SEED + sums[done:done + n])
            done += span
        if 2 * span <= WINDOW:
            sums = _mix(sums[:-span] * _SEED + sums[span:])
        span *= 2
    return total


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return (_mix(h ^ _ROW_KEYS[row]) % _CELLS).astype(np.uint32)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cells as differences, bytes of equal weight side by side, compressed."""
    steps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _by_shard(sorted_hashes: np.ndarray, shards: int):
    """(shard, slice) of sorted hashes; a shard is a range of hashes."""
    edges = np.array([(k << 64) // shards for k in range(1, shards)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(sorted_hashes, edges).tolist(), len(sorted_hashes)]
    return [(k, slice(cuts[k], cuts[k + 1])) for k in range(shards) if cuts[k] < cuts[k + 1]]


class _Chunk:
    """The documents of a chunk that have windows of their own, and the chunk's distinct windows
    with the smallest document of each."""

    def __init__(self, docs, side):
        import pyarrow as pa

        copies = {(d, t) for d, t, kind in zip(*(side.column(c).to_pylist() for c in ("doc_id", "digest", "kind"))) if kind == 0}
        shingler = Shingler(1)
        self.ids, digests = docs.column("doc_id").to_pylist(), docs.column("digest").to_pylist()
        self.words = [(t or b"").split() for t in docs.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
        self.copied = [(d, t) in copies for d, t in zip(self.ids, digests)]
        self.own = [i for i, d in enumerate(self.ids) if d is not None and not self.copied[i] and len(self.words[i]) >= WINDOW]
        hashed = [shingler.word_hashes(self.words[i]) for i in self.own]
        both = [np.concatenate([np.zeros(0, dtype=np.uint64), *(window_hashes(h, salt) for h in hashed)]) for salt in _SALTS]
        self.counts = [len(h) - WINDOW + 1 for h in hashed]
        owner = np.repeat(np.array([self.ids[i] for i in self.own], dtype=np.int64), self.counts)
        order = np.lexsort((owner, both[0]))
        sorted_h = both[0][order]
        fresh = np.append(True, sorted_h[1:] != sorted_h[:-1]) if len(order) else np.zeros(0, dtype=bool)
        self.hashes, self.second, self.smallest = sorted_h[fresh], both[1][order][fresh], owner[order][fresh]
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        self.owner = owner


def _sketch(docs, side, shards: int):
    import pyarrow as pa

    hashes, rows = _Chunk(docs, side).hashes, []
    for shard, part in _by_shard(hashes, shards):
        rows.append({"shard": shard, "chunk": docs.column("chunk")[0].as_py(),
                     **{f"cells{r}": _pack(np.unique(_cells(hashes[part], r))) for r in range(DEPTH)}})
    return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("cells0", pa.binary()), ("cells1", pa.binary())]))


def _merge_sketches(table):
    """Add up the sketches of a shard; each chunk gets back its cells that count two or more."""
    import pyarrow as pa

    chunks = table.column("chunk").to_pylist()
    hot: list[list[np.ndarray]] = []
    for r in range(DEPTH):
        cells = [_unpack(c) for c in table.column(f"cells{r}").to_pylist()]
        counts = np.zeros(int(_CELLS), dtype=np.uint8)
        for c in cells:
            counts[c] = np.minimum(counts[c] + 1, 2)
        hot.append([c[counts[c] > 1] for c in cells])
    rows = [{"chunk": k, "kind": 1, "shard": table.column("shard")[0].as_py(), "a": _pack(x), "b": _pack(y)}
            for k, x, y in zip(chunks, *hot) if len(x) and len(y)]
    return pa.Table.from_pylist(rows, schema=_side_schema())


def _side_schema():
    import pyarrow as pa

    return pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.string()),
                      ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


_SIDE = "chunk bigint, kind int, doc_id bigint, digest string, shard int, a binary, b binary"


def _estimated(docs, side, shards: int):
    """Windows of a chunk that the merged sketch counts twice: hashes and smallest document."""
    import pyarrow as pa

    chunk, rows = _Chunk(docs, side), []
    hot = {s: (a, b) for s, kind, a, b in zip(*(side.column(c).to_pylist() for c in ("shard", "kind", "a", "b"))) if kind == 1}
    for shard, part in _by_shard(chunk.hashes, shards):
        if shard not in hot:
            continue
        h = chunk.hashes[part]
        twice = np.isin(_cells(h, 0), _unpack(hot[shard][0]), assume_unique=False)
        twice[twice] = np.isin(_cells(h[twice], 1), _unpack(hot[shard][1]))
        if twice.any():
            rows.append({"shard": shard, "chunk": docs.column("chunk")[0].as_py(), "n": int(twice.sum()), "windows": b"".join(
                x[part][twice].tobytes() for x in (chunk.hashes, chunk.second, chunk.smallest))})
    return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("windows", pa.binary())]))


def _group_exactly(table):
    """Group the windows of a shard by both hashes; each chunk gets back those that a document
    outside it, smaller than its own, has."""
    import pyarrow as pa

    counts = table.column("n").to_pylist()
    parts = [np.frombuffer(w, dtype=np.uint64).reshape(3, -1) for w in table.column("windows").to_pylist()]
    first, second, doc = np.concatenate(parts, axis=1)
    doc = doc.view(np.int64)
    order = np.lexsort((doc, second, first))
    new = np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1]))
    beaten = np.empty(len(order), dtype=bool)
    beaten[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    rows, at = [], 0
    for chunk, n in zip(table.column("chunk").to_pylist(), counts):
        lost = first[at:at + n][beaten[at:at + n]]
        at += n
        if len(lost):
            rows.append({"chunk": chunk, "kind": 2, "a": lost.tobytes()})
    return pa.Table.from_pylist(rows, schema=_side_schema())


def _remove(docs, side):
    """The documents of a chunk without the words their repeated windows cover."""
    import pyarrow as pa

    chunk = _Chunk(docs, side)
    beaten = np.zeros(len(chunk.hashes), dtype=bool)
    for kind, lost in zip(side.column("kind").to_pylist(), side.column("a").to_pylist()):
        if kind == 2:
            beaten[np.searchsorted(chunk.hashes, np.frombuffer(lost, dtype=np.uint64))] = True
    gone = beaten[chunk.group] | (chunk.owner > chunk.smallest[chunk.group])
    kept = [[] if copied and len(w) >= WINDOW else w for w, copied in zip(chunk.words, chunk.copied)]
    at = 0
    for i, n in zip(chunk.own, chunk.counts):
        starts = np.nonzero(gone[at:at + n])[0]
        at += n
        if len(starts):
            edges = np.zeros(len(chunk.words[i]) + 1, dtype=np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + WINDOW, -1)
            words = chunk.words[i]
            kept[i] = [words[k] for k in np.nonzero(np.cumsum(edges[:-1]) == 0)[0].tolist()]
    return pa.table({"doc_id": pa.array(chunk.ids, pa.int64()), "n_words": pa.array([len(w) for w in chunk.words], pa.int64()),
                     "n_removed": pa.array([len(w) - len(k) for w, k in zip(chunk.words, kept)], pa.int64()),
                     "text": pa.array([b" ".join(k).decode() for k in kept], pa.string())})


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words joined by one space) per row of ``docs``.

    Words are cut at ASCII white space; a null, empty or blank text has none. Windows are judged
    on the input. A copy of a whole text with a smaller doc_id is known by its digest and sends
    no windows, so a large group of copies costs one document. Rows without doc_id are not
    changed and don't count for others; rows that repeat a doc_id don't change each other. Other
    columns are not carried.

    The texts are shuffled once, into chunks by the hash of doc_id and text, so the texts of a
    repeated doc_id are dealt out; rows without doc_id are not shuffled. The three passes over them
    (sketch, estimate, remove) read that same shuffle. What goes between the passes are packed
    cells and the hashes of windows estimated repeated.
    """
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = every.filter(F.col("doc_id").isNotNull())
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \x09-\x0D]+"), F.lit(0))
    alone = every.filter(F.col("doc_id").isNull()).select("doc_id", words.alias("_w")).select(
        "doc_id", F.size("_w").cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_removed"), F.array_join("_w", " ").alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    chunks, shards = _chunks(size["n"], size["b"]), max(1, -(-size["b"] // (5 * SHARD_WINDOWS)))
    rows = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "text")
    rows = rows.select(_chunk_of(F.col("doc_id"), F.col("digest"), chunks).alias("chunk"), "doc_id", "digest", "text")
    told = rows.select("chunk", "doc_id", "digest")
    first = told.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last")
    copies = (told.join(first, "digest").filter("doc_id > _first")
              .select(F.col("chunk").alias("chunk"), F.lit(0).alias("kind"), F.col("doc_id").alias("doc_id"), F.col("digest").alias("digest"), F.lit(None).cast("int").alias("shard"),
                      F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b")))
    grouped = rows.groupBy("chunk")

    def with_side(side, fn, schema):
        return grouped.cogroup(side.groupBy("chunk")).applyInArrow(fn, schema)

    sketches = with_side(copies, lambda d, s: _sketch(d, s, shards), "shard int, chunk bigint, cells0 binary, cells1 binary")
    hot = sketches.groupBy("shard").applyInArrow(_merge_sketches, _SIDE)
    windows = with_side(copies.union(hot), lambda d, s: _estimated(d, s, shards), "shard int, chunk bigint, n bigint, windows binary")
    lost = windows.groupBy("shard").applyInArrow(_group_exactly, _SIDE)
    return with_side(copies.union(lost), _remove, "doc_id bigint, n_words bigint, n_removed bigint, text string").unionByName(alone)


def _chunks(n_docs: int, n_bytes: int) -> int:
    return max(1, -(-n_docs // CHUNK_DOCS), -(-n_bytes // CHUNK_BYTES))


def _chunk_of(doc_id: Column, digest: Column, chunks: int) -> Column:
    """Chunk of a row. Rows equal in doc_id and text share one."""
    return F.pmod(F.xxhash64(doc_id, digest), F.lit(chunks)).cast("bigint")
