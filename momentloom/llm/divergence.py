"""How far the terms of each source diverge from those of other sources and of the whole language.

Terms are counted in tasks without a Python object per term. A term of up to 8 bytes is one
unsigned 64-bit word, of up to 16 bytes two; the words are sorted by radix, 16 bits at a time, and
equal neighbours counted. Longer terms go to buckets of like length that are sorted by bytes. Runs
of counts go on, packed, to shards of the terms and are merged there by the same sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from momentloom.llm.common import only, text_of
from momentloom.session import stage

#: Documents of a language that must have a term, and ranks of the term part.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Bytes of text counted at once, and entries (and bytes of long terms) a task gathers before it hands them on.
SLICE_BYTES, GATHERED, GATHERED_BYTES = 8 << 20, 1_500_000, 64 << 20
#: Bytes of text whose terms make one shard in a corpus of that size; shards grow as the distinct
#: terms do, with about the power 2/3 of the text.
SHARD_BYTES, SHARD_GROWTH = 32 << 20, 2 / 3
#: Counts (terms x sources) of a shard of the comparison, and sources compared with all others at once.
CELLS, SOURCE_BLOCK = 1 << 20, 512
SCALE = 1_000_000_000

#: Term bytes: letters, A-Z lower-cased, and whatever is not ASCII; 0 separates.
_FOLD = np.array([b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], dtype=np.uint8)
_HEAD = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], dtype=np.uint64)
#: Bytes of the terms that one and two words hold; from there on buckets by the bits of the length.
_SHORT, _PAIR = 8, 16


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order of the rows by unsigned columns, the first one deciding first: one pass for each
    16 bits that are not the same everywhere, the last ones first."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in range(0, column.dtype.itemsize * 8, 16):
            digit = (column >> column.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class Runs:
    """Counts of (term, group): key columns that tell terms apart and order them, group, n, docs."""

    def __init__(self, keys: list[np.ndarray], group: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.keys, self.group, self.n, self.docs = keys, group, n, docs

    def __len__(self) -> int:
        return len(self.group)

    def take(self, at) -> Runs:
        return Runs([k[at] for k in self.keys], self.group[at], self.n[at], self.docs[at])


def _term_order(keys: list[np.ndarray], *more: np.ndarray) -> np.ndarray:
    """By terms, then by ``more``: words by radix, bytes by comparison."""
    if keys[0].dtype.kind == "u":
        return radix_order([*keys, *more])
    order = radix_order(list(more)) if more else np.arange(len(keys[0]))
    return order[np.argsort(keys[0][order], kind="stable")]


def count_runs(keys: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> Runs:
    """Run-count occurrences that come in order of (group, document)."""
    order = _term_order(keys)
    keys, group, doc = [k[order] for k in keys], group[order], doc[order]
    starts = np.nonzero(_changes([*keys, group]))[0]
    fresh = _changes([*keys, group, doc]).astype(np.int64)
    n = np.diff(np.append(starts, len(group))).astype(np.int64)
    return Runs([k[starts] for k in keys], group[starts], n, np.add.reduceat(fresh, starts) if len(starts) else n)


def merge_runs(parts: list[Runs]) -> Runs:
    """One run for each (term, group), sorted."""
    keys = [np.concatenate(k) for k in zip(*(p.keys for p in parts))]
    group, n, docs = (np.concatenate([getattr(p, c) for p in parts]) for c in ("group", "n", "docs"))
    order = _term_order(keys, group)
    keys, group = [k[order] for k in keys], group[order]
    starts = np.nonzero(_changes([*keys, group]))[0]
    if not len(starts):
        return Runs(keys, group, n, docs)
    return Runs([k[starts] for k in keys], group[starts], np.add.reduceat(n[order], starts), np.add.reduceat(docs[order], starts))


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, lengths, document) of the terms of texts that lie behind each other."""
    folded = np.zeros(len(data) + 2 * _SHORT, dtype=np.uint8)
    np.take(_FOLD, data, out=folded[:len(data)])
    inside = folded[:len(data)] != 0
    after, before = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    firsts, lasts = offsets[:-1][offsets[1:] > offsets[:-1]], offsets[1:][offsets[1:] > offsets[:-1]] - 1
    before[firsts], after[lasts] = False, False
    starts, ends = np.nonzero(inside & ~before)[0], np.nonzero(inside & ~after)[0] + 1
    per_doc = np.diff(np.searchsorted(starts, offsets))
    return folded, starts, ends - starts, np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), per_doc)


def _words(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each term as a number, zeros behind a shorter one."""
    every = np.ndarray(len(folded) - _SHORT + 1, dtype=">u8", buffer=folded, strides=(1,))
    return every[starts].astype(np.uint64) & _HEAD[np.clip(lengths, 0, _SHORT)]


def count_slice(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> dict[int, Runs]:
    """Runs of each kind (1 or 2 words, or the bits of a longer length) of texts in order of group."""
    folded, starts, lengths, doc = occurrences(data, offsets)
    kind = np.where(lengths <= _SHORT, 1, 2)
    long = lengths > _PAIR
    kind[long] = np.frexp(lengths[long].astype(np.float64))[1]
    found = {}
    for k in np.unique(kind).tolist():
        at = np.nonzero(kind == k)[0]
        s, n = starts[at], lengths[at]
        if k == 1:
            keys = [_words(folded, s, n)]
        elif k == 2:
            keys = [_words(folded, s, n), _words(folded, s + _SHORT, n - _SHORT)]
        else:
            keys = [np.array([folded[a:a + b].tobytes() for a, b in zip(s.tolist(), n.tolist())])]
        found[k] = count_runs(keys, groups[doc[at]], doc[at])
    return found


def _pack(column: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, bytes of equal weight side by side, compressed."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(column) or int(column.max()) < 1 << 8 * w)
    planes = column.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    return planes.T.copy().view(f"<u{data[0]}").ravel().astype(np.uint64)


def _pack_terms(keys: list[np.ndarray]) -> bytes:
    if keys[0].dtype.kind != "u":
        return zlib.compress(b"\0".join(keys[0].tolist()), 1)
    parts = [_pack(np.diff(keys[0], prepend=np.uint64(0))), *(_pack(k) for k in keys[1:])]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unpack_terms(kind: int, data: bytes) -> list[np.ndarray]:
    if kind > 2:
        return [np.array(zlib.decompress(data).split(b"\0"))]
    parts = []
    while data:
        size = int.from_bytes(data[:4], "little")
        parts.append(_unpack(data[4:4 + size]))
        data = data[4 + size:]
    return [np.cumsum(parts[0], dtype=np.uint64), *parts[1:]]


def _shard_of(keys: list[np.ndarray], shards: int) -> np.ndarray:
    if keys[0].dtype.kind != "u":
        return np.array([zlib.crc32(t) % shards for t in keys[0].tolist()], dtype=np.uint32)
    h = keys[0]
    for k in keys[1:]:
        h = h * np.uint64(0x9E3779B97F4A7C15) + k
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.uint32)


def _term_bytes(keys: list[np.ndarray]) -> pa.Array:
    """The terms as binary values."""
    if keys[0].dtype.kind != "u":
        return pa.array(keys[0].tolist(), pa.binary())
    raw = np.stack(keys, axis=1).astype(">u8").view(np.uint8).reshape(len(keys[0]), -1)
    offsets = np.append(0, np.cumsum((raw != 0).sum(axis=1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[raw != 0].tobytes())])


_PACKED = "lang string, kind int, shard int, sources array<string>, terms binary, source binary, n binary, docs binary"
_PACKED_ARROW = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("shard", pa.int32()), ("sources", pa.list_(pa.string())),
                           ("terms", pa.binary()), ("source", pa.binary()), ("n", pa.binary()), ("docs", pa.binary())])
_COUNTED = "lang string, term binary, docs bigint, sources array<string>, counts array<bigint>"


class Counter:
    """Gathers the runs of a task and hands them on packed by language, kind and shard."""

    def __init__(self, shards: int):
        self.shards, self.codes, self.parts, self.size = shards, {}, {}, 0

    def add(self, lang: list[str], source: list[str], texts: pa.Array) -> None:
        """Count texts without nulls, a bounded slice at a time."""
        if not self.parts:
            self.codes = {}
        codes = np.array([self.codes.setdefault(g, len(self.codes)) for g in zip(lang, source)], dtype=np.uint32)
        by_group = np.argsort(codes, kind="stable")
        texts, codes = texts.take(pa.array(by_group)), codes[by_group]
        ends = np.cumsum(pa.compute.binary_length(texts).to_numpy())
        at = 0
        while at < len(codes):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            part = texts.slice(at, upto - at)
            offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset:part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
            for kind, runs in count_slice(data, offsets - offsets[0], codes[at:upto]).items():
                self.parts.setdefault(kind, []).append(runs)
                self.size += len(runs) if kind <= 2 else runs.keys[0].nbytes * GATHERED // GATHERED_BYTES
            at = upto
            if self.size > GATHERED:
                yield from self.flush(merged_only=True)

    def flush(self, merged_only: bool = False) -> Iterator[pa.RecordBatch]:
        """Hand on what is gathered; with ``merged_only`` merge first and go on if that made room. The
        codes of the groups stay: ``add`` may have slices left that use them."""
        self.parts = {k: [merge_runs(p)] for k, p in self.parts.items() if p}
        self.size = sum(len(p[0]) if k <= 2 else p[0].keys[0].nbytes * GATHERED // GATHERED_BYTES for k, p in self.parts.items())
        if merged_only and self.size <= GATHERED // 2:
            return
        groups = list(self.codes)
        langs = sorted({lang for lang, _ in groups})
        lang_of = np.array([langs.index(lang) for lang, _ in groups], dtype=np.uint32)
        rows = []
        for kind, (runs,) in self.parts.items():
            place = lang_of[runs.group] * np.uint32(self.shards) + _shard_of(runs.keys, self.shards)
            order = radix_order([place])
            place = place[order]
            cuts = np.append(np.nonzero(_changes([place]))[0], len(place)).tolist()
            for a, b in zip(cuts, cuts[1:]):
                part = runs.take(order[a:b])
                used, local = np.unique(part.group, return_inverse=True)
                rows.append({"lang": langs[int(place[a]) // self.shards], "kind": kind, "shard": int(place[a]) % self.shards,
                             "sources": [groups[g][1] for g in used.tolist()], "terms": _pack_terms(part.keys), "source": _pack(local),
                             "n": _pack(part.n), "docs": _pack(part.docs)})
        self.parts, self.size = {}, 0
        for start in range(0, len(rows), 500):
            yield pa.RecordBatch.from_pylist(rows[start:start + 500], schema=_PACKED_ARROW)


def _merge_shard(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        parts, size, lang = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                lang = row["lang"]
                local = np.array([codes.setdefault(s, len(codes)) for s in row["sources"]], dtype=np.uint32)
                parts.append(Runs(_unpack_terms(row["kind"], row["terms"]), local[_unpack(row["source"]).astype(np.int64)],
                                  _unpack(row["n"]).astype(np.int64), _unpack(row["docs"]).astype(np.int64)))
                size += len(parts[-1])
                if size > 2 * max(GATHERED, len(parts[0])):
                    parts = [merge_runs(parts)]
                    size = len(parts[0])
        runs = merge_runs(parts)
        starts = np.nonzero(_changes(runs.keys))[0]
        docs = np.add.reduceat(runs.docs, starts)
        sizes = np.diff(np.append(starts, len(runs)))
        often = docs >= least_docs
        kept = runs.take(np.repeat(often, sizes))
        if not len(kept):
            return
        offsets = np.append(0, np.cumsum(sizes[often])).astype(np.int32)
        firsts = offsets[:-1]
        sources = pa.array(list(codes), pa.string()).take(pa.array(kept.group.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(firsts), pa.string()), _term_bytes([k[firsts] for k in kept.keys]), pa.array(docs[often], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), sources), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept.n, pa.int64()))],
            names=["lang", "term", "docs", "sources", "counts"])

    return run


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, shards: int | None = None) -> DataFrame:
    """lang, term (binary), docs, sources, counts: for each term that ``least_docs`` rows of its
    language have, the sources with it and how often each has it.

    ``docs``: lang, source, text without nulls. ``shards`` of the terms of a language by default
    follow the bytes of text, read once for that.
    """
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, round((size / SHARD_BYTES) ** SHARD_GROWTH))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shards)
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string()).cast(pa.large_binary())
            yield from counter.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts)
        yield from counter.flush()

    packed = docs.select("lang", "source", "text").mapInArrow(count, _PACKED)
    return packed.groupBy("lang", "kind", "shard").applyInArrow(_merge_shard(least_docs), _COUNTED)


def _share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact: a long division, three digits at a time."""
    whole = total + 2 * kept
    value, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        value = value * 1000 + digit
    return value + 1


def _compare(key, terms: pa.Table, sides: pa.Table) -> pa.Table:
    """Sums over a shard's terms for each source of a block and each source behind it."""
    side = sides.to_pylist()[0]
    names, kept = [s["source"] for s in side["all"]], side["kept"]
    totals = np.array([s["total"] for s in side["all"]], dtype=np.int64)
    first = side["block"] * SOURCE_BLOCK
    last = min(first + SOURCE_BLOCK, len(names))
    counts = np.zeros((len(terms), len(names)), dtype=np.int64)
    if len(terms):
        lists = terms.column("sources").combine_chunks()
        at = np.repeat(np.arange(len(terms)), np.diff(lists.offsets.to_numpy()))
        column = pa.compute.index_in(lists.flatten(), pa.array(names, pa.string())).to_numpy()
        counts[at, column] = terms.column("counts").combine_chunks().flatten().to_numpy()
    shares = _share(counts, totals[None, :], kept).astype(np.uint64) if len(terms) else counts.astype(np.uint64)
    left, right, value = [], [], []
    for a in range(first, last):
        p, q = shares[:, a:a + 1], shares[:, a + 1:]
        gap = np.maximum(p, q) - np.minimum(p, q)
        value += ((gap * gap) // (p + q)).sum(axis=0).astype(np.int64).tolist()
        left += [names[a]] * q.shape[1]
        right += names[a + 1:]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()), "a": pa.array(left, pa.string()),
                     "b": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language, both ways.

    A task compares the terms of one shard over at most SOURCE_BLOCK times all sources, as a dense
    table; a language without terms has one empty shard.
    """
    langs = groups.groupBy("lang").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(F.struct("source", "total"))).alias("all"))
    most = langs.agg(F.max(F.size("all")), F.max(F.size("all") * F.col("kept"))).first()
    shards, blocks = max(1, -(-(most[1] or 0) // CELLS)), max(1, -(-(most[0] or 0) // SOURCE_BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = langs.withColumn("block", numbers(blocks)).filter(F.col("block") * SOURCE_BLOCK < F.size("all")).withColumn("shard", numbers(shards))
    terms = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "sources", "counts").withColumn("block", numbers(blocks))
    keys = ["lang", "block", "shard"]
    # A block beyond a language's sources has terms, but no side, and compares nothing.
    compared = (terms.join(sides.select(*keys), keys, "left_semi") if blocks > 1 else terms).groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(
        _compare, "lang string, a string, b string, value bigint")
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), "value"), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    return compared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.inline(both))


def _terms_above(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for the terms a source has more often than its language."""
    share = "1 + cast(1000000000 * cast({n} + 2 as decimal(20,0)) div cast({total} + 2 * kept as decimal(20,0)) as bigint)"
    own = kept.select("lang", "term", F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, n: s + n).alias("_every"),
                      F.inline(F.arrays_zip("sources", "counts"))).withColumnRenamed("sources", "source")
    rows = own.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").cast("string").alias("item"),
                                                       F.expr(share.format(n="counts", total="total")).alias("p"),
                                                       F.expr(share.format(n="_every", total="lang_total")).alias("q"))
    return rows.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.

    Terms are runs of letters and of characters that are not ASCII, A-Z lower-cased. A language keeps
    the terms that ``least_docs`` of its rows have. A share p is 1 + floor(10**9 * (count + 2) /
    (N + 2 V)), N the count over the V kept terms; the divergence of a term between shares p and q is
    floor((p - q)**2 / (p + q)). Part ``pair``: the sum of it over all kept terms to each other source
    of the language (0 if none is kept). Part ``term``: it against the whole language for the terms
    the source has, where p > q, the first ``top``. Ranks by value, then by the item's bytes.

    A null lang, source or text is empty; every row is a document, repeated ones too. A language with
    one source has no pairs. An empty table gives no rows. Other columns are not looked at.
    """
    rows = only(docs, "lang", "source", "text").select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text"))
    kept = stage(term_counts(rows, least_docs), "term-counts")
    sums = kept.select("lang", F.inline(F.arrays_zip("sources", "counts"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("total"))
    many = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(many, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = stage(groups.withColumn("lang_total", F.sum("total").over(W.partitionBy("lang"))), "term-groups")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = _pairs(kept, groups).withColumn("part", F.lit("pair")).withColumn("rank", rank)
    terms = _terms_above(kept, groups).withColumn("part", F.lit("term")).withColumn("rank", rank).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
