"""Near-duplicates by SetSketch registers.

A register holds the least of the exponential values that a document's shingles draw for it, on
a scale of powers of ``BASE`` and cut to its range. Registers of a union are the larger of two
registers, so sketches merge; equal registers are as likely as the sets are alike, so runs of
registers (bands) bring candidates together. The similarity of a candidate is estimated jointly
from all registers by likelihood and confirmed on the full sets.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentloom.llm.graph import components
from momentloom.session import stage

#: BANDS bands of ROWS registers miss a pair at similarity 0.8 three times in a million.
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Scale, rate and largest value of a register: values of 1 to 10**9 shingles stay inside.
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Percent of the union two sets must share. The estimate of such a pair falls this much below
#: it (five standard errors of 252 registers) less than once in a million.
PERCENT, MARGIN = 80, 0.13
#: Documents of a candidate group compared in one piece of work.
BLOCK = 256
_ODD = np.random.default_rng(7).integers(0, 2**63, (2, REGISTERS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """64-bit hashes of the distinct ``width``-word shingles of a text."""

    def __init__(self, width: int, remembered: int = 250_000):
        self.width, self.remembered, self.words = width, remembered, {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.words
        new = set(words).difference(known)
        if len(known) + len(new) > self.remembered:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted hashes. Letters A-Z are lower-cased, words cut at ASCII white space; a text of
        fewer words is one shingle, a text without words none."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = self.word_hashes(words)
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, np.uint64(width))
        for k in range(width):
            out = _mix(out * _SEED + h[k:len(h) - width + 1 + k])
        return np.unique(out)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of each set, a row of 16-bit values; an empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), dtype="<u2")
    full = [i for i, s in enumerate(sets) if len(s)]
    group, size = [], 0
    for n, i in enumerate(full):
        group.append(i)
        size += len(sets[i])
        if size < 32_768 and n + 1 < len(full):
            continue
        h = np.concatenate([sets[i] for i in group])
        starts = np.append(0, np.cumsum([len(sets[i]) for i in group])[:-1])
        least = np.empty((len(group), REGISTERS), dtype=np.uint64)
        for k in range(REGISTERS):
            least[:, k] = np.minimum.reduceat(h * _ODD[0, k] + _ODD[1, k], starts)
        drawn = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / RATE
        out[group] = np.clip(np.floor(1 - np.log(drawn) / log(BASE)), 0, TOP + 1)
        group, size = [], 0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sketched sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeliest similarity of each row of ``a`` and ``b`` (registers) with set sizes na, nb."""
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - more - less
    u, v = na / np.maximum(na + nb, 1), nb / np.maximum(na + nb, 1)
    factor = (BASE - 1) / BASE
    reach = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * factor) / log(BASE)

    def likelihood(j):
        up, down = reach(u - v * j), reach(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(np.shape(more)), np.minimum(np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12), 1.0)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct hashes share ``percent`` of their union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketch(docs: DataFrame, width: int, text: str = "text", with_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, fingerprint (of the whole set) and registers per row of ``docs``, and
    with ``with_sets`` shingles (64-bit hashes, binary)."""
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_hexdigest

        shingler = Shingler(width)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            for start in range(0, batch.num_rows, 256):
                sets = [shingler.shingles(t) for t in texts.slice(start, 256).to_pylist()]
                values = [r.tobytes() for r in registers(sets)]
                columns = [batch.column(0).slice(start, 256), pa.array([len(s) for s in sets], pa.int64()),
                           pa.array([xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.array(values, pa.binary())]
                if with_sets:
                    columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ["doc_id bigint", "n_shingles bigint", "fingerprint string", "registers binary", *(["shingles binary"] if with_sets else [])]
    names = [k.split()[0] for k in kinds]
    return docs.select(F.col("doc_id").cast("bigint"), F.col(f"`{text}`")).mapInArrow(run, ", ".join(kinds))


def _bands(sketches: DataFrame) -> DataFrame:
    """(band, id) for each band of each sketch; a band's key also tells its number."""
    return sketches.select(F.col("doc_id").alias("id"), F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: F.xxhash64(F.substring("registers", k * (2 * ROWS) + 1, F.lit(2 * ROWS)), k))).alias("band"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate is near enough and whose full sets are alike."""
    one = lambda side: sets.select(F.col("doc_id").alias(side), F.col("registers").alias(f"r{side}"), F.col("shingles").alias(f"s{side}"))
    sized = sets.select("doc_id", "n_shingles")
    near = (pairs.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b")
            .filter((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)).select("a", "b"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                a, b, ra, rb, sa, sb = (part.column(c).to_pylist() for c in ("a", "b", "ra", "rb", "sa", "sb"))
                sa, sb = ([np.frombuffer(x, dtype=np.uint64) for x in s] for s in (sa, sb))
                regs = [np.frombuffer(b"".join(r), dtype="<u2").reshape(-1, REGISTERS) for r in (ra, rb)]
                guess = estimate(*regs, np.array([len(s) for s in sa]), np.array([len(s) for s in sb]))
                keep = [i for i in range(len(a)) if guess[i] >= percent / 100 - MARGIN and alike(sa[i], sb[i], percent)]
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return near.join(one("a"), "a").join(one("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _compare_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links inside candidate groups that their hubs did not show.

    ``members``: grp, component, main (the group's largest component), n (members of the group on
    that side), doc_id and the columns of ``sketch``. Members outside the main component, in blocks, meet every block of the group; a
    piece of work is two blocks, and gives at most one link for each two components it joins.
    """
    # Blocks by hash: a group of any size is dealt out without being numbered in one task.
    at = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK))
    dealt = members.withColumn("_block", F.concat_ws(":", F.col("main").cast("string"), at.cast("string")))
    blocks = stage(dealt.select("grp", "_block", "main", "component", "doc_id", "registers", "shingles"), "blocks")
    kinds = blocks.select("grp", "_block", "main").distinct()
    odd = kinds.filter(~F.col("main")).select("grp", F.col("_block").alias("x"))
    work = odd.join(kinds.select("grp", F.col("_block").alias("y"), F.col("main").alias("_ym")), "grp").filter("_ym OR x <= y").select("grp", "x", "y")
    work = work.withColumn("piece", F.xxhash64("grp", "x", "y"))
    sides = (work.select("piece", "grp", F.col("x").alias("_block"), F.lit(True).alias("is_x"))
             .unionByName(work.select("piece", "grp", F.col("y").alias("_block"), F.lit(False).alias("is_x"))))
    rows = sides.join(blocks, ["grp", "_block"]).select("piece", "is_x", "component", "doc_id", "registers", "shingles")

    def compare(_, table):
        import pyarrow as pa

        is_x = np.array(table.column("is_x").to_pylist(), dtype=bool)
        ids, comps = table.column("doc_id").to_pylist(), table.column("component").to_pylist()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype="<u2").reshape(-1, REGISTERS)
        sizes = np.array([len(s) for s in sets])
        xs, ys = np.nonzero(is_x)[0], np.nonzero(~is_x)[0]
        found = []
        for x in xs.tolist():
            other = ys[(sizes[ys] * 100 >= sizes[x] * percent) & (sizes[x] * 100 >= sizes[ys] * percent)]
            other = other[[comps[y] != comps[x] for y in other.tolist()]] if len(other) else other
            if len(other):
                guess = estimate(regs[[x] * len(other)], regs[other], np.full(len(other), sizes[x]), sizes[other])
                found += [(-g, x, y) for g, y in zip(guess.tolist(), other.tolist()) if g >= percent / 100 - MARGIN]
        top: dict = {}

        def root(c):
            while top.get(c, c) != c:
                c = top[c]
            return c

        links = []
        for _, x, y in sorted(found):
            a, b = root(comps[x]), root(comps[y])
            if a != b and alike(sets[x], sets[y], percent):
                top[max(a, b)] = min(a, b)
                links.append((ids[x], ids[y]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return rows.groupBy("piece").applyInArrow(compare, "a bigint, b bigint")


def _hub_pairs(bands: DataFrame) -> DataFrame:
    """Pairs (a, b) of the hub of each band and the others there.

    The hub is that with the most company over all its bands, so that a group of near copies has
    few hubs: its members meet the most typical one in most of their bands, and each has a pair or
    two, however large the group.
    """
    met = stage(bands.join(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "band"), "bands")
    company = met.groupBy("id").agg(F.sum("n").alias("company"))
    hubs = met.join(company, "id").groupBy("band").agg(F.max_by("id", F.struct("company", (-F.col("id")).alias("_i"))).alias("hub"))
    return met.join(hubs, "band").filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def _same_documents(sets: DataFrame, first: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of a doc_id that has several."""
    several = sets.groupBy("doc_id").agg(F.min("fingerprint").alias("_one"), F.max("fingerprint").alias("_last")).filter("_one <> _last")
    pairs = sets.select("doc_id", "fingerprint").join(several, "doc_id").filter("fingerprint <> _one").select("_one", "fingerprint").distinct()
    named = lambda c, v: first.select(F.col("fingerprint").alias(c), F.col("vertex").alias(v))
    return pairs.join(named("_one", "a"), "_one").join(named("fingerprint", "b"), "fingerprint").select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, ``text``).

    Two documents are linked if their sets of ``width``-word shingles share ``percent`` of their
    union; component_id is the smallest doc_id reachable. Documents with equal sets are one from
    the start. The others meet in bands: each with a hub there (so a band of n documents gives
    n - 1 pairs), estimated, then confirmed. Documents of one candidate group that are still apart
    are compared in blocks, so no link is lost to the choice of hubs.

    Texts without words (null, empty, blank) are linked with nothing. Rows without doc_id are
    left alone: no component, kept. Rows that repeat a doc_id share its component, and each of
    their texts links. Extra columns of ``docs`` are not carried.
    """
    rows = stage(sketch(docs, width, text), "sketches")
    sets = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # A distinct set is a vertex; its number is fixed by being written.
    first = sets.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"))
    first = stage(first.withColumn("vertex", F.monotonically_increasing_id()), "representatives")
    pairs = stage(_hub_pairs(_bands(first.select(F.col("vertex").alias("doc_id"), "registers"))), "pairs")
    groups = stage(components(pairs).select(F.col("id").alias("vertex"), F.col("component").alias("grp")), "groups")
    wanted = first.join(groups, "vertex", "left_semi").select("fingerprint", "vertex", F.col("rep").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    members = sketch(texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), width, with_sets=True).drop("doc_id")
    full = stage(members.join(wanted.select("fingerprint", F.col("vertex").alias("doc_id")), "fingerprint").drop("fingerprint").dropDuplicates(["doc_id"]), "sets")
    links = stage(_confirmed(pairs, full, percent), "links")
    linked = components(links)
    placed = (groups.join(linked.select(F.col("id").alias("vertex"), "component"), "vertex", "left")
              .select("grp", F.col("vertex").alias("doc_id"), F.coalesce("component", "vertex").alias("component")))
    placed = stage(placed, "placed")
    sizes = placed.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("_n"))
    main = (sizes.groupBy("grp").agg(F.max(F.struct("_n", -F.col("component"))).alias("_m"), F.count(F.lit(1)).alias("_cs"))
            .filter("_cs > 1").select("grp", (-F.col("_m.col2")).alias("_main")))
    apart = placed.join(main, "grp").select("grp", "component", "doc_id", (F.col("component") == F.col("_main")).alias("main"))
    apart = stage(apart, "apart")
    apart = apart.join(apart.groupBy("grp", "main").agg(F.count(F.lit(1)).alias("n")), ["grp", "main"])
    more = _compare_blocks(apart.join(full.select("doc_id", "registers", "shingles"), "doc_id"), percent)
    final = components(stage(links.union(more).union(_same_documents(sets, first)), "links"))
    joined = stage(final.join(first.select(F.col("vertex").alias("id"), "fingerprint", "rep"), "id"), "linked")
    named = joined.groupBy("component").agg(F.min("rep").alias("_c"))
    answer = joined.join(named, "component").select("fingerprint", "_c")
    alone = first.join(joined.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", F.col("rep").alias("_c"))
    out = rows.select("doc_id", "n_shingles", "fingerprint").join(answer.unionByName(alone), "fingerprint", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id (of repeated rows of
    a doc_id all stay, and rows without doc_id stay)."""
    gone = near_duplicates(docs, width, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
