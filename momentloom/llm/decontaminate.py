"""Benchmark decontamination: BM25 over test items, searched with block-max WAND.

The test items are the indexed side. Every passage of every training text is a query: all items
whose BM25 score reaches a share of the score they would give themselves are retrieved, then the
words of the item's question and answer are looked for in the passage itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import repeat
from math import ceil, log

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Share of an item's own score a passage must reach to be looked at.
THRESHOLD = 0.6
#: Shares of the question's and of the answer's word 5-grams that must stand in the passage.
QUESTION, ANSWER, GRAM = 0.7, 0.5, 5
BLOCK = 4
#: Test items put into one index, and their text; more take further passes over the texts.
INDEX_ITEMS, INDEX_BYTES = 1024, 1 << 20

_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of all other characters beyond."""
    return text.lower().encode().translate(_TABLE).split()


def split_item(text: str, answer: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """Words of question and answer. Without an answer of its own, an item's last sentence of
    more than two words is the answer; a single sentence is both."""
    if answer is not None and tokens(answer):
        return tokens(text) or tokens(answer), tokens(answer)
    parts = [p for p in (tokens(s) for s in re.split(r"(?<=[.!?])\s|\n", text)) if p]
    tail: list[bytes] = []
    while parts and len(tail) < 3:
        tail = parts.pop() + tail
    question = [w for p in parts for w in p]
    return question or tail, tail


def _grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the 5-grams of ``part`` (all of it, if shorter) that the passage has."""
    want = _grams(part)
    n = min(GRAM, len(part))
    have = {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)} if n else set()
    return len(want & have) / len(want) if want else 0.0


def _whole(question: list[bytes], answer: list[bytes]) -> list[bytes]:
    return question if question == answer else question + answer


class Statistics:
    """Of all items together: how many, their words, the longest, and items per term."""

    def __init__(self):
        self.n, self.words, self.longest, self.frequency = 0, 0, 0, Counter()

    def add(self, question: list[bytes], answer: list[bytes]) -> None:
        words = _whole(question, answer)
        self.n, self.words, self.longest = self.n + 1, self.words + len(words), max(self.longest, len(words))
        self.frequency.update(set(words))


class ItemIndex:
    """Inverted index of items: per term its items in order and the score each gets from it, as
    a share of the item's own score. Items of like length stand together; every ``BLOCK`` of
    them has, per term, the largest share in it (``bounds``: terms by blocks).
    """

    def __init__(self, items: list[tuple], statistics: Statistics | None = None):
        """``items``: (item_id, question words, answer words). ``statistics`` are those of the whole
        benchmark, of which these may be a part; by default of the items."""
        self.items = sorted(items, key=lambda x: len(_whole(*x[1:])))
        if statistics is None:
            statistics = Statistics()
            for item in items:
                statistics.add(*item[1:])
        bags = [Counter(_whole(q, a)) for _, q, a in self.items]
        mean, n = max(1.0, statistics.words / max(1, statistics.n)), statistics.n
        self.vocabulary: dict[bytes, int] = {t: k for k, t in enumerate({t: None for bag in bags for t in bag})}
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.vocabulary]
        for i, bag in enumerate(bags):
            size = sum(bag.values())
            weight = {t: log(1 + (n - statistics.frequency[t] + 0.5) / (statistics.frequency[t] + 0.5)) * k * (K1 + 1)
                      / (k + K1 * (1 - B + B * size / mean)) for t, k in bag.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                ids, shares = self.postings[self.vocabulary[t]]
                ids.append(i)
                shares.append(w / own)
        # Windows of two strides, one stride apart: an item lies whole in one of them.
        self.stride = max(32, statistics.longest)

    def prepare(self) -> None:
        """Lay out the block bounds; done where the index is used, not where it is sent from."""
        blocks = -(-len(self.items) // BLOCK)
        self.bounds = np.zeros((len(self.postings), blocks), dtype=np.float32)
        for t, (ids, shares) in enumerate(self.postings):
            np.maximum.at(self.bounds[t], np.array(ids) // BLOCK, np.array(shares, dtype=np.float32))

    def search(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of a block whose shares of the distinct ``terms`` sum to ``threshold``, with the
        sum. Lists are kept in order of the item they stand at; the item where the bounds of the
        lists up to it first reach the threshold is the next that can be found."""
        low, done = block * BLOCK, (block + 1) * BLOCK
        cursors = []
        for t in terms:
            bound = float(self.bounds[t, block])
            if bound > 0:
                at = bisect_left(self.postings[t][0], low)
                cursors.append([self.postings[t][0][at], at, bound, t])
        hits = []

        def skip(cursor: list, item: int) -> None:
            ids = self.postings[cursor[3]][0]
            cursor[1] = bisect_left(ids, item, cursor[1])
            cursor[0] = ids[cursor[1]] if cursor[1] < len(ids) else done

        while True:
            cursors = sorted((c for c in cursors if c[0] < done), key=lambda c: c[0])
            reached, pivot = 0.0, None
            for cursor in cursors:
                reached += cursor[2]
                if reached >= threshold:
                    pivot = cursor[0]
                    break
            if pivot is None:
                return hits
            front = [c for c in cursors if c[0] <= pivot]
            if cursors[0][0] == pivot:
                score = sum(self.postings[c[3]][1][c[1]] for c in front)
                if score >= threshold:
                    hits.append((pivot, score))
                for c in front:
                    skip(c, pivot + 1)
            else:
                for c in front:
                    skip(c, pivot)

    def leaks(self, texts: list[str], threshold: float, question: float, answer: float) -> list[list[tuple]]:
        """Per text (item_id, first word of the passage, score, question share, answer share) of
        the items found in it, the best passage of each."""
        threshold -= 1e-6  # sums of shares are rounded
        nothing, width = len(self.postings), 2 * self.stride
        kind = np.int16 if nothing < 32_000 else np.int32
        words_of, passages = [tokens(t) for t in texts], []
        for words in words_of:
            ids = np.fromiter(map(self.vocabulary.get, words, repeat(nothing)), dtype=kind, count=len(words))
            n = max(1, ceil((len(words) - self.stride) / self.stride))
            padded = np.full((n + 1) * self.stride, nothing, dtype=kind)
            padded[:len(ids)] = ids
            passages.append(np.sort(np.lib.stride_tricks.sliding_window_view(padded, width)[::self.stride], axis=1))
        best: list[dict[int, tuple]] = [{} for _ in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in passages])
        first = np.concatenate([np.arange(len(p)) for p in passages]) * self.stride
        passages = np.concatenate(passages)
        for k in range(0, len(passages), 500):
            part = passages[k:k + 500]
            known = part < nothing
            known[:, 1:] &= part[:, 1:] != part[:, :-1]
            counts = known.sum(1)
            rows = np.nonzero(counts)[0]
            if not len(rows):
                continue
            most = np.add.reduceat(self.bounds[part[known]], np.append(0, np.cumsum(counts[rows])[:-1]), axis=0)
            # A block whose bounds fall short of the threshold has no pivot: none is lost.
            for r, block in zip(*(x.tolist() for x in np.nonzero(most >= threshold - 1e-4))):
                p = rows[r]
                d, start = int(owner[k + p]), int(first[k + p])
                for i, score in self.search(part[p][known[p]].tolist(), block, threshold):
                    name, q, a = self.items[i]
                    passage = words_of[d][start:start + width]
                    shares = overlap(q, passage), overlap(a, passage)
                    if shares[0] >= question and shares[1] >= answer and (i not in best[d] or best[d][i][2] < score):
                        best[d][i] = (name, start, float(score), *shares)
        return [[b[i] for i in sorted(b)] for b in best]


def _split_items(benchmark: DataFrame):
    """(item_id, question words, answer words, characters) of the items that have words."""
    has_answer = "answer" in benchmark.columns
    for row in benchmark.select("item_id", "text", *(["answer"] if has_answer else [])).toLocalIterator():
        question, answer = split_item(row["text"] or "", row["answer"] if has_answer else None)
        if question:
            yield row["item_id"], question, answer, len(row["text"] or "")


def _indexes(benchmark: DataFrame) -> list[ItemIndex]:
    """Test items in indexes of ``INDEX_ITEMS`` items and ``INDEX_BYTES`` of text each. Weights and the
    width of passages come from the whole benchmark, read once before, so an item's scores are the
    same in whatever index it is."""
    statistics = Statistics()
    for _, question, answer, _ in _split_items(benchmark):
        statistics.add(question, answer)
    out, items, size = [], [], 0
    for name, question, answer, chars in _split_items(benchmark):
        items.append((name, question, answer))
        size += chars
        if size >= INDEX_BYTES or len(items) >= INDEX_ITEMS:
            out.append(ItemIndex(items, statistics))
            items, size = [], 0
    return out + ([ItemIndex(items, statistics)] if items else [])


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD,
               question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """Add ``leaks``: array of (item_id, at, score, question_share, answer_share) per document.

    ``benchmark`` has item_id, text and perhaps answer. Passages are overlapping windows of the
    whole text, twice as long as the longest item (64 words at least), so no item is cut. A
    document's rows stay where they are: no shuffle, and a text of any length is one row. A null,
    empty or blank text, and an empty benchmark, give empty arrays; repeated items are found each.
    A column named leaks is replaced. Each index goes to the executors as a broadcast of at most
    ``INDEX_ITEMS`` items; a larger benchmark makes several passes.
    """
    kept = [c for c in docs.columns if c != "leaks"]
    leak = "array<struct<item_id: bigint, at: bigint, score: double, question_share: double, answer_share: double>>"
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.array().cast(leak).alias("leaks"))
    for index in _indexes(benchmark):
        # Pickled with its class, so that executors need no copy of this package.
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

        def find(batches, shared=shared):
            import pyarrow as pa

            index = cloudpickle.loads(shared.value)
            index.prepare()
            names = ("item_id", "at", "score", "question_share", "answer_share")
            for batch in batches:
                for start in range(0, batch.num_rows, 200):
                    part = batch.slice(start, 200)
                    new = index.leaks([t or "" for t in part.column(text).to_pylist()], threshold, question, answer)
                    new = [old + [dict(zip(names, x)) for x in found] for old, found in zip(part.column("leaks").to_pylist(), new)]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(new, part.column("leaks").type)], names=kept + ["leaks"])

        out = out.mapInArrow(find, out.schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    return with_leaks(docs, benchmark).filter(F.size("leaks") == 0).drop("leaks")
