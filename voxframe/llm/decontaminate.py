"""Benchmark decontamination by pigeonhole edit matching.

An item may differ from a document's passage by a budget of k edits. Cut into k + 1 pieces, one of them must
occur unchanged: all pieces of all items are searched in one pass (Aho-Corasick). Around each piece hit the
whole item is verified with Myers' bit-parallel edit distance, run for many hits at once, one bit a row.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import keep_ids, lean, slices, staged, tuned, utf8

#: Edits allowed for each byte of an item's normalised text.
ERROR_RATE = 0.08
#: Bytes of items that one pass searches for; a larger benchmark takes several passes over the documents, one after the other.
PASS_BYTES = 8_000_000

_WORD = np.ones(256, bool)
_WORD[:128] = [chr(i).isalnum() for i in range(128)]
_ONE = np.uint64(1)


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts with every run of ASCII characters that are no letters or digits as one space, one at each end too."""
    sizes = np.diff(offsets)
    n = len(sizes)
    out = np.full(int(offsets[-1]) + 2 * n, 32, np.uint8)
    at = np.arange(int(offsets[-1])) + 2 * np.repeat(np.arange(n), sizes) + 1
    out[at] = np.where(_WORD[raw], raw, 32)
    starts = offsets[:-1] + 2 * np.arange(n)
    keep = out != 32
    keep[1:] |= out[:-1] != 32
    keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[np.append(starts, len(out))]


def normal_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised texts of a column, letters lowered."""
    return normalise(*utf8(pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string())))


class Matcher:
    """Items, their pieces in one automaton, and their bit masks by byte."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE) -> None:
        import ahocorasick

        raw, at = normal_texts(pa.array([t for _, t in items], pa.string()))
        self.ids, self.texts, self.budgets = [], [], []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (item, _) in enumerate(items):
            text = raw[at[i] : at[i + 1]]
            if item is None or len(text) < 3:
                continue
            k = int(rate * (len(text) - 2))
            if k:  # an item too short for an edit must stand between word ends
                text = text[1:-1]
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b].tobytes().decode("latin-1"), []).append((len(self.ids), b))
            self.ids.append(item)
            self.texts.append(text)
            self.budgets.append(k)
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()
        self.words = [-(-len(t) // 64) for t in self.texts]
        seen: Counter[int] = Counter()
        self.place = []
        for w in self.words:
            self.place.append(seen[w])
            seen[w] += 1
        self.masks: dict[int, np.ndarray] = {}

    def mask(self, words: int) -> np.ndarray:
        """For the items of so many 64-bit words: which bytes of each item equal each of the 256 bytes."""
        got = self.masks.get(words)
        if got is None:
            own = [t for t, w in zip(self.texts, self.words, strict=True) if w == words]
            got = np.zeros((words, len(own), 256), np.uint64)
            for i, text in enumerate(own):
                for j, c in enumerate(text.tolist()):
                    got[j // 64, i, c] |= _ONE << np.uint64(j % 64)
            self.masks[words] = got = got.reshape(words, -1)
        return got

    def distances(self, words: int, items: list[int], windows: list[np.ndarray]) -> np.ndarray:
        """The least edit distance of each item to any part of its window; Myers' recurrence over all of them at once."""
        peq, n = self.mask(words), len(windows)
        m = np.array([len(self.texts[i]) for i in items], np.int64)
        row = np.array([self.place[i] for i in items], np.int64) * 256
        text = np.zeros((max(map(len, windows)), n), np.uint8)  # byte 0 occurs in no normalised item
        for i, w in enumerate(windows):
            text[: len(w), i] = w
        pv, mv = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
        last = ((m - 1) % 64).astype(np.uint64)
        score = m.copy()
        best = score.copy()
        for c in text:
            plus, minus = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            at = row + c
            for w in range(words):
                eq, p, q = peq[w][at], pv[w], mv[w]
                xv = eq | q
                eq |= minus
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = q | ~(xh | p), p & xh
                top = last if w == words - 1 else np.uint64(63)
                up, down = (ph >> top) & _ONE, (mh >> top) & _ONE
                ph, mh = (ph << _ONE) | plus, (mh << _ONE) | minus
                pv[w], mv[w] = mh | ~(xv | ph), ph & xv
                plus, minus = up, down
            score += plus.astype(np.int64)
            score -= minus.astype(np.int64)
            np.minimum(best, score, out=best)
        return best

    def batch(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item id, distance) for each item within its budget of each normalised text."""
        if not self.ids:
            return
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        rows = at.tolist()
        row = 0
        for end, where in self.automaton.iter(raw.tobytes().decode("latin-1")):
            while end >= rows[row + 1]:
                row += 1
            for item, b in where:
                k = self.budgets[item]
                lo = max(rows[row], end + 1 - b - k)
                hi = min(rows[row + 1], end + 1 - b + len(self.texts[item]) + k)
                own = spans.setdefault((item, row), [])
                if own and lo <= own[-1][1] and own[-1][0] <= hi and max(hi, own[-1][1]) - min(lo, own[-1][0]) <= 4 * len(self.texts[item]):
                    own[-1] = (min(lo, own[-1][0]), max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        jobs: dict[int, list[tuple[int, int, int, int]]] = {}
        for (item, row), parts in spans.items():
            jobs.setdefault(self.words[item], []).extend((hi - lo, item, row, lo) for lo, hi in parts)
        least: dict[tuple[int, int], int] = {}
        for words, parts in jobs.items():
            parts.sort()
            for i in range(0, len(parts), 4096):
                some = parts[i : i + 4096]
                got = self.distances(words, [x[1] for x in some], [raw[lo : lo + n] for n, _, _, lo in some])
                for (_, item, row, _), d in zip(some, got.tolist(), strict=True):
                    if d <= self.budgets[item]:
                        least[row, item] = min(d, least.get((row, item), d))
        yield from ((row, self.ids[item], d) for (row, item), d in least.items())


@lru_cache(maxsize=1)
def _matcher(name: str, items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    """The worker's own matcher of a pass: the automaton is made once a worker, not once a task."""
    return Matcher(list(items), rate)


def _passes(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of bounded size, in order of their ids."""
    group, size = [], 0
    for item, text in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append((item, text))
        size += len(text)
    if group:
        yield group


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, distance) for each document that holds an item within its budget of edits.

    Texts are lowered and every run of ASCII characters that are no letters or digits is one space; the
    distance counts bytes of that form, and is the least over the document. The budget is rate times the
    item's length in bytes of that form, rounded down, and may be 0: such short items must occur exactly, as
    whole words. Null or empty documents and items match nothing. Rows that share a doc_id (or an item_id)
    give one row, with the least distance; rows without a doc_id are left out. Other columns are not read.
    A benchmark of more than pass_bytes is searched in several passes, each of which is written before the
    next one's items are sent: neither the driver nor a worker holds more than one pass of it.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def searched(group: list[tuple[int, str]]) -> tuple[DataFrame, object]:
        sent, name = spark.sparkContext.broadcast(tuple(group)), uuid.uuid4().hex  # of pass_bytes at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent.value, rate)
            for b in batches:
                _, offsets = utf8(b.column(1))
                for lo, hi in slices(offsets):
                    found = list(matcher.batch(*normal_texts(b.column(1).slice(lo, hi - lo))))
                    ids = b.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[r]) for r, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.int64())], ["doc_id", "item_id", "distance"])

        return rows.mapInArrow(lean(run), "doc_id long, item_id long, distance long"), sent

    out, passes = None, _passes(benchmark, pass_bytes)
    group, ahead = next(passes, None), next(passes, None)
    while group:
        part, sent = searched(group)
        if out is not None or ahead:
            part = staged(part, "leaks")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
        group, ahead = ahead, next(passes, None)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, distance long")
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item; same columns. Rows without a doc_id stay."""
    return keep_ids(docs, staged(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaks"), how="left_anti")
