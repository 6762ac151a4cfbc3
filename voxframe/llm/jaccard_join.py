"""N-gram Jaccard join: word shingles, exact filters, and signature trees inside what is left.

1. A document can only be linked if four fifths of its shingles occur in other documents. Shingles are dealt
   out by hash, packed, to be counted; a slice of documents sends a shingle that it holds twice only once,
   so that frequent shingles stay small. Documents that fail are alone for certain.
2. Equal sets are one representative. Representatives that share a prefix shingle (two linked sets must) are
   chained into clusters; links never leave a cluster. Prefixes take frequent shingles last, so that a passage
   that many documents share does not chain them.
3. Inside a cluster a signature tree finds the links. Its nodes hold the OR of their members' token bitmaps,
   their size range and how far bitmaps undercount; a dual traversal drops node pairs whose greatest possible
   overlap is too small, or whose members are known to be connected, and verifies what is left on whole sets.
   A large cluster is first compared with some leaders; only what they leave is paired, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import keep_ids, lean, mix, random_words, slices, small_enough, staged, stored_bytes, tuned, utf8
from voxframe.llm.components import components

#: Words in a shingle, and the similarity of a link in hundredths.
WORDS, PERCENT = 5, 80
#: Shingles (8 bytes each) that one task holds of a cluster; larger clusters are cut into blocks of half as many.
MOST_SHINGLES = 2_000_000
#: Members of a large cluster that all others are compared with.
LEADERS = 4
#: Representatives from which on a prefix shingle is frequent, and how many such shingles are sent to tasks (8 bytes each):
#: with more of them, only more frequent ones count. Any choice gives the same links.
FREQUENT, MOST_FREQUENT = 32, 500_000
#: Children of a tree node.
FANOUT = 8
#: Bits of a shingle's hash that are counted; chance equals only let a document through to the next step.
COUNTED_BITS = 48
#: Bytes of the documents' files for each part that shingles are dealt to, so that parts do not grow with the input.
PART_BYTES = 8_000_000
#: Texts of a slice whose shingles are counted together before they are sent, in bytes.
COUNTED_BYTES = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTE = random_words(256, 11)
_PLACE = random_words(16, 13)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts in a row, and how many words each text has."""
    low = _LOWER[raw]
    solid = ~_BLANK[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(raw) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(raw) else solid
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    powers = np.cumprod(np.full(len(raw), _BASE))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[low] * powers)])
    back = np.cumprod(np.full(len(raw), _BACK))
    h = (sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)
    return mix(h), np.diff(np.searchsorted(start, offsets))


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text: size words each, or all words if there are fewer."""
    words, each = word_hashes(raw, offsets)
    at = np.concatenate([[0], np.cumsum(each)])
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h += words[i : i + n] * _PLACE[i]
    mix(h)
    for i, k in enumerate(each.tolist()):
        if k >= size:
            own = np.sort(h[at[i] : at[i] + k - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif k:
            yield mix((words[at[i] : at[i + 1]] * _PLACE[size : size + k]).sum(keepdims=True) + np.uint64(k))
        else:
            yield np.zeros(0, np.uint64)


def sets_of(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sets of several texts, hashed a slice at a time."""
    return [s for lo, hi in slices(offsets) for s in shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)]


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    second = mix(own ^ _PLACE[15])
    return int(own.sum().view(np.int64)), int(second.sum().view(np.int64))


def _counted(docs: DataFrame, parts: int, size: int) -> DataFrame:
    """(doc_id, n, d1, d2, shared): set sizes and digests, and how many shingles other documents have too.

    A row that is sent holds the shingles of one slice of documents that fall into one part, by document;
    documents are named by their slice and their place in it, both the same if a task runs again.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets, COUNTED_BYTES):
                sets = sets_of(raw, offsets[lo : hi + 1], size)
                sizes = np.array([len(s) for s in sets])
                flat, of = np.concatenate(sets), np.repeat(np.arange(hi - lo), sizes)
                order = np.argsort(flat)
                same = flat[order][1:] == flat[order][:-1]
                first, again = np.ones(len(flat), bool), np.zeros(len(flat), bool)
                first[order[1:][same]] = False
                again[order[1:][same]] = again[order[:-1][same]] = True
                here = np.bincount(of[again], minlength=hi - lo)
                digests = np.array([digest(s) for s in sets], "<i8").reshape(-1, 2)
                name = int(mix((ids[lo:hi].astype(np.uint64) + digests[:, 0].view(np.uint64)) * _PLACE[14] + np.arange(hi - lo, dtype=np.uint64)).sum().view(np.int64))
                own = np.concatenate([ids[lo:hi], sizes, digests[:, 0], digests[:, 1], here]).astype("<i8").tobytes()
                owner = np.where(again, -1, of)[first]  # -1: known to be shared here already, sent once
                flat = flat[first]
                part = (flat >> np.uint64(COUNTED_BITS)).astype(np.int64) % parts
                order = np.lexsort((owner, part)) if again.any() else np.argsort(part, kind="stable")
                flat, owner, part = flat[order], owner[order], part[order]
                bounds = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(bounds))
                blobs = []
                for p in some.tolist():
                    mine = owner[bounds[p] : bounds[p + 1]]
                    cut = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                    h = flat[bounds[p] : bounds[p + 1]]
                    blobs.append(np.array([len(cut), len(h)], "<i8").tobytes() + mine[cut].astype("<i4").tobytes() + np.diff(cut, append=len(mine)).astype("<i4").tobytes() + (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (h >> np.uint64(32)).astype("<u2").tobytes())
                some = np.concatenate([[-1 - name % parts], some]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), name)), pa.array([own, *blobs], pa.binary())], ["part", "slice", "rows"])

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, names = [], [], []
        for t in tables:
            for part, name, blob in zip(*(t.column(c).to_pylist() for c in ("part", "slice", "rows")), strict=True):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([True]), pa.array([blob])], ["slice", "own", "rows"])
                    continue
                d, n = np.frombuffer(blob, "<i8", 2).tolist()
                place, each, at = np.frombuffer(blob, "<i4", d, 16), np.frombuffer(blob, "<i4", d, 16 + 4 * d), 16 + 8 * d
                hashes.append(np.frombuffer(blob, "<u4", n, at).astype(np.uint64) | np.frombuffer(blob, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32))
                owners.append(np.where(np.repeat(place, each) < 0, np.int64(-1), np.repeat(place, each).astype(np.int64) | np.int64(len(names) << 32)))
                names.append(name)
        if hashes:
            h, who = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h)
            h, who = h[order], who[order]
            same = h[1:] == h[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            who, n = np.unique(who[shared & (who >= 0)], return_counts=True)
            cut = np.searchsorted(who >> 32, np.arange(len(names) + 1))
            place = (who & 0xFFFFFFFF).astype("<i4")
            some = np.flatnonzero(np.diff(cut)).tolist()
            blobs = [place[cut[i] : cut[i + 1]].tobytes() + n[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.int64()), pa.array([False] * len(some), pa.bool_()), pa.array(blobs, pa.binary())], ["slice", "own", "rows"])

    def merge(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, far = [], []
        for t in tables:
            for mine, blob in zip(t.column("own").to_pylist(), t.column("rows").to_pylist(), strict=True):
                if mine:
                    own.append(np.frombuffer(blob, "<i8").reshape(5, -1))
                else:
                    far.append(np.frombuffer(blob, "<i4").reshape(2, -1))
        for rows in own:  # more than one only if whole slices are equal; then each has what all of them were told
            shared = rows[4].copy()
            for place, n in far:
                shared[place] += n
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows[:4], shared)], ["doc_id", "n", "d1", "d2", "shared"])

    told = docs.mapInArrow(lean(send), "part int, slice long, rows binary").groupBy("part").applyInArrow(count, "slice long, own boolean, rows binary")
    return told.groupBy("slice").applyInArrow(merge, "doc_id long, n long, d1 long, d2 long, shared long")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, tokens): whole sorted sets, 8 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                sets = list(shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "tokens"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, tokens binary")


def _frequent(sets: DataFrame, percent: int) -> np.ndarray:
    """Sorted shingles that are in the plain prefixes of many sets; at most MOST_FREQUENT."""
    counts = staged(_prefixes(sets, percent, np.zeros(0, np.uint64)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    least = FREQUENT
    while not small_enough(counts.where(F.col("n") >= least), MOST_FREQUENT):
        least *= 2
    rows = counts.where(F.col("n") >= least).select("key").toPandas()["key"].to_numpy("<i8")  # MOST_FREQUENT numbers at most
    return np.sort(rows.view(np.uint64))


def _prefixes(sets: DataFrame, percent: int, frequent: np.ndarray) -> DataFrame:
    """(key, doc_id) for each prefix shingle: two sets that are linked have one in common, as all are in one order, frequent ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owner = [], []
            for doc, n, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                k = n - -(-percent * n // 100) + 1
                own = np.frombuffer(tokens.as_buffer(), "<u8", n)
                if len(frequent):
                    often = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
                    own = np.concatenate([own[~often], own[often]])
                keys.append(own[:k].view(np.int64))
                owner.append(np.full(k, doc, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owner))], ["key", "doc_id"])

    return sets.mapInArrow(lean(run), "key long, doc_id long")


class SignatureTree:
    """Sets in leaves of a tree whose nodes hold OR-combined token bitmaps, size ranges and undercounts."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.sets = sets
        n = len(sets)
        width = bits // 64
        maps = np.zeros((n, width), np.uint64)
        for i, s in enumerate(sets):
            bit = s & np.uint64(bits - 1)
            np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        size = np.array([len(s) for s in sets])
        over = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, over)]
        while len(self.levels[-1][0]) > FANOUT:
            maps, least, most, over = self.levels[-1]
            cut = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(over, cut)))


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs can hold a link: by size range, and by the greatest overlap that the bitmaps allow."""
    (_, low_a, high_a, _), (_, low_b, high_b, _) = a, b
    out = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
    i, j = i[out], j[out]
    most = np.zeros(len(i), np.int64)
    for lo in range(0, len(i), 4096):
        s = slice(lo, lo + 4096)
        most[s] = np.bitwise_count(a[0][i[s]] & b[0][j[s]]).sum(1)
    most += np.minimum(a[3][i], b[3][j])
    out[out] = (100 + percent) * most >= percent * (low_a[i] + low_b[j])
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def traverse(left: SignatureTree, right: SignatureTree | None, percent: int, root: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect members not connected before, by a dual traversal; root: union-find over left, then right, members."""
    same = right is None
    right = left if same else right
    shift = 0 if same else len(left.sets)
    found: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def expand(level_a: int, level_b: int, i: np.ndarray, j: np.ndarray) -> None:
        ok = possible(left.levels[level_a], right.levels[level_b], i, j, percent)
        i, j = i[ok], j[ok]
        if level_a == level_b == 0:
            some, at = np.unique(np.concatenate([i, j + shift]), return_inverse=True)
            tops = np.array([find(x) for x in some.tolist()], np.int64)[at]
            apart = tops[: len(i)] != tops[len(i) :]
            for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                p, q = find(x), find(y + shift)
                if p != q and linked(left.sets[x], right.sets[y], percent):
                    root[max(p, q)] = min(p, q)
                    found.append((x, y))
            return
        down_a, down_b = level_a >= level_b, level_b >= level_a
        for lo in range(0, len(i), 256):  # depth first in small steps: connected members leave early
            x, y = i[lo : lo + 256], j[lo : lo + 256]
            if down_a:
                n = len(left.levels[level_a - 1][0])
                x, y = (x[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(y, FANOUT)
                x, y = x[x < n], y[x < n]
            if down_b:
                n = len(right.levels[level_b - 1][0])
                y, x = (y[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(x, FANOUT)
                x, y = x[y < n], y[y < n]
            if same:
                keep = x < y if level_a == 1 else x <= y
                x, y = x[keep], y[keep]
            expand(level_a - down_a, level_b - down_b, x, y)

    a, b = len(left.levels) - 1, len(right.levels) - 1
    i, j = (x.ravel() for x in np.indices((len(left.levels[a][0]), len(right.levels[b][0]))))
    if same:
        keep = i < j if a == 0 else i <= j
        i, j = i[keep], j[keep]
    expand(a, b, i, j)
    return found


def _unit(tables: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of one unit: a cluster, or two blocks of one (side 0 against side 1; side 2 against itself and side 1)."""
    rows = sorted(((side, n, tokens[:8], doc, leader, tokens) for t in tables for doc, n, tokens, side, leader in zip(*(t.column(c).to_pylist() for c in ("doc_id", "n", "tokens", "side", "leader")), strict=True)), key=lambda x: x[:4])
    ids = [r[3] for r in rows]
    sets = [np.frombuffer(r[5], "<u8") for r in rows]
    bits = 1 << max(8, min(15, int(4 * np.median([len(s) for s in sets])).bit_length()))
    cut = sum(r[0] == 0 for r in rows)
    root = np.arange(len(rows))
    first: dict[int, int] = {}
    for x, r in enumerate(rows):  # what a leader has linked is connected
        if r[4] is not None:
            root[x] = root[first.setdefault(r[4], x)]
    left = SignatureTree(sets[:cut], bits) if cut else None
    right = SignatureTree(sets[cut:], bits) if cut < len(sets) else None
    found = []
    if left and right:
        found += [(ids[x], ids[cut + y]) for x, y in traverse(left, right, percent, root)]
    elif left:
        found += [(ids[x], ids[y]) for x, y in traverse(left, None, percent, root)]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _links(members: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): enough links between the sets of members (cluster, doc_id, n, tokens) to connect what is connected."""
    columns = ["doc_id", "n", "tokens"]
    totals = members.groupBy("cluster").agg(F.sum("n").alias("total"), F.min("doc_id").alias("lead"))
    big = staged(totals.where(F.col("total") > most), "big")

    def unit(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _unit(tables, percent)

    none = F.lit(None).cast("long")
    if not big.limit(1).count():
        whole = members.select("cluster", *columns, F.lit(0).alias("side"), none.alias("leader"))
        return whole.groupBy("cluster").applyInArrow(unit, "a long, b long")
    fits = small_enough(big, 100_000)
    rest = members.join(F.broadcast(big.select("cluster")) if fits else big.select("cluster"), "cluster", "left_anti")
    small = rest.select("cluster", *columns, F.lit(0).alias("side"), none.alias("leader")).groupBy("cluster").applyInArrow(unit, "a long, b long")
    large = members.join(F.broadcast(big) if fits else big, "cluster")

    # Leaders of a large cluster are members of middling size, told apart by hash; each member is compared with them where it lies.
    sizes = large.groupBy("cluster").agg(F.percentile_approx("n", 0.5, 1000).alias("mid"))
    off = F.floor(4 * F.abs(F.col("n") - F.col("mid")) / F.col("mid"))
    first = [F.min_by("doc_id", F.struct(off, F.xxhash64(F.lit(i), F.col("doc_id")), F.col("doc_id"))).alias(f"l{i}") for i in range(LEADERS)]
    near = large.join(F.broadcast(sizes) if fits else sizes, "cluster").groupBy("cluster").agg(*first)
    near = near.select("cluster", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("leader"))
    led = large.join(F.broadcast(near) if fits else near, "cluster").where("doc_id = leader").select("cluster", F.struct("leader", "tokens").alias("one")).groupBy("cluster").agg(F.sort_array(F.collect_list("one")).alias("leds"))  # LEADERS a cluster
    leaders = led.select("cluster", F.col("leds.leader").alias("leaders"), F.col("leds.tokens").alias("leds"))
    light = small_enough(leaders, 500)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, ids, leds = (b.column(b.schema.get_field_index(c)) for c in ("tokens", "leaders", "leds"))
            like = []
            for x, who, some in zip(t, ids, leds, strict=True):
                own = np.frombuffer(x.as_buffer(), "<u8")
                like.append([i for i, y in zip(who.as_py(), some, strict=True) if linked(own, np.frombuffer(y.as_buffer(), "<u8"), percent)])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("cluster", *columns)), pa.array(like, pa.list_(pa.int64()))], ["cluster", *columns, "likes"])

    told = large.select("cluster", *columns).join(F.broadcast(leaders) if light else leaders, "cluster").mapInArrow(lean(compare), "cluster long, doc_id long, n long, tokens binary, likes array<long>")
    told = staged(told, "led")
    stars = told.select(F.col("doc_id").alias("a"), F.explode("likes").alias("b"))
    # What leaders link is connected, also by members that two of them link. The heaviest such part of a cluster need not be compared within.
    hubs = staged(components(stars), "hubs")
    told = told.drop("likes").join(F.broadcast(hubs) if small_enough(hubs) else hubs, F.col("doc_id") == F.col("node"), "left").drop("node").withColumnRenamed("component", "leader")
    main = told.where("leader IS NOT NULL").groupBy("cluster", "leader").agg(F.sum("n").alias("w")).groupBy("cluster").agg(F.max_by("leader", F.struct("w", "leader")).alias("main"))
    told = told.join(F.broadcast(main) if fits else main, "cluster", "left").withColumn("like", F.coalesce(F.col("leader") == F.col("main"), F.lit(False))).drop("main")

    # What the leader leaves is cut into blocks, by size; each is paired with itself and with every block that its sizes allow.
    half = most // 2
    told = told.withColumn("slot", F.col("n").cast("long"))
    bands = told.groupBy("cluster", "like", "slot").agg(F.sum("n").alias("w"))
    order = Window.partitionBy("cluster", "like").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("from", F.coalesce(F.sum("w").over(order), F.lit(0)))
    spread = F.greatest(F.lit(1), F.ceil(F.col("w") / half))
    placed = told.join(bands, ["cluster", "like", "slot"]).withColumn("block", F.floor(F.col("from") / half) * 1_000 + F.pmod(F.xxhash64("doc_id"), spread))
    placed = staged(placed.select("cluster", *columns, "leader", "like", "block"), "blocks")
    blocks = placed.groupBy("cluster", "like", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = blocks.where("NOT like").alias("x"), blocks.alias("y")
    pairs = x.join(y, F.expr("x.cluster = y.cluster")).where(f"(y.like OR x.block <= y.block) AND 100 * x.high >= {percent} * y.low AND 100 * y.high >= {percent} * x.low")
    pairs = staged(pairs.select(F.col("x.cluster").alias("cluster"), F.col("x.block").alias("bx"), F.col("y.block").alias("by"), F.col("y.like").alias("ly"), F.monotonically_increasing_id().alias("unit")), "pairs")
    sides = pairs.select("cluster", F.lit(False).alias("like"), F.col("bx").alias("block"), "unit", F.lit(0).alias("side")).unionByName(pairs.where("ly OR bx <> by").select("cluster", F.col("ly").alias("like"), F.col("by").alias("block"), "unit", F.lit(1).alias("side")))
    units = placed.join(sides, ["cluster", "like", "block"]).select("unit", *columns, "side", "leader")
    return small.unionByName(stars).unionByName(units.groupBy("unit").applyInArrow(unit, "a long, b long"))


def join_similar(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, most: int = MOST_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document, exact.

    Words are runs of anything but ASCII white space, A-Z lowered. A set holds the distinct shingles of
    `size` words; a text of fewer words is one shingle; null, empty and blank texts have none, are linked
    with nothing and are their own component. Two documents are linked when 100 * intersection >= percent
    * union; component_id is the smallest doc_id reachable. Rows that share a doc_id each give a row, in
    the component of any of them; rows without a doc_id are left out. Other columns are not read.
    """
    spark = tuned(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), stored_bytes(docs) // PART_BYTES)
    facts = staged(_counted(docs, parts, size), "facts")
    same = staged(facts.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared")), "same")
    reps = same.where(100 * F.col("shared") >= percent * F.col("n")).select(F.col("rep").alias("doc_id"))
    sets = staged(_sets(keep_ids(docs, reps), size), "sets")
    keys = _prefixes(sets, percent, _frequent(sets, percent))
    lead = keys.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last")
    chained = components(keys.join(lead, "key").where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")))
    chained = staged(chained.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    members = sets.join(F.broadcast(chained) if small_enough(chained) else chained, "doc_id").select("cluster", "doc_id", "n", "tokens")
    whole = components(_links(members, percent, most))
    named = facts.join(same.drop("shared"), ["n", "d1", "d2"], "left").join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the smallest doc_id; same columns. Rows without a doc_id stay."""
    classes = join_similar(docs)
    return keep_ids(docs, staged(classes.where("doc_id <> component_id").select("doc_id").distinct(), "copies"), how="left_anti")
