"""Quality classifier: interpolated modified Kneser-Ney models of byte n-grams, trained on trusted and on toxic text.

Counts, continuation counts, discounts and probabilities are DataFrame group-bys and joins. A language's
models are packed and meet its documents, sent as packed texts, in a join. The trusted model's perplexity
of a whole document tells broken text. A few toxic words hardly move it, so the log-ratio of the toxic and
the trusted model is summed over short windows, and the highest window of a document tells toxic text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import keep_ids, lean, mix, slices, small_enough, staged, stored_bytes, tuned, utf8

#: Bytes in an n-gram (at most 7). A language's documents are dealt to one in SHARDS of the shuffle's partitions, or fewer for little text.
ORDER, SHARDS = 5, 6
#: Bytes of the documents' files for each copy of a language's models, and parts that a language's model is packed in.
COPY_BYTES, PARTS = 16_000_000, 16
#: Bytes in a window over which the log-ratio of the toxic and the trusted model is summed.
TOXIC_WINDOW = 16
#: Of trusted documents one in HELD_OUT sets thresholds and is not trained on, so thresholds carry no memory of the text.
HELD_OUT = 5
#: Log-losses are smoothed as if the document went on for PRIOR bytes at its language's mean: short texts vary most.
PRIOR = 60
#: Documents beyond this quantile of held-out trusted documents of their language are rejected, by perplexity or by their most toxic window.
QUANTILE = 0.99
#: Discounts lie between LEAST_DISCOUNT and MOST_DISCOUNT times the count they are for.
LEAST_DISCOUNT, MOST_DISCOUNT = 0.1, 0.95


def grams(raw: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every byte n-gram: order - 1 zero bytes stand before each text and one after it."""
    sizes = np.diff(offsets)
    padded = np.zeros(int(offsets[-1] - offsets[0] + len(sizes) * order), np.uint8)
    starts = offsets[:-1] - offsets[0] + np.arange(len(sizes)) * order
    row_of_byte = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row_of_byte)) + row_of_byte * order + order - 1
    padded[at] = raw[offsets[0] : offsets[-1]]
    n = len(padded) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = np.zeros(n, np.int64)
    for i in range(order):
        g <<= 8
        g |= padded[i : i + n]
    row = np.repeat(np.arange(len(sizes)), sizes + order)[:n]
    whole = np.arange(n) - starts[row] <= sizes[row]
    return row[whole], g[whole]


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, held): documents labelled good and not toxic; held ones set thresholds."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    return good.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)


def toxic_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): documents labelled toxic, whatever their quality."""
    return labels.where("toxic = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()


def counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): n-gram counts of all texts; a task adds up its own before the shuffle."""
    tuned(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}

        def merged(parts: list) -> list:
            g, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return [(g, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64))]

        def rows(lang: str, parts: list) -> pa.RecordBatch:
            g, n = merged(parts)[0]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for b in batches:
            raw, offsets = utf8(b.column(1))
            langs = np.array(b.column(0).to_pylist(), object)
            for lo, hi in slices(offsets):
                row, g = grams(raw, offsets[lo : hi + 1], order)
                of = langs[lo:hi][row]
                for lang in set(langs[lo:hi]):
                    own, n = np.unique(g[of == lang], return_counts=True)
                    parts = total.setdefault(lang, [])
                    parts.append((own, n))
                    if len(parts) > 16:
                        total[lang] = parts = merged(parts)
                        if len(parts[0][0]) > 1_000_000:  # bounds memory; what is sent early is added up later
                            yield rows(lang, total.pop(lang))
        for lang, parts in total.items():
            yield rows(lang, parts)

    return texts.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string")).mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, key, p, gamma): p of each k-gram `key`, fully interpolated; gamma of each context of order k, p null.

    Order `order` uses counts, each lower order continuation counts: in how many k+1-grams a k-gram ends.
    Below the unigrams lies the uniform distribution over 256 bytes.
    """
    levels = {order: staged(counts(texts, order), "grams")}
    for k in range(order - 1, 0, -1):
        up = levels[k + 1]
        levels[k] = up.groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    clamp = lambda d, i: F.least(F.greatest(d, F.lit(LEAST_DISCOUNT)), F.lit(MOST_DISCOUNT * i))
    lower, out = None, None
    for k in range(1, order + 1):
        t = levels[k]
        ones = t.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
        part = lambda i, y=y: F.coalesce((i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))), F.lit(0.5 * i))
        d = ones.select("lang", *[clamp(part(i), i).alias(f"d{i}") for i in (1, 2, 3)])
        t = t.join(F.broadcast(d), "lang") if small_enough(d, 10_000) else t.join(d, "lang")
        t = t.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("ctx", F.shiftright("gram", 8))
        ctx = t.groupBy("lang", "ctx").agg(F.sum("n").alias("t"), F.sum("d").alias("ds")).select("lang", "ctx", "t", (F.col("ds") / F.col("t")).alias("gamma"))
        t = t.join(ctx, ["lang", "ctx"]).withColumn("low", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
        t = t.join(lower, ["lang", "low"]) if lower is not None else t.withColumn("below", F.lit(1.0 / 256))
        t = t.select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("t") + F.col("gamma") * F.col("below")).alias("p"))
        rows = t.select("lang", F.lit(k).alias("k"), F.col("gram").alias("key"), "p", F.lit(None).cast("double").alias("gamma"))
        rows = rows.unionByName(ctx.select("lang", F.lit(k).alias("k"), F.col("ctx").alias("key"), F.lit(None).cast("double").alias("p"), "gamma"))
        rows = staged(rows, "level")  # else the plan of each order holds those of all lower ones several times
        lower = rows.where("p IS NOT NULL").select("lang", F.col("key").alias("low"), F.col("p").alias("below"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for i in range(n):
        out.append(np.frombuffer(raw[at : at + sizes[i]], kinds[i % len(kinds)]))
        at += int(sizes[i])
    return out


def packed(model: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, model): each language's model as an array of PARTS blobs; keys are dealt to parts by hash, each part is packed by itself."""
    tuned(model.sparkSession)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        arrays = []
        for k in range(1, order + 1):
            own = group[group.k == k]
            for value in ("p", "gamma"):
                some = own[own[value].notna()].sort_values("key")
                arrays += [np.diff(some["key"].to_numpy("<i8"), prepend=0), np.log(some[value].to_numpy("<f8"))]  # differences pack well
        return pd.DataFrame({"lang": group.lang.iloc[:1], "model": [_pack(*arrays)]})

    parts = model.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS))).groupBy("lang", "part").applyInPandas(pack, "lang string, model binary")
    return parts.groupBy("lang").agg(F.collect_list("model").alias("model"))


def unpacked(parts: list[bytes]) -> list[np.ndarray]:
    """A packed model's arrays for each order: sorted n-grams and their log p, sorted contexts and their log gamma."""
    pieces = [_unpack(p, "<i8", "<f8") for p in parts]
    out = []
    for i in range(0, len(pieces[0]), 2):
        keys, values = np.concatenate([np.cumsum(p[i]) for p in pieces]), np.concatenate([p[i + 1] for p in pieces])
        at = np.argsort(keys)
        out += [keys[at], values[at]]
    return out


def log_p(model: list[np.ndarray], grams_: np.ndarray, order: int) -> np.ndarray:
    """Log-probabilities of n-grams under a packed model."""
    out = np.full(len(grams_), -math.log(256))
    for k in range(1, order + 1):
        keys, p, contexts, gamma = model[4 * (k - 1) : 4 * k]
        if not len(keys):
            continue
        g = grams_ & ((1 << 8 * k) - 1)
        i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        j = np.minimum(np.searchsorted(contexts, g >> 8), len(contexts) - 1)
        out = np.where(keys[i] == g, p[i], np.where(contexts[j] == g >> 8, gamma[j] + out, out))
    return out


def peaks(ratio: np.ndarray, starts: np.ndarray, window: int = TOXIC_WINDOW) -> np.ndarray:
    """The highest sum over a window of each document's values; documents start at `starts`, shorter ones are one window."""
    total = np.concatenate([[0.0], np.cumsum(ratio)])
    ends = np.append(starts[1:], len(ratio))
    at = np.arange(len(ratio))
    to = np.minimum(at + window, np.repeat(ends, ends - starts))
    sums = np.where(to - at == window, total[to] - total[at], -np.inf)
    sums[starts] = total[to[starts]] - total[starts]
    return np.maximum.reduceat(sums, starts)


def _documents(docs: DataFrame, copies: int) -> DataFrame:
    """(lang, salt, docs): the packed texts of one language in a batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for lang in b.column(1).unique().to_pylist():
                own = b.filter(pc.equal(b.column(1), lang))
                raw, offsets = utf8(own.column(2))
                ids = own.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                salt = int(mix(ids[:1].astype(np.uint64) + np.uint64(len(raw)))[0] % np.uint64(copies))
                out.append((lang, salt, _pack(ids, np.diff(offsets).astype("<i8"), raw)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["lang", "salt", "docs"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(run), "lang string, salt int, docs binary")


def losses(docs: DataFrame, model: DataFrame, order: int = ORDER, n: int = SHARDS, toxic: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, n_grams, loss, peak): the sum of -log p over all n-grams of each document, and its most toxic window.

    peak is the highest sum, over a window, of the log-ratio of the toxic model and the model; null without
    a toxic model of the language. Models come in copies, told apart by their salt, so that a language's
    documents can be dealt evenly.
    """
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parsed = (None, None), [None, None]
        for b in batches:
            for lang, blob, *both in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                if (both := tuple(m.as_py() for m in both)) != last:
                    last, parsed = both, [None if m is None else unpacked(m) for m in both]
                ids, sizes, raw = _unpack(blob.as_py(), "<i8", "<i8", "u1")
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                for lo, hi in slices(offsets):
                    _, g = grams(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], order)
                    at, words = pd.factorize(g)
                    each = sizes[lo:hi] + 1
                    starts = np.cumsum(each) - each
                    p, q = (None if m is None else log_p(m, words, order) for m in parsed)
                    loss = pa.nulls(len(each), pa.float64()) if p is None else pa.array(-np.add.reduceat(p[at], starts))
                    peak = pa.nulls(len(each), pa.float64()) if p is None or q is None else pa.array(peaks((q - p)[at], starts))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array([lang] * len(each), pa.string()), pa.array(each), loss, peak], ["doc_id", "lang", "n", "loss", "peak"])

    copies = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n, max(2, stored_bytes(docs) // COPY_BYTES)))
    models = packed(model, order)
    models = models.withColumn("toxic", F.lit(None).cast("array<binary>")) if toxic is None else models.join(packed(toxic, order).withColumnRenamed("model", "toxic"), "lang", "left")
    models = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    joined = _documents(docs, copies).join(models, ["lang", "salt"], "left").select("lang", "docs", "model", "toxic")
    parts = joined.mapInArrow(lean(run), "doc_id long, lang string, n long, loss double, peak double")
    return parts.groupBy("doc_id", "lang").agg(F.sum("n").alias("n_grams"), F.sum("loss").alias("loss"), F.max("peak").alias("peak"))


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, n: int = SHARDS, quantile: float = QUANTILE, prior: int = PRIOR) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, threshold, toxicity, toxic_threshold, rejected for each document that has a doc_id.

    One model is trained on all documents labelled good and not toxic, but the held-out fifth, another on
    those labelled toxic; thresholds of perplexity and of toxicity (the most toxic window) are a
    quantile of the held-out ones, for each language. A document of a language without trusted text has
    no threshold and is kept (its perplexity is null if its language was never trained); one of a language without toxic
    text has no toxicity. Null and empty texts are one n-gram of padding. Rows that share a doc_id and a
    language count as one document. Documents without a label are scored like all others; null languages
    are one language, ""; other columns are not read.
    """
    tuned(docs.sparkSession)
    docs = docs.select("doc_id", "lang", "text")
    good = trusted(labels)
    taught = [keep_ids(docs, ids).withColumn("lang", F.concat(F.lit(mark), F.coalesce(F.col("lang").cast("string"), F.lit("")))) for mark, ids in (("+", good.where("NOT held").select("doc_id")), ("-", toxic_ids(labels)))]
    model = train(taught[0].unionByName(taught[1]), order)
    clean, toxic = (model.where(F.col("lang").startswith(mark)).withColumn("lang", F.expr("substring(lang, 2)")) for mark in "+-")
    scored = staged(losses(docs, clean, order, n, toxic), "losses")
    tagged = scored.join(good, "doc_id", "left")
    means = tagged.where("NOT held").groupBy("lang").agg((F.sum("loss") / F.sum("n_grams")).alias("mean"))
    tagged = tagged.join(means.hint("broadcast") if small_enough(means, 10_000) else means, "lang", "left")
    tagged = tagged.withColumn("smooth", (F.col("loss") + prior * F.col("mean")) / (F.col("n_grams") + prior))
    limits = tagged.where("held").groupBy("lang").agg(*[F.percentile_approx(v, quantile, 10_000).alias(limit) for v, limit in (("smooth", "limit"), ("peak", "most"))])
    tagged = tagged.join(limits.hint("broadcast") if small_enough(limits, 10_000) else limits, "lang", "left")
    out = tagged.select("doc_id", "lang", "n_grams", *[F.round(v, digits).alias(name) for v, digits, name in ((F.exp("smooth"), 9, "perplexity"), (F.exp("limit"), 9, "threshold"), (F.col("peak"), 6, "toxicity"), (F.col("most"), 6, "toxic_threshold"))])
    beyond = [F.coalesce(F.col(v) > F.col(limit), F.lit(False)) for v, limit in (("perplexity", "threshold"), ("toxicity", "toxic_threshold"))]
    return out.withColumn("rejected", beyond[0] | beyond[1])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones; same columns. Rows without a doc_id stay."""
    bad = staged(classify(docs, labels).where("rejected").select("doc_id").distinct(), "rejected")
    return keep_ids(docs, bad, how="left_anti")
