"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes cuts every text where its content says so, so that equal passages
give equal chunks wherever they stand. Distinct chunks are looked up among those that a worker has met, in
whatever document; only the others are encoded, whole. The ids of a chunk's first and last word are
provisional, as a cut may have gone through them. Joins are repaired by re-encoding a window around each
cut, with a word of context on either side: where the ids of that context agree with what both chunks say,
the window's ids stand. Else the context doubles, up to the chunks' ends, and then to the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import lean, random_words, tuned, utf8
from voxframe.llm.words import Memo, column_encoder, joined, tokenizer

#: Rolling window in bytes (a power of two), and bits of the hash that must be 0 at a cut: 256 bytes a chunk on average.
WINDOW, CUT_BITS = 16, 8
#: Bytes of chunks and ids that a worker keeps, of words and ids beside them, and of texts that are encoded at once. They bound memory only.
MOST_BYTES, WORD_BYTES, AT_ONCE = 12_000_000, 6_000_000, 2_000_000
#: Bytes whose rolling hashes are held at once.
HASHED_BYTES = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_GEAR = random_words(256, 7)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where content-defined chunks end in UTF-8 bytes: after each byte whose window hashes to 0, never inside a character."""
    found = []
    for lo in range(0, len(raw), HASHED_BYTES):
        first = max(0, lo - WINDOW)
        h = _GEAR[raw[first : lo + HASHED_BYTES]]
        width = 1
        while width < WINDOW:
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
            width *= 2
        hit = (h >> np.uint64(40)) & np.uint64((1 << CUT_BITS) - 1) == 0
        hit[: max(WINDOW if lo == 0 else 0, lo - first)] = False
        found.append(np.flatnonzero(hit) + first + 1)
    at = np.concatenate([np.zeros(0, np.int64), *found])
    while len(at := at[at < len(raw)]) and (inside := (raw[at] & 0xC0) == 0x80).any():
        at = at + inside
    return np.unique(at)


def _same(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether x[a : a + size] equals y[b : b + size], for each pair."""
    wrong = joined(a, sizes, x) != joined(b, sizes, y)
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), wrong, len(sizes)) == 0


class ChunkEncoder:
    """Texts to ids, with a memo of chunks shared by all documents of a worker.

    encode: the ids of texts in a row, and where each text's begin; by default words are looked up as well.
    """

    def __init__(self, path: str | None = None, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] | None = None, most: int = MOST_BYTES) -> None:
        self.encode = encode or column_encoder(path, WORD_BYTES).column
        self.chunks = Memo(self._chunks, pa.large_binary(), most)
        self.grown = self.whole = 0

    def _chunks(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, at = self.encode(pieces.cast(pa.large_string()))
        return at, ids

    def _ranges(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of raw[start:end] for each pair, and where each range's begin."""
        at = np.concatenate([[0], np.cumsum(end - start)])
        text = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(joined(start, end - start, raw))])
        return self.encode(text)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more than texts). Null counts as empty."""
        raw, offsets = utf8(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        bounds = np.unique(np.concatenate([cuts(raw), offsets]))
        start, stop = bounds[:-1], bounds[1:]
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        begin, size, pool = self.chunks.ids(coded.dictionary)
        index = coded.indices.to_numpy()
        begin, size = begin[index], size[index]
        blank = np.flatnonzero(_BLANK[raw])
        lo, hi = np.searchsorted(blank, start), np.searchsorted(blank, stop)
        solid = lo == hi
        begins, ends = np.isin(start, offsets), np.isin(stop, offsets)
        held = np.append(blank, len(raw))
        # what lies between a chunk's first and last blank stands as it is; at a text's ends there is nothing to repair
        left = np.where(begins, start, np.where(solid, stop, held[lo]))
        right = np.where(ends, stop, np.where(solid, start, held[hi - 1]))
        kept = left <= right
        kept &= ~solid | begins & ends
        heads, tails = np.flatnonzero(kept & ~begins), np.flatnonzero(kept & ~ends)
        n_head, n_tail = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        n_head[heads] = np.diff(self._ranges(raw, start[heads], left[heads])[1])
        n_tail[tails] = np.diff(self._ranges(raw, right[tails], stop[tails])[1])
        kept_size = np.where(kept, np.maximum(size - n_head - n_tail, 0), 0)
        kept_at = begin + n_head

        of = np.searchsorted(offsets, start, "right") - 1  # the document of each chunk
        cut = np.flatnonzero(~ends)  # chunks that a cut ends
        before, after = np.searchsorted(blank, stop[cut]) - 1, np.searchsorted(blank, stop[cut])
        a = np.maximum(np.where(before >= 0, held[np.maximum(before, 0)], 0), offsets[of[cut]])
        b = np.minimum(held[np.minimum(after, len(blank))], offsets[of[cut] + 1])
        a, first = np.unique(a, return_index=True)
        b, doc = b[first], of[cut][first]
        near, far = np.searchsorted(start, a, "right") - 1, np.searchsorted(stop, b, "left")
        far = np.where(b == offsets[doc + 1], far, np.searchsorted(start, b, "right") - 1)  # the chunks that hold a and b
        joins_at, joins_size, windows, bad = self._repaired(raw, blank, a, b, np.where(kept[near] & (a == right[near]), left[near], a), np.where(kept[far] & (b == left[far]), right[far], b),
                                                            kept_at[near] + kept_size[near], kept_size[near], kept_at[far], kept_size[far], pool)
        lost = np.unique(doc[bad])
        self.whole += len(lost)
        alone, alone_at = self._ranges(raw, offsets[lost], offsets[lost + 1])
        kept &= ~np.isin(of, lost)
        sound = ~np.isin(doc, lost)
        place = np.concatenate([left[kept], a[sound], offsets[lost]])
        source = np.concatenate([kept_at[kept], len(pool) + joins_at[sound], len(pool) + len(windows) + alone_at[:-1]])
        sizes = np.concatenate([kept_size[kept], joins_size[sound], np.diff(alone_at)])
        order = np.argsort(place, kind="stable")
        place, source, sizes = place[order], source[order], sizes[order]
        each = np.bincount(np.searchsorted(offsets, place, "right") - 1, sizes, len(offsets) - 1).astype(np.int64)
        return joined(source, sizes, np.concatenate([pool, windows, alone])), np.concatenate([[0], np.cumsum(each)])

    def _repaired(self, raw: np.ndarray, blank: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray, left_end: np.ndarray, left_size: np.ndarray,
                  right_at: np.ndarray, right_size: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(at, size, ids, bad): where the ids of raw[a:b] lie in ids, and for which of them no context agreed.

        Contexts reach from `least` to `most` at the widest; the chunks say that up to left_end of the pool lie the
        ids before a, from right_at on those after b.
        """
        n = len(a)
        at, size, bad, ids, held = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), [], 0
        todo, reach = np.arange(n), 1
        here, there = np.searchsorted(blank, a), np.searchsorted(blank, b)
        while len(todo):
            x = np.where(here[todo] >= reach, blank[np.maximum(here[todo] - reach, 0)], 0) if len(blank) else np.zeros(len(todo), np.int64)
            y = np.where(there[todo] + reach < len(blank), blank[np.minimum(there[todo] + reach, len(blank) - 1)], len(raw)) if len(blank) else np.full(len(todo), len(raw))
            x, y = np.maximum(x, least[todo]), np.minimum(y, most[todo])
            x, y = np.minimum(x, a[todo]), np.maximum(y, b[todo])
            got, where = self._ranges(raw, x, y)
            before, after = np.diff(self._ranges(raw, x, a[todo])[1]), np.diff(self._ranges(raw, b[todo], y)[1])
            whole = np.diff(where)
            ok = (before + after <= whole) & (before <= left_size[todo]) & (after <= right_size[todo])
            p, q = np.where(ok, before, 0), np.where(ok, after, 0)
            ok &= _same(where[:-1], left_end[todo] - p, p, got, pool) & _same(where[1:] - q, right_at[todo], q, got, pool)
            done = todo[ok]
            at[done], size[done], bad[done] = held + where[:-1][ok] + before[ok], (whole - before - after)[ok], False
            ids.append(got)
            held += len(got)
            todo = todo[~ok & ((x > least[todo]) | (y < most[todo]))]
            self.grown += len(todo)
            reach *= 2
        return at, size, np.concatenate([np.zeros(0, np.int32), *ids]), bad


@lru_cache(maxsize=2)
def chunk_encoder(path: str | None = None) -> ChunkEncoder:
    """The worker's own encoder."""
    return ChunkEncoder(path)


class Decoder:
    """Ids to text as the library decodes them, special tokens kept: tokens side by side with a blank between them if it has no decoder."""

    def __init__(self, path: str | None = None) -> None:
        self.library = tokenizer(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token

    def text(self, ids: list[int]) -> str:
        """The text of one document's ids."""
        if self.library.decoder is not None:
            return self.library.decode(ids, skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def decoder(path: str | None = None) -> Decoder:
    """The worker's own decoder."""
    return Decoder(path)


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with a column `ids` (array of int): the ids of the whole text.

    Null and empty texts have no ids. Texts of any length are whole; equal texts have equal ids. Other
    columns stay as they are; a column named `ids` is replaced.
    """
    tuned(docs.sparkSession, AT_ONCE)
    docs = docs.drop("ids")
    schema = docs.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        for b in batches:
            ids, at = encoder.column(b.column(b.schema.get_field_index(text)))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "ids"])

    return docs.mapInArrow(lean(run, False), f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with a column `decoded`: the library's decode of `ids`, special tokens kept. Null ids: empty."""
    tuned(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    schema = encoded.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            texts = [back.text(x or []) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(lean(run), f"{schema}, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, with_ids also ids; encodes and decodes in one pass.

    Null text counts as empty: no tokens, and the digests of nothing. Rows with equal texts agree;
    repeated doc_ids give repeated rows; other columns are not read.
    """
    tuned(docs.sparkSession, AT_ONCE)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, back = chunk_encoder(path), decoder(path)
        for b in batches:
            ids, at = encoder.column(b.column(1))
            ids = np.ascontiguousarray(ids, "<i4")
            a, d = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                a.append(hashlib.sha256(ids[i:j]).hexdigest())
                d.append(hashlib.sha256(back.text(ids[i:j].tolist()).encode()).hexdigest())
            columns = [b.column(0), pa.array(np.diff(at), pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, False), kinds)
