"""Word-wise use of a public tokenizer: words are encoded by the library itself, and those met before are looked up."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Name of the default vocabulary file; every operator takes a path instead.
VOCABULARY = "word_bpe_49k.json"
#: Bytes of pieces and ids that a worker keeps. They bound memory only.
MOST_BYTES = 12_000_000
#: Marks that the splitter parts from letters before them; the apostrophe, which it may not part, is left out.
LAST_LATIN = "\u0250"  # letters below it are the same in every version of Unicode in use
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file to use: the path given, or the installed public one. Resolved where the code runs."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None):
    """The library's tokenizer, with truncation and padding off."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(path))
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def letters_only(path: str | None = None):
    """The same vocabulary and merges for runs of lower-case, composed Latin letters between blanks.

    On those the normaliser changes nothing and the splitter leaves each run whole, so both are left out.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer(tokenizer(path).model)  # shared, not copied
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


def joined(starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The pieces pool[start : start + size] one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Memo:
    """Ids of pieces that were met before, in flat arrays: a hash table of pieces is made for each lookup, by Arrow.

    Beyond `most` bytes it keeps what was met again since the last time, or nothing if that is still half of it.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], kind: pa.DataType, most: int = MOST_BYTES) -> None:
        self.encode, self.kind, self.most = encode, kind, most
        self.met = self.made = 0
        self.clear()

    def clear(self) -> None:
        """Forgets everything."""
        self.pieces, self.at, self.pool = pa.array([], self.kind), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)

    def shrink(self) -> None:
        """Keeps the pieces that were met again."""
        keep = np.flatnonzero(self.again)
        sizes = np.diff(self.at)[keep]
        pieces, pool = self.pieces.take(pa.array(keep)), joined(self.at[keep], sizes, self.pool)
        self.clear()
        if pieces.nbytes + pool.nbytes <= self.most // 2:
            self.pieces, self.at, self.pool, self.again = pieces, np.concatenate([[0], np.cumsum(sizes)]), pool, np.zeros(len(pieces), bool)

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, pool): where the ids of each of these distinct pieces lie in the pool."""
        if self.pieces.nbytes + self.pool.nbytes > self.most:
            self.shrink()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        self.met, self.made = self.met + len(at), self.made + len(new)
        if len(new):
            fresh = pieces.take(pa.array(new))
            starts, ids = self.encode(fresh)
            at[new] = len(self.pieces) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, fresh])
            self.at = np.concatenate([self.at, self.at[-1] + starts[1:]])
            self.pool = np.concatenate([self.pool, ids])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return self.at[at], self.at[at + 1] - self.at[at], self.pool


class ColumnEncoder:
    """Encodes a whole column: words are told apart by Arrow, a word that a worker has met before is not encoded again.

    The vocabulary's splitter drops white space and no token crosses it, its normaliser composes no
    character across it, and its special tokens hold none. So the ids of a text are those of its words
    in order. A run of letters and the marks after it are split likewise. Words are encoded by the
    library, unseen runs of letters in few calls: each ends in the one token that has the word end.
    """

    def __init__(self, path: str | None = None, most: int = MOST_BYTES) -> None:
        self.library, self.letters = tokenizer(path), letters_only(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memo = Memo(self._words, pa.large_string(), most)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more than texts). Null counts as empty."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null("").cast(pa.large_string()), "\n", " "), " ")
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        coded = lists.flatten().dictionary_encode()
        begin, size, pool = self.memo.ids(coded.dictionary)
        index = coded.indices.to_numpy()
        sizes = size[index]
        return joined(begin[index], sizes, pool), np.concatenate([[0], np.cumsum(sizes)])[bounds]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and where each word's begin."""
        n = len(words)
        low = pc.ascii_lower(words)
        stems = pc.ascii_rtrim(low, characters=MARKS)
        plain = pc.and_(pc.string_is_ascii(words), pc.ascii_is_alpha(stems)).to_numpy(zero_copy_only=False).copy()
        cut = pc.binary_length(stems).to_numpy().astype(np.int64)
        whole = pc.binary_length(low).to_numpy()
        ended = np.flatnonzero(plain & (cut < whole))
        tails = [w[c:] for w, c in zip(low.take(pa.array(ended)).to_pylist(), cut[ended].tolist(), strict=True)]
        other = np.flatnonzero(~plain)
        good, more, odd, strange = [], [], [], []
        for i, w in zip(other.tolist(), words.take(pa.array(other)).to_pylist(), strict=True):
            lower = w.lower()
            stem = lower.rstrip(MARKS)
            if stem.isalpha() and max(stem) < LAST_LATIN and is_normalized("NFC", stem):
                good.append(i)
                more.append((stem, lower[len(stem) :]))
            else:
                odd.append(i)
                strange.append(w)
        where = np.concatenate([np.flatnonzero(plain), np.array(good, np.int64)])
        runs = pa.concat_arrays([stems.filter(pa.array(plain)), pa.array([s for s, _ in more], pa.large_string())]).dictionary_encode()
        ended = np.concatenate([ended, np.array([i for i, (_, t) in zip(good, more, strict=True) if t], np.int64)])
        marks = pa.array(tails + [t for _, t in more if t], pa.string()).dictionary_encode()
        pools, starts = [], []
        for at, ids in (self._runs(runs.dictionary.to_pylist()), self._plain(marks.dictionary.to_pylist()), self._plain(strange)):
            starts.append(at + sum(map(len, pools)))
            pools.append(ids)
        begin, size = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
        for rows, part, at, index in ((where, 0, starts[0], runs.indices), (ended, 1, starts[1], marks.indices), (np.array(odd, np.int64), 0, starts[2], pa.array(np.arange(len(odd))))):
            index = index.to_numpy()
            begin[rows, part], size[rows, part] = at[:-1][index], np.diff(at)[index]
        return np.concatenate([[0], np.cumsum(size.sum(1))]), joined(begin.ravel(), size.ravel(), np.concatenate(pools))

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of letters, many to a call; one by one where a run does not end in a single token of a word's end."""
        lines = [" ".join(runs[i : i + 200]) for i in range(0, len(runs), 200)]
        got = [np.asarray(e.ids, np.int32) for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.int32), *got])
        at = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        return (at, ids) if len(at) == len(runs) + 1 and at[-1] == len(ids) else self._plain(runs)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64), np.array([i for x in got for i in x], np.int32)


@lru_cache(maxsize=2)
def column_encoder(path: str | None = None, most: int = MOST_BYTES) -> ColumnEncoder:
    """The worker's own encoder of columns."""
    return ColumnEncoder(path, most)
