"""Whole texts to token ids with a public tokenizer file, at the speed of a dictionary look-up."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a worker process remembers; when full, the memory starts anew.
REMEMBERED_WORDS = 700_000
#: Bytes of text whose words a task looks up at once.
LOOKED_UP_BYTES = 8 << 20
#: New words that go through the tokenizer as one text.
JOINED = 256


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its memory of words outlives a task."""
    return WordEncoder(path)


class WordEncoder:
    """Ids of texts, equal to `Tokenizer.encode(text, add_special_tokens=False).ids`.

    For tokenizers that drop white space and never join across it (as
    word_bpe_49k.json): texts are cut at spaces and line ends, each distinct
    word goes through the tokenizer once, and ids are gathered by word number.
    Strings that look like special tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size()
        added = self._tokenizer.get_added_tokens_decoder()
        # Between words that are encoded together; no ordinary text gives its id.
        self._mark = min(added, default=None)
        self._marks = [t.content for t in added.values()]
        self._reset()

    def _reset(self) -> None:
        self._number: dict[str, int] = {}
        self._flat = np.zeros(0, np.uint32)
        self._length = np.zeros(0, np.int64)
        self._start = np.zeros(0, np.int64)

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        self._tokenizer.encode_special_tokens = True
        found = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, of many words a text with a special token between them."""
        self._tokenizer.encode_special_tokens = False
        mark = self._tokenizer.id_to_token(self._mark)
        texts = [mark.join([*words[a : a + JOINED], ""]) for a in range(0, len(words), JOINED)]
        found = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        ends = np.flatnonzero(ids == self._mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[str]) -> np.ndarray:
        """Numbers of new words."""
        every, odd = "\n".join(words), []
        if self._mark is None or any(m in every for m in self._marks):
            odd = [w for w in words if self._mark is None or any(m in w for m in self._marks)]
        even = words if not odd else sorted(set(words).difference(odd))
        found = [self._together(even), self._alone(odd)] if odd else [self._together(even)]
        known = len(self._number)
        self._number.update(zip([*even, *odd], range(known, known + len(words))))
        self._flat = np.concatenate([self._flat, *(f[0] for f in found)])
        self._length = np.concatenate([self._length, *(f[1] for f in found)])
        self._start = np.cumsum(self._length) - self._length
        return np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, one after the other, and how many each text has."""
        if len(self._number) > REMEMBERED_WORDS:
            self._reset()
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        known = self._number.get
        distinct = coded.dictionary.to_pylist()
        numbers = np.array([known(w, -1) for w in distinct], np.int64)
        if len(new := np.flatnonzero(numbers < 0)):
            numbers[new] = self._learn([distinct[i] for i in new.tolist()])
        return numbers[coded.indices.to_numpy(zero_copy_only=False)], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other (uint32), and how many each text has; a null text has none."""
        at, words = self._numbers(texts)
        lengths = self._length[at]
        # Position of each id: its word's start, plus its place inside the word.
        shift = self._start[at] - (np.cumsum(lengths) - lengths)
        ids = self._flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]
        return ids, _sums(lengths, words)

    def count(self, texts: pa.Array) -> np.ndarray:
        at, words = self._numbers(texts)
        return _sums(self._length[at], words)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return (upto[ends] - upto[ends - counts]).astype(np.int64)
