"""Whole texts to token ids with a byte-level BPE file, each distinct word encoded once."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wakeline.llm.tokens import JOINED, REMEMBERED_WORDS, WordEncoder

# White space beyond ASCII: a text with any of it is encoded in one piece.
WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WIDE_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")  # first bytes of those


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each worker process, so that its memory of words outlives a task."""
    return ByteEncoder(path)


class ByteEncoder(WordEncoder):
    """Ids of texts, equal to `Tokenizer.encode(text, add_special_tokens=False).ids`.

    Byte-level pre-tokenizers let a token begin at every single space or line
    end between two other characters, and at every sign after a letter, and let
    none reach across it. Texts are cut there, without a copy; every other white
    space stays inside its piece.
    A tokenizer with a normalizer or another pre-tokenizer gets whole texts.
    Strings that look like special tokens are ordinary text.
    """

    def __init__(self, path: str):
        super().__init__(path)
        kind = json.loads(self._tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self._cut = bool(byte_level and not kind.get("normalizer"))
        # A byte-level token has one character for each of its bytes.
        self._bytes = np.zeros(self.size, np.int64)
        for token, i in self._tokenizer.get_vocab().items():
            self._bytes[i] = len(token)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with their only white space, many of them a text; bytes tell them apart again."""
        self._tokenizer.encode_special_tokens = True
        texts = ["".join(words[a : a + JOINED]) for a in range(0, len(words), JOINED)]
        found = [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64))
        return ids, np.diff(np.searchsorted(np.cumsum(self._bytes[ids]), ends) + 1, prepend=0)

    def _learn(self, words: list[str]) -> np.ndarray:
        even = [w for w in words if self._cut and w[0] in " \n" and w.split() == [w[1:]]]
        odd = sorted(set(words).difference(even))
        found, known = [self._together(even), self._alone(odd)], len(self._number)
        self._number.update(zip([*even, *odd], range(known, known + len(words))))
        self._flat = np.concatenate([self._flat, *(f[0] for f in found)])
        self._length = np.concatenate([self._length, *(f[1] for f in found)])
        self._start = np.cumsum(self._length) - self._length
        return np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts, one after the other, and how many each text has."""
        if len(self._number) > REMEMBERED_WORDS:
            self._reset()
        texts = pc.fill_null(texts, "").cast(pa.string())
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        full = np.flatnonzero(np.diff(bounds))
        starts = bounds[:-1][full]
        if self._cut and len(full):
            a, b = int(bounds[0]), int(bounds[-1])
            raw = np.frombuffer(data, np.uint8)[a:b]
            ink = raw > 32
            cut = np.zeros(b - a, bool)
            cut[1:-1] = ((raw[1:-1] == 32) | (raw[1:-1] == 10)) & ink[:-2] & ink[2:]
            cut[bounds[1:] - a - 1] = False  # a text's last byte; its first one begins a piece anyway
            letter = (raw | 32) - np.uint8(97) < 26
            sign = ink & (raw < 127) & ~letter & (raw - np.uint8(48) >= 10)
            # Two bytes, U+00C0 to U+00FF, are a letter but for two signs.
            letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            cut[1:] |= sign[1:] & letter[:-1]
            if any(lead in held for held in (raw.tobytes(),) for lead in _WIDE_LEADS):
                for i in np.flatnonzero(pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)).tolist():
                    cut[bounds[i] - a : bounds[i + 1] - a] = False
            cut[starts - a] = True
            starts = np.flatnonzero(cut) + a
        counts = np.diff(np.searchsorted(starts, bounds)).astype(np.int64)
        if not len(starts):
            return np.zeros(0, np.int64), counts
        edges = np.append(starts, bounds[-1]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), data).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self._number.get
        numbers = np.array([known(w, -1) for w in distinct], np.int64)
        if len(new := np.flatnonzero(numbers < 0)):
            numbers[new] = self._learn([distinct[i] for i in new.tolist()])
        return numbers[coded.indices.to_numpy(zero_copy_only=False)], counts
