"""Ids of whole texts by a tokenizers vocabulary, as 32-bit numbers."""

from __future__ import annotations

import os

import numpy as np
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from orefall.llm.ragged import RaggedMemo, coded, gather

#: Splits lower-cased words of Latin-1 text as the vocabulary's pre-tokeniser does (fixed value of its format).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLOCK = 4096


def plain(text: str) -> bool:
    """Whether lower case and white space are the same to Python and to the library: printable Latin-1 and line ends."""
    if "<|" in text or not text.replace("\n", " ").isprintable():
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    """Encodes texts with a vocabulary that lower-cases and drops white space, word by word with memos.

    White space always ends a pre-token there, so a text's ids are its words' ids one after another, and a word's ids those of
    its pre-tokens; the last id of a pre-token is one that ends a word, which tells where each of many joined pre-tokens ends.
    Texts that are not plain go to the library whole. A full memo is emptied, which costs time but changes no result.
    """

    def __init__(self, path: str, words: int = 3 << 18, parts: int = 1 << 19) -> None:
        """words, parts: sizes of the memos; they bound the memory of a task."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.lib = Tokenizer.from_file(path)
        # Pre-tokens are lower-case and split already: the same merges without the normaliser and the pattern.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.parts = RaggedMemo(words), RaggedMemo(parts)
        self.pattern = regex.compile(PRE_TOKENS)
        vocab = self.lib.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")

    def _lib(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _parts_ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(new), BLOCK):
            block = new[a : a + BLOCK]
            ids = np.array(self.merges.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(block):
                flat.append(ids)
                lens.append(np.diff(stops, prepend=0))
            else:
                each = [self._lib(p) for p in block]
                flat += each
                lens.append(np.array([len(e) for e in each], dtype=np.int64))
        return np.concatenate(flat), np.concatenate(lens)

    def _word_ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [self.pattern.findall(w) for w in new]
        at = self.parts.rows([p for s in split for p in s], self._parts_ids)
        ids, lens = self.parts.take(at)
        count = np.array([len(s) for s in split], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(lens)])
        stops = np.concatenate([[0], np.cumsum(count)])
        return ids, total[stops[1:]] - total[stops[:-1]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each text has."""
        simple = [plain(t) for t in texts]
        distinct, codes, stops = coded([t.lower().replace("\n", " ") if ok else "" for t, ok in zip(texts, simple)])
        at = self.words.rows(distinct, self._word_ids)
        ids, lens = gather(*self.words.stored(), at[codes])
        total = np.concatenate([[0], np.cumsum(lens)])
        n = total[stops[1:]] - total[stops[:-1]]
        if all(simple):
            return ids, n
        out, first = [], total[stops[:-1]]
        for i, ok in enumerate(simple):
            out.append(ids[first[i] : first[i] + n[i]] if ok else self._lib(texts[i]))
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)
