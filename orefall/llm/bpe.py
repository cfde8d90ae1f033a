"""Byte-pair encoding over ragged numpy arrays: all sequences of a batch merge their lowest-rank pair in the same step."""

from __future__ import annotations

import json

import numpy as np
import regex

from orefall.llm.ragged import RaggedMemo, coded

#: The pattern of the byte-level vocabulary's pre-tokens (fixed value, part of the vocabulary's format).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class RankMerger:
    """Counts the symbols that byte-level BPE leaves of each pre-token."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.size = len(vocab)
        letters = byte_alphabet()
        self.first = np.zeros(256, dtype=np.int64)
        for ch, b in letters.items():
            self.first[b] = vocab[ch]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys), dtype=np.int64)[order], made[order]
        self.by_rank = made
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.pattern = regex.compile(PRE_TOKENS)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols are left of each non-empty pre-token."""
        out = np.zeros(len(tokens), dtype=np.int64)
        lens = np.array([len(t) for t in tokens], dtype=np.int64)
        sym = self.first[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), lens)
        while len(sym):
            rank = np.full(len(sym), NO_RANK)
            same = seq[1:] == seq[:-1]
            rank[:-1][same] = self._ranks(sym[:-1][same], sym[1:][same])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            done = low == NO_RANK
            out[seq[starts[done]]] = size[done]
            low_here = np.repeat(low, size)
            live = low_here != NO_RANK
            hit = live & (rank == low_here)
            # In a run such as aaa the pair's places overlap: every second one counts, from the left.
            pos = np.arange(len(hit))
            last_miss = np.maximum.accumulate(np.where(hit, -1, pos))
            hit &= (pos - last_miss) % 2 == 1
            sym = np.where(hit, self.by_rank[np.where(hit, rank, 0)], sym)
            live[1:] &= ~hit[:-1]
            sym, seq = sym[live], seq[live]
        return out


class TokenCounter:
    """Counts tokens of whole texts as the vocabulary's own library does with its defaults.

    The strings of special tokens count as one token each. A single space or line end between words always begins a
    pre-token, so a text's count is the sum of its words' counts; distinct words are merged once and kept up to `memo` of
    them. A full memo is emptied, which costs time but changes no result.
    """

    def __init__(self, path: str, memo: int = 1 << 20) -> None:
        self.merger, self.memo = RankMerger(path), RaggedMemo(memo)
        #: White space other than single spaces and line ends between words: the pattern splits such texts as a whole.
        self.odd = regex.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]$")

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A word that begins with a line end has no space before it; the line end itself is a token."""
        split = [["\n", *self.merger.pattern.findall(w[1:])] if w[:1] == "\n" else self.merger.pattern.findall(" " + w) for w in words]
        n = self._sums(split)
        return n, np.ones(len(n), dtype=np.int64)

    def _sums(self, split: list[list[str]]) -> np.ndarray:
        code: dict[str, int] = {}
        flat = np.array([code.setdefault(p, len(code)) for s in split for p in s], dtype=np.int64)
        n = self.merger.counts([p.encode("utf-8", "surrogatepass") for p in code])
        stops = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n[flat])])
        return total[stops[1:]] - total[stops[:-1]]

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        plain, whose, odd, odd_whose = [], [], [], []
        for i, t in enumerate(texts):
            parts = [t]
            if self.merger.at_special and "<|" in t:
                parts = self.merger.at_special.split(t)
                out[i] += len(parts) - 1
            for p in parts:
                if not p:
                    continue
                if self.odd.search(p):
                    odd.append(self.merger.pattern.findall(p))
                    odd_whose.append(i)
                else:
                    plain.append("\n" + p.replace("\n", " \n"))
                    whose.append(i)
        if plain:
            distinct, codes, stops = coded(plain)
            n = self.memo.take(self.memo.rows(distinct, self._merged))[0].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(n[codes])])
            np.add.at(out, whose, total[stops[1:]] - total[stops[:-1]] - 1)
        if odd:
            np.add.at(out, odd_whose, self._sums(odd))
        return out
