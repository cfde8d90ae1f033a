"""The tokens of functions.text over the bytes of a whole Arrow column, for steps that work in batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD, _MARK, _LEAD = 1, 2, 3
#: Kind of each byte of UTF-8: of a Latin word, between its parts, or the first of a character from U+4000 to U+9FFF.
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = _WORD
_KINDS[list(b"-_./")] = _MARK
_KINDS[0xE4:0xEA] = _LEAD
_KIND = _KINDS.tobytes()
_LOWER = bytes(range(256)).lower()
#: The characters beyond ASCII whose lower case has a Latin letter.
_ODD = {"\u0130": "i\u0307", "\u212a": "k"}


def token_rows(texts: pa.Array, cjk: bool = True) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of each token that tokens(), or latin_tokens(), gives; in no order."""
    ended = pc.binary_join_element_wise(pc.fill_null(pc.cast(texts, pa.string()), ""), "\n", "")  # no token spans two texts
    signs = ended.buffers()[2].to_pybytes()
    for sign, low in _ODD.items():
        if sign.encode() in signs:
            ended = pc.replace_substring(ended, sign, low)
            signs = ended.buffers()[2].to_pybytes()
    at = np.frombuffer(ended.buffers()[1], np.int32)[: len(ended) + 1]
    signs = signs[: at[-1]].translate(_LOWER)
    data, kind = np.frombuffer(signs, np.uint8), np.frombuffer(signs.translate(_KIND), np.uint8)
    latin = kind == _WORD
    mark = np.zeros(len(data), bool)
    mark[1:-1] = (kind[1:-1] == _MARK) & latin[:-2] & latin[2:]
    inside = latin | mark
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edges[::2], edges[1::2]
    marks = np.flatnonzero(mark)
    own = np.unique(np.searchsorted(start, marks, "right") - 1)
    part, part_end = np.sort(np.concatenate([start[own], marks + 1])), np.sort(np.concatenate([marks, end[own]]))
    found = [(start, _strings(np.compress(inside, data), end - start)), (part, _cut(data, part, part_end - part))]
    lead = np.flatnonzero(kind == _LEAD) if cjk else marks[:0]
    lead = lead[(data[lead] > 0xE4) | (data[np.minimum(lead + 1, len(data) - 1)] >= 0xB8)]  # from U+4E00 on
    if len(lead):
        next_to = np.diff(lead) == 3
        alone = lead[~(np.append(next_to, False) | np.append(False, next_to))]
        found += [(p, _cut(data, p, np.full(len(p), n))) for p, n in ((lead[:-1][next_to], 6), (alone, 3))]
    rows = [np.repeat(np.arange(len(ended)), np.diff(np.searchsorted(p, at))) for p, _ in found]
    return np.concatenate(rows), pa.concat_arrays([w for _, w in found])


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    before = np.cumsum(size) - size
    return _strings(data[np.repeat(start - before, size) + np.arange(size.sum())], size)


def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
