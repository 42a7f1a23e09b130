"""Words of texts in Arrow batches: runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """Some texts of a batch: their place in it, each joined again by single blanks, and all their words as numbers into ``known``."""

    rows: np.ndarray
    joined: list[bytes]
    starts: np.ndarray  #: where each text's words begin, one more at the end
    ids: np.ndarray
    known: pa.Array


def in_words(texts: pa.Array, some: int = 4_000_000) -> Iterator[Words]:
    """The texts of a column by about ``some`` bytes at a time; a longer one comes alone, null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    part = np.cumsum(sizes) // some
    for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1) if len(sizes) else ():
        joined = [b" ".join(t.split()) for t in texts.slice(at[0], len(at)).to_pylist()]
        column = pa.array([t or None for t in joined], pa.large_binary()).view(pa.large_string())
        lists = pc.split_pattern(column, " ")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        yield Words(at, joined, np.r_[0, np.cumsum(counts)], coded.indices.to_numpy().astype(np.int64), coded.dictionary)
