"""Functions of text on Arrow arrays, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a token in normalised UTF-8.
TOKEN_BYTES = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: The same, and those of all other characters than ASCII's.
WORD_BYTES = TOKEN_BYTES | (np.arange(256) >= 128)
NO_SPACE = np.arange(256) != 32


def runs(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each run of bytes that inside marks, in order, with its row. inside: for each of 256 bytes."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, ends, body = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None else np.zeros(0, np.uint8)
    begins = ends[:-1] - ends[0]
    within = inside[body]
    first = within.copy()
    first[1:] &= ~within[:-1]
    filled = begins[begins < len(body)]
    first[filled] = within[filled]
    at = np.flatnonzero(first)
    offsets = np.append(np.cumsum(within)[at] - 1, np.count_nonzero(within)).astype(np.int32)
    return np.searchsorted(begins, at, "right") - 1, pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(body[within]))
