"""Words of whole texts as Arrow arrays: split, cut into terms, numbered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of terms: digits, letters and all bytes of code points from U+0080 on; A-Z in lower case, the rest blank.
_TERM_BYTES = np.full(256, ord(" "), np.uint8)
_TERM_BYTES[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_TERM_BYTES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TERM_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TERM_BYTES[0x80:] = np.arange(0x80, 0x100)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and how many each text has (null: none)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    parts = pc.ascii_split_whitespace(texts)
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    full = pc.binary_length(flat).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(full)])
    if not full.all():
        flat = flat.filter(pa.array(full))
    return flat, np.diff(before[ends - ends[0]])


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and how many each text has (null: none).

    A term is a maximal match of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, with A-Z in lower case only.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    blanked = pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer((offsets - (offsets[0] if len(offsets) else 0)).tobytes()), pa.py_buffer(_TERM_BYTES[raw].tobytes())
    )
    return split_words(blanked)


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number from 0 for each word, equal for equal words, and the words by number."""
    coded = pc.dictionary_encode(words)
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary
