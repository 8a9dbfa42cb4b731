"""Cut texts at single spaces into chunks that a byte-level pre-tokenizer treats alone."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A single space between two characters that are no white space always starts a new piece, so a
# text may be cut there. Texts with other white space beside a space, or with a space at an end,
# are cut with care; the rest at every space. The classes are a superset of Unicode white space.
_UNSURE = (r"[\s\x0b\x1c-\x1f\x{85}\pZ] | [\s\x0b\x1c-\x1f\x{85}\pZ]|^ | $")
_CAREFUL = re.compile(r"(?<=\S) (?=\S)")


def cut(texts: pa.Array) -> pa.ListArray:
    """The chunks of each text; all but the first have lost the space before them."""
    unsure = pc.match_substring_regex(texts, _UNSURE)
    plain = pc.split_pattern(texts, " ")
    if not pc.any(unsure).as_py():
        return plain
    careful = iter([_CAREFUL.split(t) for t in texts.filter(unsure).to_pylist()])
    return pa.array([next(careful) if odd else chunks
                     for odd, chunks in zip(unsure.to_pylist(), plain.to_pylist(), strict=True)],
                    pa.list_(pa.string()))


def gather(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the ids of ``parts[c]`` for each code; also how many each gave.

    Parts hold little-endian unsigned 32-bit integers.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), "<u4")
    begins = np.cumsum(sizes) - sizes
    taken = sizes[codes]
    shift = begins[codes] - (np.cumsum(taken) - taken)
    return flat[np.repeat(shift, taken) + np.arange(taken.sum())], taken
