"""Operator 8: line-first cleaning.

Punctuation, navigation and boilerplate rules judge each line; failing lines are removed, and a
document that loses too much of its text is rejected. Words are maximal runs of characters other
than the six ASCII white-space characters.

Edge cases: null and empty texts have no words, fail the base rule and are rejected; blank lines
are neither judged nor counted as text; texts of any length are judged whole, one at a time; rows
with a null or repeated id are judged like others; an empty table gives no row; columns other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import id_text, prepare, small_batches

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_NOT_LETTER = bytes(set(range(128)) - set(range(65, 91)) - set(range(97, 123)))

# Phrases that running text hardly has, and words that it may well have: those need a second sign.
NOTICES = (rb"lorem ipsum|all rights reserved|\(c\) ?\d{4}|privacy policy|terms of (?:use|service)"
           rb"|spdx-license|licensed under|permission is hereby granted")
HINTS = (rb"cookie|javascript|copyright|sign (?:in|up)|log ?in\b|subscribe|newsletter|read more"
         rb"|click here")
BOILERPLATE = re.compile(rb"(%s)|%s" % (NOTICES, HINTS), re.I)
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, n_lines long, "
          "n_removed_lines long, clean_text string")


@dataclass(frozen=True)
class LineRules:
    """Bounds of the rules; shares are of the characters or words of one line."""

    max_symbol_share: float = 0.06      # punctuation: symbols among the characters
    max_mark_share: float = 0.5         # punctuation: words ending in two marks
    max_upper_share: float = 0.7        # punctuation: capitals among the letters
    min_letters: int = 20               # fewer letters say nothing about capitals
    max_menu_bars: int = 2              # navigation: separators in one line
    max_boilerplate_words: int = 40     # boilerplate: longer lines are running text
    max_hint_words: int = 6             # boilerplate: a hint alone counts in so short a line
    max_lost_share: float = 0.3         # document: share of its text in removed lines
    min_words: int = 50                 # document: words that have to remain


_MARKS = re.compile(rb"[!?.,;:*#$%&]{2,}(?=[ \t\n\x0b\x0c\r]|$)")
_BARS = re.compile(rb"(?:[|>]|\xc2\xbb)(?= )| \xe2\x80\xa2 ")
_SENTENCE_END = (b".", b"!", b"?", b"\xe2\x80\xa6", b"\xe3\x80\x82")


def line_fails(line: bytes, n_words: int, rules: LineRules) -> str | None:
    """The name of the rule that a line with words fails, or None."""
    size = len(line)
    if size - len(line.translate(None, _SYMBOLS)) > rules.max_symbol_share * size:
        return "navigation" if line.count(b" | ") > rules.max_menu_bars else "punctuation"
    if len(_MARKS.findall(line)) > rules.max_mark_share * n_words:
        return "punctuation"
    letters = len(line.translate(None, _NOT_LETTER))
    if letters >= rules.min_letters and (
            len(line.translate(None, _NOT_UPPER)) > rules.max_upper_share * letters):
        return "punctuation"
    if len(_BARS.findall(line)) > max(rules.max_menu_bars, n_words // 8):
        return "navigation"
    if n_words <= rules.max_boilerplate_words and is_boilerplate(line, n_words, rules):
        return "boilerplate"
    return None


def is_boilerplate(line: bytes, n_words: int, rules: LineRules) -> bool:
    """A notice; or hints: two different ones, one beside a bar, or one in a short line that is no
    sentence."""
    hints = set()
    for found in BOILERPLATE.finditer(line):
        if found[1]:
            return True
        hints.add(found[0].lower())
    if not hints:
        return False
    short = n_words <= rules.max_hint_words and not line.rstrip().endswith(_SENTENCE_END)
    return len(hints) > 1 or short or _BARS.search(line) is not None


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    c = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    pairs = c[:-1] * len(codes) + c[1:]
    if len(codes) > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(codes) + c[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = np.zeros(len(ranked) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    hit = order[same[:-1] | same[1:]]
    marked = np.zeros(len(words), bool)
    for step in range(3):
        marked[hit + step] = True
    return int(marked.sum())


def clean_document(text: str | None, rules: LineRules) -> tuple:
    """The row of one text, without its id, in the order of SCHEMA."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n_words = len(words)
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    seen: set[bytes] = set()
    left, lost, held, lines, dup, remaining = [], 0, 0, 0, 0, 0
    for line in raw.split(b"\n"):
        n = len(line.split())
        if not n:
            left.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if line_fails(line, n, rules):
            lost += len(line)
        else:
            held += len(line)
            remaining += n
            left.append(line)
    repeated = repeat_words(words)
    failed = n_words < 50 or 100 * repeated > 50 * n_words
    kept = not failed and lost <= rules.max_lost_share * (lost + held) and (
        remaining >= rules.min_words)
    return (n_words, len(text) - spaces, len(raw) - len(raw.translate(None, _SYMBOLS)), dup,
            repeated, failed, kept, lines, lines - sum(1 for x in left if x.split()),
            b"\n".join(left).decode())


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Per document the base counts, the verdict and the text without its failing lines."""
    prepare(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = zip(*(clean_document(t, rules) for t in batch.column(1).to_pylist()),
                       strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, rows, kinds)], names)

    return id_text(docs).mapInArrow(run, SCHEMA)
