"""Quality rules: how much of a text lies inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, rolling, tidy, window_hash, word_bounds

#: Largest share of word characters inside n-grams that stand earlier in the text, by n.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: Largest share of lines that stand earlier in the text, and of the characters in them.
LINE_LIMITS = (0.50, 0.30)
#: ``#*$%&|<>``
SYMBOLS = np.frombuffer("#*$%&|<>".encode("utf-32-le"), np.uint32)
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "dup_line_share double, dup_line_char_share double, dup_ngram_share map<int,double>, kept boolean"
)


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: whether an equal one stands before it, and whether an equal one exists."""
    _, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return first[inverse] != np.arange(len(hashes)), counts[inverse] > 1


def covered(flags: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words that lie inside a flagged window of n words."""
    step = np.zeros(words + 1, np.int64)
    np.add.at(step, np.flatnonzero(flags), 1)
    np.add.at(step, np.flatnonzero(flags) + n, -1)
    return np.cumsum(step)[:words] > 0


def measure(text: str | None, ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limits: tuple[float, float] = LINE_LIMITS) -> dict:
    """All measures of one whole text."""
    codes = code_points(text or "")
    starts, ends = word_bounds(codes)
    lengths, n = ends - starts, len(starts)
    word_chars = int(lengths.sum())
    words = window_hash(rolling(codes), starts, ends)
    prefix = rolling(words)

    def windows(k: int) -> np.ndarray:
        at = np.arange(max(0, n - k + 1))
        return window_hash(prefix, at, at + k)

    n_repeat = int(covered(repeated(windows(3))[1], 3, n).sum()) if n >= 3 else 0
    seen: set[str] = set()
    dup_lines = dup_chars = lines = line_chars = 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines, line_chars = lines + 1, line_chars + len(line)
            if line in seen:
                dup_lines, dup_chars = dup_lines + 1, dup_chars + len(line)
            seen.add(line)
    shares = {k: float(lengths[covered(repeated(windows(k))[0], k, n)].sum() / word_chars) if n > k else 0.0 for k in ngram_limits}
    line_share, char_share = (dup_lines / lines, dup_chars / line_chars) if lines else (0.0, 0.0)
    failed = n < 50 or 100 * n_repeat > 50 * n
    kept = not failed and line_share <= line_limits[0] and char_share <= line_limits[1] and all(shares[k] <= most for k, most in ngram_limits.items())
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": int(np.isin(codes, SYMBOLS).sum()), "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "base_failed": failed, "dup_line_share": line_share, "dup_line_char_share": char_share, "dup_ngram_share": shares, "kept": kept,
    }


def repetition(docs: DataFrame, text: str = "text", ngram_limits: dict[int, float] = NGRAM_LIMITS, line_limits: tuple[float, float] = LINE_LIMITS, carry: list[str] | None = None) -> DataFrame:
    """Measure the repetition of every text and judge it.

    Words are runs of characters other than ASCII white space; a word, a window of words and a line
    are compared by value.  For each n, ``dup_ngram_share[n]`` is the share of word characters in
    words that some n-gram covers which stands earlier in the text.  ``kept`` is false where the base
    rules fail (under 50 words, or over half the words in repeated 3-word windows) or a share
    exceeds its limit.  A null or empty text has no words, fails the base rules and is not kept.  No
    text is cut.  Rows are judged alone, so ties and repeated rows do not matter; an empty table
    gives an empty result.  ``carry`` names the input columns to return (all but the text, unless
    given); those that clash with a measure are dropped.  There is no shuffle.
    """
    made = [x.split()[0] for x in SCHEMA.split(", ")]
    carry = [c for c in (carry if carry is not None else [c for c in docs.columns if c != text]) if c not in made]
    schema = docs.select(*carry).schema
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out_schema = f"{given}, {SCHEMA}" if given else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        for batch in batches:
            rows = [measure(t, ngram_limits, line_limits) for t in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [batch.column(i) for i in range(len(carry))]
            for name in made:
                values = [r[name] for r in rows]
                if name == "dup_ngram_share":
                    arrays.append(pa.array([list(v.items()) for v in values], pa.map_(pa.int32(), pa.float64())))
                else:
                    arrays.append(pa.array(values, {"base_failed": pa.bool_(), "kept": pa.bool_(), "dup_line_share": pa.float64(), "dup_line_char_share": pa.float64()}.get(name, pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *made])

    return docs.select(*carry, F.col(text).alias("the_text")).mapInArrow(tidy(run), out_schema)
