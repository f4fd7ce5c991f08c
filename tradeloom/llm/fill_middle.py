"""Fill-in-the-middle: a text is cut in two places and its middle is moved behind the rest.

Cuts fall between units (code points, or the matches of a pattern, left to right). Where the k-th unit starts in the
UTF-8 bytes is told by a learned rank index over all boundaries of a text: straight segments from rank to byte offset,
each fitted through its first and last boundary and halved until every boundary lies within `BOUND` bytes of its line.
What is left over is stored as one signed byte a boundary, so a prediction plus its residual is the exact offset. A text
whose units all have one length is one segment without residuals.

Where to cut and which form to write follow from a hash of the id alone: repeated rows and reruns agree. A null text is
empty, and an empty text stays plain, as does one that holds a mark. A null id hashes as no digits. Very long texts are
handled whole (a row at a time); an empty table gives no rows; only `doc_id` and the text column are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: Most bytes that a boundary may lie off its segment: what a signed byte holds.
BOUND = 127
#: Marks of prefix, suffix and middle; shares of plain texts and of suffix-first ones among the others.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20


class RankIndex:
    """Exact byte offset of each boundary, by piecewise straight lines and residuals."""

    def __init__(self, offsets: np.ndarray):
        """offsets: rising, from 0 to the length; boundary k is where unit k starts."""
        self.n = len(offsets) - 1
        self.starts, self.lines = [], []
        self.residuals: np.ndarray | None = None
        rest = np.zeros(self.n + 1, np.int8)
        todo = [(0, self.n)]
        while todo:
            lo, hi = todo.pop()
            first, rise, run = int(offsets[lo]), int(offsets[hi] - offsets[lo]), max(hi - lo, 1)
            off = offsets[lo : hi + 1] - (first + np.arange(hi - lo + 1) * rise // run)
            if np.abs(off).max() <= BOUND:
                rest[lo : hi + 1] = off
                self.starts.append(lo)
                self.lines.append((first, rise, run))
            else:
                half = (lo + hi) // 2
                todo += [(half, hi), (lo, half)]  # the left half first, so that segments come in order
        # a boundary shared by two segments belongs to the right one, whose line starts there
        rest[self.starts] = 0
        if rest.any():
            self.residuals = rest

    @classmethod
    def even(cls, n: int, width: int) -> RankIndex:
        """All units have one length."""
        out = cls.__new__(cls)
        out.n, out.starts, out.lines, out.residuals = n, [0], [(0, n * width, max(n, 1))], None
        return out

    def predicted(self, k: int) -> int:
        at = bisect_right(self.starts, k) - 1
        first, rise, run = self.lines[at]
        return first + (k - self.starts[at]) * rise // run

    def offset(self, k: int) -> int:
        """The exact offset of boundary k."""
        return self.predicted(k) + (int(self.residuals[k]) if self.residuals is not None else 0)


def code_points(raw: np.ndarray) -> RankIndex:
    """Boundaries of code points: every byte that does not continue one."""
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(starts) == len(raw):
        return RankIndex.even(len(raw), 1)
    return RankIndex(np.append(starts, len(raw)))


def matches(raw: np.ndarray, unit: regex.Pattern) -> RankIndex:
    """Boundaries of the units that the pattern cuts the text into; what lies before a match belongs to it."""
    ends = [m.end() for m in unit.finditer(raw.tobytes()) if m.end() > m.start()]
    if ends:
        ends[-1] = len(raw)  # what follows the last match belongs to it
    return RankIndex(np.array([0, *ends] if ends else [0, len(raw)][: 1 + bool(len(raw))], np.int64))


def seeds(doc_id: int | None) -> list[int]:
    digits = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def filled(raw: bytes, index: RankIndex, h: list[int]) -> tuple[bytes, str, int | None, int | None]:
    """(output, form, units of the prefix, units of the middle)"""
    if not raw or h[2] % 100 >= PLAIN_FROM or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return raw, "plain", None, None
    a, b = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    x, y = index.offset(a), index.offset(b)
    prefix, middle, suffix = raw[:x], raw[x:y], raw[y:]
    if h[3] % 100 < SPM_BELOW:
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), "spm", a, b - a
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), "psm", a, b - a


def restored(output: bytes, form: str) -> bytes:
    """The text, from its output and form alone. No beginning of a mark is the end of one, so that the first place of
    each mark is the one that was written."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, middle = output[len(first) :].split(MIDDLE, 1)
    x, y = head.split(second, 1)
    return y + middle + x if form == "spm" else x + middle + y


def fill_in_middle(docs: DataFrame, text: str = "text", unit: str | None = None, outputs: bool = True) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_units, middle_units, output (if asked for), output_sha256,
    restored_sha256. unit: a pattern over UTF-8 bytes; code points without one. A narrow map, no shuffle."""
    kept = docs.select("doc_id", F.col(f"`{text}`").cast("string").alias("text"))
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), *[("output", pa.string())] * outputs, ("output_sha256", pa.string()), ("restored_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(unit.encode()) if unit else None
        for part, data, offsets in text_chunks(batches, "text"):
            rows = []
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                view = data[offsets[i] : offsets[i + 1]]
                raw = view.tobytes()
                index = matches(view, pattern) if pattern else code_points(view)
                out, form, a, b = filled(raw, index, seeds(doc_id))
                sums = hashlib.sha256(out).hexdigest(), hashlib.sha256(restored(out, form)).hexdigest()
                rows.append((index.n, form, a, b, *[out.decode("utf-8", "replace")] * outputs, *sums))
            columns = [part.column(0), *[pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f for f, _ in fields]])

    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    return kept.mapInArrow(run, ", ".join([f"doc_id {kept.schema['doc_id'].dataType.simpleString()}", *[f"{f} {kinds[t]}" for f, t in fields]]))


def op12(docs: DataFrame) -> DataFrame:
    return fill_in_middle(docs, outputs=False).withColumnsRenamed({"prefix_units": "prefix_chars", "middle_units": "middle_chars"})


ORACLE = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), seeded AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM hashed
), cut AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM seeded
), parts AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
