"""Fill-in-the-middle transformation of texts by scattering the bytes of whole batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stforecast.llm.shared import query, table

PIECE_BYTES = 4 << 20  # text moved in one step; a longer text is a step of its own
MARKS = (b"<P>", b"<S>", b"<M>")
MARK = len(MARKS[0])
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
FILLED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, ids: list[int | None]) -> np.ndarray:
    """Four 32-bit numbers for each id: the leading digits of the SHA-256 of ``seed:id``."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each starts (one more than texts)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    small = at.astype(np.int32) if at[-1] < 1 << 31 else at
    kind = pa.string() if small.dtype == np.int32 else pa.large_string()
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(small), pa.py_buffer(raw)])


def marks_in(raw: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` begins."""
    found = np.flatnonzero(raw[: max(len(raw) - len(mark) + 1, 0)] == mark[0])
    for k in range(1, len(mark)):
        found = found[raw[found + k] == mark[k]]
    return found


def unit_ends(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ends of all units in ascending order: a unit is white space with the word behind it; only
    white space that ends a text is a unit of its own."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    last = np.ones(len(raw), bool)
    last[:-1] = space[1:]
    ends = ~space & last
    full = at[1:][at[1:] > at[:-1]] - 1
    ends[full] = True  # a text ends its last unit, word or not
    return np.flatnonzero(ends) + 1


def shifts(size: int, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """How far every byte moves, for runs of bytes in ascending order of where they start."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, np.diff(moves, prepend=0))  # empty runs share a start and cancel out
    return np.cumsum(step[:size])


def layout(form: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of prefix, middle and suffix in an output, for their lengths."""
    spm, plain = form == SPM, form == PLAIN
    first = np.where(spm, MARK + suffix + MARK, MARK)
    last = np.where(spm, MARK, MARK + prefix + MARK)
    mid = 3 * MARK + prefix + suffix
    return tuple(np.where(plain, p, x) for p, x in zip((0, prefix, prefix + middle), (first, mid, last), strict=True))


def cut_points(raw: np.ndarray, at: np.ndarray, hashes: np.ndarray, percent: int, spm_percent: int):
    """Units, form, and where the middle and the suffix of every text begin."""
    ends = unit_ends(raw, at)
    first = np.searchsorted(ends, at[:-1], "right")
    n = np.searchsorted(ends, at[1:], "right") - first
    a, b = hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)
    edge = np.concatenate([[0], ends])

    def place(units: np.ndarray) -> np.ndarray:
        return np.where(units > 0, edge[first + units], at[:-1])

    cut, stop = place(np.minimum(a, b)), place(np.maximum(a, b))
    holding = np.concatenate([marks_in(raw, m) for m in MARKS])
    owner = np.searchsorted(at, holding, "right") - 1
    inside = holding + MARK <= at[owner + 1]
    plain = (hashes[:, 2] % 100 >= percent) | (n == 0)
    plain[owner[inside]] = True
    form = np.where(plain, PLAIN, np.where(hashes[:, 3] % 100 < spm_percent, SPM, PSM))
    return n, form, cut, stop


def scattered(raw: np.ndarray, at: np.ndarray, form: np.ndarray, cut: np.ndarray, stop: np.ndarray):
    """Outputs as one run of bytes and their starts."""
    start, end = at[:-1], at[1:]
    lengths = cut - start, stop - cut, end - stop
    to = np.concatenate([[0], np.cumsum(end - start + np.where(form == PLAIN, 0, 3 * MARK))])
    places = [to[:-1] + x for x in layout(form, *lengths)]
    starts = np.stack([start, cut, stop], 1).ravel()
    moves = np.stack([p - s for p, s in zip(places, (start, cut, stop), strict=True)], 1).ravel()
    out = np.empty(to[-1], np.uint8)
    out[np.arange(len(raw)) + shifts(len(raw), starts, moves)] = raw
    moved = form != PLAIN
    for mark, place in zip(MARKS, (places[0], places[2], places[1]), strict=True):
        for k in range(MARK):
            out[place[moved] - MARK + k] = mark[k]
    return out, to


def gathered(out: np.ndarray, to: np.ndarray, form: np.ndarray):
    """The texts again, from nothing but outputs and forms: every output of a cut text holds each
    mark once, and the places of the marks are its cuts."""
    start, end = to[:-1], to[1:]
    moved = form != PLAIN
    found = []
    for mark in MARKS:
        where = marks_in(out, mark)
        owner = np.searchsorted(to, where, "right") - 1
        whole = np.where(moved, -1, start)
        use = moved[owner] & (where + MARK <= end[owner])
        whole[owner[use]] = where[use]
        found.append(whole)
    p, s, m = found
    if (np.minimum(np.minimum(p, s), m)[moved] < 0).any():
        raise ValueError("an output without its marks")
    spm = form == SPM
    prefix = np.where(moved, np.where(spm, m, s) - p - MARK, end - start)
    suffix = np.where(moved, np.where(spm, p, m) - s - MARK, 0)
    middle = np.where(moved, end - m - MARK, 0)
    at = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    places = [start + x for x in layout(form, prefix, middle, suffix)]
    starts = np.stack([at[:-1], at[:-1] + prefix, at[:-1] + prefix + middle], 1)
    moves = (np.stack(places, 1) - starts).ravel()
    return out[np.arange(at[-1]) + shifts(at[-1], starts.ravel(), moves)], at


def pieces(sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one longer row."""
    most = PIECE_BYTES if most is None else most
    total, at = np.cumsum(sizes), 0
    while at < len(total):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield at, to
        at = to


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """Texts rearranged so that a model learns to fill in their middle.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever their names. A
    text (null: empty) is cut between units (white space with the word behind it) at two places
    drawn from the SHA-256 of seed and doc_id. ``percent`` of the texts are rearranged, of those
    ``spm_percent`` with the suffix first. A text that is empty or contains a mark stays plain. A
    null doc_id draws as an empty id and stays null; rows that repeat a doc_id draw the same
    numbers. An empty table gives no rows. Returns doc_id, n (units), form, prefix_chars,
    middle_chars (null if plain) and output.

    Nothing is shuffled. A task takes its bytes in pieces: the ends of all units come from one
    scan, differences at the three runs of a text give the shift of every byte by a running sum,
    and one scatter writes the outputs of the piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            _, at = buffers(texts)
            for lo, hi in pieces(np.diff(at)):
                names = batch.column(0).slice(lo, hi - lo)
                raw, starts = buffers(texts.slice(lo, hi - lo))
                n, form, cut, stop = cut_points(raw, starts, draws(seed, names.to_pylist()), percent, spm_percent)
                out, to = scattered(raw, starts, form, cut, stop)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                plain = form == PLAIN
                counts = [pa.array(chars[b] - chars[a], mask=plain) for a, b in ((starts[:-1], cut), (cut, stop))]
                columns = [names, pa.array(n), pa.array(FORMS[form]), *counts, strings(out, to)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FILLED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FILLED)


def restore(filled: DataFrame) -> DataFrame:
    """The rows of :func:`fill_in_middle` with ``restored``, the text that output and form alone give.

    ``filled`` needs form and output; its other columns are kept, but an earlier ``restored``. A
    null form or output gives an empty text. An empty table gives no rows.
    """
    kept = filled.drop("restored")
    width = len(kept.columns)
    form, output = kept.columns.index("form"), kept.columns.index("output")
    codes = {str(name): k for k, name in enumerate(FORMS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(output).fill_null("")
            forms = np.array([codes[f or "plain"] for f in batch.column(form).to_pylist()], np.int64)
            _, at = buffers(texts)
            for lo, hi in pieces(np.diff(at)):
                raw, to = buffers(texts.slice(lo, hi - lo))
                again, starts = gathered(raw, to, forms[lo:hi])
                columns = [batch.column(k).slice(lo, hi - lo) for k in range(width)]
                yield pa.RecordBatch.from_arrays([*columns, strings(again, starts)], [*batch.schema.names, "restored"])

    return kept.mapInArrow(run, StructType([*kept.schema, StructField("restored", StringType())]))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), e AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d
), f AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[greatest(c1, c2) + 1:], '') AS s,
    array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m FROM e
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""


@query("op11_fill_in_middle", SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
