"""Fill-in-middle transformation by displacement scatter.

A text is cut into a prefix, a middle and a suffix at token borders and written with control strings in between.  The bytes
of many texts lie side by side in one batch: a scan finds the token ends of all of them and with them the cuts; each segment
moves as a whole, so a difference array with one entry a segment, summed up, gives every byte its displacement, and one
scatter writes all outputs.  The inverse finds the control strings in the outputs, builds the same differences and gathers.

Memory: texts are taken in slices of ``SLICE_BYTES``, displacements are summed in blocks of ``BLOCK_BYTES``; a text longer than
a slice is a slice of its own.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Of a hundred texts that can be transformed, how many are, and of a hundred of those how many begin with the suffix.
RATE, SUFFIX_FIRST = 50, 80
#: The control strings, all of three bytes.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
PLAIN, PSM, SPM = "plain", "psm", "spm"
SLICE_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of ``SLICE_BYTES`` at most, or one text."""
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES, "right")))
        yield at, end
        at = end


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string column as bytes, and where each begins (one border more than texts); null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


def _strings(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    """The reverse: a column of strings that lie side by side."""
    return pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def token_ends(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where tokens end, over all texts: behind each run of other characters, and behind white space that ends a text."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    last = np.zeros(len(data), bool)
    last[borders[1:][np.diff(borders) > 0] - 1] = True
    end = last.copy()
    end[:-1] |= ~space[:-1] & space[1:]
    return np.flatnonzero(end) + 1


def _marks(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all control strings, and the text of each; none reaches from one text into the next."""
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])]
    text = np.searchsorted(borders, at, "right") - 1
    inside = at + MARK <= borders[text + 1]
    return at[inside], text[inside]


def _moved(places: np.ndarray, change: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Displacements of n bytes, block by block, from the differences at ``places`` (in order; several may fall together)."""
    carry = 0
    for a in range(0, n, BLOCK_BYTES):
        b = min(n, a + BLOCK_BYTES)
        lo, hi = np.searchsorted(places, (a, b))
        step = np.zeros(b - a, np.int64)
        np.add.at(step, places[lo:hi] - a, change[lo:hi])
        step[0] += carry
        shift = np.cumsum(step)
        carry = int(shift[-1])
        yield a, b, shift


def _differences(start: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference array of segments that begin at ``start`` (n texts x 3, side by side) and move by ``shift``."""
    return start.ravel(), np.diff(shift.ravel(), prepend=0)


def _layout(p: np.ndarray, m: np.ndarray, s: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where prefix, middle and suffix stand within their text and within its output; lengths in bytes; form 0 plain, 1 psm, 2 spm."""
    zero = np.zeros_like(p)
    inner = np.stack([zero, p, p + m], 1)
    psm = np.stack([zero + MARK, p + s + 3 * MARK, p + 2 * MARK], 1)
    spm = np.stack([s + 2 * MARK, s + p + 3 * MARK, zero + MARK], 1)
    return inner, np.where(form[:, None] == 0, inner, np.where(form[:, None] == 1, psm, spm))


def scattered(data: np.ndarray, borders: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of texts that are cut at ``cuts`` (n x 2, bytes from the start of the text), and their borders."""
    size = np.diff(borders)
    p, m, s = cuts[:, 0], cuts[:, 1] - cuts[:, 0], size - cuts[:, 1]
    new = np.zeros(len(borders), np.int64)
    np.cumsum(size + 3 * MARK * (form > 0), out=new[1:])
    inner, outer = _layout(p, m, s, form)
    out = np.zeros(int(new[-1]), np.uint8)
    for a, b, shift in _moved(*_differences(borders[:-1, None] + inner, (new[:-1] - borders[:-1])[:, None] + outer - inner), len(data)):
        out[np.arange(a, b) + shift] = data[a:b]
    some = form > 0
    for segment, mark in enumerate((PREFIX, MIDDLE, SUFFIX)):
        place = new[:-1][some] + outer[some, segment] - MARK
        for i in range(MARK):
            out[place + i] = mark[i]
    return out, new


def gathered(data: np.ndarray, borders: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts from the outputs and forms alone, and their borders."""
    size, n = np.diff(borders), len(form)
    at, text = _marks(data, borders)
    hit = form[text] > 0
    place = np.zeros((n, 3), np.int64)
    for segment, mark in enumerate((PREFIX, MIDDLE, SUFFIX)):
        own = hit & (data[at + 1] == mark[1])
        if np.any(np.bincount(text[own], minlength=n) != (form > 0)):
            raise ValueError(f"an output of form {PSM} or {SPM} must have {mark.decode()} once")
        place[text[own], segment] = at[own] - borders[text[own]] + MARK
    first, middle, rest = place.T
    p = np.where(form == 1, rest - first, middle - first) - MARK
    s = np.where(form == 1, middle - rest, first - rest) - MARK
    p, s = np.where(form > 0, p, 0), np.where(form > 0, s, 0)
    old = size - 3 * MARK * (form > 0)
    inner, outer = _layout(p, old - p - s, s, form)
    new = np.zeros(n + 1, np.int64)
    np.cumsum(old, out=new[1:])
    out = np.zeros(int(new[-1]), np.uint8)
    for a, b, shift in _moved(*_differences(new[:-1, None] + inner, (borders[:-1] - new[:-1])[:, None] + outer - inner), len(out)):
        out[a:b] = data[np.arange(a, b) + shift]
    return out, new


def _draws(seed: int) -> Column:
    """Four unsigned 32-bit numbers from the SHA-256 of the seed, a colon and the decimal id (a null id: nothing)."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars (code points; null where plain), output.

    A token is a run of other characters with the white space before it, or white space that ends a text.  Cuts lie at the
    smaller and the larger of two draws from 0 to n tokens.  A text that is empty or holds a control string stays plain, and
    so do those beyond ``rate`` in a hundred.  A null text is empty; a null id draws as an empty id; repeated rows are
    transformed alike; a text of any length is transformed whole; other columns are ignored; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            sizes = np.diff(_bytes(batch.column(1))[1])
            for lo, hi in _slices(sizes):
                doc_id, text, draw = (batch.column(i).slice(lo, hi - lo) for i in range(3))
                data, borders = _bytes(text)
                h = draw.flatten().to_numpy().reshape(-1, 4)
                ends = token_ends(data, borders)
                first = np.searchsorted(ends, borders[:-1], "right")
                n = np.searchsorted(ends, borders[1:], "right") - first
                form = np.where(h[:, 3] % 100 < suffix_first, 2, 1)
                form[(np.diff(borders) == 0) | (h[:, 2] % 100 >= rate)] = 0
                form[_marks(data, borders)[1]] = 0
                units = np.sort(h[:, :2] % (n[:, None] + 1), 1)
                ends = np.r_[ends, 0]
                cuts = np.where(units > 0, ends[np.maximum(first[:, None] + units - 1, 0)] - borders[:-1, None], 0)
                cuts[form == 0] = 0
                out, new = scattered(data, borders, cuts, form)
                lead = (data & 0xC0) != 0x80
                chars = [[np.count_nonzero(lead[b : b + x]), np.count_nonzero(lead[b + x : b + y])] for b, (x, y) in zip(borders[:-1].tolist(), cuts.tolist())]
                chars = np.array(chars, np.int64).reshape(-1, 2)
                plain = form == 0
                columns = [doc_id, pa.array(n.astype(np.int64)), pa.array(np.array([PLAIN, PSM, SPM])[form]), pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1], mask=plain), _strings(out, new)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), _draws(seed).alias("draws"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(formed: DataFrame) -> DataFrame:
    """``text`` rebuilt from ``output`` and ``form`` (null: plain); the other columns but output stay.

    An output whose form asks for control strings that it does not have, each once, is refused.
    """
    rest = [c for c in formed.columns if c != "output"]

    def run(batches):
        for batch in batches:
            sizes = np.diff(_bytes(batch.column("output"))[1])
            for lo, hi in _slices(sizes):
                part = batch.slice(lo, hi - lo)
                form = np.array([{PSM: 1, SPM: 2}.get(x, 0) for x in part.column("form").to_pylist()], np.int64)
                out, new = gathered(*_bytes(part.column("output")), form)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), _strings(out, new)], [*rest, "text"])

    return formed.mapInArrow(run, formed.select(rest).withColumn("text", F.lit("")).schema)


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text restored from it."""
    formed = transform(docs, **options)
    with_sha = formed.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    return restore(with_sha).withColumn("restored_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
