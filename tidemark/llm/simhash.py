"""SimHash near-duplicate groups through deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that two fingerprints within the distance must agree in one segment
up to a single bit (4 bits over 3 segments).  Each segment is indexed once per bit with that bit wiped out; fingerprints
that share such a variant are verified on all 64 bits.

Groups of any size stay linear: equal fingerprints collapse first; then each variant's members are linked to its smallest
member only, and components of those links are formed; the full equality join afterwards only has to find links between
*different* components, and emits each pair once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components, discard, forget, settled, trim

SHINGLE = 4
DISTANCE = 4
SEGMENTS = (22, 21, 21)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text: words between ASCII white space, A-Z lower-cased, overlapping shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    last = end[shingle - 1 :] if len(words) >= shingle else end[-1:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, 1 << 16):  # a very long text needs no more memory than a short one
        spans = zip(start[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist())
        h = np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and signed 64-bit ``fp`` of every row; a null or blank text has fingerprint zero."""

    def run(batches):
        forget()
        for batch in batches:
            fps = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _variants(df: DataFrame, segments: tuple[int, ...]) -> DataFrame:
    """One row per wiped ``bit``, with the ``rest`` of its segment."""
    rows, low = [], 0
    for width in segments:
        mask = ((1 << width) - 1) << low
        for bit in range(low, low + width):
            keep = mask & ~(1 << bit)
            keep = keep - (1 << 64) if keep >= 1 << 63 else keep
            rows.append(F.struct(F.lit(bit).alias("bit"), F.col("fp").bitwiseAND(F.lit(keep)).alias("rest")))
        low += width
    return df.select("*", F.inline(F.array(*rows)))


def _first_only(x, bit, segments: tuple[int, ...]):
    """Whether ``bit`` of the first segment with at most one differing bit is the one a pair is to be reported under."""
    low, near_before, found = 0, F.lit(False), F.lit(False)
    for width in segments:
        part = F.shiftrightunsigned(F.shiftleft(x, 64 - low - width), 64 - width)
        inside = (bit >= low) & (bit < low + width)
        here = F.when(part == 0, bit == low).otherwise(part == F.call_function("shiftleft", F.lit(1).cast("long"), bit - F.lit(low)))
        found = found | (inside & ~near_before & here)
        near_before = near_before | (F.bit_count(part) <= 1)
        low += width
    return found


def groups(prints: DataFrame, distance: int = DISTANCE, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """``fp`` and ``component_id`` for every distinct fingerprint of ``prints(doc_id, fp)``.

    Fingerprints link when at most ``distance`` bits differ; a component's id is the smallest doc_id in it.  ``segments``
    are bit widths that sum to 64 and number more than ``distance / 2``.  Rows with a null doc_id take part by their
    fingerprint but never give the id (a group of such rows only has a null id).
    """
    if sum(segments) != 64 or distance >= 2 * len(segments):
        raise ValueError("segments must sum to 64 bits and number more than half the distance")
    classes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")

    same = Window.partitionBy("bit", "rest")
    index = _variants(classes.select("fp"), segments).withColumn("centre", F.min("fp").over(same))
    stars = index.where((F.col("fp") > F.col("centre")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= distance))
    linked = components(stars.select(F.col("fp").alias("a"), F.col("centre").alias("b")))
    first = settled(linked, "stars")
    discard(linked)

    labelled = classes.join(first, classes["fp"] == first["node"], "left").select("fp", F.coalesce("component", "fp").alias("c"))
    labelled = settled(labelled, "labelled")
    # variants whose members are of one component have nothing left to find
    index = _variants(labelled, segments).withColumns({"low": F.min("c").over(same), "high": F.max("c").over(same)})
    index = settled(index.where("low <> high").drop("low", "high"), "open")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    bridges = index.alias("l").join(
        index.alias("r"),
        (F.col("l.bit") == F.col("r.bit")) & (F.col("l.rest") == F.col("r.rest")) & (F.col("l.fp") < F.col("r.fp")) & (F.col("l.c") != F.col("r.c"))
        & (F.bit_count(x) <= distance) & _first_only(x, F.col("l.bit"), segments),
    ).select(F.col("l.c").alias("a"), F.col("r.c").alias("b"))
    second = components(bridges)
    discard(index, first)
    full = labelled.join(second, labelled["c"] == second["node"], "left").select("fp", F.coalesce("component", "c").alias("group"))
    full = full.join(classes, "fp")
    least = full.groupBy("group").agg(F.min("least").alias("component_id"))
    return full.join(least, "group").select("fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, segments: tuple[int, ...] = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Nulls, blank texts and repeated rows: a null or blank text has fingerprint zero and links like any other; rows that
    share a doc_id each get their own row.  A text of any length is hashed whole, in pieces.  Other columns are ignored,
    whatever their names.  An empty table gives an empty result.
    """
    prints = settled(fingerprints(docs, shingle), "prints")
    found = groups(prints, distance, segments)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

