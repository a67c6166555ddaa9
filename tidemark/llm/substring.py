"""Substring dedup by seed and extend on winnowed word anchors.

Seeds.  Of every window of ``window`` words the anchor is its ``anchor``-word run with the smallest hash (winnowing), so two
equal windows always hold the same anchor at the same place.  Anchors are joined across documents; those of one document
only cannot lie in a repeat and go no further.

Extension.  Each shared anchor is extended both ways over all the windows it stands for (a *stretch*).  Stretches that are
equal as a whole are matched by one key; only where different stretches share an anchor are the single windows compared.
A window is a repeat where it also starts in a document with a smaller id, and overlapping repeats join into maximal runs.

Every match is made by grouping on a key with a minimum, never by listing pairs.  A bucket of documents sends each
different stretch once, with the smallest of its documents; the places where a stretch stands stay with the bucket.  So a
passage in a third of all documents costs its shard one entry for each bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget
from tidemark.llm.exchange import BUCKET_BYTES, DIRECT, RUNS, answered, buckets_for, covered, crossed, cuts, incoming, opened, outgoing, pack, shared_anchors, small, squeezed, unpack, width_for
from tidemark.llm.rolling import Prefix, runs, winnow

WINDOW = 13
ANCHOR = 5


def _words(text: bytes) -> np.ndarray:
    """One hash for each word."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _stretches(text: bytes, window: int, anchor: int):
    """Anchor hash, first window and number of windows of each stretch."""
    h = Prefix(_words(text)).sliding(anchor)
    at = winnow(h, window - anchor + 1)
    first, n = runs(at)
    return h[at[first]], first, n


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order of rows by their keys, the start of each group in it, and each sorted row's group number."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bucket_bytes: int = BUCKET_BYTES, direct: int = DIRECT) -> DataFrame:
    """doc_id, text_key, n_words, n_removed and ``kept`` (the kept words, single-spaced, as binary) of every document.

    ``text_key`` is Spark's xxhash64 of the text ('' if null), which tells rows apart that share a doc_id.

    A word goes if it lies in ``window`` consecutive words that also start in a document with a smaller doc_id; windows
    are judged on the texts as given.  ``window - anchor`` must be below 62.  Nulls: a null text has no words; rows with
    a null doc_id lose nothing and take nothing from others.  Rows that share a doc_id count as one document and never cut
    each other.  Texts shorter than a window stay as they are; a text of any length is handled whole, in one task, with
    memory in proportion to it.  Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < anchor <= window <= anchor + 61:
        raise ValueError("anchor must be at most window, and at least window - 61")
    buckets = shards = buckets_for(docs, bucket_bytes)
    width = width_for(buckets, 2 * shards, direct)
    rows = squeezed(docs, buckets)
    told, left = shared_anchors(rows, buckets, shards, width, lambda text: _stretches(text, window, anchor))

    def extend(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Shared anchors extended both ways: the hash of each stretch, and of each window of the different ones."""
        ids, texts = opened(pdf)
        parts = []
        for r, (text, (seed, first, n)) in enumerate(zip(texts, left(ids, texts, told))):
            if len(seed):
                prefix = Prefix(_words(text))
                each = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                parts.append((seed, prefix.slices(first, first + n + window - 1), n, first, np.full(len(seed), r), np.full(len(seed), ids[r]), prefix.sliding(window)[each]))
        if not parts:
            return outgoing(0, {}, width)
        seed, whole, n, first, row, owner, windows = (np.concatenate(x) for x in zip(*parts))
        order, start, _ = _groups(seed, whole)
        lone = order[start]  # one stretch for each different one
        least = np.minimum.reduceat(owner[order], start)
        pick = np.repeat((np.cumsum(n) - n)[lone] - np.r_[0, np.cumsum(n[lone])[:-1]], n[lone]) + np.arange(n[lone].sum())
        windows, ends = windows[pick], np.r_[0, np.cumsum(n[lone])]
        at = cuts(seed[lone], shards)
        sent = {s: pack(seed[lone[a:b]], whole[lone[a:b]], n[lone[a:b]].astype(np.uint8), windows[ends[a] : ends[b]], small(least[a:b])) for s, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a}
        bucket = int(pdf["bucket"].iloc[0])
        places = pack(np.diff(np.r_[start, len(order)]), *(small(x[order]) for x in (n, owner, row, first)))
        return outgoing(bucket, sent | {shards + bucket: places}, width)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        """The stretches of a range of anchors from all buckets: which of their windows an earlier document has."""
        forget()
        dst, got = int(pdf["dst"].iloc[0]), incoming(pdf, width)
        if dst >= shards:  # a bucket's own places
            return outgoing(dst, dict(got), width)
        parts = [unpack(x) for _, x in got]
        seed, whole, n, windows, least = (np.concatenate([p[i] for p in parts]) for i in range(5))
        n, least = n.astype(np.int64), least.astype(np.int64)
        order, start, group = _groups(seed, whole)
        first = np.zeros(len(seed), np.int64)
        first[order] = np.minimum.reduceat(least[order], start)[group] if len(order) else first[:0]
        # an anchor that leads different stretches can hide a window first seen in another of them
        lone = order[start]
        mixed = np.zeros(len(lone), bool)
        if len(lone) > 1:
            next_same = seed[lone][1:] == seed[lone][:-1]
            mixed[1:] |= next_same
            mixed[:-1] |= next_same
        some = np.zeros(len(lone), np.int64)
        hard = lone[mixed]
        if len(hard):
            size, begin = n[hard], (np.cumsum(n) - n)[hard]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            w, lead, doc = windows[np.repeat(begin, size) + inner], np.repeat(seed[hard], size), np.repeat(first[hard], size)
            o, s, g = _groups(lead, w)
            earliest = np.empty(len(w), np.int64)
            earliest[o] = np.minimum.reduceat(doc[o], s)[g]
            late = earliest < doc
            np.bitwise_or.at(some, np.repeat(np.flatnonzero(mixed), size)[late], np.int64(1) << inner[late])
        mask = np.zeros(len(seed), np.int64)
        mask[order] = some[group]
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        answers = zip(got, np.split(first, ends), np.split(mask, ends))
        return outgoing(dst, {bucket: pack(small(f), m) for (bucket, _), f, m in answers}, width)

    def cut(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, texts = opened(pdf)
        out = []
        for i, text, (at, mask) in zip(ids, texts, answered(told, len(ids), width)):
            words = text.split()
            n = len(words)
            if len(at):
                words = [words[i] for i in np.flatnonzero(~covered(n, at, mask, window)).tolist()]
            out.append((i, xxhash.xxh64_intdigest(text, 42), n, n - len(words), b" ".join(words)))
        out = pd.DataFrame(out, columns=["doc_id", "text_key", "n_words", "n_removed", "kept"])
        return out.assign(text_key=out["text_key"].astype("uint64").astype("int64")).astype({"doc_id": "Int64"})

    sent = crossed(rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(extend, RUNS), width)
    marks = crossed(sent.groupBy("dst").applyInPandas(match, RUNS), width).withColumnRenamed("dst", "bucket")
    return rows.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInPandas(cut, "doc_id long, text_key long, n_words long, n_removed long, kept binary")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same result by definition, for small tests."""
    first: dict[tuple, int] = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(doc_id, first.get(w, doc_id))
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone: set[int] = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
