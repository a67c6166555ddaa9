"""Exact-substring dedup by a distributed merge sort of suffixes that never compares a known common prefix twice.

Only suffixes that may repeat are sorted.  The anchor of every ``length``-byte string is its ``anchor``-byte piece with the
smallest hash; strings with the same anchor lie side by side and form a *stretch*, whose suffix is taken from its first
string to the end of its last.  Anchors found in one document only are struck out first (a bucket of documents sends its
distinct anchors to shards of the hash space and gets one bit back for each), and their suffixes are never sent.

Each bucket sorts its suffixes, led by their anchor's hash so that shards are ranges of the order and evenly loaded, drops
equal ones, and sends front-coded runs: for each suffix the length of the prefix shared with the one before, and the rest.
A shard merges the runs with a loser tree that keeps these lengths: two heads are told apart by their lengths alone unless
they are equal, and then the comparison starts behind the known prefix.  Equal suffixes come out side by side; where one
anchor leads different suffixes, their single strings are matched as well.  What goes back to a bucket is, for each of its
different suffixes, the smallest document that has it and a bit for each of its strings; the places stay with the bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget
from tidemark.llm.exchange import BUCKET_BYTES, DIRECT, RUNS, answered, buckets_for, covered, crossed, cuts, incoming, opened, outgoing, pack, shared_anchors, small, squeezed, unpack, width_for
from tidemark.llm.rolling import Prefix, runs, winnow

LENGTH = 50


def _stretches(data: bytes, length: int, anchor: int):
    """Anchor hash, first string and number of strings of each stretch."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = Prefix(data).sliding(anchor)
    at = winnow(h, length - anchor + 1)
    first, n = runs(at)
    return h[at[first]], first, n


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that are known to share ``start`` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared-prefix lengths, lengths of the rest, and the rests of a sorted list."""
    lcp, before = np.zeros(len(strings), np.uint32), b""
    for i, s in enumerate(strings):
        lcp[i] = shared_prefix(before, s)
        before = s
    size = np.fromiter(map(len, strings), np.uint32, len(strings)) - lcp
    return lcp, size, b"".join([s[k:] for s, k in zip(strings, lcp.tolist())])


def merge(codes: list[tuple[np.ndarray, np.ndarray, bytes]]):
    """Merge front-coded runs: yields (string, prefix shared with the last one, run, number in its run), sorted.

    A loser tree over the runs.  Every head knows the prefix it shares with the last string put out, so of two heads the
    one that shares more is the smaller, and only heads that share equally are compared, from there on.
    """
    k = 1
    while k < len(codes):
        k *= 2
    lcps, sizes, rests = [c[0].tolist() for c in codes], [c[1].tolist() for c in codes], [c[2] for c in codes]
    place, offset = [0] * k, [0] * k
    head: list[bytes | None] = [None] * k
    shares = [0] * k

    def advance(r: int) -> None:
        i = place[r]
        if i >= len(lcps[r]):
            head[r] = None
            return
        lcp, size, at = lcps[r][i], sizes[r][i], offset[r]
        before = head[r]
        head[r] = (before[:lcp] if lcp else b"") + rests[r][at : at + size]
        shares[r], offset[r], place[r] = lcp, at + size, i + 1

    for r in range(len(codes)):
        advance(r)

    def loser(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two heads; the loser's share becomes the one with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        n = shared_prefix(x, y, shares[a])
        if x[n:] <= y[n:] if n < len(x) and n < len(y) else len(x) <= len(y):
            shares[b] = n
            return a, b
        shares[a] = n
        return b, a

    tree = [0] * (2 * k)
    winners = [0] * (2 * k)
    winners[k : 2 * k] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = loser(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while head[top] is not None:
        yield head[top], shares[top], top, place[top] - 1
        advance(top)
        node = (top + k) // 2
        while node:
            a, b = top, tree[node]
            x, y = head[a], head[b]
            if y is not None:
                if x is None:
                    top, tree[node] = b, a
                elif shares[a] == shares[b]:
                    top, tree[node] = loser(a, b)
                elif shares[a] < shares[b]:
                    top, tree[node] = b, a
            node //= 2


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int | None = None, bucket_bytes: int = BUCKET_BYTES, direct: int = DIRECT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (binary) of every document.

    A byte goes if it lies in a ``length``-byte string that also starts in a document with a smaller doc_id; strings are
    judged on the texts as given, overlaps count, and matches never cross documents.  A null text is empty.  A row with a
    null doc_id loses nothing and takes nothing from others; rows that share a doc_id count as one document and never cut
    each other.  Texts shorter than ``length`` stay whole; a text of any length is handled whole, in one task, with memory in
    proportion to it.  Other columns are ignored; an empty table gives an empty result.
    """
    anchor = anchor or max(1, length // 2 - 1)
    if length - anchor + 1 > 62:
        raise ValueError("length - anchor must be below 62")
    buckets = shards = buckets_for(docs, bucket_bytes)
    width = width_for(buckets, 2 * shards, direct)
    rows = squeezed(docs, buckets)
    told, left = shared_anchors(rows, buckets, shards, width, lambda data: _stretches(data, length, anchor))

    def send(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, texts = opened(pdf)
        strings, row, first = [], [], []
        for r, (text, (h, start, n)) in enumerate(zip(texts, left(ids, texts, told))):
            lead = h.astype(">u8").tobytes()
            begin, end = start.tolist(), (start + n + length - 1).tolist()
            strings += [lead[8 * i : 8 * i + 8] + text[s:e] for i, (s, e) in enumerate(zip(begin, end))]
            row += [r] * len(begin)
            first += begin
        if not strings:
            return outgoing(0, {}, width)
        order = sorted(range(len(strings)), key=strings.__getitem__)
        row, first = np.array(row, np.int32)[order], np.array(first, np.int64)[order]
        owner = np.array([0 if i is None else i for i in ids], np.int64)[row]
        distinct, count = [], []
        for i in order:
            if distinct and distinct[-1] == strings[i]:
                count[-1] += 1
            else:
                distinct.append(strings[i])
                count.append(1)
        lead = np.array([int.from_bytes(s[:8], "big") for s in distinct], np.uint64)
        count = np.array(count, np.int64)
        least = np.minimum.reduceat(owner, np.cumsum(count) - count)
        n = np.repeat(np.array([len(s) - 7 - length for s in distinct], np.uint8), count)
        at = cuts(lead, shards)
        sent = {s: pack(front_code(distinct[a:b]), small(least[a:b])) for s, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a}
        bucket = int(pdf["bucket"].iloc[0])
        return outgoing(bucket, sent | {shards + bucket: pack(small(count), n, small(owner), row, small(first))}, width)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        dst, got = int(pdf["dst"].iloc[0]), incoming(pdf, width)
        if dst >= shards:  # a bucket's own places
            return outgoing(dst, dict(got), width)
        parts = [unpack(x) for _, x in got]
        least = [p[1].tolist() for p in parts]
        first = [np.zeros(len(x), np.int64) for x in least]  # smallest document of each suffix
        some = [np.zeros(len(x), np.int64) for x in least]  # its strings that start in a smaller document still

        def resolve(group: list) -> None:
            """All suffixes of one anchor: [string, smallest document, places]."""
            masks = [0] * len(group)
            if len(group) > 1:
                earliest: dict[bytes, int] = {}
                for s, doc, _ in group:
                    for i in range(8, len(s) - length + 1):
                        w = s[i : i + length]
                        if earliest.get(w, doc) >= doc:
                            earliest[w] = doc
                for g, (s, doc, _) in enumerate(group):
                    for i in range(8, len(s) - length + 1):
                        if earliest[s[i : i + length]] < doc:
                            masks[g] |= 1 << i - 8
            for mask, (s, doc, places) in zip(masks, group):
                for r, i in places:
                    first[r][i], some[r][i] = doc, mask

        group: list = []
        for s, lcp, r, i in merge([p[0] for p in parts]):
            if group and lcp < 8:
                resolve(group)
                group = []
            doc = least[r][i]
            if group and lcp == len(s) == len(group[-1][0]):
                group[-1][2].append((r, i))
                group[-1][1] = min(group[-1][1], doc)
            else:
                group.append([s, doc, [(r, i)]])
        resolve(group)
        return outgoing(dst, {bucket: pack(small(f), m) for (bucket, _), f, m in zip(got, first, some)}, width)

    def cut(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, texts = opened(pdf)
        out = []
        for i, text, (at, mask) in zip(ids, texts, answered(told, len(ids), width)):
            gone = covered(len(text), at, mask, length) if len(at) else np.zeros(0, bool)
            spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            out.append((i, len(text), len(text) - len(kept), spans, kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})

    sent = crossed(rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(send, RUNS), width)
    marks = crossed(sent.groupBy("dst").applyInPandas(combine, RUNS), width).withColumnRenamed("dst", "bucket")
    return rows.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same result by definition, for small tests."""
    first: dict[bytes, int] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, x in texts:
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, x in texts:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        out.append((d, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
