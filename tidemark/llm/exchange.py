"""Exchanging sorted key runs between document buckets and key shards.

Documents are dealt into buckets of bounded bytes.  A bucket asks about its distinct keys with one compact run per shard
of the key space instead of one row per key; a shard sees the runs of all buckets side by side and answers each run with
one value per key.  Keys are well-mixed unsigned 64-bit integers, and a shard is a range of them, so sorted runs stay
sorted and shards are even however frequent a key is: a bucket sends each key once.

Only runs that hold something travel.  Up to ``DIRECT`` buckets and shards a run goes straight to its shard.  Beyond, it
goes by way of a relay: a bucket packs the runs for ``width`` neighbouring shards into one row, a relay task takes the rows of
``width`` buckets for that range and repacks them by shard.  With ``width`` near the square root of their number, n buckets and
n shards exchange 2 n sqrt(n) rows instead of n squared, and every row stays large enough to be worth sending.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget

BUCKET_BYTES = 8 << 20
#: What a row weighs in a bucket besides its text.
ROW_BYTES = 512
#: Buckets and shards that exchange runs without a relay.
DIRECT = 256
RUNS = "over int, src int, runs binary"


def buckets_for(docs: DataFrame, bucket_bytes: int) -> int:
    """How many hash buckets keep a bucket near ``bucket_bytes``, whatever the size of the table."""
    weight = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + ROW_BYTES
    return max(1, math.ceil((docs.agg(F.sum(weight).alias("n")).first()["n"] or 0) / bucket_bytes))


def width_for(buckets: int, shards: int, direct: int = DIRECT) -> int:
    """How many shards share a row, and how many buckets a relay: one where no relay is needed."""
    n = max(buckets, shards)
    return 1 if n <= direct else math.isqrt(n - 1) + 1


def outgoing(src: int, runs: dict[int, bytes], width: int) -> pd.DataFrame:
    """The rows ``RUNS`` that carry the runs of one sender: one for each range of receivers."""
    ranges: dict[int, list] = {}
    for dst, run in runs.items():
        ranges.setdefault(dst // width, []).append((dst, run))
    rows = [(over, src, pickle.dumps(x, protocol=5)) for over, x in ranges.items()]
    return pd.DataFrame(rows, columns=["over", "src", "runs"]).astype({"over": "int32", "src": "int32"})


def crossed(sent: DataFrame, width: int) -> DataFrame:
    """``dst, under, runs``: the rows of ``outgoing`` dealt by receiver (``under``: a sender, or a range of them)."""
    if width == 1:
        return sent.toDF("dst", "under", "runs")

    def relay(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[int, list] = {}
        for src, runs in zip(pdf["src"], pdf["runs"]):
            for dst, run in pickle.loads(runs):
                by.setdefault(dst, []).append((src, run))
        rows = [(dst, int(pdf["src"].iloc[0]) // width, pickle.dumps(x, protocol=5)) for dst, x in by.items()]
        return pd.DataFrame(rows, columns=["dst", "under", "runs"]).astype({"dst": "int32", "under": "int32"})

    return sent.groupBy("over", (F.col("src") / width).cast("int").alias("under")).applyInPandas(relay, "dst int, under int, runs binary")


def incoming(pdf: pd.DataFrame, width: int) -> list[tuple[int, bytes]]:
    """(sender, run) for all runs of one receiver, by sender."""
    if width == 1:
        out = [(int(src), pickle.loads(runs)[0][1]) for src, runs in zip(pdf["under"], pdf["runs"])]
    else:
        out = [x for runs in pdf["runs"] for x in pickle.loads(runs)]
    return sorted(out, key=lambda x: x[0])


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and bucket; rows with equal id and text land together."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))


def cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of the sorted ``keys`` begins and ends: shards + 1 positions."""
    edge = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.r_[0, np.searchsorted(keys, edge), len(keys)]


def squeezed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, bucket and the compressed text ``z`` (a null text counts as empty)."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([press.compress((x or "").encode("utf-8")) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z, batch.column(2)], ["doc_id", "z", "bucket"])

    return bucketed(docs, buckets).mapInArrow(run, "doc_id long, z binary, bucket int")


def opened(pdf: pd.DataFrame) -> tuple[list, list[bytes]]:
    """Ids (None where null) and texts of a bucket, in an order that does not depend on how the rows arrived."""
    forget()
    press = zstandard.ZstdDecompressor()
    pairs = sorted((-1 if pd.isna(i) else int(i), pd.isna(i), bytes(z)) for i, z in zip(pdf["doc_id"], pdf["z"]))
    return [None if null else i for i, null, _ in pairs], [press.decompress(z) for *_, z in pairs]


def _anchors(ids: list, texts: list[bytes], find: Callable, low: np.uint64):
    """Per text its stretches, and the bucket's distinct shortened anchors with whether two of its documents have them."""
    found = [find(x if i is not None else b"") for i, x in zip(ids, texts)]
    each = [np.unique(f[0] >> low) for f in found]
    owner = np.repeat(np.array([0 if i is None else i for i in ids], np.int64), [len(x) for x in each])
    key = np.concatenate(each)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    if not len(key):
        return found, key, np.zeros(0, bool)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return found, key[start], np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)


def shared_anchors(rows: DataFrame, buckets: int, shards: int, width: int, find: Callable) -> tuple[DataFrame, Callable]:
    """Strikes out the anchors that stand in one document only, without sending any text.

    ``find(text)`` gives the anchor hash, first string and number of strings of each stretch of a text.  Every bucket sends
    its distinct anchors, shortened to a few bytes, to shards of the hash space and gets one bit back for each.  (A
    shortened hash may keep an anchor that is not shared; it never loses one that is.)

    Returns the answers by bucket, and a function that gives, for a bucket's ids, texts and answers, the stretches that are
    left: arrays of anchor hash, first string and number of strings for each text.
    """
    size = min(8, 5 + (shards.bit_length() - 1) // 8)
    low = np.uint64(64 - 8 * size)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        _, key, several = _anchors(*opened(pdf), find, low)
        at = cuts(key << low, shards)
        short = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
        runs = {s: pickle.dumps((short[a:b].tobytes(), np.packbits(several[a:b]).tobytes())) for s, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a}
        return outgoing(int(pdf["bucket"].iloc[0]), runs, width)

    def strike(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        keys, several, senders = [], [], []
        for sender, run in incoming(pdf, width):
            x, bits = pickle.loads(run)
            wide = np.zeros((len(x) // size, 8), np.uint8)
            wide[:, :size] = np.frombuffer(x, np.uint8).reshape(-1, size)
            keys.append(wide.reshape(-1).view("<u8"))
            several.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(keys[-1])))
            senders.append(sender)
        distinct, back, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = (n > 1) | (np.bincount(back, np.concatenate(several), len(distinct)) > 0)
        bits = np.split(shared[back], np.cumsum([len(k) for k in keys])[:-1])
        return outgoing(int(pdf["dst"].iloc[0]), {s: np.packbits(b).tobytes() for s, b in zip(senders, bits)}, width)

    def left(ids: list, texts: list[bytes], told: pd.DataFrame) -> list[tuple]:
        found, key, _ = _anchors(ids, texts, find, low)
        n = np.diff(cuts(key << low, shards))
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n[s]) for s, x in incoming(told, width)]
        shared = key[np.concatenate(bits).astype(bool)] if bits else key
        out = []
        for h, first, n in found:
            short = h >> low
            place = np.minimum(np.searchsorted(shared, short), max(len(shared) - 1, 0))
            hit = np.flatnonzero(shared[place] == short) if len(shared) else np.zeros(0, np.int64)
            out.append((h[hit], first[hit], n[hit]))
        return out

    asked = crossed(rows.groupBy("bucket").applyInPandas(ask, RUNS), width)
    return crossed(asked.groupBy("dst").applyInPandas(strike, RUNS), width).withColumnRenamed("dst", "bucket"), left


def covered(n: int, at: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a marked string: bit i of a mask marks the ``length`` places from at + i on."""
    change = np.zeros(n + 1, np.int64)
    for i in range(int(mask.max()).bit_length() if len(mask) else 0):
        start = at[(mask >> i) & 1 == 1] + i
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
    return np.cumsum(change)[:-1] > 0


def answered(told: pd.DataFrame, n: int, width: int) -> list[tuple]:
    """The first strings and masks of what is repeated, for each of the n texts of a bucket.

    ``told`` has the shards' answers (smallest document of each different stretch, mask of its strings that start in a
    smaller one still) and, last, the bucket's own places: how often each stretch stands, and for each place the number
    of its strings, document, row and first string.
    """
    got = [unpack(x) for _, x in incoming(told, width)]
    if not got:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    least, some = (np.concatenate([np.asarray(p[i], np.int64) for p in got[:-1]]) for i in range(2))
    count, size, owner, row, at = (np.asarray(x, np.int64) for x in got[-1])
    mask = np.where(owner > np.repeat(least, count), (np.int64(1) << size) - 1, np.repeat(some, count))
    hit = np.flatnonzero(mask)
    hit = hit[np.argsort(row[hit], kind="stable")]
    edge = np.searchsorted(row[hit], np.arange(n + 1))
    at, mask = at[hit], mask[hit]
    return [(at[a:b], mask[a:b]) for a, b in zip(edge[:-1], edge[1:])]


def small(x: np.ndarray) -> np.ndarray:
    """The same numbers in 32 bits where they fit."""
    return x.astype(np.int32) if not len(x) or -(1 << 31) <= x.min() and x.max() < 1 << 31 else x


def pack(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, protocol=5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
