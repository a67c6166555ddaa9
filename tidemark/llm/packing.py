"""Packing documents into fixed token windows: concatenate and cut.

First pass: every partition encodes its documents once, counts tokens and keeps the ids with each document's place in its
partition.  The driver then needs one number per partition, whose prefix sums are the global offsets.  Second pass: each
document knows where it lies in the one long concatenation, and is cut where that crosses a multiple of the window.  A
document on a boundary yields a piece on either side; windows are gapless and only the very last one is short.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, settled, trim

WINDOW = 2048
END_ID = 1
#: Encoded words in each of the two generations a worker remembers; a limit on its memory, not on the texts.
CACHE_WORDS = 250_000
#: Words of texts that are looked up together, and new ones encoded as one line: an encoding for each would cost more than its ids.
TOGETHER, LINE = 50_000, 512


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space, remembering the ids of single words.

    Text between two ASCII white-space characters is encoded alike wherever it stands, because such a tokenizer never
    builds a token across white space; so each distinct word needs to be encoded once only.
    """

    def __init__(self, path: str, remember: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._remember = remember
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def __call__(self, text: str | None) -> bytes:
        return self.each([text])[0]

    def each(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text; new words are looked up for some texts at once."""
        out, some, n = [], [], 0
        for text in texts:
            some.append((text or "").encode("utf-8").split())
            n += len(some[-1])
            if n >= TOGETHER:
                out += self._ids(some)
                some, n = [], 0
        return out + self._ids(some)

    def _ids(self, texts: list[list[bytes]]) -> list[bytes]:
        if len(self._known) > self._remember:  # words in use move to the new generation, others are forgotten with the old
            self._known, self._older = {}, self._known
        known, older, unseen = self._known, self._older, []
        for w in set().union(*texts).difference(known):
            if w in older:
                known[w] = older[w]
            else:
                unseen.append(w)
        for at in range(0, len(unseen), LINE):
            part = unseen[at : at + LINE]
            known.update(zip(part, self._new([w.decode() for w in part])))
        return [b"".join(map(known.__getitem__, words)) for words in texts]

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded as one line and cut where tokens reach beyond a word and the space behind it."""
        line = self._tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, ends = np.array(line.ids, "<u4").tobytes(), np.array([end for _, end in line.offsets], np.int64)
        cuts = 4 * np.searchsorted(ends, np.cumsum([len(w) + 1 for w in words]), "right")
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]


def encoder(path: str, remember: int = CACHE_WORDS) -> WordEncoder:
    """One encoder per worker process and file, until the worker turns to another stage."""
    return held(("words", path, remember), lambda: WordEncoder(path, remember))


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, remember: int = CACHE_WORDS) -> DataFrame:
    """Per document: ``part``, ``at`` (tokens before it in its part), ``doc_id``, ``n_tokens`` and ``ids`` with the end id.

    The table is settled, so part numbers and places stay as they are even if a later task runs twice.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, part, at = encoder(tokenizer_path, remember), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + end for x in encode.each(batch.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            places = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(places), batch.column(0), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "at", "doc_id", "n_tokens", "ids"],
            )
        trim()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return settled(rows.mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True, remember: int = CACHE_WORDS) -> DataFrame:
    """Pieces of documents and the sequence each lies in.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` (unsigned little-endian
    32-bit) if ``with_ids``.  A null text counts as empty and gives one piece with the end id alone; a null doc_id and
    repeated rows are packed like any other row; a text of any length is encoded whole and cut as often as need be; other
    columns are ignored; an empty table gives no pieces.  ``remember`` is the number of words in each generation a worker
    remembers: about 330 bytes of its memory each, against encoding rarer words again.
    """
    blocks = token_blocks(docs, tokenizer_path, end_id, remember)
    totals = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a number per partition
    sizes = np.zeros(max(totals, default=-1) + 1, np.int64)
    sizes[list(totals)] = list(totals.values())
    offsets = np.cumsum(sizes) - sizes
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            part, at, doc_id, n, ids = batch.columns
            begin = offsets[part.to_numpy()] + at.to_numpy()
            n = n.to_numpy()
            first, last = begin // window, (begin + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.maximum(sequence * window - begin[row], 0)
            stop = np.minimum((sequence + 1) * window - begin[row], n[row])
            whole = [x.as_buffer() for x in ids]
            pieces = [memoryview(whole[r])[4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist())]
            crc = np.array([zlib.crc32(x) for x in pieces], np.int64)
            columns = [doc_id.take(pa.array(row)), start, stop - start, crc, n[row], sequence, begin[row] + start - sequence * window]
            if with_ids:
                columns.append(pa.array([bytes(x) for x in pieces], pa.binary()))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return blocks.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The padded training sequences themselves from ``pack(..., with_ids=True)``: one row per sequence.

    Columns: sequence_id, ids (binary), n_tokens, doc_starts (offsets where a document begins).  A sequence holds
    ``window`` pieces at most.  Only a short last sequence is padded, unless its length is a power of two.
    """
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "start", "length", "ids"))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    body = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    fill = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.lit(window) - F.col("n_tokens"))
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), fill.cast("int")))
    starts = F.transform(F.filter("p", lambda x: x["start"] == 0), lambda x: x["offset"])
    rows = rows.select("sequence_id", body.alias("ids"), n.alias("n_tokens"), starts.alias("doc_starts"))
    return rows.withColumn("ids", F.concat("ids", pad))
