"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token exactly one vocabulary token can end its encoding.  The automaton of the vocabulary (a trie
with suffix links) reports every token that is a suffix of the prefix; a candidate is the right one if the prefix before
it is empty, or if that prefix's own last token and the candidate stay apart when encoded together.  Following the stored
tokens back from the end gives the ids, the same as merging by rank, in time linear in the matches.

A worker remembers the ids of single pieces, so that each distinct piece is worked out once.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held, trim

#: The pre-token pattern of this vocabulary family: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces in each of the two generations a worker remembers; a limit on its memory, not on the texts.
CACHE_PIECES = 400_000
_INFINITY = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        self.bytes_of = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self._born = {ids[bytes([b])]: -1 for b in range(256)}
        self._halves: dict[int, tuple[int, int]] = {}
        self._rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (ids[bytes(letters[c] for c in half)] for half in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = ids[self.bytes_of[left] + self.bytes_of[right]]
            if whole in self._born or left not in self._born or right not in self._born:
                raise ValueError("every merge must make a new token out of older ones")
            self._rank[left, right], self._halves[whole], self._born[whole] = rank, (left, right), rank
        self._automaton = ahocorasick.Automaton()
        for i in self._born:
            self._automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self._automaton.make_automaton()
        self._apart: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._pieces = regex.compile(PATTERN)
        self._spaced = re.compile(r" (?=[^\s\x1c-\x1f\x85])")
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of ``token`` while it is built, newest first, and when each is used up."""
        out, end = [], _INFINITY
        while True:
            out.append((token, end))
            if token not in self._halves:
                return out
            end, token = self._born[token], self._halves[token][side]

    def apart(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode as just these two.

        They do unless, while both are built, the two tokens at the seam are a mergeable pair whose turn comes before
        either is used up; of two merges of equal rank the one further left goes first.
        """
        if (known := self._apart.get((left, right))) is not None:
            return known
        right_spine = self._spine(right, 0)
        result = True
        for a, a_end in self._spine(left, 1):
            for b, b_end in right_spine:
                rank = self._rank.get((a, b))
                if rank is not None and rank < a_end and rank <= b_end:
                    result = False
        if len(self._apart) > 4 * CACHE_PIECES:
            self._apart.clear()
        self._apart[left, right] = result
        return result

    def piece(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        last: list[int | None] = [None] * (len(data) + 1)
        for end, token in self._automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] is None:
                start = end - len(self.bytes_of[token])
                if start == 0 or self.apart(last[start], token):
                    last[end] = token
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def _ordinary(self, text: str) -> bytes:
        # a single space before a visible character always begins a pre-token, so texts fall apart there
        chunks = self._spaced.split(text)
        if len(self._known) > CACHE_PIECES:  # pieces in use move to the new generation, others are forgotten with the old
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        for chunk in set(chunks[1:]):
            if chunk not in known:
                known[chunk] = older[chunk] if chunk in older else self._ids(" " + chunk)
        return self._ids(chunks[0]) + b"".join(map(known.__getitem__, chunks[1:]))

    def _ids(self, text: str) -> bytes:
        return np.array([i for x in self._pieces.findall(text) for i in self.piece(x.encode())], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers; the strings of special tokens give their ids."""
        parts = self._specials.split(text or "") if self._specials else [text or ""]
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._ordinary(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def model(path: str) -> PrefixBpe:
    """One model per worker process and file, until the worker turns to another stage."""
    return held(("bpe", path), lambda: PrefixBpe(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit) of every row; a null text is empty."""

    def run(batches):
        bpe = model(path)
        for batch in batches:
            ids = pa.array([bpe.encode(x) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and the decoded ``text``; bytes that are not UTF-8 become replacement characters."""

    def run(batches):
        bpe = model(path)
        for batch in batches:
            text = pa.array([bpe.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its ids and of the text decoded from them.

    Rows with null doc_id or repeated rows each give a row; a text of any length is encoded whole, its time in proportion to
    its length; other columns are ignored; an empty table gives no rows.
    """
    out = decode(encode(docs, path), path)
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def digest_by_library(path: str, text: str | None) -> tuple[int, str, str]:
    """What the tokenizers library gives, for tests."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
