"""Token-id files: byte-level encoding into ORC with row indexes and Bloom filters, and reads that prune by them."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallycast.llm.queries import query, table
from tallycast.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
CACHED_PIECES = 500_000  # of one Python worker, in all, some 120 MB; see PieceEncoder._keep
STALE_AFTER = 8  # times as many new pieces as it holds, after which a full cache starts anew
BATCH_IDS = 1_000_000  # token ids in one output batch, except where one document has more
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
COLUMNS = "part int, doc_id {kind}, part_start bigint, n_tokens bigint, tokens array<int>"
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
LETTERS_BELOW = "\u0250"  # Latin: letters in every version of Unicode
BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
# byte-level vocabularies spell a byte without a visible Latin-1 character as one of the characters from 256 on
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
SPELLING = {b: 256 + i for i, b in enumerate(_HIDDEN)}
SPELT_LEAD = {"": "", " ": chr(SPELLING[32])}


class _OddSpace(Exception):
    """White space other than a single newline between two words of a piece."""


class PieceEncoder:
    """Ids of a text as little-endian 32-bit integers, equal to the tokenizer's on the whole text.

    A byte-level tokenizer starts a new pre-token wherever a single space stands between two characters that are
    not white space, at a single newline so placed, after it, and where punctuation follows a letter; merges
    never cross pre-tokens.  So a text is cut there, a word is given to the tokenizer's model once, and repeats come
    from a bounded cache; anything but Latin letters and punctuation goes through the whole tokenizer.  Texts with a
    string of an added token, and tokenizers of any other kind, are encoded whole.
    """

    def __init__(self, path: str):
        import json

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        kind = config["pre_tokenizer"] or {}
        plain = config["normalizer"] is None and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        self.piecewise = plain and kind.get("type") == "ByteLevel" and config["model"]["type"] == "BPE" and not config["model"].get("dropout")
        self.added = [t["content"] for t in config["added_tokens"]]
        self.caches: dict[str, dict[str, bytes]] = {"": {}, " ": {}}  # by what stands before the piece
        self.kept = self.beyond = 0
        self.newline = self.encode("\n")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def _keep(self, cache: dict[str, bytes], piece: str, ids: bytes) -> None:
        """Frequent pieces come early and stay; a full cache starts anew once it has missed many times its size."""
        if self.kept < CACHED_PIECES:
            cache[piece] = ids
            self.kept += 1
        else:
            self.beyond += 1
            if self.beyond > STALE_AFTER * CACHED_PIECES:
                for every in self.caches.values():
                    every.clear()
                self.beyond = self.kept = 0

    def _piece(self, piece: str, lead: str) -> bytes:
        """Ids of ``lead + piece``, where the piece neither begins nor ends with white space.

        A word with punctuation is kept when its word has been before; most others do not come again.
        """
        cache = self.caches[lead]
        ids = cache.get(piece)
        if ids is not None:
            return ids
        if "\n" in piece:
            parts = piece.split("\n")
            if [p for p in parts if p.split() != [p]]:
                raise _OddSpace
            return self._piece(parts[0], lead) + b"".join([self.newline + self._piece(p, "") for p in parts[1:]])
        stem = piece.rstrip(PUNCTUATION)
        if stem.isalpha() and (stem.isascii() or max(stem) < LETTERS_BELOW):
            whole = len(stem) == len(piece)
            ids = None if whole else cache.get(stem)
            new = ids is None
            if new:
                spelt = stem if stem.isascii() else stem.encode().decode("latin-1").translate(SPELLING)
                found = [t.id for t in self.model.tokenize(SPELT_LEAD[lead] + spelt)]
                ids = struct.pack(f"<{len(found)}i", *found)
                self._keep(cache, stem, ids)
            if not whole:
                ids += self._piece(piece[len(stem) :], "")
            if new:
                return ids
        elif piece.split() == [piece]:
            ids = self.encode(lead + piece)
        else:
            raise _OddSpace
        self._keep(cache, piece, ids)
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.piecewise or any(a in text for a in self.added):
            return self.encode(text)
        first, *pieces = text.split(" ")
        ids = list(map(self.caches[" "].get, pieces))
        try:
            if None in ids:
                ids = [self._piece(p, " ") if i is None else i for p, i in zip(pieces, ids)]
            return self._piece(first, "") + b"".join(ids)
        except _OddSpace:  # cut only where both neighbours of a space are not white space
            first, *pieces = BOUNDARY.split(text)
            return self._whole(first, "") + b"".join([self._whole(p[1:], " ") for p in pieces])

    def _whole(self, piece: str, lead: str) -> bytes:
        try:
            return self._piece(piece, lead)
        except _OddSpace:
            return self.encode(lead + piece)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder of a Python worker, kept between tasks."""
    return PieceEncoder(path)


def _batch(part: int, ids: list, starts: list[int], encoded: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
    sizes = np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(encoded), dtype="<i4"))
    columns = [
        pa.array(np.full(len(ids), part, np.int32)), pa.array(ids, kind), pa.array(starts, pa.int64()), pa.array(sizes),
        pa.ListArray.from_arrays(pa.array(offsets), values),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "part_start", "n_tokens", "tokens"])


def write_tokens(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID
) -> None:
    """Write one ORC row per document: ids in ascending order of ``id_column``, the end id appended.

    Texts are range-partitioned and sorted by id (null ids first, equal ids by a hash of the text), then encoded in
    place, so only texts are shuffled and file ``part`` holds the ids of one range; ``part_start`` counts ids before a
    document in its file.  Integer columns get run-length encoding, each 1,000 rows an index entry, ``doc_id`` a Bloom
    filter.  A null text is empty: its document is the end id alone.  No rows give files without rows.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    end = np.array([end_id], dtype="<i4").tobytes()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, starts, encoded, held, kind = [], [], [], 0, batch.schema.field(0).type
            for k, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                encoded.append(encode(one.as_py()) + end)
                ids.append(k)
                starts.append(start)
                size = len(encoded[-1]) // 4
                start, held = start + size, held + size
                if held >= BATCH_IDS:
                    yield _batch(part, ids, starts, encoded, kind)
                    ids, starts, encoded, held = [], [], [], 0
            if ids:
                yield _batch(part, ids, starts, encoded, kind)
        ids, starts, encoded, batch = [], [], [], None
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds its cache only

    ordered.mapInArrow(run, COLUMNS.format(kind=kind)).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: Sequence[int] | None = None, kind: str = "bigint") -> DataFrame:
    """Rows ``(part, doc_id, part_start, n_tokens, tokens)``; with ``ids``, stripes and row groups are pruned by
    the index and the Bloom filters.  Files are split by stripe, so one file is read by several tasks."""
    rows = spark.read.schema(COLUMNS.format(kind=kind)).orc(path)
    return rows if ids is None else rows.filter(F.col("doc_id").isin(list(ids)))


def token_digests(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read back from the files.

    ``start`` is the document's offset in its file plus the ids of all files before, which come from a scan of the
    two narrow columns only and make one row per file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            raw = lists.values.to_numpy().astype("<u4", copy=False)
            bounds = lists.offsets.to_numpy()
            sums = [zlib.crc32(raw[a:b].data) for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path, kind=kind)
    digests = rows.select("part", "doc_id", "part_start", "tokens").mapInArrow(
        run, f"part int, doc_id {kind}, part_start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", F.expr("coalesce(sum(total) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("before"))
    return digests.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


@query("op2_token_orc")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-orc")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
