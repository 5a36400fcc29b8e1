"""Line deduplication by content-defined chunks: globally repeated chunks of lines are removed after byte comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm.queries import query, table
from tallycast.llm.rows import row_key
from tallycast.session import materialise

WINDOW = 2  # lines whose hashes the rolling hash covers
CHUNKINGS = 32  # of every text, each by its own bit of the rolling hash
MASK = (1 << 64) - 1
FACTOR = 0x9E3779B97F4A7C15


def rolling_hashes(lines: list[bytes]) -> list[int]:
    """After each line the polynomial rolling hash of the last ``WINDOW`` lines' hashes."""
    out, rolling, drop = [], 0, pow(FACTOR, WINDOW, 1 << 64)
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    for at, h in enumerate(hashes):
        rolling = (rolling * FACTOR + h) & MASK
        if at >= WINDOW:
            rolling = (rolling - hashes[at - WINDOW] * drop) & MASK
        out.append(rolling)
    return out


def boundary_bits(lines: list[bytes]) -> list[int]:
    """After each line a bit per chunking: set where that chunking ends a chunk, after every other line on average."""
    return [value >> (64 - CHUNKINGS) for value in rolling_hashes(lines)]


def chunk_spans(lines: list[bytes]) -> list[tuple[int, int]]:
    """First line and line after the last of the chunks of all chunkings with at least two lines with a word.

    A chunk reaches from one boundary of its chunking to the next; the ends of the text are boundaries of all.  Bits
    depend on the last lines only, so chunks inside a passage are the same wherever it stands, and at which of its
    lines they end differs between the chunkings.
    """
    bits, every = boundary_bits(lines), (1 << CHUNKINGS) - 1
    worded = [0]
    for line in lines:
        worded.append(worded[-1] + (not line.isspace() and line != b""))
    found = []
    for start in range(len(lines)):
        open_ones, end = bits[start - 1] if start else every, start
        while open_ones:  # chunkings with a boundary here and none since
            closed = bits[end] if end + 1 < len(lines) else every
            end += 1
            if open_ones & closed and worded[end] - worded[start] >= 2:
                found.append((start, end))
            open_ones &= ~closed
    return found


def split_lines(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split(b"\n")


def _signed(whole: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return int.from_bytes(whole[:8], "big", signed=True), int.from_bytes(whole[8:], "big", signed=True)


def chunk_table(docs: DataFrame) -> DataFrame:
    """``(ka, kb, doc_id, a, b, h1, h2)``, a row per chunk; ``a`` and ``b`` are its lines in the document."""
    rows = docs.select(*row_key(), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["ka", "kb", "doc_id", "a", "b", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for row, one in enumerate(batch.column(3)):
                lines = split_lines(one.as_py())
                found += [(row, a, b, *_signed(xxhash.xxh3_128_digest(b"\n".join(lines[a:b])))) for a, b in chunk_spans(lines)]
            if found:
                row, a, b, h1, h2 = zip(*found)
                picked = pa.array(row, pa.int64())
                columns = [c.take(picked) for c in batch.columns[:3]]
                columns += [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"ka bigint, kb bigint, doc_id {kind}, a int, b int, h1 bigint, h2 bigint")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``(ka, kb, a, b, h1, h2, again)`` of every occurrence of each digest that occurs more than once; ``again`` is false
    for the first one, by id and place, and for occurrences that overlap it.

    Digests are counted with map-side combine, so a passage in a third of all documents is one row per task.  What is
    joined grows with the corpus, so nothing is broadcast: the job has one shape at every size.
    """
    narrow = materialise(chunk_table(docs), "chunks")
    counted = narrow.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    hits = materialise(narrow.join(counted.hint("merge"), ["h1", "h2"], "left_semi"), "hits")
    place = F.struct("doc_id", "ka", "kb", "a", "b")
    first = hits.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    first = first.select("h1", "h2", *[F.col(f"first.{c}").alias(f"f{c}") for c in ("ka", "kb", "b")]).hint("merge")
    apart = (F.col("fka") != F.col("ka")) | (F.col("fkb") != F.col("kb")) | (F.col("a") >= F.col("fb"))
    return materialise(hits.join(first, ["h1", "h2"]).select("ka", "kb", "a", "b", "h1", "h2", apart.alias("again")), "occurrences")


def with_chunks(docs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``(doc_id, text, chunks)``, the documents with their repeated chunks (null: none), written: texts are shuffled once."""
    chunks = occurrences.distinct().groupBy("ka", "kb").agg(F.collect_list(F.struct("a", "b", "h1", "h2", "again")).alias("chunks"))
    return materialise(docs.select("doc_id", "text", *row_key()).join(chunks.hint("merge"), ["ka", "kb"], "left").select("doc_id", "text", "chunks"), "documents")


def _compared(rows: DataFrame, members: bool = False) -> DataFrame:
    """``(kind, h1, h2, bytes)``: of kind 0 the lines of repeated chunks by their digests, of kind 1 the chunks as the
    digests of their lines; with ``members`` the chunks once per line digest instead (kind 2)."""
    names = ["kind", "h1", "h2", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple] = set()
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = split_lines(text)
                digests = [xxhash.xxh3_128_digest(line) for line in lines]
                for s in spans:
                    inside = digests[s["a"] : s["b"]]
                    if members:
                        found.update((2, s["h1"], s["h2"], d) for d in inside)
                    else:
                        found.add((1, s["h1"], s["h2"], b"".join(inside)))
                        found.update((0, *_signed(d), line) for d, line in zip(inside, lines[s["a"] : s["b"]]))
            if found:
                types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    return rows.filter("chunks IS NOT NULL").select("text", "chunks").mapInArrow(run, "kind int, h1 bigint, h2 bigint, bytes binary")


def differing_chunks(rows: DataFrame) -> DataFrame:
    """``(h1, h2)`` of chunk digests that stand for different bytes.

    Chunks are equal if their lines' digests are, in order, and lines if their bytes are; so every line of a repeated
    chunk is sent once, however many chunks hold it, and chunks as 16 bytes a line.
    """
    versions = _compared(rows).groupBy("kind", "h1", "h2").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    differ = materialise(versions.filter("low <> high").select("kind", "h1", "h2"), "differ")
    chunks = differ.filter("kind = 1").select("h1", "h2")
    lines = differ.filter("kind = 0")
    if lines.isEmpty():
        return chunks
    signed = [F.conv(F.hex(F.substring("bytes", at, 8)), 16, -10).cast("bigint").alias(n) for at, n in ((1, "l1"), (9, "l2"))]
    members = _compared(rows, members=True).select("h1", "h2", *signed)
    return chunks.union(members.join(lines.select(F.col("h1").alias("l1"), F.col("h2").alias("l2")), ["l1", "l2"]).select("h1", "h2")).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed_lines, n_removed_chunks)``, one row per row of ``docs`` (doc_id, text).

    Lines of a chunk that occurs before (in a document of smaller id, or earlier in the same one) are removed, those
    of its first occurrence stay unless another chunk with them occurs earlier still: every removed line stands, byte
    for byte, at an earlier place, but a first occurrence can lose a part that has an earlier one of its own.  A text
    has ``CHUNKINGS`` chunkings, so that a repeated passage holds whole chunks of some of them, though their ends need
    not fall on its ends; ``n_removed_chunks`` counts different runs of lines.  A digest that different bytes share
    removes nothing.  A null text stays null with no lines; null ids come first in the order; rows of equal id and
    text are one document and lose the same lines; other columns are not read; no rows give no rows.
    """
    occurrences = repeated_chunks(docs)
    rows = with_chunks(docs, occurrences)
    differ = differing_chunks(rows)
    while not differ.isEmpty():
        occurrences = materialise(occurrences.join(differ, ["h1", "h2"], "left_anti"), "occurrences")
        rows = with_chunks(docs, occurrences)
        differ = differing_chunks(rows)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, lost, pieces = [], [], [], []
            for one, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = {(s["a"], s["b"]) for s in spans or () if s["again"]}
                out = {n for a, b in gone for n in range(a, b)}
                texts.append("\n".join(line for n, line in enumerate(one.split("\n")) if n not in out) if out else one)
                lost.append(len(out))
                lines.append(0 if one is None else one.count("\n") + 1)
                pieces.append(len(gone))
            columns = [batch.column(0), pa.array(texts, pa.string()), *(pa.array(v, pa.int64()) for v in (lines, lost, pieces))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string, n_lines bigint, n_removed_lines bigint, n_removed_chunks bigint")


@query("op9_line_chunks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
