"""SimHash near-duplicates: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm.components import components, join_local_links
from tallycast.llm.queries import query, table
from tallycast.llm.rows import row_key
from tallycast.session import materialise

SHINGLE_WORDS = 4
RADIUS = 4
TILE = 16_384  # fingerprints of a tile, on average; a pair of tiles is compared in one task
BLOCK = 1 << 17  # comparisons of one numpy call
SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # most significant bit first


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint: bit b is 1 where more than half of the shingles' hashes have it.

    Words are runs of bytes other than space and 0x09-0x0D in the text with A-Z lower-cased; shingles count as
    often as they occur; a text of fewer words is one shingle; null and texts without a word give 0.
    """
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; ``fp`` is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _halves(fp: Column) -> tuple[Column, Column]:
    """Population counts of the upper and the lower 32 bits."""
    return F.bit_count(F.shiftrightunsigned(fp, 32)), F.bit_count(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def compare_tiles(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within ``radius`` between the tiles (within the tile if ``same``).

    Every pair is compared by exclusive-or and bit count, a block at a time; a pair already joined adds nothing,
    so a tile of near copies leaves fewer links than it has members, and no connection is lost.
    """
    every = a if same else np.concatenate((a, b))
    labels = np.arange(len(every))
    rows = max(1, BLOCK // max(1, len(b)))
    for start in range(0, len(a), rows):
        skip = start + 1 if same else 0
        near = np.bitwise_count(a[start : start + rows, None] ^ b[None, skip:]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            i, j = i + start, j + skip
            if same:
                i, j = i[i < j], j[i < j]
            else:
                j = j + len(a)
            join_local_links(labels, i, j)
    joined = np.flatnonzero(labels != np.arange(len(every)))
    return every[joined], every[labels[joined]]


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(a, b)`` links that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other.

    A fingerprint's tile is the pair of population counts of its halves, cut by hash into as many parts as its
    size asks for.  Two fingerprints can be within the radius only if the counts' differences add up to no more
    than it, so all other tile pairs are skipped: a tile meets at most 41 kinds of tile at radius 4.  Tile pairs are
    rows of a join and spread over the cluster.  The comparison is exact; its work is a fixed part of all
    pairs of distinct fingerprints, and its memory is bounded by the tile.
    """
    p, q = _halves(F.col("fp"))
    signed = prints.select("fp", p.alias("p"), q.alias("q"))
    parts = signed.groupBy("p", "q").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))  # at most 33 * 33 rows
    parts = F.broadcast(materialise(parts, "parts"))
    cut = signed.join(parts, ["p", "q"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = materialise(cut.groupBy("p", "q", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    steps = [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if i + abs(j) <= radius and (i, j) >= (0, 0)]
    other = F.explode(F.array(*[F.struct((F.col("p") + i).alias("p2"), (F.col("q") + j).alias("q2")) for i, j in steps]))
    sizes = parts.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("parts").alias("parts2"))
    pairs = tiles.select("p", "q", "part", other.alias("o")).select("p", "q", "part", "o.*").join(F.broadcast(sizes), ["p2", "q2"])
    pairs = pairs.withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    same = (F.col("p") == F.col("p2")) & (F.col("q") == F.col("q2"))
    pairs = pairs.filter(~same | (F.col("part2") >= F.col("part"))).withColumn("same", same & (F.col("part2") == F.col("part")))
    left = tiles.select("p", "q", "part", F.col("fps").alias("left"))
    right = tiles.select(F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("part").alias("part2"), F.col("fps").alias("right"))
    work = pairs.join(left, ["p", "q", "part"]).join(right, ["p2", "q2", "part2"]).select("left", "right", "same")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (0, 1))
                u, v = compare_tiles(a, b, batch.column(2)[k].as_py(), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return work.mapInArrow(run, "a bigint, b bigint")


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest document id reachable over links, the document's own included.  Equal fingerprints meet in a grouped
    minimum first, so a group of exact copies of any size is one fingerprint from then on.  Null and empty
    texts have fingerprint 0 and are linked like any others; a null id never is a component's id unless all its ids
    are null; repeated rows stay repeated; other columns of ``docs`` are not read; no rows give no rows.
    """
    printed = materialise(fingerprints(docs, id_column, text, shingle), "prints")
    distinct = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["id"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return printed.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` with all their columns, one of each near-duplicate group: that of the smallest id
    (null before all).

    Groups are found on (id, hash of id and text), so null and repeated ids lose no other text.  Texts are shuffled
    once, by that hash, for the join and for repeated rows.
    """
    keyed = docs.select("doc_id", "text", *row_key())
    groups = simhash_groups(keyed.select(F.struct("doc_id", "ka", "kb").alias("row"), "text"), "row", "text", shingle, radius)
    firsts = materialise(groups.filter("doc_id = component_id").select("doc_id.ka", "doc_id.kb").distinct(), "firsts")
    whole = docs.select(F.struct("*").alias("_row"), *row_key())
    return whole.join(firsts, ["ka", "kb"]).dropDuplicates(["ka", "kb"]).select("_row.*")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
