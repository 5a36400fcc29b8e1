import random

import pyarrow.parquet as pq
import pytest

from tallycast.llm import line_chunks as L


def brute(docs):
    """Every chunk of every document against all earlier ones, by bytes."""
    order = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    first, out = {}, {}
    for doc in order:
        lines = L.split_lines(doc[1])
        for a, b in L.chunk_spans(lines):
            first.setdefault(tuple(lines[a:b]), (doc, b))
    for doc in order:
        lines, gone, runs = L.split_lines(doc[1]), set(), 0
        for a, b in L.chunk_spans(lines):
            where, end = first[tuple(lines[a:b])]
            if where != doc or a >= end:
                gone.update(range(a, b))
                runs += 1
        out[doc] = ("\n".join(line.decode() for n, line in enumerate(lines) if n not in gone), len(lines), len(gone), runs)
    return sorted((str(d[0]), *map(str, out.get(d, (None, 0, 0, 0)))) for d in docs)


def got(frame):
    return sorted((str(r.doc_id), str(r.text), str(r.n_lines), str(r.n_removed_lines), str(r.n_removed_chunks)) for r in frame.collect())


def passage(rng, n):
    return "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(n))


def test_chunks_cover_the_text_and_are_found_after_a_shift():
    rng = random.Random(1)
    for text in ["", "\n", "a", "a\nb\n", passage(rng, 50), "\n" * 1000, "x\n" * 3000]:
        lines = L.split_lines(text)
        bits, spans = L.boundary_bits(lines), set()
        for number in range(L.CHUNKINGS):
            ends = [n + 1 for n, b in enumerate(bits) if b >> number & 1 or n + 1 == len(lines)]
            spans.update(zip([0, *ends], ends))
        assert L.chunk_spans(lines) == sorted((a, b) for a, b in spans if sum(bool(x.strip()) for x in lines[a:b]) >= 2)
    shared = passage(rng, 40)
    a, b = (L.split_lines(t) for t in (passage(rng, 7) + "\n" + shared + "\n" + passage(rng, 3), passage(rng, 4) + "\n" + shared))
    both = {tuple(a[x:y]) for x, y in L.chunk_spans(a)} & {tuple(b[x:y]) for x, y in L.chunk_spans(b)}
    assert len({line for chunk in both for line in chunk}) >= 39
    assert L.chunk_spans(L.split_lines(None)) == [] and L.chunk_spans(L.split_lines("one line")) == []


def test_rolling_hash_depends_on_its_window_only():
    rng = random.Random(4)
    lines = L.split_lines(passage(rng, 30))
    assert L.rolling_hashes(lines)[12:] == L.rolling_hashes(lines[11:])[1:]
    assert L.rolling_hashes(lines)[11] != L.rolling_hashes(lines[11:])[0]


def test_equal_to_brute_force(spark):
    rng = random.Random(2)
    shared = [passage(rng, n) for n in (2, 5, 12, 30)] + ["same\nsame", "\n\n"]
    docs = [(0, None), (1, ""), (2, "one line"), (None, "\n".join((shared[2], passage(rng, 2))))]
    for i in range(80):
        docs.append((10 + i, "\n".join(rng.choice([passage(rng, 3), rng.choice(shared), rng.choice(shared)]) for _ in range(rng.randrange(1, 6)))))
    docs += docs[20:23]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, at int, h1 string").repartition(7)
    want = brute(docs)
    assert got(L.dedup_lines(df)) == want
    assert sum(int(w[4]) for w in want) > 200
    assert L.dedup_lines(df.filter("false")).count() == 0


def test_query_equals_brute_force_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    assert got(L.op9(spark, folder)) == brute(docs)


def test_nothing_is_broadcast(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plans = []
    own = L.materialise

    def kept(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df, name)

    L.materialise = kept
    try:
        L.dedup_lines(docs).count()
    finally:
        L.materialise = own
    assert len(plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_every_removed_line_stands_earlier(spark):
    """Chunks that share lines: a first occurrence may lose a part, but no line is lost altogether."""
    rng = random.Random(6)
    a, b, c = (passage(rng, 2) for _ in range(3))
    docs = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{c}"), (3, f"{b}\n{c}"), (4, f"{c}\n{a}\n{a}")]
    out = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    kept = [line for i in sorted(out) for line in out[i].split("\n")]
    assert {line for _, t in docs for line in t.split("\n")} <= set(kept) and out[1] == docs[0][1]


def test_digests_that_collide_are_left_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, "e f\ng h"), (3, "a b\nc d"), (4, "same x\nsame y"), (5, "same x\nsame y")], "doc_id long, text string")
    own = L.chunk_table

    def colliding(df):
        """One digest for the chunks of documents 1 to 3."""
        return own(df).withColumns({c: L.F.when(L.F.col("doc_id") < 4, 7).otherwise(L.F.col(c)) for c in ("h1", "h2")})

    monkeypatch.setattr(L, "chunk_table", colliding)
    found = L.with_chunks(docs, L.repeated_chunks(docs))
    assert [tuple(r) for r in L.differing_chunks(found).collect()] == [(7, 7)]
    assert {r.doc_id: r.n_removed_lines for r in L.dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 2}


def test_lines_that_collide_spoil_their_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one {k}\ntwo {k}") for i, k in enumerate((1, 1, 2, 2))], "doc_id long, text string")
    rows = L.with_chunks(docs, L.repeated_chunks(docs))
    assert L.differing_chunks(rows).count() == 0
    own = L._compared

    def colliding(df, members=False):
        """The first lines get the digest 0."""
        out, first = own(df, members), [L.xxhash.xxh3_128_digest(f"one {k}".encode()) for k in (1, 2)]
        if members:
            return out.withColumn("bytes", L.F.when(L.F.col("bytes").isin(first), L.F.unhex(L.F.lit("00" * 16))).otherwise(L.F.col("bytes")))
        hit = (L.F.col("kind") == 0) & L.F.col("bytes").cast("string").startswith("one")
        return out.withColumns({c: L.F.when(hit, 0).otherwise(L.F.col(c)) for c in ("h1", "h2")})

    monkeypatch.setattr(L, "_compared", colliding)
    assert L.differing_chunks(rows).count() == 2


@pytest.mark.parametrize("lines, least", [(2, 0.95), (3, 0.985), (4, 0.99), (8, 0.99)])
def test_share_of_repeated_lines_found(lines, least):
    rng, found, total = random.Random(lines), 0, 0
    for _ in range(300):
        run = passage(rng, lines)
        sides = [L.split_lines("\n".join((passage(rng, rng.randrange(1, 5)), run, passage(rng, rng.randrange(1, 5))))) for _ in range(2)]
        chunks = [{tuple(s[a:b]) for a, b in L.chunk_spans(s)} for s in sides]
        found += len({line for chunk in chunks[0] & chunks[1] for line in chunk})
        total += lines
    assert found / total >= least
