import functools
import hashlib
import itertools
import random
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallycast.llm import token_alignment as T

FILES = (public_tokenizers.path(T.BYTE_LEVEL), public_tokenizers.path(T.PIECES))
A, B = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
A.encode_special_tokens = True
ALIGN = T.Aligner(*FILES)


@functools.cache
def spelling():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def piece_bytes(k):
    name = B.id_to_piece(k)
    return bytes([int(name[3:5], 16)]) if len(name) == 6 and name.startswith("<0x") else name.replace("▁", " ").encode()


def groups_of(text):
    """Groups by whole-text encoding, a byte at a time; None without tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a, raw_b = [bytes(spelling()[c] for c in A.id_to_token(k)) for k in a], [piece_bytes(k) for k in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    ends = [list(itertools.accumulate(map(len, raw))) for raw in (raw_a, raw_b)]
    both = sorted(set(ends[0]) & set(ends[1]))
    place = {e: n for n, e in enumerate(both)}
    out = [([], []) for _ in both]
    for side, ids in enumerate((a, b)):
        at = 0
        for k, end in zip(ids, ends[side]):
            out[at][side].append(k)
            at = place[end] + 1 if end in place else at
    return out


def spelt(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(rows):
    found = [groups_of(t) for _, t in rows]
    counts = Counter(p for g in found if g for p in {(x, y) for a, b in g for x in a for y in b})
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (doc, _), g in zip(rows, found):
        if g is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in g for x in a for y in b]
        n = [counts[p] for p in links]
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[p] == top[p[0]] for p in links), sum(n),
                    hashlib.sha256(spelt(g).encode()).hexdigest()))
    return sorted(out, key=str)


ODD = ["", " ", "  two  spaces", "\n\nlines\n x\n\ty \n", "a\nb\nc", "\nstart", "end ", "<|endoftext|> <s> </s> <unk> <0x0A> <0x41>", "mark ▁ inside", "▁", "é ü 漢字かな　全角",
       "emoji 👩‍👩‍👧 and ́combining", "tab\tnew\x1cpart\x85next", "don't we'll I'm", "x" * 500, "a  b   c    d", "null\x00 byte \x01", "١٢٣ 456 7", "ﬁ ligature Å Å", " nbsp  ​", "\r\n\r\nx\r y"]


def check(texts):
    numbers, digests, (places, pairs, times) = ALIGN.documents(texts)
    for k, text in enumerate(texts):
        want = groups_of(text)
        assert digests[k] == ("" if want is None else hashlib.sha256(spelt(want).encode()).hexdigest()), text
        links = Counter((x << T.ID_BITS | y) for a, b in want or () for x in a for y in b)
        assert dict(zip(pairs[places == k].tolist(), times[places == k].tolist())) == links
        assert [numbers[c][k] for c in ("n_groups", "n_links")] == [len(want or ()), links.total()]
        assert [numbers[c][k] for c in ("n_a", "n_b")] == [sum(len(g[side]) for g in want or ()) for side in (0, 1)]


def test_odd_texts_equal_whole_encoding(monkeypatch):
    check(ODD + [None])
    monkeypatch.setattr(T, "WIDE", 2)
    check(ODD + [None])
    check([])
    check(["", None])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é\n\t '.1漢▁ \x1c<>|s"), max_size=60))
def test_no_token_crosses_a_cut(text):
    """Stretches between cuts, encoded by themselves, have the tokens that they have in the whole text."""
    whole = ALIGN.encode([" " + text])[0] if text else None
    parts = ALIGN.encode(ALIGN.boundary.split(" " + text)) if text else [None]
    assert (whole is None) == (None in parts)
    assert whole is None or whole == tuple([k for p in parts for k in p[side]] for side in (0, 1))


def test_cuts_are_safe_in_given_documents():
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    check(texts)
    for text, whole in zip(texts, ALIGN.encode([" " + t for t in texts])):
        parts = ALIGN.encode(ALIGN.boundary.split(" " + text))
        assert whole == tuple([k for p in parts for k in p[side]] for side in (0, 1))


def same(x, y):
    x.groups, y.groups = [";".join(x.groups)], [";".join(y.groups)]
    return all(getattr(x, c) == getattr(y, c) for c in T.Fragment.__slots__)


@pytest.mark.parametrize("seed", range(8))
def test_fragments_are_an_associative_monoid(seed):
    draw = random.Random(seed)
    text = " " + " ".join(draw.choice(["häßlich", "the", "漢字文", "unbelievable", "x\ny", "internationalization", "1234567"]) for _ in range(40))
    size = len(text.encode())
    bounds = [0, *sorted(draw.sample(range(1, size), 40)), size]
    make = lambda: [ALIGN.fragment(text, a, b) for a, b in zip(bounds, bounds[1:])]
    assert any(f.tail[0] or f.tail[1] for f in make())

    def tree(parts):
        if len(parts) == 1:
            return parts[0]
        cut = draw.randint(1, len(parts) - 1)
        left, right = tree(parts[:cut]), tree(parts[cut:])
        left.append(right, ALIGN.names)
        left.append(T.Fragment(), ALIGN.names)
        return left

    whole = spelt(groups_of(text[1:]))
    first, second = tree(make()).finish(ALIGN.names), tree(make()).finish(ALIGN.names)
    assert ";".join(first.groups) == whole and same(first, second)


def test_chunks_cut_words_and_cover_the_text(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 50)
    for text in ("internationalization über " * 60, "word " + "x" * 400 + " end of it " * 20, "漢字" * 300, "a\nb c " * 100):
        chunks = ALIGN.chunks(text)
        if chunks is None:
            assert " " not in text
            continue
        out = T.Fragment()
        for stretch, low, high in chunks:
            out.append(ALIGN.fragment(stretch, low, high), ALIGN.names)
        assert ";".join(out.finish(ALIGN.names).groups) == spelt(groups_of(text))
    chunks = ALIGN.chunks("internationalization über " * 60)
    assert any(low > 0 for _, low, _ in chunks)
    assert max(len(c) for c, *_ in ALIGN.chunks("word " + "x" * 4000 + " end of it " * 20)) < 4100


def test_table_equals_brute_force(spark):
    draw = random.Random(3)
    words = ["the", "quick", "übergroß", "internationalization", "1999", "naïve", "don't", "漢字", "emoji👍"]
    long = " ".join(draw.choice(words) + draw.choice(["", "", ".", "\n", ","]) for _ in range(45_000))
    assert len(ALIGN.chunks(long)) > T.FAN_IN
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (101, long), (101, long), (102, "y" * 70_000), (103, long[:40_000] + " ▁ " + long[:40_000]), (None, "the quick"), (None, "the quick")]
    frame = spark.createDataFrame([(d, t, 7, "b") for d, t in rows], "doc_id long, text string, n_a int, pair string")
    assert sorted(map(tuple, T.align(frame).collect()), key=str) == brute(rows)
    assert T.align(frame.limit(0)).count() == 0


def test_counts_joined_without_broadcast(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    want = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, T.align(frame).collect()), key=str) == want
    monkeypatch.setattr(T, "SMALL_PAIRS", 0)
    assert sorted(map(tuple, T.align(frame).collect()), key=str) == want
