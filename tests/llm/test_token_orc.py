import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallycast.llm import token_orc as T

PATH = public_tokenizers.path(T.TOKENIZER)
TEXTS = [None, "", " ", "\n", "a", " lead", "trail ", "two  spaces", "tab\tand\nnew \n line", "x y z", "it's we'll 123 45a", "é ñ 中文 😀 ok",
         "a <|endoftext|> b", "one\ntwo, three.\n\nfour", "\nx", "it's.\n's 'll", "naïve Éa*** of%%% ß ŋƀ ɐb x_y", "a'b' 'c", "ªº µ aªb", "end\n", "a b \n", "foo\n bar", "foo bar\n", " a  b", "\x1c a", "a \x1cb c", "word " * 4000]


def expected(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_equal_whole_encoding():
    rng = random.Random(4)
    alphabet = ["a", "Be", "'s", "é", "ß", ",", "\n", "_", "ɐ", "²", "ª", " ", " ", "  ", "\n", "\t", "12", ".", "é", " ", "中", "!!"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(1500)]
    encode = T.PieceEncoder(PATH)
    for t, want in zip(texts, expected(texts)):
        assert np.frombuffer(encode(t or ""), "<i4").tolist() == want, repr(t)


def test_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(T, "CACHED_PIECES", 3)
    encode = T.PieceEncoder(PATH)
    texts = ["a b c d e f", "a b", "c d e f g h", "a b c d e f"]
    assert [np.frombuffer(encode(t), "<i4").tolist() for t in texts] == expected(texts)


def test_cache_limit_holds_for_all_pieces_of_a_worker(monkeypatch):
    monkeypatch.setattr(T, "CACHED_PIECES", 6)
    encode = T.PieceEncoder(PATH)
    texts = ["a\nb\nc\nd\ne\nf\ng h i j k l m", "n\no p q", "a\nb h i"]
    assert [np.frombuffer(encode(t), "<i4").tolist() for t in texts * 2] == expected(texts * 2)
    assert 0 < sum(map(len, encode.caches.values())) <= 6


def test_words_with_punctuation_are_kept_once_their_word_is_known():
    encode = T.PieceEncoder(PATH)
    texts = ["q new, other. naïve;", "q new, old!\nnew,\nx other\nother.", "q new, naïve; ,;!"]
    ids = [np.frombuffer(encode(t), "<i4").tolist() for t in texts[:1]]
    assert set(encode.caches[" "]) == {"new", "other", "naïve"}
    ids += [np.frombuffer(encode(t), "<i4").tolist() for t in texts[1:]]
    assert {"new,", "naïve;"} < set(encode.caches[" "]) and "old!" not in encode.caches[" "]
    assert ids == expected(texts) and encode.kept == sum(map(len, encode.caches.values()))


def test_other_tokenizer_is_used_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = T.PieceEncoder(path)
    text = "Some  words here"
    assert not encode.piecewise
    assert np.frombuffer(encode(text), "<i4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("batch_ids", [T.BATCH_IDS, 50])
def test_files_round_trip(spark, tmp_path, monkeypatch, batch_ids):
    rows = [(i * 3 % 64, t, "s") for i, t in enumerate(TEXTS * 3)] + [(None, "null id", "s")] * 2
    path = str(tmp_path / "t")
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(3), path)
    back = T.read_tokens(spark, path).toPandas()
    want = sorted((str(d), tuple(ids) + (2,)) for (d, _, _), ids in zip(rows, expected([r[1] for r in rows])))
    text = lambda v: "None" if v != v else str(int(v))
    assert sorted((text(d), tuple(t.tolist())) for d, t in zip(back.doc_id, back.tokens)) == want
    got = T.token_digests(spark, path).toPandas().sort_values("start").reset_index(drop=True)
    assert got.doc_id.fillna(-1).is_monotonic_increasing
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1].tolist()]
    crc = sorted(zlib.crc32(np.array(t, "<u4").tobytes()) for _, t in want)
    assert sorted(got.ids_crc32) == crc
    assert sorted(T.read_tokens(spark, path, ids=[3, 6]).toPandas().doc_id.unique().tolist()) == [3, 6]
    plan = T.read_tokens(spark, path, ids=[3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id,3)" in plan


def test_empty_table(spark, tmp_path):
    T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert T.token_digests(spark, str(tmp_path / "t")).count() == 0
