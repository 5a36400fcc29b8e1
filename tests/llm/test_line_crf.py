import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallycast.llm import line_crf as C

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, l in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", l) and l in lines[:i])
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


TEXTS = [None, "", " \n\t", "a", "a b c", "a a a a", "a b c a b c", "x\ny\nx\n\n\nx ", "# * $%&|<>", "é \x85 中 \xa0 é", "a b\x0bc\x0c d\r\n"]


def test_base_counts():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "b", "é", " ", "\n", "#", "\x85"]) for _ in range(rng.randrange(80))) for _ in range(500)]
    for t in texts:
        assert C.base_counts(t) == brute(t), repr(t)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        chain = C.Chain(rng.standard_normal((2, C.WIDTH)), rng.standard_normal((2, 2)), rng.standard_normal(2), rng.standard_normal(2))
        codes = np.column_stack([rng.integers(0, g, n) for g in C.GROUPS])
        e = chain.emissions(codes)

        def total(y):
            return chain.first[y[0]] + chain.last[y[-1]] + sum(e[i, v] for i, v in enumerate(y)) + sum(chain.pairs[a, b] for a, b in zip(y, y[1:]))

        assert total(chain.decode(codes)) == pytest.approx(max(total(y) for y in itertools.product((0, 1), repeat=n)))


def test_fit_climbs_the_exact_likelihood():
    rng = np.random.default_rng(3)
    docs = [np.column_stack([rng.integers(0, g, n) for g in C.GROUPS]) for n in rng.integers(1, 6, 60)]
    labels = [(d[:, 0] + rng.integers(0, 3, len(d)) > 3).astype(int) for d in docs]

    def likelihood(chain):
        out = 0.0
        for d, y in zip(docs, labels):
            e = chain.emissions(d)
            score = lambda v: chain.first[v[0]] + chain.last[v[-1]] + sum(e[i, w] for i, w in enumerate(v)) + sum(chain.pairs[a, b] for a, b in zip(v, v[1:]))
            every = [score(v) for v in itertools.product((0, 1), repeat=len(d))]
            out += score(y.tolist()) - np.logaddexp.reduce(every)
        return out / len(docs) - 0.5 * C.RIDGE * sum((v**2).sum() for v in (chain.lines, chain.pairs, chain.first, chain.last))

    best = C.fit_chain(docs, labels)
    for _ in range(20):
        near = C.Chain(*(v + 0.05 * rng.standard_normal(v.shape) for v in (best.lines, best.pairs, best.first, best.last)))
        assert likelihood(near) < likelihood(best) + 1e-3


def test_documents_against_labels(spark):
    got = C.op10(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = got[~got.base_failed]
    assert (held.kept == (held.quality == 1)).mean() > 0.97
    assert not got[got.base_failed].kept.any()


def test_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "word " * 200_000, "x"), (1, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = C.apply_rules(docs, C.EMPTY).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *brute(t)) for i, t, _ in rows[:-2] + rows[-1:])
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got if r.doc_id is not None) == want
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert C.apply_rules(docs.filter("false"), C.fit(docs, labels)).count() == 0
