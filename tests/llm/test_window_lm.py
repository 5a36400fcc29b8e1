import os
import subprocess
import sys
from pathlib import Path

import numpy as np

from tallycast.llm import window_lm as L

SF = "/root/testdata/sf0.001"
SIZES = L.Sizes(30)


def random_network(seed, dtype=np.float64):
    rng = np.random.default_rng(seed)
    return L.Network(SIZES, {k: (rng.standard_normal(s) * 0.3).astype(dtype) for k, s in SIZES.shapes.items()})


def test_contexts_stay_inside_documents():
    tokens, around, owner = L.contexts([np.array([1, 2]), np.array([], int), np.array([3])], 9)
    assert tokens.tolist() == [1, 2, 3] and owner.tolist() == [0, 0, 2]
    assert around.tolist() == [[9, 9, 9, 2, 9, 9], [9, 9, 1, 9, 9, 9], [9] * 6]


def test_slopes_equal_differences():
    rng, network = np.random.default_rng(1), random_network(1)
    tokens, around = rng.integers(0, SIZES.ids, 40), rng.integers(0, SIZES.ids, (40, 2 * L.SIDE))
    slopes = network.slopes(tokens, around)
    loss = lambda n: -n.log_probabilities(tokens, around).mean()
    first, place = divmod(int(tokens[0]), SIZES.members)
    for k, at in (("embed", (around[0, 0], 2)), ("inner", (3, 4)), ("inner_bias", (5,)), ("outer", (6, first)), ("outer_bias", (first,)),
                  ("member", (first, 2, place)), ("member_bias", (first, place))):
        up, down = network.copy(), network.copy()
        up.weights[k][at] += 1e-5
        down.weights[k][at] -= 1e-5
        assert np.isclose((loss(up) - loss(down)) / 2e-5, slopes[k][at], rtol=1e-4, atol=1e-8), k


def test_softmaxes_go_to_exp_together(monkeypatch):
    sizes, rng, calls, exp = L.Sizes(2000), np.random.default_rng(5), [], np.exp
    network = L.Network.start(sizes, np.ones(sizes.ids))
    tokens, around = rng.integers(0, sizes.ids, 3000), rng.integers(0, sizes.ids, (3000, 2 * L.SIDE))
    monkeypatch.setattr(np, "exp", lambda *a, **b: calls.append(1) or exp(*a, **b))
    network.slopes(tokens, around)
    network.log_probabilities(tokens, around)
    assert sizes.lists > 40 and len(calls) <= 4 * -(-3000 // L.ROWS)


def test_scores_equal_plain_softmaxes_at_any_size_of_weights(monkeypatch):
    monkeypatch.setattr(L, "ROWS", 16)
    rng = np.random.default_rng(6)
    tokens, around = rng.integers(0, SIZES.ids, 100), rng.integers(0, SIZES.ids, (100, 2 * L.SIDE))
    for scale, dtype in ((1, np.float32), (400, np.float32), (3000, np.float64)):
        network = random_network(6, dtype)
        for k in ("outer", "outer_bias", "member", "member_bias"):
            network.weights[k] *= scale
        w = {k: v.astype(np.float64) for k, v in network.weights.items()}
        hidden = np.tanh(w["embed"][around].reshape(100, -1) @ w["inner"] + w["inner_bias"])
        want = np.zeros(100)
        lists, places = np.divmod(tokens, SIZES.members)
        inside = np.einsum("nh,nhm->nm", hidden, w["member"][lists]) + w["member_bias"][lists]
        for logits, at in ((hidden @ w["outer"] + w["outer_bias"], lists), (inside, places)):
            most = logits.max(1)
            want += logits[np.arange(100), at] - most - np.log(np.exp(logits - most[:, None]).sum(1))
        assert network._heads()[2] == (scale > 1)
        assert np.allclose(network.log_probabilities(tokens, around), want, rtol=1e-4, atol=1e-4)
        assert all(np.isfinite(v).all() for v in network.slopes(tokens, around).values())


def test_words_of_the_token_table(spark):
    texts = ["Ab  a\x1cb\tÜ\nab", "\x0bx\x85y\x0c z\u00a0z ", None, "", "ab new \u2003 ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (np.frombuffer(r.ids, np.uint16).tolist(), len(r.rest)) for r in L.token_table(docs, ["ab", "ü"]).collect()}
    of = L.Sizes(2).class_of
    assert got == {0: ([0, of("a\x1cb"), 1, 0], 1), 1: ([of("x\x85y"), of("z\u00a0z")], 2), 2: ([], 0), 3: ([], 0), 4: ([0, of("new"), of("\u2003"), 0], 2)}


def test_probabilities_sum_to_one():
    network = random_network(2)
    every = np.arange(SIZES.lists * SIZES.members)
    around = np.repeat(np.random.default_rng(2).integers(0, SIZES.ids, (1, 2 * L.SIDE)), len(every), axis=0)
    assert np.isclose(np.exp(network.log_probabilities(every, around)).sum(), 1.0)


def test_flat_weights_come_back():
    network = random_network(3, np.float32)
    again = L.Network.from_flat(SIZES, network.flat(True))
    assert all((again.weights[k] == v).all() and (again.squares[k] == network.squares[k]).all() for k, v in network.weights.items())
    assert all((L.Network.from_flat(SIZES, network.flat(False)).weights[k] == v).all() for k, v in network.weights.items())


def model(docs):
    words = L.vocabulary(L.word_counts(docs))
    tokens, sizes = L.token_table(docs, words), L.Sizes(len(words))
    return tokens, sizes, L.token_counts(tokens, sizes)


def mean(tokens, network):
    found = L.score(tokens, network).toPandas()
    return found.log_prob.sum() / found.n_tokens.sum()


def test_training_as_it_is_run_beats_frequencies_and_scores_follow_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens, sizes, counts = model(docs)
    network = L.train(tokens, sizes, counts)
    assert mean(tokens, network) > mean(tokens, L.Network.start(sizes, counts)) + 0.2
    got = {r.doc_id: r.log_prob for r in L.score(tokens, network).collect()}
    for r in tokens.limit(5).collect():
        ids = np.frombuffer(r.ids, np.uint16).astype(int)
        padded = [sizes.pad] * L.SIDE + ids.tolist() + [sizes.pad] * L.SIDE
        around = np.array([padded[i : i + L.SIDE] + padded[i + L.SIDE + 1 : i + 2 * L.SIDE + 1] for i in range(len(ids))]).reshape(-1, 2 * L.SIDE)
        assert np.isclose(got[r.doc_id], network.log_probabilities(ids, around).sum(), rtol=1e-5)


def test_held_out_documents_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens, sizes, counts = model(docs)
    held = "pmod(doc_id, 10) = 0"
    rest = tokens.filter(f"NOT {held}")
    counts = L.token_counts(rest, sizes)
    network = L.train(rest, sizes, counts)
    assert mean(tokens.filter(held), network) > mean(tokens.filter(held), L.Network.start(sizes, counts)) + 0.2


def test_layout_and_shards_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = lambda d: {r.doc_id: r.mean_log_prob for r in L.score_documents(d).collect()}
    two, seven = score(docs.repartition(2)), score(docs.orderBy("n_chars").repartition(7))
    assert max(abs(two[i] - seven[i]) for i in two) < 1e-6
    networks = []
    for parts in (2, 7):
        tokens, sizes, counts = model(docs.repartition(parts))
        networks.append(L.train(tokens, sizes, counts, shard=4000))
    assert all(np.allclose(networks[0].weights[k], v, atol=1e-7) for k, v in networks[1].weights.items())
    assert counts.sum() // 4000 > 3 and mean(tokens, networks[0]) > mean(tokens, L.Network.start(sizes, counts)) + 0.05


def test_training_takes_every_token_once(monkeypatch):
    seen = []
    monkeypatch.setattr(L, "BLOCK", 100)
    monkeypatch.setattr(L.Network, "step", lambda self, token, around: seen.extend(zip(token.tolist(), around[:, 2].tolist())))
    trainer, docs = L.Trainer(random_network(4), 3, 16), [np.arange(n) % SIZES.words for n in (1, 0, 2, 50, 1201)]
    for ids in docs:
        trainer.add(ids)
    trainer.learn()
    want = [(int(b), int(a)) for ids in docs for a, b in zip([SIZES.pad, *ids], ids)]
    assert sorted(seen) == sorted(want) and trainer.used == sum(map(len, docs))


def test_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, " \n", "x"), (None, "w " * 300_000, "x"), (4, "a\x1cb c ü", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = L.score_documents(docs).toPandas()
    assert sorted(got.n_tokens) == [0, 0, 2, 2, 2, 300_000] and got[got.doc_id == 1].log_prob.nunique() == 1
    assert (got[got.n_tokens == 0].log_prob == 0).all() and got.log_prob.notna().all()
    assert L.score_documents(docs.filter("false")).count() == 0


def test_words_of_a_class_share_it_by_their_counts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40))) for i in range(9)]
    rows += [(20, "house house house qzxqz"), (21, "w1 w2 w3 house w4 w5 w6")]
    sizes = L.Sizes(40)
    nonsense = next(w for w in (f"x{i}" for i in range(10**4)) if sizes.class_of(w) == sizes.class_of("house"))
    docs = spark.createDataFrame(rows + [(22, f"w1 w2 w3 {nonsense} w4 w5 w6")], "doc_id long, text string")
    assert len(L.vocabulary(L.word_counts(docs))) == 40
    got = {r.doc_id: r.log_prob for r in L.score_documents(docs).collect()}
    assert np.isclose(got[21] - got[22], np.log(4))
    tokens, sizes, counts = model(docs)
    alone = {r.doc_id: r.log_prob for r in L.score(tokens, L.train(tokens, sizes, counts)).collect()}
    assert np.isclose(got[21] - alone[21], np.log(4 / counts[sizes.class_of("house")]))


def test_vocabulary_grows_with_the_corpus(spark):
    few, many = (L.Sizes(n) for n in (100, 10_000))
    assert many.ids > 80 * few.ids and abs(many.lists * many.members - many.ids) < 2 * many.members
    docs = spark.createDataFrame([(1, "a a a a a b b b b c"), (2, "b C c c c")], "doc_id long, text string")
    assert L.vocabulary(L.word_counts(docs)) == ["a", "b", "c"]


FAULTS = """
import resource
import numpy as np
from tallycast.llm import window_lm as L

rng, sizes, faults = np.random.default_rng(7), L.Sizes(L.MOST_WORDS), []
trainer = L.Trainer(L.Network.start(sizes, np.ones(sizes.ids)), 0, L.BATCH)
for _ in range(4):
    trainer.add(rng.integers(0, sizes.ids, L.BLOCK).astype(np.uint16))
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print((faults[-1] - faults[1]) / 2 / (L.BLOCK // L.BATCH))
"""


def test_steps_reuse_the_memory_of_steps_before():
    root, kept = str(Path(L.__file__).parents[2]), {k: v for k, v in os.environ.items() if not k.startswith("MALLOC_")}
    said = subprocess.run([sys.executable, "-c", FAULTS], cwd=root, env=kept | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True)
    assert float(said.stdout) < 100


def test_contexts_are_as_narrow_as_ids():
    tokens, around, owner = L.contexts([np.array(one, np.uint16) for one in ([5, 6, 7, 8], [], [1])], 60_000)
    assert tokens.dtype == around.dtype == np.uint16 and owner.tolist() == [0, 0, 0, 0, 2]
    assert around[1].tolist() == [60_000, 60_000, 5, 7, 8, 60_000] and around[4].tolist() == [60_000] * 6
    assert [len(part) for part in L.contexts([], 9)] == [0, 0, 0]


def test_counts_by_broadcast_and_by_join_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).localCheckpoint()
    docs = docs.unionByName(spark.createDataFrame([(-1, "x" * 100 + " rare rare \x0bRARE " + "x" * 100), (-2, None)], docs.schema))
    counted = L.word_counts(docs).localCheckpoint()
    every = {r.word: r.n for r in counted.collect()}
    monkeypatch.setattr(L, "MOST_WORDS", 50)
    words, got, waiting = L.vocabulary(counted), [], []
    for most in (0, 300, 10**6):
        monkeypatch.setattr(L, "MOST_COUNTS", most)
        others = L.class_counts(counted, words)
        assert len(others) <= most and not set(others) & set(words) and all(every[w] == n for w, n in others.items())
        left = [n for w, n in every.items() if w not in others and w not in words and len(w) <= L.LONG_WORD]
        assert not others or not left or max(left) < min(others.values())
        tokens = L.token_table(docs, words, others)
        waiting.append(tokens.selectExpr("sum(size(rest)) AS n").first().n)
        assert waiting[-1] == sum(n for w, n in every.items() if w not in others and w not in words)
        got.append({r.doc_id: (r.n_tokens, r.log_prob) for r in L.score_documents(docs).collect()})
    assert waiting[0] > waiting[1] > waiting[2] == 2  # the long word
    for one in got[1:]:
        assert one.keys() == got[0].keys()
        assert all(one[i][0] == n and np.isclose(one[i][1], p, rtol=1e-9, atol=1e-9) for i, (n, p) in got[0].items())
