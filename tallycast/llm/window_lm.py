"""Masked pseudo-likelihood: a window network predicts every token from both sides and scores documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.llm.queries import query, table
from tallycast.llm.rows import row_key
from tallycast.session import materialise

OTHER_SPACES = r"[\x09-\x0D]"
LEAST_COUNT = 5  # of a word in the corpus to get an id of its own
MOST_WORDS = 7_680  # words with an id of their own, the most frequent: memory of the network
MOST_COUNTS = 1 << 17  # words whose counts go to the tasks, the most frequent; those of others come by a join
LONG_WORD, LARGE_COUNT = 64, 100_000  # longer words are left to the join; larger counts are not told apart to choose
WORDS_A_CLASS = 16  # words with an id for each hash class that other words share; 16 classes at least
SIDE = 3  # tokens of context on each side
WIDTH, HIDDEN = 8, 16
SHARD = 1 << 21  # tokens that are trained on one after another
BLOCK = 1 << 16  # tokens that are shuffled among each other
BATCH, STEPS = 8192, 256  # tokens of a step at most; fewer where the corpus has no tokens for so many steps
RATE = 0.3
SLICE = 65_536  # tokens scored together
ROWS = 2048  # of them whose logits are held at a time
DEPTH = 80.0  # below 0, of a row's largest logit: its exponential and its reciprocal are still floats
PARTS = 32  # in which weights are averaged
KEPT = 31 << 20  # bytes: below the 32 MB up to which malloc learns


def keep_freed_memory() -> None:
    """Let the C library keep what a step or slice frees for the next, which else is given back and faulted in again.

    glibc takes blocks up to the largest mapped one that was freed from its heap, and trims the heap at twice that.
    """
    np.empty(KEPT, np.uint8)


class Sizes:
    """Ids: words by falling count, hash classes, the mark beyond either end of a document; laid out in ``rows`` lists."""

    def __init__(self, words: int):
        self.words = words
        self.hashed = max(16, words // WORDS_A_CLASS)
        self.pad = words + self.hashed
        self.ids = self.pad + 1
        self.members = int(np.ceil(np.sqrt(self.ids)))
        self.lists = -(-self.ids // self.members)
        self.shapes = {
            "embed": (self.ids, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "inner_bias": (HIDDEN,), "outer": (HIDDEN, self.lists),
            "outer_bias": (self.lists,), "member": (self.lists, HIDDEN, self.members), "member_bias": (self.lists, self.members),
        }

    def classes_of(self, words: list[bytes]) -> np.ndarray:
        return self.words + np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % self.hashed

    def class_of(self, word: str) -> int:
        return int(self.classes_of([word.encode()])[0])


def _order(tokens: np.ndarray) -> np.ndarray:
    """Places of ``tokens`` in rising order, equal ones as they stand."""
    return np.argsort(tokens.astype(np.uint16), kind="stable")  # two bytes are sorted by counting


class Network:
    """The two levels of a token's probability, the list of its id and its place there, from the tokens around it."""

    def __init__(self, sizes: Sizes, weights: dict[str, np.ndarray], squares: dict[str, np.ndarray] | None = None):
        self.sizes, self.weights = sizes, weights
        self.squares = squares or {k: np.full_like(v, 1e-6) for k, v in weights.items()}

    @classmethod
    def start(cls, sizes: Sizes, counts: np.ndarray) -> Network:
        """Small fixed random weights; the biases are logs of smoothed frequencies."""
        noise = np.random.default_rng(0)
        scale = {"embed": 0.1, "inner": 0.1, "outer": 0.1, "member": 0.02}
        weights = {k: (noise.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in sizes.shapes.items()}
        full = np.zeros(sizes.lists * sizes.members)
        full[: sizes.ids] = counts
        full = full.reshape(sizes.lists, sizes.members)
        total = full.sum(1, keepdims=True)
        weights["outer_bias"] = np.log((total[:, 0] + 1) / (total.sum() + sizes.lists)).astype(np.float32)
        weights["member_bias"] = np.log((full + 0.1) / (total + 0.1 * sizes.members)).astype(np.float32)
        return cls(sizes, weights)

    def copy(self) -> Network:
        return Network(self.sizes, *({k: v.copy() for k, v in part.items()} for part in (self.weights, self.squares)))

    def _hidden(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What goes into the hidden layer, and what comes out with a column of ones, for the biases of the next."""
        w = self.weights
        inputs = w["embed"].take(around, axis=0).reshape(len(around), -1)
        hidden = np.ones((len(around), HIDDEN + 1), inputs.dtype)
        np.tanh(inputs @ w["inner"] + w["inner_bias"], out=hidden[:, :HIDDEN])
        return inputs, hidden

    def _heads(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """The weights of both levels with the biases as last row, and whether a row's largest logit has to be taken off.

        A constant on all biases of a softmax changes none of its probabilities.  The one taken here puts the largest
        logit that hidden values within 1 can give at 0; where every row then has one above ``-DEPTH``, exp needs no more.
        """
        w, heads, wide = self.weights, [], False
        for k in ("outer", "member"):
            reach, bias = np.abs(w[k]).sum(axis=-2), w[f"{k}_bias"]
            high, low = (bias + reach).max(axis=-1, keepdims=True), (bias - reach).max(axis=-1, keepdims=True)
            wide |= not float((high - low).max()) < DEPTH
            heads.append(np.concatenate([w[k], (bias - high)[..., None, :]], axis=-2))
        return *heads, wide

    def _softmaxes(self, tokens: np.ndarray, hidden: np.ndarray, heads: tuple[np.ndarray, np.ndarray, bool]) -> Iterator[tuple]:
        """For either level and ``ROWS`` of the sorted ``tokens`` at a time: the level, the rows, their parts by softmax
        (its number, first row, end), their places in it, the logits there, the exponentials of all logits.

        The exponentials stand in one array that is used again, so that they stay in a core's cache.
        """
        outer, member, wide = heads
        lists, places = np.divmod(tokens, self.sizes.members)
        bounds = np.searchsorted(lists, np.arange(self.sizes.lists + 1))
        held = np.empty(ROWS * max(self.sizes.lists, self.sizes.members), hidden.dtype)
        for a in range(0, len(tokens), ROWS):
            b = min(a + ROWS, len(tokens))
            inside = [(k, max(bounds[k], a), min(bounds[k + 1], b)) for k in range(lists[a], lists[b - 1] + 1) if bounds[k] < bounds[k + 1]]
            for level, weights, parts, at in ((0, outer[None], [(0, a, b)], lists[a:b]), (1, member, inside, places[a:b])):
                every = held[: (b - a) * weights.shape[2]].reshape(b - a, -1)
                for k, c, d in parts:
                    np.matmul(hidden[c:d], weights[k], out=every[c - a : d - a])
                if wide:
                    every -= every.max(axis=1, keepdims=True)
                found = every[np.arange(b - a), at]
                yield level, slice(a, b), parts, at, found, np.exp(every, out=every)

    def log_probabilities(self, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Log-probability of each id given its context."""
        out, heads = np.empty(len(tokens)), self._heads()
        for at in range(0, len(tokens), SLICE):
            order = at + _order(tokens[at : at + SLICE])
            t = tokens[order]
            _, hidden = self._hidden(around.take(order, axis=0))
            found = np.zeros(len(t))
            for _, rows, _, _, logits, every in self._softmaxes(t, hidden, heads):
                found[rows] += logits - np.log(every @ np.ones(every.shape[1], every.dtype))
            out[order] = found
        return out

    def slopes(self, tokens: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss, by weight."""
        w, n, order = self.weights, len(tokens), _order(tokens)
        tokens, around = tokens[order], around.take(order, axis=0)
        inputs, hidden = self._hidden(around)
        heads = self._heads()
        weights, below = (heads[0][None], heads[1]), []
        for one in weights:  # the biases' row is not needed on the way back; ones there add up the exponentials
            below.append(one.transpose(0, 2, 1).copy())
            below[-1][:, :, -1] = 1
        sums, back = [np.zeros_like(one) for one in weights], np.zeros_like(hidden)
        for level, rows, parts, at, _, every in self._softmaxes(tokens, hidden, heads):
            turned = np.empty((len(every), HIDDEN + 1), every.dtype)
            for k, c, d in parts:
                np.matmul(every[c - rows.start : d - rows.start], below[level][k], out=turned[c - rows.start : d - rows.start])
            total = turned[:, -1].copy()
            every[np.arange(len(total)), at] -= total
            scale = (1 / (n * total))[:, None]
            scaled = hidden[rows] * scale
            for k, c, d in parts:
                part = slice(c - rows.start, d - rows.start)
                sums[level][k] += scaled[part].T @ every[part]
            turned *= scale
            back[rows] += turned
        hit = below[0][0].take(tokens // self.sizes.members, axis=0) + below[1].reshape(-1, HIDDEN + 1).take(tokens, axis=0)
        back -= hit / n
        out = {"outer": sums[0][0, :-1], "outer_bias": sums[0][0, -1], "member": sums[1][:, :-1], "member_bias": sums[1][:, -1]}
        hidden, back = hidden[:, :HIDDEN], back[:, :HIDDEN]
        back = back * (1 - hidden * hidden)
        out["inner"], out["inner_bias"] = inputs.T @ back, back.sum(0)
        cells, by_column = around.T.ravel().astype(np.intp), w["inner"].reshape(2 * SIDE, WIDTH, HIDDEN).swapaxes(0, 1).reshape(-1, HIDDEN)
        columns = [np.bincount(cells, one, self.sizes.ids) for one in (by_column @ back.T).reshape(WIDTH, -1)]
        out["embed"] = np.stack(columns, axis=1).astype(w["embed"].dtype)
        return out

    def step(self, tokens: np.ndarray, around: np.ndarray) -> None:
        """One step of Adagrad."""
        for k, slope in self.slopes(tokens, around).items():
            square = self.squares[k]
            move = slope * slope
            square += move
            np.divide(slope, np.sqrt(square, out=move), out=move)
            move *= RATE
            self.weights[k] -= move

    def flat(self, squares: bool) -> np.ndarray:
        """All weights, and with ``squares`` Adagrad's sums too, end to end."""
        held = (self.weights, self.squares) if squares else (self.weights,)
        return np.concatenate([part[k].ravel() for part in held for k in self.sizes.shapes]).astype(np.float32)

    @classmethod
    def from_flat(cls, sizes: Sizes, vector: np.ndarray) -> Network:
        parts, at = [], 0
        while at < len(vector):
            parts.append({})
            for k, s in sizes.shapes.items():
                size = int(np.prod(s))
                parts[-1][k] = vector[at : at + size].reshape(s).astype(np.float32)
                at += size
        return cls(sizes, *parts)


def contexts(ids: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of some documents: the token, its context (both sides, padded), the document's number."""
    gap = np.full(SIDE, pad, ids[0].dtype if ids else np.int64)
    line = np.concatenate([gap, *(part for one in ids for part in (one, gap))]) if ids else gap
    sizes = np.array([len(one) for one in ids], np.int64)
    owner = np.repeat(np.arange(len(ids)), sizes)
    at = np.arange(len(owner)) + SIDE * owner  # places less the gap at the start
    end = len(line) - 2 * SIDE
    sides = np.stack([line[k : k + end] for k in range(2 * SIDE + 1) if k != SIDE], axis=1) if len(owner) else np.empty((0, 2 * SIDE), line.dtype)
    return line[SIDE:].take(at), sides.take(at, axis=0), owner


class Trainer:
    """Trains on the tokens of a shard, each once, in an order that its number and the order of documents decide."""

    def __init__(self, network: Network, shard: int, batch: int):
        self.network, self.batch, self.used = network.copy(), batch, 0
        self.shuffle = np.random.default_rng(shard)
        self.texts: list[np.ndarray] = []  # documents without contexts yet
        self.tokens: list[np.ndarray] = []
        self.around: list[np.ndarray] = []
        self.waiting = self.held = 0
        keep_freed_memory()

    def add(self, ids: np.ndarray) -> None:
        self.texts.append(ids)
        self.waiting += len(ids)
        if self.held + self.waiting >= BLOCK:
            self._fill()

    def _fill(self) -> None:
        token, around, _ = contexts(self.texts, self.network.sizes.pad)
        self.texts, self.waiting = [], 0
        while len(token):
            room = BLOCK - self.held
            self.tokens.append(token[:room])
            self.around.append(around[:room])
            self.held += len(token[:room])
            token, around = token[room:], around[room:]
            if self.held == BLOCK:
                self._learn_block()

    def learn(self) -> None:
        """What is left at the end."""
        self._fill()
        if self.held:
            self._learn_block()

    def _learn_block(self) -> None:
        token, around = np.concatenate(self.tokens), np.concatenate(self.around)
        order = self.shuffle.permutation(self.held)
        for part in np.array_split(order, -(-self.held // self.batch)):
            self.network.step(token[part], around.take(part, axis=0))
        self.used += self.held
        self.tokens, self.around, self.held = [], [], 0


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: every lower-cased word of the whole corpus, counted with map-side combine and written once."""
    spaced = F.regexp_replace(F.lower("text"), OTHER_SPACES, " ")  # a split at one character needs no pattern
    words = docs.select(F.explode(F.split(spaced, " ")).alias("word")).filter("word <> ''")
    return materialise(words.groupBy("word").agg(F.count("*").alias("n")), "words")


def vocabulary(counted: DataFrame) -> list[str]:
    """Words with an id of their own by falling count, ties in code-point order."""
    top = counted.filter(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(MOST_WORDS)
    return [r.word for r in top.collect()]


def class_counts(counted: DataFrame, words: list[str]) -> dict[str, int]:
    """Counts of the most frequent words besides ``words``: of all that occur so often that no more than ``MOST_COUNTS`` do."""
    short, least, held = counted.filter(F.length("word") <= LONG_WORD), None, 0
    for n, size in sorted(short.groupBy(F.least("n", F.lit(LARGE_COUNT)).alias("n")).count().collect(), reverse=True):
        held += size
        if held > MOST_COUNTS:
            break
        least = n
    own = set(words)
    return {} if least is None else {r.word: r.n for r in short.filter(F.col("n") >= least).collect() if r.word not in own}


def token_table(docs: DataFrame, words: list[str], others: dict[str, int] | None = None) -> DataFrame:
    """``(row, ka, kb, doc_id, ids, known, rest)``: two bytes a token; of words without an id of their own the sum of the
    logs of counts in ``others``, and xxhash64 of every one that is not there."""
    sizes, more = Sizes(len(words)), others or {}
    index = {w.encode(): i for i, w in enumerate((*words, *more))}
    id_of = np.append(np.arange(len(words)), sizes.classes_of([w.encode() for w in more])).astype(np.uint16)
    log_of = np.append(np.zeros(len(words)), np.log(np.array(list(more.values()), float)))
    shared = docs.sparkSession.sparkContext.broadcast((index, np.append(id_of, np.uint16(0)), np.append(log_of, 0.0)))  # at -1: unknown
    rows = docs.select(*row_key(), "doc_id", F.lower("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (index, id_of, log_of), digest, row = shared.value, xxhash.xxh64_intdigest, TaskContext.get().partitionId() << 33
        get = index.get
        for batch in batches:
            ids, logs, rest = [], [], []
            for one in batch.column(3):
                found = (one.as_py() or b"").split()  # of bytes: at space and 0x09-0x0D only
                at = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
                own, new = id_of[at], np.flatnonzero(at < 0)
                unknown = [found[i] for i in new.tolist()]
                own[new] = sizes.classes_of(unknown)
                ids.append(own.tobytes())
                logs.append(log_of[at].sum())
                rest.append(np.fromiter(map(digest, unknown, repeat(42)), np.uint64, len(unknown)).view(np.int64))
            numbers = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rest]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rest) if rest else np.empty(0, np.int64)))
            columns = [numbers, *batch.columns[:3], pa.array(ids, pa.binary()), pa.array(logs, pa.float64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["row", "ka", "kb", "doc_id", "ids", "known", "rest"])

    return materialise(rows.mapInArrow(run, f"row bigint, ka bigint, kb bigint, doc_id {kind}, ids binary, known double, rest array<bigint>"), "ids")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint16) for v in column.to_pylist()]


def token_counts(tokens: DataFrame, sizes: Sizes) -> np.ndarray:
    """How often each id occurs in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(sizes.ids, np.int64)
        for batch in batches:
            for ids in _arrays(batch.column(0)):
                counts += np.bincount(ids, minlength=sizes.ids)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])

    counts = np.zeros(sizes.ids)
    for id_, n in tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[id_] = n
    return counts


def _trained(rows: DataFrame, network: Network, batch: int, squares: bool) -> Network | None:
    """Mean of the networks trained on each shard of ``rows`` (shard, ka, kb, ids) from ``network``; None without rows.
    Adagrad's sums come back with ``squares`` only, for a network that is trained on.

    Weights travel in ``PARTS`` slices; a slice is added up over shards in their order, so the sum is always the same.
    """
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, shard = None, None

        def result() -> pa.RecordBatch:
            trainer.learn()
            slices = [s.tobytes() for s in np.array_split(trainer.network.flat(squares), PARTS)]
            columns = [pa.array(np.arange(PARTS), pa.int32()), pa.array([shard] * PARTS, pa.int64()), pa.array([trainer.used] * PARTS, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(slices, pa.binary())], ["part", "shard", "n", "weights"])

        for b in batches:
            for number, ids in zip(b.column(0).to_pylist(), _arrays(b.column(1))):
                if number != shard:
                    if trainer is not None:
                        yield result()
                    trainer, shard = Trainer(shared.value, number, batch), number
                trainer.add(ids)
        if trainer is not None:
            yield result()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for part, n, raw in zip(*[c.to_pylist() for c in b.columns]):
                one = np.frombuffer(raw, np.float32).astype(np.float64)
                held = sums.setdefault(part, [0, np.zeros(len(one))])
                held[0] += n
                held[1] += n * one
        found = [(part, (total / n).tobytes()) for part, (n, total) in sums.items() if n]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.binary()))], ["part", "weights"])

    local = rows.sortWithinPartitions("shard", "ka", "kb").select("shard", "ids").mapInArrow(run, "part int, shard bigint, n bigint, weights binary")
    ordered = local.repartition(PARTS, "part").sortWithinPartitions("part", "shard").select("part", "n", "weights")
    slices = sorted(ordered.mapInArrow(mean, "part int, weights binary").collect())
    return Network.from_flat(network.sizes, np.concatenate([np.frombuffer(s.weights) for s in slices])) if slices else None


def train(tokens: DataFrame, sizes: Sizes, counts: np.ndarray, shard: int = SHARD) -> Network:
    """The network trained on every token of the corpus, each a target once.

    A document's shard, its order there and the shuffling come from hashes of the document and the shard's number, so
    the result does not depend on the layout of the table.  The first shard is trained by itself; all others start
    from its weights, in parallel, and are averaged.  The driver holds two sets of weights.
    """
    total = int(counts.sum())
    shards = max(1, total // shard)
    batch = min(BATCH, max(64, total // STEPS))
    rows = tokens.select(F.pmod("ka", F.lit(shards)).cast("bigint").alias("shard"), "ka", "kb", "ids").filter(F.length("ids") > 0)
    network = Network.start(sizes, counts)
    network = _trained(rows.filter("shard = 0").repartition(1), network, batch, shards > 1) or network
    if shards > 1:
        network = _trained(rows.filter("shard > 0").repartition(shards, "shard"), network, batch, False) or network
    return network


def score(tokens: DataFrame, network: Network, counts: np.ndarray | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob)`` of each row of a token table.

    With the ``counts`` of ids and the ``counted`` words, a word of a hash class has the probability of its class in its
    context times its share of the class in the corpus; else ids alone are scored.  Counts above 1 of such words come
    by a join on 64 bits of the word unless the table knows them, so no task holds them all.
    """
    shared = tokens.sparkSession.sparkContext.broadcast((network, None if counts is None else np.log(np.maximum(counts, 1.0))))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, logs = shared.value
        low, high = network.sizes.words, network.sizes.pad
        keep_freed_memory()
        for batch in batches:
            every = _arrays(batch.column(2))
            sums, a = np.zeros(len(every)), 0
            while a < len(every):  # whole documents, some 100,000 tokens at a time
                b, size = a, 0
                while b < len(every) and (b == a or size + len(every[b]) <= 100_000):
                    size += len(every[b])
                    b += 1
                token, around, owner = contexts(every[a:b], high)
                each = network.log_probabilities(token, around)
                if logs is not None:
                    each -= np.where((token >= low) & (token < high), logs[token], 0.0)
                sums[a:b] = np.bincount(owner, weights=each, minlength=b - a)
                a = b
            if logs is not None:
                sums += batch.column(3).to_numpy(zero_copy_only=False)
            sizes = pa.array([len(e) for e in every], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(sums)], ["row", "doc_id", "n_tokens", "log_prob"])

    scored = tokens.select("row", "doc_id", "ids", "known").mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, log_prob double")
    if counted is not None:
        often = counted.filter("n > 1").select(F.xxhash64("word").alias("word"), F.log("n").alias("more"))
        words = tokens.select("row", F.explode("rest").alias("word")).join(often, "word")
        more = words.groupBy(F.col("row").alias("_row")).agg(F.sum("more").alias("more"))
        scored = scored.join(more, scored["row"] == more["_row"], "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).otherwise(0.0)
    return scored.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def score_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob)``, one row per row of ``docs`` (doc_id, text).

    Words are runs of characters other than space and 0x09-0x0D, lower-cased.  The network is trained on ``docs``
    itself, on every token; words that occur ``LEAST_COUNT`` times get an id of their own, up to ``MOST_WORDS``, others
    share hash classes by their counts in the whole corpus.  ``log_prob`` sums every token's log-probability given
    both sides.  Null and empty texts have no tokens, sum 0 and mean 0; null ids are passed on; equal texts score
    equally; repeated rows stay repeated; other columns are not read; no rows give no rows; the layout of ``docs`` and
    the order of its rows change no score (beyond the rounding of sums).
    """
    counted = word_counts(docs)
    words = vocabulary(counted)
    tokens, sizes = token_table(docs, words, class_counts(counted, words)), Sizes(len(words))
    counts = token_counts(tokens, sizes)
    return score(tokens, train(tokens, sizes, counts), counts, counted)


@query("op7_masked_pseudo_likelihood")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
