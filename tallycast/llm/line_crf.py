"""Quality rules with a line model: a linear-chain conditional random field marks lines as content or boilerplate."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallycast.llm.quality import labelled_sample
from tallycast.llm.queries import query, table

FIT_DOCS = 2_500  # labelled documents the line model is fitted on at most, the least by a hash of their id
LEAST_WORDS = 50
REPEAT_PERCENT = 50
CONTENT_SHARE = 0.5  # of a document's words that must stand in lines marked as content
STEPS = 150
ROUNDS = 3
RIDGE = 1e-3
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
RATIOS = (0.0, 0.02, 0.08, 0.2, 0.5)  # upper ends of the bins of a ratio
WORDS = (1, 4, 14, 60)
LENGTHS = (2.5, 4.0, 6.0, 9.0)
GROUPS = (6, 6, 6, 6, 6, 6, 5, 5, 2, 2, 3)
OFFSETS = np.concatenate(([0], np.cumsum(GROUPS)[:-1]))
WIDTH = int(sum(GROUPS))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice in the text, the first occurrence included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1_000_000:  # beyond, three ids do not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(seen) + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)``; null has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            duplicates += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def line_codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each line with a word: the bin of every feature group, and the number of words."""
    codes, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        upper = sum(map(str.isupper, words))
        ratios = (
            sum(map(line.count, SYMBOLS)) / chars,
            upper / n,
            line.count("!") / chars,
            words.count("|") / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            1.0 - len(set(words)) / n,
        )
        ending = 0 if line.rstrip()[-1] in ".!?:;…。！？" else 1
        codes.append([
            *(bisect_right(RATIOS, r) if r else 0 for r in ratios), bisect_right(WORDS, n), bisect_right(LENGTHS, chars / n),
            ending, int(line in seen), 0 if not codes else 1,
        ])
        sizes.append(n)
        seen.add(line)
    if codes:
        codes[-1][-1] = 2 if len(codes) > 1 else 0
    return np.array(codes, np.int64).reshape(len(codes), len(GROUPS)), np.array(sizes, np.int64)


@dataclass(frozen=True)
class Chain:
    """Scores of a line's label (0 boilerplate, 1 content) by feature, of a pair of neighbours, of the first and last."""

    lines: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return self.lines[:, OFFSETS + codes].sum(axis=2).T if len(codes) else np.empty((0, 2))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The most probable labels of a document's lines; of equals, content."""
        scores = self.emissions(codes)
        if not len(scores):
            return np.empty(0, np.int64)
        (stay0, to1), (to0, stay1) = self.pairs.tolist()
        rows = scores.tolist()
        a, b = rows[0][0] + self.first[0], rows[0][1] + self.first[1]
        back = []
        for e0, e1 in rows[1:]:
            from0, from1 = a + stay0 <= b + to0, a + to1 <= b + stay1
            back.append((from0, from1))
            a, b = (b + to0 if from0 else a + stay0) + e0, (b + stay1 if from1 else a + to1) + e1
        label = int(b + self.last[1] >= a + self.last[0])
        labels = [label]
        for choice in reversed(back):
            label = int(choice[label])
            labels.append(label)
        return np.array(labels[::-1], np.int64)

    def content_share(self, text: str | None) -> float:
        """Share of words in lines marked as content; 0 of a text without words."""
        codes, sizes = line_codes(text)
        return float((self.decode(codes) * sizes).sum() / sizes.sum()) if len(sizes) else 0.0


EMPTY = Chain(np.zeros((2, WIDTH)), np.zeros((2, 2)), np.zeros(2), np.array([0.0, 1.0]))  # every line is content


def fit_chain(docs: list[np.ndarray], labels: list[np.ndarray]) -> Chain:
    """Maximum likelihood with a ridge, by forward-backward over all documents at once and Adam steps."""
    order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: -len(docs[i]))
    if not order:
        return EMPTY
    sizes = np.array([len(docs[i]) for i in order])
    longest, count = int(sizes[0]), len(order)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    active = [int((sizes > t).sum()) for t in range(longest)]  # documents with a line t are the first ones
    codes = np.concatenate([docs[i] for i in order]) + OFFSETS
    gold = np.concatenate([labels[i] for i in order])
    at = [starts[: active[t]] + t for t in range(longest)]
    shape = {"lines": (2, WIDTH), "pairs": (2, 2), "first": (2,), "last": (2,)}
    theta = {k: np.zeros(v) for k, v in shape.items()}
    seen = {k: np.zeros(v) for k, v in shape.items()}
    one_hot = np.eye(2)[gold]
    for y in (0, 1):
        seen["lines"][y] = np.bincount(codes[gold == y].ravel(), minlength=WIDTH)
    seen["first"], seen["last"] = one_hot[starts].sum(0), one_hot[starts + sizes - 1].sum(0)
    for t in range(1, longest):
        seen["pairs"] += one_hot[at[t] - 1].T @ one_hot[at[t]]
    moment, square = ({k: np.zeros(v) for k, v in shape.items()} for _ in range(2))

    for step in range(1, STEPS + 1):
        emit = theta["lines"][:, codes].sum(axis=2).T
        pair = theta["pairs"]
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[at[0]] = emit[at[0]] + theta["first"]
        for t in range(1, longest):
            before = forward[at[t] - 1]
            forward[at[t]] = emit[at[t]] + np.logaddexp(before[:, :1] + pair[0], before[:, 1:] + pair[1])
        ends = starts + sizes - 1
        backward[ends] = theta["last"]
        for t in range(longest - 1, 0, -1):
            after = emit[at[t]] + backward[at[t]]
            backward[at[t] - 1] = np.logaddexp(after[:, :1] + pair[:, 0], after[:, 1:] + pair[:, 1])
        norm = np.logaddexp(*(forward[ends] + theta["last"]).T)
        total = np.repeat(norm, sizes)
        margin = np.exp(forward + backward - total[:, None])
        expected = {"lines": np.zeros((2, WIDTH)), "pairs": np.zeros((2, 2)), "first": margin[starts].sum(0), "last": margin[ends].sum(0)}
        for y in (0, 1):
            expected["lines"][y] = np.bincount(codes.ravel(), weights=np.repeat(margin[:, y], len(GROUPS)), minlength=WIDTH)
        inner = np.setdiff1d(np.arange(len(gold)), starts)
        for x in (0, 1):
            for y in (0, 1):
                expected["pairs"][x, y] = np.exp(forward[inner - 1, x] + pair[x, y] + emit[inner, y] + backward[inner, y] - total[inner]).sum()
        for k in theta:
            slope = (seen[k] - expected[k]) / count - RIDGE * theta[k]
            moment[k] = 0.9 * moment[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope * slope
            theta[k] += 0.1 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Chain(**theta)


def fit_weak(docs: list[np.ndarray], good: np.ndarray) -> Chain:
    """Line labels from document labels: lines of good documents are content, those of bad ones boilerplate at first;
    then bad documents' lines are marked again by the model, so that ordinary lines among them count as content."""
    if len(set(good.tolist())) < 2:
        return EMPTY
    labels = [np.full(len(d), int(g)) for d, g in zip(docs, good)]
    chain = fit_chain(docs, labels)
    for _ in range(ROUNDS - 1):
        labels = [l if g else chain.decode(d) for d, g, l in zip(docs, good, labels)]
        chain = fit_chain(docs, labels)
    return chain


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", docs_at_most: int = FIT_DOCS) -> Chain:
    """Fit on a bounded hash sample of labelled documents; the bins of their lines, not texts, come to the driver."""
    rows = labelled_sample(docs, labels, label, docs_at_most)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([line_codes(t.as_py())[0].astype(np.uint8).tobytes() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "label", "codes"])

    sample = rows.mapInArrow(run, f"doc_id {kind}, label int, codes binary").toArrow().sort_by("doc_id")
    codes = [np.frombuffer(c, np.uint8).astype(np.int64).reshape(-1, len(GROUPS)) for c in sample["codes"].to_pylist()]
    return fit_weak(codes, sample["label"].to_numpy() if sample.num_rows else np.empty(0))


def apply_rules(docs: DataFrame, chain: Chain, share: float = CONTENT_SHARE) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)``.

    One row per row of ``docs`` (doc_id, text), without a shuffle.  A text fails the base rules with fewer than 50 words
    or with over half of its words in repeated 3-word windows; of the others, those are kept whose share of words in
    content lines reaches ``share``.  Null and empty texts have no words and fail; null ids are passed on; repeated
    rows stay repeated; other columns are not read; no rows give no rows.
    """
    chosen = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            counts, failed, shares = [], [], []
            for one in batch.column(1):
                text = one.as_py()
                counts.append(base_counts(text))
                failed.append(base_failed(counts[-1][0], counts[-1][4]))
                shares.append(model.content_share(text))
            table_ = np.array(counts, np.int64).reshape(len(counts), 5)
            kept = [not f and s >= share for f, s in zip(failed, shares)]
            columns = [batch.column(0), *(pa.array(table_[:, k]) for k in range(5)), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept", "content_share"])

    longs = ", ".join(f"{n} bigint" for n in names)
    return chosen.mapInArrow(run, f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, content_share double")


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
