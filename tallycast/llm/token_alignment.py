"""Alignment of two tokenizers' tokens: fragments of byte ranges compose, so very long documents are split over tasks."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallycast.llm.queries import query, table
from tallycast.llm.token_orc import SPELLING
from tallycast.session import materialise

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 1 << 15  # characters of a longer document that one fragment covers
FAN_IN = 8  # fragments that one step of the tree reduction composes
SLICE = 1 << 18  # characters of the texts that are encoded and aligned in one call
CACHED_UNITS, CACHED_LENGTH = 300_000, 40  # units of text, and their characters, that one Python worker keeps: some 90 MB
ID_BITS = 20  # of an id in a pair: vocabularies are below a million
WIDE = 256  # token pairs of a group from which equal ids are counted before they are paired
SMALL_PAIRS = 500_000  # rows (id pair, count), some 50 MB in memory, up to which they are broadcast
MARK = "▁"
HEX_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
NEVER = re.compile(r"(?!)")
BYTE_OF = {chr(SPELLING.get(b, b)): b for b in range(256)}

DONE = (
    "row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a array<int>, b array<int>, times array<bigint>"
)
CHUNKS = "seq int, chunk string, low bigint, high bigint"
FRAGMENT = (
    "row bigint, doc_id {kind}, seq int, valid boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, closed boolean, "
    "head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, groups string, a array<int>, b array<int>, times array<bigint>"
)


class Tokens:
    """Ids and end offsets (in bytes) of a stretch of text under both tokenizers, as arrays."""

    __slots__ = ("a", "ends_a", "b", "ends_b")

    def __init__(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray):
        self.a, self.ends_a, self.b, self.ends_b = a, ends_a, b, ends_b

    def groups(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the groups in which A and B tokens end, and how many groups are closed by a common end."""
        last = int(max(self.ends_a[-1] if len(self.ends_a) else 0, self.ends_b[-1] if len(self.ends_b) else 0))
        cuts_a, cuts_b = np.zeros(last + 1, bool), np.zeros(last + 1, bool)
        cuts_a[self.ends_a] = cuts_b[self.ends_b] = True
        common_a, common_b = cuts_b[self.ends_a], cuts_a[self.ends_b]
        return np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b, int(common_a.sum())


def spelt(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The ids of closed groups as strings in their order, each with the mark behind it: ``,`` or ``|`` or ``;``.

    ``names`` are the decimal ids with each of the three marks.
    """
    out = np.empty(len(a) + len(b), object)
    for ids, groups, place, mark in (
        (a, group_a, np.arange(len(a)) + np.searchsorted(group_b, group_a), 1), (b, group_b, np.arange(len(b)) + np.searchsorted(group_a, group_b, "right"), 2),
    ):
        last = np.concatenate((groups[1:] != groups[:-1], [True])) if len(groups) else np.empty(0, bool)
        out[place] = names[np.where(last, mark, 0), ids]
    return out


def linked(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, pair, times)`` of the id pairs of closed groups, where ``owner`` is that of each group.

    A wide group's ids are counted before they are paired, so that a group without common ends inside takes the
    memory of its different pairs.
    """
    every = np.arange(len(owner) + 1)
    bounds_a, bounds_b = np.searchsorted(group_a, every), np.searchsorted(group_b, every)
    n_a, n_b = np.diff(bounds_a), np.diff(bounds_b)
    wide = n_a * n_b >= WIDE
    keys, times = [], []
    for g in np.flatnonzero(wide):
        ids_a, often_a = np.unique(a[bounds_a[g] : bounds_a[g + 1]], return_counts=True)
        ids_b, often_b = np.unique(b[bounds_b[g] : bounds_b[g + 1]], return_counts=True)
        pairs = (ids_a[:, None] << ID_BITS | ids_b).ravel()
        keys.append(owner[g] << 2 * ID_BITS | pairs)
        times.append((often_a[:, None] * often_b).ravel())
    plain = ~wide[group_a]
    of = group_a[plain]
    repeats = n_b[of]
    at = np.repeat(bounds_b[of], repeats) + np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    keys.append(np.repeat(owner[of] << 2 * ID_BITS | a[plain] << ID_BITS, repeats) | b[at])
    if len(keys) == 1:
        key = np.sort(keys[0])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(key)))
    else:
        key, often = np.concatenate(keys), np.concatenate([*times, np.ones(len(keys[-1]), np.int64)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.add.reduceat(often[order], first)
    found = key[first]
    return found >> 2 * ID_BITS, found & ((1 << 2 * ID_BITS) - 1), count


class Fragment:
    """What a byte range tells of the groups: an open prefix (``head``), closed groups, an open suffix (``tail``).

    A token belongs to the range in which it ends.  Without a common end (``closed`` is false) all tokens are in the
    tail.  ``append`` is associative and a new fragment is its identity: the left tail and the right head become
    a group, whatever the ranges are.
    """

    __slots__ = ("valid", "n_a", "n_b", "n_groups", "n_links", "closed", "head", "tail", "groups", "links")

    def __init__(self, closed: bool = False):
        self.valid, self.closed = True, closed
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.head, self.tail = ([], []), ([], [])
        self.groups: list[str] = []
        self.links: dict[int, int] = {}

    def _group(self, names: np.ndarray) -> None:
        """The tail becomes a closed group, or the head if nothing is closed yet."""
        a, b = (np.array(side, np.int64) for side in self.tail)
        if self.closed:
            self._closed(a, np.zeros(len(a), np.int64), b, np.zeros(len(b), np.int64), 1, names)
        else:
            self.head, self.closed = self.tail, True
        self.tail = ([], [])

    def _closed(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int, names: np.ndarray) -> None:
        self.n_groups += groups
        self.n_links += int((np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups)).sum())
        self.groups.append("".join(spelt(a, group_a, b, group_b, names))[:-1])
        _, pairs, times = linked(a, group_a, b, group_b, np.zeros(groups, np.int64))
        for pair, more in zip(pairs.tolist(), times.tolist()):
            self.links[pair] = self.links.get(pair, 0) + more

    def _push(self, a: list[int], b: list[int]) -> None:
        self.tail[0].extend(a)
        self.tail[1].extend(b)

    def tokens(self, t: Tokens, low: int, high: int, names: np.ndarray) -> None:
        """The tokens of ``t`` that end after ``low`` and not after ``high``."""
        in_a, in_b = (low < t.ends_a) & (t.ends_a <= high), (low < t.ends_b) & (t.ends_b <= high)
        t = Tokens(t.a[in_a], t.ends_a[in_a], t.b[in_b], t.ends_b[in_b])
        group_a, group_b, groups = t.groups()
        self.n_a, self.n_b = self.n_a + len(t.a), self.n_b + len(t.b)
        first = 0
        if groups and (not self.closed or self.tail[0] or self.tail[1]):  # the first group joins what is open
            self._push(t.a[group_a == 0].tolist(), t.b[group_b == 0].tolist())
            self._group(names)
            first = 1
        inner_a, inner_b = (group_a >= first) & (group_a < groups), (group_b >= first) & (group_b < groups)
        if groups > first:
            self._closed(t.a[inner_a], group_a[inner_a] - first, t.b[inner_b], group_b[inner_b] - first, groups - first, names)
        self._push(t.a[group_a >= groups].tolist(), t.b[group_b >= groups].tolist())

    def append(self, other: Fragment, names: np.ndarray) -> None:
        self.valid &= other.valid
        self.n_a, self.n_b = self.n_a + other.n_a, self.n_b + other.n_b
        if other.closed:
            if other.head[0] or other.head[1]:
                self._push(*other.head)
                self._group(names)
            self.n_groups, self.n_links = self.n_groups + other.n_groups, self.n_links + other.n_links
            self.groups.extend(other.groups)
            for pair, more in other.links.items():
                self.links[pair] = self.links.get(pair, 0) + more
        self._push(*other.tail)

    def finish(self, names: np.ndarray) -> Fragment:
        """The whole document's: its beginning and its end are cuts, so its head is a group."""
        whole = Fragment(closed=True)
        if self.valid:
            whole.append(self, names)
        whole.valid = self.valid
        return whole


def bytes_of_entry(entry: str) -> bytes:
    """What an entry of a byte-level vocabulary stands for."""
    try:
        return bytes(BYTE_OF[c] for c in entry)
    except KeyError:  # an added token
        return entry.encode()


def bytes_of_piece(piece: str) -> bytes:
    found = HEX_BYTE.fullmatch(piece)
    return bytes([int(found[1], 16)]) if found else piece.replace(MARK, " ").encode()


def names_of(ids: int) -> np.ndarray:
    """Decimal ids with a comma, a bar and a semicolon behind them."""
    return np.array([[f"{k}{mark}" for k in range(ids)] for mark in ",|;"], object)


class Aligner:
    """Both tokenizers, and the cuts that none of their tokens crosses: before a space or newline between two others.

    A byte-level tokenizer starts a pre-token there; a piece tokenizer has no piece with a mark or newline behind
    another character, which is looked up in its vocabulary (else texts are one unit each and long ones encoded by
    one task).  What stands between two cuts is encoded once and kept in a bounded cache.
    """

    def __init__(self, byte_level: str, pieces: str):
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes_a[k] = bytes_of_entry(entry)
        found = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes_of_piece(p) for p in found]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError("a vocabulary has ids beyond ID_BITS")
        self.sizes_a, self.sizes_b = (np.array(list(map(len, side)), np.int64) for side in (self.bytes_a, self.bytes_b))
        self.names = names_of(max(len(self.bytes_a), len(self.bytes_b)))
        with open(byte_level, encoding="utf-8") as f:
            config = json.load(f)
        kind = config["pre_tokenizer"] or {}
        level = config["normalizer"] is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        spaced = not any(MARK in p.lstrip(MARK) for p in found)
        self.lead = self.b.piece_to_id(MARK)
        lines = not any("\n" in p for p in found) and self.b.encode("\na")[:1] == [self.lead]
        self.leads = (" \n" if lines else " ") if level and spaced else ""
        self.boundary = re.compile(rf"(?<=\S)(?=[{self.leads}]\S)") if self.leads else NEVER
        self.cache: dict[str, tuple[bytes, ...]] = {}

    def encode(self, stretches: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """A and B ids of stretches that begin with a space, which the piece tokenizer adds itself, or with a newline.

        None if the tokens of either side do not give the bytes of the stretch.
        """
        rest = [s if s[0] == "\n" else s[1:] for s in stretches]
        out: list[tuple[list[int], list[int]] | None] = []
        for s, one, b in zip(stretches, self.a.encode_batch_fast(stretches, add_special_tokens=False), self.b.encode(rest, num_threads=1)):
            a, raw = one.ids, s.encode()
            if s[0] == "\n":  # the space before it is not in the text
                b = b[1:]
            same = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            out.append((a, b) if same else None)
        return out

    def tokens(self, a: np.ndarray, b: np.ndarray) -> Tokens:
        """Of stretches that follow each other."""
        return Tokens(a, np.cumsum(self.sizes_a[a]), b, np.cumsum(self.sizes_b[b]))

    def plain(self, key: str) -> bool:
        """Whether a key has no white space at its ends but the newline it may start with."""
        first = key[1:2] if key[:1] == "\n" and "\n" in self.leads else key[:1]
        return first != "" and not first.isspace() and not key[-1].isspace()

    def split(self, text: str, new: set[str]) -> list[str]:
        """Keys of the units between cuts of a text with a space before it: a unit without that space, or from its newline on.

        Those that the cache does not hold are added to ``new``.
        """
        if self.leads:
            keys = (text.replace("\n", " \n") if "\n" in self.leads else text).split(" ")
            unknown = [k for k in set(keys) if k not in self.cache]
            if keys[0][:1] != "\n" and all(map(self.plain, unknown)):  # cached keys are plain
                new.update(unknown)
                return keys
        whole = self.boundary.split(" " + text)
        keys = [u[1:] if u[0] == " " and u[1:] and not u[1].isspace() else u for u in whole]
        new.update(k for k in keys if k not in self.cache)
        return keys

    def laid_out(self, stretches: list[str]) -> list[tuple[bytes, bytes]] | None:
        """A and B ids, as 32-bit integers, of stretches between cuts, encoded as one text; None if it does not give its bytes back."""
        stretches = [" x", *stretches]
        text = "".join(stretches)
        raw, upto = text.encode(), np.cumsum([len(s.encode()) for s in stretches])
        out = []
        for ids, table, sizes in (
            (self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.bytes_a, self.sizes_a), (self.b.encode(text[1:]), self.bytes_b, self.sizes_b),
        ):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            numbers = np.array(ids, "<i4")
            ends = np.cumsum(sizes[numbers])
            at = np.searchsorted(ends, upto)
            if (ends[at] != upto).any():  # a token across a cut
                return None
            whole, bounds = numbers.tobytes(), (4 * (at + 1)).tolist()
            out.append([whole[i:j] for i, j in zip(bounds, bounds[1:])])
        return list(zip(*out))

    def units(self, new: set[str]) -> dict[str, tuple[bytes, ...]]:
        """Encode new units into the cache; returns A and B ids, as 32-bit integers, of those that it does not take.

        No ids stand for a unit whose tokens do not give its bytes, which is never cached.  Frequent units come early
        and are kept.
        """
        found, odd, beyond = {}, list(new), {}
        if self.leads:
            plain = [k for k in new if self.plain(k)]
            ids = self.laid_out([k if k[0] == "\n" else " " + k for k in plain]) if plain else []
            if ids is not None:
                found, odd = dict(zip(plain, ids)), [k for k in new if not self.plain(k)]
        for k, ids in zip(odd, self.encode([k if k[0] in " \n" else " " + k for k in odd]) if odd else ()):
            raw = () if ids is None else (array("i", ids[0]).tobytes(), array("i", ids[1]).tobytes())
            (found if raw and self.leads and self.plain(k) else beyond)[k] = raw
        for k, raw in found.items():
            (self.cache if len(self.cache) < CACHED_UNITS and len(k) <= CACHED_LENGTH else beyond)[k] = raw
        return beyond

    def ids(self, keys: list[str], beyond: dict[str, tuple[bytes, ...]]) -> tuple[bytes, bytes] | None:
        """All A and all B ids of a text's units; None with a unit that has none."""
        found = list(map(self.cache.get, keys))
        if None in found:
            found = [beyond[u] if f is None else f for u, f in zip(keys, found)]
            if () in found:
                return None
        a, b = zip(*found)
        return b"".join(a), b"".join(b)

    def documents(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of whole texts: numbers by name (zeros if a unit's tokens do not give its bytes), digests of the groups, and ``(place, pair, times)`` of the linked id pairs.

        Texts are laid end to end, which is a common end, and aligned in one go.
        """
        new: set[str] = set()
        split = [self.split(t, new) if t else [] for t in texts]
        beyond, kept = self.units(new), []
        for k, keys in enumerate(split):
            found = self.ids(keys, beyond) if keys else None
            if found is not None:
                kept.append((k, *found))
        places = np.array([k for k, _, _ in kept], np.int64)
        t = self.tokens(*(np.frombuffer(b"".join([e[side] for e in kept]), "<i4").astype(np.int64) for side in (1, 2)))
        numbers = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        numbers["n_a"][places] = size_a = np.array([len(e[1]) // 4 for e in kept], np.int64)
        numbers["n_b"][places] = size_b = np.array([len(e[2]) // 4 for e in kept], np.int64)
        digests = [""] * len(texts)
        if not kept:
            return numbers, digests, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        group_a, group_b, groups = t.groups()
        owner = np.empty(groups, np.int64)
        owner[group_a] = np.repeat(places, size_a)
        numbers["n_groups"] = np.bincount(owner, minlength=len(texts))
        links = np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups)
        numbers["n_links"] = np.bincount(owner, links, len(texts)).astype(np.int64)
        strings, at = spelt(t.a, group_a, t.b, group_b, self.names), 0
        for k, size in zip(places.tolist(), (size_a + size_b).tolist()):
            digests[k] = sha256("".join(strings[at : at + size])[:-1].encode()).hexdigest()
            at += size
        return numbers, digests, linked(t.a, group_a, t.b, group_b, owner)

    def fragment(self, stretch: str, low: int, high: int) -> Fragment:
        """The fragment of the bytes ``low`` to ``high`` of a stretch that starts and ends at cuts."""
        out, new = Fragment(), set()
        keys = self.split(stretch[1:], new) if stretch[0] == " " else None
        found = self.ids(keys, self.units(new)) if keys else None
        if found is None and keys is None:  # it starts with a newline
            (lists,) = self.encode([stretch])
            found = lists and tuple(np.array(side, "<i4").tobytes() for side in lists)
        if found is None:
            out.valid = False
        else:
            out.tokens(self.tokens(*(np.frombuffer(side, "<i4").astype(np.int64) for side in found)), low, high, self.names)
        return out

    def chunks(self, text: str) -> list[tuple[str, int, int]] | None:
        """``(stretch, low, high)`` of the ranges of a long text; a range lies in a stretch between two cuts.

        Ranges end every ``CHUNK`` characters, in the middle of words and tokens; where no cut is near, at the cut
        before, so that no stretch is encoded by many tasks.  None where one range holds all.
        """
        if len(text) <= CHUNK or not self.leads:
            return None
        full = " " + text
        cuts = np.array([0, *(m.start() for m in self.boundary.finditer(full)), len(full)])
        bounds = [0]
        for b in range(CHUNK, len(full), CHUNK):
            left = int(cuts[np.searchsorted(cuts, b, "right") - 1])
            right = int(cuts[np.searchsorted(cuts, b, "left")])
            b = left if right - left > CHUNK else b
            if b > bounds[-1]:
                bounds.append(b)
        bounds.append(len(full))
        out = []
        for b, e in zip(bounds, bounds[1:]):
            left, right = int(cuts[np.searchsorted(cuts, b, "right") - 1]), int(cuts[np.searchsorted(cuts, e, "left")])
            low = len(full[left:b].encode())
            out.append((full[left:right], low, low + len(full[b:e].encode())))
        return out if len(out) > 1 else None


@lru_cache(maxsize=1)
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One pair of tokenizers of a Python worker, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
    return Aligner(byte_level, pieces)


def _links(fragments: list[Fragment]) -> list[pa.Array]:
    """Columns a, b, times of the fragments' id pairs."""
    sizes = [len(f.links) for f in fragments]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    pairs = np.fromiter((p for f in fragments for p in f.links), np.int64, sum(sizes))
    times = np.fromiter((t for f in fragments for t in f.links.values()), np.int64, sum(sizes))
    columns = ((pairs >> ID_BITS).astype(np.int32), (pairs & ((1 << ID_BITS) - 1)).astype(np.int32), times)
    return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


def _done_columns(align: Aligner, rows: list[int], ids: pa.Array, texts: list[str | None]) -> list[pa.Array]:
    """Finished columns of whole texts."""
    numbers, digests, (places, pairs, times) = align.documents(texts)
    offsets = pa.array(np.searchsorted(places, np.arange(len(texts) + 1)).astype(np.int32))
    sides = ((pairs >> ID_BITS).astype(np.int32), (pairs & ((1 << ID_BITS) - 1)).astype(np.int32), times)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in sides]
    return [pa.array(rows, pa.int64()), ids, *map(pa.array, numbers.values()), pa.array(digests, pa.string()), *lists]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, size in enumerate(sizes):
        held += size
        if held >= SLICE:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


DONE_NAMES = [c.split()[0] for c in DONE.split(", ")]
FRAGMENT_NAMES = [c.split()[0] for c in FRAGMENT.split(", ")]


def _read(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Finished rows of ordinary documents, and rows with ``chunk`` for the ranges of long ones; one written table."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, row = aligner(*files), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, whole, ids = batch.column(1).to_pylist(), [], batch.column(0)
            for k, text in enumerate(texts):
                chunks = align.chunks(text) if text else None
                if chunks is None:
                    whole.append(k)
                    continue
                for seq, (stretch, low, high) in enumerate(chunks):
                    nothing = [pa.nulls(1, t) for t in [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())]]
                    values = [pa.array([v], t) for v, t in ((seq, pa.int32()), (stretch, pa.string()), (low, pa.int64()), (high, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([row + k]), ids.slice(k, 1), *nothing, *values], names)
            for start, end in _slices([len(texts[k] or "") for k in whole]):
                chosen = whole[start:end]
                done = _done_columns(align, [row + k for k in chosen], ids.take(pa.array(chosen)), [texts[k] for k in chosen])
                nothing = [pa.nulls(len(chosen), t) for t in (pa.int32(), pa.string(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*done, *nothing], names)
            row += len(texts)

    names = [*DONE_NAMES, "seq", "chunk", "low", "high"]
    return materialise(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"{DONE.format(kind=kind)}, {CHUNKS}"), "aligned")


def _fragment_batch(rows: list[tuple[int, object, int]], kind: pa.DataType, fragments: list[Fragment]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    plain = [(c, t) for c, t in zip(FRAGMENT_NAMES[3:9], (pa.bool_(), *[pa.int64()] * 4, pa.bool_()))]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), kind, pa.int32()))]
    columns += [pa.array([getattr(f, c) for f in fragments], t) for c, t in plain]
    columns += [pa.array([getattr(f, end)[side] for f in fragments], ints) for end in ("head", "tail") for side in (0, 1)]
    columns += [pa.array([";".join(f.groups) for f in fragments], pa.string()), *_links(fragments)]
    return pa.RecordBatch.from_arrays(columns, FRAGMENT_NAMES)


def _fragments_of(batch: pa.RecordBatch) -> Iterator[tuple[int, object, int, Fragment]]:
    for k in range(batch.num_rows):
        v = {c: batch.column(c)[k].as_py() for c in FRAGMENT_NAMES}
        f = Fragment(v["closed"])
        for c in ("valid", "n_a", "n_b", "n_groups", "n_links"):
            setattr(f, c, v[c])
        f.head, f.tail = (v["head_a"], v["head_b"]), (v["tail_a"], v["tail_b"])
        f.groups = [v["groups"]] if v["groups"] else []
        f.links = {a << ID_BITS | b: t for a, b, t in zip(v["a"], v["b"], v["times"])}
        yield v["row"], v["doc_id"], v["seq"], f


def _long_documents(chunks: DataFrame, files: tuple[str, str], kind: str) -> DataFrame:
    """Finished rows of long documents: fragments encoded by chunk, then composed ``FAN_IN`` at a time."""
    schema = FRAGMENT.format(kind=kind)
    width = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(*files)
        for batch in batches:
            for row, doc_id, seq, chunk, low, high in zip(*[c.to_pylist() for c in batch.columns]):
                yield _fragment_batch([(row, doc_id, seq)], batch.schema.field(1).type, [align.fragment(chunk, low, high)])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, held, kind = aligner(*files).names, None, None, None
        for batch in batches:
            kind = batch.schema.field(1).type
            for row, doc_id, seq, f in _fragments_of(batch):
                if key is None or key[::2] != (row, seq // FAN_IN):
                    if key is not None:
                        yield _fragment_batch([key], kind, [held])
                    key, held = (row, doc_id, seq // FAN_IN), Fragment()
                held.append(f, names)
        if key is not None:
            yield _fragment_batch([key], kind, [held])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = aligner(*files).names
        for batch in batches:
            for row, doc_id, _, f in _fragments_of(batch):
                whole = f.finish(names)
                if not whole.valid:
                    whole = Fragment()
                numbers = [pa.array([getattr(whole, c)], pa.int64()) for c in DONE_NAMES[2:6]]
                digest = sha256(";".join(whole.groups).encode()).hexdigest() if f.valid else ""
                columns = [pa.array([row]), pa.array([doc_id], batch.schema.field(1).type), *numbers, pa.array([digest]), *_links([whole])]
                yield pa.RecordBatch.from_arrays(columns, DONE_NAMES)

    parts = chunks.select("row", "doc_id", "seq", "chunk", "low", "high").repartition(width, "row", "seq")
    level = materialise(parts.mapInArrow(encode, schema), "fragments")
    last = level.agg(F.max("seq")).first()[0] or 0
    while last:
        near = level.withColumn("_group", F.floor(F.col("seq") / FAN_IN)).repartition("row", "_group").sortWithinPartitions("row", "seq").drop("_group")
        level, last = materialise(near.mapInArrow(compose, schema), "fragments"), last // FAN_IN
    return level.mapInArrow(finish, DONE.format(kind=kind))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast rows of three numbers if they are counted to be few; else the join decides."""
    return F.broadcast(df) if df.limit(SMALL_PAIRS + 1).count() <= SMALL_PAIRS else df


def alignments(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """The written table ``(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, times)``, one row per row of
    ``docs`` (doc_id, text): numbers of tokens, groups and links, and each linked id pair with its number of links.

    ``row`` tells rows of equal id apart.  Texts up to ``CHUNK`` characters are aligned where they are read.  Longer
    ones become byte ranges, spread over tasks by hash; their fragments are composed in a tree, ``FAN_IN`` to one, so
    a task holds one composed fragment and a batch.
    """
    files = (byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES))
    first = _read(docs, files)
    kind = docs.schema["doc_id"].dataType.simpleString()
    long = _long_documents(first.filter("chunk IS NOT NULL"), files, kind)
    return materialise(first.filter("chunk IS NULL").select(*DONE_NAMES).unionByName(long.select(*DONE_NAMES)), "alignments")


def link_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, a, documents, best)``: how many rows of ``aligned`` hold the id pair, and whether no pair of ``a`` has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("documents"))
    pairs = materialise(pairs, "pairs")
    top = pairs.groupBy(F.col("a").alias("_a")).agg(F.max("documents").alias("_top"))
    pair = F.shiftleft(F.col("a").cast("bigint"), 32).bitwiseOR(F.col("b").cast("bigint"))
    return pairs.join(_small(top), pairs["a"] == top["_a"]).select(pair.alias("pair"), "a", "documents", (F.col("documents") == F.col("_top")).alias("best"))


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs`` (doc_id, text).

    A is a byte-level tokenizer of the text with a space before it, B a piece tokenizer that adds the space itself;
    strings of special tokens in texts are plain text.  A group ends where tokens of both end; all A-B pairs of token
    occurrences in a group are links.  ``n_best`` counts links whose id pair stands in as many documents as any
    pair of its A id, ``count_sum`` adds up those numbers over links.  Null and empty texts, and texts of which the
    tokens of either side do not give the bytes back, have zeros and an empty string.  Repeated rows are documents
    each, null ids are passed on, other columns are not read, no rows give no rows.

    Pairs found in one document only are not joined: their count is 1, and they are best if no pair of their A
    id has more.  The table of the others is broadcast if it is counted to be small and shuffled if not.
    """
    aligned = alignments(docs, byte_level, pieces)
    counted = materialise(link_counts(aligned), "counts")
    often = counted.filter("documents > 1")
    busy = often.select("a").distinct().select(F.col("a").alias("_busy"))  # A ids with a count above 1: at most the vocabulary
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = aligned.select(*keys, F.explode_outer(F.arrays_zip("a", "b", "times")).alias("l")).select(
        *keys, F.col("l.a").alias("_a"), "l.times", F.shiftleft(F.col("l.a").cast("bigint"), 32).bitwiseOR(F.col("l.b").cast("bigint")).alias("_pair")
    )
    joined = links.join(_small(often.select("pair", "documents", "best")), F.col("_pair") == F.col("pair"), "left").join(
        _small(busy), F.col("_a") == F.col("_busy"), "left"
    )
    best = F.coalesce("best", F.col("_busy").isNull())
    return joined.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(best, F.col("times"))), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum(F.col("times") * F.coalesce("documents", F.lit(1))), F.lit(0)).alias("count_sum"),
    ).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
