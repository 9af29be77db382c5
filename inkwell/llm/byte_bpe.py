"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A coded text is an element of a monoid: two neighbours are joined by encoding a window around their border anew, and
the window grows until what stands outside of it provably stays. That holds for the matches of the splitting pattern
(long texts are cut into segments) and for the tokens of one match (its bytes are halved).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Memo

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of a match that are merged at once; longer ones are halved.
LEAF_BYTES = 32
#: Characters of a text that are split at once; longer texts are segments joined by a tree.
SEGMENT = 1 << 16
#: Bytes of text coded at a time, and distinct matches remembered from one step to the next.
STEP_BYTES, MEMO_UNITS = 8 << 20, 300_000
#: Stands for the rank of a pair that is no token.
NO_RANK = 1 << 40
#: Characters that decide whether a match goes on as a contraction: an apostrophe and two letters.
CONTRACTION = 3


class Numbers(dict):
    """The number of each key, in the order in which keys are first asked for."""

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        return number


class Matches(Memo):
    """Matches already coded: their numbers, and the ids of all in one array."""

    def __init__(self):
        super().__init__()
        self.known = Numbers()


class Ranks:
    """A vocabulary of byte strings with merge ranks, which are the ids, and the pattern that splits a text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.table = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.table[rank] = raw
        self.single = np.array([ranks[bytes([c])] for c in range(256)], np.int64)
        splits = [(ranks[raw[:k]], ranks[raw[k:]], rank) for raw, rank in ranks.items() for k in range(1, len(raw)) if raw[:k] in ranks and raw[k:] in ranks]
        keys = np.array([a << 32 | b for a, b, _ in splits], np.int64)
        order = np.argsort(keys)
        self.pairs, self.merges = keys[order], np.array([r for _, _, r in splits], np.int64)[order]
        self._compile()

    def _compile(self) -> None:
        import regex

        self.find = regex.compile(self.pattern).findall

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "find"}

    def __setstate__(self, state) -> None:
        self.__dict__ |= state
        self._compile()

    @classmethod
    def load(cls, path: str | None = None, pattern: str | None = None) -> Ranks:
        """From lines of base64 and rank; the public 50k vocabulary and its pattern where nothing is given."""
        import public_tokenizers

        with open(path or public_tokenizers.path(RANKS), "rb") as lines:
            ranks = {base64.b64decode(raw): int(rank) for raw, rank in map(bytes.split, lines)}
        return cls(ranks, pattern or public_tokenizers.PATTERN)

    def merged(self, raw: bytes) -> list[int]:
        """The ids of raw by merging the pair of least rank, the leftmost of equal ones, until none is left."""
        ranks, n = self.ranks, len(raw)
        if n == 0:
            return []
        if n <= LEAF_BYTES:
            parts = [raw[k : k + 1] for k in range(n)]
            pairs = [ranks.get(raw[k : k + 2]) for k in range(n - 1)]
            while found := [r for r in pairs if r is not None]:
                k = pairs.index(min(found))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del pairs[k]
                if k:
                    pairs[k - 1] = ranks.get(parts[k - 1] + parts[k])
                if k < len(pairs):
                    pairs[k] = ranks.get(parts[k] + parts[k + 1])
            return [ranks[p] for p in parts]
        # Many bytes: a heap of pairs over a list of parts, [start, end) with the starts of the neighbours.
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(raw[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            nxt = after[k]
            if end[k] == 0 or nxt >= n or end[nxt] != stop:
                continue  # one of the two has been merged since
            end[k], after[k], end[nxt] = stop, after[nxt], 0
            if after[k] < n:
                before[after[k]] = k
                if (r := ranks.get(raw[k : end[after[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
            if (p := before[k]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[raw[k : end[k]]] for k in range(n) if end[k]]

    def merged_aligned(self, rows: np.ndarray) -> list[np.ndarray]:
        """merged() for many byte strings of one length at once: a row of bytes each. A round merges one pair of every row that has one."""
        ids, numbers = self.single[rows], np.arange(len(rows))
        ranks = self._rank_of(ids[:, :-1], ids[:, 1:])
        coded: list = [None] * len(rows)
        while len(ids):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            best = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), NO_RANK)
            for k, row in zip(numbers[best == NO_RANK].tolist(), ids[best == NO_RANK].astype(np.int32)):
                coded[k] = row
            more = best < NO_RANK
            ids, ranks, numbers, at, best = ids[more], ranks[more], numbers[more], at[more], best[more]
            r = np.arange(len(ids))
            ids[r, at] = best
            places = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, places + (places > at[:, None]), axis=1)
            places = places[:-1]
            ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), axis=1)
            for shift in (-1, 0):
                some = np.flatnonzero((at + shift >= 0) & (at + shift < len(places)))
                k = at[some] + shift
                ranks[some, k] = self._rank_of(ids[some, k], ids[some, k + 1])
        return coded

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of tokens a and b, NO_RANK where there is none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.merges[at], NO_RANK)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two coded byte strings put together.

        The bytes of a window of tokens around the border are merged anew. A sequence in which every token codes
        itself and every two neighbours code themselves is the code of the whole: the first merge over a border
        between two tokens would also happen where these two stand alone. So the rest stays as soon as the pairs
        at both edges of the window do; until then the window grows on the side that fails.
        """
        table, a, b = self.table, 1, 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            inner = self.merged(b"".join([table[i] for i in [*left[len(left) - a :], *right[:b]]]))
            holds_left = a == len(left) or self.merged(table[left[-a - 1]] + table[inner[0]]) == [left[-a - 1], inner[0]]
            holds_right = b == len(right) or self.merged(table[inner[-1]] + table[right[b]]) == [inner[-1], right[b]]
            if holds_left and holds_right:
                return [*left[: len(left) - a], *inner, *right[b:]]
            a, b = a if holds_left else 2 * a, b if holds_right else 2 * b

    def encode_matches(self, found: list[bytes]) -> list[np.ndarray]:
        """encode_match() of each: those of one length together, long or rare lengths one by one."""
        coded: list = [None] * len(found)
        by_size: dict[int, list[int]] = {}
        for k, raw in enumerate(found):
            if (whole := self.ranks.get(raw)) is not None:
                coded[k] = np.array([whole], np.int32)
            else:
                by_size.setdefault(len(raw), []).append(k)
        for size, at in by_size.items():
            if size > LEAF_BYTES or len(at) < 8:
                for k in at:
                    coded[k] = np.array(self.encode_match(found[k]), np.int32)
            else:
                for k, ids in zip(at, self.merged_aligned(np.frombuffer(b"".join([found[k] for k in at]), np.uint8).reshape(len(at), size))):
                    coded[k] = ids
        return coded

    def encode_match(self, raw: bytes) -> list[int]:
        """The ids of one match: as a whole if it is a token, else by halves."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        if len(raw) <= LEAF_BYTES:
            return self.merged(raw)
        level = [self.merged(raw[k : k + LEAF_BYTES]) for k in range(0, len(raw), LEAF_BYTES)]
        return reduced(level, self.join)

    def joined_matches(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two texts put together, from those of each.

        Of the left text, a match stays if it ends before the text does and its contraction could be seen; those
        after it are split anew with a window of the right one. Splitting goes on the same way from any place where
        a match begins, so the rest of the right text stays from the first place on where matches of both begin.
        """
        if not left or not right:
            return left or right
        a, seen = 0, 0
        while a < len(left) and (a == 0 or seen < CONTRACTION):
            a += 1
            seen += len(left[-a])
        stays, b = left[: len(left) - a], 4
        tail = "".join(left[len(left) - a :])
        while True:
            window = tail + "".join(right[:b])
            ends, at, whole = {}, len(tail), b >= len(right)
            for k, piece in enumerate(right[:b]):
                at += len(piece)
                ends[at] = k + 1
            new, at = self.find(window), 0
            if whole:
                return stays + new
            for k, piece in enumerate(new):
                start, at = at, at + len(piece)
                if at == len(window) or start + CONTRACTION > len(window):
                    break  # what follows the window may change this match
                if at in ends:
                    return stays + new[: k + 1] + right[ends[at] :]
            b *= 2

    def matches(self, text: str) -> list[str]:
        """The matches of the pattern in text; those of a long text by segments."""
        if len(text) <= SEGMENT:
            return self.find(text)
        return reduced([self.find(text[k : k + SEGMENT]) for k in range(0, len(text), SEGMENT)], self.joined_matches)

    def encode_batch(self, texts: list[str], memo: Matches | None = None) -> list[np.ndarray]:
        """The ids of each text; each distinct match is coded once."""
        memo = Matches() if memo is None else memo
        if len(memo.known) > MEMO_UNITS:
            memo.__init__()
        before, known, out = len(memo.known), memo.known, []
        rows = [np.fromiter(map(known.__getitem__, found), np.int64, len(found)) for found in map(self.matches, texts)]
        memo.add(self.encode_matches([m.encode() for m in islice(known, before, None)]))
        for row in rows:
            n = memo.lengths[row]
            ends = np.cumsum(n)
            out.append(memo.flat[np.repeat(memo.starts[row] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, put together up the tree."""
        table = self.table
        if len(ids) <= SEGMENT:
            return b"".join([table[i] for i in ids])
        return reduced([b"".join([table[i] for i in ids[k : k + SEGMENT]]) for k in range(0, len(ids), SEGMENT)], lambda a, b: a + b)


def reduced(level: list, join):
    """The elements of level joined two by two, neighbours first, until one is left."""
    while len(level) > 1:
        level = [join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def steps(sizes: list[int], most: int = STEP_BYTES):
    """(from, to) of stretches of rows that hold about `most` bytes each."""
    lo = held = 0
    for k, size in enumerate(sizes):
        held += size
        if held >= most or k + 1 == len(sizes):
            yield lo, k + 1
            lo, held = k + 1, 0


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids, n_tokens, digest) of every row: the ids of the whole text, how many, and the SHA-256 of them as little-endian unsigned 32-bit integers.

    No special tokens are known: their strings are ordinary text. A null text is coded as the empty one, which has
    no ids. Very long texts are coded by segments joined in a tree. Repeated rows are rows of their own, rows
    without id keep none, an empty table gives an empty one, extra columns are not read. The ranks are broadcast:
    their size is that of the vocabulary file, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Ranks.load(path, pattern))

    def run(batches):
        vocab, memo = shared.value, Matches()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in steps([len(t) for t in texts]):
                found = vocab.encode_batch(texts[lo:hi], memo)
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                digests = [hashlib.sha256(f.astype("<u4").tobytes()).digest() for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(digests, pa.binary())], names=["id", "ids", "n_tokens", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "id long, ids array<int>, n_tokens long, digest binary")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with its ids replaced by `decoded`, the bytes that they stand for; other columns stay.

    Null ids give null bytes and no ids give none. Bytes need not be UTF-8 where ids do not come from a text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Ranks.load(path))
    others = [c for c in encoded.columns if c != ids_col]

    def run(batches):
        vocab = shared.value
        for batch in batches:
            ids, rest = batch.column(len(others)), batch.columns[: len(others)]
            sizes = [4 * (n or 0) for n in ids.value_lengths().to_pylist()]
            for lo, hi in steps(sizes):
                raw = [None if x is None else vocab.decode(x) for x in ids.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), pa.array(raw, pa.binary())], names=[*others, "decoded"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*others).schema]
    return encoded.select(*others, ids_col).mapInArrow(run, ", ".join([*kinds, "decoded binary"]))


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", F.lower(F.hex("digest")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
