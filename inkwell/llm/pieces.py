"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Below the lowest score: what a character without a piece of its own costs.
UNKNOWN_GAP = 10.0
#: Bytes of text encoded at a time, and of a unit that is encoded with others of its length.
STEP_BYTES, ALIGNED_BYTES = 8 << 20, 48
#: Units remembered from one step to the next; with more, all are forgotten.
MEMO_UNITS = 300_000


class Memo:
    """Units already encoded: their numbers, and the ids of all in one array."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, coded: list[np.ndarray]) -> None:
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, *coded])


class Vocabulary:
    """Pieces with log scores as a double-array trie over bytes; the white-space marker is the byte 0x20 in it.

    table[i] are the bytes that piece i decodes to. A marker character that stands in a text itself is no piece,
    so it goes by bytes and comes back as it was.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: (piece, log score, kind) in the order of ids; kind is normal, byte or control."""
        self.table, self.byte_ids, words = [], np.zeros(256, np.int32), {}
        for i, (piece, score, kind) in enumerate(pieces):
            raw = b""
            if kind == "byte":
                raw = bytes([int(piece[1:-1], 16)])
                self.byte_ids[raw[0]] = i
            elif kind == "normal" and piece:
                raw = piece.replace(MARK, " ").encode()
                words.setdefault(raw, i)
            self.table.append(raw)
        self.scores = np.array([s for _, s, _ in pieces])
        self.unknown = min(self.scores[list(words.values())]) - UNKNOWN_GAP
        self.longest = max(map(len, words))
        # Words may be encoded on their own if no piece goes on past a word's end, and lines too.
        inner = any(re.search(rb"[^ ] ", w) for w in words)
        lines = rb"\n" if not any(b"\n" in w for w in words) else rb""
        self.unit = re.compile(rb"(?s).+" if inner else rb"\n| *[^ \n]+| +" if lines else rb" *[^ ]+| +")
        self._build(words)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """From a SentencePiece model file. Scores that are negated merge ranks become log(1 / (rank + 1)), by Zipf's law."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = np.array([m.get_score(i) for i in range(m.get_piece_size())])
        if (scores == np.floor(scores)).all():
            scores = -np.log1p(-scores)
        kind = lambda i: "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
        return cls([(m.id_to_piece(i), float(scores[i]), kind(i)) for i in range(len(scores))])

    def _build(self, words: dict[bytes, int]) -> None:
        """base, check and value: from state s, byte c leads to base[s] + c + 1 if check there is s; value is the piece that ends."""
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for w, i in words.items():
            node = 0
            for c in w:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = i
        size = 4 * len(children) + 66_000
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        used = np.frombuffer(taken, np.uint8)
        taken[0] = 1
        single, low, todo = 1, 1, [(0, 0)]
        while todo:
            node, state = todo.pop()
            value[state] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:  # any free cell will do
                single = max(single, codes[0] + 1) if single <= 256 else single
                while taken[single]:
                    single += 1
                at = single - codes[0] - 1
            else:  # the next place where all fit; full stretches are left behind for single children
                steps, at = np.array(codes) + 1, -1
                while at < 0:
                    cells = max(low, int(steps[0]))
                    cells = cells + np.flatnonzero(used[cells : cells + 1024] == 0)
                    fits = cells[(used[cells[:, None] + (steps - steps[0])] == 0).all(axis=1)]
                    if len(fits):
                        at = int(fits[0] - steps[0])
                    else:
                        low += 512
            base[state] = at
            for c in codes:
                check[at + c + 1], taken[at + c + 1] = state, 1
                todo.append((children[node][c], at + c + 1))
        end = int(np.flatnonzero(used)[-1]) + 258
        self.base, self.check, self.value = base[:end].copy(), check[:end].copy(), value[:end].copy()

    def viterbi(self, unit: bytes) -> list[int]:
        """The ids of the best path over one unit; the earlier start wins a tie."""
        base, check, value, scores = self.base, self.check, self.value, self.scores
        n = len(unit)
        best, back = [-np.inf] * (n + 1), [(-1, -1)] * (n + 1)
        best[0] = 0.0
        p = 0
        while p < n:
            c = unit[p]
            width = 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            state, single = 0, False
            for k in range(p, n):
                nxt = int(base[state]) + unit[k] + 1
                if check[nxt] != state:
                    break
                state = nxt
                piece = int(value[state])
                if piece >= 0:
                    single |= k + 1 == p + width
                    score = best[p] + scores[piece]
                    if score > best[k + 1]:
                        best[k + 1], back[k + 1] = score, (p, piece)
            if not single and best[p] + self.unknown > best[p + width]:
                best[p + width], back[p + width] = best[p] + self.unknown, (p, -1)
            p += width
        out: list[int] = []
        while n:
            p, piece = back[n]
            out += [piece] if piece >= 0 else [int(self.byte_ids[c]) for c in reversed(unit[p:n])]
            n = p
        return out[::-1]

    def viterbi_aligned(self, units: np.ndarray) -> list[np.ndarray]:
        """viterbi() for many units of one length at once: a row of bytes each."""
        n, length = units.shape
        codes = units.astype(np.int64) + 1
        width = np.select([units < 0xC0, units < 0xE0, units < 0xF0], [1, 2, 3], 4)
        best = np.full((length + 1, n), -np.inf)
        start, piece = np.full((length + 1, n), -1, np.int32), np.full((length + 1, n), -1, np.int32)
        best[0] = 0
        for p in range(length):
            alive = np.flatnonzero(best[p] > -np.inf)
            rows, state, single = alive, np.zeros(len(alive), np.int64), np.zeros(n, bool)
            for k in range(p, min(length, p + self.longest)):
                nxt = self.base[state] + codes[rows, k]
                on = self.check[nxt] == state
                rows, state = rows[on], nxt[on]
                if not len(rows):
                    break
                found = self.value[state]
                has = found >= 0
                r, f = rows[has], found[has]
                single[r] |= k + 1 == p + width[r, p]
                score = best[p, r] + self.scores[f]
                up = score > best[k + 1, r]
                r, f = r[up], f[up]
                best[k + 1, r], start[k + 1, r], piece[k + 1, r] = score[up], p, f
            r = alive[~single[alive]]
            if len(r):
                to = p + width[r, p]
                up = best[p, r] + self.unknown > best[to, r]
                r, to = r[up], to[up]
                best[to, r], start[to, r], piece[to, r] = best[p, r] + self.unknown, p, -1
        # Walk back all rows together; a piece that is unknown stands for its bytes.
        ids, rows, at = np.full((n, length), -1, np.int32), np.arange(n), np.full(n, length)
        while len(rows):
            p, f = start[at, rows], piece[at, rows]
            known = f >= 0
            ids[rows[known], p[known]] = f[known]
            for r, a, b in zip(rows[~known].tolist(), p[~known].tolist(), at[~known].tolist()):
                ids[r, a:b] = self.byte_ids[units[r, a:b]]
            at, more = p.astype(np.int64), p > 0
            rows, at = rows[more], at[more]
        held = ids >= 0
        flat, ends = ids[held], np.cumsum(held.sum(axis=1)).tolist()
        return [flat[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def encode_units(self, units: list[bytes]) -> list[np.ndarray]:
        """The ids of each unit: those of one length together, long or rare lengths one by one."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        coded: list = [None] * len(units)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size).tolist()
            if size > ALIGNED_BYTES or len(at) < 8:
                for k in at:
                    coded[k] = np.array(self.viterbi(units[k]), np.int32)
            else:
                for lo in range(0, len(at), 1 << 14):
                    some = at[lo : lo + (1 << 14)]
                    for k, ids in zip(some, self.viterbi_aligned(np.frombuffer(b"".join([units[k] for k in some]), np.uint8).reshape(len(some), size))):
                        coded[k] = ids
        return coded

    def encode_batch(self, texts: list[bytes], memo: Memo | None = None) -> list[np.ndarray]:
        """The ids of each UTF-8 text; a blank is put before a text that isn't empty. Each distinct unit is encoded once."""
        memo = Memo() if memo is None else memo
        if len(memo.known) > MEMO_UNITS:
            memo.__init__()
        before, known = len(memo.known), memo.known
        rows = [np.array([known.setdefault(u, len(known)) for u in self.unit.findall(b" " + t)], np.int64) if t else np.empty(0, np.int64) for t in texts]
        memo.add(self.encode_units(list(islice(known, before, None))))
        out = []
        for row in rows:
            n = memo.lengths[row]
            ends = np.cumsum(n)
            take = np.repeat(memo.starts[row] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            out.append(memo.flat[take])
        return out

    def decode(self, ids) -> bytes:
        """The UTF-8 text of ids, without the blank that encoding put first."""
        raw = b"".join([self.table[i] for i in ids])
        return raw[1:] if raw[:1] == b" " else raw


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids, n_ids, n_bytes, round_trip) of every row: ids of the pieces, how many, how many of them bytes, and whether decoding gives the text back.

    Whole texts are encoded, a few MB at a time. A null text has null ids and round_trip, 0 otherwise; an empty
    one has no ids. Repeated rows are rows of their own; an empty table gives an empty one; extra columns are
    not read. The vocabulary is broadcast: its size is that of the model file, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        vocab, memo = shared.value, Memo()
        is_byte = np.zeros(len(vocab.table), bool)
        is_byte[vocab.byte_ids] = True

        def coded(ids, texts):
            found = vocab.encode_batch([t or b"" for t in texts], memo)
            back = [None if t is None else vocab.decode(f.tolist()) == t for t, f in zip(texts, found)]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)), mask=pa.array([t is None for t in texts]))
            n_bytes = [int(is_byte[f].sum()) for f in found]
            return pa.RecordBatch.from_arrays([ids, lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(n_bytes, pa.int64()), pa.array(back, pa.bool_())], names=["id", "ids", "n_ids", "n_bytes", "round_trip"])

        for batch in batches:
            lo, texts, size = 0, [], 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if size >= STEP_BYTES or k + 1 == batch.num_rows:
                    yield coded(batch.column(0).slice(lo, len(texts)), texts)
                    lo, texts, size = k + 1, [], 0

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, ids array<int>, n_ids long, n_bytes long, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) of every row of ids; null ids give a null text, and bytes that aren't UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        vocab = shared.value
        for batch in batches:
            texts = [None if ids is None else vocab.decode(ids).decode("utf-8", "replace") for ids in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes, round_trip of every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
