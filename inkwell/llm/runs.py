"""Periodic runs of words by bit-parallel lags: bit planes of word ids as one big integer, shifted, compared and folded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import steps

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Lags below this are all tried; longer ones where a block of the text comes again at that lag.
SHORT_LAGS = 64
#: An odd factor of the rolling hash of blocks, and its inverse, modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Planes:
    """The words of a text as bit planes, one behind the other in a big integer."""

    def __init__(self, ids: np.ndarray):
        self.n = n = len(ids)
        self.count = max(1, int(ids.max()).bit_length())
        bits = (ids[None] >> np.arange(self.count)[:, None]) & 1
        self.all = int.from_bytes(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(), "little")
        self.folds, k = [], self.count
        while k > 1:
            half = (k + 1) // 2
            self.folds.append(half * n)
            k = half

    def stretches(self, lag: int, least: int) -> list[tuple[int, int]]:
        """(first, end) of each longest stretch of at least `least` places whose word is the one `lag` places later."""
        places = self.n - lag
        if places < least:
            return []
        differs = self.all ^ (self.all >> lag)
        for shift in self.folds:  # a place differs if any of its planes does
            differs |= differs >> shift
        full = (1 << places) - 1
        same = (differs & full) ^ full
        width = 1  # bit k stands for `width` equal places from k on
        while same and 2 * width <= least:
            same &= same >> width
            width *= 2
        if same and width < least:
            same &= same >> (least - width)
        if not same:
            return []
        first = self._places(same & ~(same << 1))
        last = self._places(same & ~(same >> 1))
        return list(zip(first, (last + least).tolist())) if len(first) else []

    def _places(self, bits: int) -> np.ndarray:
        raw = np.frombuffer(bits.to_bytes(self.n // 8 + 1, "little"), np.uint8)
        at = np.flatnonzero(raw)
        k, bit = np.nonzero(np.unpackbits(raw[at][:, None], axis=1, bitorder="little"))
        return at[k] * 8 + bit


def recurring_lags(ids: np.ndarray, found: dict[tuple[int, int], int], width: int) -> list[int]:
    """The lags from width to below 2 * width at which a run not yet found may be.

    Such a run has 3 * width equal places in a row, so two neighbouring blocks of `width` words, at multiples of it,
    come again at the lag. Hashes of all windows tell these places; equal words have equal hashes, so none is
    missed. Blocks whose words and their copies lie in a run found before are left out where the lag is a multiple
    of its period: the stretch is then that run itself.
    """
    n = len(ids)
    with np.errstate(over="ignore"):
        powers = np.full(n, FACTOR, np.uint64).cumprod(dtype=np.uint64)
        back = np.full(n, INVERSE, np.uint64).cumprod(dtype=np.uint64)
        words = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        words ^= words >> np.uint64(32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
        window = (sums[width:] - sums[:-width]) * back[: n - width + 1]
    rows = len(window) // width
    table = window[: rows * width].reshape(rows, width)
    block, step = np.nonzero(table[1:] == table[:-1, :1])
    rest = window[rows * width :]
    if rows and len(rest):
        more = np.flatnonzero(rest == table[-1, 0])
        block, step = np.concatenate([block, np.full(len(more), rows - 1)]), np.concatenate([step, more])
    place = block * width + step
    twice = np.isin(place + width, place, assume_unique=True)
    at, lag = block[twice] * width, step[twice] + width
    known = np.zeros(len(at), bool)
    for (start, end), period in found.items():
        if end - start >= 3 * width:
            lo, hi = np.searchsorted(at, [start, end])
            known[lo:hi] |= (at[lo:hi] + lag[lo:hi] + 2 * width <= end) & (lag[lo:hi] % period == 0)
    return np.unique(lag[~known]).tolist()


def periodic_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start, then period.

    A run is a stretch with that smallest period, of at least LEAST_WORDS words and LEAST_PERIODS periods, which no
    neighbouring word extends. Lags are tried upwards; a stretch that a smaller lag has given already has that
    smaller period, and one whose smallest period is smaller is given by that lag: it holds both periods, so also
    their greatest common divisor.
    """
    n = len(words)
    if n < LEAST_WORDS:
        return []
    numbers: dict = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    planes, found = Planes(ids), {}

    def test(lag: int) -> None:
        for start, end in planes.stretches(lag, max(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)):
            found.setdefault((int(start), int(end) + lag), lag)

    for lag in range(1, min(SHORT_LAGS - 1, n // LEAST_PERIODS) + 1):
        test(lag)
    width = SHORT_LAGS
    while width * LEAST_PERIODS <= n:
        for lag in recurring_lags(ids, found, width):
            test(lag)
        width *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, exactly; of ties that of the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by blanks: of a run, only its first period stays."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, best, collapsed) of every row: all periodic runs of its words, the strongest, and the text without repeats.

    Words are what ASCII white space parts; a null text has none, as an empty one. runs are structs (start, length,
    period) in word numbers from 0, by start, then period; best is null where there are none. Very long texts are
    searched whole. Repeated rows are rows of their own, ids may be null, an empty table gives an empty one, extra
    columns are not read.
    """
    kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in steps([len(t) for t in texts]):
                words = [t.split() for t in texts[lo:hi]]
                runs = [periodic_runs(w) for w in words]
                flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
                best = [None if (b := strongest(found)) is None else dict(zip(("start", "length", "period"), b)) for found in runs]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(kind)))
                kept = pa.array([collapsed(w, found).decode() for w, found in zip(words, runs)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(w) for w in words], pa.int64()), lists, pa.array(best, kind), kept], names=["id", "n_words", "runs", "best", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    part = "struct<start: long, length: long, period: long>"
    return rows.mapInArrow(run, f"id long, n_words long, runs array<{part}>, best {part}, collapsed string")


def with_planted_loops(doc_id: Column, text: Column, words: Column) -> Column:
    """The text of op12: in one of ten documents, by a hash of the id, the words from some place on repeat from there with some period."""
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words).cast("long")
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    loop = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    turned = F.slice(F.flatten(F.array_repeat(loop, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), turned), " ")).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the strongest run, and hashes of all runs and of the collapsed text, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    docs = docs.withColumn("words", F.when(chosen, F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0))))
    found = find_runs(docs.select("doc_id", with_planted_loops(F.col("doc_id"), F.col("text"), F.col("words")).alias("text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
