"""Secret scans: patterns of known kinds, and a character convolutional network over every candidate in its context."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base kinds, in their order.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs: shorter ones would only be dropped
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: What the network judges: every run of these characters that is long enough and holds a digit, and shorter or
#: digitless ones that a credential's name stands before.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
NAMED = re.compile(r"""(?:key|auth|bearer|credentials?|pwd|pass|passphrase|pin|signature|cookie|session)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.ASCII | re.IGNORECASE)
_NAMES = ("key", "auth", "bearer", "credential", "pwd", "pass", "pin", "signature", "cookie", "session")
LEAST_RUN = 16
_DIGIT = re.compile("[0-9]")
#: Characters of a window before what it judges, of that, and after it; a longer candidate is judged by windows
#: over its whole length that begin STRIDE apart, and is as likely a secret as the likeliest of them.
BEFORE, WITHIN, AFTER, STRIDE = 20, 44, 8, 22
WIDTH, FILTERS, EMBEDDING, HIDDEN = 5, 24, 10, 16
#: Labelled findings made for training and for calibration, and the recall that the threshold must keep there.
TRAIN_ROWS, CALIBRATION_ROWS, RECALL, SEED = 4000, 2000, 0.97, 9
_SPAN = BEFORE + WITHIN + AFTER
_BATCH = 2048


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base find: leftmost, non-overlapping within a kind, in code points."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """(start, end) of what the network is to judge: the parts of runs that no base span overlaps, in order.

    Parts count if they are long enough and hold a digit; a run after a credential's name counts whole, if no
    base span overlaps it, from 8 characters on and with or without digits.
    """
    runs, out, at = [m.span() for m in CANDIDATE.finditer(text)], [], 0
    for a, b in runs:
        while at < len(spans) and spans[at][2] <= a and (at + 1 == len(spans) or spans[at + 1][0] <= a):
            at += 1
        k, lo = at, a
        while k < len(spans) and spans[k][0] < b:
            out.append((lo, min(spans[k][0], b)))
            lo = max(lo, spans[k][2])
            k += 1
        out.append((lo, b))
    found = {(a, b) for a, b in out if b - a >= LEAST_RUN and _DIGIT.search(text, a, b)}
    low = text.lower()
    if any(name in low for name in _NAMES):
        named = [m.span(1) for m in NAMED.finditer(text)]
        found |= set(_free(named, spans))
    return sorted(found)


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """The windows of a candidate, which cover it whole."""
    if b - a <= WITHIN:
        return [(a, b)]
    return [(lo, lo + WITHIN) for lo in (*range(a, b - WITHIN, STRIDE), b - WITHIN)]


def _codes() -> np.ndarray:
    """Character to class: digits, letters by case and letter, the marks of tokens, blanks, and the rest; 0 is padding."""
    table = np.full(256, 4, np.uint8)
    table[[9, 10, 13, 32]] = 1
    table[[ord(c) for c in "\"'`"]] = 2
    table[[ord(c) for c in ":,;()[]{}<>"]] = 3
    for k, group in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/_.=-")):
        for j, c in enumerate(group):
            table[ord(c)] = (5, 15, 41, 67)[k] + j
    return table


_CODES = _codes()
CLASSES = 73


def encode_windows(found: list[tuple[str, int, int]]) -> np.ndarray:
    """A row of character classes for each (text, start, end): context, then a window's characters, then context, padded."""
    out = np.zeros((len(found), _SPAN), np.uint8)
    for row, (text, a, b) in zip(out, found):
        for at, piece, right in ((0, text[max(0, a - BEFORE) : a], True), (BEFORE, text[a : min(b, a + WITHIN)], False), (BEFORE + WITHIN, text[b : b + AFTER], False)):
            if piece:
                codes = _CODES[np.minimum(np.frombuffer(piece.encode("utf-32-le"), np.uint32), 255)]
                lo = at + (BEFORE - len(piece) if right else 0)
                row[lo : lo + len(codes)] = codes
    return out


class Network:
    """Embedding, one convolution, maxima over the candidate and over its context, and two dense layers."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.standard_normal(shape) * np.sqrt(2 / shape[0])
        self.p = {"e": rng.standard_normal((CLASSES, EMBEDDING)) * 0.5, "c": scale(WIDTH * EMBEDDING, FILTERS), "cb": np.zeros(FILTERS), "h": scale(3 * FILTERS, HIDDEN), "hb": np.zeros(HIDDEN), "o": scale(HIDDEN, 1), "ob": np.zeros(1)}
        self.calibration = (1.0, 0.0)

    def forward(self, x: np.ndarray):
        p, n = self.p, len(x)
        patches = np.lib.stride_tricks.sliding_window_view(p["e"][x], WIDTH, axis=1)  # n, places, embedding, width
        cols = patches.transpose(0, 1, 3, 2).reshape(n, -1, WIDTH * EMBEDDING)
        conv = np.maximum(cols @ p["c"] + p["cb"], 0)
        lo, hi = BEFORE - WIDTH // 2, BEFORE + WITHIN - WIDTH // 2
        inside = conv[:, lo:hi]
        at = [inside.argmax(axis=1) + lo, conv[:, :lo].argmax(axis=1)]
        tops = [np.take_along_axis(conv, a[:, None, :], axis=1)[:, 0] for a in at]
        size = np.maximum((x[:, BEFORE : BEFORE + WITHIN] > 0).sum(axis=1), 1)
        mask = (x[:, BEFORE : BEFORE + WITHIN] > 0)[:, :, None]
        mean = (inside * mask).sum(axis=1) / size[:, None]
        f = np.concatenate([*tops, mean], axis=1)
        h = np.maximum(f @ p["h"] + p["hb"], 0)
        return (h @ p["o"] + p["ob"])[:, 0], (cols, conv, at, mask, size, f, h, lo, hi)

    def gradients(self, x: np.ndarray, y: np.ndarray):
        p = self.p
        z, (cols, conv, at, mask, size, f, h, lo, hi) = self.forward(x)
        n = len(x)
        dz = ((1 / (1 + np.exp(-z))) - y)[:, None] / n
        g = {"o": h.T @ dz, "ob": dz.sum(axis=0)}
        dh = dz @ p["o"].T * (h > 0)
        g |= {"h": f.T @ dh, "hb": dh.sum(axis=0)}
        df = dh @ p["h"].T
        dconv = np.zeros_like(conv)
        rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None]
        for k, a in enumerate(at):
            np.add.at(dconv, (rows, a, filters), df[:, k * FILTERS : (k + 1) * FILTERS])
        dconv[:, lo:hi] += (df[:, 2 * FILTERS :] / size[:, None])[:, None] * mask
        dconv *= conv > 0
        flat = dconv.reshape(-1, FILTERS)
        g |= {"c": cols.reshape(-1, WIDTH * EMBEDDING).T @ flat, "cb": flat.sum(axis=0)}
        dcols = (flat @ p["c"].T).reshape(n, -1, WIDTH, EMBEDDING)
        demb = np.zeros((n, x.shape[1], EMBEDDING))
        for w in range(WIDTH):
            demb[:, w : w + dcols.shape[1]] += dcols[:, :, w]
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], x.reshape(-1), demb.reshape(-1, EMBEDDING))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.004, batch: int = 128, seed: int = SEED) -> None:
        rng, m, v, t = np.random.default_rng(seed), {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                some = order[lo : lo + batch]
                t += 1
                for k, g in self.gradients(x[some], y[some]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling of the outputs on rows that were not trained on."""
        z, (a, b) = np.concatenate([self.forward(x[k : k + _BATCH])[0] for k in range(0, len(x), _BATCH)]), (1.0, 0.0)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = q * (1 - q) + 1e-9
            hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hessian, np.array([((y - q) * z).sum() - 1e-3 * a, (y - q).sum() - 1e-3 * b]))
            a, b = a + step[0], b + step[1]
        self.calibration = (float(a), float(b))

    def chance(self, x: np.ndarray) -> np.ndarray:
        """The calibrated chance that each window's candidate is a secret."""
        if not len(x):
            return np.empty(0)
        z = np.concatenate([self.forward(x[k : k + _BATCH])[0] for k in range(0, len(x), _BATCH)])
        return 1 / (1 + np.exp(-np.clip(self.calibration[0] * z + self.calibration[1], -30, 30)))


def findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n labelled findings made from a seed, half of them secrets: (text, start, end) and 1 for a secret.

    Secrets are random strings as keys, tokens, digests and encoded bytes have them, with and without a name
    before them, some late in a run that begins with a path or a name, and some short ones after a name. Others
    are what else has digits and length: paths, addresses, versions, dates, numbered names, runs of one
    character and counters, and plain words after a name. Of what is longer than a window, a window is the
    finding: one that holds the secret, or any of the others.
    """
    rng = np.random.default_rng(seed)
    pick = lambda chars, lo, hi: "".join(rng.choice(list(chars), rng.integers(lo, hi + 1)))
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    parts = ["the", "ing", "er", "and", "tion", "est", "on", "re", "ver", "ment", "que", "ein", "lich", "os", "ara", "data", "user", "test", "build", "file", "page", "item"]
    word = lambda a=1, b=3: "".join(rng.choice(parts, rng.integers(a, b + 1)))
    secrets = [
        lambda: pick(low + up + digit, 20, 64), lambda: pick(digit + "abcdef", 24, 64), lambda: pick(digit + "ABCDEF", 24, 48), lambda: pick(up + digit, 16, 32), lambda: pick(low + digit, 20, 48),
        lambda: pick(low + up + digit + "+/", 24, 60) + rng.choice(["", "=", "=="]), lambda: rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "glpat-", "pat_", "npm_"]) + pick(low + up + digit, 20, 40),
        lambda: "AKIA" + pick(up + digit, 16, 16), lambda: "eyJ" + pick(low + up + digit + "_-", 15, 30) + "." + pick(low + up + digit + "_-", 20, 40), lambda: pick(low + up + digit + "_-", 22, 44),
    ]
    others = [
        lambda: "/".join([word(), *(word() + pick(digit, 0, 3) for _ in range(rng.integers(2, 5)))]) + pick(digit, 1, 4), lambda: f"{word(2, 4)}.{word()}{pick(digit, 1, 3)}.{rng.choice(['com', 'org', 'net', 'html', 'txt', 'py'])}",
        lambda: f"20{pick(digit, 2, 2)}-{pick('01', 2, 2)}-{pick('012', 2, 2)}_{pick(digit, 6, 6)}", lambda: f"{word(3, 5)}-{pick(digit, 1, 5)}", lambda: f"{word(2, 3)}_{word(2, 3)}_{pick(digit, 1, 4)}", lambda: rng.choice(list("-=._0")) * int(rng.integers(16, 40)) + pick(digit, 1, 2),
        lambda: "v" + ".".join(pick(digit, 1, 3) for _ in range(5)) + "-" + word(2, 3), lambda: pick(digit, 16, 24), lambda: "".join(w.capitalize() for w in (word(), word(), word(), word())) + pick(digit, 1, 3), lambda: ".".join(pick(digit, 2, 3) for _ in range(6)),
        lambda: "-".join([word(1, 2), word(1, 2), word(1, 2), word(1, 2)]) + pick(digit, 1, 2), lambda: "+" + pick(digit, 2, 2) + "-" + "-".join(pick(digit, 3, 4) for _ in range(3)),
    ]
    names = ["key", "auth", "Authorization: Bearer", "credential", "private_key", "client_id", "access", "pwd", "signature", "export KEY", "secret", "token"]
    plain = ["see", "version", "file", "page", "from", "at", "id", "ref", "path", "on", "and", "the", "build"]
    out, y = [], (rng.random(n) < 0.5).astype(np.float64)
    for label in y:
        value = str((secrets if label else others)[rng.integers(len(secrets) if label else len(others))]())
        prose = " ".join(word() for _ in range(rng.integers(0, 5)))
        short = rng.random() < 0.12
        if short:  # after a name only
            value = pick(low + up + digit, 9, 15) if label else str(rng.choice([word(2, 4), word(1, 2).capitalize() + word(1, 2), word(2, 3) + "-" + word(1, 2), word(2, 3) + "_" + word(1, 2), pick(digit, 1, 2) + word(2, 3)])).ljust(8, "e")
        named = short or rng.random() < (0.5 if label else 0.08)
        lead = f"{rng.choice(names if named else plain)}{rng.choice([': ', '=', ' = ', ' ', '="'] if named or rng.random() < 0.3 else [' '])}"
        text = prose + rng.choice([" ", "\n", ""]) + (lead if short or rng.random() < 0.7 else " ")
        late = "" if short or rng.random() >= 0.2 else rng.choice(["/", "_", "=", "."]).join(word() for _ in range(rng.integers(2, 8))) + rng.choice(["/", "=", "."])
        a, b = len(text), len(text) + len(late) + len(value)
        if b - a > WITHIN:  # one window of it: for a secret one that holds most of it
            first = a + len(late) - WITHIN // 2 if label else a
            a = int(rng.integers(max(a, first), max(a, first, min(b - WITHIN, a + len(late) + 4)) + 1))
            b = min(b, a + WITHIN)
        out.append((text + late + value + rng.choice(["", '"', ".", "\n", ", "]) + " " + word(), a, b))
    return out, y


class Detector:
    """The trained network with the threshold that keeps RECALL of the calibration's secrets."""

    def __init__(self, network: Network, threshold: float):
        self.network, self.threshold = network, threshold

    @classmethod
    def train(cls, rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS, recall: float = RECALL, seed: int = SEED) -> Detector:
        network = Network(seed)
        found, y = findings(rows, seed)
        network.train(encode_windows(found), y)
        found, y = findings(calibration_rows, seed + 1)
        x = encode_windows(found)
        network.calibrate(x, y)
        chance = network.chance(x)
        bar = np.sort(chance[y == 1])[int((1 - recall) * y.sum())]
        # No lower bar than recall allows takes fewer others; of those that take as few, the middle one.
        below = chance[(y == 0) & (chance < bar)].max(initial=0.0)
        return cls(network, float((below + chance[(y == 1) & (chance > below)].min()) / 2))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """All spans (start, kind number, end) of each text: the base's, and candidates that the network takes for secrets, whole."""
        out = [base_spans(t) for t in texts]
        wanted = [(k, a, b) for k, t in enumerate(texts) for a, b in candidates(t, out[k])]
        views = ((i, *w) for i, (_, a, b) in enumerate(wanted) for w in windows(a, b))
        taken: set[int] = set()
        while some := list(islice(views, _BATCH)):
            chance = self.network.chance(encode_windows([(texts[wanted[i][0]], a, b) for i, a, b in some]))
            taken.update(i for (i, _, _), c in zip(some, chance) if c >= self.threshold)
        for i in taken:
            k, a, b = wanted[i]
            out[k].append((a, 3, b))
        return [sorted(set(x)) for x in out]


def _free(found: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those that no span overlaps; both in order of their starts, so one sweep tells."""
    out, at, end = [], 0, -1
    for a, b in found:
        while at < len(spans) and spans[at][0] < b:
            end = max(end, spans[at][2])
            at += 1
        if end <= a:
            out.append((a, b))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kinds, base, spans) of every row: base finds by kind, their spans, and all spans with those of the network.

    Spans are kind:start:end in code points, by start and then kind, comma-joined. Whole texts and whole
    candidates are read, however long; a null text counts as empty and has empty spans. Rows stay as many as
    they are, repeated ones and those of null id too; an empty table gives an empty one; extra columns are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector or Detector.train())

    def run(batches):
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = own.spans([t.as_py() or "" for t in part.column(1)])
                counts = [[sum(k == kind for _, k, _ in f) for f in found] for kind in range(3)]
                base = [_joined([s for s in f if s[1] < 3]) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array([_joined(f) for f in found])], names=["id", "n_assign", "n_access", "n_hex", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base string, spans string")


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
