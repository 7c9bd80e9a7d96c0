"""Secret scans: three base patterns plus a character convolutional network.

The base patterns are fixed; their findings always stay.  The network
scores every candidate with its surrounding context and adds those above a threshold.
Candidates are runs of 12 or more token characters with a digit and a letter, wherever they stand,
and any run of 6 or more printable ASCII characters behind ``=``, ``:`` or a key word, so that
short, letter-only, digit-only and punctuated secrets are seen, too.  The network
is trained here, on labelled findings: the candidates of all texts of the
corpus (label: does a base pattern hold there) plus texts generated
from formats by rule.  The corpus's windows are dealt by hash into shards of about ``SHARD``;
in each epoch every shard goes on from the shared weights, and their means are the next
epoch's, so no task or driver holds more than a shard.  Scores are calibrated on a validation
fold, by counts of its logits in steps of 1 / ``STEPS``, and the
threshold is the highest step that keeps a required recall there, counted
over whole secrets: one that no candidate covers is a miss.

Cases: a null text is an empty one; empty texts and texts without a
candidate have no spans; an empty table gives no rows, and its network is trained on
generated texts alone; spans are in code points, end exclusive; repeated rows
give repeated results; texts of any length are scanned whole.  Ties: a
candidate at the threshold is a span; added spans that overlap become one.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.llm.common import SLICE_ROWS, id_text, map_slices, materialize

KINDS = ("assign", "access", "hex", "model")
# fixed patterns of the base findings
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")   # maximal runs, so the length may go into the pattern
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_HAS_DIGIT, _HAS_LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
# blanks are bounded, so that a long run of them is not tried from every place
BEHIND = re.compile(r"""(?:[=:]|\b(?:pass|passwd|password|passphrase|passcode|pwd|pin|secret|token|credentials?|auth|authorization|bearer|login|key)\b"""
                    r"""["']?\x20{0,4}(?:[=:]|is\b)?)["']?[\x20\t]{0,4}["']?([!#-&(-9;<>-~][!#-&(-~]{5,})""", re.IGNORECASE | re.ASCII)
_TRAILING = ".,;:)]}>"

LEFT, BODY, RIGHT = 28, 40, 8
WIDTH = LEFT + BODY + RIGHT
#: Windows of a training shard, about.
SHARD = 6_000
EPOCHS = 6
#: Logits of the validation fold are rounded down to steps of 1 / STEPS, within +-MAX_LOGIT.
STEPS, MAX_LOGIT = 1024, 64
RECALL = 0.98


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans to score, by start: token runs with a digit and a letter, and what
    stands behind ``=``, ``:`` or a key word (without closing punctuation)."""
    found = {m.span(1)[0]: m.span(1)[0] + len(m[1].rstrip(_TRAILING)) for m in BEHIND.finditer(text)}
    out = {(s, e) for s, e in found.items() if e - s >= 6}
    if _HAS_DIGIT.search(text):
        out.update(m.span() for m in CANDIDATE.finditer(text) if _HAS_DIGIT.search(m[0]) and _HAS_LETTER.search(m[0]))
    return sorted(out)


def windows(text: str, start: int, end: int) -> list[str]:
    """The inputs of the network for one candidate: its context and its
    body, in as many windows as a long body needs."""
    left = text[max(0, start - LEFT):start].rjust(LEFT, "\x00")
    out = []
    for at in range(start, end, BODY):
        stop = min(end, at + BODY)
        right = text[stop:stop + RIGHT].ljust(RIGHT, "\x00")
        out.append(left + text[at:stop].ljust(BODY, "\x00") + right)
    return out


def encode(wins: list[str]) -> np.ndarray:
    """Character classes 0..96: padding, other, 95 printable ASCII."""
    raw = np.frombuffer("".join(wins).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw.astype(np.int64) - 30, 1))
    return out.reshape(len(wins), WIDTH).astype(np.int64)


@dataclass
class CharNetwork:
    """Embedding, one convolution, ReLU, maximum over the body's positions
    and over the context's, a dense layer; plain numpy, forward and backward."""
    embed: np.ndarray     # (97, e)
    conv: np.ndarray      # (k * e, f)
    conv_bias: np.ndarray
    dense: np.ndarray     # (2 f,)
    bias: np.ndarray      # (1,)
    slope: float = 1.0
    intercept: float = 0.0
    threshold: float = 1.0
    k: int = 5

    @staticmethod
    def fresh(e: int = 8, f: int = 16, k: int = 5, seed: int = 7) -> CharNetwork:
        r = np.random.default_rng(seed)
        return CharNetwork(r.normal(0, 0.3, (97, e)), r.normal(0, (k * e) ** -0.5, (k * e, f)), np.zeros(f),
                           r.normal(0, 0.2, 2 * f), np.zeros(1), k=k)

    def _forward(self, x: np.ndarray):
        emb = self.embed[x]                                               # n, w, e
        n, w, e = emb.shape
        cols = np.lib.stride_tricks.sliding_window_view(emb, self.k, axis=1)   # n, w-k+1, e, k
        cols = cols.transpose(0, 1, 3, 2).reshape(n, w - self.k + 1, self.k * e)
        act = np.maximum(cols @ self.conv + self.conv_bias, 0)            # n, p, f
        cut = LEFT - self.k + 1
        parts = (act[:, :cut], act[:, cut:])
        tops = [p.argmax(1) for p in parts]
        pooled = np.concatenate([np.take_along_axis(p, t[:, None], 1)[:, 0] for p, t in zip(parts, tops)], 1)
        return cols, act, tops, cut, pooled, pooled @ self.dense + self.bias[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[at:at + 512])[-1] for at in range(0, len(x), 512)] or [np.zeros(0)])

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.intercept, -500, 500)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        cols, act, tops, cut, pooled, z = self._forward(x)
        n, f = len(x), self.conv.shape[1]
        dz = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        d_pool = dz[:, None] * self.dense
        d_act = np.zeros_like(act)
        rows, filt = np.arange(n)[:, None], np.arange(f)[None]
        d_act[rows, tops[0], filt] = d_pool[:, :f]
        d_act[rows, tops[1] + cut, filt] += d_pool[:, f:]
        d_act *= act > 0
        flat = d_act.reshape(-1, f)
        d_cols = (flat @ self.conv.T).reshape(n, -1, self.k, self.embed.shape[1])
        e = self.embed.shape[1]
        at = np.lib.stride_tricks.sliding_window_view(x, self.k, axis=1)[..., None] * e + np.arange(e)
        d_embed = np.bincount(at.ravel(), d_cols.ravel(), self.embed.size).reshape(self.embed.shape)
        return [d_embed, cols.reshape(len(flat), -1).T @ flat, flat.sum(0), pooled.T @ dz, np.array([dz.sum()])]

    @property
    def params(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.dense, self.bias]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> None:
        """Adam over shuffled batches of 64."""
        r, state = np.random.default_rng(seed), Moments.fresh(self)
        for _ in range(epochs):
            self.train_epoch(x, y, state, r.permutation(len(x)), rate)

    def train_epoch(self, x: np.ndarray, y: np.ndarray, state: Moments, order: np.ndarray, rate: float = 0.01) -> None:
        """One pass in the given order."""
        for at in range(0, len(order), 64):
            state.t += 1
            for p, g, a, b in zip(self.params, self._gradients(x[order[at:at + 64]], y[order[at:at + 64]]), state.m, state.v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9 ** state.t)) / (np.sqrt(b / (1 - 0.99 ** state.t)) + 1e-8)


@dataclass
class Moments:
    """What Adam keeps from batch to batch."""
    m: list[np.ndarray]
    v: list[np.ndarray]
    t: float = 0

    @staticmethod
    def fresh(net: CharNetwork) -> Moments:
        return Moments([np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params])


def _flat(net: CharNetwork, state: Moments) -> np.ndarray:
    """Weights, moments and batch number as one vector."""
    return np.concatenate([p.ravel() for p in (*net.params, *state.m, *state.v)] + [np.array([state.t], dtype=np.float64)])


def _unflat(flat: np.ndarray) -> tuple[CharNetwork, Moments]:
    net = CharNetwork.fresh()
    state = Moments.fresh(net)
    at = 0
    for p in (*net.params, *state.m, *state.v):
        p[...] = flat[at:at + p.size].reshape(p.shape)
        at += p.size
    state.t = float(flat[at])
    return net, state


def generated_texts(n: int = 3000, seed: int = 5) -> list[tuple[str, int, int]]:
    """Texts made by rule with the span of the secret in each (0, 0: harmless):
    keys and tokens of common shapes anywhere; short, letter-only, digit-only and
    punctuated secrets behind a key word; and harmless strings of the same alphabets, some
    behind ``=``, ``:`` or a key word as well."""
    r = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda a=3, b=9: "".join(r.choice(list(lower), r.integers(a, b)))
    some = lambda abc, k: "".join(r.choice(list(abc), k))
    prose = lambda k: " ".join(word() for _ in range(k))
    pick = lambda items: items[r.integers(len(items))]
    anywhere = ["auth=", "bearer ", "pwd: ", "credential=", "private_key: ", "client_secret=", "access_token: ", ""]
    behind = ["pwd: ", "pwd=", "pass: ", "pass = ", "credential=", "client credential=", "passphrase: ", "passphrase is ", "pin: ", "pin=",
              "auth_key=", "login pass: ", "Pwd: '", "db_pass=\"", "Passcode: "]
    mixed = lower + upper + digits

    def strong() -> str:
        kind = r.integers(6)
        if kind == 0:
            return some(upper + digits, r.integers(16, 24))
        if kind == 1:
            return some(mixed, r.integers(24, 44))
        if kind == 2:
            return some("abcdef" + digits, r.integers(18, 41))
        if kind == 3:
            return pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + some(mixed, 24)
        if kind == 4:
            return some(mixed + "+/", r.integers(30, 40)) + "="
        return "eyJ" + some(mixed + "_-", 20) + "." + some(mixed + "_-", 20)

    def weak() -> str:
        kind = r.integers(6)
        if kind == 0:
            return word(5, 9) + some(digits, r.integers(1, 4)) + some(lower, r.integers(0, 3))
        if kind == 1:
            return "".join(word(3, 8) for _ in range(r.integers(2, 5))) + "ab"
        if kind == 2:
            return some(digits, r.integers(6, 13))
        if kind == 3:
            return word(3, 6) + some("@!#$%&*", 1) + some(mixed, r.integers(2, 7)) + some("!#$%&*?", 1)
        if kind == 4:
            return some(mixed + "@!#$%&*-_", r.integers(8, 16)) + "x"
        return "-".join(word(4, 7) for _ in range(r.integers(2, 5)))

    def harmless() -> tuple[str, str]:
        kind = r.integers(12)
        if kind == 0:
            return "", f"{word()}-{word()}-{word()}-{r.integers(1, 2030)}"
        if kind == 1:
            return pick(["", "http://", "see: "]), f"www.{word()}.com/{word()}/{r.integers(1, 999)}/{word()}"
        if kind == 2:
            return "", f"{word(5, 9)}{word(5, 9)}{r.integers(1, 99)}"
        if kind == 3:
            return pick(["", "date: ", "on "]), f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}:{r.integers(10, 60)}"
        if kind == 4:
            return "", f"{word()}_{word()}_v{r.integers(1, 9)}.{r.integers(0, 9)}.{word(2, 4)}"
        if kind == 5:
            return "", f"{word()}.{word()}{r.integers(1, 99)}.{word()}.org"
        if kind == 6:
            return pick(["note: ", "author: ", "title: ", f"{word()}: ", f"{word()}: ", f"{word()} = "]), word(6, 12)
        if kind == 7:
            return pick(["the key ", "pass the ", "a token ", "the secret of ", "login page ", "pin down ", "keys and "]), word(6, 12)
        if kind == 8:
            return pick(["tel: ", "isbn: ", "pages=", "id=", "year: ", "order: "]), some(digits, r.integers(6, 13))
        if kind == 9:
            return pick(["color=", "style: ", "name=", "city: "]), f"{word(4, 8)}-{word(4, 8)}"
        if kind == 10:
            return pick(["mail: ", "", "contact: "]), f"{word()}{r.integers(1, 99)}@{word()}.com"
        return pick(["ratio ", "at ", "score: "]), f"{r.integers(10, 99)}:{r.integers(10, 99)}:{r.integers(10, 99)}"

    out = []
    for i in range(n):
        if i % 2:
            key, body = (pick(anywhere), strong()) if i % 4 == 1 else (pick(behind), weak())
        else:
            key, body = harmless()
        head = prose(6) + pick([" ", "\n", ". "]) + key
        out.append((head + body + pick([" ", "\n", ", ", ". ", "\" "]) + prose(3), len(head) if i % 2 else 0, len(head) + len(body) if i % 2 else 0))
    return out


def labelled_windows(texts: list[tuple[str, int, int]]) -> tuple[list[str], list[int], list[int]]:
    """Windows of all candidates of the texts, their labels (do they overlap the secret)
    and the secret they belong to (-1: none).  A secret without a candidate has no window."""
    wins, y, owner = [], [], []
    for i, (text, start, end) in enumerate(texts):
        for s, e in candidates(text):
            hit = s < end and start < e
            for w in windows(text, s, e):
                wins.append(w)
                y.append(int(hit))
                owner.append(i if hit else -1)
    return wins, y, owner


def generated_findings(n: int = 3000, seed: int = 5) -> tuple[list[str], list[int]]:
    """Windows and labels of ``generated_texts``."""
    return labelled_windows(generated_texts(n, seed))[:2]


def labelled_corpus(docs: DataFrame) -> DataFrame:
    """(w, y, held): the distinct windows of all candidates of all texts; y is 1 where a base
    pattern holds; ``held`` marks the validation fold, a fifth by the hash of the window."""

    def find(b):
        out_w, out_y = [], []
        for t in b.column(1):
            text = t.as_py()
            found = candidates(text)
            spans = base_spans(text) if found else []
            for s, e in found:
                hit = any(a < e and s < z for a, z, _ in spans)
                for w in windows(text, s, e):
                    out_w.append(w)
                    out_y.append(int(hit))
        return {"w": out_w, "y": out_y, "held": [_held(w) for w in out_w]}

    return (map_slices(id_text(docs), find, "w string, y int, held boolean")
            .groupBy("w").agg(F.max("y").alias("y"), F.max("held").alias("held")))


def _held(window: str) -> bool:
    return hashlib.blake2b(window.encode("utf-8", "surrogatepass"), digest_size=2).digest()[0] % 5 == 0


def _epoch(flat: np.ndarray, wins: list[str], y: list[int], seed: list[int]) -> np.ndarray:
    """The vector after one pass over the windows."""
    net, state = _unflat(flat)
    net.train_epoch(encode(wins), np.array(y, dtype=np.float64), state, np.random.default_rng(seed).permutation(len(wins)))
    return _flat(net, state)


def train_shards(corpus: DataFrame, size: int = SHARD, epochs: int = EPOCHS) -> CharNetwork:
    """The network trained on all windows (w, y) of ``corpus``, each shard with the generated ones:
    per epoch, the mean of what the shards learn."""
    more, more_y = generated_part([t for i, t in enumerate(generated_texts()) if i % 10 < 8])
    shared = corpus.sparkSession.sparkContext.broadcast((more, more_y))
    shards = -(-corpus.count() // size)
    dealt = corpus.select("w", "y", F.pmod(F.xxhash64("w"), F.lit(max(1, shards))).cast("int").alias("shard"))
    flat = _flat(net := CharNetwork.fresh(), Moments.fresh(net))

    def learner(flat: np.ndarray, epoch: int):
        def learn(part: pa.Table) -> pa.Table:
            part, (wins, labels) = part.sort_by("w"), shared.value
            got = _epoch(flat, part["w"].to_pylist() + wins, part["y"].to_pylist() + labels, [11, epoch, part["shard"][0].as_py()])
            return pa.table({"i": pa.array(np.arange(len(got)), pa.int32()), "x": pa.array(got)})
        return learn

    # summed as decimals, so that the order of the shards changes nothing
    mean = F.avg(F.col("x").cast("decimal(30,18)")).cast("double")
    for epoch in range(epochs):
        if shards:
            learnt = dealt.groupBy("shard").applyInArrow(learner(flat, epoch), "i int, x double")
            flat = learnt.groupBy("i").agg(mean.alias("x")).toArrow().sort_by("i")["x"].to_numpy()
        else:
            flat = _epoch(flat, more, more_y, [11, epoch, 0])
    return _unflat(flat)[0]


def _steps(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -MAX_LOGIT, MAX_LOGIT) * STEPS).astype(np.int64)


def logit_counts(corpus: DataFrame, net: CharNetwork) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all windows (w, y) rounded down to steps, their labels and how often each pair occurs:
    2 * (2 * MAX_LOGIT * STEPS + 1) rows at most."""
    shared = corpus.sparkSession.sparkContext.broadcast(net)
    got = (map_slices(corpus.select("w", "y"), lambda b: {"z": _steps(shared.value.logits(encode(b.column(0).to_pylist()))), "y": b.column(1)},
                      "z long, y int", rows=2048)
           .groupBy("z", "y").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("z", "ascending"), ("y", "ascending")]))
    return got["z"].to_numpy() / STEPS, got["y"].to_numpy().astype(np.float64), got["n"].to_numpy()


def fit(docs: DataFrame, recall: float = RECALL) -> CharNetwork:
    """Train, calibrate and set the threshold.  The validation fold is a fifth of the corpus findings
    (by the hash of the window) and a fifth of the generated texts."""
    corpus = materialize(labelled_corpus(docs), "secret-windows")
    net = train_shards(corpus.where("not held"))
    held = [t for i, t in enumerate(generated_texts()) if i % 10 in (8, 9)]
    more, more_y, owner = labelled_windows(held)
    z, t, n = logit_counts(corpus.where("held"), net)
    more_z, more_t = _steps(net.logits(encode(more))) / STEPS, np.array(more_y, dtype=np.float64)
    net.slope, net.intercept = _platt(np.concatenate([z, more_z]), np.concatenate([t, more_t]),
                                      np.concatenate([n, np.ones(len(more))]))
    best, ones = _by_secret(net.calibrated(more_z), more_t, owner, sum(end > 0 for _, _, end in held))
    found = t == 1
    net.threshold = recall_threshold(np.concatenate([net.calibrated(z[found]), best]), np.concatenate([t[found], ones]), recall,
                                     np.concatenate([n[found], ones]))
    return net


def generated_part(texts: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    """Training windows; of a secret without a candidate, its own."""
    wins, y, owner = labelled_windows(texts)
    for i in sorted({i for i, t in enumerate(texts) if t[2]} - set(owner)):
        wins += windows(*texts[i])
        y += [1] * (len(wins) - len(y))
    return wins, y


def _by_secret(p: np.ndarray, y: np.ndarray, owner: list[int], secrets: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities per secret: the best of its windows; 0 for those without one."""
    best: dict[int, float] = {}
    for i, q in zip(owner, p):
        if i >= 0:
            best[i] = max(best.get(i, 0.0), float(q))
    alone = [float(q) for q, t, i in zip(p, y, owner) if t == 1 and i < 0]
    every = np.array(alone + list(best.values()) + [0.0] * (secrets - len(best)))
    return every, np.ones(len(every))


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and intercept; ``n``: how often each pair occurs."""
    n = np.broadcast_to(np.asarray(n, dtype=np.float64), z.shape)
    a, b, pos, neg = 1.0, 0.0, (n * y).sum(), (n * (1 - y)).sum()
    soft = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        q = n * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(n * (p - soft) * z).sum() + 1e-3 * a, (n * (p - soft)).sum()])
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def recall_threshold(p: np.ndarray, y: np.ndarray, recall: float, n: np.ndarray | None = None) -> float:
    """The highest threshold that finds at least ``recall`` of the labelled secrets; ``n``: how
    often each of them occurs."""
    pos = p[y == 1]
    if not len(pos):
        return 1.0
    order = np.argsort(pos, kind="stable")
    upto = np.cumsum((np.ones(len(p)) if n is None else n)[y == 1][order])
    return float(pos[order][np.searchsorted(upto, np.floor((1 - recall) * upto[-1]), side="right")])


def find_spans(text: str, net: CharNetwork) -> list[tuple[int, int, str]]:
    """All spans of one text; see ``find_batch``."""
    return find_batch([text], net)[0]


def find_batch(texts: list[str], net: CharNetwork) -> list[list[tuple[int, int, str]]]:
    """Base spans and the candidates that the network adds (those that
    overlap no base span), by start, then kind as listed.  Every candidate is
    scored, in blocks of windows."""
    out, owner, wins = [base_spans(t) for t in texts], [], []
    best: dict[tuple[int, int, int], float] = {}

    def flush():
        if wins:
            for key, p in zip(owner, net.probability(encode(wins))):
                best[key] = max(best.get(key, 0.0), float(p))
            owner.clear()
            wins.clear()

    for i, t in enumerate(texts):
        for s, e in candidates(t):
            for w in windows(t, s, e):
                owner.append((i, s, e))
                wins.append(w)
                if len(wins) >= 2048:
                    flush()
    flush()
    base = [sorted(o) for o in out]
    last: dict[int, int] = {}   # place of a text's latest added span
    for (i, s, e), p in sorted(best.items()):
        if p < net.threshold or any(a < e and s < z for a, z, _ in base[i]):
            continue
        if i in last and s < out[i][last[i]][1]:
            a, z, kind = out[i][last[i]]
            out[i][last[i]] = (a, max(z, e), kind)
        else:
            last[i] = len(out[i])
            out[i].append((s, e, "model"))
    return [sorted(o, key=lambda x: (x[0], KINDS.index(x[2]))) for o in out]


SPAN = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, net: CharNetwork) -> DataFrame:
    """(doc_id, spans) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(b):
        found = find_batch([t.as_py() for t in b.column(1)], shared.value)
        return {"doc_id": b.column(0),
                "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in f] for f in found]}

    return map_slices(id_text(docs), run, f"doc_id long, spans {SPAN}")


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each (merged) span replaced by ``mark``."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, net: CharNetwork, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (n_chars follows,
    where there is one); all rows and columns stay, null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(start, SLICE_ROWS)
                texts = b.column(at).to_pylist()
                found = find_batch([t or "" for t in texts], shared.value)
                cols = list(b.columns)
                new = [redact(t, s, mark) if s else t for t, s in zip(texts, found)]
                cols[at] = pa.array(new, cols[at].type)
                if size is not None:
                    n = [len(t) if s else old for t, s, old in zip(new, found, cols[size].to_pylist())]
                    cols[size] = pa.array(n, cols[size].type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return scanned.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", line)).alias("spans"), of("model").alias("n_model"))
