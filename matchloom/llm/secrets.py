"""Secrets in texts: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as outside, begin or inside of a secret, from the shape of the token,
its neighbours and features of the whole text. It learns from a bounded sample of rows whose
labels are the fixed patterns' matches, by maximum likelihood with forward-backward, and
decodes by Viterbi. Rows are independent of each other; nothing is shuffled.

Scores depend on tokens only through a few attributes, so each distinct token is described
once per worker. A running maximum of what a secret could gain proves for most texts that the
path without any secret is the best one; Viterbi runs over the whole of every other text.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from matchloom.llm.common import packed, slices, text_or_empty

KINDS = ("assign", "access", "hex")
ADDED = "crf"
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal either way
HINTS = ("passw", "secret", "token", "apikey", "api_key")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

TOKEN = re.compile(r"""[^\s"'=:;,|<>(){}\[\]]+|["'=:]""")
WORDS = frozenset(("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "credential",
                   "credentials", "access_key", "auth", "private_key"))
LENGTHS, MIXES, SPREADS, ROLES, FILES = 8, 10, 6, 6, 4
OUT, BEGIN, INSIDE = range(3)


@dataclass(frozen=True)
class SecretConfig:
    """``sample``: at most so many rows with pattern matches, and as many of any kind, train the
    field, by smallest hash; the sample is drawn from texts of ``shortest`` to ``longest`` characters, and
    has ``hits`` sequences around matches of one text at most, so that no text rules it. These bound the
    training only: spans are sought in every text. ``window``: tokens of a training sequence. ``least``:
    shortest added span."""

    sample: int = 300
    shortest: int = 200
    longest: int = 20_000
    hits: int = 20
    window: int = 25
    rounds: int = 120
    step: float = 0.15
    decay: float = 0.002
    least: int = 8


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def attributes(token: str) -> tuple[int, int, int, int]:
    """Length, mix of characters, spread of characters and role of a token."""
    size = len(token)
    if size == 1 and token in "\"'=:":
        return 0, 0, 0, 1 if token in "=:" else 2
    core = token.strip(".,!?*&%#$")
    n = len(core)
    role = 3 if core.lower() in WORDS else 4 if core.startswith("AKIA") else 0
    length = 0 if n < 6 else min(LENGTHS - 1, int(math.log2(n)) - 1) if n < 512 else LENGTHS - 1
    if not core.isascii():
        return length, 1, 0, role
    digits = sum(map(core.count, "0123456789")) if n >= 6 else 0
    if n < 6 or (core.isalpha() and (core.islower() or core.istitle())):
        return length, 2, 0, role
    lower, upper = core != core.upper(), core != core.lower()
    letters = core.isalnum()
    mix = (3 if not digits and not letters else 4 if not digits else 5 if digits == n
           else 6 if letters and not upper and not set(core) - set("0123456789abcdef")
           else 7 if letters and lower != upper else 8 if letters else 9)
    counts = Counter(core).values()
    total = sum(counts)
    entropy = -sum(c / total * math.log2(c / total) for c in counts)
    return length, mix, min(SPREADS - 1, int(entropy * 1.25)), role


SHAPE = LENGTHS + MIXES + SPREADS + ROLES
NEAR = MIXES + ROLES  # what a neighbour shows
BEFORE, BEFORE2, AFTER, FILE = SHAPE, SHAPE + NEAR, SHAPE + 2 * NEAR, SHAPE + 3 * NEAR
FEATURES = FILE + FILES + 1


class Shapes(dict):
    """Numbers distinct attribute tuples; a token is looked up once."""

    limit = 300_000

    def __init__(self):
        super().__init__()
        self.numbers: dict[tuple, int] = {}

    def __missing__(self, token: str) -> int:
        number = self.numbers.setdefault(attributes(token), len(self.numbers))
        self[token] = number
        return number

    def renew(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def own(self) -> np.ndarray:
        out = np.zeros((len(self.numbers), SHAPE))
        for (a, b, c, d), i in self.numbers.items():
            out[i, [a, LENGTHS + b, LENGTHS + MIXES + c, LENGTHS + MIXES + SPREADS + d]] = 1
        return out

    def near(self) -> np.ndarray:
        out = np.zeros((len(self.numbers), NEAR))
        for (_, b, _, d), i in self.numbers.items():
            out[i, [b, MIXES + d]] = 1
        return out


def file_feature(numbers: np.ndarray, roles: np.ndarray) -> int:
    """What a whole text is like: share of operators, and whether a key word occurs."""
    role = roles[numbers]
    dense = int((role == 1).sum() * 50 > len(numbers))
    return dense + 2 * int(bool((role == 3).any()))


@dataclass
class Field:
    """Weights of a linear-chain conditional random field with three tags."""

    emission: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 3)))
    change: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    fitted: bool = False

    def fit(self, features: np.ndarray, tags: np.ndarray, config: SecretConfig) -> Field:
        """Maximum likelihood on sequences of one length; features (n, t, FEATURES), tags (n, t)."""
        n, t, _ = features.shape
        grids = [np.zeros_like(self.emission), np.zeros_like(self.change)]
        moments = [[np.zeros_like(g), np.zeros_like(g)] for g in grids]
        hot = np.eye(3)[tags]
        pairs = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
        for turn in range(1, config.rounds + 1):
            score = features @ self.emission
            ahead, back = np.zeros((t, n, 3)), np.zeros((t, n, 3))
            ahead[0] = score[:, 0]
            for k in range(1, t):
                ahead[k] = score[:, k] + _logsum(ahead[k - 1][:, :, None] + self.change, 1)
            for k in range(t - 2, -1, -1):
                back[k] = _logsum(self.change + (score[:, k + 1] + back[k + 1])[:, None, :], 2)
            whole = _logsum(ahead[-1], 1)[:, None]
            share = np.exp(ahead + back - whole).transpose(1, 0, 2)
            expected = np.zeros((3, 3))
            for k in range(1, t):
                expected += np.exp(ahead[k - 1][:, :, None] + self.change
                                   + (score[:, k] + back[k])[:, None, :] - whole[:, :, None]).sum(axis=0)
            slopes = [np.einsum("ntf,nta->fa", features, hot - share) / n - config.decay * self.emission,
                      (pairs - expected) / n - config.decay * self.change]
            for weights, slope, (m, v) in zip((self.emission, self.change), slopes, moments):
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                weights += config.step * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
        self.fitted = True
        return self

    def viterbi(self, score: np.ndarray) -> list[int]:
        """The best tags of one text."""
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self.change.tolist()
        rows = score.tolist()
        o, b, i = rows[0]
        back = []
        for so, sb, si in rows[1:]:
            x = (o + oo, b + bo, i + io)
            y = (o + ob, b + bb, i + ib)
            z = (o + oi, b + bi, i + ii)
            p, q, r = x.index(max(x)), y.index(max(y)), z.index(max(z))
            back.append((p, q, r))
            o, b, i = x[p] + so, y[q] + sb, z[r] + si
        last = (o, b, i)
        tags = [last.index(max(last))]
        for step in reversed(back):
            tags.append(step[tags[-1]])
        return tags[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def training(texts: list[str], config: SecretConfig) -> tuple[np.ndarray, np.ndarray]:
    """Sequences around each match, and evenly spaced ones of every text."""
    shapes, sequences = Shapes(), []
    t = config.window
    for text in texts:
        spans = _tokens(text)
        if len(spans) < t:
            continue
        numbers = np.array([shapes[text[a:b]] for a, b in spans])
        tags = np.zeros(len(spans), np.int64)
        starts = np.array([a for a, _ in spans])
        for kind, a, b in base_spans(text):
            if kind == "assign":
                a = ASSIGN.match(text, a).start(1)
            i, j = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
            tags[max(i, 0):j] = INSIDE
            tags[max(i, 0)] = BEGIN
        roles = np.array([r[3] for r in shapes.numbers])
        kind = file_feature(numbers, roles)
        hits = np.flatnonzero(tags == BEGIN)[:config.hits] - t // 2
        for a in np.clip([*hits, *range(0, len(spans) - t + 1, max(t, len(spans) // 6))], 0, len(spans) - t):
            sequences.append((numbers, a, kind, tags[a:a + t]))
    own, near = shapes.own(), shapes.near()
    features = np.zeros((len(sequences), t, FEATURES))
    for row, (numbers, a, kind, _) in zip(features, sequences):
        around = np.concatenate([[-1, -1], numbers, [-1]])[a:a + t + 3]
        row[:, :SHAPE] = own[numbers[a:a + t]]
        for offset, place in ((1, BEFORE), (0, BEFORE2), (3, AFTER)):
            which = around[offset:offset + t]
            row[:, place:place + NEAR] = near[which] * (which >= 0)[:, None]
        row[:, FILE + kind] = 1
        row[:, -1] = 1
    tags = np.array([s[3] for s in sequences]) if sequences else np.zeros((0, t), int)
    return features, tags


class Tagger:
    """Decodes texts with a fitted field."""

    def __init__(self, model: Field):
        self.model, self.shapes = model, Shapes()
        gain = model.change - model.change[OUT, OUT]
        # The most that one more token in a secret can gain by its tag changes, and a secret by its ends.
        within = float(gain[1:, 1:].max())
        enter, leave = float(gain[OUT, 1:].max()), float(gain[1:, OUT].max())
        ends = max(enter + leave, enter, leave, 0.0) - within  # a text may begin or end in a secret
        self.most = within + max(0.0, ends)
        self.tables: tuple[np.ndarray, ...] | None = None

    def _tables(self) -> tuple[np.ndarray, ...]:
        n = len(self.shapes.numbers)
        if self.tables is None or len(self.tables[0]) != n + 1:
            w, own, near = self.model.emission, self.shapes.own(), self.shapes.near()
            none = np.zeros((1, 3))
            parts = [own @ w[:SHAPE] + w[-1]] + [near @ w[p:p + NEAR] for p in (BEFORE, BEFORE2, AFTER)]
            roles = np.array([r[3] for r in self.shapes.numbers], np.int64)
            self.tables = (*[np.concatenate([p, none]) for p in parts], roles)
        return self.tables

    def spans(self, texts: list[str], least: int) -> list[list[tuple[int, int]]]:
        """Tagged stretches of each text, in code points."""
        self.shapes.renew()
        pieces = [TOKEN.findall(t) for t in texts]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter(map(self.shapes.__getitem__, itertools.chain.from_iterable(pieces)),
                           np.int64, int(sizes.sum()))
        own, before, before2, after, roles = self._tables()
        found: list[list[tuple[int, int]]] = []
        ends = np.cumsum(sizes)
        for text, a, b in zip(texts, ends - sizes, ends):
            found.append([])
            if a == b:
                continue
            k = flat[a:b]
            none = len(own) - 1
            score = own[k] + self.model.emission[FILE + file_feature(k, roles)]
            score += before[np.concatenate([[none], k[:-1]])] + after[np.concatenate([k[1:], [none]])]
            score += before2[np.concatenate([[none, none], k[:-2]])[: len(k)]]
            gain = np.maximum(score[:, BEGIN], score[:, INSIDE]) - score[:, OUT] + self.most
            if gain.max() <= 0:
                continue
            tags = self.model.viterbi(score)
            if any(tags):
                places, start = _tokens(text), None
                for (x, y), tag in zip([*places, (None, None)], [*tags, OUT]):
                    if start is not None and tag != INSIDE:
                        if stop - start >= least:  # noqa: F821
                            found[-1].append((start, stop))  # noqa: F821
                        start = None
                    if tag != OUT:
                        start = x if start is None else start
                        stop = y  # noqa: F841
        return found


def fit(docs: DataFrame, config: SecretConfig) -> Field:
    """Train on a bounded sample: at most ``config.sample`` rows with matches and as many of any kind."""
    hint = F.lower("text").rlike("(passw|secret|token|api_?key)[\"']?\x20*[:=]|[0-9a-f]{24}") | F.col("text").contains("AKIA")
    marked = docs.select(text_or_empty().alias("text")).filter(F.length("text").between(config.shortest, config.longest)).withColumn(
        "h", F.xxhash64("text"))
    texts = []
    for part in (marked.filter(hint), marked):
        # Hashes first: texts reach the driver for the sample only, not from every task.
        lowest = [r["h"] for r in part.groupBy("h").count().orderBy("h").limit(config.sample).select("h").collect()]
        if lowest:
            chosen = marked.filter(F.col("h") <= lowest[-1])
            chosen = chosen if part is marked else chosen.filter(hint)
            texts += [r["text"] for r in chosen.select("text").distinct().collect()]
    features, tags = training(sorted(set(texts)), config)
    return Field().fit(features, tags, config) if (tags > 0).any() else Field()


def find(docs: DataFrame, config: SecretConfig = SecretConfig(), model: Field | None = None) -> DataFrame:
    """``docs`` with a column ``secrets``: array of (kind, start, end), by start, then kind.

    Kinds are assign, access and hex, the fixed patterns, and crf, tagged stretches that no
    pattern's match touches. Positions are code points, end exclusive. Null text counts as empty. Rows are
    independent; repeated ones get equal results; an empty table gives no rows; all other
    columns stay. Without a match in the sample there is nothing to learn, and only patterns
    find. A text of any length is decoded whole.
    """
    data = docs.select(packed(docs, "secrets"), text_or_empty().alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, config))  # weights: fixed size
    least = config.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for part in slices(batches, "_text"):
            texts = part.column(part.schema.get_field_index("_text")).to_pylist()
            more = tagger.spans(texts, least) if tagger.model.fitted else [[]] * len(texts)
            rows = []
            for text, tagged in zip(texts, more):
                base = base_spans(text)
                new = [(ADDED, a, b) for a, b in tagged if all(b <= x or y <= a for _, x, y in base)]
                rows.append([dict(kind=k, start=a, end=b) for k, a, b in sorted(
                    base + new, key=lambda s: (s[1], (*KINDS, ADDED).index(s[0])))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["_row", "secrets"])

    schema = data.select("_row").schema.add("secrets", DataType.fromDDL(SPANS))
    return data.mapInArrow(run, schema).select("_row.*", "secrets")
