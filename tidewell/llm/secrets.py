"""Secrets by patterns and a character convolutional network.

Candidates are the pattern matches and all long tokens of letters and digits. The network, in numpy, reads
each whole candidate with the characters before and after it: one-hot characters and a mark of what is
candidate and what context on which side, a convolution, the maximum over all places, a dense layer. It is
trained on labelled findings: those that the patterns settle in a bounded sample of documents, and made-up
ones of known formats and of look-alikes. Its scores are calibrated on a part held out, and the threshold of
each kind of candidate is the highest that keeps the recall asked for there.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import read, small_batches

KINDS = ["assign", "access", "hex", "token"]
#: Documents and candidates of the sample, made-up findings, and recall that a threshold keeps on held-out ones.
SAMPLE_DOCS, SAMPLE_FINDINGS, MADE, RECALL = 4000, 2000, 4000, 0.98
#: Characters of context on each side, filters, their width, hidden units; places that are convolved at once.
AROUND, FILTERS, WIDTH, HIDDEN, PLACES = 24, 24, 5, 16, 1 << 16

ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Tokens that the network judges: from 20 characters on, with a letter and a digit. One that long is no word.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind number, end of what the patterns find."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """start, end of the candidates besides the base spans."""
    return [m.span() for m in TOKEN.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


#: Classes of characters: digits, letters, and some marks each have their own.
ALPHABET = {c: k + 2 for k, c in enumerate(string.digits + string.ascii_letters + " \"'=:+/_-.,@<>()[]{}|\n")}
SIZE = len(ALPHABET) + 3


def coded(text: str, start: int, end: int) -> np.ndarray:
    """Class of each character of the candidate and its context, plus SIZE in the candidate and 2 * SIZE after it; 0 where there is no character."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    x = np.zeros(end - start + 2 * AROUND, dtype=np.uint16)
    x[AROUND - len(before) : AROUND] = [ALPHABET.get(c, 1) for c in before]
    x[AROUND : AROUND + end - start] = [ALPHABET.get(c, 1) + SIZE for c in text[start:end]]
    x[AROUND + end - start : AROUND + end - start + len(after)] = [ALPHABET.get(c, 1) + 2 * SIZE for c in after]
    return x


@dataclass
class Network:
    """Weights: a filter for each place in it, class of character and side; dense layers, calibration, a threshold for each kind."""

    filters: np.ndarray  # WIDTH, 3 * SIZE, FILTERS
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (0.5,) * len(KINDS)

    def pool(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters in a row, and for each candidate and filter the best value and its place among them."""
        flat = np.concatenate(xs).astype(np.int64)
        first = np.cumsum([0, *map(len, xs)])[:-1]
        n = len(flat) - WIDTH + 1
        conv = self.filters[0, flat[:n]]
        for k in range(1, WIDTH):
            conv = conv + self.filters[k, flat[k : k + n]]
        sizes = np.array([len(x) - WIDTH + 1 for x in xs])
        at = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # no window over two candidates
        conv, starts = conv[at], np.cumsum(sizes) - sizes
        best = np.maximum.reduceat(conv, starts)
        place = np.where(conv == np.repeat(best, sizes, axis=0), np.arange(len(at))[:, None], len(at))
        return flat, best, at[np.minimum.reduceat(place, starts)]

    def dense(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pooled = np.maximum(best, 0)
        hidden = np.maximum(pooled @ self.w1 + self.b1, 0)
        return pooled, hidden, hidden @ self.w2 + self.b2

    def logits(self, xs: list[np.ndarray]) -> np.ndarray:
        """The output for each candidate; long ones go in pieces that overlap, of which the maximum counts."""
        pieces, of = [], []
        for k, x in enumerate(xs):
            for low in range(0, max(1, len(x) - WIDTH + 1), PLACES):
                pieces.append(x[low : low + PLACES + WIDTH - 1])
                of.append(k)
        best = np.full((len(xs), FILTERS), -np.inf)
        at = 0
        while at < len(pieces):
            upto, total = at, 0
            while upto < len(pieces) and (upto == at or total + len(pieces[upto]) <= PLACES):
                total += len(pieces[upto])
                upto += 1
            np.maximum.at(best, of[at:upto], self.pool(pieces[at:upto])[1])
            at = upto
        return self.dense(best)[2]

    def score(self, xs: list[np.ndarray]) -> np.ndarray:
        if not len(xs):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(xs) + self.shift, -30, 30)))


def fit(xs: list[np.ndarray], y: np.ndarray, epochs: int = 12, seed: int = 3) -> Network:
    """The network with the least log loss, by Adam over shuffled batches."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 3 * SIZE, FILTERS)), rng.normal(0, 0.3, (FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN))
    names = ["filters", "w1", "b1", "w2", "b2"]
    first, second, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for low in range(0, len(xs), 64):
            rows = order[low : low + 64]
            flat, best, place = net.pool([xs[r] for r in rows])
            pooled, hidden, z = net.dense(best)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            d_hidden = np.outer(g, net.w2) * (hidden > 0)
            d_pooled = (d_hidden @ net.w1.T) * (pooled > 0)
            d_filters = np.zeros_like(net.filters)
            for k in range(WIDTH):
                np.add.at(d_filters[k], (flat[place + k], np.arange(FILTERS)[None]), d_pooled)
            grads = {"filters": d_filters, "w1": pooled.T @ d_hidden, "b1": d_hidden.sum(0), "w2": hidden.T @ g, "b2": g.sum()}
            t += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                setattr(net, k, getattr(net, k) - 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8))
    return net


def calibrate(net: Network, xs: list[np.ndarray], y: np.ndarray, kinds: np.ndarray, recall: float = RECALL) -> Network:
    """Scale and shift by logistic regression on held-out findings, then for each kind the highest threshold with that recall.

    A kind with fewer than 1 / (1 - recall) held-out secrets takes the threshold of all.
    """
    z = net.logits(xs)
    a, b = 1.0, 0.0
    for _ in range(300):
        g = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y
        a, b = a - 0.05 * float((g * z).mean() + 0.01 * (a - 1)), b - 0.05 * float(g.mean())
    net.scale, net.shift = max(a, 0.05), b
    p = net.score(xs)

    def least(of: np.ndarray) -> float | None:
        good = np.sort(p[of & (y == 1)])
        return float(good[int((1 - recall) * len(good))]) if len(good) * (1 - recall) >= 1 else None

    every = least(np.ones(len(y), dtype=bool))
    every = 1.0 if every is None else every
    found = [least(kinds == k) for k in range(len(KINDS))]
    net.thresholds = tuple(every if t is None else t for t in found)
    return net


def made_up(n: int = MADE, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """text, start, end, label of made-up findings: half are secrets of common formats, half are look-alikes.

    A secret may stand late in a long path, or be told by what comes after it.
    """
    rng = random.Random(seed)
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    b64, low, word = string.ascii_letters + string.digits + "+/", string.ascii_lowercase, ["alpha", "report", "user", "final", "data", "section", "image", "build", "draft", "version"]
    names = ["pwd", "auth", "credential", "private_key", "access_key", "bearer", "client_secret", "auth_token", "api-key"]
    out = []
    for k in range(n):
        if k % 2:
            body = rng.choice([
                lambda: "ghp_" + some(string.ascii_letters + string.digits, 36),
                lambda: "sk-" + some(string.ascii_letters + string.digits, rng.randint(20, 48)),
                lambda: "xoxb-" + some(string.digits, 11) + "-" + some(string.ascii_letters + string.digits, 24),
                lambda: some(b64, rng.randint(24, 44)) + "=" * rng.randint(0, 2),
                lambda: "eyJ" + some(b64, rng.randint(30, 60)),
                lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
                lambda: some("0123456789abcdef", rng.choice([32, 40, 64])),
            ])()
            if rng.random() < 0.15:
                body = "/" + "/".join(rng.choice(word) for _ in range(rng.randint(3, 30))) + "/" + body
            lead = rng.choice(["", "", rng.choice(names) + rng.choice(["=", ": ", ' = "', "='"])])
        else:
            body = rng.choice([
                lambda: "-".join([*rng.sample(word, 4), str(rng.randint(1, 2030))]),
                lambda: "_".join([*rng.sample(word, 3), str(rng.randint(1, 99)), "copy"]),
                lambda: "/" + "/".join([*(rng.choice(word) for _ in range(rng.randint(4, 30))), str(rng.randint(1990, 2030))]),
                lambda: some(low, rng.randint(16, 24)) + str(rng.randint(1, 9)) * rng.randint(1, 3),
                lambda: some(string.digits, 4) + "-" + some(string.digits, 2) + "-" + some(string.digits, 2) + "T" + some(string.digits, 6) + "-event",
                lambda: "abc123" * rng.randint(4, 6),
                lambda: "x" * rng.randint(15, 30) + "1",
                lambda: "page" + str(rng.randint(1, 9)) + "=" * rng.randint(16, 30),
            ])()
            lead = rng.choice(["", "see ", "file ", "in ", "of the "])
        before = " ".join(rng.choice(word) for _ in range(3)) + " "
        text = before + lead + body + " " + rng.choice(word)
        out.append((text, len(before + lead), len(before + lead + body), k % 2))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, findings: int = SAMPLE_FINDINGS) -> Network:
    """The network from made-up findings and those of about sample_docs documents (chosen by a hash of their text).

    In the documents the patterns' secrets are labelled 1; of other tokens, those with few distinct
    characters are labelled 0, and the rest are left out, as nothing settles them. findings bounds those of
    documents, by a hash of them; ones of more than PLACES characters are not trained on.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, label = [], [], []
            for text in b.column(0).to_pylist():
                base = base_spans(text)
                for start, kind, end in base:
                    at.append(coded(text, start, end))
                    kinds.append(kind)
                    label.append(1)
                for start, end in tokens(text):
                    if not any(s < end and start < e for s, _, e in base) and len(set(text[start:end])) <= 8:
                        at.append(coded(text, start, end))
                        kinds.append(3)
                        label.append(0)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in at], pa.binary()), pa.array(kinds, pa.int32()), pa.array(label, pa.int32())], names=["x", "kind", "y"])

    seen = some.mapInArrow(look, "x binary, kind int, y int").where(F.length("x") <= 2 * PLACES).dropDuplicates()
    real = seen.orderBy(F.xxhash64("x"), "y", "kind").limit(findings).toArrow()
    made = made_up()
    xs = [*(np.frombuffer(v, np.uint16) for v in real["x"].to_pylist()), *(coded(t, s, e) for t, s, e, _ in made)]
    y = np.array([*real["y"].to_pylist(), *(m[3] for m in made)], dtype=float)
    kinds = np.array([*real["kind"].to_pylist(), *[3] * len(made)])
    held = np.random.default_rng(11).random(len(xs)) < 0.25
    net = fit([x for x, h in zip(xs, held) if not h], y[~held])
    return calibrate(net, [x for x, h in zip(xs, held) if h], y[held], kinds[held])


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the tokens that overlap none of them: start, kind number, end."""
    base, covered = base_spans(text), bytearray(len(text))
    for s, _, e in base:
        covered[s:e] = b"\1" * (e - s)
    return base, [(s, 3, e) for s, e in tokens(text) if 1 not in covered[s:e]]


def judged(texts: list[str], net: Network) -> list[list[tuple[int, int, int, bool, bool]]]:
    """For each text start, kind number, end, whether base, whether the network takes it for a secret: base spans, and what it adds.

    The candidates of several texts are scored together.
    """
    found, xs, out = [candidates(t) for t in texts], [], []
    for t, (base, more) in zip(texts, found):
        xs += [coded(t, s, e) for s, _, e in base + more]
    score, at = net.score(xs), 0
    for base, more in found:
        rows = []
        for n, (s, k, e) in enumerate(base + more):
            yes = bool(score[at] >= net.thresholds[k])
            at += 1
            if n < len(base) or yes:
                rows.append((s, k, e, n < len(base), yes))
        out.append(sorted(rows))
    return out


def secrets(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, starts, kinds, ends, base, sure of all spans of each row of docs: arrays in order of start, then kind.

    All candidates are scored. base: the patterns found it, and it stays whatever its score; sure: its score
    reaches the threshold of its kind. Null and empty texts have none; rows that repeat a doc_id are each
    returned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 64):
                part = b.slice(low, 64)
                rows = judged([t.as_py() or "" for t in part.column(1)], sent.value)
                cols = [pa.array([[x[k] for x in r] for r in rows], pa.list_(t)) for k, t in enumerate([pa.int32()] * 3 + [pa.bool_()] * 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "starts", "kinds", "ends", "base", "sure"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(look, f"doc_id {of}, starts array<int>, kinds array<int>, ends array<int>, base array<boolean>, sure array<boolean>")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (all), n_added, n_sure (by the network) of each document."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    found = secrets(docs, train(docs)).withColumn("x", F.arrays_zip("starts", "kinds", "ends", "base", "sure"))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    named = f"transform(x, s -> concat_ws(':', element_at({kinds}, s.kinds + 1), s.starts, s.ends))"
    base = f"transform(filter(x, s -> s.base), s -> concat_ws(':', element_at({kinds}, s.kinds + 1), s.starts, s.ends))"
    counts = [F.expr(f"cast(size(filter(x, s -> s.base and s.kinds = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.expr(base), ","), 256).alias("base_sha256"), F.array_join(F.expr(named), ",").alias("spans"), F.expr("cast(size(filter(x, s -> not s.base)) as long)").alias("n_added"), F.expr("cast(size(filter(x, s -> s.sure)) as long)").alias("n_sure"))
