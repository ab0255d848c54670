"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the sum of its own hashed vector and of those of its character grams (prefixes and 4-grams of its
UTF-8 bytes). Two GRUs read a window of ``WINDOW`` words in both directions; attention pools their states; a logistic
unit scores the window. Windows overlap and cover the whole text; the document's score is the calibrated highest one.

Training uses a bounded sample of labelled documents, ``PER_CLASS`` of each label at most, the first by a hash of their
ids. Which window of a document carries its label is unknown: each epoch takes the one that scores highest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, lean, table, text_or_empty
from .shingles import mix

WINDOW, STRIDE = 48, 40
#: Labelled documents of each class that training takes at most.
PER_CLASS = 1000
DIM, HIDDEN, BUCKETS, EPOCHS = 12, 10, 1 << 15, 9
#: Words whose inputs a scoring task keeps; others are computed when they occur.
KEPT_WORDS = 150_000
#: Windows scored together.
TOGETHER = 2048
_U = np.uint64
_ENDS = ".,;:!?|\"'()[]{}<>*#%&$-_~`/\\=+"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, gram buckets of all words in one row, first gram of each word). A word has at least one gram."""
    raw = [w.strip(_ENDS).encode("utf-8", "surrogatepass") or b"\0" for w in words]
    sizes = np.array([len(r) for r in raw])
    starts = np.cumsum(sizes) - sizes
    b = np.frombuffer(b"".join(raw) + b"\0\0\0", np.uint8).astype(np.uint64)
    n = len(b) - 3
    four = mix(b[:n] | b[1 : n + 1] << _U(8) | b[2 : n + 2] << _U(16) | b[3 : n + 3] << _U(24))
    at = np.arange(n) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - at
    letters = mix(b[:n] + _U(1)) * (mix(at.astype(np.uint64)) | _U(1))
    total = np.cumsum(letters, dtype=np.uint64)
    before = np.repeat(np.where(starts > 0, total[starts - 1], _U(0)), sizes)
    prefix = mix(total - before + _U(0x51ED2701))
    word = (prefix[starts + sizes - 1] >> _U(20)) % _U(BUCKETS)
    # a word's own 4-grams, then its prefixes of 3 to 9 bytes; the first byte's gram always counts
    keep_four = (left >= 4) | (at == 0)
    keep_prefix = (at >= 2) & (at <= 8)
    owner = np.repeat(np.arange(len(raw)), sizes)
    owners = np.concatenate((owner[keep_four], owner[keep_prefix]))
    values = np.concatenate((four[keep_four] % _U(BUCKETS), (prefix[keep_prefix] >> _U(7)) % _U(BUCKETS)))
    order = np.argsort(owners, kind="stable")
    first = np.searchsorted(owners[order], np.arange(len(raw)))
    return word.astype(np.int64), values[order].astype(np.int64), first


def window_starts(n: int) -> list[int]:
    """Every word is in a window; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """All parameters by name; inputs of the two directions are stacked in the last axis."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"word": f(BUCKETS, DIM, scale=0.05), "gram": f(BUCKETS, DIM, scale=0.05), "out": f(2 * HIDDEN, scale=0.3), "bias": np.float32([-1.0]), "look": f(2 * HIDDEN, scale=0.3)}
        for d in "fb":
            self.p |= {f"W{d}": f(DIM, 3 * HIDDEN, scale=0.4), f"U{d}": f(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.calibration = (1.0, 0.0)

    def inputs(self, words: list[str]) -> np.ndarray:
        word, gram, first = grams(words)
        counts = np.diff(np.append(first, len(gram)))
        return self.p["word"][word] + np.add.reduceat(self.p["gram"][gram], first, axis=0) / np.sqrt(counts)[:, None].astype(np.float32)

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((x @ self.p[f"W{d}"] + self.p[f"c{d}"]).astype(np.float32) for d in "fb")

    def _states(self, gates: np.ndarray, mask: np.ndarray, U: np.ndarray, steps, keep: list | None = None) -> np.ndarray:
        """States (step, window, hidden) of one direction. gates(t): inputs' part of the gates at step t."""
        h = np.zeros((mask.shape[1], HIDDEN), np.float32)
        out = np.zeros((mask.shape[0], mask.shape[1], HIDDEN), np.float32)
        for t in steps:
            g = gates(t)
            rz = _sigmoid(g[:, : 2 * HIDDEN] + h @ U[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ U[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, r, z, n))
            h = (z * h + (1 - z) * n) * mask[t][:, None]
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray):
        s = np.tanh(states) @ self.p["look"]
        s = np.where(mask > 0, s, -1e9)
        e = np.exp(s - s.max(axis=0)) * mask
        a = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, states)
        return pooled @ self.p["out"] + self.p["bias"][0], a, pooled

    def score(self, ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Logits of windows: ids (window, step) are rows of the projected tables, -1 after the end."""
        out = []
        for a in range(0, len(ids), TOGETHER):
            part = np.ascontiguousarray(ids[a : a + TOGETHER].T)
            mask = (part >= 0).astype(np.float32)
            steps = range(len(part))
            both = [self._states(lambda t, T=T: T[part[t]], mask, self.p[f"U{d}"], order) for d, T, order in (("f", tables[0], steps), ("b", tables[1], reversed(steps)))]
            out.append(self.pool(np.concatenate(both, axis=2), mask)[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean logistic loss; that of the inputs is for the rows of x."""
        p, part = self.p, np.ascontiguousarray(ids.T)
        mask, steps, g = (part >= 0).astype(np.float32), range(ids.shape[1]), {}
        tables, kept, both = self.projected(x), {"f": [], "b": []}, []
        for d, T, order in (("f", tables[0], steps), ("b", tables[1], reversed(steps))):
            both.append(self._states(lambda t, T=T: T[part[t]], mask, p[f"U{d}"], order, kept[d]))
        states = np.concatenate(both, axis=2)
        logits, a, pooled = self.pool(states, mask)
        dl = ((_sigmoid(logits) - y) / len(y)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * p["out"]
        da = np.einsum("bh,tbh->tb", dpool, states)
        ds = a * (da - (a * da).sum(axis=0))
        th = np.tanh(states)
        g["look"] = np.einsum("tb,tbh->h", ds, th)
        dstates = a[:, :, None] * dpool + ds[:, :, None] * (1 - th * th) * p["look"]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            U, dh = p[f"U{d}"], np.zeros((ids.shape[0], HIDDEN), np.float32)
            gU, gT = np.zeros_like(U), np.zeros_like(tables[k])
            for t, h, r, z, n in reversed(kept[d]):
                dh = (dh + dstates[t][:, k * HIDDEN : (k + 1) * HIDDEN]) * mask[t][:, None]
                dn = dh * (1 - z) * (1 - n * n)
                drh = dn @ U[:, 2 * HIDDEN :].T
                drz = np.concatenate((drh * h * r * (1 - r), dh * (h - n) * z * (1 - z)), axis=1)
                gU[:, 2 * HIDDEN :] += (r * h).T @ dn
                gU[:, : 2 * HIDDEN] += h.T @ drz
                dgate = np.concatenate((drz, dn), axis=1)
                live = part[t] >= 0
                np.add.at(gT, part[t][live], dgate[live])
                dh = dh * z + drh * r + drz @ U[:, : 2 * HIDDEN].T
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = gU, x.T @ gT, gT.sum(axis=0)
            dx += gT @ p[f"W{d}"].T
        return g, dx


def _in_blocks(net: Network, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of all windows, ``TOGETHER`` at a time: the states of all at once would take the driver's memory."""
    tables = net.projected(x)
    return np.concatenate([net.score(ids[a : a + TOGETHER], tables) for a in range(0, len(ids), TOGETHER)] or [np.zeros(0, np.float32)])


def _grams_in_blocks(words: list[str], size: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grams`` of all words, some at a time."""
    parts, at = [], 0
    for a in range(0, len(words), size):
        word, gram, first = grams(words[a : a + size])
        parts.append((word, gram, first + at))
        at += len(gram)
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3


def _inputs_in_blocks(net: Network, word: np.ndarray, gram: np.ndarray, first: np.ndarray, counts: np.ndarray, size: int = 10_000) -> np.ndarray:
    """The inputs of all words, some at a time; one row of zeros where there are none."""
    out = np.zeros((max(1, len(word)), DIM), np.float32)
    for a in range(0, len(word), size):
        own = slice(a, a + size)
        low, high = first[a], first[own][-1] + counts[own][-1]
        out[own] = net.p["word"][word[own]] + np.add.reduceat(net.p["gram"][gram[low:high]], first[own] - low, axis=0) / np.sqrt(counts[own])[:, None].astype(np.float32)
    return out


def train(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(texts):
        return net
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int64) for t in texts]
    word, gram, first = _grams_in_blocks(list(number))
    counts = np.diff(np.append(first, len(gram)))
    owner = np.repeat(np.arange(len(first)), counts)
    # the first input starts as the smoothed log-odds of documents with the word or gram
    for name, of in (("word", lambda d: word[d]), ("gram", lambda d: np.concatenate([gram[first[i] : first[i] + counts[i]] for i in d]) if len(d) else d)):
        seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for d, y in zip(docs, toxic):
            seen[int(y)][np.unique(of(np.unique(d)))] += 1
        rate = [(s + 0.5) / (n + 1) for s, n in zip(seen, np.bincount(toxic.astype(int), minlength=2))]
        sure = (seen[0] + seen[1]) / (seen[0] + seen[1] + 4)
        net.p[name][:, 0] = np.clip(np.log(rate[1] / rate[0]) * sure, -2, 2) * (0.5 if name == "gram" else 1)
    ids, of = windows(docs)
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        x = _inputs_in_blocks(net, word, gram, first, counts)
        scores = _in_blocks(net, ids, x) if epoch else np.array([x[w[w >= 0], 0].clip(0).sum() if (w >= 0).any() else 0 for w in ids])
        best = np.array([g[np.argmax(scores[g])] for g in of])
        order = rng.permutation(len(best))
        weight = len(toxic) / (2 * max(1, toxic.sum())), len(toxic) / (2 * max(1, (1 - toxic).sum()))
        for a in range(0, len(order), 100):
            rows = order[a : a + 100]
            used, local = np.unique(ids[best[rows]], return_inverse=True)
            local = local.reshape(len(rows), -1)
            skip = int(used[0] == -1)
            used, local = used[skip:], local - skip
            if not len(used):
                continue
            grams_of = np.concatenate([gram[first[i] : first[i] + counts[i]] for i in used])
            c = counts[used]
            share = np.repeat(1 / np.sqrt(c), c)[:, None].astype(np.float32)
            x = net.p["word"][word[used]] + np.add.reduceat(net.p["gram"][grams_of] * share, np.cumsum(c) - c, axis=0)
            g, dx = net.gradients(local, x.astype(np.float32), toxic[rows])
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], word[used], dx)
            np.add.at(g["gram"], grams_of, np.repeat(dx, c, axis=0) * share)
            step += 1
            rate = 0.02 * (1 - epoch / EPOCHS) + 0.002
            for k, v in net.p.items():
                m, s = adam[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    x = _inputs_in_blocks(net, word, gram, first, counts)
    scores = _in_blocks(net, ids, x)
    net.calibration = platt(np.array([scores[g].max() for g in of]), toxic)
    return net


def platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic calibration, by Newton steps with targets smoothed as Platt has them."""
    ones, zeros = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a = np.stack([logits, np.ones_like(logits)], axis=1).astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, a.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
    return float(w[0]), float(w[1])


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids of all windows (-1 after the end), and the windows of each document; a text without words has an empty one."""
    starts = [window_starts(len(d)) for d in docs]
    ids = np.full((sum(map(len, starts)), WINDOW), -1, dtype=np.int64)
    of, at = [], 0
    for d, s in zip(docs, starts):
        for a in s:
            piece = d[a : a + WINDOW]
            ids[at, : len(piece)] = piece
            at += 1
        of.append(np.arange(at - len(s), at))
    return ids, of


class Scorer:
    """Scores texts; keeps the projected inputs of the first ``KEPT_WORDS`` distinct words."""

    def __init__(self, net: Network):
        self.net, self.number, self.used = net, {}, 0
        self.tables = [np.zeros((KEPT_WORDS + 1, 3 * HIDDEN), np.float32) for _ in "fb"]

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        number, fresh = self.number, {}
        docs = []
        for words in split:
            ids = [number.get(w, -2) for w in words]
            if -2 in ids:
                ids = [i if i != -2 else KEPT_WORDS + fresh.setdefault(w, len(fresh)) for i, w in zip(ids, words)]
            docs.append(np.array(ids, dtype=np.int64))
        tables = self.tables
        if fresh:
            new = self.net.projected(self.net.inputs(list(fresh)))
            tables = [np.concatenate((t[:KEPT_WORDS], n)) for t, n in zip(tables, new)]
            room = min(KEPT_WORDS - self.used, len(fresh))
            for t, n in zip(self.tables, new):
                t[self.used : self.used + room] = n[:room]
            for w in list(fresh)[:room]:
                number[w] = self.used
                self.used += 1
        ids, of = windows(docs)
        logits = self.net.score(ids, tables)
        a, b = self.net.calibration
        return _sigmoid(a * np.maximum.reduceat(logits, [g[0] for g in of]) + b).astype(float) if of else np.zeros(0)


def _score(net: Network):
    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            out, group, size = [], [], 0
            for t in texts:
                group.append(t)
                size += len(t)
                if size > 2_000_000:
                    out.append(scorer(group))
                    group, size = [], 0
            if group:
                out.append(scorer(group))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(out) if out else [], pa.float64())], ["id", "score"])

    return run


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Train on labelled documents that are not held out: at most ``PER_CLASS`` of each label, first by a hash of the id.

    Without usable labels the network stays as it starts, with one class alone it leans to that class: such scores mean little.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).distinct()
    chosen = None
    for y in (0, 1):
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = sorted(((r["id"], r["y"], r["text"]) for r in texts.join(F.broadcast(chosen), "id").collect()), key=lambda r: r[:2])
    try:
        return train([r[2] for r in rows], np.array([r[1] for r in rows], dtype=np.float32))
    finally:
        free_memory()  # else the driver keeps the peak of the training


def toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, held_out, score, predicted``.

    A null text counts as empty and has the network's score of no words. Null ids pass through and are not held out;
    repeated ids keep rows of their own. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(_score(net)), f"id {kind}, score double").select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, net: Network, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The input rows and columns, without the rows that score at least ``threshold``; a null text counts as empty."""
    position = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            texts = [t or "" for t in batch.column(position).to_pylist()]
            scores = [scorer(texts[a : a + 500]) for a in range(0, len(texts), 500)]
            yield batch.take(pa.array(np.flatnonzero(np.concatenate(scores or [np.zeros(0)]) < threshold), pa.int64()))

    return docs.mapInArrow(lean(run), docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
