"""Building blocks against brute force, and held-out accuracy of the trained parts."""

import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from veilink.llm import common, golomb, line_dedup, near_dedup, packing, pii, queries, shingles, tokens, topk, toxicity, warc

DATA = "/root/testdata/sf0.01"


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60))
@settings(deadline=None)
def test_golomb_round_trip(values):
    values = np.array(sorted(values), dtype=np.uint64)
    assert (golomb.decode(golomb.encode(values)) == values).all()


def in_order(counts, capacity):
    """The rounds' outcome, one piece after another with a stack of gaps: the number of sequences."""
    left, gaps, used = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True), [], 0
    while left:
        large = sum(2 * s > capacity for s in left)
        opened = large or -(-sum(left) // capacity)
        gaps += [capacity - s for s in left[:opened]]
        left, used, moved = left[opened:], used + min(opened, len(left)), True
        while moved:
            stack, kept, rest, waiting, moved = [], [], [], sorted((g for g in gaps if g), reverse=True), False
            for s in left:
                while waiting and waiting[0] >= s:
                    stack.append(waiting.pop(0))
                if stack:
                    kept.append(stack.pop() - s)
                    moved = True
                else:
                    rest.append(s)
            left, gaps = rest, kept + stack + waiting
    return used


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan(spark, seed):
    source = random.Random(seed)
    counts = {source.randint(1, 64): source.randint(1, 50) for _ in range((1, 3, 12, 25, 60)[seed])}
    table = spark.createDataFrame(list(counts.items()), "length long, n long")
    places = [tuple(r) for r in packing.plan(table, 64, common.Workspace(spark, "test")).select("length", "low", "many", "sequence", "offset").collect()]
    used = in_order(counts, 64)
    for s, n in counts.items():  # every rank once
        assert sorted(r for t, low, many, *_ in places if t == s for r in range(low, low + many)) == list(range(n))
    fill: dict[int, list] = {}
    for s, _, n, q, o in places:
        for i in range(n):
            fill.setdefault(q + i, []).append((o, s))
    assert len(fill) == used
    for parts in fill.values():
        end = 0
        for o, s in sorted(parts):
            assert o == end
            end += s
        assert end <= 64
    got: dict[int, int] = {}
    for s, _, n, *_ in places:
        got[s] = got.get(s, 0) + n
    assert got == counts
    best = 0  # best-fit decreasing, one piece at a time
    gaps: list[int] = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(64 - s)
    best = len(gaps)
    assert used <= best * 1.2 + 1


@given(st.text(max_size=60))
@settings(deadline=None, max_examples=300)
def test_byte_bpe_equals_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = tokens.byte_bpe(path).exact.encode(text, add_special_tokens=False).ids
    assert tokens.byte_bpe(path).encode(text).tolist() == want


@pytest.mark.parametrize("text", ["a  b   c \n\n d\t e", "it's <|endoftext|> x", " \r\n é\xa0ü\x85 \x1c z", "ĀɏɐABC 1２3", ""])
def test_byte_bpe_cases(text):
    bpe = tokens.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.encode(text).tolist() == bpe.exact.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="abAB \t\né", max_size=40), st.integers(1, 4))
@settings(deadline=None)
def test_shingle_sets(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    want = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    (got,) = shingles.document_words([text])
    assert len(shingles.shingle_set(got, size)) == len(want)


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(12)]
    got = near_dedup.intersections(sets)
    assert all(got[i, j] == len(set(a) & set(b)) == shingles.common(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
@settings(deadline=None)
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert line_dedup.edit_distance(a, b) == row[-1]


@given(st.text(alphabet="ab1@.- +()", max_size=40))
@settings(deadline=None, max_examples=300)
def test_base_spans(text):
    got = pii.base_spans(text)
    assert got["email"] == [m.span() for m in pii._EMAIL.finditer(text)]
    assert got["phone"] == [m.span() for m in pii._PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_boosted_candidates():
    text = "please write to anna.berg [at] example [dot] org or tel (555) 123-4567; see version 1.2.3.4 and order 2024-01-02"
    base = pii.base_spans(text)
    added = [text[a:b] for _, a, b in pii.added_spans(text, base)]
    assert "anna.berg [at] example [dot] org" in added and "(555) 123-4567" in added and not any("2024" in x for x in added)
    assert pii.redact("x a@b.co y", [("email", 2, 8)]) == "x [EMAIL] y"
    rng = random.Random(99)
    trees, limits = pii.model()
    rows = [(k, true, pii.features(t, k, a, b)) for t, k, true in (pii._example(rng) for _ in range(1500)) for k2, a, b in pii.candidates(t) if k2 == k]
    p = trees.probability(np.array([r[2] for r in rows], dtype=float))
    said = np.array([q >= limits[r[0]] for q, r in zip(p, rows)])
    truth = np.array([r[1] for r in rows])
    assert (said & truth).sum() / said.sum() > 0.97 and (said & truth).sum() / truth.sum() > 0.6


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 300, (400, 16)))
    rows = rows[np.argsort(-np.sqrt((rows**2).sum(axis=1)), kind="stable")]
    norms = np.sqrt((rows**2).sum(axis=1))
    for q in np.floor(rng.normal(0, 300, (40, 16))):
        scores = rows @ q
        for threshold in (np.quantile(scores, 0.5), np.quantile(scores, 0.97)):
            left = topk.survivors(rows, norms, rows / norms[:, None], q, float(np.sqrt((q**2).sum())), float(threshold))
            assert set(np.flatnonzero(scores >= threshold)) <= set(left.tolist() if left is not None else [])
    assert topk.products(np.array([[2.0**40, 1.0]]), np.array([2.0**20, 3.0])).tolist() == [2**60 + 3]


def test_archive_frames():
    rows = [{"row": i, "url": "u", "digest": "0" * 64, "bytes": 5, "refers": None} for i in range(50)]
    records = [warc.record(r, b"<p>%d" % r["row"] + b"text " * 100, "crawl") for r in rows]
    frames, lead = warc.archive(records)
    assert frames[0][:4] == bytes.fromhex("5d2a4d18") and len(frames[0]) == lead and len(frames) == 51
    odd = warc.record({**rows[0], "url": "http://a/\r\nX: y\r\n\r\n\u2028é"}, b"12345", "crawl")
    assert warc.parse(odd)[0]["warc-target-uri"] == "http://a/%0D%0AX: y%0D%0A%0D%0A%E2%80%A8é" and "x" not in warc.parse(odd)[0]
    assert len({warc.record_id(run, 1) for run in ("a", "b")}) == 2
    headers, block = warc.parse(records[7])
    assert headers["warc-type"] == "response" and block.endswith(b"text ")


def test_toxicity_gradients_and_accuracy():
    net = toxicity.Network(1)
    rng = np.random.default_rng(2)
    ids, y = rng.integers(-1, 6, (4, 7)), np.array([1.0, 0, 1, 0], dtype=np.float32)
    ids = np.where(np.arange(7) < rng.integers(2, 8, 4)[:, None], np.maximum(ids, 0), -1)
    x = rng.normal(0, 1, (6, toxicity.DIM)).astype(np.float32)

    def loss():
        z = net.score(ids, net.projected(x)).astype(float)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g, dx = net.gradients(ids, x, y)
    for name, at in (("Uf", (2, 3)), ("Ub", (1, 25)), ("Wf", (0, 12)), ("look", (3,)), ("out", (11,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3
    rows = duckdb.sql(f"SELECT d.doc_id, d.text, l.toxic FROM '{DATA}/documents.parquet' d JOIN '{DATA}/labels.parquet' l USING (doc_id) ORDER BY 1").fetchall()
    held = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0]
    kept = [r for r in rows if r not in held]
    net = toxicity.train([r[1] for r in kept], np.array([r[2] for r in kept], dtype=np.float32))
    p = toxicity.Scorer(net)([r[1] for r in held])
    assert np.mean((p >= 0.5) == np.array([r[2] for r in held])) > 0.9


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    found = db.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
