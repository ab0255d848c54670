"""Near duplicates, lines, tokens and the pipeline against brute force on a small fixture."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from veilink.llm import line_dedup, near_dedup, packing, pii, tokens, toxicity, word_bpe


@pytest.fixture(scope="module")
def texts():
    source = random.Random(8)
    word = lambda: "".join(source.choice("abcdefghij") for _ in range(source.randint(3, 8)))
    bases = [[[word() for _ in range(12)] for _ in range(source.randint(2, 6))] for _ in range(6)]
    out = []
    for base in bases:
        for _ in range(30):
            lines = [[w if source.random() > 0.01 else word() for w in line] for line in base]
            out.append("\n".join(" ".join(x) for x in lines))
    return out + out[:5] + ["mail me at a.b@c.org now", "x"]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pairs") / "documents.parquet")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return spark.read.parquet(path)


class Groups:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


@pytest.mark.parametrize("whole", [True, False])
def test_near_duplicates(docs, texts, monkeypatch, whole):
    if not whole:  # so that large groups and nodes occur
        for name, value in (("SMALL", 8), ("GROUP_ROWS", 8), ("SMALL_SETS", 16), ("CHUNK_ROWS", 8), ("PIVOTS", 2), ("MAX_LEVELS", 1), ("TREES_AT_ONCE", 99)):
            monkeypatch.setattr(near_dedup, name, value)
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))})
    groups = Groups(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                groups.join(i, j)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 3, 85, 100).collect()}
    assert got == {i: (len(s), groups.find(i), groups.find(i) == i) for i, s in enumerate(sets)}
    assert near_dedup.keep_one(docs, 3, 85, 100).count() == len({groups.find(i) for i in range(len(texts))})


@pytest.mark.parametrize("whole", [True, False])
def test_lines(docs, texts, monkeypatch, whole):
    """Groups by edit similarity alone, without the operator's blocks and SimHashes."""
    if not whole:  # so that blocks and groups too large for a task occur
        for name, value in (("SMALL", 6), ("GROUP_ROWS", 6), ("SMALL_TEXTS", 8), ("CHUNK_ROWS", 8), ("PIVOTS", 2), ("MAX_LEVELS", 1)):
            monkeypatch.setattr(line_dedup, name, value)
    places: dict[str, list] = {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            places.setdefault(line_dedup.normalise(line), []).append((i, k))
    lines = list(places)
    groups = Groups(len(lines))
    for i, a in enumerate(lines):
        for j in range(i):
            if groups.find(i) != groups.find(j) and line_dedup.similar(a, lines[j]):
                groups.join(i, j)
    members: dict[int, list] = {}
    for i, x in enumerate(lines):
        members.setdefault(groups.find(i), []).extend(places[x])
    want = {p: (*min(m), len(m), p == min(m)) for m in members.values() for p in m}
    assert {(r.doc_id, r.line): (r.keep_id, r.keep_line, r.group_lines, r.kept) for r in line_dedup.line_groups(docs).collect()} == want


def test_tokens(docs, texts):
    tk = word_bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rows = word_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    for r in rows.collect():
        ids = tk.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (bytes(r.ids), r.decoded) == (np.array(ids, "<u4").tobytes(), tk.decode(ids, skip_special_tokens=False))
    few = docs.sparkSession.createDataFrame([(1, [320, 2, 999_999]), (2, []), (3, None)], "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in word_bpe.decode(few, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert got == {1: tk.decode([320, 2], skip_special_tokens=False), 2: "", 3: None}


def test_packed_sequences(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.best_fit_pack(docs, path, 128, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 512 for r in rows)
    pieces = sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece))
    lone = sorted(packing.best_fit_pack(docs, path, 128).collect(), key=lambda r: (r.doc_id, r.piece))
    assert [r[:5] for r in lone] == [r[:5] for r in pieces] and {r.sequence_id for r in lone} == set(range(len(rows)))
    tk = tokens.byte_bpe(path).exact  # each piece against the library, and gapless in its sequence
    at = {}
    for i, t in enumerate(texts):
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        own = [r for r in pieces if r.doc_id == i]
        assert [r.start for r in own] == [0, *range(len(ids) % 128 or 128, len(ids), 128)][: len(own)] and sum(r.length for r in own) == len(ids)
        for r in own:
            want = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert bytes(r.ids) == want and r.ids_crc32 == zlib.crc32(want)
    for r in lone:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([n for _, n in sorted(parts)], initial=0))[:-1] and sum(n for _, n in parts) <= 128
    best: list[int] = []  # best-fit decreasing, one piece after another
    for r in sorted(pieces, key=lambda r: -r.length):
        fits = [g for g in best if g >= r.length]
        if fits:
            best.remove(min(fits))
        best.append((min(fits) if fits else 128) - r.length)
    assert len(rows) <= 1.02 * len(best) + 1


def test_pii_rows(spark):
    """The base rules against the contract's patterns, and the digest of their spans."""
    texts = [
        "a.b+c@d-e.fr x@y, 10.0.0.255 and 256.1.1.1, 1.2.3.4.5 +49 (30) 123456 +1", "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559", "@@ a@b.c.d@e.f " + "9" * 5000 + ".1.1.1", "", None,
        "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 x 0000001.002.03.4", "ü é 4111111111111111é a@b.co\u2028",
    ]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda t: re.sub("[^0-9]", "", t)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 16 <= len(digits(t)) <= 19 and luhn(digits(t))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 8 <= len(digits(t)) <= 15),
    ]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_text=True).collect()}
    for i, t in enumerate(texts):
        want = [(k, *m.span()) for k, pattern, ok in rules for m in re.finditer(pattern, t or "") if ok(m[0])]
        assert [got[i][f"n_{k}"] for k, *_ in rules] == [sum(w[0] == k for w in want) for k, *_ in rules]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [x.split(":") for x in got[i].spans.split(",") if x]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= {":".join(x) for x in spans}
        assert spans == sorted(spans, key=lambda x: ([r[0] for r in rules].index(x[0]), int(x[1]), int(x[2])))
        assert all((t or "")[int(a) : int(b)] not in got[i].redacted or int(b) - int(a) < 3 for _, a, b in spans)


def test_pipeline_stages(spark, docs, texts, monkeypatch, tmp_path):
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: toxicity.Network())
    kept = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    net = toxicity.Network()
    scores = toxicity.Scorer(net)(texts)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, s in enumerate(scores) if s < 0.5]
    lines = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    gone = {(r.doc_id, r.line) for r in line_dedup.line_groups(docs).collect() if not r.kept}
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)}
    assert {i: (r.text, r.n_chars) for i, r in lines.items()} == {i: (t, len(t)) for i, t in left.items() if t}
    redacted = {r.doc_id: r.text for r in corpus_pipeline.redact(spark, docs, "").collect()}
    assert redacted[len(texts) - 2] == "mail me at [EMAIL] now" and redacted[0] == texts[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "pii", "packing"]
    with pytest.raises(Exception, match="(?i)not exist|no such file"):  # the next stage has begun
        kept_of_lines = corpus_pipeline.drop_lines(spark, docs, "")
        corpus_pipeline.drop_near_duplicates(spark, docs, "")
        kept_of_lines.collect()


ODD = [(1, None, "en"), (2, "", None), (3, " \n\t", "en"), (None, "no id at all\nsecond line", "de"), (4, "same words\nin two rows", "en"), (5, "same words\nin two rows", "en"), (5, "same words\nin two rows", "en"), (6, "x" * 1_000_000, "en"), (7, "a.b@c.org 10.0.0.1", "en")]


def test_pipeline_edges(spark, monkeypatch, tmp_path):
    """Nulls, blank and repeated rows, one token of a million letters, an empty table, clashing columns."""
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: toxicity.Network())
    monkeypatch.setattr(toxicity.Scorer, "__call__", lambda self, texts: np.zeros(len(texts)))
    rows = [(i, t, lang, "s", len(t) if t else None, "u", "g") for i, t, lang in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __uid string, __gone string").write.parquet(str(tmp_path / "0"))
    docs, counts = spark.read.parquet(str(tmp_path / "0")), []
    empty = docs.filter("doc_id = -1")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k + 1)))
        docs = spark.read.parquet(str(tmp_path / str(k + 1)))
        counts.append(docs.count())
        if name == "line_dedup":
            got = sorted(((r.doc_id, r.text if r.doc_id != 6 else len(r.text)) for r in docs.collect()), key=repr)
            assert got == sorted([(1, None), (2, ""), (3, " \n\t"), (None, "no id at all\nsecond line"), (4, "same words\nin two rows"), (6, 1_000_000), (7, "a.b@c.org 10.0.0.1")], key=repr)
        if name == "pii":
            assert {r.text for r in docs.filter("doc_id = 7").collect()} == {"[EMAIL] [IP]"} and docs.filter("text IS NULL").count() == 1
    assert counts[:4] == [9, 7, 7, 7] and docs.filter("doc_id = 6").agg({"length": "sum"}).first()[0] > 2048


def test_edit_distances_of_like_sizes_share_steps(monkeypatch):
    """Texts of 100 to 600 characters fall into nine numbers of words; few batches hold them, and distances stay exact."""
    rng, calls, one = random.Random(5), [], line_dedup._distances
    monkeypatch.setattr(line_dedup, "_distances", lambda *args: calls.append(args[2]) or one(*args))
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(100, 600)))
        b = list(a)
        for at in (0, len(a) - 1, *rng.sample(range(len(a)), 12)):
            b[at] = "z"
        pairs.append((a, "".join(b)))
    got = line_dedup.edit_distances(pairs)
    assert got.tolist() == [line_dedup.edit_distance(a, b) for a, b in pairs]
    assert 0 < len(calls) <= 6


def test_gram_keys_are_the_least_of_each_line():
    """Each key is the least masked hash of the line's own grams, whatever lines stand beside it; of equal grams the first place counts."""
    lines = [b"exactly twelv"[:12], b"the same words again, the same words again, the same words", "größe über alles — und übergröße".encode()]
    alone = [line_dedup.gram_keys([x])[0].tolist() for x in lines]
    assert line_dedup.gram_keys(lines).tolist() == alone
    assert line_dedup.gram_keys(lines[::-1]).tolist() == alone[::-1]
    repeated = line_dedup.gram_keys([b"abcdefghijkl" * 4])[0] & np.uint64(0xFFFF)
    assert (repeated < 12).all()
