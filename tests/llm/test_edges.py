"""Nulls, empty and repeated rows, ties, empty tables, clashing columns: defined results, no crash."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from veilink.llm import exact_dedup, line_dedup, near_dedup, packing, pii, secrets, topk, toxicity, warc, word_bpe

LONG = "word " * 3000
ROWS = [(1, None), (2, ""), (3, "the same words in two rows of it"), (4, "the same words in two rows of it"), (4, "the same words in two rows of it"), (None, "no id here"), (5, LONG), (6, " \n\t "), (7, "é ü 漢字 \U0001f600 <|endoftext|>  x"), (8, "w" * 1_000_000)]
BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    clash = ["id", "uid", "h", "norm", "sha", "keep_id", "rank", "node", "rep", "block", "score", "source"]
    df.withColumns({c: F.lit("x") for c in clash}).write.parquet(path)
    return spark.read.parquet(path)


NET = toxicity.Network()
OPERATORS = {
    "exact_dedup": exact_dedup.exact_dedup,
    "packing": lambda d: packing.best_fit_pack(d, BYTES),
    "word_bpe": lambda d: word_bpe.encode_decode(d, WORDS),
    "near_dedup": near_dedup.near_duplicates,
    "line_groups": line_dedup.line_groups,
    "dedup_lines": line_dedup.dedup_lines,
    "pii": lambda d: pii.find_pii(d, with_text=True),
    "toxicity": lambda d: toxicity.toxicity(d, NET),
}
PER_ROW = {"exact_dedup", "word_bpe", "near_dedup", "dedup_lines", "pii", "toxicity"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(docs, name):
    out = OPERATORS[name](docs).collect()
    if name in PER_ROW:
        assert len(out) == len(ROWS)
    if name == "exact_dedup":
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out]
        assert sorted(x for x in got if x[0] in (1, 2)) == [(1, 1, 2, True), (2, 1, 2, False)]
        assert sorted(x for x in got if x[0] in (3, 4)) == [(3, 3, 3, True), (4, 3, 3, False), (4, 3, 3, False)]
        assert (None, None, 1, True) in got
    if name == "near_dedup":
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out]
        assert {x for x in got if x[0] in (1, 2, 6)} == {(1, 0, 1, True), (2, 0, 2, True), (6, 0, 6, True)}
        assert {x[2:] for x in got if x[0] in (3, 4)} == {(3, True), (3, False)}
    if name == "packing":
        assert sum(r.doc_id in (1, 2) and (r.length, r.piece) == (1, 0) for r in out) == 2
        assert sum(r.doc_id == 5 for r in out) == 2 and max(r.length for r in out if r.doc_id == 5) == 2048
    if name == "word_bpe":
        bpe = word_bpe.tokenizer(WORDS)
        ids = [bpe.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
        assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in out) == sorted((str(i), len(x), bpe.decode(x, skip_special_tokens=False)) for (i, _), x in zip(ROWS, ids))
    if name == "pii":
        assert {(r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in out} == {(0, 0, 0, 0, "")}
        assert sorted((str(r.doc_id), r.redacted) for r in out) == sorted((str(i), t or "") for i, t in ROWS)
    if name == "toxicity":
        texts = [t or "" for _, t in ROWS]
        assert np.allclose(sorted(r.score for r in out), sorted(toxicity.Scorer(NET)(texts)), atol=1e-6)
        assert {str(r.doc_id): r.held_out for r in out} == {str(i): i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in ROWS}
    if name == "dedup_lines":
        assert out[0].__fields__ == docs.columns
        assert {(r.doc_id, r.text) for r in out if r.doc_id != 4} == {(i, t) for i, t in ROWS if i != 4}
        assert [r.text for r in out if r.doc_id == 4] == ["", ""]
    if name == "line_groups":
        assert sum(r.kept for r in out) == len({(r.keep_id, r.keep_line) for r in out})
        assert {r.doc_id for r in out if not r.kept} == {4}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.filter("doc_id = -1")).collect() == []


def test_secrets_edges(spark, docs):
    model = secrets.fit(secrets.labelled_findings(spark, 400))
    text = 'é token = "0123456789abcdef0123456789abcdef01234567" and commit 0123456789abcdef0123456789abcdef01234567'
    rows = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame([(9, text, None)], "doc_id long, text string, source string"))
    out = secrets.scan_secrets(rows, model).collect()
    assert [(text[r.start : r.end], r.candidate_sha256) for r in out] == [(m, hashlib.sha256(m.encode()).hexdigest()) for m in ["0123456789abcdef0123456789abcdef01234567"] * 2]
    assert [r.secret for r in sorted(out, key=lambda r: r.start)] == [True, False]
    assert secrets.scan_secrets(rows.filter("doc_id = -1"), model).collect() == []


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0], "x"), (3, None, "x"), (4, [float("nan"), 1.0], "x"), (5, [None, 1.0], "x"), (6, [], "x"), (None, [1.0, 0.0], "x"), (7, [float("inf"), 0.0], "x"), (100, [-1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, norm string")
    got = [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 1, one), (0, 2, 2, one), (0, 3, None, one), (100, 1, 6, 0), (100, 2, 0, -one), (100, 3, 1, -one)]
    assert topk.exact_top_k(df.filter("vec_id < 0"), F.col("vec_id") % 100 == 0).collect() == []


def test_warc_names_and_folders(spark, tmp_path):
    """Line breaks in urls, an empty table, clashing columns, folders without a scheme."""
    rows = [(1, "http://a/\r\nX: y\r\n\r\nz", "p" * 200, "r", "d"), (2, "\u2028\x00", "p" * 200, "r", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string, digest string")
    got = warc.warc_roundtrip(pages, str(tmp_path / "plain")).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got] == [(1, "response", None, 200), (2, "revisit", 1, 200)]
    assert list((tmp_path / "plain").glob("*.warc.zst"))
    assert warc.warc_roundtrip(pages.filter("page_id < 0")).collect() == []
    assert warc.qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and warc.filesystem(f"file:{tmp_path}")[1] == str(tmp_path)


def test_top_k_in_blocks(spark, monkeypatch, tmp_path):
    """Several blocks of queries against brute force."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    data = rng.normal(0, 1, (300, 8)).astype("float32")
    data[5] = data[6]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(4).write.parquet(str(tmp_path / "v"))
    got = topk.exact_top_k(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") % 10 == 0, 5).collect()
    ints = np.floor(1024 * data.astype(float)).astype(np.int64)
    want = set()
    for q in range(0, 300, 10):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in range(300) if i != q)[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_warc_edges(spark):
    page = "<html>" + "a" * 200
    rows = [(3, "u", page), (1, None, page), (1, "u", page), (None, "u", page), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short")]
    out = warc.warc_roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in out), key=repr)
    n = len(page)
    assert got == sorted([(3, n, "revisit", 1), (1, n, "response", None), (1, n, "revisit", 1), (0, n, "revisit", 1), (5, 0, "response", None), (6, 0, "response", None), (7, 5, "response", None), (8, 5, "response", None)], key=repr)
    assert {r.payload_digest for r in out if r.payload_bytes == n} == {hashlib.sha256(page.encode()).hexdigest()}
