"""Near duplicates without any chance of a loss: the trees are made to miss most pairs. Rounds and archives by bounded means."""

import numpy as np
import pyarrow as pa
import pytest

from veilink.llm import common, line_dedup, near_dedup, packing, parts, warc


@pytest.mark.parametrize("part, whole", [(4, 5), (85, 100)])
@pytest.mark.parametrize("least", [1, 10, 60, 300, 2000])
def test_similar_sets_share_a_key(part, whole, least):
    rng = np.random.default_rng(least)
    for _ in range(200):
        n = int(least * rng.uniform(1, 1.3))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(rng.integers(0, (whole - part) * n // whole + 1))  # as few shared ones as the threshold allows
        kept = a[rng.permutation(n)[drop:]]
        b = np.unique(np.append(kept, rng.integers(0, 2**64, max(0, (whole * len(kept) // part) - n), dtype=np.uint64)))
        assert whole * len(kept) >= part * (n + len(b) - len(kept))
        assert len(np.intersect1d(parts.set_keys(a, part, whole), parts.set_keys(b, part, whole)))
        table, at = np.stack([parts.bins(a), parts.bins(b)]), np.array([0])
        assert parts.may_be_similar(np.array([len(a), len(b)]), table, at, at + 1, part, whole).all()


@pytest.mark.parametrize("whole", [True, False])
def test_pairs_that_trees_miss(spark, monkeypatch, tmp_path, whole):
    monkeypatch.setattr(near_dedup, "trees_for", lambda *a: 1)
    monkeypatch.setattr(near_dedup, "least_agreeing", lambda *a: 64)
    if not whole:  # so that a candidate group, and nodes by parts, are too large for a task
        for name, value in (("GROUP_ROWS", 32), ("SMALL", 32), ("SMALL_SETS", 8), ("CHUNK_ROWS", 4), ("PIVOTS", 1), ("TREES_AT_ONCE", 99), ("MAX_LEVELS", 12)):
            monkeypatch.setattr(near_dedup, name, value)
        monkeypatch.setattr(near_dedup, "GROWTH", 0.01)
    texts = []
    for i in range(120):  # pairs of 0.85 to 0.86 that share no word with others
        words = [f"w{i}x{k}" for k in range(202)]
        texts += [" ".join(words[:187]), " ".join(words[15:])]
    core = [f"core{i}" for i in range(165)]  # and a chain of them
    texts += [" ".join(core + [f"c{j}" for j in range(12 * i, 12 * i + 18)]) for i in range(150)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts[:2]]
    assert 0.85 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.86
    out = near_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "docs")), 3, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i - i % 2 if i < 240 else 240 for i in range(len(texts))}


def test_a_round_has_no_more_tasks_than_ranges(spark):
    """The review's run with 211 partitions spent its time on empty tasks."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        runs = [(packing.PIECE, n, 3, 0, 0, 0, 0) for n in range(1, 2000, 7)] + [(packing.GAP, 2048 - n, 2, 2 * n, 0, 0, 0) for n in range(5, 2000, 9)]
        after = packing._swept(spark.createDataFrame(runs, packing._RUN).coalesce(1), 2048, 1)
        assert after.rdd.getNumPartitions() <= 2 * packing.RANGES
        assert after.filter(f"kind <> {packing.GAP}").groupBy().sum("n").first()[0] == 3 * len(range(1, 2000, 7))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("payloads", [True, False])
def test_archives_are_read_in_bounded_batches(spark, tmp_path, payloads):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 500) for i in range(1500)], "page_id long, url string, html string").coalesce(1)
    manifest, _ = warc.write_warc(pages, str(tmp_path / "archives"), common.Workspace(spark, "test"))
    ranges = pa.RecordBatch.from_pylist([r.asDict() for r in manifest.collect()])
    sent = list(warc._read(warc.qualified(spark, str(tmp_path / "archives")), payloads)([ranges]))
    assert sum(b.num_rows for b in sent) == 1500 and max(b.num_rows for b in sent) <= warc.ROWS_AT_ONCE
    assert max(b.nbytes for b in sent) < 2 * warc.SENT_BYTES
    assert all(b.column("payload").null_count == (0 if payloads else b.num_rows) and not b.column("digest").null_count for b in sent)


def test_distances_of_many_lengths_take_few_batches(monkeypatch):
    rng, calls, inner = np.random.default_rng(5), [], line_dedup._distances
    monkeypatch.setattr(line_dedup, "_distances", lambda *a: calls.append(len(a[0])) or inner(*a))
    pairs = []
    for n in range(70, 2000, 6):
        a = list(map(str, rng.integers(0, 10, n)))
        b = a.copy()
        for at in rng.integers(0, n, n // (8 if n % 4 else 16)):
            b[at : at + 1] = [["x"], [], ["y", "z"]][rng.integers(3)]
        pairs.append(("".join(a), "".join(b)))
    most = np.array([max(map(len, p)) // 10 for p in pairs])
    got, want = line_dedup.edit_distances(pairs, most), np.array([line_dedup.edit_distance(*p) for p in pairs])
    assert ((got == want) | ((got > most) & (want > most))).all() and (want <= most).any() and (want > most).any()
    assert (line_dedup.edit_distances(pairs) == want).all()
    assert len(calls) <= 40 and sum(calls) > len(pairs)  # before: numbers of words with fewer than 16 pairs went one by one
