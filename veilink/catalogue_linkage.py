"""Further named queries, each with its SQL over the same relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import CONF, EDGES, K, M, PAIRS, candidates, edges, filters, filters_sql, matrix_groups, names, nodes_of, pair_counts, pairs, parts, query, read, rounded
from .functions import bits, scalars
from .functions import similarity as S
from .functions.qgrams import RECORD_PAD, padded_count, qgram_list
from .operators import blocking, compare, encode, graph, grouped, match, metrics, prep, regress, transfer

# ---- preparation ------------------------------------------------------------------------------------------------


@query("prepared_columns", "SELECT label_::VARCHAR AS key, coalesce(text, '-') AS text, coalesce(doc_id::VARCHAR, '-') AS doc_id FROM (SELECT doc_id, text, coalesce(lang, '-') AS label_ FROM documents)")
def _(spark, d):
    docs = read(spark, d, "documents").select("text", "source", "doc_id", "lang")
    return prep.last_to_front(prep.fill_nulls(prep.at_positions(docs, [0, 2, 3]), "-"), "key")


@query("scalar_functions", """SELECT p_partkey, (p_retailprice::BIGINT)::VARCHAR AS price, ceil(p_size / 7 * 20) / 20.0::DOUBLE AS rating, round(exp(-abs(p_size - 25) / 4.0::DOUBLE) / 8.0::DOUBLE, 9) AS density,
    (((p_size + p_partkey % 50) / 2.0::DOUBLE) > 25)::INTEGER AS over FROM (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part)""")
def _(spark, d):
    size = F.col("p_size").cast("double")
    return read(spark, d, "part").select(
        "p_partkey", scalars.integer_text(F.floor("p_retailprice").cast("double").cast("string")).alias("price"), scalars.half_rating(size / 7).alias("rating"),
        F.round(scalars.laplace_density(size, 25.0, 4.0), 9).alias("density"), scalars.mean_over([size, (F.col("p_partkey") % 50).cast("double")], 25.0).alias("over"),
    )


_PART_AT = "('0x' || substr(md5({0} || '|t'), 1, 7))::BIGINT < {1}"


@query("train_test_split", f"SELECT o_orderkey, CASE WHEN {_PART_AT.format('o_orderkey', int(0.75 * 16**7))} THEN 'train' ELSE 'test' END AS part FROM orders")
def _(spark, d):
    train, test = prep.hash_split(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.75)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _draw(pool: str, n: int, seed: str) -> str:
    return f"(SELECT id FROM {pool} ORDER BY md5(id || '|{seed}'), id LIMIT {n})"


@query("populated_samples", f"""WITH a AS (SELECT DISTINCT c_custkey AS id FROM customer), b AS (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT s_suppkey + 1000000 FROM supplier),
    both_ AS (SELECT id FROM a INTERSECT SELECT id FROM b), x AS (SELECT id FROM a EXCEPT SELECT id FROM b UNION SELECT id FROM (SELECT id FROM b EXCEPT SELECT id FROM a)),
    m AS {_draw('both_', 10, 's')}, ra AS (SELECT id FROM m UNION SELECT id FROM {_draw('x', 30, 'sa')}), rb AS (SELECT id FROM m UNION SELECT id FROM {_draw('x', 30, 'sb')})
    SELECT 'a' AS side, id FROM ra JOIN a USING (id) UNION ALL SELECT 'b', id FROM rb JOIN b USING (id) UNION ALL SELECT 'gold', id FROM ra JOIN rb USING (id)""")
def _(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    b = read(spark, d, "orders").select(F.col("o_custkey").alias("id")).unionByName(read(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"))).distinct()
    left, right, gold = prep.populate(a, b, prep.linkage_sample(a, b, "id", 40, 0.25, only_from_both=True), "id")
    side = lambda df, name, column="id": df.select(F.lit(name).alias("side"), F.col(column).alias("id"))
    return side(left, "a").unionByName(side(right, "b")).unionByName(side(gold, "gold", "id1"))


# ---- encodings --------------------------------------------------------------------------------------------------


@query("padded_qgrams", "SELECT p_partkey, (length(p_name) + 1)::INTEGER AS n, (SELECT string_agg(substr('$' || p_name || '$', i, 2), ',' ORDER BY i) FROM range(1, length(p_name) + 2) t(i)) AS grams FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", padded_count(F.length("p_name")).cast("int").alias("n"), F.array_join(qgram_list(F.col("p_name"), 2, RECORD_PAD), ",").alias("grams"))


@query("hash_counts", "SELECT greatest(1, round_even(ln(2) * 100 / avg(length(p_name) + 1), 0))::INTEGER AS k, max(length(p_name) + 1)::INTEGER AS most FROM part")
def _(spark, d):
    part = read(spark, d, "part")
    grams = qgram_list(F.col("p_name"), 2, RECORD_PAD)
    most = part.agg(F.max(F.size(grams)).cast("int").alias("most"))
    return most.select(F.lit(blocking.hash_count(100, encode.mean_qgrams(part, grams))).alias("k"), "most")


_ORDER = encode.permutation(2 * M, 7)
_WHOLE = f"list_concat(pos, list_transform(list_filter(range({M}), lambda p: NOT list_contains(pos, p)), lambda p: p + {M}))"


@query("balanced_filters", f"WITH {filters_sql('double')} SELECT id, array_to_string(list_sort(list_transform({_WHOLE}, lambda p: ({_ORDER})[p + 1])), ',') AS balanced FROM filters")
def _(spark, d):
    return filters(spark, d).select("id", F.array_join(F.transform(bits.balanced(F.col("pos"), M, _ORDER), lambda p: p.cast("string")), ",").alias("balanced"))


@query("filter_members", f"WITH {filters_sql('double')} SELECT id, list_has_all(pos, [1, 5]) AS has, (len(list_intersect(pos, [1, 5, 9]))::DOUBLE / len(list_distinct(list_concat(pos, [1, 5, 9])))) AS alike FROM filters")
def _(spark, d):
    asked, other = (F.array(*[F.lit(p) for p in x]) for x in ((1, 5), (1, 5, 9)))
    h = F.size(F.array_intersect("pos", other))
    return filters(spark, d).select("id", bits.contains(F.col("pos"), asked).alias("has"), S.set_hamming(h, F.size("pos"), F.lit(3)).alias("alike"))


# the attribute and the position behind each bit of the record filter
_MAP = encode.record_map([M, M], [M // 2, M // 2])


def _attribute_filters() -> str:
    parts = [filters_sql("double").replace("p_name", f"lower(trim({c}))").replace("recs AS", f"recs{i} AS").replace("FROM recs", f"FROM recs{i}").replace("grams AS", f"grams{i} AS").replace("FROM grams", f"FROM grams{i}")
             .replace("hashes AS", f"hashes{i} AS").replace("FROM hashes", f"FROM hashes{i}").replace("places AS", f"places{i} AS").replace("JOIN places", f"JOIN places{i}").replace("filters AS", f"filters{i} AS") for i, c in enumerate(("p_name", "p_brand"))]
    return ",\n".join(parts)


@query("record_bloom", f"""WITH {_attribute_filters()} SELECT id, array_to_string(list_filter(range({M}), lambda t: list_contains(CASE WHEN ({[a for a, _ in _MAP]})[t + 1] = 0 THEN a.pos ELSE b.pos END, ({[p for _, p in _MAP]})[t + 1])), ',') AS positions
    FROM filters0 a JOIN filters1 b USING (id)""")
def _(spark, d):
    coded = encode.encode(read(spark, d, "part"), "p_partkey", encode.EncodeSpec("rbf", ("p_name", "p_brand"), m=M, k=K))
    return coded.select("id", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


# ---- comparison and blocking ------------------------------------------------------------------------------------


@query("compared_candidates", f"""WITH {filters_sql('double')}, c AS (SELECT a.id AS id1, b.id AS id2, len(list_intersect(x.pos, y.pos)) AS h, len(x.pos) AS n1, len(y.pos) AS n2, (a.nm = b.nm)::INTEGER AS is_match
      FROM recs a JOIN recs b ON a.blk = b.blk JOIN filters x ON x.id = a.id JOIN filters y ON y.id = b.id)
    SELECT id1, id2, round(2::DOUBLE * h / (n1 + n2), 6) AS dice, round(h::DOUBLE / (n1 + n2 - h), 6) AS jaccard, round(h::DOUBLE / least(n1, n2), 6) AS overlap,
      round(1 - least(n1 - h, n2 - h)::DOUBLE / {M}, 6) AS hamming, round(1 - abs(ln(n1::DOUBLE) - ln(n2::DOUBLE)), 6) AS entropy, is_match, only_gold FROM c, (SELECT unnest([false, true]) AS only_gold) WHERE is_match = 1 OR NOT only_gold""")
def _(spark, d):
    groups = matrix_groups(spark, d).withColumn("is_match", F.coalesce("is_match", F.lit(0)))
    each = rounded(groups, *transfer.METRICS).withColumn("only_gold", F.explode(F.expr("if(is_match = 1, array(false, true), array(false))")))
    return grouped.expanded(each, ordered=False)


@query("blocks_of_both_sides", """WITH a AS (SELECT substr(c_mktsegment, 1, 2) || substr(c_nationkey::VARCHAR, 1, 2) AS k, c_custkey AS node FROM customer), b AS (SELECT substr('AUTO', 1, 2) || substr(s_nationkey::VARCHAR, 1, 2) AS k, s_suppkey AS node FROM supplier)
    SELECT DISTINCT a.node AS node1, b.node AS node2 FROM a JOIN b USING (k)""")
def _(spark, d):
    a = blocking.blocks_by(read(spark, d, "customer"), "prefix", "c_custkey", ["c_mktsegment", "c_nationkey"])
    b = blocking.blocks_by(read(spark, d, "supplier").withColumn("seg", F.lit("AUTO")), "prefix", "s_suppkey", ["seg", "s_nationkey"])
    return blocking.shared_blocks(a, b)


@query("blocking_quality", f"""WITH {EDGES}, g AS (SELECT src AS id1, dst AS id2 FROM edges WHERE sim >= 0.5), c AS (SELECT a.node AS id1, b.node AS id2 FROM nodes a, nodes b WHERE substr(a.node, 1, 2) = substr(b.node, 1, 2))
    SELECT count(*) AS gold, count(c.id1) AS found, round(count(c.id1)::DOUBLE / count(*), 6) AS completeness FROM g LEFT JOIN c USING (id1, id2)""")
def _(spark, d):
    n = blocking.prefix_blocks(names(spark, d), ["node"], 2)
    gold = edges(spark, d).filter("sim >= 0.5").select(F.col("src").alias("id1"), F.col("dst").alias("id2"))
    return rounded(blocking.pair_completeness(blocking.candidate_pairs(n, n, "node", "node"), gold), "completeness")


@query("one_block", "SELECT count(DISTINCT n_name) AS nodes, 1::BIGINT AS blocks FROM nation")
def _(spark, d):
    return blocking.blocks_by(read(spark, d, "nation"), "none", "n_name", []).agg(F.count_distinct("node").alias("nodes"), F.count_distinct("blk_key").alias("blocks"))


_ENTROPY = "(1 + coalesce((SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*)::DOUBLE AS n, length({0})::DOUBLE AS t FROM (SELECT unnest(string_split({0}, '')) AS c) GROUP BY c)), 0))"


@query("compression_distance", f"""WITH {PAIRS}, e AS (SELECT id1, id2, {_ENTROPY.format('v1')} AS a, {_ENTROPY.format('v2')} AS b, {_ENTROPY.format('(v1 || v2)')} AS c FROM pairs)
    SELECT id1, id2, round(1 - (c - least(a, b)) / greatest(a, b), 6) AS entropy_ncd FROM e""")
def _(spark, d):
    scores = lambda s, t: {"entropy_ncd": F.round(compare.entropy_distance(f"v{s}", f"v{t}"), 6)}
    return grouped.expanded(grouped.group_pairs(parts(spark, d), "p_partkey", "blk", "p_name", lambda v: {}, scores))


# ---- classification ---------------------------------------------------------------------------------------------


@query("first_matches", f"WITH {PAIRS}, r AS (SELECT id1, id2, is_match, row_number() OVER (ORDER BY id1, id2) AS n FROM pairs WHERE is_match = 1) SELECT id1, id2, is_match FROM r WHERE n <= 20 UNION ALL SELECT id1, id2, is_match FROM pairs WHERE is_match = 0")
def _(spark, d):
    return transfer.first_matches(pairs(spark, d), 20, ["id1", "id2"]).select("id1", "id2", "is_match")


@query("prefixed_quality", f"""WITH {PAIRS}, c AS (SELECT count(*) FILTER (dice > 0.5 AND is_match = 1) AS tp, count(*) FILTER (dice > 0.5 AND is_match = 0) AS fp, count(*) FILTER (dice <= 0.5 AND is_match = 1) AS fn, count(*) FILTER (dice <= 0.5 AND is_match = 0) AS tn FROM pairs)
    SELECT round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS s2_precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS s2_recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS s2_f1,
      round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS s2_accuracy, tn + fn AS predicted_0, tp + fp AS predicted_1, tn + fp AS actual_0, tp + fn AS actual_1 FROM c""")
def _(spark, d):
    q = metrics.quality(pairs(spark, d), (F.col("dice") > 0.5).cast("int"), "is_match", prefix="s2_")
    return rounded(q, "s2_precision", "s2_recall", "s2_f1", "s2_accuracy")


@query("merged_experiments", """WITH l AS (SELECT r_name AS scenario, r_regionkey AS a FROM region), r AS (SELECT r_name AS scenario, n_nationkey AS a, n_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0)
    SELECT l.scenario, l.a, r.a AS a_r, r.b FROM l LEFT JOIN r USING (scenario)""")
def _(spark, d):
    left = read(spark, d, "region").select(F.col("r_name").alias("scenario"), F.col("r_regionkey").alias("a"))
    right = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    right = right.select(F.col("r_name").alias("scenario"), F.when(F.col("n_nationkey") % 2 == 0, "pp").otherwise("x").alias("stage1_weight"), F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"))
    return metrics.merge_experiments(left, right, 2, "pp")


@query("sim_class_sample", f"""WITH {PAIRS}, c AS (SELECT id1, id2, CASE WHEN dice <= 0 OR dice > 1 THEN 'None' {' '.join(f"WHEN dice <= {i / 10}::DOUBLE THEN '{i - 1}-{i}'" for i in range(1, 11))} END AS sim_class FROM pairs)
    SELECT id1, id2, sim_class FROM c QUALIFY row_number() OVER (PARTITION BY sim_class ORDER BY md5(id1 || '|' || id2 || '|0'), id1, id2) <= 50""")
def _(spark, d):
    return regress.sample_per_class(pairs(spark, d), "dice", ["id1", "id2"], 50).select("id1", "id2", "sim_class")


@query("cosine_histogram", f"""WITH {PAIRS}, m AS (SELECT count(*) AS n FROM pairs WHERE is_match = 1), r AS (SELECT dice, row_number() OVER (ORDER BY md5(id1 || '|' || id2 || '|0'), id1, id2) AS k FROM pairs WHERE is_match = 0),
    x AS (SELECT 1 AS is_match, dice FROM pairs WHERE is_match = 1 UNION ALL SELECT 0, dice FROM r, m WHERE k <= 2 * n) SELECT is_match, round(dice, 3) AS value, count(*) AS n FROM x GROUP BY ALL""")
def _(spark, d):
    matches = pair_counts(spark, d, "is_match").filter("is_match = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return regress.cosine_histogram(pairs(spark, d), "dice", "is_match", ["id1", "id2"], 3, 2, n_matches=matches)


@query("adjusted_edges", f"""WITH {EDGES}, l AS (SELECT regr_slope(sim * sim, sim) AS a, regr_intercept(sim * sim, sim) AS b FROM edges) SELECT src, dst, round(sim * round(a, 6) + round(b, 6), 6) AS sim FROM edges, l WHERE sim * round(a, 6) + round(b, 6) >= 0.3""")
def _(spark, d):
    e = edges(spark, d)
    line = regress.simple_line(e.withColumn("s2", F.col("sim") * F.col("sim")), "sim", "s2").first()
    return rounded(regress.adjusted_edges(e, round(line["slope"], 6), round(line["intercept"], 6), 0.3), "sim")


@query("regression_quality", f"""WITH {PAIRS}, r AS (SELECT jaccard AS y, dice AS p FROM pairs WHERE dice > 0) SELECT round(1 - var_pop(y - p) / var_pop(y), 6) AS explained, round(min(abs(y - p)), 6) AS least, round(max(abs(y - p)), 6) AS largest, round(avg(abs(y - p)), 6) AS mean,
    round(stddev_pop(abs(y - p)), 6) AS deviation, round(avg((y - p) * (y - p)), 6) AS mse, round(avg((ln(1 + y) - ln(1 + p)) ** 2), 6) AS msle, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM r""")
def _(spark, d):
    return rounded(regress.regression_quality(pairs(spark, d), "dice", "jaccard"), "explained", "least", "largest", "mean", "deviation", "mse", "msle", "r2")


# ---- graphs -----------------------------------------------------------------------------------------------------


@query("merged_edges", f"WITH {EDGES}, e AS (SELECT dst AS a, src AS b, sim / 2 AS s FROM edges UNION ALL SELECT src, dst, sim FROM edges WHERE sim < 0.6 UNION ALL SELECT src, src, 1 FROM edges) SELECT least(a, b) AS src, greatest(a, b) AS dst, max(s) AS sim FROM e WHERE a <> b GROUP BY 1, 2")
def _(spark, d):
    e = edges(spark, d)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("sim") / 2).toDF("src", "dst", "sim")
    loops = e.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("sim"))
    return graph.add_edges(back.unionByName(e.filter("sim < 0.6")).unionByName(loops))


@query("linked_nodes", f"WITH {EDGES} SELECT node, freq FROM nodes WHERE node IN (SELECT u FROM near WHERE sim >= 0.6)")
def _(spark, d):
    n = read(spark, d, "part").groupBy(F.col("p_name").alias("node")).agg(F.count(F.lit(1)).cast("int").alias("freq"))
    return graph.without_singletons(n, edges(spark, d).filter("sim >= 0.6"))


@query("entity_pairs", f"""WITH {EDGES}, i AS (SELECT p_name AS node, p_partkey::VARCHAR AS id FROM part) SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, sim FROM edges JOIN i a ON a.node = src JOIN i b ON b.node = dst WHERE sim >= 0.7""")
def _(spark, d):
    n = graph.graph_nodes(read(spark, d, "part").withColumn("vals", F.array("p_name")), "p_name", "p_partkey", "vals")
    return graph.entity_pairs(n, edges(spark, d).filter("sim >= 0.7"))


@query("common_values", "WITH a AS (SELECT p_brand AS value, min(p_name) AS node_a FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_brand AS value, min(p_name) AS node_b FROM part WHERE p_size > 25 GROUP BY 1) SELECT value, node_a, node_b FROM a JOIN b USING (value)")
def _(spark, d):
    n = read(spark, d, "part").select(F.array(F.array("p_brand")).alias("org_vals"), F.col("p_name").alias("node"), "p_size")
    return graph.common_values(n.filter("p_size <= 25"), n.filter("p_size > 25"))


@query("graph_report", f"""WITH RECURSIVE {EDGES}, k AS (SELECT u, v FROM near WHERE sim >= 0.6), dg AS (SELECT u, count(*) AS n FROM k GROUP BY u), reach AS (SELECT DISTINCT u AS node, u AS r FROM k UNION SELECT k.u, reach.r FROM reach JOIN k ON k.v = reach.node),
    c AS (SELECT m, count(*) AS size FROM (SELECT node, min(r) AS m FROM reach GROUP BY node) GROUP BY m)
    SELECT 'nodes' AS measure, NULL::DOUBLE AS threshold, NULL::BIGINT AS value, count(*) AS n FROM nodes UNION ALL SELECT 'edges', NULL, NULL, count(*) FROM edges UNION ALL SELECT 'singletons', NULL, NULL, count(*) FROM nodes WHERE node NOT IN (SELECT u FROM near)
    UNION ALL SELECT 'node_freq', NULL, freq, count(*) FROM nodes GROUP BY freq UNION ALL SELECT 'edges_at', 0.6, NULL, count(*) FROM edges WHERE sim >= 0.6 UNION ALL SELECT 'degree', 0.6, n, count(*) FROM dg GROUP BY n
    UNION ALL SELECT 'components', 0.6, NULL, count(*) FROM c UNION ALL SELECT 'component_size', 0.6, size, count(*) FROM c GROUP BY size""")
def _(spark, d):
    return graph.graph_report(nodes_of(spark, d), edges(spark, d), [0.6])


@query("degree_buckets", f"""WITH {EDGES}, k AS (SELECT u, v FROM near WHERE sim >= 0.5), dg AS (SELECT u, floor(log2(count(*)) + 1e-12)::INTEGER AS b FROM near GROUP BY u),
    s AS (SELECT DISTINCT a.u, c.v FROM near a JOIN k c ON c.u = a.v WHERE c.v <> a.u), t AS (SELECT u, v FROM s ANTI JOIN k USING (u, v))
    SELECT 'degree_histo1' AS feature, k.u AS node, b AS bucket, count(*)::DOUBLE AS n FROM k JOIN dg ON dg.u = k.v GROUP BY k.u, b UNION ALL SELECT 'degree_histo2', t.u, b, count(*)::DOUBLE FROM t JOIN dg ON dg.u = t.v GROUP BY t.u, b""")
def _(spark, d):
    f = graph.neighbourhood_features(edges(spark, d), 0.5)
    columns = [c for c in f.columns if c.startswith("degree_histo")]
    long = f.select("node", *[F.col(f"`{c}`") for c in columns]).unpivot(["node"], [F.col(f"`{c}`") for c in columns], "column", "n").filter("n > 0")
    parts = F.split("column", "-")
    return long.select(parts[0].alias("feature"), "node", F.substring(parts[1], 2, 9).cast("int").alias("bucket"), "n")


_STEPS = f"""k AS (SELECT u, v FROM near WHERE sim >= 0.5), d AS (SELECT u, count(*) AS d FROM k GROUP BY u), n AS (SELECT count(*)::DOUBLE AS n FROM d)"""


@query("pagerank", f"""WITH RECURSIVE {EDGES}, {_STEPS}, r AS (SELECT d.u AS node, 1 / n AS x, 0 AS i FROM d, n UNION ALL SELECT k.v, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(x / d.d), any_value(i) + 1 FROM r JOIN k ON k.u = r.node JOIN d ON d.u = k.u, n WHERE i < 30 GROUP BY k.v)
    SELECT node, round(x, 8) AS pagerank FROM r WHERE i = 30""")
def _(spark, d):
    return rounded(graph.pagerank(edges(spark, d), 0.5), "pagerank", digits=8)


@query("eigenvector", f"""WITH RECURSIVE {EDGES}, {_STEPS}, a AS (SELECT u, v FROM k UNION ALL SELECT u, u FROM d), r AS (SELECT u AS node, 1::DOUBLE AS x, 0 AS i FROM d UNION ALL SELECT a.v, sum(x) / 32, any_value(i) + 1 FROM r JOIN a ON a.u = r.node WHERE i < 20 GROUP BY a.v),
    l AS (SELECT node, x FROM r WHERE i = 20) SELECT node, round(x / (SELECT sqrt(sum(x * x)) FROM l), 6) AS eigenvec_central FROM l""")
def _(spark, d):
    return rounded(graph.eigenvector(edges(spark, d), 0.5, 20), "eigenvec_central")


@query("closeness", f"""WITH RECURSIVE {EDGES}, {_STEPS}, w AS (SELECT u, u AS v, 0 AS l FROM d UNION SELECT w.u, k.v, l + 1 FROM w JOIN k ON k.u = w.v WHERE l < 63), f AS (SELECT u, v, min(l) AS l FROM w GROUP BY u, v)
    SELECT u AS node, round((count(*) - 1)::DOUBLE / sum(l) * (count(*) - 1) / (any_value(n) - 1), 6) AS closeness_central FROM f, n GROUP BY u""")
def _(spark, d):
    return rounded(graph.path_centralities(edges(spark, d), 0.5), "closeness_central").select("node", "closeness_central")


_FEATURES = """a AS (SELECT n_nationkey AS node, n_regionkey::DOUBLE / 4 AS x, length(n_name)::DOUBLE AS y, 1::DOUBLE AS z FROM nation), b AS (SELECT s_suppkey AS node, (s_nationkey % 3)::DOUBLE AS x, s_acctbal / 1000 AS y, 1::DOUBLE AS z FROM supplier)"""


def _features(spark, d):
    a = read(spark, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") / 4).alias("x"), F.length("n_name").cast("double").alias("y"), F.lit(1.0).alias("z"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 3).cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"), F.lit(1.0).alias("z"))
    return a, b


_ENDS = "e AS (SELECT " + ", ".join(f"least(1, min({c})) AS {c}_min, greatest(0, max({c})) AS {c}_max" for c in "xyz") + " FROM (SELECT * FROM a UNION ALL SELECT * FROM b))"


@query("feature_ranges", f"WITH {_FEATURES}, {_ENDS} SELECT * FROM e")
def _(spark, d):
    return graph.joint_range(list(_features(spark, d)), ["x", "y", "z"])


@query("normalised_features", f"WITH {_FEATURES}, {_ENDS} SELECT node, " + ", ".join(f"round(CASE WHEN {c}_max > {c}_min THEN ({c} - {c}_min) / ({c}_max - {c}_min) ELSE 0 END, 6) AS {c}" for c in "xyz") + " FROM b, e")
def _(spark, d):
    a, b = _features(spark, d)
    return rounded(graph.normalise(b, ["x", "y", "z"], graph.joint_range([a, b], ["x", "y", "z"])), "x", "y", "z")


@query("feature_deviations", f"WITH {_FEATURES} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(stddev_pop({c}), 6) AS deviation FROM b" for c in "xyz"))
def _(spark, d):
    return rounded(graph.feature_deviations(_features(spark, d)[1], ["x", "y", "z"]), "deviation")


@query("selected_features", f"""WITH {_FEATURES}, v AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, greatest((SELECT stddev_pop({c}) FROM a), (SELECT stddev_pop({c}) FROM b)) AS s" for c in 'xyz')}),
    r AS (SELECT variable, s, row_number() OVER (ORDER BY s DESC, variable) AS k FROM v) SELECT variable, s > 0 AS nonzero, k <= 1 AS first, s >= 0.5 AS from_half FROM r""")
def _(spark, d):
    a, b = _features(spark, d)
    chosen = [graph.selected_features(a, b, ["x", "y", "z"], mode) for mode in ("nonzero", 1, 0.5)]
    return spark.createDataFrame([(c, *(c in x for x in chosen)) for c in graph.selected_features(a, b, ["x", "y", "z"], "all")], "variable string, nonzero boolean, first boolean, from_half boolean")


@query("rare_vectors", f"WITH {_FEATURES} SELECT node FROM a QUALIFY count(*) OVER (PARTITION BY x, y, z) <= 2")
def _(spark, d):
    return graph.rare_vectors(_features(spark, d)[0], ["x", "y", "z"], 2).select("node")


@query("sorted_edge_differences", f"""WITH {EDGES}, l AS (SELECT u, list_reverse_sort(list(sim)) AS l FROM near GROUP BY u), p AS (SELECT a.u AS node1, b.u AS node2, a.l AS x, b.l AS y, least(len(a.l), len(b.l)) AS n FROM l a JOIN l b ON a.u < b.u)
    SELECT node1, node2, round(list_sum(list_transform(range(1, n + 1), lambda i: abs(x[i] - y[i]))) / n, 6) AS difference FROM p""")
def _(spark, d):
    lists = graph.both_ways(edges(spark, d)).groupBy("u").agg(F.collect_list("sim").alias("l"))
    both = lists.toDF("node1", "x").join(lists.toDF("node2", "y"), F.col("node1") < F.col("node2"))
    return both.select("node1", "node2", F.round(S.sorted_edge_difference(F.col("x"), F.col("y")), 6).alias("difference"))


# ---- matching ---------------------------------------------------------------------------------------------------

_NORM = ", ".join(f"(({c} - (SELECT min({c}) FROM conf)) / (SELECT max({c}) - min({c}) FROM conf)) AS {c}" for c in ("sim_conf", "degree_conf"))


@query("weighted_scores", f"""WITH {CONF}, z AS (SELECT qg, ba, cos_sim, {_NORM} FROM conf) SELECT qg, ba, weights, round(a * cos_sim + b * sim_conf + c * degree_conf, 6) AS score
    FROM z, (VALUES ('1/0/0', 1::DOUBLE, 0::DOUBLE, 0::DOUBLE), ('0/1/0', 0, 1, 0), ('0/0/1', 0, 0, 1), ('0.6/0.3/0.1', 0.6, 0.3, 0.1)) w(weights, a, b, c)""")
def _(spark, d):
    return rounded(match.weighted(match.normalised(match.confidences(candidates(spark, d), 0.3))), "score")


def greedy_sql(order: str) -> str:
    """One pair after another, with lists of the nodes that are taken."""
    return f"""s AS (SELECT src AS qg, dst AS ba, sim AS score, row_number() OVER (ORDER BY {order}) AS n FROM edges),
    g AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS qs, []::VARCHAR[] AS bs UNION ALL
      SELECT s.n, CASE WHEN list_contains(g.qs, s.qg) OR list_contains(g.bs, s.ba) THEN g.qs ELSE list_append(g.qs, s.qg) END, CASE WHEN list_contains(g.qs, s.qg) OR list_contains(g.bs, s.ba) THEN g.bs ELSE list_append(g.bs, s.ba) END FROM g JOIN s ON s.n = g.n + 1),
    f AS (SELECT unnest(qs) AS qg, unnest(bs) AS ba FROM g WHERE n = (SELECT max(n) FROM s))"""


@query("greedy_match", f"WITH RECURSIVE {EDGES}, {greedy_sql('sim DESC, src, dst')} SELECT qg, ba, score FROM f JOIN s USING (qg, ba)")
def _(spark, d):
    return match.greedy(candidates(spark, d).withColumnRenamed("cos_sim", "score"))


@query("stable_match", f"WITH RECURSIVE {EDGES}, {greedy_sql('sim DESC, src, dst')} SELECT qg, ba, score FROM f JOIN s USING (qg, ba)")
def _(spark, d):
    return match.stable(candidates(spark, d).withColumnRenamed("cos_sim", "score"))


@query("random_match", f"WITH RECURSIVE {EDGES}, {greedy_sql(chr(39).join(['md5(src || ', '|', ' || dst || ', '|42', ') DESC, src, dst']))} SELECT qg, ba, score FROM f JOIN s USING (qg, ba)")
def _(spark, d):
    return match.random_matching(candidates(spark, d).withColumnRenamed("cos_sim", "score"))


@query("bipartite_components", f"""WITH RECURSIVE {EDGES}, e AS (SELECT 'q:' || src AS q, 'b:' || dst AS b, src, dst, sim FROM edges WHERE sim >= 0.6), k AS (SELECT q AS u, b AS v FROM e UNION ALL SELECT b, q FROM e),
    reach AS (SELECT DISTINCT u AS node, u AS r FROM k UNION SELECT k.u, reach.r FROM reach JOIN k ON k.v = reach.node), c AS (SELECT node, min(r) AS component FROM reach GROUP BY node)
    SELECT src AS qg, dst AS ba, sim AS score, component FROM e JOIN c ON c.node = e.q""")
def _(spark, d):
    return match.bipartite_components(candidates(spark, d).withColumnRenamed("cos_sim", "score"), 0.6)


@query("edge_band_candidates", f"""WITH {EDGES}, b AS (SELECT DISTINCT x.node AS qg, y.node AS ba, 1 - (len(x.q) + len(y.q) - 2 * len(list_intersect(x.q, y.q)))::DOUBLE / 100 AS sim FROM nodes x JOIN nodes y ON substr(x.node, 1, 1) = substr(y.node, 1, 1)),
    t AS (SELECT u, max(sim) AS m, count(*) AS n, count(*) FILTER (sim >= 0.45) AS hi FROM near GROUP BY u) SELECT qg, ba, round(b.sim, 6) AS sim FROM b JOIN t x ON x.u = qg JOIN t y ON y.u = ba
    WHERE b.sim >= 0.8 AND y.m - x.m BETWEEN -0.05 AND 0.05 AND y.n >= x.hi AND x.n >= y.hi""")
def _(spark, d):
    n = names(spark, d).select(F.substring("node", 1, 1).alias("blk_key"), "node", F.array_distinct(qgram_list(F.col("node"))).alias("positions"))
    e = edges(spark, d)
    return rounded(match.compare_blocks_by_edges(n, n, e, e, 100, 0.8, 0.05, 0.05, 0.4), "sim")
