"""Secret scanning in DataFrame functions, with a random forest that removes false positives.

A candidate is a run of at least 16 key characters with a digit in it. The forest sees its length, the transitions between
character classes, how much of it dictionary words cover, the document's path, and the neighbouring words. It is trained on
labelled findings; by default on generated ones (``labelled_findings``), a fixed number that SQL functions derive from row numbers.
Everything runs in the JVM: no Python function sees a row.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, text_or_empty

#: Generated labelled findings that the forest is trained on by default.
FINDINGS = 4000
TREES, DEPTH, SEED = 40, 8, 17
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9])[A-Za-z0-9+/=_-]{16,}+"
_BEFORE, _AFTER = 80, 40

# Words that key names hold, words that name other long strings, words of test material, and a dictionary.
_KEY_WORDS = "key|token|secret|passwd|password|pwd|auth|credential|bearer|apikey|signature|private"
_OTHER_WORDS = "sha|sha1|sha256|md5|commit|checksum|digest|hash|uuid|guid|isbn|etag|integrity|revision|order|invoice|serial|build|version|image|base64|card|phone"
_TEST_WORDS = "test|example|sample|fixture|mock|dummy|demo|spec"
_DICTIONARY = (
    "the and for that with this from have not are was were you your all any can had her his one our out day get has him how man new now old see two way who "
    "did its let put say she too use about after again also back because been before being between both came come could each even find first found give good "
    "great hand here high home house into just keep know large last left life like line little long look made make many may mean might more most much must name "
    "need never next night number only open other over own part people place point read right said same school second should show side small some something "
    "sound still such take tell than their them then there these they thing think three through time turn under until very want water well went what when where "
    "which while will word work world would write year data file user list table image page index value content style class script link title test example"
)

FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "hex_only", "digits_only", "runs", "runs_share", "distinct", "distinct_share", "vowels", "covered",
    "known_prefix", "key_before", "assigned", "quoted", "other_before", "test_near", "test_path", "path_depth", "digits_before", "words_before", "longest_letters",
)


def _count(text: Column, kept: str) -> Column:
    """How many characters of ``text`` are in the class ``kept``."""
    return F.length(F.regexp_replace(text, f"[^{kept}]", "")).cast("double")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``uid, id, path, start, candidate, before, after`` for every candidate; ``start`` in code points."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), path.alias("path"), text_or_empty(text_col).alias("text"))
    found = rows.filter(F.col("text").rlike(CANDIDATE)).select(
        "uid", "id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("m"), F.split("text", CANDIDATE, -1).alias("g")
    )
    each = F.expr(
        f"transform(m, (x, i) -> struct(x AS candidate, length(g[i]) AS gap, right(g[i], {_BEFORE}) AS before, left(g[i + 1], {_AFTER}) AS after))"
    )
    apart = found.select("uid", "id", "path", F.posexplode(each).alias("pos", "x")).select("uid", "id", "path", "pos", "x.*")
    so_far = Window.partitionBy("uid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.col("gap") + F.length("candidate")).over(so_far) - F.length("candidate")
    return apart.select("uid", "id", "path", start.alias("start"), "candidate", "before", "after")


def with_features(found: DataFrame) -> DataFrame:
    """The candidates with a double column for each of ``FEATURES``."""
    c = F.col("candidate")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "-"), "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "B")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    n = F.length(c).cast("double")
    distinct = F.size(F.array_distinct(F.split(F.lower(c), ""))).cast("double")
    words = "|".join(sorted({w for w in _DICTIONARY.split() if len(w) > 2}, key=lambda w: (-len(w), w)))
    covered = (n - F.length(F.regexp_replace(F.lower(c), f"(?:{words})", ""))) / n
    before = F.regexp_replace(F.lower("before"), r"[^\p{L}0-9=:'\"]+", " ")
    near = F.concat_ws(" ", before, F.lower("after"))
    said = lambda text, pattern: text.rlike(pattern).cast("double")
    values = {
        "length": n, "digits": _count(c, "0-9"), "upper": _count(c, "A-Z"), "lower": _count(c, "a-z"), "symbols": _count(c, "+/=_-"),
        "hex_only": said(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"), "digits_only": said(c, "^[0-9]+$"), "runs": runs, "runs_share": runs / n, "distinct": distinct,
        "distinct_share": distinct / n, "vowels": _count(F.lower(c), "aeiou") / n, "covered": covered,
        "known_prefix": said(c, "^(?:AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk_live_|sk-|eyJ|AIza|glpat-|npm_)"),
        "key_before": said(before, rf"(?:{_KEY_WORDS})[^a-z]*(?:[a-z]+ ){{0,2}}[\W_]*$"), "assigned": said(before, r"(?:=|:)\s*['\"]?\s*$"),
        "quoted": said(before, r"['\"]\s*$"), "other_before": said(before, rf"\b(?:{_OTHER_WORDS})\b[^a-z]*(?:[a-z]+ )?[\W_]*$"),
        "test_near": said(near, rf"\b(?:{_TEST_WORDS})"), "test_path": said(F.lower("path"), rf"(?:{_TEST_WORDS})"),
        "path_depth": F.size(F.split("path", "/")).cast("double"), "digits_before": _count(before, "0-9"),
        "words_before": F.size(F.split(F.trim(before), " +")).cast("double"),
        "longest_letters": F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), lambda x: F.length(x))).cast("double"),
    }
    return found.withColumns({f"f_{k}": values[k] for k in FEATURES})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``doc_id, text, source, label``: generated findings, half of them secrets. Every value follows from the row number."""
    r = F.col("id")
    digest = lambda salt, kind=F.sha1: kind(F.concat_ws(":", F.lit(salt), r).cast("binary"))
    blob = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit("b"), r), 384))), "=", "")
    pick = lambda salt, *options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), (F.pmod(F.xxhash64(F.lit(salt), r), F.lit(len(options))) + 1).cast("int"))
    prose = pick("w", "the value was set in", "as they said before the", "and there is one more of", "en la de los que", "und der die nicht", "", "over here with", "then the other on")
    tail = pick("t", " and then the rest.", "\n", " of it", "; more", ", which", "")
    name = pick("k", "token", "api_key", "secret", "password", "auth_token", "access key", "private_key", "client_secret", "Bearer", "apiKey")
    sign = pick("s", ' = "', ": ", "=", ' := "', ": '", " ", ' => "', '&&& =### "', '*** =*** "')
    value = pick(
        "v", digest("v"), F.substring(digest("v"), 1, 32), blob, F.substring(blob, 1, 40), F.concat(F.lit("AKIA"), F.upper(F.substring(digest("a"), 1, 16))),
        F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(blob, "[+/]", "x"), 1, 36)), F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(blob, "[+/]", "q"), 1, 24)), F.sha2(digest("v").cast("binary"), 256),
    )
    secret = F.concat(prose, F.lit(" "), name, sign, value, pick("q", '"', "", "'", "###"), tail)
    joint = pick("j", "-", "_", "/")
    year = F.substring(F.conv(F.substring(digest("n"), 1, 12), 16, 10), 1, 4)
    long_word = F.concat(pick("x1", "about", "people", "world", "content"), joint, pick("x2", "after", "number", "school"), joint, pick("x3", "image", "page", "value"), joint, year)
    uuid = F.regexp_replace(F.substring(digest("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    plain = F.concat(
        prose, F.lit(" "),
        pick(
            "n", F.concat(pick("h", "sha1 ", "commit ", "checksum: ", "digest sha256 ", "etag: ", "revision ", "md5 "), digest("h")), F.concat(F.lit("id "), uuid), uuid, long_word,
            F.lpad(F.substring(F.conv(F.substring(digest("c"), 1, 15), 16, 10), 1, 16), 16, "4"), F.concat(F.lit("order "), F.lpad(F.substring(F.conv(F.substring(digest("o"), 1, 15), 16, 10), 1, 18), 18, "7")),
            F.concat(F.lit("data:image/png;base64,"), blob), F.concat(pick("y", "example token = ", "test password: ", "sample key "), F.lit("1234567890abcdef1234")),
            F.concat(F.lit("version "), F.lit("2024-01-02-build-"), F.substring(digest("r"), 1, 7)), digest("p"),
        ),
        tail,
    )
    path = pick("p", "src/app/config.py", "src0", "tests/fixtures/data.json", "docs/readme.md", "src7", "www/index.html", "")
    return spark.range(n).select(r.alias("doc_id"), F.when(r % 2 == 0, secret).otherwise(plain).alias("text"), path.alias("source"), (r % 2 == 0).cast("double").alias("label"))


def fit(findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", label_col: str = "label") -> RandomForestClassificationModel:
    """A forest from labelled findings: texts whose every candidate has the row's label (1 for a secret)."""
    rows = with_features(candidates(findings, id_col, text_col, path_col)).join(findings.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")), "id")
    made = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(rows).select("features", "y")
    return RandomForestClassifier(labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, featureSubsetStrategy="onethird").fit(made.coalesce(1))


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: ``<id_col>, start, end, candidate_sha256, score, secret``.

    ``start`` and ``end`` (exclusive) count code points. A null text counts as empty and has no candidates; a null path
    is empty. Null and repeated ids keep their candidates apart, row by row. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = with_features(candidates(docs, id_col, text_col, path_col))
    made = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(rows)
    scored = model.transform(made).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        F.col("id").alias(id_col), "start", (F.col("start") + F.length("candidate")).alias("end"), F.sha2("candidate", 256).alias("candidate_sha256"),
        F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("secret"),
    )


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), fit(labelled_findings(spark)))
