"""Secret findings filtered by a random forest, in DataFrame and JVM ML functions only.

Patterns propose candidates (assigned values, provider keys, key headers, long random-looking
strings). A random forest judges each by its length, character transitions, dictionary coverage,
path and neighbouring words; it is trained on labelled findings, a bounded table of
``training_rows`` rows that is made here by rule unless one is given.

Offsets are code points, end exclusive. Null texts are empty, repeated rows are judged alone, extra
columns are ignored, an empty table gives no findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._work import materialise

#: Candidate patterns; a match ends with the value. Earlier kinds win overlaps.
PATTERNS = {
    "key_header": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "provider_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "assigned": r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{0,20}[_-])?(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?[A-Za-z0-9+/_.~-]{6,}+",
    "long_random": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{20,}+",
}
VALUE = r"([A-Za-z0-9+/_.~-]+)$"
#: Words that placeholders are made of.
DICTIONARY = (
    "example", "sample", "dummy", "test", "demo", "your", "here", "insert", "change", "changeme", "placeholder", "password",
    "passwd", "secret", "token", "user", "admin", "default", "none", "null", "true", "false", "hello", "world", "foo", "bar",
    "key", "value", "string", "redacted", "removed", "hidden", "xxxx", "abcd", "1234", "qwerty", "letmein", "the", "and", "for",
    "with", "that", "this", "from", "have", "tion", "ment", "ing", "ent", "ion", "our", "der", "ein", "que", "los", "las",
)
POSITIVE_WORDS = r"(?i)(?:token|secret|passw|pwd|key|auth|credential|bearer|login)"
NEGATIVE_WORDS = r"(?i)(?:commit|sha-?(?:1|256)|md5|checksum|digest|uuid|guid|version|revision|hash|placeholder|dummy|integrity|etag)"
FEATURES = ("length", "digit_share", "upper_share", "distinct_share", "class_changes", "vowel_changes", "coverage", "hex", "test_path", "good_words", "bad_words", "quoted")


def _count(value: Column, pattern: str) -> Column:
    return (F.length(F.regexp_replace(value, pattern, "##")) - F.length(value)).cast("double")


def features(value: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """The columns of ``FEATURES`` for a candidate and its surroundings."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    pairs = F.greatest(n - 1, F.lit(1.0))
    share = lambda cls: F.length(F.regexp_replace(value, f"[^{cls}]", "")) / n
    change = lambda a, b: F.regexp_count(value, F.lit(f"(?<=[{a}])(?=[{b}])|(?<=[{b}])(?=[{a}])")) / pairs
    low = F.lower(value)
    covered = (n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))) / n
    columns = (
        n, share("0-9"), share("A-Z"), F.size(F.array_distinct(F.split(value, ""))) / n,
        change("0-9", "A-Za-z") + change("a-z", "A-Z"), change("aeiouAEIOU", "b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z"),
        covered, low.rlike("^[0-9a-f]+$").cast("double"),
        F.coalesce(path, F.lit("")).rlike(r"(?i)test|example|sample|fixture|mock|docs?/|readme").cast("double"),
        before.rlike(POSITIVE_WORDS).cast("double"), before.rlike(NEGATIVE_WORDS).cast("double"),
        before.rlike("[\"']$").cast("double"),
    )
    return [c.cast("double").alias(f) for c, f in zip(columns, FEATURES, strict=True)]


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(value, before, after, path, label) made by rule: random keys in code-like places, and placeholders, digests and words."""
    base = spark.range(0, rows, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), F.pmod(F.xxhash64("id"), F.lit(12)).alias("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int").alias("s"))
    h = F.col("h")
    mixed = F.substring(F.translate(F.base64(F.unhex(h)), "+/=", "aB7"), 1, 32)
    letters = F.translate(F.upper(h), "0189", "WXYZ")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), F.col("s") + 1)
    word = F.translate(h, "0123456789abcdef", "etaoinsrhlducmgp")
    value = (
        F.when(F.col("c") == 0, F.substring(h, 1, 40)).when(F.col("c") == 1, F.concat(F.lit("AKIA"), F.substring(letters, 1, 16)))
        .when(F.col("c") == 2, F.substring(h, 1, 18)).when(F.col("c") == 3, mixed).when(F.col("c") == 4, F.substring(mixed, 1, 20)).when(F.col("c") == 5, F.substring(h, 1, 32))
        .when(F.col("c") == 6, F.concat(pick("your_", "example-", "changeme", "dummy_"), pick("token_here", "password", "secret123", "value")))
        .when(F.col("c") == 7, F.substring(h, 1, 40)).when(F.col("c") == 8, F.substring(word, 1, 24))
        .when(F.col("c") == 9, F.concat(F.repeat(pick("x", "0", "ab", "-"), 12), pick("", "1", "example", "x")))
        .when(F.col("c") == 10, F.concat_ws("-", F.substring(word, 1, 8), F.substring(word, 9, 7), F.substring(word, 17, 6), F.col("s").cast("string"))).otherwise(F.concat(F.lit("v"), F.col("s"), F.lit(".12."), F.substring(h, 1, 3), F.lit("-beta")))
    )
    secret = F.col("c") < 6
    before = F.when(secret, pick('token = "', "password=", "of the secret: ", "the thing with ")).when(F.col("c") == 7, pick("commit ", "sha256: ", "etag \"", "checksum ")).otherwise(pick("password=", 'token = "', "see the page ", "and of "))
    path = F.when(secret, pick("src/app.py", "src0", "config.yml", "")).otherwise(pick("tests/fixtures.py", "docs/readme", "src1", ""))
    return base.select(value.alias("value"), before.alias("before"), F.lit("").alias("after"), path.alias("path"), secret.cast("double").alias("label"))


def train_forest(labelled: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7):
    """A random forest over ``FEATURES``; ``labelled`` is read as one partition, so the forest is reproducible."""
    rows = labelled.select("label", *features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))).coalesce(1)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)


def _find(text: Column, kind: str, window: int = 24) -> Column:
    from assayer.llm.pii import match_spans

    rank = list(PATTERNS).index(kind)

    def full(m: Column) -> Column:
        value = F.when(F.lit(kind) == "key_header", m["value"]).otherwise(F.regexp_extract(m["value"], VALUE, 1))
        start = m["stop"] - F.length(value)
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), start.alias("start"), m["stop"].alias("stop"), value.alias("value"),
                        F.substring(text, F.greatest(start - window + 1, F.lit(1)), F.least(start, F.lit(window))).alias("before"),
                        F.substring(text, m["stop"] + 1, F.lit(window)).alias("after"))

    return F.transform(match_spans(text, PATTERNS[kind]), full)


def secret_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row a candidate: key, path, kind, start, stop, value, before, after."""
    t = F.col("text")
    none = F.array().cast("array<struct<rank:int,kind:string,start:int,stop:int,value:string,before:string,after:string>>")
    guards = {"key_header": t.contains("PRIVATE KEY"), "provider_key": t.rlike("A[KS]IA"), "assigned": t.rlike("[:=]"), "long_random": t.rlike("[A-Za-z0-9+/_-]{20}")}
    where = F.col(path).cast("string") if path else F.lit("")
    rows = docs.select(F.col(key), where.alias("path"), F.col(text).cast("string").alias("text")).where("text is not null")
    found = F.concat(*[F.when(guards[k], _find(t, k)).otherwise(none) for k in PATTERNS])
    rows = rows.select(key, "path", found.alias("found")).where(F.size("found") > 0)
    apart = F.filter("found", lambda c: ~F.exists("found", lambda o: (o["rank"] < c["rank"]) & (o["start"] < c["stop"]) & (c["start"] < o["stop"])))
    return rows.select(key, "path", F.inline(apart)).drop("rank")


def secret_findings(docs: DataFrame, *, labelled: DataFrame | None = None, training_rows: int = 4000, threshold: float = 0.5, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Candidates that the forest keeps: key, kind, start, stop, value_sha256, score."""
    forest = train_forest(labelled if labelled is not None else labelled_findings(docs.sparkSession, training_rows))
    found = materialise(secret_candidates(docs, key, text, path), "secret-candidates")
    rows = found.select(key, "kind", "start", "stop", "value", *features(F.col("value"), F.col("before"), F.col("after"), F.col("path")))
    judged = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    score = F.when(F.col("kind") == "key_header", 1.0).otherwise(F.round(vector_to_array("probability")[1], 6))
    return judged.withColumn("score", score).where(F.col("score") >= threshold).select(key, "kind", "start", "stop", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score")
