"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find the certain spans; looser patterns propose more candidates. Labelers (format,
gazetteer, context, shape, neighbours) vote yes, no or abstain on every candidate. Votes are counted
by pattern (a bounded table whatever the corpus), expectation-maximisation estimates each
labeler's reliability and every pattern's probability, and a logistic span classifier is trained
on these soft labels. Candidates outside the base are added where it is confident; base spans stay.

Offsets are code points, end exclusive. Null texts are empty; repeated rows are judged alone; extra
columns are ignored; an empty table gives an empty result. Patterns are possessive and anchored to
the start of their run, so that long runs take linear time and little stack; they match what the
plain patterns match.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm._work import materialise

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base spans.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates, of the same kinds.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
}
#: Gazetteers and context words.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at", "us", "ca", "au", "jp", "cn", "br", "mx")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "91")
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
PRIVATE_IP = r"^(?:0|10|127|255|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|client|address|login|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|mastercard|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|contact|telefon|tél|teléfono)\b",
}
AGAINST = r"(?i)\b(?:version|ver|isbn|order|invoice|serial|sku|build|release|ticket|case)\b"
LABELERS = ("format", "gazetteer", "context", "shape", "neighbours")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def match_spans(text: Column, pattern: str) -> Column:
    """All matches (start, stop, value) of a pattern; starts are running sums of the lengths between matches."""
    parts, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        return F.struct((s + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), (s + F.length(x["m"])).alias("stop"), x["m"].alias("value")))).alias("out"))

    zipped = F.zip_with(F.slice(parts, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def find(text: Column, pattern: str, kind: str, base: bool, window: int = 40) -> Column:
    """All matches as candidates of ``kind`` with what stands before and after them."""
    return F.transform(
        match_spans(text, pattern),
        lambda m: F.struct(
            F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), m["start"].alias("start"), m["stop"].alias("stop"), m["value"].alias("value"),
            (F.lit(base) & _valid(kind, m["value"])).alias("base"),
            F.substring(text, F.greatest(m["start"] - window + 1, F.lit(1)), F.least(m["start"], F.lit(window))).alias("before"),
            F.substring(text, m["stop"] + 1, F.lit(window)).alias("after"),
        ),
    )


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(key, found): every base match and looser candidate of each document, passing its checks or not."""
    none = "array<struct<kind:string,rank:int,start:int,stop:int,value:string,base:boolean,before:string,after:string>>"
    t = F.col("scanned_text")
    guards = {"email": t.contains("@"), "phone": t.contains("+"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]")}
    loose = {"email": t.rlike(r"[\[(]at[\])]"), "phone": F.col("digits")}
    columns = [F.when(guards[k], find(t, BASE[k], k, True)).otherwise(F.array().cast(none)) for k in KINDS]
    columns += [F.when(loose[k], find(t, LOOSE[k], k, False)).otherwise(F.array().cast(none)) for k in LOOSE]
    rows = docs.select(F.col(key), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("scanned_text"))
    rows = rows.withColumn("digits", t.rlike("[0-9]{2}"))
    return rows.select(key, "carried", F.concat(*columns).alias("found"))


def _votes(c: Column) -> list[Column]:
    """One vote a labeler: 1 yes, 0 no, -1 abstain."""
    kind, value, digits = c["kind"], c["value"], _digits(c["value"])
    top = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    country = F.regexp_extract(value, r"^\+([0-9]{1,3})", 1)
    known = F.exists(F.array(*[F.lit(x) for x in COUNTRY_CODES]), lambda x: country.startswith(x))

    def pick(**by) -> Column:
        out = None
        for k, v in by.items():
            out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
        return out.otherwise(F.lit(-1))

    def yes_no(x: Column) -> Column:
        return F.when(x, 1).otherwise(0)

    near = F.concat_ws(" ", c["before"], c["after"])
    valid = F.when(kind == "ip", _valid("ip", value)).when(kind == "card", _valid("card", value)).when(kind == "phone", F.length(digits).between(8, 15)).otherwise(True)
    form = F.when(c["base"], 1).when(~valid, 0).otherwise(-1)
    gazetteer = pick(email=F.when(top.isin(*TOP_LEVEL), 1).otherwise(-1), ip=F.when(value.rlike(PRIVATE_IP), 0).otherwise(-1), card=yes_no(digits.rlike(CARD_PREFIX)), phone=F.when(country == "", -1).when(known, 1).otherwise(0))
    friendly = F.lit(False)
    for k in KINDS:
        friendly = friendly | ((kind == k) & near.rlike(CONTEXT[k]))
    context = F.when(friendly, 1).when(c["before"].rlike(AGAINST), 0).otherwise(-1)
    shape = pick(
        email=yes_no(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._+-]{0,63}(?:@|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]+\W")),
        ip=yes_no(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")),
        card=yes_no(value.rlike(r"^[0-9]{16,19}$|^[0-9]{4}(?:([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?)$")),
        phone=yes_no(value.rlike(r"^\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}$|^\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}$")),
    )
    glued = c["before"].rlike(r"[\w=/\"']$") | c["after"].rlike(r"^[\w=/\"']")
    return [v.cast("int") for v in (form, gazetteer, context, shape, F.when(glued, 0).otherwise(1))]


def estimate(patterns: list[tuple[str, tuple[int, ...], float]], rounds: int = 50) -> tuple[dict[tuple[str, tuple[int, ...]], float], dict[str, list[float]]]:
    """Expectation-maximisation over (kind, votes, count): probability by pattern and the labelers' reliabilities."""
    post = {}
    for kind, votes, _ in patterns:
        cast = [v for v in votes if v >= 0]
        post[kind, votes] = (sum(cast) + 0.5) / (len(cast) + 1)
    rates = {"hit": [0.8] * len(LABELERS), "clear": [0.8] * len(LABELERS)}
    for _ in range(rounds):
        prior = {}
        for k in {p[0] for p in patterns}:
            own = [(post[a, v], n) for a, v, n in patterns if a == k]
            prior[k] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for j in range(len(LABELERS)):
            for name, value, side in (("hit", 1, lambda p: p), ("clear", 0, lambda p: 1 - p)):
                voted = [(side(post[a, v]) * n, v[j]) for a, v, n in patterns if v[j] >= 0]
                right, total = sum(w for w, x in voted if x == value), sum(w for w, _ in voted)
                rates[name][j] = min(0.99, max(0.5, (right + 4) / (total + 5)))
        for k, votes, _ in patterns:
            score = log(prior[k] / (1 - prior[k]))
            for j, v in enumerate(votes):
                if v == 1:
                    score += log(rates["hit"][j] / (1 - rates["clear"][j]))
                elif v == 0:
                    score += log((1 - rates["hit"][j]) / rates["clear"][j])
            post[k, votes] = 1 / (1 + 2.718281828459045 ** -max(-30.0, min(30.0, score)))
    return post, rates


def _features(kind: str, votes: tuple[int, ...], size: int) -> list[float]:
    return [float(kind == k) for k in KINDS] + [float(v == x) for v in votes for x in (0, 1)] + [float(size == s) for s in (0, 1, 2)]


def train(judged: DataFrame) -> tuple[list[float], float] | None:
    """Weights and intercept of the span classifier, from vote patterns counted over all candidates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    # at most 4 kinds * 3^5 vote patterns * 3 sizes
    counted = judged.groupBy("kind", "votes", "size").count().collect()
    if not counted:
        return None
    patterns: dict[tuple[str, tuple[int, ...]], float] = {}
    for r in counted:
        k = r["kind"], tuple(r["votes"])
        patterns[k] = patterns.get(k, 0.0) + r["count"]
    post, _ = estimate([(k, v, n) for (k, v), n in sorted(patterns.items())])
    rows = []
    for r in sorted(counted, key=lambda r: (r["kind"], r["votes"], r["size"])):
        p = post[r["kind"], tuple(r["votes"])]
        x = Vectors.dense(_features(r["kind"], tuple(r["votes"]), r["size"]))
        rows += [(1.0, p * r["count"] + 1e-6, x), (0.0, (1 - p) * r["count"] + 1e-6, x)]
    table = judged.sparkSession.createDataFrame(rows, ["label", "weight", "features"]).coalesce(1)
    model = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=30).fit(table)
    return [float(c) for c in model.coefficients], float(model.intercept)


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: key, ``carried`` (a struct of the columns ``carry``) and ``spans``, sorted structs (kind, rank, start, stop, base) of base and added spans."""
    size = lambda c: F.when(c["stop"] - c["start"] <= 12, 0).when(c["stop"] - c["start"] <= 20, 1).otherwise(2)
    slim = lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"), c["base"].alias("base"), F.array(*_votes(c)).alias("votes"), size(c).alias("size"))
    found = materialise(candidates(docs, key, text, carry or (key,)).select(key, "carried", F.transform("found", slim).alias("found")), "pii-candidates")
    judged = found.where(F.size("found") > 0).select(F.inline("found")).select("kind", "votes", "size")
    model = train(judged)

    def keep(c: Column) -> Column:
        if not model:
            return c["base"]
        weights, intercept = model
        score = F.lit(intercept) + F.element_at(F.array(*map(F.lit, weights[: len(KINDS)])), c["rank"] + 1)
        for j in range(len(LABELERS)):
            no, yes = weights[len(KINDS) + 2 * j : len(KINDS) + 2 * j + 2]
            score = score + F.when(c["votes"][j] == 0, no).when(c["votes"][j] == 1, yes).otherwise(0.0)
        score = score + F.element_at(F.array(*map(F.lit, weights[-3:])), c["size"] + 1)
        return score > log(threshold / (1 - threshold))

    sure = F.filter("found", lambda c: c["base"])
    extra = F.filter(F.filter("found", lambda c: ~c["base"] & keep(c)), lambda c: ~F.exists("sure", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    short = lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"), c["base"].alias("base"))
    return found.withColumn("sure", sure).select(key, "carried", F.array_sort(F.transform(F.concat("sure", extra), short)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def span_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select(key, *[count(k) for k in KINDS], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the earlier one names it."""
    t = F.coalesce(text, F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        cut = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(inside, acc["out"]).otherwise(cut).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
