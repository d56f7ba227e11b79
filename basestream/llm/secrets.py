"""Secret scans: candidates by pattern, judged by a random forest, in built-in functions only.

A candidate is a run of at least 12 characters of [A-Za-z0-9+/_=.-] that holds a digit;
a word may hold many (assignments, JSON and CSV without blanks). A run glued to its name
(name=value, "name":"value") is a candidate without the name, and the name is one of its
own if it is long enough and holds a digit. Its features are its length, its character
classes and their transitions, how much of it dictionary words cover, whether it looks
like a path or address, and what the neighbouring words say. The forest is grown once
on the driver from labelled findings (a bounded, documented sample; by default
``labelled_findings``) and becomes one SQL expression, evaluated in the JVM.

Secret values are not repeated in the result, only their SHA-256.

Runs without any digit are no candidates: in prose they are words.

Defined cases: null and empty texts have no candidates; texts and words of any length are
scanned whole; repeated candidates, repeated rows and rows without an id are all reported;
other columns than doc_id and text don't matter; no rows give no findings.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORE = r"[A-Za-z0-9+/_=.-]{12,}"
#: A name with its sign (1, 2), if one is glued to the run and a digit follows, and the run (3).
NAMED = r"(?:([0-9]*+[A-Za-z_][A-Za-z0-9+/_.-]*+)[\\\"'`]*(=>|:=|==?|:)[\\\"'`]*(?!=|//)(?=[A-Za-z+/_=.-]*[0-9]))?(" + CORE + ")"
#: Marks that part the fields of one word.
FIELD_ENDS = r"[,;{}\[\]|<>]+"
#: Longer fields are not repeated whole beside each of their candidates (bytes; characters of context kept).
FIELD_BYTES, CONTEXT = 256, 64
#: Words whose letters count as covered by the dictionary.
DICTIONARY = (
    "account address admin application beta build cache client cluster commit config content data database default demo "
    "develop document domain email example file folder global group hash host image index internal invoice item key label "
    "library license local login mail main master message model module name network node number object order package page "
    "password path person phone placeholder policy port private process product project proxy public query release report "
    "request resource response restore result sample secret section server service session setting source stage staging "
    "static status storage system table target task template test text thing time token topic update upload user value "
    "version video view web window work world write"
).split()
SECRET_NEAR = r"(token|secret|passw|api.?key|apikey|access.?key|private|credential|auth|bearer)"
BENIGN_NEAR = r"(commit|sha|md5|checksum|digest|uuid|guid|phone|call|card|order|invoice|isbn|version|example|sample|test|http|www|mail|at|from|file|path|page)"
BENIGN_AFTER = r"^\W*(commit|hash|checksum|digest|uuid|guid|ext|expires?|cvv|usd|eur|version|build|html?|port|ip|is|was|were|and|or|for|from)\b"
FEATURES = (
    "size", "digits", "uppers", "marks", "transitions", "distinct", "covered", "hex_only", "digits_only", "uuid",
    "pathlike", "assigned", "quoted", "near_secret", "near_benign", "prefixed", "near_benign_after",
)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, value, word, before, after) of every candidate of whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Explode keeps the words a column of their own, split once a text.
    words = docs.where(text.rlike("[0-9]")).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(F.split(F.trim(text), r"\s+"))).alias("w"))
    hit = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.length(F.get("w", i)) >= 12) & F.get("w", i).rlike("[0-9]") & F.get("w", i).rlike(CORE))
    at = words.select("doc_id", "w", F.explode(hit).alias("i"))
    near = at.select(
        "doc_id",
        F.col("i").alias("word_no"),
        F.concat_ws(" ", F.slice("w", F.greatest(F.col("i") - 2, F.lit(1)), F.least(F.col("i"), F.lit(3)))).alias("before"),
        F.coalesce(F.get("w", F.col("i") + 1), F.lit("")).alias("after"),
        F.explode(F.array(F.split(F.get("w", F.col("i")), FIELD_ENDS))).alias("fields"),
    )
    left = lambda j: F.transform(F.slice("fields", F.greatest(j - 1, F.lit(1)), F.least(j, F.lit(2))), lambda f: F.right(f, F.lit(CONTEXT)))
    held = F.filter(F.sequence(F.lit(0), F.size("fields") - 1), lambda j: F.get("fields", j).rlike("[0-9]") & F.get("fields", j).rlike(CORE))
    fields = F.transform(held, lambda j: F.struct(F.get("fields", j).alias("field"), F.concat_ws(" ", F.when(j < 3, F.col("before")), F.concat_ws(" ", left(j))).alias("near")))
    parts = near.select("doc_id", "word_no", "after", F.explode(fields).alias("f")).select("doc_id", "word_no", "after", "f.field", "f.near")

    def found(value: Column, before: Column, named: Column) -> Column:
        short = F.concat(F.substring("field", 1, CONTEXT), F.lit(" "), named, value)
        return F.struct(value.alias("value"), F.when(F.octet_length("field") <= FIELD_BYTES, F.col("field")).otherwise(short).alias("word"), before.alias("before"))

    runs = F.arrays_zip(*[F.regexp_extract_all("field", F.lit(NAMED), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "sign"), (3, "run"))])
    both = F.transform(runs, lambda x: F.array(
        found(x["name"], F.col("near"), F.lit("")),
        found(x["run"], F.when(x["name"] == "", F.col("near")).otherwise(F.concat(F.col("near"), F.lit(" "), F.right(x["name"], F.lit(CONTEXT)), x["sign"])), F.concat(F.right(x["name"], F.lit(CONTEXT)), x["sign"])),
    ))
    kept = F.filter(F.flatten(both), lambda c: c["value"].rlike("[0-9]") & (F.length(c["value"]) >= 12))
    return parts.select("doc_id", "word_no", "after", F.explode(kept).alias("c")).select("doc_id", "word_no", "c.value", "c.word", "c.before", "after")


def features(found: DataFrame) -> DataFrame:
    """``found`` with FEATURES; needs word, value, before and after."""
    v, n = F.col("value"), F.length("value")
    share = lambda drop: (F.length(F.regexp_replace(v, drop, "")) / n)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    runs = F.length(F.regexp_replace(shape, "(.)\\1+", "$1"))
    left = F.length(F.regexp_replace(F.lower(v), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""))
    before = F.lower("before")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "size": n.cast("double"),
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "marks": share("[A-Za-z0-9]"),
        "transitions": (runs - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "covered": 1 - left / n,
        "hex_only": yes(v.rlike("^[0-9a-fA-F]+$")),
        "digits_only": yes(v.rlike("^[0-9.-]+$")),
        "uuid": yes(v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        "pathlike": yes(F.col("word").rlike(r"(://|@|\.(com|org|net|html?|txt|py|js|md|json|png|jpg)\b|^[./~]|/.*/)")),
        "assigned": yes(F.col("before").rlike(r"[=:]\s*$") | F.col("word").rlike(r"^[A-Za-z_]+[=:]")),
        "quoted": yes(F.col("word").rlike("^[\"'`]|=[\"'`]")),
        "near_secret": yes(F.concat_ws(" ", before, F.lower("word")).rlike(SECRET_NEAR)),
        "near_benign": yes(before.rlike(r"\b" + BENIGN_NEAR + r"\b")),
        "near_benign_after": yes(F.lower("after").rlike(BENIGN_AFTER)),
        "prefixed": yes(v.rlike("^(AKIA|ASIA|gh[pousr]_|sk_live_|sk-|xox[abp]-|AIza|eyJ)")),
    }
    return found.select("*", *[made[f].alias(f) for f in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = 2400) -> DataFrame:
    """Labelled candidates made from digests of row numbers: (word, value, before, after, label)."""
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat_ws(":", i.cast("string"), F.lit(salt)).cast("binary"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[^A-Za-z0-9+/=]", "")
    num = lambda salt, k: F.substring(F.lpad(F.conv(F.substring(h(salt), 1, 14), 16, 10), 20, "7"), 1, k)
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(F.xxhash64("id", F.lit(len(xs))), F.lit(len(xs))).cast("int"))
    name = pick(["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "private_key"])
    plain = pick(["the thing was", "from here to", "de la ciudad", "und die der", "was over there", "in an orderly", "le plus que"])
    kinds = [
        (1, F.concat(name, F.lit(" =")), F.concat(F.lit('"'), F.substring(h("a"), 1, 40), F.lit('"'))),
        (1, F.concat(name, F.lit(" =")), F.concat(F.lit("'"), F.substring(b64, 1, 36), F.lit("'"))),
        (1, F.concat(plain, F.lit(" "), name, F.lit(":")), F.substring(b64, 1, 32)),
        (1, plain, F.concat(F.lit("AKIA"), F.upper(F.substring(h("k"), 1, 16)))),
        (1, plain, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(F.concat(b64, b64), "[^A-Za-z0-9]", "x"), 1, 36))),
        (1, F.concat(plain, F.lit(" bearer")), F.concat(F.lit("eyJ"), b64)),
        (0, plain, num("n", 16)),
        (0, pick(["the card number", "order no", "please call", "invoice number is", "isbn"]), num("m", 13)),
        (0, plain, F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))),
        (0, pick(["fixed in commit", "merge commit", "sha of", "md5 checksum", "sha256 digest:"]), F.substring(h("c"), 1, 40)),
        (0, plain, F.concat(pick(["https://example.com/", "http://www.site.org/page/", "/usr/share/data/", "./build/module-"]), F.substring(h("p"), 1, 12), F.lit(".html"))),
        (0, plain, F.concat(pick(["person.", "first.last", "user_"]), num("e", 2), F.lit("@mail"), num("f", 1), F.lit(".example.com"))),
        (0, F.concat(name, F.lit(" =")), F.concat(F.lit('"'), pick(["example_token_123", "your-api-key-0000", "test_password_1", "sample-secret-42", "placeholder_value_1"]), F.lit('"'))),
        (0, plain, F.concat(pick(["release-version-", "document_number_", "staging.server.node", "default-template-v"]), num("v", 3))),
        (0, plain, F.concat(num("i", 3), F.lit("."), num("j", 2), F.lit("."), num("q", 3), F.lit("."), num("r", 3))),
        (0, F.lit("phone +4"), F.concat(F.lit("("), num("t", 3), F.lit(")"), num("s", 4), F.lit("-"), num("w", 6))),
    ]
    after = {1: pick(["", "", "# rotate", "on", "then", "de", "|"]), 0: pick(["", "", "commit", "expires", "is", "and", "de", "|"])}
    case = lambda at: F.get(F.array(*[k[at] if not isinstance(k[at], int) else F.lit(k[at]) for k in kinds]), (i % len(kinds)).cast("int"))
    made = spark.range(rows).select(case(0).alias("label"), case(1).alias("before"), case(2).alias("word"), F.when(case(0) == 1, after[1]).otherwise(after[0]).alias("after"))
    return made.withColumn("value", F.regexp_extract("word", CORE, 0)).where(F.col("value") != "")


def grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator, depth: int, least: int = 4):
    """One tree of (feature, cut, low, high), leaves being shares of label 1."""
    share = float(y[rows].mean())
    if depth == 0 or share in (0.0, 1.0) or len(rows) < 2 * least:
        return round(share, 6)
    best = None
    for f in rng.choice(x.shape[1], size=max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
        values = np.unique(x[rows, f])
        if len(values) < 2:
            continue
        middles = (values[1:] + values[:-1]) / 2
        for cut in middles[:: max(1, len(middles) // 12)]:
            low = x[rows, f] <= cut
            k = int(low.sum())
            if k < least or len(rows) - k < least:
                continue
            a, b = y[rows[low]].mean(), y[rows[~low]].mean()
            impurity = k * a * (1 - a) + (len(rows) - k) * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, int(f), float(cut), low
    if best is None:
        return round(share, 6)
    _, f, cut, low = best
    return f, cut, grow(x, y, rows[low], rng, depth - 1, least), grow(x, y, rows[~low], rng, depth - 1, least)


def fit(findings: DataFrame, trees: int = 15, depth: int = 6, most: int = 5000, seed: int = 11) -> list:
    """A forest from at most ``most`` labelled findings (word, value, before, after, label):
    those with the least hashes, so their order plays no part and both classes keep their shares."""
    told = features(findings).withColumn("pick", F.xxhash64("word", "value", "before", "after"))
    rows = told.orderBy("pick", "label").limit(most).select(*FEATURES, "label").collect()
    if not rows:
        return [0.0]
    data = sorted(tuple(float(v) for v in r) for r in rows)
    x, y = np.array([r[:-1] for r in data]), np.array([r[-1] for r in data])
    rng = np.random.default_rng(seed)
    return [grow(x, y, rng.integers(0, len(x), len(x)), rng, depth) for _ in range(trees)]


def as_column(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(F.col(FEATURES[f]) <= F.lit(cut), as_column(low)).otherwise(as_column(high))


def forest_column(forest: list) -> Column:
    total = as_column(forest[0])
    for t in forest[1:]:
        total = total + as_column(t)
    return total / F.lit(float(len(forest)))


@lru_cache(maxsize=4)
def _default_forest(app: str) -> list:
    return fit(labelled_findings(SparkSession.getActiveSession()))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: where it stands, its digest, its features' verdict."""
    forest = fit(findings) if findings is not None else _default_forest(docs.sparkSession.sparkContext.applicationId)
    judged = features(candidates(docs)).withColumn("probability", F.round(forest_column(forest), 6))
    return judged.select(
        "doc_id", "word_no", F.length("value").alias("value_chars"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        "probability", (F.col("probability") >= threshold).alias("is_secret"),
    )
