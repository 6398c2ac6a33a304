"""Secret scan: candidate strings, and a random forest that removes false positives.

A candidate is a long run of key characters, or whatever is assigned to a name like password or token, of any length and
characters. The forest looks at its length, its character transitions, how much of it dictionary words cover, the path, and the
words beside it, at every place of the candidate; the highest score counts. It is fitted with Spark's own RandomForestClassifier on
labelled findings (label, path, before, token, after), of which LABELLED rows are made by rule when none are given, and then
written out as one SQL expression. So a text is scanned and scored where it lies, within its row: no shuffle, no Python.

Masking is by place; a secret is also masked where it stands in the rest of the text or inside another run, the longest first.
There, one of fewer than LONG characters must stand by itself.

Defined cases: a null text has no candidates; a null path is an empty one; a candidate that occurs again in a text is one finding with
its number of places as a candidate; repeated rows are scanned each on their own; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import operator

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Characters of a run that is a candidate without a name.
LONG = 16
_NAME = r"(?:token|secret|passwo?r?d|passphrase|api[_\-]?key|access[_\-]?key|private[_\-]?key|credential|(?<![A-Za-z0-9])(?:pwd|pass|auth|key)(?![A-Za-z]))"
#: Group 1: the name, what assigns and the opening quote (empty for a run). The value follows it.
ASSIGNED = (
    rf"((?<![A-Za-z0-9+/_=.\-])(?=[A-Za-z0-9_.\-]*?(?i:{_NAME}))[A-Za-z0-9_.\-]++[\"']?(?:[ \t]*+(?:=>|:=|=|:)|[ \t]++={{2,3}})[ \t]*+(?![=\s])"
    r"(?:\"(?=[^\"\r\n]+\")|'(?=[^'\r\n]+')|(?![\"'])))(?:(?<=\")[^\"\r\n]+|(?<=')[^'\r\n]+|(?<![\"'])[^\s\"',;]*[^\s\"',;.)\]}>])"
)
RUN = rf"()(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-]{{{LONG},}}"
CANDIDATE = f"{ASSIGNED}|{RUN}"
#: One of them is in every name.
_IN_NAMES = ("token", "secret", "pass", "pwd", "auth", "key", "credential")
#: Characters before and after a candidate that count as beside it.
BEFORE, AFTER = 48, 24
LABELLED, TREES, LEVELS, SEED = 6000, 15, 6, 11
SECRET = 0.5
MASK = "[secret]"

_NAMES = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api_?key|access_?key|private_?key|auth|bearer|credential|_key|\bkey)"
_OTHERS = r"(?i)\b(commit|sha\d*|md5|checksum|digest|hash|uuid|guid|card|order|phone|isbn|iban|version|revision|build|page|see|id)\b"
_DUMMY = r"(?i)(example|sample|dummy|placeholder|your|here|changeme|test|fake|mock|redacted)"
_WORDS = r"(example|sample|dummy|placeholder|your|here|change|test|fake|token|secret|password|module|parser|number|order|user|value|string|default|insert|name|file|path|data|index|config)"
_PROSE = "the of and in to report section with from below must never remain value string required hidden none true null false limit count name model index length reset change optional".split()
_CHOSEN = "dragon monkey winter castle shadow master summer purple falcon silver garden thunder orange battery horse staple correct hunter letme rocket".split()
_PAIRS = r"(th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|de|ou|ei|ch|qu|le|la)"


def features(x: Column, path: Column) -> dict[str, Column]:
    """Of a struct with token, before and after."""
    t, low, n = x["token"], F.lower(x["token"]), F.length(x["token"]).cast("double")
    count = lambda s, pattern: F.regexp_count(s, F.lit(pattern)).cast("double")
    yes = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "length": n,
        "digits": count(t, "[0-9]") / n,
        "upper": count(t, "[A-Z]") / n,
        "kinds": F.size(F.array_distinct(F.split(t, ""))).cast("double") / n,
        "changes": count(t, "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]") / n,
        "pairs": count(low, _PAIRS) / n,
        "covered": F.lit(1.0) - F.length(F.regexp_replace(low, F.lit(_WORDS), F.lit(""))) / n,
        "hex": yes(t.rlike("^[0-9a-fA-F]+$")),
        "only_digits": yes(t.rlike("^[0-9]+$")),
        "separators": count(t, r"[+/_=\-]") / n,
        "symbols": count(t, r"[^A-Za-z0-9+/_=\-]") / n,
        "code": yes(t.rlike(r"[(){}\[\]<>$\s]|^[a-z_]+\.[a-z_.]+$")),
        "runs": yes(t.rlike(r"(.)\1{3}")),
        "named": yes(F.right(x["before"], F.lit(24)).rlike(_NAMES)),
        "assigned": yes(x["before"].rlike(r"""[=:]\s*["']?$|(?i)bearer\s+$""")),
        "quoted": yes(x["before"].rlike("""["']$""") & x["after"].rlike("""^["']""")),
        "other_name": yes(F.right(x["before"], F.lit(16)).rlike(_OTHERS)),
        "dummy_near": yes(F.concat(x["before"], x["after"]).rlike(_DUMMY)),
        "test_path": yes(path.rlike(r"(?i)(test|example|fixture|mock|doc|sample)")),
    }


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Findings whose label the rule that makes them gives: real keys beside their names, and what looks like keys."""
    h = lambda k: F.sha1(F.concat(F.col("id").cast("string"), F.lit(f"/{k}")).cast("binary"))
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), "=", "7")
    number = lambda k, n: F.right(F.concat(F.lit("4" * n), F.abs(F.xxhash64("id", F.lit(k))).cast("string")), F.lit(n))
    one_of = lambda k, words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    word = lambda k: one_of(k, _PROSE[:10])
    plain = lambda k: F.regexp_replace(b64(k), "[+/]", "k")
    letters = lambda k: F.translate(b64(k), "0123456789+/", "gHjKmNpQrTvW")
    some = lambda c, k, least, most: c.substr(F.lit(1), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most - least + 1)) + least).cast("int"))
    mark = lambda k: one_of(k, list("&!@#%*^?~"))
    said = F.concat(word(1), F.lit(" "), word(2), F.lit(" "))
    kinds = [
        (1, 'token = "', h(1), '"'),
        (1, 'TOKEN = "', F.upper(h(1)), '"'),
        (1, "api_key: ", b64(1), "\n"),
        (1, "AWS_SECRET_ACCESS_KEY=", b64(2), "\n"),
        (1, 'password = "', F.concat(F.left(b64(3), F.lit(18)), F.lit("9x")), '"'),
        (1, "Authorization: Bearer ", F.concat(b64(1), F.lit("0"), b64(2)), " "),
        (1, 'secret: "', F.md5(h(1).cast("binary")), '",'),
        (1, "private_key='", F.concat(b64(4), b64(5)), "'"),
        (1, "auth token ", F.concat(F.lit("ghp_"), F.regexp_replace(b64(6), "[+/]", "2")), " "),
        (1, 'password = "', F.concat(some(plain(1), 31, 3, 12), mark(32), some(plain(2), 33, 1, 6)), '"'),
        (1, "pwd: ", F.concat(some(plain(3), 34, 3, 8), mark(35), some(h(4), 36, 1, 4)), "\n"),
        (1, "DB_PASSWORD=", F.concat(some(plain(5), 37, 5, 12), number(38, 1)), "\n"),
        (1, 'password = "', some(letters(1), 39, 6, 15), '"'),
        (1, "password: '", F.concat(one_of(40, _CHOSEN), one_of(41, _CHOSEN)), "'"),
        (1, 'secret = "', F.lower(letters(2)), '"'),
        (1, 'api_key = "', letters(3), '"'),
        (1, "auth token ", F.concat(letters(4), letters(5)), " "),
        (0, "token: ", one_of(42, _PROSE), " "),
        (0, "the password: ", one_of(43, _PROSE), " "),
        (0, "key = ", some(number(44, 6), 45, 1, 6), "\n"),
        (0, 'key: "', one_of(46, _PROSE), '"'),
        (0, "password = ", F.concat(F.lit("${"), F.upper(one_of(47, _CHOSEN)), F.lit("_PASSWORD}")), "\n"),
        (0, "token = ", F.concat(one_of(48, ["get", "read", "self.make", "load"]), F.lit("_"), one_of(49, _PROSE), F.lit("(")), "\n"),
        (0, "api_key = ", F.concat(one_of(50, ["config.", "self.", "settings.", "os."]), one_of(51, _PROSE)), "\n"),
        (0, 'api_key = "', F.concat(F.lit("YOUR_"), F.upper(one_of(52, _PROSE)), F.lit("_KEY")), '"'),
        (0, "", F.concat(*[one_of(k, _PROSE + _CHOSEN) for k in range(53, 58)]), " "),
        (0, "", F.concat_ws("/", *[one_of(k, _PROSE + _CHOSEN) for k in range(58, 63)]), " "),
        (0, "", F.concat(F.lit("-" * 16), some(F.lit("-" * 40), 63, 1, 40)), "\n"),
        (0, "commit ", h(1), " "),
        (0, "sha256: ", F.sha2(h(1).cast("binary"), 256), "\n"),
        (0, "checksum ", F.md5(h(2).cast("binary")), "."),
        (0, "card ", number(1, 16), " "),
        (0, "", number(2, 17), " "),
        (0, "", number(3, 19), "."),
        (0, 'token = "', F.concat(F.lit("your_token_goes_here_"), number(4, 3)), '"'),
        (0, 'api_key = "', F.concat(F.lit("example-key-value-"), number(5, 4)), '"'),
        (0, 'password: "', F.concat(F.lit("xxxxxxxxxxxxxxxx"), number(6, 1)), '"'),
        (0, "see ", F.concat(F.lit("src/module_"), number(7, 2), F.lit("/parser_test_"), number(8, 2)), " "),
        (0, "", F.concat(F.lit("order_number_2024_"), number(9, 6)), ", "),
        (0, "uuid ", F.regexp_replace(h(3), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5"), " "),
        (0, "", F.concat(F.lit("http-user-agent-string-v"), number(10, 2)), " "),
        (0, "", F.concat(F.lit("==========="), number(11, 5), F.lit("==========")), "\n"),
    ]
    each = F.array(*[
        F.struct(F.lit(y).alias("label"), F.concat(said, F.lit(b)).alias("before"), t.alias("token"), F.concat(F.lit(a), word(3)).alias("after")) for y, b, t, a in kinds
    ])
    path = F.when(F.pmod(F.xxhash64("id", F.lit("p")), F.lit(9)) == 0, F.lit("tests/fixtures/keys")).otherwise(F.concat(F.lit("src"), F.col("id").cast("string")))
    one = F.element_at(each, (F.pmod(F.col("id"), F.lit(len(kinds))) + 1).cast("int"))
    made = spark.range(0, rows, numPartitions=2).select(one.alias("f"), path.alias("path"))
    # a name in a test's path is not a key
    return made.select(F.when(F.col("path").startswith("tests"), 0).otherwise(F.col("f.label")).cast("double").alias("label"), "path", "f.before", "f.token", "f.after")


def _expression(node, names: list[str], x: Column) -> Column:
    """The share of secrets that a tree gives, as a nested CASE."""
    if node.numDescendants() == 0:
        stats = [node.impurityStats().stats()[k] for k in range(2)]
        return F.lit(stats[1] / max(sum(stats), 1e-9))
    split = node.split()
    left, right = (_expression(n, names, x) for n in (node.leftChild(), node.rightChild()))
    return F.when(x[names[split.featureIndex()]] <= F.lit(split.threshold()), left).otherwise(right)


def forest(labelled: DataFrame):
    """A function from a struct of features to the share of the trees' votes for a secret."""
    names = list(features(F.struct("token", "before", "after"), F.col("path")))
    rows = cut(labelled.select("label", "path", "before", "token", "after")).select("label", *[c.alias(n) for n, c in features(F.struct("token", "before", "after"), F.coalesce("path", F.lit(""))).items()])
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=LEVELS, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)
    roots = [tree._call_java("rootNode") for tree in model.trees]
    return lambda x: functools.reduce(operator.add, [_expression(r, names, x) for r in roots]) / F.lit(float(len(roots)))


def _cuts(body: Column, pattern: str) -> Column:
    rest, names, whole = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    token = lambda x: F.substring(x["whole"], F.length(x["names"]) + 1, F.length(x["whole"]))
    zipped = F.arrays_zip(rest.alias("rest"), names.alias("names"), whole.alias("whole"))
    return F.transform(zipped, lambda x: F.struct(x["rest"].alias("rest"), F.coalesce(x["names"], F.lit("")).alias("prefix"), token(x).alias("token")))


def cuts(text: Column) -> Column:
    """Array of (rest, prefix, token): what stands before each candidate, its name, and itself; the last has the text's end as rest.
    The longer pattern is for texts that say a name and assign; one part without a token stands for a text without candidates."""
    body = F.coalesce(text, F.lit(""))
    low = F.lower(body)
    named = (body.contains(":") | body.contains("=")) & functools.reduce(operator.or_, [low.contains(n) for n in _IN_NAMES])
    none = F.array(F.struct(body.alias("rest"), F.lit("").alias("prefix"), F.lit(None).cast("string").alias("token")))
    return F.when(named, _cuts(body, CANDIDATE)).when(body.rlike(RUN), _cuts(body, RUN)).otherwise(none)


def ends(parts: Column) -> Column:
    """Array of (tail, head) of what the parts say."""
    whole = lambda x: F.concat(x["rest"], x["prefix"], F.coalesce(x["token"], F.lit("")))
    return F.transform(parts, lambda x: F.struct(F.right(whole(x), F.lit(BEFORE)).alias("tail"), F.left(whole(x), F.lit(AFTER)).alias("head")))


def _beside(parts: Column, ends: Column) -> Column:
    """Array of (token, before, after) of each place. A part has two characters or more, which bounds how many are looked at."""
    near = lambda first, n, end: F.array_join(F.transform(F.slice(ends, first, n), lambda e: e[end]), "")

    def place(x: Column, k: Column) -> Column:
        back = F.least(k, F.lit(BEFORE // 2))
        before = F.concat(F.when(k > 0, near(k + 1 - back, back, "tail")).otherwise(F.lit("")), F.right(F.concat(x["rest"], x["prefix"]), F.lit(BEFORE)))
        return F.struct(x["token"].alias("token"), F.right(before, F.lit(BEFORE)).alias("before"), F.left(near(k + 2, F.lit(AFTER // 2), "head"), F.lit(AFTER)).alias("after"))

    return F.filter(F.transform(parts, place), lambda x: x["token"].isNotNull())


def findings(parts: Column, ends: Column, path: Column, score) -> Column:
    """Array of (token, score) of the candidates' places."""
    looked = F.transform(_beside(parts, ends), lambda x: F.struct(x["token"].alias("token"), F.struct(*[c.alias(n) for n, c in features(x, F.coalesce(path, F.lit(""))).items()]).alias("f")))
    return F.transform(looked, lambda x: F.struct(x["token"].alias("token"), score(x["f"]).alias("score")))


def scan(docs: DataFrame, *, labelled: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """key, token, places, score, secret: a row for each distinct candidate of each text."""
    score = forest(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    found = docs.select(F.col(key), cuts(F.col(text)).alias("parts"), F.col(path).alias("path"))
    found = found.withColumn("ends", ends(F.col("parts"))).select(key, findings(F.col("parts"), F.col("ends"), F.col("path"), score).alias("found"))
    own = lambda t: F.filter("found", lambda f: f["token"] == t)
    tokens = F.array_distinct(F.transform("found", lambda f: f["token"]))
    best = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.size(own(t)).cast("long").alias("places"), F.array_max(F.transform(own(t), lambda f: f["score"])).alias("score")))
    # explode() would be preceded by a filter that makes the findings once more
    found = found.select(key, F.explode_outer(best).alias("f")).where("f IS NOT NULL")
    return found.select(key, "f.token", "f.places", "f.score", (F.col("f.score") >= SECRET).alias("secret"))


def redact(docs: DataFrame, *, labelled: DataFrame | None = None, text: str = "text", path: str = "source") -> DataFrame:
    """The same rows and columns, with every secret of a text replaced by MASK."""
    score = forest(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    held = docs.withColumn("__parts", cuts(F.col(text))).withColumn("__ends", ends(F.col("__parts")))
    found = F.filter(findings(F.col("__parts"), F.col("__ends"), F.col(path), score), lambda f: f["score"] >= SECRET)
    held = held.withColumn("__secrets", F.array_distinct(F.transform(found, lambda f: f["token"])))
    longest = F.transform(F.reverse(F.array_sort(F.transform("__secrets", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))), lambda x: x["t"])
    quoted = lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    alone = lambda t: F.concat(F.lit("(?<![A-Za-z0-9])"), quoted(t), F.lit("(?![A-Za-z0-9])"))
    held = held.withColumn("__pattern", F.array_join(F.transform(longest, lambda t: F.when(F.length(t) < LONG, alone(t)).otherwise(quoted(t))), "|"))
    masked = lambda c: F.regexp_replace(c, F.col("__pattern"), F.lit(MASK))
    value = lambda x: F.when(F.array_contains("__secrets", x["token"]), F.lit(MASK)).otherwise(masked(F.coalesce(x["token"], F.lit(""))))
    clean = F.array_join(F.transform("__parts", lambda x: F.concat(masked(F.concat(x["rest"], x["prefix"])), value(x))), "")
    return held.withColumn(text, F.when(F.size("__secrets") > 0, clean).otherwise(F.col(text))).drop("__parts", "__ends", "__secrets", "__pattern")


def op6_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score; the token itself is given by its digest and its ends."""
    shown = F.concat(F.left("token", F.lit(4)), F.lit("..."), F.right("token", F.lit(2)))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", shown.alias("shown"), F.sha2(F.col("token").cast("binary"), 256).alias("token_sha256"), F.length("token").alias("length"), "places", "score", "secret"
    )
