"""Secret scan with a random forest that removes false positives.

Candidates are runs of 16 or more key characters with a digit in them.  A text
is split at its candidates, so the pieces between them are each candidate's
neighbouring words.  Features: length and character classes, transitions
between classes, how usual its letter pairs are, distinct characters, coverage
by dictionary words, known key and id forms, words before it, quotes and
assignment, and the path of the document.  The dictionary and the letter pairs
are learned from the words of all documents (:func:`learn`): the ``most_words``
most frequent words, and log-probabilities of one letter after another.  A
random forest, trained from labelled findings, gives the probability that a
candidate is a secret.

All of it is DataFrame and SQL code: extraction and features are built-in
functions, the forest is Spark ML's (fit and applied in the JVM).  Only texts
with a candidate are split; each candidate is a row of its own and no group is
ever formed, so hot sources and copies need no care.

Labelled findings are a table (candidate, before, after, path, label).
:func:`sample_findings` makes one by rule, from hashes: keys, tokens and
passwords in the settings and code where they occur, against commit ids,
checksums, uuids, card and phone numbers, slugs, encoded images, versions and
placeholders.  Own findings can be given instead.  The rules tell secrets from
others in the same terms as the features do, so how well the forest does is
measured on findings written by hand (see the tests and the README).

Defined cases: null and empty texts have no candidates and give no row.  A
null path counts as empty.  Repeated rows give repeated findings.  A run of
528 or more characters is cut into pieces of 512, the last of 16 to 527, so no
character is lost; inside the run a piece has no neighbouring words.  Ids may
be of any type, and extra columns are ignored.  Without words in the documents
the fixed words below are the dictionary.  An empty table gives an empty result.
The forest doesn't depend on the session's parallelism: findings come in
``PARTS`` partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, written

#: A whole run with a digit somewhere in it, and the pieces that a run is cut into.
RUN = r"(?<![A-Za-z0-9_+/=.\-])(?=[A-Za-z_+/=.\-]*+[0-9])[A-Za-z0-9_+/=.\-]{16,}+"
PIECE = r"[A-Za-z0-9_+/=.\-]{512}(?=[A-Za-z0-9_+/=.\-]{16})|[A-Za-z0-9_+/=.\-]{16,527}"
#: Both in one, for plain scans of a text: all but the pieces behind the last digit of a run.
CANDIDATE = rf"(?=[A-Za-z_+/=.\-]*+[0-9])(?:{PIECE})"
#: Characters of text before and after a candidate that count as its neighbours.
NEAR = 48
#: Words that make an identifier readable.
DICTIONARY = "example|sample|test|demo|image|photo|data|user|name|file|http|www|com|page|index|version|release|report|build|main|master|final|draft|default|value|null|none|true|false|change|your|here|dummy|fake|insert|node|module|package|article|post|blog|news|product|item|order|invoice|number|part|chapter|section|email|phone"
SECRET_WORDS = r"(?i)(token|secret|api.?key|apikey|access.?key|private.?key|passw|pwd|auth|bearer|credential|client.?key|signing)"
OTHER_WORDS = r"(?i)(commit|sha-?\d|md5|digest|checksum|hash|uuid|guid|revision|etag|blob|build|isbn|version|image/|href|src=|id\b)"
PLAIN_PATHS = r"(?i)(test|example|sample|fixture|doc|mock|readme)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, nth, candidate, before, after, path), one row a candidate."""
    hit = docs.where(F.col(text_col).rlike(RUN))
    runs = F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))
    found = F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(PIECE), F.lit(0)))
    between = F.split(F.col(text_col), RUN, -1)
    near = F.transform(between, lambda x: F.struct(F.right(x, F.lit(NEAR)).alias("tail"), F.left(x, F.lit(NEAR)).alias("head")))
    rows = hit.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), found.alias("found"), near.alias("near"))
    ends = F.arrays_zip(F.col("found").alias("c"), F.slice("near", 1, F.size("found")).alias("b"), F.slice("near", 2, F.size("found")).alias("a"))
    none = F.struct(F.lit("").alias("tail"), F.lit("").alias("head"))
    piece = lambda x: lambda c, i: F.struct(c.alias("c"), F.when(i == 0, x["b"]).otherwise(none).alias("b"), F.when(i == F.size(x["c"]) - 1, x["a"]).otherwise(none).alias("a"))
    each = F.flatten(F.transform(ends, lambda x: F.transform(x["c"], piece(x))))
    out = rows.select("doc_id", "path", F.posexplode(each).alias("nth", "x"))
    return out.select("doc_id", "nth", F.col("x.c").alias("candidate"), F.col("x.b.tail").alias("before"), F.col("x.a.head").alias("after"), "path")


@dataclass
class Lexicon:
    """Frequent words, most frequent first, and log2 P(second letter | first letter) at 26 * first + second."""

    words: list[str]
    pairs: list[float]


#: Partitions of the made findings.
PARTS = 8


def learn(docs: DataFrame, text_col: str = "text", most_words: int = 1000) -> Lexicon:
    """Words and letter pairs of all documents; ``most_words`` words and 26 x 26 counts come to the driver."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("w")).where(F.length("w").between(3, 24))
    counts = written(words.groupBy("w").count(), "secret-words")
    top = counts.where(F.length("w") >= 4).orderBy(F.desc("count"), "w").limit(most_words).collect()
    at = counts.select("w", "count", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    letter = lambda i: F.ascii(F.substring(F.col("w"), i, F.lit(1))) - 97
    seen = at.groupBy((26 * letter(F.col("i")) + letter(F.col("i") + 1)).alias("pair")).agg(F.sum("count").alias("n")).collect()
    n = [0.5] * 676
    for r in seen:
        n[r.pair] += r.n
    return Lexicon([r.w for r in top], [math.log2(n[i] / sum(n[i // 26 * 26 : i // 26 * 26 + 26])) for i in range(676)])


def features(lexicon: Lexicon) -> dict[str, Column]:
    """Numeric features of a (candidate, before, after, path) row."""
    c, before, after, path = (F.col(x) for x in ("candidate", "before", "after", "path"))
    n = F.length(c)
    count = lambda pattern: (n - F.length(F.regexp_replace(c, pattern, ""))) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A"), "[^9aA]", "_")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    # runs of letters, cut before a capital that follows a small letter
    parts = F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    known = F.array(*[F.lit(w) for w in dict.fromkeys([*DICTIONARY.split("|"), *lexicon.words])])
    covered = F.aggregate(F.filter(parts, lambda w: (F.length(w) >= 3) & F.array_contains(known, w)), F.lit(0), lambda a, w: a + F.length(w))
    low, table_ = F.lower(c), F.array(*[F.lit(float(x)) for x in lexicon.pairs])
    at = lambda i: F.ascii(F.substring(low, i, F.lit(1))) - 97
    letter = lambda x: (x >= 0) & (x < 26)
    pair = lambda i: F.when(letter(at(i)) & letter(at(i + 1)), F.get(table_, 26 * at(i) + at(i + 1)))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), n - 1), pair), lambda x: x.isNotNull())
    usual = F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.size(pairs)).otherwise(F.lit(-8.0))
    return {
        "length": n.cast("double"),
        "digits": count("[0-9]"),
        "lower": count("[a-z]"),
        "upper": count("[A-Z]"),
        "marks": count("[^A-Za-z0-9]"),
        "transitions": (runs - 1) / n,
        "letter_pairs": F.size(pairs) / n,
        "usual_pairs": usual,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "dictionary": covered / n,
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "uuid": flag(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "number": flag(c.rlike(r"^[0-9.\-]+$")),
        "dotted": flag(c.rlike(r"^v?[0-9]+\.[0-9]+")),
        "known_form": flag(c.rlike(r"^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk_live_|sk-|AIza|glpat-|eyJ|npm_)")),
        "secret_word": flag(before.rlike(SECRET_WORDS)),
        "other_word": flag(before.rlike(OTHER_WORDS)),
        "assigned": flag(before.rlike(r"""[=:]\s*["']?$""")),
        "quoted": flag(before.rlike(r"""["']$""") & after.rlike(r"""^["']""")),
        "in_url": flag(before.rlike(r"(https?:|/)\S*$")),
        "mail": flag(after.rlike("^@")),
        "plain_path": flag(path.rlike(PLAIN_PATHS)),
    }


def _pick(options: tuple[str, ...], salt: str) -> Column:
    """One of the options by hash of the row's id."""
    at = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(x) for x in options]), at)


def sample_findings(spark: SparkSession, lexicon: Lexicon, n: int = 6000) -> DataFrame:
    """Labelled findings by rule, the same on every run; half are secrets, and words are the documents' own."""
    own = tuple(w for w in lexicon.words if len(w) > 4)[:100]
    word = lambda salt: _pick(("river", "table", "garden", "window", "letter", "market", "silver", "summer", *own), salt)
    base = spark.range(0, n, 1, PARTS).select("id", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int").alias("k"))
    hex_ = lambda salt, size: F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512), 1, size)
    b64 = lambda salt: F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 512)))
    url64 = lambda salt: F.translate(b64(salt), "+/=", "xyz")
    digits = lambda size: F.substring(F.concat(*[F.lpad(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10**9)).cast("string"), 9, "7") for i in range(3)]), 1, size)
    setting = _pick(("token", "api_key", "secret", "password", "auth_token", "SECRET_KEY", "access key", "client_secret", "Bearer"), "s")
    sign = _pick((' = "', "=", ": ", ": '", ' = "'), "g")
    lead = F.concat(word("l"), F.lit(" "), word("m"), F.lit(" "))
    other = _pick(("commit ", "sha1: ", "md5 ", "checksum = ", "revision: ", "etag: \"", "blob ", "build id "), "o")
    close = lambda s: F.when(F.endswith(s, F.lit('"')), F.lit('"')).when(F.endswith(s, F.lit("'")), F.lit("'")).otherwise(F.lit(" "))
    size = F.element_at(F.array(F.lit(20), F.lit(32), F.lit(40), F.lit(64)), F.pmod(F.xxhash64("id", F.lit("z")), F.lit(4)).cast("int") + 1)
    keyed, told = F.concat(lead, setting, sign), F.concat(lead, other)
    case = lambda hx: F.when(F.pmod(F.xxhash64("id", F.lit("c")), F.lit(5)) == 0, F.upper(hx)).otherwise(hx)
    kinds = [  # candidate, before, secret?
        (case(hex_("a", size)), keyed, 1),
        (case(hex_("b", size)), keyed, 1),
        (F.substring(url64("c"), 1, size), keyed, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(url64("d"), "xyz", "ABC"), 1, 16))), F.concat(lead, _pick(("aws_access_key_id = ", "key ", ""), "w")), 1),
        (F.concat(_pick(("ghp_", "sk_live_", "glpat-", "npm_"), "p"), F.substring(url64("e"), 1, 36)), F.concat(lead, _pick(("", "token: ", "use "), "u")), 1),
        (F.concat(F.lit("eyJ"), F.substring(url64("f"), 1, 60), F.lit("."), F.substring(url64("g"), 1, 43)), F.concat(lead, F.lit("Authorization: Bearer ")), 1),
        (F.substring(b64("h"), 1, size), keyed, 1),
        (F.substring(url64("i"), 1, 20), F.concat(lead, F.lit("password"), sign), 1),
        (hex_("j", size), told, 0),
        (F.regexp_replace(hex_("k", 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.concat(lead, _pick(("id: ", "uuid ", "key = ", ""), "v")), 0),
        (digits(16), lead, 0),
        (F.concat(word("1"), F.lit("-"), word("2"), F.lit("-"), word("3"), F.lit("-"), digits(4)), F.concat(lead, _pick(("https://example.com/blog/", "see /", "", "token: "), "q")), 0),
        (F.concat(F.lit("your-"), word("4"), F.lit("-example-key-"), digits(2)), keyed, 0),
        (F.concat(F.lit("v"), digits(1), F.lit("."), digits(2), F.lit(".0-release-build."), digits(3)), lead, 0),
        (F.concat(F.lit("iVBORw0KGgo"), F.substring(b64("l"), 1, 60)), F.concat(lead, F.lit("data:image/png;base64,")), 0),
        (F.concat(word("5"), F.lit("."), word("6"), digits(3)), lead, 0),
    ]
    pick = lambda i: F.element_at(F.array(*[F.struct(x[0].alias("candidate"), x[1].alias("before"), F.lit(x[2]).alias("label")) for x in kinds]), i)
    rows = base.withColumn("x", pick(F.col("k") + 1)).select("id", "x.*")
    mail = F.when((F.col("label") == 0) & F.rlike("candidate", F.lit(r"^[a-z]+\.[a-z]+[0-9]{3}$")), F.lit("@example.com ")).otherwise(close(F.col("before")))
    path = F.when((F.col("label") == 0) & (F.pmod("id", F.lit(3)) == 0), F.lit("docs/example.md")).otherwise(_pick(("src/main.py", "web", "config/app.ini", ""), "f"))
    return rows.select("candidate", F.right("before", F.lit(NEAR)).alias("before"), F.concat(mail, word("9")).alias("after"), path.alias("path"), "label")


def _vectors(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    made = features(lexicon)
    with_features = rows.select("*", *[x.cast("double").alias(f"__{name}") for name, x in made.items()])
    return VectorAssembler(inputCols=[f"__{name}" for name in made], outputCol="__features").transform(with_features)


def fit(findings: DataFrame, lexicon: Lexicon, trees: int = 24, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings, a table of bounded size."""
    forest = RandomForestClassifier(featuresCol="__features", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__predicted", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False)
    return forest.fit(_vectors(findings, lexicon).select("__features", F.col("label").cast("double").alias("label")))


def scored(rows: DataFrame, model: RandomForestClassificationModel, lexicon: Lexicon) -> DataFrame:
    """(candidate, before, after, path) rows with ``score``, the probability of a secret."""
    return model.transform(_vectors(rows, lexicon)).select(*rows.columns, vector_to_array("__probability")[1].alias("score"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, lexicon: Lexicon, **columns) -> DataFrame:
    """Candidates of ``docs`` with ``score``."""
    return scored(candidates(docs, **columns), model, lexicon)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lexicon = learn(docs)
    out = scan(docs, fit(sample_findings(spark, lexicon), lexicon), lexicon)
    return out.select("doc_id", "nth", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), F.col("score"), (F.col("score") >= 0.5).alias("secret"))
