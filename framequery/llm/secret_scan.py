"""Secret scans: candidate strings judged by a random forest.

One pattern finds candidates in whole texts, and each of their occurrences is
judged by its length, character transitions, dictionary coverage, path shape and
the words before and after it.  The forest is trained on labelled findings that
overlap: the same kinds of values stand in the same surroundings in both
classes, in different shares.  It is written out as an SQL expression over the
candidate's features, so a scan is one narrow pass over the texts.

Everything is a DataFrame or SQL function; the forest is Spark's own.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.common import table

#: Key blocks; values given to a telling name, or said after one; other long runs, and
#: shorter ones of letters and digits.  What is a candidate is wide, the forest decides.
NAMED = r"(?:passw(?:or)?d|secret|token|api[_-]?key|credential)s?[\"']?[ \t]*[:=][ \t]*[\"']?"
BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=:,.\s-]*?-----END [A-Z ]*PRIVATE KEY-----"
SAID = r"(?:passw(?:or)?d|secret|token|api[_ -]?key|credential|bearer|auth(?:orization)?)s?[\"']?(?:[ \t]*[:=][ \t]*|[ \t]+(?:(?:is|was|as)[ \t]+)?)[\"']?"
MARK = r"[A-Za-z0-9+/_=.\-]"
RUN = rf"(?<![\p{{L}}0-9+/_=.\-])(?:{MARK}{{16,}}+|(?=[A-Za-z+/_=.\-]*[0-9])(?=[0-9+/_=.\-]*[A-Za-z]){MARK}{{8,}}+)(?!\p{{L}})"
CANDIDATE = rf"{BLOCK}|(?i:{NAMED})[^\s\"'<>]{{8,}}|(?i:{SAID}){MARK}{{8,}}+(?!\p{{L}})|{RUN}"
#: What stands before the value in a candidate.
LEAD = rf"(?i)^(?:[A-Za-z0-9_.-]*?{NAMED}|{SAID})(?=.{{8}})"
#: Words that names and paths are made of.
DICTIONARY = "access account admin android apache archive array backup branch build bundle cache class client cloud code common config content controller count data date default demo description device document download email error example experimental factory field file final folder format function handler header home html image index info input integer internal java json label library license list local login main manager master media message method model module name node null number object order output package page param parser password path placeholder plugin private process project public query record release report request resource response result root sample schema script secret server service session source static status storage string style system table target temp template test text thread time title token type update user value version view widget window your"  # noqa: E501
#: Syllables of words in four languages.
SYLLABLES = "ment tion que con re pre de la le en er ver ung lich keit ein der un be ge sch ler au ou ion ar ir os as el al por est ado ida cion mente ing ed ness able over under inter per form port ist age ure ance ence ter tra ma na ra ni ti to do vo so"
KEY_WORDS = "token|secret|passw|api[_ -]?key|apikey|auth|bearer|credential|private|access[_ -]?key"
DIGEST_WORDS = "commit|sha1|sha256|sha-|md5|checksum|digest|etag|revision|uuid|guid|hash|version|build|example|integrity"
FEATURES = ("length", "digits", "upper", "lower", "marks", "transitions", "distinct", "vowels", "dictionary", "slashes", "dots", "extension", "hex", "prefix", "key_near", "digest_near", "given", "host", "key_after", "digest_after", "clusters", "rare", "words")  # noqa: E501


def features_sql(c: str, before: str, after: str) -> str:
    """SQL for the array of FEATURES of candidate ``c`` between two texts."""
    n = f"greatest(length({c}), 1)"
    left = lambda pattern: f"CAST(length(regexp_replace({c}, '{pattern}', '')) AS DOUBLE) / {n}"
    flag = lambda subject, pattern: f"IF({subject} rlike '{pattern}', 1D, 0D)"
    words = "|".join(sorted(DICTIONARY.split(), key=len, reverse=True))
    turns = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    parts = [
        f"CAST(least(length({c}), 400) AS DOUBLE)",
        left("[^0-9]+"),
        left("[^A-Z]+"),
        left("[^a-z]+"),
        left("[A-Za-z0-9]+"),
        f"CAST(regexp_count({c}, '{turns}') AS DOUBLE) / {n}",
        f"CAST(size(array_distinct(split({c}, ''))) AS DOUBLE) / least({n}, 64)",
        left("[^aeiouAEIOU]+"),
        f"1D - CAST(length(regexp_replace(lower({c}), '{words}', '')) AS DOUBLE) / {n}",
        f"CAST(regexp_count({c}, '/') AS DOUBLE)",
        f"CAST(regexp_count({c}, '[.]') AS DOUBLE)",
        flag(c, "[.][a-z]{1,5}$"),
        flag(c, "^[0-9a-fA-F]+$"),
        flag(c, "^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|sk_live_|eyJ|glpat-|AIza|-----BEGIN)"),
        flag(before, f"(?i)({KEY_WORDS})s?[^a-z]{{0,12}}((is|was|as|bearer|basic)[^a-z]{{1,4}})?$"),
        flag(before, f"(?i)({DIGEST_WORDS})[^a-z]{{0,12}}$"),
        flag(before, "[:=][ ]*[\"'']?$".replace("''", "\\'")),
        flag(before, "(://|@)[^ ]{0,40}$"),
        flag(after, f"(?i)^[^a-z]{{0,4}}(is |as |was |for )?(the |an |a |our )?({KEY_WORDS})"),
        flag(after, f"(?i)^[^a-z]{{0,4}}(is |as |was |for )?(the |an |a |our )?({DIGEST_WORDS})"),
        f"CAST(regexp_count(lower({c}), '[bcdfghjklmnpqrstvwxz]{{4,}}') AS DOUBLE) / {n}",
        left("[^jkqvwxzJKQVWXZ]+"),
        flag(c, "^[A-Z]?[a-z]+$|^[A-Z]+$"),
    ]
    return f"array({', '.join(parts)})"


def _one_of(items: list[str], salt: int) -> str:
    """SQL for an item chosen by the hash of the id."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in items)
    return f"element_at(array({quoted}), CAST(pmod(xxhash64(id, {salt}), {len(items)}) AS INT) + 1)"


def labelled_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """(value, before, after, label): ``rows`` findings made by rule from digests
    of their number, half of them secrets.  The bound on the training set.

    Both classes hold digests, letters and names, short and long, after key words,
    digest words or any words, in different shares; letters without a key word near
    them are no secret; 2 in 100 labels are wrong.
    """
    made = spark.range(0, rows, 1, 4).selectExpr(
        "id",
        "sha1(concat('a', id)) AS hex",
        "translate(base64(unhex(sha2(concat('b', id), 256))), '+/=', 'xyz') AS alnum",
        "translate(base64(unhex(sha2(concat('e', id), 512))), '+/=0123456789', 'xyzabcdEFGHIJ') AS letters",
        "base64(unhex(sha2(concat('c', id), 512))) AS b64",
        "CAST(pmod(xxhash64(id), 1000) AS INT) AS k",
        "pmod(xxhash64(id, 1), 100) AS roll",
        "pmod(xxhash64(id, 2), 100) AS roll_after",
        "pmod(id, 2) AS label",
        "pmod(CAST(id / 2 AS BIGINT), 16) AS kind",
    )
    words = DICTIONARY.split()
    word = lambda salt: _one_of(words, salt)
    key = _one_of(['token = "', "api_key: ", "password=", "secret = '", "Authorization: Bearer ", "bearer ", "the token is ", "password is ", 'access_key="', "the new token ", "credentials: ", "auth "], 20)
    digest = _one_of(["commit ", "sha1: ", "checksum = ", "md5=", 'etag: "', "revision ", "digest=", "build ", "uuid "], 21)
    plain = _one_of(["see the ", "in that of ", "then from ", "und der ", "de la ", 'x = "', "name: ", "", "was not ", "https://", "me@"], 22)
    before = f"""CASE WHEN roll < sure THEN {key} WHEN roll < sure + (100 - sure) * 0.6 THEN {plain} ELSE {digest} END"""
    after = f"""CASE WHEN roll_after < IF(label = 1, 2, 12) THEN concat(' ', {_one_of(["is the commit", "as checksum", "the digest", "was the build", "sha1"], 23)})
        WHEN roll_after < IF(label = 1, 14, 15) THEN concat(' ', {_one_of(["is the token", "as password", "for auth", "the api key"], 24)})
        ELSE concat({_one_of(['" ', " ", ". ", "' ", ", "], 25)}, {word(26)}, ' ', {word(27)}) END"""
    syllable = lambda salt: _one_of(SYLLABLES.split(), salt)
    spoken = f"concat({', '.join(syllable(40 + i) for i in range(3))}, IF(k % 2 = 0, concat({syllable(44)}, {syllable(45)}), ''), IF(k % 3 = 0, concat({syllable(46)}, {syllable(47)}, {syllable(48)}), ''))"
    secret = """CASE kind WHEN 0 THEN hex WHEN 1 THEN upper(hex) WHEN 2 THEN substr(alnum, 1, 20 + k % 24) WHEN 3 THEN concat('AKIA', upper(substr(alnum, 1, 16)))
        WHEN 4 THEN concat('ghp_', substr(alnum, 1, 36)) WHEN 5 THEN substr(b64, 1, 24 + k % 60) WHEN 6 THEN concat('eyJ', substr(b64, 1, 30), '.', substr(alnum, 1, 40))
        WHEN 7 THEN concat('-----BEGIN PRIVATE KEY-----', b64, b64, '-----END PRIVATE KEY-----') WHEN 8 THEN sha2(hex, 256)
        WHEN 9 THEN substr(letters, 1, 16 + k % 24) WHEN 10 THEN concat('sk_live_', substr(alnum, 1, 24))
        WHEN 11 THEN lower(substr(letters, 1, 16 + k % 20)) WHEN 12 THEN upper(substr(letters, 1, 16 + k % 20)) WHEN 13 THEN substr(alnum, 1, 8 + k % 8)
        WHEN 14 THEN lower(substr(alnum, 1, 10 + k % 8)) ELSE concat(substr(alnum, 1, 7), '!', k, substr(b64, 1, 5)) END"""
    other = f"""CASE kind WHEN 0 THEN hex WHEN 1 THEN concat(substr(hex, 1, 8), '-', substr(hex, 9, 4), '-4', substr(hex, 13, 3), '-', substr(hex, 16, 4), '-', substr(hex, 20, 12))
        WHEN 2 THEN concat({word(2)}, '/', {word(3)}, '/', {word(4)}, k, '.txt') WHEN 3 THEN concat({word(5)}, k, '.', {word(6)}, '.example.com')
        WHEN 4 THEN concat({word(8)}, initcap({word(9)}), initcap({word(10)}), k) WHEN 5 THEN concat({word(11)}, '_', {word(12)}, '_', {word(13)}, '_', k)
        WHEN 6 THEN concat(k % 9, '.', k % 17, '.', k, '-rc', k % 5, '.20', 10 + k % 20, '0101') WHEN 7 THEN concat('your_', {word(14)}, '_', {word(15)}, '_here')
        WHEN 8 THEN concat(1000 + k, 1000000 + k * 7919, 100000 + k * 31) WHEN 9 THEN sha2(hex, 256) WHEN 10 THEN concat({word(17)}, initcap({word(18)}), initcap({word(19)}), 'Of', initcap({word(16)}))
        WHEN 11 THEN IF(k % 3 = 0, lower(substr(letters, 1, 16 + k % 16)), {spoken}) WHEN 12 THEN CASE k % 3 WHEN 0 THEN upper(substr(letters, 1, 16 + k % 16)) WHEN 1 THEN initcap({spoken}) ELSE upper({spoken}) END WHEN 13 THEN concat({word(30)}, k, IF(k % 2 = 0, '', concat('-', {word(31)})))
        WHEN 14 THEN concat({syllable(49)}, {syllable(50)}, IF(k % 2 = 0, '-', '.'), {spoken})
        ELSE concat('20', 10 + k % 20, '-0', 1 + k % 9, '-1', k % 10, 'T0', k % 10, '.', k, '-', {word(16)}) END"""  # noqa: E501
    sure = "CASE WHEN label = 1 THEN IF(kind IN (3, 4, 6, 7, 10), 30, IF(kind >= 11, 96, 90)) WHEN kind IN (0, 1, 9) THEN 8 WHEN kind IN (11, 12) AND k % 3 = 0 THEN 2 WHEN kind IN (11, 12, 14) THEN 45 ELSE 30 END AS sure"
    drawn = made.selectExpr("*", sure).selectExpr("id", "label", f"IF(label = 1, {secret}, {other}) AS value", f"{before} AS before", f"{after} AS after")
    wrong = "pmod(xxhash64(id, 3), 100) < 2"
    return drawn.selectExpr("value", "before", "after", f"CAST(IF({wrong}, 1 - label, label) AS DOUBLE) AS label")


def train(findings: DataFrame, trees: int = 24, depth: int = 7) -> RandomForestClassificationModel:
    """The forest for (value, before, after, label) rows."""
    rows = findings.selectExpr("label", f"{features_sql('value', 'before', 'after')} AS v")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt")
    return forest.fit(rows.select("label", array_to_vector("v").alias("features")))


def forest_sql(model: RandomForestClassificationModel, v: str) -> str:
    """The share of trees that say secret, as SQL over the feature array ``v``."""
    trees: list[list[str]] = []
    for line in model.toDebugString.splitlines()[1:]:
        if line.strip().startswith("Tree"):
            trees.append([])
        elif line.strip():
            trees[-1].append(line.strip())

    def node(lines: list[str]) -> str:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1])}D"
        k, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node(lines)
        lines.pop(0)
        return f"IF({v}[{k}] <= {float(bound)!r}D, {yes}, {node(lines)})"

    return f"(({' + '.join(node(t) for t in trees)}) / {len(trees)}D)"


@lru_cache(maxsize=4)
def _default_forest(spark: SparkSession) -> str:
    return forest_sql(train(labelled_findings(spark)), "f.v")


def _quoted(pattern: str) -> str:
    escaped = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def with_findings(docs: DataFrame, forest: str | None = None) -> DataFrame:
    """(row, text, found): the whole row, its text, and for each occurrence of a
    candidate in the whole text its value, position (from 1) and score.

    Candidates are what stands between the pieces of the text split at them, so
    the words around each and its position need no search.  Every run of 16 marks,
    every one of 8 with letters and digits, and all that is given to a telling name
    or said after one is a candidate.  Null and empty texts have none.
    """
    forest = forest or _default_forest(docs.sparkSession)
    cut = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    cut = cut.select("row", "text", F.expr(f"regexp_extract_all(text, {_quoted(CANDIDATE)}, 0)").alias("c"))
    # Most texts have no candidate, and are not split.
    cut = cut.select("*", F.expr(f"IF(size(c) > 0, split(text, {_quoted(CANDIDATE)}, -1), NULL)").alias("p"))
    ends = """aggregate(sequence(0, size(c) - 1), array(0), (a, i) -> array_append(a, element_at(a, -1) + length(p[i]) + length(c[i])))"""
    cut = cut.select("*", F.expr(f"IF(size(c) > 0, {ends}, NULL)").alias("ends"))
    named = f"""transform(c, (v, i) -> named_struct('whole', v, 'value', regexp_replace(v, {_quoted(LEAD)}, ''), 'i', i))"""
    around = """named_struct('value', f.value, 'start', ends[f.i + 1] - length(f.value) + 1,
        'before', right(concat(p[f.i], left(f.whole, length(f.whole) - length(f.value))), 48), 'after', left(p[f.i + 1], 48))"""
    with_v = f"named_struct('value', f.value, 'start', f.start, 'v', {features_sql('f.value', 'f.before', 'f.after')})"
    score = f"named_struct('value', f.value, 'start', f.start, 'score', {forest})"
    judged = f"transform(transform(transform({named}, f -> {around}), f -> {with_v}), f -> {score})"
    return cut.select("row", "text", F.expr(f"IF(size(c) > 0, {judged}, NULL)").alias("found"))


def secret_findings(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, occurrences, digest, score, is_secret: one row for
    each distinct candidate of each document row, with its first position and
    the highest score of its occurrences.

    The value itself is not given out, only its SHA-256.  Null and empty texts
    and empty tables give no rows; a null doc_id is kept; repeated rows give
    repeated findings; other columns are ignored.
    """
    each = with_findings(docs.select("doc_id", "text")).withColumn("at", F.monotonically_increasing_id())
    each = each.select("at", F.col("row.doc_id").alias("doc_id"), F.explode("found").alias("f"))
    score = F.max("f.score").alias("score")
    found = each.groupBy("at", "doc_id", "f.value").agg(F.min("f.start").alias("start"), F.count("*").alias("occurrences"), score)
    return found.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.length("value").cast("long").alias("length"),
        "occurrences",
        F.sha2("value", 256).alias("digest"),
        "score",
        (F.col("score") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, threshold: float = 0.5, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``mark`` wherever it
    stands, longest first; n_chars follows the text where it changed.

    Null and empty texts stay; a value is confirmed by any of its occurrences;
    all columns of whatever name are kept.
    """
    confirmed = f"""array_sort(array_distinct(transform(filter(found, f -> f.score >= {threshold}D), f -> f.value)),
        (a, b) -> CASE WHEN length(a) > length(b) THEN -1 WHEN length(a) < length(b) THEN 1 WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)"""  # noqa: E501
    clean = F.expr(f"IF(found IS NULL, text, aggregate({confirmed}, text, (t, s) -> replace(t, s, {_quoted(mark)})))")
    out = with_findings(docs).select("row", "text", clean.alias("clean"))
    columns = [F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("clean") != F.col("text"), F.length("clean").cast(kind)).otherwise(F.col("row.n_chars"))
        columns[docs.columns.index("n_chars")] = length.alias("n_chars")
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))
