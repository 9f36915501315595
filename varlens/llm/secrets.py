"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything runs as DataFrame expressions: the text is marked at its candidates, split, and each
candidate described by its length, character transitions, dictionary coverage, path and neighbouring
words. The dictionary is a short list of words of code and the words that the corpus itself uses. The
forest (Spark ML) learns from labelled findings; where none are given, findings are made by rule
(labelled_findings).

Candidates are long runs of the characters of keys and encodings, and whatever is assigned to a name
that tells a secret, of any length and alphabet.
"""

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import fresh, small, written

#: Names that tell a secret.
NAMES = "token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer"
_SPACE, _QUOTE = r"\x20\x09-\x0D", "\"'`"
#: Such a name and an assignment; what follows up to a space or quote, without punctuation at its end, is a candidate.
NAMED = rf"(?i:{NAMES})[A-Za-z0-9_.-]{{0,12}}[{_QUOTE}\]]?[ \t]{{0,3}}(?::=|=>|[:=])[ \t]{{0,3}}[{_QUOTE}]?"
VALUE = rf"[^{_SPACE}{_QUOTE}]*[^{_SPACE}{_QUOTE},;.:)\]}}>]"
#: So are sixteen or more characters of keys and encodings, with a digit or two rises of case.
_CHARS = "A-Za-z0-9+/_-"
LONG = rf"(?<![{_CHARS}])(?=[A-Za-z+/_-]*+[0-9]|[A-Z]*+[a-z]++[A-Z]++[a-z]*+[A-Z])[{_CHARS}]{{16,}}+={{0,2}}"
CANDIDATE = rf"({NAMED})({VALUE})|({LONG})"
OPEN, CLOSE, ESCAPE = "\u0001", "\u0002", "\u0003"
#: How characters of a text that are used as marks are written while it is marked.
ESCAPES = ((ESCAPE, ESCAPE + "\u0006"), (OPEN, ESCAPE + "\u0004"), (CLOSE, ESCAPE + "\u0005"))
BEFORE, AFTER, THRESHOLD = 48, 24, 0.5
REDACTED = "[SECRET]"
TREES, DEPTH, SEED, EXAMPLES = 30, 9, 7, 9000
#: A word of the corpus is in the dictionary if this many documents have it, standing by itself.
LEAST_DOCS = 3

#: Words of identifiers, paths and placeholders.
DICTIONARY = (
    "about above access account action active add admin after agent alpha api app apple archive area array article asset async attribute "
    "author auto back base batch beta bin block board body book branch buffer build bundle button byte cache call case center change "
    "changeme channel chapter char check child class client cloud code collection color column comment commit common component config "
    "connect content control copy core count create current custom data date debug default delete demo detail device dir directory doc "
    "document domain dummy edit element email empty enable end entity entry error event example export factory false fake feature field "
    "file filter final find first folder font form format frame from function generic get global group handler hash head header hello "
    "here home host html http image index info init inner input insert instance integer interface internal item java job json key label "
    "last layer layout length level library license line link list local log login long main manager map master max media member memory "
    "message meta method middle min mode model module month name network new next node none note null number object offset old open option "
    "order org output page parent parse password path pattern phone place placeholder plugin point pool post prefix print private process "
    "product profile project property public query read record release remove replace report request reset resource response result return "
    "role root route row rule sample save schema scope script search secret section select send server service session set setting size "
    "source src stack start state static status step stop storage store stream string style sub system table target task template test text "
    "the thread time title token tool total true type update upload url user util value var version view web window word work world write "
    "xxxx year your zero"
).split()

FEATURES = {
    "f_length": "length(candidate)",
    "f_switch": "(length(regexp_replace(candidate, '([0-9])(?=[A-Za-z])|([A-Za-z])(?=[0-9])|([a-z])(?=[A-Z])|([A-Z])(?=[a-z])', '..')) - length(candidate)) / length(candidate)",
    "f_vowel_pairs": "(length(candidate) - length(regexp_replace(candidate, '(?i)[aeiou][bcdfghjklmnpqrstvwxyz]|[bcdfghjklmnpqrstvwxyz][aeiou]', ''))) / length(candidate)",
    "f_digits": "length(regexp_replace(candidate, '[^0-9]', '')) / length(candidate)",
    "f_upper": "length(regexp_replace(candidate, '[^A-Z]', '')) / length(candidate)",
    "f_hex": "length(regexp_replace(candidate, '[^0-9a-f]', '')) / length(candidate)",
    "f_distinct": "size(array_distinct(split(candidate, ''))) / least(length(candidate), 40)",
    "f_dictionary": f"greatest((length(candidate) - length(regexp_replace(candidate, '(?i){'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', ''))), in_corpus) / length(candidate)",
    "f_lower": "length(regexp_replace(candidate, '[^a-z]', '')) / length(candidate)",
    "f_special": "length(regexp_replace(candidate, '[A-Za-z0-9+/_=-]', '')) / length(candidate)",
    "f_template": "CAST(candidate RLIKE '^[<$%{*]|[(){}]|[>*]$' AS INT)",
    "f_repeat": "(length(candidate) - length(regexp_replace(candidate, '(.)\\\\1{2,}', ''))) / length(candidate)",
    "f_slashes": "length(regexp_replace(candidate, '[^/]', ''))",
    "f_dashes": "length(regexp_replace(candidate, '[^_-]', ''))",
    "f_path": "CAST(before RLIKE '(://|[/\\\\\\\\.])[^ ]*$' AS INT) + CAST(`after` RLIKE '^[.](com|org|net|png|jpg|html?|js|css|txt|py|md)' AS INT) + CAST(path RLIKE '(?i)(test|example|fixture|sample|doc)' AS INT)",
    "f_key_word": "CAST(before RLIKE '(?i)(token|secret|passw|passwd|pwd|api.?key|access.?key|auth|credential|private|bearer)[^ ]{0,12}[ ]*[:=]?[ ]*[^ A-Za-z0-9]{0,4}$' AS INT)",
    "f_sum_word": "CAST(before RLIKE '(?i)(commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|revision|version|etag|build|order|card|phone|isbn|ref)[^ ]{0,6}[ ]*[:=]?[ ]*[^ A-Za-z0-9]{0,4}$' AS INT)",
    "f_assigned": "CAST(before RLIKE '[:=][ ]*[^ A-Za-z0-9]{0,3}$' AS INT)",
    "f_quoted": "CAST(before RLIKE '[^ A-Za-z0-9=:]$' AND `after` RLIKE '^[^ A-Za-z0-9]' AS INT)",
}


def marked(text: Column) -> Column:
    """The text cut before each candidate: an array whose items, but for the first, are candidate, CLOSE and what follows.

    Characters used as marks are escaped in the items; plain() gives them back.
    """
    safe = text
    for raw, written_ in ESCAPES:
        safe = F.replace(safe, F.lit(raw), F.lit(written_))
    safe = F.when(text.rlike(f"[{OPEN}{CLOSE}{ESCAPE}]"), safe).otherwise(text)
    return F.split(F.regexp_replace(safe, CANDIDATE, f"$1{OPEN}$2$3{CLOSE}"), OPEN)


def plain(text: Column) -> Column:
    """An escaped text as it was."""
    for raw, written_ in reversed(ESCAPES):
        text = F.replace(text, F.lit(written_), F.lit(raw))
    return text


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, path, ordinal (from 1 in each row), start (characters before it), candidate, before, after.

    The path is the column source where docs has one. Null and empty texts have no candidates; repeated
    rows each have theirs.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", text_hash().alias("text_hash"), path.alias("path"), F.monotonically_increasing_id().alias("row"), "text")
    cut = rows.select("doc_id", "text_hash", "path", "row", F.posexplode(marked(F.col("text"))).alias("ordinal", "whole"))
    rest = F.when(F.col("ordinal") == 0, F.col("whole")).otherwise(F.substring_index("whole", CLOSE, -1))
    cut = cut.withColumns({"size": F.length(plain(F.col("whole"))) - F.least("ordinal", F.lit(1)), "rest": plain(rest)})
    cut = cut.select("doc_id", "text_hash", "path", "row", "ordinal", "size", plain(F.substring_index("whole", CLOSE, 1)).alias("candidate"), F.expr(f"right(rest, {BEFORE})").alias("tail"), F.expr(f"left(rest, {AFTER})").alias("after"))
    cut = cut.withColumn("candidate", F.when(F.col("ordinal") > 0, F.col("candidate")))  # the first item is no candidate, and may be long
    order = Window.partitionBy("row").orderBy("ordinal")
    cut = cut.withColumns({"start": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), "before": F.lag("tail").over(order)})
    return cut.where("ordinal > 0").select("doc_id", "text_hash", "path", "ordinal", "start", "candidate", "before", "after")


def parts(candidate: Column) -> Column:
    """The runs of letters of a candidate that may be words, in lower case, cut where case rises."""
    return F.array_distinct(F.transform(F.regexp_extract_all(candidate, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), F.lower))


def with_words(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found with in_corpus: letters of each candidate in words that LEAST_DOCS documents or more use.

    All texts are read for words, but only those that are part of a candidate are counted.
    """
    wanted = written(found.select(F.explode(parts(F.col("candidate"))).alias("word")).distinct(), "candidate-words")
    used = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![^\x20\x09-\x0D])[a-z]{2,}(?=[\x20\x09-\x0D.,;:!?]|$)"), F.lit(0)))
    words = docs.select(F.explode(used).alias("word")).join(small(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).select("word")
    words = written(words, "corpus-words")
    each = found.select("candidate").distinct().select("candidate", F.explode(parts(F.col("candidate"))).alias("word"))
    held = each.join(small(words), "word").groupBy("candidate").agg(F.sum(F.length("word")).cast("int").alias("in_corpus"))
    return found.join(small(written(held, "candidate-coverage")), "candidate", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(0)))


def features(rows: DataFrame) -> DataFrame:
    """rows (candidate, before, after, path and, where it was counted, in_corpus) with FEATURES."""
    if "in_corpus" not in rows.columns:
        rows = rows.withColumn("in_corpus", F.lit(0))
    return rows.withColumns({name: F.expr(sql).cast("double") for name, sql in FEATURES.items()})


def labelled_findings(spark: SparkSession, examples: int = EXAMPLES) -> DataFrame:
    """Findings made by rule: candidate, before, after, path and label (1: a secret), half of each kind.

    Random values in the usual encodings and pass words under the usual names are secrets; sums, ids, numbers,
    words, paths, rules of one character, and words, placeholders, masks and expressions under the same
    names are not.
    """
    hexa = "sha2(concat('a', id), 512)"
    base = "base64(unhex(sha2(concat('b', id), 384)))"
    plain_ = f"regexp_replace({base}, '[^A-Za-z0-9]', '')"
    pick = lambda salt, *xs: f"element_at(array({', '.join(xs)}), 1 + CAST(pmod(xxhash64(id, '{salt}'), {len(xs)}) AS INT))"
    text = lambda *xs: [f"'{x}'" for x in xs]
    words = "array(" + ", ".join(text(*DICTIONARY)) + ")"
    word = lambda salt: f"element_at({words}, 1 + CAST(pmod(xxhash64(id, '{salt}'), {len(DICTIONARY)}) AS INT))"
    size = "16 + CAST(pmod(xxhash64(id, 'n'), 33) AS INT)"
    filler = f"concat({word('p')}, ' ', {word('q')}, ' ', {word('r')})"
    name = pick("k", *text("token", "secret", "api_key", "apikey", "access_key", "auth_token", "password", "client_secret", "private_key", "API_TOKEN", "Authorization: Bearer", "DB_PASSWORD", "pwd", "passwd", "user.password", "API_KEY"))
    gap = pick("g", *[f"'{x}'" for x in (" = \"", "=", ": ", ": \"", "### = \"", "= ", "=\"", " = ", "\": \"", " := \"")])
    letters = f"regexp_replace({plain_}, '[^A-Za-z]', '')"
    pass_word = f"concat(initcap({word('u')}), CAST(pmod(xxhash64(id, 'd'), 9990) + 10 AS STRING), {pick('x', *text('!', '@', '$', '', 'x', '#1'))})"
    random_ = f"concat(left({plain_}, 3), {pick('y', *text('!', '@', '$', '%', '&', '#', '^'))}, right({plain_}, CAST(4 + pmod(xxhash64(id, 'w'), 8) AS INT)))"
    secret = pick(
        "s", f"left({hexa}, 40)", f"left({hexa}, 32)", f"left({hexa}, 64)", f"left({base}, 40)", f"concat('sk_live_', left({plain_}, 24))", f"concat('ghp_', left({plain_}, 36))", f"concat('AKIA', upper(left({plain_}, 16)))", f"left({plain_}, {size})",
        pass_word, random_, f"left({plain_}, CAST(8 + pmod(xxhash64(id, 'v'), 8) AS INT))", f"lower(left({letters}, CAST(10 + pmod(xxhash64(id, 'l'), 14) AS INT)))", f"left({hexa}, 40)",
    )
    other_name = pick("o", *text("commit ", "sha256: ", "md5 = ", "checksum=", "id: ", "uuid=", "version ", "revision ", "order ", "phone ", "card ", "https://host/", "see /usr/", "", "", ""))
    spread = "concat_ws('-', left(x, 8), substring(x, 9, 4), substring(x, 13, 4), substring(x, 17, 4), substring(x, 21, 12))".replace("x", hexa)
    other = pick(
        "f", f"left({hexa}, 40)", f"left({hexa}, 32)", spread, "lpad(CAST(abs(xxhash64(id)) AS STRING), 16, '4')", "left(concat(abs(xxhash64(id)), abs(xxhash64(id, 1))), 20)",
        f"concat({word('a')}, initcap({word('b')}), initcap({word('c')}), initcap({word('d')}), 'Name1')", f"concat_ws('_', {word('a')}, {word('b')}, {word('c')}, {word('d')}, '2024')",
        f"concat_ws('/', {word('a')}, {word('b')}, {word('c')}, {word('d')}, 'v2')", "concat(repeat('x', 20), '1')", "concat('YOUR_API_KEY_HERE_', pmod(id, 100))", "repeat('=', 20)", f"concat({word('a')}, {word('b')}, {word('c')}, {word('d')}, '1')",
    )
    # what stands after a secret's name without being one: words, placeholders, expressions, masks
    blank = pick(
        "b", word("a"), word("b"), f"initcap({word('c')})", f"concat({word('a')}, '_', {word('b')})", f"concat('<', {word('a')}, '>')", f"concat(char(36), '{{', upper({word('b')}), '}}')", f"concat({word('a')}, '.', {word('b')}, '(')", f"concat({word('a')}, '(', {word('b')})",
        "'changeme'", "'your_password_here'", "'[SECRET'", "'[REDACTED'", "repeat('*', CAST(6 + pmod(id, 8) AS INT))", "repeat('x', CAST(6 + pmod(id, 8) AS INT))", "'none'", "'true'", "'null'", "CAST(pmod(id, 60) AS STRING)", f"concat({word('a')}, '-', {word('b')})", f"concat('process.env.', upper({word('c')}))",
    )
    made_up = "concat(" + ", ".join(pick(f"m{k}", *text(*m)) for k, m in enumerate((("", "re", "pa", "ne", "un", "ca", "be", "to"), ("ver", "ti", "qui", "mo", "len", "sta", "ri", "go"), ("ence", "red", "n", "ment", "ing", "ly", "ter", "")))) + ")"
    blank = f"CASE WHEN pmod(xxhash64(id, 'made'), 4) = 0 THEN {made_up} ELSE {blank} END"
    under_name = "pmod(xxhash64(id, 'under'), 3) = 0"
    # a plain sum is no secret only because of its name, so it never comes without one
    named = f"CASE WHEN length({other}) IN (32, 40) AND {other} RLIKE '^[0-9a-f]+$' AND {other_name} NOT RLIKE '(commit|sha|md5|check|id|rev)' THEN 'commit ' ELSE {other_name} END"
    close = pick("e", *[f"'{x}'" for x in ("\" and", "\"### ", "\"\n", " ", "\n", ", the")])
    rows = spark.range(examples).withColumn("label", (F.col("id") % 2).cast("double"))
    return rows.select(
        "label", F.expr(f"CASE WHEN label = 1 THEN {secret} WHEN {under_name} THEN {blank} ELSE {other} END").alias("candidate"),
        F.expr(f"concat({filler}, ' ', CASE WHEN label = 1 OR {under_name} THEN concat({name}, {gap}) ELSE {named} END)").alias("before"),
        F.expr(f"CASE WHEN label = 1 OR {under_name} AND pmod(id, 4) = 0 THEN {close} ELSE concat(' ', {word('z')}) END").alias("after"), F.expr(pick("t", *text("src0", "src1", "app/main.py", "docs/readme.md", "test/data.txt"))).alias("path"),
    )


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest over FEATURES of labelled findings (candidate, before, after, path, label)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(features(findings))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(rows.select("features", "label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """All candidates of docs with score (the forest's chance of a secret) and is_secret.

    findings: labelled ones to learn from; those of labelled_findings() if neither they nor a model of
    train() are given. Null and empty texts have no candidates, very long ones are scanned whole, repeated rows each have their candidates;
    an empty table gives no rows.
    """
    model = model or train(labelled_findings(docs.sparkSession) if findings is None else findings)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(features(with_words(candidates(docs), docs)))
    score = vector_to_array("probability")[1]
    return model.transform(rows).withColumn("score", score).withColumn("is_secret", F.col("score") >= THRESHOLD).drop(*FEATURES, "in_corpus", "features", "probability", "rawPrediction", "prediction")


def redacted(docs: DataFrame, findings: DataFrame | None = None, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """docs with every secret replaced by REDACTED, and n_chars (where docs has it) brought up to date.

    All rows and all other characters stay as they are, null and empty texts and control characters among
    them; repeated rows are redacted alike. Columns of docs may have any names.
    """
    id_, text, hash_, at = fresh(docs, "id", "text_hash", "hash", "at")
    found = scan(docs, findings, model).where("is_secret").groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(text)).agg(F.collect_set("ordinal").alias(at))
    found = written(found, "secrets")
    rows = docs.withColumn(hash_, text_hash())
    rows = rows.join(small(found), rows["doc_id"].eqNullSafe(F.col(id_)) & (rows[hash_] == F.col(text)), "left")
    part = lambda x, i: F.when(F.array_contains(at, i), F.concat(F.lit(REDACTED), F.substring_index(x, CLOSE, -1))).otherwise(F.translate(x, CLOSE, ""))
    rows = rows.withColumn("text", F.when(F.col(at).isNull(), F.col("text")).otherwise(plain(F.array_join(F.transform(marked(F.col("text")), part), ""))))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(at).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)
