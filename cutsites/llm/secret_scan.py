"""Secret scans with a random forest that removes false positives; Spark's own expressions and its ML library only.

Candidates are maximal runs of at least 16 characters of ``[A-Za-z0-9_+/=-]``. Each is described by its length, the transitions between classes
of neighbouring characters, the share covered by a dictionary, the words and characters around it, and the path of its document; the forest
says how likely it is a secret. The dictionary is the ``DICTIONARY`` most frequent words of all documents.

The forest is trained on at most ``MAX_FINDINGS`` labelled findings (``doc_id, start, secret``) with the smallest md5; these are an input.
``format_findings`` gives labels where there are none: published key formats are secrets; plain words, numbers and paths are not.

Null and empty texts have no candidates. Positions count code points from 0. Repeated rows are scanned one by one. Ties in the forest go to
"no secret" at a score of 0.5. Without findings of both classes the score is 0 for all. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutsites.llm.common import written

TOKEN = "[A-Za-z0-9_+/=-]{16,}+"
CONTEXT = 64
DICTIONARY = 500
MAX_FINDINGS = 20_000
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CLASSES = f"translate(token, '{_UPPER}{_LOWER}{_DIGIT}', '{'U' * 26}{'l' * 26}{'d' * 10}')"

# Words that name secrets, and parts of paths where examples live.
NAMES = "(?:token|secret|passw|passwd|pwd|api|key|auth|bearer|credential|private|access)"
EXAMPLES = "(?:test|example|sample|fixture|mock|dummy|doc)"


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id, start, token, before, after, path``: every candidate with up to ``CONTEXT`` characters around it."""
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{path}`").cast("string").alias("path"), F.monotonically_increasing_id().alias("row"),
        F.expr(f"regexp_extract_all(`{text}`, '{TOKEN}', 0)").alias("tokens"), F.expr(f"split(`{text}`, '{TOKEN}', -1)").alias("pieces"),
    ).where("size(tokens) > 0")
    # pieces[i] stands before tokens[i], pieces[i + 1] after it.
    between = f"transform(pieces, p -> struct(length(p) as n, right(p, {CONTEXT}) as tail, left(p, {CONTEXT}) as head))"
    rows = rows.withColumn("pieces", F.expr(between)).select(
        "doc_id", "path", "row", F.posexplode(F.expr("transform(tokens, (t, i) -> struct(t as token, pieces[i].n as gap, pieces[i].tail as before, pieces[i + 1].head as after))"))
    ).select("doc_id", "path", "row", "pos", "col.*")
    upto = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("token")).over(upto) - F.length("token")
    return rows.select("doc_id", start.cast("long").alias("start"), "token", "before", "after", "path")


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 24 letters, over all documents; ties by the word."""
    words = docs.select(F.explode(F.expr(f"regexp_extract_all(lower(`{text}`), '(?<![a-z])[a-z]{{3,24}}+(?![a-z])', 0)")).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    return [r.word for r in top.collect()]


def word_pattern(words: list[str]) -> str:
    """A regular expression for any of the words, the longest first; shared beginnings are tested once."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def walk(node: dict) -> str:
        ways = [k + walk(v) for k, v in sorted(node.items()) if k]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:{body})?" if "" in node else body

    return walk(tree)


def features(found: DataFrame, words: list[str]) -> tuple[DataFrame, list[str]]:
    """Candidates with their numbers, and the names of these."""
    n = "length(token)"
    covered = f"1 - length(regexp_replace(lower(token), '{word_pattern(words)}', '')) / {n}" if words else "0D"
    columns = {
        "f_length": f"cast({n} as double)",
        "f_transitions": "regexp_count(classes, '(?<=U)[^U]|(?<=l)[^l]|(?<=d)[^d]|(?<=[^Uld])[Uld]') / length(token)",
        "f_into_digit": f"regexp_count(classes, '(?<=[Ul])d') / {n}",
        "f_digits": f"regexp_count(classes, 'd') / {n}",
        "f_upper": f"regexp_count(classes, 'U') / {n}",
        "f_hex": f"regexp_count(token, '[0-9a-f]') / {n}",
        "f_symbols": f"regexp_count(classes, '[^Uld]') / {n}",
        "f_vowels": f"regexp_count(lower(token), '[aeiou]') / {n}",
        "f_syllables": f"regexp_count(lower(token), '(?<=[aeiou])[bcdfghjklmnpqrstvwxyz]') / {n}",
        "f_repeats": f"regexp_count(token, '(.)(?=\\\\1)') / {n}",
        "f_covered": covered,
        "f_named": f"cast(regexp_like(lower(before), '{NAMES}[^ ]*[\"\\': =]*[:=]?[\"\\' ]*$') as double)",
        "f_name_near": f"cast(regexp_like(lower(before), '{NAMES}') as double)",
        "f_assigned": "cast(regexp_like(before, '[:=] *[\"\\']?$') as double)",
        "f_quoted": "cast(regexp_like(before, '[\"\\'`]$') and regexp_like(after, '^[\"\\'`]') as double)",
        "f_alone": "cast((before = '' or regexp_like(before, '[ \\t\\n]$')) and (after = '' or regexp_like(after, '^[ \\t\\n.,;]')) as double)",
        "f_letters_around": "cast(regexp_like(before, '[^ -~]$') or regexp_like(after, '^[^ -~]') as double)",
        "f_example_path": f"cast(coalesce(regexp_like(lower(path), '{EXAMPLES}'), false) as double)",
        "f_path_depth": "cast(coalesce(length(path) - length(replace(path, '/', '')), 0) as double)",
    }
    shown = found.withColumn("classes", F.expr(_CLASSES))
    return shown.withColumns({k: F.expr(v) for k, v in columns.items()}).drop("classes"), list(columns)


def format_findings(found: DataFrame) -> DataFrame:
    """Labels from published formats: candidates of known key formats are secrets; plain words, numbers and paths are none; others get no label."""
    key = "regexp_like(token, '^(?:AKIA|ASIA)[A-Z2-7]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{24,}$')"
    assigned = f"regexp_like(token, '^[0-9a-f]{{32,64}}$') and regexp_like(lower(before), '{NAMES}[\"\\']? *[:=] *[\"\\']?$')"
    plain = "regexp_like(token, '^[A-Za-z]?[a-z]+$|^[A-Z]+$|^[0-9-]+$|^[=_+/-]+$|^[a-z]+(?:[/_-][a-z]+)+$')"
    labelled = found.withColumn("secret", F.expr(f"case when ({key}) or ({assigned}) then 1 when {plain} then 0 end"))
    return labelled.where("secret is not null").select("doc_id", "start", "secret")


def fit(described: DataFrame, names: list[str], findings: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = 24, depth: int = 6) -> PipelineModel | None:
    """A forest from labelled findings, half of each class at most; None without both classes."""
    marks = findings.where("secret is not null").groupBy("doc_id", "start").agg(F.min("secret").alias("secret"))
    order = F.expr("md5(concat_ws(':', cast(doc_id as string), cast(start as string)))")
    some = [marks.where(F.col("secret") == k).withColumn("o", order).orderBy("o", "doc_id", "start").limit(max_findings // 2) for k in (0, 1)]
    chosen = some[0].unionByName(some[1])  # at most max_findings rows: the bound of the broadcast
    rows = described.join(F.broadcast(chosen), ["doc_id", "start"]).select("o", "secret", *names)
    # A place may be on any number of rows: equal ones count once, and the rows themselves are limited.
    rows = written(rows.dropDuplicates().orderBy("o", *names).limit(max_findings).repartition(1).sortWithinPartitions("o", *names), "findings")
    if rows.select("secret").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="features", labelCol="secret", numTrees=trees, maxDepth=depth, seed=7)
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def scan(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id, start, n_chars, token, score, is_secret`` of every candidate."""
    found = candidates(docs, doc_id, text, path)
    described, names = features(found, dictionary(docs, text))
    described = written(described, "candidates")  # read by the fit and by the scan
    model = fit(described, names, format_findings(described) if findings is None else findings)
    if model is None:
        scored = described.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(described).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", F.length("token").cast("long").alias("n_chars"), "token", "score", (F.col("score") > 0.5).alias("is_secret"))
