"""Secret scans: a pattern proposes candidates, a random forest removes false positives.

All of it is DataFrame expressions.  Candidates are

* values of any alphabet behind an announcing word and a sign of assignment, or in front of an address' @;
* whole blocks of private keys;
* tokens of long parts joined by dots;
* access-key ids, and runs of 12 or more key-like characters that hold a digit.

Their features are length, changes between character classes, the shares of classes and of different
characters, how common their letters' transitions are, coverage by dictionary words, signs of a path
or an address, and the words next to them.  The dictionary are the commonest whole words of a public
vocabulary file; transitions are counted in its words.  All of them are of the whole candidate, however
long it is; where each character becomes a value of its own, parts of ``PART`` code points are taken one
after the other and added up.  The forest is trained from labelled findings
with Spark's own trainer and then written out as one conditional expression, so that scoring is a
narrow projection without any shuffle.

``labelled_findings`` draws a fixed set of findings of many kinds, whatever the documents hold; other
labelled findings (candidate, before, after, label) can be given instead.

Null and empty texts have no findings.  Null ids are kept.  Repeated rows have their findings
each.  Other columns are ignored by the scan and kept by ``redact``, whatever their names.  Offsets and
lengths count code points.  A text of any length is searched whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_dir, shared_table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words that announce a secret.
ANNOUNCING = (
    r"(?:p(?:ass(?:word|wd|phrase|code)?|wd|rivate[_-]?key)|s(?:ecret(?:[_-]?key)?|igning[_-]?key|ession[_-]?token)|[_-]?token"
    r"|a(?:uth[_-]?token|ccess[_-]?(?:token|key)|pi[_-]?(?:token|key))|refresh[_-]?token|encryption[_-]?key|c(?:redentials?|lient[_-]?secret))"
)
#: What stands in front of a proposed value and is not part of it: an announcement, or an address' user.
ANNOUNCED = rf"(?i:{ANNOUNCING}[\"']?[ \t]{{0,3}}(?:=>?|:=?)[ \t]{{0,3}}[\"'`]?)"
PREFIX = rf"{ANNOUNCED}|[^\s/:@\"'<>]{{1,64}}+:"
#: Nothing starts inside a word, so most places of a text fail at the first test.
CANDIDATE = (
    r"(?<![A-Za-z])(?:"
    rf"(?=[pstarec_PSTAREC-]){ANNOUNCED}[^\s\"'`<>,;(){{}}\[\]]{{4,}}+"
    r"|(?<=://)[^\s/:@\"'<>]{1,64}+:[^\s/@\"'<>]{3,}+(?=@)"
    r"|-{4,5}BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?<![0-9_+/.-])(?=[A-Za-z0-9_-]{10})[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]{10,}+)+"
    r"|(?<![0-9_+/-])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?=[A-Za-z0-9_+/-]{12})[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+=*+)"
    r")"
)
AROUND = 40
#: Code points of a candidate whose transitions are looked up together.
PART = 4096
#: Candidates of a text whose lengths are added up together.
STRIDE = 128
#: Short words and digit runs that real secrets seldom hold, beside the dictionary's.
PLAIN = "xxx|abc|xyz|foo|bar|123|000|your|here|changeme|example|sample|dummy|placeholder|password|passwd|secret|token|admin|default|redacted|null|none|true|false|env|config|settings|getenv|process"
#: Words that announce a secret without a sign of assignment, and words that announce something else.
KEYWORDS = rf"(?i)({ANNOUNCING}|auth|bearer|authorization)\W{{0,6}}$"
OTHERS = r"(?i)(commit|sha1?|sha256|md5|uuid|checksum|digest|hash|version|build|order|invoice|id|isbn|phone|ref|rev|etag|tracking)\W{0,6}$"

NAMES = ["length", "runs", "digits", "upper", "lower", "marks", "distinct", "hex", "covered", "transitions", "path", "address", "longest", "keyword", "other", "assigned", "quoted", "prefix", "vowels", "dashed", "block", "plain", "reference"]


@cache
def dictionary(path: str, size: int) -> tuple:
    """The ``size`` commonest whole words of 4 to 10 letters of a vocabulary file, the commonest first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted((-sp.get_score(i), sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
    words = dict.fromkeys(m[1].lower() for _, p in pieces if (m := re.fullmatch("▁([A-Za-z]{4,10})", p)))
    return tuple(words)[:size]


def any_of(words) -> str:
    """A pattern that matches the longest of the words that fits, as a tree of their beginnings."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [c + pattern(node[c]) for c in sorted(node) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return body + "?" * ("" in node)

    return pattern(tree)


def transitions_of(words) -> list:
    """Mean-free log probabilities of 28 x 28 pairs of classes: letters, digits, all else; from words weighted by rank."""
    import math

    count = [[0.05] * 28 for _ in range(28)]
    for rank, word in enumerate(words):
        for a, b in zip(word, word[1:]):
            count[ord(a) - 97][ord(b) - 97] += 100 / (10 + rank)
    return [math.log(x / sum(row)) + math.log(28) for row in count for x in row]


def features(candidate: Column, before: Column, after: Column, vocabulary: str = VOCABULARY, size: int = 3000) -> Column:
    """A struct of doubles, one field for each of NAMES."""
    words = dictionary(vocabulary, size)
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    share = lambda p: F.length(F.regexp_replace(candidate, p, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[^A-Za-z0-9]", "-"), "[A-Z]", "A"), "[b-z]", "a"), "[1-9]", "0")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    low = F.lower(candidate)
    letters = F.regexp_replace(low, "[^a-z]+", " ")
    parts = F.regexp_extract_all(low, F.lit(rf"(?s)(?=(.{{1,{PART + 1}}}+)).{{1,{PART}}}+"), F.lit(1))  # each with the next one's first, so no pair is lost
    code = lambda part: F.transform(F.split(part, ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).when(c.between("0", "9"), 26).otherwise(27))
    table = F.expr(f"array({', '.join(f'{x:.4f}D' for x in transitions_of(words))})")
    step = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, (a * 28 + b + 1).cast("int")))
    add = lambda s, part: F.aggregate(F.array(code(part)), s, lambda z, c: F.aggregate(step(c), z, lambda y, x: y + x))  # noqa: E731  an array of one: the codes are made once
    values = [
        n,
        F.length(F.regexp_replace(classes, r"(.)\1*", "$1")) / n,
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^a-z]"),
        share("[A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        flag(candidate.rlike("^[0-9a-fA-F]+$")),
        1 - F.length(F.regexp_replace(low, any_of(words), "")) / F.greatest(F.length(low), F.lit(1)),
        F.try_divide(F.aggregate(parts, F.lit(0.0), add), F.greatest(F.length(low) - 1, F.lit(0))),
        F.length(F.regexp_replace(candidate, "[^/]", "")).cast("double"),
        flag(before.rlike(r"(://|www\.)\S*$|[/.@]$") | after.rlike(r"^\.[a-z]{2,5}\b|^/")),
        F.array_max(F.transform(F.split(letters, " "), lambda x: F.length(x))) / n,
        flag(before.rlike(KEYWORDS)),
        flag(before.rlike(OTHERS)),
        flag(before.rlike("[=:]\\s*[\"'`]?$")),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(candidate.rlike("^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live|rk_live|xox[abp]|AIza|eyJ|SG\\.|npm_)")),
        share("[^aeiouAEIOU]"),
        flag(candidate.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9]{1,4}([-/][0-9]{1,4})+$")),
        flag(candidate.startswith("-----BEGIN") | (before.rlike("://[^\\s/:@]+:$") & after.startswith("@"))),
        flag(F.lower(candidate).rlike(PLAIN)),
        flag(candidate.rlike(r"^[$%<{\[*]|^\$\{|\($|\.\w+$|^(\*+|x+|\.+|-+)$")),
    ]
    return F.struct(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in zip(NAMES, values)))


def one_finding(r, words) -> tuple:
    """(candidate, before, after, label) of a kind drawn by ``r``; lengths, alphabets and surroundings are drawn too."""
    low, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    alnum = low + low.upper() + digit
    some = lambda alphabet, lo, hi: "".join(r.choices(alphabet, k=r.randint(lo, hi)))
    word = lambda: r.choice(words)
    dated = lambda: f"{r.randint(1970, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
    typed = lambda: word() + r.choice(["", "!", "_", "7", "#", "$"]) + word().title() + r.choice(["", "1", "42", "!", "2019", "?", "99!"])  # noqa: E731  as people make passwords
    before, after = f"{word()}{r.choice([' ', ', ', '. ', chr(10), ': ', ' (', ' - '])}", r.choice([" ", ", ", ".", "\n", ";", ")", "", " and"])
    name = r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access-key", "auth_token", "client_secret", "credential", "private_key", "PASSWORD", "Token", "DB_PASSWORD"])
    keyed, quote = before + name + r.choice(["=", ": ", " = ", ":", " := ", " => "]), r.choice("\"'`")
    bare = before + r.choice(["commit ", "sha1: ", "checksum ", "rev ", "etag ", "md5 ", "build ", "digest: ", "", "", "see ", "file ", "from "])
    shown = lambda x: r.choice([(x, keyed, after), (x, keyed + quote, quote)])
    if r.random() < 0.5:
        kind = r.randrange(10)
        if kind == 0:
            found = "AKIA" + some(low.upper() + digit, 16, 16), r.choice([before, keyed]), after
        elif kind == 1:
            found = r.choice(["ghp_", "gho_", "sk_live_", "rk_live_", "xoxb-", "AIza", "glpat-", "npm_", "github_pat_"]) + some(alnum, 16, 40), before, after
        elif kind == 2:
            found = shown(some(hexa, 16, 64))
        elif kind == 3:
            found = shown(some(alnum + r.choice(["", "+/", "-_"]), 10, 60))
        elif kind == 4:
            found = some(r.choice([alnum + "+/", hexa, alnum]), 24, 64), before + r.choice(["Bearer ", "Authorization: ", "Authorization: Bearer ", "auth ", "bearer: "]), after
        elif kind == 5:
            found = f"eyJ{some(alnum + '-_', 15, 40)}.eyJ{some(alnum + '-_', 10, 60)}.{some(alnum + '-_', 20, 43)}", before + r.choice(["", "token ", "Bearer ", "jwt: "]), after
        elif kind == 6:
            what = r.choice(["", "RSA ", "EC ", "OPENSSH "])
            found = f"-----BEGIN {what}PRIVATE KEY-----\n{some(alnum + '+/', 16, 64)}\n{some(alnum + '+/', 10, 64)}\n-----END {what}PRIVATE KEY-----", before, after
        elif kind == 7:
            found = shown(typed())
        elif kind == 8:
            found = r.choice([(word() + word() + word(), keyed + quote, quote), shown(some(alnum + "!#%?*&", 6, 14))])
        else:
            found = r.choice([typed(), some(alnum + "-_!", 6, 20)]), f"{before}{r.choice(['postgres', 'mysql', 'https', 'redis', 'amqp', 'ftp'])}://{word()}:", f"@{word()}"
        return *found, 1
    kind = r.randrange(12)
    if kind == 0:
        found = some(hexa, 12, 64), bare, after
    elif kind == 1:
        found = some(hexa, 32, 64), bare + quote, quote
    elif kind == 2:
        found = "-".join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)), before + r.choice(["uuid ", "id: ", "", "ref="]), after
    elif kind == 3:
        found = word() + r.choice("_-/") + word() + r.choice(["_", "-", "/", ""]) + str(r.randint(0, 3000)), bare, after
    elif kind == 4:
        found = f"{word()}{r.randint(0, 99)}{word()}{r.choice(['', 's', '-v2'])}", bare, after
    elif kind == 5:
        found = f"{word()}/{word()}/{r.randint(0, 999)}/{word()}", before + r.choice(["http://www.", "https://", "/home/", "./"]), r.choice([".html", "/", " ", ".png"])
    elif kind == 6:
        found = r.choice(["", "+", "00"]) + some(digit, 11, 20), before + r.choice(["card ", "", "account no. ", "call ", "order ", "isbn ", "phone ", "tel: ", "fax "]), after
    elif kind == 7:
        found = dated() + r.choice(["", f"T{r.randint(0, 23):02}"]), before, after
    elif kind == 8:
        found = word() + r.choice(["", "", ".", "?", ":"]), keyed, r.choice([" ", "\n", f" {word()}"])
    elif kind == 9:
        found = r.choice([r.choice(["your_", "YOUR-", "my_", "<", "${", "$", "example_"]) + word() + r.choice(["_here", "_123", ">", "", "_placeholder"]), r.choice(["null", "none", "true", "false", "********", "xxxxxxxx", "changeme", "undefined", "os.environ", "process.env", "required", "config.get", "settings.py", "......"])]), keyed, r.choice([after, "[", "\""])
    elif kind == 10:
        found = r.choice([(f"{word()}.{word()}{r.choice('._')}{word()}", keyed, after), (f"{word()}{word()}.{word()}{word()}{r.choice(['', '1', '22'])}", bare, after)])
    else:
        found = r.choice([(r.choice(["x", "0", "ab", "12"]) * r.randint(6, 20) + "0", r.choice(["", "id ", "token=", "key: "]), after), (some(digit, 4, 8), before + r.choice(["token: ", "password: "]), f" {word()}")])
    return *found, 0


def labelled_findings(spark: SparkSession, rows: int = 8000, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """(candidate, before, after, label): drawn findings, half of each label, the same on every run."""
    from random import Random

    r, words = Random(seed), dictionary(vocabulary, 1500)[::2]
    quote = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    made = (one_finding(r, words) for _ in range(rows))
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(c)}, {quote(b)}, {quote(a)}, {v})" for c, b, a, v in made) + " AS t(candidate, before, after, label)")


def fit_forest(findings: DataFrame, trees: int = 12, depth: int = 7, seed: int = 7):
    """(Spark's model, the findings with their vectors)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    findings = shared_table(findings.repartition(8))
    x = findings.select(features(F.col("candidate"), F.col("before"), F.col("after")).alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label")
    rows = VectorAssembler(inputCols=NAMES, outputCol="features").transform(x).select("features", "label")
    rows = shared_table(rows)  # the trainer reads them often
    rows = rows.withColumn("f", F.struct(*(vector_to_array("features")[i].alias(k) for i, k in enumerate(NAMES))))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows), rows


def train_forest(findings: DataFrame, trees: int = 12, depth: int = 7, seed: int = 7) -> list:
    """Decision trees as nested tuples: (feature, threshold, left, right) or the share of label 1."""
    return read_trees(fit_forest(findings, trees, depth, seed)[0])


def read_trees(model) -> list:
    """The model's own node data, as it saves them; at most ``trees * 2**(depth + 1)`` rows."""
    spark = SparkSession.getActiveSession()
    path = shared_dir(spark)
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    nodes = {(r.treeID, r.id): r for r in rows}

    def tree(t: int, i: int):
        r = nodes[t, i]
        if r.leftChild < 0:
            return float(r.impurityStats[1]) / sum(r.impurityStats)
        return r.split.featureIndex, float(r.split.leftCategoriesOrThreshold[0]), tree(t, r.leftChild), tree(t, r.rightChild)

    return [tree(t, 0) for t in sorted({t for t, _ in nodes})]


@cache
def own_forest(vocabulary: str) -> list:
    """The forest of the drawn findings, which are the same each time: fitted once for a driver."""
    return train_forest(labelled_findings(SparkSession.getActiveSession(), vocabulary=vocabulary))


def vote(tree, f: Column) -> Column:
    """A tree as one conditional expression over a struct of features."""
    if not isinstance(tree, tuple):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(f[NAMES[feature]] <= threshold, vote(left, f)).otherwise(vote(right, f))


def prefix_of(found: Column) -> Column:
    """The announcing part of a match."""
    return F.regexp_extract(found, f"^(?:{PREFIX})", 0)


def findings(text: Column, forest: list) -> Column:
    """Array of structs (start, length, candidate, score) of all candidates of a text."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    between = F.split(text, CANDIDATE, -1)

    def place(x: Column, i: Column) -> Column:
        block = (i / STRIDE).cast("int")
        ahead = x["ahead"][block] + F.aggregate(F.slice(x["steps"], block * STRIDE + 1, i % STRIDE), F.lit(0), lambda s, n: s + n)
        lead = prefix_of(x["found"][i])
        start = ahead + F.length(x["between"][i]) + F.length(lead)
        # what follows is the text up to the next match, and that match's own prefix
        return F.struct(start.alias("start"), F.substr(x["found"][i], F.length(lead) + 1).alias("candidate"), F.right(F.concat(x["between"][i], lead), F.lit(AROUND)).alias("before"), F.left(x["between"][i + 1], F.lit(AROUND)).alias("after"))

    def sums(x: Column) -> Column:
        """Code points of each block of STRIDE steps: starts are added up in two levels, not from the text's head each time."""
        return F.transform(F.sequence(F.lit(0), (F.size(x["found"]) / STRIDE).cast("int")), lambda b: F.aggregate(F.slice(x["steps"], b * STRIDE + 1, STRIDE), F.lit(0), lambda s, n: s + n))

    def ahead(x: Column) -> Column:
        return F.transform(x["sums"], lambda _, b: F.aggregate(F.slice(x["sums"], 1, b), F.lit(0), lambda s, n: s + n))

    steps = lambda x: F.zip_with(x["between"], x["found"], lambda b, f: F.length(b) + F.coalesce(F.length(f), F.lit(0)))
    add = lambda pieces, name, value: F.transform(pieces, lambda x: x.withField(name, value(x)))
    pieces = F.array(F.struct(found.alias("found"), between.alias("between")))  # an array of one struct: each value is made once
    pieces = add(add(add(pieces, "steps", steps), "sums", sums), "ahead", ahead)
    indexes = lambda x: F.sequence(F.lit(0), F.size(x["found"]) - 1)
    placed = F.flatten(F.transform(pieces, lambda x: F.transform(indexes(x), lambda i: place(x, i))))
    scored = F.transform(placed, lambda x: F.struct(x["start"], F.length(x["candidate"]).alias("length"), x["candidate"], features(x["candidate"], x["before"], x["after"]).alias("f")))
    total = lambda f: sum((vote(t, f) for t in forest), F.lit(0.0)) / max(len(forest), 1)
    out = F.transform(scored, lambda x: F.struct(x["start"], x["length"], x["candidate"], total(x["f"]).alias("score")))
    return F.when(F.coalesce(text.rlike(CANDIDATE), F.lit(False)), out)


def with_findings(documents: DataFrame, text_col: str, labelled: DataFrame | None, name: str) -> DataFrame:
    forest = train_forest(labelled) if labelled is not None else own_forest(VOCABULARY)
    return documents.withColumn(name, findings(F.col(text_col), forest))


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Per candidate: doc_id, start, length, candidate_sha256, score, is_secret."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CANDIDATE))
    one = with_findings(docs, "text", labelled, "found").select("doc_id", F.explode("found").alias("x"))
    return one.select("doc_id", "x.start", "x.length", F.sha2("x.candidate", 256).alias("candidate_sha256"), "x.score", (F.col("x.score") >= threshold).alias("is_secret"))


def redact(documents: DataFrame, text_col: str = "text", labelled: DataFrame | None = None, threshold: float = 0.5, mask: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns; every candidate that is a secret at one of its places is replaced by ``mask`` at all of them.

    Candidates are replaced whole and by place: a longer candidate is masked or kept as it is judged itself.
    """
    name = fresh("found", documents)
    found = with_findings(documents, text_col, labelled, name)
    secrets = F.array_distinct(F.transform(F.filter(name, lambda x: x["score"] >= threshold), lambda x: x["candidate"]))
    pieces = F.array(F.struct(F.col(name).alias("found"), secrets.alias("secrets"), F.split(F.col(text_col), CANDIDATE, -1).alias("between"), F.regexp_extract_all(F.col(text_col), F.lit(CANDIDATE), F.lit(0)).alias("whole")))  # each value is made once

    def joined(x: Column) -> Column:
        shown = lambda f: F.when(F.array_contains(x["secrets"], f["candidate"]), F.lit(mask)).otherwise(F.coalesce(f["candidate"], F.lit("")))
        return F.array_join(F.zip_with(x["between"], F.zip_with(x["found"], x["whole"], lambda f, w: F.struct(f["candidate"].alias("candidate"), prefix_of(w).alias("lead"))), lambda b, f: F.concat(b, F.coalesce(f["lead"], F.lit("")), shown(f))), "")

    clean = F.transform(pieces, joined)[0]
    return found.withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(clean)).select(*documents.columns)
