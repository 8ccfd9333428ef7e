"""Secret scans: token-like candidates, and a random forest that tells findings from look-alikes, without Python workers.

Two things are candidates. A bare run is RUN within a word: LONG or more of ``[A-Za-z0-9+/_-]`` with a digit, or an
issuer's key. A value is what a telling word (password, token, ...) assigns, in the same word or in one of the next two:
of any length and of any characters but white space and its quotes. Nothing is a secret by its length alone: the forest
judges a candidate by its length, character classes and their transitions, the share of its letters that stand in
dictionary words, its path-like parts, and the words on both sides. The forest is trained from a table of labelled
findings, then written out as an expression, so scoring stays within the row: no candidate is shuffled. The dictionary
is the DICTIONARY commonest whole words of a public tokenizer's vocabulary file, whose path is a parameter.

Nulls and empty texts have no candidates. Every candidate of a text is judged, whatever the length of the text.
Repeated rows keep their rows, an empty table gives an empty result, and extra columns are ignored by scan() and kept by
redact().
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine.llm.common import give_back, table, written

TREES, LEVELS, SEED = 24, 7, 42
#: Rows of the labelled table that query and pipeline train from; the forest's threshold to call a candidate a secret.
LABELLED, THRESHOLD = 4000, 0.5
#: Words of the dictionary, of SHORT letters or more.
DICTIONARY, SHORT = 6000, 4
#: Characters of a bare run; values that are assigned have no least length.
LONG = 16
MARK = "[SECRET]"

# What words before a secret and before other codes say, and how a value is assigned.
TELLING = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer"
BENIGN = r"\b(commit|checksum|digest|etag|guid|uuid|hash|isbn|md5|ref|revision|sha-?(1|256|512)?|order|invoice|tracking|version|article)\b"
ASSIGNED = r"(?:[=:]+>?|\bis|\bwas|\bbearer|\bbasic)"
# How issuers begin their keys.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ|SG\.|npm_)"
RUN = r"(?:SG\.|eyJ)[A-Za-z0-9_.-]{%d,}|[A-Za-z0-9+/_-]{%d,}" % (LONG, LONG)
# Stand-ins that documentation prints in place of a secret.
STAND_IN = r"(?i)example|your|replace|change|insert|placeholder|dummy|xxxx|sample|redacted|hidden|none|null|\*\*\*|<|\$\{"

_T = f"(?i)(?:{TELLING})"
#: In one word: a telling name, an assignment, and something behind it.
_OWN = rf"{_T}[\w\]\"')-]*(?:=>|:=|[=:])[\"']?[^\"'=:\s]"
#: Of the two or three words before: a telling word, then an assignment at the end.
_LEFT = rf"{_T}[\w\]\"')-]*\s*(?:[\w\]\"')-]*\s*)?{ASSIGNED}[\"']?$"

FEATURES = (
    "length", "digits", "upper", "lower", "vowels", "changes", "alternates", "distinct", "hex", "repeat", "symbols", "covered", "slashes", "dashes", "path", "extension", "code", "issued", "numeric", "stand_in",
    "telling", "benign", "assigned", "quoted", "benign_after", "word_after",
)


def dictionary(path: str | None = None, words: int = DICTIONARY) -> list[str]:
    """The vocabulary's commonest words of SHORT or more letters: those it keeps whole, with a space before, earliest first."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [t[1:] for t in sorted(vocabulary, key=vocabulary.get) if re.fullmatch(rf"Ġ[a-z]{{{SHORT},}}", t)][:words]


def _share(token: Column, pattern: str) -> Column:
    return F.regexp_count(token, F.lit(pattern)) / F.length(token)


def covered(token: Column, words: list[str]) -> Column:
    """The share of a token's characters that stand in dictionary words: its letter runs (parted where case rises), whole or as
    a dictionary word at their beginning or end."""
    parted = F.regexp_replace(token, "(?<=[a-z])(?=[A-Z])", " ")
    pieces = F.filter(F.split(F.lower(parted), "[^a-z]+"), lambda p: F.length(p) >= SHORT)
    by_start: dict[str, list[str]] = {}
    for w in words:
        by_start.setdefault(w[:2], []).append(w)
    # one literal: words by their first two letters
    listed = F.str_to_map(F.lit(",".join(f"{k}:|{'|'.join(v)}|" for k, v in by_start.items())), F.lit(","), F.lit(":"))
    known = lambda p: F.coalesce(F.contains(F.try_element_at(listed, F.substring(p, 1, 2)), F.concat(F.lit("|"), p, F.lit("|"))), F.lit(False))

    def most(p: Column) -> Column:
        cuts = F.sequence(F.lit(SHORT), F.length(p))
        ends = F.transform(cuts, lambda n: F.when(known(F.substring(p, F.lit(1), n)), n).when(known(F.substring(p, F.length(p) - n + 1, n)), n).otherwise(0))
        return F.array_max(ends)

    return F.aggregate(F.transform(pieces, most), F.lit(0), lambda a, n: a + n) / F.length(token)


def features(token: Column, before: Column, after: Column, words: list[str]) -> dict[str, Column]:
    """Doubles by name; token: the candidate, before and after: what stands there, the rest of its own word included."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    n = F.length(token)
    return {
        "length": F.least(n, F.lit(200)).cast("double"),
        "digits": _share(token, "[0-9]"),
        "upper": _share(token, "[A-Z]"),
        "lower": _share(token, "[a-z]"),
        "vowels": _share(token, "[aeiouAEIOU]"),
        "changes": _share(token, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "alternates": _share(F.lower(token), "(?<=[aeiouy])[b-df-hj-np-tv-xz]|(?<=[b-df-hj-np-tv-xz])[aeiouy]"),
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "hex": flag(token.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "repeat": flag(token.rlike(r"(.)\1{3}")),
        "symbols": _share(token, "[^A-Za-z0-9/_-]"),
        "covered": covered(token, words),
        "slashes": _share(token, "/"),
        "dashes": _share(token, "[-_]"),
        "path": flag(token.rlike(r"^[./~]*/|://") | before.rlike(r"(://|/)\S*$")),
        "extension": flag(token.rlike(r"\.[a-z]{2,4}$") | after.rlike(r"^\.[a-z]{2,4}\b")),
        # a call, an index, or names joined by dots
        "code": flag(token.rlike(r"[(\[][^()\[\]]*[)\]]$|^[A-Za-z_]+(\.[A-Za-z_]+)+$|[()]$")),
        "issued": flag(token.rlike(ISSUED)),
        "numeric": flag(token.rlike("^[0-9+/_.,:-]+$")),
        "stand_in": flag(token.rlike(STAND_IN)),
        "telling": flag(before.rlike(_T)),
        "benign": flag(before.rlike(f"(?i){BENIGN}")),
        "assigned": flag(before.rlike("(=>|[=:])\\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "benign_after": flag(after.rlike(f"(?i)^\\S*\\s+{BENIGN}")),
        # prose goes on in lower case behind a word
        "word_after": flag(after.rlike("^[,.]?\\s+[a-z]")),
    }


def labelled_findings(spark: SparkSession, rows: int = LABELLED, words: list[str] | None = None) -> DataFrame:
    """token, before, after, secret: a table of labelled findings made by rule from md5 digits; half are secrets."""
    words = words or dictionary()
    i = F.col("id")
    number = lambda k, n: (F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(f":{k}"))), 1, 8), 16, 10).cast("long") % n + 1).cast("int")
    pick = lambda k, *of: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in of]), number(k, len(of)))
    upto = lambda k, a, b: number(k, b - a + 1) + a - 1
    word = lambda k: F.col(f"w_{k}")
    cut = lambda c, k, a, b: c.substr(F.lit(1), upto(k, a, b))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    byte = lambda alphabet: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda j: F.lit(alphabet).substr((F.conv(F.col("h").substr(j * 2 + 1, F.lit(2)), 16, 10).cast("int") % len(alphabet) + 1).cast("int"), F.lit(1))), "")
    # the draws are a table of their own, so that the plans of what is made of them stay small
    some = words[:500]
    listed = F.split(F.lit(" ".join(some)), " ")
    hashed = spark.range(rows).withColumn("h", F.concat(*[F.md5(F.concat(i.cast("string"), F.lit(f"/{k}"))) for k in range(3)]))
    drawn = hashed.select(
        "id",
        "h",
        byte(letters + "0123456789").alias("mixed"),
        byte(letters[:26] + "234567").alias("capital"),
        byte(letters[26:] + "0123456789").alias("small"),
        byte("!?#$%&*@^").alias("marks"),
        F.translate("h", "abcdef", "012345").alias("digits"),
        *[F.element_at(listed, number(k, len(some))).alias(f"w_{k}") for k in ("x", "y", "z", "f1", "f2")],
        pick("n", "password", "Password", "DB_PASSWORD", "passwd", "pwd", "secret", "client_secret", "token", "auth_token", "api_key", "API-KEY", "access_key", "private_key", "passphrase", "credentials", "PASS").alias("name"),
        pick("b", "commit ", "the uuid ", "sha256 ", "see ref ", "order ", "invoice ", "checksum: ", "revision ", "version=", "etag: \"", "isbn: ").alias("benign"),
        pick("p", "and the ", "of this ", "was. ", "en ", "die ", "de la ", "", "in ", "https://site.org/", "see ", "id=", "name: ").alias("plain"),
        pick("a", "=", ": ", "=\"", " = \"", ": '", " is ", "=", ": ").alias("assigns"),
    )
    drawn = written(drawn.withColumn("telling", F.concat("name", "assigns")).withColumn("cased", F.concat(F.upper(F.substring("w_x", 1, 1)), F.substring("w_x", 2, 20))))
    h, mixed, capital, small, marks, digits, name, benign, plain, telling, cased = map(F.col, ("h", "mixed", "capital", "small", "marks", "digits", "name", "benign", "plain", "telling", "cased"))
    leet = F.translate(cased, "aeio", "4310")
    secret = pick(
        "s",
        F.struct(F.concat(F.lit("AKIA"), capital.substr(1, 16)).alias("token"), pick("c", plain, plain, telling).alias("before")),
        F.struct(cut(h, "u", 16, 64).alias("token"), telling.alias("before")),
        F.struct(cut(mixed, "u", 8, 44).alias("token"), telling.alias("before")),
        F.struct(F.concat(pick("i", "ghp_", "sk_live_", "glpat-", "AIza", "npm_", "xoxb-"), mixed.substr(1, 32)).alias("token"), pick("c", plain, telling).alias("before")),
        F.struct(F.concat(F.lit("SG."), mixed.substr(1, 22), F.lit("."), mixed.substr(5, 40)).alias("token"), pick("c", plain, telling).alias("before")),
        F.struct(F.concat(leet, marks.substr(1, 1), digits.substr(F.lit(1), upto("u", 1, 4))).alias("token"), telling.alias("before")),
        F.struct(F.concat(cased, digits.substr(F.lit(1), upto("u", 2, 4)), marks.substr(F.lit(1), upto("v", 0, 2))).alias("token"), telling.alias("before")),
        F.struct(F.concat(word("x"), digits.substr(F.lit(1), upto("u", 1, 4)), pick("g", word("y"), F.lit(""))).alias("token"), telling.alias("before")),
        F.struct(F.concat(word("x"), pick("g", "-", "-", "_"), word("y"), pick("g", "-", "-", "_"), word("z"), pick("e", F.lit(""), F.lit(""), digits.substr(1, 2))).alias("token"), F.concat(name, pick("a", "=", "=\"", ": \"")).alias("before")),
        F.struct(F.concat(cut(small, "u", 4, 8), marks.substr(1, 1), small.substr(20, 4)).alias("token"), telling.alias("before")),
        F.struct(F.concat_ws("-", word("x"), word("y"), word("z"), word("f1")).alias("token"), F.concat(name, pick("a", "=", "=\"", ": \"")).alias("before")),
    )
    other = pick(
        "o",
        F.struct(cut(h, "u", 20, 64).alias("token"), benign.alias("before")),
        F.struct(F.concat(capital.substr(1, 2), digits.substr(F.lit(1), upto("u", 10, 20)), pick("e", "", "-")).alias("token"), pick("c", benign, benign, plain).alias("before")),
        F.struct(F.upper(cut(pick("d", h, mixed), "u", 16, 24)).alias("token"), benign.alias("before")),
        F.struct(F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)).alias("token"), pick("c", benign, plain).alias("before")),
        F.struct(F.concat(word("x"), pick("g", "-", "_", "/", ""), word("y"), pick("e", "-", "_", "/"), word("z"), digits.substr(F.lit(1), upto("u", 1, 4))).alias("token"), plain.alias("before")),
        F.struct(F.concat(F.upper(word("x")), F.upper(word("y")), F.upper(word("z")), digits.substr(F.lit(1), upto("u", 0, 2))).alias("token"), plain.alias("before")),
        F.struct(cut(digits, "u", 16, 24).alias("token"), pick("c", plain, benign).alias("before")),
        F.struct(F.concat(F.lit("/usr/lib/"), word("x"), F.lit("/v"), digits.substr(1, 1), F.lit("/"), word("y")).alias("token"), pick("c", plain, plain, telling).alias("before")),
        F.struct(F.concat(pick("q", "xxxxxxxxxxxxxxxx", "your_password_here_", "REPLACE_ME_WITH_KEY_", "example_token_value_", "0000000000000000", "<password>", "${TOKEN}", "********", "none", "null"), pick("e", "1", "", "")).alias("token"), telling.alias("before")),
        F.struct(F.concat(pick("q", "your", "change", "replace", "insert", "example", "sample"), pick("e", "_", "-", ""), pick("g", "password", "token", "secret", "me", "key"), pick("d", "_here", "-here", "", "_1", "-now")).alias("token"), telling.alias("before")),
        F.struct(word("x").alias("token"), F.concat(name, pick("a", " is ", ": ", " was ", ": ", " = ")).alias("before")),
        F.struct(pick("q", word("x"), F.lit("required"), F.lit("true"), F.lit("false"), F.lit("the"), F.lit("not"), F.lit("a"), F.lit("empty"), digits.substr(1, 1), digits.substr(1, 2)).alias("token"), telling.alias("before")),
        F.struct(F.concat(word("x"), pick("e", ".", "_", "."), word("y"), pick("g", "()", "", "()", "(x)", "[0]", ".py")).alias("token"), F.concat(name, pick("a", "=", " = ", ": ")).alias("before")),
    )
    chosen = F.when(i % 2 == 0, secret).otherwise(other)
    closing = F.when(F.col("x.before").rlike("\"$"), "\"").when(F.col("x.before").rlike("'$"), "'").otherwise("")
    prose = F.concat(pick("f", "", "", ".", ","), F.lit(" "), word("f1"), F.lit(" "), word("f2"))
    after = F.concat(closing, pick("l", prose, prose, F.lit(""), F.lit(";"), F.lit("!! AND"), F.lit("### the")))
    picked = drawn.select("id", "w_f1", "w_f2", chosen.alias("x"), (i % 2 == 0).cast("double").alias("secret"))
    return written(picked.select("id", "x.token", "x.before", after.alias("after"), "secret").where(F.length("token") > 0)).orderBy("id").drop("id")


def train(findings: DataFrame, words: list[str] | None = None, trees: int = TREES, levels: int = LEVELS) -> dict:
    """The dictionary and the forest: nested tuples (feature, threshold, left, right) or a leaf's share of secrets."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    words = words or dictionary()
    made = features(F.col("token"), F.col("before"), F.col("after"), words)
    featured = written(findings.coalesce(1).select("secret", *[made[k].alias(k) for k in FEATURES]))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="f").transform(featured).select("secret", "f").coalesce(1)
    forest = RandomForestClassifier(labelCol="secret", featuresCol="f", numTrees=trees, maxDepth=levels, seed=SEED, minInstancesPerNode=3).fit(rows)

    def node(n):
        if n.getClass().getSimpleName() == "LeafNode":
            a = [float(x) for x in n.impurityStats().stats()]
            return a[1] / (a[0] + a[1]) if sum(a) else 0.5
        return (int(n.split().featureIndex()), float(n.split().threshold()), node(n.leftChild()), node(n.rightChild()))

    trained = [node(t._java_obj.rootNode()) if hasattr(t, "_java_obj") else node(t._call_java("rootNode")) for t in forest.trees]
    give_back()
    return {"words": words, "trees": trained}


def shipped(spark: SparkSession) -> dict:
    """The forest over the labelled table."""
    words = dictionary()
    return train(labelled_findings(spark, words=words), words)


def score(forest: dict, values: dict[str, Column]) -> Column:
    """Mean share of secrets over the trees' leaves, as one expression."""

    def walk(n) -> Column:
        if isinstance(n, tuple):
            return F.when(values[FEATURES[n[0]]] <= n[1], walk(n[2])).otherwise(walk(n[3]))
        return F.lit(n)

    return reduce(lambda a, b: a + b, map(walk, forest["trees"])) / len(forest["trees"])


def candidates(text: Column) -> Column:
    """array<struct<word, token, before, after>> of a text's candidates, in order; word is the 0-based number of the word."""
    words = F.split(F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", ""), "[\\x20\\x09-\\x0D]+")
    tells = text.rlike(_T)
    run_like = lambda w: (F.length(w) >= LONG) & w.rlike(RUN)

    def marked(ws: Column, tells: Column) -> Column:
        spread = lambda i, a, b: F.concat_ws(" ", *[F.when(i + k >= 0, F.get(ws, i + k)) for k in range(a, b)])
        # what no assignment precedes needs no look at the words before it
        told = lambda w, i: tells & (w.rlike(_OWN) | F.when((i > 0) & F.get(ws, i - 1).rlike(f"(?i){ASSIGNED}[\"']?$"), spread(i, -3, 0).rlike(_LEFT)).otherwise(False))
        some = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("word"), w.alias("w"), told(w, i).alias("told"))), lambda x: x["told"] | run_like(x["w"]))
        return F.transform(some, lambda x: F.struct(x["word"].alias("word"), x["w"].alias("w"), x["told"].alias("told"), spread(x["word"], -3, 0).alias("left"), spread(x["word"], 1, 3).alias("right")))

    def of_word(x: Column) -> Column:
        behind = F.regexp_replace(x["w"], rf"^.*?{_T}[\w\]\"')-]*(?:=>|:=|[=:])", "")
        value = F.regexp_extract(behind, r"^[\"']([^\"']+)[\"']", 1)
        bare = F.regexp_extract(behind, r"^[\"'(\[{]*(.+?)[\"'.,;:)\]}]*$", 1)
        # decoration behind a value, as in secret"### or secret!!, isn't part of it
        bare = F.regexp_replace(bare, r"(?<=[A-Za-z0-9])[\"']?(##+|!!+|\*\*+|\$\$+|&&+|%%+)$", "")
        assigned = F.filter(F.array(F.when(x["told"], F.when(value != "", value).otherwise(bare))), lambda t: t.isNotNull() & ~t.rlike("(?i)^(bearer|basic)?$"))
        runs = F.filter(F.regexp_extract_all(x["w"], F.lit(f"({RUN})")), lambda t: ((F.regexp_count(t, F.lit("[0-9]")) > 0) | t.rlike(ISSUED)) & ~F.exists(assigned, lambda a: a.contains(t)))
        start = lambda t: F.position(t, x["w"])
        before = lambda t: F.concat(x["left"], F.lit(" "), F.substring(x["w"], F.lit(1), start(t) - 1))
        after = lambda t: F.concat(F.substring(x["w"], start(t) + F.length(t), F.length(x["w"])), F.lit(" "), x["right"])
        return F.transform(F.array_distinct(F.concat(assigned, runs)), lambda t: F.struct(x["word"].alias("word"), t.alias("token"), before(t).alias("before"), after(t).alias("after")))

    none = F.array().cast("array<struct<word: int, token: string, before: string, after: string>>")
    # most texts hold neither a run nor a telling word: they aren't split into words
    # bound as the one element of an array, so that they are made once and not for every word
    bound = F.array(F.struct(words.alias("words"), tells.alias("tells")))
    every = F.flatten(F.transform(bound, lambda b: F.flatten(F.transform(marked(b["words"], b["tells"]), of_word))))
    return F.when(tells | text.rlike(RUN), every).otherwise(none)


def findings(text: Column, forest: dict) -> Column:
    """array<struct<word, token, score>> of a text's candidates, in order."""
    featured = F.transform(candidates(text), lambda r: F.struct(r["word"].alias("word"), r["token"].alias("token"), F.struct(*[v.alias(k) for k, v in features(r["token"], r["before"], r["after"], forest["words"]).items()]).alias("f")))
    return F.transform(featured, lambda r: F.struct(r["word"].alias("word"), r["token"].alias("token"), score(forest, {k: r["f"][k] for k in FEATURES}).alias("score")))


def scan(docs: DataFrame, forest: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (word:token:score, in order, comma-joined): one row per document."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), findings(F.coalesce(F.col(text_col), F.lit("")), forest).alias("found"))
    kept = F.filter("found", lambda r: r["score"] > threshold)
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_candidates"),
        F.size(kept).cast("long").alias("n_secrets"),
        F.array_join(F.transform(kept, lambda r: F.format_string("%d:%s:%.4f", r["word"], r["token"], r["score"])), ",").alias("secrets"),
    )


def redact(docs: DataFrame, forest: dict, text_col: str = "text", threshold: float = THRESHOLD, mark: str = MARK) -> DataFrame:
    """docs with each secret in the text replaced by the mark, wherever it stands between other than letters and digits."""
    kept = F.array_distinct(F.transform(F.filter(findings(F.coalesce(F.col(text_col), F.lit("")), forest), lambda r: r["score"] > threshold), lambda r: r["token"]))
    # longest first: a secret may be part of another
    ordered = F.array_sort(kept, lambda a, b: F.length(b) - F.length(a))
    quoted = lambda s: F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    return docs.withColumn(text_col, F.aggregate(ordered, F.col(text_col), lambda t, s: F.regexp_replace(t, quoted(s), F.lit(mark.replace("\\", "\\\\").replace("$", "\\$")))))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), shipped(spark))
