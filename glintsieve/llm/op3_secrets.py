"""Operator 3: secret scans with DataFrame functions only.

One regular expression finds candidates in every whole text: values assigned to a credential name (in quotes, or bare up to white space or
a delimiter), private key blocks (with header lines or escaped line ends too), JSON web tokens and long runs with a digit, each of any length. Texts are split at the candidates, which gives each one's offset and
its neighbouring words. A random forest over the candidate's length, character transitions, dictionary coverage,
path context and neighbouring words removes false positives. The dictionary holds the whole words of a public vocabulary file (a parameter of
whole_words()); coverage is the share of a value in words of it and the share of places where a run of four letters of one begins. It is grown from labelled findings (FINDINGS, a bounded set
made by rule with a fixed seed) whose features come from the same expressions, and is applied as nested CASE expressions.

Defined results: null and empty texts hold nothing; repeated rows and ids are scanned each; a null doc_id stays null; other columns are
ignored by the scan and kept by the redaction, where the text of a secret is replaced by MARK and n_chars is counted anew.
"""

from __future__ import annotations

import base64
import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm import forest
from glintsieve.llm.common import fresh_name, only, table

MARK = "[SECRET]"
CONTEXT = 48
THRESHOLD = 0.5
FINDINGS = 1600
SUMMED = 128

_NAMES = "password|passwd|pwd|secret|token|api_?key|access_?key|private_?key|credential"
#: Possessive groups are loops in the regex engine, not recursion, so bodies may be of any length.
_PEM = r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,32}PRIVATE KEY(?: BLOCK)?-----"
_JWT = r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{5,}+(?:[.][A-Za-z0-9_-]*+){2,4}+"
_ASSIGNED = rf"(?i:{_NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}"
_NAMED = rf"{_ASSIGNED}(?:[\"'][^\"'\s]{{8,}}+[\"']|(?!-----BEGIN )[^\s\"'`,;&<>(){{}}\[\]|]{{8,}}+)"
#: A run with an assignment to a credential name in it is left to _NAMED, which starts at the name.
_RUN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[A-Za-z0-9+/_=-]{{16}})(?![A-Za-z0-9+/_=-]*?{_NAMED})[A-Za-z0-9+/_=-]{{16,}}+"
CANDIDATE = f"{_PEM}|{_NAMED}|{_JWT}|{_RUN}"
_VALUE = rf"^{_ASSIGNED}[\"']?([^\"'\s]+)[\"']?$"
_PROVIDERS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{5,}[.][A-Za-z0-9_-]*[.])"
_HINT = rf"(?i)({_NAMES}|auth|bearer)[^A-Za-z0-9]{{0,6}}$|(?i)({_NAMES}|auth|bearer)[\"' ]{{0,3}}[:=]"
_HARMLESS = r"(?i)\b(sha-?\d*|md5|checksum|commit|digest|hash|uuid|guid|example|sample|dummy|placeholder|test|integrity|revision|version|build|order|invoice|card|phone|tel|iban|isbn|id)\b"
#: Words of the dictionary: the vocabulary's first whole words by rank, so its size does not depend on the documents.
WORDS = 4000
FEATURES = ["length", "digits", "uppers", "lowers", "symbols", "turns", "repeats", "distinct", "dictionary", "familiar", "hexadecimal", "decimal", "uuid", "provider", "pem", "named", "hint", "harmless", "path", "url", "assigned", "trial", "settings"]


@lru_cache
def whole_words(path: str | None = None) -> tuple[str, ...]:
    """The lower-case words of 4 to 12 letters of a file of ranks (by default that of the vocabulary package), by rank."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    found = (re.fullmatch(rb" ([a-z]{4,12})", token) for _, token in ranked)
    return tuple(m[1].decode() for m in found if m)


@lru_cache
def dictionary() -> tuple[list[str], list[str]]:
    """The words, and the runs of four letters in them."""
    words = whole_words()[:WORDS]
    return list(words), sorted({w[k : k + 4] for w in words for k in range(len(w) - 3)})


def _covered(v: Column, n: Column) -> list[Column]:
    """The share of a value of n characters in words of the dictionary (written apart or in camel case), and of places where a run of one begins."""
    words, runs = dictionary()
    apart = F.split(F.lower(F.regexp_replace(v, "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
    begun = F.regexp_extract_all(F.lower(v), F.lit("(?=([a-z]{4}))"), F.lit(1))
    return [F.length(F.array_join(F.filter(apart, lambda w: w.isin(words)), "")) / n, F.size(F.filter(begun, lambda w: w.isin(runs))) / n]


def _share(c: Column, pattern: str) -> Column:
    kept = F.length(F.regexp_replace(c, pattern, ""))
    return (F.length(c) - kept) / F.greatest(F.length(c), F.lit(1))


def _quoted(hit: Column) -> Column:
    return hit.rlike("[\"']$")


def features(hit: Column, left: Column, right: Column, origin: Column) -> list[Column]:
    """The features of a candidate as doubles, in the order of FEATURES. origin: the path or name of where the text comes from."""
    named = hit.rlike(f"^{_ASSIGNED}")
    v = F.when(named, F.regexp_extract(hit, _VALUE, 1)).otherwise(hit)
    n = F.greatest(F.length(v), F.lit(1))
    turns = n - F.length(F.regexp_replace(v, r"(?<=[A-Za-z])(?=[0-9])[0-9]|(?<=[0-9])(?=[A-Za-z])[A-Za-z]|(?<=[a-z])[A-Z]", ""))
    flags = [
        v.rlike(r"^[0-9a-fA-F]+$"), v.rlike(r"^[0-9+-]+$"), v.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), v.rlike(_PROVIDERS), hit.startswith("-----BEGIN"),
        named, left.rlike(_HINT) | named, left.rlike(_HARMLESS) | right.rlike(r"(?i)^\W{0,3}\b(checksum|commit|hash|digest)\b"), left.rlike(r"[/\\.][^\s\"']{0,40}$") | v.rlike(r"^/|/.*/.*/"), left.rlike(r"(?i)(https?:|www\.)\S{0,48}$"), left.rlike(r"[:=]\s{0,3}[\"']?$") | named,
        origin.rlike(r"(?i)(^|[/_.-])(tests?|examples?|samples?|fixtures?|mocks?|docs?|locks?)([/_.-]|$)"), origin.rlike(r"(?i)[.](env|ya?ml|ini|conf|cfg|toml|properties|pem|key|tfvars)([.]|$)|(^|/)(config|deploy|secrets?)/"),
    ]
    return [
        F.length(v).cast("double"), _share(v, "[0-9]"), _share(v, "[A-Z]"), _share(v, "[a-z]"), _share(v, "[^A-Za-z0-9]"), turns / n, _share(v, r"(.)(?=\1)"),
        F.array_size(F.array_distinct(F.split(v, ""))) / n, *_covered(v, n), *[f.cast("double") for f in flags],
    ]


def labelled(seed: int = 20240517, odd: bool = False) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings: candidate, words before, words after, path, and 1 for a secret. Words are those of even or of odd places in all of the vocabulary."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, alnum, b64, digits = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789"
    words = whole_words()[odd::2]
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "API_KEY", "TOKEN", "client_secret", "auth token", "Authorization: Bearer"]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    case = lambda s: s.upper() if rng.random() < 0.15 else s
    chunks = lambda: "".join(pick(digits, rng.randint(1, 10)) + pick(rng.choice([hexa[10:], alnum[26:52]]), rng.randint(3, 7)) for _ in range(rng.randint(2, 4))) + pick(digits, rng.randint(1, 8))
    positive = [
        lambda: (f'{case(rng.choice(["token", "secret", "api_key", "password", "apikey", "access_key"]))}{rng.choice([" = ", "=", ": "])}"{case(chunks())}"', prose() + " ", " " + prose()),
        lambda: (case(pick(hexa, rng.choice([32, 40, 40, 64]))), f'{prose()} {case(rng.choice(names))} = "', f'" {prose()}'),
        lambda: (f'{case(rng.choice(["token", "secret", "api_key", "password", "apikey", "access_key"]))}{rng.choice([" = ", "=", ": "])}"{case(pick(hexa, rng.choice([32, 40, 40, 64])))}"', prose() + " ", " " + prose()),
        lambda: (f'{rng.choice(["token", "secret", "api_key", "password", "passwd", "pwd"])}{rng.choice([" = ", "=", ": "])}"{pick(alnum + "!#%&", rng.randint(10, 40))}"', prose() + " ", " " + prose()),
        lambda: (f'{rng.choice(["token", "secret", "api_key", "password", "passwd", "API_KEY", "TOKEN", "client_secret", "DB_PASSWORD"])}{rng.choice(["=", "=", ": "])}{rng.choice([pick(rng.choice([hexa, alnum, alnum + "!#%@$*"]), rng.randint(7, 48)) + pick(digits, 1), chunks()])}', prose() + rng.choice([" ", "\n", "?", "&"]), rng.choice([" ", "\n", "&"]) + prose()),
        # passwords that people make: words with digits between and behind them
        lambda: (f'{rng.choice(["password", "passwd", "pwd", "DB_PASSWORD", "secret"])}{rng.choice(["=", ": ", " = "])}{"".join(rng.choice(words) + pick(digits, rng.randint(1, 4)) for _ in range(rng.randint(2, 4)))}', prose() + rng.choice([" ", chr(10)]), rng.choice([" ", chr(10)]) + prose()),
        lambda: (pick(b64, rng.choice([32, 40, 44])) + "1", f"{prose()} {rng.choice(names)}={rng.choice(['', chr(34)])}", " " + prose()),
        lambda: ("AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + "7", prose() + " ", " " + prose()),
        lambda: ("ghp_" + pick(alnum, 35) + "3", prose() + " ", " " + prose()),
        lambda: ("sk_live_" + pick(alnum, 23) + "5", prose() + " ", " " + prose()),
        lambda: (f"-----BEGIN {rng.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n{pick(b64, 120)}\n-----END PRIVATE KEY-----", prose() + " ", " " + prose()),
        lambda: (f"-----BEGIN {rng.choice(['', 'RSA ', 'EC ', 'ENCRYPTED '])}PRIVATE KEY-----{rng.choice(['', chr(92) + 'n', chr(10) + 'Proc-Type: 4,ENCRYPTED' + chr(10)])}{pick(b64, rng.choice([120, 800, 2400]))}-----END PRIVATE KEY-----", prose() + " ", " " + prose()),
        lambda: ("eyJ" + ".".join(pick(alnum + "_-", n) for n in (rng.randint(17, 60), rng.randint(40, 900), rng.randint(43, 342))), f"{prose()} {rng.choice(['', 'Bearer ', 'token=', 'token = ' + chr(34)])}", rng.choice([" ", chr(34) + " "]) + prose()),
        lambda: (f'{rng.choice(["token", "secret", "api_key"])}{rng.choice([" = ", "=", ": "])}"{pick(alnum, rng.randint(41, 900))}"', prose() + " ", " " + prose()),
    ]
    negative = [
        lambda: (case(pick(hexa, rng.choice([32, 40, 64]))), f"{prose()} {rng.choice(['commit', 'sha1', 'sha256', 'md5', 'checksum', 'digest', 'hash', 'revision'])}{rng.choice([' ', ': ', ' = ', '='])}", " " + prose()),
        lambda: (case(pick(hexa, rng.choice([20, 32, 40]))), prose() + " ", " " + prose()),
        lambda: ("-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), f"{prose()} {rng.choice(['id', 'uuid', '', 'request'])} ", " " + prose()),
        lambda: (pick(digits, rng.randint(16, 24)), prose() + rng.choice([" ", " card ", " order ", " tel "]), " " + prose()),
        lambda: ("-".join(pick(digits, rng.randint(3, 5)) for _ in range(4)), prose() + " ", " " + prose()),
        lambda: ("_".join(rng.choice(words) for _ in range(4)) + pick(digits, 1), prose() + " ", " " + prose()),
        lambda: ("/" + "/".join(rng.choice(words) for _ in range(4)) + pick(digits, 2), prose() + rng.choice([" https://www.example.org", " see ", " "]), rng.choice([".html ", " "]) + prose()),
        lambda: ("".join(rng.choice(words).title() for _ in range(4)) + pick(digits, 2), prose() + " ", "( " + prose()),
        lambda: (f'{rng.choice(["password", "token", "secret", "api_key"])} = "{rng.choice(["changeme", "your-key-here", "placeholder", "example-token", "xxxxxxxxxxxx", "00000000000000", "************", "your_password_here", "<your-secret>", "${API_KEY_VALUE}", "{{token_value}}"])}"', prose() + " ", " " + prose()),
        lambda: (f'{rng.choice(["password", "token", "secret", "api_key", "credential"])}{rng.choice(["=", ": ", ": "])}{rng.choice(["changeme", "your-key-here", "placeholder", "example-token", "your_password_here", "xxxxxxxxxxxx", "$API_KEY_VALUE", "".join(rng.choice(words) for _ in range(3)), "_".join(rng.choice(words) for _ in range(3)), ".".join(rng.choice(words) for _ in range(3))])}', prose() + " ", rng.choice([" ", ". ", "\n"]) + prose()),
        lambda: (rng.choice("=-_") * rng.randint(16, 40) + pick(digits, 1), prose() + " ", " " + prose()),
        lambda: (pick("0aAx1", 1) * rng.randint(16, 32) + "1", prose() + " ", " " + prose()),
        lambda: (rng.choice(words) + "".join(rng.choice(words) for _ in range(3)) + pick(digits, 2), prose() + " ", " " + prose()),
    ]
    out = []
    for k in range(FINDINGS):
        group, label = (positive, 1) if k % 2 else (negative, 0)
        found = None
        while not found:  # the candidate as the scan cuts it out of the words around; not every draw makes one
            hit, left, right = group[k // 2 % len(group)]()
            found = next((m for m in re.finditer(CANDIDATE, left + hit + right, re.ASCII) if m.end() >= len(left) + len(hit) and m.start() < len(left) + len(hit)), None)
        # most texts have no telling path; trials hold more false positives, settings more secrets
        telling = rng.choice(["src12", "", "en", *(["config/prod.env", "deploy/values.yaml", "tests/data/a.json"] if label else ["tests/test_a.py", "docs/example.md", "a/package-lock.json", "settings.ini"])])
        out.append((found[0], found.string[: found.start()][-CONTEXT:], found.string[found.end() :][:CONTEXT], telling, label))
    return out


_TREES: list[list[forest.Tree]] = []


def examples(spark: SparkSession, found: list[tuple[str, str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The features that Spark computes of labelled findings, and their labels."""
    rows = json.dumps([{"h": h, "l": a, "r": b, "p": p, "y": y} for h, a, b, p, y in found])
    frame = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<h:string,l:string,r:string,p:string,y:int>>")))
    columns = features(*[F.col(n) for n in "hlrp"])
    got = frame.select("y", *[c.alias(n) for n, c in zip(FEATURES, columns)]).collect()
    return np.array([[r[n] for n in FEATURES] for r in got], float), np.array([r["y"] for r in got], float)


def trees(spark: SparkSession) -> list[forest.Tree]:
    """The forest, grown once a process."""
    if not _TREES:
        _TREES.append(forest.grow(*examples(spark, labelled())))
    return _TREES[0]


def with_findings(docs: DataFrame, hits: str, pieces: str, found: str) -> DataFrame:
    """docs with the candidates, the texts between them and the judged candidates (value, start, lead, hit, rule, score), in columns of the given names.

    Each step is a column that later ones use more than once, so that the optimizer keeps it and the texts are searched once. Offsets are
    sums within groups of SUMMED candidates and before them, so the cost of many candidates is not that of their pairs.
    """
    grown = trees(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes, groups, before = (fresh_name(docs, n) for n in ("sizes", "groups", "before"))
    origin = F.coalesce(docs["source"].cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    n = F.size(hits)
    total = lambda c, first, count: F.aggregate(F.slice(c, first, count), F.lit(0), lambda a, b: a + b)
    d = docs.withColumn(hits, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    d = d.withColumn(pieces, F.when(n > 0, F.split(text, CANDIDATE, -1)))
    d = d.withColumn(sizes, F.when(n > 0, F.zip_with(F.slice(pieces, F.lit(1), n), hits, lambda p, h: F.length(p) + F.length(h))))
    d = d.withColumn(groups, F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SUMMED).cast("int")), lambda k: total(sizes, k * SUMMED + 1, F.lit(SUMMED)))))
    d = d.withColumn(before, F.when(n > 0, F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda k: total(groups, F.lit(1), k))))

    def candidate(i: Column) -> Column:
        hit, left, right = F.element_at(hits, i), F.element_at(pieces, i), F.element_at(pieces, i + 1)
        k = F.floor((i - 1) / SUMMED).cast("int")
        at = F.element_at(before, k + 1) + total(sizes, k * SUMMED + 1, i - 1 - k * SUMMED)
        return F.struct(hit.alias("hit"), F.right(left, F.lit(CONTEXT)).alias("left"), F.left(right, F.lit(CONTEXT)).alias("right"), (at + F.length(left)).alias("at"))

    def measured(c: Column) -> Column:
        return F.struct(c["hit"].alias("hit"), c["at"].alias("at"), *[f.alias(n) for n, f in zip(FEATURES, features(c["hit"], c["left"], c["right"], origin))])

    def judged(c: Column) -> Column:
        value = F.when(c["named"] > 0, F.regexp_extract(c["hit"], _VALUE, 1)).otherwise(c["hit"])
        lead = F.when(c["named"] > 0, F.length(c["hit"]) - F.length(value) - _quoted(c["hit"]).cast("int")).otherwise(F.lit(0))
        rule = F.when(c["pem"] > 0, "private_key").when(c["provider"] > 0, "provider_token").when(c["hint"] > 0, "assigned_secret").otherwise("high_entropy")
        return F.struct(value.alias("value"), (c["at"] + lead).alias("start"), lead.alias("lead"), c["hit"].alias("hit"), rule.alias("rule"), forest.score(grown, [c[n] for n in FEATURES]).alias("score"))

    all_found = F.transform(F.transform(F.transform(F.sequence(F.lit(1), n), candidate), measured), judged)
    none = F.expr("cast(array() as array<struct<value:string,start:int,lead:int,hit:string,rule:string,score:double>>)")
    return d.withColumn(found, F.when(n > 0, all_found).otherwise(none)).drop(sizes, groups, before)


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, start_char, n_chars, rule, score and value_sha256 of every secret (score of THRESHOLD or more); the value itself is not given."""
    d = with_findings(only(docs, "doc_id", "text", *[n for n in docs.columns if n == "source"]), "hits", "pieces", "found")
    # explode_outer: for explode the optimizer adds a filter on the array, below the columns it is made of, and computes these in it again and again
    f = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode_outer("found").alias("f"))
    return f.filter(F.col("f.score") >= THRESHOLD).select("doc_id", F.col("f.start").cast("long").alias("start_char"), F.length("f.value").cast("long").alias("n_chars"), F.col("f.rule").alias("rule"), F.round("f.score", 6).alias("score"), F.sha2("f.value", 256).alias("value_sha256"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced by MARK in text, and n_chars counted anew where something was replaced."""
    names = docs.columns
    hits, pieces, found, text = (fresh_name(docs, n) for n in ("hits", "pieces", "found", "text"))
    d = with_findings(docs, hits, pieces, found)
    part = lambda p, f: F.concat(p, F.when(f["score"] >= THRESHOLD, F.concat(F.left(f["hit"], f["lead"]), F.lit(MARK))).otherwise(f["hit"]))
    # a quoted hit ends with its quote, which stays
    tail = lambda f: F.when((f["score"] >= THRESHOLD) & (f["lead"] > 0) & _quoted(f["hit"]), F.right(f["hit"], F.lit(1))).otherwise(F.lit(""))
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), found, lambda p, f: F.concat(part(p, f), tail(f))), ""), F.element_at(pieces, -1))
    any_secret = (F.size(hits) > 0) & F.exists(found, lambda f: f["score"] >= THRESHOLD)
    d = d.withColumn(text, F.when(any_secret, joined).otherwise(F.col("text")))
    out = {"text": F.col(text)} | ({"n_chars": F.when(any_secret, F.length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))} if "n_chars" in names else {})
    return d.select(*[out[n].alias(n) if n in out else F.col(f"`{n}`") for n in names])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return findings(table(spark, sf_dir, "documents"))
