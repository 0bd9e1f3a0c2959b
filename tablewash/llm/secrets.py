"""Secrets in texts: candidates, and a random forest that removes those that are none."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.llm.common import fresh, let, materialize
from tablewash.llm.labelled_findings import labelled_findings, labelled_values

#: Labelled findings that the forest is trained from (and as many labelled values), its trees and their depth.
FINDINGS, TREES, DEPTH = 2000, 24, 7
#: A name that tells of a secret, and what stands between it and its value, up to a quote.
_NAME = r"(?i:token|secret|passw(?:or)?d|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)"
_GIVEN = _NAME + r"[A-Za-z0-9_\-]{0,24}[\"']?\]?\s{0,4}(?:=|:|:=|=>)\s{0,4}"
#: Names themselves, which are no candidates; they end before the sign of assignment.
_NAMES = rf"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{{0,40}}?{_NAME}[A-Za-z0-9_\-]{{0,24}}(?=[\"']?\]?\s{{0,4}}(?:=|:))"
_KEY_LABEL = "[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_KEY_BLOCK = rf"-----BEGIN {_KEY_LABEL}(?:[^-]*+(?:-(?!----)[^-]*+){{0,200}}+-----END {_KEY_LABEL}|[A-Za-z0-9+/=\\\r\n]*+)"
#: What can be a secret, in the order in which it is tried: private-key blocks; values after a name, in quotes
#: or not, of any length; (names;) tokens with dots; runs of 16 or more characters of keys.
CANDIDATE = "|".join((
    _KEY_BLOCK,
    rf"(?<=\")(?<={_GIVEN}\")[^\"\n]+(?=\")", rf"(?<=')(?<={_GIVEN}')[^'\n]+(?=')",
    rf"(?<=[=:>]\s{{0,4}})(?<={_GIVEN})[^\s\"'`,;=:>][^\s\"'`,;]*(?<![.:)\]}}>])",
    _NAMES,
    r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{2,}+\.[A-Za-z0-9_\-]{16,}+(?:\.[A-Za-z0-9_\-]++)*",
    r"[A-Za-z0-9+/_\-][A-Za-z0-9+/=_\-]{15,}"))
BEFORE, AFTER = 40, 12
#: Candidates whose lengths are summed up together.
RUN = 64
#: Pieces of words that texts and names are made of.
DICTIONARY = (
    "tion ing the and ver sch ung keit heit lich ein ent ble ment que ción mente elle eau able ness less ight ough "
    "get set user account file data list index handler service config default value name time page view table item "
    "usr local share home path image font static content upload download test example sample insert here your change "
    "key token secret password private public access client server string number date type class function return "
    "hat her ere ith for that with this from have not are was all out one can had has end ast est ist ich der die das "
    "und ier ous ive ate ant ine ure ity ism ology graph phone house work land man").split()
FEATURES = ("length", "digits", "capitals", "transitions", "vowels", "dictionary", "distinct", "letter_run", "hex_only",
            "path", "secret_words", "harmless_words", "assigned", "quoted", "letter_beside", "signs", "named", "key_block", "code",
            "filler", "line_before", "digest")


def _features(c: Column, before: Column, after: Column) -> Column:
    """What the forest sees of a candidate: its length, how its characters change, how much of it is
    words, whether it is part of a path, and the words next to it."""
    n, low, near = F.length(c), F.lower(c), F.lower(before)
    share = lambda keep: F.length(F.regexp_replace(c, f"[^{keep}]", "")) / n
    runs = F.size(F.regexp_extract_all(c, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)))
    letters = F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0))
    yes = lambda x: x.cast("int")
    return F.array(*[x.cast("double") for x in (
        n, share("0-9"), share("A-Z"), runs / n, share("aeiouyAEIOUY"),
        1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")) / n,
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(24)),
        F.coalesce(F.array_max(F.transform(letters, lambda x: F.length(x))), F.lit(0)) / n,
        yes(c.rlike("^[0-9a-fA-F]+$")),
        yes(before.rlike(r"/$|\.$|://\S*$") | c.rlike("[A-Za-z]{3}/[A-Za-z]{3}")),
        yes(near.rlike(r"token|secret|passw|api.?key|access.?key|private.?key|bearer|auth|credential|key\W{0,4}$")),
        yes(near.rlike(r"(sha-?\d*|hash|md5|commit|checksum|digest|etag|uuid|revision|base64|id)\W{0,4}$|;base64,$")),
        yes(before.rlike(r"[=:]\s*[\"']?$")), yes(after.rlike("^[\"']")),
        yes(before.rlike(r"[^\x00-\x7F]$") | after.rlike(r"^[^\x00-\x7F]")),
        1 - share(r"A-Za-z0-9\s"), yes(before.rlike(rf"{_GIVEN}[\"']?$")), yes(c.rlike("^-----BEGIN ")),
        yes(c.rlike(r"^[$%]?[{<(\[]|\(|^\$[A-Za-z_]+$|^(?i:self|os|process|config|settings|env|request|args|this|options)\b[.\[]")),
        yes(low.rlike(r"^(.)\1*$|^(none|null|nil|true|false|str|string|text|bytes|optional|required|undefined|empty|todo|"
                      r"redacted|hidden|changeme|example|placeholder)$|^(your|my|the|insert|enter|example)[ _-]|^x{3,}|\*{3,}")),
        yes(before.rlike(r"(^|[\n{,;])[^\n ]*\s?[=:]\s?[\"']?$")),
        yes(c.rlike(r"(?i:sha-?\d+|md5)[-:]")))])


def candidates(text: Column) -> Column:
    """Every match of ``CANDIDATE`` but names, with start, length and features. The text is cut once
    at the candidates. A candidate's place is the sum of the lengths before it: of whole runs of
    ``RUN`` candidates, then of those of its own run, so that the work per candidate is bounded. The
    characters before a candidate are those of the whole text, whatever other candidates they belong to."""
    whole = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(whole, CANDIDATE, -1)
    total = lambda values, low, high: F.aggregate(
        F.sequence(low, high), F.lit(0), lambda s, j: s + F.get(values, j))

    def placed(p: Column) -> Column:
        """With the length of each gap and its candidate, and of what is before each run."""
        n = F.transform(p["c"], lambda c, i: F.length(c) + F.length(F.get(p["g"], i)))
        return let(n, lambda n: let(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / RUN).cast("int")),
                        lambda k: total(n, k * RUN, F.least((k + 1) * RUN, F.size(n)) - 1)),
            lambda runs: F.struct(p["c"].alias("c"), p["g"].alias("g"), n.alias("n"), F.transform(
                runs, lambda r, k: total(runs, F.lit(0), k) - r).alias("s"))))

    def before(p: Column, i: Column) -> Column:
        """Each piece before a candidate has a character at least, so a bounded number of them is enough."""
        gap = F.get(p["g"], i)
        pieces = F.transform(F.sequence(F.greatest(i - BEFORE, F.lit(0)), i - 1), lambda j: F.concat(
            F.right(F.get(p["g"], j), F.lit(BEFORE)), F.right(F.get(p["c"], j), F.lit(BEFORE))))
        return F.right(F.when((F.length(gap) >= BEFORE) | (i == 0), gap).otherwise(F.concat(F.array_join(pieces, ""), gap)), F.lit(BEFORE))

    def described(p: Column) -> Column:
        each = F.transform(p["c"], lambda c, i: F.struct(
            c.alias("c"),
            (F.get(p["s"], F.floor(i / RUN).cast("int")) + total(p["n"], i - i % RUN, i) - F.length(c)).alias("at"),
            before(p, i).alias("before"), F.left(F.get(p["g"], i + 1), F.lit(AFTER)).alias("after")))
        each = F.filter(each, lambda x: ~(x["c"].rlike(rf"^[A-Za-z0-9_\-]*{_NAME}[A-Za-z0-9_\-]*$") & x["after"].rlike(r"^[\"']?\]?\s{0,4}[=:]")))
        return F.transform(each, lambda x: F.struct(
            x["at"].alias("start"), F.length(x["c"]).alias("length"), x["c"].alias("candidate"),
            _features(x["c"], x["before"], x["after"]).alias("x")))

    parts = let(F.struct(found.alias("c"), gaps.alias("g")), lambda p: let(placed(p), described))
    return F.when(whole.rlike(CANDIDATE), parts)


def labelled_features(spark: SparkSession, examples: list[tuple[str, str, int]]) -> DataFrame:
    """(x, label) of every candidate of the labelled texts; candidates other than the marked are harmless."""
    rows = json.dumps([{"text": t, "marked": m, "secret": s} for t, m, s in examples])
    texts = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<text:string,marked:string,secret:int>>")).alias("e")).select("e.*")
    each = texts.select("marked", "secret", F.explode(candidates(F.col("text"))).alias("c"))
    return each.select(F.col("c.x").alias("x"), F.when(F.contains("c.candidate", "marked"), F.col("secret")).otherwise(0).cast("double").alias("label"))


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: node i of a tree has the children 2 i + 1 and 2 i + 2, and a branch
    that ends early goes on with equal leaves. ``feature`` and ``threshold`` hold the inner nodes of
    one tree after the other, ``secret`` the leaves."""

    depth: int
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    secret: tuple[float, ...]

    def chance(self, x: Column) -> Column:
        """The chance that a candidate with features ``x`` is a secret: every tree is walked down step by
        step, so the plan holds three arrays and a short expression, whatever the number of trees."""
        inner, leaves = 2**self.depth - 1, 2**self.depth
        trees = len(self.secret) // leaves
        given = lambda kind, values: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")

        def walk(tree: Column) -> Column:
            down = F.aggregate(
                F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0),
                lambda node, _: node * 2 + 1 + (F.get(x, F.get(given("int", self.feature), tree * inner + node))
                                                > F.get(given("double", self.threshold), tree * inner + node)).cast("int"))
            return F.get(given("double", self.secret), tree * leaves + down - inner)

        return F.aggregate(F.sequence(F.lit(0), F.lit(trees - 1)), F.lit(0.0), lambda s, tree: s + walk(tree)) / trees


def train_forest(spark: SparkSession, findings: int = FINDINGS, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """A forest trained from ``findings`` labelled findings and as many labelled values. The training
    set is bounded, and its rows are in one partition, so the same forest comes out everywhere."""
    rows = labelled_features(spark, labelled_findings(findings) + labelled_values(findings))
    # Written once, as the training reads it several times.
    model = fit_model(materialize(rows.coalesce(1)), trees, depth)
    feature, threshold, secret = [], [], []
    for tree in model.trees:
        nodes: dict[int, object] = {0: tree._java_obj.rootNode()}
        for at in range(2 ** (depth + 1) - 1):
            node = nodes[at]
            if at >= 2**depth - 1:
                harmless, leaf = node.impurityStats().stats()
                secret.append(round(leaf / (harmless + leaf), 6))
            elif node.subtreeDepth() == 0:
                nodes[2 * at + 1] = nodes[2 * at + 2] = node
                feature.append(0)
                threshold.append(0.0)
            else:
                nodes[2 * at + 1], nodes[2 * at + 2] = node.leftChild(), node.rightChild()
                feature.append(node.split().featureIndex())
                threshold.append(node.split().threshold())
    return Forest(depth, tuple(feature), tuple(threshold), tuple(secret))


def fit_model(rows: DataFrame, trees: int, depth: int):
    return RandomForestClassifier(
        featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird",
    ).fit(rows.coalesce(1).select(array_to_vector("x").alias("v"), "label"))


def find_secrets(df: DataFrame, text: str = "text", out: str = "findings", least: float = 0.5, forest: Forest | None = None) -> DataFrame:
    """``df`` with a column of its findings: (start, length, score) of each secret, in order; start
    counts code points from 0.

    Candidates are private-key blocks, values of any length and alphabet assigned to a name that tells
    of a secret, tokens with dots, and all other runs of 16 or more of the characters that keys are made
    of. A random forest over their length, character transitions, dictionary coverage, path and neighbouring words gives
    each a score; those under ``least`` are removed as false positives. Only Spark expressions run
    over the rows, the trained trees among them, and nothing is shuffled.

    A NULL or empty text has no findings. Long texts are read whole. Equal rows have equal findings.
    An empty table gives an empty table. A column named ``out`` is replaced.
    """
    (found,) = fresh(df, "found")
    forest = forest or train_forest(df.sparkSession)
    scored = F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["length"].alias("length"), forest.chance(f["x"]).alias("score")))
    none = F.expr("cast(array() as array<struct<start:int,length:int,score:double>>)")
    kept = F.coalesce(F.filter(scored, lambda s: s["score"] >= least), none)
    return df.withColumn(found, candidates(F.col(text))).withColumn(out, kept).drop(found)


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every finding replaced by ``mark``."""
    end = lambda i: F.get(findings, i)["start"] + F.get(findings, i)["length"]
    between = F.transform(F.sequence(F.lit(0), F.size(findings)), lambda i: F.substring(
        text, F.coalesce(end(i - 1), F.lit(0)) + 1,
        F.coalesce(F.get(findings, i)["start"], F.length(text)) - F.coalesce(end(i - 1), F.lit(0))))
    return F.when(F.size(findings) > 0, F.array_join(between, mark)).otherwise(text)
