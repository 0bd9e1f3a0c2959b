"""Quality rules on whole texts, and verdicts on the hosts that the texts come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import fresh, let, materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")
WINDOW = 8
#: Rules of the base: a document that fails one is rejected wherever it comes from.
BASE_RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
}
#: Rules whose failures are also weighed by the host.
SOFT_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "3 * n_dup_lines > n_lines",
    "capitals": "2 * n_capitals > word_chars",
}


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct column ``measures`` of counts over each whole text.

    n_words, word_chars: words ``[^\\x20\\x09-\\x0D]+`` and the code points in them; n_symbols:
    characters of ``#*$%&|<>``; n_lines, n_dup_lines: lines with a word, and those of them equal to an
    earlier line; n_repeat_words: words inside 8-word windows that occur twice or more in the text;
    n_capitals: upper-case letters A to Z and of Latin-1, 0 if no two stand together. A column named
    ``measures`` is replaced. A NULL or empty text has 0 of all.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, "[ \t-\r]+", -1), "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column, bare: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            F.when(bare.rlike("[#*$%&|<>]"), F.length(bare) - F.length(F.translate(bare, "#*$%&|<>", "")))
            .otherwise(0).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            # Capitals can only fail their rule where two stand next to each other.
            F.when(bare.rlike("[A-ZÀ-ÖØ-Þ]{2}"), F.length(F.regexp_replace(bare, "[^A-ZÀ-ÖØ-Þ]+", "")))
            .otherwise(0).cast("long").alias("n_capitals"),
        )

    parts = F.struct(words.alias("w"), lines.alias("l"))
    return df.withColumn("measures", let(parts, lambda s: let(
        F.array_join(s["w"], ""), lambda bare: counts(s["w"], bare, s["l"]))))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows found twice or more. Windows are compared by 64-bit hashes; most
    texts have no equal windows and end at the comparison of two counts."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(placed, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
            lambda x: x["i"])))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0), lambda a, x: a + x))

    return let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))


def host_verdicts(
    measured: DataFrame, host: str = "source", bad_rate: float = 0.5, tolerated: float = 0.05
) -> DataFrame:
    """``measured`` (a table with ``measures``) with ``base_failed``, ``host_rate`` and ``kept``.

    Failures are counted per host and rule. The rate of each is shrunk towards the corpus:
    (failed + a) / (documents + a + b), where the beta prior (a, b) of a rule has the mean and the
    spread that the hosts' own rates show (method of moments, hosts weighted by documents). So a
    host with few documents is judged nearly as the corpus is, one with many by its own rate.

    A document is kept unless it fails a base rule, or fails a soft rule whose shrunk rate at its
    host is at least ``tolerated``, or its host's shrunk rate of any failure is over ``bad_rate``.

    The measured table is written once; its rows meet the verdicts, one row per host, by host, so
    that no hot host is gathered. Columns named like the three are replaced. Documents with a NULL host form one host. Repeated rows count
    each. An empty table gives an empty table.
    """
    fails, rates, n, name = fresh(measured, "fails", "rates", "n_docs", "host_name")
    base = [F.expr(_on(r)) for r in BASE_RULES.values()]
    soft = [F.expr(_on(r)).cast("int").alias(k) for k, r in SOFT_RULES.items()]
    failed_base = base[0]
    for r in base[1:]:
        failed_base = failed_base | r
    any_soft = F.greatest(*[F.expr(_on(r)).cast("int") for r in SOFT_RULES.values()])
    rows = materialize(measured.withColumns({
        "base_failed": failed_base,
        fails: F.struct(*soft, F.greatest(failed_base.cast("int"), any_soft).alias("any"))}))
    rules = [*SOFT_RULES, "any"]
    hosts = materialize(rows.groupBy(F.col(host).alias(name)).agg(
        F.count(F.lit(1)).alias(n), *[F.sum(F.col(fails)[r]).alias(r) for r in rules]))
    prior = beta_priors(hosts, rules, n)
    shrunk = {r: (F.col(r) + F.lit(prior[r][0])) / (F.col(n) + F.lit(sum(prior[r]))) for r in rules}
    verdicts = hosts.select(name, F.struct(*[c.alias(r) for r, c in shrunk.items()]).alias(rates))
    out = rows.join(verdicts, F.col(host).eqNullSafe(F.col(name)), "left")
    soft_failed = F.lit(False)
    for r in SOFT_RULES:
        soft_failed = soft_failed | ((F.col(fails)[r] == 1) & (F.col(rates)[r] >= tolerated))
    host_bad = F.col(rates)["any"] > bad_rate
    return out.withColumns({
        "host_rate": F.col(rates)["any"], "kept": ~(F.col("base_failed") | soft_failed | host_bad),
    }).drop(fails, rates, name)


def _on(rule: str) -> str:
    for m in (*MEASURES, "n_lines"):
        rule = rule.replace(m, f"measures.{m}")
    return rule


def beta_priors(hosts: DataFrame, rules: list[str], n: str) -> dict[str, tuple[float, float]]:
    """The (a, b) of each rule from one row of sums over all hosts.

    With p the corpus rate and v the spread of the hosts' rates beyond what chance gives hosts of
    their size, a + b = p (1 - p) / v - 1, at least one document. Where the hosts differ by no more than chance the prior
    is as heavy as the corpus, and where p is 0 or 1 it is a single document of that kind.
    """
    sums = hosts.agg(
        F.sum(n).alias("docs"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col(n) * F.col(n).cast("double")).alias("squares"),
        *[F.sum(r).alias(f"f_{r}") for r in rules],
        *[F.sum(F.col(r).cast("double") * F.col(r) / F.col(n)).alias(f"s_{r}") for r in rules]).first()
    docs, count = sums["docs"] or 0, sums["hosts"] or 0
    out = {}
    for r in rules:
        p = (sums[f"f_{r}"] or 0) / docs if docs else 0.0
        if count < 2 or p <= 0 or p >= 1:
            out[r] = (p, 1 - p)
            continue
        between = (sums[f"s_{r}"] - docs * p * p) / (count - 1)  # sum of n (rate - p) ** 2
        size = (docs - sums["squares"] / docs) / (count - 1)  # mean documents of a host
        spread = max(0.0, (between - p * (1 - p)) / (size - 1)) if size > 1 else 0.0
        weight = min(float(docs), p * (1 - p) / spread - 1) if spread > 0 else float(docs)
        weight = max(weight, 1.0)
        out[r] = (p * weight, (1 - p) * weight)
    return out
