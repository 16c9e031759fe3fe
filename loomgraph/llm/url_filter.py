"""URL filter: host and path rules first, then a character language-model ratio; DataFrame functions only.

Two variable-order Markov models over the characters of URLs, one of URLs that rules allow and one of those that they
block, are counts of n-grams smoothed from order to order (Witten-Bell). A URL's log-likelihood difference, divided by its
length, is held against a threshold calibrated on the same labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_width

ORDER = 4  # characters of context, at most
START = "\x02"
ALPHABET = 256.0  # symbols over which the lowest order spreads what it hasn't seen


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


#: The rules of the query.
RULES = (
    Rule("com", "", "allow"),
    Rule("example.com", "en/", "block"),
    Rule("www.example.com", "en/", "allow"),
    Rule("net", "es/", "block"),
    Rule("net", "fr/", "block"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (name, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit("/" + r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def model_text(host: Column, path: Column) -> Column:
    """The characters that the models see."""
    return F.concat(host, path)


def grams(texts: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each character of ``text``: context (up to ORDER characters before it) and ch."""
    padded = F.concat(F.lit(START * ORDER), F.col("text"))
    rows = texts.select(*keep, padded.alias("padded"), F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    return rows.select(*keep, F.substring("padded", F.col("at"), F.lit(ORDER)).alias("context"), F.substring("padded", F.col("at") + ORDER, F.lit(1)).alias("ch"))


def _counts(labelled: DataFrame) -> DataFrame:
    """(context, ch, a, b): counts in allowed and blocked URLs, contexts of every length."""
    whole = grams(labelled, ["allowed", "n"]).groupBy("context", "ch").agg(
        F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("allowed"), 0).otherwise(F.col("n"))).alias("b")
    )
    shorter = whole.select(F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("from"), "context", "ch", "a", "b")
    shorter = shorter.select(F.expr("substring(context, `from`)").alias("context"), "ch", "a", "b")
    return shorter.groupBy("context", "ch").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def model(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, ch, pa, pb) of every n-gram seen in ``labelled`` (text, allowed, n), and (context, ta, tb, da, db): how many
    characters, and how many kinds of them, follow a context in allowed and blocked URLs."""
    counts = materialise(_counts(labelled), "grams")
    context = counts.groupBy("context").agg(
        F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.sum((F.col("a") > 0).cast("int")).alias("da"), F.sum((F.col("b") > 0).cast("int")).alias("db")
    )
    full = counts.join(context, "context")

    def level(k: int) -> DataFrame:
        return full.filter(F.length("context") == k)

    def mixed(count: str, total: str, kinds: str, lower: Column) -> Column:
        """Witten-Bell: (count + kinds * lower) / (total + kinds); an unseen context leaves the lower order as it is."""
        top, rest = F.col(count), F.col(total) + F.col(kinds)
        return F.when(rest > 0, (top + F.col(kinds) * lower) / rest).otherwise(lower)

    known = level(0).select("context", "ch", mixed("a", "ta", "da", F.lit(1 / ALPHABET)).alias("pa"), mixed("b", "tb", "db", F.lit(1 / ALPHABET)).alias("pb"))
    out = known
    for k in range(1, ORDER + 1):
        below = known.select(F.col("context").alias("tail"), "ch", F.col("pa").alias("la"), F.col("pb").alias("lb"))
        known = level(k).withColumn("tail", F.expr("substring(context, 2)")).join(below, ["tail", "ch"]).select(
            "context", "ch", mixed("a", "ta", "da", F.col("la")).alias("pa"), mixed("b", "tb", "db", F.col("lb")).alias("pb")
        )
        known = materialise(known, "order")
        out = out.unionByName(known)
    return materialise(out, "seen"), materialise(context, "contexts")


def scored(texts: DataFrame, seen: DataFrame, context: DataFrame) -> DataFrame:
    """(text, score): length-normalised log10 likelihood difference of each distinct text.

    Distinct n-grams are scored once: from the longest context down, the probabilities of the longest n-gram that was seen,
    times what each longer context leaves to unseen characters.
    """
    rows = materialise(grams(texts, ["text"]).groupBy("text", "context", "ch").agg(F.count("*").alias("n")), "textgrams")
    asked = rows.select("context", "ch").distinct()
    tails = asked.select("context", "ch", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda i: F.substring(F.col("context"), i, F.lit(ORDER)))).alias("drop", "tail"))
    found = tails.join(seen.withColumnRenamed("context", "tail"), ["tail", "ch"], "left").join(context.withColumnRenamed("context", "tail"), "tail", "left")
    spare = lambda kinds, total: F.when(F.col(total) + F.col(kinds) > 0, F.col(kinds) / (F.col(total) + F.col(kinds))).otherwise(1.0)
    found = found.select("context", "ch", "drop", "pa", "pb", spare("da", "ta").alias("sa"), spare("db", "tb").alias("sb"))
    one = found.groupBy("context", "ch").agg(F.sort_array(F.collect_list(F.struct("drop", "pa", "pb", "sa", "sb"))).alias("orders"))

    def value(p: str, s: str) -> Column:
        start = F.struct(F.lit(1.0).alias("left"), F.lit(None).cast("double").alias("got"))

        def step(acc: Column, x: Column) -> Column:
            got = F.when(acc["got"].isNotNull(), acc["got"]).when(x[p].isNotNull(), acc["left"] * x[p])
            left = F.when(x[p].isNotNull(), acc["left"]).otherwise(acc["left"] * F.coalesce(x[s], F.lit(1.0)))
            return F.struct(left.alias("left"), got.alias("got"))

        return F.aggregate("orders", start, step, lambda acc: F.coalesce(acc["got"], acc["left"] / ALPHABET))

    ratio = one.select("context", "ch", (F.log10(value("pa", "sa")) - F.log10(value("pb", "sb"))).alias("ratio"))
    ratio = materialise(ratio, "ratios")
    return rows.join(ratio, ["context", "ch"]).groupBy("text").agg((F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("score"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages``.

    The longest rule that fits decides; where none does, a score at or above the threshold allows. The threshold lies
    between the mean scores of allowed and of blocked URLs, nearer to the class that spreads less; with no labelled URL of
    either kind it is 0 and all scores are 0, so that the url is allowed. A null url, or one without ``://``, has an empty
    host and path, which no rule fits and the models score 0. Repeated rows are judged alike.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = materialise(rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", model_text(F.col("host"), F.col("path"))), "urls")
    texts = rows.groupBy("text").agg(F.max("fit").alias("fit"), F.count("*").alias("n")).filter("text != ''")
    # few bytes become many rows: dealt out again before each text is cut into its n-grams
    texts = materialise(texts.repartition(shuffle_width(pages.sparkSession)), "texts")
    labelled = materialise(texts.filter("fit is not null").select("text", (F.col("fit.verdict") == "allow").alias("allowed"), "n"), "labelled")
    seen, context = model(labelled)
    scores = materialise(scored(texts.select("text"), seen, context), "scores")
    spread = labelled.join(scores, "text").agg(
        *(F.coalesce(f(F.when(F.col("allowed") == side, F.col("score"))), F.lit(0.0)).alias(f"{name}{int(side)}") for side in (True, False) for name, f in (("m", F.avg), ("s", F.stddev_pop)))
    )
    total = F.col("s0") + F.col("s1")
    cut = spread.select(F.when(total > 0, (F.col("m1") * F.col("s0") + F.col("m0") * F.col("s1")) / total).otherwise((F.col("m0") + F.col("m1")) / 2).alias("cut"))
    cut = float((cut.first() or [0.0])[0])
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= cut, "allow").otherwise("block"))
    both = rows.join(scores, "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return both.select("page_id", "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"), "score")
