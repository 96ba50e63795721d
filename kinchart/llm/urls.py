"""URL filter: gradient-boosted trees on lexical features, behind host and path rules.

DataFrame functions and Spark ML only.  URLs that a rule fits take the rule's verdict and are the
labelled rows the trees learn from (a bounded sample, taken by a hash of the URL): length, depth,
shares of digits, entropy of the characters, parameters, and how often a host's endings are blocked.
The trees judge what no rule fits.  A labelled row sees how often its endings are blocked in the other
folds of hosts only, so no row is taught by its own label; ``held_out`` tells how well hosts are judged
that the trees have not seen.

Defined cases: a null URL and one without ``://`` has an empty host and path, fits no rule, and is
judged by the trees like any other; with labels of one kind only, that kind is the verdict;
without labels the verdict is ``allow``.  Repeated rows and extra columns change nothing; columns
named like a result are replaced.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinchart.functions.spans import let
from kinchart.llm.common import stored

MAX_ROWS = 20_000
FEATURES = (
    "url_length", "host_length", "path_length", "labels", "depth", "digits", "host_digits", "signs", "hyphens",
    "entropy", "parameters", "fragment", "ending_rate", "domain_rate",
)
_HASH_RANGE = 2**30
# Folds of hosts, and rows of the mean that a rate begins with.
FOLDS, PRIOR = 5, 10


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    known = at > 0
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.when(known, lower), F.lit("")), F.coalesce(F.when(known, path), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(text, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, sign, ""))


def _entropy(text: Column) -> Column:
    """Bits a character: each distinct character once."""
    size = F.length(text)

    def part(sign: Column) -> Column:
        share = (size - F.length(F.replace(text, sign, F.lit("")))) / size
        return -share * F.log2(share)

    return F.coalesce(F.aggregate(F.transform(F.array_distinct(F.split(text, "")), part), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def _ending(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path and the features that need no labels."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    size = F.greatest(F.length(u), F.lit(1))
    split = urls.withColumns({"host": host, "path": path})
    return split.withColumns(
        {
            "url_length": F.length(u).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "depth": _count(F.col("path"), "/+").cast("double"),
            "digits": _count(u, "[0-9]") / size,
            "host_digits": _count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1)),
            "signs": _count(u, "[^A-Za-z0-9]") / size,
            "hyphens": _count(F.col("host"), "-").cast("double"),
            "entropy": let(F.concat("host", "path"), lambda t: F.when(F.length(t) > 0, _entropy(t)).otherwise(F.lit(0.0))),
            "parameters": (_count(u, "[&=]")).cast("double"),
            "fragment": u.contains("#").cast("double"),
        }
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")


def _with_rates(df: DataFrame, labelled: DataFrame, mean: float, own_fold_out: bool) -> DataFrame:
    """``df`` with the rates of its hosts' endings among the labelled rows (a bounded sample: so are these tables)."""
    for name, labels in (("ending_rate", 1), ("domain_rate", 2)):
        sums = (F.sum("label").alias("_s"), F.count("*").alias("_n"))
        ending = _ending(F.col("host"), labels)
        whole = labelled.groupBy(ending.alias("_end")).agg(*sums)
        df = df.withColumn("_end", ending).join(F.broadcast(whole), "_end", "left")
        s, n = F.coalesce("_s", F.lit(0.0)), F.coalesce("_n", F.lit(0))
        if own_fold_out:
            parts = labelled.groupBy(ending.alias("_end"), _fold().alias("_fold")).agg(*sums).toDF("_end", "_fold", "_fs", "_fn")
            df = df.withColumn("_fold", _fold()).join(F.broadcast(parts), ["_end", "_fold"], "left")
            s, n = s - F.coalesce("_fs", F.lit(0.0)), n - F.coalesce("_fn", F.lit(0))
        df = df.withColumn(name, (s + PRIOR * mean) / (n + PRIOR)).drop("_end", "_s", "_n", "_fold", "_fs", "_fn")
    return df


def _grown(sample: DataFrame, mean: float, trees: int, depth: int) -> PipelineModel:
    """Trees fitted on the labelled rows."""
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    grower = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=trees, maxDepth=depth, seed=11, subsamplingRate=1.0)
    return Pipeline(stages=[vector, grower]).fit(_with_rates(sample, sample, mean, True).select("label", *FEATURES))


def _sample(known: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows, give or take: by a hash of the URL."""
    labelled = known.where(F.col("_rule").isNotNull())
    wanted = F.lit(int(_HASH_RANGE * min(1.0, max_rows / max(1, labelled.count()))))
    sample = labelled.where(F.pmod(F.xxhash64("_url"), F.lit(_HASH_RANGE)) < wanted).limit(2 * max_rows)
    label = (F.col("_rule.verdict") == "block").cast("double").alias("label")
    return stored(sample.select("host", label, *[f for f in FEATURES if not f.endswith("_rate")]))


def held_out(
    pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, max_rows: int = MAX_ROWS, trees: int = 20, depth: int = 4
) -> DataFrame:
    """(label, verdict, rows) of the labelled hosts of one fold, judged by trees that learnt from the others."""
    known = lexical(pages.select(F.col(url).alias("_url")), "_url").withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    sample = _sample(known, max_rows)
    seen, rest = sample.where(_fold() != 0), sample.where(_fold() == 0)
    mean = seen.agg(F.avg("label")).first()[0] or 0.0
    judged = _grown(seen, mean, trees, depth).transform(_with_rates(rest, seen, mean, False))
    return judged.groupBy("label", F.col("prediction").alias("verdict")).agg(F.count("*").alias("rows"))


def judge_urls(
    pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, max_rows: int = MAX_ROWS,
    trees: int = 20, depth: int = 4,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``score`` (how likely the trees hold a block)."""
    names = ("host", "path", "rule", "verdict", "score")
    rest = [c for c in pages.columns if c not in (*names, url)]
    # the caller's columns travel under numbers: none clashes with a feature
    numbered = pages.select(F.col(url).alias("_url"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
    known = lexical(numbered, "_url").withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    sample = _sample(known, max_rows)
    kinds = sample.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = kinds["n"], kinds["blocked"] or 0.0
    judged = known
    if 0 < blocked < n:
        mean = blocked / n
        judged = _grown(sample, mean, trees, depth).transform(_with_rates(known, sample, mean, False))
        score = vector_to_array(F.col("probability"))[1]
    else:
        score = F.lit(float(n > 0 and blocked == n))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(score >= 0.5, "block").otherwise("allow"))
    return judged.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)], F.col("_url").alias(url), "host", "path",
        F.col("_rule.text").alias("rule"), verdict.alias("verdict"), score.alias("score"),
    )
