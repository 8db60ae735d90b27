"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for what no rule fits.

Everything runs in the JVM: features and rules are column expressions, the trees are Spark ML's. They are trained from
labelled URLs: those that a rule fits (or those of a table of labels), TRAIN_ROWS different ones at most, of least md5
of the URL; a URL that many rows have counts once, by its greatest label. Of a suffix (the host's last label) the features hold the smoothed share of blocked training URLs.

A null URL, or one without `://`, has empty host and path; no rule fits it and the trees judge it by its features.
Without training rows, or with one class only, that class (allow if none) is the method's verdict everywhere. Repeated
URLs get equal verdicts; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import written

#: (host, path, verdict); a rule fits its host and all subdomains, the longest that fits wins.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
TRAIN_ROWS, ROUNDS, DEPTH, PRIOR = 10_000, 12, 3, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "host_labels", "host_length", "longest_run", "hyphens", "secure", "fragment", "suffix_rate"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    pick = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(pick(1), _UPPER, _LOWER), pick(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character by the text's own character counts."""
    n = F.length(text).cast("double")
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.coalesce(F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))), F.lit(0.0))


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with the features of the URL, but for suffix_rate; needs columns host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    runs = F.transform(F.split(u, r"[^A-Za-z]+"), lambda x: F.length(x))
    return pages.withColumns(
        {
            "length": F.length(u).cast("double"),
            "depth": F.regexp_count("path", F.lit(r"/[^/]+")).cast("double"),
            "digit_ratio": F.coalesce(F.try_divide(F.regexp_count(u, F.lit("[0-9]")).cast("double"), F.length(u)), F.lit(0.0)),
            "entropy": entropy(u),
            "params": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "host_labels": F.regexp_count("host", F.lit(r"[^.]+")).cast("double"),
            "host_length": F.length("host").cast("double"),
            "longest_run": F.coalesce(F.array_max(runs), F.lit(0)).cast("double"),
            "hyphens": F.regexp_count(u, F.lit("-")).cast("double"),
            "secure": u.startswith("https://").cast("double"),
            "fragment": F.contains(u, F.lit("#")).cast("double"),
            "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
        }
    )


class UrlModel:
    """Suffix rates and trees, fitted on rows (url, host, path, blocked)."""

    def __init__(self, labelled: DataFrame, train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, depth: int = DEPTH):
        # different URLs under a threshold of their hash that lets through a few more than asked for, then the least of these
        some = labelled.agg(F.approx_count_distinct("url")).first()[0]
        rank = F.conv(F.substring(F.md5(F.coalesce(F.col("url"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
        near = labelled.filter(rank <= int(min(1.0, 1.3 * (train_rows + 100) / max(some, 1)) * (1 << 32)))
        near = near.groupBy("url", "host", "path").agg(F.max("blocked").alias("blocked"))
        train = written(lexical(near.orderBy(F.md5(F.coalesce(F.col("url"), F.lit("")).cast("binary")), "url").limit(train_rows)), "urls")
        n, blocked = train.agg(F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
        self.constant = "allow" if not n or not blocked else "block" if blocked == n else None
        self.prior = blocked / n if n else 0.0
        if self.constant:
            return
        # a row per suffix of the bounded sample
        rates = {r[0]: (r[1] + PRIOR * self.prior) / (r[2] + PRIOR) for r in train.groupBy("suffix").agg(F.sum("blocked"), F.count("*")).orderBy("suffix").collect()}
        self.rates = [F.lit(x) for kv in rates.items() for x in kv]
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        ready = self.assembler.transform(self._rated(train)).select("_features", "blocked")
        ready = written(ready, "features", 4)
        self.trees = GBTClassifier(featuresCol="_features", labelCol="blocked", predictionCol="_blocked", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7).fit(ready)

    def _rated(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("suffix_rate", F.coalesce(F.try_element_at(F.create_map(*self.rates), F.col("suffix")), F.lit(self.prior)))

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """rows (url, host, path, ...) with `judged`: block or allow."""
        if self.constant:
            return rows.withColumn("judged", F.lit(self.constant))
        out = self.trees.transform(self.assembler.transform(self._rated(lexical(rows))))
        return out.withColumn("judged", F.when(F.col("_blocked") == 1, "block").otherwise("allow")).select(*rows.columns, "judged")


def filtered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, **fit) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every row."""
    host, path = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_said", verdict)
    labelled = rows.filter("_said is not null").select("url", "host", "path", (F.col("_said") == "block").cast("double").alias("blocked"))
    out = UrlModel(labelled, **fit).verdicts(rows)
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("_said", "judged").alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")
