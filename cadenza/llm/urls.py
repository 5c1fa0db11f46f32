"""URL filters: path rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame expressions and the JVM's own trees; no row passes through Python. A rule ``host/path`` fits its
host and all subdomains if the URL's path starts with the rule's; the longest that fits wins. URLs that no rule decides
are scored by trees that are trained on labelled URLs. The features are lengths, depth, digit ratio, character entropy,
parameter counts, and how often each suffix (top-level domain, file ending) is blocked among the labelled URLs.

Where the rules are the only source of labels, the URLs that none of them decides count as weak examples of "allow"
(UNDECIDED of a labelled URL each): no rule speaks against them. Without them, the trees would know a suffix only from the
rules that block it, and would block all of it.

Nulls: a null URL, or one without ``://``, has an empty host and path; no rule fits it, and the trees judge its lengths.
A null page_id is kept. Repeated rows are judged alike, and a URL that repeats is learned from once. Very long URLs are
judged whole. Equal scores get equal verdicts; of rules that fit, the longest is unique. Columns that aren't named are
ignored. If the labelled URLs are fewer than two classes, the verdict without a rule is "allow". An empty table gives no
rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm._work import written

ALLOW, BLOCK = "allow", "block"
#: Distinct URLs that the trees are trained on: a hash sample of about this size at most.
TRAIN_ROWS = 8000
UNDECIDED = 0.5
TREES, DEPTH = 8, 4
BLOCK_FROM = 0.5
#: A suffix's rate is drawn towards the overall rate as if by this many URLs.
PRIOR_URLS = 20.0
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "parameter_length", "hyphens", "tld_rate", "ending_rate", "tld_seen", "ending_seen")


def parsed(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the path. The host ends before the first of /, ? and #."""
    part = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2), part(3)


def ruled(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(rules[rule])).otherwise(verdict)
    return which, verdict


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with the columns host, path and the lexical features."""
    text = F.coalesce(F.col(url), F.lit(""))
    host, path, rest = parsed(F.col(url))
    out = urls.withColumns({"host": host, "path": path, "rest": rest, "_text": text})
    chars = F.filter(F.split("_text", ""), lambda c: c != "")
    length = F.greatest(F.length("_text"), F.lit(1))

    def term(c: Column) -> Column:
        share = (F.length("_text") - F.length(F.replace(F.col("_text"), c, F.lit("")))) / length
        return -share * F.log2(share)

    return out.withColumns(
        {
            "url_length": F.length("_text").cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": F.length(F.regexp_replace("_text", "[^0-9]", "")) / length,
            "entropy": F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + term(c)),
            "parameters": F.regexp_count("rest", F.lit(r"[?&][^=&#]+=")).cast("double"),
            "parameter_length": F.length("rest").cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "tld": F.substring_index("host", ".", -1),
            "ending": F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1),
        }
    ).drop("_text", "rest")


@dataclass
class Filter:
    trees: GBTClassificationModel | None
    suffixes: dict[str, DataFrame]
    overall: float


def with_suffixes(features: DataFrame, suffixes: dict[str, DataFrame], overall: float) -> DataFrame:
    for kind, rates in suffixes.items():
        features = features.join(F.broadcast(rates), kind, "left")  # a suffix of the bounded training sample a row
        features = features.fillna({f"{kind}_rate": overall, f"{kind}_seen": 0.0})
    return features


def assembled(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)


def fit(labelled: DataFrame, *, url: str = "url", rows: int = TRAIN_ROWS) -> Filter:
    """Trees from (url, label) rows, with a column ``weight`` if there is one; label 1 means block."""
    weight = F.col("weight").cast("double") if "weight" in labelled.columns else F.lit(1.0)
    known = labelled.where(F.col("label").isNotNull()).select(url, F.col("label").cast("double").alias("label"), weight.alias("weight"))
    n, ones = known.agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0)).first()
    if not 0 < ones < n:
        return Filter(None, {}, 0.0)
    below = int(min(1.0, rows / n) * (1 << 20))
    drawn = known.where(F.pmod(F.xxhash64(url), F.lit(1 << 20)) < below).distinct()  # copies of a hot URL go before the shuffle
    chosen = written(lexical(drawn, url), "url-sample")
    chosen = chosen.coalesce(4)  # a bounded sample; many short rounds follow
    count, ones, weights, share = chosen.agg(F.count(F.lit(1)), F.count_if(F.col("label") > 0), F.sum("weight"), F.sum(F.col("label") * F.col("weight"))).first()
    if not count or not 0 < ones < count:
        return Filter(None, {}, 0.0)
    overall = share / weights
    suffixes = {}
    for kind in ("tld", "ending"):
        rate = (F.sum(F.col("label") * F.col("weight")) + PRIOR_URLS * overall) / (F.sum("weight") + PRIOR_URLS)
        suffixes[kind] = written(chosen.groupBy(kind).agg(rate.alias(f"{kind}_rate"), F.log1p(F.sum("weight")).alias(f"{kind}_seen")), f"suffix-{kind}")
    ready = assembled(with_suffixes(chosen, suffixes, overall)).select("features", "label", "weight")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=1, minInstancesPerNode=5, weightCol="weight").fit(ready)
    return Filter(trees, suffixes, overall)


def judge(pages: DataFrame, rules: dict[str, str], found: Filter, *, block_from: float = BLOCK_FROM) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of each row; no shuffle."""
    features = lexical(pages.select("page_id", "url"))
    if found.trees is None:
        scored = features.withColumn("score", F.lit(0.0))
    else:
        ready = assembled(with_suffixes(features, found.suffixes, found.overall))
        scored = found.trees.transform(ready).withColumn("score", vector_to_array("probability")[1])
    which, decided = ruled(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(decided, F.when(F.col("score") >= block_from, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", which.alias("rule"), verdict.alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, rules: dict[str, str], *, undecided: float = UNDECIDED) -> DataFrame:
    """(url, label, weight): label 1 where a rule blocks, 0 where one allows, and 0 with less weight where none decides."""
    host, path, _ = parsed(F.col("url"))
    decided = ruled(host, path, rules)[1]
    label = F.coalesce((decided == BLOCK).cast("double"), F.lit(0.0))
    known = pages.select("url", label.alias("label"), F.when(decided.isNull(), undecided).otherwise(1.0).alias("weight"))
    return known.where(F.col("weight") > 0)
