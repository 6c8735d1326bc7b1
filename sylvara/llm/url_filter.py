"""URL verdicts: host and path rules first, then gradient-boosted trees on lexical features.

Everything on the path of a row is DataFrame functions: the parts of the URL, the longest rule that
fits, the features, and the trained trees, which are written out as one nested CASE expression each.

The trees learn from URLs that a rule has labelled.  These are dealt into folds by a hash of the URL.  The
suffix statistics of a training row come from the other training folds, so that no row sees its own label;
both labels weigh the same in all.  The last fold trains nothing: the margin beyond which a URL is blocked is
the one that a share of FALSE_BLOCK of its allowed URLs exceeds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a host suffix and a path prefix.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
TRAINING_ROWS = 200_000  # about so many labelled URLs at most are trained on
TREES, DEPTH, STEP = 12, 4, 0.3
FOLDS, PRIOR_ROWS = 5, 20.0  # the last fold calibrates; a suffix's statistic starts from so many rows, half of them blocked
FALSE_BLOCK = 0.05
BROADCAST_BYTES = 8 << 20  # the suffix table is broadcast up to this size, and joined by a shuffle beyond it
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ? or #.  Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; among equally long ones the first by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def features(url: Column, host: Column, path: Column, blocked: Column) -> dict[str, Column]:
    """Lexical features as doubles; blocked is the statistic of the URL's suffix.

    How often a suffix stands is no feature: a suffix without labels would then be told apart by that alone."""
    url = F.coalesce(url, F.lit(""))
    length = F.length(url)
    letters = F.split(url, "")
    # sum over distinct characters of -p * log(p), p = their share
    share = F.transform(F.array_distinct(letters), lambda c: (length - F.length(F.replace(url, c, F.lit("")))) / F.greatest(length, F.lit(1)))
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    found = {
        "length": length,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(length, F.lit(1)),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": F.instr(url, "#").cast("boolean").cast("int"),
        "hyphens": length - F.length(F.replace(url, F.lit("-"), F.lit(""))),
        "secure": F.startswith(url, F.lit("https:")).cast("int"),
        "suffix_blocked": blocked,
        "suffix_length": F.length(suffix(host)),
    }
    return {k: v.cast("double") for k, v in found.items()}


def _tree(node, names: list[str]) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    test = F.col(names[split.featureIndex()]) <= F.lit(float(split.threshold()))
    return F.when(test, _tree(node.leftChild(), names)).otherwise(_tree(node.rightChild(), names))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """(s, l, b) of every suffix: by fold its labelled and blocked rows."""
    fold = [F.col("fold") == k for k in range(FOLDS)]
    known = F.col("r").isNotNull()
    return rows.groupBy("s").agg(F.array(*[F.count_if(known & f) for f in fold]).alias("l"), F.array(*[F.count_if(f & (F.col("r.verdict") == "block")) for f in fold]).alias("b"))


def _with_suffixes(rows: DataFrame) -> DataFrame:
    """rows with blocked, the smoothed share of their suffix: out of fold for those that train, from all training folds for others."""
    stats = suffix_statistics(rows)
    size = stats.agg(F.sum(F.octet_length("s") + 16 * FOLDS + 24)).first()[0] or 0
    both = rows.join(F.broadcast(stats) if size <= BROADCAST_BYTES else stats, "s", "left")

    def total(counts: str) -> Column:
        """Of all training folds but the row's own, where it trains."""
        whole = F.aggregate(F.slice(counts, 1, FOLDS - 1), F.lit(0).cast("long"), lambda a, x: a + x)
        return whole - F.when(F.col("r").isNotNull() & (F.col("fold") < FOLDS - 1), F.get(counts, F.col("fold"))).otherwise(0)

    return both.withColumn("blocked", (total("b") + PRIOR_ROWS / 2) / (total("l") + PRIOR_ROWS)).drop("l", "b")


def train(labelled: DataFrame, names: list[str]) -> tuple[Column, DataFrame]:
    """Margin of the boosted trees, positive for block, as an expression on the feature columns; and the rows
    that did not train.

    labelled: the features, fold, pick and a column block of 0.0 and 1.0.  With one label or none in the training
    folds the margin is constant."""
    inner, outer = labelled.where(F.col("fold") < FOLDS - 1), labelled.where(F.col("fold") == FOLDS - 1)
    counts = {r[0]: r[1] for r in inner.groupBy("block").count().collect()}
    if len(counts) < 2:
        return F.lit(1.0 if counts.get(1.0) else -1.0), outer
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = sum(counts.values())
    weight = F.when(F.col("block") > 0, rows / (2.0 * counts[1.0])).otherwise(rows / (2.0 * counts[0.0]))
    some = inner.where(F.col("pick") < min(1.0, TRAINING_ROWS / rows)).withColumn("w", weight)
    table = VectorAssembler(inputCols=names, outputCol="v", handleInvalid="keep").transform(some).select("v", "w", F.col("block").alias("y"))
    model = GBTClassifier(featuresCol="v", labelCol="y", weightCol="w", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=5, seed=7, checkpointInterval=-1).fit(table)
    margin = F.lit(0.0)
    for share, tree in zip(model.treeWeights, model._java_obj.trees(), strict=True):
        margin = margin + F.lit(float(share)) * _tree(tree.rootNode(), names)
    return margin, outer


def _scored(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]]) -> tuple[DataFrame, float]:
    """The rows with features, rule and margin, and the margin beyond which a URL is blocked."""
    host, path = host_and_path(F.col("u"))
    rows = pages.select(F.col(id_col).alias("i"), F.col(url_col).cast("string").alias("u")).withColumns({"h": host, "p": path})
    rows = rows.withColumn("r", rule_of(F.col("h"), F.col("p"), rules)).withColumn("s", suffix(F.col("h")))
    where = F.pmod(F.xxhash64("u"), F.lit(FOLDS << 20))
    rows = rows.withColumn("fold", (where % FOLDS).cast("int")).withColumn("pick", F.floor(where / FOLDS) / float(1 << 20))
    rows = _with_suffixes(rows)
    made = features(F.col("u"), F.col("h"), F.col("p"), F.col("blocked"))
    rows, names = rows.withColumns(made), list(made)
    labelled = rows.where("r IS NOT NULL").select(*names, "fold", "pick", (F.col("r.verdict") == "block").cast("double").alias("block"))
    margin, outer = train(labelled, names)
    limit = outer.where("block = 0").agg(F.percentile_approx(margin, 1 - FALSE_BLOCK, 10_000)).first()[0]
    return rows.withColumn("margin", margin), max(0.0, limit or 0.0)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, margin) of every row.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
    Without a rule the verdict is block where the trees' margin is beyond the calibrated limit.  A null URL or
    one without :// has empty host and path and is judged by the trees; with no labelled URL at all the verdict
    is allow.  Rows may repeat; an empty table gives no rows; other columns are ignored.  The bound of the rows
    that train is TRAINING_ROWS; statistics, calibration and verdicts regard all rows.
    """
    out, limit = _scored(pages, id_col, url_col, rules)
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("margin") > limit, "block").otherwise("allow"))
    return out.select(F.col("i").alias(id_col), F.col("h").alias("host"), F.col("p").alias("path"), F.col("r.rule").alias("rule"), verdict.alias("verdict"), "margin")


def held_out_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row: the area under the curve over the fold that trained nothing, its shares of blocked and of allowed URLs
    that would be blocked, and the share of URLs without a rule that are."""
    rows, limit = _scored(pages, id_col, url_col, rules)
    block, over, outer = F.col("r.verdict") == "block", F.col("margin") > limit, F.col("r").isNotNull() & (F.col("fold") == FOLDS - 1)
    # by margin: how many of each label, which is a row per leaf combination, and pairs in the right order from their sums
    each = rows.where(outer).groupBy("margin").agg(F.count_if(block).alias("x"), F.count_if(~block).alias("y"))
    ranked = each.groupBy().agg(F.array_sort(F.collect_list(F.struct("margin", "x", "y"))).alias("all"))
    step = F.aggregate("all", F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("under")), lambda a, e: F.struct((a["area"] + e["x"] * (a["under"] + e["y"] / 2.0)).alias("area"), (a["under"] + e["y"]).alias("under")))
    area = ranked.select(step["area"].alias("area"))
    share = rows.agg(F.count_if(outer & block).alias("blocked"), F.count_if(outer & ~block).alias("allowed"), (F.count_if(outer & block & over) / F.count_if(outer & block)).alias("caught"), (F.count_if(outer & ~block & over) / F.count_if(outer & ~block)).alias("false_block"), (F.count_if(F.col("r").isNull() & over) / F.count_if(F.col("r").isNull())).alias("unruled_blocked"))
    return share.join(area).select((F.col("area") / (F.col("blocked") * F.col("allowed"))).alias("auc"), "caught", "false_block", "unruled_blocked")
