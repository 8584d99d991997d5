"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxspark.llm.shared import written

#: (host, path, verdict). A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 12, 4, 7
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "suffix_log_n", "suffix_block_rate", "start_log_n", "start_block_rate")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for null, or where there is no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of one URL's characters."""
    n = F.length(url)
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(url, "")), lambda c: c != "")
    return {
        "url_chars": n.cast("double"),
        "host_chars": F.length(host).cast("double"),
        "path_chars": F.length(path).cast("double"),
        "depth": count(path, "/"),
        "labels": F.when(host == "", 0.0).otherwise(count(host, ".") + 1),
        "digit_ratio": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0),
        "parameters": count(url, "="),
        "hyphens": count(url, "-"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
    }


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS, held_out: Column | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, block_score for every row of (page_id, url).

    The verdict is the longest fitting rule's. URLs that a rule fits are the labelled ones: at most ``train_rows`` of them, first
    by a hash, train the trees, which judge the rest. Suffix statistics (how often a host's last two labels,
    alone and with the first part of the path, occur, and are blocked by rules) come from all rows, a table of one row a suffix that grows with the web. With one verdict among the labelled URLs the rest
    get that verdict, with none they are allowed. ``held_out`` rows have no label (to measure the trees on). Null URLs count as empty. Repeated rows stay. An empty table gives no rows.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    suffix, start = F.substring_index("host", ".", -2), F.substring_index("path", "/", 2)
    rows = rows.withColumn("found", rule_column(F.col("host"), F.col("path"), rules)).withColumns({"suffix": suffix, "start": F.concat(suffix, F.lit("/"), start)})
    known = F.col("found").isNotNull() & ~(F.lit(False) if held_out is None else held_out)
    label = F.when(known, (F.col("found.verdict") == "block").cast("double"))
    wide = rows
    for key in ("suffix", "start"):
        stats = rows.groupBy(key).agg(F.count("*").alias("n"), F.count(label).alias("known"), F.coalesce(F.sum(label), F.lit(0.0)).alias("blocked"))
        stats = stats.select(key, F.log1p("n").alias(f"{key}_log_n"), ((F.col("blocked") + 1) / (F.col("known") + 2)).alias(f"{key}_block_rate"))
        wide = wide.join(stats, key)  # one row a key on the right: Spark broadcasts it while small, and splits a hot key's rows beyond
    wide = wide.withColumn("label", label).withColumns(lexical(url, F.col("host"), F.col("path")))
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wide)
    sample = ready.filter("label is not null").select("features", "label", F.xxhash64("url", "page_id").alias("h")).orderBy("h").limit(train_rows)
    sample = written(sample.select("features", "label"), "url-labels")
    kinds = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(kinds) == 2:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(sample)
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(ready).withColumn("block_score", vector_to_array("probability")[1])
    else:
        scored = ready.withColumn("block_score", F.lit(float(kinds[0]) if kinds else 0.0))
    said = F.coalesce(F.col("found.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), said.alias("verdict"), "block_score")
