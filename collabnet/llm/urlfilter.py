"""URL verdicts from rules, and from boosted trees where no rule fits.

The URLs that a rule judges are the labelled ones. The trees see how a URL is written
(lengths, depth, digits, entropy, parameters) and how often the labelled URLs under
its host's endings were blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collabnet.llm import boosting

ALLOW, BLOCK = "allow", "block"
BLOCKED_FROM = 0.5
SMOOTHING = 10.0
ENDINGS = (1, 2, 3)  # labels of a host's ending

_REST = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # (allow or block, host/path)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _REST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _REST, 2), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _order(rule: Rule) -> tuple:
    """The longest rule first; then that with the longer host, by text, and block before allow."""
    action, text = rule
    return -len(text), -len(_split(text)[0]), text, action != BLOCK


def match_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does."""
    fitting = []
    for action, text in sorted(rules, key=_order):
        rule_host, rule_path = _split(text)
        at_host = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fitting.append((at_host & F.startswith(path, F.lit(rule_path)), text, action))
    none = F.lit(None).cast("string")
    return (
        F.coalesce(*[F.when(fits, text) for fits, text, _ in fitting], none),
        F.coalesce(*[F.when(fits, action) for fits, _, action in fitting], none),
    )


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty one."""
    length = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (length - F.length(F.replace(text, c))).cast("double"))
    bits = F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda sum, n: sum + n * F.log2(n))
    return F.when(length > 0, F.log2(length) - bits / length).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    length = F.length(url).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return {
        "f_length": length,
        "f_host": F.length(host).cast("double"),
        "f_path": F.length(path).cast("double"),
        "f_depth": _count(path, "/"),
        "f_labels": _count(host, r"\."),
        "f_digits": _count(url, "[0-9]") / F.greatest(length, F.lit(1.0)),
        "f_host_digits": _count(host, "[0-9]"),
        "f_hyphens": _count(host, "-"),
        "f_entropy": entropy(url),
        "f_host_entropy": entropy(host),
        "f_parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "f_query": F.length(query).cast("double"),
        "f_fragment": F.contains(url, F.lit("#")).cast("double"),
        "f_extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).cast("double"),
        "f_secure": F.startswith(url, F.lit("https")).cast("double"),
    }


def _with_endings(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """``rows`` with the share of blocked labelled URLs, and their number, under each ending of the host."""
    overall = F.lit(labelled.agg(F.avg("blocked")).first()[0])
    for n in ENDINGS:
        ending = f"e{n}"
        known = labelled.groupBy(ending).agg(F.sum("blocked").alias("b"), F.count(F.lit(1)).cast("double").alias("n"))
        share = (F.col("b") + SMOOTHING * overall) / (F.col("n") + SMOOTHING)
        stats = known.select(ending, share.alias(f"f_share{n}"), F.log1p("n").alias(f"f_known{n}"))
        rows = rows.join(stats, ending, "left").fillna({f"f_known{n}": 0.0}).withColumn(f"f_share{n}", F.coalesce(f"f_share{n}", overall))
    return rows


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Every row of ``pages`` as ``row`` with host, path, rule and verdict.

    A URL that is null or has no ``://`` has an empty host and path; no rule fits it.
    Without labelled URLs of both verdicts there is nothing to learn, and what no rule
    fits is allowed. Equal rows are judged alike, other columns pass inside ``row``,
    an empty table gives no rows.
    """
    text, text_of = F.coalesce(url, F.lit("")), F.coalesce(f"row.{url}", F.lit(""))
    rows = pages.select(F.struct(*pages.columns).alias("row"), text.alias("text"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, action = match_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    labels = F.split("host", r"\.")
    endings = {f"e{n}": F.array_join(F.slice(F.reverse(labels), 1, n), ".") for n in ENDINGS}
    rows = rows.withColumns(endings)
    labelled = rows.where(F.col("action").isNotNull()).withColumn("blocked", (F.col("action") == BLOCK).cast("double"))
    made = {"text": text_of, "host": host_of(F.col(f"row.{url}")), "path": path_of(F.col(f"row.{url}"))}
    columns = lexical(F.col("text"), F.col("host"), F.col("path"))
    names = [*columns, *[f"f_{k}{n}" for n in ENDINGS for k in ("share", "known")]]
    learned = boosting.sample(labelled.withColumn("order", F.xxhash64("text")), "order").withColumns(columns)
    model = None if labelled.isEmpty() else boosting.train(_with_endings(learned, labelled), names, "blocked")
    open_rows = rows.where(F.col("action").isNull())
    if model is None:
        judged = open_rows.withColumn("verdict", F.lit(ALLOW))
    else:
        # only the row and its keys travel to the statistics; the rest is made from the URL behind the joins
        ended = _with_endings(open_rows.select("row", *endings), labelled).withColumns(made).withColumns(columns)
        scored = boosting.score(ended.withColumn("rule", F.lit(None).cast("string")), names, model)
        judged = scored.withColumn("verdict", F.when(F.col("score") >= BLOCKED_FROM, BLOCK).otherwise(ALLOW))
    wanted = ["row", "host", "path", "rule", "verdict"]
    return rows.where(F.col("action").isNotNull()).withColumn("verdict", F.col("action")).select(wanted).unionByName(judged.select(wanted))
