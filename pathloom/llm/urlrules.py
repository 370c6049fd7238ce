"""URL filters (3): pattern rules found by their rarest literal token.

Every rule is a regular expression with a list of literal tokens that any URL it fits must hold. Tokens are counted over
all URLs, each rule is filed under its rarest one, and a URL runs only the rules that its own tokens fetch.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return r"^(?:[^/]*\.)?" + re.escape(self.name)

    @property
    def tokens(self) -> list[str]:
        return whole_tokens("." + self.name)


@dataclass(frozen=True)
class WildcardRule:
    """Fits a URL, in lower case and without its scheme, that holds the pattern; ``*`` stands for any characters."""

    action: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    @property
    def regex(self) -> str:
        return "(?s)" + ".*".join(re.escape(x) for x in self.pattern.split("*"))

    @property
    def tokens(self) -> list[str]:
        return [t for part in self.pattern.split("*") for t in whole_tokens(part)]


def whole_tokens(literal: str) -> list[str]:
    """Runs of letters and digits with another character on both sides: only those are tokens of a URL that holds them."""
    return [m[1].translate(str.maketrans(UPPER, LOWER)) for m in re.finditer(r"(?<=[^A-Za-z0-9])([A-Za-z0-9]+)(?=[^A-Za-z0-9])", literal)]


#: The rules of the query. Fixed values.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: Wildcards for URLs that no host rule fits. An allowing one outdoes blocking ones.
WILDCARD_RULES = (
    WildcardRule("block", "-bets."),
    WildcardRule("block", "adult-x."),
    WildcardRule("block", "/ads/"),
    WildcardRule("block", "?*utm_source=feed"),
    WildcardRule("block", "/login.*?"),
    WildcardRule("allow", "/about/"),
    WildcardRule("allow", "blog.*.example.net/en/"),
)


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host in ASCII lower case, path, and all that follows the host; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_table(spark, rules: Sequence[HostRule | WildcardRule]) -> DataFrame:
    rows = [(i, isinstance(r, HostRule), r.action, r.name, r.regex, sorted(set(r.tokens))) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, on_host boolean, action string, name string, regex string, tokens array<string>")


def judge(
    pages: DataFrame,
    host_rules: Sequence[HostRule] = HOST_RULES,
    wildcard_rules: Sequence[WildcardRule] = WILDCARD_RULES,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for every row.

    The longest host rule decides (``rule``), else the wildcard rules (``pattern``: the longest of the deciding action),
    else ``default``. Null URLs and URLs without ``://`` have an empty host and path and fit host rules never, wildcard rules neither.
    Repeated rows are judged each, null ids stay, other columns play no part; an empty table gives no rows.
    The rules are a table, joined by token: rows grow with the tokens that fetch a rule, not with the rules.
    """
    spark = pages.sparkSession
    host, path, tail = host_and_path(F.coalesce(F.col(url), F.lit("")))
    rows = cut(
        pages.select(F.col(page_id), host.alias("host"), path.alias("path"), tail.alias("__tail")).withColumn(
            "__row", F.monotonically_increasing_id()
        )
    )
    lower = F.translate(F.concat("host", "__tail"), UPPER, LOWER)
    tokens = F.array_distinct(F.split(lower, "[^a-z0-9]+"))
    wanted = rule_table(spark, [*host_rules, *wildcard_rules])

    filed = wanted.select("rule_id", F.explode("tokens").alias("token"))
    # counted where they are read, so that a token of every URL is one row per task before it meets the rules
    counts = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(counts, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")
    )
    # one row per rule; rules without a whole token keep a null and are tried everywhere, as an expression
    index = cut(wanted.drop("tokens").join(rarest, "rule_id", "left"))
    subject = F.when(F.col("on_host"), F.concat("host", "path")).otherwise(lower)
    fetched = rows.withColumn("token", F.explode_outer(tokens)).join(index.where(F.col("token").isNotNull()), "token", "left")
    hit = F.coalesce(F.expr("rlike(__subject, regex)"), F.lit(False))
    on_host = F.when(F.col("__hit") & F.col("on_host"), F.struct(F.length("name").alias("n"), "name", "action"))
    on_url = F.when(F.col("__hit") & ~F.col("on_host"), F.struct((F.col("action") == "allow").alias("allow"), F.length("name").alias("n"), "name", "action"))
    best = (
        fetched.withColumn("__subject", subject).withColumn("__hit", hit)
        .groupBy("__row")
        .agg(
            *(F.first(c).alias(c) for c in (page_id, "host", "path", "__tail")),
            F.max(on_host).alias("__h"),
            F.max(on_url).alias("__u"),
        )
    )
    everywhere = [r for r in wildcard_rules if not r.tokens]
    if everywhere:
        tried = [
            F.when(lower.rlike(r.regex), F.struct(
                F.lit(r.action == "allow").alias("allow"), F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action")
            ))
            for r in everywhere
        ]
        best = best.withColumn("__u", F.greatest("__u", F.lit(None).cast("struct<allow:boolean,n:int,name:string,action:string>"), *tried))
    return best.select(
        page_id, "host", "path",
        F.col("__h.name").alias("rule"),
        F.coalesce("__h.action", "__u.action", F.lit(default)).alias("verdict"),
        F.when(F.col("__h").isNull(), F.col("__u.name")).alias("pattern"),
    )
