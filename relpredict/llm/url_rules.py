"""URL filters: patterns indexed by their rarest literal token; only fetched candidates run a regex."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relpredict.llm.common import stored

#: A rule table above this many rules is joined by a shuffle, not broadcast.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host + path. Each of ``tokens`` must stand in whatever it matches.

    ``text`` names a host-and-path rule; among those that match, the longest text wins. A pattern
    rule has no text and decides only where no host-and-path rule does; there, one block blocks.
    """

    verdict: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    text: str | None = None


def host_rule(verdict: str, text: str) -> UrlRule:
    """``example.com/en/``: the host, all its subdomains, and paths that start with ``/en/``."""
    host, slash, path = text.partition("/")
    whole = re.findall("[a-z0-9]+", host) + [t for t in re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return UrlRule(verdict, rf"^([^/]*\.)?{_literal(host + slash + path)}", tuple(whole), text)


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """A word of its own anywhere in host or path."""
    return UrlRule(verdict, f"(^|[^A-Za-z0-9]){_literal(word)}([^A-Za-z0-9]|$)", (word,))


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


#: The production table: host rules, then words that mark adverts, gambling, adult pages and downloads.
HOST_RULES = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)
WORDS = ("adserver", "banner", "casino", "doubleclick", "escort", "gambling", "phishing", "poker", "porn", "torrent", "viagra", "warez", "xxx")
RULES = HOST_RULES + tuple(word_rule(w) for w in WORDS)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame, *kept: str) -> DataFrame:
    """The ``kept`` columns, ``host`` (A-Z lower-cased) and ``path`` of ``url``; both empty without ``://``."""
    rest = "CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END"
    return pages.selectExpr(
        *kept,
        f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host",
        f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path",
    )


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    Tokens are runs of ASCII letters and digits. The rarest token of a rule, by the number of
    distinct host-and-path pairs that hold it, is its key in the index; ties go to the smaller token.
    A rule without tokens is a candidate for every URL. URLs that no rule meets are allowed, a null
    one among them (host and path are empty). Repeated rows and ids are judged row by row; no other
    column is read. All of it is joins and grouping: distinct host-and-path pairs are judged once,
    then joined back, and adaptive execution splits a crowded pair.
    """
    spark = pages.sparkSession
    parts = split_url(pages, "page_id")
    subjects = parts.select("host", "path").distinct()
    tokens = "regexp_extract_all(concat(host, path), '[A-Za-z0-9]+', 0)"
    held = subjects.selectExpr("host", "path", f"explode(array_distinct(concat({tokens}, array('')))) AS token")

    table = spark.createDataFrame(
        [(i, r.verdict, r.pattern, r.text, list(r.tokens) or [""]) for i, r in enumerate(rules)],
        "rule_id int, verdict string, pattern string, rule string, tokens array<string>",
    )
    near = F.broadcast if len(rules) <= BROADCAST_RULES else lambda frame: frame
    literals = table.select("rule_id", F.explode("tokens").alias("token"))
    seen = held.join(near(literals.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("rule_id").orderBy(F.coalesce("n", F.lit(0)), "token")
    rarest = literals.join(seen, "token", "left").withColumn("place", F.row_number().over(order)).where("place = 1")
    index = rarest.select("rule_id", "token").join(table.drop("tokens"), "rule_id")

    matched = held.join(near(index), "token").where("concat(host, path) RLIKE pattern")
    verdicts = matched.groupBy("host", "path").agg(
        F.expr("max(CASE WHEN rule IS NOT NULL THEN struct(length(rule) AS n, rule AS rule, verdict AS verdict) END) AS best"),
        F.expr("max(rule IS NULL AND verdict = 'block') AS blocked"),
    )
    return parts.join(stored(verdicts, "verdicts"), ["host", "path"], "left").selectExpr(
        "page_id",
        "host",
        "path",
        "best.rule AS rule",
        "CASE WHEN best IS NOT NULL THEN best.verdict WHEN blocked THEN 'block' ELSE 'allow' END AS verdict",
    )
