"""URL filters: pattern rules in an index by their rarest literal token.

A rule's pattern is a glob over the lower-cased url: `*` stands for any characters, `^` for a separator or the end, a leading
`||` for the start of a host or of a subdomain's parent, leading and trailing `|` for the url's ends. A literal token is a run
of letters and digits that the pattern fixes whole. Each rule stands under that of its tokens which the fewest rules have;
a url's own tokens fetch the rules to try, and only those run as regular expressions. Rules without a token are tried on
every url. Everything is DataFrame functions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A joined index of up to so many rules is broadcast.
BROADCAST_RULES = 500_000
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains if the url's path starts with `path`; of those that fit the longest decides."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    pattern: str
    verdict: str = "block"

    @property
    def regex(self) -> str:
        body, head, tail = self.pattern.lower(), "", ""
        if body.startswith("||"):
            body, head = body[2:], r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?"
        elif body.startswith("|"):
            body, head = body[1:], "^"
        if body.endswith("|"):
            body, tail = body[:-1], "$"
        parts = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
        return "(?s)" + head + "".join(parts.get(c) or (c if re.fullmatch(r"[a-z0-9/:=&,;!~@ _-]", c) or ord(c) > 127 else f"[{c}]" if c not in "\\^[]" else "\\" + c) for c in body) + tail

    @property
    def tokens(self) -> list[str]:
        """Runs that a match holds between characters that are no part of a token."""
        text = self.pattern.lower()
        text = ("/" + text[2:] if text.startswith("||") else "/" + text[1:] if text.startswith("|") else "*" + text)
        text = text[:-1] + "/" if text.endswith("|") else text + "*"
        return re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", text)


HOST_RULES = (HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow"))
PATTERN_RULES = (
    PatternRule("?utm_source="), PatternRule("&utm_source="), PatternRule("||blog.*/es/"), PatternRule("/ads/"), PatternRule("/banner/*.gif"),
    PatternRule("&ref=x|"), PatternRule("||tracker.example.org^"), PatternRule("*.exe|"), PatternRule("||m.*^page=2^"),
    PatternRule("||example.org/en/", "allow"), PatternRule("|https://*/fr/*.html", "allow"),
)


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, _UPPER, _LOW)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or the end) and path (then up to ? or #); both empty without a ://."""
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = lower(F.regexp_extract(after, "^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def index(rules: Sequence[PatternRule], counts: Mapping[str, int] | None = None) -> dict[str, list[int]]:
    """The numbers of the rules under each one's rarest token, "" for rules without one.

    counts: how common a token is, as among urls; by default in how many rules it stands. Ties go to the longer token.
    """
    common = Counter(counts) if counts is not None else Counter(t for r in rules for t in set(r.tokens))
    found: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        found.setdefault(min(r.tokens, key=lambda t: (common[t], -len(t), t), default=""), []).append(k)
    return found


def _host_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """struct<rule, verdict> of the longest host rule that fits, else null."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


def _url_tokens(url: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.coalesce(F.regexp_extract_all(url, F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))))


def _inline_hits(url: Column, rules: Sequence[PatternRule], counts: Mapping[str, int] | None) -> Column:
    """array of the verdicts of the rules that match, by an index that is one constant: a line for each bucket of a hash table.

    A line holds its rules as token, regex, verdict; Spark splits the constant into lines once, when it plans.
    """
    import xxhash

    rule_end, field_end, line_end = "\x01", "\x02", "\x03"  # no url token and no regex above holds these
    by_token = index(rules, counts)
    size = 2 * len(by_token) + 1
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    lines = [""] * size
    for token, numbers in by_token.items():
        at = signed(xxhash.xxh64_intdigest(token.encode(), 42)) % size
        lines[at] += "".join(field_end.join((token, rules[k].regex, rules[k].verdict)) + rule_end for k in numbers)
    table = F.split(F.lit(line_end.join(lines)), line_end)
    line = lambda t: F.element_at(table, (F.pmod(F.xxhash64(t), F.lit(size)) + 1).cast("int"))
    parts = lambda t: F.transform(F.split(line(t), rule_end), lambda r: F.split(r, field_end))
    rules_of = lambda t: F.filter(parts(t), lambda r: (F.size(r) == 3) & (r[0] == t))
    some = F.filter(_url_tokens(url), lambda t: line(t) != "")
    found = F.filter(F.flatten(F.transform(some, rules_of)), lambda r: F.regexp_like(url, r[1]))
    return F.transform(found, lambda r: r[2])


def _joined_hits(df: DataFrame, url_col: str, rules: Sequence[PatternRule], counts: Mapping[str, int] | None) -> DataFrame:
    """(url, hits) for the distinct urls that any rule with a token matches; such rules are a table, joined by token."""
    table = df.sparkSession.createDataFrame([(t, rules[k].regex, rules[k].verdict) for t, ks in index(rules, counts).items() if t for k in ks], "token string, regex string, verdict string")
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    urls = df.select(F.col(f"`{url_col}`").alias("url")).distinct().withColumn("low", lower(F.col("url")))
    tried = urls.withColumn("token", F.explode(_url_tokens(F.col("low")))).join(table, "token")
    return tried.where(F.regexp_like("low", F.col("regex"))).groupBy("url").agg(F.collect_set("verdict").alias("hits"))


def judge(
    df: DataFrame, url_col: str = "url", host_rules: Sequence[HostRule] = HOST_RULES, rules: Sequence[PatternRule] = PATTERN_RULES,
    counts: Mapping[str, int] | None = None, into: str = "judged", inline: bool = True,
) -> DataFrame:
    """df and a column `into`: struct<host, path, rule, verdict>. A column of that name is replaced.

    The longest host rule that fits decides and is named in rule. Else rule is null and patterns decide: allow if any
    matching rule allows or none matches, block otherwise. A null or empty url has an empty host and path, fits no rule
    and is allowed. Rows are judged one by one, so repeated rows stay repeated.
    Urls are judged whole, however long. inline: whether the index is a constant in the plan, which then has no join, for any
    number of rules that a plan may carry; else it is a table, joined by token, and only rules without a token are in the plan.
    """
    url = F.col(f"`{url_col}`")
    host, path = parts(url)
    own = _host_rule(host, path, host_rules)
    verdict = lambda hits: F.when(F.coalesce(F.array_contains(hits, "block"), F.lit(False)) & ~F.array_contains(hits, "allow"), "block").otherwise("allow")
    judged = lambda hits: F.struct(host.alias("host"), path.alias("path"), own["rule"].alias("rule"), F.coalesce(own["verdict"], verdict(hits)).alias("verdict"))
    if inline:
        return df.withColumn(into, judged(_inline_hits(lower(url), rules, counts)))
    taken = {c.lower() for c in df.columns}
    other, hits = (next(n for k in range(len(taken) + 1) if (n := f"{name}{k}") not in taken) for name in ("url_", "hits_"))
    found = _joined_hits(df, url_col, rules, counts).withColumnsRenamed({"url": other, "hits": hits})
    bare = [r for r in rules if not r.tokens]
    every = F.concat(F.coalesce(F.col(hits), F.array().cast("array<string>")), F.coalesce(_inline_hits(lower(url), bare, None), F.array().cast("array<string>")))
    return df.join(found, url.eqNullSafe(F.col(other)), "left").withColumn(into, judged(every)).drop(other, hits)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages.select("page_id", "url")).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    low = f"'{_UPPER}', '{_LOW}'"
    fits = lambda r: f"(host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)})"
    own = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN {_quoted(getattr(r, what))}" for r in sorted(HOST_RULES, key=lambda r: -len(r.name))) + " END"
    any_of = lambda verdict: " OR ".join(f"regexp_matches(low, {_quoted(r.regex)})" for r in PATTERN_RULES if r.verdict == verdict)
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(translate(url, {low}), '') AS low,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id, low, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), {low}), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
)
SELECT page_id, host, path, {own("name")} AS rule,
       coalesce({own("verdict")}, CASE WHEN ({any_of("block")}) AND NOT ({any_of("allow")}) THEN 'block' ELSE 'allow' END) AS verdict
FROM split"""


SQL = _sql()
