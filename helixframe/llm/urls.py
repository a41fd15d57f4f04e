"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host + path with the literal tokens that
any matching URL must hold; a rule without one is refused. A rule is filed under
the one of its tokens that the fewest URLs hold. The tokens of a URL fetch the
candidate rules, and only those run their expression.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[0-9a-z]+")


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. name: as reported, null for pattern rules. tokens: literal tokens of every match."""

    verdict: str
    regex: str
    tokens: tuple[str, ...]
    name: str | None = None
    length: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains if the URL's path starts with path; the longest fitting one wins."""
    whole = host + path
    tokens = _TOKEN.findall(whole.lower()) if re.search(r"[^0-9A-Za-z]$", whole) else _TOKEN.findall(whole.lower())[:-1]
    return Rule(verdict, rf"(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), whole, len(whole))


def pattern_rule(verdict: str, regex: str, tokens: Sequence[str]) -> Rule:
    """A regular expression searched in host + path; tokens must be whole tokens of each match, in lower case.

    An expression with alternatives that share no token is given as a rule for each.
    """
    return Rule(verdict, regex, tuple(tokens))


def rules_of(table: DataFrame, most: int = 1_000_000) -> tuple[Rule, ...]:
    """Rules from a table: verdict, host and path (a host rule), or verdict, regex and tokens (a pattern rule).

    Every task holds all rules, so a table of more than `most` is refused.
    """
    rows = table.select("verdict", "host", "path", "regex", "tokens").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules")
    return tuple(host_rule(r.verdict, r.host, r.path or "") if r.host is not None else pattern_rule(r.verdict, r.regex, r.tokens or ()) for r in rows)


#: Pattern rules that decide where no host rule fits: a match blocks.
PATTERNS = (
    pattern_rule("block", r"(?:^|\.)spam-farm\.", ("spam", "farm")),
    pattern_rule("block", r"(?:^|\.)cheap-pills\.", ("cheap", "pills")),
    pattern_rule("block", r"(?:^|\.)free-casino\.", ("free", "casino")),
    pattern_rule("block", r"/wp-login(?:[./]|$)", ("wp", "login")),
    pattern_rule("block", r"/wp-admin(?:[./]|$)", ("wp", "admin")),
    pattern_rule("block", r"/cart/", ("cart",)),
    pattern_rule("block", r"/checkout/", ("checkout",)),
)

#: The host rules of the contract.
HOST_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = str.maketrans(_UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or end, A-Z lower-cased; path then up to ? # or end; both empty without ://."""
    rest = F.substring_index(F.substring_index(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(""), "?", 1), "#", 1)
    host = F.substring_index(F.coalesce(rest, F.lit("")), "/", 1)
    return F.translate(host, _UPPER, _LOWER), F.coalesce(F.substr(rest, F.char_length(host) + 1), F.lit(""))


class RuleIndex:
    """Rules by their rarest token. frequency: URLs that hold each literal token; absent means none."""

    def __init__(self, rules: Iterable[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        for rule in rules:
            if not rule.tokens:
                raise ValueError(f"a rule needs a literal token: {rule.regex}")
            self.by_token[min(rule.tokens, key=lambda t: (frequency.get(t, 0), t))].append((rule, re.compile(rule.regex)))

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(name of the longest fitting host rule or null, verdict)."""
        if not host and not path:
            return None, "allow"
        text = host + path
        candidates = [x for token in set(_TOKEN.findall(text.translate(_TABLE))) for x in self.by_token.get(token, ())]
        best, blocked = None, False
        for rule, regex in candidates:
            if rule.name is None:
                blocked = blocked or (rule.verdict == "block" and regex.search(text) is not None)
            elif (best is None or rule.length > best.length) and regex.match(text):
                best = rule
        if best is not None:
            return best.name, best.verdict
        return None, "block" if blocked else "allow"


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = HOST_RULES + PATTERNS) -> DataFrame:
    """id, host, path, rule (null if no host rule fits) and verdict of every row.

    A null or empty URL, or one without ://, has an empty host and path and is
    allowed. Long URLs are judged whole. Repeated rows are judged alike; of two
    host rules of one length the one that is filed first wins. Other columns are
    not read, so none can clash; an id column with the name of a
    result's stands in its place. The token counts that choose each rule's index token are
    taken over all URLs, but only for tokens of the rules, so what reaches the
    driver is bounded by the rules. An empty table gives no rows.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rules = tuple(rules)
    literal = sorted({t for r in rules for t in r.tokens})
    frequency: dict[str, int] = {}
    if literal:
        tokens = F.array_distinct(F.regexp_extract_all(F.translate(F.concat("host", "path"), _UPPER, _LOWER), F.lit("([0-9a-z]+)"), 1))
        known = F.array(*[F.lit(t) for t in literal])
        held = urls.select(F.explode(F.array_intersect(tokens, known)).alias("token")).groupBy("token").count().collect()
        frequency = {r["token"]: r["count"] for r in held}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, frequency)
        for batch in batches:
            judged = [index.judge(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            made = [pa.array([x[i] for x in judged], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["id", "host", "path", "rule", "verdict"])

    kind = urls.schema["id"].dataType.simpleString()
    found = urls.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return found.select(F.col("id").alias(id_col), *[c for c in ("host", "path", "rule", "verdict") if c != id_col.lower()])
