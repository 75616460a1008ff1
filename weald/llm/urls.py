"""URL filters: host/path rules and pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weald.llm.common import map_slices, table

#: Rules by host and path, as (verdict, rule).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


@dataclass(frozen=True)
class Pattern:
    """Blocks urls that `regex` finds. Every url it finds holds all `tokens` (whole runs of letters and digits, lower case)."""

    name: str
    tokens: tuple[str, ...]
    regex: str


#: The method's own rules: tracking, advertising and link-farm addresses.
PATTERNS = (
    Pattern("ad-server", ("ads",), r"^[a-z]+://(?:[^/?#]*\.)?ads\.[^/?#]+"),
    Pattern("banner-path", ("banner", "ads"), r"/ads/(?:[^?#]*/)?banner\b"),
    Pattern("casino", ("casino",), r"\bcasino\b"),
    Pattern("link-farm", ("farm", "spam"), r"^[a-z]+://(?:[^/?#]*\.)?spam-farm\."),
    Pattern("login-page", ("login",), r"/login(?:[/.?#]|$)"),
    Pattern("porn", ("porn",), r"\bporn\b"),
    Pattern("session-id", ("phpsessid",), r"[?&;]phpsessid="),
    Pattern("tag-feed", ("feed", "tag"), r"/tag/[^?#]*/feed(?:[/?#]|$)"),
    Pattern("tracker-host", ("tracker",), r"^[a-z]+://tracker\."),
)

TOKEN = r"[a-z0-9]+"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path). Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to '?' or '#'."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].encode().lower().decode(), m[2]


def rule_lookup(rules: Iterable[tuple[str, str]]):
    """host, path -> (rule, verdict) of the longest rule that fits, by probing the host's suffixes in a hash table."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, sep, path = rule.partition("/")
        by_host.setdefault(host, []).append((sep + path, rule, verdict))

    def find(host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".")
        for i in range(len(labels)):
            for start, rule, verdict in by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best

    return find


#: What a separator of a filter line stands for.
SEPARATOR = r"(?:[^a-z0-9_.%-]|\Z)"


def pattern_of(line: str) -> Pattern | None:
    """The pattern of one line of a public block list, or None for a comment or an empty line.

    `||` begins at a host or one of its parent domains, `|` at the url's beginning or end; `*` stands for anything and
    `^` for a separator or the end. Tokens are the runs of letters and digits that the line bounds on both sides, so
    that a url it finds holds them whole; a line without any can't be indexed. Exceptions (@@), options ($) and rules
    for page elements (##) are errors.
    """
    low = line.strip().encode().lower().decode()
    if not low or low.startswith(("!", "[")):
        return None
    if low.startswith("@@") or "$" in low or "##" in low:
        raise ValueError(f"not a url pattern: {line}")
    host, begin, end = low.startswith("||"), low.startswith("|"), low.endswith("|")
    body = low[2 if host else 1 if begin else 0 : len(low) - 1 if end else None]
    tokens = tuple(m[0] for m in re.finditer(TOKEN, body) if (body[m.start() - 1] != "*" if m.start() else begin) and (body[m.end()] != "*" if m.end() < len(body) else end))
    if not tokens:
        raise ValueError(f"no whole token: {line}")
    middle = "".join(".*" if x == "*" else SEPARATOR if x == "^" else re.escape(x) for x in body)
    head = r"\A[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if host else r"\A" if begin else ""
    return Pattern(low, tokens, f"(?s){head}{middle}" + (r"\Z" if end else ""))


def read_patterns(spark: SparkSession, path: str) -> tuple[Pattern, ...]:
    """The patterns of a block list, a line each, in order. A list is configuration: thousands of lines, held in every worker."""
    return tuple(p for r in spark.read.text(path, wholetext=True).collect() for line in r["value"].splitlines() if (p := pattern_of(line)))


def token_counts(urls: DataFrame, url_col: str, tokens: Iterable[str]) -> dict[str, int]:
    """In how many rows each of the rules' own tokens occurs, counted in each partition first. One row per token comes
    back: bounded by the rules."""
    wanted = frozenset(tokens)
    if not wanted:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        find = re.compile(TOKEN).findall
        for batch in batches:
            for url in batch.column(0).to_pylist():
                counts.update(wanted.intersection(find((url or "").encode().lower().decode())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])

    found = urls.select(F.col(url_col).cast("string")).mapInArrow(count, "t string, n bigint")
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.sum("n").alias("n")).collect()}


class RarestTokenIndex:
    """Each rule stands under the one of its tokens that fewest urls hold; a url's tokens fetch the rules to try."""

    def __init__(self, patterns: Iterable[Pattern], counts: dict[str, int]):
        self.under: dict[str, list[tuple[int, re.Pattern]]] = {}
        self.names = []
        for i, p in enumerate(patterns):
            rarest = min(p.tokens, key=lambda t: (counts.get(t, 0), t))
            self.under.setdefault(rarest, []).append((i, re.compile(p.regex)))
            self.names.append(p.name)
        self.tokens = re.compile(TOKEN)

    def match(self, url: str) -> str | None:
        """The first rule (in the given order) that finds the lower-cased url."""
        low = url.encode().lower().decode()
        hits = [i for t in set(self.tokens.findall(low)) & self.under.keys() for i, regex in self.under[t] if regex.search(low)]
        return self.names[min(hits)] if hits else None


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, patterns=PATTERNS, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, pattern, verdict) for every row, in a narrow map after one count of the rules' tokens.

    A host/path rule fits its host and all subdomains if the url's path starts with its own; the longest wins (equal
    ones: the first). Otherwise a pattern that finds the url blocks it, and any other url gets `default`. Null or
    malformed urls have an empty host and path and can still meet patterns. Ids may be null or repeat; other columns
    are not read. Rules are configuration: they are held in each worker, urls never leave their partition.
    """
    counts = token_counts(df, url_col, (t for p in patterns for t in p.tokens))
    index, find = RarestTokenIndex(patterns, counts), rule_lookup(rules)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            rule, verdict = find(host, path)
            pattern = None if rule else index.match(url or "")
            rows.append((host, path, rule, pattern, verdict or ("block" if pattern else default)))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["id", "host", "path", "rule", "pattern", "verdict"])

    id_type = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")), judge, f"id {id_type}, host string, path string, rule string, pattern string, verdict string").withColumnRenamed("id", id_col)


def op2_urls(spark, sf_dir: str) -> DataFrame:
    """The verdicts on every row of pages by RULES and PATTERNS; null urls, repeated rows and ids as in filter_urls."""
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op2_sql() -> str:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    pattern = " ".join(f"WHEN regexp_matches(low, '{p.regex}') THEN '{p.name}'" for p in PATTERNS)
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH a AS (SELECT page_id, url, {low} AS low,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)} END AS rule FROM b),
d AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {pattern} END END AS pattern FROM c)
SELECT page_id, host, path, rule,
    CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for _, r, v in cases)} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM d"""
