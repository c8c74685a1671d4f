"""URL rules indexed by their rarest literal token.

A rule is ``host/path`` with ``*`` as wildcard in the path; it fits its host and all subdomains, where the url's path starts
with the rule's. The tokens of a rule are the runs of letters and digits that any fitting url holds as whole runs
(those that touch an open end or a wildcard don't count). Each rule is filed under the one of its tokens that is rarest
over all urls; a url looks up its own tokens and runs the regular expressions of the rules found, and of no others. Rules without a
token are run on every url.

The index is sent to the tasks, so a pass takes at most ``MAX_RULES`` rules; more rules make more passes over the
same rows, each keeping the better of what it found and what came before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

MAX_RULES = 50_000
_TOKEN = re.compile(r"[a-z0-9]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``specific`` rules name a host and win by length; the others are patterns of the method's own verdict."""

    pattern: str
    verdict: str
    specific: bool = True

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def regex(self) -> str:
        path = "".join(".*" if x == "*" else re.escape(x) for x in re.split(r"(\*)", self.path))
        return (rf"\A(?:[^/]*\.)?{re.escape(self.host)}{path}" if self.host else rf"\A[^/]*{path}")

    def tokens(self) -> list[str]:
        """Runs with a delimiter on both sides in every fitting url."""
        text, found = self.pattern.lower(), []
        for m in _TOKEN.finditer(text):
            left = text[m.start() - 1] if m.start() else ("." if self.host else "*")
            right = text[m.end()] if m.end() < len(text) else "*"
            if left != "*" and right != "*" and m[0].isascii():
                found.append(m[0])
        return found


#: The verdicts that the query is asked for.
SITE_RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)
#: Our own patterns for urls that no site rule fits: pages that hold no text of their own.
METHOD_RULES = tuple(Rule(p, "block", False) for p in ("/*/login/", "/*/signin/", "/*/cart/", "/*/checkout/", "/*/wp-admin/", "/cgi-bin/", "/*/feed/rss/", "/*/ads/banner/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    whole = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = whole.partition("/")
    return host.translate(_ASCII_LOWER), slash + path


def url_tokens(host: str, path: str) -> set[str]:
    return set(_TOKEN.findall((host + path).translate(_ASCII_LOWER)))


def _token_counter(wanted: frozenset[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            for url in batch.column(0).to_pylist():
                for token in url_tokens(*split_url(url)) & wanted:
                    seen[token] = seen.get(token, 0) + 1
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return count


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many of all urls each token of the rules occurs: as many numbers as the rules have tokens."""
    wanted = frozenset(t for r in rules for t in r.tokens())
    if not wanted:
        return {}
    counted = urls.mapInArrow(_token_counter(wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token (ties: the longer, then the first by letters), and those without any."""
    by: dict[str, list[Rule]] = {}
    rest = []
    for rule in rules:
        tokens = sorted(set(rule.tokens()), key=lambda t: (counts.get(t, 0), -len(t), t))
        by.setdefault(tokens[0], []).append(rule) if tokens else rest.append(rule)
    return by, rest


def _better(rule: Rule) -> tuple:
    return rule.specific, len(rule.pattern), rule.pattern


def _judge(index: dict[str, list[Rule]], rest: list[Rule], first: bool):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[Rule, re.Pattern] = {}
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("host", "path", "_rule", "_verdict", "_specific", "candidates", "regex_runs")}
            old = {c: batch.column(c).to_pylist() for c in out} if not first else None
            for i, url in enumerate(batch.column("url").to_pylist()):
                host, path = split_url(url)
                found = [r for t in url_tokens(host, path) for r in index.get(t, ())] + rest
                best = Rule(old["_rule"][i], old["_verdict"][i], old["_specific"][i]) if old and old["_rule"][i] is not None else None
                runs = 0
                for rule in found:
                    if best is not None and _better(rule) <= _better(best):
                        continue
                    runs += 1
                    if rule not in compiled:
                        compiled[rule] = re.compile(rule.regex(), re.DOTALL)
                    if compiled[rule].match(host + path):
                        best = rule
                row = (host, path, best and best.pattern, best and best.verdict, best and best.specific, len(found) + (old["candidates"][i] if old else 0), runs + (old["regex_runs"][i] if old else 0))
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            kinds = {"_specific": pa.bool_(), "candidates": pa.int64(), "regex_runs": pa.int64()}
            made = {c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()}
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), **made})

    return judge


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row, repeated rows and null urls included.

    ``rule`` is the longest site rule that fits (ties by letters), else null; the verdict is the site rule's, else that of
    the longest fitting pattern of the method, else ``default``. Empty tables give no rows; other columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    counts = token_counts(pages.select("url"), rules)
    df, first = pages, True
    schema = "page_id long, url string, host string, path string, _rule string, _verdict string, _specific boolean, candidates long, regex_runs long"
    for at in range(0, max(len(rules), 1), max_rules):
        df = df.mapInArrow(_judge(*build_index(rules[at : at + max_rules], counts), first), schema)
        first = False
    site = F.col("_specific")
    return df.select("page_id", "host", "path", F.when(site, F.col("_rule")).alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict"), F.when(~site, F.col("_rule")).alias("pattern"), "candidates", "regex_runs")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` under the site rules, and under the method's patterns where no site rule fits."""
    return judge_urls(table(spark, sf_dir, "pages"), SITE_RULES + METHOD_RULES).select("page_id", "host", "path", "rule", "verdict", "pattern")
