"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import arrow_map, texts_of

#: A list with more rules or characters than this is refused: the rules and their index go to every task.
MOST_RULES, MOST_CHARACTERS = 500_000, 64 << 20

#: Host and path rules: (verdict, host, start of the path). The longest that fits wins.
SITE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Pattern rules, each a regular expression over the lower-cased url.
PATTERN_RULES = (
    r"://([a-z0-9-]+\.)*ads-track\.",
    r"://([a-z0-9-]+\.)*casino-win\.",
    r"://([a-z0-9-]+\.)*spam-farm\.",
    r"://([a-z0-9-]+\.)*adult-x\.",
    r"://([a-z0-9-]+\.)*cheap-pills\.",
    r"://([a-z0-9-]+\.)*free-bets\.",
    r"[?&]affiliate=[a-z0-9]+",
    r"/popunder/[0-9]+\.js",
)

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class RuleIndex:
    """Rules by their rarest literal token; rules without one are tried on every url."""

    by_token: dict[str, tuple[int, ...]]
    rest: tuple[int, ...]
    rules: tuple[str, ...]

    def candidates(self, url: str) -> list[int]:
        """Numbers of the rules filed under a token of the lower-cased ``url``, and of those without a token, in order."""
        return sorted({i for t in set(_TOKEN.findall(url)) for i in self.by_token.get(t, ())} | set(self.rest))


def literal_tokens(rule: str) -> list[str]:
    """Whole url tokens (runs of letters and digits) that every url matched by ``rule`` holds.

    Read from the parsed expression: a run of literal letters and digits between literal separators or anchors at the
    top level. What is repeated, optional, alternative or grouped yields none and leaves the runs beside it open.
    """
    out: list[str] = []
    run, bounded = "", False

    def close(separator: bool) -> None:
        nonlocal run, bounded
        if run and bounded and separator:
            out.append(run)
        run, bounded = "", separator

    def is_separator(code: int) -> bool:
        return not re.fullmatch("[a-z0-9]", chr(code))

    for kind, value in parser.parse(rule):
        if kind is parser.LITERAL and not is_separator(value):
            run += chr(value)
        elif kind is parser.LITERAL or kind is parser.AT and value in (parser.AT_BEGINNING, parser.AT_END):
            close(True)
        elif kind is parser.IN:
            close(all(k is parser.LITERAL and is_separator(v) for k, v in value))
        else:
            close(False)
    return out


def build_index(rules: tuple[str, ...], frequency: dict[str, int]) -> RuleIndex:
    """Files each rule under the literal token that is rarest by ``frequency``, ties to the longer and then the smaller token."""
    if len(rules) > MOST_RULES or sum(map(len, rules)) > MOST_CHARACTERS:
        raise ValueError(f"{len(rules)} rules of {sum(map(len, rules))} characters; {MOST_RULES} of {MOST_CHARACTERS} at most")
    by_token: dict[str, list[int]] = defaultdict(list)
    rest = []
    for i, rule in enumerate(rules):
        tokens = literal_tokens(rule)
        if tokens:
            by_token[min(tokens, key=lambda t: (frequency.get(t, 0), -len(t), t))].append(i)
        else:
            rest.append(i)
    return RuleIndex({t: tuple(v) for t, v in by_token.items()}, tuple(rest), tuple(rules))


def token_frequency(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many urls' tokens equal each of ``tokens``; at most one row for each token of a rule comes back."""
    if not tokens:
        return {}
    all_tokens = pages.select(F.explode(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    # the rules' tokens, bounded as the rules are
    asked = pages.sparkSession.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    wanted = all_tokens.join(F.broadcast(asked), "token", "left_semi")
    return {r["token"]: r["n"] for r in wanted.groupBy("token").agg(F.count("*").alias("n")).collect()}


def split_url(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of ``url``; both empty without ``://``."""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = re.search(r"[/?#]", rest)
    host = rest if end is None else rest[: end.start()]
    path = "" if end is None else re.match(r"[^?#]*", rest[end.start() :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def site_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule whose host is ``host`` or a parent of it and whose path starts ``path``."""
    best = None
    at = host
    while at:
        for start, verdict in rules.get(at, ()):
            if path.startswith(start) and (best is None or len(at + start) > len(best[0])):
                best = (at + start, verdict)
        _, dot, at = at.partition(".")
        if not dot:
            break
    return best


def rules_of(table: DataFrame) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(site rules, pattern rules) of a table ``(verdict, host, path, pattern)``: rows with a pattern are pattern rules, which block; the rest site rules.

    Both come in order of their columns, so that the first match is the same on every run. More than MOST_RULES are refused.
    """
    rows = table.select("verdict", "host", F.coalesce("path", F.lit("/")).alias("path"), "pattern").distinct().orderBy("pattern", "host", "path", "verdict").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [(r["verdict"], r["host"], r["path"]) for r in rows if r["pattern"] is None], [r["pattern"] for r in rows if r["pattern"] is not None]


def judge_urls(pages: DataFrame, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, rules: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, matched, tried)`` for each row of ``pages(page_id, url)``.

    Rules are given as sequences, or as a table (rules_of) in their place.

    The longest site rule that fits decides; where none does, a url is blocked if a pattern rule matches it and allowed
    otherwise. ``matched`` is the first pattern rule that matches, else null; ``tried`` counts the regular expressions
    that ran: those filed under a token of the url, and those without a literal token. Null urls and urls without
    ``://`` have an empty host and path and fit no rule. Repeated rows give repeated rows, an empty table an empty one;
    other columns are left aside. Urls are read whole.
    """
    if rules is not None:
        site_rules, pattern_rules = rules_of(rules)
    tokens = {t for r in pattern_rules for t in literal_tokens(r)}
    index = build_index(tuple(pattern_rules), token_frequency(pages, tokens))
    sites: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for verdict, host, start in site_rules:
        sites[host].append((start, verdict))
    held = pages.sparkSession.sparkContext.broadcast((index, dict(sites)))  # bounded by MOST_RULES and MOST_CHARACTERS

    def make():
        index, sites = held.value
        compiled: dict[int, re.Pattern] = {}

        def matches(i: int, url: str) -> bool:
            rule = compiled.get(i)
            if rule is None:
                rule = compiled[i] = re.compile(index.rules[i])
            return rule.search(url) is not None

        def each(batch: pa.RecordBatch):
            out = []
            for url in texts_of(batch.column(1)):
                host, path = split_url(url)
                found = site_rule(host, path, sites)
                lower = url.lower()
                candidates = index.candidates(lower)
                hit = next((i for i in candidates if matches(i, lower)), None)
                verdict = found[1] if found else "allow" if hit is None else "block"
                out.append((host, path, found and found[0], verdict, None if hit is None else index.rules[hit], len(candidates)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["page_id", "host", "path", "rule", "verdict", "matched", "tried"])

        return each

    return arrow_map(pages.select(F.col("page_id").cast("long"), "url"), "page_id long, host string, path string, rule string, verdict string, matched string, tried int", make)


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
b AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
c AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM b),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM (SELECT DISTINCT page_id, host, path FROM c) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.verdict, CASE WHEN {matched} IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM c LEFT JOIN m ON c.page_id = m.page_id
""".replace("{matched}", "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{r}') THEN 1" for r in PATTERN_RULES) + " END")
