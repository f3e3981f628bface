"""Operator 12: URL filter by host rules and a weighted vocabulary.

Rules come first. A rule names a host and a path, as in ``example.net/en/``;
it fits a url whose host is that host or a subdomain of it and whose path
starts with that path. Of the rules that fit the longest text wins (on a tie
the longer host, then ``block``) and its verdict stands.

Where no rule fits, an Aho-Corasick automaton counts the terms of a weighted
vocabulary in the url: strict terms weigh as much as the limit, soft terms
one. A hit counts only between boundaries (no ASCII letter or digit beside
it), and each term once, so one strict hit or ``limit`` different soft hits
block the url. Percent escapes are boundaries; the url is otherwise taken
as it stands, with A-Z lower-cased.

Rules and vocabulary are parameters, sent to the tasks: both are bounded by
what the caller lists (RULES_MOST, TERMS_MOST).

Edge cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, and is judged by the vocabulary alone (null: allow). Ids may
be null or repeated; every row gets one row. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import map_batches

RULES_MOST = 100_000
TERMS_MOST = 100_000
LIMIT = 2

# The default vocabulary (lower case).
STRICT = (
    "camgirl", "camgirls", "casino", "casinos", "escort", "escorts", "hentai", "porn", "porno", "pornography",
    "sexcam", "spam", "viagra", "warez", "xxx",
)
SOFT = (
    "ads", "adult", "bet", "bets", "betting", "cheap", "cialis", "crack", "cracked", "dating", "download", "farm",
    "free", "gambling", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "pharmacy", "pill", "pills", "poker",
    "sex", "sexy", "slots", "torrent", "torrents", "track", "tracker", "win",
)

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = _rest(url)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), LETTERS, LETTERS.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class Rules:
    """Rules by host; ``find`` looks up the host and each of its parent domains."""

    def __init__(self, rules):
        if len(rules) > RULES_MOST:
            raise ValueError(f"more than {RULES_MOST} rules")
        self.by_host: dict[str, dict[str, str]] = {}
        for host, path, verdict in rules:
            if verdict not in ("allow", "block") or not host:
                raise ValueError(f"not a rule: {host}{path} {verdict}")
            paths = self.by_host.setdefault(host, {})
            paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
        self.lengths = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.by_host.items()}

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule text, verdict) of the winner."""
        best = None
        while host:
            for n in self.lengths.get(host, ()):
                verdict = self.by_host[host].get(path[:n]) if n <= len(path) else None
                if verdict:  # the first is the longest of this host; parents must be longer to win
                    if best is None or len(host) + n > len(best[0]):
                        best = host + path[:n], verdict
                    break
            host = host.partition(".")[2]
        return best


@lru_cache(maxsize=4)
def vocabulary(strict: tuple, soft: tuple):
    """The automaton over the terms, or None without any."""
    import ahocorasick

    if len(strict) + len(soft) > TERMS_MOST:
        raise ValueError(f"more than {TERMS_MOST} terms")
    found = ahocorasick.Automaton()
    for term in {*soft, *strict}:
        if term:
            found.add_word(term, (term, term in strict))
    if not len(found):
        return None
    found.make_automaton()
    return found


def _inside(text: str, at: int) -> bool:
    """Whether there is an ASCII letter or digit at this place of the lower-cased text."""
    return 0 <= at < len(text) and (text[at].isascii() and text[at].isalnum())


def hits(automaton, text: str) -> tuple[int, int]:
    """Numbers of different strict and soft terms between boundaries in a lower-cased text."""
    strict, soft = set(), set()
    if automaton is not None:
        for end, (term, heavy) in automaton.iter(text):
            if not _inside(text, end - len(term)) and not _inside(text, end + 1):
                (strict if heavy else soft).add(term)
    return len(strict), len(soft)


def judge(df: DataFrame, rules, strict=STRICT, soft=SOFT, limit: int = LIMIT, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits of every row.

    ``rules``: (host, path, "allow" or "block"). Hits are counted only where no rule decides (else null).
    """
    strict, soft, table = tuple(strict), tuple(soft), Rules(tuple(rules))
    vocabulary(strict, soft)  # raises here rather than in tasks
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    plain = F.regexp_replace(F.translate(url, LETTERS, LETTERS.lower()), "%[0-9a-f]{2}", " ")
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"),
                     F.coalesce(path, F.lit("")).alias("path"), F.coalesce(plain, F.lit("")).alias("plain"))

    def judged(ids, hosts, paths, plains):
        automaton = vocabulary(strict, soft)
        for i, host, path, plain in zip(ids, hosts, paths, plains):
            won = table.find(host, path)
            if won:
                yield i, host, path, *won, None, None
            else:
                heavy, light = hits(automaton, plain)
                yield i, host, path, None, "block" if heavy * limit + light >= limit else "allow", heavy, light

    return map_batches(rows, judged, f"page_id {rows.schema['page_id'].dataType.simpleString()}, {SCHEMA}")


def judge_sql(rules, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> str:
    """DuckDB SQL of ``judge`` over the table ``pages``."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    terms = ", ".join([f"('{t}', true)" for t in strict] + [f"('{t}', false)" for t in soft])
    lower = f"translate({{}}, '{LETTERS}', '{LETTERS.lower()}')"
    return f"""
WITH rules(h, p, v) AS (VALUES {values}), terms(term, heavy) AS (VALUES {terms}),
cut AS (
  SELECT page_id, url, row_number() OVER () AS row_no,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, row_no, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    coalesce(regexp_replace({lower.format("url")}, '%[0-9a-f]{{2}}', ' ', 'g'), '') AS plain FROM cut
), fits AS (
  SELECT row_no, h || p AS rule, v, row_number() OVER (
    PARTITION BY row_no ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), found AS (
  SELECT row_no, count(*) FILTER (heavy) AS strict_hits, count(*) FILTER (NOT heavy) AS soft_hits
  FROM parts JOIN terms ON regexp_matches(plain, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY row_no
)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN coalesce(strict_hits, 0) * {limit} + coalesce(soft_hits, 0) >= {limit} THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN v IS NULL THEN CAST(coalesce(strict_hits, 0) AS INTEGER) END AS strict_hits,
  CASE WHEN v IS NULL THEN CAST(coalesce(soft_hits, 0) AS INTEGER) END AS soft_hits
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (row_no) LEFT JOIN found USING (row_no)"""
