"""URL filter: an Aho-Corasick automaton counts strict and soft terms of a
weighted vocabulary with boundary checks; one strict hit or several distinct
soft hits block.  Host and path rules of a list come before the vocabulary."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import map_batches

#: One of these blocks.
STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "escort", "jackpot", "warez", "malware", "phishing", "spam", "sportsbook", "pills")
#: SOFT_NEEDED distinct ones of these block.
SOFT_TERMS = ("win", "cheap", "free", "ads", "track", "bonus", "bet", "poker", "loan", "deal", "farm", "adult", "sexy", "torrent", "crack", "lottery", "click", "prize")
SOFT_NEEDED = 2
#: (verdict, host, start of the path): see judge_urls.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    m = _PARTS.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


_LOWER = {b: b + 32 for b in range(65, 91)}


@functools.lru_cache(maxsize=4)
def _vocabulary(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton | None:
    automaton = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):  # a term in both is strict
        for term in terms:
            automaton.add_word(term, (weight, term))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _edge(text: str, at: int) -> bool:
    return not (0 <= at < len(text) and (text[at].isascii() and text[at].isalnum()))


def count_terms(url: str | None, automaton: ahocorasick.Automaton | None) -> tuple[int, int]:
    """Distinct strict and soft terms that stand in the URL between non-alphanumeric characters or its ends."""
    text = (url or "").translate(_LOWER)
    hits = {v for end, v in automaton.iter(text) if _edge(text, end + 1) and _edge(text, end - len(v[1]))} if automaton and text else set()
    strict = sum(w == 2 for w, _ in hits)
    return strict, len(hits) - strict


def best_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict.  rules: by host, (path, verdict)."""
    best: tuple[str | None, str | None] = (None, None)
    name = host
    while name:
        for start, verdict in rules.get(name, ()):
            if path.startswith(start) and len(name + start) > len(best[0] or ""):
                best = (name + start, verdict)
        name = name.partition(".")[2]
    return best


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """Judge every URL; only the id and URL columns are read.

    Returns page_id, host, path, rule, n_strict, n_soft, verdict for each
    input row.  A rule (verdict, host, path) fits its host and all subdomains
    if the URL's path starts with the rule's; the longest that fits decides.
    Else the URL is blocked on one strict term or ``soft_needed`` distinct
    soft ones.  A null URL, or one without ``://``, has empty host and path,
    fits no rule and is judged by its terms (null: none, so it is allowed).
    Rules and terms are parameters of a job and go to tasks in its closure.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    terms = (tuple(strict), tuple(soft))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton, out = _vocabulary(*terms), []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            rule, verdict = best_rule(host, path, by_host)
            n_strict, n_soft = count_terms(url, automaton)
            out.append((host, path, rule, n_strict, n_soft, verdict or ("block" if n_strict or n_soft >= soft_needed else "allow")))
        host, path, rule, n_strict, n_soft, verdict = zip(*out, strict=True)
        text = lambda x: pa.array(x, pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), text(host), text(path), text(rule), pa.array(n_strict, pa.int32()), pa.array(n_soft, pa.int32()), text(verdict)], names=["page_id", "host", "path", "rule", "n_strict", "n_soft", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(pages, [F.col(id_col), F.col(url_col)], f"page_id {kind}, host string, path string, rule string, n_strict int, n_soft int, verdict string", rows)


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_needed: int = SOFT_NEEDED) -> str:
    """The same as DuckDB SQL, by regular expressions."""
    word = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in rules)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH parts AS (
  SELECT page_id, {lower.format("coalesce(url, '')")} AS low,
         {lower.format("coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path, CASE {fits} END AS rule,
         ({" + ".join(word(t) for t in strict)})::INT AS n_strict,
         ({" + ".join(word(t) for t in soft)})::INT AS n_soft
  FROM parts)
SELECT page_id, host, path, rule, n_strict, n_soft,
       CASE {verdicts} WHEN n_strict > 0 OR n_soft >= {soft_needed} THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""
