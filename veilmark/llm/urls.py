"""URL filter: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton.

The vocabulary is a list of stems, each with its plural. A term counts where no ASCII letter or digit stands next to it, in host, path or query alike. A strict stem
weighs 1 and a soft one ``1 / SOFT_HITS``; a URL whose distinct stems weigh 1 or more is blocked, so one strict
stem is enough, or ``SOFT_HITS`` different soft ones. A null URL, or one without ``://``, has
an empty host and path; its text, if any, is still searched. Rows are judged one by one, so repeated rows
get the same verdict, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import read

# Fixed values of this filter: the stems of its vocabulary, strict ones and soft ones by class. A stem stands for itself and its plural.
STRICT = ["porn", "porno", "xxx", "hentai", "escort", "camgirl", "sexcam", "milf", "upskirt", "warez", "keygen", "serialz", "phishing", "malware", "ransomware",
          "botnet", "carding", "cvvshop"]
SOFT_CLASSES = {
    "gambling": ["casino", "poker", "bet", "betting", "bookmaker", "slot", "jackpot", "lottery", "roulette", "blackjack", "baccarat", "bingo", "wager",
                 "gambling", "sportsbook", "win", "winner"],
    "pharmacy": ["viagra", "cialis", "levitra", "pill", "pharmacy", "xanax", "tramadol", "steroid", "valium", "slimming", "prescription"],
    "money": ["payday", "loan", "forex", "lender", "cheap", "free", "discount", "replica", "coupon", "earn", "cash", "giveaway", "prize", "sweepstake"],
    "piracy": ["torrent", "crack", "cracked", "nulled", "repack", "hack", "cheat", "leak", "unlocked"],
    "adult": ["nude", "adult", "dating", "hookup", "erotic", "fetish", "lingerie", "webcam", "swinger", "strip", "sexy", "girl"],
    "spam": ["spam", "clickbait", "traffic", "backlink", "seo", "bulkmail", "autosurf"],
}
SOFT = [term for terms in SOFT_CLASSES.values() for term in terms]
SUFFIXES = ["", "s"]
SOFT_HITS = 2

# Fixed values of the rules: (host, path, verdict). The longest that fits wins.
RULES = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("org", "/", "allow")]


@lru_cache
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for stem in (*soft, *strict):
        for suffix in SUFFIXES:
            if suffix == "" or stem + suffix not in (*soft, *strict):
                found.add_word(stem + suffix, (len(stem + suffix), stem, stem in strict))
    found.make_automaton()
    return found


def hits(url: str | None, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft stems of a URL."""
    if not url:
        return 0, 0
    text, seen = url.lower(), set()
    for end, (length, stem, strict) in terms.iter(text):
        start = end - length
        if not any(0 <= i < len(text) and text[i].isascii() and text[i].isalnum() for i in (start, end + 1)):
            seen.add((stem, strict))
    strict = sum(s for _, s in seen)
    return strict, len(seen) - strict


def term_hits(url: Column, strict: list[str] = STRICT, soft: list[str] = SOFT) -> Column:
    """Struct (strict, soft): numbers of distinct stems."""
    names = tuple(strict), tuple(soft)

    @F.pandas_udf("strict int, soft int")
    def count(urls: pd.Series) -> pd.DataFrame:
        terms = automaton(*names)
        return pd.DataFrame([hits(u, terms) for u in urls], columns=["strict", "soft"])

    return count(url)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null when none does."""
    name = verdict = F.lit(None).cast("string")
    for at, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, url: str = "url", *keep: str) -> DataFrame:
    """``keep`` with host, path, rule, the numbers of strict and soft terms, and verdict."""
    rows = pages.select(*keep, F.col(url).alias("_url")).select(
        *keep, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        term_hits(F.col("_url")).alias("_hits"))
    rule, says = rule_of(F.col("host"), F.col("path"))
    weight = F.col("_hits.strict") * SOFT_HITS + F.col("_hits.soft")
    own = F.when(weight >= SOFT_HITS, "block").otherwise("allow")
    return rows.select(*keep, "host", "path", rule.alias("rule"), F.col("_hits.strict").alias("strict_terms"),
                       F.col("_hits.soft").alias("soft_terms"), F.coalesce(says, own).alias("verdict"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), "url", "page_id").select("page_id", "host", "path", "rule", "verdict")


def op8_sql() -> str:
    def distinct(terms: list[str]) -> str:
        return " + ".join(f"regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){t}s?($|[^a-z0-9])')::int" for t in terms)

    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
            for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    return f"""
        WITH parts AS (
            SELECT page_id, url,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        places AS (
            SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
        SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits)} END AS rule,
            CASE {' '.join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)}
                WHEN {SOFT_HITS} * ({distinct(STRICT)}) + ({distinct(SOFT)}) >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
        FROM places"""
