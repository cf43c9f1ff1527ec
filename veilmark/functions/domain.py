"""Domain of a text by the density of its keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Terms of each financial sub-domain: words, or phrases of words. A rule table; callers may bring their own.
FINANCIAL: dict[str, list[str]] = {
    "Banking": ["account", "bank", "branch", "cheque", "deposit", "ifsc", "loan", "savings account", "current account", "interest rate", "overdraft"],
    "KYC": ["aadhaar", "pan", "passport", "kyc", "know your customer", "proof of address", "date of birth", "voter", "licence", "customer due diligence"],
    "Fintech": ["upi", "wallet", "payment gateway", "neobank", "digital lending", "mobile money", "api banking"],
    "Transaction": ["transaction", "credited", "debited", "payment", "transfer", "neft", "rtgs", "imps", "invoice", "refund", "card number"],
    "Compliance": ["gst", "audit", "regulation", "aml", "anti money laundering", "tax return", "disclosure", "sanctions list"],
    "Fraud": ["fraud", "phishing", "chargeback", "stolen card", "identity theft", "suspicious activity", "money mule"],
}
LEAST_DENSITY, FULL_DENSITY = 0.005, 0.05


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def _terms_in(tokens: Column, terms: list[str]) -> Column:
    """Every occurrence of a term, words first; phrases are looked for only where their first word stands."""
    words = sorted({t for t in terms if " " not in t})
    found = F.filter(tokens, lambda t: t.isin(*words)) if words else F.array().cast("array<string>")
    for n in sorted({t.count(" ") + 1 for t in terms if " " in t}):
        found = F.concat(found, _phrases_in(tokens, sorted({t for t in terms if t.count(" ") + 1 == n}), n))
    return found


def _phrases_in(tokens: Column, phrases: list[str], n: int) -> Column:
    firsts = sorted({p.split(" ")[0] for p in phrases})
    windows = F.transform(tokens, lambda t, i: F.when(t.isin(*firsts), F.array_join(F.slice(tokens, i + 1, n), " ")))
    return F.filter(windows, lambda w: w.isin(*phrases))


def classify_domain(text: Column, domains: dict[str, list[str]] = FINANCIAL, least: float = LEAST_DENSITY, full: float = FULL_DENSITY) -> Column:
    """``struct<in_domain, domain, sub_domains, domain_confidence, keyword_density, keywords, words>`` of a text, in one pass over its words.

    The density is the number of occurrences of terms, whatever their sub-domain, per word; a text is in the domain from ``least`` on. Sub-domains are ranked by
    occurrences, equal ones by name; the first is the text's domain. The confidence is the share of the first among all occurrences in sub-domains, lowered in
    proportion where the density is below ``full``. A text without words or below ``least`` has no domain and confidence 0. Nulls are empty texts.
    """
    every = sorted({t for terms in domains.values() for t in terms})

    def ranked(found: Column) -> Column:
        def occurrences(terms: list[str]) -> Column:
            return F.size(F.filter(found, lambda t: t.isin(*terms)))

        counts = F.array(*(F.struct((-occurrences(terms)).alias("n"), F.lit(name).alias("name")) for name, terms in domains.items()))
        return F.filter(F.array_sort(counts), lambda c: c["n"] < 0)

    def judged(b: Column) -> Column:
        density = F.when(b["words"] > 0, F.size(b["found"]) / b["words"]).otherwise(F.lit(0.0))
        inside = density >= least
        total = -F.aggregate(b["ranked"], F.lit(0), lambda n, c: n + c["n"])
        share = -F.get(b["ranked"], F.lit(0))["n"] / total
        return F.struct(
            inside.alias("in_domain"), F.when(inside, F.get(b["ranked"], F.lit(0))["name"]).alias("domain"),
            F.when(inside, F.transform(b["ranked"], lambda c: c["name"])).otherwise(F.array().cast("array<string>")).alias("sub_domains"),
            F.when(inside, share * F.least(F.lit(1.0), density / full)).otherwise(F.lit(0.0)).alias("domain_confidence"),
            density.alias("keyword_density"), F.size(b["found"]).alias("keywords"), b["words"].alias("words"))

    return let(tokens_of(text), lambda tokens: let(
        F.struct(_terms_in(tokens, every).alias("found"), F.size(tokens).alias("words")), lambda f: let(
            F.struct(f["found"].alias("found"), f["words"].alias("words"), ranked(f["found"]).alias("ranked")), judged)))
