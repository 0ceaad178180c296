"""Mailboxes, hosts and contact pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import elements
from .text import non_blank, squeeze, strip

# ---- fixed values ---------------------------------------------------------
MAILBOX_ORDER = [
    "admissions", "enquiries", "enquiry", "info", "contact", "office", "head",
    "headteacher", "principal", "admin", "reception", "school", "hello",
]
PERSONAL_RANK = len(MAILBOX_ORDER) + 50
EMAIL_PATTERN = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PLACEHOLDER_HOSTS = r"(?i)example\.|@example|@test"
VENDOR_HOSTS = r"(?i)sentry|datadog|raygun|@cloudflare"
HEAD_LABELS = ["principal", "head", "managing director", "chief executive"]
# ---------------------------------------------------------------------------


def mailbox_rank(email: Column) -> Column:
    local = F.lower(F.substring_index(email, "@", 1))
    out = F.when(local.startswith(MAILBOX_ORDER[0]), 0)
    for i, name in enumerate(MAILBOX_ORDER[1:], start=1):
        out = out.when(local.startswith(name), i)
    return out.otherwise(PERSONAL_RANK)


def emails_in(html: Column) -> Column:
    """Addresses on a page: mailto targets first, then anywhere in the source."""
    targets = F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']mailto:([^\"'?]*)"), F.lit(1))
    from_links = F.flatten(F.transform(targets, lambda t: F.regexp_extract_all(t, F.lit(EMAIL_PATTERN), F.lit(0))))
    return F.concat(from_links, F.regexp_extract_all(html, F.lit(EMAIL_PATTERN), F.lit(0)))


def best_email(emails: Column, domain: Column) -> Column:
    """Best-ranked on-domain address, first among equals, or null."""
    clean = F.transform(emails, lambda e: strip(F.lower(e)))
    kept = F.filter(
        clean,
        lambda e: (F.length(e) < 100)
        & ~e.rlike(PLACEHOLDER_HOSTS)
        & ~e.rlike(VENDOR_HOSTS)
        & (e.endswith(F.concat(F.lit("."), domain)) | e.endswith(F.concat(F.lit("@"), domain))),
    )
    ranked = F.transform(kept, lambda e, i: F.struct(mailbox_rank(e).alias("r"), i.alias("i"), e.alias("e")))
    return F.array_min(ranked)["e"]


def base_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def contact_fields(html: Column) -> Column:
    """struct(email, phone, website, head_name, standards) of a directory page.

    Values come from a dt and the dd right after it; the last pair of a label
    wins. ``standards`` counts the "(level N)" marks.
    """
    marks = F.regexp_count(html, F.lit(r"\(level\s+[0-9]+\)")).alias("standards")
    pages = F.array(elements(html, ["dt", "dd", "a"]))
    # the elements become a lambda's variable, since a lambda cannot name an Arrow function
    return F.get(F.transform(pages, lambda found: F.struct(*_pair_facts(found), marks)), F.lit(0))


def _pair_facts(found: Column) -> list[Column]:
    terms = F.filter(found, lambda e: e["name"] != "a")
    after = F.slice(terms, F.lit(2), F.greatest(F.size(terms), F.lit(0)))
    beside = F.zip_with(terms, after, lambda t, d: F.struct(F.lower(squeeze(t["text"])).alias("k"), t.alias("t"), d.alias("d")))
    pairs = F.filter(
        beside,
        lambda p: (p["t"]["name"] == "dt")
        & (p["d"]["name"] == "dd")
        & (p["d"]["at"] == p["t"]["last"] + 1)
        & p["d"]["parent"].eqNullSafe(p["t"]["parent"]),
    )

    def last(*names: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["k"].isin(*names)), F.lit(-1))["d"]

    def link(dd: Column, cond) -> Column:
        inside = F.filter(found, lambda e: (e["name"] == "a") & (e["at"] > dd["at"]) & (e["at"] <= dd["last"]) & cond(e))
        return F.get(inside, F.lit(0))["href"]

    mail, site = last("email"), last("website")
    mailto = link(mail, lambda e: F.lower(e["href"]).startswith("mailto:"))
    return [
        F.coalesce(non_blank(strip(F.substring_index(mailto.substr(8, 1 << 30), "?", 1))), squeeze(mail["text"])).alias("email"),
        squeeze(last("telephone", "phone")["text"]).alias("phone"),
        F.coalesce(non_blank(link(site, lambda e: F.lit(True))), squeeze(site["text"])).alias("website"),
        squeeze(last(*HEAD_LABELS)["text"]).alias("head_name"),
    ]
