"""E-mail addresses, phone numbers and person names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions import url as U
from leadweave.functions import values as V

#: Patterns that lead data is judged by.
EMAIL_IN_TEXT = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_IN_TEXT = r"(\+?[\d(][\d\s\-().]{5,20}[\d])"
CLEAN_EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
JUNK_EMAIL = r"(?i)\.(png|jpg|jpeg|gif|svg|webp)$|^your@email\.com$|^(test|example|sample|noreply|no-reply)@"
ESCAPE_LEFT = r"(?i)^u00[0-9a-f]{2}"
DATE_LIKE = (r"^\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4}$", r"^\d{4}\s*[-–]\s*\d{4}$", r"^\d{4}\s*[-–]\s*\d{4}\s+\d{4}$", r"^\d{1,2}\.\d{2}\s*[-–]\s*\d{2}\.\d{2}$", r"^\d{4}$", r"^\d{8}$")
PHONE_SHAPE = r"^[+\d(][\d\s\-().]{5,20}[\d]$"
AUTHOR_PREFIX = r"(?i)^(?:written by |posted by |published by |author: |author |by )"
NAME_NOISE = (
    "certificate", "certification", "course", "degree", "diploma", "training", "workshop", "program", "bootcamp", "module",
    "college", "university", "institute", "academy", "school", "campus",
    "blog", "article", "guide", "tutorial", "documentation", "introduction", "overview", "review", "ranking", "comparison",
    "what is", "how to", "learn", "admission", "placement", "fees", "recommendation", "recommendations",
    "engineering", "technology", "management", "science", "artificial intelligence", "machine learning",
    "address", "registered", "corporate", "communications", "floor", "building", "street", "office",
)
PRODUCT_HINTS = ("services", "systems", "development", "solutions", "erp", "mvp")


def unescaped_email(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), ESCAPE_LEFT, "")


def email_status(raw: Column) -> Column:
    """ok, junk or malformed, of an address as scraped."""
    e = unescaped_email(raw)
    return F.when(e.rlike(JUNK_EMAIL), F.lit("junk")).when(~e.rlike(CLEAN_EMAIL), F.lit("malformed")).otherwise(F.lit("ok"))


def emails_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL_IN_TEXT), F.lit(0))


def first_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, EMAIL_IN_TEXT, 0), F.lit(""))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_phone(text: Column) -> Column:
    """A realistic phone number: one line, no date or year range, 7 to 15 digits, the right shape."""
    t = F.trim(text)
    date = t.rlike("|".join(DATE_LIKE))
    ok = ~t.rlike("[\n\r]") & ~date & F.length(digits(t)).between(7, 15) & t.rlike(PHONE_SHAPE)
    return F.coalesce(ok, F.lit(False))


def phones_in(text: Column) -> Column:
    """Valid phone numbers of a text in order, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PHONE_IN_TEXT), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, is_phone))


def has_seven_digits(phone: Column) -> Column:
    return F.length(digits(phone)) >= 7


def merge_emails(emails: Column) -> Column:
    """Addresses as the merge stage keeps them: trimmed, lower case, no plus in the local part."""
    return F.filter(F.transform(emails, lambda e: F.lower(F.trim(e))), lambda e: e.rlike(r"(?U)^[\w\.-]+@[\w\.-]+\.\w+$"))


def merge_phones(phones: Column) -> Column:
    return F.filter(F.transform(phones, lambda p: F.regexp_replace(F.trim(p), r"[\s\-()]", "")), lambda p: p.rlike(r"^\+?[0-9]{7,15}$"))


def is_person(name: Column) -> Column:
    """Plausibly a human name: 2 to 5 words of letters, no noise word."""

    def good(n: Column) -> Column:  # the cheap tests first: most texts are no names
        return F.length(n).between(2, 60) & n.rlike(r"^[A-Za-z][A-Za-z.\-' ]{1,59}$") & F.size(F.split(n, r"\s+")).between(2, 5) & ~F.lower(n).rlike("|".join(NAME_NOISE))

    def bare(n: Column) -> Column:  # only a text that begins so is copied
        return F.trim(F.when(F.substring(n, 1, 13).rlike(AUTHOR_PREFIX), F.regexp_replace(n, AUTHOR_PREFIX, "")).otherwise(n))

    return F.coalesce(U.bound(bare(F.trim(name)), good), F.lit(False))


def is_person_record(name: Column, designation: Column) -> Column:
    return is_person(name) & (F.trim(F.coalesce(designation, F.lit(""))) != "")


def is_product_label(name: Column) -> Column:
    return F.lower(name).rlike("|".join(PRODUCT_HINTS))


def is_garbage_name(name: Column) -> Column:
    """Holds an @, or more than three tenths of it are digits."""
    return name.contains("@") | (F.length(digits(name)) / F.greatest(F.length(name), F.lit(1)) > 0.3)


def email_rank(email: Column) -> Column:
    """Place of an address by the start of its local part; unknown ones last."""
    local, out = F.lower(F.substring_index(email, "@", 1)), F.lit(len(V.EMAIL_PREFIXES))
    for i, p in reversed(list(enumerate(V.EMAIL_PREFIXES))):
        out = F.when(local.startswith(p), F.lit(i)).otherwise(out)
    return out


def is_ignored_email(email: Column) -> Column:
    """An address of a machine, not of a person."""
    local, out = F.lower(F.substring_index(email, "@", 1)), F.lit(False)
    for p in V.EMAIL_IGNORED:
        out = out | local.contains(p)
    return out


def ranked_emails(emails: Column) -> Column:
    """Contacts by rank, then by address; system addresses left out, each once."""
    kept = F.array_distinct(F.filter(emails, lambda e: (e != "") & ~is_ignored_email(e)))
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(email_rank(e).alias("r"), e.alias("e")))), lambda x: x["e"])
