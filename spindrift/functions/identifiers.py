"""Indicators and identifiers: refanging, recognition, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift import schema
from spindrift.functions.columns import any_of, words

#: Formats of indicators and identifiers.
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
URL = r"^(?i)https?://"
EMAIL = r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$"
DOMAIN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"
HASH = r"^(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"
CVE = r"^(?i)CVE-\d{4}-\d{4,}$"
CVE_LOOSE = r"(?i)CVE\s*[-–]?\s*(\d{4})\s*[-–]?\s*(\d{4,})"
ATTACK_ID = r"^(?:T\d{4}(?:\.\d{3})?|TA\d{4}|S\d{4}|G\d{4})$"
FILE_NAME = r"\.(?:exe|dll|ps1|bat|doc|docx|xls|xlsx|pdf|js|vbs|hta|lnk|scr|msi|iso|zip|rar|7z)$"
PLAIN_DOMAIN = r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.[a-z]{2,}$"

SOFTWARE_WORDS = list(dict.fromkeys(w for name in schema.SOFTWARE_NAMES for w in name.split()))


def refang(value: Column) -> Column:
    """Defanged dots, colons, at signs and schemes as they were."""
    for pattern, put in ((r"\[\.\]", "."), (r"\[:\]", ":"), ("(?i)hxxp", "http"), (r"(?i)\[at\]", "@"), (r"(?i)\[dot\]", ".")):
        value = F.regexp_replace(value, pattern, put)
    return value


def ioc_subtype(value: Column) -> Column:
    """ip, url, email, domain, hash or unknown, tried in this order on the refanged value."""
    v = refang(value)
    return F.when(v.rlike(IPV4), "ip").when(v.rlike(URL), "url").when(v.rlike(EMAIL), "email").when(v.rlike(DOMAIN), "domain").when(v.rlike(HASH), "hash").otherwise("unknown")


def cve(value: Column) -> Column:
    """The identifier in its normal form, from anywhere in the value if need be; null if there is none."""
    loose = F.concat(F.lit("CVE-"), F.regexp_extract(value, CVE_LOOSE, 1), F.lit("-"), F.regexp_extract(value, CVE_LOOSE, 2))
    return F.when(value.rlike(CVE), F.upper(value)).when(value.rlike(CVE_LOOSE), loose)


def ipv4(value: Column) -> Column:
    """The refanged address without leading zeros; null if it is none."""
    v = refang(value)
    parts = F.transform(F.split(v, r"\."), lambda p: p.try_cast("int"))
    return F.when(v.rlike(IPV4) & F.forall(parts, lambda p: p.between(0, 255)), F.array_join(parts, "."))


def domain(value: Column) -> Column:
    """The domain refanged and in lower case; null if it is none."""
    v = F.lower(refang(value))
    return F.when(v.rlike(DOMAIN), v)


def digest(value: Column) -> Column:
    """The hash stripped and in lower case; null if it is none."""
    return F.when(F.trim(value).rlike(HASH), F.lower(F.trim(value)))


def attack_id(value: Column) -> Column:
    return F.trim(value).rlike(ATTACK_ID)


def normal_ioc(value: Column) -> Column:
    """An indicator in the normal form of its subtype; others as they are."""
    kind = ioc_subtype(value)
    return F.when(kind == "ip", F.coalesce(ipv4(value), value)).when(kind == "domain", domain(value)).when(kind == "hash", F.coalesce(digest(value), value)).otherwise(value)


def type_of_untyped(name: Column) -> Column:
    """A better type for a name typed Other; null if nothing tells."""
    low = F.lower(F.trim(name))
    return (
        F.when(name.rlike(r"(?i)CVE-\d{4}-\d+"), "Vulnerability")
        .when(name.rlike(IPV4) | name.rlike(HASH) | low.rlike(PLAIN_DOMAIN) | low.rlike(FILE_NAME), "IOC")
        .when(F.trim(name).rlike(r"^T\d{4}(?:\.\d{3})?$"), "Technique")
        .when(low.isin(schema.TECHNIQUE_NAMES) | any_of(low, [t for t in schema.TECHNIQUE_NAMES if len(t) > 8]), "Technique")
        .when(any_of(low, schema.CRYPTO_HINTS), "Technique")
        .when(low.contains("extension") | low.startswith("."), "File")
        .when(any_of(low, schema.CAMPAIGN_HINTS), "Campaign")
        .when(any_of(low, schema.ACTOR_HINTS), "ThreatActor")
        .when(F.arrays_overlap(words(low), F.array(*map(F.lit, SOFTWARE_WORDS))), "Software")
    )
