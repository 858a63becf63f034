"""Normal forms of entity values, as column expressions. Null gives the empty string.

Two need a Python library and only for values a native expression cannot settle:
internationalised domain labels and IPv6 compression.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def email(c: Column) -> Column:
    return _or_empty(_squeeze(F.regexp_replace(F.lower(strip(c)), "^mailto:", "")))


@F.pandas_udf(StringType())
def _idna(s: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        try:
            return ".".join(x if x.isascii() else x.encode("idna").decode("ascii") for x in v.split(".")) if v else v
        except UnicodeError:
            return v

    return s.map(one)


def domain(c: Column) -> Column:
    s = F.rtrim(F.lower(strip(c)), F.lit("."))
    netloc = F.regexp_extract(s, r"^[^/?#]*://([^/?#]*)", 1)
    s = F.when(F.contains(s, F.lit("://")) & (netloc != ""), netloc).otherwise(s)
    s = F.regexp_replace(s, r"^www\.", "")
    return _or_empty(F.when(s.rlike(r"[^\x00-\x7F]"), _idna(s)).otherwise(s))


def ascii_domain(c: Column) -> Column:
    """``domain`` for values known to be ASCII: no Python in the plan."""
    s = F.rtrim(F.lower(strip(c)), F.lit("."))
    netloc = F.regexp_extract(s, r"^[^/?#]*://([^/?#]*)", 1)
    s = F.when(F.contains(s, F.lit("://")) & (netloc != ""), netloc).otherwise(s)
    return _or_empty(F.regexp_replace(s, r"^www\.", ""))


def phone(c: Column) -> Column:
    """Digits with a leading plus; ten-digit numbers in North American style get +1."""
    s = strip(c)
    digits = F.regexp_replace(s, r"[^\d+]", "")
    bare = F.regexp_replace(digits, r"\+", "")
    north = s.rlike(r"^\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}$")
    out = F.when(digits.startswith("+"), digits).when(north, F.concat(F.lit("+1"), bare)).when(
        digits.startswith("00"), F.concat(F.lit("+"), F.substr(digits, F.lit(3))),
    ).when(digits != "", F.concat(F.lit("+"), digits)).otherwise(s)
    return _or_empty(out)


def username(c: Column) -> Column:
    return _or_empty(_squeeze(F.regexp_replace(F.lower(strip(c)), "^[@+]+", "")))


def hash_value(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), "^(sha256|sha-256|sha1|sha-1|md5|hash):", "")
    return _or_empty(F.upper(F.regexp_replace(F.regexp_replace(s, "^0x", ""), "[^a-f0-9]", "")))


OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"


@F.pandas_udf(StringType())
def _ip(s: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        for x in (v, v[1 : v.find("]")] if v and v.startswith("[") and "]" in v else None):
            try:
                return str(ipaddress.ip_address(x))
            except ValueError:
                pass
        return v

    return s.map(one)


def ip(c: Column) -> Column:
    s = strip(c)
    return _or_empty(F.when(s.rlike(rf"^{IPV4}(?::[^:]*)?$"), F.split_part(s, F.lit(":"), F.lit(1))).when(F.contains(s, F.lit(":")), _ip(s)).otherwise(s))


def url(c: Column) -> Column:
    s = strip(c)
    s = F.when(F.contains(s, F.lit("://")), s).otherwise(F.concat(F.lit("https://"), s))
    part = lambda p: F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?", p)
    scheme, host, port, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4), part(5)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    shown = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.when(path == "", "/").when(path == "/", "/").otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.when(query == "?", "").otherwise(query)
    whole = F.concat(scheme, F.lit("://"), host, shown, path, query)
    return _or_empty(F.when(strip(c) == "", "").when(scheme == "", s).otherwise(whole))


def wallet(c: Column) -> Column:
    return _or_empty(strip(c))


def cve(c: Column) -> Column:
    s = F.upper(strip(c))
    return _or_empty(F.when(s.startswith("CVE-"), s).otherwise(F.regexp_replace(s, r"^CVE\s*-?\s*(.+)$", "CVE-$1")))


def asn(c: Column) -> Column:
    s = F.upper(strip(c))
    digits = F.regexp_extract(s, r"^(?:AS)?0*(\d+)$", 1)
    return _or_empty(F.when(digits != "", F.concat(F.lit("AS"), digits)).otherwise(s))


def mac(c: Column) -> Column:
    return _or_empty(F.regexp_replace(F.translate(F.upper(strip(c)), "-.", "::"), "[^A-F0-9:]", ""))


def iban(c: Column) -> Column:
    return _or_empty(_squeeze(F.upper(strip(c))))


def vat(c: Column) -> Column:
    s = _squeeze(F.upper(strip(c)))
    return _or_empty(F.when(s.startswith("EU") & (F.length(s) > 4), F.substr(s, F.lit(3))).otherwise(s))


def user_agent(c: Column) -> Column:
    return _or_empty(F.regexp_replace(strip(c), r"\s+", " "))


#: Entity types of each normaliser.
BY_TYPE = {
    email: ("email",),
    domain: ("domain",),
    phone: ("phone",),
    username: ("username", "user"),
    hash_value: ("hash", "md5", "sha1", "sha256"),
    ip: ("ip", "ipv4", "ipv6"),
    url: ("url",),
    wallet: ("wallet", "btc", "eth"),
    cve: ("cve",),
    asn: ("asn",),
    mac: ("mac",),
    iban: ("iban",),
    vat: ("vat",),
    user_agent: ("user_agent", "useragent"),
}


def native_ip(c: Column) -> Column:
    """``ip`` without IPv6 compression: no Python in the plan."""
    s = strip(c)
    return _or_empty(F.when(s.rlike(rf"^{IPV4}(?::[^:]*)?$"), F.split_part(s, F.lit(":"), F.lit(1))).otherwise(s))


def normalize(kind: Column, value: Column, native: bool = False) -> Column:
    """The normal form of ``value`` for its entity type; of unknown types, the trimmed value.

    With ``native`` the two cases that need Python (labels beyond ASCII, IPv6) stay as they
    are, which lets the expression stand inside array functions.
    """
    k, out = F.lower(strip(kind)), None
    for f, names in BY_TYPE.items():
        f = {domain: ascii_domain, ip: native_ip}.get(f, f) if native else f
        hit = k.isin(*names)
        out = F.when(hit, f(value)) if out is None else out.when(hit, f(value))
    return out.otherwise(_or_empty(strip(value)))
