"""Source-address checks as column expressions; nothing is ever fetched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rolecast.functions.regex import SPACE, utf16_length

MAX_URL_LENGTH = 2048

# Reasons, first failing check wins.
EMPTY = "URL must be a non-empty string"
TOO_LONG = "URL exceeds maximum length of 2048 characters"
BACKSLASH = "URL must not contain backslashes"
WHITESPACE = "URL must not contain whitespace"
MALFORMED = "Malformed URL"
NOT_HTTPS = "Only HTTPS protocol is allowed"
USERINFO = "Userinfo (credentials in URL) is not allowed"
PORT = "Explicit port must be 443"
IP_LITERAL = "IP address literals are not allowed"
LOCAL_HOST = "Local and internal hosts are not allowed"


@F.pandas_udf(StringType())
def _ascii_host(hosts: pd.Series) -> pd.Series:
    def convert(host):
        if host is None:
            return None
        try:
            return host.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return hosts.map(convert)


def _percent_encode(part: Column, unsafe: str) -> Column:
    """Percent-encode the characters of ``unsafe``; other text is left alone."""
    encoded = F.array_join(
        F.transform(F.split(part, ""), lambda c: F.when(c.rlike(unsafe), F.url_encode(c)).otherwise(c)), ""
    )
    return F.when(part.rlike(unsafe), encoded).otherwise(part)


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments."""
    segments = F.slice(F.split(path, "/"), 2, 2048)
    one = r"(?i)^(?:\.|%2e)\z"
    two = r"(?i)^(?:\.|%2e){2}\z"
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.rlike(two), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s.rlike(one), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    slash = F.when((last.rlike(one) | last.rlike(two)) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), slash)
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"), resolved).otherwise(path)


def _ipv4_part(part: Column) -> Column:
    """Value of a decimal, octal or hexadecimal address part; null when it is no number."""
    hexadecimal = F.regexp_extract(part, r"^0x([0-9a-f]*)\z", 1)
    digits = (
        F.when(part.rlike(r"^0x[0-9a-f]*\z"), F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10))
        .when(part.rlike(r"^0[0-7]*\z"), F.conv(part, 8, 10))
        .when(part.rlike(r"^[1-9][0-9]*\z"), part)
    )
    return digits.try_cast("double")


def check_urls(df: DataFrame, url: str, hosts: Column, into: str = "url_check") -> DataFrame:
    """Add ``into``: struct<ok, url, is_official, reason>, null where the address is null.

    ``hosts`` is an array of lower-case official hosts; a subdomain of one counts too.
    """
    raw = F.col(url)
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    staged = df.withColumns({"_scheme": scheme, "_hosts": hosts})
    staged = staged.withColumn("_authority", F.regexp_extract(raw, r"(?i)^https?:/*([^/?#]*)", 1))
    staged = staged.withColumns(
        {
            "_userinfo": F.regexp_extract(F.col("_authority"), r"^(.*)@", 1),
            "_hostport": F.regexp_replace(F.col("_authority"), r"^.*@", ""),
            "_tail": F.regexp_replace(raw, r"(?i)^https?:/*[^/?#]*", ""),
        }
    )
    staged = staged.withColumns(
        {
            "_host": F.lower(F.regexp_replace(F.col("_hostport"), r":[0-9]*\z", "")),
            "_port": F.regexp_extract(F.col("_hostport"), r":([0-9]*)\z", 1),
        }
    )
    host = F.col("_host")
    plain = F.coalesce(_ascii_host(F.when(host.rlike(r"[^\x00-\x7F]"), host)), host)
    staged = staged.withColumn("_host", plain)
    staged = staged.withColumn("_label_host", F.regexp_replace(host, r"\.\z", ""))
    bare = F.col("_label_host")
    port = F.try_to_number(F.nullif(F.col("_port"), F.lit("")), F.lit("9999999999")).cast("bigint")
    parts = F.split(bare, r"\.")
    # A host whose last label is a number is an IPv4 form or no valid host at all.
    values = F.transform(parts, _ipv4_part)
    last_limit = F.pow(F.lit(256.0), F.lit(5) - F.size(parts))
    ipv4_form = (
        (F.size(parts) <= 4)
        & F.forall(values, lambda v: v.isNotNull())
        & F.forall(F.slice(values, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda v: v <= 255)
        & (F.element_at(values, -1) < last_limit)
    )
    ends_in_number = F.element_at(parts, -1).rlike(r"^(?:[0-9]+|0x[0-9a-f]*)\z")
    ipv6 = host.rlike(r"^\[[0-9a-f:.]+\]\z")
    bad_host = (host == "") | (~ipv6 & host.rlike(r"[\x00-\x20#/:<>?@\[\]^|%\x7f]")) | (ends_in_number & ~ipv4_form)
    malformed = (
        (F.col("_scheme") == "")
        | (F.col("_scheme").isin("http", "https") & (bad_host | F.coalesce(port > 65535, F.lit(False))))
    )
    local = (bare == "localhost") | bare.rlike(r"\.(?:localhost|local|internal|lan)\z")
    reason = (
        F.when(raw == "", EMPTY)
        .when(utf16_length(raw) > MAX_URL_LENGTH, TOO_LONG)
        .when(raw.contains("\\"), BACKSLASH)
        .when(raw.rlike(f"[{SPACE}]"), WHITESPACE)
        .when(malformed, MALFORMED)
        .when(F.col("_scheme") != "https", NOT_HTTPS)
        .when(~F.col("_userinfo").isin("", ":"), USERINFO)
        .when(F.coalesce(port != 443, F.lit(False)), PORT)
        .when(ipv6 | ends_in_number, IP_LITERAL)
        .when(local, LOCAL_HOST)
    )
    punycode = bare.startswith("xn--") | bare.contains(".xn--")
    official = F.exists(
        F.col("_hosts"),
        lambda h: ((bare == h) | bare.endswith(F.concat(F.lit("."), h))) & (~punycode | h.contains("xn--")),
    )
    path = F.regexp_extract(F.col("_tail"), r"^([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(_resolve_dots(path))
    query = F.regexp_extract(F.col("_tail"), r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(F.col("_tail"), r"(#.*)\z", 1)
    href = F.concat(
        F.lit("https://"),
        F.col("_host"),
        _percent_encode(path, r'[^\x21-\x7e]|["<>^`{}]'),
        _percent_encode(query, r"[^\x21-\x7e]|[\"<>']"),
        _percent_encode(fragment, r'[^\x21-\x7e]|["<>`]'),
    )
    staged = staged.withColumn("_reason", reason)
    ok = F.col("_reason").isNull()
    result = F.when(
        raw.isNotNull(),
        F.struct(
            ok.alias("ok"),
            F.when(ok, href).alias("url"),
            F.when(ok, official).alias("is_official"),
            F.col("_reason").alias("reason"),
        ),
    )
    return staged.withColumn(into, result).drop(
        "_scheme", "_hosts", "_authority", "_userinfo", "_hostport", "_tail", "_host", "_port", "_label_host", "_reason"
    )
