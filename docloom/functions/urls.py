"""URL functions as pure column expressions: they stay inside generated code, with no Python on the executors.

The canonical form is that of Python's URL parser and query encoder.  A URL whose host has an unbalanced bracket has
none and gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.base import col, let

# Names of tracking parameters, compared with the lower-cased parameter name.  The last one has a
# capital letter and so never matches.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "gclsrc",
    "fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref", "twclid", "msclkid",
    "hsa_acc", "hsa_cam", "hsa_grp", "hsa_ad", "hsa_src", "hsa_tgt", "hsa_kw", "hsa_mt", "hsa_net", "hsa_ver",
    "mc_cid", "mc_eid", "ref", "source", "campaign", "_ga", "_gl", "trk", "trkInfo",
)
# Schemes whose last path segment may carry ;parameters, and those that imply a host (Python's parser).
PARAM_SCHEMES = ("", "ftp", "hdl", "prospero", "http", "https", "imap", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel")
HOST_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)
_BLANKS = r"[\s\x0B\x1C-\x1F\x85   -     　]+"


def strip(text: Column) -> Column:
    """Remove white space of all kinds from both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANKS}", ""), f"{_BLANKS}$", "")


def _split(url: Column) -> Column:
    """scheme, netloc, path (with ;parameters), query and fragment; the netloc in its own case."""
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def parts(u: Column) -> Column:
        scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        rest = F.when(scheme != "", F.substr(u, F.length(scheme) + 2)).otherwise(u)
        return let(F.struct(F.lower(scheme).alias("scheme"), rest.alias("rest")), behind)

    def behind(x: Column) -> Column:
        has = x["rest"].startswith("//")
        netloc = F.when(has, F.regexp_extract(x["rest"], "^//([^/?#]*)", 1)).otherwise(F.lit(""))
        tail = F.when(has, F.regexp_replace(x["rest"], "^//[^/?#]*", "")).otherwise(x["rest"])
        return F.struct(
            x["scheme"].alias("scheme"),
            netloc.alias("netloc"),
            F.regexp_extract(tail, r"^([^?#]*)", 1).alias("path"),
            F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(tail, r"(?s)^[^#]*#(.*)$", 1).alias("fragment"),
        )

    return let(plain, parts)


def _balanced(netloc: Column) -> Column:
    return netloc.contains("[") == netloc.contains("]")


def _joined(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    implied = (scheme != "") & scheme.isin(*HOST_SCHEMES) & ((path == "") | path.startswith("/"))
    body = F.when(netloc != "", F.concat(F.lit("//"), netloc, rooted)).when(path.startswith("//") | implied, F.concat(F.lit("//"), path)).otherwise(path)
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), body)
    out = F.concat(out, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.concat(out, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))


def decode(text: Column) -> Column:
    """Percent- and plus-decoding that leaves malformed escapes alone."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def encode(text: Column) -> Column:
    """Percent-encoding with plus for blanks and a bare tilde."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\*", "%2A"), "%7E", "~")


def query_params(query: Column) -> Column:
    """Decoded parameters of a query string, in order, as an array of (k, v); blank values are kept."""
    parts = F.filter(F.split(query, "&", -1), lambda p: p != "")
    value = lambda p: F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))
    return F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(value(p)).alias("v")))


def canonical_query(query: Column) -> Column:
    """The query without tracking parameters, names sorted by code point, values of a name in their order."""
    kept = F.filter(query_params(query), lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS))

    def build(ps: Column) -> Column:
        names = F.sort_array(F.array_distinct(F.transform(ps, lambda p: p["k"])))
        same = lambda k: F.transform(F.filter(ps, lambda p: p["k"] == k), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"])))
        return F.array_join(F.flatten(F.transform(names, same)), "&")

    return F.when(query == "", F.lit("")).otherwise(let(kept, build))


def normalize_url(url: Column | str, preserve_fragment: bool = False) -> Column:
    """Canonical form of a URL; null and empty give an empty string, an unbalanced bracket in the host gives null."""
    u = col(url)

    def form(x: Column) -> Column:
        low = F.lower(x["netloc"])
        netloc = F.when((x["scheme"] == "http") & low.endswith(":80"), F.regexp_replace(low, ":80$", ""))
        netloc = netloc.when((x["scheme"] == "https") & low.endswith(":443"), F.regexp_replace(low, ":443$", "")).otherwise(low)
        path = F.when(x["scheme"].isin(*PARAM_SCHEMES), F.regexp_replace(x["path"], ";[^/]*$", "")).otherwise(x["path"])
        trimmed = F.regexp_replace(path, "/+$", "")
        path = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
        fragment = x["fragment"] if preserve_fragment else F.lit("")
        return F.when(_balanced(x["netloc"]), _joined(x["scheme"], netloc, path, canonical_query(x["query"]), fragment))

    return F.when(u.isNull() | (u == ""), F.lit("")).otherwise(let(_split(strip(u)), form))


def url_hash(url: Column | str) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the canonical URL."""
    return F.substring(F.sha2(normalize_url(url), 256), 1, 16)


def content_hash(content: Column | str) -> Column:
    """SHA-256 of bytes or of a text's UTF-8, as 64 hexadecimal digits."""
    return F.sha2(col(content), 256)


def extract_domain(url: Column | str) -> Column:
    """Lower-cased network location, with port and user information; empty if there is none."""
    return F.lower(_split(col(url))["netloc"])


def is_valid_url(url: Column | str) -> Column:
    """Whether a URL has the scheme http or https and a host part."""
    u = col(url)
    x = _split(u)
    return F.coalesce(F.when(u != "", let(x, lambda p: p["scheme"].isin("http", "https") & (p["netloc"] != "") & _balanced(p["netloc"]))), F.lit(False))


def convert_to_https(url: Column | str) -> Column:
    """http becomes https, and an empty query or fragment mark is dropped with it; other URLs stay as they are."""
    u = col(url)
    https = lambda x: F.when(x["scheme"] == "http", _joined(F.lit("https"), x["netloc"], x["path"], x["query"], x["fragment"])).otherwise(u)
    return let(_split(u), https)


def accession_number(url: Column | str) -> Column:
    """First accession number (ten, two and six digits) in a URL, else null."""
    return F.nullif(F.regexp_extract(col(url), r"([0-9]{10}-[0-9]{2}-[0-9]{6})", 1), F.lit(""))


def is_same_document(a: Column | str, b: Column | str) -> Column:
    """Whether two URLs have one canonical form."""
    return normalize_url(a).eqNullSafe(normalize_url(b))


def robots_url(url: Column | str) -> Column:
    """Where the site's robots file lies: scheme, network location, /robots.txt."""
    return let(_split(col(url)), lambda x: F.concat(x["scheme"], F.lit("://"), x["netloc"], F.lit("/robots.txt")))
