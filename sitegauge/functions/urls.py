"""URL identity as native columns. Nothing here raises on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, by the beginning of their names.
TRACKING = ("utm_", "fbclid", "gclid", "msclkid", "mc_eid", "igshid")
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold_host(netloc: Column) -> Column:
    """Lower case, without a default port, trailing dots and one leading ``www.``."""
    host = F.regexp_replace(F.lower(netloc), r":(80|443)$", "")
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")


def host_key(col) -> Column:
    """Folded host of a URL or a bare host."""
    url = _c(col)
    full = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("//"), url))
    return fold_host(F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_key(col) -> Column:
    """Identity of a page: http is https, hosts are folded, %xx is upper case, one trailing slash goes,
    tracking parameters go, the others are sorted by name and value, the fragment goes."""
    url = F.trim(_c(col))
    scheme, netloc, path, query = (F.regexp_extract(url, _PARTS, k) for k in range(1, 5))
    broken = F.contains(netloc, F.lit("[")) != F.contains(netloc, F.lit("]"))
    scheme = F.lower(scheme)
    scheme = F.when(scheme == "http", "https").otherwise(scheme)
    # capital hex digits of escapes: pieces after a % begin with them
    pieces = F.split(path, "%")
    upper = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.when(p.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substr(p, F.lit(3)))).otherwise(p))
    path = F.array_join(F.concat(F.slice(pieces, 1, 1), upper), "%")
    path = F.when((F.char_length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.named_struct(F.lit("k"), _decoded(F.substring_index(p, "=", 1)), F.lit("v"), _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""))))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).rlike("^(?:" + "|".join(TRACKING) + ")")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    folded = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), fold_host(netloc))).otherwise(""),
        path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(url == "", "").when(broken, url).otherwise(folded)


def path_of(col) -> Column:
    """Path with the query, as rules match it; at least ``/``."""
    rest = F.regexp_extract(_c(col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def same_site(url, site, subdomains: bool = False) -> Column:
    one, two = host_key(url), host_key(site)
    same = one == two
    if subdomains:
        same = same | one.endswith(F.concat(F.lit("."), two))
    return (one != "") & (two != "") & same


#: Query parameters that hold secrets.
SECRET_PARAMETERS = ("key", "apikey", "api_key", "token", "access_token", "secret", "client_secret", "password", "signature", "auth")


def redact(col) -> Column:
    """Values of secret parameters become REDACTED, in URLs and in messages."""
    return F.regexp_replace(_c(col), r"(?i)(^|[?&\s;,])(" + "|".join(SECRET_PARAMETERS) + r")=[^&\s;,#]*", "$1$2=REDACTED")
