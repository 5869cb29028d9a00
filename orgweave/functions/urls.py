"""URL and domain scalars as Column expressions (all JVM-side, inside codegen).

Nulls in give nulls out; a value that is not domain-shaped gives NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels below which a name is registered.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "ac.uk", "gov.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au",
    "co.nz", "net.nz", "org.nz", "govt.nz",
    "co.za", "org.za", "net.za",
    "com.br", "com.mx", "com.ar", "com.co", "com.pe", "com.sg", "com.my",
    "com.hk", "com.tw", "com.tr", "com.ua", "com.pl", "com.cn", "net.cn", "org.cn",
    "co.in", "net.in", "org.in", "co.il", "co.jp", "or.jp", "ne.jp", "co.kr",
    "co.th", "com.ph", "com.vn", "co.id",
)

_EDGE = r"""^[\s<>"']+|[\s<>"']+$"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it. Where an expression
    would be repeated, the optimizer would otherwise multiply it through projections and filters."""
    return F.get(F.transform(F.array(value), body), 0)


def blank_to_null(c: Column | str) -> Column:
    """NULL for NULL, empty and all-blank strings."""
    c = col(c)
    return F.when(F.length(F.trim(c)) > 0, c)


def authority(raw: Column | str, keep_port: bool = False) -> Column:
    """Lower-case host of anything URL- or domain-like, '' when there is none."""
    s = F.regexp_replace(col(raw), _EDGE, "")
    s = F.regexp_replace(s, _SCHEME, "")
    s = F.regexp_replace(s, r"^//", "")
    host = F.substring_index(F.regexp_extract(s, r"^[^/?#]*", 0), "@", -1)
    if not keep_port:
        host = F.substring_index(host, ":", 1)
    return F.lower(F.regexp_replace(F.trim(host), r"\.+$", ""))


_SUFFIXES = "|".join(x.replace(".", r"\.") for x in TWO_LABEL_SUFFIXES)
#: One pass over the value: scheme, user, as few leading labels as possible, then the root, then the end
#: of the host. Written as one expression because the optimizer repeats it wherever it infers a filter.
_ROOT = (
    r"""^[\s<>"']*+(?:[A-Za-z][A-Za-z0-9+.\-]*+://|//)?+(?:[^/?#@]*+@)*+(?:[A-Za-z0-9\-]*+\.)*?"""
    rf"""([A-Za-z0-9\-]*+\.(?:(?i:{_SUFFIXES})|[A-Za-z]{{2,}}))\.*+(?=[\s<>"']*+(?:[:/?#]|\z))"""
)


def root_domain(raw: Column | str) -> Column:
    """Registrable root: three labels below a two-label suffix, else two."""
    return F.lower(F.nullif(F.regexp_extract(col(raw), _ROOT, 1), F.lit("")))


def base_url(raw: Column | str, scheme: str = "https") -> Column:
    """Origin of the root domain; an explicit scheme is kept."""
    own = F.lower(F.regexp_extract(F.trim(col(raw)), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.concat(F.when(own != "", own).otherwise(F.lit(scheme)), F.lit("://"), root_domain(raw))


# Scheme, authority, path, query; a fragment and ";params" of the last segment are dropped.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def url_part(url: Column | str, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; '' where missing."""
    return F.regexp_extract(col(url), _PARTS, i)


def canonical_url(url: Column | str) -> Column:
    """Fragment and params dropped, slashes collapsed, no trailing slash but the root's."""
    scheme, host = F.lower(url_part(url, 1)), F.lower(url_part(url, 2))
    path = F.regexp_replace(url_part(url, 3), r";[^/]*$", "")
    path = F.regexp_replace(path, r"/{2,}", "/")
    path = F.regexp_replace(path, r"(.)/+$", "$1")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = url_part(url, 4)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def url_key(url: Column | str) -> Column:
    """Identity of a page whatever its scheme and 'www.'."""
    c = canonical_url(url)
    return F.regexp_replace(F.regexp_replace(c, r"^[a-z][a-z0-9+.\-]*:", ""), r"^//(?:www\.)?", "")


def normalize_host(raw: Column | str) -> Column:
    """Host for tag checks: as typed but lower, port kept, 'www.' and path dropped."""
    h = authority(raw, keep_port=True)
    return F.when(F.contains(h, F.lit(".")), F.regexp_replace(h, r"^www\.", ""))


def same_site(url: Column | str, domain: Column | str) -> Column:
    """Whether url lies on domain or below it; false when either has no root."""
    return F.coalesce(root_domain(url) == root_domain(domain), F.lit(False))


def path_depth(url: Column | str) -> Column:
    return F.size(F.filter(F.split(url_part(url, 3), "/"), lambda x: x != ""))


def _undot(path: Column) -> Column:
    """Path with its dot segments resolved: '.' stands for nothing, '..' takes the segment before it off."""

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    full = F.concat(F.lit("/"), F.array_join(kept, "/"), folder)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.regexp_replace(full, "^//", "/")).otherwise(path)


def url_join(base: Column | str, ref: Column | str) -> Column:
    """Reference resolution, dot segments included."""
    base, ref = col(base), col(ref)
    scheme, host, path = url_part(base, 1), url_part(base, 2), url_part(base, 3)
    origin = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), r"[^/]*$", "")
    own, rest = F.regexp_extract(ref, r"^[^?#]*", 0), F.regexp_extract(ref, r"[?#][\s\S]*$", 0)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, _undot(own), rest))
        .when(ref == "", F.regexp_replace(base, r"#[\s\S]*$", ""))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, r"#[\s\S]*$", ""), ref))
        .otherwise(F.concat(origin, _undot(F.concat(folder, own)), rest))
    )


def unwrap_redirect(url: Column | str) -> Column:
    """Target of a redirect link (first of url, q, uddg, u, target that is a URL), else the URL."""
    url = col(url)
    found = [
        F.try_url_decode(F.regexp_extract(url, rf"[?&]{p}=([^&#]*)", 1)) for p in ("url", "q", "uddg", "u", "target")
    ]
    return F.coalesce(*[F.when(x.rlike(r"^https?://"), x) for x in found], url)


def slug(s: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(s)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
