"""URLs: parsing, escapes, dot segments, normalisation, resolution.

Scalar cores work on Python strings; the Column functions wrap them in Arrow-batched UDFs
(one call a distinct value and batch).  Invalid input gives null, never an exception.
``url_parts`` has a JVM-side form, ``url_fast``, for clean absolute URLs.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_PARTS = re.compile(r"(?:([^:/?#]+):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?", re.DOTALL)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*")
_PORT = re.compile(r"[0-9]{1,5}")
_NAME = re.compile(r"[A-Za-z0-9_~!$&'()*+,;=.%-]+")
_V6 = re.compile(r"[0-9A-Fa-f:.]+|v[0-9A-Fa-f]+\..+")
_HEX = re.compile(r"%([0-9A-Fa-f]{2})")
#: Characters that never need an escape (RFC 3986, fixed values).
UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
#: Characters with a meaning in some part of a URL (RFC 3986, fixed values).
RESERVED = frozenset(":/?#[]@!$&'()*+,;=")
#: Characters that each kind of escaping encodes beside the unsafe ones (fixed values).
MASKS = {"RESERVED": frozenset("#$&+,/:;=?@[]"), "AUTH": frozenset("#/?"), "PATH": frozenset("#?"), "QUERY": frozenset("#"), "FRAGMENT": frozenset()}
#: Printable characters that a URL never holds bare (fixed values).
UNSAFE = frozenset(' "<>\\^`{|}')
_DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}


@dataclass(frozen=True)
class Url:
    scheme: str = ""
    userinfo: str = ""
    host: str = ""
    port: str = ""
    path: str = ""
    query: str = ""
    fragment: str = ""
    has_authority: bool = False
    literal: bool = False  # the host stood in brackets

    @property
    def authority(self) -> str:
        host = f"[{self.host}]" if self.literal else self.host
        return (f"{self.userinfo}@" if self.userinfo else "") + host + (f":{self.port}" if self.port else "")

    def text(self) -> str:
        return (f"{self.scheme}:" if self.scheme else "") + (f"//{self.authority}" if self.has_authority else "") + self.path + self.query + self.fragment

    @property
    def absolute(self) -> bool:
        return bool(self.scheme)


class UrlError(ValueError):
    pass


def _authority(s: str, scheme: str) -> dict:
    userinfo, at, rest = s.rpartition("@")
    if rest.startswith("["):
        host, close, tail = rest[1:].partition("]")
        if not close or not _V6.fullmatch(host):
            raise UrlError("bad address in brackets")
        port = tail[1:] if tail.startswith(":") else ""
        literal = True
    else:
        host, colon, port = rest.partition(":")
        literal = False
        if colon and not port or (not host and (colon or at)):
            raise UrlError("empty host or port")
        if host and not _NAME.fullmatch(host) and host.isascii():
            raise UrlError("bad host")
    if port and not (_PORT.fullmatch(port) and 0 < int(port) < 65536):
        raise UrlError("bad port")
    if not host and scheme not in ("", "file"):
        raise UrlError("no host")
    return {"userinfo": userinfo, "host": host, "port": port, "literal": literal}


def parse(s: str) -> Url:
    """The parts of ``s``; query and fragment keep their mark.  Raises UrlError."""
    m = _PARTS.fullmatch(s)
    scheme, authority, path, query, fragment = (m[i] or "" for i in range(1, 6))
    if m[1] is not None and not _SCHEME.fullmatch(scheme):
        raise UrlError("bad scheme")
    url = Url(scheme=scheme.lower(), path=escape(path), query=escape(query), fragment=escape(fragment), has_authority=m[2] is not None)
    return replace(url, **_authority(authority[2:], url.scheme)) if url.has_authority else url


def escape(s: str, also: frozenset = frozenset()) -> str:
    """Percent-encode what a URL may not hold, and ``also``; valid escapes stay."""
    out, i = [], 0
    while i < len(s):
        c = s[i]
        if c == "%" and _HEX.match(s, i):
            out.append(s[i : i + 3])
            i += 3
            continue
        if c in UNSAFE or c in also or not " " < c < "\x7f" or c == "%":
            out.extend(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
        else:
            out.append(c)
        i += 1
    return "".join(out)


def escape_reserved_unsafe(s: str) -> str:
    return escape(s, MASKS["RESERVED"])


def unescape(s: str, only: frozenset | None = None) -> str:
    """Decode escapes, or those of the characters ``only``; %00 stays."""
    if only is not None:
        return _HEX.sub(lambda m: c if (c := chr(int(m[1], 16))) in only else m[0], s)
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: m[0] if m[1] == b"00" else bytes([int(m[1], 16)]), s.encode("utf-8", "surrogatepass"))
    return raw.decode("utf-8", "replace")


def unescape_not(s: str, kept: frozenset) -> str:
    """Decode escapes but those of ``kept`` and of what a URL may not hold bare; those get upper-case digits."""

    def one(m):
        c = chr(int(m[1], 16))
        return m[0].upper() if c in kept or c in UNSAFE or c == "%" or not " " < c < "\x7f" else c

    return _HEX.sub(one, s)


def unescape_safe(s: str) -> str:
    """Decode escapes of characters that never need one."""
    return unescape(s, UNRESERVED)


_V4 = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_FUTURE = re.compile(r"v[0-9A-Fa-f]+\.[A-Za-z0-9._~!$&'()*+,;=:-]+")


def valid_host(host: str) -> bool:
    """A name, an IPv4 or IPv6 address, or an address of a future kind."""
    host = unescape_safe(host)
    if re.fullmatch(r"[\d.]+", host) and host.count(".") == 3:
        return bool(_V4.fullmatch(host))
    if _NAME.fullmatch(host) or (host and not host.isascii() and not re.search(r"[\s/?#:@\[\]]", host)):
        return True
    if _FUTURE.fullmatch(host):
        return True
    try:
        ipaddress.IPv6Address(host)
    except ValueError:
        return False
    return True


def syntax_ok(u: Url) -> bool:
    """Could the parts stand in one URL text?"""
    if u.has_authority and u.path and not u.path.startswith("/"):
        return False
    if re.search("[:/?#]", u.scheme) or re.search("[/?#]", u.host) or re.search("[?#]", u.path) or "#" in u.query:
        return False
    return not u.has_authority or not u.host or valid_host(u.host)


def parts_ok(u: Column) -> Column:
    """The same for a column of parts, by JVM expressions (hosts by their characters)."""
    path = ~(u["has_authority"] & (u["path"] != "") & ~u["path"].startswith("/"))
    marks = ~(u["scheme"].rlike("[:/?#]") | u["host"].rlike(r"[/?#\s]") | u["path"].rlike("[?#]") | u["query"].contains("#"))
    return F.coalesce(path & marks, F.lit(False))


def url_text(u: Column) -> Column:
    """The text of a column of parts."""
    authority = F.concat(F.when(u["userinfo"] != "", F.concat(u["userinfo"], F.lit("@"))).otherwise(""), u["host"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""))
    scheme = F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise("")
    return F.concat(scheme, F.when(u["has_authority"], F.concat(F.lit("//"), authority)).otherwise(""), u["path"], u["query"], u["fragment"])


def normal_escapes(s: str) -> str:
    """Unreserved characters bare, all other escapes in upper case."""
    return _HEX.sub(lambda m: c if (c := chr(int(m[1], 16))) in UNRESERVED else m[0].upper(), s)


def normal_path(path: str) -> str:
    """Without empty, ``.`` and ``x/..`` segments; what climbs above the start stays."""
    if not path:
        return ""
    segments: list[str] = []
    parts = [p for p in path.split("/") if p]
    for p in parts:
        if p == ".." and segments and segments[-1] != "..":
            segments.pop()
        elif p != "." or (p == "." and len(parts) == 1 and not path.startswith("/")):
            segments.append(p)
    directory = path.endswith("/") or (parts and parts[-1] in (".", "..") and segments[-1:] not in ([".."], ["."]))
    body = "/".join(segments)
    head = "/" if path.startswith("/") else ""
    return head + body + ("/" if directory and body else "")


@lru_cache(maxsize=65536)
def normalize(s: str) -> str:
    """The canonical text of ``s``.  Raises UrlError, also for schemes without a host."""
    u = parse(s)
    if u.scheme and not u.has_authority:
        raise UrlError("no authority")
    host = "".join(c.lower() if c.isascii() else c for c in normal_escapes(u.host))
    path = normal_path(normal_escapes(u.path))
    if u.has_authority and not path:
        path = "/"
    return replace(
        u, host=host, userinfo=normal_escapes(u.userinfo), path=path, query=normal_escapes(u.query), fragment=normal_escapes(u.fragment)
    ).text()


def merge(base: str, ref: str) -> str:
    """``ref`` as seen from ``base`` (absolute), after RFC 3986 section 5.2, normalised."""
    b, r = parse(base), parse(ref)
    if not b.absolute:
        raise UrlError("base is not absolute")
    if r.absolute:
        return normalize(ref)
    if r.has_authority:
        out = replace(r, scheme=b.scheme)
    elif not r.path:
        out = replace(b, query=r.query or b.query, fragment=r.fragment)
    else:
        path = r.path if r.path.startswith("/") else (b.path.rpartition("/")[0] + "/" + r.path if b.path else "/" + r.path)
        out = replace(b, path=path, query=r.query, fragment=r.fragment)
    return normalize(out.text())


def _try(f, *args):
    try:
        return f(*args)
    except UrlError:
        return None


PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("scheme", "userinfo", "host", "port", "path", "query", "fragment")] + [T.StructField("has_authority", T.BooleanType())])


@F.pandas_udf(PARTS)
def url_parts(s: pd.Series) -> pd.DataFrame:
    rows = [u and (u.scheme, u.userinfo, u.host, u.port, u.path, u.query, u.fragment, u.has_authority) for u in (x if x is None else _try(parse, x) for x in s)]
    return pd.DataFrame([r or (None,) * 8 for r in rows], columns=PARTS.names)


@F.pandas_udf(T.StringType())
def url_normalize(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _try(normalize, x), na_action="ignore")


@F.pandas_udf(T.StringType())
def url_merge(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or r is None else _try(merge, b, r) for b, r in zip(base, ref)], dtype=object)


@F.pandas_udf(T.StringType())
def url_unescape(s: pd.Series) -> pd.Series:
    return s.map(unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def url_escape(s: pd.Series) -> pd.Series:
    return s.map(escape, na_action="ignore")


def url_escape_mask(mask: str):
    """A Column function that also escapes the characters of the mask (RESERVED, AUTH, PATH, QUERY, FRAGMENT)."""
    also = MASKS[mask]

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: escape(x, also), na_action="ignore")

    return run


def url_equals(a: Column, b: Column) -> Column:
    return url_normalize(a) == url_normalize(b)


def url_fast(c: Column) -> Column:
    """Parts of a clean absolute URL by JVM expressions only; empty strings where a part is missing."""
    pattern = r"^([^:/?#]+)://([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = {"scheme": 1, "host": 2, "port": 3, "path": 4, "query": 5, "fragment": 6}
    return F.struct(*[F.regexp_extract(c, pattern, i).alias(n) for n, i in part.items()])


def default_port(scheme: Column) -> Column:
    return F.coalesce(*[F.when(scheme == s, F.lit(p)) for s, p in _DEFAULT_PORTS.items()])


def http_only(urls: Column) -> Column:
    """Does the ingest filter keep the line: an absolute http URL with a host?"""
    return F.coalesce(urls.rlike(r"^(?i:http)://[^/?#:@]+"), F.lit(False))
