"""Entities, character sets, sniffing, formatting, HTTP headers, robots.txt."""

from __future__ import annotations

import html.entities
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from millrace.functions.url import escape, unescape

_NAMED = {n: chr(c) for n, c in html.entities.name2codepoint.items()} | {"apos": "'", "QUOT": '"', "AMP": "&", "COPY": "\xa9", "GT": ">", "LT": "<", "REG": "\xae"}


def code_point(n: int) -> str:
    """The character, or nothing where Unicode defines none."""
    return chr(n) if 0 <= n <= 0x10FFFF and unicodedata.category(chr(n)) not in ("Cn", "Cs") else ""


def replace_char_entities(s: str) -> str:
    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: _NAMED.get(m[1], ""), s)


def replace_all_entities(s: str) -> str:
    """Named, then decimal, then hexadecimal references; unknown ones go; the semicolon is needed."""
    if "&" not in s:
        return s
    s = replace_char_entities(s)
    s = re.sub(r"&#([0-9]+);", lambda m: code_point(int(m[1])) if len(m[1]) < 9 else "", s)
    return re.sub(r"&#x([0-9A-Fa-f]+);", lambda m: code_point(int(m[1], 16)) if len(m[1]) < 9 else "", s)


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(replace_all_entities, na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_case(s: pd.Series) -> pd.Series:
    """Full Unicode case folding."""
    return s.map(str.casefold, na_action="ignore")


def transcode(encoding: str):
    """A Column function from bytes in ``encoding`` to text; bytes that do not fit become U+FFFD."""

    @F.pandas_udf(T.StringType())
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode(encoding, "replace"), na_action="ignore")

    return run


def looks_ascii(c: Column) -> Column:
    """Only printable ASCII, escape and the usual white space and controls (no vertical tab)."""
    return c.rlike(r"\A[\x07-\x0A\x0C\x0D\x1B\x20-\x7E]*\z")


def _bytes_like(b: Column, more: str) -> Column:
    return F.decode(b, "ISO-8859-1").rlike(r"\A[\x07-\x0A\x0C\x0D\x1B\x20-\x7E\x85" + more + r"]*\z")


def looks_latin1(b: Column) -> Column:
    """Bytes of text in ISO 8859: the same, next line, and 0xA0 to 0xFF."""
    return _bytes_like(b, r"\xA0-\xFF")


def looks_extended(b: Column) -> Column:
    """Bytes of text in an extended code page: 0x80 to 0x9F too."""
    return _bytes_like(b, r"\x80-\xFF")


def is_valid_utf8(b: Column) -> Column:
    return F.is_valid_utf8(b.cast("string"))


# integers and times


def int_read(b: Column, width: int = 8) -> Column:
    """The signed big-endian integer of the first ``width`` bytes (1 to 8)."""
    unsigned = F.conv(F.hex(F.substring(b, 1, width)), 16, 10).cast("decimal(20,0)")
    top = F.lit(str(2 ** (8 * width - 1))).cast("decimal(20,0)")  # as text: beyond a long for 8 bytes
    return F.when(unsigned >= top, unsigned - F.lit(str(2 ** (8 * width))).cast("decimal(20,0)")).otherwise(unsigned).cast("long")


def int_put(n: Column, width: int = 8) -> Column:
    """``width`` big-endian bytes of an integer, negative ones as two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * width)))


def clock(ts: Column) -> Column:
    """Hours, minutes and seconds without leading zeros."""
    return F.concat_ws(":", F.hour(ts), F.minute(ts), F.second(ts))


def whole_seconds(usec: Column) -> Column:
    """Whole seconds of a time in microseconds, towards zero."""
    return ((usec - usec % 1_000_000) / 1_000_000).cast("long")


def round_seconds(usec: Column) -> Column:
    return usec - usec % F.lit(1_000_000)


def format_timediff(usec: Column) -> Column:
    """Up to ten seconds seconds and all microseconds, below a minute seconds, else hours and minutes."""
    s = whole_seconds(usec)
    minutes, hours = F.pmod(((s - s % 60) / 60).cast("long"), F.lit(60)), ((s - s % 3600) / 3600).cast("long")
    return F.when(s <= 10, F.format_string("%d s %d us", s, usec)).when(s < 60, F.format_string("%d s", s)).otherwise(F.format_string("%d h %d m", hours, minutes))


@F.pandas_udf(T.BooleanType())
def looks_utf8(b: pd.Series) -> pd.Series:
    """Valid UTF-8 with a character beyond ASCII and no odd control; a cut last character is let pass."""

    def one(x) -> bool:
        x = bytes(x)
        for cut in range(4):
            try:
                s = x[: len(x) - cut].decode()
            except UnicodeDecodeError:
                continue
            return not s.isascii() and not re.search(r"[\x00-\x06\x0e-\x1a\x1c-\x1f\x7f]", s)
        return False

    return b.map(one, na_action="ignore")


def unicode_bom(b: Column) -> Column:
    """The encoding that a byte order mark names, or null."""
    h = F.hex(b)
    named = [("0000FEFF", "UTF-32BE"), ("FFFE0000", "UTF-32LE"), ("EFBBBF", "UTF-8"), ("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE")]
    out = F.lit(None).cast("string")
    for mark, name in reversed(named):
        out = F.when(h.startswith(mark), F.lit(name)).otherwise(out)
    return out


def pdf_version(c: Column) -> Column:
    """(major, minor) digits of a PDF's first bytes; empty where it is none."""
    return F.struct(F.regexp_extract(c, r"^%PDF-(\d)\.(\d)", 1).alias("major"), F.regexp_extract(c, r"^%PDF-(\d)\.(\d)", 2).alias("minor"))


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x09\x0E-\x1F\x7F]", "")


def _scaled(labels: list[str]):
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        def one(v: float) -> str:
            i = 0
            while v > 1000 and i < len(labels) - 1:
                v, i = v / 1000, i + 1
            return f"{v:.2f} {labels[i]}"

        return values.map(one, na_action="ignore")

    return run


#: Units, smallest first (fixed values).
_BYTES = ["iB", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
_SPEED = ["KB/s", "MB/s", "GB/s", "TB/s"]


def fmt_bytes(c: Column) -> Column:
    """Two decimals and a unit, rounded as C's printf does: by the exact binary value (Java's format rounds the decimal form)."""
    return _scaled(_BYTES)(c.cast("double"))


def fmt_kbytes_s(c: Column) -> Column:
    return _scaled(_SPEED)(c.cast("double"))


def hex_dump(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(c), "(..)(?!$)", "$1 "))


def shard_path(key: Column) -> Column:
    """Where a keyed blob lives: two directory levels of its SHA-1, then the rest."""
    h = F.sha1(key.cast("binary"))
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.substring(h, 5, 36))


# HTTP headers

_LINE = r"^([^\x00-\x20()<>@,;:\\\"/\[\]?={}\x7F]+):(.*)$"


def http_headers(c: Column, mode: str = "documented") -> Column:
    """MAP of header names to values, which keep their leading space; the last of equal names wins.

    ``observed`` leaves out a last line that no line end follows.
    """
    c = F.regexp_replace(c, r"[^\r\n]+\z", "") if mode == "observed" else c
    lines = F.filter(F.split(c, r"[\r\n]+"), lambda x: x.rlike(_LINE))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, _LINE, 1).alias("k"), F.regexp_extract(x, _LINE, 2).alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])) == 0)
    return F.map_from_entries(last)


def content_type(value: Column, mode: str = "documented") -> Column:
    """The class of a Content-Type value, by name.

    ``observed`` takes all that is neither HTML nor plain text, and does not begin with the
    XHTML type, for XHTML.
    """
    if mode == "observed":
        other = F.when(value.startswith("application/xhtml+xml"), "UNRECOGNIZED").otherwise("XHTML")
        return F.when(value.isNotNull(), F.when(value.contains("text/html"), "TEXT_HTML").when(value.contains("text/plain"), "TEXT_PLAIN").otherwise(other))
    out = F.lit("UNRECOGNIZED")
    kinds = [("text/html", "TEXT_HTML"), ("text/plain", "TEXT_PLAIN"), ("application/xhtml+xml", "XHTML"), ("application/pdf", "APPLICATION_PDF"), ("application/rss+xml", "RSS_XML"), ("application/atom+xml", "ATOM_XML")]
    for text, name in reversed(kinds):
        out = F.when(value.contains(text), F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def charset(value: Column) -> Column:
    return F.regexp_extract(value, r"charset=([^()<>@,;:\\\"/\[\]?={}\x00-\x20\x7F]+)", 1)


# robots.txt

_RULE = T.StructType([T.StructField("type", T.StringType()), T.StructField("path", T.StringType())])
ROBOTS = T.ArrayType(T.StructType([T.StructField("ua", T.ArrayType(T.StringType())), T.StructField("rules", T.ArrayType(_RULE))]))


def _canonical(path: str) -> str:
    kept = frozenset("/%")
    decoded = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: m[0].upper() if (c := chr(int(m[1], 16))) in kept or not c.isprintable() or ord(c) > 126 or c in '<>"' else c, path)
    return escape(decoded)


@lru_cache(maxsize=4096)
def robots_rules(text: str) -> list[tuple[list[str], list[tuple[str, str]]]] | None:
    """Groups of (agents, rules) in file order; null where the body is markup, not rules."""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    open_ = False
    for line in re.split(r"[\r\n]+", text):
        line = line.partition("#")[0].strip()
        if not line:
            continue
        m = re.fullmatch(r"(?i)(user-agent|allow|disallow|crawl-delay)\s*:\s*(.*)", line)
        if not m:
            if not groups and re.match(r"<[a-zA-Z!]", line):
                return None
            continue
        key, value = m[1].lower(), m[2].strip()
        if key == "user-agent":
            if not open_:
                groups.append(([], []))
                open_ = True
            groups[-1][0].append(value)
        elif groups:
            open_ = False
            groups[-1][1].append((key.upper().replace("-", "_"), value if key == "crawl-delay" else _canonical(value)))
    return groups


def path_allowed(groups, agent: str, path: str, mode: str = "documented") -> bool:
    """The first group that names the agent decides by its first matching rule; else allowed.

    ``documented`` matches agents and paths by prefix, ``observed`` by equality.  An empty
    Disallow matches nothing.
    """
    path = _canonical(path)
    exact = mode == "observed"
    for agents, rules in groups or []:
        if not any(a == agent or (not exact and (a == "*" or agent.lower().startswith(a.lower()))) for a in agents if a):
            continue
        for kind, rule in rules:
            if kind != "CRAWL_DELAY" and rule and (path == rule if exact else path.startswith(rule)):
                return kind == "ALLOW"
        return True
    return True


@F.pandas_udf(ROBOTS)
def robots_parse(s: pd.Series) -> pd.Series:
    def one(t: str):
        got = robots_rules(t)
        return None if got is None else [{"ua": a, "rules": [{"type": k, "path": p} for k, p in r]} for a, r in got]

    return s.map(one, na_action="ignore")


def robots_allowed(agent: str, mode: str = "documented"):
    """A Column function (robots text, path) -> boolean; missing or unreadable rules allow."""

    @F.pandas_udf(T.BooleanType())
    def run(text: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([t is None or p is None or path_allowed(robots_rules(t), agent, p, mode) for t, p in zip(text, path)], dtype=object)

    return run


def unescape_all(s: str) -> str:
    return unescape(s)
