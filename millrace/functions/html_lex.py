"""HTML pages as text, links and metadata, in one forward scan and one Arrow-batched UDF.

A scan takes time in proportion to the page: a search that has failed once is not made again.
``mode='observed'`` reproduces known quirks: any prefix of ``script`` begins a script, the
construct after a script's end is swallowed, unquoted values that are names are ignored,
attributes match by the prefixes ``href``, ``src`` and ``rel``, and the text of a nofollow link
leaks into the next link.

Text collection starts on; ``script`` and ``style`` turn it off, their ends and ``body`` on;
``title`` is collected and turns it off at its end.  Tags of BREAKS put a line feed where
text came since the last one.  Links are resolved against the base; those that cannot be
are dropped, as are ``rel=nofollow`` ones.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from millrace.functions.text import replace_all_entities
from millrace.functions.url import UrlError, merge, normalize, parse

#: Tags at which a word ends (fixed values).
BREAKS = frozenset(
    "applet base blockquote br button caption dd div dfn dl dt fieldset form frame h1 head hr img input li link map menu noframes object ol optgroup option p param pre q "
    "samp select table tbody td textarea tfoot th thead tr tt ul xmp body title".split()
)
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:._-]*")
_STOP = re.compile("[>\"']")
_COMMENT_END = re.compile(r"--\s*>")
_SCRIPT_END = re.compile(r"</script\s*>", re.IGNORECASE)
_ATTR = re.compile(r"([A-Za-z_:][A-Za-z0-9:._-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_REFRESH = re.compile(r"\d+; url=(.+)", re.IGNORECASE)
_LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("txt", T.StringType())])
RESULT = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(_LINK))]
    + [T.StructField(n, T.StringType()) for n in ("warnings", "title", "rss2", "rss", "atom", "charset")]
    + [T.StructField(n, T.BooleanType()) for n in ("index", "follow")]
)


class _Page:
    def __init__(self, base: str, observed: bool = False):
        if base and not _absolute(base):
            raise UrlError("base is not absolute")
        self.observed = observed
        self.base, self.out, self.title, self.links, self.warnings = base, [], [], [], []
        self.on, self.in_title, self.fresh = True, False, False
        self.href: str | None = None
        self.anchor: list[str] = []
        self.nofollow = False
        self.meta = {"rss2": "", "rss": "", "atom": "", "charset": "", "index": True, "follow": True}

    def resolve(self, url: str) -> str | None:
        url = url.strip()
        if not self.base:
            return url
        try:
            return normalize(url) if _absolute(url) else merge(self.base, url)
        except UrlError as e:
            self.warnings.append(f'link: "{url}": {e}')
            return None

    def break_(self) -> None:
        if self.href is not None:
            self.anchor.append(" ")
        elif self.on and (self.fresh or not self.out):
            self.out.append("\n")
            self.fresh = False

    def data(self, s: str) -> None:
        if not self.on or not s:
            return
        s = replace_all_entities(s)
        self.out.append(s)
        self.fresh = True
        if self.in_title:
            self.title.append(s)
        if self.href is not None:
            self.anchor.append(s)

    def close_link(self) -> None:
        if self.href is None:
            return
        if not self.nofollow:
            url = self.resolve(self.href)
            if url:
                self.links.append((url, "".join(self.anchor).strip()))
        leak = self.anchor if self.observed and self.nofollow else []
        self.href, self.anchor, self.nofollow = None, leak, False

    def attributes(self, rest: str) -> dict[str, str]:
        found = {}
        for m in _ATTR.finditer(rest):
            name = m[1].lower()
            if self.observed:
                if m[4] is not None and _NAME.fullmatch(m[4]):
                    continue
                name = next((p for p in ("href", "src", "rel") if name.startswith(p)), name)
            found[name] = replace_all_entities(m[2] or m[3] or m[4] or "")
        return found

    def start(self, name: str, rest: str) -> None:
        attrs = self.attributes(rest) if rest.strip() else {}
        if name == "body":
            self.on = True
        elif name == "title":
            self.on = self.in_title = True
        if name in BREAKS:
            self.break_()
        if name == "style":
            self.on = False
        elif name == "a" and self.on and "href" in attrs:
            self.close_link()
            self.href, self.nofollow = attrs["href"], "nofollow" in attrs.get("rel", "").lower().split()
        elif name in ("frame", "iframe") and "src" in attrs:
            url = self.resolve(attrs["src"])
            if url:
                self.links.append((url, ""))
        elif name == "link" and attrs.get("rel", "").lower() == "alternate":
            kind = {"application/rss+xml": "rss2", "application/atom+xml": "atom", "text/xml": "rss"}.get(attrs.get("type", "").lower())
            if kind and attrs.get("href"):
                self.meta[kind] = self.resolve(attrs["href"]) or attrs["href"].strip()
        elif name == "meta":
            self.metadata(attrs)

    def metadata(self, attrs: dict[str, str]) -> None:
        content, equiv = attrs.get("content", ""), attrs.get("http-equiv", "").lower()
        if attrs.get("name", "").lower() == "robots":
            for word in re.split(r"[,\s]+", content.lower()):
                if word in ("all", "none"):
                    self.meta["index"] = self.meta["follow"] = word == "all"
                    break
                if word in ("index", "noindex"):
                    self.meta["index"] = word == "index"
                elif word in ("follow", "nofollow"):
                    self.meta["follow"] = word == "follow"
        elif equiv == "content-type":
            m = re.search(r"charset=([^\s;,\"']+)", content)
            self.meta["charset"] = m[1] if m else self.meta["charset"]
        elif equiv == "refresh" and (m := _REFRESH.fullmatch(content.strip())):
            url = self.resolve(m[1])
            if url:
                self.links.append((url, ""))

    def end(self, name: str) -> None:
        if name == "body":
            self.on = False
        elif name == "style":
            self.on = True
        elif name == "title":
            self.on = self.in_title = False
        elif name == "a":
            self.close_link()
        elif name in BREAKS:
            self.break_()


def _absolute(url: str) -> bool:
    try:
        return parse(url).absolute
    except UrlError:
        return False


def _scan(page: str, observed: bool = False):
    """(text before, name, is an end tag, rest of the tag) for each construct; without a name for comments and the like.

    What is no markup stays in the text, as does a comment or a tag that the page's end cuts.
    A script, from its tag to its end tag, is one construct named ``</script>``; one without an
    end takes the rest of the page.
    """
    begin = at = 0
    last = {c: page.rfind(c) for c in ">]\"'"}
    no_comment = no_cdata = False
    while (lt := page.find("<", at)) >= 0 and lt < last[">"]:
        at = lt + 1
        m = _NAME.match(page, lt + 2 if page.startswith("</", lt) else lt + 1)
        if m:
            end = _tag_end(page, m.end(), last)
            if end < 0:
                break
            name, closes = m[0].lower(), page[lt + 1] == "/"
            if not closes and (name == "script" or (observed and "script".startswith(name))):
                close = _SCRIPT_END.search(page, end)
                yield page[begin:lt], "</script>" if close else "", False, ""
                if not close:
                    return
                begin = at = close.end()
                continue
            yield page[begin:lt], name, closes, page[m.end() : end - 1]
            begin = at = end
            continue
        if page.startswith("<!--", lt):
            close = None if no_comment else _COMMENT_END.search(page, lt + 4)
            no_comment = close is None
            end = close.end() if close else -1
        elif page.startswith("<![CDATA[", lt):
            end = -1 if no_cdata else page.find("]]>", lt) + 3
            no_cdata, end = end < lt, end if end > lt else -1
        elif page.startswith(("<?", "<>", "</>"), lt):
            end = page.find(">", lt) + 1
        elif page.startswith("<!", lt) and page[lt + 2 : lt + 3].isalpha():
            gt, bracket = page.find(">", lt), page.find("[", lt, page.find(">", lt))
            if bracket >= 0 and bracket < last["]"]:
                gt = page.find(">", page.find("]", bracket))
            end = gt + 1 if gt >= 0 else -1
        else:
            end = -1
        if end > lt:
            yield page[begin:lt], "", False, ""
            begin = at = end
    yield page[begin:], "", False, ""


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    while m := _STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        if m.start() < last[m[0]]:  # else a quote that nothing closes
            at = page.find(m[0], at) + 1
    return -1


def html_lex(page: str, base: str = "", mode: str = "documented") -> dict:
    observed = mode == "observed"
    p, swallow = _Page(base, observed), False
    for text, name, end, rest in _scan(page, observed):
        p.data(text)
        if name == "</script>":
            p.on, swallow = True, observed
        elif swallow and name:  # the end token that waits takes this construct with it
            swallow = False
        elif name:
            (p.end(name) if end else p.start(name, rest))
    out = "".join(p.out)
    return {"text": out, "links": p.links, "warnings": "\n".join(p.warnings), "title": "".join(p.title), **p.meta}


def _rows(html, base, mode: str) -> list[dict]:
    rows = []
    for h, b in zip(html, base):
        try:
            r = None if h is None else html_lex(h, b or "", mode)
        except UrlError as e:
            r = {"warnings": str(e)}
        rows.append(r or {})
    return rows


def _lexed(html: pd.Series, base: pd.Series, mode: str) -> pd.DataFrame:
    rows = _rows(html, base, mode)
    return pd.DataFrame({n: [_links(r) if n == "links" else r.get(n) for r in rows] for n in RESULT.names})


def _links(row: dict) -> list[dict] | None:
    return [{"url": u, "txt": t} for u, t in row["links"]] if "links" in row else None


def lexed_arrow(html: pa.Array, base: pa.Array, fields: Sequence[str]) -> pa.Array:
    """The named fields of RESULT as an Arrow struct, for one slice of rows."""
    rows = _rows(html.to_pylist(), base.to_pylist(), "documented")
    link = pa.struct([("url", pa.string()), ("txt", pa.string())])
    kinds = {"links": pa.list_(link), "index": pa.bool_(), "follow": pa.bool_()}
    return pa.StructArray.from_arrays([pa.array([_links(r) if n == "links" else r.get(n) for r in rows], kinds.get(n, pa.string())) for n in fields], names=list(fields))


def _lex(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return _lexed(html, base, "documented")


def _lex_observed(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return _lexed(html, base, "observed")


#: (html, base) -> RESULT.  Marked so that filters on its fields do not run it again.  These hold
#: a whole Arrow batch and its results at once; ``links.analysed`` goes through it in slices.
lex = F.pandas_udf(_lex, RESULT).asNondeterministic()
lex_observed = F.pandas_udf(_lex_observed, RESULT).asNondeterministic()
