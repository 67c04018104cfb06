"""URL paths as segments, by JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def path_parts(c: Column) -> Column:
    """struct<segments, abs, dir>: runs of slashes are one; abs and dir tell a slash at the start and at the end."""
    segments = F.filter(F.split(c, "/"), lambda s: s != "")
    return F.struct(segments.alias("segments"), c.startswith("/").alias("abs"), c.endswith("/").alias("dir"))


def path_text(p: Column) -> Column:
    """The text of parts; a lone slash for an absolute path without segments."""
    body = F.array_join(p["segments"], "/")
    return F.concat(F.when(p["abs"], "/").otherwise(""), body, F.when(p["dir"] & (F.size(p["segments"]) > 0), "/").otherwise(""))


def depth(p: Column) -> Column:
    return F.size(p["segments"])


def updir(p: Column) -> Column:
    """One directory up: a file goes with its directory; what has nothing above stays empty."""
    gone = F.when(p["dir"], 1).otherwise(2)
    kept = F.slice(p["segments"], 1, F.greatest(F.size(p["segments"]) - gone, F.lit(0)))
    return F.struct(kept.alias("segments"), p["abs"].alias("abs"), F.when(F.size(p["segments"]) > 0, True).otherwise(p["dir"]).alias("dir"))


def path_merge(base: Column, ref: Column) -> Column:
    """``ref`` as seen from ``base``: an absolute one as it is, else after the base's directory, dots resolved.

    A path that ends with ``.`` or ``..`` is a directory; ``..`` above the start is dropped.
    """
    file = ~base["dir"] & (F.size(base["segments"]) > 0) & (F.size(ref["segments"]) > 0)
    start = F.when(file, F.slice(base["segments"], 1, F.greatest(F.size(base["segments"]) - 1, F.lit(0)))).otherwise(base["segments"])

    def step(a: Column, s: Column) -> Column:
        n = F.size(a["segments"])
        kept = F.when(s == ".", a["segments"]).when(s == "..", F.slice(a["segments"], 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(a["segments"], F.array(s)))
        is_dir = F.when((s == ".") | ((s == "..") & (n > 0)), True).when(s == "..", a["dir"]).otherwise(False)
        return F.struct(kept.alias("segments"), is_dir.alias("dir"))

    merged = F.aggregate(ref["segments"], F.struct(start.alias("segments"), (base["dir"] | file).alias("dir")), step)
    own = F.struct(merged["segments"].alias("segments"), base["abs"].alias("abs"), (merged["dir"] | ref["dir"]).alias("dir"))
    return F.when(ref["abs"], ref).otherwise(own)
