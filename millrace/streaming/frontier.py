"""The crawl frontier as keyed state: a first-in first-out queue and a robots entry for each host.

Arrivals are rows of two kinds: a url of the host, or the host's robots.txt.  In each
micro-batch a host whose rows arrive, or whose timer fires, gives its front: one request a
host, as politeness asks.  State is kept by host on the executors, so hosts are dealt out by
hash; that at most N hosts are served at once is a rank over the hosts of a batch (``served``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.text import path_allowed, robots_rules
from millrace.functions.url import UrlError, parse

ARRIVAL = "host string, seq long, url string, robots string"
WAVE = "host string, seq long, url string, stage string, waiting long"


class HostQueue(StatefulProcessor):
    """State of a host: urls not yet given (in order of arrival) and the robots text."""

    def __init__(self, agent: str, every_ms: int = 0):
        self.agent, self.every = agent, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.urls = handle.getListState("urls", "seq long, url string")
        self.robots = handle.getValueState("robots", "text string")

    def _front(self, host: str) -> pd.DataFrame:
        rows = list(self.urls.get())
        text = self.robots.get()[0] if self.robots.exists() else None
        rules = robots_rules(text) if text else None
        out = []
        at = 0
        for at, (seq, url) in enumerate(rows, 1):
            try:
                path = parse(url).path or "/"
            except UrlError:
                continue
            allowed = path_allowed(rules, self.agent, path)
            out.append((host, seq, url, "CONTENT" if allowed else "NEXT", len(rows) - at))
            if allowed:  # what is not allowed goes at once and asks nothing of the host
                break
        if at < len(rows):
            self.urls.put(rows[at:])
            if self.every:
                self.handle.registerTimer(self._now + self.every)
        elif rows:
            self.urls.clear()
        return pd.DataFrame(out, columns=["host", "seq", "url", "stage", "waiting"]).astype({"seq": "int64", "waiting": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._now = timerValues.getCurrentProcessingTimeInMs() if self.every else 0
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        texts = new[new["robots"].notna()]
        if len(texts):
            self.robots.update((texts["robots"].iloc[-1],))
        urls = new[new["url"].notna()]
        if len(urls):
            self.urls.appendList([(int(s), u) for s, u in zip(urls["seq"], urls["url"])])
        yield self._front(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._now = timerValues.getCurrentProcessingTimeInMs()
        yield self._front(key[0])

    def close(self) -> None:
        pass


def waves(arrivals: DataFrame, agent: str, every_ms: int = 0) -> DataFrame:
    """What each host gives (as WAVE) of a stream of ARRIVAL rows; with ``every_ms`` also by timer.

    The session needs a state store with column families (the RocksDB provider).
    """
    mode = "ProcessingTime" if every_ms else "None"
    return arrivals.groupBy("host").transformWithStateInPandas(HostQueue(agent, every_ms), outputStructType=WAVE, outputMode="Update", timeMode=mode)


def served(wave: DataFrame, slots: int) -> DataFrame:
    """Of a batch's wave the rows of at most ``slots`` hosts, by their first arrival; a top-k over hosts."""
    hosts = wave.where("stage = 'CONTENT'").groupBy("host").agg(F.min("seq").alias("__first")).orderBy("__first").limit(slots)
    return wave.join(F.broadcast(hosts.select("host")), "host", "left_semi")
