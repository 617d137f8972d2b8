"""Search and signal services as data sources of Spark: spark.read.format("tessera_search") and ("tessera_signals").

A service is a client that tasks build themselves, named by the option `client` as "module:factory"; the factory gets the
option `settings`, JSON text. Filters on the key (= and IN) say what is asked, position < n says how many hits the service
shall give; both are pushed down, so that nothing else is fetched. Keys are dealt out to partitions, each key is tried
`attempts` times, and a key that fails becomes a row with `error` (at position 0, so that a limit keeps it) while all others go on. Load a frame for each query: Spark keeps a reader's pushed filters when the
same frame is read again without any.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

from tessera.operators import enrich

HITS = "query string, position int, item_id long, title string, artist string, album string, error string, attempts int"
# Names of the raw fields of a service's endpoints.
SIGNALS = "item_id long, total long, hotCount long, likedCount long, liked_count long, subCount long, shareCount long, pop double, followers long, followCount long, url string, code int, fee int, level string, bitrate long, error string, attempts int"


class Client(Protocol):
    def search(self, query: str, limit: int) -> list[dict]: ...

    def signals(self, item_id: int) -> dict: ...


class Fixture:
    """A service in memory, by its settings: `lists` by query in lower case, `default`, `signals` by id, `broken` keys that fail."""

    def __init__(self, settings: dict):
        self.lists, self.default = {k.lower(): v for k, v in settings.get("lists", {}).items()}, settings.get("default", [])
        self.known, self.broken = settings.get("signals", {}), set(map(str, settings.get("broken", [])))

    def search(self, query: str, limit: int) -> list[dict]:
        if query in self.broken:
            raise ConnectionError(f"no answer for {query}")
        return self.lists.get(query.lower(), self.default)[:limit]

    def signals(self, item_id: int) -> dict:
        if str(item_id) in self.broken:
            raise ConnectionError(f"no answer for {item_id}")
        return self.known.get(str(item_id), {})


def client_of(options: dict) -> Client:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(json.loads(options.get("settings", "{}")))


class Keys(InputPartition):
    def __init__(self, keys: list):
        super().__init__(0)
        self.keys = keys


class ServiceReader(DataSourceReader):
    """Reads what pushed filters ask for; `key` is the column that they name."""

    def __init__(self, options: dict, key: str, columns: list[str]):
        self.options, self.key, self.columns = dict(options), key, columns
        self.asked: list | None = None
        self.limit = int(self.options.get("limit", 12))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            at = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and at == (self.key,):
                values = list(f.value) if isinstance(f, In) else [f.value]
                self.asked = [v for v in values if self.asked is None or v in self.asked]
            elif isinstance(f, LessThan) and at == ("position",):
                self.limit = min(self.limit, int(f.value))
            elif isinstance(f, LessThanOrEqual) and at == ("position",):
                self.limit = min(self.limit, int(f.value) + 1)
            else:
                yield f

    def partitions(self) -> list[Keys]:
        if self.asked is None:
            raise ValueError(f"say what to ask for: a filter {self.key} = ... or {self.key} IN (...)")
        keys = list(dict.fromkeys(v for v in self.asked if v is not None))
        size = int(self.options.get("keys_per_partition", 50))
        return [Keys(keys[i : i + size]) for i in range(0, len(keys), size)]

    def read(self, partition: Keys) -> Iterator[tuple]:
        client = client_of(self.options)
        for key in partition.keys:
            rows, error, attempts = tried(lambda k=key: self.fetch(client, k), self.options)
            for row in rows or [{}]:
                if rows or error:
                    out = {"position": 0, **row, self.key: key, "error": error, "attempts": attempts}
                    yield tuple(out.get(c) for c in self.columns)

    def fetch(self, client: Client, key) -> list[dict]:
        raise NotImplementedError


def tried(fetch, options: dict) -> tuple[list[dict], str | None, int]:
    """(rows, error, attempts): an error only once all attempts have failed."""
    most, pause = int(options.get("attempts", 3)), float(options.get("pause", 0.05))
    for attempt in range(1, most + 1):
        try:
            return fetch(), None, attempt
        except Exception as e:  # the service is not ours: whatever it raises is the key's result, as a row
            error = f"{type(e).__name__}: {e}"
            if attempt < most:
                time.sleep(pause * 2 ** (attempt - 1))
    return [], error, most


class SearchReader(ServiceReader):
    def fetch(self, client: Client, key) -> list[dict]:
        kept = []
        for hit in client.search(key, self.limit)[: self.limit]:
            try:
                item = int(hit.get("item_id"))
            except (TypeError, ValueError):
                item = 0
            if item:  # hits without an id can't be told apart; their places stay empty
                kept.append({"position": len(kept), "item_id": item, **{c: str(hit.get(c) or "").strip() for c in ("title", "artist", "album")}})
        return kept


class SignalReader(ServiceReader):
    def fetch(self, client: Client, key) -> list[dict]:
        return [client.signals(key)]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_search"

    def schema(self) -> str:
        return HITS

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options, "query", _names(HITS))


class SignalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_signals"

    def schema(self) -> str:
        return SIGNALS

    def reader(self, schema) -> SignalReader:
        return SignalReader(self.options, "item_id", _names(SIGNALS))


def register(spark: SparkSession) -> None:
    """Make both formats known to the session; pushed filters are switched on, as keys come by them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
    spark.dataSource.register(SignalSource)


def search_all(asked: DataFrame, client: str, settings: str = "{}", **options: str) -> DataFrame:
    """HITS with the limit asked for, for a table of (query, limit): the way for more queries than a filter should name.

    Each task asks for its own rows; a query that fails is a row with `error`, one without hits has no row.
    """
    said = {"client": client, "settings": settings, **options}
    columns = _names(HITS)

    def run(batches):
        import pandas as pd

        service = client_of(said)
        reader = SearchReader(said, "query", columns)
        for batch in batches:
            out = []
            for query, limit in zip(batch["query"], batch["limit"]):
                reader.limit = int(limit)
                rows, error, attempts = tried(lambda q=query: reader.fetch(service, q), said)
                for row in rows or [{}]:
                    if rows or error:
                        out.append(tuple({"position": 0, **row, "query": query, "error": error, "attempts": attempts}.get(c) for c in columns) + (int(limit),))
            yield pd.DataFrame(out, columns=[*columns, "limit"]).astype({"position": "Int32", "item_id": "Int64"})

    return asked.select("query", "limit").distinct().mapInPandas(run, f"{HITS}, `limit` int")


def as_signals(raw: DataFrame) -> DataFrame:
    """Raw fields as signals (item_id, comments, hot, red, followers, playable, audio); failed ids have none."""
    c = F.col
    red = F.coalesce(F.nullif(c("likedCount"), F.lit(0)), F.nullif(c("liked_count"), F.lit(0)), F.nullif(c("subCount"), F.lit(0)), c("shareCount"), c("pop").cast("long"))
    known = c("url").isNotNull() | c("code").isNotNull() | c("fee").isNotNull()
    return raw.where("error IS NULL").select(
        "item_id", c("total").alias("comments"), c("hotCount").alias("hot"), red.alias("red"), enrich.first_truthy(c("followers"), c("followCount")).alias("followers"),
        F.when(known, enrich.playable(c("url"), c("code"), c("fee"))).alias("playable"), enrich.audio_grade(c("level"), c("bitrate")).alias("audio"),
    )
