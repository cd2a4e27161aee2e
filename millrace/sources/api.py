"""Records of an HTTP JSON interface as a Spark data source."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def at_path(value: object, path: str) -> object:
    """A dotted path into parsed JSON; None where it ends early."""
    for part in filter(None, path.split(".")):
        value = value[int(part)] if isinstance(value, list) and part.isdigit() and int(part) < len(value) else value.get(part) if isinstance(value, dict) else None
    return value


def as_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class ApiSource(DataSource):
    """format("api"): options url (several separated by spaces are read in parallel), method, body, headers (JSON), dataPath, fields (JSON list of {name, path, alias})."""

    @classmethod
    def name(cls) -> str:
        return "api"

    def schema(self) -> str:
        return ", ".join(f"`{f.get('alias') or f['name']}` string" for f in json.loads(self.options["fields"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ApiReader(dict(self.options))


class ApiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.options["url"].split()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        request = urllib.request.Request(partition.value, method=o.get("method", "GET"), data=o["body"].encode() if o.get("body") else None, headers=json.loads(o.get("headers", "{}")))
        with urllib.request.urlopen(request, timeout=float(o.get("timeout", 30))) as answer:
            found = at_path(json.load(answer), o.get("datapath") or o.get("dataPath") or "")
        for record in found if isinstance(found, list) else [found]:
            yield tuple(as_text(at_path(record, f.get("path") or f["name"])) for f in json.loads(o["fields"]))
