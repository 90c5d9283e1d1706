"""Saved models: an append-only log of what was claimed, saved and dropped, and a table of parameters per save.

Nothing is overwritten and every line has a folder of its own, so writers cannot clash:
the last line about a model counts. An id is claimed by writing a claim and reading all
claims again; who then sees another claim of it withdraws and takes a later number. Of two
writers the one that wrote last sees the other's claim, so no id is given twice.
"""

from __future__ import annotations

import random
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from statloom.session import small_frame
from statloom.sources.published import Log

DEFAULT_ID = "m0"
#: Claims made before an id is refused, and seconds for which a claim without a saved model holds its name.
TRIES, CLAIM_SECONDS = 20, 600


class ModelRegistry:
    """Models of one kind under `base`; works on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, base: str, kind: str):
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{kind}"
        self.log = Log(spark, f"{self.root}/log")

    def entries(self) -> list[dict[str, Any]]:
        """Metadata of every model, ordered by id number."""
        found: dict[str, dict[str, Any]] = {}
        for line in self.log.lines():
            if line["kind"] == "save":
                found[line["id"]] = {**line["metadata"], "id": line["id"], "params": line["params"]}
            elif line["kind"] == "drop":
                found.pop(line["id"], None)
        return sorted(found.values(), key=lambda m: (len(m["id"]), m["id"]))

    def models(self) -> DataFrame:
        """Ids, names and states of every model."""
        rows = [(m["id"], m["name"], m.get("state", 0)) for m in self.entries()]
        return small_frame(self.spark, rows, "id string, name string, state int")

    def find(self, id_or_name: str | None) -> dict[str, Any] | None:
        wanted = id_or_name or DEFAULT_ID
        entries = self.entries()
        for field in ("id", "name"):
            for m in entries:
                if m[field] == wanted:
                    return m
        return None

    def require(self, id_or_name: str | None) -> dict[str, Any]:
        found = self.find(id_or_name)
        if found is None:
            raise KeyError(f"no saved model {id_or_name or DEFAULT_ID!r}")
        return found

    def new_id(self, name: str | None) -> str:
        """The default id without a name, else a number that no other writer has; names are unique."""
        if name is None:
            return DEFAULT_ID
        draw = random.Random(str(uuid.uuid4()))
        for attempt in range(TRIES):
            claims = self._claims()
            fresh = [c for c in claims if time.time_ns() - c["at"] < CLAIM_SECONDS * 10**9]
            if self.find(name) is not None or (not attempt and any(c["name"] == name for c in fresh)):
                raise ValueError(f"a model named {name!r} exists")
            used = [int(x[1:]) for x in [m["id"] for m in self.entries()] + [c["id"] for c in claims] if x[1:].isdigit()]
            wanted = f"m{max([0, *used]) + 1 + (draw.randrange(attempt * 3 + 1))}"
            own = self.log.append(kind="claim", id=wanted, name=name)
            others = [c for c in self._claims() if c["token"] != own["token"]]
            if not any(c["id"] == wanted or (c["name"] == name and own["at"] - c["at"] < CLAIM_SECONDS * 10**9) for c in others):
                return wanted
            self.log.append(kind="withdraw", claim=own["token"])
            time.sleep(draw.random() * 0.2 * (attempt + 1))
        raise RuntimeError(f"no id for {name!r}: {TRIES} claims met others")

    def _claims(self) -> list[dict[str, Any]]:
        """Claims that were neither withdrawn nor followed by a drop of their model."""
        live: dict[str, dict[str, Any]] = {}
        for line in self.log.lines():
            if line["kind"] == "claim":
                live[line["token"]] = line
            elif line["kind"] == "withdraw":
                live.pop(line["claim"], None)
            elif line["kind"] == "drop":
                live = {t: c for t, c in live.items() if c["id"] != line["id"]}
        return list(live.values())

    def save(self, model_id: str, metadata: dict[str, Any], params: DataFrame) -> None:
        """Insert or replace one model; its parameters are written before the line that names them."""
        path = f"{self.root}/params/{model_id}-{uuid.uuid4()}"
        params.write.parquet(path)
        self.log.append(kind="save", id=model_id, metadata={**metadata, "id": model_id}, params=path)

    def params(self, model_id: str) -> DataFrame:
        return self.spark.read.parquet(self.require(model_id)["params"])

    def drop(self, id_or_name: str | None) -> None:
        """The model is gone from every list; all its parameter tables are emptied."""
        found = self.require(id_or_name)
        paths = [x["params"] for x in self.log.lines() if x["kind"] == "save" and x["id"] == found["id"]]
        self.log.append(kind="drop", id=found["id"])
        for path in paths:
            self.spark.range(0).write.mode("overwrite").parquet(path)
