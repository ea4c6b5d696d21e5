"""Tables that a stream adds to, epoch by epoch, and that stay small to read however long it runs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass
class EpochTable:
    """Rows by epoch in runs of epochs. `merge` makes one row of those with one key, of rows that also have their epoch.

    An epoch writes a run of its own; `fan` runs of one level become one of the next, so a table of n epochs has fan *
    log(n) runs at most, and a row is written again log(n) times. What an epoch's table consists of is a list of runs,
    which is written last: a run without a list doesn't count. An epoch that runs again starts from the list before it
    and replaces its own. Lists before the last `keep` go, with the runs that no list names any more.
    """

    spark: SparkSession
    path: str
    schema: StructType
    merge: Callable[[DataFrame], DataFrame]
    fan: int = 4
    keep: int = 3

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def epochs(self) -> list[int]:
        """Epochs whose lists are kept."""
        return [int(n.removesuffix(".json")) for n in self._names("lists") if n.endswith(".json") and n[0] != "."]

    def runs(self, before: int | None = None) -> list[dict]:
        """The runs of the table as it was before an epoch, oldest first; as it is now for None."""
        known = [e for e in self.epochs() if before is None or e < before]
        return self._list(max(known)) if known else []

    def _list(self, epoch: int) -> list[dict]:
        fs, p = self._fs(f"{self.path}/lists/{epoch:012d}.json")
        file = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _rows(self, runs: list[dict]) -> DataFrame:
        stored = StructType([*self.schema.fields, StructField("epoch", IntegerType())])
        if not runs:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*[f"{self.path}/runs/{r['name']}" for r in runs])

    def read(self, before: int | None = None) -> DataFrame:
        return self.merge(self._rows(self.runs(before))).select(*[f.name for f in self.schema])

    def write(self, epoch: int, rows: DataFrame) -> None:
        """The rows of an epoch; they must not depend on what this table has from that epoch on."""
        runs = self.runs(epoch)
        runs.append(self._run(rows.select(*[f.name for f in self.schema], F.lit(epoch).cast("int").alias("epoch")), 0, epoch))
        while len(runs) >= self.fan and len({r["level"] for r in runs[-self.fan :]}) == 1:
            old, runs = runs[-self.fan :], runs[: -self.fan]
            runs.append(self._run(self.merge(self._rows(old)), old[0]["level"] + 1, epoch))
        fs, to = self._fs(f"{self.path}/lists/{epoch:012d}.json")
        _, draft = self._fs(f"{self.path}/lists/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        fs.delete(to, False)
        fs.rename(draft, to)
        self._forget(epoch)

    def _run(self, rows: DataFrame, level: int, epoch: int) -> dict:
        name = f"{epoch:012d}-{level}-{uuid.uuid4().hex}"
        rows.select(*[f.name for f in self.schema], "epoch").write.parquet(f"{self.path}/runs/{name}")
        return {"name": name, "level": level, "epoch": epoch}

    def _forget(self, epoch: int) -> None:
        lists = [e for e in self.epochs() if e <= epoch]
        for e in lists[: -self.keep]:
            fs, p = self._fs(f"{self.path}/lists/{e:012d}.json")
            fs.delete(p, False)
        named = {r["name"] for e in self.epochs() for r in self._list(e)}
        for name in self._names("runs"):
            if name not in named:
                fs, p = self._fs(f"{self.path}/runs/{name}")
                fs.delete(p, True)


def newest(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps the row of the last epoch for each key."""

    def merge(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max("epoch").alias("epoch"))
        return rows.join(last, [*keys, "epoch"], "left_semi")

    return merge
