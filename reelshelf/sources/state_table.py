"""Stored state: Parquet generations under a version folder, and a pointer to those in force.

``<root>/v=<version>/g<number>-<full|delta>-<id>/``, ``<root>/v=<version>/current-<number>.json``

The newest pointer names the generations that count, how many rows they have, and which
batches they hold. It is written last, by a rename: a lost driver leaves a folder that no
pointer names. Nothing is overwritten. One writer at a time.

A full generation stands for everything before it. It is bucketed and sorted by path, so
that a lookup by path moves the listing to it and leaves the wide state where it is. A delta
holds changed rows and marks of deleted paths. After MERGE_DELTAS deltas these become one, or,
once they are a fair share of the table, are folded into a new full generation; so
the load plan stays the same size however many batches a stream has written.
"""

import hashlib
import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelshelf import schemas
from reelshelf.functions.fixed_values import STATE_VERSION
from reelshelf.session import PARQUET_CODEC, SETTINGS

MERGE_DELTAS = 8
FOLD_SHARE = 0.25

_POINTER = re.compile(r"^current-(\d{8})\.json$")
_NEW = {"number": 0, "generations": [], "done": {}, "tag": None, "buckets": None}


def _sum(a, b):
    """Sums of two parts; NULL is that of no rows."""
    return b if a is None else a if b is None else a + b


class StateTable:
    def __init__(
        self, spark: SparkSession, root: str, version: str = STATE_VERSION, schema: T.StructType = schemas.STATE,
        merge_deltas: int = MERGE_DELTAS, fold_share: float = FOLD_SHARE,
    ):
        self.spark = spark
        # what load() gives is right only with it, also in a session that configure() hasn't seen
        union = "spark.sql.unionOutputPartitioning"
        spark.conf.set(union, SETTINGS[union])
        self.folder = f"{root.rstrip('/')}/v={version}"
        self.schema = schema
        self.delta_schema = T.StructType([*schema.fields, T.StructField("deleted", T.BooleanType())])
        self.merge_deltas, self.fold_share = merge_deltas, fold_share
        self.observed: dict = {}  # metrics of the last write

    # --- the pointer ---------------------------------------------------------------
    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def pointer(self) -> dict:
        """What is in force; an empty one when there is no state of this version."""
        fs, folder = self._fs(self.folder)
        if not fs.exists(folder):
            return dict(_NEW)
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        newest = max((n for n in names if _POINTER.match(n)), default=None)
        if newest is None:
            return dict(_NEW)
        stream = fs.open(self._fs(f"{self.folder}/{newest}")[1])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, pointer: dict) -> None:
        name = f"{self.folder}/current-{pointer['number']:08d}.json"
        fs, draft = self._fs(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(pointer).encode())
        out.close()
        final = self._fs(name)[1]
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has committed {name}")

    # --- reading ---------------------------------------------------------------------
    def _path(self, generation: dict) -> str:
        return f"{self.folder}/{generation['name']}"

    def _table(self, name: str) -> str:
        """The catalogue's name of a full generation."""
        return f"state_{hashlib.md5(f'{self.folder}/{name}'.encode()).hexdigest()}"

    def _bucketed(self, generation: dict) -> DataFrame:
        """A full generation as a table, which tells Spark the layout of its files."""
        path, name = self._path(generation), self._table(generation["name"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (file_path) SORTED BY (file_path) INTO {generation['buckets']} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(name)

    def _delta(self, generation: dict) -> DataFrame:
        return self.spark.read.schema(self.delta_schema).parquet(self._path(generation))

    def _deltas(self, generations: list[dict]) -> DataFrame:
        """The newest row or mark per path over some deltas, oldest first."""
        parts = [self._delta(g).withColumn("_g", F.lit(i)) for i, g in enumerate(generations)]
        if len(parts) == 1:
            return parts[0].drop("_g")
        # Dealt by the path once and the newest found where the rows land. No semi join for it: Spark takes one
        # below the union, and each delta then meets the newest paths of all. Dealt so, the rows lie as in a full generation.
        rows = reduce(DataFrame.unionByName, parts).filter("file_path IS NOT NULL")
        newest = F.max("_g").over(Window.partitionBy("file_path"))
        return rows.withColumn("_newest", newest).filter("_g = _newest").select(*self.delta_schema.names)

    def load(self) -> DataFrame:
        """The state; empty when there is none of this version. Damaged files fail the query."""
        generations = self.pointer()["generations"]
        full = [g for g in generations if g["kind"] == "full"]
        deltas = [g for g in generations if g["kind"] == "delta"]
        if not generations:
            return self.spark.createDataFrame([], self.schema)
        if not deltas:
            return self._bucketed(full[0])
        old, rows = self._parts(full, deltas)
        return rows if old is None else old.unionByName(rows)

    def _parts(self, full: list[dict], deltas: list[dict]) -> tuple[DataFrame | None, DataFrame]:
        """The rows of the full generation that no delta touches, in their buckets, and those of the deltas."""
        rows = self._deltas(deltas).filter("NOT deleted").select(*self.schema.names)
        if not full:
            return None, rows
        # a path that any delta names, with a row or a mark, has its newest there: no need to find it first
        touched = reduce(DataFrame.unionByName, [self._delta(g).select("file_path") for g in deltas])
        old = self._bucketed(full[0]).join(touched, "file_path", "left_anti")
        return old.select(*self.schema.names), rows

    # --- writing ---------------------------------------------------------------------
    def _write(self, df: DataFrame, kind: str, pointer: dict, metrics: tuple = (), kept: DataFrame | None = None) -> dict:
        """Rows (and metrics) are counted by the tasks that write, so that a repeated stage counts once.

        ``kept`` are further rows of a full generation that lie in buckets already. They are written by
        themselves, as a union would lose that layout and move them; each bucket then has two files.
        """
        generation = {"name": f"g{pointer['number'] + 1:08d}-{kind}-{uuid.uuid4().hex[:8]}", "kind": kind}
        count = F.count(F.lit(1)).alias("rows")
        self.observed = {}
        if kind == "full":
            generation["buckets"] = pointer["buckets"] or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            name = self._table(generation["name"])
            for part in (df,) if kept is None else (kept, df):
                seen = Observation()
                dealt = part.select(*self.schema.names).repartition(generation["buckets"], "file_path").observe(seen, count, *metrics)
                dealt.write.mode("errorifexists" if part is not df or kept is None else "append").bucketBy(generation["buckets"], "file_path").sortBy("file_path").option("compression", PARQUET_CODEC).option("path", self._path(generation)).saveAsTable(name)
                self.observed = {k: _sum(self.observed.get(k), v) for k, v in seen.get.items()}
        else:
            seen = Observation()
            df.select(*self.delta_schema.names).observe(seen, count).write.mode("errorifexists").option("compression", PARQUET_CODEC).parquet(self._path(generation))
            self.observed = dict(seen.get)
        return generation | {"rows": self.observed["rows"]}

    def write_full(self, df: DataFrame, tag: str, *metrics: Column, kept: DataFrame | None = None) -> bool:
        """Replace the state. False when this tag's full generation is the last thing written (a retried run).

        Aliased sums in ``metrics`` are taken along in the write; ``observed`` has them afterwards. ``kept``
        has further rows, from this table's buckets: they are written where they lie.
        """
        pointer = self.pointer()
        if pointer["tag"] == tag:
            return False
        if kept is not None and not pointer["generations"]:
            df, kept = kept.unionByName(df), None  # no buckets yet
        generation = self._write(df, "full", pointer, metrics, kept)
        self._commit(pointer | {"number": pointer["number"] + 1, "generations": [generation], "tag": tag, "buckets": generation["buckets"]})
        return True

    def append_delta(self, df: DataFrame, tag: str, deleted: DataFrame | None = None, paths: DataFrame | None = None) -> bool:
        """Upsert and delete: ``df`` is unique per path, its rows replace earlier ones; paths of ``deleted`` go, but for those in ``df``.

        ``paths`` has the paths of ``df`` where they are cheaper to get than from its plan.
        ``tag`` is a source's name, "-" and its batch number, which rises with every batch. False
        when the source has written this batch already (a retried one).
        """
        pointer = self.pointer()
        source, number = self._source(tag)
        if pointer["done"].get(source, -1) >= number:
            return False
        rows = df.select(*self.schema.names).withColumn("deleted", F.lit(False))
        if deleted is not None:
            gone = deleted.select("file_path").distinct().join((df if paths is None else paths).select("file_path"), "file_path", "left_anti")
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != "file_path"]
            rows = rows.unionByName(gone.select("file_path", *blank, F.lit(True).alias("deleted")))
        generation = self._write(rows, "delta", pointer)
        pointer = pointer | {
            "number": pointer["number"] + 1, "generations": [*pointer["generations"], generation],
            "done": pointer["done"] | {source: number}, "tag": None,
        }
        self._commit(pointer)
        if sum(g["kind"] == "delta" for g in pointer["generations"]) >= self.merge_deltas:
            self.compact()
        return True

    @staticmethod
    def _source(tag: str) -> tuple[str, int]:
        source, _, number = tag.rpartition("-")
        if not number.isdigit():
            raise ValueError(f"a delta's tag is a name, '-' and a batch number: {tag}")
        return source, int(number)

    def compact(self, fold: bool | None = None) -> None:
        """Make one delta of all, or fold them into a new full generation: by their share of rows, or as told."""
        pointer = self.pointer()
        full = [g for g in pointer["generations"] if g["kind"] == "full"]
        deltas = [g for g in pointer["generations"] if g["kind"] == "delta"]
        if not deltas:
            return
        if fold is None:
            fold = sum(g["rows"] for g in deltas) >= self.fold_share * sum(g["rows"] for g in full)
        if fold:
            old, rows = self._parts(full, deltas)
            generation = self._write(rows, "full", pointer, kept=old)
            after = {"generations": [generation], "buckets": generation["buckets"]}
        else:
            after = {"generations": [*full, self._write(self._deltas(deltas), "delta", pointer)]}
        self._commit(pointer | {"number": pointer["number"] + 1} | after)

    def vacuum(self) -> int:
        """Delete generations and pointers that are not in force. For times when no job reads older ones."""
        pointer = self.pointer()
        kept = {g["name"] for g in pointer["generations"]} | {f"current-{pointer['number']:08d}.json"}
        fs, folder = self._fs(self.folder)
        found = [status.getPath() for status in fs.listStatus(folder)] if fs.exists(folder) else []
        gone = [path for path in found if path.getName() not in kept]
        for path in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(path.getName())}")
        return sum(bool(fs.delete(path, True)) for path in gone)
