"""Plan folders: tiles in shards that are written once, checked by hashes, and worked off by jobs that can be interrupted.

``plan_folder`` is a data source. Writing goes to a folder beside the target; the commit adds the index and renames, so a folder that
is there is complete. Reading checks the version, each file's content hash and that a shard belongs to the plan, and gives one partition for each shard;
option ``job`` reads only the shards of that job. A tile's hash is that of what its result depends on.
"""

from __future__ import annotations

import hashlib
import json
import traceback
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shared import materialize, ship, shuffled, spread
from .fits import _open

C = F.col
VERSION = 1
TILE = "tile long, job long, r0 long, r1 long, c0 long, c1 long, p0 long, p1 long, q0 long, q1 long, cutouts array<struct<image:string,r0:long,r1:long,c0:long,c1:long>>, hash string"
DEPENDS = ("r0", "r1", "c0", "c1", "p0", "p1", "q0", "q1")  # of a tile's fit, beside its cut-outs and the options


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def sealed(content: dict) -> bytes:
    return json.dumps(content | {"hash": digest(content)}, sort_keys=True, indent=1).encode()


def opened(raw: bytes, name: str) -> dict:
    """The content of a file, if its version and hash are right."""
    content = json.loads(raw)
    if content.get("version") != VERSION:
        raise ValueError(f"{name} has plan version {content.get('version')!r}; this library reads version {VERSION}")
    if digest({k: v for k, v in content.items() if k != "hash"}) != content.get("hash"):
        raise ValueError(f"{name} does not match its hash: edited or damaged, plan again")
    return content


def tile_hash(tile: dict, options: dict) -> str:
    return digest({"options": options, **{k: tile[k] for k in DEPENDS}, "cutouts": sorted((c["image"], c["r0"], c["r1"], c["c0"], c["c1"]) for c in tile["cutouts"])})


@dataclass
class Shard(WriterCommitMessage):
    entries: list[dict]


class PlanWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.plan = options["path"].rstrip("/"), json.loads(options.get("plan", "{}"))
        self.size = int(options.get("shard_size", 256))
        self.plan_id = uuid.uuid4().hex
        head, _, tail = self.path.rpartition("/")
        self.temporary = f"{head}/.{tail}.tmp-{self.plan_id}"

    def write(self, iterator: Iterator[Row]) -> Shard:
        store, root = _open(self.temporary)
        store.create_dir(root, recursive=True)
        entries, held = [], []

        def put() -> None:
            if not held:
                return
            name = f"shard-{uuid.uuid4().hex}.json"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(sealed({"version": VERSION, "plan_id": self.plan_id, "plan": self.plan, "tiles": held}))
            entries.append({"name": name, "tiles": [t["tile"] for t in held], "jobs": sorted({t["job"] for t in held})})
            held.clear()

        for row in iterator:
            tile = row.asDict(recursive=True)
            held.append(tile | {"hash": tile_hash(tile, self.plan)})
            if len(held) == self.size:
                put()
        put()
        return Shard(entries)

    def commit(self, messages: list[Shard | None]) -> None:
        shards = sorted((e for m in messages if m for e in m.entries), key=lambda e: e["tiles"])
        tiles = [t for e in shards for t in e["tiles"]]
        store, root = _open(self.temporary)
        _, target = _open(self.path)
        if len(set(tiles)) != len(tiles) or store.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise ValueError("tile numbers must differ" if len(set(tiles)) != len(tiles) else f"{self.path} exists: a plan folder is written once")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/index.json") as out:
            out.write(sealed({"version": VERSION, "plan_id": self.plan_id, "plan": self.plan, "shards": shards}))
        store.move(root, target)

    def abort(self, messages: list[Shard | None]) -> None:
        store, root = _open(self.temporary)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


@dataclass
class OneShard(InputPartition):
    name: str
    plan_id: str


class PlanReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"].rstrip("/"), options.get("job")

    def index(self) -> dict:
        store, root = _open(self.path)
        with store.open_input_stream(f"{root}/index.json") as f:
            return opened(f.read(), f"{self.path}/index.json")

    def partitions(self) -> list[OneShard]:
        found = self.index()
        return [OneShard(s["name"], found["plan_id"]) for s in found["shards"] if self.job is None or int(self.job) in s["jobs"]]

    def read(self, partition: OneShard) -> Iterator[tuple]:
        store, root = _open(self.path)
        with store.open_input_stream(f"{root}/{partition.name}") as f:
            shard = opened(f.read(), partition.name)
        if shard["plan_id"] != partition.plan_id:
            raise ValueError(f"{partition.name} belongs to another plan")
        for t in shard["tiles"]:
            if tile_hash(t, shard["plan"]) != t["hash"]:
                raise ValueError(f"{partition.name}: tile {t['tile']} does not match its hash")
            if self.job is None or t["job"] == int(self.job):
                cutouts = [(c["image"], c["r0"], c["r1"], c["c0"], c["c1"]) for c in t["cutouts"]]
                yield (t["tile"], t["job"], *(t[k] for k in DEPENDS), cutouts, t["hash"])


class PlanFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plan_folder"

    def schema(self) -> str:
        return TILE

    def reader(self, schema: StructType) -> PlanReader:
        return PlanReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PlanWriter:
        return PlanWriter(self.options)


def write_plan(tiles: DataFrame, path: str, options: dict, shard_size: int = 256) -> None:
    """``tiles`` (the columns of ``TILE`` but the hash) as a new plan folder; a job's tiles are kept together."""
    spark = tiles.sparkSession
    ship(spark)
    spark.dataSource.register(PlanFolder)
    rows = tiles.select("tile", "job", *DEPENDS, "cutouts")
    rows.repartition("job").sortWithinPartitions("job", "tile").write.format("plan_folder").mode("append").options(plan=json.dumps(options, sort_keys=True), shard_size=shard_size).save(path)


def read_plan(spark: SparkSession, path: str, job: int | None = None) -> DataFrame:
    """The plan's tiles, or those of a job; a wrong version or hash is an error."""
    ship(spark)
    spark.dataSource.register(PlanFolder)
    reader = spark.read.format("plan_folder")
    return (reader if job is None else reader.option("job", job)).load(path)


def partition_frames(frames: DataFrame, cap: int, overlap: int) -> DataFrame:
    """``frames`` (``ny, nx`` and more) with ``n, m``: the split into n x m cores whose padded tiles have at most ``cap`` squared pixels, with the fewest tiles, then the least padded area."""
    if cap <= 2 * overlap:
        raise ValueError(f"a tile of {cap} must exceed twice the overlap of {overlap}")
    own = [c for c in frames.columns]
    bound = F.ceil(C("ny") / (cap - 2 * overlap)) * F.ceil(C("nx") / (cap - 2 * overlap))
    f = materialize(frames.withColumns({"_id": F.monotonically_increasing_id(), "_most": bound}), "frames")
    one = F.lit(1).cast("long")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, v: t + v)

    def lengths(size: Column, parts: Column) -> Column:
        ends = lambda k: F.least(F.floor(k * size / parts) + overlap, size) - F.greatest(F.floor((k - 1) * size / parts) + 1 - overlap, one) + 1
        return F.transform(F.sequence(one, parts), ends)

    def padded(size: str, parts: str, name: str, keep: list[str]) -> DataFrame:
        """Each number of parts of an axis with the longest padded part and the sum of all. Where cores are as wide as the overlap, only the end parts are cut off, on one side: cores are the quotient, or 1 more, as the last and all but one of those are."""
        s, p = C(size).cast("long"), C(parts)
        rows = spread(f.select(*keep, "_id", "_most", F.explode(F.sequence(one, F.least(s, C("_most")))).alias(parts)))
        core, more = F.floor(s / p), s % p
        wide = (p >= 3) & (core >= overlap)
        longest = F.greatest(core + F.when(more >= 2, 1).otherwise(0) + 2 * overlap, core + F.when(more >= 1, 1).otherwise(0) + overlap)
        each = rows.withColumn("_all", F.when(~wide, lengths(s, p)))
        return each.select(*keep, "_id", "_most", parts, F.when(wide, longest).otherwise(F.array_max("_all")).alias(f"_{name}"), F.when(wide, s + 2 * overlap * (p - 1)).otherwise(total("_all")).alias(f"_{name}s"))

    high = padded("ny", "n", "h", own)
    wide = padded("nx", "m", "w", ["nx"]).drop("nx", "_most")
    splits = high.select("*", F.explode(F.sequence(one, F.least(C("nx").cast("long"), F.expr("_most div n")))).alias("m")).join(shuffled(wide), ["_id", "m"])
    fits = splits.where((C("_h") * C("_w") <= cap * cap) | ((C("n") * C("m") == 1) & (C("ny") * C("nx") <= cap * cap)))
    best = fits.groupBy("_id", *own).agg(F.min(F.struct((C("n") * C("m")).alias("tiles"), (C("_hs") * C("_ws")).alias("area"), "n", "m")).alias("_b"))
    return best.select(*own, C("_b.n").alias("n"), C("_b.m").alias("m"))


def read_cutouts(cutouts: DataFrame) -> DataFrame:
    """``path, y, x, v`` of the parts ``r0`` to ``r1``, ``c0`` to ``c1`` (from 1, inclusive) of NPY images: only the bytes of those rows are read."""
    ship(cutouts.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, r0, r1, c0, c1 in zip(b["path"], b["r0"], b["r1"], b["c0"], b["c1"]):
                store, name = _open(path)
                with store.open_input_file(name) as f:
                    version = np.lib.format.read_magic(f)
                    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                    if fortran or len(shape) != 2:
                        raise ValueError(f"{path}: rows of a two-dimensional image in C order are needed")
                    start, width = f.tell(), shape[1] * kind.itemsize
                    r0, r1, c0, c1 = max(r0, 1), min(r1, shape[0]), max(c0, 1), min(c1, shape[1])
                    for at in range(r0, r1 + 1, 256):
                        end = min(at + 255, r1)
                        f.seek(start + (at - 1) * width)
                        part = np.frombuffer(f.read((end - at + 1) * width), kind).reshape(-1, shape[1])[:, c0 - 1 : c1].astype(float)
                        y, x = np.indices(part.shape)
                        yield pd.DataFrame({"path": path, "y": y.ravel() + at, "x": x.ravel() + c0, "v": part.ravel()})

    return cutouts.select("path", "r0", "r1", "c0", "c1").mapInPandas(read, "path string, y long, x long, v double")


def run_tiles(tiles: DataFrame, work: Callable[[dict], float], results: str) -> DataFrame:
    """Work off the tiles that have no good result of their hash below ``results``; ``tile, hash, status, value, error`` of all that have been tried.

    ``work`` gets a tile as a dictionary. A tile that raises has a row of its own with status ``failed`` and the error, and leaves the others alone;
    a later run tries it again. Each run appends, so an interrupted one has lost only what its tasks had not committed.
    """
    spark = tiles.sparkSession
    ship(spark)
    schema = "tile long, hash string, status string, value double, error string"
    spark.createDataFrame([], schema).write.mode("append").parquet(results)
    done = spark.read.schema(schema).parquet(results).where("status = 'ok'").select("hash").distinct()

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tile in b.to_dict("records"):
                try:
                    rows.append((tile["tile"], tile["hash"], "ok", float(work(tile)), None))
                except Exception:  # the tile's own failure is its result
                    rows.append((tile["tile"], tile["hash"], "failed", None, traceback.format_exc(limit=-1)))
            yield pd.DataFrame(rows, columns=["tile", "hash", "status", "value", "error"])

    tiles.join(done, "hash", "left_anti").select("tile", "job", *DEPENDS, "cutouts", "hash").mapInPandas(attempt, schema).write.mode("append").parquet(results)
    return spark.read.schema(schema).parquet(results)
