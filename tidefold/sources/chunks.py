"""Arrays in chunks along time as a Spark data source: a folder of blocks with manifests, read pruned and appended to in two phases.

    spark.dataSource.register(ChunkSource)
    df.write.format("chunks").mode("append").option("path", p).option("dims", "Y,X").save()
    spark.read.format("chunks").option("path", p).load()

A table has a time ``T`` (timestamp), whole-number dimensions, and variables (doubles). A block is a dense
array of each variable over some times and the cells that have them. Tasks write blocks under names of their
own; the driver then adds one manifest that lists them with their times. What no manifest lists is not
part of the table, so a failed or repeated task changes nothing, nor does a failed job.

Files are reached by ``pyarrow.fs``: a path that executors share, or a store that it knows.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegralType, LongType, StructField, StructType, TimestampType

from ..errors import EngineIOError

TIME = "T"
#: Times that a block holds, at most, and rows that a task gathers for it.
STEPS, BLOCK_ROWS = 64, 4_000_000
SMALLEST, LARGEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


@dataclass
class Block(InputPartition):
    """A block's file, and its first and last time in microseconds."""

    file: str
    first: int
    last: int

    def __post_init__(self):
        super().__init__(self.file)


@dataclass
class Wrote(WriterCommitMessage):
    blocks: list[tuple[str, int, int]] = field(default_factory=list)


class Folder:
    """A table's folder: ``blocks/`` and ``manifests/``, the latter numbered without gaps."""

    def __init__(self, path: str):
        self.fs, self.root = _store(path)

    def manifests(self) -> list[dict]:
        """Those since the last one that replaced the table."""
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        names = sorted(f.path for f in found if f.path.endswith(".json"))
        out: list[dict] = []
        for name in reversed(names):
            with self.fs.open_input_stream(name) as f:
                out.insert(0, json.loads(f.read()))
            if out[0]["replaces"]:
                break
        return out

    def commit(self, manifest: dict) -> None:
        """Add a manifest: written aside, then moved to the next number. A job that finds its own there has committed before."""
        self.fs.create_dir(f"{self.root}/manifests", recursive=True)
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/manifests"))
        numbers = [int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json")]
        if any(m["job"] == manifest["job"] for m in self.manifests()):
            return
        aside = f"{self.root}/manifests/{manifest['job']}.tmp"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(manifest).encode())
        self.fs.move(aside, f"{self.root}/manifests/{max(numbers, default=0) + 1:08d}.json")

    def remove(self, files: list[str]) -> None:
        for name in files:
            if self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.File:
                self.fs.delete_file(f"{self.root}/{name}")

    def save(self, arrays: dict[str, np.ndarray]) -> str:
        """Write a block; its name in the folder."""
        name = f"blocks/{uuid.uuid4().hex}.npz"
        self.fs.create_dir(f"{self.root}/blocks", recursive=True)
        data = io.BytesIO()
        np.savez_compressed(data, **arrays)
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(data.getvalue())
        return name

    def load(self, name: str) -> dict[str, np.ndarray]:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return dict(np.load(io.BytesIO(f.read())))


def dense(times: np.ndarray, cells: np.ndarray, values: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Rows as arrays over (times, cells): sorted times and cells, which rows there are, values and which are null.

    Of rows for one time and cell the last given stays.
    """
    t, at = np.unique(times, return_inverse=True)
    c, cell = np.unique(cells, axis=0, return_inverse=True)
    cell = cell.reshape(-1)
    there = np.zeros((len(t), len(c)), dtype=bool)
    there[at, cell] = True
    out = {"times": t, "cells": c, "there": there}
    for name, (v, null) in values.items():
        out[f"v_{name}"], out[f"n_{name}"] = np.zeros(there.shape), np.zeros(there.shape, dtype=bool)
        out[f"v_{name}"][at, cell], out[f"n_{name}"][at, cell] = v, null
    return out


def within(block: dict[str, np.ndarray], low: int, high: int) -> np.ndarray:
    """Which rows of a block have a time from low to high."""
    t = block["times"]
    return block["there"] & ((t >= low) & (t <= high))[:, None]


class ChunkReader(DataSourceReader):
    """One partition for each block whose times may be asked for.

    Options ``from`` and ``to`` (ISO times in UTC) choose the blocks and rows between, and with ``bracket`` one
    step on either side: the last one not after ``from`` and the first not before ``to``. Filters are not
    pushed down: Spark 4.1 keeps what one scan has pushed for later scans of the same DataFrame, which
    then lack rows.
    """

    def __init__(self, path: str, schema: StructType, options: dict[str, str]):
        self.path, self.schema = path, schema
        micros = lambda x: int(np.datetime64(x, "us").astype(np.int64))
        self.low, self.high = (micros(options[k]) if k in options else end for k, end in (("from", SMALLEST), ("to", LARGEST)))
        self.bracket = options.get("bracket", "false").lower() == "true"

    def partitions(self) -> list[Block]:
        every = [Block(*b) for m in Folder(self.path).manifests() for b in m["blocks"]]
        low, high = self.low, self.high
        if self.bracket:
            # The blocks that hold the step before the first time and the step after the last one.
            low = max((b.first for b in every if b.first <= low), default=low)
            high = min((b.last for b in every if b.last >= high), default=high)
        return [b for b in every if b.last >= low and b.first <= high] or [Block("", 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        folder = Folder(self.path)
        block = folder.load(partition.file)
        t, low, high = block["times"], self.low, self.high
        if self.bracket:
            low = max((int(x) for x in t[t <= low]), default=low)
            high = min((int(x) for x in t[t >= high]), default=high)
        at, cell = np.nonzero(within(block, low, high))
        columns = []
        dims = [f.name for f in self.schema if isinstance(f.dataType, IntegralType)]
        for f in self.schema:
            if f.name == TIME:
                columns.append(pa.array(t[at], pa.timestamp("us", tz="UTC")))
            elif f.name in dims:
                columns.append(pa.array(block["cells"][cell, dims.index(f.name)], pa.int64()))
            else:
                columns.append(pa.array(block[f"v_{f.name}"][at, cell], pa.float64(), mask=block[f"n_{f.name}"][at, cell]))
        whole = pa.RecordBatch.from_arrays(columns, names=self.schema.names)
        for k in range(0, len(whole), 1 << 16):
            yield whole.slice(k, 1 << 16)


class ChunkWriter(DataSourceArrowWriter):
    """Tasks write blocks, the driver one manifest. In append mode all new times must follow those there are."""

    def __init__(self, path: str, schema: StructType, replaces: bool):
        self.path, self.schema, self.replaces, self.job = path, schema, replaces, uuid.uuid4().hex
        folder = Folder(path)
        before = [] if replaces else folder.manifests()
        self.last = max((b[2] for m in before for b in m["blocks"]), default=SMALLEST)
        if before and StructType.fromJson(before[-1]["schema"]).names != schema.names:
            raise EngineIOError(f"the table has columns {', '.join(StructType.fromJson(before[-1]['schema']).names)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        dims = [f.name for f in self.schema if isinstance(f.dataType, IntegralType)]
        names = [f.name for f in self.schema if f.name != TIME and f.name not in dims]
        done = Wrote()
        held: list[pa.RecordBatch] = []
        folder = Folder(self.path)

        def flush() -> None:
            rows = pa.Table.from_batches(held)
            held.clear()
            if any(rows.column(c).null_count for c in (TIME, *dims)):
                raise EngineIOError("times and dimensions must not be null")
            t = rows.column(TIME).cast(pa.timestamp("us", tz="UTC")).to_numpy(zero_copy_only=False).astype("datetime64[us]").astype(np.int64)
            cells = np.stack([rows.column(d).to_numpy(zero_copy_only=False) for d in dims], axis=1) if dims else np.zeros((len(t), 0), dtype=np.int64)
            steps = np.unique(t)
            for k in range(0, len(steps), STEPS):
                own = (t >= steps[k]) & (t <= steps[min(k + STEPS, len(steps)) - 1])
                values = {}
                for n in names:
                    column = rows.column(n)
                    null = column.is_null().to_numpy(zero_copy_only=False)
                    values[n] = (np.where(null, 0.0, column.cast(pa.float64()).to_numpy(zero_copy_only=False))[own], null[own])
                block = dense(t[own], cells[own], values)
                done.blocks.append((folder.save(block), int(block["times"][0]), int(block["times"][-1])))

        for batch in iterator:
            if len(batch):
                held.append(batch)
                if sum(map(len, held)) >= BLOCK_ROWS:
                    flush()
        if held:
            flush()
        return done

    def commit(self, messages: list[Wrote | None]) -> None:
        blocks = [b for m in messages if m for b in m.blocks]
        if early := [b for b in blocks if b[1] <= self.last]:
            Folder(self.path).remove([b[0] for b in blocks])
            raise EngineIOError(f"{len(early)} blocks do not follow the times that the table has")
        Folder(self.path).commit({"job": self.job, "replaces": self.replaces, "schema": self.schema.jsonValue(), "blocks": sorted(blocks, key=lambda b: (b[1], b[0]))})

    def abort(self, messages: list[Wrote | None]) -> None:
        Folder(self.path).remove([b[0] for m in messages if m for b in m.blocks])


class ChunkSource(DataSource):
    """Format ``chunks``."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise EngineIOError("chunks need a path")
        return self.options["path"]

    def schema(self) -> StructType:
        found = Folder(self._path()).manifests()
        if not found:
            raise EngineIOError(f"no chunks at {self._path()}")
        return StructType.fromJson(found[-1]["schema"])

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self._path(), schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        wrong = [f.name for f in schema if not (isinstance(f.dataType, (IntegralType, DoubleType)) or (f.name == TIME and isinstance(f.dataType, TimestampType)))]
        if TIME not in schema.names or wrong:
            raise EngineIOError(f"chunks have a timestamp T, whole-number dimensions and double variables; not so {', '.join(wrong) or 'T'}")
        plain = StructType([StructField(f.name, LongType() if isinstance(f.dataType, IntegralType) else f.dataType) for f in schema])
        return ChunkWriter(self._path(), plain, overwrite)


def write_chunks(df, path: str, step_seconds: float, mode: str = "append", steps: int = STEPS) -> None:
    """Write ``df`` (T, whole-number dimensions, double variables) as blocks of about ``steps`` times each.

    Rows are dealt to tasks by stretches of time, of as many as there are, so a block has all cells of its
    times unless the stretch has more than ``BLOCK_ROWS`` rows.
    """
    from pyspark.sql import functions as F

    df.sparkSession.dataSource.register(ChunkSource)
    block = F.floor(F.unix_micros(TIME) / int(step_seconds * steps * 1e6))
    many = max(1, df.select(block.alias("b")).distinct().count())
    dealt = df.withColumn("_b", block).repartitionByRange(many, "_b").sortWithinPartitions("_b", TIME).drop("_b")
    dealt.write.format("chunks").mode(mode).option("path", path).save()


def read_chunks(spark, path: str, start: str | None = None, end: str | None = None, bracket: bool = False):
    """The table at ``path``; with ``start`` and ``end`` its rows from one to the other, and with ``bracket`` the nearest step on either side too."""
    spark.dataSource.register(ChunkSource)
    got = spark.read.format("chunks").option("path", path)
    for name, value in (("from", start), ("to", end), ("bracket", str(bracket).lower())):
        if value is not None:
            got = got.option(name, value)
    return got.load()
