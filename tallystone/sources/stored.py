"""Stored pages as a Spark data source, in batch and as a stream of runs; and a sink of two phases.

A run is a folder with files of pages (JSON lines of page_id and html). Its last file,
`run.json`, closes it: pages fetched, whether the scopes are all there, which of them were
read to their end, and errors. A stream plans whole runs: what is not closed yet is not
there. Paths may be of any file system that Arrow knows (file, hdfs, s3, gs), on the
driver and on executors alike.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

CLOSING = "run.json"


def _at(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path inside it; a plain path is a local one."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _listed(path: str) -> list[pa.fs.FileInfo]:
    fs, at = _at(path)
    return sorted(fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True)), key=lambda f: f.path)


def _lines(path: str) -> Iterator[dict]:
    """A file's lines, block by block: a file of any length."""
    fs, at = _at(path)
    rest = b""
    with fs.open_input_stream(at) as f:
        while block := f.read(1 << 20):
            *lines, rest = (rest + block).split(b"\n")
            yield from (json.loads(x) for x in lines if x.strip())
    if rest.strip():
        yield json.loads(rest)


def _join(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


# ---- pages ---------------------------------------------------------------------------------------


class ListingSource(DataSource):
    """spark.read.format("listing_pages").load(path): the pages of a folder of JSON lines (page_id, html).

    readStream reads a folder of runs instead, and has run, kind ("page" or "close") and
    the closing figures as well; `whole_runs` says which scopes that ends.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return "page_id long, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["path"])


class _File(InputPartition):
    def __init__(self, path: str, run: str = "", kind: str = "page"):
        super().__init__(path)
        self.run, self.kind = run, kind


class _PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = [posixpath.basename(f.path) for f in _listed(self.path) if f.path.endswith(".jsonl")]
        return [_File(_join(self.path, n)) for n in names]

    def read(self, partition: InputPartition):
        for page in _lines(partition.value):
            yield page.get("page_id"), page.get("html")


RUNS = "run string, kind string, page_id long, html string, source string, started_at timestamp, finished_at timestamp, pages_fetched long, complete boolean, scopes array<string>, errors array<string>"


class RunSource(DataSource):
    """spark.readStream.format("listing_runs").load(path): closed runs in the order of their names, each with its pages and the row that closes it.

    maxRunsPerTrigger (1 by default) bounds a micro-batch. An offset is the name of the last
    run that was read, so that a restart reads none twice; names must grow.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_runs"

    def schema(self) -> str:
        return RUNS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _RunReader(self.options["path"], int(self.options.get("maxRunsPerTrigger", "1")))


class _RunReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        if most < 1:
            raise ValueError("maxRunsPerTrigger must be positive")
        self.path, self.most, self.last = path, most, None

    def _closed(self) -> list[str]:
        fs, _ = _at(self.path)
        folders = [f.path for f in _listed(self.path) if f.type == pa.fs.FileType.Directory]
        there = fs.get_file_info([_join(f, CLOSING) for f in folders])
        return [posixpath.basename(f) for f, c in zip(folders, there, strict=True) if c.type == pa.fs.FileType.File]

    def initialOffset(self) -> dict:
        return {"run": ""}

    def latestOffset(self) -> dict:
        # The end of the next micro-batch: some runs further than the last that was planned.
        runs = self._closed()
        if self.last is not None:
            runs = [r for r in runs if r > self.last][: self.most]
        else:
            runs = runs[: self.most]
        self.last = runs[-1] if runs else self.last
        return {"run": self.last or ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last or "", end["run"])
        out: list[InputPartition] = []
        for run in (r for r in self._closed() if start["run"] < r <= end["run"]):
            folder = _join(self.path, run)
            out += [_File(_join(folder, posixpath.basename(f.path)), run) for f in _listed(folder) if f.path.endswith(".jsonl")]
            out.append(_File(_join(folder, CLOSING), run, "close"))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for x in _lines(partition.value):
            if partition.kind == "page":
                yield partition.run, "page", x.get("page_id"), x.get("html"), *(None for _ in range(7))
            else:
                time = lambda k: datetime.datetime.fromisoformat(x[k]) if x.get(k) else None  # noqa: B023, E731
                yield partition.run, "close", None, None, x.get("source"), time("started_at"), time("finished_at"), x.get("pages_fetched"), bool(x.get("complete")), list(x.get("scopes") or []), list(x.get("errors") or [])

    def commit(self, end: dict) -> None:
        pass


def ended_scopes(runs: DataFrame) -> DataFrame:
    """source, scope_key, scope_started, observed_at and end_of_scope of the scopes that may lose what was not seen: those of complete runs without errors."""
    ok = (F.col("kind") == "close") & F.col("complete") & (F.size("errors") == 0)
    return runs.where(ok).select("source", F.explode("scopes").alias("scope_key"), F.col("started_at").alias("scope_started"), F.col("finished_at").alias("observed_at"), F.lit(True).alias("end_of_scope"))


def seen_and_ended(runs: DataFrame, listing: list[Column], observed: Column) -> DataFrame:
    """Listings of the pages (columns of `listing`, made of html) and the ends of scopes, as the keyed state takes them."""
    rows = runs.where("kind = 'page'").select(*listing, observed.alias("observed_at"), F.lit(False).alias("end_of_scope"), F.lit(None).cast("timestamp").alias("scope_started"))
    return rows.unionByName(ended_scopes(runs), allowMissingColumns=True)


# ---- the sink ------------------------------------------------------------------------------------


@dataclass
class _Part(WriterCommitMessage):
    """What one task wrote: a file, its rows, and a sum over its rows that has no order."""

    name: str
    rows: int
    digest: str


class VersionedSink(DataSource):
    """df.write.format("versioned_listings").option("version", v).option("expect", n).mode("append").save(path).

    Tasks write files aside and report rows and digests. The driver checks their number
    against `expect` (if given) and that every file is there with that length, lists them
    in one manifest, and moves the pointer last. If anything fails, files go and readers
    stay where they were.
    """

    @classmethod
    def name(cls) -> str:
        return "versioned_listings"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _VersionWriter(self.options["path"], self.options["version"], int(self.options.get("expect", "-1")))

    def reader(self, schema) -> DataSourceReader:
        return _VersionReader(self.options["path"])

    def schema(self):
        fs, at = _at(self.options["path"])
        from pyspark.sql.pandas.types import from_arrow_schema

        manifest = _active(self.options["path"])
        first = next(p for p in manifest["parts"])
        with fs.open_input_file(f"{at}/{manifest['version']}/{first['name']}") as f:
            return from_arrow_schema(pq.read_schema(f))


def _active(path: str) -> dict:
    """The manifest that the pointer names."""
    fs, at = _at(path)
    names = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(f"{at}/pointers", allow_not_found=True)) if f.path.endswith(".json"))
    if not names:
        raise ValueError("nothing was published yet")
    with fs.open_input_stream(names[-1]) as f:
        return json.loads(f.read())


def active_version(path: str) -> str | None:
    try:
        return _active(path)["version"]
    except ValueError:
        return None


class _VersionReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.manifest = path, _active(path)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((self.manifest["version"], p["name"], p["rows"])) for p in self.manifest["parts"]]

    def read(self, partition: InputPartition):
        version, name, rows = partition.value
        fs, at = _at(self.path)
        with fs.open_input_file(f"{at}/{version}/{name}") as f:
            file = pq.ParquetFile(f)
            if file.metadata.num_rows != rows:
                raise RuntimeError(f"{name} has {file.metadata.num_rows} rows, not {rows}")
            yield from file.iter_batches()


class _VersionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, version: str, expect: int):
        if not version or "/" in version:
            raise ValueError("a version needs a plain name")
        self.path, self.version, self.expect = path, version, expect

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, at = _at(self.path)
        fs.create_dir(f"{at}/{self.version}", recursive=True)
        name, rows, total, writer = f"part-{uuid.uuid4().hex}.parquet", 0, 0, None
        out = None
        try:
            for b in iterator:
                if writer is None:
                    out = fs.open_output_stream(f"{at}/{self.version}/{name}")
                    writer = pq.ParquetWriter(out, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
                for r in b.to_pylist():
                    total += int.from_bytes(hashlib.sha256(repr(sorted(r.items())).encode()).digest()[:16], "big")
        finally:
            if writer is not None:
                writer.close()
                out.close()
        return _Part(name if rows else "", rows, f"{total % (1 << 128):032x}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _at(self.path)
        parts = [m for m in messages if m is not None and m.rows]
        rows = sum(m.rows for m in parts)
        try:
            if any(m is None for m in messages):
                raise RuntimeError("a task reported nothing")
            if self.expect >= 0 and rows != self.expect:
                raise RuntimeError(f"{rows} rows were written, {self.expect} are expected")
            for m in parts:
                with fs.open_input_file(f"{at}/{self.version}/{m.name}") as f:
                    if pq.ParquetFile(f).metadata.num_rows != m.rows:
                        raise RuntimeError(f"{m.name} is not whole")
        except Exception:
            self.abort(messages)
            raise
        digest = sum(int(m.digest, 16) for m in parts) % (1 << 128)
        body = {"version": self.version, "rows": rows, "digest": f"{digest:032x}", "parts": [{"name": m.name, "rows": m.rows} for m in parts]}
        fs.create_dir(f"{at}/pointers", recursive=True)
        last = max((int(posixpath.basename(f.path).split("-")[0]) for f in fs.get_file_info(pa.fs.FileSelector(f"{at}/pointers")) if f.path.endswith(".json")), default=0)
        aside = f"{at}/pointers/.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            f.write(json.dumps(body).encode())
        fs.move(aside, f"{at}/pointers/{last + 1:012d}-{self.version}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _at(self.path)
        for m in messages:
            if m is not None and m.rows:
                fs.delete_file(f"{at}/{self.version}/{m.name}")
