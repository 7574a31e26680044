"""A collection as a list of immutable parts.

A pass adds one part: the new chunks and parents, what changed in the manifest, the sources whose earlier chunks no longer
count, and a segment of the lexical index.  A version is a small file that lists parts; it is written last, and only if no
other pass has written it before.  What a pass writes follows what changed; a pass without changes writes nothing.

More than ``MOST_PARTS`` parts are compacted: the newest are merged up to the first part that is at least as large as
they are together, so a chunk is rewritten about as often as the collection doubles.  The two newest versions are kept;
parts that only older ones list are deleted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lexical
from .storage import stage_table

CHUNK_SCHEMA = "chunk_id string, source string, parent_id string, ordinal int, content string, chunk_role string, embedding array<float>"
PARENT_SCHEMA = "parent_id string, source string, parent_ordinal int, parent_text string, is_metadata boolean"
MANIFEST_SCHEMA = "path string, sha256 string, length long, modified timestamp"
MOST_PARTS, KEPT_VERSIONS = 8, 2


class Conflict(RuntimeError):
    """Another pass wrote the version that this one was about to write."""


@dataclass
class Store:
    """The tables of a collection under ``root``."""

    spark: SparkSession
    root: str

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._path("versions/v*.json")
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.globStatus(path) or [])

    def version(self) -> int:
        """The latest version, 0 if there is none."""
        return max(self.versions(), default=0)

    def state(self, version: int | None = None) -> list[dict]:
        """The parts of a version in order: seq, name and number of chunks."""
        now = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/versions/v{now:09d}.json", wholetext=True).first()[0]) if now else []

    def _commit(self, parts: list[dict]) -> None:
        """Write the version that follows the one ``parts`` were made for, and delete what no kept version lists."""
        before = self._based_on
        fs, path = self._path(f"versions/v{before + 1:09d}.json")
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)  # fails if it is there
        except Exception as e:
            raise Conflict(f"version {before + 1} was written by another pass") from e
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        held = self.versions()
        kept = {p["name"] for v in held[-KEPT_VERSIONS:] for p in self.state(v)}
        for v in held[:-KEPT_VERSIONS]:
            for name in {p["name"] for p in self.state(v)} - kept:
                where = self._path(f"parts/{name}")
                where[0].delete(where[1], True)
            where = self._path(f"versions/v{v:09d}.json")
            where[0].delete(where[1], False)

    def _table(self, parts: list[dict], table: str, schema: str) -> DataFrame:
        """Rows of a table of some parts, with the part's seq."""
        found = self.spark.createDataFrame([], f"{schema}, seq int")
        for p in parts:
            found = found.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/parts/{p['name']}/{table}").withColumn("seq", F.lit(p["seq"])))
        return found

    def _gone(self, parts: list[dict], table: str, column: str) -> DataFrame:
        """Sources or chunks that parts declare gone, and before which part."""
        return self._table(parts, table, f"{column} string").groupBy(column).agg(F.max("seq").alias("before"))

    def _live(self, parts: list[dict], table: str, schema: str, among: list[dict] | None = None) -> DataFrame:
        """Rows of ``parts`` whose source is not gone later in ``among`` (default the same parts)."""
        gone = self._gone(among or parts, "gone", "source").select(F.col("source").alias("_gone"), "before")
        rows = self._table(parts, table, schema)
        return rows.join(gone, (F.col("source") == F.col("_gone")) & (F.col("seq") < F.col("before")), "left_anti").drop("seq")

    def chunks(self) -> DataFrame:
        return self._live(self.state(), "chunks", CHUNK_SCHEMA)

    def parents(self) -> DataFrame:
        return self._live(self.state(), "parents", PARENT_SCHEMA)

    def _latest(self, parts: list[dict]) -> DataFrame:
        columns = [c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]
        rows = self._table(parts, "manifest", MANIFEST_SCHEMA).groupBy("path").agg(F.max_by(F.struct(*columns[1:]), "seq").alias("x"))
        return rows.select("path", "x.*")

    def manifest(self) -> DataFrame:
        """path, sha256, length and modified of the files that the store has."""
        return self._latest(self.state()).where("sha256 is not null")

    def index(self) -> lexical.LexicalIndex | None:
        """The lexical index of the latest version, None in an empty store."""
        parts = self.state()
        if not parts:
            return None
        gone = self._gone(parts, "gone_chunks", "chunk_id").withColumnRenamed("chunk_id", "doc_id") if len(parts) > 1 else None
        return lexical.read_segments(self.spark, {p["seq"]: f"{self.root}/parts/{p['name']}/lexical" for p in parts}, gone)

    def _part(self, seq: int) -> tuple[dict, str]:
        name = f"{seq:09d}-{uuid.uuid4().hex[:8]}"
        return {"seq": seq, "name": name, "chunks": 0}, f"{self.root}/parts/{name}"

    def write(self, chunks: DataFrame, parents: DataFrame, manifest: DataFrame, gone: DataFrame, replace: bool = False) -> None:
        """A new version with one part more: new chunks and parents, changed rows of the manifest (sha256 null where a file
        is gone), and ``gone`` (source), whose earlier chunks no longer count.  With ``replace`` it has that part alone.
        """
        self._based_on = self.version()
        parts = [] if replace else self.state(self._based_on)
        part, path = self._part(max((p["seq"] for p in parts), default=0) + 1)
        chunks.write.parquet(f"{path}/chunks")
        parents.write.parquet(f"{path}/parents")
        manifest.write.parquet(f"{path}/manifest")
        gone.select("source").distinct().write.parquet(f"{path}/gone")
        added = self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
        lost = stage_table(self._live(parts, "chunks", CHUNK_SCHEMA).join(self.spark.read.schema("source string").parquet(f"{path}/gone"), "source", "left_semi").select("chunk_id", "content"), "lost-chunks")
        lost.select("chunk_id").write.parquet(f"{path}/gone_chunks")
        lexical.write_segment(added, f"{path}/lexical", "chunk_id", "content", lost)
        part["chunks"] = added.count()
        parts = [*parts, part]
        while len(parts) > MOST_PARTS:
            parts = self._compacted(parts)
        self._commit(parts)

    def _compacted(self, parts: list[dict]) -> list[dict]:
        """The same collection with its newest parts merged."""
        n = 2
        while n < len(parts) and parts[-n - 1]["chunks"] < sum(p["chunks"] for p in parts[-n:]):
            n += 1
        old, merged = parts[:-n], parts[-n:]
        part, path = self._part(parts[-1]["seq"] + 1)
        self._live(merged, "chunks", CHUNK_SCHEMA).write.parquet(f"{path}/chunks")
        self._live(merged, "parents", PARENT_SCHEMA).write.parquet(f"{path}/parents")
        latest = self._latest(merged)
        (latest if old else latest.where("sha256 is not null")).write.parquet(f"{path}/manifest")
        for table, column in (("gone", "source"), ("gone_chunks", "chunk_id")):
            self._gone(merged if old else [], table, column).select(column).write.parquet(f"{path}/{table}")
        added = self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
        # Statistics of segments add up, also where one takes off what older parts had.
        lexical.write_segment(added, f"{path}/lexical", "chunk_id", "content", like=[f"{self.root}/parts/{p['name']}/lexical" for p in merged])
        part["chunks"] = added.count()
        return [*old, part]
