"""Saved responses of a catalogue as tables, and requests as a sink that commits once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_NODE = "struct<type:string,id:string,attributes:variant,relationships:variant>"
_LINK = "array<struct<type:string,id:string>>"


def saved_responses(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """file, request, status, problem, data, listed and included of saved responses, one JSON object a line or a file.

    An object holds the request's name, its status and its body. What cannot be used is a row too: its ``problem`` says
    why (not JSON, a status other than 200, no body), and its parts are null. Files are read in splits.
    """
    raw = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    got = lambda p, kind: F.try_variant_get("v", p, kind)
    status = got("$.status", "int")
    body = got("$.body", "variant")
    problem = (
        F.when(F.col("v").isNull(), "not JSON").when(status.isNull(), "no status").when(status != 200, F.concat(F.lit("status "), status.cast("string"))).when(body.isNull() | F.is_variant_null(body), "no body")
    )
    usable = problem.isNull()
    node = lambda p: F.when(usable, F.from_json(F.to_json(got(p, "variant")), _NODE))
    return raw.select(
        "file", got("$.request", "string").alias("request"), status.alias("status"), problem.alias("problem"), node("$.body.data").alias("data"),
        F.when(usable, got("$.body.data", "array<variant>")).alias("listed"), F.when(usable, F.from_json(F.to_json(got("$.body.included", "variant")), f"array<{_NODE}>")).alias("included"),
    )


def related(node: Column, name: str) -> Column:
    """type and id of a node's related nodes, a single one as an array."""
    found = F.try_variant_get(node.getField("relationships"), f"$.{name}.data", "variant")
    said = F.to_json(found)
    return F.coalesce(F.from_json(F.when(F.startswith(said, F.lit("{")), F.concat(F.lit("["), said, F.lit("]"))).otherwise(said), _LINK), F.array().cast(_LINK))


def _album(node: Column, included: Column) -> Column:
    """An album's fields; artists by the order of their links, those not included left out; a copyright that is no string as text."""
    held = lambda path, kind="string": F.try_variant_get(node.getField("attributes"), path, kind)
    artists = F.flatten(F.transform(related(node, "artists"), lambda link: F.transform(F.slice(F.filter(included, lambda n: (n["type"] == "artists") & (n["id"] == link["id"])), 1, 1), lambda n: F.coalesce(F.try_variant_get(n["attributes"], "$.name", "string"), F.lit("")))))
    return F.struct(
        node.getField("id").alias("id"), F.coalesce(held("$.title"), F.lit("")).alias("title"), F.coalesce(held("$.releaseDate"), F.lit("")).alias("release_date"), artists.alias("artists"),
        F.coalesce(held("$.copyright"), F.lit("")).alias("copyright"), held("$.numberOfItems", "int").alias("track_count"),
    )


def search_hits(responses: DataFrame, limit: int | None = None) -> DataFrame:
    """request, pos and the album of each hit of usable search responses; links to albums that are not included are no hits."""
    rows = responses.where("problem IS NULL AND data.type = 'searchResults'").select("request", F.posexplode(related(F.col("data"), "albums")).alias("pos", "link"), F.coalesce("included", F.array().cast(f"array<{_NODE}>")).alias("included"))
    rows = rows.where("link.type = 'albums'").withColumn("node", F.get(F.filter("included", lambda n: (n["type"] == "albums") & (n["id"] == F.col("link.id"))), F.lit(0)))
    found = rows.where("node IS NOT NULL").select("request", "pos", _album(F.col("node"), F.col("included")).alias("a")).select("request", "pos", "a.*").drop("track_count")
    return found if limit is None else found.where(F.col("pos") < limit)


def album_details(responses: DataFrame) -> DataFrame:
    """request and the album of each usable response about one album; others give no row."""
    rows = responses.where("problem IS NULL AND data.type = 'albums'")
    return rows.select("request", _album(F.col("data"), F.coalesce("included", F.array().cast(f"array<{_NODE}>"))).alias("a")).select("request", "a.*")


class _Sent(WriterCommitMessage):
    def __init__(self, file: str, bodies: int):
        self.file, self.bodies = file, bodies


class _FolderWriter(DataSourceWriter):
    """Tasks write files of their own; the commit names those that count in one manifest."""

    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def _files(self):
        from pyarrow import fs

        uri = "file://" + self.folder.removeprefix("file:") if self.folder.startswith("file:/") and not self.folder.startswith("file://") else self.folder
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, folder = self._files()
        # a task may run twice: each run writes a file of its own
        name, n = f"{self.job}-{uuid.uuid4().hex}.jsonl", 0
        files.create_dir(f"{folder}/bodies", recursive=True)
        with files.open_output_stream(f"{folder}/bodies/{name}") as out:
            for row in rows:
                out.write((row["body"] + "\n").encode())
                n += 1
        return _Sent(name, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, folder = self._files()
        manifest = f"{folder}/commits/{self.job}.json"
        files.create_dir(f"{folder}/commits", recursive=True)
        if files.get_file_info(manifest).type != fs.FileType.NotFound:
            return self.abort(messages)  # the job has been committed before: a retry adds nothing
        kept = sorted(m.file for m in messages if m is not None and m.bodies)
        part = f"{manifest}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(json.dumps({"job": self.job, "files": kept}).encode())
        files.move(part, manifest)
        return None

    def abort(self, messages: list) -> None:
        files, folder = self._files()
        for m in messages:
            if m is not None:
                files.delete_file(f"{folder}/bodies/{m.file}")


class RequestFolder(DataSource):
    """A sink for request bodies (column ``body``). Options: path, and job, under which a set of bodies is committed once."""

    @classmethod
    def name(cls) -> str:
        return "request_folder"

    def schema(self) -> str:
        return "body string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FolderWriter(self.options["path"], self.options["job"])


def send(bodies: DataFrame, folder: str, job: str) -> None:
    """Write bodies to the folder; the same job a second time changes nothing."""
    bodies.sparkSession.dataSource.register(RequestFolder)
    bodies.select("body").write.format("request_folder").option("path", folder).option("job", job).mode("append").save()


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """job and body of all committed bodies."""
    commits = spark.read.schema("job string, files array<string>").json(f"{folder}/commits").select("job", F.explode("files").alias("file"))
    bodies = spark.read.text(f"{folder}/bodies").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("body"))
    return bodies.join(F.broadcast(commits), "file").select("job", "body")  # a row for each task that wrote
