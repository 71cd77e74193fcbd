"""Source recipes as files ``<root>/<domain>/_source.json``, read and written by executors.

Spark's file sources skip names that start with ``_``, so these files have a data source of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from webcatalog.schemas import RECIPE_DDL

FILE = "_source.json"
#: Folders that one task looks into, unless asked otherwise.
FOLDERS_PER_TASK = 256
#: Hadoop's names of stores that Arrow knows under another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a qualified folder."""
    scheme, found, rest = root.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if found else root).strip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}".rstrip("/"))


def parse_recipe(text: str) -> tuple[str | None, dict[str, str | None]]:
    """Backend and parameters of a recipe: the block named after the backend, else ``params``.

    A parameter that isn't text is given as JSON text, null as null.
    """
    recipe = json.loads(text)
    if not isinstance(recipe, dict):
        raise ValueError("a recipe is a JSON object")
    backend = recipe.get("backend")
    blocks = (recipe.get(name) for name in (backend, "params") if isinstance(name, str))
    params = next((b for b in blocks if b and isinstance(b, dict)), {})
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return as_text(backend), {k: as_text(v) for k, v in params.items()}


@dataclass
class _Folders(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, root: str, per_task: int) -> None:
        self.root, self.per_task = root, per_task

    def partitions(self) -> list[_Folders]:
        store, path = _store(self.root)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
        return [_Folders(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [_Folders([])]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        store, path = _store(self.root)
        for name in partition.names:
            file = f"{path}/{name}/{FILE}"
            if store.get_file_info(file).type != fs.FileType.File:
                continue
            with store.open_input_stream(file) as stream:
                text = stream.read().decode("utf-8")
            try:
                yield (name, *parse_recipe(text))
            except ValueError as error:
                raise ValueError(f"{file}: {error}") from error


class _Writer(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, path = _store(self.root)
        for row in iterator:
            domain = row.domain
            if not domain or "/" in domain or domain in (".", ".."):
                raise ValueError(f"not a domain: {domain!r}")
            store.create_dir(f"{path}/{domain}")
            text = json.dumps({"backend": row.backend, "params": row.params or {}}, indent=2, ensure_ascii=False)
            with store.open_output_stream(f"{path}/{domain}/{FILE}") as stream:
                stream.write(text.encode("utf-8"))
        return WriterCommitMessage()


class SourceRecipes(DataSource):
    """``spark.read.format("source_recipes").load(root)`` and the matching ``write``.

    A task lists or opens files of its own folders only; the driver sees no more than the folders' names.
    """

    @classmethod
    def name(cls) -> str:
        return "source_recipes"

    def schema(self) -> str:
        return RECIPE_DDL

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("foldersPerTask", FOLDERS_PER_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("recipes are replaced one by one: write with mode append")
        return _Writer(self.options["path"])


def _qualified(spark: SparkSession, root: str) -> str:
    """``root`` with its scheme, as the session's default file system gives it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def read_source_recipes(spark: SparkSession, root: str, folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """Source recipes ``<domain>/_source.json``; the folder names the domain.

    Folders without such a file are left out, and a missing ``root`` is an empty table. A file that isn't a JSON object
    ends the job with its path. ``root`` must be in a store that Arrow opens from executors.
    """
    spark.dataSource.register(SourceRecipes)
    reader = spark.read.format("source_recipes").option("foldersPerTask", folders_per_task)
    return reader.load(_qualified(spark, root))


def write_source_recipes(recipes: DataFrame, root: str) -> str:
    """One file per row of ``recipes(domain, backend, params)``, in place of the one before it.

    A domain must come once (see :func:`writers.save_source_recipes`); a task that runs again writes the same files.
    """
    spark = recipes.sparkSession
    spark.dataSource.register(SourceRecipes)
    rows = recipes.select("domain", "backend", "params")
    rows.write.format("source_recipes").mode("append").save(_qualified(spark, root))
    return root
