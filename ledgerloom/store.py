"""What an engine keeps between runs: immutable files, and one small pointer that says which of them are current.

A transaction writes new Parquet files beside the old ones and publishes all its
tables at once by putting one commit file in place. Readers see the commit
before or the one after, never a part; what an aborted transaction wrote is in no
commit. A table may be cut by columns into parts: then only the parts that a
transaction names are replaced, and the files of all others stay what they are.

A commit (``commits/<number>.json``) lists each table's parts and folders: its
size follows the number of parts, not of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .session import writing

Part = tuple[str, ...]


class ConcurrentCommit(RuntimeError):
    """Another transaction published first; the caller starts anew from what is current now."""


def bucket(column: str, buckets: int):
    """A salted key's part: rows of one value stand together, values are spread evenly."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        sc = spark.sparkContext
        self._jvm, self._conf = sc._jvm, sc._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)
        self._read: dict[int, dict[str, dict]] = {}

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # -- commits -------------------------------------------------------------

    def version(self) -> int:
        """The number of the current commit, 0 before the first."""
        folder = self._path("commits")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        version = self.version() if version is None else version
        if not version:
            return {}
        if version in self._read:
            return dict(self._read[version])
        stream = self._files.open(self._path(f"commits/{version:012d}.json"))
        try:
            self._read = {version: json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))}  # a commit never changes
            return dict(self._read[version])
        finally:
            stream.close()

    def _publish(self, version: int, tables: dict[str, dict]) -> None:
        staged, final = self._path(f"commits/.{uuid.uuid4().hex}"), self._path(f"commits/{version:012d}.json")
        out = self._files.create(staged, True)
        out.write(json.dumps(tables, sort_keys=True).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(staged, final, options)  # fails where the commit is there already
        except Exception as e:
            self._files.delete(staged, False)
            if self._files.exists(final):
                raise ConcurrentCommit(f"commit {version} was published by another transaction") from e
            raise

    def vacuum(self) -> None:
        """Older commits go, and the files that no other names: for when nobody reads them any more. What a transaction has not published yet is in no commit and stays."""
        version, folder = self.version(), self._path("commits")
        named = lambda tables: {f for t in tables.values() for fs in t["parts"].values() for f in fs}
        kept = named(self.tables(version))
        older = [int(s.getPath().getName()[:-5]) for s in self._files.listStatus(folder) if s.getPath().getName()[0] != "." and s.getPath().getName().endswith(".json")] if version else []
        gone = set().union(*[named(self.tables(v)) for v in older if v < version]) - kept
        for f in sorted(gone):
            self._files.delete(self._path(f), True)
        for v in sorted(older):
            if v < version:
                self._files.delete(self._path(f"commits/{v:012d}.json"), False)

    # -- reading -------------------------------------------------------------

    def has(self, name: str) -> bool:
        return name in self.tables()

    def parts(self, name: str, version: int | None = None) -> dict[Part, list[str]]:
        """Folders of each part of a table; one that is not cut has the part ()."""
        found = self.tables(version).get(name)
        return {tuple(json.loads(k)): v for k, v in found["parts"].items()} if found else {}

    def read(self, name: str, parts: Iterable[Part] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some parts of it: only their folders are listed and read."""
        return self._folders(self.tables(version)[name], parts)

    def _folders(self, table: dict, parts: Iterable[Part] | None) -> DataFrame:
        wanted = None if parts is None else {json.dumps(p) for p in parts}
        folders = [f for k, fs in sorted(table["parts"].items()) if wanted is None or k in wanted for f in fs]
        schema = StructType.fromJson(table["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    # -- writing -------------------------------------------------------------

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Publishes what its block wrote when the block ends well; else nothing, and its files go."""
        t = Transaction(self, self.version())
        try:
            yield t
        except BaseException:
            self._files.delete(self._path(t.folder), True)
            raise
        if t.changed:
            self._publish(t.base + 1, t.tables)
        else:
            self._files.delete(self._path(t.folder), True)


class Transaction:
    def __init__(self, store: Store, base: int):
        self.store, self.base = store, base
        self.tables = store.tables(base)
        self.folder = f"data/{base + 1:012d}-{uuid.uuid4().hex[:8]}"
        self.changed = False

    def _write(self, name: str, df: DataFrame, by: list[str], salts: int) -> dict[str, list[str]]:
        self.changed = True
        where = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        if not by:
            with writing(self.store.spark):
                df.write.parquet(f"{self.store.root}/{where}")
            return {json.dumps(()): [where]}
        keys = [f"_part{i}" for i in range(len(by))]
        dealt = df.withColumns({k: F.col(c).cast("string") for k, c in zip(keys, by, strict=True)})
        spread = [F.pmod(F.xxhash64(*df.columns), F.lit(salts))] if salts > 1 else []  # a large part is several tasks' work
        with writing(self.store.spark):
            dealt.repartition(*keys, *spread).write.partitionBy(*keys).parquet(f"{self.store.root}/{where}")
        pattern = self.store._path(where + "/_part*" + "/_part*" * (len(by) - 1))
        out = {}
        for status in self.store._files.globStatus(pattern) or []:
            names = str(status.getPath().toString()).rstrip("/").split("/")[-len(by) :]
            out[json.dumps(tuple(n.partition("=")[2] for n in names))] = ["/".join([where, *names])]
        return out

    def replace(self, name: str, df: DataFrame, by: Iterable[str] = (), salts: int = 1) -> None:
        """The whole table; ``by`` names the columns that cut it into parts (plain values: numbers and words)."""
        by = list(by)
        self.tables[name] = {"schema": json.loads(df.schema.json()), "by": by, "salts": salts, "parts": self._write(name, df, by, salts)}

    def overwrite(self, name: str, df: DataFrame, parts: Iterable[Part]) -> None:
        """The given parts of a table that is cut; one that ``df`` has no rows of goes. All other parts keep their files."""
        table = self.tables[name]
        own = {json.dumps(p) for p in parts}
        written = self._write(name, df.select(*[f["name"] for f in table["schema"]["fields"]]), table["by"], table["salts"])
        if set(written) - own:
            raise ValueError(f"{name}: rows of parts that were not named: {sorted(set(written) - own)[:3]}")
        self.tables[name] = {**table, "parts": {k: v for k, v in table["parts"].items() if k not in own} | written}

    def append(self, name: str, df: DataFrame) -> None:
        """Rows after those of a table that is not cut; a new table if there is none."""
        if name not in self.tables:
            return self.replace(name, df)
        table = self.tables[name]
        added = self._write(name, df.select(*[f["name"] for f in table["schema"]["fields"]]), [], 1)
        self.tables[name] = {**table, "parts": {json.dumps(()): table["parts"].get(json.dumps(()), []) + added[json.dumps(())]}}

    def read(self, name: str, parts: Iterable[Part] | None = None) -> DataFrame:
        """A table as it was when the transaction began."""
        return self.store.read(name, parts, self.base)

    def parts(self, name: str) -> list[Part]:
        """The parts of a table within the transaction."""
        return [tuple(json.loads(k)) for k in self.tables[name]["parts"]]

    def written(self, name: str, parts: Iterable[Part] | None = None) -> DataFrame:
        """A table, or some parts of it, as it stands within the transaction; readers see it with the commit."""
        return self.store._folders(self.tables[name], parts)

    def forget(self) -> None:
        """Nothing is published, and what was written goes."""
        self.tables, self.changed = self.store.tables(self.base), False
