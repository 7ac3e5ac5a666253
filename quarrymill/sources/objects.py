"""A registry of sealed objects with numbered ids, for several writers at once.

An object is one small JSON file, ``root/kind/D0007.json``. It is written whole under a name of its own, and then takes
its id by a step that only one writer can win: a hard link on a local disk, a rename that refuses an existing target
elsewhere (atomic on HDFS; stores without such a rename are refused). Whoever loses goes on to the next number, so an
id is never given twice and never changes what it names. The seal is a hash of what was written; reading checks it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEAL = "record_hash"
ID = re.compile(r"^([A-Z]+)(\d{4,})$")
#: Stores whose rename can refuse an existing target at once.
ATOMIC = ("hdfs", "viewfs")


class ObjectError(ValueError):
    """An object that isn't there, is there already, or isn't what was sealed."""


def sealed(payload: Mapping[str, object]) -> str:
    """The hash of a payload without its seal, whatever the order of its keys."""
    body = {k: v for k, v in payload.items() if k != SEAL}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass
class ObjectStore:
    """Objects under a folder of any store that Spark reads."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.hadoop = self.spark._jvm.org.apache.hadoop.fs
        base = self.hadoop.Path(self.root)
        self.fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.scheme = self.fs.getUri().getScheme()
        if self.scheme != "file" and self.scheme not in ATOMIC:
            raise ObjectError(f"{self.scheme} can't refuse an existing target at once")

    def _path(self, object_id: str):  # noqa: ANN202
        found = ID.match(object_id)
        if not found:
            raise ObjectError(f"{object_id!r} is no id")
        return self.hadoop.Path(f"{self.root}/{found[1]}/{object_id}.json")

    def _numbers(self, kind: str) -> list[int]:
        folder = self.hadoop.Path(f"{self.root}/{kind}")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(m[2]) for n in names if n.endswith(".json") and (m := ID.match(n[:-5])) and m[1] == kind)

    def _write(self, path, data: bytes) -> None:  # noqa: ANN001
        out = self.fs.create(path, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def _claim(self, side, target) -> bool:  # noqa: ANN001
        """Gives the written file its name; False if another one has it."""
        if self.scheme == "file":
            try:
                os.link(side.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(side, target, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self.fs.exists(target):
                return False
            raise
        return True

    def peek(self, kind: str) -> str:
        """The id that comes next, if no one takes it."""
        return f"{kind}{max([0, *self._numbers(kind)]) + 1:04d}"

    def create(self, kind: str, payload: Mapping[str, object], object_id: str | None = None) -> str:
        """Seals and writes an object; gives back its id: the next free one, or the given one, which must be free."""
        if not re.fullmatch("[A-Z]+", kind) or SEAL in payload or "id" in payload:
            raise ObjectError("kinds are capital letters, and id and seal are made here")
        folder = self.hadoop.Path(f"{self.root}/{kind}")
        self.fs.mkdirs(folder)
        number = int(ID.match(object_id)[2]) if object_id else max([0, *self._numbers(kind)]) + 1
        while True:
            name = object_id or f"{kind}{number:04d}"
            body = {"id": name, **payload}
            side = self.hadoop.Path(folder, f".{uuid.uuid4().hex}")
            self._write(side, json.dumps({**body, SEAL: sealed(body)}, indent=1, ensure_ascii=False).encode())
            try:
                if self._claim(side, self._path(name)):
                    return name
            finally:
                self.fs.delete(side, False)
            if object_id:
                raise ObjectError(f"{object_id} is there already; ids are never used again")
            number += 1

    def get(self, object_id: str, verify: bool = True) -> dict:
        """The object as recorded; raises if it isn't there or no longer fits its seal or its name."""
        path = self._path(object_id)
        if not self.fs.exists(path):
            raise ObjectError(f"{object_id} isn't there")
        lines = self.spark.read.text(path.toString(), wholetext=True).first()
        try:
            payload = json.loads(lines[0] if lines else "")
        except ValueError as e:
            raise ObjectError(f"{object_id} is no JSON any more") from e
        if verify and (payload.get(SEAL) != sealed(payload) or payload.get("id") != object_id):
            raise ObjectError(f"{object_id} was changed after it was sealed")
        return payload

    def listed(self, kind: str) -> list[str]:
        """Ids of a kind by number."""
        return [f"{kind}{n:04d}" for n in self._numbers(kind)]

    def audit(self, kind: str) -> DataFrame:
        """(id, ok) of all objects of a kind, read and checked by tasks: ``ok`` is False for what no longer fits its seal."""
        kept = sealed

        @F.udf("boolean")
        def fits(name: str, text: str) -> bool:
            try:
                payload = json.loads(text)
                return payload.get(SEAL) == kept(payload) and payload.get("id") == name
            except (ValueError, AttributeError):
                return False

        files = self.spark.read.option("pathGlobFilter", f"{kind}*.json").text(f"{self.root}/{kind}", wholetext=True)
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
        return files.select(name.alias("id"), fits(name, "value").alias("ok"))
