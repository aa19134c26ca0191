"""Reversible faults: a column renamed, a column widened to near uniqueness, a source cut down to its header. What undoes a fault is in its sealed record."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.scalars import fault_id, narrowed, widened
from vigil.sources.seal import TRUTH, Seal
from vigil.sources.snapshots import Snapshots


class Fault:
    """A fault on one item; `parameters` hold all that undoing it takes."""

    fault_class, mechanism, symptom = "unclassified", "", ""

    def __init__(self, spark: SparkSession, workspace: str, item: str, seed: int = 4417, **parameters):
        self.spark, self.workspace, self.item, self.seed, self.parameters = spark, workspace, item, seed, parameters
        self.injected_at: datetime | None = None

    @property
    def fault_id(self) -> str:
        return fault_id(self.fault_class, self.item, self.parameters, self.seed)

    def apply(self, at: datetime) -> None:
        raise NotImplementedError

    def undo(self, at: datetime) -> None:
        raise NotImplementedError

    def inject(self, at: datetime) -> None:
        self.apply(at)
        self.injected_at = at

    def revert(self, at: datetime) -> None:
        self.undo(at)

    def ground_truth(self) -> DataFrame:
        """The record to seal, as a row of TRUTH."""
        if self.injected_at is None:
            raise ValueError(f"{self.fault_id} was not injected")
        row = (self.fault_id, self.fault_class, self.workspace, self.item, self.mechanism.format(**self.parameters), self.symptom.format(**self.parameters), self.injected_at, None, self.seed, {k: json.dumps(v) for k, v in self.parameters.items()}, [])
        return self.spark.createDataFrame([row], TRUTH)

    def inject_and_seal(self, seal: Seal, at: datetime) -> str:
        """Injects and seals; a fault that is sealed already is refused before anything changes."""
        if self.fault_id in seal.list_ids():
            raise FileExistsError(f"{self.fault_id} is sealed")
        self.inject(at)
        seal.store(self.ground_truth())
        return self.fault_id

    def revert_and_record(self, seal: Seal, at: datetime) -> None:
        self.revert(at)
        seal.mark_reverted(self.fault_id, at)


class SchemaDrift(Fault):
    """parameters: path, renames {old: new}."""

    fault_class = "schema_drift"
    mechanism, symptom = "columns of the table at {path} were renamed: {renames}", "readers of the old names fail"

    def _rename(self, names: dict[str, str], at: datetime) -> None:
        t = Snapshots(self.spark, self.parameters["path"])
        have = t.read().columns
        missing = [c for c in names if c not in have]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}")
        t.overwrite(t.read().withColumnsRenamed(names), at, "RENAME", schema_change=True)

    def apply(self, at):
        self._rename(self.parameters["renames"], at)

    def undo(self, at):
        self._rename({v: k for k, v in self.parameters["renames"].items()}, at)


class ColumnWidening(Fault):
    """parameters: path, column, unique (the column whose value makes it unique)."""

    fault_class = "column_widening"
    mechanism, symptom = "{column} of the table at {path} got the value of {unique} appended", "the model grows and refreshes slow down"

    def apply(self, at):
        t, c = Snapshots(self.spark, self.parameters["path"]), self.parameters["column"]
        df = t.read()
        if not df.where(F.col(c).contains("#")).isEmpty():
            raise ValueError(f"{c} holds the separator: widening it could not be undone")
        t.overwrite(df.withColumn(c, widened(F.col(c), F.col(self.parameters["unique"]))), at, "WIDEN")

    def undo(self, at):
        t, c = Snapshots(self.spark, self.parameters["path"]), self.parameters["column"]
        t.overwrite(t.read().withColumn(c, narrowed(F.col(c))), at, "NARROW")


class SilentZeroRow(Fault):
    """parameters: path of a text file with a header line, backup beside it."""

    fault_class = "silent_zero_row"
    mechanism, symptom = "the file at {path} was cut down to its header", "runs succeed and deliver no rows"

    def _fs(self, path):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _move(self, a: str, b: str) -> None:
        fs, p = self._fs(a)
        if not fs.rename(p, self._fs(b)[1]):
            raise OSError(f"{a} can't become {b}")

    def apply(self, at):
        path = self.parameters["path"]
        backup = path + ".backup"
        fs, p = self._fs(path)
        if fs.exists(self._fs(backup)[1]):
            raise FileExistsError(f"{backup} is there: the file may be cut already, and its backup would be lost")
        stream = fs.open(p)
        reader = self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        header = reader.readLine()
        reader.close()
        if header is None:
            raise ValueError(f"{path} has no header")
        self._move(path, backup)
        out = fs.create(p, False)
        out.write(bytearray((header + "\n").encode()))
        out.close()

    def undo(self, at):
        path = self.parameters["path"]
        fs, b = self._fs(path + ".backup")
        if not fs.exists(b):
            raise FileNotFoundError(f"{path}.backup is not there: nothing to restore")
        fs.delete(self._fs(path)[1], False)
        self._move(path + ".backup", path)


CLASSES = {c.fault_class: c for c in (SchemaDrift, ColumnWidening, SilentZeroRow)}


def rebuild(spark: SparkSession, truth) -> Fault:
    """The fault of a sealed record, ready to be reverted."""
    if truth["fault_class"] not in CLASSES:
        raise ValueError(f"no fault class {truth['fault_class']}")
    made = CLASSES[truth["fault_class"]](spark, truth["target_workspace"], truth["target_item"], truth["seed"], **{k: json.loads(v) for k, v in truth["parameters"].items()})
    made.injected_at = truth["injected_at"]
    if made.fault_id != truth["fault_id"]:
        raise ValueError(f"the record of {truth['fault_id']} does not hold its own parameters")
    return made
