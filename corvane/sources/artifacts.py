"""Built artifacts and reports in a folder any Hadoop file system can hold."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.runtime import keep, rows_of


class NotBuilt(LookupError):
    """The artifact asked for does not exist."""

    code = 404


class Conflict(RuntimeError):
    """A precondition does not hold, or the same job is already running."""

    code = 409


class TooLarge(ValueError):
    code = 413


class Invalid(ValueError):
    code = 422


class Unavailable(RuntimeError):
    code = 503


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(**options) -> str:
    """A short name for *all* options of a build, ranges included, so that a partial build never answers for a whole one."""
    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Artifacts:
    """Named tables under a folder: written beside, then renamed, so a reader sees a whole table or none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, dataset: str, kind: str, key: str = "default") -> str:
        return f"{self.folder}/{dataset.replace('/', '__').replace(':', '__')}/{kind}/{key}"

    def exists(self, dataset: str, kind: str, key: str = "default") -> bool:
        fs, p = _fs(self.spark, self.path(dataset, kind, key))
        return fs.exists(p)

    def write(self, df: DataFrame, dataset: str, kind: str, key: str = "default", force: bool = False) -> bool:
        """Write unless it exists (then False); ``force`` replaces it."""
        if self.exists(dataset, kind, key) and not force:
            return False
        target = self.path(dataset, kind, key)
        beside = f"{target}.{uuid.uuid4().hex}.part"
        df.write.parquet(beside)
        fs, p = _fs(self.spark, target)
        fs.delete(p, True)
        fs.mkdirs(p.getParent())
        fs.rename(_fs(self.spark, beside)[1], p)
        return True

    def read(self, dataset: str, kind: str, key: str = "default") -> DataFrame:
        if not self.exists(dataset, kind, key):
            raise NotBuilt(f"{kind} of {dataset} is not built")
        return self.spark.read.parquet(self.path(dataset, kind, key))

    def built(self) -> list[tuple[str, str, str]]:
        """(dataset folder, kind, key) of every whole artifact."""
        fs, p = _fs(self.spark, self.folder)
        out = []
        if fs.exists(p):
            for s in fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/*/*")) or []:
                parts = s.getPath().toString().rstrip("/").split("/")[-3:]
                if s.isDirectory() and not parts[-1].endswith(".part"):
                    out.append(tuple(parts))
        return sorted(out)

    def delete(self, dataset: str, kind: str | None = None) -> int:
        """Remove a kind, or with none everything of a dataset (index, models, clusters and topics alike); number removed."""
        gone = [x for x in self.built() if x[0] == dataset.replace("/", "__").replace(":", "__") and kind in (None, x[1])]
        for d, k, key in gone:
            fs, p = _fs(self.spark, f"{self.folder}/{d}/{k}/{key}")
            fs.delete(p, True)
        return len(gone)

    def write_json(self, value, dataset: str, name: str) -> None:
        """A small side file, such as a manifest or a report."""
        fs, p = _fs(self.spark, f"{self.path(dataset, 'json', name)}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def read_json(self, dataset: str, name: str):
        path = f"{self.path(dataset, 'json', name)}.json"
        fs, p = _fs(self.spark, path)
        if not fs.exists(p):
            raise NotBuilt(name)
        return json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))


class Reports:
    """Saved evaluation reports: a JSON body, a CSV table of the runs that did not fail, and a sidecar of per-query values.

    Files are written beside and renamed, the body last, so a listed report is whole.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _put(self, name: str, text: str) -> None:
        fs, beside = _fs(self.spark, f"{self.folder}/{name}.part")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = _fs(self.spark, f"{self.folder}/{name}")[1]
        fs.delete(target, False)
        fs.rename(beside, target)

    def save(self, report: DataFrame, per_query: DataFrame | None = None, errors: dict[str, str] | None = None, label: str = "", took: dict[str, float] | None = None) -> str:
        """Store (run_label, metric, value) with the errors of failed runs and the times of the others; the new report's id."""
        rows = rows_of(report.select("run_label", "metric", "value").orderBy("run_label", "metric"), 100_000)
        name = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}{time.time_ns() % 10**9:09d}-{uuid.uuid4().hex[:8]}"
        runs = {}
        for r in rows:
            runs.setdefault(r.run_label, {"label": r.run_label, "metrics": {}, "avg_query_ms": (took or {}).get(r.run_label), "error": None})["metrics"][r.metric] = r.value
        failed = [{"label": k, "metrics": None, "avg_query_ms": None, "error": e} for k, e in (errors or {}).items()]
        text = io.StringIO()
        table = csv.writer(text, lineterminator="\n")
        table.writerows([("run_label", "metric", "value"), *((r.run_label, r.metric, r.value) for r in rows)])
        if per_query is not None:
            per_query.write.parquet(f"{self.folder}/{name}.per_query")
        self._put(f"{name}.csv", text.getvalue())
        self._put(f"{name}.json", json.dumps({"id": name, "label": label, "runs": [*runs.values(), *failed]}, sort_keys=True))
        return name

    def ids(self) -> list[str]:
        """Whole reports, newest first."""
        fs, p = _fs(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted((n.removesuffix(".json") for n in names if n.endswith(".json")), reverse=True)

    def load(self, name: str) -> dict:
        if name not in self.ids():
            raise NotBuilt(name)
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/{name}.json").collect()))

    def table(self, name: str) -> DataFrame:
        """(run_label, metric, value) of a stored report."""
        return self.spark.read.schema("run_label string, metric string, value double").option("header", True).csv(f"{self.folder}/{name}.csv")

    def per_query(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.per_query")

    def delete(self, name: str) -> bool:
        """Remove a report, its body first; False if there is none."""
        there = name in self.ids()
        for end in (".json", ".csv", ".per_query"):
            fs, p = _fs(self.spark, f"{self.folder}/{name}{end}")
            fs.delete(p, True)
        return there


def delete_dataset(spark: SparkSession, tables: dict[str, str], dataset: str, artifacts: Artifacts | None = None) -> dict[str, int]:
    """Rows removed of each table (name to folder, stored by dataset), and the number of artifacts that went with them."""
    gone = {}
    for name, path in tables.items():
        fs, p = _fs(spark, path)
        parts = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and unquote(s.getPath().getName()) == f"dataset={dataset}"] if fs.exists(p) else []
        gone[name] = sum(spark.read.parquet(x.toString()).count() for x in parts)
        for x in parts:
            fs.delete(x, True)
    if artifacts is not None:
        gone["artifacts"] = artifacts.delete(dataset)
    return gone


def reingest(spark: SparkSession, tables: dict[str, str], dataset: str, rows: dict[str, DataFrame], artifacts: Artifacts | None = None, force: bool = False) -> dict[str, int]:
    """Store (name to rows) of one dataset. Rows already there are a :class:`Conflict` unless ``force`` removes them, with all artifacts, first; the
    rows stored of each table. Nothing is removed before all new rows are written beside."""
    there = {n: _fs(spark, p)[0].exists(_fs(spark, p)[1]) and not spark.read.parquet(p).where(F.col("dataset") == dataset).isEmpty() for n, p in tables.items()}
    if any(there.values()) and not force:
        raise Conflict(f"{dataset} is there already")
    fresh = {n: keep(r.where(F.col("dataset") == dataset), "reingest") for n, r in rows.items()}
    if any(there.values()):
        delete_dataset(spark, tables, dataset, artifacts)
    for n, r in fresh.items():
        r.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("append").partitionBy("dataset").parquet(tables[n])
    return {n: r.count() for n, r in fresh.items()}


def complete(store: Artifacts, dataset: str) -> bool:
    """Whether a manifest says that the dataset was fetched whole: only then may it be ingested."""
    try:
        return bool(store.read_json(dataset, "manifest")["complete"])
    except NotBuilt:
        return False


def write_manifest(store: Artifacts, dataset: str, doc_count: int, complete: bool) -> None:
    store.write_json({"dataset_id": dataset, "doc_count": doc_count, "complete": complete, "downloaded_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}, dataset, "manifest")


class Jobs:
    """Builds by (type, key): one at a time each, with state and percent."""

    def __init__(self):
        self.jobs: dict[str, dict] = {}

    def run(self, kind: str, key: str, work, total: int = 0):
        """Run ``work(progress)``; the job's record says how it went. A second active job of the same kind and key is refused."""
        if any(j["type"] == kind and j["key"] == key and j["state"] in ("pending", "running") for j in self.jobs.values()):
            raise Conflict(f"{kind} of {key} is already running")
        job = {"id": uuid.uuid4().hex, "type": kind, "key": key, "state": "running", "processed": 0, "total": total, "percent": 0.0, "error": None, "result": None}
        self.jobs[job["id"]] = job

        def progress(done: int) -> None:
            job["processed"] = done
            job["percent"] = round(min(done / total, 1.0) * 100, 2) if total else 0.0

        try:
            job["result"] = work(progress)
            job["state"] = "skipped" if job["result"] is False else "succeeded"
            job["percent"] = 100.0
        except Exception as e:
            job["state"], job["error"] = "failed", str(e)
        return job
