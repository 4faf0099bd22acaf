"""Exports with a commit protocol: staged, hashed, published at once, leased and reused.

An export is a table of files: ``target`` (a relative path), and where its bytes come from (``source``, a path, or
``content``), with the ``sha256`` they must have, if known, and ``about`` (JSON for the manifest). A data-source writer puts
them into a staging folder beside the final one: each task hashes what it writes, compares, and writes its own part of
the manifest. The driver gets one message a task (a count, a size and a digest), never a list of files. When all
tasks are done, documents that describe the whole are added and the folder is renamed: an export is seen whole or not
at all. A failed or killed one leaves a hidden folder, which the next attempt at the same request removes.

A request is named by its signature, the hash of what is asked for and of the table. A lease, made by an exclusive
create, keeps two exports of one signature apart; one that has expired is taken over. A finished export of the same
signature is returned instead of being made again.

Defined cases: an empty table, targets that repeat or leave the folder, rows without bytes and fresh-output violations are
refused before anything is written. Null hashes are not compared. A source that changed since it was hashed fails the export.
Very long files are copied in pieces. Extra columns are ignored. All paths must be open to every executor.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from assayer.functions import kernels
from assayer.operators.records import with_status
from assayer.sources.documents import canonical_json_sha256
from assayer.sources.sinks import segmentation_manifest

FILES = "target string, source string, content binary, sha256 string, about string"
CHUNK = 4 << 20
DOCUMENT, MANIFEST = "export.json", "manifest"


class Refused(ValueError):
    """The export may not run; ``codes`` say why."""

    def __init__(self, *codes: str):
        super().__init__(", ".join(codes))
        self.codes = list(codes)


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _copy(reader, writer) -> tuple[str, int]:
    seen, n = hashlib.sha256(), 0
    while data := reader.read(CHUNK):
        seen.update(data)
        n += len(data)
        if writer is not None:
            writer.write(data)
    return seen.hexdigest(), n


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: int
    bytes: int
    digest: str


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        system, root = _at(self.staging)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.json"  # another attempt has another name
        system.create_dir(f"{root}/{MANIFEST}", recursive=True)
        n = size = 0
        digest = hashlib.sha256()
        with system.open_output_stream(f"{root}/{MANIFEST}/{name}") as lines:
            for batch in batches:
                for i in range(len(batch)):
                    r = {c: batch.column(c)[i].as_py() for c in ("target", "source", "content", "sha256", "about")}
                    sha, length = self._place(system, f"{root}/{r['target']}", r)
                    line = json.dumps({"path": r["target"], "sha256": sha, "bytes": length} | json.loads(r["about"] or "{}"), ensure_ascii=False, sort_keys=True) + "\n"
                    lines.write(line.encode())
                    digest.update(line.encode())
                    n, size = n + 1, size + length
        return Part(name, n, size, digest.hexdigest())

    @staticmethod
    def _place(system, to: str, row: dict) -> tuple[str, int]:
        folder = posixpath.dirname(to)
        system.create_dir(folder, recursive=True)
        beside = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as out:
            if row["content"] is not None:
                out.write(row["content"])
                sha, n = hashlib.sha256(row["content"]).hexdigest(), len(row["content"])
            else:
                other, inner = _at(row["source"])
                with other.open_input_stream(inner) as f:
                    sha, n = _copy(f, out)
        if row["sha256"] is not None and sha != row["sha256"]:
            raise ValueError(f"source_changed_during_delivery: {row['target']}")
        system.move(beside, to)
        return sha, n

    def commit(self, messages: list[Part | None]) -> None:
        """Keeps the manifest parts of the attempts that count and adds up what they say."""
        system, root = _at(self.staging)
        from pyarrow import fs

        parts = sorted((m for m in messages if m), key=lambda m: m.name)
        keep = {m.name for m in parts}
        for f in system.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True)):
            if f.base_name not in keep:
                system.delete_file(f.path)
        total = {"files": sum(m.files for m in parts), "bytes": sum(m.bytes for m in parts), "digest": hashlib.sha256("".join(m.digest for m in parts).encode()).hexdigest()}
        put(f"{self.staging}/.totals.json", total)

    def abort(self, messages: list[Part | None]) -> None:
        remove(self.staging)


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assayer_export"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options["staging"])


def put(path: str, document: object) -> None:
    """A small document; ``document`` is JSON unless it is text."""
    system, inner = _at(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    text = document if isinstance(document, str) else json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)
    with system.open_output_stream(inner) as f:
        f.write(text.encode())


def get(path: str) -> dict | None:
    from pyarrow import fs

    system, inner = _at(path)
    if system.get_file_info(inner).type != fs.FileType.File:
        return None
    with system.open_input_stream(inner) as f:
        return json.loads(f.read())


def exists(path: str) -> bool:
    from pyarrow import fs

    system, inner = _at(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def remove(path: str) -> None:
    from pyarrow import fs

    system, inner = _at(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


class Lease:
    """``<root>/.leases/<signature>.json``: one holder at a time, until it expires."""

    def __init__(self, spark: SparkSession, root: str, signature: str, seconds: float):
        self.spark, self.path, self.seconds = spark, f"{root}/.leases/{signature}.json", seconds

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def acquire(self) -> dict | None:
        """None, or what the present holder wrote."""
        where, system = self._hadoop(self.path)
        for _ in range(3):
            try:
                out = system.create(where, False)  # fails if it is there
            except Exception as e:
                if "exist" not in str(e):
                    raise
                try:
                    held = get(self.path) or {}
                except ValueError:  # its holder is just writing it
                    held = {"until": time.time() + self.seconds}
                if held.get("until", 0) > time.time():
                    return held
                old, _ = self._hadoop(f"{self.path}.{uuid.uuid4().hex}")
                system.rename(where, old)  # of several who try, one succeeds
                system.delete(old, False)
                continue
            out.write(bytearray(json.dumps({"until": time.time() + self.seconds, "holder": uuid.uuid4().hex}).encode()))
            out.close()
            return None
        return {"until": time.time()}

    def release(self) -> None:
        where, system = self._hadoop(self.path)
        system.delete(where, False)


def signature(request: dict, files: DataFrame) -> str:
    """The request and the table's content, in any order of its rows: counts and sums of row hashes."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("target", "source", "sha256", "about")] + [F.coalesce(F.sha2("content", 256), F.lit("\0"))]
    row = F.conv(F.substring(F.sha2(F.concat_ws("\1", *columns), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("s")).first()
    return canonical_json_sha256({"request": request, "n": r["n"], "s": str(r["s"])})


def as_files(df: DataFrame) -> DataFrame:
    """The columns of ``FILES``, those that ``df`` lacks as nulls."""
    kinds = dict(c.split() for c in FILES.split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def file_problems(files: DataFrame) -> list[str]:
    """Why a table of files cannot be exported."""
    outside = F.col("target").isNull() | F.col("target").rlike(r"^/|(?:^|/)\.|//|\\") | F.col("target").isin("", DOCUMENT) | F.col("target").startswith(f"{MANIFEST}/")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("outside"), F.count_if(F.col("source").isNull() & F.col("content").isNull()).alias("no_bytes")).first()
    twice = files.groupBy("target").count().where("count > 1").limit(1).count()
    found = {"export_empty": r["n"] == 0, "target_leaves_folder": r["outside"] > 0, "artifact_binding_incomplete": r["no_bytes"] > 0, "duplicate_target": twice > 0}
    return [code for code, yes in found.items() if yes]


def export(
    spark: SparkSession, files: DataFrame, final: str, request: dict, documents: dict[str, object] | None = None, *, tables: dict[str, DataFrame] | None = None,
    convert: Callable[[DataFrame], DataFrame] | None = None, lease_seconds: float = 3600, partitions: int | None = None,
) -> dict:
    """Publishes ``files`` as the folder ``final``; the result's ``status`` is completed, already_exists or already_running.

    ``documents`` (name to JSON or text) and ``tables`` (name to rows, written as CSV parts) are published with it. ``convert``
    makes the rows that are written from those that were checked and signed. Raises ``Refused``.
    """
    final = final.rstrip("/")
    root, name = posixpath.split(final)
    files = as_files(files)
    if problems := file_problems(files):
        raise Refused(*problems)
    sign = signature(request, files)
    folder, out = F.concat(F.regexp_replace("source", "/[^/]*$", ""), F.lit("/")), F.lit(final + "/")
    if files.where(folder.startswith(out) | out.startswith(folder)).limit(1).count():
        raise Refused("output_overlaps_source")
    if exists(final):
        done = get(f"{final}/{DOCUMENT}")
        if done and done.get("signature") == sign:
            return done | {"status": "already_exists"}
        raise Refused("output_must_be_fresh")
    lease = Lease(spark, root, sign, lease_seconds)
    held = lease.acquire()
    if held:
        return {"status": "already_running", "signature": sign, "until": held.get("until")}
    try:
        _sweep(root, f".staging-{name}-{sign}-")
        staging = f"{root}/.staging-{name}-{sign}-{uuid.uuid4().hex}"
        system, inner = _at(staging)
        system.create_dir(inner, recursive=True)
        try:
            spark.dataSource.register(ExportSource)
            dealt = as_files(convert(files) if convert else files).repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "target")
            dealt.write.format("assayer_export").mode("append").option("staging", staging).save()
            for table, rows in (tables or {}).items():
                rows.write.option("header", True).csv(f"{staging}/{table}")
            for document, value in (documents or {}).items():
                put(f"{staging}/{document}", value)
            totals = get(f"{staging}/.totals.json")
            system.delete_file(f"{inner}/.totals.json")
            done = {"status": "completed", "signature": sign, "request": request} | totals
            put(f"{staging}/{DOCUMENT}", done)
            _rename(spark, staging, final)
        except BaseException:
            remove(staging)
            raise
        return done
    finally:
        lease.release()


def _sweep(root: str, prefix: str) -> None:
    """Removes what an attempt that was killed left behind; the lease says that nobody writes there now."""
    from pyarrow import fs

    system, inner = _at(root)
    for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if f.base_name.startswith(prefix):
            system.delete_dir(f.path)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    system = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(b) or not system.rename(a, b):
        raise Refused("output_must_be_fresh")


def manifest(spark: SparkSession, final: str) -> DataFrame:
    return spark.read.json(f"{final}/{MANIFEST}")


def hashed(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``actual``: the sha256 of each path's bytes, read in pieces; null where there is no such file."""
    rows = files.select(F.col(path).alias("path_"), F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str | None] = []
            for name in batch.column("path_").to_pylist():
                try:
                    system, inner = _at(name or "")
                    with system.open_input_stream(inner) as f:
                        found.append(_copy(f, None)[0])
                except (OSError, pa.ArrowInvalid):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], ["row", "actual"])

    return rows.mapInArrow(run, rows.select("row", F.lit(None).cast("string").alias("actual")).schema).select("row.*", "actual")


#: Kinds of artifacts.
KINDS = ("prediction", "image", "overlay", "summary")


def binding_codes(artifacts: DataFrame, kinds: tuple[str, ...] = (), cases: tuple[str, ...] = (), named: tuple[str, ...] = KINDS) -> list[str]:
    """Why artifacts (kind, case_id, path, sha256, actual) cannot be delivered, gravest first; ``kinds`` and ``cases`` are what is asked for.

    An empty list permits the delivery. Each check is an aggregate over the rows; the driver gets one row of counts.
    """
    summary, case = F.col("kind") == "summary", F.col("case_id")
    bad_case = ~summary & (case.isNull() | (case == "") | case.rlike(r"[/\\\x00]"))
    wanted = F.col("kind").isin(*(kinds or named))
    r = artifacts.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("kind").isin(*named), F.lit(False))).alias("invalid_artifact_kind"), F.count_if(bad_case).alias("invalid_case_id"),
        F.count_if(F.col("path").isNull() | F.col("sha256").isNull()).alias("artifact_binding_incomplete"), F.count_if(F.col("actual").isNull()).alias("result_artifact_missing"),
        F.count_if(F.col("actual") != F.col("sha256")).alias("artifact_hash_mismatch"), F.count_if(summary).alias("summaries"),
    ).first()
    twice = artifacts.groupBy("kind", "case_id").count().where("count > 1").limit(1).count()
    codes = ["result_artifacts_missing"] if not r["n"] else []
    codes += [c for c in ("invalid_artifact_kind", "invalid_case_id") if r[c]]
    codes += ["duplicate_case_artifact"] if twice else []
    codes += [c for c in ("artifact_binding_incomplete", "result_artifact_missing", "artifact_hash_mismatch") if r[c]]
    if any(k not in named for k in kinds):
        codes.append("invalid_requested_artifact_kinds")
    known = artifacts.where(case.isNotNull()).select("case_id").distinct()
    if cases:
        asked = artifacts.sparkSession.createDataFrame([(c,) for c in cases], "case_id string")
        if len(set(cases)) < len(cases) or asked.join(known, "case_id", "left_anti").limit(1).count():
            codes.append("requested_case_missing_or_duplicate")
        known = asked.distinct()
    per_case = [k for k in (kinds or ()) if k != "summary"]
    if per_case:
        have = artifacts.where(wanted & ~summary).join(known, "case_id", "left_semi").select("kind", "case_id").distinct().count()
        if not have or have < len(per_case) * known.count():
            codes.append("requested_artifact_missing")
    if "summary" in kinds and not r["summaries"]:
        codes.append("requested_artifact_missing")
    return list(dict.fromkeys(codes))


def metric_rows(document: DataFrame, text: str = "text") -> DataFrame:
    """(case_id, metric, value) of a summary's ``metrics_per_case``: numbers, truth values and nulls, not nested ones."""
    per = F.from_json(F.get_json_object(text, "$.metrics_per_case"), "map<string,map<string,string>>")
    rows = document.select(F.explode(per).alias("case_id", "m")).select("case_id", F.explode("m").alias("metric", "value"))
    return rows.where(F.col("value").isNull() | F.col("value").rlike(r"^(true|false|-?[0-9.]+([eE][-+]?[0-9]+)?)$"))


def case_key(name: Column) -> Column:
    """A metric's case without its folder, file suffix and channel."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"(\.nii\.gz|\.[A-Za-z]+)$", ""), r"_0000$", "")


def deliver(
    spark: SparkSession, artifacts: DataFrame, final: str, identity: dict, *, expected: dict | None = None, kinds: tuple[str, ...] = (), cases: tuple[str, ...] = (),
    metrics: DataFrame | None = None, **options,
) -> dict:
    """Delivers verified results: artifacts (kind, case_id, path, sha256) of a run, and a table of its metrics if ``metrics`` (a summary's text) is given.

    ``identity`` holds dataset_id and run_id, ``expected`` what they must be. A failed check gives status block with its codes, and nothing is written.
    """
    if not all(isinstance(identity.get(k), str) and identity[k] for k in ("dataset_id", "run_id")):
        return {"status": "block", "reason_codes": ["result_identity_missing"]}
    wrong = [f"{k.removesuffix('_id')}_identity_mismatch" for k in ("dataset_id", "run_id") if (expected or {}).get(k, identity[k]) != identity[k]]
    if wrong:
        return {"status": "block", "reason_codes": wrong}
    codes = binding_codes(hashed(artifacts.select("kind", "case_id", "path", "sha256")), kinds, cases)
    tables = {}
    if metrics is not None:
        rows = metric_rows(metrics)
        own = rows.select("case_id").distinct().withColumn("key", case_key(F.col("case_id")))
        r = own.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys")).first()
        asked = spark.createDataFrame([(c,) for c in cases], "key string")
        codes += ["per_case_metrics_missing"] if not r["n"] else ["ambiguous_metric_case_id"] if r["keys"] < r["n"] else []
        codes += ["selected_case_metrics_missing"] if r["n"] and asked.join(own, "key", "left_anti").limit(1).count() else []
        names = sorted(x["metric"] for x in rows.select("metric").distinct().collect())  # the kinds of metrics
        chosen = rows.where(case_key(F.col("case_id")).isin(*cases)) if cases else rows
        columns = [F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names]
        tables = {"per_case_metrics": chosen.groupBy("case_id").agg(*columns) if columns else chosen}
    if codes:
        return {"status": "block", "reason_codes": codes}
    chosen = artifacts.where(F.col("kind").isin(*kinds)) if kinds else artifacts
    if cases:
        chosen = chosen.where((F.col("kind") == "summary") | F.col("case_id").isin(*cases))
    end = F.regexp_extract("path", r"(\.nii\.gz|\.[^./]+)?$", 1)
    target = F.concat(F.col("kind"), F.lit("/"), F.coalesce("case_id", F.lit("overall")), end)
    about = F.to_json(F.struct("kind", "case_id", F.col("path").alias("source_path")))
    files = chosen.select(target.alias("target"), F.col("path").alias("source"), "sha256", about.alias("about"))
    request = {"dataset_id": identity["dataset_id"], "run_id": identity["run_id"], "kinds": sorted(kinds), "cases": sorted(cases), "table": metrics is not None}
    report = f"<meta charset=\"utf-8\"><h1>Existing results</h1><p>{_plain(identity['dataset_id'])} / {_plain(identity['run_id'])}</p><p>Files: <a href=\"{MANIFEST}\">{MANIFEST}</a></p>"
    return export(spark, files, final, request, {"report.html": report}, tables=tables, **options)


def as_rasters(files: DataFrame, threshold: int = 127) -> DataFrame:
    """``files`` with the ``content`` of 8-bit gray PNGs; what ``about`` calls a label becomes 0 and 1 at the threshold. An unreadable source fails the task."""
    light = files.select("target", "source", "about")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():  # a row a batch: rasters are large
                system, inner = _at(r["source"])
                with system.open_input_stream(inner) as f:
                    pixels = kernels.decode_image(f.read())
                about = json.loads(r["about"])
                if pixels.ndim == 3:
                    pixels = pixels[..., :3].mean(axis=2).round().astype("uint8") if pixels.shape[2] > 2 else pixels[..., 0]
                if about["kind"] == "label":
                    pixels = kernels.threshold(pixels, threshold)
                    about["foreground"] = int(pixels.sum())
                about["shape"] = list(pixels.shape)
                row = {"target": r["target"], "content": kernels.encode_png(pixels), "about": json.dumps(about, sort_keys=True)}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("target", pa.string()), ("content", pa.binary()), ("about", pa.string())]))

    return light.mapInArrow(run, "target string, content binary, about string")


def next_folder(root: str, name: str, minimum: int = 501) -> tuple[int, str]:
    """The next free dataset number below ``root``, and its folder's name."""
    import re

    from pyarrow import fs

    system, inner = _at(root)
    found = [re.match(r"Dataset(\d+)_", f.base_name) for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True))]
    number = max([minimum, *[int(m[1]) + 1 for m in found if m]])
    return number, f"Dataset{number:03d}_{re.sub(r'[^A-Za-z0-9]+', '', name)}"


def export_segmentation(spark: SparkSession, cases: DataFrame, splits: DataFrame, role: str, final: str, name: str, threshold: int = 127, **options) -> dict:
    """A segmentation dataset of one role: images and labels by split as PNG, with its description; see ``export`` for its states.

    Sources are hashed first, so a dataset is made again if any of them changed, and reused otherwise.
    """
    rows = segmentation_manifest(cases, splits, role)
    one = lambda kind: rows.select(F.col(f"{kind}_target").alias("target"), F.col(f"{kind}_path").alias("source"), "case_id", "split", F.lit(kind).alias("kind"))
    found = hashed(one("image").unionByName(one("label")), "source")
    if found.where("actual IS NULL").limit(1).count():
        raise Refused("result_artifact_missing")
    about = F.to_json(F.struct("kind", "case_id", "split", F.col("actual").alias("source_sha256")))
    counts = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.countDistinct("case_id").alias("n")).collect()}
    document = {"name": name, "channel_names": {"0": "image"}, "labels": {"background": 0, role: 1}, "numTraining": counts.get("train", 0), "file_ending": ".png", "description": f"{role} at {threshold}."}
    request = {"role": role, "threshold": threshold, "name": name, "counts": counts}
    return export(spark, found.select("target", "source", about.alias("about")), final, request, {"dataset.json": document}, convert=lambda f: as_rasters(f, threshold), **options)


def export_ready(spark: SparkSession, source: str, quality: DataFrame, final: str, name: str, statuses: Sequence[str] = ("ready",), **options) -> dict:
    """The cases of a published dataset whose quality status (case_id, status) is one of ``statuses``, as a dataset of its own.

    Splits are those of the source's folders. Bytes are compared with the source's manifest while they are copied.
    """
    folder, file = F.regexp_extract("path", r"^(images|labels)(Tr|Val|Ts)/", 2), F.regexp_extract("path", r"([^/]+)$", 1)
    rows = manifest(spark, source).withColumn("folder", folder).where("folder <> ''").withColumn("image", F.col("path").startswith("images"))
    rows = rows.withColumn("case_id", F.when(F.col("image"), F.regexp_replace(file, r"_\d{4}\.[^.]+$", "")).otherwise(F.regexp_replace(file, r"\.[^.]+$", "")))
    chosen = with_status(quality, statuses).select("case_id").distinct()
    held = rows.join(chosen, "case_id", "left_semi")
    per = chosen.join(held.groupBy("case_id").agg(F.count_if("image").alias("images"), F.count_if(~F.col("image")).alias("labels"), F.max("folder").alias("folder")), "case_id", "left")
    r = per.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("folder").isNull()).alias("split_unknown"), F.count_if(F.col("images") == 0).alias("missing_image"),
        F.count_if(F.col("labels") == 0).alias("missing_label"), F.count_if(F.col("folder") == "Tr").alias("train"),
    ).first()
    codes = ["no_selected_cases"] if not r["n"] else [c for c in ("split_unknown", "missing_image", "missing_label") if r[c]]
    if codes or not r["train"]:
        raise Refused(*(codes or ["no_training_cases"]))
    kept = sorted({s.strip().lower() for s in statuses})
    about = get(f"{source}/dataset.json") or {}
    document = about | {"name": name, "numTraining": r["train"], "description": f"{about.get('description', '')} Filtered to QC statuses {kept}.".strip()}
    files = held.select(F.col("path").alias("target"), F.concat(F.lit(source.rstrip("/") + "/"), "path").alias("source"), "sha256", F.to_json(F.struct("case_id", "split", "kind")).alias("about"))
    return export(spark, files, final, {"source": get(f"{source}/{DOCUMENT}")["signature"], "statuses": kept, "name": name}, {"dataset.json": document}, **options)


def _plain(text: str) -> str:
    import html

    return html.escape(text)
