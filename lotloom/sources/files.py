"""Sources: manifests, templates, lot folders, binary inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotloom.functions import text

#: Header in the file -> column; the last two may be missing.
MANIFEST = {
    "N° Commande": "commande", "N° Client": "client_number", "Distributeur": "distributeur", "Client": "client",
    "Statut": "statut", "Cote": "cote", "Caisse": "caisse",
}
OPTIONAL = ("Cote", "Caisse")

ZONE = "struct<id: string, name: string, type: string, x: int, y: int, width: int, height: int, required: boolean>"
REGION = "struct<id: string, name: string, x: int, y: int, width: int, height: int>"
ARTIFACT = (
    "struct<detector: string, artifactPath: string, maxKeypoints: int, epsilon: int, synthesizedImageCount: int, "
    "buildWidth: int, buildHeight: int, createdAt: string, version: int>"
)
TEMPLATES = (
    f"id string, name string, imagePath string, imageWidth int, imageHeight int, zones array<{ZONE}>, paperIgnoreRegions array<{REGION}>, "
    f"paperFeatureArtifact {ARTIFACT}, useWolfBinarization boolean, createdAt string, updatedAt string, version int"
)


# --- manifests ---


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1; a byte order mark goes."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")), "^﻿", "")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of all files at path: lot_id (the file's name), row_number from 2, trimmed columns.

    Python's csv parses each file in one task, since row numbers count its non-blank records. A file that is empty,
    lacks a required column, or has no row, gives an error.
    """
    listed = spark.read.format("binaryFile").load(path)
    # Spark leaves out files of no bytes
    full = {r.path for r in listed.select("path").toLocalIterator()}
    if len(full) < len(listed.inputFiles()):
        names = {f.rsplit("/", 1)[-1] for f in listed.inputFiles()} - {f.rsplit("/", 1)[-1] for f in full}
        raise ValueError(f"empty manifests: {', '.join(sorted(names))}")
    files = listed.select("path", decoded(F.col("content")).alias("body"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for batch in batches:
            for name, body in zip(batch.path, batch.body, strict=True):
                if not body.strip():
                    raise ValueError(f"{name} is empty")
                reader = csv.DictReader(io.StringIO(body, newline=""), delimiter=";")
                lacking = [h for h in MANIFEST if h not in (reader.fieldnames or []) and h not in OPTIONAL]
                if lacking:
                    raise ValueError(f"{name} lacks columns: {', '.join(lacking)}")
                found = [{c: (r.get(h) or "").strip() for h, c in MANIFEST.items()} for r in reader]
                if not found:
                    raise ValueError(f"{name} has no rows")
                out = pd.DataFrame(found)
                out.insert(0, "row_number", range(2, len(out) + 2))
                out.insert(0, "lot_id", name.rsplit("/", 1)[-1].removesuffix(".csv").replace("%20", " "))
                yield out

    return files.mapInPandas(rows, "lot_id string, row_number long, " + ", ".join(f"{c} string" for c in MANIFEST.values()))


def manifest_projection(raw: DataFrame) -> DataFrame:
    """The manifest columns of a table that has been read by header, trimmed, null as empty."""
    lacking = [h for h in MANIFEST if h not in raw.columns and h not in OPTIONAL]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return raw.select(*[text.strip(F.coalesce(F.col(f"`{h}`"), F.lit(""))).alias(c) if h in raw.columns else F.lit("").alias(c) for h, c in MANIFEST.items()])


# --- binary inputs ---


def read_binary(spark: SparkSession, path: str, pattern: str, magic: dict[str, bytes] | None = None) -> DataFrame:
    """Files at path with `problem`, which says what is wrong: empty, or not of a kind in `magic`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    kinds = magic or {}
    known = F.lit(not kinds)
    for start in kinds.values():
        known = known | (F.substring("content", 1, len(start)) == F.lit(start))
    return files.withColumn("problem", F.when(F.col("length") == 0, F.lit("empty file")).when(~known, F.lit("unexpected content")))


IMAGES = {"png": b"\x89PNG", "jpeg": b"\xff\xd8\xff"}
PDF = {"pdf": b"%PDF"}


def pages_of(files: DataFrame, count: Callable[[bytes], int], render: Callable[[bytes, int, int], bytes], dpi: int = 150, at_once: int = 32) -> DataFrame:
    """A row for each page of each file: path, page_number, image, problem.

    `count` and `render` come from whichever PDF library is there; the engine has none of its own. Files are counted
    first and runs of at_once pages dealt out over tasks, so that many tasks render a long file and its bytes travel
    once a run. A file that can't be counted is one row with page 0 and its problem.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                try:
                    n, problem = int(count(r.content)), None
                except Exception as e:  # noqa: BLE001  a file that fails is a row with its problem
                    n, problem = 0, str(e)
                yield pd.DataFrame({"path": [r.path], "pages": [n], "problem": [problem]})

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                for page in range(r.first, r.last + 1):
                    try:
                        image, problem = render(r.content, page, dpi), None
                    except Exception as e:  # noqa: BLE001  a page that fails is a row with its problem
                        image, problem = None, str(e)
                    yield pd.DataFrame({"path": [r.path], "page_number": [page], "image": [image], "problem": [problem]})

    fine = files.where("problem IS NULL").select("path", "content")
    known = fine.mapInPandas(counted, "path string, pages int, problem string")
    runs = known.where("pages > 0").select("path", "pages", F.explode(F.expr(f"sequence(1, pages, {at_once})")).alias("first"))
    runs = runs.withColumn("last", F.least(F.col("first") + at_once - 1, "pages")).repartition("path", "first")
    pages = runs.join(fine, "path").select("path", "content", "first", "last").mapInPandas(rendered, "path string, page_number int, image binary, problem string")
    return pages.unionByName(known.where("problem IS NOT NULL").select("path", F.lit(0).alias("page_number"), F.lit(None).cast("binary").alias("image"), "problem"))


# --- lot folders ---


def workspaces(files: DataFrame) -> DataFrame:
    """State of each lot folder from a file listing (path, modificationTime)."""
    parts = F.split("path", "/")
    depth = F.size(F.filter(F.transform(parts, lambda p, i: F.when(text.lot_number(p).isNotNull(), i)), lambda i: i.isNotNull()))
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(text.lot_number(p).isNotNull(), i)), lambda i: i.isNotNull()))
    placed = files.select("path", "modificationTime", parts.alias("parts"), depth.alias("depth"), at.alias("at")).where("depth > 0")
    inside = placed.select(
        F.get("parts", F.col("at")).alias("name"),
        F.expr("array_join(slice(parts, at + 2, size(parts)), '/')").alias("file"),
        "modificationTime",
    )
    f, n = F.col("file"), F.col("name")
    root = ~F.contains(f, F.lit("/"))
    pdf, csv = root & f.endswith(".pdf"), root & f.endswith(".csv")
    state = inside.groupBy("name").agg(
        F.coalesce(F.bool_or(f == F.concat(n, F.lit(".pdf"))), F.lit(False)).alias("pdf_present"),
        F.coalesce(F.bool_or(f == F.concat(n, F.lit(".csv"))), F.lit(False)).alias("csv_present"),
        F.bool_or(f.startswith("sep/")).alias("sep_present"),
        F.bool_or(root & f.rlike(r"\.xlsm?$")).alias("workbook_present"),
        F.count_if(pdf & (f != F.concat(n, F.lit(".pdf")))).alias("_pdfs"),
        F.count_if(csv & (f != F.concat(n, F.lit(".csv")))).alias("_csvs"),
        F.max("modificationTime").alias("last_modified"),
    )
    told = lambda when, *what: F.when(when, F.concat(*[F.lit(w) if isinstance(w, str) else w for w in what]))
    errors = F.filter(
        F.array(
            told(~F.col("pdf_present"), "Missing expected PDF: ", n, ".pdf"),
            told(~F.col("csv_present"), "Missing expected CSV: ", n, ".csv"),
            told(F.col("_pdfs") > 0, "Expected exactly one root PDF named ", n, ".pdf"),
            told(F.col("_csvs") > 0, "Expected exactly one root CSV named ", n, ".csv"),
        ),
        lambda e: e.isNotNull(),
    )
    return (
        state.withColumn("errors", errors)
        .withColumns({"lot_number": text.lot_number(n), "status": F.when(F.size("errors") == 0, F.lit("ready")).otherwise(F.lit("incomplete"))})
        .drop("_pdfs", "_csvs")
        .orderBy(F.col("lot_number").desc())
    )


def list_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """State of all lot folders below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return workspaces(files.select("path", "modificationTime"))


def workspace_config(json: Column) -> Column:
    """struct(template_id, paper_threshold) of a config text; what is invalid is null."""
    c = F.from_json(json, "templateId string, paperThreshold string")
    kind = F.get_json_object(json, "$.templateId")
    is_text = json.rlike(r'"templateId"\s*:\s*"')
    return F.struct(F.when(is_text & (kind != ""), kind).alias("template_id"), c["paperThreshold"].try_cast("double").alias("paper_threshold"))


# --- templates ---


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Template records; what was added to the format later has its default (S9). A corrupt file gives no rows."""
    raw = spark.read.schema(TEMPLATES).json(path, multiLine=True, mode="DROPMALFORMED")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return raw.where("id IS NOT NULL").withColumns(
        {
            "zones": empty("zones", ZONE), "paperIgnoreRegions": empty("paperIgnoreRegions", REGION),
            "useWolfBinarization": F.coalesce("useWolfBinarization", F.lit(False)), "version": F.coalesce("version", F.lit(1)),
        }
    )


def find_template(templates: DataFrame, id_: str) -> DataFrame:
    """S10."""
    return templates.where(F.col("id") == id_).limit(1)


def template_list(templates: DataFrame) -> DataFrame:
    """Latest first."""
    return templates.select("id", "name", "imagePath", F.size("zones").alias("zone_count"), "updatedAt", "version").orderBy(F.col("updatedAt").desc(), "id")


def template_problems(templates: DataFrame) -> DataFrame:
    """Templates with what is wrong with them (P23, P24, P30): names, sizes, regions outside the image, repeated names."""
    outside = lambda z: (z["x"] < 0) | (z["y"] < 0) | (z["width"] < 10) | (z["height"] < 10) | (z["x"] + z["width"] > F.col("imageWidth")) | (z["y"] + z["height"] > F.col("imageHeight"))
    names = F.transform("zones", lambda z: F.trim(z["name"]))
    problems = F.filter(
        F.array(
            F.when(F.trim("name") == "", F.lit("name is blank")),
            F.when(F.exists("zones", outside), F.lit("a zone leaves the image or is too small")),
            F.when(F.exists("paperIgnoreRegions", outside), F.lit("an ignored region leaves the image or is too small")),
            F.when(F.size(F.array_distinct(names)) < F.size(names), F.lit("zone names repeat")),
            F.when(F.exists(names, lambda n: n == ""), F.lit("a zone name is blank")),
        ),
        lambda p: p.isNotNull(),
    )
    return templates.select("id", problems.alias("problems")).where(F.size("problems") > 0)


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new in place of those with the same key (K8)."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """K9."""
    return old.join(keys.select(key), key, "left_anti")


def next_version(templates: DataFrame, now: Column) -> DataFrame:
    return templates.withColumns({"version": F.col("version") + 1, "updatedAt": now})


class VersionedTable:
    """A table of which each save is a new folder; a pointer row, written last, says which one holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, df: DataFrame) -> str:
        """Writes a version, and makes it the current one only when it is complete."""
        run = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/run_id={run}")
        self.spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{self.path}/current")
        return run

    def versions(self) -> DataFrame:
        order = Window.orderBy(F.col("at").desc())  # a row for each save
        return self.spark.read.parquet(f"{self.path}/current").withColumn("age", F.row_number().over(order) - 1)

    def load(self, age: int = 0) -> DataFrame:
        """The current version, or the one that many saves ago."""
        run = self.versions().where(F.col("age") == age).first()["run"]
        return self.spark.read.parquet(f"{self.path}/run_id={run}")
