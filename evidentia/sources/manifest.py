"""Corpus manifests: reading, validation, selection, and reconciliation with files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import replies as R
from evidentia.schemas import MANIFEST, MANIFEST_DOCUMENT

#: Fixed value: the form of a document's stable id.
SLUG = r"\A[a-z0-9]+(?:[._-][a-z0-9]+)*\z"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as it is, one row; a malformed one raises an error."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True, mode="FAILFAST")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of manifests as they are, one row for each file of the path; a path without any raises FileNotFoundError."""
    rows = spark.read.option("wholetext", True).option("ignoreMissingFiles", False).text(path).select(F.input_file_name().alias("name"), F.col("value").alias("text"))
    if rows.isEmpty():
        raise FileNotFoundError(f"no manifest in {path}")
    return rows


def checked(texts: DataFrame, name: str = "name", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents of manifests that may be malformed, and what is wrong with each: a row for each fault, and no error.

    Documents have (name, document_index, the fields of a document) and are whole: each has all fields, of the right kind.
    Faults have (name, document_index, problem); the index is null where the manifest itself is at fault.
    """
    own = texts.select(F.col(name).alias("name"), R.parsed(F.col(text)).alias("v"))
    fields = [f.name for f in MANIFEST_DOCUMENT.fields if f.name != "enabled"]
    documents = R.list_at(F.col("v"), "$.documents")
    whole = [F.when(R.text_at(F.col("v"), f"$.{c}").isNull(), f"{c} must be a text") for c in ("schema_version", "corpus_id", "corpus_version")]
    whole.append(F.when(F.coalesce(F.size(documents), F.lit(0)) <= 0, "documents must be a list that isn't empty"))
    unreadable = F.when(F.col("v").isNull(), F.array(F.lit("manifest is no JSON"))).when(R.kind(F.col("v")) != "OBJECT", F.array(F.lit("manifest must be an object")))
    faults = own.select("name", F.lit(None).cast("int").alias("document_index"), F.explode(F.coalesce(unreadable, F.array_compact(F.array(*whole)))).alias("problem"))
    rows = own.select("name", F.posexplode(documents).alias("document_index", "d"))
    is_object = F.coalesce(R.kind(F.col("d")) == "OBJECT", F.lit(False))
    read = [R.text_at(F.col("d"), f"$.{c}").alias(c) for c in fields] + [R.of_kind(F.col("d"), "$.enabled", "BOOLEAN", "boolean").alias("enabled")]
    missing = [F.when(R.at(F.col("d"), f"$.{c}").isNull(), f"{c} is missing") for c in [*fields, "enabled"]]
    wrong = [F.when(R.at(F.col("d"), f"$.{c}").isNotNull() & F.col(c).isNull(), f"{c} must be {'true or false' if c == 'enabled' else 'a text'}") for c in [*fields, "enabled"]]
    rows = rows.select("name", "document_index", "d", is_object.alias("ok"), *read)
    problems = F.when(F.col("ok"), F.array_compact(F.array(*missing, *wrong))).otherwise(F.array(F.lit("document must be an object")))
    rows = rows.withColumn("problems", problems)
    faults = faults.unionByName(rows.select("name", "document_index", F.explode("problems").alias("problem")))
    return rows.filter(F.size("problems") == 0).select("name", "document_index", *fields, "enabled"), faults


def corpus_violations(raw: DataFrame) -> DataFrame:
    """(problem) of the manifest as a whole: its own fields, and documents that are missing or none."""
    checks = [F.when(F.col(c).isNull() | (F.trim(c) == ""), f"{c} must be a text") for c in ("schema_version", "corpus_id", "corpus_version")]
    checks.append(F.when(F.col("documents").isNull() | (F.size("documents") == 0), "documents must be a list that isn't empty"))
    return raw.select(F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(document_index, the manifest's fields, documents' fields) of a JSON file; a malformed one raises an error.

    A manifest without documents gives no row; ``corpus_violations`` tells it.
    """
    rows = read_raw(spark, path)
    return rows.select("schema_version", "corpus_id", "corpus_version", F.posexplode("documents").alias("document_index", "d")).select("document_index", "schema_version", "corpus_id", "corpus_version", "d.*")


def violations(documents: DataFrame) -> DataFrame:
    """(document_index, problem): fields that are missing or blank, ids that are no slugs, file names that are no PDF base
    names, and ids and file names that repeat, case aside (with the first index in the problem)."""
    strings = [f.name for f in MANIFEST_DOCUMENT.fields if f.name != "enabled"]
    name = F.col("file_name")
    checks = [F.when(F.col(c).isNull() | (F.trim(c) == ""), f"{c} must be a text") for c in strings]
    checks += [
        F.when(F.col("enabled").isNull(), "enabled must be true or false"),
        F.when(~F.trim("document_id").rlike(SLUG), "document_id is no slug"),
        F.when(name.contains("/") | ~F.lower(F.trim(name)).rlike(r".\.pdf\z"), "file_name is no PDF base name"),
    ]
    own = documents.select("document_index", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    for c in ("document_id", "file_name"):
        key = F.lower(F.trim(c))
        first = documents.groupBy(key.alias("_k")).agg(F.min("document_index").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        again = documents.withColumn("_k", key).join(first, "_k").filter("document_index > _first")
        own = own.unionByName(again.select("document_index", F.concat(F.lit(f"{c} repeats that of document "), F.col("_first").cast("string")).alias("problem")))
    return own


def select(documents: DataFrame, ids: list[str] | None = None, all_enabled: bool = False) -> DataFrame:
    """Enabled documents: all, or those of ``ids`` in their order, each once. Unknown and disabled ids raise an error."""
    if bool(ids) == all_enabled:
        raise ValueError("give either ids or all_enabled")
    if all_enabled:
        return documents.filter("enabled")
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(k, i) for k, i in enumerate(dict.fromkeys(ids))], "position int, document_id string")
    rows = wanted.join(documents, "document_id", "left")
    wrong = F.raise_error(F.concat(F.lit("unknown or disabled document: "), F.col("document_id")))
    return rows.withColumn("position", F.when(F.coalesce("enabled", F.lit(False)), F.col("position")).otherwise(wrong.cast("int")))


def reconcile(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(file_name, problem): files of the manifest that are missing (by exact name), and files unknown to it (case aside)."""
    missing = documents.select("file_name").join(files.select("file_name"), "file_name", "left_anti").select("file_name", F.lit("missing").alias("problem"))
    known = documents.select(F.lower("file_name").alias("_k")).distinct()
    unknown = files.withColumn("_k", F.lower("file_name")).join(known, "_k", "left_anti").select("file_name", F.lit("unknown").alias("problem"))
    return missing.unionByName(unknown)
