"""Readers and writers of the reference's formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = r"(O\([^()\n]*(?:\([^()\n]*\))?[^()\n]*\))"
TRUTH = "id string, name string, code string, expected_overall_time string, expected_overall_space string, line_metrics array<struct<lineno:int,time:string,space:string>>, gt_note string"
SUBMISSION = "moduleId string, activityId string, type string, status string, final_aes double, rog double, code_unchanged boolean, timestamp long"


#: Files of a name that is written in parts lie in folders of the parts.
PARTS = "part-*"


def files_by_precedence(spark: SparkSession, folders: list[str], pattern: str) -> list[str]:
    """Paths of the files that match, in a folder or its parts; of files with one name only those of the first folder. Names are listed, nothing is opened."""
    jvm, conf, first = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for folder in folders:
        mine: dict[str, list[str]] = {}
        for where in (jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}") for p in (pattern, f"{PARTS}/{pattern}")):
            for found in where.getFileSystem(conf).globStatus(where) or []:
                mine.setdefault(found.getPath().getName(), []).append(found.getPath().toString())
        first = mine | first
    return [p for n in sorted(first) for p in first[n]]


def scan_ground_truth(spark: SparkSession, folders: list[str], pattern: str = "ground_truth_chunk_*.json") -> DataFrame:
    """Records of all chunk files, each with its file's name; of files with one name only those of the first folder, the others are not opened.

    Each file holds one JSON array; large chunks are files of one name in folders of parts, all of which are read. Records without an id are passed over. Without any file it is an error.
    """
    if not (paths := files_by_precedence(spark, folders, pattern)):
        raise FileNotFoundError(f"no {pattern} in {folders}")
    return spark.read.schema(TRUTH).option("multiLine", True).json(paths).withColumn("source_file", F.col("_metadata.file_name")).where("id is not null")


#: Bytes of records that one file of ``write_arrays`` holds, about.
FILE_BYTES = 64 << 20


def write_arrays(rows: DataFrame, folder: str, name: str, most: int = FILE_BYTES) -> None:
    """Files for each ``chunk``, named by ``name``, that hold its JSON texts (``record``) as arrays, a line each.

    A file goes through one task, and is read by one, so a chunk of more than ``most`` bytes is dealt by a hash of the record over several files
    of its name, each in a folder of its part. The driver renames as many files as there are.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("chunk").agg(F.sum(F.octet_length("record")).alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("chunks")).first()
    parts = max(1, -(-(sizes["n"] or 0) // most))
    rows = rows.select("chunk", F.pmod(F.xxhash64("record"), F.lit(parts)).alias("part"), "record")
    opening = rows.select("chunk", "part").distinct().select("chunk", "part", F.lit(0).alias("at"), F.lit("[").alias("line"))
    body = rows.select("chunk", "part", F.lit(1).alias("at"), F.concat("record", F.lit(",")).alias("line"))
    closing = opening.select("chunk", "part", F.lit(2).alias("at"), F.lit("{}]").alias("line"))  # an empty record ends the list
    tasks = max(2 * parts * sizes["chunks"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = opening.unionByName(body).unionByName(closing).repartition(tasks, "chunk", "part").sortWithinPartitions("chunk", "part", "at")
    whole.select("chunk", "part", "line").write.partitionBy("chunk", "part").text(f"{folder}-parts")
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = path(folder).getFileSystem(conf)
    fs.mkdirs(path(folder))
    for found in fs.globStatus(path(f"{folder}-parts/chunk=*/part=*/part-*")):
        part = found.getPath().getParent()
        into = folder if parts == 1 else f"{folder}/{part.getName().replace('=', '-')}"
        fs.mkdirs(path(into))
        fs.rename(found.getPath(), path(f"{into}/{name.format(part.getParent().getName().split('=')[1])}"))


def split_labels(df: DataFrame, text: str, known: list[str]) -> DataFrame:
    """Pull the two labels off the end of a code text; rows whose labels are unknown go.

    The labels are the last two O(...) of the text, else the last two parts of the last line.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(LABEL), 1)
    last = F.split(F.element_at(F.split(F.col(text), "\n"), -1), ",")
    labels = F.when(F.size(found) >= 2, F.slice(found, -2, 2)).when(F.size(last) >= 2, F.transform(F.slice(last, -2, 2), F.trim))
    out = df.withColumn("__l", labels).where("__l is not null").withColumn("time", F.col("__l")[0]).withColumn("space", F.col("__l")[1])
    return out.where(F.col("time").isin(*known) & F.col("space").isin(*known)).withColumn("name", F.nullif(F.trim(F.regexp_extract(text, r"^\s*#\s*([^\n]*)", 1)), F.lit(""))).drop("__l")


def scan_labelled_csv(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """A header CSV of quoted, multi-line code whose labels are glued to the end."""
    raw = spark.read.schema("code string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return split_labels(raw, "code", known)


def scan_documents(df: DataFrame, column: str = "data", schema: str = SUBMISSION) -> DataFrame:
    """Rows with a JSON document, its known members as typed columns; a member of another type is null."""
    return df.withColumn("doc", F.from_json(column, schema)).drop(column)


def unpack_document(df: DataFrame, column: str, members: dict[str, str], id_col: str | None = None, owners: tuple[str, str] | None = None) -> DataFrame:
    """Lift members of a JSON document to columns; a member that the document holds replaces a column of its name, null too.

    With ``id_col`` there is ``_id``, its text. Of the two columns named by ``owners`` each fills the other where it is null or missing.
    Documents are read as VARIANT, so a member of another type is null and the rest stays.
    """
    doc = df.withColumn("__doc", F.try_parse_json(column)).withColumn("__has", F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")))
    lifted = lambda m, kind: F.try_variant_get("__doc", f"$.{m}", kind)
    one = lambda m, kind: F.when(F.array_contains("__has", m), lifted(m, kind)).otherwise(F.col(m).cast(kind)) if m in df.columns else lifted(m, kind)
    out = doc.select(*[c for c in df.columns if c not in (*members, column)], *[one(m, k).alias(m) for m, k in members.items()])
    if id_col is not None:
        out = out.withColumn("_id", F.col(id_col).cast("string"))
    if owners is not None:
        a, b = ([F.col(c)] if c in out.columns else [] for c in owners)
        out = out.withColumns({owners[0]: F.coalesce(*a, *b), owners[1]: F.coalesce(*b, *a)})
    return out


def migrate_blobs(legacy: DataFrame, users: DataFrame, target: DataFrame) -> DataFrame:
    """Rows (email, item, score) from one JSON map a user.

    Scores that are no numbers become 0, users that are unknown and keys already in the target are passed over.
    """
    rows = legacy.select("email", F.explode(F.from_json("data", "map<string,string>")).alias("item", "value"))
    rows = rows.select("email", "item", F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)).alias("score"))
    return rows.join(users.select("email"), "email", "left_semi").join(target.select("email", "item"), ["email", "item"], "left_anti")


def migration_report(legacy: DataFrame, moved: DataFrame) -> DataFrame:
    """How many entries there were and how many move, without moving them."""
    before = legacy.select(F.explode(F.map_keys(F.from_json("data", "map<string,string>")))).agg(F.count("*").alias("entries"))
    return before.crossJoin(moved.agg(F.count("*").alias("moved"), F.countDistinct("email").alias("users")))


def write_chunks(df: DataFrame, path: str, key: str, size: int = 10, old: DataFrame | None = None) -> None:
    """JSON files of at most ``size`` records; records whose key is written again are replaced."""
    rows = df if old is None else old.join(df.select(key), key, "left_anti").unionByName(df, allowMissingColumns=True)
    rows.write.option("maxRecordsPerFile", size).mode("overwrite").json(path)


def report_tables(rows: DataFrame, metrics: DataFrame, respondents: DataFrame, pre: DataFrame, post: DataFrame) -> dict[str, DataFrame]:
    """The sheets of the export, each from the submission grain but for ``pairs``: a row a respondent, with scores and their difference where both are there."""
    names = {3: "summary", 1: "by_module", 2: "by_respondent", 0: "detail"}
    out = {n: metrics.where(F.col("level") == k).drop("level") for k, n in names.items()}
    both = pre.join(post, "email").withColumn("difference", F.col("post") - F.col("pre"))
    return out | {"submissions": rows, "pairs": respondents.select("email").join(both.select("email", "pre", "post", "difference"), "email", "left")}


def write_report_tables(tables: dict[str, DataFrame], path: str, snapshot_date: str) -> None:
    """One Parquet table a sheet, partitioned by ``snapshot_date``; writing a date again replaces that date alone."""
    for name, df in tables.items():
        dated = df.withColumn("snapshot_date", F.lit(snapshot_date))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(f"{path}/{name}")
