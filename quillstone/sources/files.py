"""Files of a home and files from outside: paper records, listings and sizes, lists of ids, descriptors, downloads that are kept.

Defined results: a folder that isn't there has no files. Names that begin with a dot or an underscore aren't seen, as
in any table that Spark reads.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.remote import Client

FILES = "path string, length long"
DESCRIPTOR = "DescriptorUI string, DescriptorName struct<String:string>, ConceptList struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"
#: What parts the ids of a list from each other and from the lines' ends.
BLANKS = " \t\r\x0b\x0c"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below the folder; their contents aren't read."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], FILES)
        raise


def folder_sizes(files: DataFrame) -> DataFrame:
    """(folder, n_files, length) of the folders that directly hold ``files`` (path, length)."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("length"))


def figure_files(files: DataFrame) -> DataFrame:
    """(doc_key, figures): the images ``fig_<number>.png`` among ``files`` (doc_key, path), in order of the number."""
    number = F.regexp_extract("path", r"(?:^|/)fig_([0-9]{1,9})\.png$", 1)
    own = files.where(number != "").groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct(number.cast("int").alias("n"), "path"))).alias("_found"))
    return own.select("doc_key", F.transform("_found", lambda f: f["path"]).alias("figures"))


def records(files: DataFrame, schema: str) -> DataFrame:
    """The other columns of ``files`` and ``record``, of column ``json``; rows whose JSON is missing, broken or no object are left out."""
    kind = F.schema_of_variant(F.try_parse_json("json"))
    own = [c for c in files.columns if c != "json"]
    return files.where(kind.startswith("OBJECT")).select(*own, F.from_json("json", schema).alias("record"))


def scan_records(spark: SparkSession, home: str, schema: str) -> DataFrame:
    """The records ``papers/<doc_key>/metadata.json`` below a home, in order of doc_key, which is the folder's name whatever the record says."""
    try:
        raw = spark.read.text(f"{home.rstrip('/')}/papers/*/metadata.json", wholetext=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], f"doc_key string, {schema}")
        raise
    # the path is a URI, where a plus stands for itself
    folder = F.url_decode(F.replace(F.regexp_extract("_metadata.file_path", r"/([^/]*)/metadata\.json$", 1), F.lit("+"), F.lit("%2B")))
    found = records(raw.select(folder.alias("doc_key"), F.col("value").alias("json")), schema)
    return found.select("doc_key", "record.*").orderBy("doc_key")


def id_lists(files: DataFrame) -> DataFrame:
    """The other columns of ``files`` (one row a file) with (pos, id): the lines of column ``text`` without blanks around, each id once, empty ones left out."""
    own = [c for c in files.columns if c != "text"]
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return files.select(*own, F.posexplode(F.array_distinct(F.filter(lines, lambda x: x != ""))).alias("pos", "id"))


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(record, ui, heading, term) of the descriptor records of XML files, which are split by record; record is the descriptor's ui."""
    read = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR).load(path)
    terms = F.flatten(F.transform("ConceptList.Concept", lambda c: c["TermList"]["Term"]["String"]))
    return read.select(F.col("DescriptorUI").alias("record"), F.col("DescriptorUI").alias("ui"), F.col("DescriptorName.String").alias("heading"), F.explode_outer(terms).alias("term"))


def downloaded(client: Client, url: str, at: Path, force: bool = False) -> Path:
    """The file at ``url``, fetched once and kept at ``at``: whole or not at all, as it is written beside and then renamed."""
    if force or not at.exists():
        data = client.get(url, {})
        at.parent.mkdir(parents=True, exist_ok=True)
        made = at.with_name(f"{at.name}.part")
        made.write_bytes(data)
        made.replace(at)
    return at
