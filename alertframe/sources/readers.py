"""Readers of bulletins, labels and tables, batch and streaming."""

from __future__ import annotations

import json
import tarfile
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .. import schemas
from ..functions import scalars as S
from ..text import taxonomy

TOPIC = "gcn.circulars"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records from .json (one object or an array per file), .jsonl, or a directory of such files."""
    suffix = PurePosixPath(path).suffix.lower()
    reader = spark.read.schema(schemas.RECORD)
    if suffix in (".jsonl", ".ndjson"):
        return reader.json(path)
    if suffix == ".json":
        return reader.option("multiLine", True).json(path)
    if suffix:
        raise ValueError(f"unsupported suffix {suffix!r}: {path}")
    reader = reader.option("recursiveFileLookup", True)
    whole = reader.option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    lines = spark.read.schema(schemas.RECORD).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    return whole.unionByName(lines)


def to_circulars(records: DataFrame) -> DataFrame:
    raw, number = S.id_parts(F.col("circularId"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return records.select(
        number.alias("circular_id"), raw.alias("circular_id_raw"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"), blank("eventId").alias("event_id"),
        F.col("createdOn").alias("created_on"), blank("submitter").alias("submitter"), blank("format").alias("format"), blank("bibcode").alias("bibcode"), F.lit(None).cast("timestamp").alias("trigger_time"),
    )


def archive(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one-object files as records in order of their file names (column file)."""
    rows = spark.read.schema(schemas.RECORD).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def to_parquet(records: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Records once and for all as Parquet, in ranges of their id, so that later reads open few files and skip most."""
    records.repartitionByRange("circularId").sortWithinPartitions("circularId").write.option("maxRecordsPerFile", per_file).mode("overwrite").parquet(path)


def found_and_missing(circulars: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int]:
    """fetch(), and how many of the wanted ids there are none of."""
    missing = wanted.join(circulars.select("circular_id"), "circular_id", "left_anti").count()
    return fetch(circulars, wanted), missing


def first_ids(rows: DataFrame, most: int, label: str | None = None) -> DataFrame:
    """The first ids in order, of the rows with that topic label if one is given: a cap that is the feature asked for."""
    own = rows.filter(F.col("label") == label) if label else rows
    return own.select("circular_id").distinct().orderBy("circular_id").limit(most)


def with_bodies(gold: DataFrame, circulars: DataFrame) -> DataFrame:
    """Gold rows with the subject and body of their bulletins; gold without a bulletin goes."""
    return gold.join(circulars.select("circular_id", "subject", "body"), "circular_id")


def only_loaded(gold: DataFrame, circulars: DataFrame) -> DataFrame:
    return gold.join(circulars.select("circular_id"), "circular_id", "left_semi")


def gold_pairs(gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read_gold() as two tables of records, what is stated and what was predicted: event, redshift, telescope, measure."""

    def side(prefix: str) -> DataFrame:
        has = lambda c: F.col(prefix + c) if prefix + c in gold.columns else F.lit(None).cast("string")
        z = F.regexp_extract(has("redshift"), r"(\d+(?:\.\d+)?)", 1)
        return gold.select("circular_id", S.grb_name(has("event")).alias("event"), F.nullif(z, F.lit("")).cast("double").alias("redshift"), has("telescope").alias("telescope"), F.lower(has("measure")).alias("measure"))

    return side(""), side("pred_")


def fetch(circulars: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ids' rows (column circular_id) in the order of column ord; ids that are missing are left out."""
    return wanted.join(circulars, "circular_id").orderBy("ord").drop("ord")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """circular_id, subject, date, label; ids that are not positive whole numbers are dropped."""
    rows = spark.read.csv(path, header=True)
    return rows.select(S.positive_id(F.col("`Circular ID`")).alias("circular_id"), F.col("Subject").alias("subject"), F.col("Date").alias("date"), F.col("Label").alias("label")).filter("circular_id is not null")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A redshift gold table with quoted multi-line texts; sentinels are null."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    named = {"Text": "text", "Actual Redshift": "redshift", "Predicted Redshift": "pred_redshift", "Actual GRB Number": "event", "Predicted GRB Number": "pred_event"}
    named |= {"Actual Telescope Name": "telescope", "Predicted Telescope Name": "pred_telescope", "Actual Redshift Type": "measure", "Predicted Redshift Type": "pred_measure", "Circular Date": "date"}
    cols = [S.or_nothing(F.col(f"`{c}`")).alias(n) for c, n in named.items() if c in rows.columns]
    return rows.select(S.positive_id(F.col("`Circular Number`")).alias("circular_id"), *cols)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A directory of *.label.json files."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.label.json").json(path)


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("circular_id long, stratum string").option("multiLine", True).json(path)


def replay(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A directory of record files as a stream, oldest files first."""
    return spark.readStream.schema(schemas.RECORD).option("maxFilesPerTrigger", per_trigger).option("multiLine", True).json(path)


def messages(raw: DataFrame) -> DataFrame:
    """Records of messages (column value), and bad: the text of those that are no record, which nothing drops in silence."""
    text = F.col("value").cast("string")
    parsed = raw.select(F.from_json(text, schemas.RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), text.alias("text"))
    whole = F.col("r._bad").isNull() & F.col("r.circularId").isNotNull()
    return parsed.select("r.*", F.when(~F.coalesce(whole, F.lit(False)), F.col("text")).alias("bad")).drop("_bad")


def kafka(spark: SparkSession, servers: str, topic: str = TOPIC, **options: str) -> DataFrame:
    """The live topic's records (see messages()); needs the Kafka connector on the class path."""
    return messages(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load())


def fetch_one(base: str, number: int, timeout: float = 30) -> dict | None:
    """One bulletin by its id over HTTP; None if there is none."""
    try:
        with urllib.request.urlopen(f"{base}/{number}.json", timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            return None
        raise


def _as_row(x: dict) -> tuple:
    return tuple(x.get(f.split()[0]) for f in schemas.RECORD.split(", "))  # without a session


class _RangePoller(SimpleDataSourceStreamReader):
    """Upward by id, up to the first that does not exist yet; ids in `known` are skipped, and requests are `delay` apart."""

    def __init__(self, base: str, start: int, most: int, delay: float = 0.0, known: str = "") -> None:
        self.base, self.start, self.most, self.delay = base, start, most, delay
        self.known = {int(p.stem) for p in Path(known).glob("*.json") if p.stem.isdigit()} if known else set()

    def initialOffset(self) -> dict:
        return {"id": self.start}

    def _get(self, number: int) -> tuple | None:
        time.sleep(self.delay)
        x = fetch_one(self.base, number)
        return None if x is None else _as_row(x)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start["id"]
        while len(rows) < self.most:
            if at not in self.known:
                if (row := self._get(at)) is None:
                    break
                rows.append(row)
            at += 1
        return iter(rows), {"id": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for r in map(self._get, (k for k in range(start["id"], end["id"]) if k not in self.known)) if r is not None])


class _FolderReplay(SimpleDataSourceStreamReader):
    """Files of one record each in order of the number in their name (other names: 0), `most` a batch."""

    def __init__(self, folder: str, most: int) -> None:
        number = lambda p: int(p.stem) if p.stem.isdigit() else 0
        self.files = sorted(Path(folder).glob("*.json"), key=lambda p: (number(p), p.name))
        self.most = most

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _rows(self, a: int, b: int) -> list[tuple]:
        read = (json.loads(p.read_text(encoding="utf-8")) for p in self.files[a:b])
        return [_as_row(x) for x in read if x.get("circularId") is not None]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["at"] + self.most, len(self.files))
        return iter(self._rows(start["at"], end)), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["at"], end["at"]))


class BulletinArchive(DataSource):
    """Streaming source "bulletins": options url, start, most, delay and known (a folder of files that are there already)."""

    @classmethod
    def name(cls) -> str:
        return "bulletins"

    def schema(self) -> str:
        return schemas.RECORD

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        o = self.options
        return _RangePoller(o["url"], int(o.get("start", 1)), int(o.get("most", 100)), float(o.get("delay", 0)), o.get("known", ""))


class BulletinFolder(DataSource):
    """Streaming source "bulletin-folder": options folder and most."""

    @classmethod
    def name(cls) -> str:
        return "bulletin-folder"

    def schema(self) -> str:
        return schemas.RECORD

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return _FolderReplay(self.options["folder"], int(self.options.get("most", 1)))


def untar(spark: SparkSession, tarball: str, out: str, force: bool = False) -> str:
    """Unpacks an archive once (a sentinel file says so) and gives the directory; the driver's own file system."""
    folder = Path(out)
    done = folder / ".unpacked"
    if force or not done.exists():
        folder.mkdir(parents=True, exist_ok=True)
        with tarfile.open(tarball) as t:
            t.extractall(folder, filter="data")
        done.touch()
    return str(folder)


def taxonomy_tables(spark: SparkSession, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """alias_lower, canonical, ord (the first claim of a name has it), and class, path; folder: another version's YAML files."""
    entries = taxonomy.load(folder) if folder else taxonomy.builtin()
    claims = [(a.lower(), name, k) for k, (name, _, more) in enumerate(entries) for a in (name, *more)]
    aliases = spark.createDataFrame(claims, "alias_lower string, canonical string, ord int")
    first = aliases.groupBy("alias_lower").agg(F.min_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))
    return first, spark.createDataFrame(list(taxonomy.paths_of(entries).items()), "class string, path array<string>")
