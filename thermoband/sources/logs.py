"""Logger files: directories of CSVs whose headers may differ."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermoband.functions import clock
from thermoband.functions.categories import unite
from thermoband.schemas import BODY_RAW, ENV_RAW, LAB_RAW
from thermoband.session import broadcast_if_small, durable
from thermoband.sources.tables import CSV_TIME

def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, matched by column name; missing columns are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


#: How files are quoted: a quote inside quotes is doubled (a stray backslash stands for itself).
CSV = {"nullValue": "NA", "escape": '"'}


def _value(text: Column, dtype: T.DataType) -> Column:
    """A field's text as a value, by the CSV reader's own rules; unreadable ones are NULL."""
    if isinstance(dtype, T.StringType):
        return text
    schema = T.StructType([T.StructField("v", dtype)])
    return F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), CSV | {"timestampNTZFormat": CSV_TIME})["v"]


def _fields(line: Column, n: int) -> Column:
    """The fields of a line as an array of `n` texts; empty ones and NA are missing, in quotes too."""
    names = [f"c{i}" for i in range(n)]
    row = F.from_csv(line, ", ".join(f"{c} string" for c in names), CSV)
    return F.array(*[F.nullif(row[c], F.lit("")) for c in names])


def _listed(spark: SparkSession, path: str) -> tuple[list[str], list[str], bool]:
    """Files of a folder (or of all that a pattern fits) that Spark lists, those that it hides, since their names start
    with an underscore, and whether there are folders that it would take for partitions."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = given.getFileSystem(spark._jsc.hadoopConfiguration())
    roots = store.globStatus(given)
    if not roots:
        raise FileNotFoundError(path)
    found = [f for root in roots for f in (store.listStatus(root.getPath()) if root.isDirectory() else [root])]
    files = sorted(f.getPath().toString() for f in found if f.isFile())
    hidden = [name for name in files if name.rpartition("/")[2].startswith("_")]
    seen = [name for name in files if not name.rpartition("/")[2].startswith(("_", "."))]
    return seen, hidden, any(f.isDirectory() and "=" in f.getPath().getName() for f in found)


def _lines(reader: DataFrameReader, path: str | list[str]) -> DataFrame:
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )


def log_lines(spark: SparkSession, path: str, subfolders: bool = False) -> DataFrame:
    """Every line of every file of a folder: file, block (where its part of the file starts), place (ascending within it), line.

    Folders in it are left out unless `subfolders` is set. Files whose names start with a point are left out. Those that
    start with an underscore, which Spark hides, are read under other names, through links that hold for this read only
    (in `subfolders` they stay hidden).
    """
    seen, hidden, partitions = _listed(spark, path)
    reader = spark.read.option("recursiveFileLookup", subfolders)
    lines = _lines(reader, seen if partitions and not subfolders else path) if seen or subfolders else None
    if hidden:
        store = f"hidden-{uuid.uuid4().hex}"
        if any(name.startswith("viewfs:") for name in hidden):
            raise ValueError(f"files with names that start with _ can't be read from this store: {hidden[:5]}")
        links = {f"viewfs://{store}/f{i}": name for i, name in enumerate(hidden)}
        reader = spark.read
        for link, name in links.items():
            reader = reader.option(f"fs.viewfs.mounttable.{store}.link./{link.rpartition('/')[2]}", name)
        names = F.create_map(*[F.lit(x) for pair in links.items() for x in pair])
        linked = _lines(reader, list(links)).withColumn("file", names[F.col("file")])
        lines = linked if lines is None else lines.union(linked)
    if lines is None:
        raise FileNotFoundError(f"no files in {path}")
    return lines


#: Places in a record at the end of a stretch of text: in a field, in quotes, just after a quote, at the start.
_FIELD, _QUOTED, _CLOSED, _START = range(4)
#: Lines of a record at most; more of them are taken for a quote that is not closed.
MOST_LINES = 10_000


def _in_quotes(line: Column, start: int) -> Column:
    """Whether a line that begins at `start` ends inside quotes. A quote opens at the start of a field only."""

    def step(at: Column, text: Column) -> Column:
        opens = text.endswith(",") | ((text == "") & at.isin(_START, _CLOSED))
        return F.when(at == _QUOTED, _CLOSED).when(opens, _QUOTED).otherwise(_FIELD)

    parts = F.split(line, '"')
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(start), step) == _QUOTED


def _composed(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """`known` and `quoted` after each row and all before it in `within`.

    A row maps the state before it (in quotes or not) to the one after it: `known` rows to `quoted` whatever it was,
    others turn it round if `quoted` is set. So the state after a row is that of the last known row, turned round once
    for each later row that does so.
    """
    upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum((~F.col("known") & F.col("quoted")).cast("int")).over(upto)
    rows = rows.withColumn("_turns", turns)
    last = F.last(F.when(F.col("known"), F.struct("quoted", "_turns")), ignorenulls=True).over(upto)
    rows = rows.withColumn("_last", last)
    odd = (F.col("_turns") - F.coalesce("_last._turns", F.lit(0))) % 2 == 1
    return rows.withColumns({"known": F.col("_last").isNotNull(), "quoted": F.coalesce("_last.quoted", F.lit(False)) != odd}).drop("_turns", "_last")


def _joined(lines: DataFrame) -> DataFrame:
    """Records of files in which some go over several lines.

    Each block of a file finds out what it does to either state at its start; over the blocks of a file that gives the
    state each one really starts in, and so each line. A record starts at a line outside quotes and holds the lines
    that follow inside them, also those of the next blocks. Blocks are read by as many tasks as before.
    """
    either = {"_out": _in_quotes(F.col("line"), _START), "_in": _in_quotes(F.col("line"), _QUOTED)}
    mapped = lines.withColumns(either).withColumns({"known": F.col("_out") == F.col("_in"), "quoted": F.col("_out")})
    after = durable(_composed(mapped.drop("_out", "_in"), ["file", "block"], "place"))
    blocks = after.groupBy("file", "block").agg(F.max_by(F.struct("known", "quoted"), "place").alias("s"))
    ends = _composed(blocks.select("file", "block", "s.known", "s.quoted"), ["file"], "block")
    by_block = Window.partitionBy("file").orderBy("block")
    starts = ends.select("file", "block", F.coalesce(F.lag("quoted").over(by_block), F.lit(False)).alias("_begun"))
    open_ = [r.file for r in ends.groupBy("file").agg(F.max_by("quoted", "block").alias("q")).where("q").limit(5).collect()]
    if open_:
        raise ValueError(f"a quote is not closed in {open_}")
    by_line = Window.partitionBy("file", "block").orderBy("place")
    before = F.lag(F.struct("known", "quoted")).over(by_line)
    rows = after.withColumn("_before", before).join(broadcast_if_small(durable(starts)), ["file", "block"])
    inside = F.when(F.col("_before").isNull(), F.col("_begun")).when(F.col("_before.known"), F.col("_before.quoted"))
    inside = inside.otherwise(F.col("_begun") != F.col("_before.quoted"))
    rows = rows.withColumn("_of", F.when(~inside, F.struct("block", "place")))
    rows = rows.withColumn("_of", F.last("_of", ignorenulls=True).over(by_line))
    lasts = rows.groupBy("file", "block").agg(F.max("_of").alias("_end"))
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("file", "block", F.last("_end", ignorenulls=True).over(earlier).alias("_end"))
    rows = rows.join(broadcast_if_small(durable(lasts)), ["file", "block"]).withColumn("_of", F.coalesce("_of", "_end"))
    long_ = [r.file for r in rows.groupBy("file", "_of").count().where(F.col("count") > MOST_LINES).limit(5).collect()]
    if long_:
        raise ValueError(f"a record of more than {MOST_LINES} lines in {long_}")
    records = rows.groupBy("file", "_of").agg(F.array_sort(F.collect_list(F.struct("block", "place", "line"))).alias("held"))
    return records.select("file", "_of.block", "_of.place", F.array_join("held.line", "\n").alias("line"))


def log_records(spark: SparkSession, path: str, subfolders: bool = False) -> DataFrame:
    """The records of every file of a folder, as `log_lines`; fields in quotes may hold line breaks (read as a single
    line feed). Blank records are left out. A quote that is never closed is an error.

    Files without such fields are read as they lie; only the lines of the others are brought together, once, and written.
    """
    lines = log_lines(spark, path, subfolders)
    broken = lines.filter(F.col("line").contains('"')).filter(_in_quotes(F.col("line"), _START)).select("file").distinct()
    broken = durable(broken)
    if not broken.isEmpty():
        broken = broadcast_if_small(broken)
        lines = lines.join(broken, "file", "left_anti").union(durable(_joined(lines.join(broken, "file", "left_semi"))))
    return lines.filter(F.trim("line") != "")


def with_headers(lines: DataFrame, path: str, headers: bool = False) -> tuple[DataFrame, list[str]]:
    """The records (file, block, place, line) below the first of their file with the file's `names` and their `fields`,
    and all names that occur. With `headers` the first ones are there too, marked by `is_header`. Fields without a name
    are not read. Two small jobs learn the names and the largest number of fields, since a plan needs its columns; the
    names of all files are as many as the columns of the result."""
    first = durable(lines.filter("block = 0").groupBy("file").agg(F.min_by("line", "place").alias("header")))
    commas = F.length("header") - F.length(F.regexp_replace("header", ",", "")) + 1
    widest = first.agg(F.max(commas)).first()[0]
    if widest is None:
        raise FileNotFoundError(f"no lines in the files of {path}")
    clean = F.regexp_replace("header", "^\ufeff", "")
    names = F.transform(_fields(clean, widest), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    named = durable(first.select(F.col("file").alias("of_file"), "header", names.alias("names")))
    found = sorted(r[0] for r in named.select(F.explode("names")).distinct().collect() if r[0])
    # Lines are joined to their file's header; a large file is split only if they need not be dealt out by file.
    rows = lines.join(broadcast_if_small(named), F.col("file") == F.col("of_file")).withColumn("is_header", F.col("line") == F.col("header"))
    rows = rows if headers else rows.filter("NOT is_header").drop("is_header")
    return rows.withColumn("fields", _fields(F.col("line"), widest)), found


def read_log_dir(spark: SparkSession, path: str, schema: T.StructType, subfolders: bool = False) -> DataFrame:
    """All files of a folder, each read by its own header, whatever their names and number.

    A plain folder read matches columns by position and would swap values when
    a file orders its header differently. Here the folder is read as records
    (see `log_records`); the first one of a file is its header, which names the
    fields of the others. Columns that a file lacks are NULL; columns outside
    `schema` are text; files without lines give no rows; a record equal to its
    file's header is no reading. `_file`, `_block`, `_place` tell where a row stands.
    """
    rows, found = with_headers(log_records(spark, path, subfolders), path)
    types = {f.name.lower(): f.dataType for f in schema}

    def column(name: str) -> Column:
        text = F.get("fields", (F.array_position("names", name) - 1).cast("int"))
        # position 0 means that the file has no such column
        text = F.when(F.array_contains("names", name), text)
        return _value(text, types.get(name, T.StringType())).alias(name)

    return rows.select(
        *[column(n) for n in [*types, *(n for n in found if n not in types)]],
        F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("place").alias("_place"),
    )


def _order() -> Column:
    """Readings of one time keep the order of their files and lines."""
    return F.struct("_file", "_block", "_place")


def unreadable_times(raw: DataFrame, text: Column, parsed: Column) -> DataFrame:
    """For each file of `read_log_dir` its readings and how many have a time that can't be read."""
    bad = text.isNotNull() & parsed.isNull()
    return raw.groupBy(F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_unreadable")
    )


def body_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Body-temperature logger files; times are rounded to the hour."""
    raw = read_log_dir(spark, folder, BODY_RAW)
    read_at = clock.parse_mdy_hms(unite(" ", "date", "time"))
    return raw.select(
        _order().alias("obs_id"),
        read_at.alias("read_at"),
        F.col("snakeid").alias("original_id"),
        F.substring("snakeid", 1, 1).alias("type"),
        "location",
        clock.round_hour(read_at).alias("datetime"),
        "temp",
    )


def env_logs(spark: SparkSession, file: str) -> DataFrame:
    """Readings of the environment models."""
    raw = read_log_dir(spark, file, ENV_RAW).drop("date", "time", "time_int")
    read = raw.withColumns({"datetime": clock.parse_mdy_hm("datetime"), "obs_id": _order()})
    return read.drop("_file", "_block", "_place")


def lab_logs(spark: SparkSession, file: str) -> DataFrame:
    """Readings of the lab gradient."""
    raw = read_log_dir(spark, file, LAB_RAW)
    united = raw.withColumn("datetime", unite(" ", "date", "time")).drop("date", "time", "_file", "_block", "_place")
    return united.withColumn("datetime", clock.parse_mdy_hms("datetime"))

