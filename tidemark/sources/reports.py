"""Recorded run reports (one JSON document per file, plain or gzip) as relational tables.

A report is read whole, parsed once to VARIANT, and exploded into one tagged relation (`tagged`), which `land` writes in a
single pass as a Parquet folder for each kind of row, clustered by run. Everything downstream reads its kinds' folders, and
nothing touches JSON again: a report is large, and a gzip report can be read by one task only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.safe import ratio, report_time
from tidemark.sources.shared import complete

_IMPORT = "array<struct<dll:string,imports:array<struct<name:string>>>>"


def get(doc: str, path: str, kind: str) -> Column:
    """A value inside a VARIANT column, NULL where any level is missing or of another type."""
    return F.try_variant_get(F.col(doc), path, kind)


def reports(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """run_id, path, doc (VARIANT), bad. The run is named by info.id, or else by the number in the file's name; several
    archives are told apart by `prefix`. A document that does not parse is a row with `bad` set, and does not stop others."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return parsed(raw, prefix)


def parsed(raw: DataFrame, prefix: str = "") -> DataFrame:
    """The same for reports that are already rows (path, value: the JSON text)."""
    # What parses is an object if it begins like one; its schema would be a walk through all of it.
    rows = raw.select("path", F.try_parse_json("value").alias("doc"), F.coalesce(F.col("value").rlike(r"^[ \t\r\n]*\{"), F.lit(False)).alias("_object"))
    number = F.regexp_extract("path", r"(\d+)[^/\d]*(?:\.json)?(?:\.gz)?$", 1)
    run = F.coalesce(get("doc", "$.info.id", "string"), F.nullif(number, F.lit("")))
    return rows.select(F.concat(F.lit(prefix), run).alias("run_id"), "path", "doc", (F.col("doc").isNull() | ~F.col("_object")).alias("bad"))


def targets(files: DataFrame, path: str = "path") -> DataFrame:
    """Of a listing of files, those to be read as one batch, with `number`, the task's number (NULL without one): reports in
    numerically named folders if there are any, else archives and JSON files. Order by number (NULLs last), then path."""
    p = F.col(path)
    folder = F.regexp_extract(p, r"(?:^|/)([0-9]+)/reports/report\.json$", 1)
    named = F.regexp_extract(p, r"task[_-]?([0-9]+)[^/]*$", 1)
    marked = files.withColumn("_folder", F.nullif(folder, F.lit(""))).withColumn("_file", p.rlike(r"(\.gz|\.json)$"))
    any_folder = marked.agg(F.coalesce(F.bool_or(F.col("_folder").isNotNull()), F.lit(False)).alias("_any"))
    out = marked.crossJoin(any_folder).filter((F.col("_any") & F.col("_folder").isNotNull()) | (~F.col("_any") & F.col("_file")))  # one row
    number = F.when(F.col("_any"), F.col("_folder")).otherwise(F.nullif(named, F.lit(""))).try_cast("long")
    return out.withColumn("number", number).drop("_folder", "_file", "_any")


def merged(archives: dict[str, DataFrame]) -> DataFrame:
    """The reports of several archives (prefix -> rows of path and value) as one table, told apart by their prefixes."""
    return reduce(DataFrame.unionByName, [parsed(raw, prefix) for prefix, raw in archives.items()])


def tagged(found: DataFrame) -> DataFrame:
    """All relations of reports as one, a row each: `kind` says which, and columns that a kind does not have are NULL.

    run: path, bad, malscore, family. event: pos (its place in the list), object, name (what happened), ts, file, source,
    target. process: proc (its place), node, parent, name, ts (first seen), text (command line). call: pos, proc, name (API),
    category, ts, args. list: pos, name, text. import: name (static or unpacked), dll, text.

    A report is parsed once and exploded in two steps, first into its sections and then a section into its members, so that
    never more than one process's calls are an array beside the document.
    """
    section = "array<struct<kind:string,at:int,name:string,dll:string,v:variant,texts:array<string>>>"
    none, some = F.lit(None), F.array().cast(section)
    one = lambda kind, at=none, name=none, dll=none, v=none, texts=none: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), name.cast("string").alias("name"), dll.cast("string").alias("dll"), v.cast("variant").alias("v"), texts.cast("array<string>").alias("texts"))
    all_of = lambda items, f: F.coalesce(F.transform(items, f).cast(section), some)
    lists = F.map_entries(get("doc", "$.behavior.summary", "map<string,variant>"))
    symbols = lambda view: lambda d: one("import", name=F.lit(view), dll=d["dll"], texts=d["imports"]["name"])
    static, unpacked = _import_tables()
    parts = F.concat(
        F.array(one("run")).cast(section),
        all_of(get("doc", "$.behavior.enhanced", "array<variant>"), lambda v, i: one("event", at=i, v=v)),
        all_of(get("doc", "$.behavior.processes", "array<variant>"), lambda v, i: one("process", at=i, v=v)),
        all_of(lists, lambda e: one("list", name=e["key"], texts=F.try_variant_get(e["value"], "$", "array<string>"))),
        all_of(static, symbols("static")),
        all_of(unpacked, symbols("unpacked")),
    )
    rows = found.select("run_id", "path", "bad", get("doc", "$.malscore", "double").alias("malscore"), get("doc", "$.detections[0].family", "string").alias("family"), F.when(F.col("bad"), F.array(one("run")).cast(section)).otherwise(parts).alias("parts"))
    # An outer explode, since the filter that the optimizer adds to an inner one would parse the document once more for each use.
    rows = rows.select("run_id", "path", "bad", "malscore", "family", F.explode_outer("parts").alias("s")).select("run_id", "path", "bad", "malscore", "family", "s.*")

    v = lambda path, kind="string": F.try_variant_get("v", path, kind)
    member = "array<struct<c:variant,text:string>>"
    empty = F.array(F.struct(F.lit(None).alias("c"), F.lit(None).alias("text"))).cast(member)
    calls = F.transform(F.coalesce(v("$.calls", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.struct(c.alias("c"), F.lit(None).cast("string").alias("text"))).cast(member)
    texts = F.transform("texts", lambda t: F.struct(F.lit(None).cast("variant").alias("c"), t.alias("text"))).cast(member)
    process, event, run = F.col("kind") == "process", F.col("kind") == "event", F.col("kind") == "run"
    members = F.when(process, F.concat(empty, calls)).when(F.col("kind").isin("list", "import"), texts).otherwise(empty)
    first = F.when(event, v("$.timestamp")).when(process, v("$.first_seen"))
    of_event = {"object": "$.object", "file": "$.data.file", "source": "$.data.from", "target": "$.data.to"}
    head = rows.select(
        "run_id", "kind", "at", "dll",
        *[F.when(run, F.col(c)).alias(c) for c in ("path", "bad", "malscore", "family")],
        *[F.when(event, v(path)).alias(c) for c, path in of_event.items()],
        F.when(process, v("$.process_id", "long")).alias("node"),
        F.when(process, v("$.parent_id", "long")).alias("parent"),
        F.when(process, F.coalesce(v("$.environ.CommandLine"), v("$.command_line"))).alias("line"),
        F.coalesce("name", F.when(event, v("$.event")), F.when(process, v("$.process_name"))).alias("name"),
        report_time(first).alias("ts"),
        members.alias("members"),
    )
    # Exploded after the section's own columns are taken, so that a row has no copy of the whole section.
    head = head.select(*[c for c in head.columns if c != "members"], F.posexplode_outer("members").alias("sub", "m")).filter("sub is not null")
    call = (F.col("kind") == "process") & (F.col("sub") > 0)
    c = lambda path, kind="string": F.try_variant_get("m.c", path, kind)
    stamp = F.coalesce(report_time(c("$.timestamp")), F.timestamp_micros((c("$.time", "double") * 1e6).cast("long")))
    # The place in the run follows from both places, without a window over the run.
    place = F.shiftleft(F.col("at").cast("long"), 32) + F.col("sub") - 1
    own = lambda name: F.when(~call, F.col(name)).alias(name)
    return head.select(
        "run_id",
        F.when(call, "call").otherwise(F.col("kind")).alias("kind"),
        F.when(call, place).when(event, F.col("at")).when(F.col("kind") == "list", F.col("sub")).cast("long").alias("pos"),
        F.when(F.col("kind") == "process", F.col("at")).alias("proc"),
        F.when(call, c("$.api")).otherwise(F.col("name")).alias("name"),
        F.when(call, c("$.category")).alias("category"),
        F.when(call, stamp).otherwise(F.col("ts")).alias("ts"),
        F.when(call, _arguments(c)).alias("args"),
        "object", "file", "source", "target", own("node"), own("parent"), "dll",
        F.when(F.col("kind") == "process", F.when(~call, F.col("line"))).otherwise(F.col("m.text")).alias("text"),
        "path", "bad", "malscore", "family",
    )


def _arguments(c) -> Column:
    """Arguments by name, from an object or from a list of names and values, of which the last with a name counts."""
    pairs = F.coalesce(c("$.arguments", "array<struct<name:string,value:string>>"), F.array().cast("array<struct<name:string,value:string>>"))
    named = F.filter(pairs, lambda x: x["name"].isNotNull())
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["name"] == x["name"]))
    return F.coalesce(c("$.arguments", "map<string,string>"), F.map_from_entries(F.transform(last, lambda x: F.struct(x["name"], x["value"]))))


def _import_tables() -> tuple[Column, Column]:
    """The static import table, an object by library or a list in old reports, and those of all unpacked files."""
    by_dll = "map<string,struct<dll:string,imports:array<struct<name:string>>>>"
    static = F.coalesce(F.map_values(get("doc", "$.target.file.pe.imports", by_dll)), get("doc", "$.target.file.pe.imports", _IMPORT), get("doc", "$.static.pe_imports", _IMPORT))
    each = lambda v: F.coalesce(F.map_values(F.try_variant_get(v, "$.pe.imports", by_dll)), F.try_variant_get(v, "$.pe.imports", _IMPORT), F.array().cast(_IMPORT))
    unpacked = [F.flatten(F.transform(F.coalesce(get("doc", p, "array<variant>"), F.array().cast("array<variant>")), each)) for p in ("$.CAPE.payloads", "$.dropped")]
    return static, F.concat(*unpacked)


def land(found: DataFrame, path: str) -> DataFrame:
    """Writes what is `tagged` to a folder for each kind, in one pass over the reports, and reads it back. A report's rows lie
    together in the order of the report, in one file of each kind."""
    tagged(found).write.partitionBy("kind").parquet(path)
    return landed(found.sparkSession, path)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The relations that `land` wrote; without its commit mark they are not complete, which is an error."""
    if not complete(spark, path):
        raise FileNotFoundError(f"no complete relations in {path}")
    return spark.read.schema(RELATIONS).parquet(path)


#: Columns of `tagged`; `kind` is the folder.
RELATIONS = (
    "run_id string, pos long, proc int, name string, category string, ts timestamp, args map<string,string>, object string, file string, source string, target string, "
    "node long, parent long, dll string, text string, path string, bad boolean, malscore double, family string, kind string"
)


def _of(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("kind") == kind)


def runs(rows: DataFrame) -> DataFrame:
    """run_id, path, bad: every report, those that do not parse too. Like the next ones it reads `tagged` or `landed` rows."""
    return _of(rows, "run").select("run_id", "path", "bad")


def metadata(rows: DataFrame, family: str = "unknown") -> DataFrame:
    """Score and first detected family."""
    return _of(rows, "run").filter("not bad").select("run_id", "malscore", F.coalesce("family", F.lit(family)).alias("family"))


def file_events(rows: DataFrame) -> DataFrame:
    """run_id, pos, object, kind, ts, file, source, target: the list of enhanced events in its own order."""
    return _of(rows, "event").select("run_id", "pos", "object", F.col("name").alias("kind"), "ts", "file", "source", "target")


def processes(rows: DataFrame) -> DataFrame:
    return _of(rows, "process").select("run_id", "proc", "node", "parent", "name", F.col("ts").alias("first_seen"), F.col("text").alias("command_line"))


def api_calls(rows: DataFrame) -> DataFrame:
    """run_id, pos, proc, api, category, ts, args. Calls are in the order of their processes."""
    return _of(rows, "call").select("run_id", "pos", "proc", F.col("name").alias("api"), "category", "ts", "args")


def summary(rows: DataFrame, lists: list[str]) -> DataFrame:
    """run_id, list, pos, value of the string lists in behavior.summary."""
    return _of(rows, "list").filter(F.col("name").isin(lists)).select("run_id", F.col("name").alias("list"), "pos", F.col("text").alias("value"))


def imports(rows: DataFrame) -> DataFrame:
    """run_id, view (static or unpacked), dll, name."""
    return _of(rows, "import").filter("text is not null").select("run_id", F.col("name").alias("view"), "dll", F.col("text").alias("name"))


def static_features(rows: DataFrame, names: DataFrame, categories: dict[str, list[str]], indicative: list[str]) -> DataFrame:
    """Per run: total imports of each view, distinct keywords of each category that occur in a name, how many indicative
    categories occur, and what only the unpacked view reveals. Runs without imports have NULLs."""
    low = F.lower("name")
    hits = [F.bool_or(F.contains(low, F.lit(k.lower()))) for ks in categories.values() for k in ks]
    per = names.groupBy("run_id", "view").agg(F.count(F.lit(1)).alias("total"), *[h.cast("int").alias(f"k{i}") for i, h in enumerate(hits)])
    sums, i = [], 0
    for c, ks in categories.items():
        sums.append(sum((F.col(f"k{j}") for j in range(i, i + len(ks))), F.lit(0)).alias(c))
        i += len(ks)
    cats = per.select("run_id", "view", "total", *sums)
    pick = lambda view, c: F.max(F.when(F.col("view") == view, F.col(c)))
    wide = cats.groupBy("run_id").agg(*[pick(v, c).alias(f"{v}_{c}") for v in ("static", "unpacked") for c in ("total", *categories)])
    count = sum(((F.col(f"static_{c}") > 0).cast("int") for c in indicative), F.lit(0))
    more = {c: F.col(f"unpacked_{c}") - F.col(f"static_{c}") for c in categories}
    revealed = [F.when(x.isNotNull(), F.greatest(F.lit(0), x)).alias(f"revealed_{c}") for c, x in more.items()]
    out = wide.select("run_id", F.col("static_total").alias("total_imports"), *[F.col(f"static_{c}").alias(f"imp_{c}") for c in categories], count.alias("indicative_categories"), *revealed)
    return runs(rows).filter("not bad").select("run_id").join(out, "run_id", "left")


def interaction(static: DataFrame, calls: DataFrame, category: str, apis: Column) -> DataFrame:
    """Whether what is imported is called: imported only, called only, agreement; NULL for runs without imports."""
    called = calls.groupBy("run_id").agg(F.bool_or(apis).alias("called"))
    both = static.join(called, "run_id", "left").withColumn("called", F.coalesce("called", F.lit(False)))
    has, imported = F.col("total_imports") > 0, F.col(f"imp_{category}") > 0
    known = lambda c: F.when(has, c.cast("int"))
    return both.select("run_id", known(imported & ~F.col("called")).alias("imported_not_called"), known(~imported & F.col("called")).alias("called_not_imported"), known(imported == F.col("called")).alias("agreement"))


def masked(features: DataFrame, dynamic: list[str], coverage: str = "coverage") -> DataFrame:
    """Feature rows with their dynamic columns blank where the run is not fully covered."""
    return features.withColumns({c: F.when(F.col(coverage) == "full", F.col(c)) for c in dynamic})


def buffer_entropy(calls: DataFrame, argument: str = "Buffer") -> DataFrame:
    """Shannon entropy of the bytes of an escaped buffer argument, per call; NULL where there is none.

    Escapes are backslash x and two hexadecimal digits, and the usual letters; any other character is its own code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if b is None else entropy_of(decoded_buffer(b)) for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], ["run_id", "pos", "api", "entropy"])

    plain = calls.select("run_id", "pos", "api", F.try_element_at("args", F.lit(argument)).alias("buffer"))
    return plain.mapInArrow(run, "run_id string, pos long, api string, entropy double")


def entropy_of_runs(calls: DataFrame, argument: str = "Buffer") -> DataFrame:
    """Per run: number of calls, and mean and largest entropy of their buffers; NULL without any buffer."""
    return buffer_entropy(calls, argument).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"), F.avg("entropy").alias("mean_entropy"), F.max("entropy").alias("max_entropy"))


def decoded_buffer(text: str) -> bytes:
    import re

    letters = {"n": 10, "r": 13, "t": 9, "0": 0, "\\": 92, '"': 34, "'": 39}
    out = bytearray()
    for m in re.finditer(r"\\x([0-9a-fA-F]{2})|\\([nrt0\\\"'])|(.)", text, re.S):
        out.append(int(m[1], 16) if m[1] else letters[m[2]] if m[2] else ord(m[3]) & 255)
    return bytes(out)


def entropy_of(data: bytes) -> float | None:
    import numpy as np

    if not data:
        return None
    p = np.bincount(np.frombuffer(data, np.uint8)) / len(data)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def printable_runs(spark: SparkSession, path: str, least: int = 5, separator: str = "\n") -> DataFrame:
    """path and each run of at least `least` printable ASCII characters of binary files, repeated ones too.

    Files are read as pieces between separators, a byte that no run can hold, so a large file is dealt out in byte ranges,
    and a run that lies over a border is found whole: the reader of a range goes on to the end of its last piece. Files
    with long stretches of zeros and few line ends are read better with the separator "\\0"."""
    if len(separator) != 1 or " " <= separator <= "~":
        raise ValueError("a separator is one character that is not printable")
    pieces = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path)
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return pieces.select(F.col("_metadata.file_path").alias("path"), F.explode(F.regexp_extract_all(text, F.lit(f"([\\x20-\\x7e]{{{least},}})"), F.lit(1))).alias("run"))


def structure(found: DataFrame) -> DataFrame:
    """The merged schema of all reports that parse, and the share of reports that do; one row."""
    good = F.count_if(~F.col("bad"))
    return found.agg(F.schema_of_variant_agg(F.when(~F.col("bad"), F.col("doc"))).alias("schema"), ratio(good, F.count(F.lit(1))).alias("share"))


def log_lines(spark: SparkSession, path: str, stamp: str = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{1,6})", log: Column | None = None, rotation: Column | None = None) -> DataFrame:
    """log, path, line (its number in the file), text, ts of text logs, rotated and compressed ones too. A line without a time
    of its own has the time of the last one before it in its log, also over the border of a file; NULL before the first.

    log, rotation: what log a file (column path) is of, and its number in the rotation, the oldest file having the highest;
    by default the path without .N and .gz, and N. Files of one number follow one another by path.

    Files are read in byte ranges. Lines keep their order in a range and take their time from lines of it (one stream, no
    shuffle); the last time of each range reaches the next ones in a pass over the ranges alone."""
    name = F.regexp_replace("path", r"\.gz$", "")
    number = F.coalesce(F.nullif(F.regexp_extract(name, r"\.(\d+)$", 1), F.lit("")).cast("long"), F.lit(0)) if rotation is None else rotation
    log = F.regexp_replace(name, r"\.\d+$", "") if log is None else log
    own = report_time(F.nullif(F.regexp_extract("value", stamp, 1), F.lit("")))
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"), own.alias("ts"))
    numbered_ = rows.mapInArrow(_carried, "path string, start long, at long, text string, ts timestamp")
    ranges = numbered_.groupBy("path", "start").agg(F.max("at").alias("most"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("at"))).alias("last"))
    ranges = ranges.select("path", "start", "most", "last", log.alias("log"), number.alias("rotation"))
    before = Window.partitionBy("log").orderBy(F.desc("rotation"), "path", "start").rowsBetween(Window.unboundedPreceding, -1)  # ranges of a log
    in_file = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = ranges.select("path", "start", "log", F.last("last", ignorenulls=True).over(before).alias("_ts"), F.coalesce(F.sum(F.col("most") + 1).over(in_file), F.lit(0)).alias("_line"))
    return numbered_.join(known, ["path", "start"]).select("log", "path", (F.col("_line") + F.col("at")).alias("line"), "text", F.coalesce("ts", "_ts").alias("ts"))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one byte range after another, numbered, with the last time before them in their range."""
    import numpy as np
    import pyarrow.compute as pc

    range_, count, last = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start, text, ts = batch.columns
        keys = list(zip(pc.dictionary_encode(path).indices.to_numpy(zero_copy_only=False), start.to_numpy(), strict=True))
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        at, carried = np.zeros(len(keys), np.int64), []
        for a, b in zip(edges, edges[1:], strict=False):
            if (own := (path[a].as_py(), start[a].as_py())) != range_:
                range_, count, last = own, 0, None
            at[a:b] = np.arange(count, count + b - a)
            count += b - a
            filled = pc.fill_null_forward(pa.concat_arrays([pa.array([last], ts.type), ts.slice(a, b - a)])).slice(1)
            last = filled[-1].as_py()
            carried.append(filled)
        yield pa.RecordBatch.from_arrays([path, start, pa.array(at), text, pa.concat_arrays(carried)], ["path", "start", "at", "text", "ts"])


def csv_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with a header, all strings; a missing file is an empty table, and a short row has NULLs."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns])


def sequences_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of run_id and sequence."""
    return spark.read.schema("run_id string, sequence array<string>").json(path)
