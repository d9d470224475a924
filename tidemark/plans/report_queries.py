"""Queries over recorded reports. The driver has none, so each run of its events table is written as a report (JSON text),
read by the sources like any other, and compared with SQL over the events themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.paths import extension, extension_group, extension_or_none, stem
from tidemark.functions.safe import whole_number
from tidemark.operators import behaviour, verdict
from tidemark.operators.ranks import numbered
from tidemark.plans.registry import query
from tidemark.sources import reports
from tidemark.sources.shared import complete, shared_dir
from tidemark.sources.testdata import EVENT_LOG_SQL, event_log

CALLS = ["NtWriteFile", "CryptEncrypt", "NtTerminateProcess", "FindFirstFileExW", "connect", "RegSetValueExW", "NtReadFile", "MoveFileW", "OpenSCManagerW", "SystemParametersInfoW", "NtSetInformationFile", "BCryptEncrypt", "Process32NextW", "NtClose", "NtCreateSection", "NtMapViewOfSection", "NtCreateFile", "NtWriteFile", "NtReadFile", "WriteFile", "ReadFile"]
#: By number of the process (its id is one more; one without calls is not in the report): its name, parent and command line. The fourth is a bystander, the fifth
#: hangs on it, the sixth on nothing, and the last on the third.
PROCESSES = [("sample.exe", 0, None), ("WMIC.exe", 1, "wmic shadowcopy delete"), ("cmd.exe", 1, "cmd /c bcdedit /set x"), ("Explorer.EXE", 1, None), ("helper.exe", 4, "taskkill /im b.exe"), ("stray.exe", 99, "sc query"), ("late.exe", 3, None)]
#: By run_id % 12: what the summary lists as executed, with what the rules should and should not find; and by run_id % 4 the
#: registry keys.
COMMANDS = [
    ["net stop svc", "taskkill /f /im a.exe", "internet stop"],
    ["wevtutil cl system", "wevtutil el"],
    ["schtasks /create /tn x", "schtasks /query", "netsh firewall set opmode disable"],
    [],
    ["vssadmin delete shadows /all", "vssadmin resize shadowstorage", "wmic shadowcopy call create"],
    ["wbadmin delete catalog -quiet", "wbadmin get status"],
    ["bcdedit /set recoveryenabled no", "xbcdedit"],
    ["sc stop vss", "sc query vss", "misc stop vss"],
    ["C:\\Users\\a\\AppData\\Roaming\\x.exe", "C:\\Users\\a\\AppData\\Roaming\\y\\x.exe"],
    ["netsh advfirewall set allprofiles state off", "netsh wlan show profiles"],
    ["whoami /all", "net user x", "cipher /w:c", "nltest /dclist:x"],
    ["net use z: \\\\h\\admin$", "psexec \\\\h cmd", "reg add HKLM\\a", "Stop-Service x"],
]
KEYS = [["HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x", "HKLM\\a"], ["HKLM\\a"], [], ["HKLM\\Winlogon\\Shell"]]
#: By run_id % 3: names that the static import table lists, and those of the unpacked payload.
STATIC = [["CryptEncrypt", "ReadFile"], ["send"], []]
UNPACKED = [["CryptEncrypt", "CryptGenKey"], ["send"], ["connect", "CryptGenKey"]]
CATEGORIES = {"crypto": ["CryptEncrypt", "CryptGenKey"], "network": ["send", "connect"]}
#: A path by its number, as an expression for both engines; some writes append to it.
PATH = r"""concat(CASE target % 5 WHEN 0 THEN concat('C:\Users\admin\Documents\f', target, '.docx') WHEN 1 THEN 'C:\Users\admin\Desktop\desktop.ini'
 WHEN 2 THEN concat('C:\Windows\system32\f', target, '.dll') WHEN 3 THEN concat('C:\Users\admin\Downloads\d', pos % 4, '\HOW-TO ', target, '.txt') ELSE concat('C:/data/d', pos % 3, '/Read_Me.html') END, CASE WHEN kind = 'write' AND target % 5 IN (0, 2) AND pos % 4 = 1 THEN '.enc' ELSE '' END)"""
MOVED = "CASE pos % 4 WHEN 0 THEN concat({p}, '.zz') WHEN 1 THEN concat('C:\\x\\q', pos, '.lock') WHEN 2 THEN concat({p}, '.', pos % 3) ELSE concat('C:\\x\\q', pos, '.tmp') END".replace("{p}", "path")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _by(number: str, values: list[str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: The same reports as relations: r (calls and file events, of reports that parse), c (executed commands).
BASE = (
    EVENT_LOG_SQL
    + f""", r0 AS (SELECT *, {PATH} AS path, list_extract({_sql_list(CALLS)}, CAST(pos % {len(CALLS)} + 1 AS INT)) AS call, CASE WHEN target % 2 = 0 THEN '13' ELSE '10' END AS cls, target % 7 AS pnum, dense_rank() OVER (PARTITION BY run_id ORDER BY target % 7) - 1 AS proc FROM ev WHERE run_id % 17 <> 0),
r AS (SELECT *, {MOVED} AS moved, proc * 4294967296 + row_number() OVER (PARTITION BY run_id, proc ORDER BY pos) - 1 AS place FROM r0),
runs AS (SELECT DISTINCT run_id FROM r),
c AS (SELECT run_id, unnest({_by("run_id % 12", [_sql_list(x) if x else "CAST([] AS VARCHAR[])" for x in COMMANDS])}) AS text, generate_subscripts({_by("run_id % 12", [_sql_list(x) if x else "CAST([] AS VARCHAR[])" for x in COMMANDS])}, 1) AS j FROM runs),
keys AS (SELECT run_id, unnest({_by("run_id % 4", [_sql_list(x) if x else "CAST([] AS VARCHAR[])" for x in KEYS])}) AS value FROM runs),
procs AS (SELECT run_id, proc, pnum, min(ts) AS ts, {_by("pnum", ["'" + p[0] + "'" for p in PROCESSES])} AS name, {_by("pnum", ["'" + p[2] + "'" if p[2] else "NULL" for p in PROCESSES])} AS text FROM r GROUP BY run_id, proc, pnum)
"""
)


def raw_reports(spark: SparkSession, sf: str) -> DataFrame:
    """path and value (JSON text) of one report per run of the events table; every seventeenth is broken."""
    literal = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    pick = lambda number, options: F.get(F.array(*[literal(x) for x in options]), number.cast("int"))
    log = event_log(spark, sf).withColumn("path", F.expr(PATH.replace("\\", "\\\\"))).withColumn("moved", F.expr(MOVED.replace("\\", "\\\\")))
    stamp = F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd HH:mm:ss,SSSSSS")
    moves = F.col("kind") == "move"
    data = F.struct(F.when(~moves, F.col("path")).alias("file"), F.when(moves, F.col("path")).alias("from"), F.when(moves, F.col("moved")).alias("to"))
    event = F.struct("pos", F.lit("file").alias("object"), F.col("kind").alias("event"), stamp.alias("timestamp"), data.alias("data"))
    api = F.get(literal(CALLS), (F.col("pos") % len(CALLS)).cast("int"))
    arguments = F.array(F.struct(F.lit("FileInformationClass").alias("name"), F.when(F.col("target") % 2 == 0, "13").otherwise("10").alias("value")), F.struct(F.lit("Buffer").alias("name"), F.when(F.col("target") % 2 == 0, r"\x00\xff\x00\xff").otherwise("aab").alias("value")), F.struct(F.lit("Length").alias("name"), F.format_string("0x%x", F.col("pos")).alias("value")),
        F.struct(F.when(api == "NtCreateSection", "FileName").otherwise("HandleName").alias("name"), F.when(api != "NtMapViewOfSection", F.col("path")).alias("value")), F.struct(F.lit("SectionHandle").alias("name"), F.when(api.isin("NtCreateSection", "NtMapViewOfSection"), F.concat(F.lit("0x"), F.col("target") % 3)).alias("value")))
    call = F.struct("pos", api.alias("api"), F.col("category"), stamp.alias("timestamp"), arguments.alias("arguments"))
    per = log.groupBy("run_id", (F.col("target") % 7).cast("int").alias("proc")).agg(F.sort_array(F.collect_list(event)).alias("events"), F.sort_array(F.collect_list(call)).alias("calls"), F.min(stamp).alias("first_seen"), F.collect_set(F.when(F.col("kind") == "write", F.col("path"))).alias("writes"), F.collect_set(F.when(F.col("kind") == "delete", F.col("path"))).alias("deletes"))
    names = literal([p[0] for p in PROCESSES])
    process = F.struct("proc", (F.col("proc") + 1).alias("process_id"), F.get(F.array(*[F.lit(p[1]) for p in PROCESSES]), F.col("proc")).alias("parent_id"), F.get(names, F.col("proc")).alias("process_name"), "first_seen", F.get(literal([p[2] for p in PROCESSES]), F.col("proc")).alias("command_line"), "calls")
    whole = per.groupBy("run_id").agg(F.sort_array(F.collect_list(process)).alias("processes"), F.sort_array(F.flatten(F.collect_list("events"))).alias("enhanced"), *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(a) for c, a in (("writes", "write_files"), ("deletes", "delete_files"))])
    run = F.col("run_id")
    pe = lambda options: F.struct(F.array(F.struct(F.lit("K.dll").alias("dll"), F.transform(pick(run % 3, options), lambda n: F.struct(n.alias("name"))).alias("imports"))).alias("imports"))
    document = F.to_json(
        F.struct(
            F.struct(run.alias("id")).alias("info"),
            (run % 10 / 2).alias("malscore"),
            F.when(run % 2 == 0, F.array(F.struct(F.concat(F.lit("fam"), run % 3).alias("family")))).alias("detections"),
            F.struct(F.struct(pe(STATIC).alias("pe")).alias("file")).alias("target"),
            F.struct(F.array(F.struct(pe(UNPACKED).alias("pe"))).alias("payloads")).alias("CAPE"),
            F.struct("enhanced", "processes", F.struct(pick(run % 12, COMMANDS).alias("executed_commands"), pick(run % 4, KEYS).alias("write_keys"), "write_files", "delete_files").alias("summary")).alias("behavior"),
        )
    )
    return whole.select(F.concat(F.lit("task_"), run, F.lit(".json")).alias("path"), F.when(run % 17 == 0, "{broken").otherwise(document).alias("value"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return reports.parsed(raw_reports(spark, sf))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """The relations of all reports. They are parsed and landed once for the files that the events table now has, in the
    shared folder of this application; every query reads the kinds of rows that it needs."""
    files = spark.read.parquet(f"{sf}/events.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    path = f"{shared_dir(spark)}/tidemark/reports-{spark.sparkContext.applicationId}-{state[0]}-{state[1]}"
    return reports.landed(spark, path) if complete(spark, path) else reports.land(_found(spark, sf), path)


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("run_id", F.col("run_id").cast("long"))


def _events(rows: DataFrame) -> DataFrame:
    return _number(reports.file_events(rows)).withColumns({"path": F.coalesce("file", "source"), "ts": F.unix_micros("ts")})


def _calls(rows: DataFrame) -> DataFrame:
    return _number(reports.api_calls(rows)).withColumns({"ts": F.unix_micros("ts"), "class": F.try_element_at("args", F.lit("FileInformationClass"))})


def _processes(rows: DataFrame) -> DataFrame:
    return _number(reports.processes(rows)).select("run_id", "proc", "node", "parent", "name", F.unix_micros("first_seen").alias("ts"), F.col("command_line").alias("text"))


def _list(rows: DataFrame, name: str) -> DataFrame:
    return _number(reports.summary(rows, [name])).drop("list")


def _commands(rows: DataFrame) -> DataFrame:
    """Commands of processes and of the summary, as run_id, ts, pos, text."""
    none = F.lit(None).cast("long")
    launched = _processes(rows).select("run_id", "ts", F.lit(-1).cast("long").alias("pos"), "text")
    return launched.unionByName(_list(rows, "executed_commands").select("run_id", none.alias("ts"), "pos", F.col("value").alias("text"))).filter("text is not null")


@query(
    "s01_reports",
    EVENT_LOG_SQL + """SELECT run_id, run_id % 17 = 0 AS bad, CASE WHEN run_id % 17 <> 0 THEN run_id % 10 / 2.0 END AS malscore, CASE WHEN run_id % 17 = 0 THEN NULL WHEN run_id % 2 = 0 THEN 'fam' || (run_id % 3) ELSE 'unknown' END AS family
FROM (SELECT DISTINCT run_id FROM ev)""",
)
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Reports by run, broken ones too, with score and family."""
    rows = _rows(spark, sf)
    return _number(reports.runs(rows).select("run_id", "bad").join(reports.metadata(rows), "run_id", "left"))


@query("s01_file_events", BASE + "SELECT run_id, pos - 1 AS pos, kind, ts, CASE WHEN kind <> 'move' THEN path END AS file, CASE WHEN kind = 'move' THEN path END AS source, CASE WHEN kind = 'move' THEN moved END AS target FROM r")
def file_events(spark: SparkSession, sf: str) -> DataFrame:
    """The list of file events in its order, with real times."""
    return _events(_rows(spark, sf)).select("run_id", "pos", "kind", "ts", "file", "source", "target")


@query("p24_arguments", BASE + "SELECT run_id, place AS pos, call AS api, cls AS class, pos AS size FROM r")
def arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments by name, and a number from hexadecimal text."""
    return _calls(_rows(spark, sf)).select("run_id", "pos", "api", "class", whole_number(F.try_element_at("args", F.lit("Length"))).alias("size"))


@query(
    "o17_buffer_entropy",
    BASE + """, b AS (SELECT run_id, CASE WHEN target % 2 = 0 THEN 1.0 ELSE -(2.0 / 3 * log2(2.0 / 3) + 1.0 / 3 * log2(1.0 / 3)) END AS e FROM r WHERE call IN ('NtWriteFile', 'CryptEncrypt', 'BCryptEncrypt'))
SELECT run_id, count(*) AS n_calls, round(avg(e), 6) AS mean_entropy, round(max(e), 6) AS max_entropy FROM b GROUP BY run_id""",
)
def buffer_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of the bytes that some calls pass on, mean and largest of each run."""
    calls = reports.api_calls(_rows(spark, sf)).filter(F.col("api").isin("NtWriteFile", "CryptEncrypt", "BCryptEncrypt"))
    return _number(reports.entropy_of_runs(calls)).withColumns({c: F.round(c, 6) for c in ("mean_entropy", "max_entropy")})


def _imports_sql(view: str, lists: list[list[str]]) -> str:
    rows = [f"({i}, '{view}', '{n}')" for i, names in enumerate(lists) for n in names]
    return ", ".join(rows)


IMPORTS = f", i(m, view, name) AS (VALUES {_imports_sql('static', STATIC)}, {_imports_sql('unpacked', UNPACKED)}), im AS (SELECT run_id, view, name FROM runs JOIN i ON run_id % 3 = m)\n"


@query(
    "o18_static_features",
    BASE + IMPORTS + """, s AS (SELECT run_id, count(*) FILTER (view = 'static') AS total, count(*) FILTER (view = 'static' AND name IN ('CryptEncrypt', 'CryptGenKey')) AS sc, count(*) FILTER (view = 'static' AND name IN ('send', 'connect')) AS sn,
 count(*) FILTER (view = 'unpacked' AND name IN ('CryptEncrypt', 'CryptGenKey')) AS uc, count(*) FILTER (view = 'unpacked' AND name IN ('send', 'connect')) AS un FROM im GROUP BY run_id)
SELECT run_id, CAST(nullif(total, 0) AS BIGINT) AS total_imports, CASE WHEN total > 0 THEN sc END AS imp_crypto, CASE WHEN total > 0 THEN sn END AS imp_network, CASE WHEN total > 0 THEN CAST(sc > 0 AS INT) + CAST(sn > 0 AS INT) END AS indicative_categories,
 CASE WHEN total > 0 THEN greatest(0, uc - sc) END AS revealed_crypto, CASE WHEN total > 0 THEN greatest(0, un - sn) END AS revealed_network FROM s""",
)
def static_features(spark: SparkSession, sf: str) -> DataFrame:
    """Imports by category, and what only the unpacked view has."""
    rows = _rows(spark, sf)
    out = _number(reports.static_features(rows, reports.imports(rows), CATEGORIES, ["crypto", "network"]))
    return out.select("run_id", "total_imports", *[F.col(c).cast("long") for c in out.columns if c not in ("run_id", "total_imports")])


@query(
    "o19_interaction",
    BASE + IMPORTS + """, s AS (SELECT run_id, count(*) AS total, count(*) FILTER (name LIKE 'Crypt%') > 0 AS has FROM im WHERE view = 'static' GROUP BY run_id), k AS (SELECT run_id, count(*) FILTER (call IN ('CryptEncrypt', 'BCryptEncrypt')) > 0 AS called FROM r GROUP BY run_id)
SELECT run_id, CASE WHEN total > 0 THEN CAST(has AND NOT called AS INT) END AS imported_not_called, CASE WHEN total > 0 THEN CAST(NOT has AND called AS INT) END AS called_not_imported, CASE WHEN total > 0 THEN CAST(has = called AS INT) END AS agreement FROM k LEFT JOIN s USING (run_id)""",
)
def interaction(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    static = reports.static_features(rows, reports.imports(rows), CATEGORIES, ["crypto"])
    return _number(reports.interaction(static, reports.api_calls(rows), "crypto", F.col("api").isin("CryptEncrypt", "BCryptEncrypt")))


RULES = ", ".join("('" + token + "', '" + pattern.replace("'", "''") + "', " + str(i) + ")" for i, (token, pattern) in enumerate(behaviour.COMMAND_RULES))


@query(
    "p12_command_rules",
    BASE + f", rules(token, pattern, i) AS (VALUES {RULES}), t AS (SELECT run_id, text FROM c UNION ALL SELECT run_id, text FROM procs WHERE text IS NOT NULL) SELECT run_id, token, count(*) AS commands FROM t JOIN rules ON regexp_matches(text, pattern) GROUP BY run_id, token",
)
def command_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The nine rules over commands of processes and of the summary."""
    return behaviour.command_marks(_commands(_rows(spark, sf))).groupBy("run_id", "token").agg(F.count(F.lit(1)).alias("commands"))


@query(
    "p22_command_purposes",
    BASE + """, t AS (SELECT run_id, lower(text) AS x FROM c UNION ALL SELECT run_id, lower(text) FROM procs WHERE text IS NOT NULL)
SELECT run_id, count(*) AS n_commands, """
    + ", ".join("count(*) FILTER (" + " OR ".join(f"contains(x, '{w}')" for w in words) + f") AS n_{name}" for name, words in behaviour.PURPOSES.items())
    + " FROM t GROUP BY run_id",
)
def command_purposes(spark: SparkSession, sf: str) -> DataFrame:
    return behaviour.purposes(_commands(_rows(spark, sf)))


TOKENS = ", ".join(f"('{token}', '{key}', {least})" for token, (apis, least) in behaviour.API_RULES.items() for key in [*apis, *[f"{behaviour.SET_INFORMATION}:{x}" for x, t in behaviour.CLASSES.items() if t == token]])


#: The sample's own processes, with their ids; this goes before what reads `own`.
OWN = f""", own AS (SELECT run_id, min(pnum) + 1 AS pid FROM procs GROUP BY run_id
 UNION SELECT p.run_id, p.pnum + 1 FROM procs p JOIN own o ON p.run_id = o.run_id AND {_by("p.pnum", [str(p[1]) for p in PROCESSES])} = o.pid WHERE lower(p.name) NOT IN ({", ".join(f"'{x}'" for x in behaviour.BYSTANDERS)})),
ro AS (SELECT r.* FROM r JOIN own o ON r.run_id = o.run_id AND r.pnum + 1 = o.pid),
st AS (SELECT run_id, min(ts) AS ts FROM ro GROUP BY run_id)
"""
RECURSIVE = BASE.replace("WITH ev", "WITH RECURSIVE ev", 1) + OWN
#: The onset of encryption, of three rewrites or more, and of notes, in two folders or more.
ONSETS = """, sec AS (SELECT *, last_value(CASE WHEN call = 'NtCreateSection' THEN lower(path) END IGNORE NULLS) OVER (PARTITION BY run_id, target % 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file FROM ro WHERE call IN ('NtCreateSection', 'NtMapViewOfSection')),
rw AS (SELECT run_id, place, ts, call, lower(path) AS p, regexp_replace(lower(path), '\\.[^.\\\\]*$', '') AS s FROM ro WHERE call IN ('NtReadFile', 'ReadFile', 'NtWriteFile', 'WriteFile')),
rk AS (SELECT run_id, key, min(place) AS place FROM (SELECT run_id, unnest([p, s]) AS key, place FROM rw WHERE call IN ('NtReadFile', 'ReadFile') UNION ALL SELECT run_id, file, place FROM sec WHERE call = 'NtMapViewOfSection' AND file IS NOT NULL) GROUP BY ALL),
hits AS (SELECT DISTINCT rw.run_id, rw.place, rw.ts FROM rw JOIN rk ON rk.run_id = rw.run_id AND rk.key IN (rw.p, rw.s) AND rk.place < rw.place WHERE call IN ('NtWriteFile', 'WriteFile')),
enc AS (SELECT run_id, count(*) AS n_rewrites, min_by(ts, place) AS onset, min(place) AS pos FROM hits GROUP BY run_id HAVING count(*) >= 3),
docs AS (SELECT run_id, regexp_extract(p, '[^\\\\]*$') AS name FROM (SELECT DISTINCT run_id, lower(path) AS p FROM r WHERE kind = 'write') WHERE regexp_matches(p, '\\.(txt|html?|hta|rtf|url|png|bmp)$')
 GROUP BY ALL HAVING count(DISTINCT CASE WHEN contains(p, '\\') THEN regexp_replace(p, '\\\\[^\\\\]*$', '') ELSE '' END) >= 2),
nh AS (SELECT run_id, count(DISTINCT name) AS names, min_by(ts, place) AS onset, min(place) AS pos FROM (SELECT run_id, place, ts, regexp_extract(lower(path), '[^\\\\]*$') AS name FROM ro WHERE call IN ('NtWriteFile', 'WriteFile', 'NtCreateFile')) JOIN docs USING (run_id, name) GROUP BY run_id)
"""


@query("j14_own_processes", RECURSIVE + "SELECT p.run_id, CAST(p.proc AS INT) AS proc FROM procs p JOIN own o ON p.run_id = o.run_id AND p.pnum + 1 = o.pid")
def own_processes(spark: SparkSession, sf: str) -> DataFrame:
    """The sample's processes, without bystanders and what hangs on them alone."""
    return behaviour.own_processes(_processes(_rows(spark, sf)))


@query("o22_report_onset", RECURSIVE + ONSETS + "SELECT * FROM enc")
def report_onset(spark: SparkSession, sf: str) -> DataFrame:
    """The first write to what was read or mapped, by own processes."""
    rows = _rows(spark, sf)
    return behaviour.encryption_onset(_calls(rows), behaviour.own_processes(_processes(rows)), least=3)


@query("o23_report_note", RECURSIVE + ONSETS + "SELECT * FROM nh")
def report_note(spark: SparkSession, sf: str) -> DataFrame:
    """The first call on a document that lies in several folders."""
    rows = _rows(spark, sf)
    return behaviour.note_onset(_calls(rows), behaviour.own_processes(_processes(rows)), _list(rows, "write_files"), least=2)


@query("o24_report_encryption", RECURSIVE + "SELECT run_id, CAST(count(*) FILTER (call IN ('NtWriteFile', 'WriteFile') AND pid IS NOT NULL) >= 6 AS INT) AS coarse_encryption FROM r LEFT JOIN (SELECT run_id, pid, pid - 1 AS pnum FROM own) USING (run_id, pnum) GROUP BY run_id")
def report_encryption(spark: SparkSession, sf: str) -> DataFrame:
    """Many writes by own processes."""
    rows = _rows(spark, sf)
    return behaviour.coarse_encryption(_calls(rows), own=behaviour.own_processes(_processes(rows)), least=6)


TOKENS = ", ".join(f"('{token}', '{key}', {least})" for token, (apis, least) in behaviour.API_RULES.items() for key in [*apis, *[f"{behaviour.SET_INFORMATION}:{x}" for x, t in behaviour.CLASSES.items() if t == token]])


@query(
    "o21_behaviours",
    RECURSIVE + ONSETS + f""", tok(token, key, least) AS (VALUES {TOKENS}), rules(token, pattern, i) AS (VALUES {RULES}),
k AS (SELECT run_id, CASE WHEN call = 'NtSetInformationFile' THEN call || ':' || cls ELSE call END AS key, count(*) AS n, min(place) AS place, arg_min(ts, place) AS ts FROM ro GROUP BY ALL),
a AS (SELECT run_id, token, ts, place, sum(n) OVER (PARTITION BY run_id, token) AS n, least, row_number() OVER (PARTITION BY run_id, token ORDER BY ts, place) AS rn FROM k JOIN tok USING (key)),
m AS (SELECT run_id, token, ts, place FROM a WHERE rn = 1 AND n >= least UNION ALL SELECT run_id, token, ts, -1 FROM procs JOIN rules ON regexp_matches(text, pattern)
 UNION ALL SELECT run_id, token, ts, j - 1001 FROM c JOIN st USING (run_id) JOIN rules ON regexp_matches(text, pattern)
 UNION ALL SELECT run_id, 'FILE_ENCRYPT', onset, pos FROM enc UNION ALL SELECT run_id, 'RANSOM_NOTE', onset, pos FROM nh),
f AS (SELECT run_id, token, ts, place, row_number() OVER (PARTITION BY run_id, token ORDER BY ts, place) AS rn FROM m)
SELECT run_id, string_agg(token, ',' ORDER BY ts, place, token) AS sequence FROM f WHERE rn = 1 GROUP BY run_id""",
)
def behaviours(spark: SparkSession, sf: str) -> DataFrame:
    """Behaviours of a report in the order of first evidence; calls count for the sample's own processes alone."""
    rows = _rows(spark, sf)
    marks = behaviour.report_behaviours(_calls(rows), _processes(rows), _list(rows, "executed_commands"), _list(rows, "write_files"), rewrites=3, places=2)
    return behaviour.behaviours(marks).select("run_id", F.array_join("sequence", ",").alias("sequence"))


@query(
    "o07_report_stages",
    BASE + f""", e AS (SELECT run_id, kind, ts, lower(path) AS low, regexp_replace(lower(regexp_extract(replace(path, '/', '\\'), '[^\\\\]*$')), '[\\s_\\-.!]+', '', 'g') AS flat FROM r),
m AS (SELECT run_id, 'read' AS stage, ts FROM e WHERE kind = 'read' UNION ALL SELECT run_id, 'write', ts FROM e WHERE kind = 'write' UNION ALL SELECT run_id, 'rename', ts FROM e WHERE kind = 'move' UNION ALL SELECT run_id, 'delete', ts FROM e WHERE kind = 'delete'
 UNION ALL SELECT run_id, 'wallpaper', ts FROM e WHERE kind = 'write' AND (contains(low, 'transcodedwallpaper') OR contains(low, '\\themes\\') OR contains(low, 'wallpaper'))
 UNION ALL SELECT run_id, 'note', ts FROM e WHERE kind = 'write' AND ({" OR ".join(f"contains(flat, '{w}')" for w in behaviour.STAGE_NOTE_WORDS)})
 UNION ALL SELECT run_id, 'enumerate', ts FROM r WHERE call = 'FindFirstFileExW' UNION ALL SELECT run_id, 'crypto', ts FROM r WHERE call LIKE 'Crypt%' OR call LIKE 'BCrypt%'
 UNION ALL SELECT run_id, 'persistence', NULL FROM keys WHERE {" OR ".join(f"contains(lower(value), '{w}')" for w in behaviour.PERSISTENCE_KEYS)}
 """
    + " ".join(f"UNION ALL SELECT run_id, '{s}', NULL FROM c WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) for s, ws in behaviour.COMMAND_STAGES.items())
    + f"""), f AS (SELECT run_id, stage, min(ts) AS ts FROM m GROUP BY ALL)
SELECT run_id, count(*) AS n_stages_all, count(*) FILTER (stage NOT IN ('rename', 'delete', 'note')) AS n_stages_clean, count(*) FILTER (stage IN ({", ".join(f"'{s}'" for s in behaviour.COMMAND_STAGES)})) AS stage_ground_clearing,
 CAST(bool_or(stage = 'enumerate') AS INT) AS stage_has_enumerate, CAST(bool_or(stage = 'wallpaper') AS INT) AS stage_has_wallpaper, CAST(bool_or(stage = 'persistence') AS INT) AS stage_has_persistence,
 CASE WHEN count(ts) >= 2 THEN round((max(ts) - min(ts)) / 1e6, 2) END AS stage_span_sec, count(ts) AS stage_timed_count FROM f GROUP BY run_id""",
)
def stages(spark: SparkSession, sf: str) -> DataFrame:
    """The fourteen stages."""
    rows = _rows(spark, sf)
    lists = _number(reports.summary(rows, ["executed_commands", "write_keys"]))
    of = lambda name, as_: lists.filter(F.col("list") == name).select("run_id", F.col("value").alias(as_))
    return behaviour.stage_features(behaviour.stage_marks(_events(rows), _calls(rows), of("write_keys", "value"), of("executed_commands", "text")))


@query(
    "o20_preparation_counts",
    BASE + """, t AS (SELECT run_id, lower(text) AS x, 1 AS c, 0 AS w FROM c UNION ALL SELECT run_id, lower(value), 0, 1 FROM keys)
SELECT run_id, CAST(sum(c) AS BIGINT) AS n_executed_commands, """
    + ", ".join("count(*) FILTER (c = 1 AND (" + " OR ".join(f"contains(x, '{w}')" for w in ws) + f")) AS n_{name}" for name, ws in behaviour.PREPARATION_COMMANDS.items())
    + ", CAST(0 AS BIGINT) AS n_services_created, CAST(0 AS BIGINT) AS n_services_started, CAST(sum(w) AS BIGINT) AS n_registry_writes, CAST(0 AS BIGINT) AS n_registry_deletes FROM t GROUP BY run_id",
)
def preparation_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return behaviour.preparation_counts(_number(reports.summary(rows, ["executed_commands", "created_services", "started_services", "write_keys", "delete_keys"])))


@query(
    "o20_preparation_timing",
    BASE + """, p AS (SELECT run_id, ts FROM procs WHERE pnum = 1), d AS (SELECT run_id, min(ts) AS d0, max(ts) AS d1, count(*) AS nd FROM r WHERE kind IN ('delete', 'move') GROUP BY run_id)
SELECT run_id, CAST(1 AS BIGINT) AS n_prep_processes, CAST(1 AS BIGINT) AS n_prep_categories, CAST(coalesce(ts <= d0, false) AS BIGINT) AS n_prep_before_destroy, CAST(ts <= d0 AS INT) AS prep_precedes_destroy, CASE WHEN ts <= d0 THEN round((d0 - ts) / 1e6, 1) END AS prep_to_first_destroy_sec,
 CASE WHEN d0 IS NULL THEN NULL WHEN ts <= d0 THEN nd ELSE 0 END AS n_destroy_after_prep, CASE WHEN d0 IS NULL THEN NULL WHEN nd > 1 THEN round((d1 - d0) / 1e6, 1) ELSE 0.0 END AS destroy_span_after_prep_sec, CAST(ts BETWEEN d0 AND d1 AS BIGINT) AS n_prep_during_destroy,
 CAST(ts <= d1 AS INT) AS prep_overlaps_destroy, CASE WHEN ts BETWEEN d0 AND d1 AND d1 > d0 THEN round((ts - d0) / CAST(d1 - d0 AS DOUBLE), 3) END AS prep_position_in_destroy FROM p LEFT JOIN d USING (run_id)""",
)
def preparation_timing(spark: SparkSession, sf: str) -> DataFrame:
    """Launches of preparing utilities against deletes and moves."""
    rows = _rows(spark, sf)
    processes = _number(reports.processes(rows)).select("run_id", "name", F.unix_micros("first_seen").alias("ts"))
    return behaviour.preparation_timing(processes, _events(rows).filter("kind IN ('delete', 'move')").select("run_id", "ts"))


DECOY = "(contains(lower(path), '\\users\\admin\\desktop') OR contains(lower(path), '\\users\\admin\\documents') OR contains(lower(path), '\\users\\admin\\downloads'))"
DAMAGE = f""", q AS (SELECT run_id, path, bool_or(kind = 'read') AS r, bool_or(kind = 'write') AS w, bool_or(kind IN ('delete', 'move')) AS x FROM r WHERE {DECOY} AND NOT contains(lower(path), 'desktop.ini') GROUP BY ALL),
y AS (SELECT run_id, count(*) FILTER ((x AND NOT (w AND NOT r)) OR (w AND r)) AS destroyed_decoys, count(*) FILTER (w AND NOT r) AS self_created, count(*) FILTER (r AND NOT ((x AND NOT (w AND NOT r)) OR (w AND r))) AS read_only_decoys FROM q GROUP BY run_id)
"""


@query("o25_victim_dirs", BASE + DAMAGE + "SELECT * FROM y")
def victim_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Damage to decoys alone, by folder and without noise."""
    rows = _events(_rows(spark, sf)).filter(verdict.is_decoy(F.col("path")))
    return verdict.decoy_damage(rows.withColumn("target", F.col("path")))


@query(
    "o33_decoy_diagnosis",
    BASE + f"""SELECT run_id, count(DISTINCT CASE WHEN {DECOY} AND kind IN ('write', 'delete', 'move') THEN lower(path) END) AS in_folders, count(DISTINCT CASE WHEN {DECOY} AND kind IN ('write', 'delete', 'move') AND NOT contains(lower(path), 'desktop.ini') THEN lower(path) END) AS without_noise,
 count(DISTINCT CASE WHEN {DECOY} AND kind IN ('write', 'delete', 'move') AND path LIKE '%.docx' THEN lower(path) END) AS allowed_only FROM r GROUP BY run_id""",
)
def decoy_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.decoy_diagnosis(_events(_rows(spark, sf)), F.col("path"), ["docx", "pdf"])


APPENDS = """, wd AS (SELECT DISTINCT run_id, kind, path, CASE WHEN contains(path, '\\') THEN regexp_replace(path, '\\\\[^\\\\]*$', '') ELSE '' END AS dir FROM r WHERE kind IN ('write', 'delete')),
ax AS (SELECT run_id, moved[length(path) + 1:] AS suffix FROM r WHERE kind = 'move' AND starts_with(moved, path)
 UNION ALL SELECT w.run_id, w.path[length(min(d.path)) + 1:] FROM wd w JOIN wd d ON w.run_id = d.run_id AND w.dir = d.dir AND w.kind = 'write' AND d.kind = 'delete' AND starts_with(w.path, d.path) AND w.path <> d.path GROUP BY w.run_id, w.path),
ap AS (SELECT run_id, count(*) AS append_renames, count(DISTINCT suffix) AS distinct_suffixes FROM ax GROUP BY run_id)
"""
SHARED = """, se AS (SELECT run_id, ext, count(*) AS n, min(pos) AS first FROM (SELECT run_id, pos, path, moved, lower(regexp_extract(regexp_extract(replace(moved, '/', '\\'), '[^\\\\]*$'), '\\..*$')) AS ext, lower(regexp_extract(regexp_extract(replace(path, '/', '\\'), '[^\\\\]*$'), '\\..*$')) AS old FROM r WHERE kind = 'move')
 WHERE NOT starts_with(moved, path) AND ext <> '' AND ext <> old AND NOT regexp_full_match(ltrim(ext, '.'), '[0-9]+') AND ltrim(ext, '.') <> 'tmp' GROUP BY run_id, ext),
sx AS (SELECT run_id, ext, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, first) AS rn FROM se) WHERE rn = 1)
"""
NOTES = """, np AS (SELECT run_id, lower(replace(path, '/', '\\')) AS p FROM r WHERE kind = 'write' UNION ALL SELECT run_id, lower(replace(moved, '/', '\\')) FROM r WHERE kind = 'move'),
nn AS (SELECT run_id, regexp_extract(p, '[^\\\\]*$') AS name, p[:length(p) - length(regexp_extract(p, '[^\\\\]*$')) - 1] AS dir FROM np WHERE contains(p, '\\')),
nc AS (SELECT run_id, name, count(DISTINCT dir) AS dirs, bool_or(contains(translate(name, ' _-.!', ''), 'howto')) AS explicit FROM nn WHERE regexp_matches(translate(name, ' _-.!', ''), 'readme|howto') GROUP BY ALL),
nt AS (SELECT run_id, dirs, name, explicit, count(*) OVER (PARTITION BY run_id) AS candidates, row_number() OVER (PARTITION BY run_id ORDER BY explicit DESC, dirs DESC, name) AS rn FROM nc)
"""


def _moves(rows: DataFrame) -> DataFrame:
    return _events(rows).filter("kind = 'move'").select("run_id", "pos", "source", "target")


def _appends(rows: DataFrame) -> DataFrame:
    folder = F.when(F.instr("value", "\\") > 0, F.regexp_replace("value", r"\\[^\\]*$", "")).otherwise("")
    files = lambda name: _list(rows, name).select("run_id", folder.alias("dir"), F.col("value").alias("path"))
    return verdict.append_renames(_moves(rows), files("write_files"), files("delete_files"))


def _notes(rows: DataFrame) -> DataFrame:
    rows = _events(rows).filter("kind IN ('write', 'move')")
    return verdict.note_spread(rows.select("run_id", F.explode(F.array_compact(F.array("file", "target"))).alias("path")))


@query("o26_append_renames", BASE + APPENDS + "SELECT * FROM ap")
def append_renames(spark: SparkSession, sf: str) -> DataFrame:
    return _appends(_rows(spark, sf))


@query("o27_shared_extension", BASE + SHARED + "SELECT run_id, n AS shared_extension_renames, ext AS shared_extension FROM sx")
def shared_extension(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.shared_extension(_moves(_rows(spark, sf)))


@query("o28_note_spread", BASE + NOTES + "SELECT run_id, dirs AS note_dirs, name AS note_name, explicit AS note_explicit, candidates FROM nt WHERE rn = 1")
def note_spread(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(_rows(spark, sf))


@query(
    "o30_report_verdict",
    BASE + DAMAGE + APPENDS + SHARED + NOTES + """, v AS (SELECT e.run_id, e.n, coalesce(destroyed_decoys, 0) AS d, coalesce(read_only_decoys, 0) AS ro, coalesce(append_renames, 0) AS a, coalesce(distinct_suffixes, 0) AS s, coalesce(sx.n, 0) AS x, coalesce(dirs, 0) AS nd, coalesce(explicit, false) AS ex
 FROM (SELECT run_id, count(*) AS n FROM r GROUP BY run_id) e LEFT JOIN y USING (run_id) LEFT JOIN ap USING (run_id) LEFT JOIN sx USING (run_id) LEFT JOIN (SELECT * FROM nt WHERE rn = 1) USING (run_id)),
z AS (SELECT *, CAST(d >= 3 AS INT) + CAST(a >= 3 AS INT) + CAST(nd >= 1 AS INT) + CAST(x >= 3 AS INT) AS axes FROM v)
SELECT run_id, axes, CASE WHEN d >= 4 THEN 'TRUE_ENCRYPTION' WHEN a >= 8 AND s / CAST(greatest(1, a) AS DOUBLE) <= 0.3 THEN 'TRUE_ENCRYPTION' WHEN x >= 50 THEN 'TRUE_ENCRYPTION' WHEN axes >= 4 THEN 'TRUE_ENCRYPTION'
 WHEN n < 60 THEN CASE WHEN ex OR nd >= 2 THEN 'TRUE_ENCRYPTION' ELSE 'FAILED' END WHEN ex OR nd >= 2 THEN 'TRUE_ENCRYPTION' WHEN d > 0 THEN 'WEAK_VICTIM_ACTIVITY' ELSE 'NO_VICTIM_ACTIVITY' END AS verdict FROM z""",
)
def report_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """O25 to O30 from the report on: evidence on four axes, and the cascade."""
    rows = _rows(spark, sf)
    decoys = _events(rows).filter(verdict.is_decoy(F.col("path")))
    damage = verdict.decoy_damage(decoys.withColumn("target", F.col("path")))
    calls = _calls(rows).groupBy("run_id").agg(F.count(F.lit(1)).alias("total_calls"))
    joined = calls
    for part in (damage, _appends(rows), verdict.shared_extension(_moves(rows)), _notes(rows)):
        joined = joined.join(part, "run_id", "left")
    evidence = joined.fillna(0).fillna(False, ["note_explicit"])
    return verdict.verdicts(evidence, verdict.Limits(destroyed=4, axes=4, events_an_axis=3, executed=60)).select("run_id", "axes", "verdict")


@query(
    "p13_extension_groups",
    BASE + "SELECT grp, count(*) AS n FROM (SELECT CASE WHEN path LIKE '%.enc' THEN 'other' ELSE CASE target % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'other' WHEN 2 THEN 'executable' WHEN 3 THEN 'document' ELSE 'other' END END AS grp FROM r) GROUP BY grp",
)
def extension_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _events(_rows(spark, sf)).groupBy(extension_group(extension(F.col("path"))).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("s13_structure", EVENT_LOG_SQL + "SELECT count(*) FILTER (run_id % 17 <> 0) / CAST(count(*) AS DOUBLE) AS share, true AS has_behavior FROM (SELECT DISTINCT run_id FROM ev)")
def structure(spark: SparkSession, sf: str) -> DataFrame:
    return reports.structure(_found(spark, sf)).select("share", F.contains("schema", F.lit("behavior")).alias("has_behavior"))


@query(
    "p29_attempts",
    "SELECT o_orderkey, CAST(o_orderkey % 4 AS BIGINT) AS attempts, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE '' END AS notes FROM orders",
)
def attempt_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    first = F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("")
    notes = F.when(F.col("o_orderkey") % 4 > 0, F.concat(first, F.lit(";submit_failed_x"), F.col("o_orderkey") % 4)).otherwise(first)
    return rows.select("o_orderkey", behaviour.attempts(notes).alias("attempts"), behaviour.without_attempts(notes).alias("notes"))


@query(
    "s02_batch_targets",
    """WITH f AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'b/task_' || s_suppkey || '_report.json.gz' WHEN 1 THEN 'b/task-' || s_suppkey || '.json' WHEN 2 THEN 'b/x' || s_suppkey || '.json' ELSE 'b/notes' || s_suppkey || '.txt' END AS path, s_suppkey FROM supplier),
n AS (SELECT path, CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey END AS number FROM f WHERE s_suppkey % 4 < 3) SELECT path, number, row_number() OVER (ORDER BY number NULLS LAST, path) AS place FROM n""",
)
def batch_targets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("b/task_"), k, F.lit("_report.json.gz"))).when(k % 4 == 1, F.concat(F.lit("b/task-"), k, F.lit(".json"))).when(k % 4 == 2, F.concat(F.lit("b/x"), k, F.lit(".json"))).otherwise(F.concat(F.lit("b/notes"), k, F.lit(".txt")))
    found = reports.targets(spark.read.parquet(f"{sf}/supplier.parquet").select(name.alias("path")))
    return numbered(found, [], [F.col("number").asc_nulls_last(), "path"], F.coalesce(F.lpad(F.floor(F.col("number") / 1000).cast("string"), 12, "0"), F.lit("~")), "place")


@query("s12_archives", EVENT_LOG_SQL + "SELECT prefix || run_id AS run_id, run_id % 17 = 0 AS bad FROM (SELECT DISTINCT run_id FROM ev), (SELECT unnest(['a:', 'b:']) AS prefix) WHERE run_id % 17 <> 0 UNION ALL SELECT prefix || run_id, true FROM (SELECT DISTINCT run_id FROM ev), (SELECT unnest(['a:', 'b:']) AS prefix) WHERE run_id % 17 = 0")
def archives(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_reports(spark, sf)
    return reports.merged({"a:": raw, "b:": raw}).select("run_id", "bad")


@query("o31_masked_rows", BASE + "SELECT run_id, CASE WHEN count(*) >= 60 THEN count(*) END AS n_calls, CASE WHEN count(*) >= 60 THEN count(DISTINCT call) END AS n_apis FROM r GROUP BY run_id")
def masked_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Dynamic columns are blank where a run is not fully covered."""
    per = _calls(_rows(spark, sf)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("api").alias("n_apis"), F.when(F.count(F.lit(1)) >= 60, "full").otherwise("low").alias("coverage"))
    return reports.masked(per, ["n_calls", "n_apis"]).drop("coverage")


@query(
    "o32_survey",
    BASE + """, t AS (SELECT run_id, lower(text) AS x FROM c UNION ALL SELECT run_id, lower(text) FROM procs WHERE text IS NOT NULL), p AS (SELECT run_id, CASE run_id % 3 WHEN 0 THEN 'TRUE_ENCRYPTION' WHEN 1 THEN 'FAILED' ELSE 'WEAK_VICTIM_ACTIVITY' END AS verdict, """
    + ", ".join("count(*) FILTER (" + " OR ".join(f"contains(x, '{w}')" for w in words) + f") AS n_{name}" for name, words in behaviour.PURPOSES.items())
    + " FROM t GROUP BY run_id) SELECT verdict, count(*) AS runs, "
    + ", ".join(f"round(avg(CASE WHEN n_{name} > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_n_{name}" for name in behaviour.PURPOSES)
    + " FROM p GROUP BY verdict",
)
def survey(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the runs of each verdict that show each purpose of a command."""
    found = behaviour.purposes(_commands(_rows(spark, sf)))
    kind = F.when(F.col("run_id") % 3 == 0, "TRUE_ENCRYPTION").when(F.col("run_id") % 3 == 1, "FAILED").otherwise("WEAK_VICTIM_ACTIVITY")
    flags = [f"n_{name}" for name in behaviour.PURPOSES]
    out = verdict.survey(found.withColumn("verdict", kind), flags)
    return out.select("verdict", "runs", *[F.round(f"share_{c}", 6).alias(f"share_{c}") for c in flags])


@query(
    "p04_p08_names",
    BASE + r""", n AS (SELECT DISTINCT path, regexp_extract(path, '[^\\]*$') AS name FROM r) SELECT path, CASE WHEN contains(name, '.') THEN lower(regexp_extract(path, '([^.]*)$', 1)) ELSE '(none)' END AS ext, CASE WHEN contains(name, '.') THEN regexp_replace(path, '\.[^.\\]*$', '') ELSE path END AS stem FROM n""",
)
def path_names(spark: SparkSession, sf: str) -> DataFrame:
    """The extension or (none), and a path without its extension."""
    rows = _events(_rows(spark, sf)).select("path").distinct()
    return rows.select("path", extension_or_none(F.col("path")).alias("ext"), stem(F.col("path")).alias("stem"))
