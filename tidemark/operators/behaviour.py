"""Rules that turn commands, calls, events and names into behaviours, stages and purposes, with times of first evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paths import contains_any, stem
from tidemark.functions.safe import ratio
from tidemark.operators.sequences import rewrite_onset
from tidemark.operators.tables import tree_closure

#: Behaviour of a command line, in order.
COMMAND_RULES = (
    ("SHADOW_DELETE", r"(?i)(vssadmin|wmic).{0,40}shadow(cop(y|ies))?\s*(delete|/nointeractive)|shadowcopy\s+delete|Win32_ShadowCopy"),
    ("RECOVERY_DISABLE", r"(?i)\bbcdedit\b"),
    ("BACKUP_DELETE", r"(?i)wbadmin.{0,20}(delete|catalog)"),
    ("FIREWALL_DISABLE", r"(?i)netsh.{0,40}(firewall|advfirewall).{0,20}(off|disable)"),
    ("EVENTLOG_CLEAR", r"(?i)wevtutil.{0,10}\bcl\b|Clear-EventLog"),
    ("PERSIST_SCHTASK", r"(?i)schtasks.{0,10}/create"),
    ("PROCESS_KILL", r"(?i)\btaskkill\b"),
    ("SERVICE_ACCESS", r"(?i)\bnet\s+stop\b|\bsc\s+(stop|config|delete)\b"),
    ("SELF_COPY", r'(?i)appdata\\(roaming|local)\\[^\\"]+\.exe'),
)
#: Behaviour -> (APIs, calls of any of them at least).
API_RULES = {
    "WALLPAPER_SET": (("SystemParametersInfoW", "SystemParametersInfoA"), 1),
    "PROCESS_KILL": (("NtTerminateProcess",), 3),
    "PROCESS_ENUM": (("CreateToolhelp32Snapshot", "Process32FirstW", "Process32NextW"), 1),
    "SERVICE_ACCESS": (("OpenSCManagerW", "OpenServiceW", "ControlService", "ChangeServiceConfigW", "DeleteService"), 2),
    "REGISTRY_WRITE": (("RegSetValueExW", "RegSetValueExA"), 3),
    "NETWORK": (("connect", "WSAConnect", "InternetConnectW", "InternetOpenUrlW", "HttpSendRequestW"), 1),
    "RM_SESSION": (("RmStartSession", "RmRegisterResources"), 1),
    "CRYPTO_API": (("CryptEncrypt", "BCryptEncrypt", "CryptGenKey", "CryptDeriveKey", "BCryptGenerateSymmetricKey"), 5),
    "DIR_ENUMERATE": (("FindFirstFileExW", "FindFirstFileW", "NtQueryDirectoryFile"), 50),
    "FILE_DELETE": (("NtDeleteFile", "DeleteFileW"), 20),
    "FILE_RENAME": (("MoveFileW", "MoveFileExW", "MoveFileWithProgressW", "MoveFileWithProgressTransactedW"), 20),
}
#: The call whose argument FileInformationClass tells what it does, and its classes that count as behaviours.
SET_INFORMATION, CLASSES = "NtSetInformationFile", {"13": "FILE_DELETE", "10": "FILE_RENAME"}

#: Processes of the system itself, which are not the sample's even below it.
BYSTANDERS = (
    "explorer.exe", "svchost.exe", "dllhost.exe", "wmiprvse.exe", "securityhealthhost.exe", "mobsync.exe", "useroobebroker.exe",
    "splwow64.exe", "slui.exe", "musnotification.exe", "runtimebroker.exe", "sihost.exe", "taskhostw.exe", "conhost.exe",
    "backgroundtaskhost.exe", "searchindexer.exe", "ctfmon.exe", "fontdrvhost.exe", "dwm.exe", "spoolsv.exe", "sppsvc.exe",
    "wuauclt.exe", "smartscreen.exe", "wmiadap.exe", "applicationframehost.exe", "shellexperiencehost.exe",
    "startmenuexperiencehost.exe", "textinputhost.exe", "musnotificationux.exe", "musnotifyicon.exe", "usoclient.exe", "searchapp.exe",
)
#: Calls that read, write, or map a file, and names of documents that can be notes.
READS, WRITES, OPENS = ("NtReadFile", "ReadFile"), ("NtWriteFile", "WriteFile"), ("NtWriteFile", "WriteFile", "NtCreateFile")
SECTION, MAP, DEVICE = "NtCreateSection", "NtMapViewOfSection", "\\device\\"
NOTE_DOCUMENTS = r"\.(txt|html?|hta|rtf|url|png|bmp)$"

#: Stages that commands, APIs, keys and names show, and the stages that the verdict reads itself.
COMMAND_STAGES = {
    "shadow_delete": ("vssadmin", "shadowcopy", "shadowstorage", "wmic shadow"),
    "recovery_off": ("bcdedit", "wbadmin", "recoveryenabled", "bootstatuspolicy"),
    "service_stop": ("net stop", "sc stop", "sc config", "taskkill /f"),
    "log_clear": ("wevtutil", "cl system", "cl security"),
    "backup_delete": ("delete catalog", "delete systemstatebackup"),
}
ENUMERATION_APIS = (
    "NtQueryDirectoryFile", "NtQueryDirectoryFileEx", "FindFirstFileExW", "FindNextFileW", "GetLogicalDriveStringsW",
    "NtQueryVolumeInformationFile", "SHGetFolderPathW", "GetDiskFreeSpaceExW",
)
PERSISTENCE_KEYS = ("currentversion\\run", "currentversion\\runonce", "\\winlogon\\shell", "\\userinit")
WALLPAPER_MARKS = ("transcodedwallpaper", "\\themes\\", "wallpaper")
STAGE_NOTE_WORDS = ("readme", "decrypt", "recover", "restore", "howto", "unlock", "ransom", "yourfiles", "filesback")
VERDICT_STAGES = ("rename", "delete", "note")

#: What counts as preparing, by words of a command and by names of processes.
PREPARATION_COMMANDS = {
    "shadow_delete": ("vssadmin", "shadowcopy", "wbadmin", "delete shadows", "delete catalog", "resize shadowstorage"),
    "recovery_disable": ("bcdedit", "recoveryenabled", "bootstatuspolicy", "ignoreallfailures"),
    "service_stop": ("net stop", "sc stop", "sc.exe stop", "net1 stop"),
    "process_kill": ("taskkill", "tskill", "wmic process call terminate"),
    "log_clear": ("wevtutil", "clear-eventlog", "cipher /w"),
}
PREPARATION_PROCESSES = {
    "vssadmin.exe": "shadow", "wmic.exe": "shadow", "wbadmin.exe": "shadow", "bcdedit.exe": "recovery", "net.exe": "service",
    "net1.exe": "service", "sc.exe": "service", "taskkill.exe": "kill", "wevtutil.exe": "logs", "schtasks.exe": "persistence",
    "reg.exe": "persistence",
}
#: Purposes of a command by its words.
PURPOSES = {
    "shadow_delete": ("vssadmin", "shadowcopy", "wbadmin", "delete shadows", "delete catalog", "resize shadowstorage", "shadowstorage"),
    "recovery_disable": ("bcdedit", "recoveryenabled", "bootstatuspolicy", "ignoreallfailures", "disable-computerrestore"),
    "backup_delete": ("wbadmin delete", "delete backup", "delete systemstatebackup"),
    "service_stop": ("net stop", "sc stop", "sc.exe stop", "net1 stop", "stop-service"),
    "process_kill": ("taskkill", "tskill", "process call terminate", "stop-process"),
    "lateral_movement": ("net use", "net view", "psexec", "wmic /node", "admin$", "c$", "ipc$", "invoke-command", "enter-pssession"),
    "persistence": ("schtasks", "reg add", "currentversion\\\\run", "sc create", "new-service", "startup"),
    "log_clear": ("wevtutil", "clear-eventlog", "cipher /w", "clearev"),
    "discovery": ("nltest", "net group", "net user", "whoami", "systeminfo", "arp -a", "ipconfig", "net localgroup"),
}


def command_tokens(text: Column, rules: Sequence[tuple[str, str]] = COMMAND_RULES) -> Column:
    """The behaviours of a command line, in the order of the rules; an empty array where none fits or there is no text."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(token)) for token, pattern in rules]))


def purposes(commands: DataFrame, text: str = "text", words: Mapping[str, Sequence[str]] = PURPOSES) -> DataFrame:
    """Per run: commands of each purpose; a command may have several."""
    return commands.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_commands"), *[F.count_if(contains_any(F.col(text), list(ws))).alias(f"n_{name}") for name, ws in words.items()])


def attempts(notes: Column) -> Column:
    """The number of failed attempts that notes record; 0 without a mark."""
    return F.coalesce(F.nullif(F.regexp_extract(notes, r"submit_failed_x(\d+)", 1), F.lit("")).cast("long"), F.lit(0))


def without_attempts(notes: Column) -> Column:
    """Notes without their marks of attempts; an empty string for none."""
    return F.regexp_replace(F.coalesce(notes, F.lit("")), r";?submit_failed_x\d+", "")


def command_marks(commands: DataFrame, rules: Sequence[tuple[str, str]] = COMMAND_RULES) -> DataFrame:
    """run_id, ts, pos, token of commands (run_id, ts, pos, text)."""
    return commands.select("run_id", "ts", "pos", F.explode(command_tokens(F.col("text"), rules)).alias("token"))


def own_processes(processes: DataFrame, bystanders: Sequence[str] = BYSTANDERS) -> DataFrame:
    """run_id, proc of the processes (run_id, proc, node, parent, name) of the sample: the run's first process, and those
    below it that are no bystanders. A bystander cuts off what it started. Entries that repeat a kept number are kept."""
    first = processes.groupBy("run_id").agg(F.min_by("node", "proc").alias("first"))
    root = F.col("node").eqNullSafe(F.col("first"))
    edges = processes.join(first, "run_id").select("run_id", "node", "parent", root.alias("root"), (~root & F.coalesce(F.lower("name"), F.lit("")).isin(list(bystanders))).alias("cut"))
    tree = tree_closure(edges, F.col("root"), F.col("cut")).withColumnRenamed("run_id", "_run").withColumnRenamed("node", "_node")
    return processes.join(tree, (F.col("run_id") == F.col("_run")) & F.col("node").eqNullSafe(F.col("_node")), "left_semi").select("run_id", "proc")


def run_starts(calls: DataFrame, own: DataFrame) -> DataFrame:
    """run_id and the time of the earliest call of the sample's own processes."""
    per = calls.groupBy("run_id", "proc").agg(F.min("ts").alias("start")).join(own, ["run_id", "proc"], "left_semi")
    return per.groupBy("run_id").agg(F.min("start").alias("start"))


def api_marks(calls: DataFrame, own: DataFrame | None = None, rules: Mapping[str, tuple[Sequence[str], int]] = API_RULES, classes: Mapping[str, str] = CLASSES) -> DataFrame:
    """run_id, ts, pos, token of the behaviours whose APIs were called often enough, at their first evidence.

    calls: run_id, pos, proc, api, ts, class (the argument FileInformationClass, NULL for other calls). own: the processes
    (run_id, proc) whose calls count; without it all do. Calls are counted per process before they meet `own`. Of each API
    the first call by place counts, at its time or else the run's start; of a behaviour's APIs the earliest."""
    key = F.when(F.col("api") == SET_INFORMATION, F.concat(F.lit(SET_INFORMATION + ":"), F.col("class"))).otherwise(F.col("api"))
    members = {token: list(apis) + [f"{SET_INFORMATION}:{c}" for c, t in classes.items() if t == token] for token, (apis, _) in rules.items()}
    tokens = F.array_compact(F.array(*[F.when(F.col("key").isin(names), F.lit(token)) for token, names in members.items()]))
    # The run's start is the least time of all its calls, so every key is counted, not only those of rules.
    per = calls.groupBy("run_id", *(["proc"] if own is not None else []), key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.min_by("ts", "pos").alias("ts"), F.min("ts").alias("start"))
    per = per if own is None else per.join(own, ["run_id", "proc"], "left_semi")
    per = per.groupBy("run_id", "key").agg(F.sum("n").alias("n"), F.min(F.struct("pos", "ts")).alias("first"), F.min("start").alias("start"))
    start = F.min("start").over(Window.partitionBy("run_id"))  # a row for each key of a run
    marked = per.select("run_id", "key", "n", "first.pos", F.coalesce("first.ts", start).alias("ts")).withColumn("token", F.explode(tokens))
    least = F.create_map(*[x for token, (_, n) in rules.items() for x in (F.lit(token), F.lit(n))])
    first = marked.groupBy("run_id", "token").agg(F.sum("n").alias("n"), F.min(F.struct("ts", "pos")).alias("first"))
    return first.filter(F.col("n") >= F.try_element_at(least, F.col("token"))).select("run_id", "first.ts", "first.pos", "token")


def _argument(name: str) -> Column:
    return F.nullif(F.lower(F.try_element_at("args", F.lit(name))), F.lit(""))


def encryption_onset(calls: DataFrame, own: DataFrame, least: int = 20) -> DataFrame:
    """run_id, n_rewrites, onset, pos: the first write to a path that was read or mapped before, or whose stem was, of runs
    whose own processes wrote so `least` times. calls: run_id, pos, proc, api, ts, args.

    A section's handle stands for the file of its last creation in the run."""
    api, name = F.col("api"), _argument("HandleName")
    rows = calls.filter(api.isin(*READS, *WRITES, SECTION, MAP)).join(own, ["run_id", "proc"], "left_semi")
    files = rows.filter(api.isin(*READS, *WRITES) & name.isNotNull() & ~(api.isin(*READS) & F.startswith(name, F.lit(DEVICE))))
    files = files.select("run_id", "pos", "ts", F.when(api.isin(*READS), "read").otherwise("write").alias("kind"), name.alias("path"), stem(name).alias("stem"))
    handle = F.nullif(F.try_element_at("args", F.lit("SectionHandle")), F.lit(""))
    sections = rows.filter(api.isin(SECTION, MAP)).select("run_id", "pos", "ts", "api", handle.alias("handle"), F.when(api == SECTION, _argument("FileName")).alias("file")).filter("handle is not null")
    until = Window.partitionBy("run_id", "handle").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mapped = sections.withColumn("path", F.last("file", ignorenulls=True).over(until)).filter((api == MAP) & F.col("path").isNotNull())
    mapped = mapped.select("run_id", "pos", "ts", F.lit("read").alias("kind"), "path", F.col("path").alias("stem"))
    return rewrite_onset(files.unionByName(mapped), [F.col("path"), F.col("stem")], least)


def note_onset(calls: DataFrame, own: DataFrame, files: DataFrame, least: int = 5) -> DataFrame:
    """run_id, names, onset, pos: the first call of the run's own processes that opens or writes a file whose name is a
    document's and lies in `least` directories or more, of the written paths (run_id, value)."""
    low = F.lower("value")
    split = files.select("run_id", F.substring_index(low, "\\", -1).alias("name"), F.when(F.instr(low, "\\") > 0, F.regexp_replace(low, r"\\[^\\]*$", "")).otherwise("").alias("dir"))
    notes = split.filter(F.col("name").rlike(NOTE_DOCUMENTS)).groupBy("run_id", "name").agg(F.count_distinct("dir").alias("dirs")).filter(F.col("dirs") >= least)
    opened = calls.filter(F.col("api").isin(*OPENS)).withColumn("name", F.substring_index(F.coalesce(_argument("HandleName"), _argument("FileName")), "\\", -1))
    per = opened.groupBy("run_id", "proc", "name").agg(F.min(F.struct("pos", "ts")).alias("first")).join(own, ["run_id", "proc"], "left_semi")
    hits = per.join(notes, ["run_id", "name"]).groupBy("run_id").agg(F.count_distinct("name").alias("names"), F.min("first").alias("first"))
    return hits.select("run_id", "names", F.col("first.ts").alias("onset"), F.col("first.pos").alias("pos"))


def coarse_encryption(calls: DataFrame, is_write: Column | None = None, own: DataFrame | None = None, least: int = 50) -> DataFrame:
    """run_id, coarse_encryption: 1 where the run's own processes (all without `own`) wrote `least` times or more."""
    is_write = F.col("api").isin(*WRITES) if is_write is None else is_write
    if own is None:
        return calls.groupBy("run_id").agg((F.count_if(is_write) >= least).cast("int").alias("coarse_encryption"))
    per = calls.groupBy("run_id", "proc").agg(F.count_if(is_write).alias("n"))
    kept = per.join(own.withColumn("_own", F.lit(True)), ["run_id", "proc"], "left")
    return kept.groupBy("run_id").agg((F.coalesce(F.sum(F.when(F.col("_own"), F.col("n"))), F.lit(0)) >= least).cast("int").alias("coarse_encryption"))


def report_behaviours(calls: DataFrame, processes: DataFrame, listed: DataFrame, files: DataFrame, rewrites: int = 20, places: int = 5) -> DataFrame:
    """run_id, ts, pos, token of all evidence in a report: API counts, the onset of encryption and of notes by the sample's
    own processes, and the commands of all processes and of the run's summary (run_id, value, and `pos` in the list).

    A command without a time of its own has that of the sample's first call, or 0. Listed ones come before those of
    processes, and these before calls of the same time."""
    own = own_processes(processes)
    starts = run_starts(calls, own)
    launched = processes.filter("text <> ''").select("run_id", "ts", F.lit(-1).cast("long").alias("pos"), "text")
    executed = listed.select("run_id", F.lit(None).cast("long").alias("ts"), (F.col("pos") - 1000).cast("long").alias("pos"), F.col("value").alias("text"))
    commands = command_marks(launched.unionByName(executed)).join(starts, "run_id", "left").select("run_id", F.coalesce("ts", "start", F.lit(0)).alias("ts"), "pos", "token")
    onsets = [(encryption_onset(calls, own, rewrites), "FILE_ENCRYPT"), (note_onset(calls, own, files, places), "RANSOM_NOTE")]
    marks = api_marks(calls, own).unionByName(commands)
    for found, token in onsets:
        marks = marks.unionByName(found.join(starts, "run_id", "left").select("run_id", F.coalesce("onset", "start", F.lit(0)).alias("ts"), "pos", F.lit(token).alias("token")))
    return marks


def behaviours(marks: DataFrame) -> DataFrame:
    """run_id and its behaviours in the order of first evidence (time, then place, then name); each once."""
    first = marks.groupBy("run_id", "token").agg(F.min(F.struct("ts", "pos")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "token")))  # one member per token
    return first.groupBy("run_id").agg(F.transform(ordered, lambda x: x["token"]).alias("sequence"))


def stage_marks(events: DataFrame, calls: DataFrame, keys: DataFrame, commands: DataFrame) -> DataFrame:
    """run_id, stage, ts of all evidence of stages: file events (run_id, kind, path, ts), calls (run_id, api, ts), registry
    keys (run_id, value) and commands (run_id, text; without times)."""
    low = F.lower(F.replace(F.coalesce("path", F.lit("")), F.lit("/"), F.lit("\\")))
    flat = F.regexp_replace(F.substring_index(low, "\\", -1), r"[\s_\-.!]+", "")
    words = lambda c, ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(c, w))
    kind, api = F.col("kind"), F.col("api")
    by_event = {"read": kind == "read", "write": kind == "write", "wallpaper": (kind == "write") & contains_any(F.col("path"), list(WALLPAPER_MARKS)), "note": (kind == "write") & words(flat, STAGE_NOTE_WORDS), "rename": kind == "move", "delete": kind == "delete"}
    by_call = {"enumerate": api.isin(list(ENUMERATION_APIS)), "crypto": ~api.isin(list(ENUMERATION_APIS)) & (F.startswith(api, F.lit("Crypt")) | F.startswith(api, F.lit("BCrypt")))}
    each = lambda rules: F.explode(F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in rules.items()]))).alias("stage")
    none = F.lit(None).cast(events.schema["ts"].dataType).alias("ts")
    return (
        events.select("run_id", each(by_event), "ts")
        .unionByName(calls.select("run_id", each(by_call), "ts"))
        .unionByName(keys.filter(contains_any(F.col("value"), list(PERSISTENCE_KEYS))).select("run_id", F.lit("persistence").alias("stage"), none))
        .unionByName(commands.select("run_id", each({s: contains_any(F.col("text"), list(ws)) for s, ws in COMMAND_STAGES.items()}), none))
    )


def stage_features(marks: DataFrame) -> DataFrame:
    """Per run: numbers of all stages and of those that the verdict does not read, of ground-clearing ones, three flags,
    stages with a time, and seconds from the first to the last of these (two or more). ts is in microseconds."""
    first = marks.groupBy("run_id", "stage").agg(F.min("ts").alias("ts"))
    has = lambda s: F.bool_or(F.col("stage") == s).cast("int").alias(f"stage_has_{s}")
    return first.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_stages_all"),
        F.count_if(~F.col("stage").isin(list(VERDICT_STAGES))).alias("n_stages_clean"),
        F.count_if(F.col("stage").isin(list(COMMAND_STAGES))).alias("stage_ground_clearing"),
        *[has(s) for s in ("enumerate", "wallpaper", "persistence")],
        F.when(F.count("ts") >= 2, F.round((F.max("ts") - F.min("ts")) / 1e6, 2)).alias("stage_span_sec"),
        F.count("ts").alias("stage_timed_count"),
    )


def preparation_counts(lists: DataFrame) -> DataFrame:
    """Per run: executed commands, those of each preparing kind, services and registry keys, of the summary's lists
    (run_id, list, value)."""
    own = lambda name: F.col("list") == name
    command = own("executed_commands")
    return lists.groupBy("run_id").agg(
        F.count_if(command).alias("n_executed_commands"),
        *[F.count_if(command & contains_any(F.col("value"), list(ws))).alias(f"n_{name}") for name, ws in PREPARATION_COMMANDS.items()],
        *[F.count_if(own(name)).alias(f"n_{alias}") for name, alias in (("created_services", "services_created"), ("started_services", "services_started"), ("write_keys", "registry_writes"), ("delete_keys", "registry_deletes"))],
    )


def preparation_timing(processes: DataFrame, destroyed: DataFrame) -> DataFrame:
    """Launches of preparing utilities (run_id, name, ts) against deletes and moves (run_id, ts); ts in microseconds.

    Runs without both have the counts alone. Equal times count as before, and as during."""
    kinds = F.create_map(*[F.lit(x) for pair in PREPARATION_PROCESSES.items() for x in pair])
    prep = processes.withColumn("kind", F.try_element_at(kinds, F.lower("name"))).filter("kind is not null and ts is not null")
    window = destroyed.groupBy("run_id").agg(F.min("ts").alias("d0"), F.max("ts").alias("d1"), F.count("ts").alias("nd"))
    seen = prep.join(window, "run_id", "left")
    at = F.col("ts")
    per = seen.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_prep_processes"),
        F.count_distinct("kind").alias("n_prep_categories"),
        F.first("d0").alias("d0"), F.first("d1").alias("d1"), F.first("nd").alias("nd"),
        F.count_if(at <= F.col("d0")).alias("before"),
        F.count_if(at.between(F.col("d0"), F.col("d1"))).alias("during"),
        F.min(F.when(at <= F.col("d0"), at)).alias("p0"),
        F.min(F.when(at.between(F.col("d0"), F.col("d1")), at)).alias("i0"),
    )
    both = F.col("d0").isNotNull()
    when = lambda c: F.when(both, c)
    return per.select(
        "run_id", "n_prep_processes", "n_prep_categories",
        F.when(both, F.col("before")).otherwise(0).alias("n_prep_before_destroy"),
        when((F.col("before") > 0).cast("int")).alias("prep_precedes_destroy"),
        F.round((F.col("d0") - F.col("p0")) / 1e6, 1).alias("prep_to_first_destroy_sec"),
        when(F.when(F.col("before") > 0, F.col("nd")).otherwise(0)).alias("n_destroy_after_prep"),
        when(F.round(F.when(F.col("nd") > 1, (F.col("d1") - F.col("d0")) / 1e6).otherwise(0.0), 1)).alias("destroy_span_after_prep_sec"),
        when(F.col("during")).alias("n_prep_during_destroy"),
        when(((F.col("during") > 0) | (F.col("before") > 0)).cast("int")).alias("prep_overlaps_destroy"),
        F.round(ratio(F.col("i0") - F.col("d0"), F.col("d1") - F.col("d0")), 3).alias("prep_position_in_destroy"),
    )
