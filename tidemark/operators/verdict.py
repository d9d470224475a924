"""Damage to decoys, renames, notes, and the cascade that turns evidence into a verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.paths import collapsed, contains_any, dotted_suffix, extension
from tidemark.operators.events import target_flags


#: Folders with decoys, and fragments of paths in them that are none.
VICTIM_DIRS = ("\\Users\\admin\\Desktop", "\\Users\\admin\\Documents", "\\Users\\admin\\Downloads")
DECOY_NOISE = (
    "\\appdata\\", "desktop.ini", "thumbs.db", "\\.ssh\\", "\\searches\\", "\\contacts\\", "\\favorites\\", "\\links\\",
    "ntuser.dat", "\\microsoft\\",
)
#: Words in names of notes, words that say it outright, extensions that are no note's, and extensions that
#: ordinary software renames onto.
NOTE_WORDS = (
    "readme", "read_me", "read-me", "read me", "recover", "restore", "decrypt", "unlock", "ransom", "instruction", "how_to",
    "howto", "how-to", "how to", "help_", "_info", "-info", "files_back", "your_files", "important", "attention", "warning",
)
NOTE_EXPLICIT = ("decrypt", "recover", "restore", "unlock", "ransom", "howto", "filesback", "yourfiles", "getback", "readmeplease")
NOT_NOTES = (
    "exe", "dll", "sys", "drv", "ocx", "cpl", "scr", "com", "msi", "cab", "tmp", "log", "dat", "db", "sqlite", "etl", "evtx",
    "pf", "mui", "lnk", "url", "ico", "cur", "ani", "theme", "deskthemepack",
)
BENIGN_TARGETS = ("tmp", "bak", "old", "log", "part", "partial", "download", "crdownload", "swp", "orig", "sav", "~")


def is_decoy(path: Column, folders: Sequence[str] = VICTIM_DIRS, noise: Sequence[str] = DECOY_NOISE) -> Column:
    """Whether a path lies in a decoy folder and is not one of its other files."""
    return contains_any(path, list(folders)) & ~contains_any(path, list(noise))


def decoy_damage(log: DataFrame) -> DataFrame:
    """Targets that a run created itself (written, never read), destroyed (removed and not its own, or rewritten after
    being read), or only read. `log` holds the events on decoys (`is_decoy`)."""
    r, w, x = F.col("r"), F.col("w"), F.col("x")
    destroyed = (x & ~(w & ~r)) | (w & r)
    return target_flags(log).groupBy("run_id").agg(F.count_if(destroyed).alias("destroyed_decoys"), F.count_if(w & ~r).alias("self_created"), F.count_if(r & ~destroyed).alias("read_only_decoys"))


def execution(log: DataFrame, executed: int = 500, covered: int = 100) -> DataFrame:
    """Numbers of calls and of destructive events, and whether the run executed and is covered."""
    n = F.count(F.lit(1))
    return log.groupBy("run_id").agg(n.alias("total_calls"), F.count_if(F.col("kind").isin("delete", "move")).alias("destructive_events"), (n >= executed).alias("executed"), (n >= covered).alias("covered"))


def decoy_diagnosis(log: DataFrame, path: Column, allowed: Sequence[str], folders: Sequence[str] = VICTIM_DIRS, noise: Sequence[str] = DECOY_NOISE) -> DataFrame:
    """Per run: distinct paths in decoy folders that were written, deleted or moved, under two filters side by side: all
    but the noise, and of these only those with an allowed extension."""
    low = F.lower(path)
    inside = contains_any(path, list(folders)) & log["kind"].isin("write", "delete", "move")
    kept = inside & ~contains_any(path, list(noise))
    listed = kept & extension(path).isin(list(allowed))
    one = lambda c: F.count_distinct(F.when(c, low))
    return log.groupBy("run_id").agg(one(inside).alias("in_folders"), one(kept).alias("without_noise"), one(listed).alias("allowed_only"))


def append_renames(moves: DataFrame, written: DataFrame, deleted: DataFrame) -> DataFrame:
    """Renames (run_id, source, target) whose target extends the source, and written paths that extend a deleted path of
    their directory (run_id, dir, path in both); number and distinct suffixes. Of several deleted paths the least counts.
    A written path meets deleted ones through its own prefixes, not by comparing all paths of a directory."""
    direct = moves.filter(F.startswith("target", "source") & (F.col("target") != F.col("source"))).select("run_id", F.substring("target", F.length("source") + 1, F.length("target")).alias("suffix"), F.col("target").alias("path"))
    prefixes = written.distinct().withColumn("gone", F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring(F.col("path"), F.lit(1), n)))).filter(F.length("path") > 0)
    pairs = prefixes.join(deleted.select("run_id", "dir", F.col("path").alias("gone")).distinct(), ["run_id", "dir", "gone"])
    indirect = pairs.groupBy("run_id", "path").agg(F.min("gone").alias("gone")).select("run_id", F.substring("path", F.length("gone") + 1, F.length("path")).alias("suffix"), "path")
    return direct.unionByName(indirect).groupBy("run_id").agg(F.count(F.lit(1)).alias("append_renames"), F.count_distinct("suffix").alias("distinct_suffixes"))


def shared_extension(moves: DataFrame, benign: Sequence[str] = BENIGN_TARGETS) -> DataFrame:
    """The new suffix that most renames (run_id, pos, source, target) share: not one that is appended, numeric, unchanged
    or benign (names without their leading dots). Of suffixes with equal counts the first seen wins."""
    new = dotted_suffix(F.col("target"))
    bare = F.regexp_replace("ext", r"^\.+", "")
    fresh = moves.filter(~F.startswith("target", "source")).withColumn("ext", new).filter((F.col("ext") != "") & (F.col("ext") != dotted_suffix(F.col("source"))) & ~bare.rlike("^[0-9]+$") & ~bare.isin(list(benign)))
    counts = fresh.groupBy("run_id", "ext").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = F.max_by("ext", F.struct("n", -F.col("first")))
    return counts.groupBy("run_id").agg(F.max("n").alias("shared_extension_renames"), F.substring(best, 1, 40).alias("shared_extension"))


def note_spread(files: DataFrame, words: Sequence[str] = NOTE_WORDS, explicit: Sequence[str] = NOTE_EXPLICIT, never: Sequence[str] = NOT_NOTES) -> DataFrame:
    """The file name that looks like a note and lies in most directories, of the paths (run_id, path) that a run wrote or
    moved something to.

    Names and directories are compared in lower case, and names and words without separators. Paths without a directory
    and names with an extension that is no note's do not count. Names with an explicit word come first, and of equals the
    least. note_explicit: whether there is such a name."""
    low = F.lower(F.replace("path", F.lit("/"), F.lit("\\")))
    named = files.withColumn("_p", low).filter(F.instr("_p", "\\") > 0).withColumn("name", F.substring_index("_p", "\\", -1)).withColumn("dir", F.substring(F.col("_p"), F.lit(1), F.length("_p") - F.length("name") - 1))
    flat = collapsed(F.col("name"))
    bare = [w.lower().translate(str.maketrans("", "", " _-.!")) for w in words]
    plain = [w.lower().translate(str.maketrans("", "", " _-.!")) for w in explicit]
    has: Column = F.exists(F.array(*[F.lit(w) for w in bare]), lambda w: F.contains(flat, w))
    said = F.exists(F.array(*[F.lit(w) for w in plain]), lambda w: F.contains(flat, w))
    per = named.filter(~extension(F.col("name")).isin(list(never)) & has).groupBy("run_id", "name").agg(F.count_distinct("dir").alias("dirs"), F.bool_or(said).alias("explicit"))
    top = F.struct(F.col("explicit"), F.col("dirs"), F.concat(F.transform(F.split("name", ""), lambda c: -F.ascii(c)), F.array(F.lit(1))), F.col("name"))
    return per.groupBy("run_id").agg(F.max(top).alias("top"), F.count(F.lit(1)).alias("candidates")).select("run_id", F.col("top.dirs").alias("note_dirs"), F.substring("top.name", 1, 60).alias("note_name"), F.col("top.explicit").alias("note_explicit"), "candidates")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the cascade."""

    destroyed: int = 3
    appends: int = 8
    diversity: float = 0.3
    shared: int = 50
    axes: int = 2
    events_an_axis: int = 1
    note_dirs: int = 2
    executed: int = 500


def verdicts(evidence: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Adds axes, verdict and reason to rows with destroyed_decoys, read_only_decoys, append_renames, distinct_suffixes,
    shared_extension_renames, note_dirs, note_explicit, total_calls.

    There are four axes: decoys, appended names, shared extensions, notes. A note that states its purpose is enough by
    itself. Evidence is looked at before execution: a short run can still be true."""
    at = limits or Limits()
    least = at.events_an_axis
    diversity = F.col("distinct_suffixes") / F.greatest(F.lit(1), F.col("append_renames"))
    reached = [F.col("destroyed_decoys") >= least, F.col("append_renames") >= least, F.col("note_dirs") >= 1, F.col("shared_extension_renames") >= least]
    axes = sum((F.coalesce(c, F.lit(False)).cast("int") for c in reached), F.lit(0))
    rules = [
        (F.col("destroyed_decoys") >= at.destroyed, "TRUE_ENCRYPTION", "decoys destroyed"),
        ((F.col("append_renames") >= at.appends) & (diversity <= at.diversity), "TRUE_ENCRYPTION", "appended few suffixes to many files"),
        (F.col("shared_extension_renames") >= at.shared, "TRUE_ENCRYPTION", "renamed many files to one new extension"),
        (F.col("axes") >= at.axes, "TRUE_ENCRYPTION", "several kinds of evidence"),
        (F.col("note_explicit") | (F.col("note_dirs") >= at.note_dirs), "TRUE_ENCRYPTION", "a note"),
        (F.col("total_calls") < at.executed, "FAILED", "did not execute"),
        (F.col("destroyed_decoys") > 0, "WEAK_VICTIM_ACTIVITY", "few decoys destroyed"),
        (F.col("read_only_decoys") > 0, "NO_VICTIM_ACTIVITY", "decoys read, none destroyed"),
    ]
    verdict, reason = F, F
    for when, name, why in rules:
        verdict, reason = verdict.when(when, name), reason.when(when, why)
    return evidence.withColumn("axes", axes).withColumns({"verdict": verdict.otherwise("NO_VICTIM_ACTIVITY"), "reason": reason.otherwise("decoys never touched")})


def survey(per_run: DataFrame, flags: list[str], verdict: str = "verdict") -> DataFrame:
    """Share of the runs of each verdict that show each flag at all."""
    return per_run.groupBy(verdict).agg(F.count(F.lit(1)).alias("runs"), *[F.avg((F.col(c) > 0).cast("double")).alias(f"share_{c}") for c in flags])
