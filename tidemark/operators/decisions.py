"""Cascades and look-ups that turn columns into decisions, checks of decisions against labels, and manifest steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.safe import ratio
from tidemark.operators.tables import attach, best_of

#: Largest file, and flags and the native subsystem in a program's header.
LARGEST, DLL, SYSTEM, NATIVE = 50 * 1024 * 1024, 0x2000, 0x1000, 1
#: Libraries and the strings that give them away.
FINGERPRINTS = {
    "cryptopp": ["cryptopp", "CryptoPP", "rijndael_simd", "Crypto++"],
    "openssl": ["OpenSSL", "libcrypto", "SSLeay"],
    "mbedtls": ["mbedtls", "mbed TLS"],
    "libsodium": ["libsodium", "sodium_"],
    "wolfssl": ["wolfSSL", "wolfssl"],
    "boost": ["boost"],
}
#: Names of installers, of other files beside them, and of those for other machines; sizes of one.
INSTALLER, NO_INSTALLER = r"(?i)\.(exe|msi)$", r"(?i)(symbols|pdb|debug|portable|\.zip\.exe$|sha256|\.sig$|blockmap|\.asc$|checksum)"
WRONG_MACHINE = r"(?i)(arm64|aarch64|_arm\b|-arm\b|\.arm\.|linux|darwin|macos|osx|\.dmg|\.deb|\.rpm)"
SMALLEST_ASSET = 100_000
#: What each constructed variant does to the files that were there.
INTENTS = {
    "m2_copydel": "destroys", "m2_nocrypt": "destroys", "m4_manytoone": "destroys", "m6_crypto": "destroys", "m7_wipe": "destroys",
    "m9_move": "destroys", "r1_replace_name": "destroys", "r1_rename_only": "destroys", "m3_rename": "destroys", "b1_batch": "destroys",
    "t0_burst": "destroys", "t1_spread": "destroys", "t2_batch": "destroys", "s1_decoys": "destroys", "s2_progfiles": "destroys",
    "s3_walkroot": "destroys", "f0_all": "destroys", "f1_documents": "destroys", "f2_media": "destroys", "f3_executable": "destroys",
    "v010": "destroys", "v050": "destroys", "v100": "destroys", "v200": "destroys", "v999": "destroys", "g0100": "destroys",
    "g0500": "destroys", "g1500": "destroys", "x_full": "destroys", "stage3": "destroys", "stage4": "destroys", "stage5": "destroys",
    "stage6": "destroys", "stage7": "destroys", "tool_7z_delete": "destroys", "tool_7z_perfile": "destroys",
    "tool_robocopy_mv": "destroys", "tool_shell_rename": "destroys", "tool_backup": "destroys", "stage2": "ambiguous",
    "m1_inplace": "ambiguous", "tool_certutil": "ambiguous", "tool_cipher": "invisible", "tool_compact": "invisible",
    "stage1": "harmless", "m5_drop": "harmless", "m8_keep": "harmless", "w_progfiles_read": "harmless", "e1_note_only": "harmless",
    "e2_wallpaper_only": "harmless", "e4_shadow_only": "harmless", "e28_prep_only": "harmless", "tool_7z_keep": "harmless",
    "tool_ps_zip": "harmless", "tool_robocopy_cp": "harmless", "tool_xcopy": "harmless", "tool_findstr": "harmless",
    "tool_defender": "harmless", "tool_attrib": "harmless", "tool_acl": "harmless", "tool_taskkill": "harmless",
    "tool_chrome": "harmless", "tool_apps": "harmless", "tool_open_docs": "harmless", "tool_acrobat": "harmless",
    "tool_media": "harmless", "tool_session": "harmless", "tool_ie_wmp": "harmless",
}
#: Calls from which a run is usable.
USABLE = 100


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def header_decision(size: Column, parses: Column, characteristics: Column, subsystem: Column, entry_point: Column, largest: int = LARGEST) -> tuple[Column, Column]:
    """Decision (SUBMIT or SKIP) and reason from the header of a program; the first rule that applies counts. A size that is
    not known cannot be read."""
    rules = [
        (size.isNull(), "STAT_ERROR"),
        (size == 0, "EMPTY_FILE"),
        (size > largest, "OVERSIZE"),
        (~F.coalesce(parses, F.lit(False)), "NOT_PE"),
        (characteristics.bitwiseAND(F.lit(DLL)) != 0, "DLL"),
        ((subsystem == NATIVE) | (characteristics.bitwiseAND(F.lit(SYSTEM)) != 0), "DRIVER_OR_NATIVE"),
        (entry_point == 0, "NO_ENTRY_POINT"),
    ]
    reason = F
    for when, why in rules:
        reason = reason.when(when, why)
    reason = reason.otherwise("OK")
    return F.when(reason == "OK", "SUBMIT").otherwise("SKIP"), reason


def best_asset(assets: DataFrame, repo: str, name: str, size: str, largest_mb: float, ordinal: str) -> DataFrame:
    """Of each repository the largest asset that is an installer for the machine and within the sizes; of equals the first."""
    n, s = F.col(name), F.col(size)
    fit = assets.filter(n.rlike(INSTALLER) & ~n.rlike(NO_INSTALLER) & ~n.rlike(WRONG_MACHINE) & s.between(SMALLEST_ASSET, largest_mb * 1e6))
    return best_of(fit, F.col(repo).cast("string"), [F.desc(size)], ordinal)


def keyword_counts(text: Column, categories: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """For each category, how many of its distinct keywords occur in the text, in either case."""
    low = F.lower(text)
    count = lambda words: F.size(F.filter(F.array(*[F.lit(w.lower()) for w in dict.fromkeys(words)]), lambda w: F.contains(low, w))).cast("long")
    return {c: F.coalesce(count(words), F.lit(0)) for c, words in categories.items()}


def fingerprints(text: Column, known: Mapping[str, Sequence[str]] = FINGERPRINTS) -> Column:
    """The libraries whose strings occur in a text, sorted and joined by semicolons; an empty string for none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(F.exists(F.array(*[F.lit(s.lower()) for s in strings]), lambda s: F.contains(low, s)), F.lit(lib)) for lib, strings in known.items()]
    return F.array_join(F.sort_array(F.array_compact(F.array(*hits))), ";")


def readable(imports: Column, least: int = 20) -> Column:
    """Whether an import table is long enough to say anything; NULL where there is none."""
    return imports >= least


def label_check(rows: DataFrame, label: str, flagged: Column, confirmed: Sequence[str] = ("A", "A2"), excluded: Sequence[str] = ("F",)) -> DataFrame:
    """Verdicts against labels given by hand, without excluded ones: confirmed rows, those detected and missed, other rows
    and those flagged; `passes`: nothing missed, nothing flagged."""
    own, hit = F.col(label).isin(list(confirmed)), F.coalesce(flagged, F.lit(False))
    sums = rows.filter(F.col(label).isNotNull() & ~F.col(label).isin(list(excluded))).agg(F.count_if(own).alias("confirmed"), F.count_if(own & hit).alias("detected"), F.count_if(own & ~hit).alias("missed"), F.count_if(~own).alias("negatives"), F.count_if(~own & hit).alias("flagged"))
    return sums.withColumn("passes", (F.col("missed") == 0) & (F.col("flagged") == 0))


#: How a verdict and the pictures agree.
AGREE, CHANGED_ALONE, VERDICT_ALONE = "agree", "REVIEW: screen changed but verdict says no encryption", "REVIEW: verdict says encryption but screen unchanged"


def agreement_class(verdict: Column, change: Column, positive: str = "TRUE_ENCRYPTION") -> Column:
    """How a verdict and what the pictures show agree; an empty string where either is unknown."""
    unknown = verdict.isNull() | (verdict == "") | change.isNull() | change.isin("unknown", "unreadable")
    claims, changed = verdict == positive, change == "yes"
    return F.when(unknown, "").when(claims == changed, AGREE).when(changed, CHANGED_ALONE).otherwise(VERDICT_ALONE)


def intents(rows: DataFrame, names: DataFrame, run: str = "sample_id", prefix: str = "H", known: Mapping[str, str] = INTENTS) -> DataFrame:
    """`rows` with `variant`, by a table of task_id and variant (with or without .exe), and its `intent`; unclassified where
    either is unknown. Of several variants of a task the least counts. The look-up table is of fixed size."""
    plain = names.groupBy(F.concat(F.lit(prefix), F.col("task_id").cast("string")).alias(run)).agg(F.min(F.regexp_replace("variant", r"\.exe", "")).alias("variant"))
    found = rows.join(plain, run, "left")
    return found.withColumn("intent", F.coalesce(F.try_element_at(_map(known), F.col("variant")), F.lit("unclassified")))


def failures(rows: DataFrame, rate: str, flag_at: float) -> DataFrame:
    """Of rows with an intent: their number, and those flagged in a share `flag_at` of the folds or more, by intent."""
    return rows.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(rate) >= flag_at).alias("flagged"))


def retry_decision(outcome: Column, out_of_memory: Column, calls: Column, agent_died: Column, usable: int = USABLE) -> tuple[Column, Column]:
    """Whether to run again, and why. A dead agent outranks the number of calls; only without usable calls does the cause
    matter."""
    rules = [
        (agent_died, "RETRY", "agent dead"),
        (calls >= usable, "NO_RETRY", "observed, the sample was quiet"),
        (out_of_memory, "RETRY", "host out of memory"),
        (outcome == "sample_launch_failed", "NO_RETRY", "could not be launched"),
        (outcome == "no_log", "RETRY", "analyzer never started"),
        (outcome == "truncated", "RETRY", "log stops mid-run"),
    ]
    decision, reason = F, F
    for when, what, why in rules:
        decision, reason = decision.when(F.coalesce(when, F.lit(False)), what), reason.when(F.coalesce(when, F.lit(False)), why)
    return decision.otherwise("NO_RETRY"), reason.otherwise("finished, recorded nothing")


def screenshot_decision(shots: Column) -> Column:
    """The simpler rule, to compare with."""
    return F.when(shots == 0, "RETRY").otherwise("NO_RETRY")


def kill_effect(runs: DataFrame, feature: str, positive: str = "TRUE_ENCRYPTION") -> DataFrame:
    """Per family of fully covered runs (sample_id, family, verdict, coverage, agent_died, hit_timeout): runs with the
    feature, how many of these were cut short, used the whole window and are positive, and the same rate of all its runs;
    `share` is the family's among all runs with the feature, which tells whether one family is responsible."""
    has, yes = F.coalesce(F.col(feature) > 0, F.lit(False)), F.col("verdict") == positive
    per = runs.filter("coverage = 'full'").groupBy(F.coalesce(F.nullif("family", F.lit("")), F.lit("(unattributed)")).alias("family")).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(yes).alias("positive"), F.count_if(has).alias("with_feature"), F.count_if(has & yes).alias("with_feature_positive"),
        F.count_if(has & F.col("agent_died")).alias("cut_short"), F.count_if(has & F.col("hit_timeout")).alias("whole_window"),
    )
    total = per.agg(F.sum("with_feature").alias("_all"))
    return per.crossJoin(total).withColumns({"rate": ratio(F.col("positive"), F.col("runs")), "rate_with_feature": ratio(F.col("with_feature_positive"), F.col("with_feature")), "share": ratio(F.col("with_feature"), F.col("_all"))}).drop("_all")  # one row


def volume_side(volume: Column, cut: float) -> Column:
    """train under the cut, measure from it on; NULL without a volume."""
    return F.when(volume < cut, "train").when(volume >= cut, "measure")


def in_band(volume: Column, low: float, high: float) -> Column:
    return (volume >= low) & (volume < high)


def two_stage_gate(rows: DataFrame, gate: Column, y: str) -> DataFrame:
    """What a first stage lets through: rows, rows passed, positives, and positives that it loses for good."""
    ok, yes = F.coalesce(gate, F.lit(False)), F.col(y) == 1
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), F.count_if(yes).alias("positives"), F.count_if(yes & ~ok).alias("lost"))


def added(manifest: DataFrame, new: DataFrame, key: str = "sha") -> DataFrame:
    """The manifest with rows of `new` whose key it lacks, as pending; of several with one key one is added."""
    fresh = new.dropDuplicates([key]).join(manifest.select(key), key, "left_anti")
    return manifest.unionByName(fresh.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def marked_submitted(manifest: DataFrame, tasks: DataFrame, key: str = "sha", run: str = "run_id") -> DataFrame:
    """Rows that `tasks` (key, run) names become submitted under that run."""
    own = tasks.groupBy(key).agg(F.max(run).alias("_run"))
    found = attach(manifest, own, key)
    return found.withColumns({"status": F.when(F.col("matched"), "submitted").otherwise(F.col("status")), run: F.when(F.col("matched"), F.col("_run")).otherwise(F.col(run))}).drop("_run", "matched")


def marked_result(manifest: DataFrame, results: DataFrame, key: str = "sha") -> DataFrame:
    """Rows that `results` (key, result) names become analyzed with that result."""
    own = results.groupBy(key).agg(F.max("result").alias("_result"))
    found = attach(manifest, own, key)
    old = F.col("result") if "result" in manifest.columns else F.lit(None).cast("string")
    return found.withColumns({"result": F.when(F.col("matched"), F.col("_result")).otherwise(old), "status": F.when(F.col("matched"), "analyzed").otherwise(F.col("status"))}).drop("_result", "matched")


def reset(manifest: DataFrame, stuck: DataFrame, run: str = "run_id", only: str = "submitted") -> DataFrame:
    """Rows in state `only` whose run is in `stuck` go back to pending, without a run."""
    found = attach(manifest, stuck.select(run).distinct(), run)
    hit = F.col("matched") & (F.col("status") == only)
    return found.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), run: F.when(hit, "").otherwise(F.col(run))}).drop("matched")


def manifest_of(listing: DataFrame, present: DataFrame, source: str, added_date: Column, ordinal: str = "ordinal") -> DataFrame:
    """A listing (ordinal, sha256, path, machine, subsystem, is_dll) as manifest rows: blank hashes and those that are not
    `present` (sha256) left out, and of each hash the first."""
    sha = F.trim("sha256")
    fit = listing.withColumn("sha256", sha).filter("sha256 <> ''").join(present.select("sha256").distinct(), "sha256", "left_semi")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    first = best_of(fit, F.col("sha256"), [F.col(ordinal)], ordinal)
    blank = F.lit("")
    return first.select(
        "sha256", F.regexp_extract("path", r"([^/]*)$", 1).alias("original_filename"), blank.alias("family"), F.lit(source).alias("source"), F.lit("benign").alias("label"), added_date.alias("added_date"),
        F.lit("pending").alias("status"), blank.alias("cape_task_id"), blank.alias("result"), F.concat(F.lit("arch="), text("machine"), F.lit(";subsystem="), text("subsystem"), F.lit(";is_dll="), text("is_dll")).alias("notes"),
    )


def stable_columns(tables: Sequence[DataFrame], first: Sequence[str]) -> list[str]:
    """The columns of several tables: the given ones, then all others in the order in which they are first seen."""
    return list(dict.fromkeys([*first, *(c for t in tables for c in t.columns)]))


def stable_union(tables: Sequence[DataFrame], first: Sequence[str]) -> DataFrame:
    """All rows with all columns in their stable order; what a table lacks is NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    names = stable_columns(tables, first)
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in names])


def natural_order(name: Column) -> list[Column]:
    """Sort keys of file names: those that are whole numbers first, by value, then the others as text."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    number = F.when(stem.rlike("^[0-9]+$"), stem.try_cast("decimal(38,0)"))
    return [number.isNull(), number.asc_nulls_last(), stem]


def pictures(files: DataFrame, path: str = "path") -> DataFrame:
    """Picture files of each folder with their place, in natural order: run (the folder's parent or the folder), shot."""
    from pyspark.sql import Window

    name = F.substring_index(F.col(path), "/", -1)
    kept = files.filter(F.lower(name).rlike(r"\.(png|jpg|jpeg|bmp)$")).withColumn("run", F.substring(F.col(path), F.lit(1), F.length(path) - F.length(name) - 1))
    return kept.withColumn("shot", F.row_number().over(Window.partitionBy("run").orderBy(*natural_order(name), path)))
