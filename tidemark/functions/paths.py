"""Path and name functions. Definitions of an extension differ on purpose and keep separate names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Group of each extension; anything else is in group other.
EXTENSION_GROUPS = {
    "document": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf", "rtf", "odt", "ods", "txt", "csv", "xml", "json", "md"],
    "media": ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "svg", "mp3", "mp4", "avi", "mkv", "mov", "wav", "webm", "webp"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "bz2", "iso", "cab"],
    "database": ["db", "sql", "mdb", "accdb", "sqlite", "bak", "dbf"],
    "code": ["c", "cpp", "h", "py", "java", "js", "cs", "php", "rb", "go"],
    "executable": ["exe", "dll", "sys", "drv", "ocx", "cpl", "scr", "msi", "com", "bat", "cmd", "ps1", "efi"],
}


def event_path(file: Column, source: Column) -> Column:
    """The file of an event, or else where it was moved from."""
    return F.coalesce(F.nullif(file, F.lit("")), F.nullif(source, F.lit("")))


def extension_or_none(path: Column) -> Column:
    """After the last dot of the last backslash component, lower case; (none) without a dot."""
    name = F.substring_index(path, "\\", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("(none)")


def extension(path: Column) -> Column:
    """As above, but slashes count as backslashes, and nothing gives an empty string."""
    name = F.substring_index(F.replace(path, F.lit("/"), F.lit("\\")), "\\", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def dotted_suffix(path: Column) -> Column:
    """From the first dot of the name on, lower case; an empty string without one."""
    name = F.substring_index(F.replace(path, F.lit("/"), F.lit("\\")), "\\", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring(name, F.instr(name, "."), F.length(name)))).otherwise("")


def directory(path: Column) -> Column:
    """Before the last backslash; an empty string where none comes after the first character."""
    p = F.replace(path, F.lit("/"), F.lit("\\"))
    cut = F.length(p) - F.length(F.substring_index(p, "\\", -1)) - 1
    return F.when(cut > 0, F.substring(p, F.lit(1), cut)).otherwise("")


def stem(path: Column) -> Column:
    """Without the last extension, if its dot follows the last backslash."""
    name = F.substring_index(path, "\\", -1)
    tail = F.length(F.substring_index(name, ".", -1)) + 1
    return F.when(F.instr(name, ".") > 0, F.substring(path, F.lit(1), F.length(path) - tail)).otherwise(path)


def base_stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def extension_group(ext: Column) -> Column:
    """Group of an extension (lower case, without its dot), from a literal map."""
    pairs = [x for g, es in EXTENSION_GROUPS.items() for e in es for x in (F.lit(e), F.lit(g))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("other"))


def collapsed(name: Column) -> Column:
    """Lower case without separators."""
    return F.translate(F.lower(name), " _-.!", "")


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """A name's canonical form: trimmed, and mapped if its lower case is an alias."""
    t = F.trim(name)
    pairs = [x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(t)), t)


def variant_kind(base: Column) -> Column:
    """First three underscore tokens of a name that are not a limit or repetition mark (l or r and digits)."""
    return F.array_join(F.slice(F.filter(F.split(base, "_"), lambda t: (t != "") & ~t.rlike("^[lr][0-9]+$")), 1, 3), "_")


def source_of(run_id: Column, prefixes: dict[str, str], default: str) -> Column:
    """Source of a run by the prefix of its id; the first prefix that fits counts."""
    out = F.lit(default)
    for prefix, source in reversed(prefixes.items()):
        out = F.when(F.startswith(run_id, F.lit(prefix)), source).otherwise(out)
    return out


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any word occurs in the text, in either case."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))
