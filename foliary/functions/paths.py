"""Predicates and projections over logical source paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operating-system metadata that is never a source document.
IGNORED_FILES = (".ds_store", ".localized", "desktop.ini", "ehthumbs.db", "icon\r", "thumbs.db")
IGNORED_DIRECTORIES = (
    "$recycle.bin", ".fseventsd", ".spotlight-v100", ".temporaryitems", ".trashes", "__macosx",
    "system volume information",
)
IGNORED_PREFIXES = ("._", "~$", ".~lock.")


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def _fold_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("ſ"), F.lit("s"))


def clean_path(path: Column) -> Column:
    """The path without empty and `.` segments; a leading slash is kept."""
    return F.concat(
        F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(_parts(path), "/")
    )


def file_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_parts(path), F.lit(-1)), F.lit(""))


def extension_of(name: Column) -> Column:
    """Lower-cased last suffix; a leading or trailing dot is not a suffix."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def is_ignored_source_path(path: Column) -> Column:
    """The file, or a directory above it, is operating-system metadata."""
    parts = F.transform(_parts(F.replace(path, F.lit("\\"), F.lit("/"))), _fold_name)
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    ignored = F.exists(directories, lambda d: d.isin(*IGNORED_DIRECTORIES)) | name.isin(*IGNORED_FILES)
    for prefix in IGNORED_PREFIXES:
        ignored = ignored | name.startswith(prefix)
    return F.coalesce(ignored, F.lit(False))


def is_safe_relative_path(path: Column) -> Column:
    """A relative path that cannot leave its root, read as POSIX and as Windows path."""
    bare = F.regexp_replace(path, "^[A-Za-z]:", "")
    return F.coalesce(
        (F.length(path) > 0)
        & ~path.contains("\x00")
        & ~path.startswith("/")
        & ~path.rlike(r"^[A-Za-z]:[\\/]")
        & ~path.rlike(r"^[\\/]{2}[^\\/]+[\\/]+[^\\/]+")
        & ~F.array_contains(F.split(bare, r"[/\\]"), "..")
        & ~path.isin(".", "./"),
        F.lit(False),
    )


def is_safe_index_path(path: Column) -> Column:
    """A relative POSIX path with at least one segment and no parent segment."""
    parts = _parts(path)
    return F.coalesce(
        ~path.startswith("/") & (F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.lit(False)
    )


def path_in_folder(path: Column, folder: Column) -> Column:
    """Strict descendant by whole path segments."""
    base, target = clean_path(folder), clean_path(path)
    return F.when(base == "", F.length(target) > 0).otherwise(target.startswith(F.concat(base, F.lit("/"))))


def source_directory_of(path: Column) -> Column:
    """Parent directory, `.` at the top level."""
    parent = F.regexp_extract(clean_path(path), "(?s)^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("."))).otherwise(parent)


def relative_directory_of(path: Column) -> Column:
    """Parent directory as shown with downloads: empty at the top level."""
    directory = source_directory_of(path)
    return F.when(directory == ".", F.lit("")).otherwise(directory)


def folder_id_of(directory: Column) -> Column:
    """Stable folder id that does not expose the path."""
    return F.concat(F.lit("folder-"), F.substring(F.sha2(directory, 256), 1, 16))


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)
