"""Path predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from patchlake import rules


def is_ignored(path: Column) -> Column:
    """Lock files and generated or vendored folders.

    Every pattern begins at the start of a path part; said once, the search
    tries the alternatives there only.
    """
    tails = [p.removeprefix("(^|/)") for p in rules.IGNORED_PATH_PATTERNS]
    return path.rlike("(?i)(?:^|/)(?:" + "|".join(tails) + ")")


def suffix(path: Column) -> Column:
    """Last suffix, lower case; empty for names without one (``.bashrc``, ``a.``)."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)/*\z", 1))


def extension(path: Column) -> Column:
    """Suffix as a category: ``unknown`` without a path, ``no_extension`` without a suffix."""
    found = suffix(path)
    return (
        F.when(path.isNull() | (path == ""), F.lit("unknown"))
        .when(found == "", F.lit("no_extension"))
        .otherwise(found)
    )


def is_source(path: Column, extensions: list[str] | None = None) -> Column:
    return suffix(path).isin(extensions or rules.SOURCE_EXTENSIONS)


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(?s)/tests?/|\Atests?/|\Atest_|_test\.py\z")


def language(path: Column) -> Column:
    """Language of a source file, null if its suffix is not a known one."""
    pairs = [F.lit(x) for item in rules.LANGUAGE_BY_EXTENSION.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def in_ignored_directory(path: Column) -> Column:
    """Any part of the path, folder or file name, is an ignored directory name."""
    names = F.array(*[F.lit(d) for d in rules.IGNORED_DIRECTORIES])
    return F.arrays_overlap(F.split(path, "/"), names)


def module_name(path: Column) -> Column:
    """Dotted module of a file; null where nothing is left of the path."""
    inner = F.regexp_replace(path, r"\A(?:src|lib)(?:/|\z)", "")
    package = r"(?:\A|/)__init__\.py\z"
    inner = F.when(inner.rlike(package), F.regexp_replace(inner, package, "")).otherwise(
        F.regexp_replace(inner, r"\.py\z", "")
    )
    return F.nullif(F.replace(inner, F.lit("/"), F.lit(".")), F.lit(""))
