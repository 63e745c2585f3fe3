"""Path, name and URL functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codelore.functions import fixed


def _case(pairs: list[tuple[Column, object]], otherwise: object) -> Column:
    first, *rest = pairs
    out = F.when(first[0], F.lit(first[1]))
    for condition, value in rest:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), "[.][^.]*$", "")


def extension(path: Column) -> Column:
    """The lower-cased extension without its point; a leading or last point begins none."""
    return F.lower(F.regexp_extract(basename(path), "^.+[.]([^.]+)$", 1))


def language(path: Column) -> Column:
    e = F.concat(F.lit("."), extension(path))
    return _case([(e == x, name) for x, name in fixed.LANGUAGES.items()], "unknown")


def module_of(path: Column) -> Column:
    """The first segment of a path, or two under a source root; '(root)' for files at the top."""
    p = parts(path)
    two = F.lower(F.get(p, F.lit(0))).isin(*fixed.SOURCE_ROOTS) & (F.size(p) > 2)
    return F.when(F.size(p) <= 1, F.lit("(root)")).when(two, F.concat_ws("/", F.slice(p, 1, 2))).otherwise(F.get(p, F.lit(0)))


def role(path: Column) -> Column:
    low = F.lower(path)
    return _case([(low.rlike(pattern), name) for pattern, name in fixed.ROLES], "implementation")


def prior(path: Column) -> Column:
    """The least prior of the matching path rules: tests, documentation and tools rank lower."""
    low = F.lower(path)
    return F.least(*[_case([(low.rlike(pattern), value)], 1.0) for pattern, value in fixed.PRIORS])


def entry_label(path: Column) -> Column:
    return _case([(path.rlike(pattern), label) for pattern, label in fixed.ENTRIES], fixed.NO_ENTRY)


def entry_grade(path: Column) -> Column:
    """The place of the first entry pattern that matches; null if none does."""
    return _case([(path.rlike(pattern), i) for i, (pattern, _) in enumerate(fixed.ENTRIES)], None)


def complexity_band(lines: Column, symbols: Column) -> Column:
    return _case([((lines > most) | (symbols > many), band) for band, most, many in fixed.BANDS], "low")


def collection_name(name: Column) -> Column:
    """Legal names pass; others become a slug of at most 40 characters and eight digest digits."""
    name = F.regexp_replace(name, r"^\s+|\s+$", "")
    legal = name.rlike("^[a-zA-Z0-9][a-zA-Z0-9._-]{1,61}[a-zA-Z0-9]$") & ~name.contains("..") & ~name.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$")
    slug = F.substring(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9._-]", "-"), "^[._-]+|[._-]+$", ""), 1, 40)
    return F.when(legal, name).otherwise(F.concat(F.lit("repo-"), F.when(slug == "", "repo").otherwise(slug), F.lit("-"), F.substring(F.sha1(name), 1, 8)))


#: https on the code host, two plain segments; no port, credentials, query or fragment.
REPOSITORY_URL = r"^(?i:https://(?:www\.)?github\.com)/+([A-Za-z0-9_][A-Za-z0-9._-]*)/+([A-Za-z0-9_][A-Za-z0-9._-]*?)(?:\.git)?/*[?]?#?$"


def valid_repository_url(url: Column) -> Column:
    return F.trim(url).rlike(REPOSITORY_URL)


def repository_name(url: Column) -> Column:
    """The repository's name in a valid URL, without ``.git``; empty for other URLs."""
    return F.regexp_extract(F.trim(url), REPOSITORY_URL, 2)
