"""Column expressions over paths, names and call texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {"lua": "lua", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust"}
#: File names in a known language.
GLOB = "*.{" + ",".join(LANGUAGES) + "}"
#: Names that start a program.
ENTRYPOINTS = ("main", "init", "setup", "run", "m.run")

IDENT = "[A-Za-z_][A-Za-z0-9_]*"


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def language(path: Column) -> Column:
    """The language of a file, null for other files."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.regexp_extract(path, r"\.([^./]+)$", 1))


def relative_path(root: str, path: Column) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def module_id(relpath: Column) -> Column:
    return F.translate(F.regexp_replace(relpath, r"\.[^.]+$", ""), "/", ".")


def package_id(relpath: Column) -> Column:
    return F.coalesce(_null_if_empty(F.regexp_extract(relpath, "^([^/]+)/", 1)), F.lit("(root)"))


def is_test(relpath: Column, name: Column) -> Column:
    rel = F.lower(relpath)
    return rel.contains("/test") | rel.contains("spec") | rel.contains("_test.") | F.lower(name).startswith("test")


def is_entrypoint(name: Column) -> Column:
    return F.lower(name).isin(*ENTRYPOINTS)


def starts_with_any(value: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes], F.lit(False))


def ignored(relpath: Column, name: Column, options) -> Column:
    """Whether dead-code search passes a symbol over."""
    out = starts_with_any(relpath, options.ignore_prefixes)
    if options.ignore_tests:
        out = out | is_test(relpath, name)
    if options.ignore_entrypoints:
        out = out | is_entrypoint(name)
    return out


def label(name: Column, relpath: Column) -> Column:
    return F.concat(name, F.lit(" - "), relpath)


def range_label(sr: Column, sc: Column, er: Column, ec: Column) -> Column:
    return F.format_string("%d:%d-%d:%d", sr + 1, sc + 1, er + 1, ec)


def normalize_space(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null if nothing is left."""
    return _null_if_empty(F.trim(F.regexp_replace(text, r"\s+", " ")))


def receiver_tail(receiver: Column) -> Column:
    return _null_if_empty(F.regexp_extract(F.regexp_replace(receiver, r"[:\s]+$", ""), f"({IDENT})$", 1))


def parse_call(text: Column) -> dict[str, Column]:
    """raw, receiver, call_name, kind, receiver_tail of a call's text.

    The text is split at its last ``::``, else its last ``:``, else its last
    ``.``; what follows is cut to its leading identifier if it has one.
    """
    raw = normalize_space(text)
    plain = F.regexp_replace(raw, r"\?\.", ".")
    parts = [("::", r"^(.*)::(.*)$"), (":", r"^(.*):(.*)$"), (".", r"^(.*)\.(.*)$")]
    receiver, name = F.lit(None).cast("string"), plain
    for mark, pattern in reversed(parts):
        receiver = F.when(plain.contains(mark), F.regexp_extract(plain, pattern, 1)).otherwise(receiver)
        name = F.when(plain.contains(mark), F.regexp_extract(plain, pattern, 2)).otherwise(name)
    cut = F.coalesce(_null_if_empty(F.regexp_extract(name, f"^({IDENT})", 1)), name)
    return {"raw": raw, "receiver": receiver, "call_name": cut, "kind": F.when(receiver.isNotNull(), "member").when(raw.isNotNull(), "function"), "receiver_tail": receiver_tail(receiver)}


def names_match(call: Column, definition: Column) -> Column:
    """Equal, or one ends with ``.`` or ``:`` and the other."""
    return normal_names_match(normalize_space(call), normalize_space(definition))


def ends_with_name(name: Column, end: Column) -> Column:
    """Whether ``end`` follows a ``.`` or ``:`` of the name."""
    return name.endswith(F.concat(F.lit("."), end)) | name.endswith(F.concat(F.lit(":"), end))


def normal_names_match(a: Column, b: Column) -> Column:
    """``names_match`` of names whose blanks are normal."""
    return F.coalesce((a == b) | ends_with_name(b, a) | ends_with_name(a, b), F.lit(False))


def suffixes(name: Column) -> Column:
    """What follows each ``.`` or ``:`` of a name."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substr(name, i, F.lit(1)).isin(".", ":"))
    return F.transform(at, lambda i: F.substr(name, i + 1))


def severity(score: Column, thresholds) -> Column:
    critical, high, medium = thresholds
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def fold_path(path: Column) -> Column:
    """``.`` and ``..`` segments folded away."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = (F.lit(".."),)
    out = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when((s == up[0]) & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(out, "/")
