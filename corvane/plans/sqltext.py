"""The text analysis of functions/text.py in SQL, for an independent engine that checks results."""

from __future__ import annotations

from corvane.functions.text import fold_tables


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fold(column: str) -> str:
    one, to, several = fold_tables()
    keys = "[" + ",".join(quoted(c) for c in several) + "]"
    values = "[" + ",".join(quoted(v) for v in several.values()) + "]"
    marks = quoted("".join(several))
    wide = (
        f"CASE WHEN translate({column}, {marks}, '') <> {column} THEN array_to_string(list_transform("
        f"regexp_extract_all({column}, '(?s).'), lambda c: coalesce({values}[list_position({keys}, c)], c)), '') ELSE {column} END"
    )
    return f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x7F]') THEN translate({wide}, {quoted(one)}, {quoted(to)}) ELSE {column} END"


def sql_tokens(column: str, lowercase: bool = True, min_length: int = 1) -> str:
    clean = f"translate({sql_fold(column)}, {quoted(chr(39) + '’`')}, '')"
    found = f"regexp_extract_all(lower({clean}), '[a-z0-9]+')" if lowercase else f"regexp_extract_all({clean}, '[A-Za-z0-9]+')"
    if min_length > 1:
        found = f"list_filter({found}, lambda t: length(t) >= {min_length})"
    return f"coalesce({found}, [])"
