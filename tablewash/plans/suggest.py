"""Choosing steps from a profile and a sentence of hints per column.

The rules read a handful of facts about each column on the driver; the facts come from, and the
steps become, Spark jobs over the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tablewash.functions.text import BOOLEAN_MAP
from tablewash.functions.typing import column_types, string_columns
from tablewash.operators.detect import detect_sequential
from tablewash.operators.profile import overview
from tablewash.plans.steps import Step, run_steps
from tablewash.session import materialize
from tablewash.sources.tables import TableSet

# The words in a hint that call for a step, and those that rule one out.
HANDS_OFF = ("no cleaning", "no action")
NO_CONVERSION = (*HANDS_OFF, "no conversion", "no type conversion")
IDENTIFIER = ("identifier", " id", "id ")
MIXED_FORMAT = ("mixed", "expected pattern", "standardize")
CURRENCY = ("'$'", '"$"', "currency", "usd")
NUMBER = ("numeric", "float", "price", "amount", "usd", "$")
SEQUENCE = ("sequential", "sequence")
NAMED = ("identifier", "name", "id")
FORWARD = ("forward fill", "forward-fill", "ffill")
AVERAGE = ("mean", "average")
MOST_FREQUENT = ("mode", "category", "categorical")
YEAR_TYPO = ("2033", "2023")
QUOTED_CONSTANT = r"constant\s+['\"]([^'\"]+)['\"]"


def _any(text: str, words: Sequence[str]) -> bool:
    return any(w in text for w in words)


def fill_choice(hint: str, kind: str, looks_sequential: bool) -> tuple[str, str | None]:
    """The fill method for a column, and the constant if it is one."""
    quoted = re.search(QUOTED_CONSTANT, hint, re.IGNORECASE)
    hint = hint.lower()
    identifier = kind == "string" and _any(hint, NAMED) and not _any(hint, HANDS_OFF)
    dated = kind in ("string", "datetime") and "date" in hint and _any(hint, ("missing", "null"))
    choices = (
        (_any(hint, SEQUENCE), ("sequential", None)),
        (identifier and looks_sequential, ("sequential", None)),
        (identifier, ("constant", "Unknown")),
        (quoted is not None, ("constant", quoted and quoted.group(1))),
        (_any(hint, ("constant", "'unknown'", '"unknown"')), ("constant", "Unknown")),
        (_any(hint, FORWARD) or dated, ("forward_fill", None)),
        (_any(hint, AVERAGE), ("mean", None)),
        (_any(hint, MOST_FREQUENT), ("mode", None)),
    )
    return next((choice for fits, choice in choices if fits), ("median", None))


def preparing_steps(kinds: Mapping[str, str], duplicates: int, hints: Mapping[str, str]) -> list[Step]:
    """What has to happen before missing cells can be filled: duplicates, whitespace, identifier
    formats, stray characters and types, in this order."""
    text = {c: hints.get(c, "").lower() for c, kind in kinds.items() if kind == "string"}
    steps = [Step("drop_duplicates")] if duplicates else []
    steps += [Step("strip_whitespace", c) for c, h in text.items() if "whitespace" in h]
    steps += [
        Step("standardize_format", c) for c, h in text.items()
        if _any(h, IDENTIFIER) and _any(h, MIXED_FORMAT) and not _any(h, HANDS_OFF)
    ]
    for c, h in text.items():
        if _any(h, CURRENCY) and "$" in h and (_any(h, ("'$'", '"$"')) or "string" in h):
            steps += [Step("replace_substring", c, old_value=old, new_value="") for old in ("$", ",")]
        elif all(year in h for year in YEAR_TYPO):
            steps.append(Step("replace_substring", c, old_value=YEAR_TYPO[0], new_value=YEAR_TYPO[1]))
    for c, h in text.items():
        if "datetime" in h and not _any(h, NO_CONVERSION):
            steps.append(Step("convert_type", c, target_type="datetime"))
        elif _any(h, NUMBER):
            steps.append(Step("convert_type", c, target_type="float"))
    return steps


def filling_steps(
    kinds: Mapping[str, str], nulls: Mapping[str, int], hints: Mapping[str, str], sequential: Sequence[str]
) -> list[Step]:
    steps = []
    for c, n in nulls.items():
        if n:
            method, constant = fill_choice(hints.get(c, ""), kinds[c], c in sequential)
            if method in ("mean", "median") and kinds[c] not in ("int", "float"):
                continue
            steps.append(Step("fill_null", c, method=method, constant_value=constant))
    return steps


def finishing_steps(kinds: Mapping[str, str], duplicates: int, hints: Mapping[str, str]) -> list[Step]:
    """Duplicates that filling brought about, booleans, outliers."""
    hint = {c: hints.get(c, "").lower() for c in kinds}
    steps = [Step("drop_duplicates")] if duplicates else []
    steps += [
        Step("map_values", c, mapping=BOOLEAN_MAP) for c, kind in kinds.items()
        if kind == "string" and ("boolean" in hint[c] or ("yes" in hint[c] and "no" in hint[c] and "date" not in hint[c]))
    ]
    steps += [
        Step("remove_outliers", c) for c, kind in kinds.items() if kind in ("int", "float") and "outlier" in hint[c]
    ]
    return steps


def clean_by_hints(
    df: DataFrame, hints: Mapping[str, str], order_by: Sequence[str], row_id: str | None = None
) -> tuple[DataFrame, list[Step]]:
    """Profile, prepare, profile again, fill, finish. Returns the table and the steps taken. The
    prepared table is written once, since the second profile and the fills all read it."""
    kinds = column_types(df)
    _, duplicates, _ = overview(df.drop(row_id) if row_id else df)
    first = preparing_steps(kinds, duplicates, hints)
    out = materialize(run_steps(df, first, order_by, row_id))
    kinds = column_types(out)
    _, _, nulls = overview(out)
    sequential: list[str] = []
    if string_columns(out) and any(nulls.values()):
        sequential = [r["column"] for r in detect_sequential(out, order_by, least=2).where("is_sequential").collect()]
    second = filling_steps(kinds, nulls, hints, sequential)
    if second:
        out = materialize(run_steps(out, second, order_by, row_id))
    _, duplicates, _ = overview(out.drop(row_id) if row_id else out)
    third = finishing_steps(kinds, duplicates, hints)
    return run_steps(out, third, order_by, row_id), first + second + third


def clean_set_by_hints(tables: TableSet, hints: Mapping[str, Mapping[str, str]]) -> tuple[TableSet, list[Step]]:
    """Orphans first, then each table by its own hints."""
    taken = [
        Step("validate_foreign_key", r.from_column, table=r.from_table, foreign_key_column=r.from_column,
             lookup_table=r.to_table, lookup_key_column=r.to_column)
        for r in tables.relationships
    ]
    tables = run_steps(tables, taken)
    for name in tables:
        done, steps = clean_by_hints(tables[name], hints.get(name, {}), tables.order_by[name])
        tables = tables.with_table(name, done)
        taken += steps
    return tables, taken
