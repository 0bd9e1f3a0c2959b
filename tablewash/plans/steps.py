"""Steps as data, and applying a list of them to a table or a table set."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import DataFrame

from tablewash.errors import CleaningError
from tablewash.operators import cells, fills, relate, rows
from tablewash.operators.fits import fit_median, fit_moments
from tablewash.session import materialize
from tablewash.sources.tables import TableSet

# The fields each kind of step needs, and the choices some fields have.
REQUIRED = {
    "fill_null": ("column", "method"),
    "drop_duplicates": (),
    "convert_type": ("column", "target_type"),
    "normalize": ("column",),
    "remove_outliers": ("column",),
    "strip_whitespace": ("column",),
    "map_values": ("column", "mapping"),
    "replace_substring": ("column", "old_value", "new_value"),
    "standardize_format": ("column",),
    "lookup_fill": ("table", "column", "foreign_key_column", "lookup_table", "lookup_key_column", "lookup_value_column"),
    "validate_foreign_key": ("table", "foreign_key_column", "lookup_table", "lookup_key_column"),
}
CHOICES = {
    ("fill_null", "method"): ("mean", "median", "mode", "constant", "forward_fill", "backward_fill", "sequential"),
    ("normalize", "method"): ("minmax", "zscore"),
    ("convert_type", "target_type"): ("int", "float", "datetime", "string"),
    ("remove_outliers", "outlier_method"): ("iqr", "zscore"),
}
LINK_STEPS = ("lookup_fill", "validate_foreign_key")
FITTED_STEPS = ("normalize", "remove_outliers", "standardize_format")
ORDERED_FILLS = ("forward_fill", "backward_fill", "sequential")


@dataclass(frozen=True)
class Step:
    action_type: str
    column: str | None = None
    table: str | None = None
    method: str | None = None
    target_type: str | None = None
    constant_value: Any = None
    mapping: Mapping[str, Any] | None = None
    old_value: str | None = None
    new_value: str | None = None
    outlier_method: str | None = None
    outlier_threshold: float | None = None
    foreign_key_column: str | None = None
    lookup_table: str | None = None
    lookup_key_column: str | None = None
    lookup_value_column: str | None = None

    def __post_init__(self) -> None:
        if self.action_type not in REQUIRED:
            raise CleaningError(f"unknown action type '{self.action_type}'; one of {', '.join(REQUIRED)}")
        for name in REQUIRED[self.action_type]:
            value = getattr(self, name)
            if value is None or (name == "mapping" and not value):
                raise CleaningError(f"{self.action_type} requires '{name}'")
        for (action, name), allowed in CHOICES.items():
            value = getattr(self, name)
            if action == self.action_type and value is not None and value not in allowed:
                raise CleaningError(f"{action}: '{name}' must be one of {', '.join(allowed)}")
        if self.method == "constant" and self.constant_value is None:
            raise CleaningError("fill_null with a constant requires 'constant_value'")

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> Step:
        known = {f.name for f in fields(cls)}
        extra = set(d) - known
        if extra or "action_type" not in d:
            raise CleaningError(f"unknown or missing fields: {', '.join(sorted(extra)) or 'action_type'}")
        return cls(**d)

    def sentence(self, rows_before: int | None = None, rows_after: int | None = None) -> str:
        """What the step does, in one sentence."""
        gone = ""
        if rows_before is not None and rows_after is not None:
            gone = f" {rows_before - rows_after} of {rows_before}"
        c = self.column
        texts = {
            "fill_null": f"Filled missing cells of {c} using {self.method}"
                         + (f" {self.constant_value!r}" if self.method == "constant" else ""),
            "drop_duplicates": f"Removed{gone} rows as duplicates",
            "convert_type": f"Converted {c} to {self.target_type}",
            "normalize": f"Normalized {c} ({self.method or 'minmax'})",
            "remove_outliers": f"Removed{gone} rows with outliers in {c} ({self.outlier_method or 'iqr'})",
            "strip_whitespace": f"Stripped whitespace around {c}",
            "map_values": f"Mapped values of {c}",
            "replace_substring": f"Replaced '{self.old_value}' with '{self.new_value}' in {c}" if self.new_value
                                 else f"Removed '{self.old_value}' from {c}",
            "standardize_format": f"Brought identifiers in {c} to one format",
            "lookup_fill": f"Filled missing cells of {self.table}.{c} from {self.lookup_table}",
            "validate_foreign_key": f"Removed{gone} rows of {self.table} without a parent in {self.lookup_table}",
        }
        return texts[self.action_type]


def as_steps(steps: Iterable[Step | Mapping[str, Any]]) -> list[Step]:
    return [s if isinstance(s, Step) else Step.from_dict(s) for s in steps]


def apply_step(df: DataFrame, step: Step, order_by: Sequence[str] = (), row_id: str | None = None) -> DataFrame:
    """One step on one table. ``order_by`` is the row order for the steps that have one."""
    c = step.column
    match step.action_type:
        case "fill_null":
            return fills.fill_null(df, c, step.method, step.constant_value, order_by)
        case "drop_duplicates":
            return rows.drop_duplicates(df, row_id)
        case "convert_type":
            return cells.convert_type(df, c, step.target_type)
        case "normalize":
            return cells.normalize(df, c, step.method or "minmax")
        case "remove_outliers":
            return rows.remove_outliers(df, c, step.outlier_method or "iqr", step.outlier_threshold)
        case "strip_whitespace":
            return cells.strip_whitespace(df, c)
        case "map_values":
            return cells.map_values(df, c, step.mapping)
        case "replace_substring":
            return cells.replace_substring(df, c, step.old_value, step.new_value)
        case "standardize_format":
            return cells.standardize_ids(df, c, order_by)
    raise CleaningError(f"'{step.action_type}' needs a table set")


def run_steps(
    target: DataFrame | TableSet, steps: Iterable[Step | Mapping[str, Any]],
    order_by: Sequence[str] = (), row_id: str | None = None,
) -> DataFrame | TableSet:
    """Apply steps in order. On a table set each step goes to its ``table`` (the primary one by
    default), with the row order the set names for it. Without one, ``order_by`` and ``row_id``
    hold for every table that has those columns."""
    todo = as_steps(steps)
    if isinstance(target, TableSet):
        return _run_on_set(target, todo, order_by, row_id)
    shuffled = False
    while todo:
        group = _fill_group(todo)
        if shuffled and _fits(todo[0]):
            # A fit reads its input again. After a shuffle, one written copy costs less.
            target, shuffled = materialize(target), False
        if len(group) > 1:
            target = _fill_together(target, group, order_by)
        else:
            target = apply_step(target, todo[0], order_by, row_id)
        taken = todo[:max(1, len(group))]
        shuffled = shuffled or any(s.action_type == "drop_duplicates" or s.method in ORDERED_FILLS for s in taken)
        todo = todo[len(taken):]
    return target


def _fits(step: Step) -> bool:
    return step.action_type in FITTED_STEPS or (step.action_type == "fill_null" and step.method != "constant")


def _run_on_set(tables: TableSet, steps: list[Step], order_by: Sequence[str], row_id: str | None) -> TableSet:
    while steps:
        step = steps[0]
        name = step.table or tables.primary
        if name is None:
            raise CleaningError("the step names no table and the set has no primary one")
        if step.action_type in LINK_STEPS:
            tables, taken = tables.with_table(name, _link_step(tables, name, step)), 1
        else:
            run = [step]
            for other in steps[1:]:
                if other.action_type in LINK_STEPS or (other.table or tables.primary) != name:
                    break
                run.append(other)
            columns = tables[name].columns
            order = tables.order_by.get(name) or (order_by if set(order_by) <= set(columns) else ())
            done = run_steps(tables[name], run, order, row_id if row_id in columns else None)
            tables, taken = tables.with_table(name, done), len(run)
        steps = steps[taken:]
    return tables


def _link_step(tables: TableSet, name: str, step: Step) -> DataFrame:
    child, parent = tables[name], tables[step.lookup_table]
    if step.action_type == "validate_foreign_key":
        return relate.enforce_fk(child, step.foreign_key_column, parent, step.lookup_key_column)
    order = tables.order_by.get(step.lookup_table) or ()
    return relate.lookup_fill(
        child, step.column, step.foreign_key_column, parent,
        step.lookup_key_column, step.lookup_value_column, order)


def _fill_group(steps: list[Step]) -> list[Step]:
    """The leading fills of different columns. Filling one column changes neither the rows nor
    the other columns, so they can be fitted on the same table at once."""
    group: list[Step] = []
    for s in steps:
        if s.action_type != "fill_null" or s.column in {g.column for g in group}:
            break
        group.append(s)
    return group


def _fill_together(df: DataFrame, group: list[Step], order_by: Sequence[str]) -> DataFrame:
    """Means in one pass, medians in one pass, ordered fills in one scan."""
    by_method: dict[str, list[Step]] = {}
    for s in group:
        by_method.setdefault(s.method, []).append(s)
    values: dict[str, Any] = {}
    means = [s.column for s in by_method.get("mean", [])]
    medians = [s.column for s in by_method.get("median", [])]
    fills._only_numbers(df, means + medians, "a mean or median fill")
    if means:
        values.update({c: m.mean for c, m in fit_moments(df, means).items()})
    if medians:
        values.update(fit_median(df, medians))
    ordered = {s.column: s.method.removesuffix("_fill") for m in ORDERED_FILLS[:2] for s in by_method.get(m, [])}
    out = fills.fill_rows(df, ordered, [s.column for s in by_method.get("sequential", [])], order_by)
    for s in by_method.get("mode", []):
        values[s.column] = fills.mode_of(df, s.column)
    for s in by_method.get("constant", []):
        out = fills.fill_constant(out, s.column, s.constant_value)
    return fills.fill_value(out, values)
