"""Errors raised while a cleaning step is being built."""


class CleaningError(ValueError):
    """A step cannot be applied to the table it was given."""


def require_columns(df, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise CleaningError(f"no such column: {', '.join(missing)}")
