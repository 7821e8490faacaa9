"""Names for helper columns that no input has."""

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores put after those that df has already, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
