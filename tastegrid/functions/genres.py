"""Genre lists stored as one ``A|B|C`` string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def genre_array(genres: ColumnOrName = "genres", keep_blank: bool = False) -> Column:
    """The list of genres, untrimmed; null stays null and ``''`` is one blank genre (dropped unless ``keep_blank``)."""
    parts = F.split(_col(genres), "[|]")
    return parts if keep_blank else F.filter(parts, lambda g: F.trim(g) != "")


def primary_genre(genres: ColumnOrName = "genres") -> Column:
    """The first genre, which may be blank."""
    return F.split_part(_col(genres), F.lit("|"), F.lit(1))


def matches_genre(genres: ColumnOrName, wanted: ColumnOrName) -> Column:
    """Case-insensitive substring test, as used on recommendation rows."""
    return F.contains(F.lower(_col(genres)), F.lower(_col(wanted)))


def same_genre(genre: ColumnOrName, wanted: ColumnOrName) -> Column:
    """Case-insensitive equality, as used on the per-genre lists."""
    return F.lower(_col(genre)) == F.lower(_col(wanted))
