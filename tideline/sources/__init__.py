"""Readers and writers of the wide and long tables the jobs exchange."""
from .tables import (  # noqa: F401
    drop_seam_duplicates,
    read_grid,
    read_weather,
    read_wide_csv,
    seam_duplicates,
    unpivot_columns,
    wide_predictions,
    write_extract,
    write_scores,
)
