"""A user function such as computed columns name."""

from __future__ import annotations

import pandas as pd


def last_digit(rows: pd.DataFrame) -> pd.Series:
    return rows["user_id"] % 10
