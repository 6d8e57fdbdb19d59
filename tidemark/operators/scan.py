"""Scans by filter strings: hash equality and time ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.types import Kind
from tidemark.functions.values import UNITS_FROM
from tidemark.operators.table import FILE, ROW, TimeSeriesTable

#: Bytes of a page, as JSON.
PAGE_BYTES = 1 << 20

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<op>&&|==|>=|<=|!=|>|<)|(?P<name>[A-Za-z_]\w*))""")


class FilterError(ValueError):
    """A filter that can't be read, or that isn't about the hash or sort column."""


@dataclass
class Domain:
    """What filters ask for: hash values, and ranges [from, until) of the sort column as epoch numbers."""

    hashes: list[str] | None = None
    ranges: list[tuple[int | None, int | None]] = field(default_factory=list)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"cannot read {text[at:]!r} in {text!r}")
        out.append((m.lastgroup or "", m[m.lastgroup]))
        at = m.end()
    return out


def parse_filters(filters: Iterable[str], hash_by: str, sort_by: str) -> Domain:
    """`hash == 'value'`, `sort >= a` and `sort >= a && sort < b`. Several filters all hold; several hash values are alternatives."""
    filters = list(filters)
    if not filters:
        raise FilterError("no filters were given")
    domain = Domain()
    for text in filters:
        found = tokens(text)
        shape = " ".join(kind for kind, _ in found)
        words = [word for _, word in found]
        if shape == "name op text" and words[0] == hash_by and words[1] == "==":
            value = re.sub(r"\\(.)", r"\1", words[2][1:-1])
            domain.hashes = [*(domain.hashes or []), value]
        elif shape == "name op number" and words[0] == sort_by and words[1] == ">=":
            domain.ranges.append((int(float(words[2])), None))
        elif shape == "name op number op name op number" and words[0] == words[4] == sort_by and [words[1], words[3], words[5]] == [">=", "&&", "<"]:
            domain.ranges.append((int(float(words[2])), int(float(words[6]))))
        else:
            raise FilterError(f"{text!r} is neither {hash_by} == 'value' nor a range {sort_by} >= a [&& {sort_by} < b]")
    return domain


def epoch_seconds(value: int) -> float:
    """Seconds of an epoch number in seconds, milli-, micro- or nanoseconds, told by its size."""
    start = int(UNITS_FROM.timestamp())
    for digits in (9, 6, 3):
        if value > start * 10**digits:
            return value / 10**digits
    return float(value)


def time_range(low: tuple[str, int] | None, high: tuple[str, int] | None) -> tuple[float, float | None] | None:
    """Bounds (exactly, above or below; value) as a range of seconds, [from, until); None where there is no range.

    An exact lower and upper bound are a range; above leaves the end open; a lower bound below starts at 0."""
    if low is None:
        return None
    kind, value = low
    if kind == "exactly" and high is not None and high[0] == "exactly":
        return epoch_seconds(value), epoch_seconds(high[1])
    if kind == "above":
        return epoch_seconds(value), None
    if kind == "below":
        return 0.0, epoch_seconds(value)
    return None


def scan(table: TimeSeriesTable, columns: Iterable[str] | None = None, filters: Iterable[str] = (), place: bool = False) -> DataFrame:
    """A scan by filter strings. A table with a hash column must be asked for values of it. place: see TimeSeriesTable.scan()."""
    domain = parse_filters(filters, table.hash_by, table.sort_by)
    if table.hash_by and domain.hashes is None:
        raise FilterError(f"your query must contain '{table.hash_by}' constraint")
    kind = table.union_schema().get(table.sort_by)
    ranges = domain.ranges
    if kind is Kind.TIMESTAMP:
        ranges = [tuple(None if x is None else F.timestamp_micros(F.lit(int(epoch_seconds(x) * 1e6))) for x in r) for r in ranges]
    return table.scan(columns, domain.hashes, ranges, place=place)


def read_page(table: TimeSeriesTable, columns: Iterable[str], filters: Iterable[str], token: str | None = None, max_bytes: int = PAGE_BYTES) -> tuple[list[Row], str | None]:
    """Rows of a scan of about max_bytes at most (one row at least), and the token that the next page goes on from; None at the end.

    Rows come file by file, in the order of names and places in the file; the token names a file and a place, so a reader can
    stop and go on later, in another session too, as long as the file is there: batches that come meanwhile don't move rows."""
    columns = list(columns)
    located = scan(table, columns, filters, place=True)
    size = F.octet_length(F.to_json(F.struct(*columns))).alias("_size")
    after, skip = (None, 0) if token is None else (lambda t: (t[1], int(t[0])))(token.split(":", 1))
    page, total = [], 0
    for path in sorted(set(located.inputFiles())):
        if after is not None and path < after:
            continue
        start = skip if path == after else 0
        own = located.where((F.col(FILE) == path) & (F.col(ROW) >= start)).select(*columns, ROW, size).orderBy(ROW)
        for row in own.toLocalIterator():
            if page and total + row["_size"] > max_bytes:
                return page, f"{row[ROW]}:{path}"
            page.append(Row(**{c: row[c] for c in columns}))
            total += row["_size"]
    return page, None


def pages(df: DataFrame, rows: int) -> Iterator[list[Row]]:
    """A result page by page, a partition in memory at a time."""
    page: list[Row] = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) >= rows:
            yield page
            page = []
    if page:
        yield page
