"""Functions on record columns: headers, tables of cells, fees, retries, validation errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.binding import bound


def allowed_headers(headers: Column, names: tuple[str, ...]) -> Column:
    """The entries of a map whose lower-cased name is in the list."""
    return F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: k.isin(*names))


def has_prohibited_header(headers: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.transform(F.map_keys(headers), F.lower), F.array(*map(F.lit, names)))


def filled(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))


def normal_matrix(rows: Column) -> Column:
    """Cells with single blanks, rows padded to the longest one, empty rows and columns dropped. Linear in the cells: a
    column that any row fills is among the distinct places of filled cells."""
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    places = lambda r: F.filter(F.transform(r, lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull())
    used = lambda kept: F.array_sort(F.array_distinct(F.flatten(F.transform(kept, places))))
    taken = lambda kept, columns: F.transform(kept, lambda r: F.transform(columns, lambda i: F.coalesce(F.get(r, i), F.lit(""))))
    kept = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: filled(r) > 0)
    return bound(kept, lambda k: bound(used(k), lambda columns: taken(k, columns)))


def reliable_table(rows: Column) -> Column:
    """Two rows and columns at least, rectangular, filled headers, two filled cells in each row."""
    width = F.size(rows[0])
    shape = (F.size(rows) >= 2) & (width >= 2) & F.forall(rows, lambda r: F.size(r) == width)
    return F.coalesce(shape & (filled(rows[0]) == width) & F.forall(rows, lambda r: filled(r) >= 2), F.lit(False))


def dense_table(rows: Column, least: float = 0.72, columns: tuple[int, int] = (2, 12)) -> Column:
    """So many columns, cells filled by the share, two filled cells in each row."""
    cells = F.flatten(rows)
    share = F.try_divide(filled(cells).cast("double"), F.size(cells).cast("double"))
    return F.coalesce(F.size(rows[0]).between(*columns) & (share >= least) & F.forall(rows, lambda r: filled(r) >= 2), F.lit(False))


def published(status: Column) -> Column:
    """Whether a publication status is missing, blank, 1 or true."""
    return F.lower(F.coalesce(status.cast("string"), F.lit(""))).isin("", "1", "true")


def fee(amount: Column) -> Column:
    """Digits with thousands separators; anything else as it is."""
    digits = amount.rlike("^[0-9]{1,18}$")
    return F.when(digits, F.format_number(amount.try_cast("bigint"), 0)).otherwise(amount)


def retry_delay(attempt: Column, backoff: float, retry_after: Column, most: float = 30.0) -> Column:
    """Exponential backoff or what the server asks for, whichever is longer, up to a bound."""
    return F.least(F.lit(most), F.greatest(F.lit(backoff) * F.pow(F.lit(2.0), attempt), F.coalesce(retry_after, F.lit(0.0))))


def retryable(status: Column) -> Column:
    return F.coalesce(status.isin(408, 425) | status.between(500, 599), F.lit(False))


def fetch_method(url: Column, dynamic: Column) -> Column:
    """How a source is to be fetched: as a PDF, rendered, or as it is."""
    return F.when(F.endswith(F.lower(url), F.lit(".pdf")), "pdf").when(dynamic, "rendered").otherwise("static")


def is_pdf(body: Column) -> Column:
    """Whether the signature stands in the first 1,024 bytes."""
    return F.contains(F.substring(body, 1, 1024), F.lit(b"%PDF-"))


def errors(**checks: Column) -> Column:
    """The names of the checks that do not hold; null counts as a failure."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))


def count_errors(attempted: Column, successful: Column, failed: Column, selected: Column, skipped: Column) -> Column:
    """Manifest arithmetic: attempted = successful + failed, selected = attempted + skipped."""
    return errors(attempted=attempted == successful + failed, selected=selected == attempted + skipped)
