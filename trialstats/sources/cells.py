"""Cells of CSV files by column name, for files of any layout: what a task runs on whole files."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of one Arrow batch.
ROWS = 4096


def header_of(content: bytes) -> list[str]:
    """Trimmed names in a file's first line; none for an empty file."""
    return [name.strip() for name in next(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), skipinitialspace=True), [])]


def rows_of(content: bytes, columns: list[str]) -> Iterator[tuple[int, list[str | None], str | None]]:
    """(place, cells of ``columns``, the row's text if it is bad) of every row that isn't blank, from place 1.

    Quoted cells may hold commas, quotes and line breaks. A blank cell and a column that the file lacks are missing. A row with more or
    fewer cells than the header is bad; its cells are taken from the left.
    """
    reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), skipinitialspace=True)
    header = [name.strip() for name in next(reader, [])]
    at = [header.index(name) if name in header else None for name in columns]
    place = 0
    for cells in reader:
        if not any(cell.strip() for cell in cells):
            continue
        place += 1
        took = [cells[i].strip() or None if i is not None and i < len(cells) else None for i in at]
        yield place, took, None if len(cells) == len(header) else ",".join(cells)


def file_rows(columns: list[str]):
    """Rows of whole files: ``file`` (carried), ``place``, ``cells``, ``bad``. A file is read at once, its rows leave in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("content")):
                rows, own = rows_of(content.as_buffer().to_pybytes(), columns), batch.column("file").slice(i, 1)
                while some := [row for _, row in zip(range(ROWS), rows)]:  # noqa: B905
                    places, cells, bad = zip(*some, strict=True)
                    files = own.take(pa.array([0] * len(some)))
                    arrays = [files, pa.array(places, pa.int32()), pa.array(cells, pa.list_(pa.string())), pa.array(bad, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["file", "place", "cells", "bad"])

    return run


def file_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [header_of(content.as_buffer().to_pybytes()) for content in batch.column("content")]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.string()))], ["names"])
