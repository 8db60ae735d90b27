"""Tables as single files: CSV, TSV and XLSX, by rows streamed through the driver's file system."""

from __future__ import annotations

import csv
import os
from itertools import chain

from pyspark.sql import DataFrame

from gridloom.sources import xlsx

FORMATS = {".csv": ",", ".tsv": "\t", ".xlsx": None}


def save_dataframe(df: DataFrame, path: str, encoding: str = "utf-8-sig", quote_all: bool = False) -> None:
    """One .csv, .tsv or .xlsx file with a header; folders are made. Nulls are empty fields. Rows come to the driver a
    partition at a time: for single files only, write_folder is the way for tables of any size."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in FORMATS:
        raise ValueError(f"Unsupported file format: {path}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    if kind == ".xlsx":
        with open(path, "wb") as out:
            xlsx.write(out, {"Sheet1": chain([df.columns], df.toLocalIterator())})
        return
    with open(path, "w", encoding=encoding, newline="") as out:
        writer = csv.writer(out, delimiter=FORMATS[kind], quoting=csv.QUOTE_ALL if quote_all else csv.QUOTE_MINIMAL, lineterminator="\n")
        writer.writerow(df.columns)
        writer.writerows(df.toLocalIterator())


def write_folder(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False) -> None:
    """A folder of part files, written by all executors: the way for tables of any size."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quoteAll=quote_all)
