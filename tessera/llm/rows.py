"""Whole rows carried through an operator under one name, so that no column of theirs can clash with its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Each row of docs as `_row`, beside the columns that the operator reads."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *columns)


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def set_aside(docs: DataFrame, inner: tuple[str, ...], results: tuple[str, ...], *read: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs without columns named like an operator's results, those named like its inner columns under other names, and what gives them back.

    Names are compared as Spark does, without regard to case; the columns that the operator reads stay.
    """
    keep = {c.lower() for c in read}
    gone = [c for c in docs.columns if c.lower() in {r.lower() for r in results} - keep]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in gone)) if gone else docs
    clash = {c: f"{c}\u0001" for c in docs.columns if c.lower() in {i.lower() for i in inner} - keep}
    return docs.withColumnsRenamed(clash), lambda out: out.withColumnsRenamed({v: k for k, v in clash.items()})
