"""Facts of source files: one parse of each file for all the facets a query asks for."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.facets import FACETS, SCHEMAS

FILES = "project string, path string, content string"


def parsed(content: str | None) -> tuple[ast.Module | None, str | None]:
    try:
        return ast.parse(content or ""), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return None, f"{type(problem).__name__}: {problem}"


def listed(rows: list[tuple], ends: list[int], kind: pa.ListType) -> pa.ListArray:
    """Lists of structs from all their rows and the number of rows up to the end of each list."""
    fields = list(kind.value_type)
    cells = list(zip(*rows)) or [()] * len(fields)
    structs = pa.StructArray.from_arrays([pa.array(c, field.type) for c, field in zip(cells, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, type=kind)


def extract(files: DataFrame, *facets: str) -> DataFrame:
    """``project``, ``path``, ``error`` and one array of structs for each facet.

    A null content counts as an empty file; a file that can't be parsed has its
    ``error`` and empty facets. Repeated rows give repeated results.
    """
    schema = T.StructType.fromDDL("project string, path string, error string")
    for f in facets:
        schema = schema.add(f, T.ArrayType(T.StructType.fromDDL(SCHEMAS[f])))
    shape = to_arrow_schema(schema)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, rows, ends = [], [[] for _ in facets], [[0] for _ in facets]
            for _, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                tree, error = parsed(content)
                errors.append(error)
                for f, found, end in zip(facets, rows, ends):
                    if tree:
                        found += FACETS[f](tree, content or "", path or "")
                    end.append(len(found))
            lists = [listed(*x) for x in zip(rows, ends, [field.type for field in shape][3:])]
            yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in batch.columns[:2]), pa.array(errors, pa.string()), *lists], schema=shape)

    return files.select(*(F.col(c).cast("string").alias(c) for c in ("project", "path", "content"))).mapInArrow(kernel, schema)


def facts(files: DataFrame, facet: str) -> DataFrame:
    """One row for each fact of a facet, with its ``project`` and ``path``."""
    return rows_of(extract(files, facet), facet)


def rows_of(extracted: DataFrame, facet: str) -> DataFrame:
    return extracted.select("project", "path", F.explode(facet).alias("fact")).select("project", "path", "fact.*")


def lines(files: DataFrame) -> DataFrame:
    """``project``, ``path``, ``line`` from 1 and its ``text``; an ending line break starts no line."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col("content"), F.lit("")), r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    return files.select("project", "path", F.posexplode(parts).alias("at", "text")).select("project", "path", (F.col("at") + 1).alias("line"), "text")
