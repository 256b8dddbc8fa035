"""MAT files (Level 5) as a source: their variables as typed rows.

Files are read by Spark, one a row; a task parses nested elements, compressed ones too. A file that is
no MAT file, or is cut off, gives the variables before the damage. Function handles and objects give no
rows; complex numbers give their real parts and ``imag``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Numbers of the format: element types of numbers, and classes of arrays. Fixed values.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXT = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR, SPARSE = 1, 2, 4, 5
CLASSES = {CELL: "cell", STRUCT: "struct", CHAR: "char", SPARSE: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}
ROWS = "path string, name string, kind string, dim array<int>, number array<double>, imag array<double>, text string"


def elements(data: bytes, end: str):
    """(type, payload) one after the other; an element of up to four bytes may lie in its own tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(end + "II", data, at)
        if kind >> 16:
            kind, size, start, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            start, step = at + 8, 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)
        if start + size > len(data):
            return
        yield kind, data[start : start + size]
        at += step


def numbers(kind: int, payload: bytes, end: str) -> np.ndarray:
    return np.frombuffer(payload, end + NUMBERS[kind]).astype(float)


def matrix(payload: bytes, end: str, name: str | None = None):
    """(name, class, dims, numbers, imaginary parts, text) of an array and of all that it holds, in depth.

    A field is named ``array.field``; of several structs, and of cells, the place is given: ``array(2).field``.
    """
    parts = list(elements(payload, end))
    if len(parts) < 3:
        return
    flags = struct.unpack(end + "I", parts[0][1][:4])[0]
    dim = [int(n) for n in numbers(*parts[1], end)]
    own = parts[2][1].decode("utf-8", "replace")
    name, rest, kind = own if name is None else name, parts[3:], flags & 0xFF
    count = int(np.prod(dim))
    if kind == CELL:
        yield name, "cell", dim, [], [], None
        for n, (_, inner) in enumerate(rest[:count]):
            yield from matrix(inner, end, f"{name}({n + 1})")
    elif kind == STRUCT:
        yield name, "struct", dim, [], [], None
        width = int(numbers(*rest[0], end)[0])
        fields = [rest[1][1][k : k + width].split(b"\0")[0].decode() for k in range(0, len(rest[1][1]), width)]
        for n, (_, inner) in enumerate(rest[2 : 2 + count * len(fields)]):
            at = f"({n // len(fields) + 1})" if count > 1 else ""
            yield from matrix(inner, end, f"{name}{at}.{fields[n % len(fields)]}")
    elif kind == CHAR:
        k, inner = rest[0] if rest else (1, b"")
        text = inner.decode(TEXT[k] + ({"<": "-le", ">": "-be"}[end] if k != 16 else ""), "replace") if k in TEXT else "".join(map(chr, numbers(k, inner, end).astype(int)))
        if dim[0] > 1:  # rows of text lie column by column
            text = "\n".join("".join(r) for r in np.array(list(text)).reshape(dim[::-1]).T)
        yield name, "char", dim, [], [], text
    elif kind == SPARSE:
        rows, starts, values = (numbers(*p, end) for p in rest[:3])
        dense = np.zeros(dim)
        cols = np.repeat(np.arange(dim[1]), np.diff(starts).astype(int))
        dense[rows[: len(cols)].astype(int), cols] = values[: len(cols)]
        yield name, "sparse", dim, dense.ravel(order="F").tolist(), [], None
    elif kind in CLASSES:
        real = numbers(*rest[0], end).tolist() if rest else []
        imag = numbers(*rest[1], end).tolist() if flags & 0x800 and len(rest) > 1 else []
        yield name, "logical" if flags & 0x200 else CLASSES[kind], dim, real, imag, None


def parse(data: bytes):
    """Rows of a file's variables."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        return
    end = "<" if data[126:128] == b"IM" else ">"
    try:
        for kind, payload in elements(data[128:], end):
            if kind == COMPRESSED:
                for k, inner in elements(zlib.decompress(payload), end):
                    if k == MATRIX:
                        yield from matrix(inner, end)
            elif kind == MATRIX:
                yield from matrix(payload, end)
    except (struct.error, zlib.error, KeyError, ValueError, IndexError):
        return


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind, dim, number, imag, text): a row a variable, field or cell; numbers in column order."""

    def rows(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in ROWS.split(", ")]
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = [(p, *r) for r in parse(content.as_py())]
                if got:
                    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mat").load(path)
    return files.select("path", "content").mapInArrow(rows, ROWS)


def parameter(variables: DataFrame, name: str) -> DataFrame:
    """(path, value): the first number of a variable or field of that name, its text as a number where it is text."""
    value = F.coalesce(F.get("number", F.lit(0)), F.expr("try_cast(trim(text) AS double)"))
    return variables.where(F.col("name") == name).select("path", value.alias("value"))
