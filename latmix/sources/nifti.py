"""NIfTI-1 volumes as a source: one file is one row, its payload exploded to voxels. nifti_sink writes them."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Data type codes of the format. Fixed values.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = 348


def parse_header(data: bytes):
    """(dims, 4 x 4 affine, value type, offset, slope, intercept) from a file's beginning, or None where it can't be read."""
    try:
        if data[:2] == b"\x1f\x8b":
            data = zlib.decompressobj(31).decompress(data, HEADER + 4)
        end = "<" if struct.unpack("<i", data[:4])[0] == HEADER else ">"
        dims = struct.unpack(end + "8h", data[40:56])
        kind = end + TYPES[struct.unpack(end + "h", data[70:72])[0]]
        offset, slope, inter = struct.unpack(end + "3f", data[108:120])
        affine = np.vstack([np.frombuffer(data[280:328], end + "f4").reshape(3, 4), [0, 0, 0, 1]]).astype(float)
        return dims[1 : 1 + dims[0]], affine, kind, int(offset), slope or 1.0, inter
    except (struct.error, KeyError, ValueError, zlib.error):
        return None


def parse(data: bytes):
    """(dims, 4 x 4 affine, values in file order), or None where the file can't be read."""
    head = parse_header(data)
    if head is None:
        return None
    dim, affine, kind, offset, slope, inter = head
    try:
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        return dim, affine, np.frombuffer(data, kind, int(np.prod(dim)), offset).astype(float) * slope + inter
    except (ValueError, OSError, EOFError, zlib.error):
        return None


def head(dim, affine, code: int = 16, slope: float = 1.0, inter: float = 0.0, description: str = "") -> bytes:
    out = bytearray(HEADER + 4)
    struct.pack_into("<i", out, 0, HEADER)
    struct.pack_into("<8h", out, 40, len(dim), *dim, *[1] * (7 - len(dim)))
    struct.pack_into("<2h", out, 70, code, np.dtype(TYPES[code]).itemsize * 8)
    struct.pack_into("<3f", out, 108, HEADER + 4, slope, inter)
    said = description.encode()[:79]
    out[148 : 148 + len(said)] = said
    struct.pack_into("<2h", out, 252, 0, 2)
    out[280:328] = np.asarray(affine, "<f4")[:3].tobytes()
    out[344:348] = b"n+1\x00"
    return bytes(out)


def stored(values: np.ndarray, code: int = 16, slope: float = 1.0, inter: float = 0.0) -> bytes:
    """Values as the file holds them: whole types are rounded and kept in range."""
    data = (values - inter) / slope
    if TYPES[code][0] in "iu":
        data = np.clip(np.round(data), *((k := np.iinfo(TYPES[code])).min, k.max))
    return np.asarray(data, "<" + TYPES[code]).tobytes(order="F")


def build(values: np.ndarray, affine, code: int = 16, slope: float = 1.0, inter: float = 0.0, description: str = "") -> bytes:
    return head(values.shape, affine, code, slope, inter, description) + stored(values, code, slope, inter)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, k, c, v); unreadable files give no rows."""

    def voxels(batches):
        import pandas as pd

        for frame in batches:
            for p, content in zip(frame["path"], frame["content"]):
                got = parse(content)
                if got is None:
                    continue
                dim = (*got[0], *[1] * (4 - len(got[0])))[:4]
                idx = np.unravel_index(np.arange(len(got[2])), dim, order="F")
                yield pd.DataFrame({"path": p, **{n: x + 1 for n, x in zip("ijkc", idx)}, "v": got[2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(voxels, "path string, i int, j int, k int, c int, v double")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, dim, mat): headers; voxels are not decoded."""

    def rows(batches):
        import pandas as pd

        for frame in batches:
            got = [(p, parse_header(c)) for p, c in zip(frame["path"], frame["content"])]
            got = [(p, list(map(int, g[0])), g[1].ravel().tolist()) for p, g in got if g]
            yield pd.DataFrame(got, columns=["path", "dim", "mat"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, dim array<int>, mat array<double>")
