"""A sink of NIfTI-1 images: a Python data source whose tasks write whole images and whose commit shows them.

Voxels meet by image and slice, slices by image and in order; a task streams slices into the files of
its images, under names that start with a dot, and the driver renames what the tasks that counted have
written. A task that is run again writes another file, and what is not committed is deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import nifti

NAME = "latmix_nifti"


@dataclass
class Written(WriterCommitMessage):
    files: list


class Sink(DataSource):
    """Rows: name, slice (from 0; null for an image without voxels), payload, dim, mat. Options: path, code, slope, inter, description."""

    @classmethod
    def name(cls):
        return NAME

    def writer(self, schema, overwrite):
        return Writer(dict(self.options))


class Writer(DataSourceWriter):
    def __init__(self, options):
        self.options = options

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.options["path"])

    def write(self, rows):
        import uuid

        import pyarrow as pa

        code, slope, inter = int(self.options.get("code", 16)), float(self.options.get("slope", 1.0)), float(self.options.get("inter", 0.0))
        files, root = self._files()
        files.create_dir(root)
        done, own, out, at, size, count = [], None, None, 0, 0, 0

        def finish():
            for _ in range(count - at):  # slices without voxels at the end
                out.write(bytes(size))
            out.close()

        for row in rows:
            if row["name"] != own:
                if out is not None:
                    finish()
                own, at, dim = row["name"], 0, [int(n) for n in row["dim"]]
                hidden = f"{root}/.{uuid.uuid4().hex}"
                done.append((hidden, f"{root}/{own}"))
                out = files.open_output_stream(hidden, compression="gzip" if own.endswith(".gz") else None)
                out.write(nifti.head(dim, np.array(row["mat"]).reshape(4, 4), code, slope, inter, self.options.get("description", "")))
                plane = dim[0] * (dim[1] if len(dim) > 1 else 1)
                size, count = plane * np.dtype(nifti.TYPES[code]).itemsize, int(np.prod(dim)) // max(plane, 1)
                empty = nifti.stored(np.zeros(plane), code, slope, inter)
            if row["slice"] is None or not 0 <= row["slice"] < count:
                continue
            while at < row["slice"]:
                out.write(empty)
                at += 1
            out.write(nifti.stored(np.frombuffer(row["payload"]), code, slope, inter))
            at += 1
        if out is not None:
            size = len(empty)
            finish()
        return Written(done)

    def commit(self, messages):
        files, _ = self._files()
        for m in messages:
            for hidden, final in m.files if m else []:
                files.move(hidden, final)

    def abort(self, messages):
        files, _ = self._files()
        for m in messages:
            for hidden, _ in m.files if m else []:
                if files.get_file_info(hidden).type.name != "NotFound":
                    files.delete_file(hidden)


def write(voxels: DataFrame, headers: DataFrame, path: str, code: int = 16, slope: float = 1.0, inter: float = 0.0, description: str = "") -> None:
    """Writes images: voxels (name, i, j, k, v, and c for a fourth dimension), headers (name, dim array<int>, mat array<double> by row).

    A name is the file's, ``.gz`` at its end compresses. A voxel that is absent or null is 0, one outside
    the dims is left out, and voxels of a name without a header are not written.
    """
    spark = voxels.sparkSession
    c = F.col("c") if "c" in voxels.columns else F.lit(1)
    side = lambda n: F.coalesce(F.get("dim", F.lit(n)), F.lit(1))
    placed = voxels.join(headers.select("name", "dim"), "name").where(F.col("i").between(1, side(0)) & F.col("j").between(1, side(1)) & F.col("k").between(1, side(2)) & c.between(1, side(3)))
    spot = F.struct((F.col("i") - 1 + (F.col("j") - 1) * side(0)).cast("int").alias("at"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    slices = placed.groupBy("name", (F.col("k") - 1 + (c - 1) * side(2)).cast("int").alias("slice"), (side(0) * side(1)).alias("plane")).agg(F.collect_list(spot).alias("voxels"))

    def dense(batches):
        import pyarrow as pa

        for batch in batches:
            payload = []
            for n, spots in zip(batch.column("plane").to_pylist(), batch.column("voxels")):
                x, s = np.zeros(n), spots.values
                x[s.field("at").to_numpy()] = s.field("v").to_numpy(zero_copy_only=False)
                payload.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("slice"), pa.array(payload, pa.binary())], names=["name", "slice", "payload"])

    made = slices.mapInArrow(dense, "name string, slice int, payload binary")
    rows = headers.select("name", "dim", "mat").join(made, "name", "left").select("name", "slice", "payload", "dim", "mat")
    spark.dataSource.register(Sink)
    rows.repartition("name").sortWithinPartitions("name", "slice").write.format(NAME).mode("append").option("path", path).option("code", code).option("slope", slope).option("inter", inter).option("description", description).save()
