"""Depth frames as a stream, fused into a grid batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.sampling import integrate_tsdf


class Fusion:
    """A running truncated distance field in a versioned folder; each micro-batch of pixels makes the next version.

    Versions are written whole and named by the batch, so a batch that is run again after a failure writes the same version
    from the one before it, and readers never see half of one. frames: frame_id to its camera (see integrate_tsdf).

    The folder itself says which versions there are (a written one ends with _SUCCESS), so a new driver with the same folder
    and checkpoint goes on where the last one stopped; an existing start is kept.
    """

    def __init__(self, voxels: DataFrame, path: str, frames: dict[int, dict], size: float):
        self.spark, self.path, self.frames, self.size = voxels.sparkSession, path, frames, size
        if "start" not in self._written():
            voxels.select("i", "j", "k", "v", "w").write.mode("overwrite").parquet(f"{path}/start")

    def _written(self) -> list[str]:
        """The names of the versions that are written whole."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return [f.getPath().getParent().getName() for f in found or []]

    def version(self, before: int | None = None) -> DataFrame:
        """The latest version, or that before a batch."""
        numbers = [int(n.removeprefix("batch-")) for n in self._written() if n.startswith("batch-")]
        names = [n for n in numbers if before is None or n < before]
        return self.spark.read.parquet(f"{self.path}/{f'batch-{max(names)}' if names else 'start'}")

    def batch(self, pixels: DataFrame, batch_id: int) -> None:
        """pixels: frame_id, u, v, depth. Frames are taken in the order of their ids."""
        state = self.version(batch_id)
        pixels = pixels.persist()
        for row in pixels.select("frame_id").distinct().orderBy("frame_id").collect():  # the frames of one batch
            frame = self.frames[row["frame_id"]]
            state = integrate_tsdf(state, pixels.where(pixels["frame_id"] == row["frame_id"]), frame, self.size)
        state.write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        pixels.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        sink: Callable[[DataFrame, int], None] = self.batch
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
