"""Streams of voxels: groups of pictures by event time, and a stateful encoder that keeps one frame a scene."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import codec
from ..sources.container import Params

BLOCKS = "scene string, frame int, type string, voxels long, block binary"


def windowed_counts(voxels: DataFrame, gop: int, framerate: float, late: str = "10 seconds") -> DataFrame:
    """Voxels of each group of pictures of a stream with event time `ts`; rows later than `late` are left out by the watermark."""
    span = f"{gop / framerate:.6f} seconds"
    return voxels.withWatermark("ts", late).groupBy("scene", F.window("ts", span)).agg(F.count("*").alias("n_voxels"))


def frames_of(voxels: DataFrame) -> DataFrame:
    """One row a frame, its voxels in a list, from a stream in which each frame's voxels come together."""
    return voxels.groupBy("scene", "frame").agg(F.collect_list(F.struct("x", "y", "z", "r", "g", "b")).alias("voxels"))


class GopEncoder(StatefulProcessor):
    """Encodes frames(scene, frame, voxels) in order: the state is the frame before, its number, and frames that came early.

    The frame before is forgotten when a group of pictures ends.
    """

    def __init__(self, dims: tuple[int, int, int], params: Params):
        self.bricks, self.params = tuple(n // 8 for n in dims), params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "frame int")
        self.before = handle.getValueState("before", "cells binary")
        self.early = handle.getMapState("early", "frame int", "cells binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for i, voxels in zip(batch["frame"], batch["voxels"], strict=True):
                cells = np.array([[v[c] for c in "xyzrgb"] for v in voxels], dtype="<i4").reshape(-1, 6)
                self.early.updateValue((int(i),), (cells.tobytes(),))
        at = self.next.get()[0] if self.next.exists() else 0
        raw = self.before.get()[0] if self.before.exists() else None
        out = []
        while self.early.containsKey((at,)):
            cells = self.early.getValue((at,))[0]
            self.early.removeKey((at,))
            frame, v = self.frame(cells)
            before = None if at % self.params.gop == 0 or raw is None else self.frame(raw)[0]
            out.append((key[0], at, "I" if before is None else "P", v, codec.encode_frame(frame, before, self.bricks, self.params.group, self.params.motion)))
            at += 1
            raw = None if at % self.params.gop == 0 else cells
        self.next.update((at,))
        if raw is None:
            self.before.clear()
        else:
            self.before.update((raw,))
        if out:
            yield pd.DataFrame(out, columns=["scene", "frame", "type", "voxels", "block"])

    @staticmethod
    def frame(raw: bytes) -> tuple[codec.Frame, int]:
        v = np.frombuffer(bytes(raw), "<i4").reshape(-1, 6).astype(np.int64)
        return (codec.frame_of(*v[:, :3].T, v[:, 3:].astype(np.uint8)) if len(v) else {}), len(v)

    def close(self) -> None:
        pass


def encode_stream(frames: DataFrame, dims: tuple[int, int, int], params: Params) -> DataFrame:
    """Frame blocks of a stream of frames(scene, frame, voxels)."""
    return frames.groupBy("scene").transformWithStateInPandas(GopEncoder(dims, params), BLOCKS, "Append", "None")
