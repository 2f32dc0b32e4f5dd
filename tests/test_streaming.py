import numpy as np

from voxelweave.sources import codec
from voxelweave.sources.container import Params
from voxelweave.streaming import gops


def test_windowed_counts(spark, tmp_path):
    schema = "scene string, ts timestamp, x int"
    spark.createDataFrame([("s", f"2024-01-01 00:00:0{k}", k) for k in range(6)], "scene string, t string, x int").selectExpr("scene", "timestamp(t) ts", "x").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = gops.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 4, 2.0).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n_voxels"] for r in spark.sql("select n_voxels from counts order by window").collect()] == [2, 2, 2]


class State:
    def __init__(self):
        self.value, self.map = None, {}

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    containsKey = lambda self, k: k in self.map  # noqa: E731, N815
    getValue = lambda self, k: self.map[k]  # noqa: E731, N815

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None

    def updateValue(self, k, v):  # noqa: N802
        self.map[k] = v

    def removeKey(self, k):  # noqa: N802
        del self.map[k]


class Handle:
    def getValueState(self, name, schema):  # noqa: N802
        return State()

    def getMapState(self, name, keys, values):  # noqa: N802
        return State()


def test_stateful_encoder_keeps_order_and_forgets():
    import pandas as pd

    frames = {i: [dict(zip("xyzrgb", (i + k % 3, k % 8, k // 8, k, i, 7), strict=True)) for k in range(24)] for i in range(6)}
    p = gops.GopEncoder((16, 8, 8), Params(3, 0, True))
    p.init(Handle())
    blocks = []
    for batch in ([1, 0], [5, 2], [4, 3]):
        for out in p.handleInputRows(("s",), iter([pd.DataFrame({"frame": batch, "voxels": [frames[i] for i in batch]})]), None):
            blocks += out.to_dict("records")
    assert [b["frame"] for b in blocks] == list(range(6)) and "".join(b["type"] for b in blocks) == "IPPIPP"
    assert not p.before.exists() and not p.early.map
    before = None
    for b in blocks:
        before = codec.decode_frame(b["block"], None if b["type"] == "I" else before, (2, 1, 1), 0)
        got = np.concatenate(list(codec.voxels_of(before)))
        assert sorted(map(tuple, got.tolist())) == sorted(tuple(v.values()) for v in frames[b["frame"]])
