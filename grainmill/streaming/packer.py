"""Streaming: a stream of documents with a position to seek to, and a packer that keeps what is left over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "pending array<string>, next_block long"


class Shards(DataSource):
    """format("shards"), option path: rows (shard, row, text) of a folder's Parquet files, by name and row; option
    batch: rows at once. The position of a stream is {shard, row}, the row after the last one read."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return "shard int, row long, text string"

    def simpleStreamReader(self, schema):
        return ShardReader(self.options)


class ShardReader(SimpleDataSourceStreamReader):
    """Batches are bounded by their rows, not by what there is, so that the packer's task holds one batch at most."""

    def __init__(self, options):
        self.path, self.batch = options["path"].removeprefix("file://"), int(options.get("batch", 1000))

    def initialOffset(self) -> dict:
        return {"shard": 0, "row": 0}

    def _rows(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        """The rows after start, up to end or so many as a batch has, and the position after them. Files and row groups outside
        that range aren't read."""
        import pyarrow.dataset as ds
        import pyarrow.parquet as pq

        names = sorted(ds.dataset(self.path, format="parquet").files)
        out, at = [], dict(start)
        while at["shard"] < len(names):
            shard, f = at["shard"], pq.ParquetFile(names[at["shard"]])
            stop = f.metadata.num_rows if end is None or shard < end["shard"] else min(end["row"], f.metadata.num_rows)
            before = 0
            for g in range(f.num_row_groups):
                n = f.metadata.row_group(g).num_rows
                if before + n > at["row"] and before < stop:
                    texts = f.read_row_group(g, columns=["text"]).column("text")
                    for k in range(max(0, at["row"] - before), min(n, stop - before)):
                        at["row"], text = before + k + 1, texts[k].as_py()
                        if text is not None and text.strip():
                            out.append((shard, at["row"], text))
                        if end is None and len(out) == self.batch:
                            return out, at
                before += n
            if shard + 1 == len(names) or (end is not None and shard >= end["shard"]):
                break
            at = {"shard": shard + 1, "row": 0}
        return out, at

    def read(self, start: dict):
        rows, end = self._rows(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(start, end)[0])

    def commit(self, end: dict) -> None:
        pass


class Packer(StatefulProcessor):
    """Documents (stream, shard, row, ids) to blocks (stream, block, w): size + 1 tokens each, one shared with the next."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("packer", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        pending, block = ([], 0) if not self.state.exists() else (list(self.state.get()[0]), self.state.get()[1])
        for ids in pd.concat(rows).sort_values(["shard", "row"])["ids"]:
            pending += list(ids)
        out = []
        while len(pending) >= self.size + 1:
            out.append((key[0], block, pending[: self.size + 1]))
            pending, block = pending[self.size :], block + 1
        self.state.update((pending, block))
        yield pd.DataFrame(out, columns=["stream", "block", "w"])

    def close(self) -> None:
        pass


def packed(documents: DataFrame, size: int) -> DataFrame:
    """Blocks of a stream (stream, shard, row, ids); each value of stream is packed on its own, by one task at a time."""
    return documents.groupBy("stream").transformWithStateInPandas(Packer(size), "stream string, block long, w array<string>", "Append", "None")
