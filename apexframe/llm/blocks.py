"""Tables that tasks read in blocks of bounded size, so that none of them is broadcast or held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

from .warc import store


class Blocks:
    """A Parquet folder in shared storage as a sequence of blocks, each made by ``build`` of rows of about ``size`` bytes.

    Iterating again reads the files again, unless the whole table is one block; that one is kept.
    """

    def __init__(self, folder: str, columns: list[str], build: Callable[[pa.Table], object], size: int):
        self._folder, self._columns, self._build, self._size, self._only = folder, columns, build, size, None

    def _batches(self) -> Iterator[pa.RecordBatch]:
        files, top = store(self._folder)
        for info in sorted(files.get_file_info(fs.FileSelector(top)), key=lambda i: i.path):
            if info.is_file and info.path.endswith(".parquet"):
                with pq.ParquetFile(files.open_input_file(info.path)) as opened:
                    yield from opened.iter_batches(1024, columns=self._columns)

    def __iter__(self) -> Iterator[object]:
        if self._only is not None:
            yield self._only
            return
        held, size, n = [], 0, 0
        for batch in self._batches():
            held.append(batch)
            size += batch.nbytes
            if size >= self._size:
                yield self._build(pa.Table.from_batches(held))
                held, size, n = [], 0, n + 1
        if held:
            block = self._build(pa.Table.from_batches(held))
            if not n:
                self._only = block
            yield block
