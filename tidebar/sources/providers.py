"""Session providers as Spark data sources: ``spark.read.format("vendor_csv").load(path)`` gives raw session rows.

A provider is a subclass of ``SessionFiles`` that says how one of its files becomes rows. Listing files, one partition per
symbol, the schema check and the stream of Arrow batches are common to all. ``canonical`` then applies the session contract
(``readers.canonical_sessions``) with the provider's settlement time.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidebar import schemas
from tidebar.sources.readers import canonical_sessions

PRICES = ["open", "high", "low", "close", "volume"]
RAW = T.StructType([schemas.SESSIONS[c] for c in ("symbol", "session_date", *PRICES)])
_ARROW = pa.schema([("symbol", pa.string()), ("session_date", pa.date32()), *[(c, pa.float64()) for c in PRICES]])
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class SymbolFiles(InputPartition):
    """One symbol's files, read one after the other."""

    symbol: str | None
    paths: list[str]


class SessionFiles(DataSource):
    """Session files of one provider, in a folder per symbol (``symbol=...``), or of the one symbol of option ``symbol``.

    Options: ``path``; ``symbol``, the symbol of files that lie in no such folder; ``symbols``, a comma-separated list, the
    only folders to read. Subclasses set the settlement time and implement ``rows``.
    """

    close: tuple[int, int] = (16, 0)

    @classmethod
    def name(cls) -> str:
        raise NotImplementedError

    @staticmethod
    def rows(file: BinaryIO) -> Iterator[pd.DataFrame]:
        """The file in frames of ``session_date`` and prices; what cannot be read as such is missing."""
        raise NotImplementedError

    def schema(self) -> T.StructType:
        return RAW

    def reader(self, schema: T.StructType) -> SessionReader:
        if [f.name for f in schema] != RAW.names:
            raise ValueError(f"{self.name()} has the columns {RAW.names}, not {[f.name for f in schema]}")
        return SessionReader(type(self), dict(self.options))


class SessionReader(DataSourceReader):
    def __init__(self, source: type[SessionFiles], options: dict[str, str]):
        self.source = source
        self.path, self.symbol = options["path"], options.get("symbol")
        wanted = options.get("symbols")
        self.wanted = None if wanted is None else {s.strip() for s in wanted.split(",")}

    def partitions(self) -> list[SymbolFiles]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        files: dict[str | None, list[str]] = defaultdict(list)
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            *folders, file = info.path[len(root.rstrip("/")):].lstrip("/").split("/")
            if info.type != fs.FileType.File or any(p[0] in "._" for p in (*folders, file)):
                continue
            named = [unquote(f.removeprefix("symbol=")) for f in folders if f.startswith("symbol=")]
            symbol = self.symbol if not named else None if named[-1] == _NULL_FOLDER else named[-1]
            if self.wanted is None or symbol in self.wanted:
                files[symbol].append(info.path)
        return [SymbolFiles(s, sorted(p)) for s, p in sorted(files.items(), key=lambda f: (f[0] is not None, f[0] or ""))]

    def read(self, partition: SymbolFiles | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files at all
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.paths:
            with store.open_input_stream(path) as file:
                for frame in self.source.rows(file):
                    missing = [c for c in ("session_date", *PRICES[:4]) if c not in frame.columns]
                    if missing:
                        raise ValueError(f"{self.source.name()}: {path} has no {', '.join(missing)}")
                    frame = frame[frame["session_date"].notna()].reindex(columns=_ARROW.names)
                    frame["symbol"] = partition.symbol
                    yield pa.RecordBatch.from_pandas(frame, schema=_ARROW, preserve_index=False)


class VendorCsv(SessionFiles):
    """CSV with a header in any case; '.' and junk are missing values."""

    @classmethod
    def name(cls) -> str:
        return "vendor_csv"

    @staticmethod
    def rows(file: BinaryIO) -> Iterator[pd.DataFrame]:
        with pd.read_csv(file, dtype=str, chunksize=50_000) as parts:
            for part in parts:
                part = part.rename(columns=lambda c: c.strip().lower()).rename(columns={"date": "session_date"})
                if "session_date" in part:
                    day = pd.to_datetime(part["session_date"], format="%Y-%m-%d", errors="coerce")
                    part["session_date"] = day.dt.date.where(day.notna(), None)
                for c in PRICES:
                    if c in part:
                        part[c] = pd.to_numeric(part[c], errors="coerce")
                yield part


class IndexCsv(VendorCsv):
    """An index computed into the 16:15 settlement window."""

    close = (16, 15)

    @classmethod
    def name(cls) -> str:
        return "index_csv"


class ChartJson(SessionFiles):
    """One JSON object of parallel arrays; the open epoch gives the New York session date."""

    @classmethod
    def name(cls) -> str:
        return "chart_json"

    @staticmethod
    def rows(file: BinaryIO) -> Iterator[pd.DataFrame]:
        chart = json.load(file)
        bars = pd.DataFrame({c: chart[c] for c in ("timestamp", *PRICES) if c in chart})
        opened = pd.to_datetime(bars.pop("timestamp"), unit="s", utc=True).dt.tz_convert("America/New_York")
        yield bars.assign(session_date=opened.dt.date).astype({c: "float64" for c in PRICES if c in bars})


FORMATS: dict[str, type[SessionFiles]] = {}


def register(spark: SparkSession, *sources: type[SessionFiles]) -> None:
    """Make providers known to a session as formats; without arguments, the three of this module."""
    for source in sources or (VendorCsv, IndexCsv, ChartJson):
        FORMATS[source.name()] = source
        spark.dataSource.register(source)


def sessions(spark: SparkSession, name: str, path: str, now: Column, **options: str) -> DataFrame:
    """A registered provider's sessions under the session contract, as of ``now``."""
    if name not in FORMATS:
        raise KeyError(f"unknown provider {name!r}; registered: {sorted(FORMATS)}")
    raw = spark.read.format(name).options(**options).load(path)
    return canonical_sessions(raw, F.lit(name), now, *FORMATS[name].close)
