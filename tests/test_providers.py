"""Session providers as data sources."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.sources import providers


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_vendor_and_index_files(spark, tmp_path):
    providers.register(spark)
    write(tmp_path / "symbol=A%20B" / "1.csv", "DATE, Open ,high,LOW,close,Volume,note\n2024-01-02,1,2,0.5,1.5,10,x\njunk,1,1,1,1,1,x\n2024-01-03,.,2,1,1,1,x\n")
    write(tmp_path / "symbol=A%20B" / "2.csv", "date,open,high,low,close\n2024-01-04,3,4,2,3.5\n")
    write(tmp_path / "symbol=C" / "1.csv", "date,open,high,low,close,volume\n2024-01-02,5,6,4,5.5,7\n2024-03-01,1,1,1,1,1\n")
    write(tmp_path / "symbol=C" / "_SUCCESS", "")
    write(tmp_path / "symbol=__HIVE_DEFAULT_PARTITION__" / "1.csv", "date,open,high,low,close,volume\n2024-01-02,1,1,1,1,1\n")
    raw = spark.read.format("vendor_csv").load(str(tmp_path))
    assert raw.rdd.getNumPartitions() == 3 and raw.count() == 6
    got = {(r["symbol"], str(r["session_date"]), r["close"], r["volume"], r["source"]) for r in providers.sessions(spark, "vendor_csv", str(tmp_path), now()).collect()}
    assert got == {("A B", "2024-01-02", 1.5, 10.0, "vendor_csv"), ("A B", "2024-01-04", 3.5, None, "vendor_csv"),
                   ("C", "2024-01-02", 5.5, 7.0, "vendor_csv"), (None, "2024-01-02", 1.0, 1.0, "vendor_csv")}
    ends = {n: providers.sessions(spark, n, f"file://{tmp_path}", now(), symbols="C").select(F.date_format("bar_end", "HH:mm")).collect() for n in ("vendor_csv", "index_csv")}
    assert [[r[0] for r in e] for e in ends.values()] == [["21:00"], ["21:15"]]


def test_chart_files(spark, tmp_path):
    providers.register(spark)
    at = [int(pd.Timestamp(f"2024-01-0{d} 14:30", tz="UTC").timestamp()) for d in (2, 3)]
    write(tmp_path / "chart.json", json.dumps({"timestamp": at, "open": [1, None], "high": [2, 2], "low": [1, 1], "close": [1.5, 2], "volume": [3, None]}))
    rows = spark.read.format("chart_json").option("symbol", "X").load(str(tmp_path)).orderBy("session_date").collect()
    assert [(r["symbol"], str(r["session_date"]), r["open"], r["volume"]) for r in rows] == [("X", "2024-01-02", 1.0, 3.0), ("X", "2024-01-03", None, None)]


def test_own_provider_and_faults(spark, tmp_path):
    class PipeText(providers.SessionFiles):
        @classmethod
        def name(cls):
            return "pipe_text"

        @staticmethod
        def rows(file):
            import pandas as pd

            f = pd.read_csv(file, sep="|")
            yield f.assign(session_date=pd.to_datetime(f["session_date"]).dt.date)

    providers.register(spark)
    providers.register(spark, PipeText)
    write(tmp_path / "good" / "symbol=P" / "a.txt", "session_date|open|high|low|close|volume\n2024-01-02|1|2|1|2|5\n")
    assert providers.sessions(spark, "pipe_text", str(tmp_path / "good"), now()).first()["close"] == 2.0
    write(tmp_path / "bad" / "symbol=P" / "a.txt", "session_date|open|high|low\n2024-01-02|1|2|1\n")
    with pytest.raises(Exception, match="has no close"):
        providers.sessions(spark, "pipe_text", str(tmp_path / "bad"), now()).collect()
    (tmp_path / "none").mkdir()
    assert providers.sessions(spark, "vendor_csv", str(tmp_path / "none"), now()).count() == 0
    with pytest.raises(KeyError, match="unknown provider"):
        providers.sessions(spark, "nope", str(tmp_path), now())
