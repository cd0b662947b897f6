import datetime
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sitescope.operators.entities import first_claims, first_come
from sitescope.sources.export import NoExport, export, flattened, manifest, read_export

SCHEMA = (
    "id long, name string, score double, tags array<string>, place struct<city:string,at:struct<lat:double,zip:string>>, raw binary, "
    "seen timestamp_ntz, flag boolean, extra map<string,int>"
)
ROWS = [
    (1, "plain", 1.5, ["a", "b,c"], ("X", (1.25, "007")), b"\x00\xff", datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), True, {"k": 1}),
    (2, 'quote " and, comma\nnew line', 1e-17, [], ("", (None, None)), b"", None, False, {}),
    (3, "", float("inf"), None, None, None, datetime.datetime(1999, 12, 31), None, None),
    (4, None, None, ["", None, "é漢"], (None, None), b"x", None, True, {"a": None}),
    (5, "  blanks \t", -0.5, ['"'], ("\\", (0.0, "")), None, None, None, None),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_json_keeps_everything(spark, frame, tmp_path):
    export(frame, str(tmp_path / "e"), "json")
    assert rows(read_export(spark, str(tmp_path / "e"), check=True)) == rows(frame)


def test_csv_is_flat_and_typed(spark, frame, tmp_path):
    done = export(frame, str(tmp_path / "e"), "csv", [F.asc("id")], file_rows=2)
    back = read_export(spark, str(tmp_path / "e"), check=True)
    assert back.columns == ["id", "name", "score", "tags", "place.city", "place.at.lat", "place.at.zip", "raw", "seen", "flag", "extra"]
    got = {r[0]: list(r)[1:] for r in back.collect()}
    assert got[1] == ["plain", 1.5, ["a", "b,c"], "X", 1.25, "007", b"\x00\xff", ROWS[0][6], True, {"k": 1}]
    assert got[2][:5] == ['quote " and, comma\nnew line', 1e-17, [], "", None] and got[3][0] == "" and got[4][0] is None
    assert got[3][1] == float("inf") and got[4][2] == ["", None, "é漢"] and got[5][0] == "  blanks \t" and got[5][3:6] == ["\\", 0.0, ""]
    assert done.rows == 5 and len(list((tmp_path / "e" / "data" / done.run).glob("part-*.csv"))) >= 3
    assert flattened(frame).columns == back.columns


def test_only_finished_exports_are_read(spark, frame, tmp_path):
    folder = str(tmp_path / "e")
    with pytest.raises(NoExport):
        read_export(spark, folder)
    first = export(frame.where("id < 3"), folder, "json")
    frame.select("id", "name").write.json(f"{folder}/data/broken-off")
    assert manifest(spark, folder).run == first.run and read_export(spark, folder).count() == 2
    time.sleep(0.01)
    second = export(frame, folder, "csv")
    assert manifest(spark, folder).run == second.run and read_export(spark, folder, check=True).count() == 5
    file = next((tmp_path / "e" / "data" / second.run).glob("part-*.csv"))
    spark.range(3).write.csv(f"{folder}/data/{second.run}/more")
    file.write_text("\n".join(file.read_text().split("\n")[:1]))
    (file.parent / f".{file.name}.crc").unlink()
    with pytest.raises(ValueError):
        read_export(spark, folder, check=True)


def test_empty_and_unknown_format(spark, frame, tmp_path):
    assert export(frame.limit(0), str(tmp_path / "e"), "csv").rows == 0
    assert read_export(spark, str(tmp_path / "e"), check=True).collect() == []
    with pytest.raises(ValueError):
        export(frame, str(tmp_path / "e"), "xlsx")


def test_a_long_chain_of_claims_needs_no_rounds(spark):
    """Every request shares a hostname with the next: 10,000 of them as fast as ten, and none that serial service would refuse for an accepted one."""

    def chain(n):
        return spark.range(n).select(F.col("id").alias("request_id"), F.explode(F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string"))).alias("hostname"))

    first_claims(chain(10)).collect()
    begin = time.perf_counter()
    assert [r[0] for r in first_claims(chain(10)).collect()] == [0]
    short, begin = time.perf_counter() - begin, time.perf_counter()
    assert [r[0] for r in first_claims(chain(10_000)).collect()] == [0]
    assert time.perf_counter() - begin < 5 * short + 2
    mixed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (4, "d"), (5, "d"), (6, "e")], "request_id long, hostname string")
    assert sorted(r[0] for r in first_claims(mixed).collect()) == [1, 4, 6]
    assert sorted(r[0] for r in first_come(mixed).collect()) == [1, 3, 4, 6]
