import io
import json
import os

import pytest

from stratavane import cli
from stratavane.config import EngineConfig
from stratavane.engine import Engine

PROGRAM = "EDB_DECL:\nArc(x int, y int)\nIDB_DECL:\nTc(x int, y int)\nRULE_DECL:\nTc(x, y) :- Arc(x, y).\nTc(x, y) :- Tc(x, z), Arc(z, y).\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "p.datalog").write_text(PROGRAM)
    (tmp_path / "Arc.csv").write_text("1|2\n2|3\n3|4\n")
    (tmp_path / "Config.json").write_text(json.dumps({"csv_delimiter": "|", "set_difference": "one_phase"}))
    return tmp_path


def test_a_program_with_a_configuration_file(spark, folder, capsys):
    args = ["--program", str(folder / "p.datalog"), "--input", str(folder), "--config", str(folder / "Config.json")]
    assert cli.main([*args, "--output", str(folder / "out")]) == 0
    assert "Tc 6" in capsys.readouterr().out and any(f.startswith("part-") for f in os.listdir(folder / "out" / "Tc.csv"))
    assert cli.main([*args, "--sql", "SELECT count(*) AS n FROM Tc WHERE x = 1"]) == 0
    assert "|3  |" in capsys.readouterr().out
    assert cli.main([*args, "--explain"]) == 0
    assert "(recursive)" in capsys.readouterr().out


def test_the_configuration_folder_and_the_shell(spark, folder, capsys, monkeypatch):
    monkeypatch.setenv("CONFIG_FILE_DIR", str(folder))
    monkeypatch.setattr("sys.stdin", io.StringIO("SELECT max(y) AS top FROM Tc;\nSELECT nothing\nquit\nSELECT 99 AS late\n"))
    monkeypatch.setattr(cli.shell, "__defaults__", (__import__("sys").stdin,))
    assert cli.main(["--program", str(folder / "p.datalog"), "--input", str(folder), "--mode", "interactive"]) == 0
    out = capsys.readouterr().out
    assert "|4  |" in out and "99" not in out and "nothing" in out.lower()


def test_from_json_rejects_what_it_does_not_know(tmp_path):
    (tmp_path / "c.json").write_text('{"analyse": "full"}')
    with pytest.raises(ValueError, match="unknown settings: analyse"):
        EngineConfig.from_json(str(tmp_path / "c.json"))
    (tmp_path / "c.json").write_text('{"analyze": "minimum", "jobs": 3}')
    assert EngineConfig.from_json(str(tmp_path / "c.json")).jobs == 3


@pytest.mark.parametrize("level", ["minimum", "full"])
def test_statistics_of_stored_tables(spark, level):
    spark.sql("DROP TABLE IF EXISTS Arc")
    spark.createDataFrame([(1, 2), (2, 3)], "x int, y int").write.saveAsTable("Arc")
    try:
        got = Engine(spark, EngineConfig(preload=True, analyze=level)).run(PROGRAM)["Tc"]
        assert got.count() == 3
        told = {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED Arc").collect()}
        assert "2 rows" in told["Statistics"]
        column = {r["info_name"]: r["info_value"] for r in spark.sql("DESCRIBE EXTENDED Arc x").collect()}
        assert (column["max"] == "2") == (level == "full")
    finally:
        spark.sql("DROP TABLE Arc")
