import numpy as np
import pytest

from rangelake import cli
from rangelake.sources import blockfile as B


@pytest.fixture
def data(tmp_path):
    rng = np.random.default_rng(2)
    for rank in (0, 1):
        own = [(np.sort(rng.uniform(0, 20, 50)).astype("<f4"), np.zeros((50, 4), np.uint8)) for _ in range(3)]
        B.write_file(str(tmp_path / "in"), rank, {0: own, 1: own}, 4)
    return tmp_path


def test_commands(spark, data, capsys):
    i = str(data / "in")
    assert cli.run(spark, ["query", "-i", i, "-e", "0", "-x", "5", "-y", "6", "--candidates", "--log", str(data / "log")]) == 0
    assert cli.run(spark, ["scan", "-i", i, "-e", "1", "-x", "5", "-y", "6"]) == 0
    (data / "q.csv").write_text("0,1,2\n1,3,4\n")
    assert cli.run(spark, ["batch", "-i", i, "-b", str(data / "q.csv")]) == 0
    assert cli.run(spark, ["analyze", "-i", i, "-q", str(data / "plan"), "-o", str(data / "curves")]) == 0
    assert cli.run(spark, ["check", "-i", i]) == 0
    assert cli.run(spark, ["compact", "-i", i, "-e", "1"]) == 0
    assert spark.read.parquet(i + ".merged").count() == 300
    assert "key_selectivity" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.run(spark, ["query", "-i", i, "-x", "1", "-y", "2"])
