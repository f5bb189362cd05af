import math

import pytest

from kestrel.sources import csv_matrix


def _write(path, text, newline="\n"):
    with open(path, "w", newline="") as fh:
        fh.write(text.replace("\n", newline))


def test_csv_oddities_become_nan(spark, tmp_path):
    p = tmp_path / "x.csv"
    _write(p, "1,2.5,x\n#c\n\n3,,4\n")
    rows = sorted(csv_matrix.read_matrix(spark, str(p)).collect())
    assert [r.row_id for r in rows] == [0, 1]
    a, b = rows[0].features, rows[1].features
    assert a[:2] == [1.0, 2.5] and math.isnan(a[2])
    assert b[0] == 3.0 and math.isnan(b[1]) and b[2] == 4.0


def test_ragged_csv_fails(spark, tmp_path):
    p = tmp_path / "r.csv"
    _write(p, "1,2\n3\n")
    with pytest.raises(ValueError, match="ragged"):
        csv_matrix.read_matrix(spark, str(p))


def test_positional_ids_across_files_and_crlf_labels(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    _write(d / "part-0.csv", "".join(f"{i},{i * 2}\n" for i in range(0, 50)))
    _write(d / "part-1.csv", "".join(f"{i},{i * 2}\n" for i in range(50, 120)))
    lab = tmp_path / "y.csv"
    _write(lab, "".join(f"{i % 2}\n" for i in range(120)), newline="\r\n")
    df = csv_matrix.read_labelled(spark, str(d), str(lab))
    rows = df.collect()
    assert len(rows) == 120
    for r in rows:
        assert r.features[0] == r.row_id
        assert r.label == r.row_id % 2


def test_positional_ids_over_many_splits(spark, tmp_path):
    p = tmp_path / "big.csv"
    n = 30000
    _write(p, "".join(f"{i},1\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        m = csv_matrix.read_matrix(spark, str(p))
        assert m.rdd.getNumPartitions() > 5
        bad = m.filter("features[0] != row_id").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bad == 0


def test_positional_join_length_mismatch(spark, tmp_path):
    x = tmp_path / "x.csv"
    y = tmp_path / "y.csv"
    _write(x, "1,2\n3,4\n5,6\n")
    _write(y, "1\n0\n")
    with pytest.raises(ValueError, match="positional join"):
        csv_matrix.read_labelled(spark, str(x), str(y))
