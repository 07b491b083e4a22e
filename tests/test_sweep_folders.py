import pytest

from pairloom.sources import read_sweep, read_sweeps


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "fed.csv").write_text('"Name","a.kl","winrate","note"\n"r1","0.5","1",""\n"r2","2","0.25","x, ""y"""\n')
    (tmp_path / "single.csv").write_text('"a.kl","Name","every-n","winrate"\n"1","r3","7","0"\n')
    (tmp_path / "twin.csv").write_text('"a.kl","Name","every-n","winrate"\n"3","r4","9","12345678901"\n')
    (tmp_path / "more.csv").write_text('Name,flag,at\nr5,true,2024-01-02 03:04:05\n')
    (tmp_path / "none.csv").write_text("Name,empty\n")
    (tmp_path / "blank.csv").write_text("")
    return tmp_path


def test_unlike_files_in_one_table(spark, folder):
    df = read_sweeps(spark, str(folder))
    assert dict(df.dtypes) == {
        "Name": "string", "a_kl": "double", "winrate": "double", "note": "string", "every_n": "int",
        "flag": "boolean", "at": "timestamp", "empty": "string", "export": "string",
    }
    rows = {r.Name: r for r in df.collect()}
    assert {name: r.export for name, r in rows.items()} == {
        "r1": "fed", "r2": "fed", "r3": "single", "r4": "twin", "r5": "more",
    }
    assert (rows["r2"].a_kl, rows["r2"].note, rows["r2"].every_n) == (2.0, 'x, "y"', None)
    assert (rows["r4"].every_n, rows["r4"].winrate, rows["r1"].note) == (9, 12345678901.0, None)
    assert rows["r5"].flag is True and rows["r5"].a_kl is None


def test_types_of_one_file_are_those_of_read_sweep(spark, folder):
    path = str(folder / "single.csv")
    one, folder_like = read_sweep(spark, path), read_sweeps(spark, path, label=None)
    assert one.dtypes == folder_like.dtypes and one.collect() == folder_like.collect()


def test_each_file_is_read_once(spark, folder, monkeypatch):
    """The table is written while its types are found; what is read afterwards is the written one."""
    df = read_sweeps(spark, str(folder))
    assert not any(file.endswith(".csv") for file in df.inputFiles())


def test_files_that_do_not_fit(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_sweeps(spark, str(tmp_path / "nowhere"))
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(ValueError, match="no exports"):
        read_sweeps(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("a.b,a-b\n1,2\n")
    with pytest.raises(ValueError, match="a_b"):
        read_sweeps(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("export\n1\n")
    with pytest.raises(ValueError, match="choose another label"):
        read_sweeps(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("x,y\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_sweeps(spark, str(tmp_path))


def test_line_breaks_in_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"n","t"\n"1","one\ntwo"\n')
    (tmp_path / "b.csv").write_text('"t"\n"three"\n')
    rows = read_sweeps(spark, str(tmp_path), multi_line=True).collect()
    assert {(r.n, r.t, r.export) for r in rows} == {(1, "one\ntwo", "a"), (None, "three", "b")}
