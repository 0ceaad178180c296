"""Quoted CSV cut at every possible place, against Spark's one-task reader."""

import random

import pytest

from tierline.sources import csv_blocks as cb

VALUES = ["a", "bb", "", '"q"', '"a,b"', '"x\ny"', '""', '"he said ""hi"""', '5" pipe', "é", '"é\n\n"', " pad ", '"a"b', '"a" ', 'x"y"z',
          '"\n"', "NULL", '"line ""\n"" end"', "z" * 50, '",\n,"']


@pytest.fixture
def blocks_of(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def one_task(spark, path, encoding):
    df = spark.read.csv(path, header=True, encoding=encoding, mode="PERMISSIVE", quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.replace(cb.BOM, "") for c in df.columns])


def compare(spark, blocks_of, path, encoding, sizes):
    blocks_of(1 << 27)
    want = one_task(spark, path, encoding)
    rows = sorted(map(tuple, want.collect()), key=str)
    for size in sizes:
        blocks_of(size)
        got = cb.read_quoted_csv(spark, path, encoding)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == rows


@pytest.mark.parametrize("seed", range(6))
def test_random_files(spark, blocks_of, tmp_path, seed):
    rng = random.Random(seed)
    encoding, eol, columns = ["UTF-8", "ISO-8859-1"][seed % 2], ["\n", "\r\n"][seed // 3], rng.randint(1, 4)
    lines = [",".join(rng.choice(["h%d", '"h,%d"', f'"h{eol}%d"']) % i for i in range(columns))]
    for _ in range(60):
        lines.append(",".join(rng.choice(VALUES) for _ in range(max(1, columns + rng.choice([0, 0, -1, 1])))))
        lines += [""] * (rng.random() < 0.05)
    data = (eol.join(lines) + eol * (seed % 3 > 0)).encode(encoding)
    path = tmp_path / "f.csv"
    path.write_bytes((b"\xef\xbb\xbf" if encoding == "UTF-8" and seed % 4 == 0 else b"") + data)
    compare(spark, blocks_of, str(path), encoding, [37, 211, 1 << 27])


def test_a_value_over_many_blocks_and_several_files(spark, blocks_of, tmp_path):
    for k in range(3):
        text = f'a,b\n{k},"{"line, with comma" * 3}\n' + "and more\n" * 60 + f'"\nx{k},y\n'
        (tmp_path / f"f{k}.csv").write_text(text)
    compare(spark, blocks_of, str(tmp_path), "UTF-8", [50, 400])


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        cb.read_quoted_csv(spark, str(tmp_path), "UTF-8")


def test_empty_files_and_headers_alone(spark, blocks_of, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert cb.read_quoted_csv(spark, str(tmp_path / "a.csv"), "UTF-8").count() == 0
    (tmp_path / "b.csv").write_text('"a\nb",c\n')
    got = cb.read_quoted_csv(spark, str(tmp_path / "b.csv"), "UTF-8")
    assert got.columns == one_task(spark, str(tmp_path / "b.csv"), "UTF-8").columns and got.count() == 0


def test_effects_of_blocks_add_up(spark):
    """Fixed ends, turns and blocks without effect, against a walk from the first block on."""
    rng = random.Random(5)
    kinds = [(0, 1), (1, 0), (0, 0), (1, 1)]
    rows = [(f, b * 10, *rng.choice(kinds)) for f in range(4) for b in range(40)]
    effects = spark.createDataFrame(rows, "file long, block long, from_between int, from_inside int")
    got = {(r.file, r.block): r.state for r in cb.first_states(effects).collect()}
    for f in range(4):
        state = 0
        for _, block, s, q in sorted(r for r in rows if r[0] == f):
            assert got[f, block] == state
            state = q if state else s


def test_a_large_file_is_read_by_many_tasks(spark, blocks_of, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("id,note\n" + "".join(f'{i},"line one\nline ""two"" {i}"\n' for i in range(20_000)))
    blocks_of(64 << 10)
    df = cb.read_quoted_csv(spark, str(path), "UTF-8")
    assert df.count() == 20_000
    assert df.where("note = concat('line one\nline \"two\" ', id)").count() == 20_000
    lines = cb._lines(spark, str(path))
    assert lines.rdd.getNumPartitions() >= 8
    effects = cb.block_effects(lines).collect()
    assert len(effects) >= 8 and any(r.from_between for r in effects)
