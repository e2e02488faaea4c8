import brute_shards
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

from skyframe.sources import delimited as dl
from skyframe.sources import shards
from skyframe.sources.shards import ShardSet

RAW = "raw_id long, shard_id long, line_no int, line string, names string"
FILES = "shard_id long, feed string, seq int, column_spec string, names string"


def make(spark, made):
    """made: list of (feed, seq, spec, lines)."""
    raw, files, n = [], [], 0
    for s, (feed, seq, spec, lines) in enumerate(made, 1):
        files.append((s, feed, seq, spec, "clash"))
        for k, line in enumerate(lines, 1):
            n += 1
            raw.append((n, s, k, line, "clash"))
    return spark.createDataFrame(raw, RAW), spark.createDataFrame(files, FILES), raw, files


def both(spark, made, repeat=1):
    raw, files, r, f = make(spark, made)
    for _ in range(repeat - 1):
        raw = raw.union(raw)
    got = ShardSet(raw, files)
    p4, p5 = brute_shards.solve([x[:4] for x in r], [x[:4] for x in f])
    assert {tuple(x) for x in got.changes().collect()} == p4
    rejects = [(x["raw_id"], x["reason"]) for x in got.rejected().collect()]
    assert len(rejects) == len(set(rejects)) and set(rejects) == p5
    return got, p4, p5


HEAD = "source_id,ra,dec,phot_g_mean_mag,pmra,pmdec"
BAD = [
    "# note", "", None, "   ", HEAD, "1,10.5,20.25,12.125,1,2", "2,10.5,20.25,null,,NULL", "3,361,0,1,1,1", "4,-0.1,0,1,1,1", "5,0,90.5,1,1,1", "6,,0,1,1,1", "7,0,null,1,1,1",
    "8,1e2, +5.E0 ,.5,-1e-3,2", "9,1,2,nan,1,1", "10,1,2,1,Infinity,1", "11,1,2,1,1,1e999", "12,1,2,3,4", "13,1,2,3,4,5,6", '14,"1",2,3,4,5', '15,"1,2,3,4,5', '16,1 "x",2,3,4,5', '17,"1"x,2,3,4,5',
    '"18 ""q""",1,2,3,4,5', "19,1,2,3,4,5   ", "20,1,2,3,٣,5", "21,0x10,2,3,4,5", "22,1_0,2,3,4,5", '23,"",2,3,4,5', ",,,,,", "24,360,-90,1,1,x",
]


@pytest.mark.parametrize("few", [0, 1000])
def test_reasons_in_order(spark, monkeypatch, few):
    monkeypatch.setattr(shards, "FEW_SHARDS", few)
    got, _, p5 = both(spark, [("f", 1, None, BAD)], repeat=2)
    why = dict(p5)
    assert why[8] == "bad_ra" and why[17] == "field_count" and why[20] == "quoting" and why[30] == "bad_pmdec"
    good = {r["source_id"]: r for r in got.loaded().collect()}
    assert good[2]["mag"] is None and good[8]["dec"] == 5.0 and good[19]["pmdec"] == 5.0


def rows(rng, n=30):
    return [[str(10**15 + i), f"{rng.uniform(0, 360):.9f}", f"{rng.uniform(-90, 90):.9f}", f"{rng.uniform(5, 20):.6f}", f"{rng.normal():.7f}", f"{rng.normal():.7f}", f"{rng.uniform():.8f}"] for i in range(n)]


def shard(names, data):
    return [",".join(names), *[",".join(r) for r in data]]


def test_chained_renames_removals_and_types(spark):
    a, names = rows(np.random.default_rng(1)), HEAD.split(",") + ["err"]
    ren = lambda old, new, ns: [new if x == old else x for x in ns]
    n2 = ren("ra", "RAJ", names)
    n3 = ren("RAJ", "alpha", n2)
    milli = [[*r[:3], str(int(float(r[3]) * 1000)), *r[4:]] for r in a]
    other = [[*r[:6], f"{float(r[6]) + 1:.8f}"] for r in a]
    got, p4, p5 = both(spark, [
        ("f", 1, None, shard(names, a)), ("f", 2, None, shard(n2, a)), ("f", 4, None, shard(n3, a)), ("f", 5, None, shard(n3, milli)),
        ("f", 6, None, shard(ren("err", "err2", n3), other)), ("g", 1, "ra=foo, mag=bar", shard(["foo", "dec", "bar", "pmra", "pmdec"], [r[1:6] for r in a])), ("g", 2, None, shard(["foo", "dec", "baz", "pmra", "pmdec"], [r[1:6] for r in a])),
    ])
    assert (2, "renamed", "ra", "RAJ") in p4 and (3, "renamed", "RAJ", "alpha") in p4 and (4, "retyped", "phot_g_mean_mag", "phot_g_mean_mag") in p4
    assert (5, "removed", "err", "") in p4 and (5, "added", "", "err2") in p4 and (7, "renamed", "bar", "baz") in p4
    assert not p5
    last = got.loaded().where("shard_id = 7").first()
    assert last["mag"] is not None and set(last["decimals"]) == {"ra", "dec", "mag", "pmra", "pmdec"} and not last["integers"] and not last["texts"]
    assert [r["version"] for r in got.versions().where("feed = 'f'").orderBy("seq").collect()] == [1, 2, 3, 4, 5]
    steps = [tuple(r)[1:-1] for r in got.steps().where("feed = 'f'").orderBy("version", "step").collect()]
    assert steps == [
        (2, 2, "rename", "ra", "RAJ", "decimal", "decimal"), (3, 3, "rename", "RAJ", "alpha", "decimal", "decimal"), (4, 4, "cast", "phot_g_mean_mag", "phot_g_mean_mag", "decimal", "integer"),
        (5, 5, "cast", "phot_g_mean_mag", "phot_g_mean_mag", "integer", "decimal"), (5, 5, "default", "", "err2", None, "decimal"), (5, 5, "drop", "err", "", "decimal", None),
    ]
    # every change comes from a step, and a file with the fingerprint of the one before it has none
    assert {r["shard_id"] for r in got.changes().collect()} <= {r["shard_id"] for r in got.steps().collect()}
    one = got.loaded().where("shard_id = 4").first()
    assert one["decimals"]["mag"] == float(milli[0][3]) or one["mag"] in {float(r[3]) for r in milli}
    assert one["decimals"]["err2"] is None and set(one["integers"]) == {"source_id"}


def test_versions_follow_names_and_types(spark):
    a = rows(np.random.default_rng(4))
    names = HEAD.split(",") + ["err"]
    empty = [[*r[:6], ""] for r in a]
    whole = [[*r[:6], str(i)] for i, r in enumerate(a)]
    text = [[*r[:6], f"x{i}"] for i, r in enumerate(a)]
    got, p4, _ = both(spark, [("f", 1, None, shard(names, a)), ("f", 2, None, shard(names[::-1], [r[::-1] for r in a])), ("f", 3, None, shard(names, empty)), ("f", 4, None, shard(names, whole)), ("f", 5, None, shard(names, text))])
    # order and missing values make no version; the type of err changes past a file without values, which no report demands
    assert [r["version"] for r in got.versions().orderBy("seq").collect()] == [1, 1, 1, 2, 3]
    assert {(r["version"], r["step"], r["from_type"], r["to_type"], r["reported"]) for r in got.steps().collect()} == {(2, "cast", "decimal", "integer", False), (3, "cast", "integer", "text", True)}
    assert p4 == {(5, "retyped", "err", "err")}
    first = got.loaded().where("shard_id = 1").first()
    assert set(first["texts"]) == {"err"} and float(first["texts"]["err"]) < 1


def test_all_names_change_at_once(spark):
    a = rows(np.random.default_rng(2))
    names = [f"n{i}" for i in range(7)]
    raw, files, _, _ = make(spark, [("f", 1, None, shard(HEAD.split(",") + ["err"], a)), ("f", 2, None, shard(names, a))])
    got = {tuple(r) for r in ShardSet(raw, files).changes().collect()}
    assert got == {(2, "renamed", o, n) for o, n in zip(HEAD.split(",") + ["err"], names)}


def test_empty_tables_and_lines_without_a_file(spark):
    empty = ShardSet(spark.createDataFrame([], RAW), spark.createDataFrame([], FILES))
    assert empty.changes().count() == 0 and empty.rejected().count() == 0 and empty.loaded().count() == 0
    raw, _, _, _ = make(spark, [("f", 1, None, [HEAD, "1,2,3,4,5,6", "x"])])
    alone = ShardSet(raw, spark.createDataFrame([], FILES))
    assert [r["reason"] for r in alone.rejected().collect()] == ["field_count"]
    assert alone.loaded().count() == 1


def test_long_fields(spark):
    both(spark, [("f", 1, None, [HEAD + ",note", "1,2,3,4,5,6," + "z" * 200_000, '2,2,3,4,5,6,"' + "y," * 100_000 + '"'])])


@pytest.mark.parametrize("text,value", [("1", 1.0), ("+1.5e3", 1500.0), (".5", 0.5), ("5.", 5.0), ("1e400", None), ("NaN", None), ("", None), ("1,5", None)])
def test_numbers(text, value):
    got = dl.numbers(pa.array([text]))[0]
    assert got == value if value is not None else np.isnan(got)


def test_the_smallest_tables(spark):
    c = duckdb.connect()
    raw = c.execute(f"select raw_id, shard_id, line_no, line from '{DATA}/raw_lines.parquet'").fetchall()
    files = c.execute(f"select shard_id, feed, seq, column_spec from '{DATA}/shard_files.parquet'").fetchall()
    p4, p5 = brute_shards.solve(raw, files)
    got = ShardSet(spark.read.parquet(f"{DATA}/raw_lines.parquet"), spark.read.parquet(f"{DATA}/shard_files.parquet"))
    assert {tuple(r) for r in got.changes().collect()} == p4
    assert {(r["raw_id"], r["reason"]) for r in got.rejected().collect()} == p5
