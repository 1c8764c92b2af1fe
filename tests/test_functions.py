import pytest
from pyspark.sql import functions as F

from helixframe.functions import nucleotide as N
from helixframe.functions.params import Params, default_gapless, default_score, default_xdrop, parse_int

M = [0x55555555]
PATHS = [
    (M, 0, 32, "16M"),
    ([0x55550000, *M * 3], 16, 112, "56M"),
    ([0x55555000, *M * 2, 0x55], 12, 92, "46M"),
    ([0x55550555], 0, 32, "6M4D8M"),
    ([0x5555F555], 0, 32, "6M4I8M"),
    ([0xAAAA0555, 0], 0, 33, "6M5D8M"),
    ([0xAAABF555, 0], 0, 33, "6M5I8M"),
    ([0xAAABF555, 0xAAAA0556, 0], 0, 65, "6M5I8M1I5M5D8M"),
    ([0xAAABF554, 0xAAAA0556, 0xAAAAAAAA], 0, 65, "2D5M5I8M1I5M5D8M"),
]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_cigar_of_packed_paths(spark):
    rows = [(i, N.path_string(w, o, n), c) for i, (w, o, n, c) in enumerate(PATHS)]
    df = spark.createDataFrame(rows, "i int, path string, want string")
    for r in df.select("want", N.cigar(F.col("path")).alias("got"), N.cigar_reverse(F.col("path")).alias("rev"), N.cigar_tokens(F.col("path")).alias("t")).collect():
        assert r["got"] == r["want"]
        assert r["rev"] == "".join(reversed(r["t"]))


def test_base_sets(spark):
    letters = "ACGTURYKMBVDHSWNx"
    rows = spark.createDataFrame([(c,) for c in letters + letters.lower()], "c string")
    got = {r["c"]: r for r in rows.select("c", N.encode_4bit(F.col("c")).alias("n"), N.encode_2bit(F.col("c")).alias("b"), N.encode_4bit_text(F.col("c")).alias("h")).collect()}
    want = dict(zip(letters, (1, 2, 4, 8, 8, 5, 10, 12, 3, 14, 7, 13, 11, 6, 9, 0, 0)))
    for c, r in got.items():
        assert r["n"] == want.get(c.upper(), 0), c
        assert int(r["h"], 16) == r["n"]
        assert r["b"] == {"C": 1, "G": 2, "T": 3, "U": 3}.get(c.upper(), 0)


def test_decode_and_complement(spark):
    rows = spark.range(15).select(F.col("id").cast("int").alias("n"))
    for r in rows.select("n", N.decode_4bit(F.col("n")).alias("c"), N.complement_4bit(F.col("n")).alias("m")).collect():
        assert r["c"] == "NACMGRSVTWYHKDBN"[r["n"]]
        assert r["m"] == int(f"{r['n']:04b}"[::-1], 2)


def test_revcomp_and_pack(spark):
    assert one(spark, N.revcomp(F.col("s")), s="ACVVGTGT") == "ACACBBGT"
    assert one(spark, N.revcomp(F.col("s")), s="") == ""
    assert one(spark, N.pack_kmer(F.col("s")), s="CGGT") == 1 | 2 << 2 | 2 << 4 | 3 << 6
    assert one(spark, N.mirror(F.col("n"), F.col("p")), n=10, p=3) == 16


def test_gids(spark):
    row = spark.range(1).select(N.gid(F.lit(7), F.lit(1)).alias("g")).select("g", N.gid_segment(F.col("g")).alias("s"), N.gid_direction(F.col("g")).alias("d"), N.gid_reverse(F.col("g")).alias("r")).first()
    assert tuple(row) == (15, 7, 1, 14)


@pytest.mark.parametrize("text,want", [("H\tVN:Z:1.0", 0x10000), ("H\tVN:Z:1.2.3", 0x10203), ("H\tVN:Z:0.9", 0x900), ("H\tXX:i:1", None)])
def test_version(spark, text, want):
    assert one(spark, N.version(F.col("s")), s=text) == want


def test_windows(spark):
    assert one(spark, N.windows(F.col("s"), 3), s="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, N.windows(F.col("s"), 3), s="AC") == []


def test_defaults():
    assert (default_gapless(1, 2), default_xdrop(1, 2, 1), default_score(1)) == (10, 47, 100)
    p = Params().resolved()
    assert (p.gapless, p.xdrop, p.score) == (10, 47, 100)
    assert Params(score=1).resolved().score == 1


@pytest.mark.parametrize("text,want", [("10", 10), ("0x1f", 31), ("0b101", 5), ("0d12", 12), ("017", 15), ("-3", -3), ("0", 0)])
def test_parse_int(text, want):
    assert parse_int(text) == want


def test_parse_int_refuses_suffix():
    with pytest.raises(ValueError):
        parse_int("10K")


@pytest.mark.parametrize("bad", [{"k": 3}, {"k": 33}, {"m": 0}, {"gi": 1, "ge": 2}, {"gi": 7, "ge": 1}, {"gi": 0, "ge": 200}, {"xdrop": 128}, {"clip": "X"}])
def test_limits(bad):
    with pytest.raises(ValueError):
        Params(**bad)
