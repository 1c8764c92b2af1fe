import pytest
from pyspark.sql import functions as F

from helixframe.operators import graph as G
from helixframe.plans.queries import tiny_graph


def spell(*classes):
    out = [""]
    for c in classes:
        out = [p + x for p in out for x in c]
    return out


ACG = "ACG"
# (section, place, whether the path goes straight to the last section) -> k-mers
WANT = {
    (0, 0, False): ["GGAA", "GGGA"],
    (0, 1, False): ["GAAA", "GGAA", "GAAC", "GGAC"],
    (0, 2, False): ["AAAA", "GAAA", "AACA", "GACA"],
    (0, 3, False): ["AAAC", "ACAC"],
    (0, 1, True): ["GAAA", "GGAA"],
    (0, 2, True): ["AAAC", "GAAC"],
    (0, 3, True): ["AACA", "AACC", "AACG"],
    (2, 0, True): spell("AC", "A", "C", ACG),
    (4, 0, False): spell("A", "C", ACG, ACG),
    (4, 1, False): spell("C", ACG, ACG, "G"),
    (4, 2, False): spell(ACG, ACG, "G", "T"),
    (4, 3, False): spell(ACG, "G", "T", "G"),
    (4, 4, False): ["GTGT"],
}


def test_kmers_along_paths(spark):
    got = {}
    for r in G.graph_kmers(tiny_graph(spark), 4).collect():
        got.setdefault((r["gid"], r["pos"], r["route"][:1] == [4]), []).append(r["kmer"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in WANT.items()}


def test_unknown_bases_break_windows(spark):
    segs = spark.createDataFrame([("sec0", "GGRANNNNGTTCANNNNNAAAAT", 0), ("sec1", "TNNNCCCCC", 1)], "name string, seq string, o long")
    links = spark.createDataFrame([("sec0", 0, "sec1", 0, 2)], "src string, src_ori int, dst string, dst_ori int, o long")
    rows = G.graph_kmers(G.build(segs, links, "o"), 4).select("gid", "pos", "kmer").collect()
    want = [(0, 0, "GGAA"), (0, 0, "GGGA"), (0, 8, "GTTC"), (0, 9, "TTCA"), (0, 18, "AAAA"), (0, 19, "AAAT"), (0, 20, "AATT"), (2, 4, "CCCC"), (2, 5, "CCCC")]
    assert sorted(map(tuple, rows)) == sorted(want)


@pytest.fixture(scope="module")
def second(spark):
    segs = spark.createDataFrame([("sec0", "GGRA", 0), ("sec1", "MGGG", 1), ("sec2", "ACVVGTGT", 4)], "name string, seq string, o long")
    links = spark.createDataFrame([("sec0", 0, "sec1", 0, 2), ("sec1", 0, "sec2", 0, 3), ("sec0", 0, "sec2", 0, 5)], "src string, src_ori int, dst string, dst_ori int, o long")
    return G.build(segs, links, "o")


def test_successors_and_totals(second):
    assert {r["gid"]: r["succ"] for r in second.successors().collect()} == {0: [2, 4], 1: [], 2: [4], 3: [1], 4: [], 5: [3, 1]}
    assert tuple(second.total_length().first()) == (3, 16)


def test_index_and_match(second):
    kmers = G.graph_kmers(second, 4, both_strands=True)
    assert [tuple(r) for r in G.match(kmers, "GTGT").collect()] == [(4, 4), (5, 4)]
    assert [tuple(r) for r in G.match(kmers, "CGGG").collect()] == [(2, 0), (4, 1), (5, 3)]
    hit = G.index(kmers).filter("kmer = 'CGGG'").first()
    assert [(h["gid"], h["pos"]) for h in hit["hits"]] == [(2, 0), (4, 1), (5, 3)] and hit["n"] == 3


def test_linear_index_equals_plain_windows(spark):
    rows = spark.createDataFrame([(1, "ACGTNACGTA"), (2, ""), (3, "ACG")], "id int, seq string")
    assert sorted(map(tuple, G.linear_kmers(rows, "id", "seq", 4).collect())) == [(1, 0, "ACGT"), (1, 5, "ACGT"), (1, 6, "CGTA")]


def test_names_in_order_of_first_mention(spark):
    rows = spark.createDataFrame([("b", 3), ("a", 1), ("b", 0), ("c", 2)], "name string, o int")
    assert {r["name"]: r["id"] for r in G.dictionary(rows, "name", "o").collect()} == {"b": 0, "a": 1, "c": 2}


def test_later_segment_replaces_and_links_may_name_unknown(spark):
    segs = spark.createDataFrame([("x", "AAAA", 1), ("x", "CC", 2)], "name string, seq string, o long")
    links = spark.createDataFrame([("y", 0, "x", 1, 0)], "src string, src_ori int, dst string, dst_ori int, o long")
    g = G.build(segs, links, "o")
    assert {(r["gid"], r["name"], r["seq"]) for r in g.sections.collect()} == {(0, "y", ""), (1, "y", ""), (2, "x", "CC"), (3, "x", "GG")}
    assert {(r["src"], r["dst"]) for r in g.edges.select("src", "dst").collect()} == {(0, 3), (2, 1)}
    assert G.expand(spark.createDataFrame([("RN",), ("RA",)], "kmer string")).select(F.sort_array(F.collect_list("kmer"))).first()[0] == ["AA", "GA"]
