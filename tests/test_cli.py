import random

import pytest

from helixframe import cli
from helixframe.functions.params import Params

g = random.Random(21)
SEQ = "".join(g.choice("ACGT") for _ in range(200))


def wrap(s):
    return "\n".join(s[i : i + 80] for i in range(0, len(s), 80))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("seqs")
    (d / "ref.fa").write_text(f"> seq1\n{wrap(SEQ)}\n")
    far = "".join(g.choice("ACGT") for _ in range(60))
    (d / "reads.fa").write_text(f"> read1\n{wrap(SEQ[80:160])}\n> read2\n{wrap(SEQ[50:130])}\n> read3\n{wrap(SEQ[130:])}\n> far\n{far}\n")

    def gfa(names, cuts):
        a, b = cuts
        x, y, z = names
        return f"H\tVN:Z:1.0\nS\t{x}\t{SEQ[:a]}\nS\t{y}\t{SEQ[a:b]}\nS\t{z}\t{SEQ[b:]}\nL\t{x}\t+\t{y}\t+\t0M\nL\t{y}\t+\t{z}\t+\t0M\nL\t{x}\t+\t{z}\t+\t0M\n"

    (d / "g1.gfa").write_text(gfa(("11", "12", "13"), (80, 160)))
    (d / "g2.gfa").write_text(gfa(("14", "15", "16"), (90, 150)))
    return d


def test_sam_of_linear_reads(spark, files):
    lines = [r["line"].split("\t") for r in cli.run(spark, str(files / "ref.fa"), str(files / "reads.fa"), Params(score=1), "sam").collect()]
    body = [x for x in lines if not x[0].startswith("@")]
    assert lines[1] == ["@SQ", "SN:seq1", "LN:200"]
    got = {x[0]: (x[1], x[3], x[5], x[9]) for x in body}
    assert got == {"read1": ("0", "81", "80M", SEQ[80:160]), "read2": ("0", "51", "80M", SEQ[50:130]), "read3": ("0", "131", "70M", SEQ[130:]), "far": ("4", "0", "*", got["far"][3])}


def test_gpa_of_graphs(spark, files):
    lines = [r["line"].split("\t") for r in cli.run(spark, str(files / "g1.gfa"), str(files / "g2.gfa"), Params(score=1), "gpa").collect()]
    assert lines[0] == ["H", "VN:Z:0.1"]
    whole = [x for x in lines[1:] if x[5] == "+" and x[9] == "+"]
    assert {(x[2], x[6]) for x in whole} >= {("11", "14"), ("12", "14"), ("12", "15"), ("12", "16"), ("13", "16")}
    first = next(x for x in whole if x[2] == "11" and x[6] == "14")
    assert (first[3], first[4], first[7], first[8], first[10]) == ("0", "80", "0", "80", "80M")


def test_self_and_unmapped(spark, files):
    lines = [r["line"] for r in cli.run(spark, str(files / "ref.fa"), None, Params(score=1), "sam", unmapped=False).collect()]
    assert [x.split("\t")[5] for x in lines if not x.startswith("@")] == ["200M"]


def test_commands(spark, files, tmp_path, capsys):
    out = str(tmp_path / "out.sam")
    assert cli.main(["-m1", str(files / "ref.fa"), str(files / "reads.fa"), "-o", out]) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "out.sam").glob("part-*")))
    assert "read1\t0\tseq1\t81\t255\t80M" in text and "-k14 -r30 -d3" in capsys.readouterr().err
    assert cli.main(["index", str(files / "ref.fa")]) == 1
    assert cli.main(["bwa", "index", str(files / "ref.fa")]) == 1
    assert cli.main(["bwa", "mem", "-P", str(files / "ref.fa"), str(files / "reads.fa")]) == 1
    assert cli.main(["bwa", "mem", str(files / "ref.fa"), str(files / "reads.fa")]) == 0
    assert "read2\t0\tseq1\t51\t255\t80M" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["align", str(files / "ref.fa"), "-o", "x.bam"])
