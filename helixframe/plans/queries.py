"""Registered queries of the sequence operators, and their SQL.

The driver's tables hold no nucleotides, so texts are mapped to them
(:func:`~helixframe.functions.nucleotide.dna`); every query reads whole tables
and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nucleotide as N
from ..functions.params import Params
from ..functions.storage import fresh, positions
from ..operators import align, graph, intervals, mapper, ordering, seeds
from ..sources import readers, writers
from ..streaming.drain import drain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K, REPEAT = 14, 30


def query(sql: str | None = None):
    def keep(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def days(c: str):
    return F.unix_date(F.col(c).cast("date"))


# SQL shared by the oracles

_DNA = "upper(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac'))"
_SEEDS = f"""
qs AS MATERIALIZED (SELECT item_id, {_DNA} AS s FROM benchmark),
ds AS MATERIALIZED (SELECT doc_id, {_DNA} AS s FROM documents),
rs AS (SELECT doc_id, 0 AS dir, s FROM ds UNION ALL SELECT doc_id, 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM ds),
qk AS MATERIALIZED (SELECT item_id, i::INT AS qpos, substring(s, i + 1, {K}) AS kmer FROM qs, unnest(range(0, greatest(length(s) - {K} + 1, 0))) AS t(i)),
want AS (SELECT DISTINCT kmer FROM qk),
rk AS MATERIALIZED (SELECT * FROM (SELECT doc_id, dir, i::INT AS rpos, substring(s, i + 1, {K}) AS kmer FROM rs, unnest(range(0, greatest(length(s) - {K} + 1, 0))) AS t(i)) SEMI JOIN want USING (kmer)),
hits AS (SELECT kmer, count(*) AS hits FROM rk GROUP BY kmer)"""
_KEPT = f"""{_SEEDS},
few AS (SELECT kmer FROM hits WHERE hits <= {REPEAT}),
sd AS MATERIALIZED (SELECT item_id, qpos, doc_id, dir, rpos FROM qk SEMI JOIN few USING (kmer) JOIN rk USING (kmer)),
ev AS (SELECT item_id, qpos, lag(qpos) OVER (PARTITION BY item_id ORDER BY qpos) AS prev FROM qk SEMI JOIN few USING (kmer)),
kept AS MATERIALIZED (
  SELECT sd.* FROM sd JOIN ev USING (item_id, qpos)
  WHERE prev IS DISTINCT FROM qpos - 1 OR NOT EXISTS (SELECT 1 FROM sd o WHERE o.item_id = sd.item_id AND o.doc_id = sd.doc_id AND o.dir = sd.dir AND o.qpos = sd.qpos - 1 AND o.rpos = sd.rpos - 1))"""


def _ref(spark, sf_dir, tail: int = 0):
    return seeds.reference_kmers(table(spark, sf_dir, "documents").select("doc_id", N.dna(F.col("text")).alias("s")), "doc_id", "s", K, tail)


def _query(spark, sf_dir, tail: int = 0):
    return seeds.query_kmers(table(spark, sf_dir, "benchmark").select("item_id", N.dna(F.col("text")).alias("s")), "item_id", "s", K, tail)


def _kept(spark, sf_dir, tail: int = 0):
    """Seeds that pass the filters; with ``tail``, the letters that follow them on both sides (``a``, ``b``)."""
    own = _query(spark, sf_dir, tail)
    ref = seeds.matched(_ref(spark, sf_dir, tail), own)
    few = seeds.counted_hits(ref, own).filter(F.col("hits") <= REPEAT).select("kmer")
    known = own.join(few, "kmer")
    return seeds.drop_adjacent(seeds.seed_join(ref, known), known.select("qid", "qpos"))


@query(f"""WITH {_SEEDS} SELECT item_id, doc_id, dir, count(*) AS n_seeds, min(qpos) AS first_q, max(qpos) AS last_q, min(rpos) AS first_r
FROM qk JOIN rk USING (kmer) GROUP BY item_id, doc_id, dir""")
def seed_join(spark, sf_dir):
    found = seeds.seed_join(_ref(spark, sf_dir), _query(spark, sf_dir))
    out = found.groupBy(F.col("qid").alias("item_id"), F.col("rid").alias("doc_id"), "dir")
    return out.agg(F.count("*").alias("n_seeds"), F.min("qpos").alias("first_q"), F.max("qpos").alias("last_q"), F.min("rpos").alias("first_r"))


OFTEN = 2


@query(f"""WITH {_SEEDS} SELECT kmer, hits, count(*) AS q_hits FROM hits JOIN qk USING (kmer) WHERE hits > {OFTEN} GROUP BY kmer, hits""")
def seed_repeat_filter(spark, sf_dir):
    return seeds.repetitive(_ref(spark, sf_dir), _query(spark, sf_dir), OFTEN)


@query(f"WITH {_KEPT} SELECT item_id, qpos, doc_id, dir, rpos FROM kept")
def seed_adjacent_antijoin(spark, sf_dir):
    return _kept(spark, sf_dir).select(F.col("qid").alias("item_id"), "qpos", F.col("rid").alias("doc_id"), "dir", "rpos")


@query(f"""WITH {_KEPT},
m AS (SELECT *, rpos - qpos AS diagonal, CASE WHEN qpos - lag(qpos) OVER w <= 1 THEN 0 ELSE 1 END AS fresh FROM sd WINDOW w AS (PARTITION BY item_id, doc_id, dir, rpos - qpos ORDER BY qpos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id, doc_id, dir, diagonal ORDER BY qpos) AS run FROM m)
SELECT item_id, doc_id, dir, diagonal, min(qpos) AS start_q, max(qpos) AS end_q, count(*) AS n FROM r GROUP BY item_id, doc_id, dir, diagonal, run""")
def diagonal_chains(spark, sf_dir):
    found = seeds.chains(seeds.seed_join(_ref(spark, sf_dir), _query(spark, sf_dir), REPEAT))
    return found.select(F.col("qid").alias("item_id"), F.col("rid").alias("doc_id"), "dir", "diagonal", F.col("start").alias("start_q"), F.col("end").alias("end_q"), "n")


@query(f"""WITH cs AS MATERIALIZED (SELECT conv_id, turn, {_DNA} AS s FROM conversations), bs AS (SELECT {_DNA} AS s FROM benchmark),
rs AS (SELECT s FROM bs UNION ALL SELECT reverse(translate(s, 'ACGT', 'TGCA')) FROM bs),
rk AS (SELECT DISTINCT substring(s, i + 1, {K}) AS kmer FROM rs, unnest(range(0, greatest(length(s) - {K} + 1, 0))) AS t(i)),
ck AS (SELECT conv_id, turn, substring(s, i + 1, {K}) AS kmer FROM cs, unnest(range(0, greatest(length(s) - {K} + 1, 0))) AS t(i))
SELECT conv_id, turn FROM cs ANTI JOIN (SELECT conv_id, turn FROM ck JOIN rk USING (kmer)) USING (conv_id, turn)""")
def unmapped_reads(spark, sf_dir):
    """Turns of conversations, as reads, without a seed on any item."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", N.dna(F.col("text")).alias("s"))
    own = seeds.query_kmers(turns.withColumn("id", F.struct("conv_id", "turn")), "id", "s", K)
    items = table(spark, sf_dir, "benchmark").select("item_id", N.dna(F.col("text")).alias("s"))
    mapped = seeds.seed_join(seeds.reference_kmers(items, "item_id", "s", K), own).select("qid.conv_id", "qid.turn")
    return turns.select("conv_id", "turn").join(mapped, ["conv_id", "turn"], "left_anti")


def _after(spark, sf_dir, keep: F.Column | None = None):
    """Texts of both sides that follow each kept seed (those that satisfy ``keep``, on 17 letters of ``a`` and ``b``)."""
    kept = _kept(spark, sf_dir, 17)
    kept = (kept if keep is None else kept.filter(keep)).drop("a", "b")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rid"), N.dna(F.col("text")).alias("s"))
    ref = seeds.strands(docs, "rid", "s").withColumnRenamed("seq", "rseq")
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), N.dna(F.col("text")).alias("qseq"))
    rows = kept.join(own, "qid").join(ref, ["rid", "dir"])
    return rows.select("qid", "qpos", "rid", "dir", "rpos", F.expr(f"substring(rseq, rpos + {K + 1})").alias("a"), F.expr(f"substring(qseq, qpos + {K + 1})").alias("b"))


_HIT = " + ".join(f"CASE WHEN length(a) > {i} AND ({' OR '.join(f'substring(b, {j + 1}, 1) = substring(a, {i + 1}, 1)' for j in (i - 1, i, i + 1) if j >= 0)}) THEN 1 ELSE 0 END" for i in range(16))


@query(f"""WITH {_KEPT},
p AS MATERIALIZED (SELECT item_id, qpos, doc_id, dir, rpos, substring(rs.s, rpos + {K + 1}, 17) AS a, substring(qs.s, qpos + {K + 1}, 17) AS b FROM kept JOIN qs USING (item_id) JOIN rs USING (doc_id, dir))
SELECT item_id, qpos, doc_id, dir, rpos, ({_HIT})::INT AS score FROM p WHERE {_HIT} > 10""")
def gapless_filter(spark, sf_dir):
    # the window and one letter beyond it come with the k-mers
    rows = _kept(spark, sf_dir, 17).withColumn("score", N.gapless_score(F.col("a"), F.col("b")))
    return rows.filter("score > 10").select(F.col("qid").alias("item_id"), "qpos", F.col("rid").alias("doc_id"), "dir", "rpos", "score")


def _extended(spark, sf_dir, p: Params):
    rows = _after(spark, sf_dir, N.gapless_score(F.col("a"), F.col("b")) > p.resolved().gapless)
    pairs = rows.select(F.struct("qid", "qpos", "rid", "dir", "rpos").alias("id"), F.substring(F.col("a"), F.lit(1), align.reach(F.length("b"), p.resolved())).alias("a"), "b")
    out = align.extend_pairs(pairs, p)
    return out.select(F.col("id.qid").alias("item_id"), "id.qpos", F.col("id.rid").alias("doc_id"), "id.dir", "id.rpos", "score", "alen", "blen", N.cigar(F.col("path")).alias("cigar"))


@query()
def extend_affine(spark, sf_dir):
    return _extended(spark, sf_dir, Params(k=K))


@query()
def extend_linear(spark, sf_dir):
    return _extended(spark, sf_dir, Params(k=K, gi=0, ge=2))


WINDOW = 24


def _window_sql(gi: int, ge: int) -> str:
    """Row by row over ``a``: h and f are lists over ``b``; the gap along ``b`` is a running maximum. In so short a window no cell of a best path falls by the X-drop."""
    up = f"list_transform(range(0, n + 1), lambda j: greatest(h[j + 1] - {gi}, f[j + 1]) - {ge})"
    diagonal = "list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN nf[1] ELSE greatest(nf[j + 1], h[j] + CASE WHEN b[j] = a[i + 1] THEN 1 ELSE -2 END) END)"
    along = f"list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN g[1] ELSE greatest(g[j + 1], list_max(list_transform(range(0, j), lambda t: g[t + 1] + {ge} * t)) - {gi} - {ge} * j) END)"
    return f"""WITH RECURSIVE {_KEPT},
p AS MATERIALIZED (SELECT item_id, qpos, doc_id, dir, rpos, substring(rs.s, rpos + {K + 1}, {WINDOW}) AS a, substring(qs.s, qpos + {K + 1}, {WINDOW}) AS b FROM kept JOIN qs USING (item_id) JOIN rs USING (doc_id, dir)),
dp AS (SELECT item_id, qpos, doc_id, dir, rpos, a, b, length(b)::INT AS n, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE -{gi} - {ge} * j END)::INT[] AS h, list_transform(range(0, length(b) + 1), lambda j: -100000)::INT[] AS f FROM p
  UNION ALL SELECT item_id, qpos, doc_id, dir, rpos, a, b, n, i + 1, ({along})::INT[], nf FROM (SELECT *, ({diagonal})::INT[] AS g FROM (SELECT *, ({up})::INT[] AS nf FROM dp WHERE i < length(a)))),
c AS (SELECT item_id, qpos, doc_id, dir, rpos, i + j - 1 AS way, h[j] AS v FROM dp, unnest(range(1, n + 2)) AS t(j)),
m AS (SELECT *, max(v) OVER (PARTITION BY item_id, qpos, doc_id, dir, rpos) AS top FROM c)
SELECT item_id, qpos, doc_id, dir, rpos, top::BIGINT AS score, min(way)::BIGINT AS steps FROM m WHERE v = top GROUP BY item_id, qpos, doc_id, dir, rpos, top"""


def _window(spark, sf_dir, p: Params):
    kept = _kept(spark, sf_dir, WINDOW)
    out = align.extend_pairs(kept.select(F.struct("qid", "qpos", "rid", "dir", "rpos").alias("id"), "a", "b"), p)
    return out.select(F.col("id.qid").alias("item_id"), "id.qpos", F.col("id.rid").alias("doc_id"), "id.dir", "id.rpos", "score", (F.col("alen") + F.col("blen")).alias("steps"))


@query(_window_sql(2, 1))
def extend_window_affine(spark, sf_dir):
    """Extensions of every kept seed by 24 letters: best score, and the first anti-diagonal that has it."""
    return _window(spark, sf_dir, Params(k=K))


@query(_window_sql(0, 2))
def extend_window_linear(spark, sf_dir):
    return _window(spark, sf_dir, Params(k=K, gi=0, ge=2))


@query()
def align_reads(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("name"), N.dna(F.col("text")).alias("seq"), "item_id")
    ref = graph.build(items, order="item_id")
    reads = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_ord"), N.dna(F.col("text")).alias("seq"))
    found = mapper.align(ref, reads, Params(k=K, repeat=REPEAT))
    return found.select(F.col("read_ord").alias("doc_id"), "ordinal", "score", N.cigar(F.col("path")).alias("cigar"), "sections")


@query(f"""SELECT item_id, i::INT AS pos, substring(s, i + 1, {K}) AS kmer FROM (SELECT item_id, {_DNA} AS s FROM benchmark), unnest(range(0, greatest(length(s) - {K} + 1, 0))) AS t(i)""")
def kmer_windows(spark, sf_dir):
    return _query(spark, sf_dir).select(F.col("qid").alias("item_id"), F.col("qpos").alias("pos"), "kmer")


@query(f"""WITH s AS (SELECT item_id, {_DNA} AS s FROM benchmark), b AS (SELECT item_id * 2 AS gid, s FROM s UNION ALL SELECT item_id * 2 + 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM s),
k AS (SELECT gid, i::INT AS pos, substring(s, i + 1, {K}) AS kmer FROM b, unnest(range(0, greatest(length(s) - {K} + 1, 0))) AS t(i))
SELECT kmer, count(*) AS n, string_agg(gid || ':' || pos, ',' ORDER BY gid, pos) AS hits FROM k GROUP BY kmer""")
def kmer_index(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", N.dna(F.col("text")).alias("s"))
    kmers = seeds.reference_kmers(own, "item_id", "s", K).select("kmer", (F.col("rid") * 2 + F.col("dir")).alias("gid"), F.col("rpos").alias("pos"))
    spelled = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["gid"], h["pos"])), ",")
    return graph.index(kmers).select("kmer", "n", spelled.alias("hits"))


@query(f"""WITH ds AS (SELECT {_DNA} AS s FROM documents), k AS (SELECT substring(s, i + 1, {K}) AS kmer FROM ds, unnest(range(0, greatest(length(s) - {K} + 1, 0))) AS t(i)),
c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) SELECT n AS multiplicity, count(*) AS kmers FROM c GROUP BY n""")
def kmer_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", N.dna(F.col("text")).alias("s"))
    counts = graph.linear_kmers(docs, "doc_id", "s", K).groupBy("kmer").agg(F.count("*").alias("n"))
    return counts.groupBy(F.col("n").alias("multiplicity")).agg(F.count("*").alias("kmers"))


@query(f"SELECT doc_id, length(s) AS n, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS rc FROM (SELECT doc_id, {_DNA} AS s FROM documents)")
def revcomp(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", N.dna(F.col("text")).alias("s"))
    return docs.select("doc_id", F.length("s").cast("long").alias("n"), F.md5(N.revcomp(F.col("s")).cast("binary")).alias("rc"))


_CODE = "translate(regexp_replace(replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'U', 'T'), '[^ACMGRSVTWYHKDB]', 'N', 'g'), 'NACMGRSVTWYHKDB', '0123456789abcde')"


@query(f"SELECT doc_id, md5({_CODE}) AS code, length(replace({_CODE}, '0', '')) AS known FROM documents")
def iupac_encode(spark, sf_dir):
    code = N.encode_4bit_text(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(code.cast("binary")).alias("code"), F.length(F.replace(code, F.lit("0"), F.lit(""))).cast("long").alias("known"))


@query(f"""WITH k AS (SELECT item_id, i::INT AS pos, substring(s, i + 1, {K}) AS kmer FROM (SELECT item_id, {_DNA} AS s FROM benchmark), unnest(range(0, greatest(length(s) - {K} + 1, 0))) AS t(i))
SELECT item_id, pos, list_sum(list_transform(range(0, {K}), lambda j: (strpos('ACGT', kmer[j + 1]) - 1) * (1::BIGINT << (2 * j))))::BIGINT AS code FROM k""")
def kmer_pack(spark, sf_dir):
    return _query(spark, sf_dir).select(F.col("qid").alias("item_id"), F.col("qpos").alias("pos"), N.pack_kmer(F.col("kmer")).alias("code"))


@query("""WITH l AS (SELECT item_id, i::INT AS pos, upper(substring(s, i + 1, 1)) AS c FROM (SELECT item_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM benchmark), unnest(range(0, length(s))) AS t(i)),
x AS (SELECT *, CASE WHEN c = 'U' THEN 'T' ELSE c END AS d, strpos('ACMGRSVTWYHKDB', CASE WHEN c = 'U' THEN 'T' ELSE c END) AS v FROM l)
SELECT item_id, pos, greatest(strpos('ACGT', d) - 1, 0)::INT AS two, v::INT AS four, substring('NACMGRSVTWYHKDB', v + 1, 1) AS back, ((v & 1) * 8 + (v & 2) * 2 + (v & 4) // 2 + (v & 8) // 8)::INT AS complement FROM x""")
def base_codes(spark, sf_dir):
    letters = F.regexp_extract_all(F.regexp_replace("text", "[^A-Za-z]", ""), F.lit("."), F.lit(0))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(letters).alias("pos", "c"))
    four = N.encode_4bit(F.col("c"))
    return rows.select("item_id", "pos", N.encode_2bit(F.col("c")).alias("two"), four.alias("four"), N.decode_4bit(four).alias("back"), N.complement_4bit(four).alias("complement"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE (o_custkey % 3 * 65536 + CASE WHEN o_custkey % 5 > 1 THEN o_orderkey % 20 * 256 ELSE 0 END + CASE WHEN o_custkey % 5 > 2 THEN o_orderkey % 7 ELSE 0 END)::INT END AS version, o_orderpriority || ' ' || o_orderstatus AS command FROM orders""")
def header_fields(spark, sf_dir):
    kind = F.col("o_custkey") % 5
    text = F.concat(F.lit("H\tVN:Z:"), F.col("o_custkey") % 3, F.when(kind > 1, F.concat(F.lit("."), F.col("o_orderkey") % 20)).otherwise(""), F.when(kind > 2, F.concat(F.lit("."), F.col("o_orderkey") % 7)).otherwise(""))
    command = N.one_line(F.concat("o_orderpriority", F.lit("\t"), "o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(N.version(F.when(kind == 0, "H\tXX:Z:1.0").otherwise(text)), F.lit(-1)).alias("version"), command.alias("command"))


_NDNA = "upper(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgnacgtacgtac'))"


@query(f"""SELECT doc_id, count(*) AS kept, sum(i)::BIGINT AS places FROM (SELECT doc_id, {_NDNA} AS s FROM documents), unnest(range(0, greatest(length(s) - 5, 0))) AS t(i) WHERE strpos(substring(s, i + 1, 6), 'N') = 0 GROUP BY doc_id""")
def kmer_n_drop(spark, sf_dir):
    """Windows of six letters without N, where every p is one."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.upper(F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgnacgtacgtac")).alias("s"))
    return graph.linear_kmers(rows, "doc_id", "s", 6).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("pos").alias("places"))


@query("""SELECT n_nationkey, n_nationkey * 2 + n_regionkey % 2 AS gid, xor(n_nationkey * 2 + n_regionkey % 2, 1) AS rev, 2 * (n_nationkey + 10) - n_regionkey - 1 AS mirrored FROM nation""")
def gid_codec(spark, sf_dir):
    g = N.gid(F.col("n_nationkey"), F.col("n_regionkey") % 2)
    return table(spark, sf_dir, "nation").select("n_nationkey", g.alias("gid"), N.gid_reverse(g).alias("rev"), N.mirror(F.col("n_nationkey") + 10, F.col("n_regionkey")).alias("mirrored"))


_IV = """iv AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS lkey, epoch(o_orderdate)::BIGINT // 86400 + 1 + o_orderkey % 60 AS rkey FROM orders),
q AS (SELECT n_nationkey, 9131 + 90 * n_nationkey AS l, 9131 + 90 * n_nationkey + 5 + 3 * n_regionkey AS r FROM nation)"""


def _intervals(spark, sf_dir):
    lkey = days("o_orderdate").cast("long")
    iv = table(spark, sf_dir, "orders").select("o_orderkey", lkey.alias("lkey"), (lkey + 1 + F.col("o_orderkey") % 60).alias("rkey"))
    l = (9131 + 90 * F.col("n_nationkey")).cast("long")
    return iv, table(spark, sf_dir, "nation").select("n_nationkey", l.alias("l"), (l + 5 + 3 * F.col("n_regionkey")).alias("r"))


def _iv_sql(on: str) -> str:
    return f"WITH {_IV} SELECT n_nationkey, o_orderkey, lkey, rkey FROM iv JOIN q ON {on}"


def _iv_out(rows):
    return rows.select("n_nationkey", "o_orderkey", "lkey", "rkey")


@query(_iv_sql("lkey >= l AND lkey < r AND rkey < r"))
def iv_contained(spark, sf_dir):
    return _iv_out(intervals.contained(*_intervals(spark, sf_dir)))


@query(_iv_sql("lkey <= l AND rkey >= r"))
def iv_containing(spark, sf_dir):
    return _iv_out(intervals.containing(*_intervals(spark, sf_dir)))


@query(_iv_sql("lkey < r AND rkey > l"))
def iv_intersect(spark, sf_dir):
    return _iv_out(intervals.intersect(*_intervals(spark, sf_dir)))


@query(f"WITH {_IV} SELECT n_nationkey, o_orderkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY lkey, o_orderkey) - 1 AS seq FROM iv JOIN q ON lkey < r AND rkey > l")
def iv_in_order(spark, sf_dir):
    found = intervals.intersect(*_intervals(spark, sf_dir))
    return intervals.in_order(found, ["n_nationkey"], "o_orderkey").select("n_nationkey", "o_orderkey", F.col("seq").cast("long").alias("seq"))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def exact_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    found = intervals.exact(keys, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber"), [])
    return found.select(F.col("key").alias("l_orderkey"), "l_linenumber", "o_custkey")


def _nearest(spark, sf_dir, left):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("key"))
    keys = rows.filter("event_type = 'purchase'").select("user_id", "key")
    probes = rows.filter("event_type = 'click'").select("event_id", "user_id", "key")
    return intervals.nearest(keys, probes, ["user_id"], left).select("event_id", F.col("key").alias("at"), "found")


_NEAR = "WITH e AS (SELECT *, epoch_us(ts) AS k FROM events) SELECT p.event_id, p.k AS at, {agg}(o.k) AS found FROM e p LEFT JOIN e o ON o.user_id = p.user_id AND o.event_type = 'purchase' AND o.k {op} p.k WHERE p.event_type = 'click' GROUP BY p.event_id, p.k"


@query(_NEAR.format(agg="max", op="<="))
def nearest_left(spark, sf_dir):
    return _nearest(spark, sf_dir, True)


@query(_NEAR.format(agg="min", op=">="))
def nearest_right(spark, sf_dir):
    return _nearest(spark, sf_dir, False)


@query("SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1)::INT AS id FROM events GROUP BY event_type")
def dict_encode(spark, sf_dir):
    return graph.dictionary(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""WITH c AS (SELECT l_partkey % 256 AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT bin, n, coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c""")
def histogram_partial_final(spark, sf_dir):
    return ordering.histogram(table(spark, sf_dir, "lineitem"), F.col("l_partkey"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey & 255, o_orderkey) - 1 AS n FROM orders")
def radix_sort_stable(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").bitwiseAND(255).alias("digit"))
    return ordering.numbered(rows, "digit", "o_orderkey").select("o_orderkey", "n")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_partkey * 4096 + l_orderkey % 4096, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS n FROM lineitem")
def sort_full(spark, sf_dir):
    """The place of every row in a sort by a whole key, made unique by the row."""
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.struct(F.col("l_partkey") * 4096 + F.col("l_orderkey") % 4096, "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"))
    return positions(ordering.sort_full(rows, "key")).select("l_orderkey", "l_linenumber", "n")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey * 7919 & 65535, o_orderkey) - 1 AS n FROM orders")
def sort_half(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 7919).alias("key"))
    return positions(ordering.sort_half(rows, "key", "o_orderkey", 16)).select("o_orderkey", "n")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY (o_custkey * 7919) >> 8 & 65535, o_orderkey) - 1 AS n FROM orders")
def sort_partial(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 7919).alias("key"))
    return positions(ordering.sort_partial(rows, "key", "o_orderkey", 1, 3)).select("o_orderkey", "n")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders")
def row_counter(spark, sf_dir):
    return ordering.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "n")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def topk_min_heap(spark, sf_dir):
    return ordering.smallest(table(spark, sf_dir, "orders"), 100, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 1")
def queue_get_filtered(spark, sf_dir):
    return ordering.first_match(table(spark, sf_dir, "events"), F.col("event_type") == "error", "event_id").select("event_id", "user_id")


@query("""SELECT event_id, user_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value > b""")
def running_argmax(spark, sf_dir):
    return ordering.running_best(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")


def _lines(spark, sf_dir):
    """Line items with a total order within their order, as line numbers repeat."""
    return table(spark, sf_dir, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT - 25) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS c FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c, l_linenumber) AS n FROM s) SELECT l_orderkey, l_linenumber AS at, c::BIGINT AS least FROM r WHERE n = 1""")
def prefix_argmin(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    out = ordering.prefix_argmin(rows, ["l_orderkey"], "place", F.col("l_quantity").cast("long") - 25)
    return out.select("l_orderkey", F.col("at.l_linenumber").alias("at"), "least")


@query("""SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM lineitem""")
def cum_offset(spark, sf_dir):
    rows = ordering.offsets(_lines(spark, sf_dir), ["l_orderkey"], "place", F.col("l_quantity").cast("long"))
    return rows.select("l_orderkey", "l_linenumber", "offset")


@query("""SELECT l_orderkey, l_linenumber, (row_number() OVER w - 1)::INT AS ordinal, lag(l_linenumber) OVER w AS prev, lead(l_linenumber) OVER w AS next, row_number() OVER w = 1 AS "primary" FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def prev_next_link(spark, sf_dir):
    return ordering.linked(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("""WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber FROM r JOIN c USING (l_orderkey) WHERE k <= n""")
def distinct_by_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return ordering.distinct_scores(rows, "l_orderkey", "l_suppkey", "l_linenumber").select("l_orderkey", "l_linenumber")


def _nations(spark, sf_dir):
    """Nations as segments, linked to their region's segment."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    segs = region.select(F.col("r_name").alias("name"), F.col("r_name").alias("seq"), F.col("r_regionkey").cast("long").alias("o"))
    segs = segs.unionByName(nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("seq"), (F.col("n_nationkey") + 100).cast("long").alias("o")))
    links = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    links = links.select(F.col("n_name").alias("src"), (F.col("n_nationkey") % 2).alias("src_ori"), F.col("r_name").alias("dst"), F.lit(0).alias("dst_ori"), (F.col("n_nationkey") + 200).cast("long").alias("o"))
    return graph.build(segs, links, "o")


_NATIONS = """ids AS (SELECT r_name AS name, row_number() OVER (ORDER BY r_regionkey) - 1 AS id FROM region UNION ALL SELECT n_name, (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) - 1 FROM nation),
l AS (SELECT a.id * 2 + n_nationkey % 2 AS src, b.id * 2 AS dst, n_nationkey + 200 AS ord FROM nation JOIN region ON n_regionkey = r_regionkey JOIN ids a ON a.name = n_name JOIN ids b ON b.name = r_name),
e AS (SELECT src, dst, ord FROM l UNION ALL SELECT xor(dst, 1), xor(src, 1), ord FROM l)"""


@query(f"WITH {_NATIONS} SELECT src::INT AS src, dst::INT AS dst, ord::BIGINT AS ord FROM e")
def link_mirror_union(spark, sf_dir):
    return _nations(spark, sf_dir).edges


@query(f"WITH {_NATIONS}, g AS (SELECT (id * 2 + d)::INT AS gid FROM ids, (VALUES (0), (1)) t(d)) SELECT gid, coalesce(string_agg(dst, ',' ORDER BY ord, dst), '') AS succ FROM g LEFT JOIN e ON e.src = g.gid GROUP BY gid")
def adjacency(spark, sf_dir):
    return _nations(spark, sf_dir).successors().select("gid", F.array_join("succ", ",").alias("succ"))


@query(f"WITH {_NATIONS} SELECT count(*) AS sections, sum(length(name))::BIGINT AS total_len FROM ids")
def graph_totals(spark, sf_dir):
    return _nations(spark, sf_dir).total_length()


@query(f"WITH s AS (SELECT item_id, {_DNA} AS s FROM benchmark) SELECT item_id, 0 AS dir, s AS seq FROM s UNION ALL SELECT item_id, 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM s")
def strand_union(spark, sf_dir):
    return seeds.strands(table(spark, sf_dir, "benchmark").select("item_id", N.dna(F.col("text")).alias("s")), "item_id", "s")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_positions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(f"WITH {_KEPT} SELECT item_id, qpos, doc_id, dir, rpos FROM sd EXCEPT ALL SELECT item_id, qpos, doc_id, dir, rpos FROM kept")
def diff_seeds(spark, sf_dir):
    every = seeds.seed_join(_ref(spark, sf_dir), _query(spark, sf_dir), REPEAT).select("qid", "qpos", "rid", "dir", "rpos")
    return every.exceptAll(_kept(spark, sf_dir).select(every.columns)).select(F.col("qid").alias("item_id"), "qpos", F.col("rid").alias("doc_id"), "dir", "rpos")


_TINY = [("sec0", "GGRA", 0), ("sec1", "M", 1), ("sec2", "ACVVGTGT", 3)]
_TINY_LINKS = [("sec0", 0, "sec1", 0, 2), ("sec1", 0, "sec2", 0, 4), ("sec0", 0, "sec2", 0, 5)]


def tiny_graph(spark):
    segs = spark.createDataFrame(_TINY, "name string, seq string, o long")
    return graph.build(segs, spark.createDataFrame(_TINY_LINKS, "src string, src_ori int, dst string, dst_ori int, o long"), "o")


@query("""WITH RECURSIVE sec(gid, s) AS (VALUES (0, 'GGRA'), (2, 'M'), (4, 'ACVVGTGT')), edge(a, b) AS (VALUES (0, 2), (2, 4), (0, 4)),
iupac(c, b) AS (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('R','A'),('R','G'),('M','A'),('M','C'),('V','A'),('V','C'),('V','G')),
p AS (SELECT gid, gid AS at, length(s) AS n, s, 0 AS prev, 3 AS need, '' AS route FROM sec
  UNION ALL SELECT p.gid, e.b, p.n, p.s || substring(x.s, 1, need), length(p.s), need - least(need, length(x.s)), p.route || '>' || e.b FROM p JOIN edge e ON e.a = p.at JOIN sec x ON x.gid = e.b WHERE need > 0),
w AS (SELECT gid, i AS pos, route, substring(s, i + 1, 4) AS k FROM p, unnest(range(0, greatest(length(s) - 3, 0))) AS t(i) WHERE i < n AND i + 4 > prev)
SELECT gid, pos::INT AS pos, route, a.b || c.b || g.b || t.b AS kmer FROM w JOIN iupac a ON a.c = k[1] JOIN iupac c ON c.c = k[2] JOIN iupac g ON g.c = k[3] JOIN iupac t ON t.c = k[4]""")
def graph_kmers(spark, sf_dir):
    found = graph.graph_kmers(tiny_graph(spark), 4)
    return found.select("gid", "pos", F.concat_ws("", F.transform("route", lambda g: F.concat(F.lit(">"), g.cast("string")))).alias("route"), "kmer")


def _nation_graph(spark, sf_dir):
    """The graph of nations and regions with names as nucleotides, and a link back to each region's next nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dna = lambda c: N.dna(F.concat(F.col(c), F.lit("gattaca")))
    segs = region.select(F.col("r_name").alias("name"), dna("r_name").alias("seq"), F.col("r_regionkey").cast("long").alias("o"))
    segs = segs.unionByName(nation.select(F.col("n_name").alias("name"), dna("n_name").alias("seq"), (F.col("n_nationkey") + 100).cast("long").alias("o")))
    links = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    links = links.select(F.col("n_name").alias("src"), (F.col("n_nationkey") % 2).alias("src_ori"), F.col("r_name").alias("dst"), F.lit(0).alias("dst_ori"), (F.col("n_nationkey") + 200).cast("long").alias("o"))
    return graph.build(segs, links, "o")


@query(f"""WITH RECURSIVE {_NATIONS},
sq AS (SELECT id, upper(translate(regexp_replace(lower(name || 'gattaca'), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')) AS s FROM ids),
sec AS (SELECT id * 2 AS gid, s FROM sq UNION ALL SELECT id * 2 + 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM sq),
p AS (SELECT gid, gid AS at, length(s) AS n, s, 0::BIGINT AS prev, 11::BIGINT AS need, '' AS route FROM sec
  UNION ALL SELECT p.gid, e.dst, p.n, p.s || substring(x.s, 1, need), length(p.s), need - least(need, length(x.s)), p.route || '>' || e.dst FROM p JOIN e ON e.src = p.at JOIN sec x ON x.gid = e.dst WHERE need > 0)
SELECT gid::INT AS gid, i::INT AS pos, route, substring(s, i + 1, 12) AS kmer FROM p, unnest(range(0, greatest(length(s) - 11, 0))) AS t(i) WHERE i < n AND i + 12 > prev""")
def nation_kmers(spark, sf_dir):
    found = graph.graph_kmers(_nation_graph(spark, sf_dir), 12, both_strands=True)
    return found.select("gid", "pos", F.concat_ws("", F.transform("route", lambda g: F.concat(F.lit(">"), g.cast("string")))).alias("route"), "kmer")


@query(f"""WITH {_NATIONS} SELECT '@HD' || chr(9) || 'VN:1.0' || chr(9) || 'SO:unsorted' AS line UNION ALL SELECT '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || length(name) FROM ids
UNION ALL SELECT '@RG' || chr(9) || 'ID:1' UNION ALL SELECT '@PG' || chr(9) || 'ID:0' || chr(9) || 'PN:helixframe' || chr(9) || 'CL:align -k14' UNION ALL SELECT 'H' || chr(9) || 'VN:Z:0.1'""")
def file_headers(spark, sf_dir):
    sam = writers.sam_header(_nations(spark, sf_dir).sections, "helixframe", 0, "align\t-k14").select("line")
    return sam.unionByName(spark.createDataFrame([(writers.gpa_header(),)], "line string"))


@query(f"SELECT concat_ws(chr(9), 'item' || item_id, 4, '*', 0, 0, '*', '*', 0, 0, s, '*', 'RG:Z:1') AS line FROM (SELECT item_id, {_DNA} AS s FROM benchmark)")
def sam_unmapped(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", N.dna(F.col("text")).alias("s"))
    both = seeds.strands(rows, "item_id", "s").select((F.col("item_id") * 2 + F.col("dir")).alias("gid"), F.concat(F.lit("item"), "item_id").alias("name"), "seq")
    return writers.sam_unmapped(both).select("line")


def _gfa(spark, sf_dir):
    """Nations and regions as a GFA file, written and read back."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    tab = lambda *c: F.concat_ws("\t", *c).alias("value")
    overlap = F.element_at(F.array(F.lit("0M"), F.lit("4M"), F.lit("*")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    sign = F.when(F.col("n_nationkey") % 2 == 0, "+").otherwise("-")
    lines = spark.createDataFrame([("H\tVN:Z:1.0",), ("# made from nations",)], "value string")
    lines = lines.unionByName(region.select(tab(F.lit("S"), "r_name", "r_name"))).unionByName(nation.select(tab(F.lit("S"), "n_name", "n_name")))
    both = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = lines.unionByName(both.select(tab(F.lit("L"), "n_name", sign, "r_name", F.lit("+"), overlap))).unionByName(both.select(tab(F.lit("P"), "n_name", "r_name", F.lit("*"))))
    path = fresh(spark, "nations") + ".gfa"
    lines.write.option("compression", "gzip").text(path)
    return readers.read_records(spark, path)


@query("SELECT r_name AS name, r_name AS seq FROM region UNION ALL SELECT n_name, n_name FROM nation")
def gfa_segments(spark, sf_dir):
    return _gfa(spark, sf_dir)[0].select("name", "seq")


@query("""SELECT n_name AS src, n_nationkey % 2 AS src_ori, r_name AS dst, 0 AS dst_ori, CASE n_nationkey % 3 WHEN 0 THEN '0M' WHEN 1 THEN '4M' ELSE '' END AS cigar, n_nationkey % 3 = 0 AS joined FROM nation JOIN region ON n_regionkey = r_regionkey""")
def gfa_links(spark, sf_dir):
    links = _gfa(spark, sf_dir)[1]
    own = readers.joinable(links).select("src", "dst").withColumn("joined", F.lit(True))
    return links.join(own, ["src", "dst"], "left").select("src", "src_ori", "dst", "dst_ori", "cigar", F.coalesce("joined", F.lit(False)).alias("joined"))


@query(f"SELECT 'item' || item_id AS name, 'x ' || item_id AS comment, s AS seq, repeat('@I+', length(s) // 3) || repeat('>', length(s) % 3) AS qual FROM (SELECT item_id, {_DNA} AS s FROM benchmark) WHERE length(s) > 0")
def fastq_scan(spark, sf_dir):
    """Items as FASTQ files whose qualities hold every mark, sequences over several lines."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", N.dna(F.col("text")).alias("s")).filter("length(s) > 0")
    quality = F.concat(F.expr("repeat('@I+', cast(length(s) div 3 as int))"), F.expr("repeat('>', cast(length(s) % 3 as int))"))
    text = F.concat(F.lit("@item"), "item_id", F.lit(" x "), "item_id", F.lit("\n"), F.regexp_replace("s", "(.{50})", "$1\n"), F.lit("\n+\n"), quality)
    path = fresh(spark, "items") + ".fq"
    rows.repartition(3).select(text.alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_records(spark, path)[0]


_PATH = f"translate({_DNA}, 'ACGT', 'RDRD')"
_TOKENS = f"list_transform(regexp_extract_all(replace(replace(replace({_PATH}, 'DR', 'M'), 'D', 'I'), 'R', 'D'), 'M+|I+|D+'), lambda x: length(x) || x[1])"


@query(f"SELECT doc_id, md5(array_to_string({_TOKENS}, '')) AS cigar, md5(array_to_string(list_reverse({_TOKENS}), '')) AS reverse_cigar FROM documents")
def path_rle_cigar(spark, sf_dir):
    path = F.translate(N.dna(F.col("text")), "ACGT", "RDRD")
    md5 = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", md5(N.cigar(path)).alias("cigar"), md5(N.cigar_reverse(path)).alias("reverse_cigar"))


@query(f"SELECT doc_id, length(replace(p, 'R', '')) AS d, length(replace(p, 'D', '')) AS r, length(replace(substring(p, 41, 32), 'R', '')) AS near FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def path_steps(spark, sf_dir):
    path = F.translate(N.dna(F.col("text")), "ACGT", "RDRD")
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("p"))
    long = lambda c: c.cast("long")
    return rows.select("doc_id", long(N.steps(F.col("p"), "D")).alias("d"), long(N.steps(F.col("p"), "R")).alias("r"), long(N.window_steps(F.col("p"), F.lit(40))).alias("near"))


def _pseudo(spark, sf_dir):
    """Chains of seeds as alignments of items to documents, and both section tables."""
    found = seeds.chains(seeds.seed_join(_ref(spark, sf_dir), _query(spark, sf_dir), REPEAT))
    size = (F.col("end") - F.col("start") + K).cast("int")
    zero = F.lit(0)
    section = F.struct(
        (F.col("rid") * 2 + F.col("dir")).cast("int").alias("aid"), (F.col("qid") * 2).cast("int").alias("bid"),
        (F.col("start") + F.col("diagonal")).cast("int").alias("apos"), F.col("start").cast("int").alias("bpos"), size.alias("alen"), size.alias("blen"), zero.alias("ppos"),
    )
    key = F.struct("qid", "rid", "dir", "diagonal", "start")
    aligned = found.select(key.alias("read_ord"), zero.alias("ordinal"), F.expr(f"repeat('DR', cast(end - start + {K} as int))").alias("path"), F.array(section).alias("sections"))

    def sections(name, key, prefix):
        rows = table(spark, sf_dir, name).select(F.col(key).alias("i"), N.dna(F.col("text")).alias("s"))
        both = seeds.strands(rows, "i", "s")
        return both.select((F.col("i") * 2 + F.col("dir")).cast("int").alias("gid"), F.concat(F.lit(prefix), "i").alias("name"), F.length("seq").alias("len"), "seq")

    return aligned, sections("documents", "doc_id", "doc"), sections("benchmark", "item_id", "item")


_CHAINED = f"""WITH {_KEPT},
m AS (SELECT *, rpos - qpos AS diagonal, CASE WHEN qpos - lag(qpos) OVER w <= 1 THEN 0 ELSE 1 END AS fresh FROM sd WINDOW w AS (PARTITION BY item_id, doc_id, dir, rpos - qpos ORDER BY qpos)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id, doc_id, dir, diagonal ORDER BY qpos) AS run FROM m),
ch AS (SELECT item_id, doc_id, dir, diagonal, min(qpos) AS b, max(qpos) - min(qpos) + {K} AS n FROM r GROUP BY item_id, doc_id, dir, diagonal, run),
al AS (SELECT ch.*, b + diagonal AS a, length(rs.s) AS rlen, qs.s AS q, length(qs.s) AS qlen FROM ch JOIN qs USING (item_id) JOIN rs USING (doc_id, dir))"""


@query(f"""{_CHAINED} SELECT concat_ws(chr(9), 'item' || item_id, CASE WHEN dir = 1 THEN 16 ELSE 0 END, 'doc' || doc_id, CASE WHEN dir = 1 THEN rlen - a - n ELSE a END + 1, 255,
CASE WHEN dir = 1 THEN (CASE WHEN qlen - b - n > 0 THEN (qlen - b - n) || 'S' ELSE '' END) || n || 'M' || (CASE WHEN b > 0 THEN b || 'S' ELSE '' END)
ELSE (CASE WHEN b > 0 THEN b || 'S' ELSE '' END) || n || 'M' || (CASE WHEN qlen - b - n > 0 THEN (qlen - b - n) || 'S' ELSE '' END) END,
'*', 0, 0, CASE WHEN dir = 1 THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END, '*', 'RG:Z:1') AS line FROM al""")
def sam_projection(spark, sf_dir):
    return writers.sam_records(*_pseudo(spark, sf_dir)).select("line")


@query(f"""{_CHAINED}, num AS (SELECT *, row_number() OVER (ORDER BY item_id, doc_id, dir, diagonal, b) - 1 AS id FROM al)
SELECT concat_ws(chr(9), 'A', id, 'doc' || doc_id, CASE WHEN dir = 1 THEN rlen - a ELSE a END, n, CASE WHEN dir = 1 THEN '-' ELSE '+' END, 'item' || item_id, b, n, '+', n || 'M', '*', '*', 'MQ:i:255') AS line FROM num""")
def gpa_projection(spark, sf_dir):
    return writers.gpa_records(*_pseudo(spark, sf_dir)).select("line")


@query(r"""WITH v AS (SELECT conv_id || '_' || turn || ' ' || role || ' a>b' || chr(10) || text || CASE WHEN turn % 3 = 0 THEN 'AC>cut ' || conv_id || chr(10) || 'GT' ELSE '' END AS t FROM conversations),
p AS (SELECT unnest(regexp_extract_all(t, '(?s)(?:^|>)([^\n]*(?:\n[^>]*)?)', 1)) AS t FROM v),
h AS (SELECT trim(regexp_extract(t, '^([^\n]*)', 1)) AS h, regexp_replace(regexp_extract(t, '(?s)^[^\n]*\n(.*)$', 1), '[^!-~]', '', 'g') AS seq FROM p WHERE length(trim(t)) > 0)
SELECT regexp_extract(h, '^([^ ]*)', 1) AS name, trim(regexp_extract(h, '^[^ ]* (.*)$', 1)) AS comment, seq FROM h""")
def fasta_scan(spark, sf_dir):
    """Turns of conversations as FASTA files: marks in headers stay, marks in sequences begin a record."""
    more = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("AC>cut "), "conv_id", F.lit("\nGT"))).otherwise("")
    text = F.concat(F.lit(">"), F.concat_ws("_", "conv_id", "turn"), F.lit(" "), "role", F.lit(" a>b\n"), "text", more)
    path = fresh(spark, "turns") + ".fa"
    table(spark, sf_dir, "conversations").repartition(4).select(text.alias("value")).write.text(path)
    return readers.read_records(spark, path)[0].select("name", "comment", "seq")


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def stream_drain(spark, sf_dir):
    run = fresh(spark, "drain")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    events.repartition(8).write.parquet(f"{run}/in")
    # two files at a time
    rows = drain(spark, f"{run}/in", events.schema, lambda s: s, f"{run}/out", f"{run}/state", files_per_batch=2)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))
