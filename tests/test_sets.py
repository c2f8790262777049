"""Literal fixtures, laws and edges of the engine."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idsets import queries
from idsets.functions import hashing, unsigned
from idsets.operators import bitmaps, terms
from idsets.operators.dictionary import Index, Keyer
from idsets.operators.idset import IdSet, intersect, signed, union
from idsets.operators.ring import Ring, balance, max_share, remapped
from idsets.operators.sharding import Shape, ShardedSet
from idsets.plans import planner
from idsets.sources import setfile, text
from idsets.sources.catalog import Catalog, UnknownSet

EDGES = [0, 1, 32767, 32768, 32769, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]


def of(spark, *ids):
    return IdSet.of(spark, ids)


def test_dedup_and_has(spark):
    s = of(spark, 5, 1, 3, 3, 1)
    assert s.count() == 3 and s.has(3) and not s.has(4)
    assert s.add(9, 9).ids() == [1, 3, 5, 9] and s.add() is s


def test_intersect_of_several(spark):
    a, b, c = of(spark, 1, 2, 3, 4), of(spark, 3, 4, 5, 6), of(spark, 4, 5, 6, 7)
    assert a.intersect(b).ids() == [3, 4]
    for f in (IdSet.intersect, IdSet.intersect_dense, IdSet.intersect_auto):
        assert f(a, b, c).ids() == [4]
        assert f(a, IdSet.empty(spark), c).ids() == []
    assert intersect(a).ids() == [1, 2, 3, 4]
    assert intersect(spark=spark).ids() == [] == union(spark=spark).ids()


def test_union_and_difference(spark):
    a, b = of(spark, 1, 2), of(spark, 2, 3)
    assert a.union(b, of(spark, 10)).ids() == [1, 2, 3, 10]
    assert a.difference(b).ids() == [1]
    assert a.filter(b).ids() == [2]


def test_unsigned_edges(spark):
    s = of(spark, *EDGES)
    assert s.ids() == EDGES
    for f in (IdSet.intersect, IdSet.intersect_dense, IdSet.intersect_auto):
        assert f(s, of(spark, 0, 32768, 1 << 63, (1 << 64) - 1)).ids() == [0, 32768, 1 << 63, (1 << 64) - 1]
    r = s.info().first()
    assert (r.members, r.bytes, r.min_id, r.max_id) == (8, 64, 0, -1)
    shown = s.df.select(unsigned.shown(F.col("id")).alias("x")).collect()
    assert sorted(int(x.x) for x in shown) == EDGES
    with pytest.raises(ValueError):
        signed(1 << 64)


def test_facets_of_one_table_combine(spark):
    rows = spark.createDataFrame([(1, 1, None), (2, 1, 1), (3, 0, 1), (4, None, 0), (None, 1, 1)], "id bigint, a int, b int")
    a, b = (IdSet.facet(rows, f"{c} = 1", "id", unique=True) for c in "ab")
    other = of(spark, 1, 2)
    plan = lambda s: s.df._jdf.queryExecution().executedPlan().toString()
    for got, want in ((a.intersect(b), [2]), (a.union(b), [1, 2, 3]), (a.difference(b), [1]), (b.difference(a), [3])):
        assert got.ids() == want and "Join" not in plan(got) and "Exchange" not in plan(got)
    assert a.intersect(other, b).ids() == [2] and a.union(other).ids() == [1, 2] and a.difference(b, other).ids() == []


def test_nulls_are_no_ids(spark):
    rows = spark.createDataFrame([(1,), (None,), (1,)], "id bigint")
    assert IdSet.from_column(rows).ids() == [1]
    assert [r.member for r in of(spark, 1).members(rows).orderBy("id").collect()] == [False, True, True]


def test_laws_on_random_sets(spark):
    r = random.Random(2)
    for universe, fill in ((64, 40), (4096, 3000), (1 << 20, 100)):
        x, y = ({r.randrange(universe) for _ in range(fill)} for _ in range(2))
        a, b = of(spark, *x), of(spark, *y)
        assert a.intersect(b).ids() == b.intersect(a).ids() == a.intersect_dense(b).ids() == sorted(x & y)
        assert a.union(b).count() == len(x) + len(y) - a.intersect_count(b).first().n
        assert a.difference(b).intersect(b).count() == 0


def test_search_keeps_the_order_of_the_batch(spark):
    batch = spark.createDataFrame([(k, i) for k, i in enumerate([9, 1, 5, 5, 1, 7])], "ordinal bigint, id bigint")
    assert [tuple(x) for x in of(spark, 1, 5, 9).search(batch).collect()] == [(0, 9), (1, 1), (2, 5)]


def test_plan_choice(spark):
    sets = [of(spark, 0, 1, 2, 3).df, of(spark, 2, 3, 4, 5).df]
    assert planner.choose(sets).dense
    wide = [of(spark, *(k << 13 for k in range(100))).df] * 2
    assert not planner.choose(wide).dense
    assert not planner.choose(sets[:1]).dense
    assert not planner.choose([IdSet.empty(spark).df] * 2).dense


def test_bitmap_counts(spark):
    s = of(spark, *range(100), 40_000)
    assert bitmaps.count(bitmaps.construct(s.df)).first().n == 101
    assert sorted(r.id for r in bitmaps.extract(bitmaps.construct(s.df)).collect()) == [*range(100), 40_000]


def test_shards(spark):
    shape = Shape(1000, 4)
    a = ShardedSet(of(spark, 0, 1, 249, 250, 500, 999, 1000, 1 << 40), shape)
    b = ShardedSet(of(spark, 250, 500, 999, 123), shape)
    assert a.has(250) and not a.has(2) and not a.has(1000) and not a.has(1 << 40)
    assert a.intersect_count(b).first().n == 3
    assert [r.n for r in a.counts().orderBy("shard").collect()] == [3, 1, 1, 1]
    with pytest.raises(ValueError):
        a.intersect_count(ShardedSet(of(spark, 1), Shape(1000, 5)))
    with pytest.raises(ValueError):
        Shape(0, 4)


def test_sharded_queries_keep_ids_beyond_their_shape(spark, tmp_path):
    keys = [0, 5, 1_048_575, 1_048_576, 9_000_000]
    orders = [(k, "1-URGENT", 1.0) for k in keys]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, "R") for k in [*keys[1:], 9_000_001]], "l_orderkey bigint, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [r.n for r in sorted(run("shard_counts"))] == [3, 0, 0, 0, 0, 0, 0, 2]
    assert len(run("shard_modes")) == 8 and sum(r.bytes for r in run("shard_bytes")) == 5 * 8
    assert run("shard_intersect_count")[0].n == 4


def test_shard_modes(spark):
    ids = spark.range(10).union(spark.range(131_072, 181_072))
    own = ShardedSet(IdSet(ids), Shape(1 << 20, 8))
    assert [r["mode"] for r in own.modes().orderBy("shard").collect()] == ["sparse", "dense", *["sparse"] * 6]
    assert [r["bytes"] for r in own.bytes().orderBy("shard").collect()][:3] == [80, 16_384, 0]


@pytest.mark.parametrize(
    ("term", "id_"),
    [("casa", 3125458), ("moradia", 95578313231), ("lar", 115615), ("Oa", 3149), ("0b", 3149), ("AA", 2143), ("࡞", 2143), ("são paulo", 106532816968652), ("sao paulo", 105651496225965), ("São Paulo", 106532787415948), ("", 0)],
)
def test_positional_id(spark, term, id_):
    assert int(spark.createDataFrame([(term,)], "t string").select(unsigned.shown(hashing.positional_id(F.col("t"))).alias("x")).first().x) == id_


def test_positional_id_wraps(spark):
    r = random.Random(1)
    words = ["".join(r.choice("aéß日\U0001d11ez") for _ in range(r.randint(1, 60))) for _ in range(40)]
    got = spark.createDataFrame([(w,) for w in words], "t string").select("t", unsigned.shown(hashing.positional_id(F.col("t"))).alias("x")).collect()
    for row in got:
        at, total = 0, 0
        for k, c in enumerate(row.t):
            total += (ord(c) + at + 1) * 31**k
            at += len(c.encode())
        assert int(row.x) == total % (1 << 64)


def test_fnv(spark):
    ids = [signed(i) for i in EDGES]
    got = {r.id: r.h for r in spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", hashing.fnv1a_id(F.col("id")).alias("h")).collect()}
    assert got == {i: signed(hashing.fnv1a((i & (1 << 64) - 1).to_bytes(8, "little"))) for i in ids}


def vocabulary(spark, *words):
    return spark.createDataFrame(list(enumerate(words)), "ordinal bigint, term string")


def test_keyer(spark):
    keyer = Keyer.build(vocabulary(spark, "casa", "saca", "casa", "lar", "lar", "", "saca "))
    assert {(r.term, r.id) for r in keyer.df.collect()} == {("casa", 0), ("saca", 1), ("lar", 2), ("", 3), ("saca ", 4)}
    own, missing = keyer.id_set(vocabulary(spark, "casa", "inexistente", "lar", "inexistente"))
    assert own.ids() == [0, 2] and [r.term for r in missing.orderBy("ordinal").collect()] == ["inexistente"] * 2
    assert {(r.id, r.term) for r in keyer.terms(spark.range(4, 6)).collect()} == {(4, "saca "), (5, None)}
    assert len(Keyer.build(vocabulary(spark, "x").limit(0))) == 0


def test_index_is_a_bijection(spark):
    keys = spark.range(5000).select(F.col("id").alias("ordinal"), F.xxhash64(F.col("id") % 3000).alias("key"))
    index = Index.build(keys)
    ids = sorted(r.dense_id for r in index.df.collect())
    assert ids == list(range(3000)) and len(index) == 3000
    assert index.lookup(spark.createDataFrame([(7,)], "key bigint")).first().dense_id is None


def test_ring(spark):
    ids = spark.range(3000)
    ring = Ring(["a", "b", "c"])
    routed = {r.id: r.owner for r in ring.route(ids).collect()}
    assert set(routed.values()) == {"a", "b", "c"}
    assert all(ring.owner(i) == o for i, o in routed.items())
    less = ring.remove("b")
    assert {r.owner for r in less.route(ids).collect()} == {"a", "c"}
    assert less.nodes == ["a", "c"] and ring.add("a").points == ring.points
    assert all(less.owner(i) == o for i, o in routed.items() if o != "b")
    moved = remapped(ids, ring, less).first()
    assert moved.total == 3000 and moved.moved == sum(o == "b" for o in routed.values())
    assert balance(ring.route(ids)).count() == 3 and 1 / 3 <= max_share(ring.route(ids)).first().max_share < 1
    assert Ring([]).route(ids).first().owner is None and Ring([]).owner(1) is None


def test_synonyms(spark):
    entries = spark.createDataFrame([(0, 1, [20, 30]), (1, 1, [40]), (2, 2, [])], "ordinal bigint, term_id bigint, synonyms array<bigint>")
    own = terms.Synonyms(entries)
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "term_id bigint")
    assert sorted(map(tuple, own.expand(wanted).collect())) == [(1, 0, 1), (1, 1, 20), (1, 2, 30), (2, 0, 2), (3, 0, 3)]
    assert sorted(map(tuple, own.search(wanted, of(spark, 30, 3)).collect())) == [(1, 2, 30), (3, 0, 3)]
    assert len(own) == 3


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "The  Red fox\nran"), (2, "a red foxtrot"), (3, None)], "doc_id bigint, text string")
    assert terms.phrase_matches(docs, "red FOX").ids() == [1]
    postings = terms.shingles(docs, 2)
    assert terms.window_candidates(postings, ["red fox", "fox ran"]).ids() == [1]
    assert docs.select(terms.composed(F.lit("é")).alias("x")).first().x == "é"


def test_set_files(spark, tmp_path):
    s = of(spark, 9, 3, 7, 1, (1 << 64) - 1)
    setfile.write_set(s, str(tmp_path / "a.sxset"))
    assert (tmp_path / "a.sxset").read_bytes() == setfile.encode(np.array(s.ids(), np.uint64))
    assert setfile.read_set(spark, str(tmp_path / "a.sxset")).ids() == s.ids()
    setfile.write_set(IdSet.empty(spark), str(tmp_path / "none.sxset"))
    (tmp_path / "bad.sxset").write_bytes(b"nao-e-sxset")
    rows = setfile.read_files(spark, str(tmp_path)).collect()
    assert {r.set_name for r in rows if r.error} == {"bad"}
    assert {r.id & (1 << 64) - 1 for r in rows if r.set_name == "a"} == set(s.ids())
    with pytest.raises(Exception, match="another format"):
        setfile.read_set(spark, str(tmp_path / "bad.sxset")).count()


@pytest.mark.parametrize("raw", [b"SXSET1", b"SXSET1S", b"SXSET1X" + bytes(8), b"SXSET1S" + b"\xff" * 8, b"SXSET1S" + (2).to_bytes(8, "little") + (5).to_bytes(8, "little") * 2, b"SXSET1S" + (2).to_bytes(8, "little") + bytes(8)])
def test_bad_set_files(raw):
    with pytest.raises(ValueError):
        setfile.decode(raw)


def test_good_set_files():
    assert setfile.decode(setfile.encode(np.array([100, 2, 1, 2])) + b"more").tolist() == [1, 2, 100]
    assert setfile.decode(setfile.encode(np.array([], np.uint64))).tolist() == []


def test_text_ids(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# ids\n10, 20;30\n\n\t0040 18446744073709551615 10\n")
    assert text.read_ids(spark, str(tmp_path / "ids.txt")).ids() == [10, 20, 30, 40, (1 << 64) - 1]
    (tmp_path / "bad.txt").write_text("1 -5 +5 1.7 1e3 x 18446744073709551616 2\n")
    assert text.read_ids(spark, str(tmp_path / "bad.txt"), text.PERMISSIVE).ids() == [1, 2]
    with pytest.raises(Exception, match="not an id"):
        text.read_ids(spark, str(tmp_path / "bad.txt")).count()
    with pytest.raises(ValueError):
        text.read_ids(spark, str(tmp_path / "bad.txt"), "lenient")
    (tmp_path / "terms.txt").write_text(" casa \n# x\n\nlar\n")
    assert [r.term for r in text.read_terms(spark, str(tmp_path / "terms.txt")).orderBy("ordinal").collect()] == ["casa", "lar"]


def test_catalog(spark, tmp_path):
    own = Catalog(spark, str(tmp_path / "sets"))
    assert own.names() == []
    assert own.put("a", of(spark, 1, 2, 3, 4)) == 4 and own.put("b é/".replace("/", ""), of(spark, 3, 4, 5, 6)) == 4
    own.put("a", of(spark, 1, 3, 4))
    assert own.names() == ["a", "b é"]
    assert [tuple(r) for r in own.list().collect()] == [("a", 3), ("b é", 4)]
    assert own.has("a", 3) and not own.has("a", 2)
    assert own.intersect(["a", "b é"]).ids() == [3, 4]
    assert own.union(["a", "b é"]).ids() == [1, 3, 4, 5, 6] and own.difference(["a", "b é"]).ids() == [1]
    with pytest.raises(ValueError):
        own.intersect(["a"])
    own.drop("a")
    for f in (own.get, own.drop):
        with pytest.raises(UnknownSet):
            f("a")
    with pytest.raises(ValueError):
        own.put("", of(spark, 1))


def test_plans(spark):
    """Facets reach the scan, and bucketed sets join without an exchange."""
    from idsets import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    own = plan(queries.facets(spark, "/root/testdata/sf0.001")["urgent"].df)
    assert "EqualTo(o_orderpriority,1-URGENT)" in own and "Exchange" not in own and "o_totalprice" not in own
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = queries.stored_intersect_count(spark, "/root/testdata/sf0.001")
        assert plan(stored).count("hashpartitioning") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_command_line(spark, tmp_path, capsys):
    from idsets.__main__ import main

    (tmp_path / "a.txt").write_text("1 2 3 3\n")
    (tmp_path / "b.txt").write_text("2;3;18446744073709551615\n")
    said = lambda *a: (main([str(tmp_path / x) if "." in x else x for x in a]), capsys.readouterr().out)[1]
    assert "4 ids read, 3 different" in said("build", "a.txt", "a.sxset")
    said("build", "b.txt", "b.sxset")
    assert "members 3, bytes 24, from 2 to 18446744073709551615" in said("info", "b.sxset")
    assert said("has", "a.sxset", "2", "9").split() == ["2", "yes", "9", "no"]
    assert said("intersect", "a.sxset", "b.sxset", "--list").split("\n")[:3] == ["2 ids in all of 2 sets", "2", "3"]
    assert said("id", "casa").split() == ["casa", "3125458"]
    (tmp_path / "terms.txt").write_text("casa\nlar\ncasa\n")
    assert said("terms", "terms.txt").startswith("2 terms")


def test_shards_of_unsigned_ids(spark):
    ids = [0, 5, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 0xABCDEF0123456789]
    for shards in (2, 3, 7):
        shape = Shape(1 << 64, shards)
        own = ShardedSet(of(spark, *ids), shape)
        assert sorted((r.shard, r.id % (1 << 64)) for r in own.df.collect()) == sorted((i // shape.bits, i) for i in ids)
        assert own.has((1 << 64) - 1) and not own.has(7)


def test_counts_by_mode(spark):
    for bits in (1 << 20, 1_000_003):
        a = ShardedSet(IdSet(spark.range(10).union(spark.range(400_000, 460_000))), Shape(bits, 8))
        b = ShardedSet(IdSet(spark.range(5, 200).union(spark.range(400_000, 460_000, 2))), Shape(bits, 8))
        plain = {r.shard: r.n for r in a.intersect_counts(b).collect()}
        by_mode = a.intersect_counts_by_mode(b).collect()
        assert {r.shard: r.n for r in by_mode} == plain
        assert {r["modes"] for r in by_mode} == {"sparse-sparse", "dense-dense"}


def test_bit_test(spark):
    own = bitmaps.construct(of(spark, 0, 1, 9, 32_767, 32_768, 32_769, 70_000).df)
    probes = spark.createDataFrame([(i,) for i in (0, 1, 2, 9, 10, 32_767, 32_768, 32_769, 32_770, 70_000, 1 << 40)], "id bigint")
    assert sorted(r.id for r in bitmaps.members(own, probes).filter("member").collect()) == [0, 1, 9, 32_767, 32_768, 32_769, 70_000]


def test_repeats_go_only_where_they_matter(spark):
    twice = spark.createDataFrame([(k % 5,) for k in range(20)], "id bigint")
    a, b = IdSet.from_column(twice), IdSet(spark.range(3, 9))
    assert sorted(a.intersect(b).ids()) == sorted(b.intersect(a).ids()) == [3, 4]
    assert a.intersect(IdSet.from_column(twice)).count() == 5 and a.union(b, a).count() == 9 and sorted(b.difference(a).ids()) == [5, 6, 7, 8]
    assert "Aggregate" not in b.intersect(a).df._jdf.queryExecution().optimizedPlan().toString()


def test_set_file_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(setfile, "BLOCK", 100)
    ids = [k * k + (k % 3 << 62) for k in range(5000)] + [(1 << 64) - 1]
    setfile.write_set(of(spark, *ids), str(tmp_path / "many.sxset"))
    assert setfile.decode((tmp_path / "many.sxset").read_bytes()).tolist() == sorted(set(ids))
    assert setfile.read_set(spark, str(tmp_path / "many.sxset")).count() == len(set(ids))


def test_catalog_names_and_puts(spark, tmp_path):
    own = Catalog(spark, str(tmp_path / "sets"))
    assert own.table().count() == 0
    for name in ("é ü%", "_x", "001"):
        own.put(name, of(spark, 1, 2))
    own.put("001", own.get("001").add(7))
    assert own.names() == sorted(["é ü%", "_x", "001"])
    assert {(r.set_name, r.members) for r in own.list().collect()} == {("é ü%", 2), ("_x", 2), ("001", 3)}
    assert [p.name for p in (tmp_path / "sets").iterdir() if p.name.startswith(".new") or p.name.startswith(".old")] == []


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from idsets.plans.storage import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None)))


def test_functions_for_sql(spark):
    from idsets.functions import sql
    from idsets.operators.ring import Ring

    sql.register(spark)
    assert spark.sql("SELECT positional_id('casa') AS a, positional_id('') AS b, positional_id(NULL) AS c, id_text(-1) AS d").first() == (3125458, 0, None, str((1 << 64) - 1))
    ring = Ring(["a", "b", "c"])
    sql.register_ring(spark, "owner_of", ring)
    sql.register_ring(spark, "nobody", Ring([]))
    rows = spark.sql("SELECT id, owner_of(id) AS owner, nobody(id) AS none FROM range(300)").collect()
    assert all(r.owner == ring.owner(r.id) and r.none is None for r in rows)
