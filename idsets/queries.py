"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idsets.functions import hashing, sql, unsigned
from idsets.operators import bitmaps, terms
from idsets.operators.dictionary import Index, Keyer, dense_ids
from idsets.operators.idset import IdSet
from idsets.operators.ring import Ring, balance, max_share, remapped, shard_owners
from idsets.operators.sharding import Shape, ShardedSet
from idsets.plans import planner
from idsets.plans.storage import scratch, scratch_table, written
from idsets.sources import catalog, setfile, text

SQL: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

_URGENT = "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'"
_LARGE = "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_totalprice >= 100000"
_RETURNED = "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'"
_THREE = f"{_URGENT} INTERSECT {_LARGE} INTERSECT {_RETURNED}"
#: The least shape of the sharded queries (its universe grows with greater ids), the nodes of the ring and the phrase's place: parameters.
SHAPE = Shape(1 << 20, 8)
NODES = ("node-a", "node-b", "node-c")


def query(text: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facets(spark: SparkSession, sf_dir: str) -> dict[str, IdSet]:
    """Orders that are urgent, large or have a returned line. o_orderkey is a key, so only lines need a distinct."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return {
        "urgent": IdSet.facet(orders, F.col("o_orderpriority") == "1-URGENT", "o_orderkey", unique=True),
        "large": IdSet.facet(orders, F.col("o_totalprice") >= 100000, "o_orderkey", unique=True),
        "returned": IdSet.facet(lines, F.col("l_returnflag") == "R", "l_orderkey"),
    }


def long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, s in facets(spark, sf_dir).items():
        rows = s.df.select(F.lit(name).alias("set_name"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


_LONG = f"SELECT 'urgent' AS set_name, id FROM ({_URGENT}) UNION ALL SELECT 'large', id FROM ({_LARGE}) UNION ALL SELECT 'returned', id FROM ({_RETURNED})"

# set algebra


@query(f"SELECT id FROM ({_THREE})")
def facet_intersect(spark, sf_dir):
    """urgent and large are facets of one table: one filter of it, and one semi-join."""
    f = facets(spark, sf_dir)
    return f["urgent"].intersect(f["large"], f["returned"]).df


@query(f"SELECT count(*) AS n FROM ({_THREE})")
def facet_intersect_count(spark, sf_dir):
    f = facets(spark, sf_dir)
    return f["urgent"].intersect(f["large"], f["returned"]).df.agg(F.count("*").alias("n"))


@query(f"{_URGENT} UNION {_RETURNED}")
def facet_union(spark, sf_dir):
    f = facets(spark, sf_dir)
    return f["urgent"].union(f["returned"]).df


@query(f"{_LARGE} EXCEPT {_RETURNED}")
def facet_difference(spark, sf_dir):
    f = facets(spark, sf_dir)
    return f["large"].difference(f["returned"]).df


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def filter_mask(spark, sf_dir):
    base = IdSet.facet(read(spark, sf_dir, "customer"), "c_acctbal > 5000", "c_custkey", unique=True)
    return base.filter(IdSet.facet(read(spark, sf_dir, "orders"), "o_orderstatus = 'F'", "o_custkey")).df


@query("SELECT id FROM (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT unnest([-1, 9223372036854775807]) AS id)")
def add_ids(spark, sf_dir):
    return IdSet.from_column(read(spark, sf_dir, "orders"), "o_custkey").add((1 << 64) - 1, (1 << 63) - 1).df


# membership


@query("SELECT event_id, user_id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS member FROM events")
def has_batch(spark, sf_dir):
    own = IdSet.facet(read(spark, sf_dir, "customer"), "c_acctbal > 0", "c_custkey", unique=True)
    return own.members(read(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


@query("SELECT min(event_id) AS ordinal, user_id AS id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id")
def search_batch_ordered(spark, sf_dir):
    own = IdSet.facet(read(spark, sf_dir, "customer"), "c_acctbal > 0", "c_custkey", unique=True)
    return own.search(read(spark, sf_dir, "events"), "event_id", "user_id")


@query("SELECT 10 AS id, 10 IN (SELECT o_orderkey FROM orders) AS member UNION ALL SELECT -1, -1 IN (SELECT o_orderkey FROM orders)")
def has_one(spark, sf_dir):
    own = IdSet.from_column(read(spark, sf_dir, "orders"), "o_orderkey", unique=True)
    probes = spark.createDataFrame([(10,), (-1,)], "id int")
    hit = own.df.filter(F.col("id").isin(10, -1)).withColumnRenamed("id", "hit")
    return probes.join(F.broadcast(hit), F.col("id") == F.col("hit"), "left").select("id", F.col("hit").isNotNull().alias("member"))  # two rows at most


# catalog


@query(f"SELECT set_name, count(*) AS members FROM ({_LONG}) GROUP BY set_name")
def catalog_list(spark, sf_dir):
    return catalog.listing(long_table(spark, sf_dir))


@query(f"SELECT count(*) AS members, count(*) * 8 AS bytes, min(id) AS min_id, max(id) AS max_id FROM ({_RETURNED})")
def set_info(spark, sf_dir):
    return facets(spark, sf_dir)["returned"].info()


@query(f"SELECT id FROM ({_LONG}) GROUP BY id HAVING count(DISTINCT set_name) = 3")
def named_intersect(spark, sf_dir):
    return catalog.intersect_named(long_table(spark, sf_dir), ["urgent", "large", "returned"]).df


@query(f"SELECT id FROM ({_URGENT} INTERSECT {_RETURNED})")
def catalog_intersect(spark, sf_dir):
    """The sets are put into a catalog on disk first."""
    own = catalog.Catalog(spark, scratch(spark, "catalog"))
    for name, s in facets(spark, sf_dir).items():
        if name != "large":
            own.put(name, s)
    return own.intersect(["urgent", "returned"]).df


def _catalog(spark, sf_dir) -> catalog.Catalog:
    own = catalog.Catalog(spark, scratch(spark, "catalog"))
    for name, s in facets(spark, sf_dir).items():
        own.put(name, s)
    return own


@query(f"SELECT id FROM ({_URGENT} UNION {_RETURNED})")
def catalog_union(spark, sf_dir):
    return _catalog(spark, sf_dir).union(["urgent", "returned"]).df


@query(f"SELECT id FROM ({_LARGE} EXCEPT {_RETURNED})")
def catalog_difference(spark, sf_dir):
    return _catalog(spark, sf_dir).difference(["large", "returned"]).df


@query(f"SELECT set_name, count(*) AS members FROM ({_LONG}) WHERE set_name <> 'large' GROUP BY set_name")
def catalog_drop(spark, sf_dir):
    """A name is dropped, another put over itself, and the rest listed from the catalog's folder."""
    own = _catalog(spark, sf_dir)
    own.drop("large")
    own.put("urgent", own.get("urgent"))
    return own.list()


@query(f"SELECT id, id IN (SELECT id FROM ({_URGENT})) AS member FROM (SELECT unnest([0, 1, 2, 3, -1])::BIGINT AS id)")
def catalog_has(spark, sf_dir):
    own = _catalog(spark, sf_dir)
    return spark.createDataFrame([(i, own.has("urgent", i % (1 << 64))) for i in (0, 1, 2, 3, -1)], "id bigint, member boolean")


@query(f"SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS place, id FROM ({_LARGE})")
def set_ordered(spark, sf_dir):
    """The ids with their places in the order, sorted in ranges."""
    return dense_ids(facets(spark, sf_dir)["large"].df, "id", name="place").select("place", "id")


@query(f"SELECT id::VARCHAR AS text FROM ({_LARGE}) UNION ALL SELECT '18446744073709551615'")
def exported_ids(spark, sf_dir):
    own = facets(spark, sf_dir)["large"].add((1 << 64) - 1)
    return own.df.select(unsigned.shown(F.col("id")).cast("string").alias("text"))


# hashes

_HUGE = "18446744073709551616::HUGEINT"


def _positional(term: str) -> str:
    digits = f"list_transform(range(len({term}), 0, -1), lambda i: unicode({term}[i]) + strlen({term}[1:i-1]) + 1)"
    return f"CASE WHEN {term} = '' THEN 0::HUGEINT ELSE list_reduce(list_prepend(0::HUGEINT, list_transform({digits}, lambda d: d::HUGEINT)), lambda a, d: (a * 31 + d) % {_HUGE}) END"


@query(f"SELECT term, ({_positional('term')})::DECIMAL(20,0) AS id FROM (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT c_name FROM customer)")
def positional_id(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("term")).unionByName(read(spark, sf_dir, "customer").select(F.col("c_name").alias("term"))).distinct()
    return names.select("term", unsigned.shown(hashing.positional_id(F.col("term"))).alias("id"))


@query(f"SELECT count(*) AS terms, count(*) - count(DISTINCT h) AS collisions FROM (SELECT {_positional('term')} AS h FROM (SELECT DISTINCT substr(p_name, 1, 3) AS term FROM part UNION SELECT DISTINCT substr(c_name, 10, 9) FROM customer))")
def collision_rate(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.substring("p_name", 1, 3).alias("term")).unionByName(read(spark, sf_dir, "customer").select(F.substring("c_name", 10, 9).alias("term"))).distinct()
    return names.agg(F.count("*").alias("terms"), (F.count("*") - F.countDistinct(hashing.positional_id(F.col("term")))).alias("collisions"))


@query(f"SELECT term, ({_positional('term')})::DECIMAL(20,0)::VARCHAR AS id FROM (SELECT DISTINCT p_name AS term FROM part)")
def sql_positional_id(spark, sf_dir):
    """By the functions for SQL."""
    sql.register(spark)
    read(spark, sf_dir, "part").createOrReplaceTempView("idsets_part")
    return spark.sql("SELECT term, id_text(positional_id(term)) AS id FROM (SELECT DISTINCT p_name AS term FROM idsets_part)")


# dictionaries

_KEYER = "SELECT term, (row_number() OVER (ORDER BY first) - 1)::BIGINT AS id FROM (SELECT p_name AS term, min(p_partkey) AS first FROM part GROUP BY p_name)"


def _keyer(spark, sf_dir) -> Keyer:
    return Keyer.build(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("term")))


@query(_KEYER)
def keyer_build(spark, sf_dir):
    return _keyer(spark, sf_dir).df


_WANTED = "SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN p_name || '?' ELSE p_name END AS term FROM part"


def _wanted(spark, sf_dir) -> DataFrame:
    term = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), term.alias("term"))


@query(f"SELECT ordinal, w.term AS term, k.id AS id FROM ({_WANTED}) w LEFT JOIN ({_KEYER}) k ON w.term = k.term")
def keyer_lookup(spark, sf_dir):
    return _keyer(spark, sf_dir).lookup(_wanted(spark, sf_dir)).select("ordinal", "term", "id")


@query(f"SELECT ordinal, term FROM ({_WANTED}) WHERE term NOT IN (SELECT p_name FROM part)")
def keyer_missing(spark, sf_dir):
    return _keyer(spark, sf_dir).id_set(_wanted(spark, sf_dir))[1].select("ordinal", "term")


@query(f"SELECT DISTINCT k.id AS id FROM ({_WANTED}) w JOIN ({_KEYER}) k ON w.term = k.term")
def keyer_id_set(spark, sf_dir):
    return _keyer(spark, sf_dir).id_set(_wanted(spark, sf_dir))[0].df


@query(f"SELECT x.id AS id, k.term AS term FROM (SELECT unnest(range(0, 100, 7))::BIGINT AS id) x LEFT JOIN ({_KEYER}) k ON x.id = k.id")
def keyer_terms(spark, sf_dir):
    return _keyer(spark, sf_dir).terms(spark.range(0, 100, 7)).select("id", "term")


@query(f"SELECT count(*) AS terms, sum(strlen(term) + 8)::BIGINT AS bytes, 8.0 * sum(strlen(term) + 8) / count(*) AS bits_per_term, count(*) - count(DISTINCT {_positional('term')}) AS collisions FROM ({_KEYER})")
def keyer_sizes(spark, sf_dir):
    """What a dictionary holds, and how many of its terms a positional hash would confuse."""
    return _keyer(spark, sf_dir).sizes()


_DENSE = "SELECT key, (row_number() OVER (ORDER BY first, key) - 1)::BIGINT AS dense_id FROM (SELECT user_id AS key, min(event_id) AS first FROM events GROUP BY user_id)"


@query(_DENSE)
def index_dense(spark, sf_dir):
    return Index.build(read(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("key"))).df


@query(f"SELECT c_custkey AS key, dense_id FROM customer LEFT JOIN ({_DENSE}) d ON c_custkey = d.key")
def index_lookup(spark, sf_dir):
    own = Index.build(read(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("key")))
    return own.lookup(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query(f"SELECT (SELECT count(*) FROM ({_KEYER})) AS terms, (SELECT count(*) FROM ({_DENSE})) AS keys, (SELECT count(*) FROM part) AS entries")
def dictionary_lengths(spark, sf_dir):
    index = Index.build(read(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("key")))
    return spark.createDataFrame([(len(_keyer(spark, sf_dir)), len(index), len(_synonyms(spark, sf_dir)))], "terms bigint, keys bigint, entries bigint")


# bitmaps and plans


@query(f"SELECT event_id, user_id, user_id IN ({_RETURNED}) AS member FROM events")
def bit_test(spark, sf_dir):
    """Ids tested against a set's bitmap."""
    own = bitmaps.construct(facets(spark, sf_dir)["returned"].df)
    return bitmaps.members(own, read(spark, sf_dir, "events").select("event_id", "user_id"), "user_id")


@query(f"SELECT count(*) AS n FROM ({_URGENT} INTERSECT {_RETURNED})")
def word_range_count(spark, sf_dir):
    """Two sets as ranges of words in stored partitions."""
    f = facets(spark, sf_dir)
    a, b = (written(bitmaps.word_ranges(f[n].df, 4), "word_ranges") for n in ("urgent", "returned"))
    return bitmaps.count_words(bitmaps.and_words(a, b))


_STEPS = (1, 3, 10, 100, 1000)


@query(" UNION ALL ".join(f"SELECT {k} AS step, count(*) AS n FROM ({_RETURNED}) WHERE id % {k} = 0" for k in _STEPS))
def sparse_sweep(spark, sf_dir):
    """A set against ever sparser ones, from one scan of it: the ids that each step divides."""
    own = facets(spark, sf_dir)["returned"].df
    return own.select(F.explode(F.filter(F.array(*map(F.lit, _STEPS)), lambda k: F.col("id") % k == 0)).alias("step")).groupBy("step").agg(F.count("*").alias("n"))


@query(f"SELECT id FROM ({_THREE})")
def dense_intersect(spark, sf_dir):
    f = facets(spark, sf_dir)
    return f["urgent"].intersect_dense(f["large"], f["returned"]).df


@query(f"SELECT count(*) AS n FROM ({_THREE})")
def dense_count(spark, sf_dir):
    return bitmaps.count(bitmaps.intersect([bitmaps.construct(s.df) for s in facets(spark, sf_dir).values()]))


@query(f"SELECT id FROM ({_URGENT} UNION {_RETURNED})")
def dense_union(spark, sf_dir):
    f = facets(spark, sf_dir)
    return bitmaps.extract(bitmaps.union([bitmaps.construct(f[n].df) for n in ("urgent", "returned")]))


@query(_RETURNED)
def dense_extract(spark, sf_dir):
    return bitmaps.extract(bitmaps.construct(facets(spark, sf_dir)["returned"].df))


@query(f"SELECT id FROM ({_THREE})")
def auto_intersect(spark, sf_dir):
    f = facets(spark, sf_dir)
    return f["urgent"].intersect_auto(f["large"], f["returned"]).df


@query(
    f"SELECT k, universe, total, (k >= 2 AND universe > 0 AND (2 * k - 1) * (universe // 64 + 1) < total AND k * (universe // 64 + 1) * 8 <= 134217728) AS dense "
    f"FROM (SELECT count(DISTINCT set_name) AS k, max(id) + 1 AS universe, count(*) AS total FROM ({_LONG}))"
)
def plan_choice(spark, sf_dir):
    sizes = planner.statistics([s.df for s in facets(spark, sf_dir).values()])
    rows = sizes.agg(F.count("*").alias("k"), (F.max("max_id") + 1).alias("universe"), F.sum("size").alias("total"))
    return rows.select("*", planner.dense_column(F.col("k"), F.col("universe"), F.col("total")).alias("dense"))


@query(f"SELECT count(*) AS n FROM ({_URGENT} INTERSECT {_RETURNED})")
def word_intersect_count(spark, sf_dir):
    f = facets(spark, sf_dir)
    return bitmaps.count_words(bitmaps.and_words(bitmaps.words(f["urgent"].df), bitmaps.words(f["returned"].df)))


@query(f"SELECT id // 64 AS word_idx, count(*) AS n FROM ({_RETURNED}) GROUP BY 1")
def word_counts(spark, sf_dir):
    return bitmaps.words(facets(spark, sf_dir)["returned"].df).select("word_idx", F.bit_count("word").cast("bigint").alias("n"))


# shards



def _width(every: str) -> str:
    """The ids of a shard: the universe reaches to the greatest id of every set in the query, and is SHAPE's at least."""
    return f"((greatest({SHAPE.universe}, coalesce((SELECT max(id) FROM ({every})), 0) + 1) + {SHAPE.shards - 1}) // {SHAPE.shards})"


def _counts(own: str, every: str) -> str:
    return f"SELECT s.shard AS shard, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range({SHAPE.shards}))::INT AS shard) s LEFT JOIN (SELECT (id // {_width(every)})::INT AS shard, count(*) AS n FROM ({own}) GROUP BY 1) c ON s.shard = c.shard"


def _modes(own: str, every: str) -> str:
    return f"SELECT shard, n, CASE WHEN n < {_width(every)} // 64 THEN 'sparse' ELSE 'dense' END AS mode FROM ({_counts(own, every)})"


_BOTH = f"{_URGENT} UNION {_RETURNED}"


def sharded(*sets: IdSet) -> list[ShardedSet]:
    """The sets over SHAPE's shards, whose universe reaches to the greatest id of all of them where that is beyond SHAPE's."""
    every = sets[0].df
    for s in sets[1:]:
        every = every.unionByName(s.df)
    greatest = every.agg(F.max("id")).first()[0]
    shape = Shape(max(SHAPE.universe, (greatest or 0) + 1), SHAPE.shards)
    return [ShardedSet(s, shape) for s in sets]


@query(_counts(_RETURNED, _RETURNED))
def shard_counts(spark, sf_dir):
    return sharded(facets(spark, sf_dir)["returned"])[0].counts()


@query(_modes(_RETURNED, _RETURNED))
def shard_modes(spark, sf_dir):
    return sharded(facets(spark, sf_dir)["returned"])[0].modes()


@query(f"SELECT shard, mode, (CASE WHEN mode = 'sparse' THEN n * 8 ELSE ({_width(_RETURNED)} + 63) // 64 * 8 END)::BIGINT AS bytes FROM ({_modes(_RETURNED, _RETURNED)})")
def shard_bytes(spark, sf_dir):
    return sharded(facets(spark, sf_dir)["returned"])[0].bytes()


@query(f"SELECT count(*) AS n FROM ({_URGENT} INTERSECT {_RETURNED})")
def shard_intersect_count(spark, sf_dir):
    f = facets(spark, sf_dir)
    urgent, returned = sharded(f["urgent"], f["returned"])
    return urgent.intersect_count(returned)


@query(
    f"SELECT shard, a.mode || '-' || b.mode AS modes, n FROM (SELECT (id // {_width(_BOTH)})::INT AS shard, count(*) AS n FROM ({_URGENT} INTERSECT {_RETURNED}) GROUP BY 1) "
    f"JOIN (SELECT shard, mode FROM ({_modes(_URGENT, _BOTH)})) a USING (shard) JOIN (SELECT shard, mode FROM ({_modes(_RETURNED, _BOTH)})) b USING (shard)"
)
def shard_counts_by_mode(spark, sf_dir):
    f = facets(spark, sf_dir)
    urgent, returned = sharded(f["urgent"], f["returned"])
    return urgent.intersect_counts_by_mode(returned)


@query(f"SELECT id, id IN ({_RETURNED}) AS member FROM (SELECT unnest([0, 1, 5, 4096, 1099511627776, -1])::BIGINT AS id)")
def sharded_has(spark, sf_dir):
    own = sharded(facets(spark, sf_dir)["returned"])[0]
    return spark.createDataFrame([(i, own.has(i % (1 << 64))) for i in (0, 1, 5, 4096, 1 << 40, -1)], "id bigint, member boolean")


# ring


def _points(ring: Ring) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({p}::HUGEINT, '{n}')" for p, n in ring.points) + ") AS v(point, node)"


def _owners(ring: Ring, ids: str = "SELECT c_custkey AS id FROM customer") -> str:
    steps = f"list_reduce(list_prepend({hashing.FNV_BASIS}::HUGEINT, list_transform(range(8), lambda k: ((id >> (8 * k)::INT) & 255)::HUGEINT)), lambda h, b: (xor(h, b) * {hashing.FNV_PRIME}) % {_HUGE})"
    first = min(ring.points)[1]
    return f"SELECT id, coalesce((SELECT arg_min(node, point) FROM ({_points(ring)}) WHERE point >= h), '{first}') AS owner FROM (SELECT id, {steps} AS h FROM ({ids}))"


_RING, _MORE = Ring(list(NODES)), Ring([*NODES, "node-d"])


def _customers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


@query(_owners(_RING))
def sql_ring_owner(spark, sf_dir):
    """By the functions for SQL."""
    sql.register_ring(spark, "idsets_owner", _RING)
    _customers(spark, sf_dir).createOrReplaceTempView("idsets_customers")
    return spark.sql("SELECT id, idsets_owner(id) AS owner FROM idsets_customers")


@query(_owners(_RING))
def ring_route(spark, sf_dir):
    return _RING.route(_customers(spark, sf_dir))


@query(f"SELECT owner, count(*) AS n FROM ({_owners(_RING)}) GROUP BY owner")
def ring_balance(spark, sf_dir):
    return balance(_RING.route(_customers(spark, sf_dir)))


@query(f"SELECT max(n)::DOUBLE / sum(n) AS max_share FROM (SELECT owner, count(*) AS n FROM ({_owners(_RING)}) GROUP BY owner)")
def ring_max_share(spark, sf_dir):
    return max_share(_RING.route(_customers(spark, sf_dir)))


@query(f"SELECT count(*) AS total, count(*) FILTER (a.owner <> b.owner) AS moved FROM ({_owners(_RING)}) a JOIN ({_owners(_MORE)}) b USING (id)")
def ring_remap(spark, sf_dir):
    return remapped(_customers(spark, sf_dir), _RING, _MORE)


_SHARDS = "SELECT unnest(range(12))::BIGINT AS id"


@query(f"SELECT owner, count(*) AS n FROM ({_owners(_RING, _SHARDS)}) GROUP BY owner")
def shards_per_node(spark, sf_dir):
    return balance(shard_owners(spark, 12, _RING))


@query(f"SELECT a.id AS shard, a.owner AS before, b.owner AS after FROM ({_owners(_RING, _SHARDS)}) a JOIN ({_owners(_MORE, _SHARDS)}) b USING (id) WHERE a.owner <> b.owner")
def moved_shards(spark, sf_dir):
    both = _MORE.route(shard_owners(spark, 12, _RING), "shard", "after")
    return both.filter("owner <> after").select("shard", F.col("owner").alias("before"), "after")


# terms

_ENTRIES = "SELECT p_partkey AS ordinal, p_partkey % 50 AS term_id, [p_size::BIGINT, (p_partkey * 7) % 200] AS synonyms FROM part"
_FIRST = f"SELECT term_id, arg_min(synonyms, ordinal) AS synonyms FROM ({_ENTRIES}) GROUP BY term_id"
_EXPANDED = f"SELECT term_id, (generate_subscripts(everything, 1) - 1)::INT AS place, unnest(everything) AS id FROM (SELECT t.term_id AS term_id, list_prepend(t.term_id, coalesce(synonyms, [])) AS everything FROM (SELECT unnest(range(60))::BIGINT AS term_id) t LEFT JOIN ({_FIRST}) s ON t.term_id = s.term_id)"


def _synonyms(spark, sf_dir) -> terms.Synonyms:
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return terms.Synonyms(part.select(key.alias("ordinal"), (key % 50).alias("term_id"), F.array(F.col("p_size").cast("bigint"), (key * 7) % 200).alias("synonyms")))


@query(_EXPANDED)
def synonym_expand(spark, sf_dir):
    return _synonyms(spark, sf_dir).expand(spark.range(60).withColumnRenamed("id", "term_id"))


@query(f"SELECT term_id, place, id FROM ({_EXPANDED}) WHERE id IN (SELECT s_suppkey FROM supplier)")
def expanded_search(spark, sf_dir):
    own = IdSet.from_column(read(spark, sf_dir, "supplier"), "s_suppkey", unique=True)
    return _synonyms(spark, sf_dir).search(spark.range(60).withColumnRenamed("id", "term_id"), own)


def _normal(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT {_normal('p_type')} AS term FROM part")
def normalised_terms(spark, sf_dir):
    return read(spark, sf_dir, "part").select(terms.normalised(F.col("p_type")).alias("term")).distinct()


@query(r"SELECT DISTINCT nfc_normalize(p_type || ' cafe' || chr(769)) AS term FROM part")
def composed_terms(spark, sf_dir):
    return read(spark, sf_dir, "part").select(terms.composed(F.concat("p_type", F.lit(" cafe\u0301"))).alias("term")).distinct()


@query(f"SELECT doc_id AS id FROM documents WHERE contains(' ' || {_normal('text')} || ' ', ' of the ')")
def phrase_match(spark, sf_dir):
    return terms.phrase_matches(read(spark, sf_dir, "documents"), "of  The").df


_POSTINGS = f"SELECT DISTINCT c_custkey AS id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS shingle FROM (SELECT p_partkey AS c_custkey, list_filter(string_split({_normal('p_name')}, ' '), lambda x: x <> '') AS w FROM part)"


@query(f"SELECT shingle, count(DISTINCT id) AS n FROM ({_POSTINGS}) GROUP BY shingle")
def shingle_postings(spark, sf_dir):
    return terms.shingles(read(spark, sf_dir, "part"), 2, "p_partkey", "p_name").groupBy("shingle").agg(F.countDistinct("id").alias("n"))


_WINDOWS = "SELECT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) FROM part WHERE p_partkey = 1"


@query(f"SELECT DISTINCT id FROM ({_POSTINGS}) WHERE shingle IN ({_WINDOWS})")
def window_candidates(spark, sf_dir):
    """The parts with the first window of part 1's name."""
    part = read(spark, sf_dir, "part")
    first = part.filter("p_partkey = 1").select(F.concat_ws(" ", F.split("p_name", " ")[0], F.split("p_name", " ")[1])).first()
    return terms.window_candidates(terms.shingles(part, 2, "p_partkey", "p_name"), [first[0]] if first else []).df


@query(f"SELECT min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY {_normal('text')}")
def context_dedup(spark, sf_dir):
    return terms.distinct_contexts(read(spark, sf_dir, "documents"))


# files


@query(f"SELECT 'large' AS set_name, id, NULL::VARCHAR AS error FROM ({_LARGE}) UNION ALL SELECT 'returned', id, NULL FROM ({_RETURNED})")
def set_file_round_trip(spark, sf_dir):
    """Two portable set files, encoded by executors, and their folder read back by executors."""
    path = scratch(spark, "setfiles")
    for name in ("large", "returned"):
        setfile.write_set(facets(spark, sf_dir)[name], f"{path}/{name}{setfile.SUFFIX}")
    return setfile.read_files(spark, path)


@query("SELECT trim(p_name) AS term, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")
def term_file(spark, sf_dir):
    """A term file with blanks and comments, and the lines that are terms."""
    path = scratch(spark, "terms")
    line = F.when(F.col("p_size") > 10, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(F.col("p_size") > 5, F.concat(F.lit("# "), "p_name")).otherwise(F.lit(" "))
    read(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return text.read_terms(spark, path).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT unnest([1, 2, 3, -1, 40])::BIGINT AS id")
def text_ids(spark, sf_dir):
    lines = spark.createDataFrame([("# a comment",), ("1, 2;3",), ("",), ("  18446744073709551615\t2",), ("x 40 -7 1.5 18446744073709551616",)], "value string")
    return IdSet.from_column(text.parse_ids(lines, text.PERMISSIVE)).df


@query("SELECT unnest([1, 2, 9223372036854775807, -9223372036854775808])::BIGINT AS id")
def json_ids(spark, sf_dir):
    bodies = spark.createDataFrame([('{"ids": [1, 2, 2]}',), ('{"ids": [9223372036854775807, 9223372036854775808]}',), ("{}",)], "body string")
    return text.read_json_ids(bodies).df


# stored and ad-hoc intersections


@query(f"SELECT count(*) AS n FROM ({_URGENT} INTERSECT {_RETURNED})")
def stored_intersect_count(spark, sf_dir):
    """Two tables bucketed alike: the join has no exchange."""
    names = []
    for name in ("urgent", "returned"):
        names.append(scratch_table(spark, name))
        catalog.store_bucketed(facets(spark, sf_dir)[name], names[-1], 8)
    a, b = (IdSet(spark.table(n)) for n in names)
    return a.intersect_count(b)


@query(f"SELECT count(*) AS n FROM ({_RETURNED}) WHERE id IN (SELECT unnest(range(0, 3000, 3)))")
def adhoc_intersect_count(spark, sf_dir):
    """The ad-hoc set comes from the driver, so its size is known, and it is broadcast."""
    wanted = spark.range(0, 3000, 3)
    return facets(spark, sf_dir)["returned"].df.join(F.broadcast(wanted), "id", "left_semi").agg(F.count("*").alias("n"))


# retrieval


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def permitted_candidates(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    english = IdSet.facet(read(spark, sf_dir, "documents"), "lang = 'en'", "doc_id")
    return english.intersect(IdSet.facet(labels, "quality = 1", "doc_id")).difference(IdSet.facet(labels, "toxic = 1", "doc_id")).df


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY event_type")
def stream_members(spark, sf_dir):
    """The events read as a stream, probed batch by batch, and what came through."""
    from idsets.streaming.probe import members_of

    events = read(spark, sf_dir, "events")
    own = IdSet.facet(read(spark, sf_dir, "customer"), "c_mktsegment = 'BUILDING'", "c_custkey", unique=True)
    path = scratch(spark, "stream")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else _linked(spark, sf_dir, path))
    out = members_of(stream, "user_id", own).select("event_type", "user_id")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string, user_id bigint").parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def _is_folder(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _linked(spark, sf_dir: str, path: str) -> str:
    """A stream reads folders: a copy of the one file in a folder of its own."""
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{path}/in")
    return f"{path}/in"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
