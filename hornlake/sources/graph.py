"""Edge tables: projections of relational tables, bulk loads and a synthetic graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Kinds of nodes, by the letter that their text begins with; a number is the key before the place of its kind.
KINDS = "oscpnr"
KIND_BITS = 4


def _number(kind: str, column: str) -> Column:
    key, most = F.col(column).cast("long"), 1 << (63 - KIND_BITS)
    fits = F.shiftleft(key, KIND_BITS).bitwiseOR(F.lit(KINDS.index(kind)).cast("long"))
    return F.when(key.between(-most, most - 1), fits).when(key.isNotNull(), F.raise_error(F.concat(F.lit(f"{column} is too large: "), key.cast("string"))))


def _text(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind), F.col(column).cast("string"))


def with_ids(edges: DataFrame) -> DataFrame:
    """Edges without parallel ones get an id that depends on their content only."""
    return edges.select(F.xxhash64("rel", "src", "dst").alias("eid"), "src", "rel", "dst", *[c for c in edges.columns if c not in ("eid", "src", "rel", "dst")])


def project(spark: SparkSession, sf_dir: str, relations: tuple[str, ...], coded: bool = False) -> DataFrame:
    """(eid, src, rel, dst) of the named relations over the order tables; nodes are text or, if coded, numbers, one for each text."""
    end = _number if coded else _text

    def _edge(rows: DataFrame, rel: str, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        return rows.select(end(*src).alias("src"), F.lit(rel).alias("rel"), end(*dst).alias("dst"))

    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    of_customer = orders.join(customer, orders.o_custkey == customer.c_custkey)
    of_nation = of_customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    keys = lambda rows, *columns: rows.select(*columns).distinct()  # noqa: E731  # before they become text: numbers are a third of the size
    made = {
        "contains": lambda: _edge(keys(line, "l_orderkey", "l_partkey"), "contains", ("o", "l_orderkey"), ("p", "l_partkey")),
        "filledBy": lambda: _edge(keys(line.where("l_returnflag <> 'R'"), "l_orderkey", "l_suppkey"), "filledBy", ("o", "l_orderkey"), ("s", "l_suppkey")),
        "suppliedBy": lambda: _edge(keys(line.where("l_linenumber <= 2"), "l_partkey", "l_suppkey"), "suppliedBy", ("p", "l_partkey"), ("s", "l_suppkey")),
        "placedBy": lambda: _edge(orders, "placedBy", ("o", "o_orderkey"), ("c", "o_custkey")),
        "places": lambda: _edge(orders, "places", ("c", "o_custkey"), ("o", "o_orderkey")),
        "custNation": lambda: _edge(customer, "custNation", ("c", "c_custkey"), ("n", "c_nationkey")),
        "suppNation": lambda: _edge(supplier, "suppNation", ("s", "s_suppkey"), ("n", "s_nationkey")),
        "inRegion": lambda: _edge(nation, "inRegion", ("n", "n_nationkey"), ("r", "n_regionkey")),
        "shipsToNation": lambda: _edge(of_customer.where("o_orderstatus <> 'P'"), "shipsToNation", ("o", "o_orderkey"), ("n", "c_nationkey")),
        "shipsToRegion": lambda: _edge(of_nation.where("o_orderstatus = 'F'"), "shipsToRegion", ("o", "o_orderkey"), ("r", "n_regionkey")),
        "custRegion": lambda: _edge(
            customer.where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "custRegion", ("c", "c_custkey"), ("r", "n_regionkey")
        ),
        "notShipped": lambda: _edge(of_customer.where("o_orderpriority = '1-URGENT'"), "notShipped", ("o", "o_orderkey"), ("n", "c_nationkey")),
    }
    edges = None
    for name in relations:
        edges = made[name]() if edges is None else edges.unionByName(made[name]())
    return with_ids(edges)


ORDERS = ("contains", "filledBy", "suppliedBy", "placedBy", "custNation", "suppNation", "inRegion", "shipsToNation", "shipsToRegion", "custRegion")
CHAINS = ("places", "contains", "suppliedBy", "suppNation", "inRegion", "custNation", "custRegion")


def factual(edges: DataFrame, factual_only: bool = True) -> DataFrame:
    """Edges that no rule made, or all."""
    if not factual_only or "is_inferred" not in edges.columns:
        return edges
    return edges.where(~F.coalesce("is_inferred", F.lit(False)))


def load_nodes(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Each id once."""
    return rows.select(F.col(id_col).cast("string").alias("id")).where(F.col("id").isNotNull()).dropDuplicates(["id"])


def load_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, rel, dst) rows whose ends are nodes, each once, with ids."""
    known = nodes.select("id")
    kept = rows.select("src", "rel", "dst").dropDuplicates(["src", "rel", "dst"])
    kept = kept.join(known, kept.src == known.id, "left_semi")
    return with_ids(kept.join(known, kept.dst == known.id, "left_semi"))


def synthetic(spark: SparkSession, persons=20_000, cities=2_000, countries=200, regions=20, companies=5_000, universities=1_000, seed=42) -> DataFrame:
    """People, places and employers: nine relations, drawn by hashes of (seed, what, number)."""
    draw = lambda what, key, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), key), F.lit(n)).cast("long")
    name = lambda kind, key: F.concat(F.lit(f"{kind}_"), key.cast("string"))
    edge = lambda rows, rel, src, dst: rows.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    i = F.col("id")
    city = spark.range(cities).withColumn("country", draw("country", i, countries))
    person = spark.range(persons).withColumns({"city": draw("city", i, cities), "company": draw("company", i, companies), "university": draw("university", i, universities)})
    person = person.withColumn("country", draw("country", F.col("city"), countries))
    country = spark.range(countries)
    # A company sits in the country of its least employee, if it has any.
    employer = person.groupBy("company").agg(F.min_by("country", "id").alias("country"))
    seat = spark.range(companies).join(employer, F.col("id") == F.col("company"), "left").select("id", F.coalesce("country", draw("seat", i, countries)).alias("country"))
    made = [
        edge(city, "locatedIn", name("city", i), name("country", F.col("country"))),
        edge(country, "partOf", name("country", i), name("region", draw("region", i, regions))),
        edge(person, "bornIn", name("person", i), name("city", F.col("city"))),
        edge(person, "livesIn", name("person", i), name("city", F.col("city"))),
        edge(person, "nationality", name("person", i), name("country", F.col("country"))),
        edge(person.where(draw("none", i, 100) < 3), "noNationality", name("person", i), name("country", F.col("country"))),
        edge(person, "worksAt", name("person", i), name("company", F.col("company"))),
        edge(person, "educatedAt", name("person", i), name("university", F.col("university"))),
        edge(seat, "headquartersIn", name("company", i), name("country", F.col("country"))),
    ]
    edges = made[0]
    for more in made[1:]:
        edges = edges.unionByName(more)
    return with_ids(edges)
