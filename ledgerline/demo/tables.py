"""Domain extracts and references derived from the TPC-H-style test tables.

Every table is a Spark plan over the given parquet files, so its size grows with
the scale factor. Attribute assignments use arithmetic on keys and sizes to hit
every rule of the reports (missing values, retired codes, blank categories,
unknown facilities, several routes per customer, ...). The same derivations are
written independently as DuckDB SQL in :mod:`ledgerline.demo.oracle`.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.params import Params
from ledgerline.session import freed_shuffles, scratch_dir
from ledgerline.sources.order import KEY_TEXTS, compact

DEMO_PARAMS = Params(
    distributor="Demo Distributor",
    special_customers=("C7", "C11", "C300"),
    product_token="12",
    token_mode="Y",
)

DEC = "decimal(12,2)"


def _code(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _sku(partkey: str = "l_partkey", size: str = "p_size") -> Column:
    """Part key as text; every tenth size carries the retired-code suffix."""
    return F.concat(F.col(partkey).cast("string"), F.when(F.col(size) % 10 == 0, F.lit("_old")).otherwise(F.lit("")))


def _uom(linenumber: str = "l_linenumber") -> Column:
    n = F.col(linenumber)
    return (F.when(n == 1, "Case").when(n == 2, "INF_PROD_CAS").when(n == 3, "Subcase")
            .when(n == 4, "Piece").when(n == 5, F.lit(None).cast("string")).otherwise("Case"))


def _case(col: Column, mapping: list[tuple[int, object]], default=None) -> Column:
    out = None
    for k, v in mapping:
        cond = col == k
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default))


EXTRACTS = [
    "invoice", "returns", "sales_order", "customer", "route", "price", "category", "supervisor", "calendar",
    "classification", "gt_channel", "new_customer", "deductions", "free_goods",
]


class DerivedTables:
    """Domain tables as lazy plans over the raw test tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, spread: bool = False, part: tuple[int, int] = (0, 1)):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._spread = spread
        self._part = part

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _source(self, name: str, *cols: str) -> DataFrame:
        """Columns of a raw table behind the fact extracts.

        With ``spread``, rows of a file that Spark would read with fewer tasks than there are
        cores are dealt to all of them here, where rows are narrow and few. Larger files are
        split by their scans and are not shuffled for it.
        """
        df = self.raw(name).select(*cols)
        cores = self.spark.sparkContext.defaultParallelism
        if self._spread and _file_bytes(self.spark, f"{self.sf_dir}/{name}.parquet") < cores * SPLIT_BYTES:
            df = df.repartition(cores)
        return df

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def _lines(self) -> DataFrame:
        # Orders first, so that the second join's shuffle does not carry the part's texts.
        li = self._source(
            "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
        p = self.raw("part").select("p_partkey", "p_name", "p_size")
        i, parts = self._part  # part i holds the lines of a hash class of parts; lines of a part lie side by side once joined
        if parts > 1:
            li, p = [df.filter(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(parts)) == i) for df, key in ((li, "l_partkey"), (p, "p_partkey"))]
        return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(p, F.col("l_partkey") == F.col("p_partkey")))

    @cached_property
    def invoice(self) -> DataFrame:
        x = self._lines
        amount = F.col("l_extendedprice").cast(DEC) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
        item_type = (F.when(F.col("l_linenumber") == 7, "ITM_SALES_TAX")
                     .when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "N"), F.lit(None).cast("string"))
                     .otherwise("ITM_GOODS"))
        return x.select(
            F.col("l_shipdate").cast("date").alias("txn_date"),
            _code("C", "o_custkey").alias("customer_id"),
            _code("CUST-", "o_custkey").alias("customer_name"),
            _sku().alias("sku"),
            _code("IC", "l_partkey").alias("item_code"),
            F.col("p_name").alias("sku_name"),
            _uom().alias("uom"),
            F.col("l_quantity").cast(DEC).alias("qty"),
            amount.alias("amount"),
            item_type.alias("item_type"),
            _code("INV", "l_orderkey").alias("doc_no"),
            _code("SO", "l_orderkey").alias("order_no"),
            _code("E", "l_suppkey").alias("rep_id"),
        )

    @cached_property
    def returns(self) -> DataFrame:
        x = self._lines.filter(F.col("l_returnflag") == "R")
        facility = _case(F.col("l_linenumber"), [(1, "MAIN BO"), (2, "Virtual WH"), (3, "MAIN FG"), (4, "BO FG"),
                                                 (5, "FG_1"), (6, "VirtualWH")])
        uom = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 3),
                     F.lit(None).cast("string")).otherwise(_uom())
        return_type = (F.when(F.col("l_linestatus") == "F", "CUSTOMER_RETURN")
                       .when(F.col("l_linenumber") == 7, F.lit(None).cast("string")).otherwise("BAD_ORDER"))
        return x.select(
            F.col("l_shipdate").cast("date").alias("txn_date"),
            _code("CR", "l_orderkey").alias("doc_no"),
            _code("E", "l_suppkey").alias("rep_id"),
            _code("C", "o_custkey").alias("customer_id"),
            _code("CUST-", "o_custkey").alias("customer_name"),
            _sku().alias("sku"),
            F.col("p_name").alias("sku_name"),
            facility.alias("facility"),
            (F.col("l_extendedprice").cast(DEC) * F.col("l_discount").cast("decimal(4,2)")).alias("amount"),
            uom.alias("uom"),
            F.col("l_quantity").cast(DEC).alias("qty"),
            return_type.alias("return_type"),
        )

    @cached_property
    def sales_order(self) -> DataFrame:
        x = self._lines
        status = F.when(F.col("o_orderstatus") == "F", "Invoiced").when(F.col("o_orderstatus") == "O", "Open")
        return x.select(
            F.col("o_orderdate").cast("date").alias("txn_date"),
            _code("C", "o_custkey").alias("customer_id"),
            _sku().alias("sku"),
            F.col("p_name").alias("sku_name"),
            _uom().alias("uom"),
            F.col("l_quantity").cast(DEC).alias("qty"),
            F.col("l_extendedprice").cast(DEC).alias("amount"),
            status.alias("status"),
            _code("SO", "o_orderkey").alias("order_no"),
        )

    @cached_property
    def customer(self) -> DataFrame:
        c = self._source("customer", "*")
        n = self.raw("nation")
        r = self.raw("region")
        x = (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
        key = F.col("c_custkey")
        created = F.date_add(F.lit("2020-01-01").cast("date"), (key % 1000).cast("int"))
        base = x.select(
            _code("C", "c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_class"),
            F.when(F.col("c_acctbal") > 5000, "KEY").otherwise("REGULAR").alias("account_group"),
            F.when(F.col("c_nationkey") == 0, F.lit(None).cast("string"))
            .otherwise(_code("R", "c_nationkey")).alias("rep_id"),
            F.concat(F.lit("Rep "), F.col("n_name")).alias("rep_name"),
            F.col("r_name").alias("branch"),
            F.concat(F.lit("Brgy "), (key % 40).cast("string")).alias("barangay"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("province"),
            _case(key % 3, [(0, "VAN(EXTRUCK)"), (1, "BOOK(Booking)")], "MODERN TRADE").alias("channel"),
            F.when(F.col("c_acctbal") < 0, "Blocked/On hold").when(key % 20 == 0, "Approval On Hold")
            .when(key % 31 == 0, F.lit(None).cast("string")).otherwise("Active/Approved").alias("status"),
            F.when(F.col("c_acctbal") > 8000, "URBAN").otherwise("RURAL").alias("retail_env"),
            F.when(key % 97 == 0, F.lit("N/A")).otherwise(F.date_format(created, "MM/dd/yyyy")).alias("created"),
            F.col("c_acctbal"),
            created.alias("_created"),
        )
        # Rich accounts appear twice in the extract, the copy created 400 days earlier and active.
        copies = base.filter(F.col("c_acctbal") > 9900).withColumns({
            "created": F.date_format(F.date_sub(F.col("_created"), 400), "MM/dd/yyyy"),
            "status": F.lit("Active/Approved"),
        })
        return base.unionByName(copies).drop("c_acctbal", "_created")

    @cached_property
    def route(self) -> DataFrame:
        c = self._source("customer", "c_custkey", "c_nationkey")
        key = F.col("c_custkey")
        days = [(0, "MON"), (1, "TUE"), (2, "WED"), (3, "THU"), (4, "FRI"), (5, "SAT")]
        weeks = _case(key % 5, [(0, "_WKLY"), (1, "_WK1_WK3"), (2, "_WK2_WK4"), (3, "_WK1")], "")

        def code(day_shift: int) -> Column:
            day = _case((key + day_shift) % 6, days)
            full = F.concat(_code("RT", "c_nationkey"), F.lit("_"), day, weeks)
            return F.when(key % 11 == 0, _code("RT", "c_nationkey")).otherwise(full)

        first = c.select(_code("C", "c_custkey").alias("customer_id"), code(0).alias("route_code"))
        second = c.filter(key % 13 == 0).select(_code("C", "c_custkey").alias("customer_id"),
                                                code(2).alias("route_code"))
        return first.unionByName(second)

    @cached_property
    def price(self) -> DataFrame:
        p = self._source("part", "p_partkey", "p_name", "p_size", "p_retailprice").filter(F.col("p_size") != 4)
        uoms = F.array(*[F.struct(F.lit(u).alias("uom"), F.lit(f).cast("decimal(4,2)").alias("factor"))
                         for u, f in [("Case", "1.00"), ("Subcase", "0.25"), ("Piece", "0.05")]])
        channels = F.array(F.lit("BOOK(Booking)"), F.lit("VAN(EXTRUCK)"))
        classes = F.array(
            F.lit("Regular"),
            _case(F.col("p_size") % 6, [(0, "BEV Dealer"), (2, "Wholesale")]),
        )
        x = (p.withColumn("u", F.explode(uoms)).withColumn("channel", F.explode(channels))
             .withColumn("price_class", F.explode(classes)))
        x = x.filter(~((F.col("channel") == "VAN(EXTRUCK)") & (F.col("p_partkey") % 9 == 0)))
        x = x.filter(~((F.col("p_size") % 6).isin(3, 4, 5) & F.col("price_class").isNull()))
        price = F.col("p_retailprice").cast(DEC) * F.col("u.factor")
        price = F.when(F.col("channel") == "VAN(EXTRUCK)", price * F.lit("1.05").cast("decimal(3,2)")).otherwise(price)
        return x.select(
            F.col("p_partkey").cast("string").alias("sku"),
            F.col("p_name").alias("sku_name"),
            F.col("u.uom").alias("uom"),
            price.alias("price"),
            "price_class",
            "channel",
        )

    @cached_property
    def category(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", "p_name", "p_type", "p_size").filter(F.col("p_size") != 3)
        cat = F.when(F.col("p_size") == 1, F.lit("")).when(F.col("p_size") == 2, F.lit("  ")).otherwise(F.col("p_type"))
        return p.select(_sku("p_partkey").alias("sku"), F.col("p_name").alias("sku_name"), cat.alias("category"))

    @cached_property
    def supervisor(self) -> DataFrame:
        s = self.raw("supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("supervisor"))
        rep = F.when(F.col("s_nationkey") == 1, F.lit(None).cast("string")).otherwise(_code("R", "s_nationkey"))
        return s.select(rep.alias("rep_id"), "supervisor")

    @cached_property
    def calendar(self) -> DataFrame:
        ship = self.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("txn_date"))
        ordered = self.raw("orders").select(F.col("o_orderdate").cast("date").alias("txn_date"))
        days = ship.unionByName(ordered).distinct().filter(F.dayofweek("txn_date") != 1)
        return days.select("txn_date", F.weekofyear("txn_date").alias("week"))

    @cached_property
    def classification(self) -> DataFrame:
        seg = self.raw("customer").select("c_mktsegment").distinct().filter(F.col("c_mktsegment") != "HOUSEHOLD")
        return seg.select(F.col("c_mktsegment").alias("customer_class"),
                          F.concat(F.lit("CL-"), F.substring("c_mktsegment", 1, 3)).alias("classification"))

    @cached_property
    def gt_channel(self) -> DataFrame:
        seg = self.raw("customer").select("c_mktsegment").distinct().filter(F.col("c_mktsegment") != "MACHINERY")
        return seg.select(F.col("c_mktsegment").alias("customer_class"),
                          F.concat(F.lit("GT-"), F.col("c_mktsegment")).alias("gt_channel"))

    @cached_property
    def new_customer(self) -> DataFrame:
        c = self.raw("customer").filter(F.col("c_acctbal") >= 0)
        flag = _case(F.col("c_custkey") % 4, [(0, "NO"), (2, "  "), (3, "YES")])
        return c.select(_code("C", "c_custkey").alias("customer_id"), flag.alias("is_new"))

    @cached_property
    def deductions(self) -> DataFrame:
        """Two key lists in one sheet: ``invoice_key`` and ``return_key``, NULL where a list is shorter."""
        inv_keys = self.invoice.filter(F.col("qty") > 48).select(
            F.concat(F.col("doc_no"), F.lit("_"), F.col("sku")).alias("invoice_key"),
            F.lit(None).cast("string").alias("return_key"))
        ret_keys = self.returns.filter(F.col("qty") < 5).select(
            F.lit(None).cast("string").alias("invoice_key"),
            F.concat(F.col("doc_no"), F.lit("_"), F.col("sku")).alias("return_key"))
        return inv_keys.unionByName(ret_keys)

    @cached_property
    def free_goods(self) -> DataFrame:
        p = self.raw("part").filter(F.col("p_size") % 7 == 0)
        size = F.when(F.col("p_size") == 49, F.lit(None)).otherwise(F.col("p_size") % 5).cast(DEC)
        return p.select(F.col("p_partkey").cast("string").alias("sku"), size.alias("case_size"))


_LOCK = threading.RLock()
_ROOTS: dict[tuple[str, str], str] = {}
_READS: dict[tuple[str, str], DataFrame] = {}

# Bytes of a file for each core from which its scan feeds all cores (fixed value: Spark's default cost of opening a file).
SPLIT_BYTES = 4 << 20


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _file_bytes(spark: SparkSession, path: str) -> int:
    source, fs = _fs_path(spark, path)
    return fs.getContentSummary(source).getLength()


# Bytes of lines for each part in which they are landed, and the most parts: a part's shuffles are freed before the next.
PART_BYTES, MOST_PARTS = 64 << 20, 4
# Extracts of all lines.
FACTS = ("invoice", "returns", "sales_order")
# Extracts that are derived from landed ones.
LANDED_FROM = {"deductions": ("invoice", "returns")}


def _land(spark: SparkSession, sf_dir: str, root: str, name: str) -> None:
    target = f"{root}/{name}.parquet"
    tpath, fs = _fs_path(spark, target)
    if fs.exists(tpath):
        return
    tmp = f"{root}/_tmp-{name}-{uuid.uuid4().hex}"
    parts = min(MOST_PARTS, _file_bytes(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet") // PART_BYTES + 1) if name in FACTS else 1
    for i in range(parts):
        derived = DerivedTables(spark, sf_dir, spread=True, part=(i, parts))
        for source in LANDED_FROM.get(name, ()):
            _land(spark, sf_dir, root, source)
            derived.__dict__[source] = spark.read.parquet(f"{root}/{source}.parquet")
        # Lines of one SKU lie side by side, so its dictionary is small.
        options = compact([c for c in KEY_TEXTS if c != "sku"])
        getattr(derived, name).write.mode("append").options(**options).parquet(tmp)
    src, _ = _fs_path(spark, tmp)
    if not fs.rename(src, tpath) and not fs.exists(tpath):
        raise OSError(f"could not move {tmp} to {target}")


def land_extracts(spark: SparkSession, sf_dir: str, force: bool = False, names: Sequence[str] | None = None) -> str:
    """Write domain tables of ``sf_dir`` (by default all) as Parquet under the shared scratch folder.

    This is the landing step of a real deployment (extracts arrive once a day and
    are staged as typed Parquet); the reports then read the landed files with
    column pruning, pushed filters and exact size statistics. A table is written by the
    tasks that compute it, without another shuffle: small inputs are dealt to all cores before
    they are joined, larger ones split by their scans and joins. Each table is written to a fresh folder
    and renamed into place after the write commits, so a failed or retried job
    never leaves a partial table behind. Independent tables are written by
    concurrent jobs. Each is landed once per Spark application and directory.
    """
    from concurrent.futures import ThreadPoolExecutor

    names = EXTRACTS if names is None else names
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _ROOTS or force:
            tag = hashlib.sha1(key[1].encode()).hexdigest()[:12]
            _ROOTS[key] = f"{scratch_dir(spark)}/landed/{tag}" + (f"-{uuid.uuid4().hex[:8]}" if force else "")
        root = _ROOTS[key]
        sources = dict.fromkeys(s for n in names for s in LANDED_FROM.get(n, ()))
        first = list(dict.fromkeys([*sources, *(n for n in names if n not in LANDED_FROM)]))
        with freed_shuffles(spark):
            with ThreadPoolExecutor(max_workers=4) as pool:
                list(pool.map(lambda n: _land(spark, sf_dir, root, n), first))
            for name in names:
                _land(spark, sf_dir, root, name)
        return root


class DemoTables:
    """Domain tables of one scale-factor directory, read from their landed Parquet copies.

    A table is landed when it is first asked for, so a query lands the extracts it reads and no others.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, landed: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._derived = None if landed else DerivedTables(spark, sf_dir)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in EXTRACTS:
            raise KeyError(name)
        if self._derived is not None:
            return getattr(self._derived, name)
        # One DataFrame per landed table: files are listed and footers read once,
        # not on every use inside a plan.
        with _LOCK:
            root = _ROOTS.get((self.spark.sparkContext.applicationId, self.sf_dir))
            if (root, name) not in _READS:
                root = land_extracts(self.spark, self.sf_dir, names=[name])
                _READS[(root, name)] = self.spark.read.parquet(f"{root}/{name}.parquet")
            return _READS[(root, name)]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in EXTRACTS:
            raise AttributeError(name)
        return self[name]
