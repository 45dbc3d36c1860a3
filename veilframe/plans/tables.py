"""The driver's tables, and OCR-like tables derived from them by integer arithmetic.

Each derived table has the same definition twice: as a DataFrame for the queries and as SQL
for their oracles.  The driver has no boxes, frames or tag elements of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Rows of a task where a table is spread.
TASK_ROWS = 100_000


def row_groups(df: DataFrame) -> list[int]:
    """Rows of each row group of a table's files, from their footers."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    out = []
    for file in df.inputFiles():
        path = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(path)
        try:
            out += [g.getRowCount() for g in reader.getFooter().getBlocks()]
        finally:
            reader.close()
    return out


def spread(df: DataFrame) -> DataFrame:
    """A table that fewer tasks would read than the session has cores, over tasks of about ``TASK_ROWS`` rows.

    One task reads a row group, whatever the number of splits of its file, so the row groups of a table of few files are counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    groups = row_groups(df)
    if min(len(groups), df.rdd.getNumPartitions()) >= cores:
        return df
    return df.repartition(max(cores, -(-sum(groups) // TASK_ROWS)))


class Tables:
    """``t.orders`` and the like; derived tables are methods."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in ("documents", "conversations", "orders", "customer") else df

    def frames(self) -> DataFrame:
        return self.conversations.select(
            F.col("conv_id").alias("video"), F.col("turn").alias("frame"), "role", "text", ((F.length("text") % 100) / 100.0).alias("conf"), (F.col("turn") * 2.0).alias("ts")
        )

    def boxes_gt(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        x1, y1 = (F.col("l_partkey") * 7) % 60, (F.col("l_suppkey") * 13) % 40
        items = self.lineitem
        # a task's rows, and with them its memory, stay as many for a larger table; all that follows by instance needs no other exchange
        items = items.repartition(max(self.spark.sparkContext.defaultParallelism, -(-sum(row_groups(items)) // TASK_ROWS)), "l_orderkey")
        rows = items.withColumn("idx", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))
        return rows.select(
            F.col("l_orderkey").alias("instance"), "idx", "l_partkey", x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + 20 + F.floor("l_quantity")).cast("int").alias("x2"), (y1 + 20 + 3 * F.col("l_linenumber")).cast("int").alias("y2")
        )

    def boxes_pred(self) -> DataFrame:
        c = F.col
        dx, dy = (c("idx") % 4).cast("int"), (c("l_partkey") % 7).cast("int")
        return self.boxes_gt().where(c("l_partkey") % 5 != 0).select("instance", "idx", (c("x1") + dx).alias("x1"), (c("y1") + dy).alias("y1"), (c("x2") + dx).alias("x2"), (c("y2") + dy).alias("y2"), ((c("l_partkey") * 37 % 101) / 100.0).alias("conf"))

    def boxes(self) -> tuple[DataFrame, DataFrame]:
        return self.boxes_gt().drop("l_partkey"), self.boxes_pred()

    def modality(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("instance"), F.col("o_orderpriority").alias("modality"))

    def qi_records(self) -> DataFrame:
        j = self.customer.join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(self.orders, F.col("c_custkey") == F.col("o_custkey"))
        return j.select("c_mktsegment", "n_name", "o_orderpriority", F.month("o_orderdate").alias("month"), "o_orderstatus")

    def elements(self) -> DataFrame:
        j = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        key, day, s = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit
        row = lambda k, vr, v, private=False: F.struct(s(k).alias("keyword"), s(vr).alias("vr"), v.alias("value"), s(private).alias("is_private"))
        rows = F.array(
            row("PatientID", "LO", F.col("c_name")), row("PatientName", "PN", F.concat(s("Name^"), F.col("c_name"))), row("ReferringPhysicianName", "PN", s("Doe^Jane")), row("SOPInstanceUID", "UI", F.concat(s("1.2."), key, s(".1"))),
            row("SOPClassUID", "UI", s("1.2.840.10008.5.1.4.1.1.1")), row("StudyDate", "DA", day), row("AcquisitionDateTime", "DT", F.concat(day, s("112233.1234"))), row("StudyID", "SH", key),
            row("StudyDescription", "LO", F.when(F.col("o_orderkey") % 3 == 0, F.concat(s("Chest of "), F.col("c_name"))).otherwise("Chest")), row("Vendor", "LO", s("x"), True),
        )
        return j.select(F.col("o_orderkey").alias("instance"), F.col("c_name").alias("patient"), F.inline(rows))

    def gold(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(
            k.alias("ord"), F.col("c_mktsegment").alias("file"), k.cast("string").alias("report_id"), F.element_at(F.array(*map(F.lit, FIRST)), (k % len(FIRST) + 1).cast("int")).alias("first_name"),
            F.when(k % 13 != 0, F.element_at(F.array(*map(F.lit, LAST)), (k % len(LAST) + 1).cast("int"))).alias("last_name"), F.when(k % 17 != 0, F.format_string("%02d.%02d.%d", k % 28 + 1, k % 12 + 1, k % 60 + 1940)).otherwise("n/a").alias("dob"),
        )

    def predicted(self, drop: int = 10) -> DataFrame:
        c, k = F.col, F.col("ord")
        return self.gold().where(k % drop != 0).select(
            "ord", "file", F.when(k % 50 == 1, F.concat(F.lit("x"), c("report_id"))).when(k % 53 == 2, F.lit(" ")).otherwise(c("report_id")).alias("report_id"),
            F.when(k % 7 == 0, F.concat(F.lit("Dr. "), c("first_name"))).when(k % 6 == 0, F.lit(None)).otherwise(c("first_name")).alias("first_name"), F.when(k % 9 == 0, F.replace(c("last_name"), F.lit("e"), F.lit("a"))).otherwise(c("last_name")).alias("last_name"),
            F.when(k % 5 == 0, F.replace(c("dob"), F.lit("."), F.lit("-"))).otherwise(c("dob")).alias("dob"),
        )

    def states(self) -> DataFrame:
        """Partial records by user in event order; blanks by the number in ``props``."""
        k = F.get_json_object("props", "$.k").cast("int")
        some = lambda m, v: F.when(k % m == 0, v).when(k % m == 1, "unknown")
        n = F.col("event_id")
        day = lambda a, b: F.format_string("%04d-%02d-%02d", n % a + b, n % 12 + 1, n % 28 + 1)
        return self.events.select(
            F.col("user_id").alias("video"), n.alias("frame"), some(7, F.concat(F.lit("F"), n.cast("string"))).alias("first_name"), some(6, F.concat(F.lit("L"), n.cast("string"))).alias("last_name"), some(9, day(80, 1930)).alias("dob"),
            some(5, n.cast("string")).alias("casenumber"), some(8, day(20, 2000)).alias("examination_date"),
        )

    def overlays(self) -> DataFrame:
        """One overlay text a customer, in four layouts."""
        g = self.gold().join(self.customer.select("c_custkey", "c_nationkey"), F.col("ord") == F.col("c_custkey"))
        k, f, n, d = F.col("ord"), F.col("first_name"), F.coalesce("last_name", F.lit("Unbekannt")), F.col("dob")
        s = F.lit
        return g.select(
            "ord",
            F.when(k % 4 == 0, F.concat(s("Patient: "), n, s(", "), f, s(" geb. "), d, s(" Fallnr: "), (k + 10000).cast("string")))
            .when(k % 4 == 1, F.concat(s("Pat. "), f, s(" "), n, s(" DOB: "), d, s(" Untersuchung: 03.04.2021 Zeit: 09:41 weiblich")))
            .when(k % 4 == 2, F.concat(s("Name: "), n, s(" "), f, s("\nUntersucher: Schulze Meier\nCase: "), k.cast("string"), s(" male")))
            .otherwise(F.concat(s("E "), (k + 20000).cast("string"), s("/2024 09:53:32 "), n, s(", "), f))
            .alias("text"),
        )


FIRST = ["Alice", "Bernd", "Carla", "Detlef", "Erika", "Frieda", "Gerhard", "Hanna"]
LAST = ["Adler", "Becker", "Conrad", "Decker", "Engel", "Fischer", "Geiger", "Heller", "Jaeger", "Keller", "Lehmann"]


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _pick(words, key: str) -> str:
    return f"list_extract([{', '.join(map(lit, words))}], (({key}) % {len(words)} + 1)::INT)"


VIEWS = {
    "frames": "frames AS (SELECT conv_id AS video, turn AS frame, role, text, (length(text) % 100) / 1e2 AS conf, turn * 2e0 AS ts FROM conversations)",
    "boxes_gt": """boxes_gt AS (SELECT l_orderkey AS instance, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))::INT AS idx, l_partkey,
        ((l_partkey * 7) % 60)::INT AS x1, ((l_suppkey * 13) % 40)::INT AS y1, ((l_partkey * 7) % 60 + 20 + floor(l_quantity))::INT AS x2, ((l_suppkey * 13) % 40 + 20 + 3 * l_linenumber)::INT AS y2 FROM lineitem)""",
    "boxes_pred": """boxes_pred AS (SELECT instance, idx, (x1 + idx % 4)::INT AS x1, (y1 + l_partkey % 7)::INT AS y1, (x2 + idx % 4)::INT AS x2, (y2 + l_partkey % 7)::INT AS y2, (l_partkey * 37 % 101) / 1e2 AS conf
        FROM boxes_gt WHERE l_partkey % 5 <> 0)""",
    "qi": """qi AS (SELECT c_mktsegment, n_name, o_orderpriority, month(o_orderdate)::VARCHAR AS month, o_orderstatus FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey)""",
    "elements": """elements AS (SELECT o_orderkey AS instance, c_name AS patient, unnest([
        {'keyword': 'PatientID', 'vr': 'LO', 'value': c_name, 'is_private': false}, {'keyword': 'PatientName', 'vr': 'PN', 'value': 'Name^' || c_name, 'is_private': false},
        {'keyword': 'ReferringPhysicianName', 'vr': 'PN', 'value': 'Doe^Jane', 'is_private': false}, {'keyword': 'SOPInstanceUID', 'vr': 'UI', 'value': '1.2.' || o_orderkey || '.1', 'is_private': false},
        {'keyword': 'SOPClassUID', 'vr': 'UI', 'value': '1.2.840.10008.5.1.4.1.1.1', 'is_private': false}, {'keyword': 'StudyDate', 'vr': 'DA', 'value': strftime(o_orderdate, '%Y%m%d'), 'is_private': false},
        {'keyword': 'AcquisitionDateTime', 'vr': 'DT', 'value': strftime(o_orderdate, '%Y%m%d') || '112233.1234', 'is_private': false}, {'keyword': 'StudyID', 'vr': 'SH', 'value': o_orderkey::VARCHAR, 'is_private': false},
        {'keyword': 'StudyDescription', 'vr': 'LO', 'value': CASE WHEN o_orderkey % 3 = 0 THEN 'Chest of ' || c_name ELSE 'Chest' END, 'is_private': false}, {'keyword': 'Vendor', 'vr': 'LO', 'value': 'x', 'is_private': true}], recursive := true)
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "gold": f"""gold AS (SELECT c_custkey AS ord, c_mktsegment AS file, c_custkey::VARCHAR AS report_id, {_pick(FIRST, "c_custkey")} AS first_name, CASE WHEN c_custkey % 13 <> 0 THEN {_pick(LAST, "c_custkey")} END AS last_name,
        CASE WHEN c_custkey % 17 <> 0 THEN printf('%02d.%02d.%d', c_custkey % 28 + 1, c_custkey % 12 + 1, c_custkey % 60 + 1940) ELSE 'n/a' END AS dob FROM customer)""",
    "predicted": """predicted AS (SELECT ord, file, CASE WHEN ord % 50 = 1 THEN 'x' || report_id WHEN ord % 53 = 2 THEN ' ' ELSE report_id END AS report_id,
        CASE WHEN ord % 7 = 0 THEN 'Dr. ' || first_name WHEN ord % 6 = 0 THEN NULL ELSE first_name END AS first_name, CASE WHEN ord % 9 = 0 THEN replace(last_name, 'e', 'a') ELSE last_name END AS last_name,
        CASE WHEN ord % 5 = 0 THEN replace(dob, '.', '-') ELSE dob END AS dob FROM gold WHERE ord % 10 <> 0)""",
    "states": """states AS (WITH k AS (SELECT user_id AS video, event_id AS frame, (props->>'$.k')::INT AS k FROM events) SELECT video, frame,
        CASE WHEN k % 7 = 0 THEN 'F' || frame WHEN k % 7 = 1 THEN 'unknown' END AS first_name, CASE WHEN k % 6 = 0 THEN 'L' || frame WHEN k % 6 = 1 THEN 'unknown' END AS last_name,
        CASE WHEN k % 9 = 0 THEN printf('%04d-%02d-%02d', frame % 80 + 1930, frame % 12 + 1, frame % 28 + 1) WHEN k % 9 = 1 THEN 'unknown' END AS dob, CASE WHEN k % 5 = 0 THEN frame::VARCHAR WHEN k % 5 = 1 THEN 'unknown' END AS casenumber,
        CASE WHEN k % 8 = 0 THEN printf('%04d-%02d-%02d', frame % 20 + 2000, frame % 12 + 1, frame % 28 + 1) WHEN k % 8 = 1 THEN 'unknown' END AS examination_date FROM k)""",
    "overlays": """overlays AS (SELECT ord, CASE WHEN ord % 4 = 0 THEN 'Patient: ' || n || ', ' || first_name || ' geb. ' || dob || ' Fallnr: ' || (ord + 10000)
        WHEN ord % 4 = 1 THEN 'Pat. ' || first_name || ' ' || n || ' DOB: ' || dob || ' Untersuchung: 03.04.2021 Zeit: 09:41 weiblich'
        WHEN ord % 4 = 2 THEN 'Name: ' || n || ' ' || first_name || chr(10) || 'Untersucher: Schulze Meier' || chr(10) || 'Case: ' || ord || ' male'
        ELSE 'E ' || (ord + 20000) || '/2024 09:53:32 ' || n || ', ' || first_name END AS text FROM (SELECT *, coalesce(last_name, 'Unbekannt') AS n FROM gold))""",
}
_NEEDS = {"boxes_pred": ["boxes_gt"], "predicted": ["gold"], "overlays": ["gold"]}


def with_views(sql: str, *names: str) -> str:
    """The query with the definitions of derived tables, and of those they need, in front."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, []), n) if x not in order]
    if not order:
        return sql
    head = ",\n".join(VIEWS[n] for n in order)
    body = sql.strip()
    return f"WITH {head}{',' + body[4:] if body.upper().startswith('WITH') else ' ' + body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), wide: str = "", text: str = ""):
    """Registers a function of ``Tables`` as a query, with its SQL.

    wide: columns that the query casts to 64 bits, as SQL counts have; text: dates that both write as text.
    """
    cast = dict.fromkeys(wide.split(), "bigint") | dict.fromkeys(text.split(), "string")

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir)).withColumns({c: F.col(c).cast(k) for c, k in cast.items()})

        QUERIES[name] = run
        run.__doc__ = f.__doc__
        if sql:
            whole = with_views(sql, *views)
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in text.split())}) FROM ({whole})" if text else whole
        return f

    return register
