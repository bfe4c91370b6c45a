"""Event envelopes: normalising partial events, files of them, and the sample table as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("seq", "id", "ts", "event_time", "node", "source", "type", "subject", "correlation", "payload", "payload_json", "ttl_class", "hops")
# What a partial event of a file lacks.
FILLED = {"id": "", "ts": "2026-01-01T00:00:00Z", "node": "test-node", "source": "test"}
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_TOKEN = r"[A-Za-z0-9_-]+"
CONCRETE = rf"^{_TOKEN}(\.{_TOKEN})*$"


def configure(spark: SparkSession) -> None:
    """Session settings the plans rely on; of two equal JSON keys the last counts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def emitted(partial: DataFrame, node: str, first_seq: int = 1) -> DataFrame:
    """Producers' partial events (subject, payload_json?, type?, source?, correlation?, ts?) as envelopes.

    Rows with a subject that isn't concrete are dropped (``refused`` has them).
    Sequence numbers are dense by arrival (ts, id); they are given to one batch at
    a time, over the rows' keys only.
    """
    have = partial.columns
    get = lambda name, otherwise: F.coalesce(F.col(name), otherwise) if name in have else otherwise
    out = partial.where(F.col("subject").rlike(CONCRETE)).select(
        get("id", F.concat(F.lit("LS."), F.lower(F.hex(F.xxhash64(*have))))).alias("id"),
        get("ts", F.date_format(F.current_timestamp(), STAMP)).alias("ts"),
        F.lit(node).alias("node"),
        get("source", F.lit("cli")).alias("source"),
        get("type", F.col("subject")).alias("type"),
        "subject",
        (F.col("correlation") if "correlation" in have else F.lit(None).cast("string")).alias("correlation"),
        get("payload_json", F.lit("null")).alias("payload_json"),
    )
    return numbered(out, first_seq)


def refused(partial: DataFrame) -> DataFrame:
    return partial.where(~F.coalesce(F.col("subject").rlike(CONCRETE), F.lit(False)))


def numbered(rows: DataFrame, first_seq: int = 1) -> DataFrame:
    """The rows with dense sequence numbers by (ts, id): counts of time buckets first, then numbers within each."""
    from pyspark.sql import Window

    bucket = F.substring("ts", 1, 16)  # a minute
    counts = rows.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy("ts", "id"))
    return typed(rows.withColumn("_b", bucket).join(before, "_b").withColumn("seq", (F.col("_before") + inner + F.lit(first_seq - 1)).cast("long")).drop("_b", "_before"))


def typed(rows: DataFrame) -> DataFrame:
    """Envelope columns in order; payload and event_time from their texts."""
    have = rows.columns
    missing = {"correlation": "string", "ttl_class": "string", "hops": "int", "seq": "long"}
    for name, kind in missing.items():
        if name not in have:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    if "event_time" not in have:
        rows = rows.withColumn("event_time", F.try_to_timestamp("ts"))
    if "payload" not in have:
        rows = rows.withColumn("payload", F.try_parse_json("payload_json"))
    return rows.select(*COLUMNS)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON array or JSON-lines file (or folder of them).

    Blank lines are skipped, ``{"seq", "event"}`` wrappers opened, lines that are no JSON
    objects dropped, and what is missing filled in.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parsed_events(lines, "value")


def parsed_events(lines: DataFrame, column: str) -> DataFrame:
    whole = F.try_parse_json(F.col(column))
    one = lines.select(F.col(column).alias("_text"), whole.alias("_v"))
    many = one.where(F.schema_of_variant("_v").startswith("ARRAY")).select(F.explode(F.try_variant_get("_v", "$", "array<variant>")).alias("_v"))
    single = one.where(F.schema_of_variant("_v").startswith("OBJECT")).select("_v")
    v = single.union(many)
    inner = F.try_variant_get("_v", "$.event", "variant")
    v = v.select(F.try_variant_get("_v", "$.seq", "long").alias("seq"), F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(F.col("_v")).alias("e"))
    text = lambda name: F.try_variant_get("e", f"$.{name}", "string")
    filled = lambda name: F.coalesce(text(name), F.lit(FILLED[name]))
    rows = v.where(text("subject").isNotNull()).select("seq", *(filled(n).alias(n) for n in FILLED), F.coalesce(text("type"), text("subject")).alias("type"), text("subject").alias("subject"), text("correlation").alias("correlation"), F.try_variant_get("e", "$.payload", "variant").alias("payload"), F.try_variant_get("e", "$.hops", "int").alias("hops"), text("ttlClass").alias("ttl_class"))
    return typed(rows.withColumn("payload_json", F.to_json("payload")))


def sample_payload() -> Column:
    """The JSON text of a sample event's payload, given ``_k``; a note is absent below 50, a flag is null at multiples of 7."""
    k = F.col("_k")
    user = F.col("user_id") % 10
    note = F.when(k >= 50, F.concat(F.lit(', "note": "n'), k, F.lit('"'))).otherwise(F.lit(""))
    flag = F.when(k % 7 == 0, F.lit(', "flag": null')).otherwise(F.lit(""))
    return F.concat(F.lit('{"k": '), k, F.lit(', "value": '), F.col("value").cast("string"), F.lit(', "user_id": '), F.col("user_id"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "tags": ["'), F.col("event_type"), F.lit('", "u'), user, F.lit('"]'), note, flag, F.lit("}"))


def sample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as envelopes; all columns are row-wise, so filters on them reach the scan where they can."""
    return as_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def as_events(table: DataFrame) -> DataFrame:
    configure(table.sparkSession)
    time, number = F.col("ts").cast("timestamp"), F.col("event_id")
    table = table.select("*", F.inline(F.array(F.struct(F.get_json_object("props", "$.k").cast("int").alias("_k")))))  # read once
    rows = table.select(
        (number + 1).alias("seq"), F.concat(F.lit("EV."), number).alias("id"), F.date_format(time, STAMP).alias("ts"), time.alias("event_time"), F.concat(F.lit("n"), F.col("user_id") % 4).alias("node"),
        F.concat(F.lit("tap."), "event_type").alias("source"), F.concat(F.lit("app."), "event_type", F.lit(".u"), F.col("user_id") % 10).alias("subject"),
        F.when(number % 10 != 0, F.concat(F.lit("U."), "user_id")).alias("correlation"), sample_payload().alias("payload_json"), (number % 10).cast("int").alias("hops"),
    )
    return typed(rows.withColumn("type", F.col("subject")))
