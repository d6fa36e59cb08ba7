"""Labels from layout text: a symbol's table rows, the row that counts, packages, part-name checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.joins import dealt

# Fixed values that results depend on.
NEW_SYMBOL = r"^[A-Z][A-Za-z0-9()]*\s+[a-z]"
SECTION = r"^(Static|Dynamic|Thermal|Limiting|Symbol|Table)\b"
PACKAGE_NAME = r"^[A-Z][A-Za-z0-9‐-―-]*$"
PACKAGE_VERSION = r"(?<![A-Za-z0-9_])(SOT\d+[A-Z]?)(?![A-Za-z0-9_])"
UNITS = {"VDS": r"^V$", "ID": r"^A$", "RDSon": r"^m?[\u03A9\u2126]"}


def quick_reference(documents: DataFrame) -> DataFrame:
    """Lines of each document's reference table: part, pos, line; only documents with a table and a channel."""
    start = F.locate("Quick reference data", F.col("text"))
    head = F.substring("text", 1, 4000)
    after = F.expr("locate('Package outline', text, greatest(locate('Quick reference data', text), 1))")
    table = F.when(after > start, F.expr("substr(text, locate('Quick reference data', text), locate('Package outline', text, greatest(locate('Quick reference data', text), 1)) - locate('Quick reference data', text))"))
    table = table.otherwise(F.expr("substr(text, greatest(locate('Quick reference data', text), 1))"))
    found = documents.where((start > 0) & head.rlike("(?i)[NP]-channel"))
    return found.select("part", F.posexplode(F.split(table, "\n")).alias("pos", "line"))


def channel(text: Column) -> Column:
    """N or P as the head of a document says; N first."""
    head = F.substring(text, 1, 4000)
    return F.when(head.rlike("(?i)N-channel"), "N").when(head.rlike("(?i)P-channel"), "P")


def table_rows(lines: DataFrame, symbol: str) -> DataFrame:
    """Data rows of a symbol's block, wrapped rows too: part, pos, text, min, typ, max, unit.

    A block opens at the symbol and closes at a section or another symbol: the last such event before a
    line says whether it is inside. Rows that repeat, but for white space, count once. Lines are dealt by part over as many tasks as their number needs:
    they compress so well that Spark, going by shuffled bytes, would sort tens of times as much in a task.
    """
    return _table_rows(dealt(lines, "part"), symbol)


def _table_rows(lines: DataFrame, symbol: str) -> DataFrame:
    """table_rows of lines that are dealt by part already."""
    line = T.trim(F.col("line"))
    trimmed = lines.select("part", "pos", line.alias("text")).where("text <> ''")
    starts = F.col("text").rlike(rf"^\Q{symbol}\E\s")
    event = F.when(starts, 1).when(F.col("text").rlike(SECTION) | F.col("text").rlike(NEW_SYMBOL), 0)
    inside = F.last(event, ignorenulls=True).over(Window.partitionBy("part").orderBy("pos"))
    rows = trimmed.withColumn("_in", inside).where((F.col("_in") == 1) & F.col("text").rlike(T.VALUE_TAIL))
    values = F.split(F.trim(F.regexp_extract("text", T.VALUE_TAIL, 1)), r"\s+")
    read = rows.select(
        "part", "pos", "text", F.get(values, F.lit(0)).alias("min"),
        F.when(F.size(values) == 3, F.get(values, F.lit(1))).otherwise("-").alias("typ"),
        F.element_at(values, -1).alias("max"), F.regexp_extract("text", T.VALUE_TAIL, 2).alias("unit"),
    )
    once = Window.partitionBy("part", F.regexp_replace("text", r"\s+", " ")).orderBy("pos")
    return read.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n").where(F.col("unit").rlike(UNITS.get(symbol, ".")))


def measurements(rows: DataFrame) -> DataFrame:
    """Rows with a maximum as measurements: part, pos, value, typ, unit, conditions, text; ohms in milliohms."""
    ohm = F.col("unit").rlike(T.OHM_SIGNS)
    scale = F.when(ohm & ~F.col("unit").startswith("m"), 1000.0).otherwise(1.0)
    value, typ = F.col("max").try_cast("double") * scale, F.col("typ").try_cast("double") * scale
    unit = F.when(ohm, "mΩ").otherwise(F.col("unit"))
    return rows.select("part", "pos", value.alias("value"), typ.alias("typ"), unit.alias("unit"), T.conditions_in(F.col("text")).alias("conditions"), "text").where("value is not null")


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("part").orderBy(*order, "pos")))
    return ranked.where("_n = 1").drop("_n")


def reference_resistance(rows: DataFrame) -> DataFrame:
    """The row that counts: at 25 °C and 10 V gate drive, else at 25 °C and the highest drive, else the first."""
    at_25, drive = T.is_reference_junction(F.col("text")), T.gate_drive(F.col("text"))
    return _first(rows, F.desc(at_25 & F.coalesce(drive == 10, F.lit(False))), F.desc(at_25), F.desc(F.when(at_25, F.coalesce(drive, F.lit(0.0))).otherwise(0.0)))


def reference_current(rows: DataFrame) -> DataFrame:
    """The row that counts: at a 25 °C reference and continuous, else at the reference, else the first."""
    at_25 = T.is_reference_ambient(F.col("text"))
    return _first(rows, F.desc(at_25 & T.is_continuous(F.col("text"))), F.desc(at_25))


def packages(documents: DataFrame) -> DataFrame:
    """Package names of each part's row under "Ordering information": part, package (array or null)."""
    window = F.expr("substr(text, locate('Ordering information', text), 2500)")
    lines = F.when(F.locate("Ordering information", F.col("text")) > 0, F.split(window, "\n"))
    own = lambda line: F.regexp_like(line, F.concat(F.lit(r"^\s*"), T.quoted(F.col("part")), F.lit(r"\s")))
    at = documents.select("part", lines.alias("lines")).withColumn("at", F.array_position(F.transform("lines", own), F.lit(True)).cast("int"))
    row, below = F.get("lines", F.col("at") - 1), F.get("lines", F.col("at"))
    tokens = F.split(T.trim(F.expr("substr(lines[at - 1], locate(part, lines[at - 1]) + length(part))")), r"\s+")
    found = at.where("at > 0").select("part", tokens.alias("tokens"), row.alias("row"), F.coalesce(below, F.lit("")).alias("below"))
    name = F.regexp_replace(F.get("tokens", F.lit(0)), ";$", "")
    able = lambda t: t.rlike(PACKAGE_NAME) & t.rlike(r"\d")
    options = F.array(F.get("tokens", F.lit(1)), F.get(F.split(T.trim(F.col("below")), r"\s+"), F.lit(0)))
    alias = F.when(F.get("tokens", F.lit(0)).endswith(";"), F.get(F.filter(options, lambda t: t.isNotNull() & able(t)), F.lit(0)))
    version = lambda c: F.nullif(F.regexp_extract(c, PACKAGE_VERSION, 1), F.lit(""))
    names = F.array_distinct(F.array_compact(F.array(name, alias, F.coalesce(version(F.col("row")), version(F.col("below"))))))
    read = found.select("part", F.when(name.rlike(PACKAGE_NAME), names).alias("package"))
    return documents.select("part").join(read, "part", "left")


def parse(documents: DataFrame) -> DataFrame:
    """Label row for each document (part, text) with a table and a channel: part, channel, package, vds_v,
    id_a, rdson_mohm, rdson_all, id_all."""
    lines = dealt(quick_reference(documents), "part")
    struct = F.struct("value", "typ", "unit", "conditions")
    vds = _first(_table_rows(lines, "VDS")).select("part", F.col("max").try_cast("double").alias("vds_v"))
    ohms, amps = _table_rows(lines, "RDSon"), _table_rows(lines, "ID")
    no_typ = lambda df: df.withColumn("typ", F.lit(None).cast("double"))
    one = lambda df, name: df.select("part", struct.alias(name))
    every = lambda df, name: df.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", struct.alias("m")))), lambda x: x["m"]).alias(name))
    rdson = one(measurements(reference_resistance(ohms)), "rdson_mohm")
    current = one(no_typ(measurements(reference_current(amps))), "id_a")
    rdson_all = every(measurements(ohms), "rdson_all")
    id_all = every(no_typ(measurements(amps.where(T.is_continuous(F.col("text"))))), "id_all")
    base = documents.where((F.locate("Quick reference data", F.col("text")) > 0) & channel(F.col("text")).isNotNull()).select("part", channel(F.col("text")).alias("channel"))
    out = base.join(packages(documents), "part", "left")
    for part in (vds, current, rdson, rdson_all, id_all):
        out = out.join(part, "part", "left")
    empty = lambda c: F.coalesce(c, F.array().cast("array<struct<value:double,typ:double,unit:string,conditions:string>>")).alias(c)
    return out.select("part", "channel", "package", "vds_v", "id_a", "rdson_mohm", empty("rdson_all"), empty("id_all"))


def name_check_counts(labels: DataFrame, shown: int = 12) -> tuple[DataFrame, DataFrame]:
    """How many names of labels with both figures state figures and how many labels agree with them, and the first disagreements on resistance, by part."""
    checked = name_check(labels)
    counts = checked.agg(F.count(F.lit(1)).alias("decoded"), F.count_if("vds_agrees").alias("vds_agrees"), F.count_if("rdson_agrees").alias("rdson_agrees"))
    return counts, checked.where(~F.col("rdson_agrees")).orderBy("part").limit(shown)


def coverage(labels: DataFrame, *fields: str) -> DataFrame:
    """Rows, and rows that have each field."""
    return labels.agg(F.count(F.lit(1)).alias("parts"), *[F.count(F.col(f)).alias(f) for f in fields])


def name_check(labels: DataFrame) -> DataFrame:
    """Labels with a resistance and a rating against what part names state: part, vds_agrees (magnitudes), rdson_agrees (within a tenth)."""
    decoded = labels.where("rdson_mohm.value is not null and vds_v is not null").withColumn("d", T.decode_name(F.col("part"))).where("d is not null")
    near = F.abs(F.col("rdson_mohm.value") - F.col("d.rdson_mohm")) / F.col("d.rdson_mohm") <= 0.1
    return decoded.select("part", (F.abs("vds_v") == F.col("d.vds_v")).alias("vds_agrees"), near.alias("rdson_agrees"))
