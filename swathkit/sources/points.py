"""Point files: text with a header, for in-situ records.

Leading lines "#key=value" are parameters: columnSeparator (one character, default tab), latColumn, lonColumn, timeColumn,
timeColumns, dateFormat. The first other line names the columns; later lines that are blank or start with # are skipped.
The roles of latitude, longitude and time come from the parameters or from usual names, whatever their case. A column is
numeric if its first value that is not empty is a number (nan, inf and -inf count); later texts in it are NaN. Empty is
NULL. A latitude beyond 90 or a longitude outside -180 to 360, or one that is missing, fails the read. Short rows are
filled with NULL; what a row has beyond the header is ignored. Several time columns are joined by a comma and need
a dateFormat; whole numbers among them lose their fraction.

Only the parameters and the header come to the driver, wherever the header is; rows are read and typed natively.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathkit.sources.files import numbered_lines

LAT, LON, TIME = ("lat", "latitude", "northing"), ("lon", "long", "longitude", "easting"), ("time", "date")
DEFAULT_FORMAT = "yyyy-MM-dd HH:mm:ss"
PARAMETERS = 1000  # the most that a file can have; there are seven kinds


@dataclass
class Header:
    names: list[str]
    separator: str
    lat: int
    lon: int
    time: list[int]
    date_format: str | None
    parameters: dict[str, str] = field(default_factory=dict)

    @property
    def has_location(self) -> bool:
        return self.lat >= 0 and self.lon >= 0

    @property
    def has_time(self) -> bool:
        return bool(self.time)

    def index(self, name: str) -> int:
        """Place of a column by its exact name, or -1."""
        return self.names.index(name) if name in self.names else -1

    def description(self) -> str:
        out = f'columns for lat="{self.names[self.lat]}" lon="{self.names[self.lon]}"'
        return out + (f' time="{",".join(self.names[k] for k in self.time)}"' if self.time else "")


def find(names: Sequence[str], wanted: Sequence[str]) -> int:
    """Place of the first wanted name that a column has, whatever its case."""
    low = [n.strip().lower() for n in names]
    return next((low.index(w.lower()) for w in wanted if w.lower() in low), -1)


def read_header(first: Sequence[str], date_format: str | None = None) -> Header:
    parameters: dict[str, str] = {}
    rest = list(first)
    while rest and rest[0].startswith("#"):
        key, eq, value = rest.pop(0)[1:].partition("=")
        if eq:
            parameters[key.strip()] = value.split("=")[0].strip("\r\n") if key.strip() == "columnSeparator" else value.split("=")[0].strip()
    rest = [x for x in rest if x.strip() and not x.strip().startswith("#")]
    if not rest:
        raise ValueError("a point file needs a header line")
    separator = (parameters.get("columnSeparator") or "\t")[0]
    names = [n.strip() for n in rest[0].split(separator)]

    def role(key: str, usual: Sequence[str]) -> int:
        at = find(names, [parameters[key]] if key in parameters else usual)
        if key in parameters and at < 0:
            raise ValueError(f"{key}: no column {parameters[key]!r}")
        return at

    form = parameters.get("dateFormat", date_format)
    if "timeColumns" in parameters:
        times = [find(names, [n.strip()]) for n in parameters["timeColumns"].split(",")]
        if min(times) < 0:
            raise ValueError(f"timeColumns: {parameters['timeColumns']!r} are not all columns")
        if not form:
            raise ValueError("timeColumns needs a dateFormat")
    else:
        times = [k for k in [role("timeColumn", TIME)] if k >= 0]
    return Header(names, separator, role("latColumn", LAT), role("lonColumn", LON), times, form, parameters)


def number(text: Column) -> Column:
    """A number, with the spellings of NaN and infinity; NULL for anything else."""
    low = F.lower(F.trim(text))
    return (F.when(low == "nan", F.lit(float("nan"))).when(low.isin("inf", "infinity", "+inf", "+infinity"), F.lit(float("inf")))
             .when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(low.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d+)?$"), low.try_cast("double")))


def checked(value: Column, low: float, high: float, what: str) -> Column:
    """A coordinate in its range (NaN passes); anything else fails the query."""
    bad = value.isNull() | (~F.isnan(value) & ((value < low) | (value > high)))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{what} out of range or missing: "), F.coalesce(value.cast("string"), F.lit("none")))).cast("double")).otherwise(value)


def read_points(spark: SparkSession, path: str, date_format: str | None = DEFAULT_FORMAT) -> tuple[DataFrame, Header]:
    """All columns by name, and the header; rec_id ascends with the lines."""
    text = numbered_lines(spark, [path]).select(F.col("line").alias("value"), F.col("seq").alias("rec_id"))
    rows = text.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    found = rows.agg(F.min("rec_id").alias("at"), F.min_by("value", "rec_id").alias("names")).first()
    if found.at is None:
        raise ValueError("a point file needs a header line")
    other = text.filter(~F.col("value").startswith("#")).agg(F.min("rec_id")).scalar()
    leading = text.filter(F.col("value").startswith("#") & F.col("value").contains("=") & (F.col("rec_id") < other)).orderBy("rec_id").limit(PARAMETERS)
    header = read_header([*[r[0] for r in leading.select("value").collect()], found.names], None if date_format == DEFAULT_FORMAT else date_format)
    parts = F.split("value", "\\Q" + header.separator + "\\E", -1)
    cells = [F.nullif(F.trim(F.get(parts, F.lit(k))), F.lit("")).alias(f"c{k}") for k in range(len(header.names))]
    rows = rows.filter(F.col("rec_id") != found.at).select("rec_id", *cells)
    lead = rows.agg(*[F.min_by(f"c{k}", F.when(F.col(f"c{k}").isNotNull(), F.col("rec_id"))).alias(f"c{k}") for k in range(len(header.names))])
    types = lead.select(*[number(F.col(c)).isNotNull().alias(c) for c in lead.columns]).first()
    typed = []
    for k, name in enumerate(header.names):
        c = F.col(f"c{k}")
        typed.append((F.when(c.isNotNull(), F.coalesce(number(c), F.lit(float("nan")))) if types[k] else c).alias(name))
    return rows.select("rec_id", *typed), header


def records(spark: SparkSession, path: str, date_format: str | None = DEFAULT_FORMAT) -> DataFrame:
    """rec_id, time_ms (NULL if the file has no time), lon, lat."""
    rows, header = read_points(spark, path, date_format)
    if not header.has_location:
        raise ValueError("a point file needs latitude and longitude columns")
    quoted = [F.col(f"`{n}`") for n in header.names]
    types = dict(rows.dtypes)
    parts = [F.when(quoted[k].isNotNull(), quoted[k].cast("long").cast("string")) if types[header.names[k]] == "double" and len(header.time) > 1 else quoted[k].cast("string") for k in header.time]
    time = F.unix_millis(F.to_timestamp(F.concat_ws(",", *parts) if len(parts) > 1 else parts[0], header.date_format or DEFAULT_FORMAT)) if parts else F.lit(None).cast("long")
    return rows.select("rec_id", time.alias("time_ms"), checked(quoted[header.lon].cast("double"), -180, 360, "longitude").alias("lon"), checked(quoted[header.lat].cast("double"), -90, 90, "latitude").alias("lat"))
