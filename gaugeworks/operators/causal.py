"""Features from neighbours as they were known at the time, for all channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import columns as C
from gaugeworks.functions.columns import rounded
from gaugeworks.operators import timeline as TL

K = ("station_id", "hour_utc")
LAGS, WINDOWS = (1, 3, 24), (6, 24)


def registry_of(hours: DataFrame) -> DataFrame:
    """``(station_id, latitude, longitude, install_utc)`` of the stations that
    have an hour with data: installed with the first of them, at a made-up place
    by a hash of the id, within four degrees each way."""
    part = lambda a: F.conv(F.substring(F.md5(F.col("station_id").cast("binary")), a, 6), 16, 10).cast("long") % 4000 / 1000.0
    own = hours.where("data_present = 1").groupBy("station_id").agg(F.min("hour_utc").alias("install_utc"))
    return own.select("station_id", (30.0 + part(1)).alias("latitude"), (10.0 + part(7)).alias("longitude"), "install_utc")


def neighbours(registry: DataFrame, radius_km: float) -> DataFrame:
    """``(station_id, neighbour_id, distance_km, valid_from)``: ordered pairs of
    stations within ``radius_km``, as long as the neighbour is installed. Rows
    without a place or an install hour have no neighbours and are none.

    Stations meet in cells of latitude bands as high as the radius; a cell is as
    wide as the radius at the band's end, so that it has as many stations near
    the poles as elsewhere, and cells close around the globe.
    """
    height = radius_km / 110.0
    known = registry.where("latitude is not null and longitude is not null and install_utc is not null and not isnan(latitude) and not isnan(longitude)")
    band = F.floor(F.col("latitude") / height)

    def cells(b: Column) -> Column:
        """How many cells a band has, by its greatest latitude and that around."""
        far = F.least(F.greatest(F.abs((b - 1) * height), F.abs((b + 2) * height)), F.lit(90.0))
        return F.greatest(F.floor(360.0 * F.cos(F.radians(far)) / height), F.lit(1))

    def cell(b: Column) -> Column:
        return F.pmod(F.floor(F.pmod(F.col("longitude"), F.lit(360.0)) / (360.0 / cells(b))), cells(b))

    a = known.select("station_id", F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lon"), "longitude", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.pmod(cell(F.col("band")) + s, cells(F.col("band")))))
    a = a.withColumn("cell", F.explode(around)).drop("longitude")
    b = known.select(F.col("station_id").alias("neighbour_id"), F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"), F.col("install_utc").alias("valid_from"), band.alias("band"), cell(band).alias("cell"))
    km = C.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    pairs = a.join(b, ["band", "cell"]).where("station_id <> neighbour_id").withColumn("distance_km", rounded(km, 6))
    return pairs.where(F.col("distance_km") <= radius_km).select("station_id", "neighbour_id", "distance_km", "valid_from")


def spatial_now(hours: DataFrame, edges: DataFrame, channels: list[str], least: int = 2) -> DataFrame:
    """``(station_id, hour_utc, near_<c>, residual_<c>, ...)`` of every row of
    ``hours``: how many neighbours that are valid by then have a value of each
    channel in this very hour, and the row's own value less their median; null
    under ``least`` of them. All channels share one join and one aggregation."""
    values = hours.select(F.col("station_id").alias("neighbour_id"), "hour_utc", *[F.col(c).alias(f"v_{c}") for c in channels])
    some = F.coalesce(*[F.col(f"v_{c}") for c in channels]).isNotNull()
    met = values.where(some).join(edges, "neighbour_id").where("hour_utc >= valid_from")
    around = met.groupBy(*K).agg(*[x for c in channels for x in (F.median(f"v_{c}").alias(f"m_{c}"), F.count(f"v_{c}").alias(f"n_{c}"))])
    out = hours.select(*K, *channels).join(around, list(K), "left")
    return out.select(
        *K, *[F.coalesce(f"n_{c}", F.lit(0)).alias(f"near_{c}") for c in channels],
        *[F.when(F.col(f"n_{c}") >= least, F.col(c) - F.col(f"m_{c}")).alias(f"residual_{c}") for c in channels],
    )


def summaries(rows: DataFrame, columns: list[str], lags=LAGS, windows=WINDOWS) -> DataFrame:
    """``rows`` with, per column, its change over ``lags`` hours and the mean,
    population deviation, least and greatest of the hours strictly before. All
    of them read one order of a station's hours."""
    order, out = TL.by("station_id"), {}
    for c in columns:
        for k in lags:
            out[f"{c}_delta_{k}h"] = F.col(c) - F.lag(c, k).over(order)
        for w in windows:
            p = TL.prior(w, "station_id")
            out |= {f"{c}_mean_{w}h": F.avg(c).over(p), f"{c}_std_{w}h": F.stddev_pop(c).over(p), f"{c}_min_{w}h": F.min(c).over(p), f"{c}_max_{w}h": F.max(c).over(p)}
    return rows.withColumns(out)


def spatial_features(grid: DataFrame, channels: list[str], radius_km: float, least: int = 2) -> DataFrame:
    """Residuals to the neighbours known at the time, now and in summary, of
    every row of a grid; the registry is that of the rows themselves, so rows of
    the future change nothing before them."""
    now = spatial_now(grid, neighbours(registry_of(grid), radius_km), channels, least)
    return summaries(now, [f"residual_{c}" for c in channels])


def detector_counts(rows: DataFrame, flags: list[str], hours: int = 24) -> DataFrame:
    """``rows`` with how many of the last ``hours`` hours, the row's own
    included, had each flag."""
    w = TL.back(hours, "station_id")
    return rows.withColumns({f"{f}_count_{hours}h": F.sum(F.coalesce(F.col(f), F.lit(False)).cast("int")).over(w) for f in flags})


def forecast_features(grid: DataFrame, reference: DataFrame, channels: list[str], lags=LAGS, windows=WINDOWS) -> DataFrame:
    """Per row of a grid and for every channel: the value now and its residual to
    the reference of the hour (``raw_<c>``, ``ext_<c>``), their changes and the
    summaries of the hours before, and whether the station sends, with its count
    of hours that it did not. Nothing reads a later hour; all windows share one
    order of a station's hours."""
    own = grid.join(reference, "hour_utc", "left").select(
        *K, (F.col("data_present") == 0).alias("absent"), *[F.col(c).alias(f"raw_{c}") for c in channels], *[(F.col(c) - F.col(f"ref_{c}")).alias(f"ext_{c}") for c in channels]
    )
    return detector_counts(summaries(own, [f"{n}_{c}" for c in channels for n in ("raw", "ext")], lags, windows), ["absent"])
