"""Gridded, registered and mobile population, stops, weather and POI records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.cleaning import code, counted, dong_key, first_existing, first_filled, in_box, joined_names, number, ratio, require, standard_name, truthy, whole

#: Columns of the grid population files.
GRID_COLUMNS = {"hour": "시간", "grid": "250M격자", "living": "생활인구합계"}
SENIOR_COLUMNS = ("남자 65~69세", "남자 70세 이상", "여자 65~69세", "여자 70세 이상")


def mean_by_hour(rows: DataFrame, grid: str, hour: str, living: str) -> DataFrame:
    return rows.groupBy(F.col(grid).alias("grid_id"), F.col(hour).alias("hour")).agg(F.avg(F.coalesce(number(living), F.lit(0.0))).alias("mean_living_population"))


def summarise_grid(rows: DataFrame, grid: str, hour: str, living: str, seniors: Sequence[str] = ()) -> DataFrame:
    """A row per grid cell: means and maxima, and means by day (9-17), night (0-5, 20-23) and commute (7-9, 18-20); a NULL cell is kept."""
    value = F.coalesce(number(living), F.lit(0.0))
    old = sum((F.coalesce(number(c), F.lit(0.0)) for c in seniors), F.lit(0.0))
    at = number(hour)
    times = {"daytime": at.between(9, 17), "nighttime": at.between(0, 5) | at.between(20, 23), "commute": at.between(7, 9) | at.between(18, 20)}
    out = rows.groupBy(F.col(grid).alias("grid_id")).agg(
        F.count("*").alias("observed_rows"), F.avg(value).alias("mean_living_population"), F.max(value).alias("max_living_population"),
        F.avg(old).alias("mean_senior_population"), F.max(old).alias("max_senior_population"),
        *(F.avg(F.when(t, value)).alias(f"{n}_mean_population") for n, t in times.items()),
    )
    return out.withColumn("senior_share_mean", ratio("mean_senior_population", "mean_living_population"))


def join_grid(cells: DataFrame, summary: DataFrame, key: str = "CELL_ID") -> DataFrame:
    """All cells, with livingpop_joined."""
    return cells.join(summary, F.col(key) == F.col("grid_id"), "left").withColumn("livingpop_joined", F.col("grid_id").isNotNull())


#: Columns of the mobility file.
MOBILITY = {
    "month": "대상연월", "weekday": "요일", "hour": "도착시간", "origin": "출발 행정동 코드", "destination": "도착 행정동 코드", "sex": "성별", "age": "나이",
    "trip_type": "이동유형", "move_pop": "move_pop", "masked_count": "masked_count", "avg_move_time_min": "avg_move_time_min",
}


def prepare_trips(trips: DataFrame, names: dict[str, str] = MOBILITY) -> DataFrame:
    """Typed trips; rows without an hour are dropped."""
    require(trips, list(names.values()))
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    return trips.select(
        c["month"].cast("string").alias("month"), c["weekday"].cast("string").alias("weekday"), whole(c["hour"]).alias("hour"), code(c["origin"]).alias("origin"),
        code(c["destination"]).alias("destination"), c["trip_type"].cast("string").alias("trip_type"), F.coalesce(number(c["move_pop"]), F.lit(0.0)).alias("move_pop"),
        F.coalesce(number(c["masked_count"]), F.lit(0.0)).alias("masked_count"), number(c["avg_move_time_min"]).alias("time_min"),
    ).where("hour is not null")


def _marked(trips: DataFrame, codes: DataFrame) -> DataFrame:
    """Trips with whether each end is one of the codes."""
    known = codes.select(F.col("code").cast("string").alias("code")).where("code is not null").distinct()
    a, b = known.select(F.col("code").alias("origin"), F.lit(True).alias("_o")), known.select(F.col("code").alias("destination"), F.lit(True).alias("_d"))
    return trips.join(a, "origin", "left").join(b, "destination", "left").withColumn("origin_in", F.col("_o").isNotNull()).withColumn("destination_in", F.col("_d").isNotNull()).drop("_o", "_d")


def mobility_by_code(trips: DataFrame, codes: DataFrame, peak_hours: Sequence[int] = (7, 8, 9, 17, 18, 19)) -> DataFrame:
    """Sixteen figures for every code (0 where nothing moves): each trip counts once for its origin and once for its destination.

    trips: what prepare_trips() gives; codes: a table with a column code.
    """
    marked = _marked(trips, codes)
    inside, peak, work = F.col("origin_in") & F.col("destination_in"), F.col("hour").isin(*peak_hours), F.coalesce(F.col("trip_type").isin("HW", "WH"), F.lit(False))
    ends = marked.select(
        F.explode(F.array(
            F.when(F.col("origin_in"), F.struct(F.lit("o").alias("role"), F.col("origin").alias("code"))),
            F.when(F.col("destination_in"), F.struct(F.lit("d").alias("role"), F.col("destination").alias("code"))),
        )).alias("end"),
        "move_pop", "time_min", (F.col("origin") == F.col("destination")).alias("same"), inside.alias("inside"), peak.alias("peak"), work.alias("work"),
    ).where("end is not null").select("end.*", "move_pop", "time_min", "same", "inside", "peak", "work")
    from_, to = F.col("role") == "o", F.col("role") == "d"
    total = lambda test: F.sum(F.when(test, F.col("move_pop")).otherwise(0.0))
    timed = F.col("time_min").isNotNull() & (F.col("move_pop") > 0)
    mean = lambda side: ratio(F.sum(F.when(side & timed, F.col("move_pop") * F.col("time_min"))), F.sum(F.when(side & timed, F.col("move_pop"))))
    sums = {
        "mobility_departures": from_, "mobility_arrivals": to, "mobility_internal_trips": from_ & F.col("same"), "mobility_seoul_internal_departures": from_ & F.col("inside"),
        "mobility_seoul_internal_arrivals": to & F.col("inside"), "mobility_outbound_to_nonseoul": from_ & ~F.col("inside"), "mobility_inbound_from_nonseoul": to & ~F.col("inside"),
        "mobility_peak_departures": from_ & F.col("peak"), "mobility_peak_arrivals": to & F.col("peak"), "mobility_home_work_departures": from_ & F.col("work"),
        "mobility_home_work_arrivals": to & F.col("work"),
    }
    found = ends.groupBy("code").agg(
        *(total(t).alias(n) for n, t in sums.items()), mean(from_).alias("mobility_origin_avg_move_time_min"), mean(to).alias("mobility_destination_avg_move_time_min")
    )
    out = codes.select(F.col("code").cast("string").alias("code")).where("code is not null").distinct().join(found, "code", "left").fillna(0.0, subset=list(sums))
    return out.withColumns({
        "mobility_total_trips": F.col("mobility_departures") + F.col("mobility_arrivals"), "mobility_peak_total_trips": F.col("mobility_peak_departures") + F.col("mobility_peak_arrivals"),
        "mobility_net_inflow": F.col("mobility_arrivals") - F.col("mobility_departures"),
    }).withColumnRenamed("code", "mobility_admin_code")


def mobility_quality(trips: DataFrame, codes: DataFrame) -> DataFrame:
    """One row: rows, totals, distinct values, and distinct pairs with an end inside (counted exactly, as a distinct aggregation)."""
    marked = _marked(trips, codes)
    active = F.col("origin_in") | F.col("destination_in")
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    pairs = marked.where(active).select("origin", "destination").distinct().agg(F.count("*").alias("od_pair_count"))
    sums = marked.agg(
        F.count("*").alias("used_row_count"), F.count_if(F.col("move_pop") <= 0).alias("zero_or_negative_move_pop_count"), F.sum("move_pop").alias("total_move_pop"),
        F.sum("masked_count").alias("total_masked_count"), texts("hour").alias("hour_values"), texts("trip_type").alias("trip_type_values"),
    )
    return sums.crossJoin(F.broadcast(pairs))  # one row each


def unmatched_codes(trips: DataFrame, codes: DataFrame, end: str = "origin", prefix: str = "11", top: int = 10) -> DataFrame:
    """Codes with the city's prefix that the dimension lacks, by moves: a top-k report (ties by code)."""
    known = codes.select(F.col("code").cast("string").alias(end))
    some = trips.where(F.col(end).startswith(prefix)).join(known, end, "left_anti")
    return some.groupBy(F.col(end).alias("code")).agg(F.sum("move_pop").alias("move_pop")).orderBy(F.desc("move_pop"), "code").limit(top)


def mobility_code(admin_code) -> Column:
    """First seven digits of an administrative code."""
    return F.substring(F.col(admin_code).cast("string"), 1, 7)


def dissolve(areas: DataFrame, by: Column, key: str, names: Sequence[str], tile: float = 5000.0) -> DataFrame:
    """One row per key: comma-joined distinct names, number of parts, the first name's first word as district, surface of the parts' union.

    The union itself is spatial.union_pieces(), a row for each tile.
    """
    from terrane.operators.spatial import union_pieces

    keyed = areas.withColumn(key, by)
    sums = keyed.groupBy(key).agg(*(joined_names(n).alias(f"{n}s") for n in names), F.count("*").alias("parts"), F.min(F.split(F.col(names[-1]), " ")[0]).alias("district"))
    return sums.join(union_pieces(keyed, key, tile).groupBy(key).agg(F.sum("area").alias("area")), key, "left")


def mobility_demand(spread: DataFrame) -> DataFrame:
    """Cells with net inflow, both norms (missing as 0) and their mean."""
    from terrane.functions.scaling import scaled_all

    out = spread.withColumn("mobility_net_inflow", F.col("mobility_arrivals") - F.col("mobility_departures"))
    out = scaled_all(out, {"mobility_total_norm": "mobility_total_trips", "mobility_peak_norm": "mobility_peak_total_trips"}, missing_as_zero=True)
    return out.withColumn("mobility_index", (F.col("mobility_total_norm") + F.col("mobility_peak_norm")) / 2)


#: Districts by the first five digits of a boundary code; rows of the whole city; names that merged into one boundary.
DISTRICTS = {
    "11010": "종로구", "11020": "중구", "11030": "용산구", "11040": "성동구", "11050": "광진구", "11060": "동대문구", "11070": "중랑구", "11080": "성북구", "11090": "강북구",
    "11100": "도봉구", "11110": "노원구", "11120": "은평구", "11130": "서대문구", "11140": "마포구", "11150": "양천구", "11160": "강서구", "11170": "구로구", "11180": "금천구",
    "11190": "영등포구", "11200": "동작구", "11210": "관악구", "11220": "서초구", "11230": "강남구", "11240": "송파구", "11250": "강동구",
}
CITY_NAMES = ("서울시", "서울특별시")
REGISTERED_ALIASES = [("동대문구", "용두동", "용신동"), ("동대문구", "신설동", "용신동")]
ALIAS_COLUMNS = "district_name string, admin_key string, boundary_key string"


def district_of(admin_code: Column | str) -> Column:
    """District name by the first five digits of a code; NULL where unknown."""
    head = F.substring(F.col(admin_code) if isinstance(admin_code, str) else admin_code, 1, 5)
    return F.create_map(*(F.lit(x) for pair in DISTRICTS.items() for x in pair))[head]


def registered_rows(sheet: DataFrame, order: str = "row_idx", name: str = "name", population: str = "population", senior: str = "senior") -> DataFrame:
    """Dong rows of a population sheet with the district named above them.

    A row that bears a district's name opens it, the city's total closes it;
    rows without a name or any figure don't count. A sheet has some hundred
    rows, so one window orders it.
    """
    label = F.trim(F.col(name))
    typed = sheet.select(F.col(order).alias("_at"), label.alias("admin_name"), counted(population).alias("registered_population"), counted(senior).alias("registered_senior_population"))
    typed = typed.where((F.coalesce("admin_name", F.lit("")) != "") & (F.col("registered_population").isNotNull() | F.col("registered_senior_population").isNotNull()))
    city, district = F.col("admin_name").isin(*CITY_NAMES), F.col("admin_name").isin(*DISTRICTS.values())
    above = F.last(F.when(city, F.lit("")).when(district, F.col("admin_name")), ignorenulls=True).over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = typed.withColumn("district_name", F.nullif(above, F.lit(""))).where(~city & ~district)
    out = out.select("admin_name", "district_name", "registered_population", "registered_senior_population")
    return out.withColumn("registered_senior_share", ratio("registered_senior_population", "registered_population"))


def register_by_boundary(boundary: DataFrame, registered: DataFrame, aliases: DataFrame, prefix: str = "11") -> DataFrame:
    """City boundaries (code, admin_name, district_name) with the registered population of their names; every one must match once.

    aliases: (district_name, admin_key, boundary_key) for names that changed or
    merged. Doubled keys and boundaries without population raise ValueError.
    """
    city = boundary.where(F.col("code").startswith(prefix)).withColumn("_key", standard_name("admin_name"))
    named = registered.withColumn("_own", dong_key("admin_name")).join(
        F.broadcast(aliases.select(F.col("district_name").alias("_ad"), F.col("admin_key").alias("_ak"), "boundary_key")),
        (F.col("district_name") == F.col("_ad")) & (F.col("_own") == F.col("_ak")), "left",
    ).withColumn("_key", F.coalesce("boundary_key", "_own"))
    merged = named.groupBy("district_name", "_key").agg(
        F.sum("registered_population").alias("registered_population"), F.sum("registered_senior_population").alias("registered_senior_population"),
        joined_names("admin_name").alias("registered_source_names"),
    )
    out = validated_join(city, merged, ["district_name", "_key"])
    return out.withColumn("registered_senior_share", ratio("registered_senior_population", "registered_population")).drop("_key")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which each left row must match exactly one right row; keys must be unique on both sides."""
    for side, df in (("left", left), ("right", right)):
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"the {side} table repeats keys")
    if not left.join(right, keys, "left_anti").isEmpty():
        raise ValueError("rows without a match")
    return left.join(right, keys, "left")


def unmatched_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    only = lambda a, b, name: a.select(*keys).distinct().join(b, keys, "left_anti").withColumn("only_in", F.lit(name))
    return only(left, right, "left").union(only(right, left, "right"))


def stop_candidates(rides: DataFrame, mode: str, stop_id: str, stop_name: str, passengers: str = "passengers", lon: str = "lon", lat: str = "lat", flags: Sequence[str] = ("location_matched",)) -> DataFrame:
    """Stops with mean place, sum of passengers and rows, from rides inside the box with all flags set."""
    fit = in_box(lon, lat)
    for flag in flags:
        fit = fit & truthy(flag)
    return rides.where(fit).groupBy(F.lit(mode).alias("mode"), F.col(stop_id).cast("string").alias("stop_id"), F.col(stop_name).alias("stop_name")).agg(
        F.avg(number(lon)).alias("lon"), F.avg(number(lat)).alias("lat"), F.sum(F.coalesce(number(passengers), F.lit(0.0))).alias("passengers_sum"), F.count("*").alias("source_rows")
    )


#: Names that columns of one kind go by.
BUS = {"stop_id": ("standard_bus_stop_id", "표준버스정류장ID"), "stop_name": ("bus_stop_name", "역명"), "month": ("사용년월",)}
SUBWAY = {"stop_id": ("지하철역",), "stop_name": ("지하철역",), "month": ("사용월",)}
POI = {
    "poi_id": ("기관ID", "상가업소번호", "연번"), "name": ("기관명", "상호명", "기관명칭"), "category": ("병원분류명", "상권업종대분류명", "시설종류"),
}


def normalised_stops(rows: DataFrame, mode: str) -> DataFrame:
    """Bus or subway rows under common names; columns that are missing are NULL."""
    has = rows.columns
    names = BUS if mode == "bus" else SUBWAY
    return rows.select(
        F.lit(mode).alias("mode"), *(first_filled(has, v).alias(k) for k, v in names.items()), *(first_existing(has, [c]).alias(c) for c in ("hour", "ride_type")),
        *(number(first_existing(has, [c])).alias(c) for c in ("passengers", "lon", "lat")), *(c for c in ("coord_valid", "location_matched") if c in has),
    )


def normalised_pois(rows: DataFrame, kind: str) -> DataFrame:
    """POI rows of any source under common names."""
    has = rows.columns
    return rows.select(F.lit(kind).alias("poi_type"), *(first_filled(has, v).alias(k) for k, v in POI.items()), *(number(first_existing(has, [c])).alias(c) for c in ("lon", "lat")))


#: Columns of hourly weather files.
ASOS = {"지점": "station_id", "지점명": "station_name", "일시": "observed_at", "기온(°C)": "temp_c", "강수량(mm)": "rain_mm", "풍속(m/s)": "wind_ms", "습도(%)": "humidity_pct", "적설(cm)": "snow_cm"}


def normalised_weather(rows: DataFrame, names: dict[str, str] = ASOS) -> DataFrame:
    """Renamed columns; measures that are missing count as 0 (temperature too); observed_at as a time or NULL."""
    out = rows.withColumnsRenamed(names)
    measures = [c for c in ("temp_c", "rain_mm", "wind_ms", "humidity_pct", "snow_cm") if c in out.columns]
    out = out.withColumns({c: F.coalesce(number(c), F.lit(0.0)) for c in measures})
    return out.withColumn("observed_at", F.try_to_timestamp(F.col("observed_at").cast("string")).cast("timestamp_ntz")) if "observed_at" in out.columns else out


def demand_index(cells: DataFrame, axes: dict[str, str], out: str) -> DataFrame:
    """Mean of min-max scaled axes (missing as 0): axes maps the name of each scaled column to its source."""
    from terrane.functions.cleaning import fill_numeric
    from terrane.functions.scaling import scaled_all

    cells = scaled_all(fill_numeric(cells), axes, missing_as_zero=True)
    return cells.withColumn(out, sum((F.col(n) for n in axes), F.lit(0.0)) / len(axes))


PRELIM_AXES = {"living_population_norm": "living_mean_living_population", "senior_population_norm": "living_mean_senior_population", "poi_total_norm": "poi_total_count"}
FINAL_AXES = {
    "registered_population_norm": "registered_population", "registered_senior_population_norm": "registered_senior_population",
    "living_population_norm": "living_mean_living_population", "poi_total_norm": "poi_total_count",
}


def demand_features(cells: DataFrame, living: DataFrame, pois: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Cells with all features and the preliminary (three axes) or, with registered population, final (four axes) index."""
    out = cells.join(living, "hex_id", "left").join(pois, "hex_id", "left")
    out = out if registered is None else out.join(registered, "hex_id", "left")
    out = demand_index(out, PRELIM_AXES if registered is None else FINAL_AXES, "demand_index_prelim" if registered is None else "demand_index_final")
    out = out.withColumn("living_senior_share_mean", F.coalesce(ratio("living_mean_senior_population", "living_mean_living_population"), F.lit(0.0)))
    return out if registered is None else out.withColumn("registered_senior_share", F.coalesce(ratio("registered_senior_population", "registered_population"), F.lit(0.0)))
