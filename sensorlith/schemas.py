"""Column layouts of the files that are read."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _L, _B = T.DoubleType(), T.StringType(), T.LongType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


POSE = struct(x_m=_D, y_m=_D, yaw_rad=_D)

# Payload fields of all event types together; an event has those of its type.
PAYLOAD = struct(
    truth=POSE,
    estimate=POSE,
    command=struct(left_mps=_D, right_mps=_D),
    gps=struct(available=_B, x_m=_D, y_m=_D),
    localization=struct(pose_error_m=_D, gps_innovation_m=_D),
    mission=struct(waypoint_index=_L, target_x_m=_D, target_y_m=_D),
    control_loop_latency_ms=_D,
    queue_depth=_L,
    cpu_percent=_D,
    dropped_messages=_L,
    name=_S,
    reason=_S,
    waypoint_index=_L,
    waypoints_reached=_L,
    active=_B,
    traction=_D,
)

RUN_EVENT = struct(
    event_id=_S,
    run_id=_S,
    mission_id=_S,
    robot_id=_S,
    software_version=_S,
    event_type=_S,
    sequence=_L,
    event_time_s=_D,
    recorded_at=_S,
    schema_version=_S,
    payload=PAYLOAD,
)

# Columns of a run result, in order.
RESULT_COLUMNS = (
    "run_id scenario_name software_version seed log_path max_time_s gps_period_s gps_noise_std_m waypoint_tolerance_m slip_start_s "
    "slip_end_s left_wheel_traction mission_success waypoints_reached duration_s completion_time_s telemetry_samples localization_rmse_m "
    "localization_max_error_m detector_alerts detector_false_positives detection_latency_s log_sequence_gaps path_length_m path_efficiency "
    "cross_track_rmse_m cross_track_max_error_m"
).split()

_BIKE = struct(
    station_id=_S,
    name=_S,
    short_name=_S,
    lat=_D,
    lon=_D,
    capacity=_L,
    region_id=_S,
    rental_methods=T.ArrayType(_S),
    station_type=_S,
    has_kiosk=_B,
    external_id=_S,
    num_bikes_available=_L,
    num_ebikes_available=_L,
    num_bikes_disabled=_L,
    num_docks_available=_L,
    num_docks_disabled=_L,
    is_installed=_L,
    is_renting=_L,
    is_returning=_L,
    last_reported=_L,
)

_ENVELOPE = {"source_name": _S, "source_url": _S, "observed_at_utc": _S, "fetched_at_utc": _S}

BIKE_SNAPSHOT = struct(
    **_ENVELOPE, payload=struct(last_updated=_L, ttl=_L, version=_S, data=struct(stations=T.ArrayType(_BIKE)))
)

ROAD_SNAPSHOT = struct(
    **_ENVELOPE,
    query=_S,
    row_count=_L,
    payload=T.ArrayType(
        struct(
            link_id=_S,
            data_as_of=_S,
            speed=_S,
            travel_time=_S,
            status=_S,
            borough=_S,
            link_name=_S,
            owner=_S,
            transcom_id=_S,
            link_points=_S,
            encoded_poly_line=_S,
            encoded_poly_line_lvls=_S,
        )
    ),
)

_VALUE = struct(value=_S)
_PERIOD = struct(
    number=_L,
    name=_S,
    startTime=_S,
    endTime=_S,
    isDaytime=_B,
    temperature=_S,
    temperatureUnit=_S,
    probabilityOfPrecipitation=_VALUE,
    relativeHumidity=_VALUE,
    dewpoint=_VALUE,
    windSpeed=_S,
    windDirection=_S,
    shortForecast=_S,
    detailedForecast=_S,
)
_OBSERVED = struct(
    timestamp=_S,
    temperature=_VALUE,
    dewpoint=_VALUE,
    relativeHumidity=_VALUE,
    windSpeed=_VALUE,
    windGust=_VALUE,
    barometricPressure=_VALUE,
    textDescription=_S,
)
_ALERT = struct(
    id=_S, sent=_S, effective=_S, onset=_S, expires=_S, ends=_S, status=_S, messageType=_S, category=_S, severity=_S,
    certainty=_S, urgency=_S, event=_S, headline=_S, areaDesc=_S, description=_S, instruction=_S,
)
WEATHER_SNAPSHOT = struct(
    **_ENVELOPE,
    locations=T.ArrayType(
        struct(
            location_id=_S,
            lat=_D,
            lon=_D,
            point=struct(
                properties=struct(
                    cwa=_S, gridId=_S, gridX=_L, gridY=_L, forecastZone=_S, county=_S, fireWeatherZone=_S, forecastHourly=_S, observationStations=_S
                )
            ),
            hourly_forecast=struct(properties=struct(generatedAt=_S, updateTime=_S, periods=T.ArrayType(_PERIOD))),
            latest_observations=T.ArrayType(
                struct(
                    station=struct(stationIdentifier=_S, name=_S),
                    station_url=_S,
                    observation=struct(properties=_OBSERVED),
                    error=_S,
                )
            ),
            active_alerts=struct(features=T.ArrayType(struct(id=_S, properties=_ALERT))),
        )
    ),
)
