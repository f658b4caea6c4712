"""All registered queries. Importing this package fills the registry."""

from importlib import import_module

MODULES = ("trips", "stations", "speeds", "weather", "fusion", "imu", "missions", "signals", "rovers", "tables", "streams", "texts")

for _name in MODULES:
    import_module(f"sensorlith.queries.{_name}")
