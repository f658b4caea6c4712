"""Sensor, mobility and robot-reliability analytics as Spark DataFrame jobs."""
