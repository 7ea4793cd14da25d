"""stationlake: weather-station telemetry on Spark DataFrames.

Reports are decoded, validated, resolved to allow-listed stations, converted
to metric units and stored with latest-wins upserts; 1m / 1h / 1d rollups
(count, mean, min, max, sample std, mode) are kept for every numeric field.
Every operator is a DataFrame -> DataFrame function; nothing is collected to
the driver.
"""

__version__ = "0.1.0"
